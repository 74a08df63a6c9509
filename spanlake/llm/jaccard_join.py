"""Documents whose word shingles have a Jaccard similarity at or above a threshold, by partitioning the universe.

Sets fall into size bands. For the larger set of a pair in a band, the threshold bounds the number H of shingles that only
one of the two holds. The universe of shingles is hashed into segments:

* exact: H + 1 + slack segments, of which at least slack + 1 are the same in both sets. slack follows the number of empty
  segments to be expected of a band's sets. Each set is indexed by the contents
  of its segments. Segments of few shingles, which chance or a shared passage makes equal, get no entry: those of WEAK or
  fewer, or of one less, and so on, as far as a set has at most slack of them. Two similar sets still share one that both
  index, as the larger of their two limits leaves out at most slack of the segments that are the same.
* one deletion: (H + 1) / 2 segments, of which at least one differs by one shingle at most. Each is indexed whole and without
  each of its shingles.

A band takes the scheme that costs less: one deletion where a set has so few shingles that its segments hold four or five and
chance matches would cost most, and exact elsewhere, as it has a fifth of the entries. Of sets that share an entry, pairs whose shingles fall too
differently on the parts of the universe are dropped: the sum of their counts' differences bounds from below what only one holds. The others are
compared by their shingles, in tiles of bounded size; a link counts only once the words themselves confirm it. Copies count once: a set is
known by a 128-bit BLAKE2 digest of its shingles' words.

Many sets that share entries are first compared with a few pivots among them. Those that a pivot ties together need no further comparison with
each other; only what is left over meets all others. So a group of near copies costs about its size, not its square.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.arrays import Words, byte_texts, equal_groups, mix, pieces, short_hashes, words_of
from spanlake.llm.components import connected_components
from spanlake.llm.frames import column, cut

PIECE_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20
WEAK = 2
#: Members and shingles of one side of a tile.
TILE_SETS, TILE_SHINGLES = 512, 2_000_000
#: The largest set of the bands that are indexed with one deletion.
DELETE_TOP = 24
#: Sets that share an entry up to which they are paired; more are laid out in tiles.
PAIR_SETS = 48
#: Members of a large group that all its others are compared with first.
PIVOTS = 8
#: Shingles whose words are held at once when a link is confirmed.
CONFIRMED_SHINGLES = 500_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Bands:
    """Size bands and their scheme for similarities of percent / 100 and more."""

    def __init__(self, percent: int):
        if not 1 <= percent <= 100:
            raise ValueError("percent must be from 1 to 100")
        self.percent = percent
        tops = [0]
        # at 100 only equal sets link, and those have one key: no band has entries
        while tops[-1] < 1 << 31 and percent < 100:
            tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
        if percent == 100:
            tops += [1 << 31, 1 << 32]
        self.tops = np.array(tops[1:], dtype=np.int64)
        self.differ = (100 - percent) * 2 * self.tops // (100 + percent)
        n, h = self.tops * (percent / 100) ** 2, self.differ
        self.slack = np.zeros(len(n), dtype=np.int64)
        for _ in range(4):  # the empty segments that are to be expected of a band's smaller sets, and three deviations more
            exact = h + 1 + self.slack
            empty = exact * np.exp(-n / exact)
            self.slack = np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64)
        exact = h + 1 + self.slack
        halves = (h + 2) // 2
        self.deletes = self.tops <= DELETE_TOP
        self.segments = np.where(self.deletes, halves, exact)


def _spans_of(words: Words, a: int, b: int, width: int) -> int:
    """How many words a shingle of a text with words a to b has: `width`, or all of a shorter text's."""
    return min(width, b - a)


def _sets(texts: list[bytes], width: int, keyed: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after the other in order, where each text's begin, and with `keyed` each set's key.

    A key is the digest of the words of all shingles in order of their hashes, as a row of two integers.
    """
    words = words_of([(t or b"").translate(_LOWER) for t in texts])
    hashes = words.hashes()
    grams = short_hashes(hashes, width)
    out, sizes, keys = [], [], []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        n = _spans_of(words, a, b, width)
        mine = grams[a : b - width + 1] if n == width else short_hashes(hashes[a:b], n) if n else grams[:0]
        if keyed:
            one, at = np.unique(mine, return_index=True)
            raw = words.raw
            held = [raw[i:j] for i, j in zip(words.starts[a + at].tolist(), words.ends[a + at + n - 1].tolist())]
            keys.append(hashlib.blake2b(b"\n".join(held), digest_size=16).digest())
        else:
            one = np.unique(mine)
        out.append(one)
        sizes.append(len(one))
    first = np.zeros(len(sizes) + 1, dtype=np.int64)
    np.cumsum(sizes, out=first[1:])
    return np.concatenate(out) if out else grams[:0], first, np.frombuffer(b"".join(keys), dtype=np.uint64).reshape(-1, 2)


def _confirmed(x: bytes, y: bytes, percent: int, width: int) -> bool:
    """Whether two texts link, by their words, a bounded part of the shingles at a time."""
    sides = []
    for text in (x, y):
        words = words_of([text.translate(_LOWER)])
        n = _spans_of(words, 0, len(words), width)
        sides.append((words, n, short_hashes(words.hashes(), n)))
    parts = np.uint64(1 + sum(len(g) for _, _, g in sides) // CONFIRMED_SHINGLES)
    shared = size = 0
    for k in range(int(parts)):
        a, b = ({w.slice(i, n) for i in np.flatnonzero(g % parts == k).tolist()} for w, n, g in sides)
        shared += len(a & b)
        size += len(a) + len(b)
    return 100 * shared >= percent * (size - shared)


def _key_array(keys: np.ndarray) -> pa.Array:
    return pa.array([k.tobytes() for k in np.ascontiguousarray(keys)], pa.binary())


def _outlines(tokens: np.ndarray, first: np.ndarray) -> list[bytes]:
    """How many of each set's shingles fall on each part of the universe, two parts a byte, 15 standing for more.

    A set of n has between n / 4 and n / 2 parts, a power of two; those of a smaller power are sums of neighbours.
    """
    n = np.diff(first)
    bits = np.maximum(1, np.floor(np.log2(np.maximum(n, 4))).astype(np.int64) - 1)
    base = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(1 << bits, out=base[1:])
    owner = np.repeat(np.arange(len(n)), n)
    part = (mix(tokens ^ np.uint64(0x1B873593)) >> (np.uint64(64) - bits[owner].astype(np.uint64))).astype(np.int64)
    count = np.minimum(np.bincount(base[owner] + part, minlength=base[-1]), 15).astype(np.uint8)
    packed = (count[::2] | count[1::2] << 4).tobytes()
    return [packed[a // 2 : b // 2] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


def _counts(outline: bytes, parts: int) -> np.ndarray:
    both = np.frombuffer(outline, dtype=np.uint8)
    out = np.empty(2 * len(both), dtype=np.int64)
    out[::2], out[1::2] = both & 15, both >> 4
    return np.minimum(out.reshape(parts, -1).sum(axis=1), 15)


def _possible(percent: int):
    """Pairs that their outlines let be similar enough."""

    def possible(batches):
        for part in batches:
            keep = []
            for n, m, a, b in zip(*(part.column(part.schema.get_field_index(k)).to_pylist() for k in ("n", "other_n", "outline", "other_outline"))):
                parts = 2 * min(len(a), len(b))
                keep.append(int(np.abs(_counts(a, parts) - _counts(b, parts)).sum()) * (100 + percent) <= (100 - percent) * (n + m))
            yield part.select(["key", "other"]).filter(pa.array(keep, pa.bool_()))

    return possible


def _describe(width: int):
    def described(batches):
        for part in pieces(batches, "text", PIECE_BYTES):
            tokens, first, keys = _sets(byte_texts(part.column(1)), width, keyed=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), _key_array(keys), pa.array(_outlines(tokens, first), pa.binary())], names=["doc_id", "n", "key", "outline"])

    return described


def _entries(tokens: np.ndarray, first: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(set's index, hash) of every index entry."""
    n = np.diff(first)
    own = np.searchsorted(bands.tops, n)
    owners, hashes = [], []
    for up in (0, 1):
        level = own + up
        use = (n > 0) & (bands.differ[level] > 0)
        if up:
            use &= n * 100 >= bands.percent * (bands.tops[own] + 1)
        sets = np.flatnonzero(use)
        if not len(sets):
            continue
        m = np.where(use, bands.segments[level], 0)
        base = np.zeros(len(n) + 1, dtype=np.int64)
        np.cumsum(m, out=base[1:])
        owner = np.repeat(np.arange(len(n)), n)
        inside = use[owner]
        owner, token = owner[inside], tokens[inside]
        spread = mix(token ^ np.uint64(0x6A09E667))
        segment = base[owner] + ((spread >> np.uint64(33)).astype(np.int64) * m[owner] >> 31)
        value = mix(token ^ np.uint64(0x3C6EF372))
        low, high = (value & np.uint64((1 << 30) - 1)).astype(np.float64), (value >> np.uint64(34)).astype(np.float64)
        count = np.bincount(segment, minlength=base[-1])
        lows, highs = (np.bincount(segment, weights=x, minlength=base[-1]).astype(np.uint64) for x in (low, high))  # exact: below 2**53
        of = np.repeat(np.arange(len(n)), m)
        place = mix((np.arange(base[-1]) - base[of]).astype(np.uint64) * np.uint64(0x10001) + level[of].astype(np.uint64) * np.uint64(0x9E3779B9))
        deletes = bands.deletes[level]
        limit = np.full(len(n), -1)
        for k in range(WEAK + 1):
            limit[np.bincount(of, weights=count <= k, minlength=len(n)) <= bands.slack[level]] = k
        entry = (count > limit[of]) | deletes[of]
        owners.append(of[entry])
        hashes.append(mix((lows + (highs << np.uint64(32)) * np.uint64(3)) ^ place)[entry])
        less = deletes[owner]
        if less.any():
            s = segment[less]
            owners.append(owner[less])
            rest = (lows[s] - low[less].astype(np.uint64)) + ((highs[s] - high[less].astype(np.uint64)) << np.uint64(32)) * np.uint64(3)
            hashes.append(mix(rest ^ place[s]))
    if not owners:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(owners), np.concatenate(hashes)


def _index(width: int, bands: Bands, buckets: int):
    def indexed(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for part in pieces(batches, "text", PIECE_BYTES):
            tokens, first, keys = _sets(byte_texts(part.column(1)), width, keyed=True)
            fresh = np.zeros(len(keys), dtype=bool)  # copies in one piece are indexed once
            fresh[np.unique(keys, axis=0, return_index=True)[1]] = True
            n = np.where(fresh, np.diff(first), 0)
            inside = np.repeat(fresh, np.diff(first))
            tokens, first = tokens[inside], np.append(0, np.cumsum(n))
            owner, entry = _entries(tokens, first, bands)
            bucket = ((entry >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket * len(n) + owner, kind="stable")
            owner, entry, bucket = owner[order], (entry[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), bucket[order]
            if not len(bucket):
                continue
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            rows = {"bucket": [], "entries": [], "counts": [], "sets": []}
            for p, q in zip(cuts[:-1], cuts[1:]):
                sets, count = np.unique(owner[p:q], return_counts=True)
                rows["bucket"].append(int(bucket[p]))
                rows["entries"].append(entry[p:q].tobytes())
                rows["counts"].append(squeeze.compress(np.stack([count, n[sets]]).astype(np.uint32).tobytes()))
                rows["sets"].append(keys[sets].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int64()), *(pa.array(rows[k], pa.binary()) for k in ("entries", "counts", "sets"))], names=list(rows))

    return indexed


def _groups(percent: int):
    """Sets that share an entry: pairs (key, other) of a small group, and the members of a large one, with its name and size."""

    def grouped(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        entries, keys, sizes, each = [], [], [], []
        for blob, counts, sets in zip(*(table.column(k).to_pylist() for k in ("entries", "counts", "sets"))):
            count, n = np.frombuffer(expand.decompress(counts), dtype=np.uint32).reshape(2, -1)
            entries.append(np.frombuffer(blob, dtype=np.uint32))
            keys.append(np.frombuffer(sets, dtype="V16"))
            sizes.append(n)
            each.append(count)
        keys, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        keys, sizes = keys.view(np.uint64).reshape(-1, 2), np.concatenate(sizes).astype(np.int64)[first]
        owner, entries = np.repeat(number, np.concatenate(each)), np.concatenate(entries)
        index, begins = equal_groups(entries.astype(np.uint64) << np.uint64(32))
        cuts = np.append(np.flatnonzero(begins), len(index))
        low, high, large, seen = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [], set()
        for p, q in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            sets = np.unique(owner[index[p:q]])
            if len(sets) < 2:
                continue
            name = hashlib.blake2b(keys[sets].tobytes(), digest_size=8).digest()
            if name in seen:
                continue
            seen.add(name)
            n = sizes[sets]
            if len(sets) <= PAIR_SETS:
                i, j = np.triu_indices(len(sets), 1)
                near = np.minimum(n[i], n[j]) * 100 >= percent * np.maximum(n[i], n[j])
                low.append(sets[i[near]])
                high.append(sets[j[near]])
            else:
                large.append((int.from_bytes(name, "little", signed=True), sets))
        pairs = np.unique(np.stack([np.concatenate(low), np.concatenate(high)], axis=1), axis=0)
        first = np.concatenate([pairs[:, 0], *(s for _, s in large)])
        names = _key_array(keys)
        none = [None] * len(pairs)
        flat = lambda values: np.concatenate([np.zeros(0, dtype=np.int64), *(np.full(len(s), v) for v, (_, s) in zip(values, large))]).astype(np.int64).tolist()
        return pa.table(
            {
                "key": names.take(pa.array(first)),
                "other": pa.concat_arrays([names.take(pa.array(pairs[:, 1])), pa.nulls(len(first) - len(pairs), pa.binary())]),
                "n": sizes[first],
                "name": pa.array(none + flat([v for v, _ in large]), pa.int64()),
                "size": pa.array(none + flat([len(s) for _, s in large]), pa.int64()),
            }
        )

    return grouped


def _squeezed(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for part in pieces(batches, "text", PIECE_BYTES):
        texts = [squeeze.compress(t or b"") for t in byte_texts(part.column(1))]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["doc_id", "squeezed"])


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left shares with each on the right, block by block of the shingles that more than one holds."""
    every = np.concatenate(left + (right if right is not left else []))
    distinct, count = np.unique(every, return_counts=True)
    common = distinct[count > 1]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    step = max(256, (8 << 20) // (len(left) + len(right)))
    for at in range(0, len(common), step):
        block = common[at : at + step]

        def matrix(sets):
            held = np.zeros((len(sets), len(block)), dtype=np.float32)
            for i, one in enumerate(sets):
                where = np.searchsorted(block, one[np.searchsorted(one, block[0]) : np.searchsorted(one, block[-1], "right")])
                part = one[np.searchsorted(one, block[0]) : np.searchsorted(one, block[-1], "right")]
                held[i, where[block[where] == part]] = 1
            return held

        a = matrix(left)
        out += a @ (a if right is left else matrix(right)).T
    return out


def _compare(percent: int, width: int):
    """What the links of a tile connect: (a, b), b being the least id on side 0 that a is connected with."""

    def compared(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        rep = table.column("rep").to_numpy()
        expand = zstandard.ZstdDecompressor()
        texts = [expand.decompress(t) for t in table.column("squeezed").to_pylist()]
        every, first, _ = _sets(texts, width)
        tokens = [every[a:b] for a, b in zip(first[:-1], first[1:])]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        alone = not len(right)
        right = left if alone else right
        a, b = [tokens[i] for i in left], [tokens[i] for i in right]
        if len(a) == 2 and alone:
            shared = np.zeros((2, 2))
            shared[1, 0] = len(a[0]) + len(a[1]) - len(np.unique(np.concatenate(a)))
        else:
            shared = _shared(a, a if alone else b)
        both = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - shared
        hit = shared * 100 >= percent * both
        if alone:
            hit = np.tril(hit, -1)
        parent = list(range(len(table)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(hit))):
            u, v = root(int(left[i])), root(int(right[j]))
            if u != v and (rep[left[i]] == rep[right[j]] or _confirmed(texts[left[i]], texts[right[j]], percent, width)):
                parent[u] = v
        least: dict[int, tuple] = {}  # of each root, the least id on the left, or at all
        for i in range(len(table)):
            r = root(i)
            least[r] = min(least.get(r, (2, 0)), (int(side[i]), int(rep[i])))
        out = [(int(rep[i]), least[root(i)][1]) for i in range(len(table)) if rep[i] != least[root(i)][1]]
        pairs = np.array(out, dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return compared


def _units(large: DataFrame) -> DataFrame:
    """(unit, key, n, whole): sets to be compared with each other, of large groups (name, key, n, size).

    One group of near copies makes many large groups, a segment each, of nearly the same sets. Groups that hang together become one unit, a whole one,
    if that costs less than each of them alone, going by squares of sizes; otherwise each is a unit. A group hangs on the largest that any of its sets
    is in; that this may not join all that overlap costs only time.
    """
    top = F.max(F.struct("size", "name")).over(Window.partitionBy("key"))  # a set is in no more groups than it has entries
    large = large.withColumn("top", top)
    label = large.groupBy("name").agg(F.max("top").alias("top")).select("name", F.col("top.name").alias("unit"))
    large = cut(large.select("name", "key", "n", "size").join(label, "name"))
    members = large.groupBy("unit", "key").agg(F.max("n").alias("n"), F.sum("size").alias("alone"))
    whole = members.groupBy("unit").agg((F.count("*") * F.count("*") <= F.sum("alone")).alias("whole"))
    joined = members.join(whole.where("whole"), "unit").select("unit", "key", "n", "whole")
    apart = large.join(whole.where("NOT whole"), "unit").select(F.col("name").alias("unit"), "key", "n", "whole")
    return cut(joined.unionByName(apart))


def _parts(count, n):
    """How many tiles' sides so many sets with so many shingles fill."""
    return F.ceil(F.greatest(count / TILE_SETS, n / TILE_SHINGLES)).cast("long")


def _numbers(upto):
    return F.sequence(F.lit(0).cast("long"), upto - 1)


def _with_pivots(units: DataFrame) -> DataFrame:
    """(tile, side, key): every part of a unit, on side 1, and its pivots, on both, of (unit, key, n)."""
    least = [F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), "key")).getField("key") for k in range(PIVOTS)]
    facts = units.groupBy("unit").agg(_parts(F.count("*"), F.sum("n")).alias("parts"), F.array_distinct(F.array(*least)).alias("pivots")).where(F.size("pivots") > 1)
    members = units.join(facts.select("unit", "parts"), "unit").select(F.xxhash64("unit", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("tile"), F.lit(1).alias("side"), "key")
    pivots = facts.select("unit", "pivots", F.explode(_numbers(F.col("parts"))).alias("part")).select(F.xxhash64("unit", "part").alias("tile"), F.lit(0).alias("side"), F.explode("pivots").alias("key"))
    return members.unionByName(pivots).unionByName(pivots.withColumn("side", F.lit(1)))


def _left_over(settled: DataFrame) -> DataFrame:
    """(tile, side, key): sets outside their unit's largest component, with each other and with those inside, of (unit, key, n, component)."""
    by = settled.groupBy("unit", "component").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    facts = by.groupBy("unit").agg(F.max(F.struct("count", "component", "n")).alias("bulk"), F.sum("count").alias("count"), F.sum("n").alias("n")).where("count > bulk.count")
    facts = facts.select("unit", F.col("bulk.component").alias("bulk"), _parts(F.col("bulk.count"), F.col("bulk.n")).alias("bulk_parts"), _parts(F.col("count") - F.col("bulk.count"), F.col("n") - F.col("bulk.n")).alias("parts"))
    sets = settled.join(facts, "unit").withColumn("inside", F.col("component") == F.col("bulk"))
    sets = sets.withColumn("part", F.pmod(F.xxhash64("key"), F.when(F.col("inside"), F.col("bulk_parts")).otherwise(F.col("parts"))))
    loose = sets.where("NOT inside")
    among = loose.withColumn("meets", F.explode(_numbers(F.col("parts"))))
    among = among.select(F.xxhash64("unit", F.least("part", "meets"), F.greatest("part", "meets"), F.lit("among")).alias("tile"), (F.col("part") > F.col("meets")).cast("int").alias("side"), "key")
    out = loose.withColumn("meets", F.explode(_numbers(F.col("bulk_parts")))).select(F.xxhash64("unit", "part", "meets", F.lit("out")).alias("tile"), F.lit(0).alias("side"), "key")
    bulk = sets.where("inside").withColumn("meets", F.explode(_numbers(F.col("parts")))).select(F.xxhash64("unit", "meets", "part", F.lit("out")).alias("tile"), F.lit(1).alias("side"), "key")
    return among.unionByName(out).unionByName(bulk)


def jaccard_components(docs: DataFrame, percent: int = 85, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per input row.

    A text's set holds its distinct runs of `width` words `[^\\x20\\x09-\\x0D]+` after A-Z are lower-cased; with fewer words, all of
    them as one. Two rows link when 100 * shared >= percent * joint; component_id is the smallest doc_id reachable by links,
    the row's own included.

    Null text, empty text and text without words: an empty set, linked with nothing. Null doc_id: n_shingles is counted,
    component_id is null, and the row links with nothing. Rows that share a doc_id are one document, linked by the set of
    each. Only the two named columns are read, so others may have
    any names. An empty table gives no rows.
    """
    docs = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    rows = cut(docs.mapInArrow(_describe(width), "doc_id long, n long, key binary, outline binary"))
    sets = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.struct("n", "outline")).alias("of"))
    reps = sets.select("key", "rep")
    size = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    entries = known.mapInArrow(_index(width, Bands(percent), buckets), "bucket long, entries binary, counts binary, sets binary")
    schema = "key binary, other binary, n long, name long, size long"
    groups = cut(entries.groupBy("bucket").applyInArrow(_groups(percent), schema).distinct())
    units = _units(groups.where("name IS NOT NULL").select("name", "key", "n", "size"))
    both = groups.where("name IS NULL").select("key", "other")
    both = both.join(sets.select("key", "of.n", "of.outline"), "key").join(sets.select(F.col("key").alias("other"), F.col("of.n").alias("other_n"), F.col("of.outline").alias("other_outline")), "other")
    pairs = cut(both.select("key", "other", "n", "other_n", "outline", "other_outline").mapInArrow(_possible(percent), "key binary, other binary"))
    wanted = units.select("key").unionByName(pairs.select("key")).unionByName(pairs.select(F.col("other").alias("key"))).distinct().join(reps, "key")
    texts = cut(known.mapInArrow(_squeezed, "doc_id long, squeezed binary").join(wanted.select(F.col("rep").alias("doc_id"), "rep", "key"), "doc_id").select("key", "rep", "squeezed"))
    links_of = lambda tiles: tiles.join(texts, "key").select("tile", "side", "rep", "squeezed").groupBy("tile").applyInArrow(_compare(percent, width), "a long, b long")

    # each unit with its pivots; then what these don't tie to the unit's largest component meets all of the unit
    tied = cut(links_of(_with_pivots(units)))
    homes = units.groupBy("key").agg(F.min(F.when(F.col("whole"), F.col("unit"))).alias("home"))
    labels = cut(homes.join(reps, "key").join(tied.groupBy("a").agg(F.min("b").alias("b")), F.col("rep") == F.col("a"), "left").select("key", "home", F.coalesce("b", "rep").alias("component")))
    tiles = _left_over(cut(units.join(labels.select("key", "component"), "key")))

    # a pair goes to its first set's tile; sets with many pairs have several tiles
    mine, theirs = (labels.select(F.col("key").alias(k), F.struct("home", "component").alias(v)) for k, v in (("key", "mine"), ("other", "theirs")))
    pairs = pairs.join(mine, "key", "left").join(theirs, "other", "left")
    pairs = cut(pairs.where("NOT coalesce(mine.component = theirs.component, false) AND NOT coalesce(mine.home = theirs.home, false)").select("key", "other"))
    fans = pairs.groupBy("key").agg(F.ceil(F.count("*") / TILE_SETS).alias("fan"))
    pairs = pairs.join(fans, "key").withColumn("tile", F.xxhash64("key", F.pmod(F.xxhash64("other"), F.col("fan"))))
    tiles = tiles.unionByName(pairs.select("tile", F.lit(0).alias("side"), "key").distinct()).unionByName(pairs.select("tile", F.lit(1).alias("side"), F.col("other").alias("key")))
    links = links_of(tiles).unionByName(tied)
    # rows that share a doc_id and not the set tie what the sets are known by
    several = rows.where("n > 0").groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("doc_id")
    links = links.unionByName(rows.where("n > 0").join(several, "doc_id").join(reps, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    found = connected_components(links)

    labels = reps.join(found, reps["rep"] == found["id"], "left").select("key", F.coalesce("component_id", "rep").alias("label"))
    out = rows.join(labels, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("label")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each_group(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, all columns unchanged, of each component only the smallest id's; rows with null ids stay, and rows that share an id stay or go together."""
    found = jaccard_components(docs, percent, width, id_col, text_col)
    gone = found.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__gone")).agg(F.min(F.col("component_id") != F.col("doc_id")).alias("__all")).where("__all").select("__gone")
    return docs.join(gone, column(id_col).cast("long") == F.col("__gone"), "left_anti")
