"""Removal of long byte strings that occur more than once, by a distributed, common-prefix-aware merge sort of suffixes.

Only suffixes at synchronising positions are sorted: the least hashed gram of each string of `length` bytes, at its leftmost
place. Equal strings have the same one at the same offset, and about 2 / length of all positions are such. A suffix
travels with what lies before it of the strings it stands for, so each string of `length` bytes is whole in one record.

Each piece of a task's rows sorts its suffixes and cuts the run at splitters; the parts are exchanged front-coded (what
a suffix shares with the one before is a number). A partition merges its runs with a loser tree that carries common prefix
lengths, and never compares known prefixes again; a run's next suffix is decoded as the tree asks for it.

The common prefixes decide. Two records match if what they share to the right of their positions, known from the merge, and what
they share to the left make up `length` bytes; the bytes shared are those to be removed. Neighbours in the order of suffixes are joined to
clusters at their common prefix, longest first; within a cluster records are in order of their left sides read backwards, so that a
record's best partner to the left is a neighbour too.

Records that a piece holds more than once leave it once, so a passage in a third of all documents is a record a piece.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import byte_texts, mix, pieces, runs, sliding_min
from spanlake.llm.frames import column

PIECE_BYTES = 1 << 20
BUCKET_BYTES = 6 << 20
GRAM = 16
#: Sampled places a range of suffixes, and ranges at most; more buckets than that split ranges by the hash of a suffix's gram.
SAMPLES, RANGES = 32, 2048
#: Windows whose synchronising positions are found at once, and low bits of hashes that give way to places.
BLOCK, PLACE_BITS = 1 << 18, np.uint64(21)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each run of GRAM bytes."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8).copy().view(np.uint64).ravel()
    out = mix(eight[8:] ^ np.uint64(0xA0761D6478BD642F))
    out += eight[:-8]
    return mix(out)


def _windows(data: np.ndarray, limits: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows of one text that have one synchronising position, block by block: first window, how many, that position, and the text's number.

    limits are the places where texts end.
    """
    reach = length - GRAM + 1
    low = (np.uint64(1) << PLACE_BITS) - np.uint64(1)
    for at in range(0, max(0, len(data) - length + 1), BLOCK):
        upto = min(at + BLOCK, len(data) - length + 1)
        hashes = _gram_hashes(data[at : upto + length - 1])
        ranked = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # of equal ones the leftmost
        anchor = (sliding_min(ranked, reach) & low).astype(np.int64) + at
        window = np.arange(at, upto)
        owner = np.searchsorted(limits, window, "right")
        whole = window + length <= limits[owner]
        breaks = np.append(True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))
        first, count = runs(whole, breaks)
        yield first + at, count, anchor[first], owner[first]


def _shared(a: bytes, b: bytes, since: int = 0) -> int:
    """Length of the common prefix of two strings that share `since` bytes."""
    n = min(len(a), len(b))
    if a[since:n] == b[since:n]:
        return n
    differ = int.from_bytes(a[since:n]) ^ int.from_bytes(b[since:n])
    return n - (differ.bit_length() + 7) // 8


class Run:
    """A sorted run of records, front-coded; holds one record at a time.

    A record is a suffix, what it shares with the one before, its left side read backwards, and its document and place.
    """

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:8], "little")
        self._share, self._tail, self._left = (x.tolist() for x in np.frombuffer(blob, dtype=np.int32, count=3 * n, offset=8).reshape(3, n))
        self._doc, self._place = (x.tolist() for x in np.frombuffer(blob, dtype=np.int64, count=2 * n, offset=8 + 12 * n).reshape(2, n))
        self._blob, self._at, self._next = blob, 8 + 28 * n, 0
        self.shared, self.text = 0, b""
        self.advance()

    @staticmethod
    def packed(records: list[tuple[bytes, bytes, int, int]]) -> bytes:
        """Sorted records as a run's bytes."""
        share = [0, *(_shared(a[0], b[0]) for a, b in zip(records, records[1:]))][: len(records)]
        tails = [r[0][h:] for r, h in zip(records, share)]
        numbers = np.array([share, [len(t) for t in tails], [len(r[1]) for r in records]], dtype=np.int32)
        places = np.array([[r[2] for r in records], [r[3] for r in records]], dtype=np.int64)
        return b"".join([len(records).to_bytes(8, "little"), numbers.tobytes(), places.tobytes(), *(x for t, r in zip(tails, records) for x in (t, r[1]))])

    def advance(self) -> None:
        """On to the next record; text is None behind the last."""
        k = self._next
        if k == len(self._share):
            self.text = None
            return
        at, tail, left = self._at, self._tail[k], self._left[k]
        self.shared = self._share[k]
        self.text = self.text[: self.shared] + self._blob[at : at + tail]
        self.left = self._blob[at + tail : at + tail + left]
        self.doc, self.place = self._doc[k], self._place[k]
        self._at, self._next = at + tail + left, k + 1


def merged(parts: list[Run]) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """Merges sorted runs with a loser tree: yields (prefix shared with the suffix before, suffix, left side, document, place).

    Each waiting suffix knows what it shares with the last winner: of two, the one that shares more is less; only if they share the same are bytes
    compared, and those from there on.
    """
    size = 1
    while size < len(parts):
        size *= 2
    parts = parts + [None] * (size - len(parts))
    known = [0] * size
    loser = [0] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes that with the winner."""
        if parts[b] is None or parts[b].text is None:
            return a, b
        if parts[a] is None or parts[a].text is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y, since = parts[a].text, parts[b].text, known[a]
        if x[since:] <= y[since:]:
            known[b] = _shared(x, y, since)
            return a, b
        known[a] = _shared(x, y, since)
        return b, a

    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    winner = winners[1]
    while parts and parts[winner] is not None and parts[winner].text is not None:
        run = parts[winner]
        yield known[winner], run.text, run.left, run.doc, run.place
        run.advance()
        known[winner] = run.shared
        node = (winner + size) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def matches(records: Iterable[tuple[int, bytes, bytes, int, int]], length: int) -> Iterator[tuple[int, int, int]]:
    """(document, first byte, number of bytes) of what records share with others, `length` bytes or more.

    records come in order of their suffixes: (prefix shared with the one before, suffix, left side backwards, document, place).
    """
    spans, where, best = [], [], []
    stack: list[tuple[int, list]] = []  # (prefix shared with the cluster below, its records by left side)

    def join(above: list, below: list, prefix: int) -> list:
        """Both clusters, all of whose records share the prefix; of the fewer each meets its neighbours among the others."""
        few, many = sorted((above, below), key=len)
        for one in few:
            if len(one[0]) + prefix < length:
                continue  # it shares too little with anything from here on
            at = bisect_left(many, one)
            for other in many[max(0, at - 1) : at + 1]:
                left = _shared(one[0], other[0])
                if prefix + left >= length:
                    for i in (one[1], other[1]):
                        if left > best[i]:  # else a longer prefix with as long a left side was found before
                            best[i] = left
                            spans.append((where[i][0], where[i][1] - left, prefix + left))
            insort(many, one)
        return many

    for shared, _, left, doc, place in records:
        while len(stack) > 1 and stack[-1][0] > shared:
            prefix, above = stack.pop()
            stack[-1] = (stack[-1][0], join(above, stack[-1][1], prefix))
        if shared < GRAM:  # one cluster is left, that shares too little with what follows
            yield from spans
            for x in (spans, where, best, stack):
                x.clear()
        stack.append((shared, [(left, len(where))]))
        where.append((doc, place))
        best.append(-1)
    while len(stack) > 1:
        prefix, above = stack.pop()
        stack[-1] = (stack[-1][0], join(above, stack[-1][1], prefix))
    yield from spans


def _packed_spans(spans) -> pa.RecordBatch:
    numbers = np.array(spans, dtype=np.int64).reshape(-1, 3)
    return pa.RecordBatch.from_arrays([pa.array(numbers[:, k]) for k in range(3)], names=["doc_id", "first", "n"])


def _sorted_records(part: pa.RecordBatch, length: int) -> tuple[list, list]:
    """A piece's distinct records in order, and the spans that it repeats itself."""
    texts = byte_texts(part.column(1))
    doc = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    data = b"".join(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    limits = np.cumsum(sizes)
    seen: dict[tuple[bytes, bytes], tuple[int, int]] = {}
    twice: set[tuple[bytes, bytes]] = set()
    spans: list[list[int]] = []

    def add(d: int, first: int, n: int) -> None:
        if spans and spans[-1][0] == d and spans[-1][1] <= first <= spans[-1][1] + spans[-1][2]:  # a text of one letter has a record a byte
            spans[-1][2] = max(spans[-1][2], first + n - spans[-1][1])
        else:
            spans.append([d, first, n])

    for at, count, anchor, owner in _windows(np.frombuffer(data, dtype=np.uint8), limits, length):
        places = anchor - (limits - sizes)[owner]
        for a, x, e, d, p in zip(at.tolist(), anchor.tolist(), (at + count + length - 1).tolist(), doc[owner].tolist(), places.tolist()):
            one = data[x:e], data[a:x][::-1]
            if one not in seen:
                seen[one] = d, p
                continue
            if one not in twice:
                twice.add(one)
                add(seen[one][0], seen[one][1] - (x - a), e - a)
            add(d, p - (x - a), e - a)
    distinct = sorted((*one, *where) for one, where in seen.items())
    shares = [0, *(_shared(a[0], b[0]) for a, b in zip(distinct, distinct[1:]))][: len(distinct)]
    spans += matches(((h, *r) for h, r in zip(shares, distinct)), length)
    return distinct, spans


def _runs(length: int, splitters: list[bytes], fan: int):
    def made(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in pieces(batches, "text", PIECE_BYTES):
            part = part.filter(pa.compute.and_(part.column(0).is_valid(), part.column(1).is_valid()))
            records, spans = _sorted_records(part, length)
            parts: dict[int, list] = {}
            for one in records:
                bucket = bisect_right(splitters, one[0]) * fan + (zlib.crc32(one[0][:GRAM]) % fan if fan > 1 else 0)
                parts.setdefault(bucket, []).append(one)
            if not parts:
                continue
            done = [None] * len(parts)
            done[0] = squeeze.compress(np.array(spans, dtype=np.int64).tobytes()) if spans else None
            blobs = [squeeze.compress(Run.packed(p)) for p in parts.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(blobs, pa.binary()), pa.array(done, pa.binary())], names=["bucket", "run", "done"])

    return made


def _merge(length: int):
    def merge(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        out = [_packed_spans(np.frombuffer(expand.decompress(b.as_py()), dtype=np.int64)) for b in table.column("done") if b.is_valid]
        parts = [Run(expand.decompress(b.as_py())) for b in table.column("run")]
        out.append(_packed_spans(list(matches(merged(parts), length))))
        return pa.Table.from_batches(out)

    return merge


def _remove(batches):
    for part in pieces(batches, "text", PIECE_BYTES):
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, spans in zip(byte_texts(part.column(1)), part.column(2).to_pylist()):
            text = text or b""
            keep, at, count = [], 0, 0
            for first, n in sorted((s["first"], s["n"]) for s in spans or ()):
                first, end = min(first, len(text)), min(first + n, len(text))  # rows that share an id can differ in length
                if end <= first:
                    continue
                if first > at or not count:
                    keep.append(text[at:first])
                    count += 1
                at = max(at, end)
            keep.append(text[at:])
            kept.append(b"".join(keep))
            n_bytes.append(len(text))
            n_removed.append(len(text) - len(kept[-1]))
            n_spans.append(count)
        yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _splitters(docs: DataFrame, size: int, ranges: int) -> list[bytes]:
    """Grams that cut the suffixes into about `ranges` parts of like size: quantiles of those at SAMPLES places a range, spread evenly over all bytes."""
    stride = max(GRAM, size // (ranges * SAMPLES))
    last = F.length("text") - GRAM
    offset = F.pmod(F.xxhash64("doc_id"), F.lit(stride)).cast("int")
    places = docs.where(last >= offset).select("text", F.explode(F.sequence(offset, last, F.lit(stride))).alias("place"))
    grams = places.select(F.substring(F.col("text").substr(F.col("place") + 1, F.lit(GRAM)).cast("binary"), 1, GRAM).alias("gram"))
    found = sorted(bytes(r[0]) for r in grams.orderBy(F.xxhash64("gram")).limit(2 * ranges * SAMPLES).collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def repeated_byte_spans(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first, n): bytes covered by strings of `length` bytes that also start elsewhere; spans of a document can overlap."""
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} at least")
    docs = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET_BYTES))
    ranges = min(buckets, RANGES)
    made = docs.mapInArrow(_runs(length, _splitters(docs, size, ranges), math.ceil(buckets / ranges)), "bucket long, run binary, done binary")
    return made.groupBy("bucket").applyInArrow(_merge(length), "doc_id long, first long, n long")


def suffix_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept), a row per input row; kept is the remaining bytes of the text in UTF-8.

    A byte goes if a string of `length` bytes covers it that also starts at another place, of the same text included. Matches
    never cross texts; strings are judged on the input. n_spans counts the maximal removed runs.

    Null text is empty. Null or shorter texts lose nothing. Null doc_id: the row loses nothing and is compared with nothing.
    Repeated rows are copies of each other; rows that share a doc_id each lose what is found in one of them, by place. Only the two
    named columns are read, so others may have any names. An empty table gives no rows.
    """
    spans = repeated_byte_spans(docs, length, id_col, text_col).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    rows = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return rows.join(spans, "doc_id", "left").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
