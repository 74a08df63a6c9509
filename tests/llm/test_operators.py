"""The ten operators against brute force, on small tables with the odd rows that real ones hold."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.llm import quality as ql
from spanlake.llm.arrays import equal_groups, sliding_min, words_of
from spanlake.llm.components import connected_components
from spanlake.llm.decontamination import contaminated, decontaminate
from spanlake.llm.embeddings import embedding_components
from spanlake.llm.jaccard_join import Bands, _confirmed, jaccard_components, one_of_each_group
from spanlake.llm.line_dedup import line_dedup
from spanlake.llm.mixing import Mixture
from spanlake.llm.secrets import Novelty, secret_spans
from spanlake.llm.substring_dedup import substring_dedup
from spanlake.llm import suffix_dedup as sx
from spanlake.llm.suffix_dedup import Run, _shared, matches, merged, suffix_dedup
from spanlake.llm.url_filter import judge_urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed=1, n=60):
    """Random texts with passages in common, copies, near copies, and odd ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 7)))
    passage = [word() for _ in range(120)]
    out = []
    for i in range(n):
        words = [word() for _ in range(rng.randint(1, 150))]
        if i % 4 == 0:
            words[rng.randrange(len(words)) :] = passage[: rng.randint(10, 120)]
        if i % 5 == 4:
            words = out[rng.randrange(len(out))].split()
            if i % 2 and len(words) > 30:
                words[rng.randrange(len(words))] = "edited"
        out.append(" ".join(w + rng.choice(["", "", "\n", " \t"]) for w in words))
    return out + [None, "", " \n\t", "one", "x " * 600, "x" * 900, ("long " + " ".join(passage) + "\n") * 30, "A b 　 c"]


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], schema)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, list(enumerate(texts())))


def odd(spark):
    """Null ids, repeated rows, and extra columns under the operators' own names."""
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(None, base), (1, base), (1, base), (2, base), (3, None), (3, "other " * 30)]
    df = table(spark, rows)
    for name in ("words", "row", "id", "text_", "key", "spans", "n", "tokens", "starts", "lines", "m", "score", "n_lines", "size", "hash"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


# helpers


def test_words_and_groups():
    w = words_of([b"a  bb\n", None, b"", b" c"])
    assert (w.raw, w.first.tolist(), w.text_of().tolist()) == (b"a bb c ", [0, 2, 2, 2, 3], [0, 0, 3])
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 500).astype(np.uint64) << np.uint64(58 - 6)
    index, begins = equal_groups(h)
    count = Counter(h.tolist())
    assert sorted(index.tolist()) == [i for i in range(500) if count[int(h[i])] > 1]
    assert begins.sum() == sum(c > 1 for c in count.values())
    for width in (1, 2, 3, 7, 16, 17):
        assert sliding_min(h, width).tolist() == [min(h[i : i + width].tolist()) for i in range(500 - width + 1)]
    assert len(equal_groups(h[:0])[0]) == len(equal_groups(h[:1])[0]) == 0


def test_loser_tree():
    rng = random.Random(3)
    for n in (1, 2, 3, 7):
        parts = [sorted({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 40))}) for _ in range(n)]
        runs = [Run(Run.packed([(x, x[::-1], r, k) for k, x in enumerate(p)])) for r, p in enumerate(parts)]
        out = list(merged(runs))
        got = [x for _, x, *_ in out]
        assert got == sorted(x for p in parts for x in p)
        assert all(parts[r][k] == x and left == x[::-1] for _, x, left, r, k in out)
        assert [h for h, *_ in out[1:]] == [_shared(a, b) for a, b in zip(got, got[1:])]
    assert list(merged([])) == list(merged([Run(Run.packed([]))] * 3)) == []


def test_matches_by_prefixes_on_both_sides(monkeypatch):
    """What each record shares with any other one, found from neighbours alone, against all pairs."""
    monkeypatch.setattr(sx, "GRAM", 1)
    rng = random.Random(4)
    for length in (5, 9):
        for _ in range(60):
            side = lambda most: bytes(rng.choice(b"aab") for _ in range(rng.randint(1, most)))
            records = sorted((side(length), side(length - 1), d, 100) for d in range(rng.randint(0, 25)))
            shares = [0] + [_shared(a[0], b[0]) for a, b in zip(records, records[1:])]
            got = {d: set() for _, _, d, _ in records}
            for d, first, n in matches(((h, *r) for h, r in zip(shares, records)), length):
                got[d] |= set(range(first, first + n - length + 1))
            for x, left, d, place in records:
                want = set()
                for y, other, e, _ in records:
                    p, q = _shared(x, y), _shared(left, other)
                    if d != e and p + q >= length:
                        want |= set(range(place - q, place + p - length + 1))
                assert got[d] == want


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(200)] + [(7, 7), (None, 1), (1, None)]
    parent = {x: x for a, b in links if a is not None and b is not None for x in (a, b)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and root(a) != root(b):
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r["id"]: r["component_id"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(root(x) == root(y) and x != y for y in parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


def removed_words(rows, width=20):
    split = [(i, (t or "").encode().split()) for i, t in sorted(rows, key=lambda r: r[0])]
    seen, out = set(), {}
    for i, w in split:
        gone = set()
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            if key in seen:
                gone.update(range(k, k + width))
            seen.add(key)
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


@pytest.mark.parametrize("width", [20, 5])
def test_substring_dedup(spark, docs, width):
    got = {r[0]: tuple(r)[1:] for r in substring_dedup(docs, width).collect()}
    assert got == removed_words(list(enumerate(texts())), width)


def test_substring_dedup_odd_rows(spark):
    got = sorted((str(r[0]), r[1], r[2]) for r in substring_dedup(odd(spark)).collect())
    # `other` thirty times: all but the first word lies in a window that repeats the first one
    assert got == [("1", 100, 0), ("1", 100, 0), ("2", 100, 100), ("3", 0, 0), ("3", 30, 29), ("None", 100, 0)]
    assert substring_dedup(empty(spark)).count() == 0


def test_hash_collisions_are_settled_by_words(monkeypatch):
    from spanlake.llm import substring_dedup as module

    monkeypatch.setattr(module, "window_hashes", lambda h, k: np.zeros(max(0, len(h) - k + 1), dtype=np.uint64))
    w = words_of([b"a b c d", b"b c d e"])
    _, later = module.earlier_repeats(w, 2, np.array([1, 2]), np.array([0, 0]))
    assert np.flatnonzero(later).tolist() == [4, 5]


# 2


def test_quality(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() + ("###" if i % 3 == 0 else "") for _ in range(rng.randint(5, 60)))) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(600)] + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    df = table(spark, rows + [(None, None), (1000, ""), (1001, None)])
    machine = ql.train(df, labels)
    got = ql.score(df, machine).collect()
    held = [r for r in got if r["doc_id"] is not None and r["held_out"] and r["doc_id"] < 600]
    assert len(held) > 100 and sum(r["predicted"] == (r["doc_id"] % 3 != 0) for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got) and len(got) == 603
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    again = ql.train(df, labels)
    assert np.array_equal(machine.w, again.w) and np.array_equal(machine.v, again.v)
    none = ql.train(df, labels.limit(0))
    assert {r["score"] for r in ql.score(df, none).collect()} == {0.5}
    assert ql.score(odd(spark), machine).columns[-3:] == ["held_out", "score", "predicted"] and ql.score(odd(spark), machine).count() == 6
    assert ql.score(empty(spark), machine).count() == 0


def plain_features(text, n_chars):
    """The hashed words and statistics of a text, one after the other, by definition."""
    raw = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in raw).split()
    slots = Counter(int(words_of([w]).hashes()[0] >> np.uint64(64 - ql.BITS)) for w in words)
    values = {k: 1 + math.log(n) for k, n in slots.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    kind = lambda c: 0 if c in b" \t\n\x0b\f\r" else 1 if 97 <= c <= 122 else 2 if 65 <= c <= 90 else 3 if 48 <= c <= 57 else 4 if c in b".,;:!?'\"-()" else 7 if c < 32 else 6 if c >= 128 else 5
    kinds = Counter(map(kind, raw))
    lines, n = raw.split(b"\n"), len(words)
    sizes = [len(w) for w in words]
    mean = sum(sizes) / max(1, n)
    stats = [kinds[k] / max(1, len(raw)) for k in range(8)]
    stats += [math.log1p(len(lines)), len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines)), raw.count(b" | ") / max(1, n), kinds[2] / max(1, kinds[1] + kinds[2]), math.log1p(n), len(slots) / max(1, n), mean]
    stats += [math.sqrt(max(0, sum(x * x for x in sizes) / max(1, n) - mean * mean)), math.log1p(max(0, n_chars or 0))]
    return {k: v / norm for k, v in values.items()}, stats


def test_scores_from_plain_features(spark):
    """Each score from features worked out by hand and the sum over all pairs; the label, language, source and id change nothing."""
    rng = np.random.default_rng(8)
    size = (1 << ql.BITS) + ql.N_STATS
    machine = ql.Machine(0.2, rng.normal(0, 0.3, size).astype(np.float32), rng.normal(0, 0.1, (size, ql.FACTORS)).astype(np.float32), rng.normal(size=ql.N_STATS), rng.uniform(0.5, 2, ql.N_STATS))
    rows = list(enumerate([*texts()[:12], None, "", "A b a | B\nA b a | B\n\x01é", "x" * 3000]))
    df = table(spark, rows)
    got = {r["doc_id"]: r["score"] for r in ql.score(df, machine).collect()}
    for i, text in rows:
        words, stats = plain_features(text, len(text or ""))
        x = {**words, **{(1 << ql.BITS) + k: np.clip((v - machine.centre[k]) / machine.scale[k], -3, 3) * 0.3 for k, v in enumerate(stats)}}
        keys = list(x)
        w, v, values = machine.w[keys].astype(float), machine.v[keys].astype(float), np.array([x[k] for k in keys])
        gram = (v @ v.T) * np.outer(values, values)
        margin = machine.bias + w @ values + (gram.sum() - np.trace(gram)) / 2
        assert math.isclose(got[i], 1 / (1 + math.exp(-margin)), abs_tol=1e-4)
    other = df.withColumns({"doc_id": F.col("doc_id") + 100_000, "lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    assert {r["doc_id"] - 100_000: r["score"] for r in ql.score(other, machine).collect()} == got


def test_pairs_in_linear_time():
    rng = np.random.default_rng(0)
    m = ql.Machine(0.3, rng.normal(size=20).astype(np.float32), rng.normal(size=(20, 8)).astype(np.float32), np.zeros(1), np.ones(1))
    index, value, first = np.array([1, 5, 9, 2, 3]), np.array([1, 0.5, 2, 1, 1], dtype=np.float32), np.array([0, 3, 5])
    want = []
    for a, b in ((0, 3), (3, 5)):
        s = m.bias + sum(m.w[index[i]] * value[i] for i in range(a, b))
        want.append(s + sum(m.v[index[i]] @ m.v[index[j]] * value[i] * value[j] for i in range(a, b) for j in range(i + 1, b)))
    assert np.allclose(m.parts(index, value, first)[0], want, rtol=1e-4)


# 3


def targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.remove(s)
    return out


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 300), rng.choice(["a", "b", "b", "b", "c", None, "é", "Z"])) for i in range(400)] + [(900, "w " * 9, "tiny"), (901, None, "nothing"), (None, "w " * 50, "a"), (5, "w", "a"), (5, "w", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixture = Mixture(df, block=16)
    got = mixture.taken().collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    assert len(got) == len(rows) and sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    assert all(r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9) for r in got)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(40, 0.02 * want[s]) for s in sizes)
    assert taken["tiny"] == 27
    again = Mixture(df.repartition(7), block=16).taken()
    assert sorted(map(str, again.collect())) == sorted(map(str, got))
    blocks = mixture.blocks(df)
    assert blocks.agg(F.sum("n_words")).first()[0] == sum(taken.values())
    assert blocks.where("size(split(text, ' ')) <> n_words").count() == 0
    per_block = blocks.groupBy("shard", "slot").agg(F.sum("n_words").alias("n"))
    assert per_block.agg(F.max("n")).first()[0] == 16
    assert Mixture(spark.createDataFrame([], "doc_id long, text string, source string")).taken().count() == 0


def test_mixing_takes_what_the_slots_name(spark):
    """taken, counted slot by slot from where each row lies in its source; and the shards' counts, against a uniform draw."""
    rng = random.Random(14)
    rows = [(i, "w " * rng.randint(0, 90), rng.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("rank", "size", "hash", "index", "begin", "slot", "group", "id", "length", "digest"):
        df = df.withColumn(name, F.lit("clash"))
    mixture = Mixture(df, block=8, shard_slots=200)
    slots = mixture.slots.collect()
    uses = Counter((r["rank"], r["index"]) for r in slots)
    want = {}
    for r in mixture.documents.collect():
        inside = range(r["begin"], r["begin"] + r["size"])
        want[r["doc_id"]] = sum(uses[r["rank"], w // 8] for w in inside)
    assert {r["doc_id"]: r["taken"] for r in mixture.taken().collect()} == want and sum(want.values()) > 0
    assert mixture.blocks(df).agg(F.sum("n_words")).first()[0] == sum(want.values())
    counts = Counter((r["rank"], r["shard"]) for r in slots)
    assert counts == {(r["rank"], r["shard"]): r["n"] for r in mixture.counts.collect()}
    shards = max(k for _, k in counts) + 1
    assert shards > 8
    for rank in {k for k, _ in counts}:
        every = [counts[rank, k] for k in range(shards)]
        mean = sum(every) / shards
        chi = sum((n - mean) ** 2 / mean for n in every)  # of shards - 1 degrees of freedom
        assert 0.2 * shards < chi < 3 * shards


def test_mixing_gives_each_row_its_own_text(spark):
    """Null and repeated ids of one size, at other places and in another order too."""
    rows = [(i, " ".join(f"{name}{k}" for k in range(20)), "a") for i, name in ((None, "p"), (None, "q"), (None, "r"), (7, "s"), (7, "t"), (-(1 << 63), "u"), (None, "p"))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = ["shard", "slot", "begin", "text"]
    parts = Mixture(df, block=8).blocks(df).select("doc_id", "n_words", *keys).collect()
    words = Counter(w for r in parts for w in r["text"].split())
    assert words == Counter(w for _, t, _ in rows for w in t.split())
    assert all(r["n_words"] == len(r["text"].split()) and (r["doc_id"], r["text"][0]) in {(i, t[0]) for i, t, _ in rows} for r in parts)
    again = df.repartition(5)
    assert sorted(map(str, Mixture(again, block=8).blocks(again).select("doc_id", "n_words", *keys).collect())) == sorted(map(str, parts))


def test_permutation_is_one(spark):
    from spanlake.llm.mixing import _permuted

    for n in (1, 2, 5, 64, 1000):
        got = [r[0] for r in spark.range(n).select(F.expr(_permuted("id", str(n), "3, 1"))).collect()]
        assert sorted(got) == list(range(n))


# 4


def test_secrets(spark):
    key = "q7Z/x9Kp2LmW4vRt8YbN3cHs6JdF1gQe"
    rows = [
        (1, f'token = "{"0a1b2c3d" * 3}" and PASSWORD: short and é API-KEY x'),
        (2, "AKIA" + "A1" * 8 + " AKIA12 deadbeefdeadbeefff 0123456789abcde"),
        (3, f"bearer {key} then"),
        (4, "bearer configuration_settings_environment and the same configuration_settings_environment"),
        (5, None),
        (6, ""),
        (7, "password=token:secretsecretsecret"),
        (8, "ééé secret_key: 'abcdefabcdef0123'"),
        (9, "passwd='" + "z" * 20_000 + "'"),
        (None, f"x {key} y"),
    ]
    got = {r["doc_id"]: r for r in secret_spans(table(spark, rows)).collect()}
    assert got[1]["base"] == "assign:0:33,hex:9:33" and got[1]["n_assign"] == 1
    assert (got[2]["n_access"], got[2]["n_hex"], got[2]["base"]) == (1, 1, "access:0:20,hex:28:46")
    assert got[3]["spans"] == "novel:7:39" and got[3]["base"] == ""
    assert [got[i]["spans"] for i in (4, 5, 6, None)] == [""] * 4
    assert got[7]["n_assign"] == 0 and got[8]["base"] == "hex:17:33"
    assert got[9]["base"] == "assign:0:20008"
    assert secret_spans(odd(spark)).count() == 6 and secret_spans(empty(spark)).count() == 0


def test_secrets_in_assignments(spark):
    """Values of NAME=value, the sensitive word being in the name."""
    key, other = "q7Z/x9Kp2LmW4vRt8YbN3cHs6JdF1gQe", "Uw5+Xe0Bn7TzGk3PyA9sMhV2rDjC6fLo"
    names = ["AWS_SECRET_ACCESS_KEY", "private_key", "credential", "pwd", "passphrase", "api-key", "SIGNING_SALT", "https://host.example/path?page=2&access_key"]
    rows = list(enumerate(f"{n}={key}" for n in names))
    rows += [(20, f"pwd={key}==\nnext"), (21, f"AWS_ACCESS_KEY_ID={other}\nAWS_SECRET_ACCESS_KEY={key}\n"), (22, f"pwd={key}\n# before:\npwd={key}\n")]
    rows += [(23, f"pwd={key}\n" * 12), (24, f"bearer {key[:12]}={other[:12]}"), (25, f"NAME={key}"), (26, "private_key=configuration_settings_environment"), (27, f"bearer {key}={other[:12]}"), (28, f"/token_a={key}/secret_b={other}")]
    got = {r["doc_id"]: r for r in secret_spans(table(spark, rows)).collect()}
    assert all(r["base"] == "" for r in got.values())
    found = {i: [t[int(s) : int(e)] for s, e in (x.split(":")[1:] for x in got[i]["spans"].split(",") if x)] for i, t in rows}
    assert [found[i] for i in range(len(names))] == [[key]] * len(names)
    assert [found[i] for i in range(20, 24)] == [[key + "=="], [other, key], [key] * 2, [key] * 12]
    assert [found[i] for i in range(24, 29)] == [[f"{key[:12]}={other[:12]}"], [], [], [f"{key}={other[:12]}"], [key, other]]


def test_secrets_base_matches_the_patterns(spark):
    rng = random.Random(9)
    parts = ["token", "Secret", "api_key", "APIKEY", "=", ":", " ", "\t", '"', "'", "abc", "AKIA", "ABCDEFGH", "deadbeef", "0123", "é", ".", "-", "password"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(60))) for i in range(200)]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    for r in secret_spans(table(spark, rows)).collect():
        t = dict(rows)[r["doc_id"]]
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 18]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
        assert r["base"] == ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))


def test_novelty():
    novelty = Novelty(b"configuration settings environment access_token refresh_token")
    random_key, known = "q7Z/x9Kp2LmW4vRt8YbN3cHs6JdF1gQe", "configuration settings environment"
    assert novelty.of("key: ", random_key, "") > 0.7 > 0.3 > novelty.of("key: ", known, "")
    assert novelty.of(random_key + " key: ", random_key, "") < 0.3


# 5


def test_decontamination(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 9, 40])))) for i in range(12)] + [(20, None), (None, "a b c d e f"), (21, "")]
    rows = []
    for i in range(80):
        words = [word() for _ in range(rng.choice([0, 3, 50, 3000]))]
        if i % 2:
            part = (rng.choice(items)[1] or "").split()
            part = part[: max(1, int(len(part) * rng.choice([1, 0.95, 0.7])))]
            at = rng.randint(0, len(words))
            words[at:at] = [p.upper() for p in part]
        rows.append((i, " ".join(words)))
    rows += [(100, None), (None, items[0][1])]
    split = lambda t: (t or "").lower().split()
    sets = lambda t: {tuple(split(t)[k : k + 5]) for k in range(len(split(t)) - 4)}
    want = {(d, i): len(sets(t) & sets(x)) for d, t in rows for i, x in items if d is not None and i is not None and sets(x) and len(sets(t) & sets(x)) >= 0.8 * len(sets(x)) - 1e-9}
    df, bench = table(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_found"] for r in contaminated(df, bench).collect()}
    assert got == want and len(want) > 10
    kept = decontaminate(df, bench).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(i) for i, _ in rows if i is None or i not in {d for d, _ in want})
    assert decontaminate(odd(spark), bench).count() == 6 and contaminated(empty(spark), bench).count() == contaminated(df, bench.limit(0)).count() == 0


# 6


def removed_bytes(rows, length):
    count = Counter(t[k : k + length] for _, t in rows for k in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        gone = [False] * len(t)
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out.append((i, len(t), sum(gone), sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone)), bytes(b for b, g in zip(t, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("length", [400, 60, 16])
def test_suffix_dedup(spark, docs, length, monkeypatch):
    if length == 60:  # more buckets than ranges
        monkeypatch.setattr(sx, "RANGES", 2)
    got = sorted(tuple(r)[:4] + (bytes(r[4]),) for r in suffix_dedup(docs.repartition(3), length).collect())
    assert got == removed_bytes([(i, (t or "").encode()) for i, t in enumerate(texts())], length)


def test_windows_in_blocks(monkeypatch):
    """Synchronising positions do not depend on where blocks begin."""
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (900, 10, 0, 2000, 61)]
    data, limits = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts])

    def anchors():
        found = sx._windows(data, limits, 60)
        return {w: (x, o) for block in found for a, n, x, o in zip(*(v.tolist() for v in block)) for w in range(a, a + n)}

    whole = anchors()
    assert set(whole) == {b - len(t) + k for t, b in zip(texts, limits.tolist()) for k in range(len(t) - 59)}
    monkeypatch.setattr(sx, "BLOCK", 100)
    assert anchors() == whole


def test_suffix_dedup_registered_table(spark):
    """Against all byte strings of 400, on the registered query's whole table."""
    import hashlib

    from spanlake.llm.queries import op6_suffix_dedup
    from tests.conftest import SMALL

    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    seen, twice = set(), set()
    for _, t in rows:
        for k in range(len(t) - 399):
            h = hashlib.blake2b(t[k : k + 400], digest_size=16).digest()
            (twice if h in seen else seen).add(h)
    want = {}
    for i, t in rows:
        gone = np.zeros(len(t) + 1, dtype=np.int64)
        for k in range(len(t) - 399):
            if hashlib.blake2b(t[k : k + 400], digest_size=16).digest() in twice:
                gone[k] += 1
                gone[k + 400] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(t) else 0
        want[i] = (len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~gone])).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op6_suffix_dedup(spark, SMALL).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 0


def test_suffix_dedup_odd_rows(spark):
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in suffix_dedup(odd(spark), 100).collect())
    assert got == [("1", 389, 389, 1), ("1", 389, 389, 1), ("2", 389, 389, 1), ("3", 0, 0, 0), ("3", 180, 180, 1), ("None", 389, 0, 0)]
    assert suffix_dedup(empty(spark)).count() == 0


# 7


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(int(i), (base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.02, 0.08])).tolist()) for i in range(300)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] + [1.0] * 15), (903, [float("inf")] * 16), (904, [None] + [1.0] * 15), (905, []), (906, rows[0][1][:8]), (None, rows[0][1]), (5, rows[5][1]), (907, [x * 1e30 for x in rows[0][1]]), (908, [x * 1e-30 for x in rows[0][1]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("cell", "row", "digest", "codes", "scale", "error", "weight", "part", "home", "own", "n", "a", "b"):
        df = df.withColumn(name, F.lit("clash"))
    one = {}
    for i, v in rows:
        if i is not None:
            one[i] = v
    usable = {i: np.array(v) / np.linalg.norm(np.array(v)) for i, v in one.items() if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: [j for j in usable if i != j and len(usable[j]) == len(usable[i]) and usable[i] @ usable[j] >= 0.95] if i in usable else [] for i in one}
    label = {i: i for i in one}
    changed = True
    while changed:
        changed = False
        for i in one:
            least = min([label[i], *(label[j] for j in links[i])])
            changed |= least != label[i]
            label[i] = least
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(df).collect()}
    assert got.pop(None) == (0, None, False)
    assert got == {i: (len(links[i]), label[i], label[i] == i) for i in one}
    assert embedding_components(df.limit(0)).count() == 0


def linked_vectors(rows, threshold=0.95):
    """(n_links, component, kept) of each id of usable vectors, by all pairs."""
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    link = m @ m.T >= threshold
    np.fill_diagonal(link, False)
    label = {i: i for i in ids}
    while True:
        after = {i: min([label[i], *(label[ids[j]] for j in np.flatnonzero(link[k]))]) for k, i in enumerate(ids)}
        if after == label:
            return {i: (int(link[k].sum()), label[i], label[i] == i) for k, i in enumerate(ids)}
        label = after


@pytest.mark.parametrize("tile", [16, 4096])
def test_embeddings_in_tiles(spark, monkeypatch, tile):
    """Cells and tiles of a few vectors each; copies, groups about the threshold, and vectors of many components."""
    from spanlake.llm import embeddings as module

    monkeypatch.setattr(module, "TILE", tile)
    rng = np.random.default_rng(tile)
    rows = []
    for width in (24,) if tile == 16 else (1500,):
        base = rng.normal(size=(6, width))
        for i in range(160 if tile == 16 else 60):
            near = base[i % 6] + rng.normal(size=width) * rng.choice([0, 0.1, 0.22, 0.23, 0.24])
            rows.append((i, near.tolist()))
    rows += [(1000 + i, rows[3][1]) for i in range(40)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == linked_vectors(rows)


def test_int8_bounds():
    """No product of codes is further from the cosine than its bound."""
    from spanlake.llm import embeddings as module

    rng = np.random.default_rng(3)
    for width in (2, 64, 700):
        unit = module._units(rng.normal(size=(200, width)) * rng.choice([0.01, 1, 30], size=(200, width)))[0]
        q, scale, error = module._quantised(unit)
        near = (q.astype(float) * scale[:, None]) @ (q.astype(float) * scale[:, None]).T
        bound = error[:, None] + (1 + error[:, None]) * error[None, :] + module.ROUNDING
        assert q.dtype == np.int8 and (np.abs(near - unit @ unit.T) <= bound).all() and bound.max() < 0.2


def test_embeddings_registered_table(spark):
    from spanlake.llm.queries import op7_embedding_dedup
    from tests.conftest import LARGER

    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{LARGER}/embeddings.parquet").collect()]
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op7_embedding_dedup(spark, LARGER).collect()} == linked_vectors(rows)


def test_embeddings_of_repeated_ids(spark):
    """Each distinct vector of an id counts, whatever invalid ones it has beside."""
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    nan = [float("nan"), 0.0, 0.0]
    rows = [(1, x), (2, x), (2, y), (2, y), (3, y), (4, z), (4, nan), (5, z), (5, [None, 1.0, 0.0]), (6, nan), (6, None), (7, [1.0, 1.0, 0.0]), (7, [1.0, 1.001, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (1, 1, True), 2: (2, 1, False), 3: (1, 1, False), 4: (1, 4, True), 5: (1, 4, False), 6: (0, 6, True), 7: (0, 7, True)}


# 8


def test_urls(spark):
    urls = ["http://A.Example.COM/en/1?x=/es/", "https://www.example.com/en/2", "http://x.www.example.com/en/", "http://example.com/de/", "http://foo.net/es/a", "http://foo.net/fr", "http://net/fr/q#z", "http://notcom/", "http://x.org", None, "", "no scheme", "http://e.com", "a?u=http://b.com/", "ftp://h.com#/", "http://\ncom/ü"]
    df = spark.createDataFrame(list(enumerate(urls)) * 3 + [(None, "http://x.org/en/5")], "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:5] for r in judge_urls(df).collect()}
    want = {0: ("a.example.com", "/en/1", "example.com/en/", "block"), 1: ("www.example.com", "/en/2", "www.example.com/en/", "allow"), 2: ("x.www.example.com", "/en/", "www.example.com/en/", "allow"), 3: ("example.com", "/de/", "com/", "allow"), 4: ("foo.net", "/es/a", "net/es/", "block"), 6: ("net", "/fr/q", "net/fr/", "block"), 13: ("b.com", "/", "com/", "allow")}
    assert {k: got[k] for k in want} == want
    assert {k: got[k][:3] for k in (5, 7, 8, 9, 10, 11, 12, 14)} == {5: ("foo.net", "/fr", None), 7: ("notcom", "/", None), 8: ("x.org", "", None), 9: ("", "", None), 10: ("", "", None), 11: ("", "", None), 12: ("e.com", "", None), 14: ("h.com", "", None)}
    assert all(v[3] in ("allow", "block") for v in got.values()) and judge_urls(df).count() == len(urls) * 3 + 1
    assert {r["verdict"] for r in judge_urls(df.where("url LIKE '%org%'")).collect()} == {"allow"} and judge_urls(df.limit(0)).count() == 0


URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def url_parts(url):
    """(host, path, tokens), read off the contract and the operator's docstring."""
    rest = (url or "").partition("://")[2]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    query = re.search(r"^[^?#]*\?([^#]*)", rest)
    tokens = {f"host:{x}" for x in host.split(".") if x} | {"path:" + re.sub("[0-9]+", "#", x) for x in path.split("/") if x}
    tokens |= {"key:" + x.partition("=")[0] for x in (query[1] if query else "").split("&") if x}
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://", url or "")
    tokens.add("scheme:" + (scheme[1] if scheme else ""))
    return host, path, tokens | ({"fragment"} if "#" in (url or "") else set())


def judged_urls(urls, support, confidence):
    """(rule, verdict, confidence) of each URL: every combination of tokens is counted."""
    from itertools import combinations

    parts = [url_parts(u) for u in urls]
    fits = [[(len(h + p), -k, v, h + p) for k, (v, h, p) in enumerate(URL_RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)] for host, path, _ in parts]
    known = [max(f)[2:] if f else None for f in fits]
    labelled = [(t, k[0]) for (_, _, t), k in zip(parts, known) if k]
    count, right = Counter(), Counter()
    for tokens, verdict in labelled:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                count[c] += 1
                right[c, verdict] += 1
    need = support * len(labelled)
    rules = [(k / count[c], k / len(labelled), v, set(c)) for (c, v), k in right.items() if k >= need and k / count[c] >= confidence]
    out = []
    for (_, _, tokens), k in zip(parts, known):
        best = max((r[:3] for r in rules if r[3] <= tokens), default=None)
        out.append((k[1], k[0], None) if k else (None, best[2] if best else "allow", best[0] if best else None))
    return out


@pytest.mark.parametrize(("support", "confidence"), [(0.01, 0.8), (0.05, 0.6), (0.2, 0.95)])
def test_mined_url_rules(spark, support, confidence):
    rng = random.Random(7)
    urls = [f"http{rng.choice(['', 's'])}://m{i % 5}.example.{'com' if i % 2 else 'net'}/{rng.choice(['en', 'es', 'fr', 'de'])}/p/{i}?id={i}{rng.choice(['', '&a=1&b=2', '&c=3', '#x'])}" for i in range(200)]
    urls += [f"http{rng.choice(['', 's'])}://m{i}.example.org/{rng.choice(['en', 'es', 'fr'])}/p/{i}{rng.choice(['', '?a=1', '?b=1&c', '?id=1#', '?zz'])}" for i in range(60)] + [None, "", "x"]
    got = {r["page_id"]: r for r in judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), support=support, confidence=confidence).collect()}
    for i, (rule, verdict, sure) in enumerate(judged_urls(urls, support, confidence)):
        assert (got[i]["rule"], got[i]["verdict"]) == (rule, verdict) and (sure is None) == (got[i]["confidence"] is None)
        assert sure is None or math.isclose(sure, got[i]["confidence"])


def test_urls_with_many_fixed_parameters(spark):
    """Thirty keys that always come together are one item, not 2**30 combinations; a page with any of them has it."""
    keys = "&".join(f"k{i}={i}" for i in range(30))
    rows = [(i, f"http://a.net/{'es' if i % 2 else 'fr'}/x?{keys}") for i in range(100)] + [(i, f"http://b.com/x/{i}") for i in range(100, 200)] + [(200, "http://c.org/?k7"), (201, "http://c.org/?other")]
    got = {r["page_id"]: (r["verdict"], r["confidence"]) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[200] == ("block", 1.0) and got[201][1] is None


def test_token_classes_are_confirmed(spark, monkeypatch):
    from spanlake.llm import url_filter as module

    pages = spark.createDataFrame([(0, ["a", "b", "c"]), (1, ["a", "b", "d"]), (2, ["c", "e"])], "page long, tokens array<string>")
    assert {r["token"]: r["class"] for r in module.token_classes(pages, 0.1).collect()} == {"a": "a", "b": "a", "c": "c", "d": "d", "e": "e"}
    real = F.xxhash64
    monkeypatch.setattr(module.F, "xxhash64", lambda *c: real(F.lit(0)))  # digests that tell nothing but parity
    assert {r["token"]: r["class"] for r in module.token_classes(pages, 0.1).collect()} == {t: t for t in "abcde"}


# 9


def removed_lines(rows, width=3):
    seen, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = t.split("\n") if t is not None else []
        gone = set()
        for k in range(len(lines) - width + 1):
            key = "\n".join(lines[k : k + width])
            if not re.search(r"\S", key):
                continue
            if key in seen:
                gone.update(range(k, k + width))
            seen.setdefault(key, (i, k))
        out[i] = (len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup(spark, docs):
    rng = random.Random(8)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", f"line {rng.randrange(40)}"]) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "same\n" * 40)]
    for data in (rows, list(enumerate(texts()))):
        got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup(table(spark, data)).collect()}
        assert got == removed_lines(data)
    out = line_dedup(odd(spark).withColumn("text", F.concat_ws("\n", "text", "text", "text", "text")))
    assert out.count() == 6 and set(out.columns) == {*odd(spark).columns, "n_lines", "n_removed"}
    assert line_dedup(empty(spark)).count() == 0


# 10


def jaccard_labels(rows, percent, width):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = {}
    for i, t in rows:
        w = lower(t).encode().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            changed |= label[a] != label[b]
            label[a] = label[b] = least
    return {i: (len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize(("percent", "width"), [(85, 4), (80, 5), (60, 1), (100, 2)])
def test_jaccard(spark, percent, width):
    rng = random.Random(percent)
    rows = list(enumerate(texts(percent, 40)))
    for base_size in (6, 20, 60, 300):  # near copies at all distances about the threshold
        base = [f"w{rng.randrange(10**6)}" for _ in range(base_size)]
        for k in range(12):
            words = [w if rng.random() > 0.006 * k else f"e{rng.randrange(10**6)}" for w in base]
            rows.append((1000 * base_size + k, " ".join(words[: len(words) - rng.choice([0, 0, k // 2]) or None])))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(table(spark, rows), percent, width).collect()}
    assert got == jaccard_labels(rows, percent, width)


def test_jaccard_large_groups(spark):
    """More copies than are paired: groups are laid out in tiles."""
    rng = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 12])):
            words[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(table(spark, rows)).collect()}
    assert got == jaccard_labels(rows, 85, 4)


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_no_link_by_a_structured_collision(spark):
    """Words whose polynomial hashes modulo 2**64 are equal, whatever the base."""
    one, other = thue_morse(1024)
    rows = [(1, one), (2, other), (3, "x " * 30 + one), (4, "x " * 30 + other), (5, one.replace("a", "w ")), (6, other.replace("a", "w "))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(table(spark, rows)).collect()}
    assert got == jaccard_labels(rows, 85, 4) and got[1][1] == 1 and got[2][1] == 2
    rows = [(1, one + " " + "y " * 25), (2, other + " " + "z " * 25)]
    assert {r[0]: tuple(r)[1:] for r in substring_dedup(table(spark, rows)).collect()} == removed_words(rows)
    got = sorted(tuple(r)[:4] + (bytes(r[4]),) for r in suffix_dedup(table(spark, [(1, one), (2, other)]), 400).collect())
    assert got == removed_bytes([(1, one.encode()), (2, other.encode())], 400)


def test_links_are_confirmed_by_words(monkeypatch):
    from spanlake.llm import jaccard_join as module

    assert _confirmed(b"a b c d e F", b"A b\tc d e f", 100, 4) and not _confirmed(b"a b c d e f", b"a b c d e g", 85, 4)
    assert _confirmed(b"one", b"ONE", 85, 4) and not _confirmed(b"one two", b"one", 85, 4)
    monkeypatch.setattr(module, "short_hashes", lambda v, n: np.zeros(max(0, len(v) - n + 1), dtype=np.uint64))
    assert not _confirmed(b"a b c d e f", b"g h i j k l", 85, 4)  # equal hashes, different words


@pytest.mark.parametrize("pivots", [1, 8])
def test_large_groups_without_one_middle(spark, monkeypatch, pivots):
    """Two groups of near copies that share passages, and a chain between them: pivots leave some over, which meet all others."""
    from spanlake.llm import jaccard_join as module

    monkeypatch.setattr(module, "PIVOTS", pivots)
    rng = random.Random(13)
    base = [f"w{i}" for i in range(200)]
    far = base[:100] + [f"v{i}" for i in range(100)]
    rows = []
    for i in range(160):
        words = list(base if i % 2 else far)
        for _ in range(rng.choice([0, 1, 3, 6])):
            words[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + k, " ".join(base[: 200 - 4 * k] + far[200 - 4 * k :])) for k in range(26)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(table(spark, rows)).collect()}
    assert got == jaccard_labels(rows, 85, 4)


def test_jaccard_odd_rows(spark):
    got = sorted((str(r[0]), r[1], str(r[2])) for r in jaccard_components(odd(spark)).collect())
    assert got == [("1", 97, "1"), ("1", 97, "1"), ("2", 97, "1"), ("3", 0, "3"), ("3", 1, "3"), ("None", 97, "None")]
    kept = one_of_each_group(odd(spark))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3", "3", "None"] and kept.columns == odd(spark).columns
    assert jaccard_components(empty(spark)).count() == 0


def test_jaccard_registered_table(spark):
    from spanlake.llm.queries import op10_jaccard_join
    from tests.conftest import SMALL

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op10_jaccard_join(spark, SMALL).collect()}
    assert got == jaccard_labels(rows, 85, 4) and sum(i != c for i, (_, c) in got.items()) > 0


def test_very_long_texts(spark):
    """Texts of over 20 MB: a copy, a near copy, and one that is one word."""
    words = [f"w{i * 2654435761 % 1000003:x}" for i in range(3_200_000)]
    text = " ".join(words)
    words[1_000_000] = "edited"
    rows = [(1, text), (2, text), (3, " ".join(words)), (4, "x" * 2_000_000), (5, "short")]
    assert len(text) > 20_000_000
    df = table(spark, rows).repartition(2).cache()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(df).collect()}
    assert [got[i][1] for i in range(1, 6)] == [1, 1, 1, 4, 5] and got[1] == got[2] and got[4] == (1, 4)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(df).select("doc_id", "n_words", "n_removed").collect()}
    assert got[2] == (3_200_000, 3_200_000) and got[3] == (3_200_000, 3_199_999) and got[4] == (1, 0)
    got = {r["doc_id"]: r["n_removed"] for r in suffix_dedup(df).select("doc_id", "n_removed").collect()}
    assert got[1] == got[2] == len(text) and 0 < len(rows[2][1]) - got[3] < 20 and got[4] == 2_000_000 and got[5] == 0
    got = {r["doc_id"]: r["n_removed"] for r in line_dedup(df).select("doc_id", "n_removed").collect()}
    assert set(got.values()) == {0}
    assert ql.score(df, ql.train(df, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).count() == 5
    assert {r["spans"] for r in secret_spans(df).select("spans").collect()} == {""}
    df.unpersist()


def test_bands():
    for percent in (50, 80, 85, 95):
        bands = Bands(percent)
        for n in range(1, 400):
            own, largest = np.searchsorted(bands.tops, n), n * 100 // percent
            assert np.searchsorted(bands.tops, largest) <= own + 1
            level = np.searchsorted(bands.tops, largest)
            assert (n + largest) * (100 - percent) // (100 + percent) <= bands.differ[level]
