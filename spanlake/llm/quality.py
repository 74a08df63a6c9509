"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairs cost time linear in the features, by
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from spanlake.llm.arrays import IS_SPACE, byte_texts, mix, pieces, words_of
from spanlake.llm.frames import column

BITS = 14
FACTORS = 8
PIECE_BYTES = 4 << 20
#: The fit takes at most so many labelled rows, those of the least hashes of doc_id, with texts of at most so many characters.
FIT_ROWS, FIT_CHARS = 6_000, 50_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Classes of bytes: space, lower case, upper case, digit, sentence mark, other ASCII, beyond ASCII, control.
_CLASS = np.full(256, 5, dtype=np.uint8)
_CLASS[:32] = 7
_CLASS[128:] = 6
_CLASS[IS_SPACE] = 0
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[list(b".,;:!?'\"-()")] = 4
N_STATS = 18


def features(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words of a batch (text, n_chars): index, value and each row's first place, and a row of statistics each."""
    texts = [t or b"" for t in byte_texts(part.column(part.schema.get_field_index("text")))]
    chars = part.column(part.schema.get_field_index("n_chars")).fill_null(0).to_numpy(zero_copy_only=False).astype(float)
    words = words_of([t.translate(_LOWER) for t in texts])
    n = np.diff(words.first)
    slot = (words.hashes() >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.sort((words.text_of() << BITS) | slot)
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
    count = np.diff(np.append(begins, len(key)))
    owner, index = key[begins] >> BITS, key[begins] & ((1 << BITS) - 1)
    value = 1 + np.log(count)
    norm = np.sqrt(np.bincount(owner, weights=value * value, minlength=len(texts)))
    value = value / norm[owner]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))

    stats = np.zeros((len(texts), N_STATS))
    for i, text in enumerate(texts):
        kinds = np.bincount(_CLASS[np.frombuffer(text, dtype=np.uint8)], minlength=8)
        share = kinds / max(1, len(text))
        lines = text.split(b"\n")
        stats[i, :8] = share
        stats[i, 8:13] = np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(len(text) / len(lines)), text.count(b" | ") / max(1, n[i]), kinds[2] / max(1, kinds[1] + kinds[2])
    stats[:, 13] = np.log1p(n)
    stats[:, 14] = np.diff(first) / np.maximum(1, n)
    lengths = words.ends - words.starts
    of = words.text_of()
    mean = np.bincount(of, weights=lengths, minlength=len(texts)) / np.maximum(1, n)
    stats[:, 15] = mean
    stats[:, 16] = np.sqrt(np.maximum(0, np.bincount(of, weights=lengths * lengths, minlength=len(texts)) / np.maximum(1, n) - mean * mean))
    stats[:, 17] = np.log1p(np.maximum(chars, 0))  # metadata
    return index, value.astype(np.float32), first, stats


@dataclass
class Machine:
    """Weights of the hashed words and, behind them, of the statistics, which are centred and scaled first."""

    bias: float
    w: np.ndarray
    v: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    fitted: bool = True

    def join(self, index, value, first, stats):
        """The hashed words and the statistics as one list of features, row by row."""
        rows, m = len(first) - 1, stats.shape[1]
        scaled = np.clip((stats - self.centre) / self.scale, -3, 3) * 0.3
        n = np.diff(first)
        start = first[:-1] + np.arange(rows) * m
        out_index, out_value = np.empty(len(index) + rows * m, dtype=np.int64), np.empty(len(index) + rows * m, dtype=np.float32)
        at = np.arange(len(index)) + np.repeat(np.arange(rows) * m, n)
        out_index[at], out_value[at] = index, value
        tail = (start + n)[:, None] + np.arange(m)
        out_index[tail], out_value[tail] = (1 << BITS) + np.arange(m), scaled
        return out_index, out_value, np.append(start, len(out_index))

    def parts(self, index, value, first):
        """Each row's margin, and its sums of v_if x_i."""
        at = first[:-1]  # no row is empty: each has statistics
        sums = np.add.reduceat(self.v[index] * value[:, None], at)
        squares = np.add.reduceat((self.v[index] ** 2).sum(axis=1) * value**2, at)
        return self.bias + np.add.reduceat(self.w[index] * value, at) + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def scores(self, part: pa.RecordBatch) -> np.ndarray:
        if not part.num_rows:
            return np.zeros(0)
        margin, _ = self.parts(*self.join(*features(part)))
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(index, value, first, stats, label, epochs: int = 12, batch: int = 256, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Logistic loss, minimised by AdaGrad over shuffled batches; the seed fixes the result."""
    rng = np.random.default_rng(seed)
    size = (1 << BITS) + stats.shape[1]
    scale = stats.std(axis=0)
    machine = Machine(0.0, np.zeros(size, dtype=np.float32), rng.normal(0, 0.02, (size, FACTORS)).astype(np.float32), stats.mean(axis=0), np.where(scale > 1e-9, scale, 1.0))
    index, value, first = machine.join(index, value, first, stats)
    machine.bias = float(np.log((label.sum() + 1) / ((1 - label).sum() + 1)))
    seen_w, seen_v, seen_b = np.full(size, 1e-2), np.full((size, FACTORS), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            n = first[rows + 1] - first[rows]
            begin = np.append(0, np.cumsum(n))
            where = np.repeat(first[rows] - begin[:-1], n) + np.arange(begin[-1])
            i, x = index[where], value[where]
            margin, sums = machine.parts(i, x, begin)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - label[rows]) / len(rows)
            e = np.repeat(error, n)
            ids, inverse = np.unique(i, return_inverse=True)
            g = np.bincount(inverse, weights=e * x) + decay * machine.w[ids]
            each = e[:, None] * x[:, None] * (np.repeat(sums, n, axis=0) - machine.v[i] * x[:, None])
            gv = np.stack([np.bincount(inverse, weights=each[:, f]) for f in range(FACTORS)], axis=1) + decay * machine.v[ids]
            seen_w[ids] += g * g
            seen_v[ids] += gv * gv
            seen_b += error.sum() ** 2
            machine.w[ids] -= rate * g / np.sqrt(seen_w[ids])
            machine.v[ids] -= rate * gv / np.sqrt(seen_v[ids])
            machine.bias -= rate * error.sum() / np.sqrt(seen_b)
    return machine


def _featured(batches):
    for part in pieces(batches, "text", PIECE_BYTES):
        index, value, first, stats = features(part)
        bounds = list(zip(first[:-1], first[1:]))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(part.schema.get_field_index("label")), pa.array([index[a:b].astype(np.uint16).tobytes() for a, b in bounds], pa.binary()), pa.array([value[a:b].tobytes() for a, b in bounds], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())], names=["doc_id", "label", "index", "value", "stats"])


def _columns(docs: DataFrame, id_col: str, text_col: str, chars_col: str) -> DataFrame:
    chars = column(chars_col) if chars_col in docs.columns else F.length(column(text_col))
    return docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"), chars.cast("double").alias("n_chars"))


def is_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality", rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Machine:
    """Fits on at most `rows` labelled rows that are not held out; without any, every text scores 0.5 and the machine's `fitted` is false.

    Labels other than 0 and 1, null ids and null labels are left out; of repeated ids the largest label counts. Chosen rows whose text is longer than
    `chars` characters are left out of the fit, and so are those that no document has; null texts count as empty. Of documents that share a chosen id each
    is a row of the fit. Only the named columns are read, so others may have any names.
    """
    labels = labels.select(column(id_col).cast("long").alias("doc_id"), column(label_col).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    labels = labels.where(~is_held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = _columns(docs, id_col, text_col, chars_col).join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.length("text"), F.lit(0)) <= chars)
    got = sample.mapInArrow(_featured, "doc_id long, label int, index binary, value binary, stats binary").toArrow().sort_by([("doc_id", "ascending"), ("stats", "ascending")])
    if not got.num_rows:
        return Machine(0.0, np.zeros((1 << BITS) + N_STATS, dtype=np.float32), np.zeros(((1 << BITS) + N_STATS, FACTORS), dtype=np.float32), np.zeros(N_STATS), np.ones(N_STATS), fitted=False)
    index = [np.frombuffer(b, dtype=np.uint16) for b in got.column("index").to_pylist()]
    value = np.concatenate([np.frombuffer(b, dtype=np.float32) for b in got.column("value").to_pylist()])
    stats = np.stack([np.frombuffer(b) for b in got.column("stats").to_pylist()])
    first = np.append(0, np.cumsum([len(x) for x in index]))
    return fit(np.concatenate(index).astype(np.int64), value, first, stats, got.column("label").to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", threshold: float = 0.7) -> DataFrame:
    """The input's rows and columns plus held_out, score (0 to 1) and predicted (1 from the threshold on).

    Null text counts as empty, null metadata as 0. Null ids are not held out. Input columns of these three names are
    replaced; others may have any names. The model is a constant of about 600 kB.
    """
    rest = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    chars = column(chars_col) if chars_col in docs.columns else F.length(column(text_col))
    kept = [c for c in rest if c != text_col]
    rows = docs.select(column(text_col).alias("text"), chars.cast("double").alias("n_chars"), F.struct(F.lit(0).alias(""), *map(column, kept)).alias("row"))

    def scored(batches):
        for part in pieces(batches, "text", PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(machine.scores(part).astype(float))], names=["text", "row", "score"])

    out = rows.mapInArrow(scored, StructType([rows.schema["text"], rows.schema["row"], StructField("score", DoubleType())]))
    columns = [F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in rest]
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    held = F.coalesce(F.crc32(F.col("row").getField(id_col).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return out.select(*columns, held.alias("held_out"), "score", predicted.alias("predicted"))
