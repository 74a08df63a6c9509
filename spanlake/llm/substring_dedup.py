"""Removal of word windows that occur earlier, by super-k-mer partitioning.

Consecutive windows that share a minimiser (the smallest hash of a few-word gram in the window) travel as one packed
string to the minimiser's bucket. There the windows' hashes are sorted, and equal windows are confirmed by their words.

Before the shuffle, each piece of a task's rows removes the windows that it repeats itself, so a window of a passage that
fills a third of the corpus reaches its bucket once a piece and not once a document.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.arrays import Words, byte_texts, equal_groups, mix, pieces, runs, sliding_min, window_hashes, words_of

PIECE_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
GRAM = 4


def earlier_repeats(words: Words, width: int, doc: np.ndarray, start: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which windows lie in one text, and which of these repeat one at a smaller (doc, start).

    doc and start are of each text's first word; texts come in that order.
    """
    hashes = words.hashes() if hashes is None else hashes
    win = window_hashes(hashes, width)
    whole, later = np.zeros(len(win), dtype=bool), np.zeros(len(win), dtype=bool)
    if not len(win):
        return whole, later
    text = words.text_of()
    whole[:] = text[: len(win)] == text[width - 1 :]
    inside = np.flatnonzero(whole)
    index, begins = equal_groups(win[inside])
    if not len(index):
        return whole, later
    index = inside[index]
    head = index[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    owner = text[index]
    place = start[owner] + index - words.first[owner]
    first_owner = text[head]
    first_place = start[first_owner] + head - words.first[first_owner]
    after = (doc[owner] > doc[first_owner]) | (doc[owner] == doc[first_owner]) & (place > first_place)
    raw, a, b = words.raw, words.starts, words.ends
    index, head = index[after], head[after]
    left, right, left_to, right_to = (x.tolist() for x in (a[index], a[head], b[index + width - 1], b[head + width - 1]))
    equal = np.fromiter((raw[p:q] == raw[r:s] for p, q, r, s in zip(left, left_to, right, right_to)), dtype=bool, count=len(index))
    later[index[equal]] = True
    if not equal.all():  # two windows with one hash: settle these by their words
        odd = np.isin(win, win[index[~equal]]) & whole
        seen: dict[bytes, tuple[int, int]] = {}
        for i in np.flatnonzero(odd):
            key, at = words.slice(i, width), (int(doc[text[i]]), int(start[text[i]] + i - words.first[text[i]]))
            later[i] = at > seen.setdefault(key, at)
    return whole, later


def _covered(later: np.ndarray, words: Words, doc: np.ndarray, start: np.ndarray, width: int) -> pa.RecordBatch:
    """Runs of words that later windows cover, as (doc_id, first word, number of words)."""
    text = words.text_of()
    breaks = np.zeros(len(later), dtype=bool)
    breaks[1:] = text[1 : len(later)] != text[: len(later) - 1]
    at, count = runs(later, breaks)
    owner = text[at]
    return pa.RecordBatch.from_arrays([pa.array(doc[owner]), pa.array(start[owner] + at - words.first[owner]), pa.array(count + width - 1)], names=["doc_id", "first", "n"])


def _pack(width: int, buckets: int):
    def packed(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for part in pieces(batches, "text", PIECE_BYTES):
            part = part.filter(pa.compute.and_(part.column(0).is_valid(), part.column(1).is_valid()))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            order = np.argsort(ids, kind="stable")
            doc = ids[order].astype(np.int64)
            texts = byte_texts(part.column(1))
            words = words_of([texts[i] for i in order])
            if len(words) < width:
                continue
            zero = np.zeros(len(doc), dtype=np.int64)
            hashes = words.hashes()
            whole, later = earlier_repeats(words, width, doc, zero, hashes)
            least = sliding_min(window_hashes(hashes, GRAM), width - GRAM + 1)
            text = words.text_of()
            breaks = np.zeros(len(whole), dtype=bool)
            breaks[1:] = (least[1:] != least[:-1]) | (text[1 : len(whole)] != text[: len(whole) - 1])
            at, count = runs(whole & ~later, breaks)
            bucket = (mix(least[at]) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            at, count, bucket = at[by], count[by], bucket[by]
            raw, a, b = words.raw, words.starts[at].tolist(), words.ends[at + count + width - 2].tolist()
            owner = text[at]
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(at))
            done = _covered(later, words, doc, zero, width)
            rows = {"bucket": bucket[cuts[:-1]], "texts": [], "places": [], "done": [None] * (len(cuts) - 1)}
            for p, q in zip(cuts[:-1], cuts[1:]):
                rows["texts"].append(squeeze.compress(b"\n".join([raw[i:j] for i, j in zip(a[p:q], b[p:q])])))
                rows["places"].append(squeeze.compress(np.concatenate([doc[owner[p:q]], at[p:q] - words.first[owner[p:q]]]).tobytes()))
            if len(cuts) > 1 and done.num_rows:
                rows["done"][0] = squeeze.compress(b"".join(done.column(k).to_numpy().astype(np.int64).tobytes() for k in range(3)))
            yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"]), *(pa.array(rows[k], pa.binary()) for k in ("texts", "places", "done"))], names=list(rows))

    return packed


def _count(width: int):
    def counted(table: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor()
        texts, doc, start, out = [], [], [], []
        for blob, place, done in zip(*(table.column(k).to_pylist() for k in ("texts", "places", "done"))):
            texts += expand.decompress(blob).split(b"\n")
            a, b = np.frombuffer(expand.decompress(place), dtype=np.int64).reshape(2, -1)
            doc.append(a)
            start.append(b)
            if done:
                columns = np.frombuffer(expand.decompress(done), dtype=np.int64).reshape(3, -1)
                out.append(pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["doc_id", "first", "n"]))
        doc, start = np.concatenate(doc), np.concatenate(start)
        order = np.lexsort((start, doc))
        words = words_of([texts[i] for i in order])
        _, later = earlier_repeats(words, width, doc[order], start[order])
        out.append(_covered(later, words, doc[order], start[order], width))
        return pa.Table.from_batches(out)

    return counted


def _remove(batches):
    for part in pieces(batches, "text", PIECE_BYTES):
        ids, texts, spans = part.column(0), byte_texts(part.column(1)), part.column(2).to_pylist()
        n_words, n_removed, kept = [], [], []
        for text, span in zip(texts, spans):
            words = (text or b"").split()
            n_words.append(len(words))
            if span:
                gone = np.zeros(len(words) + 1, dtype=np.int32)
                for s in span:
                    if s["first"] < len(words):  # rows that share an id can differ in length
                        gone[s["first"]] += 1
                        gone[min(len(words), s["first"] + s["n"])] -= 1
                words = [w for w, g in zip(words, np.cumsum(gone).tolist()) if not g]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def repeated_word_spans(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, first, n): words covered by windows that also start earlier; spans of a document can overlap."""
    if width < GRAM:
        raise ValueError(f"width must be {GRAM} at least")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, math.ceil(size / BUCKET_BYTES))
    packed = docs.mapInArrow(_pack(width, buckets), "bucket long, texts binary, places binary, done binary")
    return packed.groupBy("bucket").applyInArrow(_count(width), "doc_id long, first long, n long")


def substring_dedup(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_text (the kept words joined by one space).

    A word goes if a window of `width` consecutive words covers it whose word sequence also starts at a smaller
    (doc_id, start). Windows are judged on the input. Only the two named columns are read, so others may have any names.

    Null or empty text, or fewer words than a window: nothing is removed. Null doc_id: nothing is removed, and the row
    takes no part in the comparison. Rows that share a doc_id count as one document: windows at the same start are not
    earlier than each other, and a span found in one of the rows goes from each. An empty table gives no rows.
    """
    spans = repeated_word_spans(docs, width, id_col, text_col).groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(spans, "doc_id", "left").mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept_text string")
