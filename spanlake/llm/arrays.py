"""Numpy helpers that the Arrow stages share: words, rolling hashes, sliding minima, equal groups.

All of them work on one bounded piece of a task's rows at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute

#: The separators of `[^\x20\x09-\x0D]+`.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)
_BLOCK = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base modulo 2**64, and of its inverse."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("_powers", _BASE), ("_inverses", pow(_BASE, -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            globals()[name] = np.multiply.accumulate(out)
    return _powers[:n], _inverses[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive values; empty if there are fewer."""
    n = len(values)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * up, out=total[1:])
    out = total[width:] - total[:-width]
    out *= down[: n - width + 1]
    return mix(out)


def short_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Like window_hashes, with a mixing step for each of a few values: no structure of a run carries over to its hash."""
    n = len(values) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(_BASE)
        out += values[k : k + n]
        out = mix(out)
    return out


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def equal_groups(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices whose hash occurs more than once, in order of hash and index, and which of them begin a group."""
    n = len(hashes)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = (hashes >> bits << bits) | np.arange(n, dtype=np.uint64)
    key.sort()
    head = key >> bits
    same = np.zeros(n + 1, dtype=bool)
    if n > 1:
        same[1:-1] = head[1:] == head[:-1]
    index = (key[same[1:] | same[:-1]] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    full = hashes[index]
    order = np.lexsort((index, full))
    index, full = index[order], full[order]
    same = np.zeros(len(full) + 1, dtype=bool)
    if len(full) > 1:
        same[1:-1] = full[1:] == full[:-1]
    member = same[1:] | same[:-1]
    return index[member], ~same[:-1][member]


def runs(flags: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of the maximal runs of true flags; a run ends where breaks is true."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    begins = np.ones(len(at), dtype=bool)
    begins[1:] = np.diff(at) != 1
    if breaks is not None:
        begins |= breaks[at]
    first = np.flatnonzero(begins)
    return at[first], np.diff(np.append(first, len(at)))


@dataclass
class Words:
    """Words of several texts: `raw` holds each of them with one space behind it."""

    raw: bytes
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # of each text, and at last the number of all words

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """Index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def slice(self, first: int, count: int) -> bytes:
        return self.raw[self.starts[first] : self.ends[first + count - 1]]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, a bounded part of them at a time: the sum of its 8-byte blocks, each mixed with its place and the word's length."""
        data = np.frombuffer(self.raw + bytes(8), dtype=np.uint8)
        out = np.empty(len(self), dtype=np.uint64)
        blocks = np.append(0, np.cumsum((self.ends - self.starts + 7) // 8))
        at = 0
        while at < len(self):
            upto = max(at + 1, int(np.searchsorted(blocks, blocks[at] + _BLOCK // 8, "right")) - 1)
            if upto == at + 1:
                out[at] = _word_hash(data, int(self.starts[at]), int(self.ends[at]))
            else:
                n = self.ends[at:upto] - self.starts[at:upto]
                first = blocks[at:upto] - blocks[at]
                word = np.repeat(np.arange(upto - at), np.diff(blocks[at : upto + 1]))
                block = np.arange(len(word)) - first[word]
                out[at:upto] = mix(np.add.reduceat(_mixed_blocks(data, self.starts[at:upto][word] + 8 * block, n[word] - 8 * block, block, n[word]), first))
            at = upto
        return out


def _mixed_blocks(data: np.ndarray, place: np.ndarray, left: np.ndarray, block: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Up to 8 bytes from each place, mixed with the block's number and the word's length."""
    value = np.lib.stride_tricks.sliding_window_view(data, 8)[place].view(np.uint64).ravel()
    unused = np.uint64(8) * (np.uint64(8) - np.minimum(left, 8).astype(np.uint64))
    value = (value << unused) >> unused
    key = block.astype(np.uint64) * np.uint64(_BASE) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(mix(value ^ np.uint64(0xA0761D6478BD642F)) ^ mix(key))


def _word_hash(data: np.ndarray, start: int, end: int) -> np.uint64:
    """The hash of one word, which can be very long."""
    total = np.zeros(1, dtype=np.uint64)
    for a in range(start, end, _BLOCK):
        place = np.arange(a, min(end, a + _BLOCK), 8)
        total += _mixed_blocks(data, place, end - place, (place - start) // 8, np.full(len(place), end - start)).sum(dtype=np.uint64)
    return mix(total)[0]


def words_of(texts: list[bytes]) -> Words:
    """Splits texts at white space; None counts as empty."""
    joined = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", dtype=np.uint8)
    space = IS_SPACE[joined]
    last = np.zeros(len(joined), dtype=bool)
    last[1:] = space[1:] & ~space[:-1]
    limits = np.cumsum([len(t or b"") + 1 for t in texts], dtype=np.int64) - 1
    first = np.zeros(len(texts) + 1, dtype=np.int64)
    first[1:] = np.searchsorted(np.flatnonzero(last), limits, "right")
    text = joined[~space | last].copy()
    text[IS_SPACE[text]] = 32
    ends = np.flatnonzero(text == 32)
    starts = np.zeros(len(ends), dtype=np.int64)
    starts[1:] = ends[:-1] + 1
    return Words(text.tobytes(), starts, ends, first)


def pieces(batches, text: str, limit: int):
    """Cuts Arrow batches into runs of rows with at most `limit` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, done = 0, 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(at, upto - at)
            at, done = upto, int(ends[upto - 1])


def byte_texts(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is None."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
