"""Secrets in texts: patterns, and strings in a sensitive context that zstandard can't predict.

A candidate is a long run of key characters shortly behind a sensitive word, or what an '=' in such a run assigns. Its
novelty is what it adds to the compressed size of its surroundings, without copies of it, a byte of it, by a compressor
primed with a dictionary of identifiers and code. Words and identifiers cost little; keys cost nearly their entropy.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from spanlake.llm.arrays import byte_texts, pieces
from spanlake.llm.frames import column

PIECE_BYTES = 4 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))  # places stay
KINDS = ("assign", "access", "hex", "novel")

_ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs, without the shorter ones that would be dropped
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Words whose neighbourhood is sensitive.
CONTEXT_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "credential", "bearer", "authorization", "auth_", "signing", "encryption", "client_id", "key=", "key:", "pwd", "passphrase")
_CONTEXT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)))
LEAST_CHARS = 20
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_CHARS)
_NAME = re.compile(r"[a-z_-]*|[A-Z_-]*")
_ASSIGNED = re.compile(r"=+(?=[A-Za-z0-9+/_-])")  # padding at the end assigns nothing
#: How many characters may lie between a sensitive word and a candidate, and how many on either side are its surroundings.
REACH, AROUND = 64, 256
NOVELTY = 0.6
#: Identifiers and code that prime the compressor.
IDENTIFIERS = """import export const let var function return class def self this public private static void string int float double bool boolean
true false null None undefined if else for while try except catch finally raise throw new delete async await yield lambda with as from in is not and or
username user_name password passwd secret token access_token refresh_token api_key apiKey API_KEY secret_key client_id client_secret private_key public_key
authorization Authorization: Bearer Basic credential credentials session_id session cookie csrf_token signature nonce salt hash sha256 md5 base64 encode decode encrypt decrypt
config configuration settings environment os.environ process.env getenv setenv DATABASE_URL database host localhost port connection_string http:// https:// www. .com .org .net /api/v1/ /v2/ /users/ /login /oauth2/
example_password changeme your_api_key_here YOUR_TOKEN_HERE placeholder xxxxxxxxxxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef
----BEGIN RSA PRIVATE KEY---- ----END RSA PRIVATE KEY---- ssh-rsa AAAAB3NzaC1yc2E test_ demo_ sample_ default_ internal_ production_ staging_ development_ request response header body payload content_type application/json
"""
_LEVEL = 9


class Novelty:
    """Marginal compressed bytes of strings under a primed compressor."""

    def __init__(self, dictionary: bytes):
        self._squeeze = zstandard.ZstdCompressor(level=_LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def of(self, before: str, candidate: str, after: str) -> float:
        """What the candidate adds a byte of it, between its surroundings."""
        without = len(self._squeeze.compress((before + after).encode()))
        return (len(self._squeeze.compress((before + candidate + after).encode())) - without) / len(candidate)


def base_spans(text: str, lower: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the patterns' matches, in no order."""
    spans = []
    if any(w in lower for w in _ASSIGN_WORDS):
        spans += [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return spans + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def _parts(text: str, lower: str, start: int, end: int) -> list[tuple[int, int]]:
    """A run of key characters, split at each '=' that a candidate's length follows, without the names in front of these."""
    out = []
    for s, e in (m.span() for m in _ASSIGNED.finditer(text, start, end) if end - m.end() >= LEAST_CHARS):
        head = max(text.rfind("/", start, s), text.rfind("+", start, s), start - 1)
        named = any(w in lower[head + 1 : e] for w in CONTEXT_WORDS) or _NAME.fullmatch(text, head + 1, s)
        out.append((start, max(head, start) if named else s))
        start = e
    return [*out, (start, end)]


def _surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """What stands on either side, without other copies of the string: next to one, a key would cost nothing."""
    candidate, n = text[start:end], end - start
    before, after = text[max(0, start - AROUND - n) : start], text[end : end + AROUND + n]
    # blanked before they are cut to AROUND, so that no part of a copy stays
    before, after = (side.replace(candidate, "\0" * n) for side in (before, after))
    return before[-AROUND:].replace("\0", ""), after[:AROUND].replace("\0", "")


def novel_spans(text: str, lower: str, taken: list[tuple[int, str, int]], novelty: Novelty, least: float) -> list[tuple[int, str, int]]:
    """Candidates outside the spans taken, shortly behind a sensitive word, whose novelty reaches `least`.

    Of NAME=value the value counts, and the sensitive word can be in the name; the whole run counts where no part of it does.
    """
    if not any(w in lower for w in CONTEXT_WORDS):
        return []
    out, edges = [], sorted((s, e) for s, _, e in taken)
    candidates = [m.span() for m in _CANDIDATE.finditer(text)]
    if not candidates:
        return []
    marks = [m.end() for m in _CONTEXT.finditer(lower)]
    held = 0

    def near(place: int) -> bool:
        at = bisect_right(marks, place)
        return at > 0 and place <= marks[at - 1] + REACH

    def novel(start: int, end: int) -> bool:
        k = held
        while k < len(edges) and edges[k][1] <= start:
            k += 1
        candidate = text[start:end]
        if k < len(edges) and edges[k][0] < end or len(candidate) < LEAST_CHARS or candidate.isalpha() or candidate.isdigit():
            return False
        before, after = _surroundings(text, start, end)
        return novelty.of(before, candidate, after) >= least

    for start, end in candidates:
        while held < len(edges) and edges[held][1] <= start:
            held += 1
        behind, parts = near(start), _parts(text, lower, start, end)
        found = [(s, "novel", e) for s, e in parts if (behind or near(s)) and novel(s, e)]
        if not found and len(parts) > 1 and behind and novel(start, end):
            found = [(start, "novel", end)]
        out += found
    return out


def _scan(dictionary: bytes, least: float):
    def scanned(batches):
        novelty = Novelty(dictionary)
        for part in pieces(batches, "text", PIECE_BYTES):
            columns = {k: [] for k in ("n_assign", "n_access", "n_hex", "base", "spans")}
            for raw in byte_texts(part.column(1)):
                text = (raw or b"").decode()
                lower = (raw or b"").translate(_LOWER).decode()
                base = base_spans(text, lower)
                found = sorted(base + novel_spans(text, lower, base, novelty, least), key=lambda s: (s[0], KINDS.index(s[1])))
                for k in KINDS[:3]:
                    columns[f"n_{k}"].append(sum(s[1] == k for s in base))
                shown = [f"{k}:{s}:{e}" for s, k, e in found]
                columns["base"].append(",".join(x for x in shown if not x.startswith("novel")))
                columns["spans"].append(",".join(shown))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(columns[k], pa.int64()) for k in ("n_assign", "n_access", "n_hex")), *(pa.array(columns[k], pa.string()) for k in ("base", "spans"))], names=["doc_id", *columns])

    return scanned


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", identifiers: str = IDENTIFIERS, novelty: float = NOVELTY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans), a row per input row.

    base and spans list kind:start:end in code points, end exclusive, by start, then by kind as in KINDS; spans also has
    the novel strings. Null or empty text: no spans. Ids can be null or repeat; each row is judged alone. Only the two named columns
    are read, so others may have any names. An empty table gives no rows.
    """
    docs = docs.select(column(id_col).cast("long").alias("doc_id"), column(text_col).alias("text"))
    return docs.mapInArrow(_scan(identifiers.encode(), novelty), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")
