"""Secrets in texts: fixed patterns, and strings that neither their surroundings nor a dictionary can explain.

The novelty of a candidate is what it adds, in bytes per byte, to the zstandard frame of its surroundings, compressed
with a dictionary of identifiers and words. Names, paths and repeated strings are explained by either and add little;
a random key adds about as many bytes as it has.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.common import small_batches

KINDS = ("assign", "access", "hex", "novel")
_NAMES = "password|passwd|secret|token|api_?key"
_ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                     re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
#: Shortest string that is weighed.
MIN_LENGTH = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_LENGTH)
_SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|credential|private|bearer|authorization|signature|session|cookie|"
                        r"access.?key|api.?key|client.?key|account.?key", re.ASCII | re.IGNORECASE)
#: Any text with a span has one of these; RE2 looks for them in whole columns at once.
_MAY = (f"(?i){_NAMES}|{_SENSITIVE.pattern}", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}")
#: Text that primes the compressor. Fixed values.
DICTIONARY = """
import from class def function return public private protected static final void string int long boolean null true false
const let var new this self super async await export default interface implements extends package module require include
username user_name password passwd secret token api_key apikey access_key client_id client_secret private_key public_key
authorization bearer session cookie signature credential credentials config configuration settings environment variable
example placeholder changeme your_api_key_here insert_token_here xxxxxxxxxxxxxxxx test_password dummy_secret none empty
http https www com org net localhost index html json xml yaml toml utf-8 content-type application text plain base64 encode
get set put post delete update create insert select where order group limit table column value key name type data list map
request response handler service manager controller factory builder provider context session_id user_id account_id
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef 1234567890 00000000000000000000
The and of to in is that for with was on are by this be from or an which you not have it at as but they will their more
""".strip()


class Novelty:
    """Marginal compressed size against a dictionary and the surroundings."""

    def __init__(self, dictionary: str = DICTIONARY, around: int = 256):
        self.around = around
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_dict_id=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - self.around):start], text[end:end + self.around]
        context = (before + after).encode("utf-8", "replace")
        whole = context + b" " + text[start:end].encode("utf-8", "replace")
        added = len(self.compressor.compress(whole)) - len(self.compressor.compress(context))
        return added / (end - start)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind number, end) of the fixed patterns, leftmost and non-overlapping for each kind, in code points."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 32]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, str]], novelty: Novelty, reach: int, least: float):
    """Strings of MIN_LENGTH characters with a letter and a digit, at most ``reach`` before or behind a sensitive word, that
    compression can't explain and no base span meets."""
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    found = []
    if not words:
        return found
    starts, ends = [w[0] for w in words], sorted(w[1] for w in words)
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        # name=value: the name is not part of the string, but a word in it may make the value sensitive.
        while (cut := text.find("=", start, end)) >= 0 and end - cut - 1 >= MIN_LENGTH:
            start = cut + 1
        own = text[start:end]
        before, behind = bisect.bisect_right(ends, start) - 1, bisect.bisect_left(starts, end)
        near = (before >= 0 and start - ends[before] <= reach) or (behind < len(starts) and starts[behind] - end <= reach)
        if not near or not any(c.isdigit() for c in own) or not any(c.isalpha() for c in own):
            continue
        if any(s < end and start < e for s, _, e in base):
            continue
        if novelty(text, start, end) >= least:
            found.append((start, 3, end))
    return found


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 48, least: float = 0.7,
                 dictionary: str = DICTIONARY) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for every row.

    ``spans`` are ``kind:start:end`` in code points, end exclusive, by start and then kind; ``base_sha256`` is the
    digest of those of the three fixed kinds. A null text is empty: no spans, the digest of the empty string. Repeated
    rows each get their row, null ids stay null, other columns are ignored.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string"
    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            may = pa.array([False] * len(column))
            for pattern in _MAY:
                may = pc.or_(may, pc.match_substring_regex(column, pattern))
            counts = [[0] * len(column) for _ in KINDS]
            digests, spans = [nothing] * len(column), [""] * len(column)
            for i in pc.indices_nonzero(may).to_pylist():
                text = column[i].as_py()
                base = base_spans(text)
                more = novel_spans(text, base, novelty, reach, least)
                for _, kind, _ in base + more:
                    counts[kind][i] += 1
                digests[i] = hashlib.sha256(_joined(base).encode()).hexdigest()
                spans[i] = _joined(base + more)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())], names=names)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return small_batches(rows).mapInArrow(run, schema)
