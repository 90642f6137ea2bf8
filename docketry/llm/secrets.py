"""Secrets in texts: stated patterns, and random strings found by their token efficiency.

Words that a byte-level BPE vocabulary knows are written with few tokens; random strings need about one for
every two characters. A candidate is a run of key-like characters that is long enough to be a key; those with few
characters a token are secrets. Digests and identifiers that are random by nature but no secret (hashes of
known lengths, UUIDs, numbers) are excluded first, and so are paths and names made of parts that the vocabulary
writes with few tokens. Where a stated span covers a part of a candidate, the rest is judged too.

Defined cases: a null or empty text has no spans; spans are code points, end exclusive; repeated rows get
equal results; an empty table gives an empty result; other columns stay where rows are redacted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import Remembered, load_ranks
from .common import in_batches, slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
#: Every assignment holds one of these in lower case, and a colon or an equals sign.
ASSIGN_MARKS = ("passw", "secret", "token", "api")

#: Candidates of the token test.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Below this many characters a token a candidate is random.
LEAST_EFFICIENCY = 2.2
#: Least characters beside a UUID that can be a secret.
LEAST_BESIDE = 8
#: Lengths of hexadecimal digests in common use (fixed values).
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
DIGEST = re.compile(r"[0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[\d_=+/-]+")
#: Path-like and word-like identifiers: parts of letters, with two digits at most, joined by separators. Their parts decide.
WORDS = re.compile(r"[_/+=-]*(?:[A-Za-z]+\d{0,2}[_/+=-]+)*[A-Za-z]+\d{0,2}[_/+=-]*")
LETTERS = re.compile(r"[A-Za-z]+")
#: Bytes that may stand in a candidate become x, others a blank.
CLASS = bytes(ord("x") if chr(b).isascii() and (chr(b).isalnum() or chr(b) in "+/_=-") else 32 for b in range(256))
HEX_CLASS = bytes(ord("x") if chr(b) in "0123456789abcdef" else 32 for b in range(256))

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def base_spans(text: str, data: bytes) -> list[Span]:
    """Spans of the stated patterns; each pattern is tried only where its fixed parts occur."""
    found: list[Span] = []
    if b"=" in data or b":" in data:
        lower = data.lower()
        if any(mark.encode() in lower for mark in ASSIGN_MARKS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    if b"x" * 32 in data.translate(HEX_CLASS):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class TokenTest:
    """What the vocabulary tells of a candidate."""

    def __init__(self, pattern: str, ranks_path: str):
        self.find, self.known = regex.compile(pattern).findall, Remembered(load_ranks(ranks_path))

    def tokens(self, text: str) -> int:
        return sum(len(self.known[piece]) for piece in self.find(text)) // 4

    def __call__(self, candidate: str) -> bool:
        """Whether a candidate has few characters a token."""
        return len(candidate) < LEAST_EFFICIENCY * self.tokens(candidate)

    def is_name(self, candidate: str) -> bool:
        """Whether every part of a word-like candidate is one token or has many characters a token."""
        return bool(WORDS.fullmatch(candidate)) and not any(self(part) and self.tokens(part) > 1 for part in LETTERS.findall(candidate))


def is_known(candidate: str, random: TokenTest) -> bool:
    """Whether a candidate is a digest or an identifier, which are no secrets for being random."""
    if NUMBER.fullmatch(candidate) or random.is_name(candidate):
        return True
    rest = UUID.sub("", candidate)
    if rest != candidate:  # an identifier and what stands beside it
        return len(rest) < LEAST_BESIDE or is_known(rest, random) or not random(rest)
    return bool(DIGEST.fullmatch(candidate)) and len(candidate) in DIGEST_LENGTHS


def token_test(pattern: str, ranks_path: str) -> TokenTest:
    return TokenTest(pattern, ranks_path)


def uncovered(start: int, end: int, base: list[Span]) -> list[tuple[int, int]]:
    """The parts of a range that no stated span covers."""
    found = []
    for s, _, e in sorted(base):
        if s < end and start < e:
            if start < s:
                found.append((start, s))
            start = max(start, e)
    return [*found, (start, end)] if start < end else found


def random_spans(text: str, data: bytes, base: list[Span], random: TokenTest) -> list[Span]:
    """Candidates with letters that fail the token test, without what stated spans cover of them."""
    if b"x" * 20 not in data.translate(CLASS):
        return []
    secret = lambda s: any(c.isalpha() for c in s) and not is_known(s, random) and random(s)
    least = 20  # of a candidate's characters
    found = []
    for m in CANDIDATE.finditer(text):
        whole = secret(m[0])
        for start, end in uncovered(m.start(), m.end(), base):
            s = text[start:end]
            if whole if s == m[0] else (whole and not is_known(s, random)) or (len(s) >= least and secret(s)):
                found.append((start, 3, end))
    return found


def spans_of(text: str | None, random: TokenTest) -> list[Span]:
    """All spans by start, then kind; of a random span that overlaps a stated one the rest is kept."""
    text = text or ""
    data = text.encode()
    base = base_spans(text, data)
    return sorted(base + random_spans(text, data, base, random))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.IntegerType())]))
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))


def find_spans(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans (start, kind, end) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = token_test(pattern, ranks_path)
        for batch in slices(batches, "text"):
            found = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans_of(t, random)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, SPAN_ARROW)], ["doc_id", "spans"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_batches(rows).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)]))


def redact(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """df with every span's text replaced by `[kind]`; overlapping spans are replaced together. A column of text lengths follows."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = token_test(pattern, ranks_path)
        for batch in slices(batches, text_col):
            out = []
            for text in batch.column(at).to_pylist():
                parts, done = [], 0
                for start, kind, end in spans_of(text, random):
                    if start >= done:
                        parts += [text[done:start], f"[{KINDS[kind]}]"]
                    done = max(done, end)
                out.append("".join([*parts, text[done:]]) if parts else text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            if chars_col in names:
                columns[names.index(chars_col)] = pa.array([None if t is None else len(t) for t in out], batch.schema.field(names.index(chars_col)).type)
            yield pa.record_batch(columns, schema=batch.schema)

    names = list(df.columns)
    return in_batches(df).mapInArrow(run, df.schema)


def digest_columns(found: DataFrame) -> DataFrame:
    """doc_id, counts by stated kind, the digest of the stated spans and all spans as text."""
    text = lambda keep: F.array_join(F.transform(keep, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    stated = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(text(stated), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
