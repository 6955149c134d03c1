"""Secret scans by token efficiency.

Random strings cost many tokens: where ordinary words take four or more characters per token of a
tiktoken vocabulary, keys and passwords take about two. A candidate is a maximal run of 16 characters or more of the base-64
and URL alphabets that mixes at least two kinds of characters, or has a word of that length; it is reported as ``token`` if its characters per
token are at most ``RATIO``, unless it is a known digest (hexadecimal, in the length of a common digest), a UUID, or an
identifier (words joined by separators, numbers, paths). An identifier's words are told from random letters of one case by their own ratio, which must be over
``WORD_RATIO``. Spans of the fixed base patterns are always reported.

Edge cases: null and empty texts have no spans; rows are independent, so ties and repeated rows repeat;
an empty table gives an empty table; extra columns pass through, those named as an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cache, mapped, text_slices

#: Fixed patterns of the base scan, with the least length of what is kept.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
#: Words of which each assignment has one, for a cheap test of the whole text.
ASSIGN_WORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "token")

#: Parameters of the method.
LEAST, RATIO, WORD_RATIO = 16, 2.2, 1.78
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
IDENTIFIER = re.compile(r"(?:[0-9]+|[A-Za-z]?[a-z]+|[A-Z]+)(?:[/_=+-]+(?:[0-9]+|[A-Za-z]?[a-z]+|[A-Z]+))*[/_=+-]*")
LONG_WORD = re.compile(r"[A-Za-z]{16,}")
_RUN_BYTES = np.zeros(256, bool)
_RUN_BYTES[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True


def read_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken rank file; a few MB at most, so that it may be broadcast."""
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError("a vocabulary of over 64 MB isn't broadcast")
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def encoder(ranks: dict[bytes, int], pattern: str):
    """One encoder per worker, vocabulary and pattern, told by what they hold."""
    import tiktoken

    content = hashlib.sha256(pattern.encode())
    for token, rank in ranks.items():
        content.update(b"%d %d " % (rank, len(token)) + token)
    held, key = cache(__name__), content.hexdigest()
    if key not in held:
        held[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return held[key]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    spans = []
    if ":" in text or "=" in text:
        folded = text.lower()
        if any(w in folded for w in ASSIGN_WORDS):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return spans


def has_long_run(texts: list[str]) -> np.ndarray:
    """Of each text, whether it has a run of LEAST characters of the run alphabet."""
    if not texts:
        return np.zeros(0, bool)
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    flags = _RUN_BYTES[np.frombuffer(b"\n".join(data) + b"\n", np.uint8)]
    breaks = np.flatnonzero(~flags)  # each text ends with one
    longest = np.diff(breaks, prepend=-1) - 1
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(ends, breaks[longest >= LEAST], side="right")] = True
    return out


def looks_random(run: str, encode) -> bool:
    """Whether the run isn't a digest, UUID or identifier, and takes many tokens for its length."""
    if DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return False
    if IDENTIFIER.fullmatch(run):
        return any(len(w) <= WORD_RATIO * len(encode(w)) for w in LONG_WORD.findall(run))
    kinds = any(c.isdigit() for c in run) + any(c.islower() for c in run) + any(c.isupper() for c in run)
    return kinds >= 2 and len(run) <= RATIO * len(encode(run))


def spans_of(texts: list[str | None], encode) -> list[list[tuple[int, int, int]]]:
    """All spans of each text as (start, kind, end), ordered by start, then kind."""
    texts = [t or "" for t in texts]
    out = []
    for text, long in zip(texts, has_long_run(texts), strict=True):
        spans = base_spans(text)
        if long:
            spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
            base = [(a, b) for a, _, b in spans]
            for m in RUN.finditer(text):
                if not any(a <= m.start() and m.end() <= b for a, b in base) and looks_random(m[0], encode):
                    spans.append((m.start(), 3, m.end()))
        out.append(sorted(spans))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "secret_spans") -> DataFrame:
    """Adds ``out_col``: the spans (kind, start, end) of secrets, in code points, end exclusive."""
    from .bpe import replaced

    ranks = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = replaced(df.schema, out_col, SPAN)
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value, pattern).encode_ordinary
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            found = [x for texts in text_slices(column) for x in spans_of(texts, encode)]
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in found]
            spans = pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), spans], names=[*keep, out_col])

    return mapped(df, run, schema)


def digest(scanned: DataFrame, out_col: str = "secret_spans") -> DataFrame:
    """Counts by base kind, the base spans' SHA-256 and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda kind: F.size(F.filter(out_col, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(out_col, lambda s: s["kind"] != "token")
    return scanned.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col(out_col)).alias("spans"))
