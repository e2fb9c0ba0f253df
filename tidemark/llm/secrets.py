"""Secret scan: fixed kinds, and strings that stay new to a primed compressor.

The fixed kinds are regular expressions. Novelty looks at other strings in a
sensitive context: after a word such as key, token or credential, which ends up
to 40 characters before, on the same line or an earlier one. The word may be
plural, a part of a camel-case name (secretKey, APIKey), or run together with
others (apikey). Strings on the lines after such a string, with nothing but white
space, quotes and backslashes between, are in its context and share its
surroundings, as the lines of a key body do. A candidate's marginal cost is the compressed
length of its surroundings with it, less the length without it, where zstandard
is primed with a dictionary of identifiers and the surroundings come first. One of
more than ``PIECE_OVER`` characters is measured in pieces, as the compressor
learns the alphabet of a long string and then takes few bits for each character;
a long string that repeats itself is not novel. A string that costs at least ``LEAST_SHARE`` of its own bytes is incompressible
and is reported as kind ``novel``. Spans of the fixed kinds always stay.

Left out: strings of fewer than 16 characters (the short last line of a key body
too), strings of letters or of digits only, strings broken by other characters
than those of base64 and identifiers, and strings without a sensitive word near.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, text_bytes

#: The kinds, in the order of ties, each with the group that must be long enough and its least length.
KINDS = (
    ("assign", re.compile("([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile("[0-9a-f]+"), 0, 24),
)
#: Texts without one of these, in lower case, hold no assignment.
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_LONG_HEX = re.compile("[0-9a-f]{24}")
NOVEL = "novel"
#: Words end at other characters, at the next capital of a camel-case name, and before the last capital of a run of them.
_SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
    r"(?i:(?:(?:secret|token|passw(?:or)?d|credential|auth(?:orization)?|bearer|private|access|api|key)s?)+)"
    r"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))[\s\S]{0,40}\Z",
    re.ASCII,
)
#: Strings that may be credentials: long, with letters and digits.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
#: Between strings of one body: an end of line, with indents and quotes.
_NEXT_LINE = re.compile(r"[\s\"'\\]*\n[\s\"'\\]*")
REACH, CONTEXT, LEAST_SHARE = 60, 200, 0.75
PIECE_OVER, PIECE, LEAST_WHOLE = 200, 64, 0.45

#: Primes the compressor: words and identifiers as they stand in code and configuration.
IDENTIFIERS = b"""
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1111111111 1234567890 9876543210
import export default function return const string number boolean null true false undefined class public private static void
https://www.example.com/index.html http://localhost:8080/api/v1/users application/json text/plain charset=utf-8 Content-Type
user_id username account client_id customer order_id product session request response timestamp created_at updated_at version
authorization_header access_level api_endpoint key_value_store private_network secret_name token_type password_field credential
2019-01-01T00:00:00Z 2020-12-31 2021 2022 2023 2024 2025 example-placeholder-value changeme xxxxxxxxxxxxxxxx your-token-here
"""


class Novelty:
    """Marginal compressed bytes of a candidate against identifiers and its surroundings."""

    def __init__(self, dictionary: bytes = IDENTIFIERS):
        settings = zstandard.ZstdCompressionParameters(
            window_log=14, chain_log=13, hash_log=13, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
            write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=settings)
        self.compress = zstandard.ZstdCompressor(dict_data=held, compression_params=settings).compress

    def share(self, before: str, candidate: str, after: str) -> float:
        """Compressed bytes that the candidate adds, as a share of its own."""
        around = f"{before}{after}".encode("utf-8", "replace")
        # no match starts in the last bytes of a block: the surroundings close it
        with_it = len(self.compress(around + candidate.encode() + b" 0123456789 0000000000"))
        without = len(self.compress(around + b" 0123456789 0000000000"))
        return (with_it - without) / len(candidate)

    def novel(self, before: str, candidate: str, after: str) -> bool:
        """Whether a candidate, or its pieces on average and the whole of it, costs enough."""
        if len(candidate) <= PIECE_OVER:
            return self.share(before, candidate, after) >= LEAST_SHARE
        if self.share(before, candidate, after) < LEAST_WHOLE:
            return False
        pieces = [candidate[i : i + PIECE] for i in range(0, len(candidate), PIECE)]
        return sum(self.share(before, p, after) * len(p) for p in pieces) >= LEAST_SHARE * len(candidate)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind's place, end) of the fixed kinds; leftmost, not overlapping within a kind."""
    spans = []
    low = text.lower()
    wanted = (any(w in low for w in _ASSIGN_WORDS), "AKIA" in text, _LONG_HEX.search(text) is not None)
    for place, ((_, pattern, group, least), look) in enumerate(zip(KINDS, wanted)):
        if look:
            spans += [(m.start(), place, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return sorted(spans)


def _has_mixed(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in ("key", "token", "secret", "passw", "credential", "auth", "bearer", "private", "access", "api"))


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int]]:
    """Incompressible strings in a sensitive context that meet no fixed span."""
    out = []
    if not _has_mixed(text):
        return out
    bodies: list[list[tuple[int, int]]] = []
    for m in _CANDIDATE.finditer(text):
        if bodies and bodies[-1][-1][1] == gap and _NEXT_LINE.fullmatch(text, gap, m.start()):
            bodies[-1].append(m.span())
        elif _SENSITIVE.search(text, max(0, m.start() - REACH), m.start()):
            bodies.append([m.span()])
        gap = m.end()
    for body in bodies:
        first, last = body[0][0], body[-1][1]
        before, after = text[max(0, first - CONTEXT) : first], text[last : last + CONTEXT]
        for start, end in body:
            if not any(a < end and start < b for a, _, b in taken) and novelty.novel(before, text[start:end], after):
                out.append((start, end))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, base and found, arrays of (kind, start, end) in code points, end exclusive.

    ``base`` holds the fixed kinds, ``found`` those and novel strings, by start
    and then kind. Null and empty texts have none. Texts are read whole; repeated
    rows are scanned each; extra columns are ignored.
    """
    span = "array<struct<kind:string,start:int,end:int>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for rows in batches:
            _, offsets = text_bytes(rows.column(1))
            for a, b in chunks(offsets, CHUNK_BYTES):
                base, found = [], []
                for text in rows.column(1).slice(a, b - a).to_pylist():
                    own = base_spans(text or "")
                    more = novel_spans(text or "", own, novelty)
                    base.append([{"kind": KINDS[k][0], "start": s, "end": e} for s, k, e in own])
                    every = sorted(own + [(s, len(KINDS), e) for s, e in more]) if more else own
                    found.append([{"kind": KINDS[k][0] if k < len(KINDS) else NOVEL, "start": s, "end": e} for s, k, e in every])
                yield pa.RecordBatch.from_arrays([rows.column(0).slice(a, b - a), pa.array(base, kind), pa.array(found, kind)], names=["doc_id", "base", "found"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"doc_id long, base {span}, found {span}")


def joined(spans: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def digest(spans: str):
    return F.sha2(F.encode(joined(spans), "UTF-8"), 256)


def spans_digest(text: str) -> str:
    """The digest of a text's fixed spans, for checks outside Spark."""
    return hashlib.sha256(",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in base_spans(text)).encode()).hexdigest()
