"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text. The toxic one holds the
strings that toxic documents share and ordinary ones lack, most frequent last;
the ordinary one, of the same size, ordinary words like those, and frequent ones. Each
distinct word of a text is a window, compressed with either dictionary; its gain
is the ordinary length less the toxic length. Both dictionaries end in one fixed string that also stands around
every window, so that a compressed block's fixed cost is always paid and single
matches show. A logistic curve over the text's gains, fitted on labelled rows
that did not train the dictionaries, is the calibrated threshold.

The fit uses at most ``SAMPLE_TOXIC`` and ``SAMPLE_ORDINARY`` labelled rows of
up to ``SAMPLE_BYTES`` bytes, chosen by a hash of the id. Scores read whole
texts and nothing but texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, giving_back, text_bytes

FOLDS = 5
SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_BYTES = 1500, 6000, 20_000
DICTIONARY_BYTES = 4096
GRAM = 5
#: Least gains and most bytes above the shortest toxic length that make a window count.
CLEAR = ((2, 2), (3, 3), (4, 3), (5, 4), (6, 8))
#: Stands around every window and ends both dictionaries; any string that texts do not hold would do.
BALLAST = b"~^|<{[@#0Qz9}_]>=Xk7%;+Vj6&$`Wq5*:Yp4Jb3Kx2ZgH1"


def _window(string: bytes) -> bytes:
    return BALLAST[:24] + string + BALLAST[24:]


def _grams(word: bytes) -> list[bytes]:
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def _ranked(counts: Counter) -> list[tuple[bytes, int]]:
    """Most frequent first; ties by bytes, so that a fit repeats exactly."""
    return sorted(counts.items(), key=lambda x: (-x[1], x[0]))


def _words(text: str) -> set[bytes]:
    return {b" %b " % w.encode("utf-8", "replace") for w in text.lower().split()}


def contrast(toxic: list[str], ordinary: list[str]) -> tuple[list[bytes], list[bytes]]:
    """Training strings of both kinds, most telling first.

    Toxic: parts of words, or else whole words, with the space around, that are
    at least 20 times as frequent in toxic texts. Ordinary: words that share a
    5-gram with those, then the most frequent ones.
    """
    there, elsewhere, bags = Counter(), Counter(), [_words(text) for text in toxic]
    for bag in bags:
        there.update({g for w in bag for g in _grams(w[:-1])} | bag)
    other: Counter = Counter()
    for text in ordinary:
        bag = _words(text)
        other.update(bag)
        elsewhere.update({g for w in bag for g in _grams(w[:-1])})
    elsewhere += other
    least = max(3, 0.01 * len(toxic))
    telling = {g for g, n in there.items() if n >= least and n / len(toxic) > 20 * (elsewhere[g] + 0.5) / max(1, len(ordinary))}
    found: Counter = Counter()
    for bag in bags:
        for word in bag:
            at, n = 0, len(word) - GRAM
            while at < n:
                end = at
                while end < n and word[end : end + GRAM] in telling:
                    end += 1
                if end > at:
                    found[word[at : end - 1 + GRAM]] += 1
                at = end + 1
    strings: list[bytes] = []
    for string, count in _ranked(found):
        if count >= least and not any(string in k or k in string for k in strings):
            strings.append(string)
    whole = [w for w in telling if w[-1:] == b" " and w[:1] == b" " and len(w) > GRAM and not any(k in w for k in strings)]
    strings += sorted(whole, key=lambda w: (-there[w], w))
    shared = {g for w in whole for g in _grams(w)}
    near = Counter({w: n for w, n in other.items() if any(g in shared for g in _grams(w)) and w not in telling})
    return strings, [w for w, _ in _ranked(near)[:2000]] + [w for w, _ in _ranked(other)[:2000]]


def _dictionary(parts: list[bytes], separator: bytes, size: int) -> bytes:
    held, used = [], 0
    for part in parts:
        if used + len(part) + 1 > size:
            break
        held.append(part)
        used += len(part) + 1
    return separator.join(reversed(held)).rjust(size, b"\n")


class Classifier:
    def __init__(self, toxic: bytes, ordinary: bytes, weights: np.ndarray | None = None, shortest: int = 0):
        self.contents, self.weights, self.shortest = (ordinary, toxic), weights, shortest
        self._compressors = None

    def __reduce__(self):
        return Classifier, (self.contents[1], self.contents[0], self.weights, self.shortest)

    def _lengths(self, windows: list[bytes]) -> Iterator[np.ndarray]:
        if self._compressors is None:
            self._compressors = []
            for content in self.contents:
                settings = zstandard.ZstdCompressionParameters(
                    window_log=14, chain_log=12, hash_log=12, search_log=5, min_match=GRAM, target_length=256, strategy=zstandard.STRATEGY_LAZY2,
                    write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
                )
                held = zstandard.ZstdCompressionDict(content + BALLAST, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=settings)
                self._compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=settings))
        for compressor in self._compressors:
            packed = compressor.multi_compress_to_buffer(windows)
            yield np.fromiter((len(packed[i]) for i in range(len(packed))), np.int64, len(packed))

    def rest(self) -> None:
        """Drop the compressors; they are made again when next needed."""
        self._compressors = None

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Per text: a constant, the largest gain, numbers of windows by gain and toxic length, and the number of windows, scaled."""
        place: dict[str, int] = {}
        owner, windows = [], []
        for i, text in enumerate(texts):
            found = [place.setdefault(w, len(place)) for w in dict.fromkeys((text or "").lower().split())]
            windows += found
            owner += [i] * len(found)
        out = np.zeros((len(texts), 3 + len(CLEAR)))
        out[:, 0] = 1
        if windows:
            ordinary, toxic = self._lengths([_window(f" {w} ".encode("utf-8", "replace")) for w in place])
            at, owner = np.array(windows), np.array(owner)
            toxic, gain = toxic[at], (ordinary - toxic)[at]
            counts = np.bincount(owner, minlength=len(texts))
            most = np.zeros(len(texts))
            np.maximum.at(most, owner, np.where(toxic <= self.shortest + 6, gain, 0))
            out[:, 1] = np.minimum(most, 8) / 8
            for i, (least, left) in enumerate(CLEAR):
                out[:, 2 + i] = np.log1p(np.bincount(owner, (gain >= least) & (toxic <= self.shortest + left), len(texts)))
            out[:, -1] = np.log1p(counts) / 8
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.weights, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(rows: list[tuple[int, str, int]]) -> Classifier:
    """A classifier from (id, text, toxic). Every other row of a class trains the dictionaries, the rest the curve."""
    rows = sorted(rows, key=lambda r: (r[2], r[0], r[1]))
    train, rest = rows[::2], rows[1::2]
    toxic, ordinary = [t for _, t, x in train if x], [t for _, t, x in train if not x]
    if not toxic or not ordinary or len({x for _, _, x in rest}) < 2:
        return Classifier(b"", b"")
    strings, plain = contrast(toxic, ordinary)
    if not strings:
        return Classifier(b"", b"")
    size = min(DICTIONARY_BYTES, sum(len(s) + 1 for s in strings) + 1)
    made = Classifier(_dictionary(strings, b"\n", size), _dictionary(plain, b"\n", size))
    made.shortest = int(min((n for n in list(made._lengths([_window(s) for s in strings]))[1]), default=0))
    made.weights = _logistic(made.features([t for _, t, _ in rest]), np.array([x for _, _, x in rest], float))
    return made


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[int, str, int]]:
    """The bounded sample: rows of training folds with a label, first by hash of the id."""
    named = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    named = named.where(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % FOLDS != 0)
    picked = [named.where(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for x, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_ORDINARY))]
    texts = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    chosen = texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return [(r["doc_id"], r["text"], r["toxic"]) for r in chosen.toLocalIterator()]


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` in struct ``row``, with held_out, score (0 to 1) and predicted (score at least 0.5).

    Null and empty texts have no windows and get the curve's value there. A row
    without an id is not held out. Without labels of both kinds, or strings that
    tell them apart, every score is 0. Repeated rows are scored alike; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(training_rows(docs, labels, id_col, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            column = rows.column(rows.schema.get_field_index("_text"))
            _, offsets = text_bytes(column)
            for a, b in chunks(offsets, CHUNK_BYTES // 2):
                part = rows.slice(a, b - a)
                scores = model.value.scores(column.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=["row", "held_out", "score", "predicted"])
        model.value.rest()

    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("x"))
    held_out = (F.col(f"`{id_col}`").isNotNull() & (F.crc32(F.encode(name, "UTF-8")) % FOLDS == 0)).alias("held_out")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("_text"), held_out)
    kind = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(giving_back(run), f"row {kind}, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return score(docs, labels, id_col, text_col).where("predicted = 0").select("row.*")
