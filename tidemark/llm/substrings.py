"""Substring deduplication: seed and extend on winnowed anchors.

Every run of ``SEED_WORDS`` words is hashed. Each window of ``length`` words is
represented by its anchor, the run inside it with the smallest hash (the last
of equal ones), so equal windows share their anchor at the same place. Anchors
that occur in two documents or more are seeds. Around a seed a match is extended
to both sides as far as the windows anchored there agree: the windows' own
hashes, from another hash function, are compared among documents that share the
seed. A match is a window's two 64-bit hashes, 128 bits in all. Overlapping
matched windows join to maximal repeats.

Documents without seeds never send a window, and no pair of documents is formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, powers, run_hashes, stored, text_bytes, word_bounds, word_hashes

LENGTH = 50
SEED_WORDS = 26
_SEED_BASE, _WINDOW_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_PLACE = np.uint64((1 << 24) - 1)
#: Occurrences of a seed per part; seeds with more are split by window hash.
PART_ROWS = 20_000
#: Rows that a task remembers having read, so that equal ones are read once.
REMEMBERED_ROWS = 100_000


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    held, span = values, 1
    while span * 2 <= width:
        held = np.minimum(held[:-span], held[span:])
        span *= 2
    if span < width:
        held = np.minimum(held[: len(held) - (width - span)], held[width - span :])
    return held


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, seed_words: int = SEED_WORDS) -> tuple[np.ndarray, ...]:
    """(seed, row, first window, number of windows) of each anchor's run of windows; windows are numbered inside their row."""
    starts, ends, first = word_bounds(data, offsets)
    if len(starts) < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    seeds = run_hashes(word_hashes(data, starts, ends), seed_words, _SEED_BASE)
    place = np.arange(len(seeds), dtype=np.uint64) & _PLACE
    least = _sliding_min((seeds & ~_PLACE) | (_PLACE - place), length - seed_words + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    window = np.arange(len(least))
    inside = window + length <= first[row + 1]
    window, row, least = window[inside], row[inside], least[inside]
    if not len(window):
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    fresh = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (row[1:] != row[:-1])])
    count = np.diff(np.r_[fresh, len(window)])
    # the anchor's place: its low bits, counted from the window's start
    start = window[fresh].astype(np.uint64)
    anchor = (start + (((_PLACE - (least[fresh] & _PLACE)) - start) & _PLACE)).astype(np.int64)
    return seeds[anchor], row[fresh], window[fresh] - first[row[fresh]], count


def _find_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        data, offsets = text_bytes(rows.column(2))
        ids, prints = rows.column(0), rows.column(1)
        for a, b in chunks(offsets):
            seed, row, start, count = anchor_runs(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            at = pa.array(row + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seed.view(np.int64)), ids.take(at), prints.take(at), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["seed", "doc_id", "print", "start", "count"],
            )


def _window_hashes(data: np.ndarray) -> np.ndarray:
    starts, ends, _ = word_bounds(data, np.array([0, len(data)]))
    return run_hashes(word_hashes(data, starts, ends), LENGTH, _WINDOW_BASE)


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The window hashes at each shared seed of a document, split into parts where the seed is frequent.

    Rows with the same id and text have the same windows, so a task reads one of
    those it remembers; should another task read one too, the marks are the same.
    """
    read: set[tuple[int, int]] = set()
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        out: list[tuple] = []
        for i in np.flatnonzero(rows.column("runs").is_valid().to_numpy(zero_copy_only=False)).tolist():
            doc, mark = rows.column("doc_id")[i].as_py(), rows.column("print")[i].as_py()
            if (doc, mark) in read:
                continue
            if len(read) == REMEMBERED_ROWS:
                read.clear()
            read.add((doc, mark))
            hashes = _window_hashes(data[offsets[i] : offsets[i + 1]])
            runs = rows.column("runs")[i].values
            columns = [runs.field(k).to_numpy() for k in range(4)]
            for start, count, seed, many in zip(*(c.tolist() for c in columns)):
                own = hashes[start : start + count]
                parts = many // PART_ROWS + 1
                if parts == 1:
                    out.append((seed, 0, doc, mark, start, (1 << count) - 1, own.tobytes()))
                    continue
                part = own % np.uint64(parts)
                for p in np.unique(part).tolist():
                    mine = np.flatnonzero(part == p)
                    out.append((seed, p, doc, mark, start, int((1 << mine).sum()), own[mine].tobytes()))
            if len(out) > 20_000:
                yield _packed(out)
                out = []
        if out:
            yield _packed(out)


def _packed(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["seed", "part", "doc_id", "print", "start", "which", "windows"])


def _expand(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """One entry per window: row, seed, part, document, window hash and bit."""
    which = rows.column("which").to_numpy().astype(np.int64)
    bits = (which[:, None] >> np.arange(32)) & 1
    row, bit = np.nonzero(bits)
    column = rows.column("windows")
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return row, rows.column("seed").to_numpy()[row], rows.column("part").to_numpy()[row], rows.column("doc_id").to_numpy()[row], np.frombuffer(data.tobytes(), np.uint64), bit


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows that a smaller document has too. Rows come by seed, part and document; the first holder of a window is the smallest."""
    held: tuple | None = None  # windows of the seed at the end of the last batch, with their first document
    for rows in batches:
        if not rows.num_rows:
            continue
        row, seed, part, doc, window, bit = _expand(rows)
        before = 0
        if held is not None and held[0] == (seed[0], part[0]):
            before = len(held[1])
            seed, part = np.r_[np.full(before, seed[0]), seed], np.r_[np.full(before, part[0]), part]
            window, doc = np.r_[held[1], window], np.r_[held[2], doc]
            row, bit = np.r_[np.full(before, -1), row], np.r_[np.zeros(before, np.int64), bit]
        order = np.lexsort((doc, window, part, seed))
        s, p, w, d = seed[order], part[order], window[order], doc[order]
        fresh = np.r_[True, (s[1:] != s[:-1]) | (w[1:] != w[:-1]) | (p[1:] != p[:-1])]
        owner = d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        tail = fresh & (s == seed[-1]) & (p == part[-1])
        held = ((seed[-1], part[-1]), w[tail], d[tail])
        repeated = order[(d > owner) & (order >= before)]
        if len(repeated):
            mask = np.zeros(rows.num_rows, np.int64)
            np.bitwise_or.at(mask, row[repeated], np.int64(1) << bit[repeated])
            found = np.flatnonzero(mask)
            at = pa.array(found)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(at), rows.column("print").take(at), rows.column("start").take(at), pa.array(mask[found].astype(np.int32))], names=["doc_id", "print", "start", "mask"])


def _covered(n: int, marks: list[dict] | None) -> np.ndarray:
    """Which of n words lie in a repeated window."""
    edge = np.zeros(n + LENGTH + 1, np.int64)
    if marks:
        start = np.array([m["start"] for m in marks])
        row, bit = np.nonzero((np.array([m["mask"] for m in marks])[:, None] >> np.arange(32)) & 1)
        windows = np.unique(start[row] + bit)
        np.add.at(edge, windows, 1)
        np.add.at(edge, windows + LENGTH, -1)
    return np.cumsum(edge)[:n] > 0


def _cut(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            data, offsets = text_bytes(rows.column("text"))
            raw = data.tobytes()
            out = []
            for i, marks in enumerate(rows.column("marks").to_pylist()):
                words = raw[offsets[i] : offsets[i + 1]].split()
                gone = _covered(len(words), marks) if marks else None
                kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g])
                spans = [] if gone is None else np.flatnonzero(np.diff(np.r_[0, gone, 0])).reshape(-1, 2).tolist()
                out.append((len(words), 0 if gone is None else int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], *((kept.decode(),) if texts else ())))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
            names = ["n_words", "n_removed", "kept_sha256", "spans", "kept"]
            columns = list(zip(*out)) if out else [()] * (4 + texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names[: len(columns)]])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (removed word ranges) and, with ``texts``, kept.

    A word goes if a window of 50 words over it also starts in a document with
    a smaller id. Null and empty texts have no words. Rows without an id keep
    all words and take none from others; rows that share an id are each judged
    against smaller ids only. Extra columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("print"), F.coalesce(text, F.lit("")).alias("text"))
    seeds = stored(source.where("doc_id is not null").mapInArrow(_find_seeds, "seed long, doc_id long, print long, start int, count int"))
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("many")).where("least < most").select("seed", "many")
    runs = seeds.join(shared, "seed").groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "count", "seed", "many")).alias("runs"))
    # a left join here as below, so that both read one exchange of the texts
    windows = source.join(runs, ["doc_id", "print"], "left").select("doc_id", "print", "text", "runs").mapInArrow(_extend, "seed long, part int, doc_id long, print long, start int, which int, windows binary")
    marks = windows.repartition("seed", "part").sortWithinPartitions("seed", "part", "doc_id").mapInArrow(_compare, "doc_id long, print long, start int, mask int")
    marks = marks.groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "mask")).alias("marks"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + (", kept string" if texts else "")
    return source.join(marks, ["doc_id", "print"], "left").select("doc_id", "text", "marks").mapInArrow(_cut(texts), schema)
