"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions. Each decision has a context tree: its node at
depth d is reached by the d bytes before, and holds how often the decision went
either way there. A node's Krichevsky-Trofimov estimate and the product of its
children's weighted probabilities are averaged with weight one half each, from
the leaves up; that mixes all depths. A text's probability is the product of
its decisions, up to an end mark, with the weights that training left behind.
Where training never saw a longer context, the longest one it saw decides.

Counts, trees and scores run as Spark jobs over whole texts:

1. every task counts its byte runs and words; equal ones meet by bucket. A
   bucket holds whole subtrees: runs that agree in the two bytes before.
2. buckets weigh their subtrees; the two top levels (256 contexts) are summed
   over all buckets and weighed on the driver.
3. buckets turn each run of bytes that occurs anywhere into a log probability.
4. documents look up their runs. The table is broadcast if it has at most
   ``BROADCAST_ROWS`` rows. Beyond that documents are dealt, compressed, into
   blocks of about ``BLOCK_BYTES``; a block asks once for each run and word in
   it, cells of the table answer, and blocks score with the answers. So the
   disk holds a compressed copy of the texts and each block's distinct runs,
   not a row per document and run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, mix, stored, text_bytes, word_bounds, word_hashes

DEPTH = 5
HELD_OUT = (7, 2)
#: Rows of a lookup table that are broadcast at most: 16 bytes each.
BROADCAST_ROWS = 8_000_000
#: Entries that a task holds before it merges them.
HELD_ENTRIES = 1_500_000
#: Bytes of text, with ``ROW_BYTES`` for each row, that share one look-up where the table is not broadcast.
BLOCK_BYTES = 64 << 20
ROW_BYTES = 64
_END = 0xFF  # never a byte of UTF-8: ends a text and fills the context before it


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def byte_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte and end mark: the bytes before it, latest first, then itself, as a number; and its row."""
    n, lengths = len(offsets) - 1, np.diff(offsets)
    row = np.repeat(np.arange(n), lengths)
    whole = np.full(len(data) + n * (DEPTH + 1), _END, np.uint64)
    whole[np.arange(len(data)) + DEPTH * (row + 1) + row] = data
    key = np.zeros(len(whole) - DEPTH, np.uint64)
    for back in range(1, DEPTH + 1):
        key = (key << np.uint64(8)) | whole[DEPTH - back : len(whole) - back]
    key = (key << np.uint64(8)) | whole[DEPTH:]
    first = offsets[:-1] + (DEPTH + 1) * np.arange(n)  # of each row, in key
    owner = np.repeat(np.arange(n), lengths + 1)
    return key[np.arange(len(owner)) - np.repeat(offsets[:-1] + np.arange(n), lengths + 1) + np.repeat(first, lengths + 1)], owner


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[fresh], np.add.reduceat(count, fresh) if len(fresh) else count


class _Counter:
    def __init__(self):
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray, counted: bool) -> None:
        key, count = np.unique(keys, return_counts=True)
        self.keys.append(key)
        self.counts.append(count if counted else np.zeros(len(key), np.int64))
        self.held += len(key)
        if self.held > HELD_ENTRIES:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.keys:
            key, count = _merge(self.keys, self.counts)
            self.keys, self.counts, self.held = [key], [count], 0
            return key, count
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)


_PACKED = "kind int, bucket int, keys binary, counts binary"
_PACKED_NAMES = ["kind", "bucket", "keys", "counts"]
_WORDS, _RUNS = 0, 1


def _bucket(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    top = keys if kind == _WORDS else keys >> np.uint64(8 * (DEPTH - 1))  # runs: the two bytes before
    return (mix(top) % np.uint64(buckets)).astype(np.int32)


def _count(buckets: int):
    """Counts of words (training rows) and byte runs (all rows, counted in training rows) of a partition, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {_WORDS: _Counter(), _RUNS: _Counter()}
        for rows in batches:
            data, offsets = text_bytes(rows.column("text"))
            held_out = rows.column("held_out").to_numpy(zero_copy_only=False)
            for a, b in chunks(offsets, CHUNK_BYTES):
                part, bounds, train = lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a], ~held_out[a:b]
                runs, owner = byte_runs(part, bounds)
                known = train[owner]
                held[_RUNS].add(runs[known], True)
                held[_RUNS].add(runs[~known], False)
                starts, ends, first = word_bounds(part, bounds)
                own = np.repeat(train, np.diff(first))
                held[_WORDS].add(word_hashes(part, starts, ends)[own], True)
        for kind, counter in held.items():
            keys, counts = counter.total()
            bucket = _bucket(kind, keys, buckets)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for i in np.flatnonzero(np.diff(bounds)).tolist():
                at = order[bounds[i] : bounds[i + 1]]
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([i], pa.int32()), pa.array([keys[at].tobytes()]), pa.array([counts[at].astype(np.int64).tobytes()])], names=_PACKED_NAMES)

    return run


def _unpack(rows: pa.Table, names: tuple[str, str] = ("keys", "counts")) -> tuple[np.ndarray, np.ndarray]:
    return _merge([np.frombuffer(x.as_py(), np.uint64) for x in rows[names[0]]], [np.frombuffer(x.as_py(), np.int64) for x in rows[names[1]]])


def _join(rows: pa.Table) -> pa.Table:
    keys, counts = _unpack(rows)
    return pa.table([rows["kind"][:1], rows["bucket"][:1], [keys.tobytes()], [counts.tobytes()]], names=_PACKED_NAMES)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x >= 0.5: Stirling's series after eight steps up."""
    steps = np.zeros_like(x)
    for k in range(8):
        steps += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - steps


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


class _Level:
    """The nodes at one depth for each of the eight decisions, and where each run of bytes passes."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        context = keys >> np.uint64(8 * (DEPTH - depth) + 8)
        own, self.place = np.unique((context << np.uint64(8)) | (keys & np.uint64(0xFF)), return_inverse=True)
        total = np.bincount(self.place, counts, len(own))
        self.node, self.zeros, self.ones, self.example = [], [], [], []
        for k in range(8):
            name = own >> np.uint64(8 - k)
            fresh = np.r_[True, name[1:] != name[:-1]]
            node = np.cumsum(fresh) - 1
            bit = ((own >> np.uint64(7 - k)) & np.uint64(1)).astype(bool)
            self.node.append(node)
            self.ones.append(np.bincount(node, total * bit, node[-1] + 1))
            self.zeros.append(np.bincount(node, total * ~bit, node[-1] + 1))
        # one run of bytes per key, to find a node's parent
        self.some = np.zeros(len(own), np.int64)
        self.some[self.place] = np.arange(len(keys))

    def through(self, k: int) -> np.ndarray:
        return self.node[k][self.place]


def _weigh(keys: np.ndarray, counts: np.ndarray, least: int):
    """Levels from ``least`` to DEPTH with, per decision, each node's log weighted probability and its own estimate's weight."""
    levels = {d: _Level(keys, counts, d) for d in range(least, DEPTH + 1)}
    weighted, stay = {}, {}
    for d in range(DEPTH, least - 1, -1):
        level = levels[d]
        for k in range(8):
            own = log_kt(level.zeros[k], level.ones[k])
            if d == DEPTH:
                weighted[d, k], stay[d, k] = own, np.ones(len(own))
                continue
            below = levels[d + 1]
            first = np.flatnonzero(np.r_[True, below.node[k][1:] != below.node[k][:-1]])
            parent = level.through(k)[below.some[first]]
            children = np.bincount(parent, weighted[d + 1, k], len(own))
            weighted[d, k] = np.logaddexp(own, children) - np.log(2)
            stay[d, k] = np.exp(own - np.log(2) - weighted[d, k])
    return levels, weighted, stay


def _decision(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The decision's number (1 to 255) and its outcome in each run."""
    byte = (keys & np.uint64(0xFF)).astype(np.int64)
    return (1 << k) | (byte >> (8 - k)), (byte >> (7 - k)) & 1


def _top_rows(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """What a bucket adds to the nodes with one byte of context."""
    keys, counts = _unpack(rows)
    levels, weighted, _ = _weigh(keys, counts, 2)
    level, out = levels[2], []
    for k in range(8):
        first = np.flatnonzero(np.r_[True, level.node[k][1:] != level.node[k][:-1]])
        example = keys[level.some[first]]
        number, _ = _decision(example, k)
        before = (example >> np.uint64(8 * DEPTH)).astype(np.int64)
        out.append(np.c_[before, number, level.zeros[k], level.ones[k], weighted[2, k]])
    flat = np.concatenate(out)
    spot, where = np.unique(flat[:, 0].astype(np.int64) * 256 + flat[:, 1].astype(np.int64), return_inverse=True)
    sums = [np.bincount(where, flat[:, c], len(spot)) for c in (2, 3, 4)]
    return pa.table([spot // 256, spot % 256, *sums], names=["before", "number", "zeros", "ones", "weighted"])


def _top(rows) -> np.ndarray:
    """For each byte before and decision: counts and own weight with one byte of context, then with none."""
    table = np.zeros((256, 256, 6))  # zeros, ones, stay at depth 1; zeros, ones, stay at depth 0
    below = np.zeros((256, 256))
    for r in rows:
        table[r["before"], r["number"], :2] = r["zeros"], r["ones"]
        below[r["before"], r["number"]] = r["weighted"]
    own = log_kt(table[..., 0], table[..., 1])
    joint = np.logaddexp(own, below) - np.log(2)
    table[..., 2] = np.exp(own - np.log(2) - joint)
    zeros, ones = table[..., 0].sum(0), table[..., 1].sum(0)
    own = log_kt(zeros, ones)
    table[..., 3], table[..., 4] = zeros, ones
    table[..., 5] = np.exp(own - np.log(2) - (np.logaddexp(own, joint.sum(0)) - np.log(2)))
    return table


def _estimate(zeros: np.ndarray, ones: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (np.where(bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)


def _log_probabilities(keys: np.ndarray, counts: np.ndarray, top: np.ndarray) -> np.ndarray:
    """log10 of the probability of each run's last byte after the others."""
    levels, _, stay = _weigh(keys, counts, 2)
    before = (keys >> np.uint64(8 * DEPTH)).astype(np.int64)
    total = np.zeros(len(keys))
    for k in range(8):
        number, bit = _decision(keys, k)
        p, seen = np.zeros(len(keys)), np.zeros(len(keys), bool)
        for d in range(DEPTH, 1, -1):
            node = levels[d].through(k)
            zeros, ones, weight = levels[d].zeros[k][node], levels[d].ones[k][node], stay[d, k][node]
            own = _estimate(zeros, ones, bit)
            p = np.where(seen, weight * own + (1 - weight) * p, own)
            seen = zeros + ones > 0
        for at in (0, 3):
            zeros, ones, weight = (top[before, number, at + i] for i in range(3))
            own = _estimate(zeros, ones, bit)
            p = np.where(seen, weight * own + (1 - weight) * p, own)
            seen = zeros + ones > 0
        total += np.log10(p)
    return total


class Model:
    """Tables of a trained model: word counts and log probabilities of byte runs, as packed DataFrames, and totals."""

    def __init__(self, packed: DataFrame, runs: DataFrame, train_texts: int, train_tokens: int, vocabulary: int):
        self.packed, self.runs = packed, runs
        self.train_texts, self.train_tokens, self.vocabulary = train_texts, train_tokens, vocabulary


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        size = [(len(k.as_py()) // 8, int(np.frombuffer(c.as_py(), np.int64).sum())) for k, c in zip(rows.column("keys"), rows.column("counts"))]
        yield pa.RecordBatch.from_arrays([rows.column("kind"), pa.array([s for s, _ in size], pa.int64()), pa.array([c for _, c in size], pa.int64())], names=["kind", "rows", "total"])


def prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text (null as empty) and held_out; rows without an id train."""
    number, remainder = HELD_OUT
    name = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), (F.crc32(F.encode(name, "UTF-8")) % number == remainder).alias("held_out"))


def train(rows: DataFrame) -> Model:
    """Count and weigh. ``rows``: text and held_out; byte runs of held-out rows get probabilities but no counts."""
    spark = rows.sparkSession
    buckets = max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    counted = rows.select("text", "held_out").mapInArrow(_count(buckets), _PACKED)

    def join(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _join(table)

    packed = stored(counted.groupBy("kind", "bucket").applyInArrow(join, _PACKED))
    totals = {r["kind"]: r for r in packed.mapInArrow(_sizes, "kind int, rows long, total long").groupBy("kind").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total")).collect()}
    texts = rows.where(~F.col("held_out")).count()
    words = totals.get(_WORDS)
    runs = packed.where(F.col("kind") == _RUNS)
    parts = runs.groupBy("bucket").applyInArrow(_top_rows, "before long, number long, zeros double, ones double, weighted double")
    top = spark.sparkContext.broadcast(_top(parts.groupBy("before", "number").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "weighted")]).collect()))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                keys = np.frombuffer(keys.as_py(), np.uint64)
                values = _log_probabilities(keys, np.frombuffer(counts.as_py(), np.int64), top.value)
                yield pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([values.tobytes()])], names=["keys", "values"])

    tables = stored(runs.mapInArrow(weigh, "keys binary, values binary"))
    model = Model(packed, tables, texts, (words["total"] if words else 0) + texts, (words["rows"] if words else 0) + (texts > 0))
    model.word_rows = words["rows"] if words else 0
    model.run_rows = totals[_RUNS]["rows"] if _RUNS in totals else 0
    return model


def _sorted_table(frame: DataFrame, kind) -> tuple[np.ndarray, np.ndarray]:
    table = frame.toArrow()
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table[0]] or [np.zeros(0, np.uint64)])
    values = np.concatenate([np.frombuffer(x.as_py(), kind) for x in table[1]] or [np.zeros(0, kind)])
    order = np.argsort(keys)
    return keys[order], values[order]


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    if not len(table[0]):
        return np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return np.where(table[0][at] == keys, table[1][at], 0)


def _features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, key, row, count) of the words and byte runs of some rows, each key once per row."""
    part = lower_ascii(data)
    starts, ends, first = word_bounds(part, bounds)
    for kind, keys, owner in ((_WORDS, word_hashes(part, starts, ends), np.repeat(np.arange(len(bounds) - 1), np.diff(first))), (_RUNS, *byte_runs(part, bounds))):
        if kind == _RUNS:  # 48 bits of key and 16 of row sort as one number
            both, count = np.unique((keys << np.uint64(16)) | owner.astype(np.uint64), return_counts=True)
            yield kind, both >> np.uint64(16), (both & np.uint64(0xFFFF)).astype(np.int64), count
        else:
            order = np.argsort(keys, kind="stable")
            yield kind, keys[order], owner[order], np.ones(len(keys), np.int64)


def _fresh(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of sorted keys, and each entry's place among them."""
    fresh = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return keys[fresh], np.cumsum(fresh) - 1


def _small_chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in chunks(offsets, CHUNK_BYTES):
        for first in range(a, b, 0xFFFF):
            yield first, min(first + 0xFFFF, b)


_SCORED = "doc_id long, held_out boolean, bytes long, n_tokens long, n_known long, base_score double, score double"
_SCORED_NAMES = ["doc_id", "held_out", "bytes", "n_tokens", "n_known", "base_score", "score"]


def _scores(rows: pa.RecordBatch, words: tuple[np.ndarray, np.ndarray], runs: tuple[np.ndarray, np.ndarray], scale: float, end: tuple[float, int]) -> Iterator[pa.RecordBatch]:
    """``_SCORED`` of some rows; the tables hold at least the rows' words and byte runs that the model has."""
    data, offsets = text_bytes(rows.column("text"))
    for a, b in _small_chunks(offsets):
        bounds = offsets[a : b + 1] - offsets[a]
        out = {}
        for kind, keys, row, count in _features(data[offsets[a] : offsets[b]], bounds):
            distinct, place = _fresh(keys)
            value = _find(words if kind == _WORDS else runs, distinct)[place]
            if kind == _WORDS:
                out["n"] = np.bincount(row, minlength=b - a) + 1
                out["known"] = np.bincount(row, value > 0, b - a).astype(np.int64) + end[1]
                out["base"] = np.bincount(row, np.log10(value + 1) - scale, b - a) + end[0]
            else:
                out["score"] = np.bincount(row, value * count, b - a)
        part = rows.slice(a, b - a)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(np.diff(bounds)), *map(pa.array, (out["n"], out["known"], out["base"], out["score"]))], names=_SCORED_NAMES)


def score(docs: DataFrame, model: Model, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``prepared`` rows without text, with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte."""
    spark = docs.sparkSession
    scale = float(np.log10(model.train_tokens + model.vocabulary + 1))
    end = (float(np.log10(model.train_texts + 1)) - scale, int(model.train_texts > 0))
    if max(model.word_rows, model.run_rows) <= broadcast_rows:
        words = spark.sparkContext.broadcast(_sorted_table(model.packed.where(F.col("kind") == _WORDS).select("keys", "counts"), np.int64))
        runs = spark.sparkContext.broadcast(_sorted_table(model.runs, np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                yield from _scores(rows, words.value, runs.value, scale, end)

        scored = docs.mapInArrow(run, _SCORED)
    else:
        scored = _score_in_blocks(docs, model, scale, end)
    return scored.withColumn("train_tokens", F.lit(model.train_tokens).cast("bigint")).withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.greatest(F.col("bytes"), F.lit(1)))


def _shrunk(numbers: np.ndarray) -> bytes:
    """Numbers of 64 bits, byte by byte of the numbers and compressed: near ones share their upper bytes."""
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _grown(packed: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, "zstd", asbytes=True) if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(kind)


def _shrunk_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as steps from one to the next."""
    return _shrunk(np.diff(keys, prepend=np.uint64(0)))


def _grown_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_grown(packed, np.uint64), dtype=np.uint64)


class _Distinct:
    """Distinct keys, merged when half as many again are held as the last merge left."""

    def __init__(self):
        self.keys, self.held, self.most = [], 0, HELD_ENTRIES

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(np.unique(keys))
        self.held += len(self.keys[-1])
        if self.held > self.most:
            self.total()

    def total(self) -> np.ndarray:
        key = np.concatenate(self.keys or [np.zeros(0, np.uint64)])
        self.keys = []
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key
        self.keys, self.held, self.most = [key], len(key), max(HELD_ENTRIES, len(key) * 3 // 2)
        return key


def _dealt(kind: int, keys: np.ndarray, cells: int) -> Iterator[tuple[int, np.ndarray]]:
    """Cells and the places of their sorted ``keys``. Runs that agree in the four bytes before share a cell, so no cell is hot."""
    cell = mix(keys if kind == _WORDS else keys >> np.uint64(8 * (DEPTH - 3))) % np.uint64(cells)
    order = np.argsort(cell, kind="stable")
    bounds = np.searchsorted(cell[order], np.arange(cells + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        yield i, order[bounds[i] : bounds[i + 1]]


def _table_cells(kind: int, of: type, cells: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packed keys and values of a model's table, dealt by cell."""

    def rows(keys: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, value = np.concatenate(keys), np.concatenate(values)
        order = np.argsort(key)
        key, value = key[order], value[order].astype(np.float64)
        for i, at in _dealt(kind, key, cells):
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([i], pa.int32()), pa.array([_shrunk_keys(key[at])]), pa.array([_shrunk(value[at])])], names=["kind", "cell", "keys", "values"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values, held = [], [], 0
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                keys.append(np.frombuffer(key.as_py(), np.uint64))
                values.append(np.frombuffer(value.as_py(), of))
                held += len(keys[-1])
                if held > HELD_ENTRIES:
                    yield from rows(keys, values)
                    keys, values, held = [], [], 0
        if keys:
            yield from rows(keys, values)

    return run


def _answers(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys, sorted, and values of packed rows."""
    keys = np.concatenate([_grown_keys(x.as_py()) for x in rows["keys"]] or [np.zeros(0, np.uint64)])
    values = np.concatenate([_grown(x.as_py(), np.float64) for x in rows["values"]] or [np.zeros(0)])
    order = np.argsort(keys)
    return keys[order], values[order]


def _pieces(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows that a block's pieces hold."""
    for piece in rows["piece"]:
        yield from pa.ipc.open_stream(piece.as_buffer())


def _score_in_blocks(docs: DataFrame, model: Model, scale: float, end: tuple[float, int]) -> DataFrame:
    """The same sums where the tables are too large to broadcast: blocks of documents ask cells of the tables."""
    weight = docs.agg(F.sum(F.octet_length("text").cast("bigint") + ROW_BYTES)).first()[0] or 0
    blocks = max(1, -(-weight // BLOCK_BYTES))
    cells = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seed = 0, TaskContext.get().partitionId() << 32
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for rows in batches:
            _, offsets = text_bytes(rows.column("text"))
            for a, b in chunks(offsets + ROW_BYTES * np.arange(len(offsets)), CHUNK_BYTES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=options) as stream:
                    stream.write_batch(rows.slice(a, b - a))
                block = int(mix(np.array([seed + number], np.uint64))[0] % np.uint64(blocks))
                number += 1
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "piece"])

    def ask(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        held = {_WORDS: _Distinct(), _RUNS: _Distinct()}
        for piece in _pieces(rows):
            data, offsets = text_bytes(piece.column("text"))
            for a, b in chunks(offsets, CHUNK_BYTES):
                part, bounds = lower_ascii(data[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
                starts, ends, _ = word_bounds(part, bounds)
                held[_WORDS].add(word_hashes(part, starts, ends))
                held[_RUNS].add(byte_runs(part, bounds)[0])
        asked = [(kind, i, _shrunk_keys(keys[at])) for kind, keys in ((k, c.total()) for k, c in held.items()) for i, at in _dealt(kind, keys, cells)]
        return pa.table([pa.array([key[0].as_py()] * len(asked), pa.int64()), pa.array([x[0] for x in asked], pa.int32()), pa.array([x[1] for x in asked], pa.int32()), pa.array([x[2] for x in asked], pa.binary())], names=["block", "kind", "cell", "keys"])

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        held = _answers(table)
        values = [_shrunk(_find(held, _grown_keys(x.as_py())).astype(np.float64)) for x in asked["keys"]]
        return pa.table([asked["block"], asked["kind"], asked["keys"], pa.array(values, pa.binary())], names=["block", "kind", "keys", "values"])

    def finish(rows: pa.Table, answers: pa.Table) -> pa.Table:
        words, runs = (_answers(answers.filter(pc.equal(answers["kind"], kind))) for kind in (_WORDS, _RUNS))
        return pa.Table.from_batches([x for piece in _pieces(rows) for x in _scores(piece, words, runs, scale, end)])

    # both uses of ``dealt`` read one exchange
    dealt = docs.select("doc_id", "held_out", "text").mapInArrow(pack, "block long, piece binary").groupBy("block")
    shape = "kind int, cell int, keys binary, values binary"
    words = model.packed.where(F.col("kind") == _WORDS).select("keys", "counts").mapInArrow(_table_cells(_WORDS, np.int64, cells), shape)
    runs = model.runs.mapInArrow(_table_cells(_RUNS, np.float64, cells), shape)
    asked = dealt.applyInArrow(ask, "block long, kind int, cell int, keys binary").groupBy("kind", "cell")
    answers = asked.cogroup(words.unionByName(runs).groupBy("kind", "cell")).applyInArrow(answer, "block long, kind int, keys binary, values binary")
    return dealt.cogroup(answers.groupBy("block")).applyInArrow(finish, _SCORED)


def context_tree_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Train on the rows that are not held out and score all: one row per document.

    doc_id, held_out, bytes, n_tokens, n_known, base_score (add-one word model),
    score (log10 probability of the lower-cased text with its end), train_tokens
    and bits_per_byte. Null and empty texts hold the end only. Repeated rows
    count and are scored each. Without training rows every byte costs 8 bits.
    Extra columns are ignored; an empty table gives no rows.
    """
    rows = prepared(docs, id_col, text_col)
    return score(rows, train(rows), broadcast_rows)
