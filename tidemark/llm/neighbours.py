"""N-gram Jaccard self-join with Bayesian pruning of candidates.

A text is its set of five-word shingles; texts with one set form a class of
copies, and only classes are compared. Classes that agree on one of ``BANDS``
bands of ``ROWS`` MinHash values are candidates: a pair with similarity 0.8 is
missed with probability (1 - 0.8^5)^32 = 3e-6.

Candidates meet in blocks. A class belongs to the cell of the smallest class
reached over its bands, and large cells are split, so every candidate pair lies
in one pair of blocks that share a band. Inside a pair of blocks MinHash values
are compared 16 at a time; a pair is dropped once the posterior probability of a
similarity of ``threshold`` falls below ``TOLERANCE``. The rest is verified on
the shingle sets. A pair of blocks hands on counts of links and a spanning
forest of them, never the pairs. Connected classes form a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, giving_back, mix, powers, run_hashes, small_side, stored, text_bytes, word_bounds, word_hashes

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK = 2048
TILE = 256
#: Candidate classes that are broadcast to the texts at most; beyond it they meet by shuffle.
SMALL_MEMBERS = 1_000_000
_BASE = 0xC2B2AE3D27D4EB4F
_FACTORS = (np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 32, (HASHES, 2), dtype=np.uint32)) | np.array([1, 0], np.uint32)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and the n + 1 bounds. Shorter texts are one shingle."""
    starts, ends, first = word_bounds(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    runs = run_hashes(words, SHINGLE_WORDS, _BASE)
    row = np.repeat(np.arange(len(counts)), np.maximum(counts - SHINGLE_WORDS + 1, 0))
    place = np.arange(len(row)) - np.repeat(np.cumsum(np.r_[0, np.maximum(counts - SHINGLE_WORDS + 1, 0)])[:-1], np.maximum(counts - SHINGLE_WORDS + 1, 0))
    keys = runs[first[:-1][row] + place] if len(row) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS))
    if len(short):
        power, _ = powers(_BASE, SHINGLE_WORDS + 1)
        whole = [mix(np.array([(words[first[i] : first[i + 1]] * power[: counts[i]]).sum() + np.uint64(counts[i])], np.uint64))[0] for i in short.tolist()]
        row, keys = np.r_[row, short], np.r_[keys, np.array(whole, np.uint64)]
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])] if len(keys) else np.zeros(0, bool)
    row, keys = row[fresh], keys[fresh]
    return keys, np.searchsorted(row, np.arange(len(counts) + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values, one line per row that has shingles."""
    x = (keys >> np.uint64(32)).astype(np.uint32)
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), HASHES), np.uint32)
    for i, (a, b) in enumerate(_FACTORS):
        out[:, i] = np.minimum.reduceat(x * a ^ b, at)
    return out


def _set_digests(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = bounds[:-1][np.diff(bounds) > 0]
    first, second = mix(keys ^ np.uint64(0x5851F42D4C957F2D)), mix(keys + np.uint64(0x14057B7EF767814F))
    return np.add.reduceat(first, at), np.add.reduceat(second, at)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text with words: digests of its shingle set, their number, band keys."""
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        for a, b in chunks(offsets):
            keys, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            has = np.flatnonzero(np.diff(bounds))
            if not len(has):
                continue
            one, two = _set_digests(keys, bounds)
            values = signatures(keys, bounds).astype(np.uint64).reshape(len(has), BANDS, ROWS)
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(has), BANDS)).copy()
            for r in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) ^ values[:, :, r])
            at = pa.array(has + a)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(has) + 1, dtype=np.int32) * BANDS), pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(at), rows.column("print").take(at), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), bands], names=["doc_id", "print", "one", "two", "bands"])


def _payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MinHash values and shingle sets of candidate texts, once for each pair of blocks."""
    names = ["low", "high", "node", "mine", "minhash", "shingles"]
    for rows in batches:
        data, offsets = text_bytes(rows.column("text"))
        pairs = rows.column("pairs").to_pylist()
        for a, b in chunks(offsets):
            keys, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            values = signatures(keys, bounds).astype(np.uint16)
            line = np.cumsum(np.diff(bounds) > 0) - 1
            out = []
            for i in range(a, b):
                packed = values[line[i - a]].tobytes(), keys[bounds[i - a] : bounds[i - a + 1]].tobytes()
                out += [(p["low"], p["high"], rows.column("node")[i].as_py(), p["mine"], *packed) for p in pairs[i]]
                if len(out) >= 2000 or i == b - 1:
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=names)
                    out = []


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For 16, 32, ... compared values, the fewest matches that leave P(similarity >= threshold) at ``tolerance`` or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), and its upper
    tail at t is the chance of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return out


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Places of edges that span the same components."""
    label, chosen, place = np.arange(n), [], np.arange(len(u))
    while True:
        a, b = label[u[place]], label[v[place]]
        apart = a != b
        place, low, high = place[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        if not len(place):
            return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        order = np.lexsort((low, high))
        first = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        chosen.append(place[first])
        parent = np.arange(n)
        parent[high[first]] = low[first]
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
        label = parent[label]


class _Side:
    def __init__(self, nodes, minhash, shingles):
        self.nodes = np.array(nodes, np.int64)
        self.minhash = np.frombuffer(b"".join(minhash), np.uint16).reshape(-1, HASHES)
        self.sizes = np.array([len(s) // 8 for s in shingles])
        self.keys = np.frombuffer(b"".join(shingles), np.uint64)
        self.bounds = np.r_[0, np.cumsum(self.sizes)]

    def set(self, i):
        return self.keys[self.bounds[i] : self.bounds[i + 1]]

    def entries(self, rows):
        """(place in rows, key) of all shingles of some rows."""
        keys = np.concatenate([self.set(i) for i in rows.tolist()])
        return np.repeat(np.arange(len(rows)), self.sizes[rows]), keys


def _common(a: _Side, b: _Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of some pairs of shingle sets."""
    if len(i) < 2000:
        return np.array([len(np.intersect1d(a.set(x), b.set(y), assume_unique=True)) for x, y in zip(i.tolist(), j.tolist())], np.int64)
    # many pairs: products of incidence matrices over slices of the shared shingles
    rows, at = np.unique(i, return_inverse=True)
    columns, to = np.unique(j, return_inverse=True)
    ra, ka = a.entries(rows)
    rb, kb = b.entries(columns)
    shared = np.intersect1d(ka, kb)
    out = np.zeros((len(rows), len(columns)), np.float32)
    pa_, pb = np.searchsorted(shared, ka), np.searchsorted(shared, kb)
    for at_most, place, row in ((len(shared), pa_, ka), (len(shared), pb, kb)):
        np.minimum(place, max(at_most - 1, 0), out=place)
    ina, inb = shared[pa_] == ka if len(shared) else np.zeros(len(ka), bool), shared[pb] == kb if len(shared) else np.zeros(len(kb), bool)
    ra, pa_, rb, pb = ra[ina], pa_[ina], rb[inb], pb[inb]
    oa, ob = np.argsort(pa_, kind="stable"), np.argsort(pb, kind="stable")
    ra, pa_, rb, pb = ra[oa], pa_[oa], rb[ob], pb[ob]
    width = 4096
    for start in range(0, len(shared), width):
        xa, ya = np.searchsorted(pa_, [start, start + width])
        xb, yb = np.searchsorted(pb, [start, start + width])
        left, right = np.zeros((len(rows), width), np.float32), np.zeros((len(columns), width), np.float32)
        left[ra[xa:ya], pa_[xa:ya] - start] = 1
        right[rb[xb:yb], pb[xb:yb] - start] = 1
        out += left @ right.T
    return np.rint(out[at, to]).astype(np.int64)


def _links(a: _Side, b: _Side, same: bool, least: list[int], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified pairs, tile by tile."""
    for start in range(0, len(a.nodes), TILE):
        rows = np.arange(start, min(start + TILE, len(a.nodes)))
        small, large = np.minimum(a.sizes[rows][:, None], b.sizes[None, :]), np.maximum(a.sizes[rows][:, None], b.sizes[None, :])
        alive = small >= threshold * large - 1e-9
        if same:
            alive &= rows[:, None] < np.arange(len(b.nodes))[None, :]
        matches = np.zeros(alive.shape, np.int16)
        for h in range(STEP):
            matches += a.minhash[rows, h][:, None] == b.minhash[None, :, h]
        i, j = np.nonzero(alive & (matches >= least[0]))
        count = matches[i, j].astype(np.int64)
        i = i + start
        for k in range(1, len(least)):
            if not len(i):
                break
            span = slice(k * STEP, (k + 1) * STEP)
            for p in range(0, len(i), 1 << 16):
                q = slice(p, p + (1 << 16))
                count[q] += (a.minhash[i[q], span] == b.minhash[j[q], span]).sum(1)
            keep = count >= least[k]
            i, j, count = i[keep], j[keep], count[keep]
        if len(i):
            common = _common(a, b, i, j)
            good = common >= threshold * (a.sizes[i] + b.sizes[j] - common) - 1e-9
            yield i[good], j[good]


def _compare(threshold: float):
    least = least_matches(threshold)

    def finish(key, group) -> pa.RecordBatch | None:
        mine = np.array(group[1])
        sides = [_Side(*([column[x] for x in np.flatnonzero(mine == s).tolist()] for column in (group[0], group[2], group[3]))) for s in (0, 1)]
        same = key[0] == key[1]
        a, b = (sides[0], sides[0]) if same else sides
        if not len(a.nodes) or not len(b.nodes):
            return None
        shift = 0 if same else len(a.nodes)
        nodes = a.nodes if same else np.r_[a.nodes, b.nodes]
        degree, us, vs = np.zeros(len(nodes), np.int64), [], []
        for i, j in _links(a, b, same, least, threshold):
            degree += np.bincount(i, minlength=len(nodes)) + np.bincount(j + shift, minlength=len(nodes))
            keep = _forest(i, j + shift, len(nodes))
            us.append(i[keep])
            vs.append(j[keep] + shift)
        if not us:
            return None
        u, v = np.concatenate(us), np.concatenate(vs)
        keep = _forest(u, v, len(nodes))
        u, v, linked = nodes[u[keep]], nodes[v[keep]], np.flatnonzero(degree)
        none = np.zeros(len(u), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[u, nodes[linked]]), pa.array(np.r_[v, nodes[linked]]), pa.array(np.r_[none, degree[linked]])], names=["u", "v", "links"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by pair of blocks."""
        key, group = None, ([], [], [], [])
        for rows in batches:
            low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
            edges = np.r_[0, np.flatnonzero((low[1:] != low[:-1]) | (high[1:] != high[:-1])) + 1, len(low)] if len(low) else [0]
            columns = [rows.column(c) for c in ("node", "mine", "minhash", "shingles")]
            for x, y in zip(edges[:-1], edges[1:]):
                now = int(low[x]), int(high[x])
                if now != key:
                    if key is not None and (out := finish(key, group)) is not None:
                        yield out
                    key, group = now, ([], [], [], [])
                for held, column in zip(group, columns):
                    held += column.slice(x, y - x).to_pylist()
        if key is not None and (out := finish(key, group)) is not None:
            yield out

    return run


def components(edges: DataFrame) -> DataFrame:
    """node and label (smallest node of its component) for edges (u, v), by hooking to the smallest neighbour and jumping."""
    labels = stored(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct().withColumn("label", F.col("node")))
    while True:
        # every edge carries the smaller label to both ends' present roots
        near = edges.join(labels.select(F.col("node").alias("u"), F.col("label").alias("a")), "u").join(labels.select(F.col("node").alias("v"), F.col("label").alias("b")), "v").where("a <> b")
        hooks = near.groupBy(F.greatest("a", "b").alias("root")).agg(F.min(F.least("a", "b")).alias("to"))
        hooks = stored(hooks)
        if hooks.isEmpty():
            return labels
        while True:  # shorten chains of hooks until every root points at a final one
            on = hooks.join(hooks.select(F.col("root").alias("to"), F.col("to").alias("further")), "to", "left")
            if on.where("further is not null").isEmpty():
                break
            hooks = stored(on.select("root", F.coalesce("further", "to").alias("to")))
        labels = stored(labels.join(hooks.withColumnRenamed("root", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label")))


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("print"), F.coalesce(text, F.lit("")).alias("text"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, copy_id, n_copies, n_links, class_size.

    copy_id is the smallest id with the same shingle set, n_copies how many have
    it. n_links counts the different shingle sets at ``threshold`` or more.
    class_id is the smallest id of the connected group, class_size its rows.
    Texts of one to four words are one shingle. Texts without words, and null,
    are alone: class_id and copy_id are their own id. Rows without an id are
    grouped like others, and ids of groups without any are null. Extra columns
    are ignored; repeated rows are copies; an empty table gives no rows.
    """
    source = _source(docs, id_col, text_col)
    grouped = _grouped(source, threshold).drop("print")
    one = F.lit(1).cast("bigint")
    alone = source.where(~F.col("text").rlike("[^\\x20\\x09-\\x0D]")).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), one.alias("n_copies"), F.lit(0).cast("bigint").alias("n_links"), one.alias("class_size"))
    return grouped.unionByName(alone)


def _grouped(source: DataFrame, threshold: float) -> DataFrame:
    """The groups of the texts with words, with a hash of each text."""
    sketch = stored(source.mapInArrow(giving_back(_sketch), "doc_id long, print long, one long, two long, bands array<long>"))
    classes = stored(sketch.groupBy("one", "two").agg(F.min("doc_id").alias("copy_id"), F.min("print").alias("print"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands")).withColumn("node", F.xxhash64("one", "two")))
    bands = classes.select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.min("node").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low")
    members = stored(bands.join(buckets, "key"))
    near = members.groupBy("node").agg(F.min("low").alias("low"))
    cells = members.select("key", "node").join(near, "node").groupBy("key").agg(F.min("low").alias("low"))
    cells = stored(members.select("key", "node").join(cells, "key").groupBy("node").agg(F.min("low").alias("cell")))
    parts = cells.groupBy("cell").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("parts"))
    blocks = stored(cells.join(parts, "cell").select("node", F.xxhash64("cell", F.pmod(F.xxhash64("node", F.lit(1)), "parts")).alias("block")))
    touched = stored(members.select("key", "node").join(blocks, "node").select("key", "block").distinct())
    several = touched.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    crossing = touched.join(several, "key")
    pairs = crossing.join(crossing.select("key", F.col("block").alias("other")), "key").where("block < other").select("block", "other").distinct()
    own = blocks.select("block").distinct().select("block", F.col("block").alias("low"), F.col("block").alias("high"), F.lit(0).alias("mine"))
    pairs = stored(pairs)
    sides = own.union(pairs.select("block", F.col("block").alias("low"), F.col("other").alias("high"), F.lit(0))).union(pairs.select(F.col("other").alias("block"), F.col("block").alias("low"), F.col("other").alias("high"), F.lit(1)))
    wanted = blocks.join(sides, "block").groupBy("node").agg(F.collect_list(F.struct("low", "high", "mine")).alias("pairs"))
    # a class is read from one of its texts: of equal sets any will do
    rows = sketch.select("doc_id", "print", F.xxhash64("one", "two").alias("node")).groupBy("node", "doc_id", "print").agg(F.count(F.lit(1)).alias("alike"))
    owner = rows.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "print", "alike")).alias("text"))
    wanted = stored(wanted.join(owner, "node").select("node", "pairs", "text.doc_id", "text.print", "text.alike"))

    def meet(some: DataFrame) -> DataFrame:
        chosen = small_side(some, SMALL_MEMBERS)
        return source.alias("s").join(chosen.alias("w"), F.col("s.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("s.print") == F.col("w.print"))).select("text", "node", "pairs")

    repeats = wanted.where("alike > 1")
    if repeats.isEmpty():
        met = meet(wanted)
    else:  # of repeated rows one is read; only their texts are shuffled, after each task has reduced its own
        one = meet(repeats).groupBy("node").agg(F.first("text").alias("text"), F.first("pairs").alias("pairs"))
        met = meet(wanted.where("alike = 1")).unionByName(one)
    payload = met.mapInArrow(giving_back(_payload), "low long, high long, node long, mine int, minhash binary, shingles binary")
    compared = payload.repartition("low", "high").sortWithinPartitions("low", "high", "node").mapInArrow(giving_back(_compare(threshold)), "u long, v long, links long")
    compared = stored(compared)
    labels = components(compared.where("links = 0").select("u", "v"))
    degrees = compared.where("links > 0").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("n_links"))
    joined = classes.select("node", "copy_id", "n_copies", "one", "two").join(labels, "node", "left").join(degrees, "node", "left").withColumn("label", F.coalesce("label", "node"))
    groups = joined.groupBy("label").agg(F.min("copy_id").alias("class_id"), F.sum("n_copies").alias("class_size"))
    facts = stored(joined.join(groups, "label").select("one", "two", "copy_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "class_id", "class_size"))
    return sketch.select("doc_id", "print", "one", "two").join(facts, ["one", "two"]).select("doc_id", "print", "class_id", "copy_id", "n_copies", "n_links", "class_size")


def drop_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group stays: the one with the smallest id; rows without words stay as they are."""
    source = _source(docs, id_col, text_col)
    groups = stored(_grouped(source, threshold).where("class_size > 1").select("doc_id", "print", "class_id"))
    # the smallest id stays; of its rows, if several, the one with the smallest hash
    stays = groups.where("doc_id <=> class_id").groupBy("class_id").agg(F.min("print").alias("stays"))
    judged = groups.alias("g").join(stays.withColumnRenamed("class_id", "c"), F.col("g.class_id").eqNullSafe(F.col("c"))).select("doc_id", "print", (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("print") == F.col("stays"))).alias("good"))
    judged = stored(judged.groupBy("doc_id", "print").agg(F.max("good").alias("good"), F.count(F.lit(1)).alias("alike")).where("not good or alike > 1"))
    verdicts = small_side(judged.select(F.struct("doc_id", "print").alias("_key"), "good"), SMALL_MEMBERS)
    print_ = F.coalesce(F.xxhash64(F.col(f"`{text_col}`")), F.lit(0))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.struct(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), print_.alias("print")).alias("_of"))
    met = packed.join(verdicts, F.col("_of") == F.col("_key"), "left")
    repeated = met.where("good").groupBy("_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return met.where("good is null").select("_row.*").unionByName(repeated.select("_row.*"))
