"""The dealt operators as named queries over the whole test tables, with SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: DuckDB: the text without white space.
_BARE = "regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')"


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = sql
        return function

    return register


def tokenizer_path() -> str:
    """The byte-level BPE file; TOKENIZER_FILE names another."""
    import public_tokenizers

    return os.environ.get("TOKENIZER_FILE") or public_tokenizers.path("byte_bpe_50k.json")


@query(
    "op6_exact_dedup",
    f"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256({_BARE}) AS text_sha256 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS k,
 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM r""",
)
def exact_dedup(spark, folder):
    from .exact import exact_groups

    return exact_groups(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@query("op7_bpe")
def bpe(spark, folder):
    from .bpe import encode

    return encode(table(spark, folder, "documents"), tokenizer_path(), ids=False)


@query("op9_mix")
def mix(spark, folder):
    from .mixing import mix as run

    rows = run(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


#: DuckDB: the words of each document.
_WORDS = "SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents"


@query(
    "op1_substring_dedup",
    f"""
WITH d AS ({_WORDS}),
h AS (SELECT doc_id, list_transform(range(1, greatest(len(w) - 48, 1)), lambda i: md5(array_to_string(w[i:i + 49], ' '))) AS hs FROM d),
x AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM h),
m AS (SELECT h, min(doc_id) AS least FROM x GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN m USING (h) WHERE least < doc_id),
v AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT v.doc_id, string_agg(word, ' ' ORDER BY v.p) AS kept, count(*) AS n FROM v ANTI JOIN c ON v.doc_id = c.doc_id AND v.p = c.p GROUP BY v.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
)
def substring_dedup(spark, folder):
    from .substrings import remove_repeats

    return remove_repeats(table(spark, folder, "documents")).drop("spans")


@query("op8_context_tree_scores")
def context_tree_scores(spark, folder):
    from .contexts import context_tree_scores as run

    return run(table(spark, folder, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


@query("op3_toxicity")
def toxicity(spark, folder):
    from .toxicity import score

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score(docs, table(spark, folder, "labels")).select("row.doc_id", "held_out", "score", "predicted")


@query(
    "op4_jaccard_join",
    f"""
WITH RECURSIVE d AS ({_WORDS}),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END)) AS s FROM d WHERE len(w) > 0),
c AS (SELECT s, min(doc_id) AS copy_id, count(*) AS n_copies, len(s) AS n FROM s GROUP BY s),
u AS (SELECT copy_id, n, unnest(s) AS g FROM c),
p AS (SELECT a.copy_id AS a, b.copy_id AS b FROM u a JOIN u b ON a.g = b.g AND a.copy_id < b.copy_id GROUP BY a.copy_id, b.copy_id, a.n, b.n HAVING 5 * count(*) >= 4 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT copy_id AS node, copy_id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
l AS (SELECT node, min(root) AS root FROM r GROUP BY node),
z AS (SELECT root, sum(n_copies) AS class_size FROM l JOIN c ON node = copy_id GROUP BY root),
f AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT s.doc_id, l.root AS class_id, c.copy_id, c.n_copies, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, CAST(class_size AS BIGINT) AS class_size
FROM s JOIN c ON s.s = c.s JOIN l ON l.node = c.copy_id JOIN z ON z.root = l.root LEFT JOIN f ON f.a = c.copy_id
UNION ALL SELECT doc_id, doc_id, doc_id, 1, 0, 1 FROM d WHERE len(w) = 0""",
)
def jaccard_join(spark, folder):
    from .neighbours import similar_groups

    return similar_groups(table(spark, folder, "documents"))


@query("op2_secrets")
def secrets(spark, folder):
    from .secrets import count, digest, joined, scan

    found = scan(table(spark, folder, "documents"))
    kinds = [count("base", kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *kinds, digest("base").alias("base_sha256"), joined("found").alias("spans"), count("found", "novel").alias("n_novel"))


@query(
    "op10_top_k",
    """
WITH w AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
 FROM w q JOIN w x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
)
def top_k(spark, folder):
    from .nearest import top_k as run

    return run(table(spark, folder, "embeddings"))


@query("op5_html_text")
def html_text(spark, folder):
    from .html_text import extract

    return extract(table(spark, folder, "pages"))


def _merkle_sql(levels: int = 5, upper: int = 3) -> str:
    """The manifest with runs of 16: ``levels`` levels per source and ``upper`` above, enough for 16^levels rows a source."""
    bit = "xor(c, 0)"
    for _ in range(8):
        bit = f"list_reduce([{bit}, 0], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)"
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([enc("doc_id"), enc("source"), enc("lang"), enc("n_chars"), text]) + ")"
    lower = enc("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    crc = bit.replace("xor(c, 0)", "xor(c, b)")
    parts = [
        f"""t AS (SELECT doc_id, source, {leaf(enc('text'))} AS leaf, {leaf(lower)} AS low,
 xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: {crc}), 4294967295) % 5 = 0 AS hit
FROM documents)""",
        "l0 AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS i, doc_id, leaf AS h, CASE WHEN hit THEN low ELSE leaf END AS x FROM t)",
    ]
    runs = lambda name, old, key: f"{name} AS (SELECT {key}i // 16 AS i, list(h ORDER BY i) AS m, CASE WHEN count(*) OVER (PARTITION BY {key or '1, '}0) = 1 AND count(*) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {old} GROUP BY {key}i // 16)"
    for n in range(levels):
        parts.append(runs(f"l{n + 1}", f"l{n}", "source, "))
    parts.append(f"u0 AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, h FROM l{levels})")
    for n in range(upper):
        parts.append(runs(f"u{n + 1}", f"u{n}", ""))
    joins, steps = [], []
    for n in range(levels):
        joins.append(f"JOIN l{n + 1} ON l{n + 1}.source IS NOT DISTINCT FROM l0.source AND l{n + 1}.i = l0.i // {16 ** (n + 1)}")
        steps.append((f"l{n + 1}.m", f"l0.i // {16**n} % 16"))
    joins.append("JOIN u0 ON u0.source IS NOT DISTINCT FROM l0.source")
    for n in range(upper):
        joins.append(f"JOIN u{n + 1} ON u{n + 1}.i = u0.i // {16 ** (n + 1)}")
        steps.append((f"u{n + 1}.m", f"u0.i // {16**n} % 16"))
    text = lambda m: f"array_to_string({m}, '')"
    proof = " || ".join(f"{text(f'{m}[1:{s}]')} || {text(f'{m}[{s} + 2:]')}" for m, s in steps)
    path = ", ".join(f"{{'l': {text(f'{m}[1:{s}]')}, 'r': {text(f'{m}[{s} + 2:]')}, 'x': ''}}" for m, s in steps)
    parts.append(f"p AS (SELECT l0.doc_id, l0.h AS leaf, l{levels}.h AS subroot, u{upper}.h AS root, sha256({proof}) AS proof_sha256, l0.x, [{path}] AS path FROM l0 {' '.join(joins)})")
    fold = "list_reduce(list_prepend({'l': '', 'r': '', 'x': x}, path), lambda a, b: {'l': '', 'r': '', 'x': CASE WHEN b.l = '' AND b.r = '' THEN a.x ELSE sha256(b.l || a.x || b.r) END}).x"
    parts.append(f"f AS (SELECT doc_id, leaf, subroot, root, proof_sha256, {fold} AS folded_root FROM p)")
    return "WITH " + ",\n".join(parts) + "\nSELECT *, folded_root = root AS verified FROM f"


@query("op11_merkle_manifest", _merkle_sql())
def merkle_manifest(spark, folder):
    from .manifest import every_fifth, lower_ascii, merkle_manifest as run

    docs = table(spark, folder, "documents")
    return run(docs, changed={"text": lower_ascii(F.col("text"))}, when=every_fifth(F.col("doc_id"))).drop("source", "path")


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    def near(n: int) -> str:
        gap = "CAST(list_sum(list_transform(list_zip(w.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT)"
        return f"a{n} AS (SELECT vec_id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (SELECT w.vec_id, c.cluster, {gap} AS d FROM w, c{n} c) GROUP BY vec_id)"

    parts = [
        """w AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, v FROM w QUALIFY cluster < {k})",
        near(0),
    ]
    for n in range(rounds):
        parts += [
            f"s{n} AS (SELECT cluster, j, sum(x) AS s, count(*) AS m FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM a{n} JOIN w USING (vec_id)) GROUP BY cluster, j)",
            f"n{n} AS (SELECT cluster, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY j) AS v FROM s{n} GROUP BY cluster)",
            f"c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(n{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN n{n} USING (cluster))",
            near(n + 1),
        ]
    own = "CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia"
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, {own}, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} USING (cluster)"


@query("op12_centroid_clusters", _clusters_sql())
def centroid_clusters(spark, folder):
    from .simplex import clusters

    return clusters(table(spark, folder, "embeddings")).drop("compared")


@query(
    "op13_warc",
    """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM g""",
)
def warc(spark, folder):
    from .archives import archive_pages

    return archive_pages(table(spark, folder, "pages"))
