"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, licenses, mixing, neighbours, packing, quality, repeats, secrets, sharding, simhash, token_files, topk, vector_links

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    rows = packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.drop("ids")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, summed from the blocks that its shards got."""
    return mixing.shares(mixing.mixed(table(spark, sf_dir, "documents")))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    return vector_links.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document."""
    return licenses.recognised(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document; the law is near equal bytes."""
    rows = sharding.sharded(table(spark, sf_dir, "documents"), shards=8)
    return rows.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the token files hold of every document, after a round trip."""
    return token_files.token_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every hundredth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document."""
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, repetition planted in a tenth of them."""
    return repeats.digests(repeats.periodic_runs(repeats.planted(table(spark, sf_dir, "documents"))))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors for every twentieth vector."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the words of every source differ from those of the other sources of its language."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


#: The signs that a value can hold, for SQL dialects without back references.
SIGNS = string.digits + string.ascii_letters + "_=/.-+"
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_packing, op3_mixing, op4_embedding_near_dedup, op5_license_scan, op6_sharding,
        op7_secret_scan, op8_token_files, op9_exact_top_k, op10_quality_classifier, op11_periodic_runs, op12_nearest_neighbours, op13_source_divergence,
    )
}


def _op4_sql() -> str:
    sound = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {sound}
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= {vector_links.THRESHOLD}
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, p.component_id, e.vec_id = p.component_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN part p ON p.a = e.vec_id
"""


def _op5_sql() -> str:
    wordings = {v: (k,) for k, v in licenses.SENTENCES.items()} | licenses.WORDINGS
    known = ", ".join(f"('{s}', {list(ids)})" for s, ids in wordings.items())
    # the ids between those of a rule, as few as possible, stay
    pattern = lambda rule: "((?:<[^>]*>)*?)".join(f"<{i}>" for i in rule)
    steps, hits, now = [], [], "s0"
    for i, (name, rule) in enumerate(licenses.RULES):
        between = "".join(f"\\{n}" for n in range(1, len(rule)))
        steps.append(
            f"s{i + 1} AS (SELECT *, regexp_replace(l{i}, '{pattern(rule)}', '{between}', 'g') AS l{i + 1} FROM {now})"
        )
        hits.append(f"CASE WHEN l{i + 1} <> l{i} THEN '{name}' END")
        now = f"s{i + 1}"
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM (
    SELECT r, regexp_split_to_array(t, '[.!?:]+[ \t\r]|[\n\x0B\f]') AS p FROM d)),
ids AS (
    SELECT r, flatten(list(k.id ORDER BY i)) AS ids FROM cut JOIN known k
    ON k.sentence = trim(regexp_replace(translate(p, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'))
    GROUP BY r),
s0 AS (
    SELECT d.doc_id, coalesce(ids.ids, CAST([] AS VARCHAR[])) AS ids,
        array_to_string(list_transform(coalesce(ids.ids, CAST([] AS VARCHAR[])), lambda x: '<' || x || '>'), '') AS l0
    FROM d LEFT JOIN ids USING (r)),
{", ".join(steps)},
named AS (SELECT *, list_filter([{", ".join(hits)}], lambda x: x IS NOT NULL) AS names FROM {now})
SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, CAST(len(ids) AS BIGINT) AS n_sentences,
    array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i), ',') AS licenses
FROM named
"""


def _op7_sql() -> str:
    q = lambda s: s.replace("'", "''")
    found = " UNION ALL ".join(
        f"""SELECT r, source, lang, {no} AS no, unnest(w) AS w, unnest(g) AS g, unnest(v) AS v, generate_subscripts(w, 1) AS i FROM (
    SELECT r, source, lang, regexp_extract_all(t, '(?s)(.*?)(?:{q(p)}|\\z)', 0) AS w,
        regexp_extract_all(t, '(?s)(.*?)(?:{q(p)}|\\z)', 1) AS g, regexp_extract_all(t, '(?s)(.*?)(?:{q(p)}|\\z)', 2) AS v
    FROM d WHERE regexp_matches(t, '{q(p)}'))"""
        for no, p in enumerate(secrets.PATTERNS.values())
    )
    kinds = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
found AS ({found}),
placed AS (SELECT *, sum(length(w)) OVER (PARTITION BY r, no ORDER BY i) AS e FROM found),
spans AS (
    SELECT r, no, source, lang, coalesce(v, '') AS v, CAST(e - (length(w) - length(g)) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM placed
    WHERE coalesce(v, '') <> '' AND CASE no WHEN 0 THEN length(v) >= {secrets.LEAST_ASSIGNED}
        WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') ELSE true END),
owned AS (
    SELECT v, count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) AS owners,
        count(DISTINCT (source, lang)) AS repositories FROM spans GROUP BY v),
judged AS (
    SELECT s.*, owners <= {secrets.MOST_OWNERS} AND repositories <= {secrets.MOST_REPOSITORIES}
        AND NOT regexp_matches(v, '(?i)example|sample|xxxx|0000|1234567')
        AND NOT regexp_matches(v, '{"|".join(f"[{c}]{{6}}" for c in SIGNS)}') AS live
    FROM spans s JOIN owned USING (v)),
kept AS (
    SELECT * FROM judged j WHERE no < 3 OR (live AND NOT EXISTS (
        SELECT 1 FROM judged b WHERE b.r = j.r AND b.no < 3 AND b.s < j.e AND b.e > j.s))),
listed AS (
    SELECT r, {", ".join(f"count(*) FILTER (WHERE no = {no}) AS n_{k}" for no, k in enumerate(secrets.KINDS))},
        count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE NOT live) AS n_example,
        string_agg({kinds}[no + 1] || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (WHERE no < 3) AS base,
        string_agg({kinds}[no + 1] || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans
    FROM kept GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in (*secrets.KINDS, "live", "example"))},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)
"""


def _op9_sql() -> str:
    return f"""
WITH v AS (
    SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({topk.SCALE} * x)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def _op12_sql() -> str:
    sound = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND {sound}),
scores AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]), lambda a, b: a + b) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


def _op13_sql() -> str:
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
occurring AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '{divergence.TERM}')) AS term FROM d),
kept AS (SELECT lang, term FROM occurring GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.LEAST_DOCUMENTS}),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM occurring SEMI JOIN kept USING (lang, term) GROUP BY ALL),
counts AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + ({divergence.SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v) AS p FROM counts JOIN v USING (lang)),
whole AS (SELECT lang, term, 1 + ({divergence.SCALE}::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.MOST_TERMS}
"""


SQL: dict[str, str] = {
    "op4_embedding_near_dedup": _op4_sql(),
    "op5_license_scan": _op5_sql(),
    "op7_secret_scan": _op7_sql(),
    "op9_exact_top_k": _op9_sql(),
    "op12_nearest_neighbours": _op12_sql(),
    "op13_source_divergence": _op13_sql(),
}
