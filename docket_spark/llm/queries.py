"""The registered queries of this folder: name to (spark, sf_dir) function, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docket_spark.llm import (
    centroids,
    decontaminate,
    exact_dedup,
    infill,
    language,
    packing,
    pii,
    quality,
    repeats,
    rules,
    secrets,
    simhash,
    spans,
    tokens,
)
from docket_spark.llm.columns import fold_of

QUERIES = {}
ORACLES = {}
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def register(name, sql=None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    "op7_exact_dedup",
    f"""SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
        doc_id = max(doc_id) OVER same AS kept, sha256(folded) AS text_sha256
    FROM (SELECT doc_id, {_FOLDED} AS folded FROM documents)
    WINDOW same AS (PARTITION BY folded)""",
)
def op7(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("content_hash")


@register("op9_token_counts")
def op9(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


@register("op5_best_fit_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


@register("op1_simhash")
def op1(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@register("op2_language_id")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    profiles = language.learn_profiles(docs, learn_from=~held_out)
    return language.identify(docs, profiles, also={"held_out": held_out})


@register("op10_quality_classifier")
def op10(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of("doc_id", 3) == 1
    vectors = quality.word_vectors(docs)
    network = quality.fit(docs, labels, vectors, learn_from=~held_out)
    return quality.scores(docs, vectors, network, also={"held_out": held_out})


@register("op6_secret_scan")
def op6(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents"))
    known = spans.by_start(F.col("known"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("known"), kind).alias(f"n_{kind}") for kind in secrets.KINDS[:3]],
        F.sha2(spans.listed(known), 256).alias("base_sha256"),
        spans.listed(spans.by_start(F.concat("known", "added"))).alias("spans"),
        spans.count_of(F.col("added"), "entropy").alias("n_entropy"),
    )


@register("op3_personal_data")
def op3(spark, sf_dir):
    found = pii.scan(table(spark, sf_dir, "documents"))
    known = spans.by_kind(F.col("known"))
    return found.select(
        "doc_id",
        *[spans.count_of(F.col("known"), kind).alias(f"n_{kind}") for kind in pii.KINDS[:4]],
        F.sha2(spans.listed(known), 256).alias("base_sha256"),
        spans.listed(spans.by_kind(F.concat("known", "added"))).alias("spans"),
        spans.count_of(F.col("added"), "context").alias("n_context"),
    )


@register("op8_benchmark_decontamination")
def op8(spark, sf_dir):
    return decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@register("op4_substring_dedup")
def op4(spark, sf_dir):
    found = repeats.repeats(table(spark, sf_dir, "documents"), both_ends=True)
    places = F.transform("removed", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return found.select(
        "doc_id",
        "first_doc_id",
        F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0), lambda n, x: n + x["end"] - x["start"])
        .cast("long")
        .alias("removed_chars"),
        F.array_join(places, ",").alias("removed"),
    )


_BLANKS = r"[ \x09-\x0D]"
_WORD = r"[^ \x09-\x0D]"
_DRAWN = "CAST(('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), {}, 8)) AS BIGINT)"


@register(
    "op11_fill_in_middle",
    f"""WITH units AS (SELECT doc_id, coalesce(text, '') AS body,
        regexp_extract_all(coalesce(text, ''), '{_BLANKS}*{_WORD}+|{_BLANKS}+') AS u FROM documents),
    drawn AS (SELECT *, {_DRAWN.format(1)} % (len(u) + 1) AS c1, {_DRAWN.format(9)} % (len(u) + 1)
        AS c2, {_DRAWN.format(17)} AS h3, {_DRAWN.format(25)} AS h4 FROM units),
    parts AS (SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p,
        array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
        array_to_string(u[greatest(c1, c2) + 1:len(u)], '') AS s,
        CASE WHEN body = '' OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
            OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn)
    SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form,
        CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN body WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
            ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
        sha256(body) AS restored_sha256 FROM parts""",
)
def op11(spark, sf_dir):
    found = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    text = infill.restored(F.col("output"), F.col("form"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(text, 256).alias("restored_sha256"),
    )


def _lloyd_sql(width=64, clusters=8, rounds=10, scale=1024, seed=3):
    """The rounds one after another, each a pair of tables."""
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, [CAST(floor({scale} *
            CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x FROM embeddings
            WHERE len(embedding) = {width}
            AND len([x for x in embedding if isfinite(CAST(x AS DOUBLE))]) = {width})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1
            AS k, x FROM v ORDER BY k LIMIT {clusters})""",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS MATERIALIZED (SELECT i, m.k AS k, m.d AS d FROM (SELECT i, min({{'d': d, 'k': k}})
            AS m FROM (SELECT i, k, list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in
            list_zip(v.x, c{r}.x)]) AS d FROM v, c{r}) GROUP BY i))"""
        )
        if r < rounds:
            steps.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n.x, c{r}.x) AS x FROM c{r} LEFT JOIN
                (SELECT k, list(m ORDER BY j) AS x FROM (SELECT k, j, CAST((sum(x) - ((sum(x) % count(*))
                + count(*)) % count(*)) // count(*) AS BIGINT) AS m FROM (SELECT a{r}.k,
                generate_subscripts(v.x, 1) AS j, unnest(v.x) AS x FROM v JOIN a{r} USING (i))
                GROUP BY k, j) GROUP BY k) AS n USING (k))"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f""" SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
        CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (i) JOIN c{rounds} USING (k)"""
    )


@register("op12_centroid_clustering", _lloyd_sql())
def op12(spark, sf_dir):
    members, found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(members, found)


_QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT i, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM
    (SELECT i, regexp_extract_all(body, '{_WORD}+') AS ws FROM d)),
words AS (SELECT i, count(*) AS n_words, sum(length(word)) AS word_chars,
    count(*) FILTER (regexp_matches(word, '[A-Za-z]|[^\x00-\x7F]')) AS alphabetic,
    count(*) FILTER (regexp_matches(word, '[A-Z].*[A-Z]') AND NOT regexp_matches(word, '[a-z]')) AS
    capital FROM w GROUP BY i),
triples AS (SELECT i, pos, word AS a, lead(word) OVER s AS b, lead(word, 2) OVER s AS c FROM w
    WINDOW s AS (PARTITION BY i ORDER BY pos)),
again AS (SELECT i, pos FROM (SELECT i, pos, c, count(*) OVER (PARTITION BY i, a, b, c) AS many FROM
    triples WHERE c IS NOT NULL) WHERE many > 1),
repeated AS (SELECT i, count(DISTINCT pos) AS n_repeat_words FROM (SELECT i,
    unnest([pos, pos + 1, pos + 2]) AS pos FROM again) GROUP BY i),
l AS (SELECT i, line FROM (SELECT i, unnest(string_split(body, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '{_WORD}')),
lines AS (SELECT i, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    count(*) FILTER (regexp_matches(line, '^{_BLANKS}*[-*•]')) AS bullets,
    count(*) FILTER (regexp_matches(line, '([.][.][.]|…){_BLANKS}*$')) AS ellipses FROM l GROUP BY i),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS
    word_chars, CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, alphabetic, capital, bullets, ellipses
    FROM d LEFT JOIN words USING (i) LEFT JOIN repeated USING (i) LEFT JOIN lines USING (i)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND NOT (10 * n_symbols > n_words) AND word_chars BETWEEN 3 * n_words AND
    10 * n_words AND 10 * alphabetic >= 8 * n_words AND NOT (10 * capital > 5 * n_words)
    AND NOT (10 * bullets > 9 * n_lines) AND NOT (10 * ellipses > 3 * n_lines)
    AND NOT (10 * n_dup_lines > 3 * n_lines) AS kept FROM b"""


@register("op13_quality_rules", _QUALITY)
def op13(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    measures = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rules.judge(docs, rules.learn_order(docs), measures=measures, base=rules.BASE)
