"""Narrative retrieval: filters, nearest neighbours, diversity, themes and examples."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import sql
from checks.core import DOCUMENT, ELIGIBLE
from checks.registry import index, narratives, register, rounded
from docket_spark.functions.embedding import hashed_terms, with_embedding
from docket_spark.functions.text import bounded_quote, quote_fingerprint
from docket_spark.operators import pivots
from docket_spark.operators.nearest import nearest_by_key
from docket_spark.operators.ranking import diversify, pick_examples
from docket_spark.plans import evidence, retrieval
from docket_spark.plans.binding import bind_companies
from docket_spark.session import checkpoint_folder
from docket_spark.sources import testdata

FILTERS = retrieval.NarrativeFilters(
    issue="en",
    product="BUILDING",
    company_response="O",
    start=date(1996, 1, 1),
    end=date(1999, 1, 1),
)
_PREDICATE = (
    "issue = 'en' AND product = 'BUILDING' AND company_response = 'O' AND "
    "date_received >= DATE '1996-01-01' AND date_received < DATE '1999-01-01'"
)


def _long(name):
    """A rank in the integer type the oracle counts in."""
    return F.col(name).cast("bigint").alias(name)


def anchor(spark, sf, vec_id=7):
    """One stored vector as the query vector, as a scalar subquery."""
    return (
        testdata.table(spark, sf, "embeddings")
        .where(F.col("vec_id") == vec_id)
        .select("embedding")
        .scalar()
    )


def _ranked_sql(where="true", vec_id=7, k=24):
    return (
        f"SELECT *, row_number() OVER (ORDER BY distance, complaint_id) AS rank FROM (SELECT *, "
        f"{sql.distance('embedding', f'(SELECT embedding FROM embeddings WHERE vec_id = {vec_id})')} "
        f"AS distance FROM idx WHERE {where}) ORDER BY distance, complaint_id LIMIT {k}"
    )


@register(
    "flt_narrative_filters",
    sql.query(f"SELECT complaint_id, state, company FROM idx WHERE {_PREDICATE}", "idx"),
)
def _(spark, sf):
    rows = index(spark, sf).where(FILTERS.predicate())
    return rows.select("complaint_id", "state", "company")


@register(
    "ret_filtered_topk",
    sql.query(
        "SELECT rank, complaint_id, round(distance, 6) AS distance FROM r",
        "idx",
        r=_ranked_sql(_PREDICATE, k=10),
    ),
)
def _(spark, sf):
    hits = retrieval.retrieve(index(spark, sf), anchor(spark, sf), FILTERS, 10)
    return rounded(hits.select(_long("rank"), "complaint_id", "distance"), "distance")


@register(
    "ret_diverse_topk",
    sql.query(
        "SELECT row_number() OVER (ORDER BY nth > 1, rank) AS position, complaint_id, issue, "
        "sub_issue FROM (SELECT *, row_number() OVER (PARTITION BY issue, sub_issue ORDER BY rank) "
        "AS nth FROM r) ORDER BY nth > 1, rank LIMIT 8",
        "idx",
        r=_ranked_sql("issue = 'en'"),
    ),
)
def _(spark, sf):
    filters = retrieval.NarrativeFilters(issue="en")
    hits = retrieval.retrieve_diverse(index(spark, sf), anchor(spark, sf), filters)
    return hits.select(_long("position"), "complaint_id", "issue", "sub_issue")


# One request per customer segment and region: the vector of the segment's first customer's nation.
_REQUESTS = """SELECT c_mktsegment || '/' || r_name AS question_id, c_mktsegment AS product,
  r_name AS state, min(c_custkey) AS vec_id FROM customer JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


def _requests(spark, sf):
    read = lambda name: testdata.table(spark, sf, name)
    named = (
        read("customer")
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("c_mktsegment").alias("product"), F.col("r_name").alias("state"))
        .agg(F.min("c_custkey").alias("vec_id"))
    )
    vectors = read("embeddings").select("vec_id", F.col("embedding").alias("query_vector"))
    return named.join(vectors, "vec_id").select(
        F.concat_ws("/", "product", "state").alias("question_id"), "product", "state", "query_vector"
    )


_BATCHED = sql.query(
    "SELECT question_id, rank, complaint_id, round(distance, 6) AS distance FROM (SELECT *, "
    "row_number() OVER (PARTITION BY question_id ORDER BY distance, complaint_id) AS rank FROM "
    f"(SELECT question_id, complaint_id, {sql.distance('idx.embedding', 'e.embedding')} AS distance "
    "FROM idx JOIN q USING (product, state) JOIN embeddings e ON e.vec_id = q.vec_id)) "
    "WHERE rank <= 5",
    "idx",
    q=_REQUESTS,
)


@register("ret_keyed_topk", _BATCHED)
def _(spark, sf):
    hits = nearest_by_key(index(spark, sf), _requests(spark, sf), ["product", "state"], 5)
    return rounded(hits.select("question_id", _long("rank"), "complaint_id", "distance"), "distance")


# Every hundredth vector asks, some with filters of its own document and some with days.
_ASKED = """SELECT CAST(vec_id AS VARCHAR) AS question_id, vec_id, e.embedding AS query_vector,
  CASE WHEN vec_id % 300 = 0 THEN lang END AS issue,
  CASE WHEN vec_id % 400 = 100 THEN 'BUILDING' END AS product,
  CASE WHEN vec_id % 200 = 0 THEN DATE '1994-01-01' END AS first_day,
  CASE WHEN vec_id % 500 = 0 THEN DATE '1997-01-01' END AS end_day
FROM embeddings e LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0"""
_MATCHING = (
    "idx JOIN asked ON (asked.issue IS NULL OR idx.issue = asked.issue) AND (asked.product IS NULL OR "
    "idx.product = asked.product) AND (first_day IS NULL OR date_received >= first_day) AND (end_day IS "
    "NULL OR date_received < end_day)"
)


def asked(spark, sf):
    vec = F.col("vec_id")
    documents = testdata.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    return (
        testdata.table(spark, sf, "embeddings")
        .where(vec % 100 == 0)
        .join(documents, "vec_id", "left")
        .select(
            vec.cast("string").alias("question_id"),
            "vec_id",
            F.col("embedding").alias("query_vector"),
            F.when(vec % 300 == 0, F.col("lang")).alias("issue"),
            F.when(vec % 400 == 100, "BUILDING").alias("product"),
            F.when(vec % 200 == 0, F.lit(date(1994, 1, 1))).alias("start"),
            F.when(vec % 500 == 0, F.lit(date(1997, 1, 1))).alias("end"),
        )
    )


_ALL_ASKED = sql.query(
    "SELECT question_id, rank, complaint_id, round(distance, 6) AS distance FROM (SELECT *, "
    "row_number() OVER (PARTITION BY question_id ORDER BY distance, complaint_id) AS rank FROM "
    f"(SELECT question_id, complaint_id, {sql.distance('idx.embedding', 'query_vector')} AS distance "
    f"FROM {_MATCHING})) WHERE rank <= 5",
    "idx",
    asked=_ASKED,
)


@register("ret_batch_topk", _ALL_ASKED)
def _(spark, sf):
    hits = retrieval.retrieve_batch(index(spark, sf), asked(spark, sf), 5)
    return rounded(hits.select("question_id", _long("rank"), "complaint_id", "distance"), "distance")


@register("ret_pruned_topk", _ALL_ASKED)
def _(spark, sf):
    folder = f"{checkpoint_folder(spark)}/layout-{uuid.uuid4().hex}"
    rows = index(spark, sf).select("complaint_id", "embedding", "issue", "product", "date_received")
    pivots.write_layout(rows, folder, pivots=16)
    hits = pivots.nearest_batch_pruned(
        spark, folder, asked(spark, sf), 5, ("issue", "product"), {"date_received": ("start", "end")}
    )
    return rounded(hits.select("question_id", _long("rank"), "complaint_id", "distance"), "distance")


@register(
    "ret_diverse_batch",
    sql.query(
        "SELECT question_id, position, complaint_id FROM (SELECT *, row_number() OVER (PARTITION BY "
        "question_id ORDER BY CASE WHEN n > 8 THEN nth > 1 ELSE false END, rank) AS position FROM "
        "(SELECT *, count(*) OVER (PARTITION BY question_id) AS n, row_number() OVER (PARTITION BY "
        "question_id, issue, sub_issue ORDER BY rank) AS nth FROM (SELECT *, row_number() OVER "
        "(PARTITION BY question_id ORDER BY distance, complaint_id) AS rank FROM (SELECT question_id, "
        f"complaint_id, idx.issue, sub_issue, {sql.distance('idx.embedding', 'query_vector')} AS "
        f"distance FROM {_MATCHING})) WHERE rank <= 24)) WHERE position <= 8",
        "idx",
        asked=_ASKED,
    ),
)
def _(spark, sf):
    hits = retrieval.retrieve_batch(index(spark, sf), asked(spark, sf), diversified=True)
    return hits.select("question_id", _long("position"), "complaint_id")


@register(
    "ret_request_status",
    sql.query(
        "SELECT question_id, CASE vec_id % 500 WHEN 400 THEN 'configuration_error' WHEN 300 THEN "
        "'configuration_error' WHEN 200 THEN 'index_error' ELSE CASE WHEN n IS NULL THEN 'empty' ELSE "
        "'ok' END END AS status, CASE WHEN vec_id % 500 IN (200, 300, 400) THEN 0 ELSE "
        "least(coalesce(n, 0), 3) END AS hit_count, CASE vec_id % 500 WHEN 400 THEN 'the request has no "
        "query text' WHEN 300 THEN 'the request asks for fewer than one row' WHEN 200 THEN 'the "
        "request''s vector has 10 numbers' END AS error FROM asked LEFT JOIN (SELECT question_id, "
        "count(*) AS n FROM idx JOIN asked ON (vec_id % 500 <> 100 OR company = 'no such company') AND "
        "(first_day IS NULL OR date_received >= first_day) AND (end_day IS NULL OR date_received < "
        "end_day) GROUP BY 1) USING (question_id)",
        "idx",
        asked=_ASKED,
    ),
)
def _(spark, sf):
    part = F.col("vec_id") % 500
    requests = (
        asked(spark, sf)
        .drop("issue", "product")
        .withColumns(
            {
                "query_text": F.when(part == 400, " ").otherwise("fees"),
                "top_k": F.when(part == 300, 0).otherwise(3),
                "company": F.when(part == 100, "no such company"),
                "query_vector": F.when(part == 200, F.slice("query_vector", 1, 10)).otherwise(
                    F.col("query_vector")
                ),
            }
        )
    )
    rows = index(spark, sf)
    width = rows.agg(F.max(F.size("embedding"))).scalar()
    hits = retrieval.retrieve_batch(rows, retrieval.searchable(requests, width), "top_k")
    return retrieval.retrieval_status(requests, hits, width=width)


# Terms by dimension, over the norm of a document's counts.
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@register(
    "ret_index_embedding",
    sql.query(
        "SELECT complaint_id, CAST(dimension AS INTEGER) AS dimension, round(CAST(CAST(n / norm AS "
        "FLOAT) AS DOUBLE), 5) AS value FROM "
        "counted JOIN (SELECT complaint_id, sqrt(sum(n * n)) AS norm FROM counted GROUP BY 1) USING "
        "(complaint_id)",
        "narrative",
        terms="SELECT complaint_id, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % 64 AS dimension FROM "
        f"(SELECT complaint_id, unnest(regexp_extract_all(lower({DOCUMENT}), '{_TERM}')) AS term FROM "
        f"narrative WHERE {ELIGIBLE})",
        counted="SELECT complaint_id, dimension, count(*) AS n FROM terms GROUP BY ALL",
    ),
)
def _(spark, sf):
    rows = retrieval.index_rows(narratives(spark, sf)).select("complaint_id", "document")
    embedded = with_embedding(rows, "document", hashed_terms(64))
    # The outer form, as Spark computes the vectors once more to filter by their size for the inner one.
    return (
        embedded.select("complaint_id", F.posexplode_outer("embedding").alias("dimension", "value"))
        .where("value <> 0")
        .withColumn("value", F.round(F.col("value").cast("double"), 5))
    )


@register(
    "jn_narrative_binding",
    sql.query(
        "SELECT complaint_id, company FROM narrative WHERE company = (SELECT company FROM narrative "
        "WHERE company IS NOT NULL GROUP BY company ORDER BY count(*) DESC, company LIMIT 1)",
        "narrative",
    ),
)
def _(spark, sf):
    rows = narratives(spark, sf)
    winner = (
        rows.where(F.col("company").isNotNull())
        .groupBy("company")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), F.col("company").asc())
        .limit(1)
        .select("company")
        .scalar()
    )
    return rows.where(F.col("company") == winner).select("complaint_id", "company")


@register(
    "jn_binding_outcomes",
    """WITH o AS (SELECT o_custkey, o_orderpriority AS bound, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderkey) - 1 AS row_index FROM orders),
c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 4 END AS bind_row,
  CASE WHEN c_custkey % 3 = 0 THEN '1 urgent' END AS company FROM customer),
j AS (SELECT c.*, bound, CASE WHEN bind_row IS NULL THEN NULL WHEN bound IS NULL THEN 'the bound row is not
  among the structured rows' WHEN company IS NOT NULL AND bound <> '1-URGENT' THEN 'the bound company is not
  the one the request names' END AS error FROM c LEFT JOIN o ON o_custkey = c_custkey AND row_index = bind_row)
SELECT c_custkey AS question_id, CASE WHEN bind_row IS NOT NULL AND error IS NULL THEN bound ELSE company
  END AS company, regexp_replace(error, '\\s+', ' ', 'g') AS binding_error FROM j""",
)
def _(spark, sf):
    """A customer asks about the priority of one of their orders."""
    orders = testdata.table(spark, sf, "orders")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = orders.select(
        F.col("o_custkey").alias("question_id"),
        place.alias("row_index"),
        F.col("o_orderpriority").alias("company"),
    )
    key = F.col("c_custkey")
    requests = testdata.table(spark, sf, "customer").select(
        key.alias("question_id"),
        F.when(key % 5 > 0, key % 4).alias("bind_row"),
        F.when(key % 3 == 0, "1 urgent").alias("company"),
    )
    return bind_companies(requests, rows).select("question_id", "company", "binding_error")


def documents_as_evidence(spark, sf):
    """Every document as an evidence item of its source, in id order."""
    return testdata.table(spark, sf, "documents").select(
        F.col("source").alias("question_id"),
        F.col("doc_id").alias("rank"),
        F.col("doc_id").cast("string").alias("complaint_id"),
        "lang",
        (F.col("n_chars") % 7).cast("string").alias("length_class"),
        "text",
    )


@register(
    "win_diversified_topk",
    """WITH e AS (SELECT *, n_chars % 7 AS c, row_number() OVER (PARTITION BY source, lang,
  n_chars % 7 ORDER BY doc_id) AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN n > 12 THEN nth > 1
  ELSE false END, doc_id) AS position FROM e)
SELECT source AS question_id, position, doc_id FROM p WHERE position <= 12""",
)
def _(spark, sf):
    kept = diversify(
        documents_as_evidence(spark, sf), "question_id", ["lang", "length_class"], "rank", 12
    )
    return kept.select("question_id", _long("position"), F.col("rank").alias("doc_id"))


@register(
    "win_example_selection",
    sql.query(
        "SELECT source AS question_id, example_no, CAST(doc_id AS VARCHAR) AS complaint_id, quote "
        "FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS example_no FROM "
        "(SELECT *, row_number() OVER (PARTITION BY source, regexp_replace(lower(quote), '\\s+', '', "
        "'g') ORDER BY doc_id) AS nth FROM quoted WHERE quote <> '') WHERE nth = 1) "
        "WHERE example_no <= 3",
        quoted=f"SELECT doc_id, source, {sql.bounded_quote('c')} AS quote FROM "
        f"(SELECT *, {sql.collapse('text')} AS c FROM documents)",
    ),
)
def _(spark, sf):
    quoted = documents_as_evidence(spark, sf).withColumn("quote", bounded_quote(F.col("text")))
    quoted = quoted.withColumn("print", quote_fingerprint(F.col("quote")))
    return pick_examples(quoted, "question_id", "complaint_id", "quote", "print", "rank", 3).select(
        "question_id", _long("example_no"), "complaint_id", "quote"
    )


@register(
    "agg_repeated_themes",
    """SELECT question_id, theme_no, issue, sub_issue, retrieved_count FROM (SELECT *, row_number()
  OVER (PARTITION BY question_id ORDER BY retrieved_count DESC, issue, sub_issue) AS theme_no FROM
  (SELECT 'doc' || n_chars % 5 AS question_id, lang AS issue, source AS sub_issue, count(*) AS
  retrieved_count FROM documents GROUP BY ALL HAVING count(*) >= 2)) WHERE theme_no <= 3""",
)
def _(spark, sf):
    items = testdata.table(spark, sf, "documents").select(
        F.concat(F.lit("doc"), (F.col("n_chars") % 5).cast("string")).alias("question_id"),
        F.col("lang").alias("issue"),
        F.concat(F.lit("  "), "source", F.lit(" ")).alias("sub_issue"),
    )
    return evidence.themes(items).select(
        "question_id", _long("theme_no"), "issue", "sub_issue", "retrieved_count"
    )


_ITEM = {
    "complaint_id": "CAST(doc_id AS VARCHAR)",
    "lang": "lang",
    "length_class": "CAST(n_chars % 7 AS VARCHAR)",
    "rank": "CAST(doc_id AS VARCHAR)",
    "text": "text",
}
_LINE = "sha256(concat_ws(',', " + ", ".join(
    f"coalesce(length({x}) || ':' || {x}, 'N')" for x in _ITEM.values()
) + "))"
_LEVEL = (
    "(SELECT q, place // 1000 AS place, sha256(string_agg(line, ',' ORDER BY place)) AS line FROM {} "
    "GROUP BY q, place // 1000)"
)
_TREE = _LEVEL.format(
    _LEVEL.format(_LEVEL.format(f"(SELECT source AS q, doc_id AS place, {_LINE} AS line FROM documents)"))
)


@register(
    "agg_evidence_fingerprint",
    "SELECT q AS question_id, sha256(string_agg(line, ',' ORDER BY place)) AS evidence_sha256 FROM "
    f"{_TREE} GROUP BY q",
)
def _(spark, sf):
    items = documents_as_evidence(spark, sf)
    return evidence.fingerprint(items, ["rank"])
