"""Scalar functions over document, order and supplier texts; company resolution; request texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import sql
from checks.registry import register
from docket_spark.functions import requests as asked
from docket_spark.functions import text as t
from docket_spark.functions.answers import parse_answer
from docket_spark.functions.metrics import ratio
from docket_spark.functions.vectors import squared_l2
from docket_spark.plans.companies import entity_conflicts, registry_entries, resolve_companies
from docket_spark.sources import testdata


def _documents(spark, sf):
    return testdata.table(spark, sf, "documents")


@register(
    "fn_scalar_builtins",
    """SELECT o_orderkey, nullif(trim(o_orderpriority), '1-URGENT') AS priority,
  lower(o_orderpriority) AS folded, coalesce(nullif(o_orderstatus, 'P'), 'pending') AS status,
  abs(o_custkey - 700) AS span, CASE WHEN o_orderstatus = 'F' THEN 1 END AS filled,
  TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
  TRY_CAST(o_orderpriority AS INTEGER) AS unreadable FROM orders""",
)
def _(spark, sf):
    return testdata.table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif(F.trim("o_orderpriority"), F.lit("1-URGENT")).alias("priority"),
        F.lower("o_orderpriority").alias("folded"),
        F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("pending")).alias("status"),
        F.abs(F.col("o_custkey") - 700).alias("span"),
        F.when(F.col("o_orderstatus") == "F", 1).alias("filled"),
        F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"),
        F.col("o_orderpriority").try_cast("int").alias("unreadable"),
    )


@register(
    "fn_regexp_replace",
    "SELECT doc_id, regexp_replace(lower(source || '--' || lang || ' #' || n_chars), "
    "'[^a-z0-9]+', ' ', 'g') AS replaced FROM documents",
)
def _(spark, sf):
    text = F.concat("source", F.lit("--"), "lang", F.lit(" #"), F.col("n_chars").cast("string"))
    return _documents(spark, sf).select(
        "doc_id", F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ").alias("replaced")
    )


@register(
    "fn_truncation",
    "SELECT doc_id, length(text) AS characters, substr(text, 1, 6000) AS shortened, "
    "length(text) > 6000 AS truncated FROM documents",
)
def _(spark, sf):
    return _documents(spark, sf).select(
        "doc_id",
        F.length("text").cast("bigint").alias("characters"),
        F.substring("text", 1, 6000).alias("shortened"),
        (F.length("text") > 6000).alias("truncated"),
    )


@register("fn_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))


@register(
    "fn_whitespace_collapse",
    f"SELECT doc_id, {sql.collapse('text')} AS collapsed FROM documents",
)
def _(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", t.collapse_whitespace(F.col("text")).alias("collapsed")
    )


_QUOTED = (
    f"SELECT doc_id, source, lang, text, {sql.bounded_quote('c')} AS quote FROM "
    f"(SELECT *, {sql.collapse('text')} AS c FROM documents)"
)


@register("fn_bounded_quote", sql.query("SELECT doc_id, quote FROM quoted", quoted=_QUOTED))
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", t.bounded_quote(F.col("text")).alias("quote"))


@register(
    "fn_quote_fingerprint",
    sql.query(
        "SELECT doc_id, regexp_replace(lower(quote), '\\s+', '', 'g') AS fingerprint FROM quoted",
        quoted=_QUOTED,
    ),
)
def _(spark, sf):
    quote = t.bounded_quote(F.col("text"))
    return _documents(spark, sf).select(
        "doc_id", t.quote_fingerprint(quote).alias("fingerprint")
    )


@register(
    "fn_quote_containment",
    sql.query(
        f"SELECT doc_id, contains({sql.collapse('text')}, CASE WHEN doc_id % 3 = 0 THEN quote || "
        "' never written' ELSE quote END) AS contained FROM quoted",
        quoted=_QUOTED,
    ),
)
def _(spark, sf):
    quote = t.bounded_quote(F.col("text"))
    claimed = F.when(F.col("doc_id") % 3 == 0, F.concat(quote, F.lit(" never written"))).otherwise(
        quote
    )
    return _documents(spark, sf).select(
        "doc_id", t.contains_quote(F.col("text"), claimed).alias("contained")
    )


_ID = (
    "CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN '0' || doc_id "
    "WHEN 2 THEN doc_id || ' ' ELSE 'c' || doc_id END"
)


@register(
    "fn_canonical_id",
    f"SELECT doc_id, regexp_full_match({_ID}, '0|[1-9][0-9]*') AS canonical FROM documents",
)
def _(spark, sf):
    number, part = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    spelled = (
        F.when(part == 0, number)
        .when(part == 1, F.concat(F.lit("0"), number))
        .when(part == 2, F.concat(number, F.lit(" ")))
        .otherwise(F.concat(F.lit("c"), number))
    )
    return _documents(spark, sf).select("doc_id", t.is_canonical_id(spelled).alias("canonical"))


@register(
    "fn_number_format",
    """SELECT l_quantity, l_linenumber, rtrim(rtrim(printf('%.4f', l_quantity / l_linenumber), '0'), '.')
  AS formatted, count(*) AS row_count FROM lineitem GROUP BY ALL""",
)
def _(spark, sf):
    value = ratio(F.col("l_quantity"), F.col("l_linenumber"))
    return (
        testdata.table(spark, sf, "lineitem")
        .groupBy("l_quantity", "l_linenumber", t.format_number(value).alias("formatted"))
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


_PHRASE = (
    "CASE event_id % 8 WHEN 0 THEN 'Cash App spike in H2 2025' WHEN 1 THEN 'Zelle fraud Q' || "
    "(1 + user_id % 4) || ' ' || (2020 + user_id % 6) WHEN 2 THEN 'Trend of mortgage and "
    "debt collection ' || (2021 + user_id % 3) || ' to ' || (2024 + user_id % 3) WHEN 3 THEN "
    "'How much money do California  consumers typically get back?' WHEN 4 THEN 'auto insurance "
    "claim handling in the second half of 2025' WHEN 5 THEN 'MOHELA student loan late cases in CA' "
    "WHEN 6 THEN 'actual relief from TransUnion credit report disputes 20' || (10 + user_id % 15) "
    "ELSE 'Cashier ' || event_type || ' ' || user_id END"
)


def _request_texts(spark, sf):
    """A request text per event: fixed phrasings filled from the event's own values."""
    user, part = F.col("user_id"), F.col("event_id") % 8

    def number(value):
        return value.cast("string")

    text = (
        F.when(part == 0, "Cash App spike in H2 2025")
        .when(
            part == 1,
            F.concat(
                F.lit("Zelle fraud Q"), number(1 + user % 4), F.lit(" "), number(2020 + user % 6)
            ),
        )
        .when(
            part == 2,
            F.concat(
                F.lit("Trend of mortgage and debt collection "),
                number(2021 + user % 3),
                F.lit(" to "),
                number(2024 + user % 3),
            ),
        )
        .when(part == 3, "How much money do California  consumers typically get back?")
        .when(part == 4, "auto insurance claim handling in the second half of 2025")
        .when(part == 5, "MOHELA student loan late cases in CA")
        .when(
            part == 6,
            F.concat(
                F.lit("actual relief from TransUnion credit report disputes 20"),
                number(10 + user % 15),
            ),
        )
        .otherwise(F.concat(F.lit("Cashier "), "event_type", F.lit(" "), number(user)))
    )
    return testdata.table(spark, sf, "events").select(
        "event_id", asked.normalise_request(text).alias("q")
    )


_REQUESTS = (
    f"SELECT event_id, lower({sql.collapse('p')}) AS q FROM "
    f"(SELECT event_id, {_PHRASE} AS p FROM events)"
)


def _first(pairs):
    return "CASE " + " ".join(f"WHEN contains(q, '{p}') THEN '{v}'" for p, v in pairs) + " END"


@register(
    "jn_gazetteer_tags",
    sql.query(
        f"SELECT event_id, {_first(asked.BRAND_PHRASES)} AS brand, {_first(asked.PRODUCT_PHRASES)} "
        "AS product, CASE WHEN list_has_any(regexp_split_to_array(q, '[^a-z]+'), ['california', "
        "'ca']) THEN 'CA' END AS state FROM r",
        r=_REQUESTS,
    ),
)
def _(spark, sf):
    q = F.col("q")
    return _request_texts(spark, sf).select(
        "event_id",
        asked.tagged_brand(q).alias("brand"),
        asked.tagged_product(q).alias("product"),
        asked.tagged_state(q).alias("state"),
    )


@register(
    "fn_date_range",
    sql.query(
        """SELECT event_id, CASE WHEN half THEN DATE '2025-07-01' WHEN quarter <> '' THEN
  make_date(CAST(quarter_year AS INT), CAST(quarter AS INT) * 3 - 2, 1) WHEN len(years) > 0 THEN
  make_date(list_min(years), 1, 1) END AS requested_start,
CASE WHEN half THEN DATE '2026-01-01' WHEN quarter <> '' THEN
  CAST(make_date(CAST(quarter_year AS INT), CAST(quarter AS INT) * 3 - 2, 1) + INTERVAL 3 MONTH
  AS DATE) WHEN len(years) > 0 THEN make_date(list_max(years) + 1, 1, 1) END AS requested_end
FROM (SELECT event_id, contains(q, 'second half of 2025') OR contains(q, 'h2 2025') AS half,
  regexp_extract(q, '\\bq([1-4])\\s*(20\\d{2})\\b', 1) AS quarter,
  regexp_extract(q, '\\bq([1-4])\\s*(20\\d{2})\\b', 2) AS quarter_year,
  [CAST(y AS INT) FOR y IN regexp_extract_all(q, '\\b(20\\d{2})\\b', 1)] AS years
  FROM r)""",
        r=_REQUESTS,
    ),
)
def _(spark, sf):
    start, end = asked.requested_period(F.col("q"))
    return _request_texts(spark, sf).select(
        "event_id", start.alias("requested_start"), end.alias("requested_end")
    )


def _any(phrases):
    return "(" + " OR ".join(f"contains(q, '{p}')" for p in phrases) + ")"


@register(
    "fn_intent_flags",
    sql.query(
        "SELECT event_id, regexp_matches(q, '\\bhow much money\\b|\\btypically get back\\b|"
        "\\bdollar amount\\b') AS asks_relief_amount, contains(q, 'auto insurance') AND "
        "contains(q, 'claim') AS asks_auto_claims, "
        f"{_any(asked.SPIKE_PHRASES)} AS asks_spike, {_any(asked.LATE_PHRASES)} AS "
        f"asks_late_response, {_any(asked.RELIEF_PHRASES)} AS asks_relief_outcome, "
        f"{_any(asked.TREND_PHRASES)} AS asks_trend, {_any(asked.REGIONAL_PHRASES)} AS "
        f"asks_regional_banking, {_any(asked.NARRATIVE_WORDS)} AS asks_narrative FROM r",
        r=_REQUESTS,
    ),
)
def _(spark, sf):
    flags = asked.intent_flags(F.col("q"))
    return _request_texts(spark, sf).select(
        "event_id", *[flag.alias(name) for name, flag in flags.items()]
    )


_SENTENCE = "regexp_replace(c, '[“”\".!?:]', '', 'g')"
_ANSWER = (
    f"SELECT doc_id, {_SENTENCE} AS s, 'Found ' || n_chars || ' characters. Complaint ' || doc_id "
    f"|| ' reported: “' || {_SENTENCE} || '” Interpretation: from ' || source || '. "
    f"Limitations: only ' || lang || '.' AS answer FROM (SELECT *, {sql.collapse('text')} AS c "
    "FROM documents)"
)


@register(
    "fn_answer_parsing",
    sql.query(
        "SELECT d.doc_id, 'from ' || source || '.' AS interpretation, 'only ' || lang || '.' AS "
        "limitations, CAST(d.doc_id AS VARCHAR) AS quoted_id, s AS quote, 'Found ' || n_chars || "
        "' characters.' AS first_sentence, 1 AS sentence_count FROM a JOIN documents d USING "
        "(doc_id)",
        a=_ANSWER,
    ),
)
def _(spark, sf):
    quote = F.regexp_replace(t.collapse_whitespace(F.col("text")), "[“”\".!?:]", "")
    answers = _documents(spark, sf).select(
        "doc_id",
        F.concat(
            F.lit("Found "),
            F.col("n_chars").cast("string"),
            F.lit(" characters. Complaint "),
            F.col("doc_id").cast("string"),
            F.lit(" reported: “"),
            quote,
            F.lit("” Interpretation: from "),
            "source",
            F.lit(". Limitations: only "),
            "lang",
            F.lit("."),
        ).alias("answer"),
    )
    return parse_answer(answers).select(
        "doc_id",
        "interpretation",
        "limitations",
        F.col("quoted_ids")[0].alias("quoted_id"),
        F.col("quotes")[0].alias("quote"),
        F.col("sentences")[0].alias("first_sentence"),
        F.size("sentences").alias("sentence_count"),
    )


@register(
    "fn_vector_distance",
    f"""SELECT a.vec_id, round({sql.distance('a.embedding', 'b.embedding')}, 6) AS distance
FROM embeddings a JOIN embeddings b ON b.vec_id = a.label""",
)
def _(spark, sf):
    vectors = testdata.table(spark, sf, "embeddings")
    other = vectors.select(
        F.col("vec_id").alias("other_id"), F.col("embedding").alias("other_embedding")
    )
    return vectors.join(other, F.col("label") == F.col("other_id")).select(
        "vec_id",
        F.round(squared_l2(F.col("embedding"), F.col("other_embedding")), 6).alias("distance"),
    )


_SUPPLIER_TEXT = (
    "CASE c_custkey % 6 WHEN 0 THEN '  Cash App ' WHEN 1 THEN 'BLOCK INC' WHEN 2 THEN 'mohela' "
    "WHEN 3 THEN 'Early Warning Services LLC' WHEN 4 THEN '   ' ELSE c_name END"
)
_CLEANED_TEXT = f"coalesce(nullif(trim({_SUPPLIER_TEXT}), ''), {_SUPPLIER_TEXT})"
_ENTRIES = " UNION ALL ".join(
    f"SELECT '{key}' AS company_key, '{legal}' AS legal_company, '{brand}' AS brand_name, "
    f"{alias} AS is_alias"
    for key, (legal, brand, alias) in registry_entries().items()
)
_RESOLVED = f"""SELECT c_custkey, input_value, legal_company, brand_name, CASE WHEN is_alias THEN
  'curated_alias' WHEN NOT is_alias THEN 'normalized_legal_name' ELSE 'unresolved' END AS status,
  c_mktsegment
FROM (SELECT c_custkey, c_mktsegment, {_CLEANED_TEXT} AS input_value FROM customer)
LEFT JOIN ({_ENTRIES}) ON company_key = {sql.KEY.format('input_value')}"""


def _resolved(spark, sf):
    part = F.col("c_custkey") % 6
    named = testdata.table(spark, sf, "customer").select(
        "c_custkey",
        "c_mktsegment",
        F.when(part == 0, "  Cash App ")
        .when(part == 1, "BLOCK INC")
        .when(part == 2, "mohela")
        .when(part == 3, "Early Warning Services LLC")
        .when(part == 4, "   ")
        .otherwise(F.col("c_name"))
        .alias("company_text"),
    )
    return resolve_companies(named, "company_text")


@register(
    "jn_entity_resolution",
    sql.query(
        "SELECT c_custkey, input_value, legal_company, brand_name, status FROM resolved",
        resolved=_RESOLVED,
    ),
)
def _(spark, sf):
    return _resolved(spark, sf).select(
        "c_custkey", "input_value", "legal_company", "brand_name", "status"
    )


@register(
    "jn_entity_consistency",
    sql.query(
        "SELECT c_custkey, CASE WHEN c_custkey % 7 < 5 AND regexp_replace(lower(explicit), "
        "'[^a-z0-9]', '', 'g') <> regexp_replace(lower(legal_company), '[^a-z0-9]', '', 'g') THEN "
        "'company conflict' WHEN c_mktsegment = 'MACHINERY' AND brand_name <> 'Zelle' THEN "
        "'brand conflict' END AS conflict FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN "
        "'Acme Bank' ELSE upper(legal_company) END AS explicit FROM resolved WHERE legal_company IS "
        "NOT NULL)",
        resolved=_RESOLVED,
    ),
)
def _(spark, sf):
    rows = _resolved(spark, sf).where(F.col("legal_company").isNotNull())
    part = F.col("c_custkey") % 7
    explicit = F.when(part == 0, "Acme Bank").when(part < 5, F.upper("legal_company"))
    brand = F.when(F.col("c_mktsegment") == "MACHINERY", "Zelle")
    conflict = entity_conflicts(explicit, brand, F.col("legal_company"), F.col("brand_name"))
    return rows.select("c_custkey", conflict.alias("conflict"))
