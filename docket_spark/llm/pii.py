"""Personal data: known forms, and identifiers found from the contexts that known ones occur in.

Known forms (e-mail, IP address, card, phone) are the seeds of a bootstrap. Every token with a digit or
an @ is an instance, a number written in groups as a whole, and the words around it make its lexical patterns: the word before, the two words
before, the word after, and the word on either side. Spark keeps the graph of patterns and instances
with the number of documents' occurrences on each edge, and scores it in rounds. A pattern's score is
the share of its occurrences that lie on trusted instances, lowered where it has few different ones; an
instance's score is the chance that at least one of its patterns is right. Seeds stay trusted, and an
instance whose score reaches ``trust`` becomes trusted for the next round. After the last round, tokens
next to a pattern of high score are reported unless they overlap a known form.

All of it is column functions, joins and aggregates. Edges are counted before they are joined, so a
frequent word or token is one row per task, and joins are on narrow rows that adaptive execution can
split. The narrow per-document findings are written to the checkpoint folder once.

Defined cases: a null text is the empty text. Places are code points, end exclusive. A pattern needs
``support`` different trusted instances. Ids are passed on as they are; rows that repeat are searched
each; an empty table gives an empty result. Columns of any other name are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket_spark.llm import spans
from docket_spark.llm.columns import column, text_of
from docket_spark.session import cut_lineage

# Lookbehinds and possessive repeats only spare retries inside one run; the matches are those of the
# plain patterns.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "context")

_IP_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_BLANK = r"\x20\x09-\x0D"
# A number written in groups is one token, so that its first and last words are its context.
_GROUPED = rf"[^{_BLANK}0-9@+]*+(?:{PHONE}|(?=(?:[0-9][\x20-]?){{13}}){CARD})"
TOKEN = rf"(?<![^{_BLANK}])(?:{_GROUPED}|[^{_BLANK}0-9@]*+[0-9@])[^{_BLANK}]*+"
_EDGE = r"""^[("'\[<{]+|[)"'\]>},.;:!?]+$"""
NEARBY = 80

ROUNDS, TRUST, SURPRISE, SUPPORT = 3, 0.9, 2.0, 5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def known_forms(body: Column) -> Column:
    """The known forms in ``body`` as an array of (number, kind, start, end)."""

    def is_ip(x: Column) -> Column:
        return x["value"].rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")

    def is_card(x: Column) -> Column:
        digits = _digits(x["value"])
        sized = F.length(digits).between(13, 19)
        return F.when(sized, F.call_function("luhn_check", digits)).otherwise(F.lit(False))

    def is_phone(x: Column) -> Column:
        return F.length(_digits(x["value"])).between(9, 15)

    return F.concat(
        spans.marked(spans.find(body, EMAIL), 0, "email"),
        spans.marked(F.filter(spans.find(body, IP), is_ip), 1, "ip"),
        spans.marked(F.filter(spans.find(body, CARD), is_card), 2, "card"),
        spans.marked(F.filter(spans.find(body, PHONE), is_phone), 3, "phone"),
    )


def _words(text: Column) -> Column:
    """Lower-cased words of ``text`` without the marks around them."""
    tidy = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x20\x09-\x0D:=#]+", "")
    return F.filter(F.split(tidy, rf"[{_BLANK}]+"), lambda w: w != "")


def _instances(body: Column) -> Column:
    """Tokens with a digit or an @: (start, end, value, patterns), without the marks around them."""

    def one(x: Column) -> Column:
        lead = F.length(x["value"]) - F.length(F.regexp_replace(x["value"], _EDGE.split("|")[0], ""))
        tail = F.length(x["value"]) - F.length(F.regexp_replace(x["value"], _EDGE.split("|")[1], ""))
        before = F.slice(F.reverse(_words(F.substring(x["before"], -NEARBY, NEARBY))), 1, 2)
        after = _words(F.substring(x["after"], 1, NEARBY))
        left, left2, right = F.get(before, F.lit(0)), F.get(before, F.lit(1)), F.get(after, F.lit(0))
        patterns = F.array(
            F.concat(left, F.lit(" _")),
            F.concat(left2, F.lit(" "), left, F.lit(" _")),
            F.concat(F.lit("_ "), right),
            F.concat(left, F.lit(" _ "), right),
        )
        return F.struct(
            (x["start"] + lead).alias("start"),
            (x["end"] - tail).alias("end"),
            F.regexp_replace(x["value"], _EDGE, "").alias("value"),
            F.array_compact(patterns).alias("patterns"),
        )

    made = F.transform(spans.find(body, TOKEN), one)
    return F.filter(made, lambda x: x["value"].rlike("[0-9@]") & (F.length(x["value"]) >= 4))


def _score(edges: DataFrame, seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Patterns with their scores and instances with theirs, after the last round.

    ``edges``: pattern, value, many. ``seeds``: value.
    """
    trusted = seeds.select("value", F.lit(1.0).alias("trust"))
    for _ in range(ROUNDS):
        patterns = (
            edges.join(trusted, "value", "left")
            .groupBy("pattern")
            .agg(
                F.sum(F.col("many") * F.coalesce("trust", F.lit(0.0))).alias("right"),
                F.sum("many").alias("all"),
                F.count("trust").alias("different"),
            )
            .where(F.col("different") >= SUPPORT)
            .select("pattern", (F.col("right") / (F.col("all") + SURPRISE)).alias("score"))
        )
        patterns = cut_lineage(patterns)
        unsure = F.least("score", F.lit(0.999))
        instances = (
            edges.join(patterns.where(F.col("score") >= TRUST / 2), "pattern")
            .groupBy("value")
            .agg((1 - F.exp(F.sum(F.log(1 - unsure)))).alias("score"))
        )
        found = instances.where(F.col("score") >= TRUST)
        trusted = (
            seeds.select("value", F.lit(1.0).alias("trust"))
            .union(found.select("value", F.col("score").alias("trust")))
            .groupBy("value")
            .agg(F.max("trust").alias("trust"))
        )
    return patterns, trusted


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: its id, known (the known forms) and added (found by context), arrays of
    (number, kind, start, end)."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        column(doc_id).alias("id"),
        text_of(text).alias("body"),
    )
    body = F.col("body")
    found = cut_lineage(
        rows.select(
            "row", "id", known_forms(body).alias("known"), _instances(body).alias("instances")
        )
    )
    seen = found.where(F.size("instances") > 0).select("row", "known", F.inline("instances"))
    overlaps = F.exists(
        "known", lambda k: (k["start"] < F.col("end")) & (F.col("start") < k["end"])
    )
    seen = seen.withColumn("is_seed", overlaps).drop("known")
    counted = (
        seen.withColumn("pattern", F.explode("patterns"))
        .groupBy("pattern", "value")
        .agg(F.count(F.lit(1)).alias("many"))
    )
    edges = cut_lineage(counted)
    seeds = cut_lineage(seen.where("is_seed").select("value").distinct())
    patterns, trusted = _score(edges, seeds)
    # Sure patterns discover: a token next to one is reported if the graph trusts the token.
    sure = patterns.where(F.col("score") >= TRUST).select("pattern")
    added = (
        seen.where("not is_seed")
        .withColumn("pattern", F.explode("patterns"))
        .join(sure, "pattern", "left_semi")
        .join(trusted.select("value"), "value", "left_semi")
        .groupBy("row")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("places"))
    )
    none = F.array().cast("array<struct<start:long,end:long>>")
    return found.join(added, "row", "left").select(
        F.col("id").alias(doc_id),
        "known",
        spans.marked(F.coalesce("places", none), 4, "context").alias("added"),
    )
