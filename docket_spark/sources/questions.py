"""Question lists: one JSON array of objects with a text id and a text question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _is_text(name: str):
    return F.col(name).isNotNull() & (F.schema_of_variant(name) == "STRING")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Validated questions. Any malformed or repeated entry fails the read as a whole."""
    document = spark.read.text(path, wholetext=True).select(
        F.try_parse_json("value").alias("document")
    )
    shape = document.agg(
        F.count_if(
            F.coalesce(F.schema_of_variant("document").startswith("ARRAY<"), F.lit(False))
        ).alias("arrays"),
        F.count(F.lit(1)).alias("files"),
    ).first()
    if shape["files"] == 0 or shape["arrays"] != shape["files"]:
        raise ValueError("questions JSON must be an array")
    items = (
        document.select(
            F.expr("try_variant_get(document, '$', 'array<variant>')").alias("items")
        )
        .select(F.posexplode("items").alias("position", "item"))
        .select(
            "position",
            F.expr("try_variant_get(item, '$.id', 'variant')").alias("id"),
            F.expr("try_variant_get(item, '$.question', 'variant')").alias("question"),
        )
    )
    valid = _is_text("id") & _is_text("question")
    if items.where(~F.coalesce(valid, F.lit(False))).limit(1).count():
        raise ValueError("each question must contain string id and question fields")
    questions = items.select(
        "position",
        F.expr("variant_get(id, '$', 'string')").alias("id"),
        F.expr("variant_get(question, '$', 'string')").alias("question"),
    )
    repeated = (
        questions.groupBy("id").count().where("count > 1").orderBy("id").limit(1).collect()
    )
    if repeated:
        raise ValueError(f"duplicate question id: {repeated[0]['id']}")
    return questions
