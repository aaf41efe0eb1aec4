"""Complaint-shaped views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket_spark.constants import SOURCE_COLUMNS
from docket_spark.sources.complaints import ROW_ORDER

POPULATION = ("1996-01-01", "2000-12-31")
# What a table may come to in memory to be sent to every executor.
SMALL = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_small(frame: DataFrame) -> bool:
    """Whether the rows, counted and not estimated, come to less than ``SMALL``: 16 bytes a value and its text.

    Where a session has turned broadcasts off, no table is.
    """
    limit = frame.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if limit.startswith("-"):
        return False
    texts = [F.coalesce(F.octet_length(name), F.lit(0)) for name, kind in frame.dtypes if kind == "string"]
    row = sum(texts, F.lit(16 * len(frame.columns)))
    return (frame.agg(F.sum(row.cast("bigint"))).first()[0] or 0) < SMALL


def _day(name: str) -> Column:
    return F.col(name).cast("date").cast("string")


def raw_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as complaints, with the untidy spellings a raw snapshot has.

    Ids of filled lines are padded, dates of returned lines are ISO timestamps, flags come in
    mixed case, products of open orders are padded and one tag is blank; cleaning undoes all of
    it. Join strategies are left to Spark, which knows the table sizes. Order lines are the long table:
    customers join the orders before these meet the lines, and the orders come after the parts, so that lines
    with the same order's texts lie together, and are small when compressed, in what follows. Suppliers that
    are few are sent to where the lines are then, so that no exchange moves their names; many meet the lines
    first, when these are shortest.
    """
    read = lambda name: table(spark, sf_dir, name)
    orders = (
        read("orders")
        .join(read("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    suppliers = read("supplier").select("s_suppkey", "s_name")
    supplied, few = F.col("l_suppkey") == F.col("s_suppkey"), is_small(suppliers)
    rows = read("lineitem") if few else read("lineitem").join(suppliers, supplied)
    rows = rows.join(read("part"), F.col("l_partkey") == F.col("p_partkey")).join(
        orders, F.col("l_orderkey") == F.col("o_orderkey")
    )
    if few:
        rows = rows.join(F.broadcast(suppliers), supplied)
    number = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string")
    none = F.lit(None).cast("string")
    order = (
        "l_shipdate",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
    )
    return rows.select(
        F.when(F.col("l_returnflag") == "R", F.concat(_day("l_shipdate"), F.lit("T09:30:00Z")))
        .otherwise(_day("l_shipdate"))
        .alias("date_received"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit(" "), "p_type", F.lit("  ")))
        .otherwise(F.col("p_type"))
        .alias("product"),
        F.concat(F.lit("SIZE "), F.col("p_size").cast("string")).alias("sub_product"),
        F.col("p_brand").alias("issue"),
        F.col("p_name").alias("sub_issue"),
        F.concat(F.lit("line "), number).alias("consumer_complaint_narrative"),
        none.alias("company_public_response"),
        F.col("s_name").alias("company"),
        F.col("n_name").alias("state"),
        none.alias("zip_code"),
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit("  "))
        .otherwise(F.col("c_mktsegment"))
        .alias("tags"),
        F.col("o_orderpriority").alias("submitted_via"),
        _day("o_orderdate").alias("date_sent_to_company"),
        F.col("o_orderstatus").alias("company_response_to_consumer"),
        F.when(F.col("l_returnflag") == "A", F.lit("Yes"))
        .when(F.col("l_returnflag") == "R", F.lit("NO"))
        .alias("timely_response"),
        F.when(F.col("l_linestatus") == "F", F.concat(F.lit(" "), number, F.lit(" ")))
        .otherwise(number)
        .alias("complaint_id"),
        F.struct(*order).alias(ROW_ORDER),
    )


def with_defects(raw: DataFrame) -> DataFrame:
    """The same rows with unreadable dates and flags, blank ids and blank narratives in places."""
    quantity, tax = F.col(f"{ROW_ORDER}.l_quantity"), F.col(f"{ROW_ORDER}.l_tax")
    return raw.withColumns(
        {
            "date_received": F.when(quantity == 50, F.lit("not-date"))
            .when(quantity == 49, F.lit("1998-07"))
            .otherwise(F.col("date_received")),
            "timely_response": F.when(quantity == 48, F.lit("maybe")).otherwise(
                F.col("timely_response")
            ),
            "complaint_id": F.when(quantity == 47, F.lit("  ")).otherwise(F.col("complaint_id")),
            "consumer_complaint_narrative": F.when(tax == 0, F.lit(" ")).otherwise(
                F.col("consumer_complaint_narrative")
            ),
        }
    )


def with_registry_names(raw: DataFrame, supplier_key: Column | None = None) -> DataFrame:
    """The same rows where every tenth supplier trades under a spelling of a curated company."""
    key = F.substring_index("company", "#", -1).cast("bigint") if supplier_key is None else supplier_key
    return raw.withColumn(
        "company",
        F.when(key % 10 == 0, "BLOCK, INC.")
        .when(key % 10 == 1, "cash app")
        .when(key % 10 == 2, "Early Warning Services, LLC")
        .when(key % 10 == 3, "Mohela")
        .otherwise(F.col("company")),
    )


def narrative_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What other tables say of a document, by its id as text: order, customer and label columns.

    Rows of documents only, and without their texts, so that none of these joins moves a text.
    """
    read = lambda name: table(spark, sf_dir, name)
    ids = read("documents").select("doc_id")
    orders = read("orders").join(ids, F.col("o_orderkey") == F.col("doc_id"), "left_semi")
    ordered = (
        orders.join(read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(read("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(read("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .withColumnRenamed("o_orderkey", "doc_id")
    )
    labels = read("labels").join(ids, "doc_id", "left_semi")
    return ordered.join(labels, "doc_id", "full").select(
        F.col("doc_id").cast("string").alias("complaint_id"),
        _day("o_orderdate").alias("date_received"),
        F.col("c_mktsegment").alias("product"),
        F.col("n_name").alias("company"),
        F.col("r_name").alias("state"),
        F.col("o_orderpriority").alias("submitted_via"),
        _day("o_orderdate").alias("date_sent_to_company"),
        F.col("o_orderstatus").alias("company_response_to_consumer"),
        F.when(F.col("quality") == 1, F.lit("Yes"))
        .when(F.col("quality") == 0, F.lit("No"))
        .alias("timely_response"),
    )


def narrative_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as complaints with narratives, nothing else known of them."""
    own = {
        "complaint_id": F.col("doc_id").cast("string"),
        "issue": F.col("lang"),
        "sub_issue": F.col("source"),
        "consumer_complaint_narrative": F.col("text"),
    }
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(
        *[own.get(name, none).alias(name) for name in SOURCE_COLUMNS],
        F.struct(F.col("doc_id")).alias(ROW_ORDER),
    )


def narrative_complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as complaints with narratives; order, customer and label columns as metadata."""
    texts, facts = narrative_texts(spark, sf_dir), narrative_facts(spark, sf_dir)
    known = [name for name in facts.columns if name != "complaint_id"]
    return texts.drop(*known).join(facts, "complaint_id", "left").select(*texts.columns)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for every document: the stored ones, dealt out in turn by id."""
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    many = stored.agg(F.count(F.lit(1))).scalar()
    return (
        table(spark, sf_dir, "documents")
        .select(F.col("doc_id").cast("string").alias("complaint_id"), (F.col("doc_id") % many).alias("vec_id"))
        .join(stored, "vec_id")
        .select("complaint_id", "embedding")
    )
