"""Operators against brute force on random small inputs, hot groups included."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from docket_spark.operators.profiling import content_fingerprint, null_profile, schema_profile
from docket_spark.operators.ranking import diversify, first_rows, pick_examples, repeated_themes, stratified_sample
from docket_spark.operators.totals import joined_text, with_share


def diversify_by_walking(items, target):
    """items: (rank, label) in rank order."""
    if len(items) <= target:
        return items
    chosen, labels = [], set()
    for item in items:
        if item[1] not in labels and len(chosen) < target:
            chosen.append(item)
            labels.add(item[1])
    for item in items:
        if len(chosen) == target:
            break
        if item not in chosen:
            chosen.append(item)
    return chosen


@pytest.mark.parametrize("seed", range(4))
def test_diversify_equals_the_walk(spark, seed):
    rng = random.Random(seed)
    data, expected = [], []
    for query, size in (("hot", 60), ("small", 3), ("exact", 6), ("one", 1), ("few", 15)):
        labels = rng.choice([2, 4, 9])
        items = [(rank, rng.choice([None, *"abcdefgh"][:labels])) for rank in range(1, size + 1)]
        data += [(query, rank, label, "x") for rank, label in items]
        walk = diversify_by_walking([(r, lab or "") for r, lab in items], 6)
        expected += [(query, i + 1, item[0]) for i, item in enumerate(walk)]
    frame = spark.createDataFrame(data, "q string, rank int, label string, other string")
    kept = diversify(frame.repartition(5), "q", ["label", "other"], "rank", 6)
    assert sorted(rows(kept.select("q", "position", "rank"))) == sorted(expected)


def examples_by_walking(items, n):
    taken, ids, prints = [], set(), set()
    for rank, item, quote in items:
        mark = quote.lower().replace(" ", "")
        if not quote or item in ids or mark in prints or len(taken) == n:
            continue
        taken.append((item, quote, rank))
        ids.add(item)
        prints.add(mark)
    return taken


@pytest.mark.parametrize("seed", range(6))
def test_examples_equal_the_walk_with_repeated_ids_and_quotes(spark, seed):
    rng = random.Random(seed)
    data, expected = [], []
    for query, size in (("hot", 80), ("b", 5), ("c", 12)):
        items = [
            (rank, f"id{rng.randrange(4)}", rng.choice(["", "a b", "A B", "ab", "c", "d", "e"]))
            for rank in range(size)
        ]
        data += [(query, *item) for item in items]
        walk = examples_by_walking(items, 3)
        expected += [(query, i + 1, *entry) for i, entry in enumerate(walk)]
    frame = spark.createDataFrame(data, "q string, rank int, id string, quote string").withColumn(
        "print", F.lower(F.replace("quote", F.lit(" "), F.lit("")))
    )
    picked = pick_examples(frame.repartition(5), "q", "id", "quote", "print", "rank", 3)
    assert sorted(rows(picked)) == sorted(expected)


def test_first_rows_beyond_the_engine_threshold(spark):
    data = spark.range(5000).select((F.col("id") % 2).alias("g"), F.col("id"))
    small = first_rows(data, ["g"], [F.col("id").desc()], 40)
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10")
    try:
        large = first_rows(data.repartition(6), ["g"], [F.col("id").desc()], 40)
        assert sorted(rows(large)) == sorted(rows(small))
    finally:
        spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")


def test_hot_groups_are_cut_before_the_exchange(spark):
    data = spark.range(100).select((F.col("id") % 2).alias("g"), "id")
    plan = first_rows(data, ["g"], [F.col("id").asc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_themes_need_two_and_keep_three(spark):
    labels = [("Account access", "Frozen")] * 3 + [("Fees", " Unexpected  fee")] * 2 + [("Fees", "once"), ("", "x"), ("", "x")]
    labels += [("b", None)] * 2 + [("B", "z")] * 2 + [("a", "")] * 2
    frame = spark.createDataFrame([("q", *pair) for pair in labels], "q string, issue string, sub_issue string")
    trimmed = F.trim(F.regexp_replace("sub_issue", r"\s+", " "))
    assert rows(repeated_themes(frame, "q", F.col("issue"), trimmed, 5).orderBy("theme_no").drop("q")) == [
        ("Account access", "Frozen", 3, 1),
        ("a", None, 2, 2),
        ("b", None, 2, 3),
        ("B", "z", 2, 4),
        ("Fees", "Unexpected fee", 2, 5),
    ]


def test_sample_does_not_depend_on_partitions(spark):
    data = spark.range(900).select(F.when(F.col("id") < 600, "hot").otherwise("cold").alias("s"), F.col("id").cast("string").alias("k"))
    one = sorted(rows(stratified_sample(data, ["s"], "k", 7)))
    assert one == sorted(rows(stratified_sample(data.repartition(9), ["s"], "k", 7)))
    assert len(one) == 14


def test_joined_text_in_chunks_keeps_the_order(spark):
    parts = spark.range(2500).select(F.lit("q").alias("q"), F.col("id"), F.col("id").cast("string").alias("t"))
    expected = ",".join(str(i) for i in range(2500))
    shuffled = parts.repartition(8)
    for chunk in (None, F.floor(F.col("id") / 100)):
        assert rows(joined_text(shuffled, ["q"], ["id"], "t", ",", "all", chunk)) == [("q", expected)]


def test_share_of_an_empty_slice(spark):
    empty = spark.createDataFrame([], "issue string, complaint_count bigint")
    assert rows(with_share(empty)) == []


def test_profiles(spark):
    frame = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(null_profile(frame)) == [("b", 1)]
    assert rows(schema_profile(frame).orderBy("ordinal"))[1] == (1, "b", "string", True, None)
    assert rows(content_fingerprint(frame)) == rows(content_fingerprint(frame.repartition(3).select("b", "a")))
    assert rows(content_fingerprint(frame)) != rows(content_fingerprint(frame.limit(1)))
