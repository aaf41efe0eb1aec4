"""Index building and retrieval."""

import random
import re
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from docket_spark.functions.embedding import hashed_terms
from docket_spark.operators import blocks, pivots
from docket_spark.operators.blocks import nearest_batch
from docket_spark.operators.nearest import nearest_by_key
from docket_spark.plans import retrieval
from docket_spark.plans.publish import current_folder, publish_generation
from docket_spark.plans.retrieval import NarrativeFilters

SCHEMA = (
    "complaint_id string, consumer_complaint_narrative string, product string, sub_product string, "
    "issue string, sub_issue string, company string, company_key string, brand_name string, "
    "date_received date, state string, timely_response boolean, company_response_to_consumer string"
)


def complaint(i, narrative=None, day=date(2025, 1, 1), timely=False):
    return (
        i, narrative or f"narrative {i}", "Payments", "", "Issue", "", "Block, Inc.", "block inc",
        "Cash App", day, "CA", timely, "Closed",
    )


@pytest.fixture
def silver_root(spark, tmp_path):
    data = [complaint("1"), complaint("2"), complaint("3"), complaint("4", "  ")]
    frame = spark.createDataFrame(data, SCHEMA)
    root = str(tmp_path / "silver")
    publish_generation(spark, root, lambda f: frame.write.parquet(f"{f}/complaints"), lambda f: {})
    return root


def test_index_counts_and_limit(spark, tmp_path, silver_root):
    root = str(tmp_path / "index")
    made = retrieval.build_index(spark, silver_root, root, hashed_terms(8), limit=2)
    assert (made["documents_indexed"], made["eligible_silver_narratives"]) == (2, 3)
    assert made["metadata_schema_version"] == 2
    index, digest = retrieval.open_index(spark, root)
    assert sorted(r["complaint_id"] for r in index.collect()) == ["1", "2"] and len(digest) == 64
    full = retrieval.build_index(spark, silver_root, root, hashed_terms(8))
    assert full["documents_indexed"] == 3 and full["reconciles_to_eligible_silver"]
    with pytest.raises(ValueError, match="below 1"):
        retrieval.build_index(spark, silver_root, root, hashed_terms(8), limit=0)


def test_failed_build_keeps_the_current_index(spark, tmp_path, silver_root):
    root = str(tmp_path / "index")
    retrieval.build_index(spark, silver_root, root, hashed_terms(8))
    before = current_folder(spark, root)
    with pytest.raises(Exception, match="one vector per text"):
        retrieval.build_index(spark, silver_root, root, lambda texts: np.zeros((len(texts) + 1, 4)))
    assert current_folder(spark, root) == before


def test_stale_or_foreign_index_is_refused(spark, tmp_path, silver_root):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        retrieval.open_index(spark, root)
    retrieval.build_index(spark, silver_root, root, hashed_terms(8))
    with pytest.raises(ValueError, match="another collection"):
        retrieval.open_index(spark, root, embedding_model="other")
    publish_generation(spark, root, lambda f: None, lambda f: {"metadata_schema_version": 1})
    with pytest.raises(ValueError, match="older metadata schema"):
        retrieval.open_index(spark, root)


def test_embedding_sees_small_batches(spark):
    from docket_spark.functions.embedding import with_embedding

    def limited(texts):
        assert len(texts) <= 10
        return hashed_terms(8)(texts)

    frame = spark.range(55).select(F.concat(F.lit("text "), F.col("id").cast("string")).alias("t"))
    assert with_embedding(frame, "t", limited, batch=10).count() == 55


def test_the_column_embedder_gives_the_vectors_of_the_function(spark):
    from docket_spark.functions.embedding import with_embedding

    texts = ["", "Late fee, late-fee!", "naïve café 日本 x_y", "a b " * 500, None, "ÀÉ It's 3.14"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for dimensions in (1, 8, 300):
        embedder = hashed_terms(dimensions)
        found = [r["embedding"] for r in with_embedding(frame, "t", embedder).collect()]
        assert np.allclose(np.array(found), embedder(texts), atol=1e-6)
    plan = with_embedding(frame, "t", hashed_terms(8))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_the_column_embedder_reads_a_text_once(spark):
    import checks.retrievals  # noqa: F401
    from checks.registry import QUERIES
    from docket_spark.functions.embedding import with_embedding

    frame = spark.createDataFrame([("a b",)], "t string")
    plan = with_embedding(frame, "t", hashed_terms(8))._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan
    query = QUERIES["ret_index_embedding"](spark, "/root/testdata/sf0.001")
    assert query._jdf.queryExecution().executedPlan().toString().count("md5(") == 1


def test_a_narrative_is_moved_once(spark):
    from checks import registry

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = registry.index(spark, "/root/testdata/sf0.001")
        plan = spark._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    moved = [x for x in plan.split("\n\n") if re.match(r"\(\d+\) Exchange\b", x)]
    texts = ("text#", "consumer_complaint_narrative#", "document#", "excerpt#")
    assert sum(any(name in x.split("Arguments")[0] for name in texts) for x in moved) == 1


def test_document_and_metadata(spark):
    data = [complaint("00123", "Late-fee dispute", None, None), complaint("5", "x" * 6001)]
    late, long = retrieval.index_rows(spark.createDataFrame(data, SCHEMA)).orderBy("complaint_id").select(
        "document", "date_received_ordinal", "narrative_truncated", retrieval.metadata_map().alias("m"),
        retrieval.excerpt_of_document(F.col("document")).alias("excerpt"),
    ).collect()
    assert late["document"] == (
        "Complaint ID: 00123\nCompany: Block, Inc.\nProduct: Payments\nSub-product: Unknown\n"
        "Issue: Issue\nSub-issue: Unknown\nConsumer narrative:\nLate-fee dispute"
    )
    assert late["excerpt"] == "Late-fee dispute" and late["date_received_ordinal"] is None
    assert late["m"]["complaint_id"] == "00123" and late["m"]["timely_response"] == ""
    assert late["m"]["narrative_truncated"] == "false" and "date_received_ordinal" not in late["m"]
    assert long["narrative_truncated"] and len(long["excerpt"]) == 6000
    assert long["m"]["timely_response"] == "false"
    assert long["m"]["date_received_ordinal"] == str(date(2025, 1, 1).toordinal())


def test_excerpt_splits_at_the_first_marker_only(spark):
    frame = spark.createDataFrame([("a\nConsumer narrative:\nb Consumer narrative:\nc",), ("none",)], "d string")
    assert rows(frame.select(retrieval.excerpt_of_document(F.col("d")))) == [("b Consumer narrative:\nc",), ("none",)]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    data = []
    for i in range(120):
        vector = [float(rng.randrange(5)) for _ in range(4)]
        data.append((str(i), vector, rng.choice(["A", "B"]) if i % 9 else None,
                     rng.choice("xy"), date(2025, 1, 1 + i % 28)))
    frame = spark.createDataFrame(data, "complaint_id string, embedding array<float>, company string, issue string, date_received date")
    return data, frame.repartition(5)


def brute(data, vector, keep, k):
    scored = sorted(
        (sum((a - b) ** 2 for a, b in zip(row[1], vector)), row[0]) for row in data if keep(row)
    )
    return [(i + 1, key, distance) for i, (distance, key) in enumerate(scored[:k])]


def test_filtered_nearest_equals_brute_force(spark, corpus):
    data, index = corpus
    filters = NarrativeFilters(company=" A ", issue="x", start=date(2025, 1, 3), end=date(2025, 1, 20))
    hits = retrieval.retrieve(index, [1.0, 2.0, 3.0, 0.0], filters, 7)
    expected = brute(data, [1, 2, 3, 0], lambda r: r[2] == "A" and r[3] == "x" and date(2025, 1, 3) <= r[4] < date(2025, 1, 20), 7)
    assert rows(hits.select("rank", "complaint_id", "distance")) == expected


ASKED = (
    "question_id string, query_vector array<double>, company string, issue string, first date, last date, top_k int"
)


def asked(spark):
    day = lambda n: date(2025, 1, n)
    rows = [
        ("r1", [0.0, 0.0, 0.0, 0.0], "A", None, None, None, 3),
        ("r2", [4.0, 1.0, 0.0, 2.0], None, "y", day(4), None, 40),
        ("r3", [2.0, 2.0, 2.0, 2.0], None, None, day(3), day(9), 1),
        ("r4", [1.0, 1.0, 1.0, 1.0], "Z", "x", None, None, 5),
        ("r5", [2.0, 2.0, 2.0, 2.0], "B", "x", None, day(1), 5),
        ("r6", [1.0, 1.0, 1.0, 1.0], None, None, None, None, 0),
        ("r7", [1.0, 1.0], None, None, None, None, 5),
        ("r8", None, None, None, None, None, 5),
    ]
    rows += [(f"s{n}", [n % 5.0, n % 3.0, 1.0, 0.0], None, None, None, None, n % 9) for n in range(40)]
    return rows, spark.createDataFrame(rows, ASKED)


def all_brute(data, rows, k=None):
    expected = []
    for name, vector, company, issue, first, last, top_k in rows:
        if vector is None or len(vector) != 4 or (k is None and top_k < 1):
            continue

        def keep(r):
            return (
                (company is None or r[2] == company) and (issue is None or r[3] == issue)
                and (first is None or r[4] >= first) and (last is None or r[4] < last)
            )

        expected += [(name, *hit) for hit in brute(data, vector, keep, k or top_k)]
    return sorted(expected)


def found(hits):
    return sorted(rows(hits.select("question_id", "rank", "complaint_id", "distance")))


DAYS = {"date_received": ("first", "last")}


def test_many_requests_equal_brute_force(spark, corpus, monkeypatch):
    data, index = corpus
    listed, requests = asked(spark)
    # One block and cell, many of each, and distances computed a few at a time.
    for sizes in ({}, {"cell_bytes": 700, "block_bytes": 300}):
        for k in (5, "top_k"):
            hits = nearest_batch(index, requests, k, ("company", "issue"), DAYS, **sizes)
            assert found(hits) == all_brute(data, listed, None if k == "top_k" else k)
    hits = nearest_batch(index, requests, 5)
    free = [(name, vector, None, None, None, None, 5) for name, vector, *_ in listed]
    assert found(hits) == all_brute(data, free)
    keyed = nearest_by_key(index, requests.where("question_id = 'r1'").drop("issue"), ["company"], 5)
    assert found(keyed) == [e for e in all_brute(data, listed, 5) if e[0] == "r1"]
    assert nearest_batch(index, requests.limit(0), 5).count() == 0
    assert nearest_batch(index.limit(0), requests, 5, ("company",)).count() == 0


def test_one_meeting_equals_brute_force_in_small_steps(monkeypatch):
    rng = np.random.default_rng(3)
    points = rng.integers(0, 3, (50, 4)).astype(float)  # many ties
    asked_points = rng.integers(0, 3, (9, 4)).astype(float)
    held = pa.table({"id": [f"d{n:02}" for n in range(50)], "embedding": points.tolist()})
    wanted = pa.table({"query_vector": asked_points.tolist(), "_k": pa.array([0, 1, 2, 3, 50, 60, 7, 7, 7])})
    for product in (1, 60, 10_000):
        monkeypatch.setattr(blocks, "PRODUCT", product)
        i, j, distance = blocks.meet(wanted, held, "id")
        got = list(zip(i.tolist(), j.tolist(), distance.tolist()))
        want = []
        for n, point in enumerate(asked_points):
            far = ((points - point) ** 2).sum(axis=1)
            best = sorted(range(50), key=lambda d: (far[d], d))[: wanted["_k"][n].as_py()]
            want += [(n, d, far[d]) for d in best]
        assert got == want


def test_a_search_is_one_plan_and_documents_of_other_routes_stay(spark, corpus):
    data, index = corpus
    requests = spark.createDataFrame(
        [("q", [0.0] * 4, "A", None, None, None, 3)], ASKED
    )
    plan = nearest_batch(index, requests, 3, ("company",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def rows_read(frame):
    """Rows that the scans of an executed query gave out."""
    frame.collect()
    plan, total, todo = frame._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(n) for n in range(children.size())]
    return total


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = random.Random(9)
    data = []
    for n in range(6000):
        centre = rng.randrange(20)
        vector = [float(np.float32(centre * (1 + d) % 7 * 10 + rng.gauss(0, 0.3))) for d in range(6)]
        data.append((f"{n:04}", vector, rng.choice("AB"), rng.choice("xy"), date(2025, 1, 1 + n % 28)))
    frame = spark.createDataFrame(
        data, "complaint_id string, embedding array<float>, company string, issue string, date_received date"
    )
    folder = str(tmp_path_factory.mktemp("layout")) + "/one"
    pivots.write_layout(frame, folder, pivots=20)
    return data, frame, folder


def test_pruned_search_reads_fewer_rows_and_finds_the_same(spark, clustered):
    data, frame, folder = clustered
    assert pivots.read_rows(spark, folder).count() == len(data)
    for n, k in ((5, 1), (77, 10), (1234, 300)):
        vector = data[n][1]
        for predicate in (None, F.col("company") == "A", F.col("company") == "none"):
            keep = lambda r: predicate is None or (r[2] == "A" and "none" not in str(predicate))  # noqa: E731, B023
            found_rows = rows(
                pivots.nearest_pruned(spark, folder, vector, k, predicate).select("rank", "complaint_id", "distance")
            )
            assert [(r, i) for r, i, _ in found_rows] == [(r, i) for r, i, _ in brute(data, vector, keep, k)]
    all_rows = rows_read(pivots.read_rows(spark, folder))
    some = pivots.candidates(spark, folder, data[5][1], 3)
    assert rows_read(some) < all_rows / 5
    assert some.count() >= 3


def test_pruned_batch_finds_what_the_full_batch_finds(spark, clustered):
    data, frame, folder = clustered
    listed = [
        (f"q{n}", data[n * 50][1], ("A", None, "C")[n % 3], (None, "x")[n % 2], None, date(2025, 1, 9) if n % 5 == 0 else None, n % 8)
        for n in range(60)
    ]
    requests = spark.createDataFrame(listed, ASKED)
    for k in (4, "top_k"):
        full = nearest_batch(frame, requests, k, ("company", "issue"), DAYS)
        few = pivots.nearest_batch_pruned(spark, folder, requests, k, ("company", "issue"), DAYS)
        assert found(few) == found(full) and few.count()


def test_pivots_of_few_or_no_rows(spark, tmp_path):
    schema = "complaint_id string, embedding array<float>"
    for name, data in (("none", []), ("same", [(str(n), [1.0, 2.0]) for n in range(5)] + [("x", None)])):
        folder = str(tmp_path / name)
        pivots.write_layout(spark.createDataFrame(data, schema), folder)
        asks = spark.createDataFrame([("q", [0.0, 0.0])], "question_id string, query_vector array<double>")
        want = min(3, len([1 for _, v in data if v]))
        assert pivots.nearest_pruned(spark, folder, [0.0, 0.0], 3).count() == want
        assert pivots.nearest_batch_pruned(spark, folder, asks, 3).count() == want


def test_outcomes_of_many_requests(spark, tmp_path, silver_root):
    root = str(tmp_path / "index")
    schema = "question_id string, query_text string, top_k int, query_vector array<float>, company string, start date, end date"
    vector = [float(x) for x in hashed_terms(8)(["narrative 2"])[0]]
    day = date(2025, 1, 1)
    asks = [
        ("ok", "fees", 2, vector, " Block, Inc. ", None, None),
        ("empty", "fees", 2, vector, "Other", None, None),
        ("days", "fees", 2, vector, None, day, day),
        ("blank", " ", 2, vector, None, None, None),
        ("zero", "fees", 0, vector, None, None, None),
        ("width", "fees", 2, vector[:3], None, None, None),
        ("absent", "fees", 2, None, None, None, None),
    ]
    requests = spark.createDataFrame(asks, schema)

    def outcomes():
        hits, status = retrieval.answer_requests(spark, root, requests)
        return hits, {r["question_id"]: (r["status"], r["hit_count"]) for r in status.collect()}

    hits, lost = outcomes()
    assert hits is None and lost["ok"] == ("index_error", 0) and lost["blank"][0] == "configuration_error"
    retrieval.build_index(spark, silver_root, root, hashed_terms(8))
    hits, told = outcomes()
    wrong = ("configuration_error", 0)
    assert told == {
        "ok": ("ok", 2), "empty": ("empty", 0), "days": wrong, "blank": wrong, "zero": wrong,
        "width": ("index_error", 0), "absent": ("index_error", 0),
    }
    assert {(r["question_id"], r["rank"]) for r in hits.collect()} == {("ok", 1), ("ok", 2)}
    diverse, _ = retrieval.answer_requests(spark, root, requests, diversified=True)
    assert {(r["question_id"], r["position"]) for r in diverse.collect()} == {("ok", n) for n in (1, 2, 3)}
    publish_generation(spark, root, lambda f: None, lambda f: {"metadata_schema_version": 1})
    assert outcomes()[1]["ok"] == wrong


def test_invalid_requests(corpus):
    with pytest.raises(ValueError):
        NarrativeFilters(start=date(2025, 1, 1), end=date(2025, 1, 1))
    with pytest.raises(ValueError):
        retrieval.retrieve(corpus[1], [0.0] * 4, k=0)
    assert NarrativeFilters().predicate() is None


def test_filters_reach_the_scan(spark, tmp_path, silver_root):
    root = str(tmp_path / "index")
    retrieval.build_index(spark, silver_root, root, hashed_terms(8))
    index, _ = retrieval.open_index(spark, root)
    hits = retrieval.retrieve(index, [0.0] * 8, NarrativeFilters(product="Payments", state="CA"), 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(state,CA)" in plan and "PartitionFilters: [isnotnull(product" in plan


def test_product_labels_stay_texts(spark, tmp_path):
    rows = [("1", "007"), ("2", "08"), ("3", "2024-01-01"), ("4", None)]
    frame = spark.createDataFrame(rows, "complaint_id string, product string")
    frame.write.partitionBy("product").parquet(str(tmp_path / retrieval.TABLE))
    found = retrieval.read_index(spark, str(tmp_path)).collect()
    assert sorted((r["complaint_id"], r["product"]) for r in found) == rows
