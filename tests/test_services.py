"""Coverage, companies, sources, publication and refresh."""

import json
import shutil
from datetime import date

import pytest
from conftest import rows
from fixtures import RAW_SCHEMA, SILVER_SOURCE, raw_row
from pyspark.sql import functions as F

from docket_spark.constants import METRIC_TABLES
from docket_spark.functions.embedding import hashed_terms
from docket_spark.plans import binding, bronze, gold, retrieval, silver
from docket_spark.plans.companies import entity_conflicts, resolve_companies
from docket_spark.plans.coverage import decide
from docket_spark.plans.parts import read_current
from docket_spark.plans.publish import (
    current_folder,
    publish_generation,
    require_separate,
    write_run,
)
from docket_spark.sources.complaints import ROW_ORDER, read_snapshot, read_table
from docket_spark.sources.manifests import read_capabilities
from docket_spark.sources.questions import read_questions
from docket_spark.streaming import refresh

CAPABILITIES = "snapshot_start date, snapshot_end date, has_consumer_narratives boolean, has_verified_relief_amount boolean, supports_auto_insurance_claims boolean"
REQUEST = "id int, requested_start date, requested_end date, needs_relief_amount boolean, needs_auto_claims boolean"


def decided(spark, capabilities, *requests):
    have = spark.createDataFrame([capabilities], CAPABILITIES)
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], REQUEST)
    return [
        (r["answerable"], r["required_capability"], r["reason"])
        for r in decide(asked, have).orderBy("id").collect()
    ]


def test_bound_companies(spark):
    rows = spark.createDataFrame(
        [("a", 0, "Block, Inc."), ("a", 1, " "), ("b", 0, "Zelle")], "question_id string, row_index int, company string"
    )
    asks = [("a", 0, None), ("a", 0, "BLOCK INC"), ("a", 0, "Zelle"), ("a", 1, None), ("a", 2, "x"), ("b", None, "y"), ("c", 0, None)]
    requests = spark.createDataFrame(asks, "question_id string, bind_row int, company string")
    bound = binding.bind_companies(requests, rows).select("question_id", "company", "binding_error")
    found = sorted((tuple(r) for r in bound.collect()), key=str)
    assert found == sorted([
        ("a", "Block, Inc.", None), ("a", "Block, Inc.", None), ("a", "Zelle", binding.OTHER_COMPANY),
        ("a", None, binding.BLANK_COMPANY), ("a", "x", binding.MISSING_ROW), ("b", "y", None),
        ("c", None, binding.MISSING_ROW),
    ], key=str)


def test_coverage_rules_in_order(spark):
    snapshot = (date(2024, 1, 1), date(2025, 12, 31), True, False, False)
    result = decided(
        spark,
        snapshot,
        (date(2023, 3, 1), date(2023, 4, 1), False, False),
        (date(2023, 3, 1), None, True, True),
        (None, None, False, True),
        (date(2025, 12, 1), date(2026, 1, 1), False, False),
        (date(2025, 5, 1), date(2025, 5, 1), False, False),
        (None, date(2026, 1, 2), False, False),
        (None, None, False, False),
    )
    assert [r[:2] for r in result] == [
        (False, "date_range"), (False, "verified_relief_amount"), (False, "auto_insurance_claims"),
        (True, None), (False, "date_range"), (False, "date_range"), (True, None),
    ]
    assert "2024-01-01" in result[0][2] and "2025-12-31" in result[5][2]
    small = (date(2022, 5, 1), date(2022, 6, 30), True, False, False)
    (late,) = decided(spark, small, (date(2022, 6, 30), date(2022, 7, 2), False, False))
    assert not late[0] and "2022-06-30" in late[2]
    assert decided(spark, (None, None, False, True, True), (None, None, True, True))[0][1] == "consumer_narratives"
    assert decided(spark, (None, None, True, True, True), (None, None, True, True))[0][1] == "date_range"


def test_companies_resolve_without_guessing(spark):
    names = [" Cash App ", "Block, Inc.", "MOHELA", "State Farm", "  ", "Early Warning Services LLC"]
    frame = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    result = resolve_companies(frame, "name").orderBy("i").select("input_value", "legal_company", "brand_name", "status")
    assert rows(result) == [
        ("Cash App", "Block, Inc.", "Cash App", "curated_alias"),
        ("Block, Inc.", "Block, Inc.", "Cash App", "normalized_legal_name"),
        ("MOHELA", "MOHELA", "MOHELA", "curated_alias"),
        ("State Farm", None, None, "unresolved"),
        ("  ", None, None, "unresolved"),
        ("Early Warning Services LLC", "Early Warning Services, LLC", "Zelle", "normalized_legal_name"),
    ]


def test_explicit_names_must_not_contradict(spark):
    data = [("BLOCK INC", None, "Block, Inc.", "Cash App"), ("Acme", None, "Block, Inc.", "Cash App"), (None, "Zelle", "Block, Inc.", "Cash App"), (None, None, "MOHELA", None)]
    frame = spark.createDataFrame(data, "a string, b string, c string, d string")
    found = frame.select(entity_conflicts(*[F.col(n) for n in "abcd"]))
    assert [r[0] for r in found.collect()] == [None, "company conflict", "brand conflict", None]


def test_questions(spark, tmp_path):
    path = tmp_path / "questions.json"
    path.write_text(json.dumps([{"id": "q1", "question": "What?"}, {"id": "q2", "question": "Why?"}], indent=1))
    assert rows(read_questions(spark, str(path)).orderBy("position")) == [(0, "q1", "What?"), (1, "q2", "Why?")]
    for bad, message in (
        ({"id": "q1"}, "must be an array"),
        ([{"id": 1, "question": "x"}], "string id and question"),
        (["x"], "string id and question"),
        ([{"id": "q1", "question": None}], "string id and question"),
        ([{"id": "a", "question": "x"}, {"id": "a", "question": "y"}], "duplicate question id: a"),
    ):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError, match=message):
            read_questions(spark, str(path))


def test_manifests(spark, tmp_path):
    good = {
        "population_criteria": {"date_received": {"start": "2024-01-01", "end": "2025-12-31"}},
        "row_count": 3, "distinct_complaint_id_count": 3, "narrative_count": 2,
    }
    path = tmp_path / "manifest.json"

    def attempt(payload):
        path.write_text(payload if isinstance(payload, str) else json.dumps(payload))
        return read_capabilities(spark, str(path))

    assert rows(attempt(good)) == [(date(2024, 1, 1), date(2025, 12, 31), True, False, False)]
    assert rows(attempt({**good, "narrative_count": 0}))[0][2] is False
    dates = lambda **kw: {**good, "population_criteria": {"date_received": {"start": "2024-01-01", "end": "2025-12-31", **kw}}}
    for bad in (
        "[]", "not json", {}, {**good, "population_criteria": []}, {**good, "population_criteria": {}},
        dates(start=None), dates(end="2025-13-01"), dates(start="2026-01-01"), dates(end=20251231),
        {**good, "row_count": -1}, {**good, "row_count": True}, {**good, "row_count": "3"},
        {**good, "narrative_count": None}, {**good, "narrative_count": 1.5},
    ):
        with pytest.raises(ValueError, match="invalid Bronze manifest"):
            attempt(bad)


def test_snapshots_in_other_formats(spark, tmp_path):
    frame = spark.createDataFrame(SILVER_SOURCE, RAW_SCHEMA)
    frame.coalesce(1).write.csv(str(tmp_path / "csv"), header=True)
    frame.coalesce(1).write.json(str(tmp_path / "json"))
    frame.coalesce(1).write.orc(str(tmp_path / "orc"))
    expected = sorted(r["complaint_id"].strip() for r in frame.collect())
    for fmt, options in (("csv", {"header": "true"}), ("json", {}), ("orc", {})):
        read = read_snapshot(spark, str(tmp_path / fmt), fmt, **options)
        assert sorted(r["complaint_id"].strip() for r in read.collect()) == expected
        assert silver.silver_table(read).count() == 2
    with pytest.raises(ValueError):
        read_snapshot(spark, "x", "xml")
    for name in ("", "a.b", "a\0"):
        with pytest.raises(ValueError):
            read_table(spark, name)


def test_publication_switches_only_when_complete(spark, tmp_path):
    root = str(tmp_path / "out")
    frame = spark.range(3)
    publish_generation(spark, root, lambda f: frame.write.parquet(f"{f}/t"), lambda f: {"n": 3})
    first = current_folder(spark, root)

    def broken(folder):
        raise RuntimeError("report failed")

    with pytest.raises(RuntimeError):
        publish_generation(spark, root, lambda f: frame.write.parquet(f"{f}/t"), broken)
    assert current_folder(spark, root) == first and read_current(spark, root, "t").count() == 3
    assert len(list((tmp_path / "out" / "_generations").iterdir())) == 1
    publish_generation(spark, root, lambda f: spark.range(5).write.parquet(f"{f}/t"), lambda f: {})
    assert read_current(spark, root, "t").count() == 5
    (tmp_path / "out" / "_current").write_text("../elsewhere\n")
    (tmp_path / "out" / "._current.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError):
        current_folder(spark, root)


def test_places_must_be_separate(spark, tmp_path):
    require_separate(spark, str(tmp_path / "a"), str(tmp_path / "ab"))
    for other in (str(tmp_path / "a"), str(tmp_path / "a" / "b"), f"file:{tmp_path}/a/"):
        with pytest.raises(ValueError, match="overlap"):
            require_separate(spark, str(tmp_path / "a"), other)


def test_runs_are_written_once(spark, tmp_path):
    outputs = {"answers": spark.range(2), "evidence": spark.range(1)}
    target = write_run(spark, str(tmp_path), outputs, "run-1")
    assert spark.read.json(f"{target}/answers").count() == 2
    with pytest.raises(FileExistsError):
        write_run(spark, str(tmp_path), outputs, "run-1")
    for bad in ("", "..", "a/b", "_x"):
        with pytest.raises(ValueError):
            write_run(spark, str(tmp_path), outputs, bad)
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["run-1"]


def arrivals():
    return [
        raw_row(date_received="2025-03-01", company="Acme", complaint_id="100", timely_response="no", consumer_complaint_narrative="moved"),
        raw_row(date_received="2025-02-10", company="Acme", complaint_id="200", consumer_complaint_narrative="new"),
        raw_row(date_received="2025-02-11", company="Acme", complaint_id="200", consumer_complaint_narrative="again"),
    ]


@pytest.fixture
def built(spark, tmp_path):
    source = str(tmp_path / "source")
    spark.createDataFrame(SILVER_SOURCE, RAW_SCHEMA).coalesce(1).write.parquet(source)
    roots = [str(tmp_path / name) for name in ("bronze", "silver", "gold")]
    bronze.create_bronze(spark, source, roots[0], allow_population_violations=True)
    silver.rebuild_silver(spark, *roots[:2])
    gold.rebuild_gold(spark, *roots[1:])
    return roots


def assert_gold_is_that_of(spark, gold_root, complaints):
    refreshed = gold.read_metric_tables(spark, current_folder(spark, gold_root))
    for name in METRIC_TABLES:
        full = gold.metrics_from_complaints(complaints, name)
        assert sorted(rows(refreshed[name].select(full.columns)), key=str) == sorted(rows(full), key=str)


def test_refresh_equals_a_full_rebuild_and_can_be_repeated(spark, built, tmp_path):
    _, silver_root, gold_root = built
    old = read_current(spark, silver_root, "complaints")
    arriving = spark.createDataFrame(arrivals(), RAW_SCHEMA).coalesce(1).withColumn(ROW_ORDER, F.monotonically_increasing_id())
    refresh.apply_batch(spark, silver_root, arriving)
    new = read_current(spark, silver_root, "complaints")
    picked = new.orderBy("complaint_id").select("complaint_id", "date_received", "consumer_complaint_narrative")
    assert rows(picked) == [
        ("100", date(2025, 3, 1), "moved"), ("101", date(2025, 2, 3), "second"), ("200", date(2025, 2, 10), "new"),
    ]
    changes = refresh.changes_from_arrivals(old, refresh.canonical_arrivals(arriving))
    assert sorted(rows(changes), key=str) == sorted(rows(refresh.changed_complaints(old, new)), key=str)
    # The first refresh deals silver into buckets and gold into months; from then on only months that
    # differ are made anew.
    assert refresh.refresh_gold(spark, silver_root, gold_root)["refreshed_months"] is None
    assert_gold_is_that_of(spark, gold_root, new)
    moved = spark.createDataFrame(
        [raw_row(date_received="2025-01-07", company="Acme", complaint_id="100"),
         raw_row(date_received="2024-12-31", company="New", complaint_id="300")], RAW_SCHEMA
    ).coalesce(1).withColumn(ROW_ORDER, F.monotonically_increasing_id())
    second = refresh.apply_batch(spark, silver_root, moved)
    assert second["silver_rows"] == 4 and len(second["buckets_written"]) in (1, 2)
    report = refresh.refresh_gold(spark, silver_root, gold_root)
    assert report["refreshed_months"] == ["2024-12-01", "2025-01-01", "2025-03-01"]
    kept = {name: part["generation"] for name, part in report["parts"]["company_month_metrics"].items()}
    assert kept["2025-02-01"] != kept["2025-01-01"] and "2025-03-01" not in kept
    assert_gold_is_that_of(spark, gold_root, read_current(spark, silver_root, "complaints"))
    assert refresh.refresh_gold(spark, silver_root, gold_root)["refreshed_months"] == []
    assert_gold_is_that_of(spark, gold_root, read_current(spark, silver_root, "complaints"))
    refresh.apply_batch(spark, silver_root, moved)
    new = read_current(spark, silver_root, "complaints")
    refresh.apply_batch(spark, silver_root, moved)
    again = read_current(spark, silver_root, "complaints")
    assert sorted(rows(again), key=str) == sorted(rows(new), key=str)
    assert refresh.changed_complaints(new, again).count() == 0


def test_invalid_arrivals_change_nothing(spark, built):
    before = current_folder(spark, built[1])
    bad = spark.createDataFrame([raw_row(complaint_id="1", timely_response="maybe")], RAW_SCHEMA).withColumn(ROW_ORDER, F.lit(1))
    with pytest.raises(ValueError, match="no canonical records"):
        refresh.apply_batch(spark, built[1], bad)
    assert current_folder(spark, built[1]) == before


def many(spark, ids, narrative="text", **fields):
    data = [
        raw_row(**{"date_received": f"2025-{1 + i % 5:02}-03", "company": f"C{i % 3}", "complaint_id": str(i),
                   "product": f"00{i % 2}", "consumer_complaint_narrative": f"{narrative} {i}"} | fields)
        for i in ids
    ]
    return spark.createDataFrame(data, RAW_SCHEMA).coalesce(1).withColumn(ROW_ORDER, F.monotonically_increasing_id())


@pytest.fixture(scope="module")
def made_once(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bucketed")
    roots = [str(folder / name) for name in ("silver", "gold", "index")]
    start = silver.silver_table(many(spark, range(39)))
    publish_generation(spark, roots[0], lambda f: start.write.parquet(f"{f}/complaints"), lambda f: {})
    gold.rebuild_gold(spark, *roots[:2])
    refresh.apply_batch(spark, roots[0], many(spark, [39]), buckets=8)
    refresh.refresh_gold(spark, *roots[:2])
    retrieval.build_index(spark, roots[0], roots[2], hashed_terms(8))
    return folder


@pytest.fixture
def bucketed(made_once, tmp_path):
    """Silver of forty complaints in eight buckets, gold in months, and an index."""
    shutil.copytree(made_once, tmp_path / "copy")
    return [str(tmp_path / "copy" / name) for name in ("silver", "gold", "index")]


def files_of(spark, root):
    """Data files of current silver by bucket."""
    import re

    listed = read_current(spark, root, "complaints").inputFiles()
    return {(re.search("_part=([0-9]+)", name)[1], name) for name in listed}


def test_buckets_that_nothing_arrives_in_keep_their_files(spark, bucketed):
    silver_root = bucketed[0]
    before, folder = files_of(spark, silver_root), current_folder(spark, silver_root)
    assert len({bucket for bucket, _ in before}) == 8
    report = refresh.apply_batch(spark, silver_root, many(spark, [3, 3, 100]))
    after, hit = files_of(spark, silver_root), set(report["buckets_written"])
    assert 1 <= len(hit) <= 2 and report["arrived_rows"] == 3 and report["silver_rows"] == 41
    assert {f for f in before if f[0] not in hit} == {f for f in after if f[0] not in hit}
    assert not {f for f in before if f[0] in hit} & after
    assert report["null_counts"]["state"] == 41 and report["previous_generation"] == folder[-32:]
    assert sorted(int(r[0]) for r in rows(read_current(spark, silver_root, "complaints").select("complaint_id"))) == [*range(40), 100]
    # An empty batch publishes the same parts.
    assert refresh.apply_batch(spark, silver_root, many(spark, [3]).limit(0))["buckets_written"] == []
    assert files_of(spark, silver_root) == after


def test_months_reach_the_scan_as_ranges(spark, bucketed):
    assert refresh.month_ranges([date(2025, 3, 1), date(2024, 12, 1), date(2025, 1, 1)]) == [
        (date(2024, 12, 1), date(2025, 2, 1)), (date(2025, 3, 1), date(2025, 4, 1)),
    ]
    picked = read_current(spark, bucketed[0], "complaints").where(refresh.in_months([date(2025, 3, 1)]))
    assert picked.count() == 8
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = picked.where("true")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(date_received,2025-03-01)" in plan and "LessThan(date_received,2025-04-01)" in plan


def held(spark, index_root):
    index, _ = retrieval.open_index(spark, index_root)
    return {r["complaint_id"]: (r["product"], r["excerpt"], tuple(r["embedding"])) for r in index.collect()}


def test_index_embeds_what_changed_and_drops_what_went(spark, bucketed, monkeypatch):
    silver_root, _, index_root = bucketed
    embedder = hashed_terms(8)
    counted = spark.sparkContext.accumulator(0)

    def counting(texts):
        counted.add(len(texts))
        return hashed_terms(8)(texts)

    refresh.apply_batch(spark, silver_root, many(spark, [1, 2, 200], narrative="other"))
    refresh.apply_batch(spark, silver_root, many(spark, [5], product="new product"))
    refresh.apply_batch(spark, silver_root, many(spark, [6], consumer_complaint_narrative=" "))
    report = refresh.refresh_index(spark, silver_root, index_root, counting)
    assert (report["embedded_rows"], report["removed_rows"], report["documents_indexed"]) == (4, 4, 40)
    assert counted.value == 4 and len(report["segments"]) == 2
    found = held(spark, index_root)
    assert set(found) == {str(i) for i in (*range(40), 200) if i != 6}
    assert found["1"][1] == "other 1" and found["3"][0] == "001" and found["5"][0] == "new product"
    # The same as an index built anew.
    fresh_root = index_root + "-fresh"
    retrieval.build_index(spark, silver_root, fresh_root, embedder)
    assert held(spark, fresh_root) == found
    # Nothing changed, then a narrative that comes back, and at last one segment again.
    assert refresh.refresh_index(spark, silver_root, index_root, embedder)["embedded_rows"] == 0
    refresh.apply_batch(spark, silver_root, many(spark, [6]))
    monkeypatch.setattr(refresh, "LONGEST", 3)
    report = refresh.refresh_index(spark, silver_root, index_root, embedder)
    assert len(report["segments"]) == 1 and report["embedded_rows"] == 1
    assert set(held(spark, index_root)) == {str(i) for i in (*range(40), 200)}


def test_a_breached_profile_leaves_the_current_generation(spark, bucketed):
    silver_root = bucketed[0]
    before = current_folder(spark, silver_root)
    flood = many(spark, range(100, 200))
    with pytest.raises(refresh.DriftRefused, match="row_count"):
        refresh.apply_batch(spark, silver_root, flood, tolerance=0.5)
    assert current_folder(spark, silver_root) == before
    assert read_current(spark, silver_root, "complaints").count() == 40
    report = refresh.apply_batch(spark, silver_root, many(spark, [100, 101]), tolerance=0.5)
    assert report["silver_rows"] == 42 and not any(x["breached"] for x in report["drift"])
    assert refresh.apply_batch(spark, silver_root, flood, tolerance=3.0)["silver_rows"] == 140


def test_stream_brings_gold_and_index_up_to_silver(spark, bucketed, tmp_path):
    silver_root, gold_root, index_root = bucketed
    inbox, checkpoint = str(tmp_path / "inbox"), str(tmp_path / "checkpoint")
    many(spark, [1, 300]).drop(ROW_ORDER).write.parquet(inbox)
    everything = dict(gold_root=gold_root, index_root=index_root, embedder=hashed_terms(8), tolerance=0.5)
    refresh.refresh_stream(spark, inbox, silver_root, checkpoint, **everything)
    assert read_current(spark, silver_root, "complaints").count() == 41
    assert_gold_is_that_of(spark, gold_root, read_current(spark, silver_root, "complaints"))
    assert len(held(spark, index_root)) == 41
    # A batch that drifts too far stops the stream; with a wider tolerance it goes through later.
    many(spark, range(400, 500)).drop(ROW_ORDER).write.mode("append").parquet(inbox)
    with pytest.raises(Exception, match="tolerance"):
        refresh.refresh_stream(spark, inbox, silver_root, checkpoint, **everything)
    assert read_current(spark, silver_root, "complaints").count() == 41
    refresh.refresh_stream(spark, inbox, silver_root, checkpoint, **{**everything, "tolerance": 9.0})
    assert len(held(spark, index_root)) == read_current(spark, silver_root, "complaints").count() == 141


def test_gold_catches_up_after_a_refresh_that_died(spark, bucketed):
    """Two batches reach silver before gold is refreshed once."""
    silver_root, gold_root, _ = bucketed
    refresh.apply_batch(spark, silver_root, many(spark, [1], date_received="2025-07-07"))
    refresh.apply_batch(spark, silver_root, many(spark, [2], date_received="2025-08-08"))
    months = refresh.refresh_gold(spark, silver_root, gold_root)["refreshed_months"]
    assert months == ["2025-02-01", "2025-03-01", "2025-07-01", "2025-08-01"]
    assert_gold_is_that_of(spark, gold_root, read_current(spark, silver_root, "complaints"))


def test_gold_of_one_table_takes_its_columns_only(spark, tmp_path):
    table, (silver_root, gold_root) = "company_issue_month_metrics", (str(tmp_path / n) for n in ("silver", "gold"))
    columns = gold.needed_columns([table])
    refresh.build_buckets(spark, silver_root, many(spark, range(40)), 4, columns)
    first = refresh.refresh_gold(spark, silver_root, gold_root, [table])
    assert first["tables"] == [table] and first["refreshed_months"] is None
    moved = many(spark, [3, 100], company="New", date_received="2025-09-09")
    second = refresh.apply_batch(spark, silver_root, moved, tolerance=0.5)
    assert second["silver_rows"] == 41 and not any(x["breached"] for x in second["drift"])
    assert refresh.refresh_gold(spark, silver_root, gold_root)["refreshed_months"] == ["2025-04-01", "2025-09-01"]
    assert sorted(read_current(spark, silver_root, "complaints").columns) == sorted(columns)
    whole = silver.silver_table(many(spark, [i for i in range(40) if i != 3])).unionByName(silver.silver_table(moved))
    full = gold.metrics_from_complaints(whole, table)
    found = gold.read_metric_table(spark, current_folder(spark, gold_root), table)
    assert sorted(rows(found.select(full.columns)), key=str) == sorted(rows(full), key=str)
    for other in (["company_month_metrics"], [table, "company_month_metrics"]):
        with pytest.raises(ValueError, match="gold holds other tables"):
            refresh.refresh_gold(spark, silver_root, gold_root, other)
    with pytest.raises(ValueError, match="no metric tables: nothing"):
        refresh.refresh_gold(spark, silver_root, gold_root + "-new", ["nothing"])
    # Rows are validated whole, in columns that are not kept too.
    with pytest.raises(ValueError, match="1 invalid"):
        refresh.build_buckets(spark, silver_root, many(spark, [1], date_sent_to_company="2025"), 4, columns)


def test_several_tables_are_refreshed_from_those_they_add_up(spark, tmp_path):
    names = ["company_issue_month_metrics", "company_response_month_metrics"]
    silver_root, gold_root = str(tmp_path / "silver"), str(tmp_path / "gold")
    rest = dict(issue="late", company_response_to_consumer="Closed", state="CA")
    # One is added up from the detail table, which is not among them.
    columns = gold.needed_columns([gold.DETAIL, *names])
    refresh.build_buckets(spark, silver_root, many(spark, range(20), **rest), 4, columns)
    assert refresh.refresh_gold(spark, silver_root, gold_root, names)["tables"] == names
    refresh.apply_batch(spark, silver_root, many(spark, [5, 50], **rest | {"issue": "fees"}))
    report = refresh.refresh_gold(spark, silver_root, gold_root)
    assert sorted(report["parts"]) == names and report["refreshed_months"] == ["2025-01-01"]
    complaints = read_current(spark, silver_root, "complaints")
    for name in names:
        full = gold.metrics_from_complaints(complaints, name)
        found = gold.read_metric_table(spark, current_folder(spark, gold_root), name).select(full.columns)
        assert sorted(rows(found), key=str) == sorted(rows(full), key=str)


def test_a_value_that_moves_to_another_column_is_a_change(spark, bucketed):
    silver_root, gold_root, _ = bucketed
    for product, issue in (("x", None), (None, "x")):
        refresh.apply_batch(spark, silver_root, many(spark, [1], product=product, issue=issue))
        assert refresh.refresh_gold(spark, silver_root, gold_root)["refreshed_months"] == ["2025-02-01"]
        assert_gold_is_that_of(spark, gold_root, read_current(spark, silver_root, "complaints"))


def test_the_months_that_differ_are_found_without_moving_complaints(spark, bucketed):
    complaints, columns = read_current(spark, bucketed[0], "complaints"), gold.needed_columns(METRIC_TABLES)
    digests = refresh.month_digests(complaints, columns)
    plan = digests._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange " in line]
    assert len(moved) == 1 and "hashpartitioning(complaint_month" in moved[0] and "partial_count" in plan
    assert sorted(rows(digests)) == sorted(rows(refresh.month_digests(complaints.repartition(5), columns)))
    other = refresh.month_digests(complaints.withColumn("timely_response", F.lit(True)), columns)
    assert digests.count() == 5 and digests.join(other, "digest").isEmpty()


def test_a_refreshed_table_costs_the_same_whichever_was_asked_before(spark, monkeypatch):
    from __spark_entry__ import queries

    written, publish = [], refresh.publish_parts

    def counting(spark, root, tables, *rest, **named):
        written.append(sorted(tables))
        return publish(spark, root, tables, *rest, **named)

    monkeypatch.setattr(refresh, "publish_parts", counting)
    for name in ("company_month_metrics", "product_month_metrics"):
        written.clear()
        assert queries()[f"inc_refreshed_{name}"](spark, "/root/testdata/sf0.001").count() > 0
        assert written == [["complaints"], [name], ["complaints"], [name]]


def test_stream_processes_arrivals_once(spark, built, tmp_path):
    inbox, checkpoint = str(tmp_path / "inbox"), str(tmp_path / "checkpoint")
    spark.createDataFrame(arrivals(), RAW_SCHEMA).coalesce(1).write.parquet(inbox)
    refresh.refresh_stream(spark, inbox, built[1], checkpoint)
    after = current_folder(spark, built[1])
    assert read_current(spark, built[1], "complaints").count() == 3
    refresh.refresh_stream(spark, inbox, built[1], checkpoint)
    assert current_folder(spark, built[1]) == after


def test_snapshots_processed_one_by_one_or_together_end_alike(spark, built, tmp_path):
    """The newest snapshot wins either way, also where its name sorts last."""
    import os

    ends = []
    for together in (False, True):
        root = str(tmp_path / f"silver-{together}")
        shutil.copytree(built[1], root)
        inbox, checkpoint = tmp_path / f"inbox-{together}", str(tmp_path / f"checkpoint-{together}")
        inbox.mkdir()
        for k, name in enumerate(("a", "b")):
            made = tmp_path / f"made-{together}-{name}"
            row = raw_row(complaint_id="1", product=f"version {k + 1}", timely_response="Yes")
            spark.createDataFrame([row], RAW_SCHEMA).coalesce(1).write.parquet(str(made))
            target = inbox / f"{name}.parquet"
            target.write_bytes(next(made.glob("part-*.parquet")).read_bytes())
            os.utime(target, (1_700_000_000 + 60 * k,) * 2)
            if not together:
                refresh.refresh_stream(spark, str(inbox), root, checkpoint)
        refresh.refresh_stream(spark, str(inbox), root, checkpoint)
        found = read_current(spark, root, "complaints").where("complaint_id = '1'").collect()
        ends.append([r["product"] for r in found])
    assert ends == [["version 2"], ["version 2"]]


def test_drift(spark):
    old = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "x")], "a int, b string")
    new = spark.createDataFrame([(1, None, 1)] * 3 + [(1, "x", 1)], "a int, b string, c int")
    found = refresh.drift(refresh.table_profile(old), refresh.table_profile(new), 0.5)
    breached = sorted((r["metric"], r["column_name"]) for r in found.where("breached").collect())
    assert breached == [("column", "c"), ("null_count", "b")]
    assert refresh.drift(refresh.table_profile(old), refresh.table_profile(old), 0.0).where("breached").count() == 0
