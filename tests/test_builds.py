"""Bronze, silver and gold builds, and what a failed build leaves behind."""

from datetime import UTC, date, datetime

import pytest
from conftest import rows
from fixtures import INVALID_ROW, RAW_SCHEMA, SILVER_SOURCE, raw_row
from pyspark.sql import functions as F

from docket_spark.constants import METRIC_TABLES
from docket_spark.operators.profiling import null_profile
from docket_spark.plans import bronze, gold, silver
from docket_spark.plans.parts import read_current
from docket_spark.plans.publish import current_folder, current_report
from docket_spark.sources.complaints import ROW_ORDER, file_digests, read_snapshot

BRONZE = "date_received string, consumer_complaint_narrative string, complaint_id string"
CLEAN = [("2025-01-03T10:00:00Z", "narrative", "1")]
VIOLATING = [*CLEAN, ("2026-01-01", "late", "2"), ("2025-01-02", " ", "3")]


def write(spark, data, schema, path):
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(path))
    return str(path)


def test_bronze_lands_verbatim_with_manifest(spark, tmp_path):
    source = write(spark, CLEAN, BRONZE, tmp_path / "source")
    root = str(tmp_path / "bronze")
    made = bronze.create_bronze(
        spark, source, root, source_version="v1", snapshot_at=datetime(2026, 1, 1, tzinfo=UTC)
    )
    report, digest = current_report(spark, root)
    assert report == made and len(digest) == 64
    assert (made["row_count"], made["distinct_complaint_id_count"], made["narrative_count"]) == (1, 1, 1)
    assert made["retrieval_snapshot_at"] == "2026-01-01T00:00:00Z"
    assert made["date_received_min"] == made["date_received_max"] == "2025-01-03"
    assert set(made["population_violations"].values()) == {0}
    assert [c["name"] for c in made["schema"]] == ["date_received", "consumer_complaint_narrative", "complaint_id"]
    assert rows(read_current(spark, root, "complaints").drop(ROW_ORDER)) == CLEAN


def test_bronze_digest_is_the_file_digest(spark, tmp_path):
    import hashlib

    source = write(spark, CLEAN, BRONZE, tmp_path / "source")
    made = bronze.create_bronze(spark, source, str(tmp_path / "bronze"))
    (part,) = [p for p in (tmp_path / "source").iterdir() if p.name.startswith("part-")]
    assert made["sha256"] == hashlib.sha256(part.read_bytes()).hexdigest()


def test_bronze_refuses_population_violations_unless_allowed(spark, tmp_path):
    source = write(spark, VIOLATING, BRONZE, tmp_path / "source")
    root = str(tmp_path / "bronze")
    with pytest.raises(ValueError, match="population"):
        bronze.create_bronze(spark, source, root)
    with pytest.raises(FileNotFoundError):
        current_folder(spark, root)
    made = bronze.create_bronze(spark, source, root, allow_population_violations=True)
    assert made["population_violations"] == {
        "date_received_out_of_range_or_invalid_count": 1,
        "blank_narrative_count": 1,
    }


def test_bronze_needs_its_columns_and_separate_places(spark, tmp_path):
    source = write(spark, [("1",)], "complaint_id string", tmp_path / "source")
    with pytest.raises(ValueError, match="missing required columns: consumer_complaint_narrative, date_received"):
        bronze.create_bronze(spark, source, str(tmp_path / "bronze"))
    with pytest.raises(ValueError, match="overlap"):
        bronze.create_bronze(spark, source, source)
    with pytest.raises(ValueError, match="ordered"):
        bronze.manifest(spark.createDataFrame(CLEAN, BRONZE), "2025-02-01", "2025-01-01")


@pytest.fixture
def landed(spark, tmp_path):
    def land(data, name="bronze"):
        source = write(spark, data, RAW_SCHEMA, tmp_path / f"{name}-source")
        root = str(tmp_path / name)
        bronze.create_bronze(spark, source, root, allow_population_violations=True)
        return root

    return land


def test_silver_cleans_and_keeps_the_first_row(spark, tmp_path, landed):
    root = str(tmp_path / "silver")
    report = silver.rebuild_silver(spark, landed(SILVER_SOURCE), root)
    assert (report["source_rows"], report["silver_rows"], report["duplicate_rows_skipped"]) == (3, 2, 1)
    assert report["brand_alias_counts"] == {"Cash App": 1, "Zelle": 1}
    assert report["null_counts"]["sub_product"] == 2 and "product" not in report["null_counts"]
    table = read_current(spark, root, "complaints")
    assert table.columns == list(silver.SILVER_COLUMNS)
    picked = table.orderBy("complaint_id").select(
        "complaint_id", "date_received", "product", "company_key", "brand_name", "timely_response"
    )
    assert rows(picked) == [
        ("100", date(2025, 1, 2), "Payments", "block inc", "Cash App", True),
        ("101", date(2025, 2, 3), "Transfer", "early warning services llc", "Zelle", False),
    ]


def test_invalid_rows_abort_and_leave_current_silver(spark, tmp_path, landed):
    root = str(tmp_path / "silver")
    silver.rebuild_silver(spark, landed(SILVER_SOURCE), root)
    before = current_folder(spark, root)
    for i, bad in enumerate(
        (INVALID_ROW, raw_row(complaint_id=" "), raw_row(complaint_id="9", timely_response="maybe"))
    ):
        with pytest.raises(ValueError, match="1 invalid canonical records"):
            silver.rebuild_silver(spark, landed([*SILVER_SOURCE, bad], f"bad{i}"), root)
    assert current_folder(spark, root) == before


def test_figures_counted_by_the_write_equal_those_of_the_rows(spark, tmp_path, landed):
    other = [raw_row(complaint_id=str(k), date_received=f"2025-01-{1 + k % 28:02}") for k in range(40)]
    for name, data in (("some", [*SILVER_SOURCE, *other, *other[:7]]), ("none", [])):
        root = landed(data, name)
        made, _ = current_report(spark, root)
        plain = bronze.manifest(read_current(spark, root, "complaints"))
        assert {k: made[k] for k in plain} == plain
        assert made["row_count"] == len(data)
        report = silver.rebuild_silver(spark, root, str(tmp_path / f"silver-{name}"))
        table = read_current(spark, str(tmp_path / f"silver-{name}"), "complaints")
        assert report["silver_rows"] == table.count()
        assert report["source_rows"] == len(data)
        assert report["null_counts"] == {
            r.column_name: r.null_count for r in null_profile(table).collect()
        }
        assert report["brand_alias_counts"] == {
            r.brand_name: r.complaint_count for r in silver.brand_counts(table).collect()
        }


def test_an_invalid_duplicate_aborts_too(spark, tmp_path, landed):
    twice = [raw_row(complaint_id="7"), raw_row(complaint_id="7", timely_response="maybe")]
    with pytest.raises(ValueError, match="1 invalid canonical records"):
        silver.rebuild_silver(spark, landed(twice, "twice"), str(tmp_path / "silver"))


def test_both_ways_of_deduplication_agree_under_a_hot_id(spark):
    data = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .otherwise((F.col("id") % 700).cast("string"))
        .alias("complaint_id"),
        ((F.col("id") * 7919) % 3001).alias(ROW_ORDER),
    )
    windowed = silver.canonical(data.repartition(7))
    lost = silver.superseded(data.repartition(5)).select(ROW_ORDER)
    filtered = data.join(lost, ROW_ORDER, "left_anti").select(*data.columns)
    assert sorted(rows(windowed)) == sorted(rows(filtered))
    assert windowed.count() == data.select("complaint_id").distinct().count()


GOLD_SCHEMA = (
    "complaint_id string, date_received date, company string, product string, state string, "
    "issue string, sub_issue string, company_response_to_consumer string, timely_response boolean"
)
GOLD_SOURCE = [
    ("1", date(2025, 1, 2), "Acme", "Payments", "CA", "Late", "Fees", "Closed", True),
    ("2", date(2025, 1, 15), "Acme", "Payments", "CA", "Late", "Fees", "Closed", False),
    ("3", None, "Acme", "Cards", "CA", "Other", "Other", "Closed", True),
    ("4", date(2025, 1, 20), "Acme", "Payments", "CA", "Late", "Fees", "Closed", None),
    ("5", date(2025, 1, 21), "Unknown Co", "Payments", "TX", "Late", "Fees", "Closed", None),
]


def test_gold_metrics_and_unknown_rates(spark):
    table = gold.metrics_from_complaints(
        spark.createDataFrame(GOLD_SOURCE, GOLD_SCHEMA), "company_product_month_metrics"
    )
    assert sorted(rows(table)) == [
        ("Acme", "Payments", date(2025, 1, 1), 3, 1, 2, 0.5),
        ("Unknown Co", "Payments", date(2025, 1, 1), 1, 0, 0, None),
    ]


def test_gold_tables_reconcile_and_derived_tables_equal_direct_ones(spark, tmp_path, landed):
    source = str(tmp_path / "silver")
    silver.rebuild_silver(spark, landed(SILVER_SOURCE), source)
    root = str(tmp_path / "gold")
    report = gold.rebuild_gold(spark, source, root)
    assert report["silver_rows"] == report["dated_silver_rows"] == 2
    assert {t: r["metric_total"] for t, r in report["reconciliation"].items()} == dict.fromkeys(METRIC_TABLES, 2)
    complaints = read_current(spark, source, "complaints")
    written = gold.read_metric_tables(spark, current_folder(spark, root))
    for name in METRIC_TABLES:
        direct = gold.metrics_from_complaints(complaints, name)
        assert sorted(rows(written[name]), key=str) == sorted(rows(direct), key=str)


def test_one_scan_metrics_equal_single_tables(spark):
    complaints = spark.createDataFrame(
        [*GOLD_SOURCE, ("6", date(2025, 2, 1), None, None, None, None, None, None, True)], GOLD_SCHEMA
    )
    together = gold.all_metrics(complaints)
    for name, dims in METRIC_TABLES.items():
        columns = [*dims, "complaint_count", "timely_response_count", "timely_response_known_count"]
        part = together.where(F.col("table_name") == name).select(*columns)
        single = gold.metrics_from_complaints(complaints, name).select(*columns)
        assert sorted(rows(part), key=str) == sorted(rows(single), key=str)


def test_gold_needs_its_columns_and_a_failed_build_keeps_current(spark, tmp_path, landed, monkeypatch):
    source, root = str(tmp_path / "silver"), str(tmp_path / "gold")
    silver.rebuild_silver(spark, landed(SILVER_SOURCE), source)
    gold.rebuild_gold(spark, source, root)
    before = current_folder(spark, root)
    monkeypatch.setattr(gold, "written_totals", lambda tables: dict.fromkeys(METRIC_TABLES, 1))
    with pytest.raises(RuntimeError, match="reconciliation failed"):
        gold.rebuild_gold(spark, source, root)
    assert current_folder(spark, root) == before
    with pytest.raises(ValueError, match="missing required columns: company"):
        gold.dated(spark.createDataFrame(GOLD_SOURCE, GOLD_SCHEMA).drop("company"))


def test_date_texts(spark):
    from docket_spark.functions.dates import date_ordinal, parse_date

    good = ["2025-01-03", "2025-1-3", "2025-01-03T10:00:00Z", "2025-01-03 10:00:00.5+05:30", "2025/01/03"]
    bad = ["2025", "2025-01", "2025-01-03x", "2025-13-01", "2025-01-03T99:00:00", "not-date", "", "2025-0a-01", None]
    frame = spark.createDataFrame([(t,) for t in [*good, *bad]], "t string")
    parsed = [r[0] for r in frame.select(parse_date(F.col("t"))).collect()]
    assert parsed == [date(2025, 1, 3)] * len(good) + [None] * len(bad)
    ordinal = frame.where("t = '2025-01-03'").select(date_ordinal(parse_date(F.col("t")))).first()[0]
    assert ordinal == date(2025, 1, 3).toordinal()


def test_neither_file_size_nor_split_size_moves_the_first_row(spark, tmp_path):
    """a.parquet has one row, b.parquet many; the row in a comes first however files are read."""
    folder = str(tmp_path / "snapshot")
    for name, n in (("a", 1), ("b", 20_000)):
        part = spark.range(n).selectExpr("CAST(id AS STRING) AS complaint_id", f"'{name}' AS product")
        part.coalesce(1).write.parquet(str(tmp_path / name))
        source = next((tmp_path / name).glob("part-*.parquet"))
        (tmp_path / "snapshot").mkdir(exist_ok=True)
        (tmp_path / "snapshot" / f"{name}.parquet").write_bytes(source.read_bytes())
    for size in ("128m", "16k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            first = silver.canonical(read_snapshot(spark, folder))
            assert first.where("complaint_id = '0'").first()["product"] == "a"
            assert first.count() == 20_000
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain_tree(data, chunk):
    """The tree digest of a file's bytes, by plain loops."""
    import hashlib

    sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
    lines, at = [], 0
    parts = data.split(b"\n")
    for line in parts if parts[-1] else parts[:-1]:
        lines.append((at, sha(line)))
        at += len(line) + 1
    for size in (chunk, chunk * 1000, chunk * 1_000_000):
        groups = {}
        for place, digest in lines:
            groups.setdefault(place // size * size, []).append(digest)
        lines = [(place, sha(",".join(digests))) for place, digests in sorted(groups.items())]
    return "tree:" + sha(f"{len(data)}," + sha(",".join(digest for _, digest in lines)))


def test_long_files_are_digested_in_ranges_whatever_the_split(spark, tmp_path):
    import hashlib
    import random

    draw = random.Random(8)
    folder = tmp_path / "files"
    folder.mkdir()
    data = {
        "big one.bin": draw.randbytes(200_000) + b"\n\n\n" + b"x" * 5_000,
        "also+big.csv": b"".join(b"row %d,\xc3\xa4\r\n" % k for k in range(9_000)),
        "small.txt": b"a\nb",
    }
    for name, content in data.items():
        (folder / name).write_bytes(content)
    want = {name: plain_tree(c, 4096) if len(c) > 1000 else hashlib.sha256(c).hexdigest() for name, c in data.items()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("128m", "30000b", "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            found = file_digests(spark, str(folder), whole=1000, chunk=4096).collect()
            assert {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in found} == want
            assert {r["length"] for r in found} == {len(c) for c in data.values()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert bronze.combined_digest(file_digests(spark, str(folder), whole=1000))


def test_files_too_long_for_a_value_pass_through_their_digest(spark, tmp_path):
    import gzip
    import hashlib
    import random

    draw = random.Random(9)
    folder = tmp_path / "files"
    folder.mkdir()
    text = b"".join(b"row %d,\xc3\xa4\r\n" % k for k in range(3_000))
    data = {
        "random bytes.bin": draw.randbytes(150_000),
        "ends+with feeds.bin": draw.randbytes(20_000) + b"\n\n\n",
        "text.csv": text,
        "marked.csv": b"\xef\xbb\xbf" + text,
        "marked once.csv": b"\xef\xbb\xbf" + text[:-1],
        "one line.json": b"x" * 30_000,
        "packed.csv.gz": gzip.compress(draw.randbytes(9_000) + text),
        "short.txt": b"a\nb",
        "long.bin": draw.randbytes(300_000),
    }
    for name, content in data.items():
        (folder / name).write_bytes(content)
    want = {name: hashlib.sha256(c).hexdigest() for name, c in data.items()} | {"long.bin": plain_tree(data["long.bin"], 4096)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("128m", "7000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            found = file_digests(spark, str(folder), whole=200_000, chunk=4096, value=1000)
            assert {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in found.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    # Contents are read of no file but the short and the packed ones.
    plan, opened = found._jdf.queryExecution().executedPlan().toString(), 0
    todo = [found._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        if "binaryFile" in node.nodeName() and "content#" in node.simpleString(1000):
            opened += node.metrics().get("numFiles").get().value()
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert "MapInArrow" in plan and opened == 2


def test_a_snapshot_above_the_limit_of_one_value_lands(spark, tmp_path, monkeypatch):
    from docket_spark.sources import complaints

    source, root = str(tmp_path / "source"), str(tmp_path / "bronze")
    spark.createDataFrame(SILVER_SOURCE, RAW_SCHEMA).coalesce(1).write.parquet(source)
    monkeypatch.setattr(bronze, "file_digests", lambda s, p: complaints.file_digests(s, p, whole=100))
    made = bronze.create_bronze(spark, source, root, allow_population_violations=True)
    assert made["row_count"] == len(SILVER_SOURCE) and len(made["sha256"]) in (64, 69)


def test_order_lines_move_once_for_each_of_their_keys(spark):
    from docket_spark.sources import testdata

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = testdata.raw_complaints(spark, "/root/testdata/sf0.001")
        plan = spark._jvm.PythonSQLUtils.explainString(lines._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    blocks = plan.split("\n\n")
    moved = [x for x in blocks if ") Exchange\n" in x and "l_extendedprice#" in x]
    assert len(moved) == 3


def test_a_batch_reaches_its_buckets_by_one_exchange(spark):
    from docket_spark.plans.silver import clean, silver_table
    from docket_spark.sources import testdata
    from docket_spark.streaming import refresh

    lines = testdata.raw_complaints(spark, "/root/testdata/sf0.001").localCheckpoint()
    number = lines["complaint_id"].cast("long")
    old = silver_table(lines.where(number % 3 != 0).withColumn("tags", lines["state"])).localCheckpoint()
    late = lines.where(number % 2 == 0)
    late = late.unionByName(late.limit(50)).localCheckpoint()
    dealt = refresh.in_buckets(old, clean(late), 4)
    expected = refresh.merge(old, refresh.canonical_arrivals(late))
    found = dealt.drop("_part")
    assert found.count() == expected.count() > 0
    assert found.exceptAll(expected).isEmpty()
    assert {row["_part"] for row in dealt.select("_part").distinct().collect()} == {"0", "1", "2", "3"}
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_bucket_and_piece_of_a_row_are_not_moved_with_it(spark):
    from docket_spark.plans.silver import clean, silver_table
    from docket_spark.sources import testdata
    from docket_spark.streaming import refresh

    lines = testdata.raw_complaints(spark, "/root/testdata/sf0.001").localCheckpoint()
    dealt = refresh.in_buckets(silver_table(lines).limit(0), clean(lines), 4)
    plan = spark._jvm.PythonSQLUtils.explainString(dealt._jdf.queryExecution(), "formatted").split("\n\n")
    moved = [x for x in plan if ") Exchange\n" in x and "REPARTITION_BY_COL" in x]
    assert len(moved) == 1 and "complaint_id#" in moved[0]
    assert "_part#" not in moved[0] and "_piece#" not in moved[0]
    # An id tells rows apart by its start, so it leads the sort.
    sorts = [x for x in plan if ") Sort" in x and "_age#" in x]
    assert sorts and all("Arguments: [complaint_id#" in x for x in sorts)


def test_a_table_is_made_of_its_own_columns(spark, landed, tmp_path):
    silver.rebuild_silver(spark, landed(SILVER_SOURCE), str(tmp_path / "silver"))
    complaints = read_current(spark, str(tmp_path / "silver"), "complaints")
    for name, dimensions in METRIC_TABLES.items():
        needed = gold.needed_columns([name])
        assert {*needed} == {"complaint_id", "date_received", "timely_response", *dimensions} - {"complaint_month"}
        narrow = gold.metrics_from_complaints(complaints.select(*needed), name)
        assert sorted(rows(narrow), key=str) == sorted(rows(gold.metrics_from_complaints(complaints, name)), key=str)
        with pytest.raises(ValueError):
            gold.metrics_from_complaints(complaints.select(*needed[:-1]), name)


def exchanges(spark, frame):
    plan = spark._jvm.PythonSQLUtils.explainString(frame._jdf.queryExecution(), "formatted").split("\n\n")
    return [x for x in plan if ") Exchange\n" in x]


def placed_rows(spark):
    """Cleaned rows with repeated ids, shared places, rows without an id, and texts of all kinds."""
    texts = [None, "", "a,b", "\u00e4\u4e2d \U0001f600", "x" * 40_000, '"quoted"\n', "0"]
    entries = []
    for i in range(60):
        complaint = None if i % 11 == 0 else str(i % 23)
        place = (i % 23, 0) if i >= 56 else (i // 7, i)
        values = {name: texts[(i * k) % 7] for k, name in enumerate(silver.SOURCE_COLUMNS, 1)}
        entries.append((*raw_row(**{**values, "complaint_id": complaint}), place))
    schema = f"{RAW_SCHEMA}, {ROW_ORDER} struct<day: int, line: int>"
    rows_ = spark.createDataFrame([*entries, entries[1], entries[11]], schema)
    # Bytes that are no text stay what they are.
    odd = F.unhex(F.lit("FF41C3")).cast("string")
    return rows_.withColumn("issue", F.when(F.col(f"{ROW_ORDER}.line") % 5 == 0, odd).otherwise(F.col("issue")))


def test_kept_rows_come_from_one_scan_and_one_exchange(spark):
    cleaned = placed_rows(spark)
    as_bytes = lambda f: f.withColumns({n: F.hex(n) for n in silver.SOURCE_COLUMNS})
    kept = silver.kept_rows(cleaned)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan ExistingRDD") == len(exchanges(spark, kept)) == 1
    expected = silver.kept_rows(cleaned, silver.superseded(cleaned))
    assert kept.schema == cleaned.schema
    found = sorted(rows(as_bytes(kept)), key=str)
    assert found == sorted(rows(as_bytes(expected)), key=str) and 23 < len(found) < 62


def test_totals_are_reconciled_by_one_scan(spark):
    complaints = spark.createDataFrame(GOLD_SOURCE, GOLD_SCHEMA)
    checked = gold.reconciliation(complaints)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "ubquery" not in plan
    many = sum(row[GOLD_SCHEMA.split(", ").index("date_received date")] is not None for row in GOLD_SOURCE)
    assert sorted(rows(checked)) == sorted((name, many, True) for name in METRIC_TABLES)
    assert rows(gold.reconciliation(complaints.where("date_received IS NULL"))) == []


def test_names_of_few_suppliers_are_moved_with_no_line(spark, monkeypatch):
    from docket_spark.sources import testdata

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        few = testdata.raw_complaints(spark, "/root/testdata/sf0.001")
        monkeypatch.setattr(testdata, "SMALL", 100)
        many = testdata.raw_complaints(spark, "/root/testdata/sf0.001")
        moved = [[x for x in exchanges(spark, lines) if "l_extendedprice#" in x] for lines in (few, many)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len(moved[0]) == 2 and not any("s_name#" in x for x in moved[0])
    # Many meet the lines before these carry the texts of their parts.
    assert len(moved[1]) == 3 and [("s_name#" in x, "p_name#" in x) for x in moved[1]].count((True, False)) == 1
    assert few.count() == many.count() > 0 and few.exceptAll(many).isEmpty()


def test_silver_of_named_columns_moves_these_and_a_digest(spark):
    raw = placed_rows(spark).withColumn("company", F.concat(F.lit("No. "), "complaint_id", F.lit(", Inc.")))
    raw = raw.dropDuplicates(["complaint_id", ROW_ORDER]).localCheckpoint()
    whole = silver.silver_table(raw)
    columns = ["complaint_id", "company", "issue", "state", "date_received", "timely_response"]
    narrow = silver.silver_table(raw, columns=columns, digest=True)
    expected = whole.select(*columns, F.xxhash64(*silver.SILVER_COLUMNS).alias(silver.DIGEST))
    assert narrow.schema == expected.schema
    (moved,) = exchanges(spark, narrow)
    assert sorted(rows(narrow), key=str) == sorted(rows(expected), key=str)
    assert "_texts#" in moved and "company#" not in moved and "tags#" not in moved
    with pytest.raises(ValueError):
        silver.silver_table(raw, [F.col("issue")], columns=columns)


def test_sides_of_a_refresh_are_made_once(spark):
    import checks.refreshes  # noqa: F401
    from checks.registry import QUERIES
    from docket_spark.streaming import refresh

    files = QUERIES["inc_refreshed_metrics"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/refresh-" in file for file in files)

    raw = placed_rows(spark).dropDuplicates(["complaint_id", ROW_ORDER]).localCheckpoint()
    columns = gold.needed_columns(["company_month_metrics"])
    first, later = raw.where(f"{ROW_ORDER}.day < 5"), raw.where(f"{ROW_ORDER}.day >= 3")
    late = later.withColumn("tags", F.when(F.col("complaint_id") == "7", F.lit("new")).otherwise(F.col("tags")))
    old, fresh = silver.silver_table(first), refresh.canonical_arrivals(late)
    old_, fresh_ = (
        silver.silver_table(first, columns=columns, digest=True),
        refresh.canonical_arrivals(late, columns),
    )
    for a, b in (
        (refresh.merge(old, fresh).select(*sorted(columns)), refresh.merge(old_, fresh_).select(*sorted(columns))),
        (refresh.changes_from_arrivals(old, fresh), refresh.changes_from_arrivals(old_, fresh_)),
    ):
        assert sorted(rows(a), key=str) == sorted(rows(b), key=str) != []
