import pytest

from murmur.operators import cleaning
from murmur.schema import ValidationError
from murmur.sources.append import append_new, last_number
from murmur.sources.feedback import (
    dataset_summary, export_csv, file_slug, load_feedback, preview, safe_load_and_clean,
)

HEAD = "date,feedback_id,location,feedback,extra\n"


def write(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_columns_follow_the_header_and_quotes_work(spark, tmp_path):
    path = write(tmp_path, HEAD + '2026-06-01,FB1,Hall,"a ""b"", c\nsecond line",x\n2026-06-02,NA,nan,None,\n')
    rows = load_feedback(spark, path, multi_line=True).orderBy("_ord").collect()
    assert rows[0]["feedback"] == 'a "b", c\nsecond line' and rows[0]["feedback_id"] == "FB1"
    assert (rows[1]["feedback_id"], rows[1]["location"], rows[1]["feedback"], rows[1]["extra"]) == (None,) * 4
    df, error = safe_load_and_clean(spark, path, multi_line=True)
    assert error is None and df.count() == 1 and "extra" in df.columns


def test_typed_errors(spark, tmp_path):
    with pytest.raises(ValidationError, match="empty"):
        load_feedback(spark, write(tmp_path, ""))
    with pytest.raises(ValidationError, match="no rows"):
        load_feedback(spark, write(tmp_path, HEAD))
    with pytest.raises(ValidationError, match="Could not read"):
        load_feedback(spark, str(tmp_path / "missing.csv"))
    assert "Missing required" in safe_load_and_clean(spark, write(tmp_path, "a,b\n1,2\n"))[1]
    assert "After cleaning" in safe_load_and_clean(spark, write(tmp_path, HEAD + "bad,FB1,Hall,x,\n"))[1]


def test_export_and_read_back(spark, feedback, tmp_path):
    df = feedback([{"feedback": 'a "b", c'}, {"feedback": "plain"}], analyzed=False)
    assert file_slug("Feedback (Full)") == "feedback_full"
    path = export_csv(df.select("feedback_id", "date", "location", "feedback"), str(tmp_path), "Feedback (Full)")
    back = load_feedback(spark, path)
    assert sorted(r["feedback"] for r in back.collect()) == ['a "b", c', "plain"]


def test_preview_and_summary(feedback):
    df = feedback([{"location": p} for p in ("A", "B", "A", None)] * 5)
    assert [r["_ord"] for r in preview(df).collect()] == list(range(10))
    row = dataset_summary(df).first()
    assert (row["total_records"], row["unique_locations"]) == (20, 2)
    bare = dataset_summary(df.drop("location", "date")).first()
    assert (bare["total_records"], bare["unique_locations"], bare["first_date"]) == (20, 0, None)


def test_rows_of_several_files_are_ordered_by_path(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text(HEAD + "2026-06-01,FB1,Hall,short,\n2026-06-01,FB2,Hall,second,\n")
    (folder / "b.csv").write_text(HEAD + "2026-06-01,FB1,Hall," + "long " * 500 + ",\n")
    rows = load_feedback(spark, str(folder)).orderBy("_ord").collect()
    assert [(r["feedback_id"], r["feedback"][:4]) for r in rows] == [("FB1", "shor"), ("FB2", "seco"), ("FB1", "long")]
    assert len({r["_ord"] for r in rows}) == 3
    cleaned, error = safe_load_and_clean(spark, str(folder))
    assert error is None and sorted(r["feedback"] for r in cleaned.collect()) == ["second", "short"]


def test_dates_in_other_forms(spark):
    rows = [(0, "2026-06-01"), (1, "06/02/2026"), (2, "3.6.2026"), (3, "soon"), (4, None)]
    df = spark.createDataFrame(rows, "_ord long, date string")
    formats = ["MM/dd/yyyy", "d.M.yyyy"]
    got = {r["_ord"]: str(r["date"])[:10] for r in cleaning.parse_dates(df, formats).collect()}
    assert got == {0: "2026-06-01", 1: "2026-06-02", 2: "2026-06-03"}
    assert tuple(cleaning.unreadable_dates(df, formats).first()) == (5, 2)
    assert tuple(cleaning.unreadable_dates(df).first()) == (5, 4)


def test_long_ids_are_read_whole_or_refused(spark):
    def last(*ids):
        return last_number(spark.createDataFrame([(i,) for i in ids], "feedback_id string"))

    assert last("FB0009", "FB0123", None, "FBx") == 123
    assert last("FB1000000000000000001", "FB999999999999999999") == 10**18 + 1
    assert last() == 0
    with pytest.raises(ValueError, match="too large"):
        last("FB1234567890123456789012")


def test_append_skips_known_texts_and_numbers_on(spark):
    schema = "_ord long, feedback_id string, date string, location string, feedback string"
    existing = spark.createDataFrame([(0, "FB0007", "2026-06-02", "A", " known "), (1, "FB0003", "2026-06-01", "A", "b")], schema)
    incoming = spark.createDataFrame([
        (5, "2026-06-03", "B", "new"), (6, "2026-06-03", "B", "known"), (7, "2026-06-01", "B", "new"),
        (8, "2026-06-03", "B", " known "), (9, "2026-06-03", "B", "b"),
    ], "_ord long, date string, location string, feedback string")
    rows = [(r["feedback_id"], r["feedback"]) for r in append_new(existing, incoming).collect()]
    # Incoming rows are compared as they are, and not with each other.
    assert rows == [("FB0003", "b"), ("FB0009", "new"), ("FB0007", " known "), ("FB0008", "new"), ("FB0010", " known ")]
    again = append_new(existing, incoming.limit(0))
    assert again.count() == 2


def test_lines_that_do_not_fit_the_header_are_set_aside(spark, tmp_path):
    from murmur.sources.feedback import load_checked

    lines = ["2026-06-01,FB1,Hall,fine,x", "2026-06-01,FB2,Hall", '2026-06-01,FB3,Hall,"a" b",c",y,z', "2026-06-01,FB4,nan,also fine,",
             "2026-06-01,FB5,Hall,a,b,c,d", '2026-06-01,FB6,Hall,"quoted, fine",x']
    path = write(tmp_path, HEAD + "\n".join(lines) + "\n")
    loaded = load_checked(spark, path, str(tmp_path / "quarantine"))
    rows = loaded.rows.orderBy("_ord").collect()
    assert [r["feedback_id"] for r in rows] == ["FB1", "FB4", "FB6"]
    assert rows[1]["location"] is None and rows[2]["feedback"] == "quoted, fine"
    assert loaded.n_rejected == 3 and {r["record"] for r in loaded.rejected.collect()} == {lines[1], lines[2], lines[4]}
    assert all(r["path"].endswith("in.csv") for r in loaded.rejected.collect())
    again = load_checked(spark, path, str(tmp_path / "quarantine"))
    assert again.n_rejected == 3 and spark.read.parquet(str(tmp_path / "quarantine")).count() == 6
    clean = load_checked(spark, write(tmp_path, HEAD + lines[0] + "\n"), str(tmp_path / "q2"))
    assert clean.n_rejected == 0 and clean.rejected.count() == 0 and clean.rows.count() == 1


def test_exported_parts_read_by_name_keep_the_row_order(spark, tmp_path):
    from pyspark.sql import functions as F

    df = spark.range(5000).select(
        F.col("id").alias("_ord"), F.concat(F.lit("t"), "id").alias("feedback"), F.col("id").alias("n")).orderBy(F.rand(1))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = export_csv(df, str(tmp_path), "Feedback (Full)")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    import pathlib

    parts = sorted(pathlib.Path(path).glob("part-*.csv"))
    numbers = [int(line.split(",")[0]) for part in parts for line in part.read_text().splitlines()[1:]]
    assert numbers == list(range(5000)) and len(parts) > 1


def test_a_damaged_cache_file_costs_its_results_only(spark, tmp_path):
    import pathlib

    from pyspark.sql import functions as F

    from murmur.schema import RESULT_SCHEMA
    from murmur.sources import cache as c

    def results(first, last, mark):
        fields = [F.lit(mark if f.dataType.typeName() == "string" and f.name != "analysis_error" else None).cast(f.dataType).alias(f.name)
                  for f in RESULT_SCHEMA.fields]
        return spark.range(first, last, 1, 1).select(F.sha1(F.col("id").cast("string")).alias("cache_key"), F.struct(*fields).alias("result"))

    path = str(tmp_path / "cache")
    assert c.load_cache(spark, path).collect() == [] and c.unreadable_files(spark, path) == 0
    assert c.save_cache(results(0, 40, "b"), path) and c.save_cache(results(20, 60, "a"), path)
    assert c.load_cache(spark, path).count() == 80 and c.unreadable_files(spark, path) == 0
    files = sorted(pathlib.Path(path).rglob("part-*.parquet"))
    victim = files[3]
    lost = spark.read.parquet(str(victim)).count()
    victim.write_bytes(victim.read_bytes()[: victim.stat().st_size // 2])
    assert c.load_cache(spark, path).count() == 80 - lost and c.unreadable_files(spark, path) == 1
    small = c.compact_cache(spark, path, str(tmp_path / "small"))
    by_key = {r["cache_key"]: r["result"]["summary"] for r in small.collect()}
    assert small.count() == len(by_key) == c.load_cache(spark, path).select("cache_key").distinct().count()
    assert set(by_key.values()) == {"a", "b"}
    keys = results(20, 21, "x").select("cache_key")
    some = c.load_cache(spark, str(tmp_path / "small"), keys)
    assert keys.first()[0] in {r["cache_key"] for r in some.collect()} and some.count() < small.count()
    assert "PartitionFilters: [(isnull(key_prefix" in some._jdf.queryExecution().executedPlan().toString()
