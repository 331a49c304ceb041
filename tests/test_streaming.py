from pyspark.sql import functions as F

from murmur.operators.enrich import analyze
from murmur.operators.lexicon import SAMPLE
from murmur.plans.bindings import document_feedback
from murmur.streaming.feed import analyze_feed, read_feed


def test_stream_equals_batch_and_takes_each_file_once(spark, tmp_path):
    rows = document_feedback(spark, "/root/testdata/sf0.001").select("feedback_id", "date", "location", "feedback")
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first, second = rows.where("feedback_id < 100"), rows.where("feedback_id >= 100")
    for part in (first, second):
        part.write.mode("append").parquet(source)
        analyze_feed(read_feed(spark, source), SAMPLE, target, state).awaitTermination(120)
    columns = ["feedback_id", "sentiment", "category", "severity", "summary"]
    assert sorted(spark.read.parquet(target).select(*columns).collect()) == sorted(
        analyze(rows, SAMPLE).select(*columns).collect())


def test_append_survives_a_failure_between_rows_and_mark(spark, feedback, tmp_path, monkeypatch):
    import pytest

    from murmur.streaming import feed as f

    def texts(*values):
        return feedback([{"feedback": v} for v in values], analyzed=False)

    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    f.start_append(texts("old", "older").withColumn("feedback_id", F.concat(F.lit("FB000"), F.col("_ord") + 7)), target)
    columns = ["_ord", "feedback_id", "date", "location", "feedback"]
    texts("new a", "old", "new b", "new a").select(*columns).coalesce(1).write.parquet(source)
    schema = spark.read.parquet(source).schema

    def run():
        query = f.append_feed(f.read_feed(spark, source, schema), target, checkpoint)
        query.awaitTermination()

    def stored():
        return sorted((r["batch"], r["feedback_id"], r["feedback"]) for r in f.appended(spark, target).collect())

    before = [(-1, "FB0007", "old"), (-1, "FB0008", "older")]
    write = f._write

    def failing(df, to, part, batch):
        if part == "marks" and batch == 0:
            raise RuntimeError("lost")
        write(df, to, part, batch)

    monkeypatch.setattr(f, "_write", failing)
    with pytest.raises(Exception, match="lost"):
        run()
    assert stored() == before  # rows without a mark are not there
    monkeypatch.setattr(f, "_write", write)
    run()
    first = [(0, "FB0009", "new a"), (0, "FB0010", "new b"), (0, "FB0011", "new a")]
    assert stored() == before + first
    run()
    assert stored() == before + first
    texts("new b", "last", "older").select(*columns).coalesce(1).write.mode("append").parquet(source)
    run()
    assert stored() == before + first + [(1, "FB0012", "last")]
    f.append_batch(texts("new b", "last", "older"), 1, target)  # once more, after its mark
    assert stored() == before + first + [(1, "FB0012", "last")]
