import json

from pyspark.sql import functions as F

from murmur.functions.text import text_key
from murmur.operators.enrich import analysis_failures, enrich
from murmur.operators.lexicon import SAMPLE
from murmur.sources.cache import load_cache, save_cache

TEXTS = ["heat in here", "great place", "heat in here", None, "the gate", "great place", "  ", "heat in here"]


def table(feedback, texts=TEXTS):
    return feedback([{"feedback": t} for t in texts], analyzed=False)


def polite_scorer():
    # Defined here, so that it is shipped to the workers by value.
    def polite(texts):
        return [{"sentiment": "Positive", "category": "Safety", "severity": "Low", "summary": t} for t in texts]

    return polite


def results(df):
    return [tuple(r) for r in df.orderBy("_ord").select("_ord", "sentiment", "category", "summary", "analysis_error").collect()]


def test_every_row_gets_the_result_of_its_text(feedback):
    rows = results(enrich(table(feedback), SAMPLE).rows)
    assert [r[0] for r in rows] == list(range(len(TEXTS)))
    assert rows[0][1:] == rows[2][1:] == rows[7][1:]
    assert rows[3][1:] == ("Neutral", "Other", "Empty feedback.", None)


def test_repeated_texts_get_the_same_result(feedback):
    many = results(enrich(table(feedback, TEXTS * 40), SAMPLE).rows)
    once = [r[1:] for r in results(enrich(table(feedback), SAMPLE).rows)]
    assert [r[1:] for r in many] == once * 40


def test_cache_round_trip_and_prompt_in_the_key(spark, feedback, tmp_path):
    path = str(tmp_path / "cache")
    df = table(feedback)
    assert load_cache(spark, path).count() == 0
    first = enrich(df, SAMPLE, cache=load_cache(spark, path), scorer=polite_scorer())
    assert save_cache(first.fresh, path)
    without = results(first.rows)
    failing = lambda texts: 1 / 0
    second = enrich(df, SAMPLE, cache=load_cache(spark, path), scorer=failing)
    # Blank texts never come from the scorer and are never cached.
    assert [r for r in results(second.rows)] == without
    assert second.fresh.count() == 0
    other = enrich(df, SAMPLE, cache=load_cache(spark, path), scorer=failing, prompt="new")
    assert other.rows.where("analysis_error is null").count() == 0
    key = lambda p: spark.range(1).select(text_key(F.lit("x"), p)).first()[0]
    assert key("a") != key("b")


def test_skipped_entries_are_asked_for_alone_and_then_left_to_the_rules(feedback):
    def forgetful(texts):
        # Forgets "the gate" in company and "great place" always; numbers may come as text.
        entries = [
            {"id": str(i), "sentiment": "Mixed"} for i, t in enumerate(texts, 1)
            if t != "great place" and (t != "the gate" or len(texts) == 1)
        ]
        return "Here: " + str(entries).replace("'", '"')

    rows = results(enrich(table(feedback), SAMPLE, batch_scorer=forgetful).rows)
    assert [r[1] for r in rows] == ["Mixed", "Positive", "Mixed", "Neutral", "Mixed", "Positive", "Neutral", "Mixed"]
    left = "The reply holds no usable entry for this text."
    assert [r[4] for r in rows] == [None, left, None, "Empty feedback text.", None, left, "Empty feedback text.", None]


def test_failing_batch_goes_to_the_rules(feedback):
    out = enrich(table(feedback), SAMPLE, batch_scorer=lambda texts: 1 / 0)
    assert {r[4] for r in results(out.rows)} == {"API error: division by zero", "Empty feedback text."}
    assert out.fresh.count() == 0


def test_failing_scorer_falls_back_with_the_reason(feedback):
    def broken(texts):
        raise RuntimeError("no credits")

    out = enrich(table(feedback), SAMPLE, scorer=broken)
    rows = results(out.rows)
    assert rows[0][1] == "Negative" and rows[0][4] == "API error: no credits"
    assert rows[6][4] == "Empty feedback text."
    report = analysis_failures(out.rows).first()
    assert (report["failed"], report["total"], report["first_error"]) == (8, 8, "API error: no credits")


def test_scorer_sees_each_text_once_in_small_batches(feedback, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    polite = polite_scorer()

    def counting(texts):
        import uuid
        (log / uuid.uuid4().hex).write_text(json.dumps(texts))
        return polite(texts)

    texts = [f"text {i % 35}" for i in range(100)]
    enrich(table(feedback, texts), SAMPLE, scorer=counting).rows.count()
    calls = [json.loads(p.read_text()) for p in log.iterdir()]
    assert sorted(t for call in calls for t in call) == sorted(set(texts))
    assert max(map(len, calls)) <= 10


def test_texts_for_a_scorer_are_picked_by_row_number(spark, feedback, monkeypatch):
    from murmur.operators import enrich as e
    from murmur.operators.lexicon import SAMPLE

    df = feedback([{"feedback": t} for t in ["same"] * 30 + ["other", None, "", "same"]], analyzed=False)
    keyed = df.withColumn("cache_key", e.text_key(df["feedback"])).fillna("", ["feedback"])
    pending = e.first_texts(keyed, keyed)
    assert sorted(r["feedback"] for r in pending.collect()) == ["", "other", "same"]
    plan = pending._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "Aggregate" not in plan.split("Scan")[0].replace("HashAggregate", "")
    rows = e.enrich(df, SAMPLE, scorer=lambda texts: ["not json"] * len(texts)).rows
    assert rows.count() == 34


def test_batches_are_cut_by_rows_and_bytes():
    import pandas as pd

    from murmur.operators.enrich import batches

    frame = pd.DataFrame({"feedback": ["a" * n for n in (5, 5, 20, 1, 1, 1, 1, 1)] + [None, "é" * 5]})
    got = [part["feedback"].map(lambda t: len(t.encode()) if t else 0).tolist() for part in batches(frame, 3, 10)]
    assert got == [[5, 5], [20], [1, 1, 1], [1, 1, 0], [10]]
    assert list(batches(frame.iloc[:0], 3)) == []


def test_long_texts_reach_a_scorer_in_bounded_batches(spark, tmp_path):
    from pyspark.sql import functions as F

    from murmur.operators import enrich as e
    from murmur.operators.lexicon import SAMPLE

    path = str(tmp_path / "long")
    spark.range(0, 200, 1, 1).select(
        F.col("id").cast("string").alias("cache_key"), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), 100_000).alias("feedback"),
    ).write.parquet(path)

    seen = str(tmp_path / "seen")

    def scorer(texts):
        with open(seen, "a") as file:
            file.write(f"{len(texts)} {sum(map(len, texts))}\n")
        return ["{}"] * len(texts)

    assert e.score(spark.read.parquet(path), SAMPLE, scorer, 1000).count() == 200
    calls = [tuple(map(int, line.split())) for line in open(seen)]
    assert sum(n for n, _ in calls) == 200 and max(size for _, size in calls) <= e.BATCH_BYTES


def test_replies_and_settled_texts_are_not_stored(spark, monkeypatch):
    from murmur.operators import enrich as e
    from murmur.operators.lexicon import SAMPLE

    def scorer(texts):
        return '[{"id": 1, "sentiment": "Mixed"}]'

    kept, cut = [], e.cut_lineage
    monkeypatch.setattr(e, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    texts = spark.createDataFrame([(str(i), f"text {i}") for i in range(6)], "cache_key string, feedback string").coalesce(1)
    got = {r["cache_key"]: r["result"]["sentiment"] for r in e.score_numbered(texts, SAMPLE, scorer, 3).collect()}
    assert got == {str(i): "Mixed" for i in range(6)}
    assert all("reply" not in df.columns for df in kept)
    assert sorted(r["cache_key"] for r in kept[0].where("feedback is not null").collect()) == ["1", "2", "4", "5"]
