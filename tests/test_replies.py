import json

from pyspark.sql import functions as F

from murmur.operators import replies as r
from murmur.operators.lexicon import SAMPLE


def parse(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, reply string")
    return [x[1] for x in sorted(df.select("i", r.sanitize(r.extract_object(F.col("reply")))).collect())]


def test_wrapping_is_removed(spark):
    entry = '{"sentiment": "Mixed", "summary": "a {b} c"}'
    wrapped = [
        entry, f"<think>{{no}}\nreally</think> {entry}", f"```json\n{entry}\n```", f"Sure! {entry} Bye.",
        f"\n```\n{entry}```  ",
    ]
    assert {(x["sentiment"], x["summary"]) for x in parse(spark, wrapped)} == {("Mixed", "a {b} c")}


def test_unusable_replies(spark):
    assert parse(spark, ["", "no", "}{", "{broken", '{"a": 1} }', None, '[1, 2]',
                         '{"a": 1} and {"b": 2}', '{"a": 1}, {"b": 2}', '{"a": 1}] {"b": 2}', '{"a": 1}} {"b": 2}']) == [None] * 11


def test_values_are_checked_and_filled(spark):
    rows = parse(spark, [
        "{}",
        json.dumps({"sentiment": "angry", "category": 7, "severity": None, "keywords": "heat", "main_issue": None,
                    "summary": None, "suggested_action": None}),
        json.dumps({"sentiment": "Negative", "category": "Safety", "severity": "High",
                    "keywords": [" a ", "", None, 3, "b"], "main_issue": "  ", "summary": " s ", "suggested_action": " "}),
        json.dumps({"main_issue": True, "summary": 5, "suggested_action": "x"}),
    ])
    common = ("Neutral", "Other", "Low", [])
    assert tuple(rows[0])[:7] == (*common, "None", "", "No action needed")
    assert tuple(rows[1])[:7] == (*common, "None", "None", "None")
    assert tuple(rows[2])[:7] == ("Negative", "Safety", "High", ["a", "None", "3", "b"], "None", "s", "No action needed")
    assert tuple(rows[3])[4:7] == ("True", "5", "x")
    assert all(x["analysis_error"] is None for x in rows)


def test_single_replies_fall_back(spark):
    df = spark.createDataFrame([
        (0, "heat in here", '{"sentiment": "Positive"}', None), (1, "heat in here", "sorry", None),
        (2, "  ", '{"sentiment": "Positive"}', None), (3, "great", None, "API error: x"),
    ], "i int, feedback string, reply string, error string")
    rows = sorted(r.parse_replies(df, SAMPLE).select("i", "result.sentiment", "result.analysis_error").collect())
    assert [tuple(x)[1:] for x in rows] == [
        ("Positive", None), ("Negative", r.NOT_JSON), ("Neutral", r.EMPTY_TEXT), ("Positive", "API error: x")]


def test_batch_entries_find_their_texts(spark):
    texts = [(1, i, f"great {i}") for i in range(1, 7)] + [(2, 1, "heat in here")]
    requests = spark.createDataFrame(texts, "batch_id long, item_no long, feedback string")
    reply = json.dumps([
        {"id": "2", "summary": "two"}, {"id": 2, "summary": "second two"}, {"id": 3.7, "summary": "three"},
        {"id": 99, "summary": "outside"}, {"id": "4.0", "summary": "no number"}, {"id": None, "summary": "none"},
        {"summary": "missing"}, 17, "text", None, {"id": True, "summary": "one"}, {"id": [5], "summary": "list"},
    ])
    replies = spark.createDataFrame([(1, f"Here: {reply}!"), (2, "broken [")], "batch_id long, reply string")
    rows = r.parse_batch_replies(requests, replies, SAMPLE).orderBy("batch_id", "item_no").collect()
    got = [(x["result"]["summary"], x["result"]["analysis_error"]) for x in rows]
    missing = r.SKIPPED
    assert got == [("one", None), ("two", None), ("three", None), ("great 4", missing), ("great 5", missing),
                   ("great 6", missing), ("heat in here", missing)]


def test_replies_are_parsed_once_or_twice_not_for_each_field(spark):
    from murmur.plans.catalog import QUERIES

    plan = QUERIES["sanitize_results"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.count("lengthOfJsonArray") <= 2
