import pytest

from murmur.operators.classify import classify, flatten_keywords
from murmur.operators.enrich import analyze
from murmur.operators.lexicon import KEYWORD_STOP_WORDS, SAMPLE, Lexicon


# One line or more for each way to a mood, a severity and a category.
CASES = [
    (None, "Neutral", "Other", "Low"), ("", "Neutral", "Other", "Low"), (" \t ", "Neutral", "Other", "Low"),
    ("Exam hall", "Mixed", "Academic", "Medium"),  # a term that says both
    ("heat in corridor, great", "Mixed", "Environment", "Medium"),  # both, and a contrast
    ("license only", "Neutral", "Software", "Low"),
    ("license fan", "Neutral", "Software", "Low"),  # as many neutral terms as negative ones
    ("great view", "Positive", "Other", "Low"),
    ("great fan", "Positive", "Hardware", "Low"),  # a repeated term counts twice
    ("great fan tv odor", "Negative", "Hardware", "Medium"),
    ("fan is loud", "Negative", "Hardware", "Medium"),
    ("urgent: fan smoke", "Negative", "Hardware", "High"),
    ("fan near stone", "Negative", "Hardware", "Low"),  # a tie goes to the category of higher priority
    ("heat trash", "Negative", "Cleanliness", "Medium"),
    ("wait mit Eile", "Negative", "Transportation", "Medium"),  # only a mild term
    ("plain words", "Neutral", "Other", "Low"),
]


def test_moods_categories_and_severities(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, feedback string")
    rows = sorted(classify(df, SAMPLE).collect())
    assert [(r["feedback"], r["sentiment"], r["category"], r["severity"]) for r in rows] == CASES


@pytest.mark.parametrize(("text", "issue", "summary", "action", "keywords"), [
    (None, "None", "Empty feedback.", "No action needed", []),
    ("great view", "None", "great view", "No action needed", ["great", "view"]),
    ("  noisy fan, noisy lobby ", "Hardware issue", "noisy fan, noisy lobby", "Repair or replace the device.", ["noisy", "lobby"]),
    ("fan " + "y" * 200, "Hardware issue", "fan " + "y" * 133 + "...", "Repair or replace the device.", ["y" * 200]),
    ("fan alpha beta gamma delta epsilon", "Hardware issue", "fan alpha beta gamma delta epsilon",
     "Repair or replace the device.", ["alpha", "beta", "gamma", "delta"]),
])
def test_issue_summary_action_and_keywords(spark, text, issue, summary, action, keywords):
    row = classify(spark.createDataFrame([(text,)], "feedback string"), SAMPLE).first()
    assert (row["main_issue"], row["summary"], row["suggested_action"], row["keywords"]) == (issue, summary, action, keywords)


def test_terms_with_blanks_match_at_the_ends_and_repeats_count_twice(spark):
    lex = Lexicon(negative=["bad", "worse"], positive=["good", "good"], mild=[" end "])
    df = spark.createDataFrame([(0, "bad good"), (1, "the end"), (2, "ends"), (3, "bad worse good")], "i int, feedback string")
    rows = sorted(classify(df, lex).select("i", "sentiment", "category").collect())
    assert [r["sentiment"] for r in rows] == ["Positive", "Negative", "Neutral", "Negative"]
    assert {r["category"] for r in rows} == {"Other"}


def test_lexicon_table_round_trip(spark, tmp_path):
    table = SAMPLE.to_table(spark)
    assert Lexicon.from_table(table) == SAMPLE
    assert SAMPLE.stop == KEYWORD_STOP_WORDS


def test_analysis_needs_no_python_worker_and_no_shuffle(spark):
    df = spark.createDataFrame([(1, "a")], "i int, feedback string")
    plan = analyze(df, SAMPLE)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_keywords_flatten(spark):
    df = spark.createDataFrame([("noisy lobby and noisy stairs",)], "feedback string")
    assert flatten_keywords(classify(df, SAMPLE)).first()["keywords"] == "noisy, lobby, stairs"


def test_looked_up_terms_mean_the_same_as_terms_sought_one_by_one(spark, monkeypatch):
    import dataclasses
    import random

    from murmur.operators import classify as c
    from murmur.operators.lexicon import SAMPLE

    rng = random.Random(7)
    own = ["ab", "a b", "of the", " in ", "@", "", "x", "ab", "über", "日本語の本", "a  b", "no good at", "abcabc", "  "]
    made = ["".join(rng.choice("abc ") for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    lexicon = dataclasses.replace(
        SAMPLE, negative=SAMPLE.negative + own + made[::3], positive=SAMPLE.positive + made[1::3], high=SAMPLE.high + made[2::3] + own)
    texts = ["", None, " ", "ab", "Of  the\tcab", "ÜBER 日本語の本", "x@y", "no good at all", "abc" * 40, "a b " * 30]
    texts += ["".join(rng.choice("abc  \n.") for _ in range(rng.randrange(120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "_ord long, feedback string")

    def rows():
        counted = c.with_hits(c.with_classifier_text(df), lexicon).select("_ord", "_neg", "_pos", "_neu", "_category_hits").collect()
        return counted, c.classify(df, lexicon).collect()

    assert c.Matcher(lexicon).looked_up["negative"] == []
    expected = rows()
    assert sum(r["_neg"] > 5 for r in expected[0]) > 50
    for few in (150, 10, 0):  # terms without a whole stem one by one, then looked up as well
        monkeypatch.setattr(c, "FEW_TERMS", few)
        assert any(c.Matcher(lexicon).looked_up.values())
        assert rows() == expected


def test_fifty_thousand_terms(spark):
    import time

    from murmur.operators import classify as c
    from murmur.operators.lexicon import Lexicon

    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{i:05}" for i in range(50_000)]
    table = spark.createDataFrame([("negative" if i % 2 else "positive", None, w, None, None) for i, w in enumerate(words)],
                                  "group string, label string, term string, priority int, action string")
    lexicon = Lexicon.from_table(table)
    df = spark.createDataFrame([(i, " ".join(words[i : i + 3])) for i in range(0, 50_000, 1000)], "_ord long, feedback string")
    start = time.perf_counter()
    got = c.with_hits(c.with_classifier_text(df), lexicon).select("_ord", "_neg", "_pos").collect()
    assert [(r["_neg"], r["_pos"]) for r in got] == [(1, 2)] * 50
    assert time.perf_counter() - start < 60


def test_keywords_around_the_part_that_is_looked_at_first(spark):
    """Words cut by its end count whole; where it has too few, all of the text is searched."""
    import re

    from pyspark.sql import functions as F
    from murmur.operators import classify as c

    texts = [" " * (c.HEAD - n) + "alpha alpha beta-x gamma stop-" + "d" * m + " omega zeta" for n in range(40) for m in (0, 1, 9)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", c.keywords(F.col("t"), ["gamma"]).alias("k"))
    for r in got.collect():
        words = [w for w in dict.fromkeys(re.findall(r"[a-z][a-z-]{3,}", texts[r["i"]])) if w != "gamma"]
        assert r["k"] == words[:4]
    assert "substring" in got._jdf.queryExecution().optimizedPlan().toString()
