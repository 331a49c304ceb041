import random
from collections import Counter

from pyspark.sql import functions as F

from murmur.operators import charts, summaries as s
from murmur.operators.priority import priority_problems


def test_summary_equals_a_count_by_hand(feedback):
    rng = random.Random(2)
    rows = [{
        "location": rng.choice(["A", "B", None, "C"]), "category": rng.choice(["x", "y", None]),
        "sentiment": rng.choice(["Positive", "Negative", None]), "severity": rng.choice(["Low", "High", "odd", None]),
        "main_issue": rng.choice(["p", "q", " p ", "None", "", None, "r", "t", "Analysis Unavailable"]),
        "date": f"2026-01-{rng.randint(10, 28)} 0{rng.randint(0, 9)}:00:00",
    } for _ in range(300)]
    rows += [{"location": "hot", "category": "x", "main_issue": "one"} for _ in range(200)]
    got = {r["location"]: r for r in s.summary_table(feedback(rows), "location").collect()}
    assert set(got) == {"A", "B", "C", "hot"}
    for place in got:
        mine = [{"sentiment": "Negative", "severity": "Low", "date": "2026-01-01", **r} for r in rows if r["location"] == place]
        weights = [{"High": 3, "Medium": 2}.get(r["severity"], 1) for r in mine]
        issues = Counter(r["main_issue"].strip() for r in mine if (r["main_issue"] or "").strip().lower()
                         not in ("none", "", "analysis unavailable"))
        cats = Counter(r["category"] for r in mine if r["category"])
        row = got[place]
        assert row["reports"] == len(mine)
        assert abs(row["pct_of_total"] - 100 * len(mine) / len(rows)) <= 0.05 + 1e-9
        assert abs(row["avg_severity"] - sum(weights) / len(mine)) <= 0.005 + 1e-9
        assert row["high_severity"] == sum(r["severity"] == "High" for r in mine)
        assert row["negative"] == sum(r["sentiment"] == "Negative" for r in mine)
        best = sorted(issues.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        assert row["top_issues"] == ("; ".join(k for k, _ in best) or "-")
        assert row["top_category"] == (min(cats.items(), key=lambda kv: (-kv[1], kv[0]))[0] if cats else "-")
        assert row["first_report"] == min(r["date"] for r in mine)[:10]


def test_fixed_orders_and_unknown_values_last(feedback):
    df = feedback([{"severity": v} for v in ("Low", "odd", "High", "Medium", "Low")])
    assert [r["severity"] for r in s.summary_table(df, "severity").collect()] == ["High", "Medium", "Low", "odd"]
    assert "high_severity" not in s.summary_table(df, "severity").columns
    assert "negative" not in s.summary_table(df, "sentiment").columns


def test_bundle_tables_equal_the_single_tables(feedback):
    df = feedback([{"location": p, "category": c, "main_issue": i}
                   for p in "AB" for c in "xyz" for i in ("m", "n", None) for _ in range(ord(c) % 3 + 1)])
    bundle = s.build_datasets(df)
    assert list(bundle) == s.DATASET_NAMES
    for name, by in zip(s.DATASET_NAMES[1:], s.DIMENSIONS):
        assert bundle[name].collect() == s.summary_table(df, by).collect()
    plain = s.build_datasets(df.drop("category"))
    assert list(plain) == ["Feedback (Full)", "By Location"]
    assert s.build_datasets(df.limit(0)) == {}


def test_bundle_issues_with_ties_long_common_starts_and_a_hot_one(feedback):
    """All tables of the bundle against the single ones, which count whole texts."""
    rng = random.Random(4)
    start = "the same sixteen characters and more "
    issues = [start + x for x in "dcba"] + ["z", "Z", "é", "e", " z ", "None", None, ""]
    rows = [{
        "location": rng.choice(["A", "B", None, "C"]), "category": rng.choice(["x", "y", None]),
        "sentiment": rng.choice(["Positive", "Negative", None]), "severity": rng.choice(["Low", "High", None]),
        "main_issue": rng.choice(issues),
    } for _ in range(250)]
    rows += [{"location": "hot", "main_issue": start + "hot"}] * 150
    rows += [{"location": "apart", "main_issue": f"{start}{i:03}"} for i in range(40)]
    df = feedback(rows)
    bundle = s.label_tables(df)
    for name, by in zip(s.DATASET_NAMES[1:], s.DIMENSIONS):
        assert bundle[name].collect() == s.summary_table(df, by).collect()
    apart = [r["top_issues"] for r in bundle["By Location"].collect() if r["location"] == "apart"]
    assert apart == ["; ".join(f"{start}{i:03}" for i in range(3))]


def test_rollup_does_not_grow_with_the_issues(feedback, monkeypatch):
    """All issues distinct: one row for each combination of labels, and few issues kept for the last step."""
    written = []
    cut = s.cut_lineage
    monkeypatch.setattr(s, "cut_lineage", lambda df: written.append(cut(df)) or written[-1])
    df = feedback([{"location": "AB"[i % 2], "category": "xyz"[i % 3], "main_issue": f"{i:05} is broken"} for i in range(600)])
    tables = s.label_tables(df)
    rolled, rivals, leading = written
    assert rolled.count() == 6 and "issue" not in rolled.columns
    assert "issue" not in rivals.columns and rivals.count() == 3 * (2 + 3 + 1 + 1) == leading.count()
    top = {r["category"]: r["top_issues"] for r in tables["By Category"].collect()}
    assert top["y"] == "00001 is broken; 00004 is broken; 00007 is broken"


def test_csv_lines_quote_and_carry_headings(feedback):
    df = feedback([{"location": 'Hall, "B"'}, {"location": "Attic"}, {"location": "Attic", "severity": "High"}])
    text = s.datasets_to_text(s.build_datasets(df)).orderBy("dataset_no", "part", "row_no").collect()
    lines = [r["line"] for r in text]
    assert [line for line in lines if line.startswith("###")] == [f"### Dataset: {n}" for n in s.DATASET_NAMES[1:]]
    assert lines[1].startswith("Location,Reports,% of Total,Positive")
    assert lines[2].startswith("Attic,2,66.7") and lines[3].startswith('"Hall, ""B""",1,33.3')
    assert [r["row_no"] for r in text[:4]] == [0, 0, 1, 2]
    assert [line.split(",")[0] for line in lines[-2:]] == ["High", "Low"]


def test_modes_statistics_and_headline(feedback):
    df = feedback([{"category": c, "location": p} for c, p in (("b", "X"), ("a", "X"), (None, "Y"), ("b", None), ("a", "Y"))])
    head = s.headline_metrics(df).first()
    assert (head["total"], head["top_category"], head["top_location"], head["negative"]) == (5, "a", "X", 5)
    empty = s.headline_metrics(df.limit(0)).first()
    assert (empty["total"], empty["top_category"]) == (0, "-")
    stats = {(r["statistic"], r["value"]): r["n"] for r in s.dataset_stats(df.drop("severity")).collect()}
    assert stats[("total", "")] == 5 and stats[("category", "b")] == 2
    assert not any(k == "severity" for k, _ in stats)
    modes = {r["category"]: r["top_value"] for r in s.top_value_per_group(df, "category", "location").collect()}
    assert modes == {"a": "X", "b": "X"}


def test_priority_scores(feedback):
    df = feedback([
        {"category": "a", "severity": "High", "date": "2026-01-10 12:00:00"},
        {"category": "a", "severity": "Medium", "date": "2026-01-01 00:00:00"},
        {"category": "b", "severity": "odd", "date": "2026-01-08 13:00:00"},
        {"category": None, "severity": "High", "date": "2026-01-11 11:00:00"},
        {"category": "c", "severity": "Medium", "date": "2026-01-01 11:00:00"},
    ])
    rows = {r["priority_problem"]: (r["reports"], r["severity_label"], r["priority_score"])
            for r in priority_problems(df).collect()}
    # Ages against 01-11 11:00 in whole days: a 0, b 2, c 10.
    score = lambda n, w, age: round((n / 2 * 0.4 + w / 3 * 0.4 + (1 - age / 10) * 0.2) * 100, 1)
    assert rows == {"a": (2, "High", score(2, 2.5, 0)), "b": (1, "Low", score(1, 1, 2)), "c": (1, "Medium", score(1, 2, 10))}
    assert priority_problems(df.drop("severity")).collect() == []
    assert priority_problems(df.limit(0)).columns == ["priority_problem", "reports", "severity_label", "priority_score"]


def test_one_day_of_data_counts_as_recent(feedback):
    assert priority_problems(feedback([{"severity": "High"}])).first()["priority_score"] == 100.0


def test_charts(feedback):
    df = feedback([{"severity": "High", "sentiment": "Mixed"}, {"severity": None, "sentiment": None}])
    assert [(r["severity"], r["count"]) for r in charts.chart_severity(df).collect()] == [
        ("Low", 0), ("Medium", 0), ("High", 1)]
    assert [tuple(r) for r in charts.chart_sentiment(df).collect()] == [("Mixed", 1, 100.0)]
    assert charts.chart_severity(df.limit(0)).collect() == []
    assert charts.chart_sentiment(df.drop("sentiment")).collect() == []
    words = df.withColumn("keywords", F.lit("fan, heat"))
    assert [tuple(r) for r in charts.chart_keywords(words).collect()] == [("fan", 2), ("heat", 2)]


def test_no_datasets_give_no_lines(spark):
    assert s.datasets_to_text({}).collect() == []
