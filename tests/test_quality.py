from murmur.operators import quality as k


def test_coverage_counts_absent_values(feedback):
    df = feedback([{"location": p, "category": c} for p, c in [("A", "Safety")] * 5 + [("B", "Other"), ("B", "odd")]])
    rows = {(r["column"], r["value"]): (r["rows"], r["thin"]) for r in k.coverage_values(df).collect()}
    assert rows[("category", "Safety")] == (5, False) and rows[("category", "Internet")] == (0, True)
    assert rows[("location", "B")] == (2, True) and ("category", "odd") not in rows
    assert len(rows) == 2 + 11 + 4 + 3


def test_thin_pairs_are_intended_pairs_of_known_places(spark, feedback):
    df = feedback([{"location": p, "category": c} for p, c in [("A", "Safety")] * 5 + [("B", "Other"), ("B", "odd")]])
    assert {tuple(r) for r in k.coverage_pairs(df).collect()} == {("B", "Other", 1)}
    wanted = spark.createDataFrame([("A", "Safety"), ("A", "Other"), ("C", "Other"), ("B", "odd")], "location string, category string")
    assert {tuple(r) for r in k.coverage_pairs(df, wanted).collect()} == {("A", "Other", 0)}


def test_agreement_weighs_repeated_ids_and_counts_nulls_as_different(spark, feedback):
    df = feedback([
        {"feedback_id": "a", "category": "x"}, {"feedback_id": "a", "category": "y"},
        {"feedback_id": "b", "category": None}, {"feedback_id": "c"},
    ])
    gold = spark.createDataFrame(
        [("a", "x", "Negative", "Low"), ("a", "x", "Mixed", "Low"), ("b", None, "Negative", "High"), ("z", "x", "x", "x")],
        "feedback_id string, category string, sentiment string, severity string")
    rows = {r["label"]: (r["rows"], r["equal"], r["agreement"]) for r in k.label_agreement(df, gold).collect()}
    assert rows == {"category": (5, 2, 40.0), "sentiment": (5, 3, 60.0), "severity": (5, 4, 80.0)}


def test_rules(spark, feedback):
    good = feedback([{"location": p, "category": c, "feedback": f"{p}{c}{i}"} for p in "AB" for c in ("Safety", "Other") for i in range(5)])
    rules = lambda df, **o: {r["rule"]: r["ok"] for r in k.quality_rules(df, ["A", "B"], ["Safety", "Other"], **o).collect()}
    assert all(rules(good, min_records=20).values())
    assert [n for n, ok in rules(good).items() if not ok] == ["enough_records"]
    bad = good.unionByName(feedback([{"location": "C", "feedback": "ASafety0", "feedback_id": " "}]))
    failed = {n for n, ok in rules(bad, min_records=20).items() if not ok}
    assert failed == {"texts_unique", "no_blank_fields", "no_other_values", "every_intended_pair_sufficient"}
    wanted = spark.createDataFrame([("Z", "Safety")], "location string, category string")
    assert not rules(good, min_records=20, intended=wanted)["every_intended_pair_sufficient"]
