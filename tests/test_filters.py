import random
from datetime import date
from itertools import combinations

from murmur.operators import filters as f
from murmur.schema import FilterSpec

ORDER = ["severity", "sentiment", "category", "date_range", "location"]


def ords(df):
    return sorted(r["_ord"] for r in df.collect())


def test_selection_date_ends_and_missing_columns(feedback):
    df = feedback([
        {"date": "2026-01-05 00:00:00"}, {"date": "2026-01-06 10:00:00"}, {"date": "2026-01-06 00:00:00"},
        {"location": None}, {"date": None},
    ])
    assert ords(f.filter_date_range(df, date(2026, 1, 5), date(2026, 1, 6))) == [0, 2]
    assert ords(f.filter_multiselect(df, "location", ["Hall"])) == [0, 1, 2, 4]
    assert ords(f.filter_multiselect(df, "location", [])) == [0, 1, 2, 3, 4]
    assert ords(f.apply_filters(df.drop("category"), FilterSpec(category=["None such"]))) == [0, 1, 2, 3, 4]
    assert ords(f.apply_filters(df, FilterSpec(date_range=(date(2026, 1, 5),)))) == [0, 1, 2, 3, 4]


def test_relaxation_equals_brute_force(feedback):
    rng = random.Random(5)
    for _ in range(6):
        rows = [{
            "location": rng.choice("AB"), "category": rng.choice("CD"), "sentiment": rng.choice("EF"),
            "severity": rng.choice("GH"), "date": f"2026-01-0{rng.randint(1, 4)} 00:00:00",
        } for _ in range(rng.randint(1, 4))]
        df = feedback(rows)
        spec = FilterSpec(["A"], ["C"], rng.choice([["E"], []]), ["G"], (date(2026, 1, 2), date(2026, 1, 2)))
        active = [n for n in ORDER if spec.is_active(n)]
        tried = (c for size in range(len(active) + 1) for c in combinations(active, size))
        for names in tried:
            expected = ords(f.apply_filters(df, spec, skip=names))
            if expected:
                break
        relaxed = f.filter_with_relaxation(df, spec)
        assert ords(relaxed) == expected
        assert {r["ignored_filters"] for r in relaxed.collect()} == {", ".join(f.LABELS[n] for n in names)}


def test_relaxation_of_an_empty_table_is_empty(feedback):
    assert f.filter_with_relaxation(feedback([{}]).limit(0), FilterSpec(location=["A"])).collect() == []


def test_explanation_and_hint(feedback):
    df = feedback([{"location": "A"}, {"location": None}, {"severity": "High"}])
    spec = FilterSpec(location=["A", "B"], sentiment=["Positive"], severity=["High"])
    rows = {r["filter_name"]: (r["selected"], r["records"]) for r in f.explain_filters(df, spec).collect()}
    assert rows == {"Location": ("A, B", 1), "Sentiment": ("Positive", 0), "Severity": ("High", 1)}
    assert f.filter_hint(spec) and not f.filter_hint(FilterSpec(severity=["High"]))
    assert f.explain_filters(df, FilterSpec()).collect() == []


def test_search_and_details(feedback):
    df = feedback([{"feedback": "Broken FAN"}, {"feedback": None}, {"feedback": "fantastic"}, {"feedback": "x"}])
    assert ords(f.search_text(df, "fan$")) == [0]
    assert ords(f.search_text(df, "fan")) == [0, 2]
    assert f.feedback_details(df).columns == [
        "feedback_id", "date", "location", "feedback", "category", "sentiment", "severity"]


def test_domains(feedback):
    rows = f.filter_domains(feedback([{"location": "B"}, {"location": "A"}, {"location": None}])).collect()
    assert [r["value"] for r in rows if r["filter_name"] == "location"] == ["A", "B"]
    assert [r["value"] for r in rows if r["filter_name"].startswith("date")] == ["2026-01-01"] * 2
