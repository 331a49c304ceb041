import pytest

from murmur.operators.cleaning import clean_feedback, require_rows
from murmur.schema import ValidationError

SCHEMA = "_ord long, feedback_id string, date string, location string, feedback string"
DAY = "2026-06-01"


def clean(spark, rows, **options):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)
    return clean_feedback(df, **options).orderBy("_ord")


def ords(df):
    return [r["_ord"] for r in df.collect()]


def test_steps_and_their_order(spark):
    df = clean(spark, [
        ("a", "not a date", "hall", "one"),     # shadows the next row, then goes itself
        ("a", DAY, "hall", "two"),
        ("b", DAY, "  main\thall ", " x  y "),
        ("c", DAY, "main hall", "x y"),         # same content under another id
        ("d", DAY, "MAIN HALL", "x y"),         # case variants survive
        ("e", DAY, None, "place unknown"),
        ("f", DAY, "None", "odd place"),
        ("g", DAY, "wi-fi areas", "nan"),
        ("h", DAY, "x", None),
        ("i", "2026-06-01 10:30:00", "men's", "late"),
        ("j", "01/06/2026", "x", "other format"),
    ])
    rows = {r["_ord"]: r for r in df.collect()}
    assert sorted(rows) == [2, 4, 5, 6, 9]
    assert rows[2]["location"] == "Main Hall" and rows[2]["feedback"] == "x y"
    assert rows[5]["location"] == "Unspecified" and rows[6]["location"] == "None"
    assert rows[9]["location"] == "Men'S" and rows[9]["date"].hour == 10


def test_rows_without_id_are_one_record_unless_told_otherwise(spark):
    rows = [(None, DAY, "a", "1"), (None, DAY, "a", "2"), ("x", DAY, "a", "3")]
    assert ords(clean(spark, rows)) == [0, 2]
    assert ords(clean(spark, rows, null_ids_are_equal=False)) == [0, 1, 2]


def test_cleaning_again_changes_nothing(spark):
    rows = [(str(i % 7), DAY, f"zone  {i % 3}", f"text {i % 5}") for i in range(40)]
    once = clean(spark, rows)
    assert clean_feedback(once).orderBy("_ord").collect() == once.collect()


def test_a_third_of_all_rows_under_one_key(spark):
    rows = [("hot" if i % 3 == 0 else str(i), DAY, "a", "same" if i % 3 == 1 else str(i)) for i in range(3000)]
    seen_ids, seen_text, expected = set(), set(), []
    for i, (key, _, place, text) in enumerate(rows):
        if key in seen_ids:
            continue
        seen_ids.add(key)
        if (place, text) not in seen_text:
            seen_text.add((place, text))
            expected.append(i)
    assert ords(clean(spark, rows)) == expected


def test_errors(spark):
    with pytest.raises(ValidationError, match="Missing required column.*date, feedback.*Expected"):
        clean_feedback(spark.createDataFrame([("a", "b")], "feedback_id string, location string"))
    with pytest.raises(ValidationError, match="After cleaning"):
        require_rows(clean(spark, [("a", "never", "x", "y")]))
