import random
import re

import pytest
from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.functions.numbers import mean2, percent
from murmur.functions.ordering import number_rows

TRICKY = [
    "", " ", "wi-fi areas", "men's room", "  a\tb  c \n", "ABC def", "3rd floor", "o'neil-smith",
    "\x1cx\x1fy\x85z", "éÉ café", "日本abc", "straße ßx", "a_b c", " line ", "x" * 200, "a " * 90,
]


def randoms(n=150):
    rng = random.Random(3)
    letters = "abcXYZ éÉßñ-'_09 \t\n  \x1c\x85.,!日"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def apply(spark, texts, column):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in sorted(df.select("i", column).collect())]


@pytest.mark.parametrize("column, expected", [
    (lambda t: tx.collapse_spaces(t), lambda s: re.sub(r"\s+", " ", s.strip())),
    (lambda t: tx.strip_spaces(t), str.strip),
    (lambda t: tx.title_case(t), str.title),
    (lambda t: tx.classifier_form(t), lambda s: " " + re.sub(r"\s+", " ", s.lower()) + " "),
    (lambda t: tx.search_form(t), lambda s: re.sub(r"[^a-z0-9 ]", "", s.lower().replace("-", ""))),
])
def test_text_functions_agree_with_python(spark, column, expected):
    texts = TRICKY + randoms()
    assert apply(spark, texts, column(F.col("t"))) == [expected(t) for t in texts]


@pytest.mark.parametrize(("text", "summary"), [
    ("", ""), ("  padded\t", "padded"), ("a" * 140, "a" * 140), ("a" * 141, "a" * 137 + "..."),
    ("x" * 136 + " " + "y" * 10, "x" * 136 + "..."), ("a " * 90, "a " * 68 + "a..."),
])
def test_summaries_are_cut(spark, text, summary):
    assert apply(spark, [text], tx.truncate_summary(F.col("t"))) == [summary]


def test_query_words_keep_duplicates_and_drop_stop_words(spark):
    got = apply(spark, ["What about the Wi-Fi, wifi and campus lab heat?"], tx.query_words(F.col("t")))
    assert got == [["wifi", "wifi", "heat"]]


def test_grams_are_all_runs(spark):
    text = "abcdef gh ijkl"
    got = apply(spark, [text], tx.grams(F.col("t"), [(3, 3), (5, 5)]))[0]
    runs = [text[i:i + n] for n in (3, 5) for i in range(len(text) - n + 1)]
    assert got == [r for r in runs if " " not in r]
    longest = apply(spark, [text], tx.grams(F.col("t"), [(4, 5)]))[0]
    assert longest == ["abcde", "bcdef", "cdef", "ijkl"]


def test_rounding_is_half_up_on_exact_ratios(spark):
    df = spark.createDataFrame([(1, 16), (1, 3), (2, 3), (0, 5), (0, 0)], "k long, n long")
    rows = df.select(percent(F.col("k"), F.col("n")), mean2(F.col("k"), F.col("n"))).collect()
    assert [tuple(r) for r in rows] == [(6.3, 0.06), (33.3, 0.33), (66.7, 0.67), (0.0, 0.0), (None, None)]


def test_number_rows_is_gap_free_for_sparse_and_dense_ordinals(spark):
    rng = random.Random(1)
    ords = {*range(50), *(rng.randrange(2**62) for _ in range(200)), 2**33, 2**33 + 1}
    df = spark.createDataFrame([(o,) for o in ords], "_ord long").repartition(7)
    got = {r["_ord"]: r["n"] for r in number_rows(df, "n", bits=4).collect()}
    assert got == {o: i for i, o in enumerate(sorted(ords), 1)}
