"""Rule classifier: native column expressions only, no shuffle, no Python worker.

Each step adds its columns from those before it, so every term list is matched once per row. A
few terms are sought one by one. A large lexicon is a hash table in the plan: the short runs of a
text are looked up there, so what a row costs does not grow with the number of terms.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.text import classifier_form, string_array, strip_spaces, truncate_summary
from murmur.operators.lexicon import FALLBACK_CATEGORY, Lexicon
from murmur.schema import RESULT_FIELDS

TERM_GROUPS = ["negative", "positive", "neutral", "contrast", "both_ways", "high", "low", "mild"]
# Fixed values written into results.
NO_ISSUE = "None"
NO_ACTION = "No action needed"
EMPTY_SUMMARY = "Empty feedback."

FEW_TERMS = 300  # up to this many are sought one by one
HEAD = 600  # characters of a text that mostly hold its first keywords
STEM = 4  # characters of a term that are looked up
ENTRY, BUCKET, FIELD = "\x01", "\x02", "\x03"
_FOUND = "_found"
_TEXT, _NEG, _POS, _NEU, _CATS = "_text", "_neg", "_pos", "_neu", "_category_hits"


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the listed terms the text contains; repeats in the list count again.

    The length check names the text a second time. A column named only once would be inlined into
    the lambda and computed again for every term.
    """
    found = F.filter(string_array(terms), lambda term: F.contains(text, term))
    return F.when(F.octet_length(text) > 0, F.size(found)).otherwise(0)


def has_any(text: Column, terms: list[str]) -> Column:
    found = F.exists(string_array(terms), lambda term: F.contains(text, term))
    return F.when(F.octet_length(text) > 0, found).otherwise(False)


def with_classifier_text(df: DataFrame, text: str = "feedback") -> DataFrame:
    return df.withColumn(_TEXT, classifier_form(F.col(text)))


def stem(term: str) -> str:
    """The first characters of a term, within one word and the blanks around it."""
    inner = term.find(" ", 1)
    return term[: STEM if inner < 0 else min(STEM, inner + 1)]


def term_table(groups: dict[str, list[str]]) -> tuple[Column, int, list[int]]:
    """The terms as a hash table: a literal array of buckets by the checksum of their stems.

    A bucket is a text of entries, an entry has stem, term and the numbers of the groups that list
    the term, as often as they do. Also given are the number of buckets and the lengths of stems.
    Spark folds the split of one literal into a constant array; a literal for each term would
    have to be analysed one by one.
    """
    listed: dict[str, list[str]] = {}
    for place, terms in enumerate(groups.values()):
        for term in terms:
            listed.setdefault(term, []).append(str(place))
    if any(mark in term for term in listed for mark in (ENTRY, BUCKET, FIELD)):
        raise ValueError("a term holds a control character that separates terms")
    size = 2 * len(listed) + 1
    buckets: list[list[str]] = [[] for _ in range(size)]
    for term, places in listed.items():
        entry = FIELD.join([stem(term), term, ",".join(places)])
        buckets[zlib.crc32(stem(term).encode()) % size].append(entry)
    table = F.split(F.lit(BUCKET.join(ENTRY.join(b) for b in buckets)), BUCKET, -1)
    return table, size, sorted({len(stem(t)) for t in listed})


def with_found(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Add the numbers of the groups whose terms the text contains, once for each listing.

    Each distinct word of the text, with a blank on both sides, is cut into its overlapping runs,
    and the distinct runs are looked up by their first characters. What is met is verified in the text.
    """
    table, size, lengths = term_table(groups)
    words = F.array_join(F.array_distinct(F.split(F.col(_TEXT), " ")), "  ")
    runs = F.regexp_extract_all(F.concat(F.lit(" "), words, F.lit(" ")), F.lit(f"(?s)(?=(.{{{min(lengths)},{STEM}}}))"), F.lit(1))

    def looked_up(run: Column) -> Column:
        def of_length(n: int) -> Column:
            head = F.substring(run, 1, n)
            bucket = F.get(table, (F.crc32(head.cast("binary")) % size).cast("int"))
            own = F.filter(F.split(bucket, ENTRY), lambda entry: F.startswith(entry, F.concat(head, F.lit(FIELD))))
            return F.when(bucket != "", own).otherwise(string_array([]))

        return F.concat(*map(of_length, lengths))

    met = df.withColumn("_runs", F.array_distinct(runs))
    entries = F.transform(F.array_distinct(F.flatten(F.transform("_runs", looked_up))), lambda e: F.split(e, FIELD))
    met = met.withColumn("_met", F.when(F.size("_runs") > 0, entries))
    def occurs(entry: Column) -> Column:
        whole = (entry[0] == entry[1]) & ~F.contains(entry[1], F.lit("  "))  # words stand two blanks apart here
        return whole | F.contains(F.col(_TEXT), entry[1])

    verified = F.filter(F.col("_met"), occurs)
    numbers = F.flatten(F.transform(verified, lambda entry: F.split(entry[2], ",")))
    # As in hits() the text is named outside the lambda as well.
    return met.withColumn(_FOUND, F.when(F.octet_length(_TEXT) > 0, numbers)).drop("_runs", "_met")


class Matcher:
    """How often the terms of a group occur in the classifier's text.

    Terms are looked up if there are many, except for those without a whole stem as long as these
    are few: each length of stems costs a lookup of every run.
    """

    def __init__(self, lexicon: Lexicon):
        groups = {g: getattr(lexicon, g) for g in TERM_GROUPS}
        self.categories = [f"category {i}" for i in range(len(lexicon.categories))]
        groups |= dict(zip(self.categories, lexicon.categories.values(), strict=True))
        odd = {g: [t for t in terms if len(stem(t)) < STEM] for g, terms in groups.items()}
        if sum(map(len, groups.values())) <= FEW_TERMS:
            odd = groups
        elif sum(map(len, odd.values())) > FEW_TERMS:
            odd = {g: [t for t in terms if not t] for g, terms in groups.items()}
        self.one_by_one = odd
        self.looked_up = {g: [t for t in terms if t not in set(odd[g])] for g, terms in groups.items()}

    def prepared(self, df: DataFrame) -> DataFrame:
        return with_found(df, self.looked_up) if any(self.looked_up.values()) else df

    def hits(self, group: str) -> Column:
        few = hits(F.col(_TEXT), self.one_by_one[group])
        if not self.looked_up[group]:
            return few
        number = str(list(self.looked_up).index(group))
        return few + F.size(F.filter(F.coalesce(_FOUND, string_array([])), lambda n: n == number))

    def has_any(self, group: str) -> Column:
        few = has_any(F.col(_TEXT), self.one_by_one[group])
        return few | F.coalesce(F.array_contains(_FOUND, str(list(self.looked_up).index(group))), F.lit(False)) if self.looked_up[group] else few


def with_hits(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Add the hits of each group; ``_TEXT`` has to be there."""
    match = Matcher(lexicon)
    return match.prepared(df).withColumns({
        _NEG: match.hits("negative"),
        _POS: match.hits("positive"),
        _NEU: match.hits("neutral"),
        _CATS: F.array(*[match.hits(c) for c in match.categories]),
    })


def sentiment(lexicon: Lexicon) -> Column:
    """The first rule that applies: both ways, neutral cues, positive, negative, mild wording."""
    match, neg, pos, neu = Matcher(lexicon), F.col(_NEG), F.col(_POS), F.col(_NEU)
    torn = (pos > 0) & (neg > 0) & match.has_any("contrast")
    mild = match.has_any("low") | match.has_any("high") | match.has_any("mild")
    return (
        F.when(match.has_any("both_ways") | torn, "Mixed")
        .when((neu > 0) & (pos == 0) & (neg <= neu), "Neutral")
        .when(pos > neg, "Positive")
        .when(neg > 0, "Negative")
        .when(mild, "Negative")
        .otherwise("Neutral")
    )


def category(lexicon: Lexicon) -> Column:
    """The category with most hits; the lexicon's order decides ties."""
    if not lexicon.categories:
        return F.lit(FALLBACK_CATEGORY)
    scores, best = F.col(_CATS), F.array_max(_CATS)
    winner = F.get(string_array(list(lexicon.categories)), F.array_position(scores, best) - 1)
    return F.when(best > 0, winner).otherwise(FALLBACK_CATEGORY)


def severity(lexicon: Lexicon) -> Column:
    match = Matcher(lexicon)
    return (
        F.when(
            F.col("sentiment") == "Negative",
            F.when(match.has_any("high"), "High")
            .when(match.has_any("low"), "Low")
            .otherwise("Medium"),
        )
        .when(F.col("sentiment") == "Mixed", "Medium")
        .otherwise("Low")
    )


def keywords(text: Column, stop: list[str], limit: int = 4) -> Column:
    """The first distinct tokens of four or more characters that are not stop words.

    They are sought in the begin of the text, in all of it only where that holds too few. A token of the
    begin counts if another character follows, so none is cut.
    """

    def first(some: Column, pattern: str) -> Column:
        tokens = F.regexp_extract_all(some, F.lit(pattern), F.lit(1))
        return F.slice(F.array_except(tokens, string_array(stop)), 1, limit)  # distinct, in order

    early = first(F.substring(text, 1, HEAD), r"([a-z][a-z\-]{3,}+)(?=[^a-z\-])")
    return F.when(F.size(early) >= limit, early).otherwise(first(text, r"([a-z][a-z\-]{3,})"))


def classify(df: DataFrame, lexicon: Lexicon, text: str = "feedback") -> DataFrame:
    """Add the seven result columns; a blank text gets the fixed neutral record."""
    blank = F.coalesce(strip_spaces(F.col(text)) == "", F.lit(True))
    calm = F.col("sentiment").isin("Positive", "Neutral")
    actions = F.get(
        string_array([lexicon.actions.get(c, NO_ACTION) for c in lexicon.categories]),
        F.array_position(string_array(list(lexicon.categories)), F.col("category")) - 1,
    )
    scored = (
        with_hits(with_classifier_text(df, text), lexicon)
        .withColumn("_blank", blank)
        .withColumns({
            "sentiment": F.when(F.col("_blank"), "Neutral").otherwise(sentiment(lexicon)),
            "category": F.when(F.col("_blank"), FALLBACK_CATEGORY).otherwise(category(lexicon)),
        })
    )
    return scored.withColumns({
        "severity": F.when(F.col("_blank"), "Low").otherwise(severity(lexicon)),
        "keywords": F.when(F.col("_blank"), F.array().cast("array<string>"))
        .otherwise(keywords(F.col(_TEXT), lexicon.stop)),
        "main_issue": F.when(calm, NO_ISSUE).otherwise(F.concat(F.col("category"), F.lit(" issue"))),
        "summary": F.when(F.col("_blank"), EMPTY_SUMMARY).otherwise(truncate_summary(F.col(text))),
        "suggested_action": F.when(calm, NO_ACTION).otherwise(F.coalesce(actions, F.lit(NO_ACTION))),
    }).drop(_TEXT, _FOUND, _NEG, _POS, _NEU, _CATS, "_blank")


def classify_as_result(df: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Like ``classify`` but as one ``result`` struct."""
    names = [n for n in RESULT_FIELDS if n != "analysis_error"]
    no_error = F.lit(None).cast("string").alias("analysis_error")
    return classify(df, lexicon).withColumn("result", F.struct(*names, no_error)).drop(*names)


def flatten_keywords(df: DataFrame) -> DataFrame:
    """Keywords as one comma-separated text, for display and export."""
    return df.withColumn("keywords", F.array_join("keywords", ", "))
