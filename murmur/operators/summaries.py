"""Summary tables, headline metrics and statistics.

Each table makes one pass: grouping sets count the groups, the values competing for "most
frequent" and the issues together, so the only large shuffle carries partial counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from murmur.functions.numbers import mean2, percent
from murmur.functions.ordering import top_rows
from murmur.functions.text import day_text, strip_spaces
from murmur.schema import ORD, SENTIMENTS, SEVERITY_ORDER, is_analyzed, severity_weight
from murmur.session import cut_lineage

# Issue texts that do not name an issue, dataset names and column headings.
NON_ISSUES = ["none", "analysis unavailable", ""]
DATASET_NAMES = ["Feedback (Full)", "By Location", "By Category", "By Sentiment", "By Severity"]
HEADINGS = {
    "location": "Location", "category": "Category", "sentiment": "Sentiment",
    "severity": "Severity", "reports": "Reports", "pct_of_total": "% of Total",
    "positive": "Positive", "neutral": "Neutral", "negative": "Negative", "mixed": "Mixed",
    "high_severity": "High Severity", "medium_severity": "Medium Severity",
    "low_severity": "Low Severity", "avg_severity": "Avg Severity (1-3)",
    "top_category": "Top Category", "top_location": "Top Location", "top_issues": "Top Issues",
    "first_report": "First Report", "latest_report": "Latest Report",
    "priority_problem": "Priority Problem", "severity_label": "Severity",
    "priority_score": "Priority Score",
}
ORDERS = {"sentiment": SENTIMENTS, "severity": SEVERITY_ORDER}
DIMENSIONS = ["location", "category", "sentiment", "severity"]
PREFIX = 16  # characters of an issue that go with its digest and settle most ties


def with_headings(table: DataFrame) -> DataFrame:
    """The table under its display headings."""
    return table.select(*[F.col(c).alias(HEADINGS.get(c, c)) for c in table.columns])


def issue_text(column: Column) -> Column:
    """The stripped issue, or null when it names none."""
    text = strip_spaces(column)
    return F.when(~F.lower(text).isin(NON_ISSUES), text)


def measures(df: DataFrame) -> DataFrame:
    """Just the columns summaries need, one count per row."""
    issue = issue_text(F.col("main_issue")) if "main_issue" in df.columns else F.lit(None).cast("string")
    return df.select(
        *DIMENSIONS, issue.alias("issue"),
        F.lit(1).cast("long").alias("n"), severity_weight().alias("weight"),
        F.col("date").alias("first"), F.col("date").alias("last"),
    )


def rollup_measures(measured: DataFrame) -> DataFrame:
    """Add up rows that agree in all labels: one row for each combination, whatever the texts say."""
    return measured.groupBy(*DIMENSIONS).agg(
        F.sum("n").alias("n"), F.sum("weight").alias("weight"),
        F.min("first").alias("first"), F.max("last").alias("last"),
    )


def leading_issues(measured: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most frequent issues of each value of each label: (dimension, value, rank, issue, n).

    Issues are counted by digest, so no text is shuffled with the counts. In each group the k-th
    pair of count and prefix is a bound that no better issue can miss; only issues that reach it are
    looked up in the records, and their texts settle what the prefix leaves open. Issues that tie in
    both stay until then, as rows of a join, so no group is held by one task.
    """
    digest = F.unhex(F.md5("issue")).alias("digest")
    named = measured.where(F.col("issue").isNotNull())
    labels = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    groups = ["dimension", "value"]
    counted = (
        named.select(F.inline(labels), digest, F.substring("issue", 1, PREFIX).alias("prefix"), "n")
        .where(F.col("value").isNotNull())
        .groupBy(*groups, "digest", "prefix").agg(F.sum("n").alias("n"))
    )
    bounds = (
        top_rows(counted, groups, [F.desc("n"), F.asc("prefix")], k, "rank").where(F.col("rank") == k)
        .select(*groups, F.col("n").alias("_n"), F.col("prefix").alias("_prefix"))
    )
    reached = (F.col("n") > F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("prefix") <= F.col("_prefix")))
    rivals = cut_lineage(
        counted.join(bounds, groups, "left").where(F.col("_n").isNull() | reached).select(*groups, "digest", "n")
    )
    texts = named.select(digest, "issue").join(rivals.select("digest"), "digest", "left_semi").distinct()
    ranked = top_rows(rivals.join(texts, "digest"), groups, [F.desc("n"), F.asc("issue")], k, "rank")
    return ranked.select(*groups, "rank", "issue", "n")


def most_frequent(
    df: DataFrame, keys: list[str], value: str, k: int, count: Column | None = None
) -> DataFrame:
    """The ``k`` most frequent values per group with ``n`` and ``rank``; nulls do not compete."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*keys, value]])
    counted = df.where(present).groupBy(*keys, value).agg(
        (F.count(F.lit(1)) if count is None else count).alias("n")
    )
    return top_rows(counted, keys, [F.desc("n"), F.asc(value)], k, "rank")


def top_value_per_group(df: DataFrame, by: str, value: str) -> DataFrame:
    """The most frequent value of each group, ``-`` when it has none."""
    best = most_frequent(df, [by], value, 1).select(by, value)
    groups = df.where(F.col(by).isNotNull()).select(by).distinct()
    return groups.join(best, by, "left").select(by, F.coalesce(value, F.lit("-")).alias("top_value"))


def top_issues_per_group(df: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The most frequent issues of each group joined by ``; ``, ``-`` when it has none."""
    issues = df.select(by, issue_text(F.col("main_issue")).alias("issue"))
    best = most_frequent(issues, [by], "issue", k).groupBy(by).agg(_joined_issues(k))
    groups = df.where(F.col(by).isNotNull()).select(by).distinct()
    return groups.join(best, by, "left").select(
        by, F.coalesce("top_issues", F.lit("-")).alias("top_issues")
    )


def _joined_issues(k: int, also: Column | None = None) -> Column:
    ranked = [
        F.max(F.when((F.col("rank") == i) & (F.lit(True) if also is None else also), F.col("issue")))
        for i in range(1, k + 1)
    ]
    return F.concat_ws("; ", *ranked).alias("top_issues")


def summary_table(df: DataFrame, by: str, issues: DataFrame | None = None) -> DataFrame:
    """One row per value of ``by`` from an analyzed table, or from its rolled-up measures and leading ``issues``.

    Null groups have no row but count in the total that percentages refer to.
    """
    measured = measures(df) if issues is None else df
    total = measured.agg(F.sum("n")).scalar()
    rivals = [c for c in ("category", "location") if c != by] + (["issue"] if issues is None else [])
    sums = {"n": F.sum("n"), "weight": F.sum("weight"), "first": F.min("first"), "last": F.max("last")}
    if by != "sentiment":
        sums |= {s.lower(): F.sum(F.when(F.col("sentiment") == s, F.col("n")).otherwise(0)) for s in SENTIMENTS}
    if by != "severity":
        sums |= {
            f"{s.lower()}_severity": F.sum(F.when(F.col("severity") == s, F.col("n")).otherwise(0))
            for s in SEVERITY_ORDER
        }
    # The sums read the untouched columns, the sets their copies, so grouping nulls no input.
    copies = measured.where(F.col(by).isNotNull()).withColumns({f"_{c}": F.col(c) for c in [by, *rivals]})
    grouped = copies.groupingSets(
        [[f"_{by}"], *[[f"_{by}", f"_{c}"] for c in rivals]], f"_{by}", *[f"_{c}" for c in rivals]
    ).agg(F.grouping_id().alias("_set"), *[a.alias(n) for n, a in sums.items()])
    bits = len(rivals)
    whole = (1 << bits) - 1
    set_of = {c: whole & ~(1 << (bits - 1 - i)) for i, c in enumerate(rivals)}
    value = F.coalesce(*[F.col(f"_{c}") for c in rivals])
    competing = grouped.where((F.col("_set") == whole) | value.isNotNull()).withColumn("issue", value)
    ranked = top_rows(competing, [f"_{by}", "_set"], [F.desc("n"), F.asc("issue")], 3, "rank")
    own_issues = [] if issues is not None else [_joined_issues(3, F.col("_set") == set_of["issue"])]

    def of_group(column: str) -> Column:
        return F.max(F.when(F.col("_set") == whole, F.col(column)))

    def winner(column: str) -> Column:
        first = (F.col("_set") == set_of[column]) & (F.col("rank") == 1)
        return F.coalesce(F.max(F.when(first, F.col(f"_{column}"))), F.lit("-"))

    per_group = ranked.groupBy(F.col(f"_{by}").alias(by)).agg(
        *[of_group(n).alias(n) for n in sums],
        *[winner(c).alias(f"top_{c}") for c in rivals if c != "issue"], *own_issues,
    ).withColumn("_total", total)
    if issues is not None:
        named = issues.where(F.col("dimension") == by).groupBy(F.col("value").alias(by)).agg(_joined_issues(3))
        per_group = per_group.join(named, by, "left")
    found = F.coalesce("top_issues", F.lit(""))
    table = per_group.select(
        by, F.col("n").alias("reports"), percent(F.col("n"), F.col("_total")).alias("pct_of_total"),
        *[n for n in sums if n not in ("n", "weight", "first", "last")],
        mean2(F.col("weight"), F.col("n")).alias("avg_severity"),
        *[f"top_{c}" for c in rivals if c != "issue"],
        F.when(found == "", "-").otherwise(found).alias("top_issues"),
        day_text(F.col("first")).alias("first_report"), day_text(F.col("last")).alias("latest_report"),
    )
    return table.orderBy(*display_order(by))


def display_order(by: str) -> list[Column]:
    """The row order of a summary table: a fixed one for the labels, else the largest group first."""
    if by in ORDERS:
        return [position(by, ORDERS[by]), F.asc(by)]
    return [F.desc("reports"), F.asc(by)]


def position(column: str, order: list[str]) -> Column:
    """Place of the value in an explicit order, unknown values last."""
    place = reduce(
        lambda chain, item: chain.when(F.col(column) == item[1], item[0]),
        enumerate(order), F.when(F.lit(False), -1),
    )
    return place.otherwise(len(order))


def basic_location_table(df: DataFrame) -> DataFrame:
    """Reports and dates per location, for a table that is not analyzed."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return (
        df.where(F.col("location").isNotNull()).groupBy("location")
        .agg(F.count(F.lit(1)).alias("reports"), F.min("date").alias("a"), F.max("date").alias("b"))
        .withColumn("_total", total)
        .select(
            "location", "reports", percent(F.col("reports"), F.col("_total")).alias("pct_of_total"),
            day_text(F.col("a")).alias("first_report"), day_text(F.col("b")).alias("latest_report"),
        )
        .orderBy(*display_order("location"))
    )


def full_dataset(df: DataFrame) -> DataFrame:
    """Every record with the date as ``yyyy-MM-dd``."""
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd")) if "date" in df.columns else df


def build_datasets(df: DataFrame) -> dict[str, DataFrame]:
    """The named datasets; a name is missing while its table cannot be built.

    Four summaries come from ``label_tables``.
    """
    if df.isEmpty():
        return {}
    datasets = {"Feedback (Full)": full_dataset(df)}
    if not is_analyzed(df):
        datasets["By Location"] = basic_location_table(df)
        return datasets
    return datasets | label_tables(df)


def label_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The four summary tables of an analyzed table.

    The measures are added up over all labels, and the leading issues found, once; both are written to
    the checkpoint folder, and the tables read these small results instead of the records.
    """
    measured = measures(df)
    rolled = cut_lineage(rollup_measures(measured))
    issues = cut_lineage(leading_issues(measured))
    return {name: summary_table(rolled, by, issues) for name, by in zip(DATASET_NAMES[1:], DIMENSIONS)}


def csv_lines(table: DataFrame, name: str) -> DataFrame:
    """The rows of a summary table as CSV text: (dataset, row_no, line), without the heading.

    Rows are numbered from 1 in display order. The first column is the one the table groups by;
    it has one row per group, so the numbering window holds groups, never records.
    """
    order = Window.orderBy(*display_order(table.columns[0]))
    numbered = table.withColumn("_row_no", F.row_number().over(order))
    cells = [F.col(f"`{c}`").alias(HEADINGS.get(c, c)) for c in table.columns]
    return numbered.select(
        F.lit(name).alias("dataset"), F.col("_row_no").alias("row_no"),
        F.to_csv(F.struct(*cells), {"escape": '"'}).alias("line"),
    )


def csv_heading(table: DataFrame) -> str:
    return ",".join(HEADINGS.get(c, c) for c in table.columns)


def table_lines(table: DataFrame, name: str) -> DataFrame:
    """A summary table as text: (dataset, part, row_no, line), nothing for an empty table.

    ``part`` is 0 for the title, 1 for the heading, 2 for the rows.
    """
    def opening(part: int, line: str) -> Column:
        return F.struct(
            F.lit(name).alias("dataset"), F.lit(part).alias("part"), F.lit(0).alias("row_no"), F.lit(line).alias("line")
        )

    head = table.limit(1).select(
        F.inline(F.array(opening(0, f"### Dataset: {name}"), opening(1, csv_heading(table))))
    )
    return head.unionByName(csv_lines(table, name).withColumn("part", F.lit(2)))


def datasets_to_text(datasets: dict[str, DataFrame]) -> DataFrame:
    """The summary tables as text: (dataset_no, dataset, part, row_no, line).

    Sorted by ``dataset_no``, ``part`` and ``row_no`` the lines read as one text: the tables in their
    fixed sequence, each with title, heading and rows in display order. Empty tables are left out.
    """
    blocks = [
        table_lines(datasets[name], name).withColumn("dataset_no", F.lit(number))
        for number, name in enumerate(DATASET_NAMES) if number and name in datasets
    ]
    if not blocks:
        return SparkSession.active().createDataFrame(
            [], "dataset_no int, dataset string, part int, row_no int, line string"
        )
    return reduce(DataFrame.unionByName, blocks).select("dataset_no", "dataset", "part", "row_no", "line")


def headline_metrics(df: DataFrame) -> DataFrame:
    """Total, positive, negative and high-severity counts, top category and top location."""
    copies = df.select(
        "sentiment", "severity", F.col("category").alias("_category"), F.col("location").alias("_location")
    )
    grouped = copies.groupingSets([[], ["_category"], ["_location"]], "_category", "_location").agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("sentiment") == "Positive").alias("positive"),
        F.count_if(F.col("sentiment") == "Negative").alias("negative"),
        F.count_if(F.col("severity") == "High").alias("high"),
    )
    value = F.coalesce("_category", "_location")
    competing = grouped.where((F.col("_set") == 3) | value.isNotNull()).withColumn("_value", value)
    best = top_rows(competing, ["_set"], [F.desc("n"), F.asc("_value")], 1, "rank")

    def of_all(column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("_set") == 3, F.col(column))), F.lit(0).cast("long"))

    return best.agg(
        of_all("n").alias("total"), of_all("positive").alias("positive"),
        of_all("negative").alias("negative"), of_all("high").alias("high_priority"),
        F.coalesce(F.max(F.when(F.col("_set") == 1, F.col("_value"))), F.lit("-")).alias("top_category"),
        F.coalesce(F.max(F.when(F.col("_set") == 2, F.col("_value"))), F.lit("-")).alias("top_location"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of all values of several columns in one pass: (column, value, n), nulls left out."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])
    return (
        df.select(F.inline(pairs)).where(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def dataset_stats(df: DataFrame) -> DataFrame:
    """Record total and the value counts of the columns that exist, as (statistic, value, n)."""
    present = [c for c in ("sentiment", "category", "severity", "location") if c in df.columns]
    total = df.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("total").alias("statistic"), F.lit("").alias("value"), "n"
    )
    if not present:
        return total
    counts = value_counts(df, present).withColumnRenamed("column", "statistic")
    return total.unionByName(counts)


def summary_facts(df: DataFrame, examples: int = 5) -> DataFrame:
    """The facts a written summary rests on: statistics and the first high-severity examples."""
    facts = dataset_stats(df)
    if not {"severity", "summary"} <= set(df.columns):
        return facts
    high = df.where(F.col("severity") == "High").orderBy(ORD).limit(examples)
    lines = high.select(
        F.lit("example").alias("statistic"),
        F.concat(F.lit("("), F.col("location"), F.lit(") "), F.col("summary")).alias("value"),
        F.lit(1).cast("long").alias("n"),
    )
    return facts.unionByName(lines)
