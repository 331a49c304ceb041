"""The registered queries: each operator over the given tables, and the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.functions import text as tx
from murmur.operators import charts, classify, cleaning, context, enrich, filters, quality, questions, ranking
from murmur.operators import replies, summaries
from murmur.operators.lexicon import SAMPLE
from murmur.operators.priority import priority_problems
from murmur.plans import bindings as b
from murmur.plans.bindings import quoted, sql_hits, sql_list, sql_strip, with_bindings
from murmur.schema import CATEGORIES, ORD, SENTIMENTS, SEVERITIES, FilterSpec
from murmur.session import shared_folder
from murmur.sources import append, cache, feedback

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def keep(run: Run) -> Run:
        QUERIES[name] = Query(run, sql)
        return run

    return keep


ROW = "_ord, feedback_id, date, location, feedback"
WS = b.WS


# --- sources -----------------------------------------------------------------------------------

@register("scan_feedback", "select doc_id _ord, doc_id, text, source from documents")
def _(spark, sf):
    loaded = feedback.load_feedback(spark, f"{sf}/documents.parquet", "parquet", sequence="doc_id")
    return loaded.select(ORD, "doc_id", "text", "source")


@register("preview_rows", with_bindings("d", f"select {ROW} from d order by _ord limit 10"))
def _(spark, sf):
    return feedback.preview(b.document_feedback(spark, sf))


@register("dataset_summary", with_bindings("e", """
    select count(*) total_records, count(distinct location) unique_locations,
           min(date) first_date, max(date) last_date from e"""))
def _(spark, sf):
    return feedback.dataset_summary(b.events_feedback(spark, sf))


@register("append_new_rows", with_bindings("d new", f"""
    , known as (select distinct {sql_strip('feedback')} t from d),
    added as (select *, row_number() over (order by _ord) + (select max(_ord) from d) no
              from new where feedback not in (select t from known))
    select printf('FB%04d', _ord) feedback_id, strftime(date, '%Y-%m-%d') date, location, feedback from d
    union all select printf('FB%04d', no), date, location, feedback from added"""))
def _(spark, sf):
    return append.append_new(b.stored_feedback(spark, sf), b.new_feedback(spark, sf))


def _csv_sql(by: str, name: str) -> str:
    columns = _SUMMARY_COLUMNS[by]
    cells = [f"coalesce(cast({c} as varchar), '')" for c in columns]
    quoting = "case when regexp_matches({0}, '[,\"]') then '\"' || replace({0}, '\"', '\"\"') || '\"' else {0} end"
    line = " || ',' || ".join(quoting.format(c) for c in cells)
    heading = ",".join(summaries.HEADINGS[c] for c in columns)
    listed = summaries.ORDERS.get(by)
    order = f"coalesce(list_position({sql_list(listed)}, {by}), 99), {by}" if listed else f"reports desc, {by}"
    start = f"select {summaries.DATASET_NAMES.index(name)} dataset_no, {quoted(name)} dataset"
    return (
        f"{start}, 0 part, 0 row_no, {quoted('### Dataset: ' + name)} line union all "
        f"{start}, 1, 0, {quoted(heading)} union all "
        f"{start}, 2, (row_number() over (order by {order}))::int, {line} from s_{by}"
    )


# --- cleaning ----------------------------------------------------------------------------------

def _sql_spaces(column: str) -> str:
    return f"trim(regexp_replace({column}, '{WS}+', ' ', 'g'))"


_NORMAL = ("normal", f"select _ord, {_sql_spaces('feedback_id')} feedback_id, date, "
           f"{_sql_spaces('location')} location, {_sql_spaces('feedback')} feedback from raw")
_TEXTED = ("texted", "select * from normal where feedback not in ('nan', 'None', '')")
_FILLED = ("filled", "select * replace (case when location is null or location in ('nan', '') "
           "then 'Unspecified' else location end as location) from texted")
_BY_ID = ("by_id", "select * exclude rn from (select * replace (coalesce(feedback_id, 'nan') as feedback_id), "
          "row_number() over (partition by coalesce(feedback_id, 'nan') order by _ord) rn from filled) where rn = 1")
_BY_TEXT = ("by_text", "select * exclude rn from (select *, row_number() over "
            "(partition by location, feedback order by _ord) rn from by_id) where rn = 1")


def _sql_title(column: str) -> str:
    cased = r"\p{Ll}\p{Lu}\p{Lt}"
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({column}), '[{cased}]+|[^{cased}]+'), "
        "lambda w: case when w[1] = 'ß' then 'Ss' else upper(w[1]) end || w[2:]), '')"
    )


_TITLED = ("titled", f"select * replace ({_sql_title('location')} as location) from by_text")
_SQL_DATE = "try_strptime(date, '%Y-%m-%d')"


def _cleaning_sql(*steps: tuple[str, str], body: str) -> str:
    ctes = "".join(f", {n} as ({s})" for n, s in steps)
    return with_bindings("raw", f"{ctes} {body}")


def _normal(spark, sf):
    return cleaning.normalize_whitespace(b.raw_feedback(spark, sf))


def _filled(spark, sf):
    return cleaning.fill_location(cleaning.drop_blank_text(_normal(spark, sf)))


@register("normalize_whitespace", _cleaning_sql(_NORMAL, body=f"select {ROW} from normal"))
def _(spark, sf):
    return _normal(spark, sf)


@register("drop_blank_text", _cleaning_sql(_NORMAL, _TEXTED, body=f"select {ROW} from texted"))
def _(spark, sf):
    return cleaning.drop_blank_text(_normal(spark, sf))


@register("fill_location", _cleaning_sql(_NORMAL, _TEXTED, _FILLED, body=f"select {ROW} from filled"))
def _(spark, sf):
    return _filled(spark, sf)


@register("dedup_by_id", _cleaning_sql(_NORMAL, _TEXTED, _FILLED, _BY_ID, body=f"select {ROW} from by_id"))
def _(spark, sf):
    return cleaning.dedup_by_id(cleaning.fill_id(_filled(spark, sf)))


@register("dedup_by_content", _cleaning_sql(
    _NORMAL, _TEXTED, _FILLED, _BY_ID, _BY_TEXT, body=f"select {ROW} from by_text"))
def _(spark, sf):
    return cleaning.dedup_by_content(cleaning.dedup_by_id(cleaning.fill_id(_filled(spark, sf))))


@register("title_case", _cleaning_sql(
    _NORMAL, body=f"select _ord, {_sql_title('location')} location, "
    f"{_sql_title('substr(feedback, 1)')} feedback from normal"))
def _(spark, sf):
    titled = cleaning.title_case_location(_normal(spark, sf))
    return titled.select(ORD, "location", tx.title_case(F.col("feedback")).alias("feedback"))


@register("parse_dates", with_bindings(
    "raw", f"select _ord, {_SQL_DATE} date, location from raw where {_SQL_DATE} is not null"))
def _(spark, sf):
    return cleaning.parse_dates(b.raw_feedback(spark, sf)).select(ORD, "date", "location")


_DAY = "DATE '2026-06-01' + cast(doc_id % 111 as int)"


@register("parse_dates_formats", f"""
    with d as (select doc_id, {_DAY} as day_read from documents)
    select doc_id _ord, case doc_id % 4 when 2 then cast(day_read as timestamp) + interval 570 minute
           else cast(day_read as timestamp) end date,
           (select count(*) from d where doc_id % 4 = 3) unreadable
    from d where doc_id % 4 <> 3""")
def _(spark, sf):
    # A quarter of the dates each: ISO, day first, with a time of day, and in a form nobody named.
    forms = ["yyyy-MM-dd", "dd/MM/yyyy", "yyyy.MM.dd HH:mm", "'on' dd MM yyyy"]
    moment = F.expr("timestamp_ntz '2026-06-01 09:30:00' + make_dt_interval(cast(doc_id % 111 as int))")
    written = F.coalesce(*[
        F.when(F.col("doc_id") % 4 == i, F.date_format(moment, form)) for i, form in enumerate(forms)
    ])
    raw = b.documents(spark, sf).select(F.col("doc_id").alias(ORD), written.alias("date"))
    total = cleaning.unreadable_dates(raw, forms[1:3]).select("unreadable").scalar()
    return cleaning.parse_dates(raw, forms[1:3]).withColumn("unreadable", total)


@register("clean_feedback", _cleaning_sql(
    _NORMAL, _TEXTED, _FILLED, _BY_ID, _BY_TEXT, _TITLED,
    body=f"select _ord, feedback_id, {_SQL_DATE} date, location, feedback from titled "
    f"where {_SQL_DATE} is not null"))
def _(spark, sf):
    return cleaning.clean_feedback(b.raw_feedback(spark, sf)).select(*ROW.split(", "))


# --- filters -----------------------------------------------------------------------------------

SPEC = FilterSpec(
    location=["Zone 1", "Zone 3", "Zone 4"], category=["error", "click", "view"],
    sentiment=["Negative", "Mixed"], severity=["High", "Medium"],
    date_range=(date(2024, 1, 5), date(2024, 1, 20)),
)
# Sign-ups are never negative and the range holds midnight only.
STRICT = FilterSpec(
    location=["Zone 2"], category=["signup"], sentiment=["Negative"], severity=["High", "Medium"],
    date_range=(date(2024, 1, 5), date(2024, 1, 5)),
)


def _sql_filter(spec: FilterSpec, name: str) -> str:
    if name == "date_range":
        start, end = spec.date_range
        return f"(date >= timestamp '{start} 00:00:00' and date <= timestamp '{end} 00:00:00')"
    return f"({name} in ({', '.join(quoted(v) for v in getattr(spec, name))}))"


def _sql_relaxed(spec: FilterSpec) -> str:
    """Brute force: count the rows under every set of dropped filters, take the first non-empty."""
    order = filters.RELAX_ORDER
    sets = [c for size in range(len(order) + 1) for c in combinations(order, size)]
    rows = ", ".join(
        f"({i}, {quoted(', '.join(filters.LABELS[n] for n in c))}, "
        + ", ".join("true" if n in c else "false" for n in order) + ")"
        for i, c in enumerate(sets)
    )
    names = ", ".join(f"drop_{n}" for n in order)
    passes = " and ".join(f"(drop_{n} or coalesce({_sql_filter(spec, n)}, false))" for n in order)
    return f""", sets as (select * from (values {rows}) v(place, ignored_filters, {names})),
        hits as (select place, ignored_filters, _ord, e.location, e.category, e.sentiment, e.severity
                 from e, sets where {passes})
        select _ord, location, category, sentiment, severity, ignored_filters from hits
        where place = (select min(place) from hits)"""


_LABELLED = [ORD, "location", "category", "sentiment", "severity"]
_LABELLED_SQL = ", ".join(_LABELLED)


@register("filter_multiselect", with_bindings(
    "e", f"select {_LABELLED_SQL} from e where {_sql_filter(SPEC, 'location')}"))
def _(spark, sf):
    e = b.events_feedback(spark, sf)
    chosen = filters.filter_multiselect(e, "location", SPEC.location)
    return filters.filter_multiselect(chosen, "severity", []).select(*_LABELLED)


@register("filter_date_range", with_bindings(
    "e", f"select _ord, date from e where {_sql_filter(SPEC, 'date_range')}"))
def _(spark, sf):
    return filters.filter_date_range(b.events_feedback(spark, sf), *SPEC.date_range).select(ORD, "date")


@register("filter_combined", with_bindings(
    "e", f"select {_LABELLED_SQL} from e where " + " and ".join(
        _sql_filter(SPEC, n) for n in ("location", "category", "sentiment", "date_range"))))
def _(spark, sf):
    kept = filters.apply_filters(b.events_feedback(spark, sf), SPEC, skip=("severity",))
    return kept.select(*_LABELLED)


@register("filter_relaxation", with_bindings("e", _sql_relaxed(STRICT)))
def _(spark, sf):
    kept = filters.filter_with_relaxation(b.events_feedback(spark, sf), STRICT)
    return kept.select(*_LABELLED, "ignored_filters")


@register("filter_explain", with_bindings("e", " union all ".join(
    f"select {quoted(filters.LABELS[n])} filter_name, {quoted(', '.join(getattr(STRICT, n)))} selected, "
    f"count(*) records from e where {_sql_filter(STRICT, n)}" for n in filters.SELECTIONS)))
def _(spark, sf):
    return filters.explain_filters(b.events_feedback(spark, sf), STRICT)


@register("search_text", with_bindings(
    "d", "select _ord, feedback_id, location from d where regexp_matches(feedback, '(?i)heat|trash[a-z]* |^the')"))
def _(spark, sf):
    found = filters.search_text(b.document_feedback(spark, sf), "heat|trash[a-z]* |^the")
    return found.select(ORD, "feedback_id", "location")


@register("feedback_details", with_bindings(
    "da", "select feedback_id, date, location, feedback, category, sentiment, severity, keywords, "
    "summary, suggested_action from da"))
def _(spark, sf):
    return filters.feedback_details(classify.flatten_keywords(b.analyzed_documents(spark, sf)))


@register("filter_domains", with_bindings("e", "select distinct 'location' filter_name, location \"value\" from e "
    "union all select * from (values " + ", ".join(
        f"({quoted(n)}, {quoted(v)})" for n, values in
        (("category", CATEGORIES), ("sentiment", SENTIMENTS), ("severity", SEVERITIES)) for v in values)
    + ") v(filter_name, \"value\") union all select 'date_min', strftime(min(date), '%Y-%m-%d') from e "
    "union all select 'date_max', strftime(max(date), '%Y-%m-%d') from e"))
def _(spark, sf):
    return filters.filter_domains(b.events_feedback(spark, sf))


# --- aggregations ------------------------------------------------------------------------------

_ISSUE = f"case when lower({sql_strip('main_issue')}) not in ('none', 'analysis unavailable', '') then {sql_strip('main_issue')} end"
_WEIGHT = "case severity when 'High' then 3 when 'Medium' then 2 else 1 end"


def _sql_mode(by: str, value: str) -> str:
    return (
        f"select {by}, {value} top from (select {by}, {value}, row_number() over (partition by {by} "
        f"order by count(*) desc, {value}) rn from e where {value} is not null group by 1, 2) where rn = 1"
    )


def _sql_issues(by: str) -> str:
    return (
        f"select {by}, string_agg(issue, '; ' order by rn) top_issues from (select {by}, issue, row_number() over "
        f"(partition by {by} order by count(*) desc, issue) rn from (select {by}, {_ISSUE} issue from e) "
        f"where issue is not null group by 1, 2) where rn <= 3 group by 1"
    )


_SENTIMENT_COLUMNS = ["positive", "neutral", "negative", "mixed"]
_SEVERITY_COLUMNS = ["high_severity", "medium_severity", "low_severity"]
_SUMMARY_COLUMNS = {
    by: [by, "reports", "pct_of_total"]
    + (_SENTIMENT_COLUMNS if by != "sentiment" else []) + (_SEVERITY_COLUMNS if by != "severity" else [])
    + ["avg_severity"] + [f"top_{c}" for c in ("category", "location") if c != by]
    + ["top_issues", "first_report", "latest_report"]
    for by in summaries.DIMENSIONS
}


def _sql_summary(by: str) -> str:
    counts = [f"count(*) filter (sentiment = {quoted(s)}) {s.lower()}" for s in SENTIMENTS if by != "sentiment"]
    counts += [f"count(*) filter (severity = {quoted(s)}) {s.lower()}_severity" for s in SEVERITIES if by != "severity"]
    tops = [c for c in ("category", "location") if c != by]
    return (
        f"select g.{by}, reports, ((2000 * reports + total) // (2 * total)) / 10::double pct_of_total, "
        + "".join(f"{c.split()[-1]}, " for c in counts)
        + "((200 * w + reports) // (2 * reports)) / 100::double avg_severity, "
        + "".join(f"coalesce(m_{c}.top, '-') top_{c}, " for c in tops)
        + "coalesce(i.top_issues, '-') top_issues, coalesce(strftime(a, '%Y-%m-%d'), '-') first_report, "
        "coalesce(strftime(z, '%Y-%m-%d'), '-') latest_report "
        f"from (select {by}, count(*) reports, sum({_WEIGHT})::bigint w, min(date) a, max(date) z"
        + "".join(f", {c}" for c in counts)
        + f" from e where {by} is not null group by 1) g cross join (select count(*) total from e) "
        + "".join(f"left join ({_sql_mode(by, c)}) m_{c} on m_{c}.{by} = g.{by} " for c in tops)
        + f"left join ({_sql_issues(by)}) i on i.{by} = g.{by}"
    )


def _register_summary(by: str) -> None:
    @register(f"summary_by_{by}", with_bindings("e", _sql_summary(by)))
    def _(spark, sf):
        return summaries.summary_table(b.events_feedback(spark, sf), by)


for _by in summaries.DIMENSIONS:
    _register_summary(_by)


@register("summary_csv_lines", with_bindings(
    "e", "".join(f", s_{by} as ({_sql_summary(by)})" for by in summaries.DIMENSIONS) + " "
    + " union all ".join(_csv_sql(by, n) for n, by in zip(summaries.DATASET_NAMES[1:], summaries.DIMENSIONS))))
def _(spark, sf):
    return summaries.datasets_to_text(summaries.build_datasets(b.events_feedback(spark, sf)))


@register("basic_location_table", with_bindings("d", """
    select location, count(*) reports,
           ((2000 * count(*) + (select count(*) from d)) // (2 * (select count(*) from d))) / 10::double pct_of_total,
           strftime(min(date), '%Y-%m-%d') first_report, strftime(max(date), '%Y-%m-%d') latest_report
    from d group by 1"""))
def _(spark, sf):
    return summaries.basic_location_table(b.document_feedback(spark, sf))


@register("full_dataset", with_bindings("e", "select * replace (strftime(date, '%Y-%m-%d') as date) from e"))
def _(spark, sf):
    return summaries.full_dataset(b.events_feedback(spark, sf))


@register("headline_metrics", with_bindings("e", """
    select count(*) total, count(*) filter (sentiment = 'Positive') positive,
           count(*) filter (sentiment = 'Negative') negative, count(*) filter (severity = 'High') high_priority,
           (select category from e group by 1 order by count(*) desc, 1 limit 1) top_category,
           (select location from e group by 1 order by count(*) desc, 1 limit 1) top_location from e"""))
def _(spark, sf):
    return summaries.headline_metrics(b.events_feedback(spark, sf))


@register("top_value_per_group", with_bindings(
    "e", f"select location, top top_value from ({_sql_mode('location', 'main_issue')})"))
def _(spark, sf):
    return summaries.top_value_per_group(b.events_feedback(spark, sf), "location", "main_issue")


@register("top_issues_per_group", with_bindings("e", _sql_issues("category")))
def _(spark, sf):
    return summaries.top_issues_per_group(b.events_feedback(spark, sf), "category")


@register("priority_problems", with_bindings("e", f"""
    , g as (select category, count(*) n, sum({_WEIGHT})::bigint w, max(date) recent from e
            where category is not null group by 1),
    a as (select *, floor(date_diff('microsecond', recent, (select max(date) from e)) / 86400000000)::bigint age from g),
    m as (select max(n) mn, case when max(age) > 0 then max(age) else 1 end ma from a)
    select category priority_problem, n reports,
           case when 2 * w >= 5 * n then 'High' when 2 * w >= 3 * n then 'Medium' else 'Low' end severity_label,
           round(((n / mn::double) * 0.4::double + ((w / n::double) / 3::double) * 0.4::double
                  + (1::double - age / ma::double) * 0.2::double) * 100::double, 1) priority_score
    from a, m"""))
def _(spark, sf):
    return priority_problems(b.events_feedback(spark, sf))


@register("chart_sentiment", with_bindings("e", """
    select sentiment, count(*) count,
           ((2000 * count(*) + (select count(sentiment) from e)) // (2 * (select count(sentiment) from e))) / 10::double share
    from e group by 1"""))
def _(spark, sf):
    return charts.chart_sentiment(b.events_feedback(spark, sf))


@register("chart_location", with_bindings("e", "select location, count(*) count from e group by 1"))
def _(spark, sf):
    return charts.chart_location(b.events_feedback(spark, sf))


@register("chart_severity", with_bindings("e", """
    select position, v.severity, count(e.severity) count
    from (values (1, 'Low'), (2, 'Medium'), (3, 'High')) v(position, severity)
    left join e on e.severity = v.severity group by 1, 2"""))
def _(spark, sf):
    return charts.chart_severity(b.events_feedback(spark, sf))


@register("chart_category", with_bindings("e", "select category, count(*) count from e group by 1"))
def _(spark, sf):
    return charts.chart_category(b.events_feedback(spark, sf))


@register("chart_over_time", with_bindings(
    "e", "select cast(date_trunc('week', date) as timestamp) period, category, count(*) count from e group by 1, 2"))
def _(spark, sf):
    return charts.chart_over_time(b.events_feedback(spark, sf))


@register("chart_keywords", with_bindings("da", """
    select keyword, count(*) count from (select unnest(string_split(keywords, ', ')) keyword from da)
    where keyword <> '' group by 1 order by 2 desc, 1 limit 20"""))
def _(spark, sf):
    return charts.chart_keywords(b.analyzed_documents(spark, sf))


_STATS = "select 'total' statistic, '' \"value\", count(*) n from e" + "".join(
    f" union all select {quoted(c)}, {c}, count(*) from e where {c} is not null group by 2"
    for c in summaries.DIMENSIONS)


@register("dataset_stats", with_bindings("e", _STATS))
def _(spark, sf):
    return summaries.dataset_stats(b.events_feedback(spark, sf))


@register("summary_facts", with_bindings("e", _STATS + " union all select * from (select 'example', "
    "'(' || location || ') ' || summary, 1 from e where severity = 'High' order by _ord limit 5)"))
def _(spark, sf):
    return summaries.summary_facts(b.events_feedback(spark, sf))


# --- rankings ----------------------------------------------------------------------------------

_COMPLAINT = "sentiment in ('Negative', 'Mixed')"


def _sql_top(column: str, where: str, k: int) -> str:
    return with_bindings("e", f"""
        select row_number() over (order by count(*) desc, {column})::int rank, {column} "value", count(*) n
        from e where {where} and {column} is not null group by {column} order by 1 limit {k}""")


@register("top_locations", _sql_top("location", _COMPLAINT, 3))
def _(spark, sf):
    return questions.top_locations(b.events_feedback(spark, sf))


@register("top_categories", _sql_top("category", _COMPLAINT, 4))
def _(spark, sf):
    return questions.top_categories(b.events_feedback(spark, sf))


@register("top_actions", _sql_top(
    "suggested_action", "lower(suggested_action) not in ('no action needed', 'review manually.', '')", 5))
def _(spark, sf):
    return questions.top_actions(b.events_feedback(spark, sf))


CONTEXT_QUESTION = "Which signup errors or purchases of user 23 went wrong in zone 4?"
QUESTION = "Is the heating near the gate broken, or do trash and odors bother people of src12?"


def _words_sql(question: str) -> str:
    return (
        f"list_transform(list_filter(regexp_extract_all(regexp_replace(replace(lower({question}), '-', ''), "
        f"'[^a-z0-9 ]', '', 'g'), '[a-z0-9]+'), lambda w: length(w) >= 4 and not list_contains("
        f"{sql_list(tx.SEARCH_STOP_WORDS)}, w)), lambda w: w[1:5])"
    )


def _search_sql(column: str) -> str:
    return f"regexp_replace(replace(lower({column}), '-', ''), '[^a-z0-9 ]', '', 'g')"


def _relevant_sql(source: str, question: str) -> str:
    return f""", texts as (select *, {_search_sql('feedback')} || ' ' || {_search_sql('location')} _search from {source}),
    scored as (select *, case when (select count(*) from {source}) > 150 then
               len(list_filter({_words_sql(quoted(question))}, lambda w: contains(_search, w))) * 10 + {_WEIGHT}
               else 0 end score from texts),
    best as (select *, row_number() over (order by score desc, _ord) rank from scored order by rank limit 150)"""


@register("relevance_topk", with_bindings(
    "da", _relevant_sql("da", QUESTION) + " select rank::int rank, _ord, feedback_id, score::bigint score from best"))
def _(spark, sf):
    best = ranking.relevance_topk(b.analyzed_documents(spark, sf), QUESTION)
    ranked = best.withColumn("rank", F.expr("row_number() over (order by score desc, _ord)"))
    return ranked.select("rank", ORD, "feedback_id", "score")


@register("high_severity_list", with_bindings("e", """
    select _ord, location, summary, severity from e where severity = 'High' order by _ord limit 6"""))
def _(spark, sf):
    listed = ranking.high_severity_list(b.events_feedback(spark, sf))
    return listed.select(ORD, "location", "summary", "severity")


@register("positive_list", with_bindings("e", """
    select _ord, location, summary from e where sentiment = 'Positive' order by _ord limit 5"""))
def _(spark, sf):
    return questions.positive_list(b.events_feedback(spark, sf)).select(ORD, "location", "summary")


_BULLET = "'- **' || location || '** (' || severity || ' severity, ' || category || '): ' || summary"


@register("bullets", with_bindings("e", f"""
    , c as (select * from e where {_COMPLAINT})
    select * from (select row_number() over (order by _ord) position, {_BULLET} line from c order by 1 limit 5)
    union all select 6, '- ...and ' || (count(*) - 5) || ' more.' from c having count(*) > 5"""))
def _(spark, sf):
    return ranking.bullets(questions.complaints(b.events_feedback(spark, sf)))


@register("negative_digest", with_bindings("e", """
    , v as (select 'category' part, category "value", count(*) n from e where sentiment = 'Negative' group by 2
            union all select 'location', location, count(*) from e where sentiment = 'Negative' group by 2)
    select 'total' part, 1 rank, '' "value", count(*) n from e where sentiment = 'Negative'
    union all select part, rank, "value", n from
      (select *, row_number() over (partition by part order by n desc, "value")::int rank from v) where rank <= 3"""))
def _(spark, sf):
    return questions.negative_digest(b.events_feedback(spark, sf))


@register("count_report", with_bindings("e", """
    select 'total' "value", count(*) n from e union all select sentiment, count(*) from e group by 1"""))
def _(spark, sf):
    return questions.count_report(b.events_feedback(spark, sf))


# --- text operators ----------------------------------------------------------------------------

def _documents(spark, sf):
    return b.document_feedback(spark, sf)


_T = f"' ' || regexp_replace(lower(coalesce(feedback, '')), '{WS}+', ' ', 'g') || ' '"


@register("classifier_text", with_bindings("d", f"select _ord, {_T} text from d"))
def _(spark, sf):
    return _documents(spark, sf).select(ORD, tx.classifier_form(F.col("feedback")).alias("text"))


@register("lexicon_hits", with_bindings("d", f"""
    select _ord, {sql_hits(_T, SAMPLE.negative)} negative, {sql_hits(_T, SAMPLE.positive)} positive,
           {sql_hits(_T, SAMPLE.neutral)} neutral from d"""))
def _(spark, sf):
    text = classify.with_classifier_text(_documents(spark, sf))
    t = F.col("_text")
    return text.select(
        ORD, classify.hits(t, SAMPLE.negative).cast("long").alias("negative"),
        classify.hits(t, SAMPLE.positive).cast("long").alias("positive"),
        classify.hits(t, SAMPLE.neutral).cast("long").alias("neutral"),
    )


@register("classify_sentiment", with_bindings("da", "select _ord, sentiment from da"))
def _(spark, sf):
    return b.analyzed_documents(spark, sf).select(ORD, "sentiment")


@register("classify_category", with_bindings("da", "select _ord, category from da"))
def _(spark, sf):
    return b.analyzed_documents(spark, sf).select(ORD, "category")


@register("classify_severity", with_bindings("da", "select _ord, severity from da"))
def _(spark, sf):
    return b.analyzed_documents(spark, sf).select(ORD, "severity")


@register("extract_keywords", with_bindings("da", "select _ord, keywords from da"))
def _(spark, sf):
    return classify.flatten_keywords(b.analyzed_documents(spark, sf)).select(ORD, "keywords")


_RESULT = ["sentiment", "category", "severity", "keywords", "main_issue", "summary", "suggested_action"]


@register("classify_full", with_bindings("da", f"select _ord, {', '.join(_RESULT)} from da"))
def _(spark, sf):
    return classify.flatten_keywords(b.analyzed_documents(spark, sf)).select(ORD, *_RESULT)


@register("truncate_summary", with_bindings("da", "select _ord, summary from da"))
def _(spark, sf):
    return _documents(spark, sf).select(ORD, tx.truncate_summary(F.col("feedback")).alias("summary"))


@register("normalize_search", with_bindings("d", f"select _ord, {_search_sql('feedback')} text from d"))
def _(spark, sf):
    return _documents(spark, sf).select(ORD, tx.search_form(F.col("feedback")).alias("text"))


@register("query_words", with_bindings(
    "q", f"select question_id, array_to_string({_words_sql('question')}, ',') words from q"))
def _(spark, sf):
    words = tx.prefixes(tx.query_words(F.col("question")))
    return b.questions(spark, sf).select("question_id", F.array_join(words, ",").alias("words"))


_LINE = (
    "feedback_id || ' | ' || strftime(date, '%Y-%m-%d') || ' | ' || location || ' | ' || category || ' | ' || "
    "sentiment || ' | ' || severity || ' | ' || feedback || case when suggested_action <> '' and "
    "lower(suggested_action) <> 'no action needed' then ' | Action: ' || suggested_action else '' end"
)


@register("record_lines", with_bindings("e", f"select _ord, {_LINE} line from e"))
def _(spark, sf):
    e = b.events_feedback(spark, sf)
    return e.select(ORD, ranking.record_line(e).alias("line"))


@register("text_key", with_bindings("d", "select _ord, sha1('prompt|' || coalesce(feedback, '')) \"key\" from d"))
def _(spark, sf):
    return _documents(spark, sf).select(ORD, tx.text_key(F.col("feedback"), "prompt").alias("key"))


# --- enrichment --------------------------------------------------------------------------------

@register("enrich_cached", with_bindings("da", """
    , cached as (select distinct feedback from da join labels on labels.doc_id = da._ord)
    select da._ord, sentiment, category, severity,
           case when cached.feedback is null then main_issue else 'from the cache' end main_issue
    from da left join cached on cached.feedback = da.feedback"""))
def _(spark, sf):
    documents = _documents(spark, sf)
    labelled = documents.join(b.table(spark, sf, "labels").selectExpr("doc_id as _ord"), ORD, "left_semi")
    stored = classify.classify_as_result(
        labelled.select("feedback", tx.text_key(F.col("feedback")).alias("cache_key")), SAMPLE)
    cache = stored.withColumn("result", F.col("result").withField("main_issue", F.lit("from the cache")))
    rows = enrich.enrich(documents, SAMPLE, cache.select("cache_key", "result")).rows
    return rows.select(ORD, "sentiment", "category", "severity", "main_issue")


def _probe_scorer():
    """A scorer whose reply depends on the length of a text alone, nested so that it travels by value.

    A text whose length divides by 7 is skipped among others, by 35 always.
    """
    def reply(texts: list[str]) -> str:
        import json

        entries = []
        for number, text in enumerate(texts, 1):
            n = len(text)
            if n % 35 and (n % 7 or len(texts) == 1):
                entries.append({
                    "id": number, "sentiment": ["Positive", "Neutral", "Negative", "Mixed"][n % 4],
                    "category": "Safety" if n % 3 else "Software", "severity": ["Low", "Medium", "High"][n % 3],
                })
        return "Result: " + json.dumps(entries)

    return reply


_SCORED = f"""select _ord, case when left_out then sentiment else ['Positive', 'Neutral', 'Negative', 'Mixed'][n % 4 + 1] end sentiment,
    case when left_out then category when n % 3 = 0 then 'Software' else 'Safety' end category,
    case when left_out then severity else ['Low', 'Medium', 'High'][n % 3 + 1] end severity,
    case when blank then {quoted(replies.EMPTY_TEXT)} when left_out then {quoted(replies.SKIPPED)} end analysis_error
    from (select *, length(feedback) n, {sql_strip("coalesce(feedback, '')")} = '' blank,
                 blank or length(feedback) % 35 = 0 left_out from da)"""


@register("enrich_scorer", with_bindings("da", _SCORED))
def _(spark, sf):
    rows = enrich.enrich(b.document_feedback(spark, sf), SAMPLE, batch_scorer=_probe_scorer()).rows
    return rows.select(ORD, "sentiment", "category", "severity", "analysis_error")


@register("cache_round_trip", with_bindings("da", f"""
    , scored as ({_SCORED})
    select scored._ord, scored.sentiment, scored.category, scored.severity,
           case when analysis_error is null then 'scorer' else 'rules' end origin from scored"""))
def _(spark, sf):
    # Results that are stored and loaded again answer a second run; what failed goes to the rules.
    documents = b.document_feedback(spark, sf)
    path = shared_folder(spark, "cache")
    cache.save_cache(enrich.enrich(documents, SAMPLE, batch_scorer=_probe_scorer()).fresh, path)
    stored = cache.load_cache(spark, path)
    rows = enrich.enrich(documents, SAMPLE, stored).rows
    known = stored.select("cache_key", F.lit("scorer").alias("origin"))
    return rows.join(known, "cache_key", "left").select(
        ORD, "sentiment", "category", "severity", F.coalesce("origin", F.lit("rules")).alias("origin"))


_FENCED = "regexp_replace(regexp_replace(reply, '(?s)<think>.*?</think>', '', 'g'), '(?m)^```(?:json)?|```$', '', 'g')"


def _sql_spoken(path: str, missing: str, blank: str, entry: str = "j") -> str:
    spoken = (
        f"case json_type({entry}, '{path}') when 'NULL' then 'None' when 'BOOLEAN' then "
        f"case when json_extract_string({entry}, '{path}') = 'true' then 'True' else 'False' end "
        f"else {sql_strip(f'''json_extract_string({entry}, '{path}')''')} end"
    )
    return (
        f"case when json_type({entry}, '{path}') is null then {quoted(missing)} "
        f"when {spoken} = '' then {quoted(blank)} else {spoken} end"
    )


def _sql_choice(name: str, allowed: list[str], default: str, entry: str = "j") -> str:
    value = f"json_extract_string({entry}, '$.{name}')"
    return f"case when {value} in ({', '.join(quoted(v) for v in allowed)}) then {value} else {quoted(default)} end"


def _sql_sanitized(entry: str = "j") -> dict[str, str]:
    items = f"json_extract({entry}, '$.keywords[*]')"
    return {
        "sentiment": _sql_choice("sentiment", SENTIMENTS, "Neutral", entry),
        "category": _sql_choice("category", CATEGORIES, "Other", entry),
        "severity": _sql_choice("severity", SEVERITIES, "Low", entry),
        "keywords": f"case when json_type({entry}, '$.keywords') = 'ARRAY' then array_to_string(list_filter("
                    f"list_transform({items}, lambda k: case when json_type(k) = 'NULL' then 'None' "
                    f"else trim(json_extract_string(k, '$')) end), lambda k: k <> ''), ', ') else '' end",
        "main_issue": _sql_spoken("$.main_issue", "None", "None", entry),
        "summary": _sql_spoken("$.summary", "", "", entry),
        "suggested_action": _sql_spoken("$.suggested_action", "No action needed", "No action needed", entry),
    }


_OBJECT = f"regexp_extract({_FENCED}, '(?s)\\{{.*\\}}')"
# The rule classifier's columns under other names, and the parsed entry or null.
_RULES = (
    f", rules as (select _ord r_ord, {', '.join(f'{c} r_{c}' for c in _RESULT)} from da), "
    f"entries_of as (select *, case when json_valid({_OBJECT}) then json({_OBJECT}) end j from rep)"
)


def _parsed(spark, sf):
    parsed = replies.parse_replies(b.replies(spark, sf), SAMPLE)
    return parsed.select(
        ORD, *[F.col(f"result.{c}").alias(c) for c in _RESULT], F.col("result.analysis_error").alias("analysis_error")
    ).withColumn("keywords", F.array_join("keywords", ", "))


@register("parse_replies", with_bindings("da rep", _RULES + " select _ord, " + ", ".join(
    f"case when j is null then r_{c} else {sql} end {c}" for c, sql in _sql_sanitized().items())
    + f", case when j is null then {quoted(replies.NOT_JSON)} end analysis_error "
    "from entries_of join rules on r_ord = _ord"))
def _(spark, sf):
    return _parsed(spark, sf)


@register("sanitize_results", with_bindings("rep", ", entries_of as (select *, case when json_valid("
    f"{_OBJECT}) then json({_OBJECT}) end j from rep) select _ord, " + ", ".join(
        f"{sql} {c}" for c, sql in _sql_sanitized().items()) + " from entries_of where j is not null"))
def _(spark, sf):
    clean = replies.sanitized(b.replies(spark, sf)).where(F.col("result").isNotNull())
    return clean.select(ORD, *[F.col(f"result.{c}").alias(c) for c in _RESULT]).withColumn(
        "keywords", F.array_join("keywords", ", "))


@register("fallback_rows", with_bindings("da rep", _RULES + f"""
    select _ord, r_sentiment sentiment, r_category category, r_severity severity,
           {quoted(replies.NOT_JSON)} analysis_error from entries_of join rules on r_ord = _ord where j is null"""))
def _(spark, sf):
    failed = _parsed(spark, sf).where(F.col("analysis_error").isNotNull())
    return failed.select(ORD, "sentiment", "category", "severity", "analysis_error")


@register("analysis_failures", with_bindings("rep", f"""
    select count(*) filter (not json_valid({_OBJECT})) failed, count(*) total,
           {quoted(replies.NOT_JSON)} first_error from rep"""))
def _(spark, sf):
    return enrich.analysis_failures(_parsed(spark, sf))


_ARRAY = "regexp_extract(reply, '(?s)\\[.*\\]')"


@register("parse_batch_replies", with_bindings("da batch", f"""
    , items as (select batch_id, unnest(json_extract({_ARRAY}, '$[*]')) j,
                unnest(range(json_array_length({_ARRAY})::bigint)) pos from batch),
    numbered as (select *, try_cast(try_cast(json_extract_string(j, '$.id') as double) as bigint) item_no
                 from items where json_type(j) = 'OBJECT'),
    first as (select * from (select *, row_number() over (partition by batch_id, item_no order by pos) rn
              from numbered where item_no is not null) where rn = 1),
    rules as (select _ord r_ord, {', '.join(f'{c} r_{c}' for c in _RESULT)} from da)
    select r.batch_id, r.item_no, """ + ", ".join(
        f"case when j is null then r_{c} else {sql} end {c}" for c, sql in _sql_sanitized().items())
    + f""", case when j is null then {quoted(replies.SKIPPED)} end analysis_error
    from requests r join rules on r_ord = r._ord
    left join first f on f.batch_id = r.batch_id and f.item_no = r.item_no"""))
def _(spark, sf):
    parsed = replies.parse_batch_replies(b.batch_requests(spark, sf), b.batch_replies(spark, sf), SAMPLE)
    return parsed.select(
        "batch_id", "item_no", *[F.col(f"result.{c}").alias(c) for c in _RESULT],
        F.col("result.analysis_error").alias("analysis_error"),
    ).withColumn("keywords", F.array_join("keywords", ", "))


# --- questions ---------------------------------------------------------------------------------

_NAMED = f""", places as (select distinct location from e),
    tokens as (select location, unnest(string_split({_search_sql('location')}, ' ')) t from places),
    named as (select distinct question_id, location from q, tokens
      where length(t) >= 3 and t not in ({', '.join(quoted(w) for w in questions.GENERIC_PLACE_WORDS)})
        and (contains({_search_sql('question')}, t)
             or (length(t) >= 6 and contains({_search_sql('question')}, t[1:5])))),
    cats as (select distinct question_id, category from q, (select distinct category from e)
      where contains({sql_strip('lower(question)')}, lower(category)))"""


@register("mentioned_locations", with_bindings("e q", _NAMED + " select question_id, location from named"))
def _(spark, sf):
    return questions.mentioned_locations(b.questions(spark, sf), b.events_feedback(spark, sf))


def _sql_report(mentions: str, key: str, shown: str, name: str = "reported") -> str:
    """CTEs that end in ``name``; the ones before it carry the key in their names."""
    met, names, best, listed = (f"{n}_{key}" for n in ("met", "names", "best", "listed"))
    return f""", {met} as (select m.question_id, e.*, {shown} as is_shown, {_WEIGHT} w from {mentions} m join e using ({key})),
    {names} as (select question_id, string_agg({key}, ', ' order by first) as names from (
        select question_id, {key}, min(_ord) first from {met} group by 1, 2) group by 1),
    {best} as (select *, row_number() over (partition by question_id order by w desc, _ord) r from {met} where is_shown),
    {listed} as (select question_id, string_agg(cast(_ord as varchar), ',' order by r) row_ids,
               string_agg({_BULLET}, chr(10) order by r) bullets from {best} where r <= 5 group by 1),
    {name} as (select question_id, names, reports, shown, coalesce(row_ids, '') row_ids,
        coalesce(bullets, '') || case when shown > 5 then chr(10) || '- ...and ' || (shown - 5) || ' more.' else '' end bullets
        from {names} join (select question_id, count(*) reports, count(*) filter (is_shown) shown from {met} group by 1) c
        using (question_id) left join {listed} using (question_id))"""


@register("location_report", with_bindings(
    "e q", _NAMED + _sql_report("named", "location", _COMPLAINT) + " select * from reported"))
def _(spark, sf):
    return questions.location_report(b.questions(spark, sf), b.events_feedback(spark, sf))


@register("category_report", with_bindings(
    "e q", _NAMED + _sql_report("cats", "category", "true") + " select * from reported"))
def _(spark, sf):
    return questions.category_report(b.questions(spark, sf), b.events_feedback(spark, sf))


_KEYWORD = f""", asked as (select distinct question_id, unnest({_words_sql('question')}) w from q),
    words as (select distinct w from asked),
    texts as (select _ord, {_WEIGHT} weight, {_search_sql('feedback')} t from {{table}}),
    postings as (select w, _ord, weight from words, texts where contains(t, w)),
    pairs as (select distinct question_id, _ord, weight from asked join postings using (w)),
    ranked as (select question_id, _ord, count(*) over (partition by question_id) hits,
               row_number() over (partition by question_id order by weight desc, _ord)::int rank from pairs)"""


@register("keyword_search", with_bindings(
    "da q", _KEYWORD.format(table="da") + " select question_id, hits, rank, _ord from ranked where rank <= 5"))
def _(spark, sf):
    return questions.keyword_hits(b.questions(spark, sf), b.analyzed_documents(spark, sf))


def _sql_has(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(t, {quoted(w)})" for w in words) + ")"


_ROUTED = f"""{_NAMED}{_KEYWORD.format(table="e")},
    routed as (select question_id, question, case
      when regexp_replace(t, '[!?. ]+$', '') in ({', '.join(quoted(w) for w in questions.GREETINGS)})
           or {_sql_has(questions.GREETING_PHRASES)} then 'greeting'
      when question_id in (select question_id from named) then 'location'
      when {_sql_has(questions.PLACE_WORDS)} and {_sql_has(questions.PLACE_RANK_WORDS)} then 'top_locations'
      when {_sql_has(questions.HIGH_WORDS)} then 'high_severity'
      when {_sql_has(questions.ACTION_WORDS)} then 'top_actions'
      when {_sql_has(questions.NEGATIVE_WORDS)} then 'negative_digest'
      when {_sql_has(questions.POSITIVE_WORDS)} then 'positive'
      when (select count(*) from e where {_COMPLAINT}) > 0 and {_sql_has(questions.CATEGORY_WORDS)} then 'top_categories'
      when {_sql_has(questions.COUNT_WORDS)} then 'count'
      when question_id in (select question_id from cats) then 'category'
      when question_id in (select question_id from pairs) then 'keyword' else 'none' end intent
      from (select *, {sql_strip('lower(question)')} t from q))"""


@register("route_questions", with_bindings("e q", _ROUTED + " select question_id, question, intent from routed"))
def _(spark, sf):
    return questions.route_questions(b.questions(spark, sf), b.events_feedback(spark, sf))


def _sql_lines(where: str, limit: int, order: str) -> str:
    """Bullet text of the first rows of ``e`` and the count of the others, as a scalar."""
    return (
        f"(select string_agg(line, chr(10) order by r) from (select {_BULLET} line, row_number() over (order by {order}) r "
        f"from e where {where}) where r <= {limit}) || (select case when count(*) > {limit} then chr(10) || '- ...and ' || "
        f"(count(*) - {limit}) || ' more.' else '' end from e where {where})"
    )


def _sql_counts(column: str, where: str, first: int, last: int) -> str:
    return (
        f"coalesce((select string_agg(v || ' (' || n || ')', ', ' order by r) from (select {column} v, count(*) n, "
        f"row_number() over (order by count(*) desc, {column}) r from e where {where} group by 1) "
        f"where r between {first} and {last}), '')"
    )


def _sql_first(column: str, where: str, what: str) -> str:
    return f"(select {what} from e where {where} group by {column} order by count(*) desc, {column} limit 1)"


_WORST = f"{_WEIGHT} desc, _ord"
_ACTIONABLE = "lower(suggested_action) not in ('no action needed', 'review manually.', '')"
_FIXED_ANSWERS = {
    "greeting": quoted(questions.GREETING_TEXT),
    "none": quoted(questions.NOT_ENOUGH_TEXT),
    "top_locations": f"'**' || {_sql_first('location', _COMPLAINT, 'location')} || '** has the most negative/mixed reports (' || "
                     f"{_sql_first('location', _COMPLAINT, 'count(*)')} || '). Next: ' || {_sql_counts('location', _COMPLAINT, 2, 3)} || '.'",
    "high_severity": "(select count(*) from e where severity = 'High') || ' report(s) are High severity:' || chr(10) || "
                     + _sql_lines("severity = 'High'", 6, _WORST),
    "top_actions": "'Commonly suggested improvements:' || chr(10) || (select string_agg('- ' || a, chr(10) order by r) from "
                   "(select suggested_action a, row_number() over (order by count(*) desc, suggested_action) r from e "
                   f"where {_ACTIONABLE} group by 1) where r <= 5)",
    "negative_digest": "'There are ' || (select count(*) from e where sentiment = 'Negative') || ' negative reports. Top categories: ' || "
                       + _sql_counts("category", "sentiment = 'Negative'", 1, 3) + " || '. Top locations: ' || "
                       + _sql_counts("location", "sentiment = 'Negative'", 1, 3) + " || '.' || chr(10) || "
                       + _sql_lines("sentiment = 'Negative'", 5, _WORST),
    "positive": "'There are ' || (select count(*) from e where sentiment = 'Positive') || ' positive reports:' || chr(10) || "
                + _sql_lines("sentiment = 'Positive'", 5, "_ord"),
    "top_categories": f"'The most common problem category is **' || {_sql_first('category', _COMPLAINT, 'category')} || '** (' || "
                      f"{_sql_first('category', _COMPLAINT, 'count(*)')} || ' reports). Next: ' || {_sql_counts('category', _COMPLAINT, 2, 4)} || '.'",
    "count": "'There are ' || (select count(*) from e) || ' feedback records: ' || (select string_agg(sentiment || ' ' || n, ', ' "
             "order by n desc, sentiment) from (select sentiment, count(*) n from e group by 1)) || '.'",
}
_ANSWERS = (
    _sql_report("named", "location", _COMPLAINT, "of_place") + _sql_report("cats", "category", "true", "of_category")
    + f""", of_word as (select question_id, 'Found ' || max(hits) || ' related report(s):' || chr(10)
          || string_agg({_BULLET}, chr(10) order by rank) filter (rank <= 5)
          || case when max(hits) > 5 then chr(10) || '- ...and ' || (max(hits) - 5) || ' more.' else '' end own
        from ranked join e using (_ord) group by 1),
    fixed(intent, answer) as (""" + " union all ".join(f"select {quoted(k)}, {v}" for k, v in _FIXED_ANSWERS.items()) + """)
    select r.question_id, r.intent, case r.intent
        when 'location' then case when p.shown = 0
            then '**' || p.names || '** has ' || p.reports || ' report(s) and none of them are negative or mixed.'
            else '**' || p.names || '** has ' || p.reports || ' report(s) (' || p.shown || ' negative/mixed):' || chr(10) || p.bullets end
        when 'category' then c.reports || ' report(s) in **' || c.names || '**:' || chr(10) || c.bullets
        when 'keyword' then w.own else f.answer end answer, 'local' "mode", cast(null as varchar) error
    from routed r left join of_place p using (question_id) left join of_category c using (question_id)
    left join of_word w using (question_id) left join fixed f on f.intent = r.intent"""
)


@register("answer_questions", with_bindings("e q", _ROUTED + _ANSWERS))
def _(spark, sf):
    return questions.answer_questions(b.questions(spark, sf), b.events_feedback(spark, sf))


_CONTEXT = (
    _relevant_sql("e", CONTEXT_QUESTION)
    + "".join(f", s_{by} as ({_sql_summary(by)})" for by in summaries.DIMENSIONS)
    + f""" select 0 part, 0 block_no, 'records' "block", 0::bigint "position", '### Dataset: Feedback (Full) - ' || case when count(*) > 150 then
        'Showing the 150 most relevant of ' || count(*) || ' records (summary datasets cover all ' || count(*) || ').'
        else 'All ' || count(*) || ' records are listed.' end line from e
    union all select 0, 0, 'records', 1, {quoted(ranking.ANALYZED_HEADING)}
    union all select 2, 0, 'records', rank, {_LINE} from best """
    + " ".join(
        f"union all select 3, dataset_no, dataset, part + greatest(row_no - 1, 0), line from ({_csv_sql(by, name)})"
        for name, by in zip(summaries.DATASET_NAMES[1:], summaries.DIMENSIONS))
)


@register("context_lines", with_bindings("e", _CONTEXT))
def _(spark, sf):
    return ranking.context_lines(b.events_feedback(spark, sf), CONTEXT_QUESTION)


@register("context_batch", with_bindings("e q", f"""
    , asked as (select question_id, {_words_sql('question')} words from q),
    texts as (select *, {_search_sql('feedback')} || ' ' || {_search_sql('location')} _search, {_WEIGHT} weight from e),
    scored as (select question_id, _ord, case when (select count(*) from e) > 150
        then len(list_filter(words, lambda w: contains(_search, w))) * 10 + weight else 0 end::bigint score from asked, texts),
    best as (select *, row_number() over (partition by question_id order by score desc, _ord)::int rank from scored)
    select question_id, rank, _ord, score, {_LINE} line from best join e using (_ord) where rank <= 150"""))
def _(spark, sf):
    return context.context_batch(b.questions(spark, sf), b.events_feedback(spark, sf))


# --- quality -----------------------------------------------------------------------------------

_DOMAINS = {"category": [*b.EVENT_TYPES, "refund"], "sentiment": SENTIMENTS, "severity": SEVERITIES}


@register("coverage_values", with_bindings("e", """
    , v as (select 'location' "column", location "value", count(*) n from e group by 2 """ + " ".join(
    f"union all select '{c}', v, count({c}) from (values {', '.join(f'({quoted(v)})' for v in values)}) d(v) "
    f"left join e on e.{c} = d.v group by 2" for c, values in _DOMAINS.items())
    + """) select "column", "value", n as "rows", n < 1100 thin from v"""))
def _(spark, sf):
    return quality.coverage_values(b.events_feedback(spark, sf), _DOMAINS, minimum=1100)


@register("coverage_pairs", with_bindings("e", """
    , pairs as (select location, category from e union select location, 'refund' from e)
    select p.location, p.category, count(e.category) as "rows" from pairs p
    left join e on e.location = p.location and e.category = p.category group by 1, 2 having count(e.category) < 220"""))
def _(spark, sf):
    e, wanted = b.events_feedback(spark, sf), b.intended_pairs(spark, sf)
    return quality.coverage_pairs(e, wanted, _DOMAINS["category"], minimum=220)


@register("label_agreement", with_bindings("da gold", """
    , m as (select da.category = gold.category category, da.sentiment = gold.sentiment sentiment,
                   da.severity = gold.severity severity from da join gold using (feedback_id)),
    v as (""" + " union all ".join(
        f"select '{c}' as label, count(*) as \"rows\", count(*) filter ({c}) as equal from m"
        for c in quality.LABEL_COLUMNS)
    + """) select *, ((2000 * equal + "rows") // (2 * "rows")) / 10::double agreement from v"""))
def _(spark, sf):
    return quality.label_agreement(b.analyzed_documents(spark, sf), b.gold_labels(spark, sf))


_ZONES = [f"Zone {i}" for i in range(9)]


@register("quality_rules", with_bindings("e", f""", l as (select location, count(*) n from e group by 1),
    c as (select category, count(*) n from e group by 1),
    pairs as (select location, category from e union select location, 'refund' from e),
    p as (select count(e.category) n from pairs left join e on e.location = pairs.location
          and e.category = pairs.category group by pairs.location, pairs.category)
    select 'enough_records' as rule, count(*) >= 500 ok from e
    union all select 'texts_unique', count(distinct feedback) = count(*) from e
    union all select 'no_blank_fields', count(*) filter (trim(feedback_id) = '' or trim(location) = '' or
        trim(feedback) = '' or feedback_id is null or location is null or feedback is null or date is null) = 0 from e
    union all select 'every_location_present', count(*) = 9 from l where location in ({', '.join(quoted(z) for z in _ZONES)})
    union all select 'every_category_present', count(*) = 6 from c where category in ({', '.join(quoted(z) for z in _DOMAINS['category'])})
    union all select 'every_location_sufficient', count(*) = 9 from l where n >= 5
    union all select 'every_category_sufficient', count(*) = 6 from c where n >= 5
    union all select 'no_other_values', (select count(*) from l) = 9 and (select count(*) from c) = 6
    union all select 'every_intended_pair_sufficient', count(*) filter (n < 5) = 0 from p"""))
def _(spark, sf):
    e, wanted = b.events_feedback(spark, sf), b.intended_pairs(spark, sf)
    return quality.quality_rules(e, _ZONES, _DOMAINS["category"], wanted)
