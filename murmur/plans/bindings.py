"""The given tables seen as feedback tables, once as DataFrames and once as DuckDB SQL.

E     analyzed feedback from ``events``
D     plain text feedback from ``documents``
DA    D after the rule classifier with the sample lexicon
RAW   dirty input for cleaning, from ``documents``
NEW   rows to append to D, from ``documents``
REP   raw scorer replies, one per document
BATCH numbered requests and one array reply per ten documents
GOLD  expected labels from ``labels``
Q     questions: user turns of ``conversations`` and one probe per intent and routing conflict
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.operators.classify import NO_ACTION, NO_ISSUE
from murmur.operators.enrich import analyze
from murmur.operators.lexicon import FALLBACK_CATEGORY, SAMPLE, Lexicon
from murmur.schema import ORD
from murmur.session import spread

PROBES = [
    "Hello!", "help?", "What can you do for me", "this shop is nice",
    "Tell me about Zone 3", "Any trouble in the zones?", "Which location has the most complaints?",
    "Where do people stop", "What problems have high severity?", "is anything urgent or critical",
    "What improvements are commonly suggested?", "Which actions would fix the highway",
    "Summarize the negative feedback.", "Why do people complain", "Show me the compliments",
    "What is good here", "What is the most common problem?", "Name the main category",
    "How many records are there?", "number of reports", "Anything on SIGNUP flows", "purchase view",
    "Clicked buttons with value", "valued items", "xyzzy qwert", "", "an of it", "What is the most", "trashed gates",
    "heat-ing and fans", "Which area is worst",
]

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]

# One template per binding; {S} is the string type, {K} the number in ``props``.
_E = [
    ("_ord", "event_id"),
    ("feedback_id", "cast(event_id as {S})"),
    ("date", "ts"),
    ("location", "concat('Zone ', cast(user_id % 9 as {S}))"),
    ("feedback", "concat('A ', event_type, ' by user ', cast(user_id as {S}), ' with value ', props)"),
    ("category", "event_type"),
    ("sentiment", "case event_type when 'error' then 'Negative' when 'click' then 'Mixed' "
                  "when 'view' then 'Neutral' else 'Positive' end"),
    ("severity", "case when value >= 100 then 'High' when value >= 30 then 'Medium' else 'Low' end"),
    ("summary", "concat(event_type, ' report ', {K})"),
    ("main_issue", "case when event_id % 10 = 0 then 'None' when event_id % 11 = 0 then ' ' "
                   "when event_id % 13 = 0 then null else concat('issue ', {K}) end"),
    ("suggested_action", "case when event_id % 6 = 0 then 'No action needed' "
                         "else concat('action ', {K}) end"),
]
_D = [
    ("_ord", "doc_id"),
    ("feedback_id", "cast(doc_id as {S})"),
    ("date", "{DAY}"),
    ("location", "source"),
    ("feedback", "text"),
]
_NEW = [
    ("_ord", "doc_id"),
    ("date", "cast(cast({DAY} as date) as {S})"),
    ("location", "source"),
    ("feedback", "case doc_id % 3 when 0 then concat(text, ' again') when 1 then concat(' ', text) else text end"),
]
_RAW = [
    ("_ord", "_ord"),
    ("feedback_id", "case when k % 23 = 0 then null else concat('FB', cast(id as {S})) end"),
    ("date", "case when k % 19 = 0 and _ord < 1000000000000 then 'not a date' else cast(cast({DAY} as date) as {S}) end"),
    ("location", "case when k % 17 = 0 then '   ' else source end"),
    ("feedback", "case when k % 7 = 0 then null when k % 11 = 0 then '' when k % 13 = 0 then 'nan' "
                 "else concat('  ', text, {TAB}, ' ') end"),
]
_RAW_FIRST = [("k", "doc_id"), ("id", "doc_id"), ("text", "text"), ("source", "source"), ("_ord", "doc_id")]
_RAW_AGAIN = [
    ("k", "doc_id"),
    ("id", "case when doc_id % 10 = 0 then doc_id + 1000000000000 else doc_id end"),
    ("text", "text"),
    ("source", "case when doc_id % 15 = 0 then upper(source) else source end"),
    ("_ord", "doc_id + 1000000000000"),
]
_RAW_AGAIN_IF = "doc_id % 5 = 0"

# JSON objects as a scorer might send them, with all the usual defects.
_ENTRY = (
    "concat('{{', {ID} '\"sentiment\": ', case doc_id % 5 when 0 then '\"Negative\"' when 1 then '\"angry\"' "
    "when 2 then 'null' when 3 then '\"Mixed\"' else '\"Positive\"' end, "
    "case when doc_id % 7 = 0 then '' else concat(', \"category\": \"', case doc_id % 3 when 0 then 'Safety' "
    "when 1 then 'Food Service' else 'Nowhere' end, '\"') end, "
    "', \"severity\": ', case doc_id % 4 when 0 then '\"High\"' when 1 then '\"Medium\"' when 2 then '3' "
    "else '\"Low\"' end, "
    "', \"keywords\": ', case doc_id % 6 when 0 then '\"no list\"' when 1 then '[]' "
    "when 2 then '[\" heat \", \"\", \"fan\"]' when 3 then '[null, 7]' else concat('[\"', lower(source), '\"]') end, "
    "case doc_id % 8 when 0 then '' when 1 then ', \"main_issue\": null' when 2 then ', \"main_issue\": \"  \"' "
    "else concat(', \"main_issue\": \" issue in ', source, ' \"') end, "
    "case doc_id % 9 when 0 then '' when 1 then ', \"summary\": null' else ', \"summary\": \" short {{text}} \"' end, "
    "case when doc_id % 10 = 0 then '' when doc_id % 10 = 1 then ', \"suggested_action\": null' "
    "when doc_id % 10 = 2 then ', \"suggested_action\": true' else ', \"suggested_action\": \"look\"' end, '}}')"
)
_REPLY = (
    "case when doc_id % 12 = 0 then 'Sorry, that did not work.' "
    "when doc_id % 12 = 1 then concat('<think>{{a}} or {{b}}?</think>', chr(10), '```json', chr(10), {ENTRY}, chr(10), '```') "
    "when doc_id % 12 = 2 then concat('Here it is: ', {ENTRY}, ' Anything else?') "
    "when doc_id % 12 = 3 then concat('{{\"sentiment\": \"Negative\", ', {ENTRY}) "
    "else {ENTRY} end"
)
_NUMBER = (
    "case doc_id % 11 when 0 then '\"id\": \"' when 1 then '\"id\": 9' when 2 then '\"nr\": ' "
    "else '\"id\": ' end, cast(case when doc_id % 11 = 7 then 1 else doc_id % 10 + 1 end as {S}), case doc_id % 11 when 0 then '\"' "
    "when 5 then '.0' else '' end, ', ',"
)


def _entry(number: str = "") -> str:
    return _ENTRY.replace("{ID}", number).replace("{{", "{").replace("}}", "}")


def _reply() -> str:
    return _REPLY.replace("{{", "{").replace("}}", "}").replace("{ENTRY}", _entry())


def _fill(template: str, spark: bool) -> str:
    fills = {
        "{S}": "string" if spark else "varchar",
        "{K}": "get_json_object(props, '$.k')" if spark else "json_extract_string(props, '$.k')",
        "{DAY}": (
            "cast(date_add(DATE '2026-06-01', cast(doc_id % 111 as int)) as timestamp_ntz)" if spark
            else "cast(DATE '2026-06-01' + cast(doc_id % 111 as int) as timestamp)"
        ),
        "{TAB}": "chr(9)",
    }
    for mark, text in fills.items():
        template = template.replace(mark, text)
    return template


def _exprs(columns: list[tuple[str, str]], spark: bool = True) -> list[str]:
    return [f"{_fill(expr, spark)} as {name}" for name, expr in columns]


def _select(columns: list[tuple[str, str]], table: str) -> str:
    return "select " + ", ".join(_exprs(columns, spark=False)) + f" from {table}"


# --- Spark side --------------------------------------------------------------------------------

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one table whose texts are long enough to keep all cores busy."""
    return spread(table(spark, sf_dir, "documents"), "doc_id")


def events_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_exprs(_E))


def document_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(*_exprs(_D))


def analyzed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analyze(document_feedback(spark, sf_dir), SAMPLE)


def raw_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = documents(spark, sf_dir)
    first = source.selectExpr(*_exprs(_RAW_FIRST))
    again = source.where(_RAW_AGAIN_IF).selectExpr(*_exprs(_RAW_AGAIN))
    day = "cast(date_add(DATE '2026-06-01', cast(k % 111 as int)) as timestamp_ntz)"
    columns = [(n, e.replace("{DAY}", day)) for n, e in _RAW]
    return first.unionByName(again).selectExpr(*_exprs(columns))


def new_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).selectExpr(*_exprs(_NEW))


def stored_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D with ids and dates as the append step stores them."""
    return document_feedback(spark, sf_dir).withColumns({
        "feedback_id": F.format_string("FB%04d", F.col(ORD)),
        "date": F.date_format("date", "yyyy-MM-dd"),
    })


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [*_D, ("reply", _reply())]
    return documents(spark, sf_dir).selectExpr(*_exprs(columns))


def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [("batch_id", "doc_id div 10"), ("item_no", "doc_id % 10 + 1"), ("feedback", "text")]
    return documents(spark, sf_dir).selectExpr(*_exprs(columns))


def batch_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply per batch; a batch has ten entries, so the lists stay short."""
    entries = documents(spark, sf_dir).selectExpr(*_exprs([
        ("batch_id", "doc_id div 10"), ("doc_id", "doc_id"), ("entry", _entry(_NUMBER))
    ]))
    listed = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("doc_id", "entry"))), lambda e: e["entry"]), ", ")
    return entries.groupBy("batch_id").agg(
        F.concat(F.lit("Result: ["), listed, F.lit(", 5, {}]")).alias("reply")
    )


def gold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(
        "cast(doc_id as string) as feedback_id", "'Environment' as category",
        "case quality when 1 then 'Positive' else 'Negative' end as sentiment",
        "case toxic when 1 then 'High' else 'Low' end as severity",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").selectExpr(
        "conv_id * 1000 + turn as question_id", "text as question"
    )
    probes = spark.createDataFrame(
        [(-i - 1, text) for i, text in enumerate(PROBES)], "question_id long, question string"
    )
    return turns.unionByName(probes)


def intended_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that ought to occur: those of E and each of its places with a type that never does."""
    feedback = events_feedback(spark, sf_dir)
    seen = feedback.select("location", "category").distinct()
    return seen.unionByName(seen.select("location", F.lit("refund").alias("category")).distinct())


# --- DuckDB side -------------------------------------------------------------------------------

# White space as in the text functions, for RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]" if values else "cast([] as varchar[])"


def sql_hits(text: str, terms: list[str]) -> str:
    return f"len(list_filter({sql_list(terms)}, lambda k: contains({text}, k)))"


def sql_strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{WS}+', ''), '{WS}+$', '')"


def sql_classified(source: str, lexicon: Lexicon) -> list[tuple[str, str]]:
    """CTEs that end in ``classified``: the rule classifier over the CTE ``source``."""
    cats = list(lexicon.categories)
    scores = "[" + ", ".join(sql_hits("_t", t) for t in lexicon.categories.values()) + "]"
    actions = sql_list([lexicon.actions[c] for c in cats])
    summary = sql_strip("feedback")
    return [
        ("c_text", f"select *, ' ' || regexp_replace(lower(coalesce(feedback, '')), '{WS}+', ' ', 'g') || ' ' _t, "
                   f"coalesce({summary}, '') _s from {source}"),
        ("c_hits", f"select *, {sql_hits('_t', lexicon.negative)} _neg, {sql_hits('_t', lexicon.positive)} _pos, "
                   f"{sql_hits('_t', lexicon.neutral)} _neu, {sql_hits('_t', lexicon.contrast)} _con, "
                   f"{sql_hits('_t', lexicon.both_ways)} _both, {sql_hits('_t', lexicon.high)} _high, "
                   f"{sql_hits('_t', lexicon.low)} _low, {sql_hits('_t', lexicon.mild)} _mild, {scores} _cats from c_text"),
        ("c_labels", "select *, case when _s = '' then 'Neutral' "
                     "when _both > 0 or (_pos > 0 and _neg > 0 and _con > 0) then 'Mixed' "
                     "when _neu > 0 and _pos = 0 and _neg <= _neu then 'Neutral' when _pos > _neg then 'Positive' "
                     "when _neg > 0 then 'Negative' when _low + _high + _mild > 0 then 'Negative' else 'Neutral' end sentiment, "
                     f"case when _s = '' or list_max(_cats) = 0 then {quoted(FALLBACK_CATEGORY)} "
                     f"else {sql_list(cats)}[list_position(_cats, list_max(_cats))] end category from c_hits"),
        ("classified", "select * exclude (_t, _s, _neg, _pos, _neu, _con, _both, _high, _low, _mild, _cats), "
                       "case when _s = '' then 'Low' when sentiment = 'Negative' then case when _high > 0 then 'High' "
                       "when _low > 0 then 'Low' else 'Medium' end when sentiment = 'Mixed' then 'Medium' else 'Low' end severity, "
                       "case when _s = '' then '' else array_to_string(list_filter(regexp_extract_all(_t, '[a-z][a-z\\-]{3,}'), "
                       f"lambda w: not list_contains({sql_list(lexicon.stop)}, w)), ' ') end _words, "
                       f"case when sentiment in ('Positive', 'Neutral') then {quoted(NO_ISSUE)} else category || ' issue' end main_issue, "
                       "case when _s = '' then 'Empty feedback.' when length(_s) <= 140 then _s "
                       f"else regexp_replace(substr(_s, 1, 137), '{WS}+$', '') || '...' end summary, "
                       f"case when sentiment in ('Positive', 'Neutral') then {quoted(NO_ACTION)} "
                       f"else {actions}[list_position({sql_list(cats)}, category)] end suggested_action from c_labels"),
        ("analyzed", "select * exclude (_words), array_to_string(list_filter(string_split(_words, ' '), "
                     "lambda w, i: w <> '' and list_position(string_split(_words, ' '), w) = i)[1:4], ', ') keywords from classified"),
    ]


def sql_bindings() -> dict[str, list[tuple[str, str]]]:
    """The CTEs of each binding."""
    raw_day = "cast(DATE '2026-06-01' + cast(k % 111 as int) as timestamp)"
    raw = [(n, e.replace("{DAY}", raw_day)) for n, e in _RAW]
    probes = ", ".join(f"({-i - 1}, {quoted(t)})" for i, t in enumerate(PROBES))
    d = [("d", _select(_D, "documents"))]
    return {
        "e": [("e", _select(_E, "events"))],
        "d": d,
        "da": d + sql_classified("d", SAMPLE) + [("da", "select * from analyzed")],
        "raw": [
            ("raw_rows", _select(_RAW_FIRST, "documents") + " union all " + _select(_RAW_AGAIN, "documents")
             + f" where {_RAW_AGAIN_IF}"),
            ("raw", _select(raw, "raw_rows")),
        ],
        "new": [("new", _select(_NEW, "documents"))],
        "rep": [("rep", _select([*_D, ("reply", _reply())], "documents"))],
        "batch": [
            ("requests", _select([("batch_id", "doc_id // 10"), ("item_no", "doc_id % 10 + 1"),
                                  ("feedback", "text"), ("_ord", "doc_id")], "documents")),
            ("entries", _select([("batch_id", "doc_id // 10"), ("doc_id", "doc_id"), ("entry", _entry(_NUMBER))], "documents")),
            ("batch", "select batch_id, 'Result: [' || string_agg(entry, ', ' order by doc_id) || ', 5, {}]' reply "
                      "from entries group by 1"),
        ],
        "gold": [("gold", "select cast(doc_id as varchar) feedback_id, 'Environment' category, "
                          "case quality when 1 then 'Positive' else 'Negative' end sentiment, "
                          "case toxic when 1 then 'High' else 'Low' end severity from labels")],
        "q": [("q", "select conv_id * 1000 + turn question_id, text question from conversations where role = 'user' "
                    f"union all select * from (values {probes}) v(question_id, question)")],
    }


def with_bindings(names: str, body: str) -> str:
    """``body`` under the CTEs of the named bindings."""
    known = sql_bindings()
    ctes: dict[str, str] = {}
    for name in names.split():
        ctes.update(dict(known[name]))
    return "with " + ", ".join(f"{n} as ({sql})" for n, sql in ctes.items()) + " " + body
