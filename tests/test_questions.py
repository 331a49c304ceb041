import pytest

from murmur.operators import questions as q
from murmur.operators import ranking as r


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id long, question string")


# location, category, sentiment, severity, text, action
ROWS = [
    ("Library", "Internet", "Negative", "High", "heating broken", "Fix it"),
    ("Library", "Internet", "Negative", "Low", "window noisy", "Look"),
    ("Wi-Fi Areas", "Internet", "Mixed", "Medium", "wifi-router slow", "Fix it"),
    ("Food Court", "Food Service", "Positive", "Low", "clean tables", "No Action Needed"),
    ("Food Court", "Food Service", "Negative", "Medium", "heat and noise", "Look"),
    ("Campus Entrance", "Other", "Positive", "Low", "great door", ""),
    ("Lab", "Other", "Neutral", "Low", "plain room", "no action needed"),
    ("IT", "Internet", "Mixed", "Low", "the of", "Fix it"),
    ("Library", "Other", "Positive", "Low", "windows open", ""),
]
COLUMNS = ["location", "category", "sentiment", "severity", "feedback", "suggested_action"]


@pytest.fixture
def wards(feedback):
    rows = [dict(zip(COLUMNS, row, strict=True)) for row in ROWS]
    return rows, feedback(rows)


@pytest.mark.parametrize(("question", "places"), [
    ("Is the library ok?", {"Library"}), ("librarians", {"Library"}), ("wifi", {"Wi-Fi Areas"}),
    ("Wi-Fi!", {"Wi-Fi Areas"}), ("foodie", {"Food Court"}), ("court or lab?", {"Food Court", "Lab"}),
    ("entra", {"Campus Entrance"}), ("campus area", set()), ("it", set()), ("labrador", {"Lab"}), ("xyzzy", set()), ("", set()),
])
def test_places_a_question_names(spark, wards, question, places):
    assert {x["location"] for x in q.mentioned_locations(ask(spark, question), wards[1]).collect()} == places


def test_categories_a_question_names(spark, wards):
    asked = ask(spark, "internet and food service", "INTERNET", "foodservice", "another")
    got = {tuple(x) for x in q.mentioned_categories(asked, wards[1]).collect()}
    assert got == {(0, "Internet"), (0, "Food Service"), (1, "Internet"), (3, "Other")}


@pytest.mark.parametrize(("question", "hits"), [
    ("heating broken", [0]), ("window panes", [1, 8]), ("noisy spots", [1]), ("wifi-router", [2]),
    ("heating windows", [0, 1, 8]), ("the of", []), ("xyzzy", []), ("", []),
])
def test_rows_a_question_hits_by_severity(spark, wards, question, hits):
    shifted = wards[1].withColumn("_ord", wards[1]["_ord"] * 40_000 + 17)
    got = sorted((x["rank"], x["_ord"], x["hits"]) for x in q.keyword_hits(ask(spark, question), shifted).collect())
    assert got == [(k, o * 40_000 + 17, len(hits)) for k, o in enumerate(hits, 1)]


def test_routes_and_their_order(spark, wards):
    cases = {
        "Hello!": "greeting", "help? ": "greeting", "What can you do": "greeting", "hi there": "none",
        "Hey, library": "location", "most complaints by location": "top_locations", "where to stop": "top_locations",
        "where am i": "none", "Anything urgent?": "high_severity", "highway": "high_severity",
        "suggest something": "top_actions", "please fix": "top_actions", "complaints": "negative_digest",
        "summary": "negative_digest", "any praise": "positive", "main thing": "top_categories",
        "stop it": "top_categories", "how many": "count", "internet": "category", "noisy spots": "keyword",
        "window panes": "keyword", "nothing": "none", "": "none", "fix the library": "location",
        "most serious": "high_severity",
    }
    routed = q.route_questions(ask(spark, *cases), wards[1]).collect()
    assert {x["question"]: x["intent"] for x in routed} == cases


def test_routes_before_analysis(spark, wards):
    df = wards[1].select("_ord", "feedback_id", "date", "location", "feedback")
    cases = {"anything urgent": "none", "praise": "none", "how many": "count", "internet": "none",
             "complain": "negative_digest", "suggest": "top_actions", "most locations": "top_locations"}
    assert {x["question"]: x["intent"] for x in q.route_questions(ask(spark, *cases), df).collect()} == cases
    answers = {x["question_id"]: x["answer"] for x in q.answer_questions(ask(spark, *cases), df).collect()}
    assert answers[2] == "There are 9 feedback records across 6 locations."
    assert answers[4] == q.NO_LABELS_YET_TEXT and answers[5] == q.NO_ACTIONS_YET_TEXT


ANSWERS = {
    "hi": q.GREETING_TEXT,
    "the library": "**Library** has 3 report(s) (2 negative/mixed):\n"
                   "- **Library** (High severity, Internet): heating broken\n"
                   "- **Library** (Low severity, Internet): window noisy",
    "top location": "**Library** has the most negative/mixed reports (2). Next: Food Court (1), IT (1).",
    "urgent": "1 report(s) are High severity:\n- **Library** (High severity, Internet): heating broken",
    "improve": "Commonly suggested improvements:\n- Fix it\n- Look",
    "negative": "There are 3 negative reports. Top categories: Internet (2), Food Service (1). "
                "Top locations: Library (2), Food Court (1).\n"
                "- **Library** (High severity, Internet): heating broken\n"
                "- **Food Court** (Medium severity, Food Service): heat and noise\n"
                "- **Library** (Low severity, Internet): window noisy",
    "praise": "There are 3 positive reports:\n"
              "- **Food Court** (Low severity, Food Service): clean tables\n"
              "- **Campus Entrance** (Low severity, Other): great door\n"
              "- **Library** (Low severity, Other): windows open",
    "most": "The most common problem category is **Internet** (4 reports). Next: Food Service (1).",
    "how many": "There are 9 feedback records: Negative 3, Positive 3, Mixed 2, Neutral 1.",
    "internet": "4 report(s) in **Internet**:\n"
                "- **Library** (High severity, Internet): heating broken\n"
                "- **Wi-Fi Areas** (Medium severity, Internet): wifi-router slow\n"
                "- **Library** (Low severity, Internet): window noisy\n"
                "- **IT** (Low severity, Internet): the of",
    "window pane": "Found 2 related report(s):\n"
                   "- **Library** (Low severity, Internet): window noisy\n"
                   "- **Library** (Low severity, Other): windows open",
    "xyzzy": q.NOT_ENOUGH_TEXT,
}


def test_answers(spark, wards):
    got = q.answer_questions(ask(spark, *ANSWERS), wards[1], error="no token").collect()
    assert {list(ANSWERS)[x["question_id"]]: x["answer"] for x in got} == ANSWERS
    assert {(x["mode"], x["error"]) for x in got} == {("local", "no token")}
    empty = q.answer_questions(ask(spark, "hi"), wards[1].limit(0)).first()
    assert empty["answer"] == q.NOT_ENOUGH_TEXT


def test_place_without_complaints_and_empty_lists(spark, feedback):
    df = feedback([{"location": "Library", "sentiment": "Positive", "category": None, "suggested_action": "no action needed"}])
    got = [x["answer"] for x in q.answer_questions(
        ask(spark, "library", "urgent", "negative", "improve", "most", "most complaints where"), df).orderBy("question_id").collect()]
    assert got == [
        "**Library** has 1 report(s) and none of them are negative or mixed.",
        q.NO_HIGH_TEXT, q.NO_NEGATIVE_TEXT, q.NOT_ENOUGH_TEXT, q.NOT_ENOUGH_TEXT, q.NOT_ENOUGH_TEXT,
    ]


def test_relevance_only_ranks_large_tables(spark, wards):
    got = [(x["score"], x["_ord"]) for x in r.relevance_topk(wards[1], "broken window?", k=4).collect()]
    assert got == [(13, 0), (11, 1), (11, 8), (2, 2)]
    every = r.relevance_topk(wards[1], "broken window?", k=9).collect()
    assert [(x["score"], x["_ord"]) for x in every] == [(0, i) for i in range(9)]


def test_record_lines_and_context(spark, feedback):
    df = feedback([{"suggested_action": a} for a in ("Look", "NO action needed", "", None)])
    lines = [x[0] for x in df.orderBy("_ord").select(r.record_line(df)).collect()]
    assert lines[0] == "0 | 2026-01-01 | Hall | Safety | Negative | Low | x | Action: Look"
    assert [line.count("Action") for line in lines] == [1, 0, 0, 0]
    context = r.context_lines(df, "x").orderBy("part", "block_no", "position").collect()
    assert context[0]["line"] == "### Dataset: Feedback (Full) - All 4 records are listed."
    assert context[1]["line"] == r.ANALYZED_HEADING and sum(x["part"] == 2 for x in context) == 4
    tables = [x["line"] for x in context if x["part"] == 3]
    assert tables[0] == "### Dataset: By Location" and tables[2].startswith("Hall,4,100.0")
    plain = r.context_lines(df.select("_ord", "feedback_id", "date", "location", "feedback"), "x").collect()
    assert {x["line"] for x in plain} >= {r.PLAIN_HEADING, r.NOT_ANALYZED_NOTE}
    assert [x["line"] for x in r.bullets(df, 3).collect()][-1] == "- ...and 1 more."


def test_a_word_in_a_third_of_many_questions(spark, feedback):
    """One word in a third of 30,000 questions and a third of the texts: no row of any table grows with it."""
    from pyspark.sql import functions as F
    from murmur.operators import questions as q

    texts = [f"common thing{i % 7:04}" if i % 3 == 0 else f"rare{i:05}" for i in range(3000)]
    df = feedback([{"feedback": t, "severity": ["Low", "High"][i % 2]} for i, t in enumerate(texts)])
    words = F.concat(F.when(F.col("id") % 3 == 0, "common").otherwise("unheard"), F.lit(" rare"), F.lpad((F.col("id") % 5000).cast("string"), 5, "0"))
    asked = spark.range(30_000, numPartitions=4).select(F.col("id").alias("question_id"), words.alias("question"))
    found = q.search(asked, df)
    assert found.sets.count() <= 30_000 and found.words.groupBy("_set").count().agg(F.max("count")).first()[0] <= 2
    hits = {r["question_id"]: (r["hits"], r["rank"], r["_ord"]) for r in q.keyword_hits(asked, df, 1).collect()}
    common, rare = set(range(0, 3000, 3)), {i for i in range(3000) if i % 3}
    for i in (0, 3, 6, 2999, 4, 29_999, 14_997):
        # Terms are five letters long: every "rare..." question meets all texts with "rare0", "rare1", "rare2".
        own = rare if (i % 5000) // 10_000 == 0 else set()
        expected = own | (common if i % 3 == 0 else set())
        assert hits[i][0] == len({t for t in expected if i % 3 == 0 or t in own}), i
        assert hits[i][1:] == (1, min(t for t in expected if t % 2))


def test_texts_are_counted_across_blocks(spark, feedback):
    from pyspark.sql import functions as F
    from murmur.operators import questions as q

    n = 70_000  # three blocks of 32,768 texts
    df = spark.range(n, numPartitions=4).select(
        (F.col("id") * 1000).alias("_ord"), F.when(F.col("id") % 2 == 0, "alpha thing").otherwise("other thing").alias("feedback"))
    asked = spark.createDataFrame([(1, "alpha"), (2, "thing alpha"), (3, "other alpha"), (4, "nowhere")], "question_id long, question string")
    got = {r["question_id"]: (r["hits"], r["_ord"]) for r in q.keyword_hits(asked, df, 1).collect()}
    assert got == {1: (n // 2, 0), 2: (n, 0), 3: (n, 0)}


def test_context_of_a_table_of_questions_is_that_of_each_question(spark, feedback, monkeypatch):
    import random

    from murmur.operators import context

    rng = random.Random(3)
    words = ["heating", "broken", "window", "library", "slow", "printer", "a-b", "cafeteria", "é"]
    rows = [{"feedback": rng.choice([None, ""]) if i % 29 == 0 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))),
             "location": rng.choice(["Hall", "Printer room", None]), "severity": rng.choice(["Low", "Medium", "High"])} for i in range(400)]
    asked = {1: "Is the heating broken?", 2: "printer printer window", 3: "", 4: "nothing here", 5: "slowly library cafeteria heating",
             6: None, 7: "broken broken broken slow"}
    questions = spark.createDataFrame([*asked.items(), (1, asked[1])][:-1], "question_id long, question string")
    for df in (feedback(rows), feedback(rows, analyzed=False).drop("severity")):
        expected = {q: [(x["_ord"], x["score"]) for x in r.relevance_topk(df, text or "", k=20).collect()] for q, text in asked.items()}
        for size in (4096, 3):
            monkeypatch.setattr(context, "QUESTIONS_AT_ONCE", size)
            got = {q: [] for q in asked}
            for x in sorted(context.relevance_batch(questions, df, 20).collect(), key=lambda x: x["rank"]):
                got[x["question_id"]].append((x["_ord"], x["score"]))
            assert got == expected
    df = feedback(rows[:15])
    got = context.context_batch(questions, df, 20).collect()
    lines = {x["_ord"]: x["line"] for x in df.select("_ord", r.record_line(df).alias("line")).collect()}
    assert len(got) == 7 * 15 and all(x["line"] == lines[x["_ord"]] and x["score"] == 0 and x["rank"] == x["_ord"] + 1 for x in got)
    assert context.context_batch(questions, df.limit(0), 20).collect() == []
    assert context.relevance_batch(questions.limit(0), feedback(rows), 20).collect() == []


def test_hits_of_sets_in_parts_are_those_of_a_plain_search(spark, feedback, monkeypatch):
    """Sets in several parts, texts in several groups and blocks, ids null and repeated; one row for a set and group."""
    import random

    from pyspark.sql import functions as F
    from murmur.functions import text as tx

    monkeypatch.setattr(q, "SETS_IN_MEMORY", 7)
    monkeypatch.setattr(q, "SETS_AT_ONCE", 2)
    monkeypatch.setattr(q, "TEXTS_AT_ONCE", 64)
    rng = random.Random(5)
    words = [f"{c}{c}word{i}" for i, c in enumerate("abcdefghij")]
    texts = [" ".join(rng.sample(words, rng.randrange(4))) for _ in range(900)]
    df = feedback([{"feedback": t, "severity": rng.choice(["Low", "Medium", "High"])} for t in texts])
    df = df.withColumn("_ord", F.when(F.col("_ord") != 0, F.col("_ord"))).unionByName(df.where("_ord = 5"))
    asked = [" ".join(rng.sample([*words, "nowhere"], rng.randrange(1, 5))) for _ in range(40)]
    rows = [(r["_ord"], r["feedback"], {"Low": 1, "Medium": 2, "High": 3}[r["severity"]]) for r in df.distinct().collect()]
    expected = {}
    for i, question in enumerate(asked):
        met = sorted((-w, -1 if o is None else o) for o, t, w in rows if any(x[:5] in t for x in question.split()))
        expected |= {(i, k): (len(met), None if o < 0 else o) for k, (_, o) in enumerate(met[:5], 1)}
    found = q.keyword_hits(ask(spark, *asked).unionByName(spark.createDataFrame([(None, "aaword bbword ccword ddword eeword ffword")], q.QUESTION_SCHEMA)), df)
    assert {(r["question_id"], r["rank"]): (r["hits"], r["_ord"]) for r in found.collect()} == expected
    assert "bitmap" not in found._jdf.queryExecution().executedPlan().toString()


def test_context_scores_kinds_of_records_for_sets_of_words(spark, feedback, monkeypatch):
    """However many records and questions there are, what is scored is k records of a kind for each set of words."""
    from murmur.operators import context

    texts = ["heating broken", "window noisy", "heating and window"]
    df = feedback([{"feedback": texts[i % 3], "severity": "Low"} for i in range(400)])
    asked = ask(spark, *[["nothing here", "the heating", f"heating xyzzy{i}", "window heating"][i % 4] for i in range(60)])
    seen, scored = [], context._scored

    def note(records, sets, ids, k, scale):
        seen.append((records.count(), len(ids)))
        return scored(records, sets, ids, k, scale)

    monkeypatch.setattr(context, "_scored", note)
    asked = asked.unionByName(spark.createDataFrame([(None, "heating")], "question_id long, question string"))
    got = {}
    for x in context.relevance_batch(asked, df, 10).collect():
        got.setdefault(x["question_id"], {})[x["rank"]] = (x["_ord"], x["score"])
    assert seen == [(30, 2)]
    of_heating = [(i, 11) for i in range(400) if i % 3 != 1][:10]
    expected = [[(i, 1) for i in range(10)], of_heating, of_heating, [(3 * i + 2, 21) for i in range(10)]]
    assert [got[None][k] for k in range(1, 11)] == expected[0]
    assert all([got[i][k] for k in range(1, 11)] == expected[i % 4] for i in range(60))


def test_texts_are_met_by_kind_and_questions_by_words_that_texts_have(spark, feedback):
    """However many texts and questions there are, what meets is the kinds of both."""
    from pyspark.sql import functions as F

    texts = ["heating broken", "broken window", "window noisy", "nothing here"]
    df = feedback([{"feedback": texts[i % 4], "severity": ["Low", "High"][i % 7 == 0]} for i in range(1200)])
    asked = ask(spark, *[["heating unheard", "window heating unheard", "unheard", "broken"][i % 4] + f" q{i:03}" for i in range(400)])
    asked = asked.unionByName(spark.createDataFrame([(None, "broken q003")], q.QUESTION_SCHEMA))
    found = q.search(asked, df)
    tasks = found.texts.rdd.getNumPartitions()
    assert found.words.count() == 3 and found.texts.count() <= 6 * 5 * tasks
    assert found.texts.agg(F.sum("_times")).first()[0] == 900
    hits = [{i for i in range(1200) if any(w in texts[i % 4] for w in words)} for words in (["heating"], ["window", "heating"], [], ["broken"])]
    expected = {}
    for i in range(400):
        first = sorted(hits[i % 4], key=lambda o: (o % 7 != 0, o))[:5]
        expected |= {(i, k): (len(hits[i % 4]), o) for k, o in enumerate(first, 1)}
    got = {(r["question_id"], r["rank"]): (r["hits"], r["_ord"]) for r in q.keyword_hits(asked, df).collect()}
    # A question without an id has the set of one of the very same words, as before.
    assert got == expected | {(None, k): v for (i, k), v in expected.items() if i == 3}


def test_unions_of_kinds_are_those_of_plain_sets():
    """Texts in any number of blocks and merges, words that are rare and frequent, sets with none, one and many."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(11)
    texts = [(o * 3 - 5000, rng.randrange(1, 4), sorted({min(int(rng.expovariate(0.2)), 60) for _ in range(rng.randrange(1, 5))})) for o in range(9000)]
    sets = [sorted(rng.sample(range(70), rng.randrange(1, 7))) for _ in range(300)]
    schema = pa.schema([("_ord", pa.int64()), ("_weight", pa.int64()), ("_times", pa.int64()), ("_codes", pa.list_(pa.int64()))])

    def table(rows):
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    rows = [(o, w, 1, c) for o, w, c in texts]
    rng.shuffle(rows)
    parts = [q.kinds(table(rows[i : i + 2500]), 5) for i in range(0, 9000, 2500)]
    met = q.kinds(pa.concat_tables([*parts[:2], parts[2].slice(3), parts[2].slice(0, 3)]), 5).to_pylist() + parts[3].to_pylist()
    assert sum(r["_times"] for r in met) == 9000 and len(met) < 9000
    for taken in (met, [{"_ord": o, "_weight": w, "_times": n, "_codes": c} for o, w, n, c in rows]):
        taken = sorted(taken, key=lambda r: (-r["_weight"], r["_ord"]))
        unions = q.Unions(np.arange(300) * 10, np.array([len(s) for s in sets]), np.concatenate(sets), 5)
        for start in range(0, len(taken), q.TEXTS_AT_ONCE):
            block = taken[start : start + q.TEXTS_AT_ONCE]
            owner = np.repeat(np.arange(len(block)), [len(r["_codes"]) for r in block])
            unions.add(*(np.array([r[c] for r in block]) for c in ("_ord", "_weight", "_times")), owner, np.concatenate([r["_codes"] for r in block]))
        got = {r["_set"]: (r["hits"], [(x["lack"], x["ord"]) for x in r["first"]]) for b in unions.rows() for r in b.to_pylist()}
        for i, words in enumerate(sets):
            own = sorted((-w, o) for o, w, c in texts if set(c) & set(words))
            assert got.get(i * 10, (0, [])) == (len(own), own[:5])


def test_many_names_are_found_like_few(spark, wards, monkeypatch):
    asked = ask(spark, "is the library ok", "wifi and food court", "internet or food service", "entrance", None, "")
    few = [sorted(map(tuple, f(asked, wards[1]).collect())) for f in (q.mentioned_locations, q.mentioned_categories)]
    answers = sorted(map(tuple, q.answer_questions(asked, wards[1]).collect()))
    monkeypatch.setattr(q, "FEW_KEYS", 0)
    monkeypatch.setattr(q, "FEW_ROWS", 0)
    assert [sorted(map(tuple, f(asked, wards[1]).collect())) for f in (q.mentioned_locations, q.mentioned_categories)] == few
    assert few[0] and few[1] and sorted(map(tuple, q.answer_questions(asked, wards[1]).collect())) == answers
    assert q.mentioned_locations(asked, wards[1].where("location = 'IT'")).collect() == []
    assert q.mentioned_categories(asked, wards[1].where("category is null")).collect() == []


def test_first_rows_lie_within_the_bounds_of_their_labels(spark, feedback, monkeypatch):
    """Few of many records are sorted for the lists; numbers may be null, negative or repeated."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(2)
    rows = [{"location": rng.choice(["Hall", "Lab", None]), "category": rng.choice(["Safety", "Other", None]), "feedback": str(rng.random()),
             "sentiment": rng.choice(["Negative", "Mixed", "Positive", None]), "severity": rng.choice(["Low", "High", None])} for _ in range(3000)]
    df = feedback(rows).withColumn("_ord", F.when(F.col("_ord") % 500 != 1, (F.col("_ord") * 7919) % 2003 - 1000))
    counts = q.label_counts(df).cache()
    assert counts.agg(F.sum("_n")).first()[0] == 3000
    near = df.join(counts, (df.location.eqNullSafe(counts.location)) & (df.category.eqNullSafe(counts.category))
                   & (df.sentiment.eqNullSafe(counts.sentiment)) & (df.severity.eqNullSafe(counts.severity)) & (df["_ord"] <= counts["_bound"]))
    assert counts.count() * 6 <= near.count() < 1500

    def listed(some):
        return sorted(map(repr, q._first_rows(some, q.label_counts(some)).collect()))

    plain = df.drop("category")
    got = [listed(df), listed(plain)]
    monkeypatch.setattr(q, "is_small", lambda *_: False)
    assert [listed(df), listed(plain)] == got and len(got[0]) == 6 * (2 + 2 + 3) and len(got[1]) == 12
