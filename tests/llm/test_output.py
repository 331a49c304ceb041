"""Mixing, training order, the registered queries and the pipeline."""

import math
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.llm import decontaminate, mixing, simhash, training_order
from murmur.llm.queries import QUERIES, TOKENIZERS, table, toxic_model

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, copy string"
ENCODER = training_order.byte_pair_encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


# --- mixing ------------------------------------------------------------------------------------

@pytest.mark.parametrize("rate", [0.0, 0.1, 1.0, 7.5, 1000.0])
def test_distribution_is_poisson(spark, rate):
    cdf = spark.range(1).select(mixing.distribution(F.lit(rate)).alias("c")).first()["c"]
    total = 0.0
    for k in range(min(len(cdf), 60)):
        total += math.exp(-rate + (k * math.log(rate) if k else 0) - math.lgamma(k + 1)) if rate else 1.0
        assert cdf[k] == pytest.approx(total, abs=1e-9)
    assert cdf[-1] == pytest.approx(1.0, abs=1e-9)


def test_sources_reach_their_weights(spark):
    rows = [(i, "x" * 10, "hot" if i % 3 else ("a" if i % 2 else None), "old") for i in range(3000)]
    rows += [(5000, None, "empty", ""), (None, "y" * 10, "a", "")]
    docs = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(docs)
    got = mixed.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()
    sizes = {r["source"]: r["n"] for r in got}
    assert set(sizes) == {"hot", "a", None}
    for n in sizes.values():  # a third each, up to chance
        assert abs(n - 10_000) < 1500
    once = mixing.mix(docs, {"a": 1.0}, total=20_000.0)
    assert {r["source"] for r in once.select("source").distinct().collect()} == {"a"}
    assert once.first()["rate"] == pytest.approx(20_000 / (500 * 10 + 10))
    assert mixing.mix(docs, {}).count() == 0
    assert mixing.mix(docs.limit(0)).collect() == []


def test_rows_without_an_id_are_drawn_on_their_own(spark):
    rows = [(None, f"{i:04}", "a", "") for i in range(1000)] + [(None, None, "a", "")]
    mixed = mixing.mix(spark.createDataFrame(rows, DOCS), {"a": 1.0}, total=2000.0)  # every second, on average
    got = mixed.select("text", "copy", "shuffle_key").collect()
    drawn = {r["text"] for r in got if r["text"] is not None}
    assert 300 < len(drawn) < 500  # 1 - 1/sqrt(e) of 1000, up to chance
    assert len({r["shuffle_key"] for r in got}) == len(got)


def test_a_rare_source_in_a_million_rows(spark):
    rare = F.when(F.col("id") == 5, "rare").otherwise("common")
    docs = spark.range(1_000_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), rare.alias("source"))
    got = {r["source"]: r for r in mixing.mix(docs).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("copy").alias("copies"), F.max("copy").alias("last")).collect()}
    assert abs(got["rare"]["n"] - 500_000) < 5000 and got["rare"]["copies"] == got["rare"]["n"] == got["rare"]["last"] + 1
    assert abs(got["common"]["n"] - 500_000) < 5000


def test_terms_around_a_large_rate_add_up(spark):
    rates = spark.createDataFrame([("a", 1500.0), ("b", 40_000.5), (None, 1e9)], "source string, rate double")
    rows = {r["rate"]: r for r in mixing.cells(rates).collect()}
    for rate in (1500.0, 40_000.5):
        r = rows[rate]
        ks = range(r["first"], r["first"] + mixing.CELLS * r["width"])
        exact = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in ks])[r["width"] - 1 :: r["width"]]
        assert np.abs(np.array(r["cells"]) - exact).max() < 1e-9
    assert all(abs(r["mass"] - 1) < 1e-9 for r in rows.values()) and len(rows) == 3


def test_counts_of_very_large_rates(spark):
    docs = table(spark, SF, "documents")
    rows, rate, n, large = mixing.counted(docs, total=1e15)
    z = (F.col(n) - F.col(rate)) / F.sqrt(F.col(rate))
    got = rows.agg(F.count(F.lit(1)).alias("rows"), F.avg(z).alias("mean"), F.stddev(z).alias("apart"), F.sum(n).alias("n"), F.sum(rate).alias("r")).first()
    assert large and got["rows"] == docs.count()
    assert abs(got["mean"]) < 0.25 and abs(got["apart"] - 1) < 0.2 and abs(got["n"] / got["r"] - 1) < 1e-5
    with pytest.raises(ValueError):
        mixing.counted(docs, total=1e20)


@pytest.mark.parametrize("rate", [900.0, 1100.0, 30_000.0])
def test_counts_at_the_change_of_method_invert_the_same_distribution(spark, rate):
    sums = np.cumsum([math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(int(rate + 12 * rate**0.5))])
    docs = spark.createDataFrame([(i, "x", "s", "") for i in range(300)], DOCS)
    rows, _, n, _ = mixing.counted(docs, total=300 * rate)
    u = mixing.uniform(F.lit(42), F.col("doc_id").cast("string"))
    for r in rows.select(F.col(n).alias("n"), u.alias("u")).collect():
        assert r["n"] == int((sums < r["u"]).sum())


def test_blocks_of_copies_hold_every_number_once(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 7)
    rows = spark.createDataFrame([(1, 0, [1]), (2, 7, [1]), (3, 8, [1]), (4, 49, None), (5, 50, [1]), (6, 700, [1]), (6, 700, [1])],
                                 "id long, n long, tags array<int>")
    got = Counter((r["id"], r["copy"]) for r in mixing.repeated(rows, "n", "copy", True).collect())
    expected = Counter((i, c) for i, n in ((2, 7), (3, 8), (4, 49), (5, 50), (6, 700), (6, 700)) for c in range(n))
    assert got == expected


def test_sql_of_mixing_holds_for_null_and_repeated_ids(spark, tmp_path):
    from check_oracle import compare, connect

    rows = [(i % 40 if i % 3 else None, f"text {i % 50} é" if i % 7 else None, ["a", "b", None, "empty"][i % 4] if i % 7 else "empty")
            for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    connection = connect(SF)
    connection.execute(f"create or replace view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    good, note = compare(spark, connection, "op10_mixing", QUERIES["op10_mixing"].run, QUERIES["op10_mixing"].sql, str(tmp_path))
    assert good, note


def test_columns_named_like_helper_columns_keep_their_values(spark):
    names = ["_id", "_text", "_spans", "_hit", "_kept", "__kept", "_source", "_rate", "_cdf", "_u", "_COUNT"]
    rows = [(1, "a b c d", "s"), (2, "k l m n o", "s"), (3, "k l m n o", "s")]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)
    own = tuple(n + "!" for n in names)
    docs = spark.createDataFrame([(*r, *own) for r in rows], schema)
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")

    def found(df):
        assert df.columns[:3] == docs.columns[:3]
        assert {tuple(r[n] for n in names) for r in df.collect()} <= {own}
        return sorted((r["doc_id"], r["text"]) for r in df.collect())

    assert found(simhash.keep_one(docs)) == [rows[0][:2], rows[1][:2]]
    assert found(decontaminate.remove_documents(docs, bench, 4)) == [rows[1][:2], rows[2][:2]]
    assert found(decontaminate.remove_spans(docs, bench, 4)) == [(1, ""), rows[1][:2], rows[2][:2]]
    assert {r[0] for r in found(mixing.mix(docs, total=2000.0))} == {1, 2, 3}


def test_counts_do_not_depend_on_the_reading_and_copies_are_numbered(spark):
    rows = [(i, "abc", "s", "") for i in range(400)] + [(7, "abc", "s", "")]
    docs = spark.createDataFrame(rows, DOCS)
    one, two = mixing.mix(docs, total=3000.0), mixing.mix(docs.repartition(7), total=3000.0)
    key = lambda df: sorted((r["doc_id"], r["copy"]) for r in df.collect())
    assert key(one) == key(two)
    per = Counter(r["doc_id"] for r in one.collect())
    assert per[7] % 2 == 0  # a repeated row is repeated alike
    for i, n in list(per.items())[:50]:
        if i != 7:
            assert sorted(r["copy"] for r in one.where(F.col("doc_id") == i).collect()) == list(range(n))
            break
    order = [r["doc_id"] for r in one.collect()]
    assert order != sorted(order)


# --- training order ----------------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_slots_are_a_keyed_permutation(n):
    one = training_order.slots(np.arange(n), n, 42)
    assert sorted(one.tolist()) == list(range(n))
    if n > 60:
        assert one.tolist() != training_order.slots(np.arange(n), n, 43).tolist()
        assert abs(np.corrcoef(np.arange(n), one)[0, 1]) < 0.4


TEXTS = [(1, "Hello  wörld\n\n 日本 it's"), (2, None), (3, ""), (4, " \t "), (None, "a b"), (1, "again"), (6, "word " * 700)]


def test_chunks_have_the_tokens_of_the_whole_text():
    """Blanks of all kinds, lone or in runs, before and after words, marks and apostrophes."""
    encode = ENCODER()
    rng = np.random.default_rng(5)
    alphabet = list(" \t\n\v\f\r\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u3000\u200b \u00a0aZ\u00e9\u4e2d1\u00bd'.,!_") + ["'s", "'ll", " 's", "  "]
    texts = ["\n  \xa0 \xa0  1's", "", " ", "\xa0", "a\xa0", "\xa0 a", "a \x1c b", "a \x1c\x1d b é"]
    texts += ["".join(rng.choice(alphabet, rng.integers(1, 25))) for _ in range(20_000)]
    chunks = training_order.Chunks(encode)
    for text in texts:
        parts = training_order._CHUNK.findall(text)
        assert "".join(parts) == text
        assert b"".join(map(chunks.__getitem__, parts)) == np.array(encode(text), "<u2").tobytes(), repr(text)


@pytest.fixture
def shards(spark):
    docs = spark.createDataFrame([(*t, "s", "") for t in TEXTS], DOCS)
    return training_order.materialise(docs, ENCODER, length=16, records=8)


def test_shards_hold_every_sequence_once_and_texts_come_back(spark, shards, tmp_path):
    rows = sorted(shards.collect(), key=lambda r: r["shard"])
    assert [r["shard"] for r in rows] == list(range(len(rows)))
    assert [r["first_slot"] for r in rows] == [8 * i for i in range(len(rows))]
    assert all(r["n_records"] == 8 for r in rows[:-1]) and {r["stride"] for r in rows} == {16 + 32}
    assert all(len(r["data"]) == r["n_records"] * r["stride"] and len(r["doc_ids"]) == r["n_records"] for r in rows)
    path = training_order.write_shards(shards, str(tmp_path))
    read = training_order.read_from(spark, path).collect()
    assert [r["slot"] for r in read] == list(range(len(read)))
    assert [r["doc_id"] for r in read] == [i for r in rows for i in r["doc_ids"]]
    encode = ENCODER()
    ends = Counter()
    for doc, text in TEXTS:
        if doc != 1:
            tokens = [t for r in sorted(read, key=lambda r: r["number"]) if r["doc_id"] == doc for t in r["tokens"]]
            assert tokens == [*encode(text or ""), 50256]
        ends[doc] += 1
    assert sum(t == 50256 for r in read for t in r["tokens"]) == len(TEXTS)
    later = training_order.read_from(spark, path, 21).collect()
    assert [tuple(r) for r in later] == [tuple(r) for r in read[21:]]


def test_no_documents_no_shards(spark):
    assert training_order.materialise(spark.createDataFrame([], DOCS), ENCODER).collect() == []
    with pytest.raises(ValueError):
        training_order.materialise(spark.createDataFrame([], DOCS), ENCODER, length=0)


# --- queries and pipeline ----------------------------------------------------------------------

NATIVE = ["op3_decontamination", "op5_url_filter", "op10_mixing"]


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_queries_equal_their_sql(spark, name):
    from check_oracle import compare, connect

    good, note = compare(spark, connect(SF), name, QUERIES[name].run, QUERIES[name].sql, SF)
    assert good, note


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_have_no_python_and_no_product(spark, name):
    plan = QUERIES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_every_query_covers_its_table(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    n = {t: table(spark, SF, t).count() for t in ("documents", "pages", "embeddings")}
    for name, source in [("op1_lm_scoring", "documents"), ("op2_simhash", "documents"), ("op4_secret_scan", "documents"),
                         ("op6_token_counts", "documents"), ("op9_toxicity", "documents")]:
        assert QUERIES[name].run(spark, SF).count() == n[source], name


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = table(spark, SF, "documents")
    names = [n for n, _ in p.STAGES]
    kept, after = docs, {}
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns
        kept = spark.createDataFrame(kept.collect(), kept.schema)
        after[name] = [r["doc_id"] for r in kept.collect()]
    clean = set(after[names[0]])
    model = toxic_model(spark, docs, SF)
    from murmur.llm import decontaminate, toxicity

    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert clean == {i for i, s in scores.items() if s < 0.5}
    groups = simhash.near_duplicates(docs.where(F.col("doc_id").isin(*clean))).collect()
    assert sorted(after[names[1]]) == sorted({r["component_id"] for r in groups})
    hit = {r["doc_id"] for r in decontaminate.report(docs, table(spark, SF, "benchmark")).where("n_hit > 0").collect()}
    assert set(after[names[2]]) == set(after[names[1]]) - hit
    assert set(after[names[3]]) <= set(after[names[2]])
    shards = p.STAGES[-1][1](spark, kept, SF).collect()
    assert {i for r in shards for i in r["doc_ids"]} == set(after[names[3]])
