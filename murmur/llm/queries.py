"""The operators over the given tables, as registered queries, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import (
    decontaminate,
    embeddings,
    lm,
    mixing,
    periods,
    pieces,
    secrets,
    simhash,
    token_counts,
    toxicity,
    training_order,
    urls,
    whitening,
)
from murmur.llm.common import held_out

TOKENIZERS = "/opt/tokenizers"
LM_FOLDS, TOXIC_FOLDS = 10, 5
URL_RULES = [
    ("net", "/", "block"), ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"), ("org", "/fr/", "allow"),
]


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm.score_documents(docs, ~held_out(F.col("doc_id"), LM_FOLDS))


def simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "crf")

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"),
        F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
    )


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_counts.read_pieces(f"{TOKENIZERS}/byte_bpe_50k.json")
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), pieces)


def training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoder = training_order.byte_pair_encoder(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    return training_order.materialise(table(spark, sf_dir, "documents"), encoder)


def embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.98)


def toxic_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    return toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("_id"), TOXIC_FOLDS))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxic_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id", held_out(F.col("doc_id"), TOXIC_FOLDS).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("shuffle_key")


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def planted_runs(docs: DataFrame) -> DataFrame:
    """The documents, those with crc32(id) % 10 = 0 ending in repeats of their own words.

    With g = floor(crc32 / 10), the words from a = g % n on become copies of the first
    p = 1 + floor((n - a) / (3 + g % 8)) of them.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w"))
    n = F.size("w")
    a = (F.col("g") % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice("w", a + 1, p), times)), F.lit(1), n - a)
    text = F.array_join(F.concat(F.slice("w", F.lit(1), a), tail), " ")
    return rows.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.periodic_runs(planted_runs(table(spark, sf_dir, "documents")), min_words=12)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.read_model(f"{TOKENIZERS}/piece_bpe_32k.model")
    found = pieces.round_trip(table(spark, sf_dir, "documents"), model)
    return found.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
with b as (select cast(item_id as varchar) item, {_WORDS.format('text')} w from benchmark),
bw as (select distinct item, w[i:i+9] win, len(w[i:i+9]) l
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from b where len(w) > 0)),
d as (select doc_id, {_WORDS.format('text')} w from documents),
dw as (select doc_id, i, l, w[i:i+l-1] win from (
  select doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) i
  from d cross join (select distinct l from bw) where len(w) >= l)),
hit as (select doc_id, i, dw.l, item from dw join bw on dw.win = bw.win),
words as (select doc_id, count(distinct p) n_hit from (
  select doc_id, unnest(generate_series(i, i + l - 1)) p from hit) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item, ',' order by item) names
  from (select distinct doc_id, item from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

URL_SQL = r"""
with p as (select page_id, """ + _LOW.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)") + r""" host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
r(h, p, v) as (values """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES) + r"""),
m as (select page_id, arg_max(h || r.p, length(h || r.p)) rule, arg_max(v, length(h || r.p)) verdict
  from p join r on (host = h or host like '%.' || h) and starts_with(path, r.p) group by page_id)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from p left join m using (page_id)
"""

EMBEDDING_SQL = """
with recursive v as (select vec_id, label, embedding::double[] e from embeddings
  where label is not null and embedding is not null),
links as (select a.vec_id a, b.vec_id b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select a, b from links union select reach.a, links.b from reach join links on reach.b = links.a),
root as (select a, min(b) b from reach group by a),
n as (select a, count(*) n from links group by a)
select vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(b, vec_id)) component_id,
  vec_id = least(vec_id, coalesce(b, vec_id)) kept
from embeddings left join root on vec_id = root.a left join n on vec_id = n.a
"""

MIXING_SQL = """
with recursive s as (select source, sum(length(coalesce(text, '')))::double size from documents group by source),
r as (select source, case when size > 0
  then (1.0::double / (select count(*) from s where size > 0)) * (select sum(size) from s) / size else 0 end rate from s),
c as (select source, rate, 0 k, -rate lg, exp(-rate) cdf from r where rate > 0
  union all select source, rate, k + 1, lg + ln(rate / (k + 1)), cdf + exp(lg + ln(rate / (k + 1)))
  from c where k + 1 <= ceil(rate + 12 * sqrt(rate) + 30)),
t as (select source, any_value(rate) rate, list(cdf) cdfs from c group by source),
u as (select *, (('0x' || substr(md5('42|' || coalesce(doc_id::varchar, 'text|' || coalesce(sha256(text), ''))), 1, 13))
  ::bigint::double + 0.5) / 4503599627370496.0 u from documents)
select u.* exclude (u), t.rate, unnest(range(len(list_filter(t.cdfs, lambda x: x < u.u)))) as copy
from u join t on u.source is not distinct from t.source
"""

QUERIES: dict[str, Query] = {
    "op1_lm_scoring": Query(lm_scoring),
    "op2_simhash": Query(simhash_dedup),
    "op3_decontamination": Query(decontamination, DECONTAMINATION_SQL),
    "op4_secret_scan": Query(secret_scan),
    "op5_url_filter": Query(url_filter, URL_SQL),
    "op6_token_counts": Query(token_count),
    "op7_training_order": Query(training_shards),
    "op8_embedding_dedup": Query(embedding_dedup, EMBEDDING_SQL),
    "op9_toxicity": Query(toxicity_scores),
    "op10_mixing": Query(source_mixing, MIXING_SQL),
    "op11_embedding_whitening": Query(embedding_whitening),
    "op12_periodic_runs": Query(periodic_runs),
    "op13_sentencepiece": Query(piece_round_trip),
}
