"""The records closest to each question of a table, as context for a model."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.ordering import top_rows
from murmur.functions.text import grams, prefixes, query_words, search_form
from murmur.operators.joins import broadcast_if_small
from murmur.operators.questions import PREFIX_MIN, TERM_LETTERS
from murmur.operators.ranking import MAX_CONTEXT_ROWS, record_line
from murmur.schema import ORD, is_analyzed, severity_weight
from murmur.session import cut_lineage

QUESTIONS_AT_ONCE = 4096  # sets of words; with 150 rows each their lists take 10 MB in a task
ROWS_AT_ONCE = 256


def _asked(questions: DataFrame) -> DataFrame:
    """(question_id, prefix, code, times): what is sought, and how often the question says it."""
    words = questions.select("question_id", F.explode(prefixes(query_words(F.col("question")))).alias("prefix"))
    code = F.conv(F.concat(F.lit("1"), F.col("prefix")), 36, 10).cast("long").alias("code")
    return words.groupBy("question_id", "prefix").agg(F.count(F.lit(1)).alias("times")).select("question_id", "prefix", code, "times")


def _records(asked: DataFrame, df: DataFrame, weight: Column) -> DataFrame:
    """(_ord, _weight, codes) of the records with any asked-for word in text or place; one scan."""
    stem = F.substring("prefix", 1, PREFIX_MIN).alias("_stem")
    wanted = cut_lineage(asked.select("prefix", "code").distinct().select("prefix", "code", stem))
    text = F.concat(search_form(F.col("feedback")), F.lit(" "), search_form(F.col("location")))
    runs = F.array_distinct(grams(text, [(PREFIX_MIN, TERM_LETTERS)]))
    found = df.select(ORD, weight.alias("_weight"), F.explode(runs).alias("_run"))
    keyed = found.withColumn("_stem", F.substring("_run", 1, PREFIX_MIN))
    met = keyed.join(broadcast_if_small(wanted), "_stem").where(F.startswith("_run", "prefix"))
    return cut_lineage(met.groupBy(ORD, "_weight").agg(F.collect_set("code").alias("codes")))


class Best:
    """The k best (score, _ord) of each question of a block, met in rising _ord."""

    def __init__(self, asked: list[tuple[int, int, int]], questions: int, k: int):
        self.k, self.n = k, questions
        own = np.array(sorted((c, q, t) for q, c, t in asked), np.int64).reshape(-1, 3)
        self.words, self.starts, self.sizes = np.unique(own[:, 0], return_index=True, return_counts=True)
        self.asks, self.times = own[:, 1], own[:, 2]
        self.lists: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * questions
        self.bar = np.full(questions, -1, np.int64)  # the score that is beaten to get on a full list

    def add(self, ords: np.ndarray, weights: np.ndarray, owner: np.ndarray, codes: np.ndarray, scale: int) -> None:
        """Records by number and weight; ``codes`` are the words of the records ``owner``."""
        if not self.words.size:
            return
        word = np.minimum(np.searchsorted(self.words, codes), self.words.size - 1)
        known = self.words[word] == codes
        word, owner = word[known], owner[known]
        if not word.size:
            return
        sizes = self.sizes[word]
        at = np.repeat(self.starts[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        cell = np.repeat(owner, sizes) * self.n + self.asks[at]
        hits = np.bincount(cell, self.times[at], ords.size * self.n).reshape(-1, self.n).astype(np.int64)
        scores = hits * scale + weights[:, None]
        # What comes later loses a tie, so only a higher score gets on a full list.
        question, row = np.nonzero(((hits > 0) & (scores > self.bar)).T)
        if not question.size:
            return
        starts = np.flatnonzero(np.diff(question, prepend=-1))
        for q, part in zip(question[starts], np.split(row, starts[1:]), strict=True):
            score = np.append(self.lists[q][0], scores[part, q])
            place = np.append(self.lists[q][1], ords[part])
            best = np.lexsort((place, -score))[: self.k]
            self.lists[q] = score[best], place[best]
            if best.size == self.k:
                self.bar[q] = score[best[-1]]


def _scored(records: DataFrame, asked: DataFrame, ids: list[str], k: int, scale: int) -> DataFrame:
    """(_set, _ord, score): each task's best rows of each set of a block, from one pass of the small table."""
    number = {q: i for i, q in enumerate(ids)}
    block = asked.where(F.col("_set").between(ids[0], ids[-1]))  # the ids are sorted
    rows = [(number[r["_set"]], r["code"], r["times"]) for r in block.collect()]  # of QUESTIONS_AT_ONCE sets
    shared = records.sparkSession.sparkContext.broadcast((rows, ids))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked_, ids_ = shared.value
        best = Best(asked_, len(ids_), k)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(start, ROWS_AT_ONCE)
                codes = part.column(2)
                owner = np.repeat(np.arange(part.num_rows), codes.value_lengths().to_numpy())
                best.add(part.column(0).to_numpy(), part.column(1).to_numpy(), owner, codes.flatten().to_numpy(), scale)
        for q, (score, place) in zip(ids_, best.lists, strict=True):
            if score.size:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * score.size), pa.array(place), pa.array(score)], ["_set", ORD, "score"])

    ordered = records.select(ORD, F.col("_weight").cast("long").alias("_weight"), "codes").sortWithinPartitions(ORD)
    return ordered.mapInArrow(work, f"_set string, {ORD} long, score long")


def _best(questions: DataFrame, df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(question_id, _set) and (_set, rank, _ord, score): questions that hit the same words as often share a list.

    Words that no record has are left out, so all questions without a hit share the set of no words, named ``""``.
    Records of equal words and weight differ in nothing but their number: the first ``k`` of a kind are kept.
    """
    weight = severity_weight() if is_analyzed(df) else F.lit(0).cast("long")
    scale = 10 if is_analyzed(df) else 1
    first = df.select(ORD, weight.alias("_weight")).orderBy(F.desc("_weight"), ORD).limit(k + 1).collect()
    large = len(first) > k
    ids = questions.select("question_id").distinct()
    # At most k rows; they are candidates for every set.
    lead = [(r[ORD], r["_weight"] if large else 0) for r in first[:k]]
    filler = df.sparkSession.createDataFrame(lead, f"{ORD} long, score long")
    owners, found = ids.withColumn("_set", F.lit("")), filler.withColumn("_set", F.lit(""))
    if large:
        asked = cut_lineage(_asked(questions))
        records = _records(asked, df, weight).withColumn("codes", F.sort_array("codes"))
        records = cut_lineage(top_rows(records, ["_weight", "codes"], [F.asc(ORD)], k, "_rank").drop("_rank"))
        # The question without an id has no words.
        met = asked.where(F.col("question_id").isNotNull()).join(records.select(F.explode("codes").alias("code")).distinct(), "code", "left_semi")
        own = met.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("code", "times"))).alias("_asks"))
        own = cut_lineage(own.withColumn("_set", F.sha1(F.to_json("_asks"))))
        sets = cut_lineage(own.groupBy("_set").agg(F.any_value("_asks").alias("_asks")).select("_set", F.inline("_asks")))
        # The names of the sets and the words of one block at a time are what the driver needs.
        every = [r[0] for r in sets.select("_set").distinct().orderBy("_set").toLocalIterator()]
        parts = [_scored(records, sets, every[i : i + QUESTIONS_AT_ONCE], k, scale) for i in range(0, len(every), QUESTIONS_AT_ONCE)]
        named = sets.select("_set").distinct()
        owners = ids.join(own.select("question_id", "_set"), "question_id", "left").withColumn("_set", F.coalesce("_set", F.lit("")))
        if parts:
            literal = F.from_json(F.lit(str([list(x) for x in lead])), "array<array<bigint>>")
            behind = named.unionByName(ids.limit(1).select(F.lit("").alias("_set"))).select("_set", F.explode(literal).alias("_f")).select(
                "_set", F.col("_f")[0].alias(ORD), F.col("_f")[1].alias("score"))
            found = cut_lineage(reduce(DataFrame.unionByName, parts)).unionByName(behind)
            found = found.groupBy("_set", ORD).agg(F.max("score").alias("score"))
    ranked = top_rows(found, ["_set"], [F.desc("score"), F.asc(ORD)], k, "rank")
    return owners, ranked.select("_set", "rank", ORD, "score")


def _given(owners: DataFrame, rows: DataFrame) -> DataFrame:
    """Each question with the rows of its set; those of the set of no words are k at most and held by every task."""
    plain = owners.where(F.col("_set") == "").join(F.broadcast(rows.where(F.col("_set") == "")), "_set")
    return plain.unionByName(owners.where(F.col("_set") != "").join(broadcast_if_small(rows.where(F.col("_set") != "")), "_set")).drop("_set")


def relevance_batch(questions: DataFrame, df: DataFrame, k: int = MAX_CONTEXT_ROWS) -> DataFrame:
    """(question_id, rank, _ord, score): for every question what ``relevance_topk`` gives for it.

    The records are scanned twice: once for the words asked for, once, narrowly, for the ``k`` first
    by severity, which stand behind the records with a hit. Scores are added up in
    the tasks that hold the words of the records; a task keeps ``k`` rows of a set of words and passes over
    records that cannot get on its list, so no table of question-record pairs is made.
    Sets are taken in blocks, however many there are; questions get the rows of theirs at the end.

    A null question has no words, as has a null text or place. Repeated question ids count as one question.
    A null id has no words either and takes none from others.
    """
    owners, rows = _best(questions, df, k)
    return _given(owners, cut_lineage(rows)).select("question_id", "rank", ORD, "score")


def context_batch(questions: DataFrame, df: DataFrame, k: int = MAX_CONTEXT_ROWS) -> DataFrame:
    """(question_id, rank, _ord, score, line): the record lines of each question's context.

    A record that many questions show is fetched once, and joined to sets of words, not to questions.
    """
    owners, rows = _best(questions, df, k)
    rows = cut_lineage(rows)
    wanted = broadcast_if_small(rows.select(ORD).distinct())
    lines = df.join(wanted, ORD, "left_semi").select(ORD, record_line(df).alias("line"))
    return _given(owners, cut_lineage(rows.join(lines, ORD))).select("question_id", "rank", ORD, "score", "line")
