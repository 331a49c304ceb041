"""Answering a table of questions from a feedback table.

Substring conditions are turned into equality joins on character runs: "the text contains this
term" becomes "one of the text's runs equals the term's first letters". Answers are built from
aggregates per place, category and word, never from question-record pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.functions.ordering import top_rows
from murmur.functions.text import grams, prefixes, query_words, search_form, strip_spaces
from murmur.operators.joins import broadcast_if_small, is_small
from murmur.operators.ranking import bullet_line, more_line
from murmur.operators.summaries import most_frequent
from murmur.schema import ANALYSIS_COLUMNS, COMPLAINT_SENTIMENTS, ORD, complaints, is_analyzed, severity_weight
from murmur.session import cut_lineage, small_arrow_batches

# Routing words, words that do not name a place, actions that are none, and texts.
GREETINGS = ["hi", "hello", "hey", "help"]
GREETING_PHRASES = ["what can you", "how do you work"]
PLACE_WORDS = ["location", "where", "which place", "which area"]
PLACE_RANK_WORDS = ["most", "top", "worst", "highest", "complaint"]
HIGH_WORDS = ["high severity", "severe", "urgent", "serious", "critical", "high priority", "high"]
ACTION_WORDS = ["improve", "suggest", "action", "solution", "recommend", "fix"]
NEGATIVE_WORDS = ["negative", "complain", "summarize", "summary"]
POSITIVE_WORDS = ["positive", "praise", "compliment", "good"]
CATEGORY_WORDS = [
    "common", "most", "top", "main", "biggest", "major", "frequent", "category", "categories",
]
COUNT_WORDS = ["how many", "total", "number of", "count"]
GENERIC_PLACE_WORDS = ["area", "areas", "campus"]
NON_ACTIONS = ["no action needed", "review manually.", ""]

GREETING_TEXT = (
    "Hi! I answer questions using the campus feedback datasets. Try: "
    "*What is the most common problem?*, *Which location has the most complaints?*, "
    "*What are the major problems in the library?*, *What problems have high severity?*, "
    "or *What improvements are commonly suggested?*"
)
NOT_ENOUGH_TEXT = "The dataset does not contain enough information to answer that."
NO_HIGH_TEXT = "No feedback is marked High severity in the current data."
NO_ACTIONS_YET_TEXT = (
    "Run **Analyze Feedback** first - suggested actions are generated by the AI analysis."
)
NO_LABELS_YET_TEXT = "Run **Analyze Feedback** first so I can tell negative feedback apart."
NO_NEGATIVE_TEXT = "There is no negative feedback in the current data."
NO_POSITIVE_TEXT = "There is no positive feedback in the current data."

QUESTION_SCHEMA = "question_id long, question string"
TERM_LETTERS = 5  # a term is looked up by this many first letters at most
PREFIX_MIN = 4  # search words have at least this many
LISTED = 6  # rows of the longest list
FEW_KEYS = 200  # names that are sought one by one
FEW_BYTES = 1 << 16
FEW_ROWS = 1000  # that are fetched by their numbers

TEXT_GROUPS = 64  # of which each meets all questions
TEXTS_AT_ONCE = 4096  # bits of a word in a block
SETS_AT_ONCE = 8192  # with a block's bits 4 MB
SETS_IN_MEMORY = 500_000  # some 200 MB of a task, with twenty words each
KINDS_AT_ONCE = 131_072  # texts, or rows of kinds, that a task sorts at a time
SHOWN = 5
NO_ORD = -(1 << 63)
_FIRST = pa.list_(pa.struct([("lack", pa.int64()), ("ord", pa.int64())]))
_TEXT_SCHEMA = f"{ORD} long, _weight long, _times long, _codes array<long>"


def _folded(question: Column) -> Column:
    return strip_spaces(F.lower(question))


def _has(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _weight(df: DataFrame) -> Column:
    return severity_weight() if "severity" in df.columns else F.lit(1).cast("long")


def label_counts(df: DataFrame) -> DataFrame:
    """Number ``_n`` and first row ``_first`` of each combination of place and labels.

    All counts that answers need are sums over this table, so one scan serves them together. The
    functions below that count records take it as well as the records themselves. The first rows
    of a combination, as many as a list may show, lie up to ``_bound``, or anywhere if it is null:
    of the first rows of some dealt groups as many do.
    """
    group = F.pmod(F.xxhash64(ORD), F.lit(2 * LISTED))
    firsts = F.array(*[F.min(F.when(group == i, F.col(ORD))) for i in range(2 * LISTED)])
    return df.groupBy(*_label_names(df)).agg(
        F.count(F.lit(1)).alias("_n"), F.min(ORD).alias("_first"),
        F.get(F.array_sort(F.array_compact(firsts)), F.lit(LISTED - 1)).alias("_bound"),
    )


def _label_names(df: DataFrame) -> list[str]:
    return ["location", *(ANALYSIS_COLUMNS if is_analyzed(df) else [])]


def _count(df: DataFrame) -> Column:
    return F.coalesce(F.sum("_n"), F.lit(0).cast("long")) if "_n" in df.columns else F.count(F.lit(1))


# --- places and categories named in a question -------------------------------------------------

def _naming(questions: DataFrame, text: Column, keys: DataFrame, name: str) -> DataFrame:
    """(question_id, name) of the keys, a few, whose ``_run`` is in the text; they are sought one by one."""
    rows = keys.collect()
    if not rows:
        return questions.select("question_id", F.lit("").alias(name)).limit(0)
    few = F.array(*[F.struct(F.lit(r[name]).alias(name), F.lit(r["_run"]).alias("_run")) for r in rows])
    # The text is named outside the lambda as well, or it would be made anew for each key.
    met = F.when(F.col("_text").isNotNull(), F.filter(few, lambda k: F.contains(F.col("_text"), k["_run"])))
    found = questions.select("question_id", text.alias("_text")).select("question_id", F.explode(met).alias("_key"))
    return found.select("question_id", F.col(f"_key.{name}").alias(name)).distinct()


def mentioned_locations(questions: DataFrame, df: DataFrame) -> DataFrame:
    """(question_id, location) for each place a question names.

    A place is named by any of its words of three or more letters, or by the first five letters
    of a word of six or more. Both come to: the word's first five letters occur in the question.
    Of more than a few words that is an equality join on runs of three to five characters.
    """
    places = df.where(F.col("location").isNotNull()).select("location").distinct()
    words = places.select("location", F.explode(F.split(search_form(F.col("location")), " ")).alias("_word"))
    named = words.where((F.length("_word") >= 3) & ~F.col("_word").isin(GENERIC_PLACE_WORDS))
    keys = cut_lineage(named.select("location", F.substring("_word", 1, TERM_LETTERS).alias("_run")).distinct())
    if is_small(keys, FEW_KEYS, FEW_BYTES):
        return _naming(questions, search_form(F.col("question")), keys, "location")
    asked = questions.select(
        "question_id",
        F.explode(F.array_distinct(grams(search_form(F.col("question")), [(3, 3), (4, 4), (5, 5)]))).alias("_run"),
    )
    return asked.join(broadcast_if_small(keys), "_run").select("question_id", "location").distinct()


def mentioned_categories(questions: DataFrame, df: DataFrame) -> DataFrame:
    """(question_id, category) for each category whose lower-cased name is in the question.

    More than a few names meet the questions by their first letters, five at most; whole names are
    compared for the pairs left. The text is not carried along with its runs.
    """
    names = df.where(F.col("category").isNotNull()).select("category").distinct()
    names = names.withColumn("_name", F.lower("category"))
    keys = cut_lineage(names.withColumn("_run", F.substring("_name", 1, TERM_LETTERS)))
    folded = _folded(F.col("question"))
    if is_small(keys, FEW_KEYS, FEW_BYTES):
        return _naming(questions, folded, keys.select("category", F.col("_name").alias("_run")), "category")
    runs = F.array_distinct(F.concat(grams(folded, [(n, n) for n in range(1, 6)], "."), F.array(F.lit(""))))
    asked = questions.select("question_id", F.explode(runs).alias("_run"))
    met = asked.join(broadcast_if_small(keys), "_run").select("question_id", "category", "_name")
    texts = questions.select("question_id", folded.alias("_q"))
    named = texts.join(met, "question_id").where(F.contains("_q", F.col("_name")))
    return named.select("question_id", "category").distinct()


# --- keyword search ----------------------------------------------------------------------------

@dataclass(frozen=True)
class Search:
    """Questions and texts reduced to the words they share; all three are small tables on disk."""

    sets: DataFrame   # (question_id, _set): questions that share the same words with the texts share a set
    words: DataFrame  # (_set, _codes): the words of a set that any text has, sorted
    texts: DataFrame  # (_ord, _weight, _times, _codes): the first texts of each kind, see kinds()


def _code(prefix: str) -> Column:
    return F.conv(F.concat(F.lit("1"), F.col(prefix)), 36, 10).cast("long").alias("_code")


def question_prefixes(questions: DataFrame) -> DataFrame:
    """(question_id, prefix): the first five letters of the words that count, once each."""
    words = F.array_distinct(prefixes(query_words(F.col("question"))))
    return questions.select("question_id", F.explode(words).alias("prefix"))


def search(questions: DataFrame, df: DataFrame, shown: int = SHOWN) -> Search:
    """Find the words of the questions in the texts.

    Each text is taken apart where it lies: at every position the run of up to five characters is
    looked up by its first four among the distinct prefixes. A prefix is at most five letters and
    digits, so it is also a whole number, its ``_code``. A text is in one task as a whole, so its
    words are gathered before the shuffle, which carries numbers only. Words that no text has hit
    nothing; without them many questions are the same.
    """
    spark = df.sparkSession
    asked = question_prefixes(questions).select("question_id", "prefix", _code("prefix"))
    by_question = cut_lineage(asked.groupBy("question_id").agg(F.sort_array(F.collect_set("_code")).alias("_words")))
    prefix = F.substring(F.lower(F.conv(F.col("_code").cast("string"), 10, 36)), 2, TERM_LETTERS)
    codes = by_question.select(F.explode("_words").alias("_code")).distinct()
    wanted = cut_lineage(codes.select("_code", prefix.alias("prefix")).withColumn("_stem", F.substring("prefix", 1, PREFIX_MIN)))
    # Runs lie within words, so a word that a text repeats is cut into them once.
    spoken = F.array_join(F.array_distinct(F.split(search_form(F.col("feedback")), " ")), " ")
    runs = F.array_distinct(grams(spoken, [(PREFIX_MIN, TERM_LETTERS)]))
    found = df.select(ORD, _weight(df).alias("_weight"), F.explode(runs).alias("_run"))
    keyed = found.withColumn("_stem", F.substring("_run", 1, PREFIX_MIN))
    met = keyed.join(broadcast_if_small(wanted), "_stem").where(F.startswith("_run", "prefix"))
    whole = met.groupBy(ORD, "_weight").agg(F.sort_array(F.collect_set("_code")).alias("_codes"))
    small_arrow_batches(df)
    texts = cut_lineage(whole.select(
        F.coalesce(ORD, F.lit(NO_ORD)).alias(ORD), F.col("_weight").cast("long").alias("_weight"),
        F.lit(1).cast("long").alias("_times"), "_codes").mapInArrow(_first_of_kinds(shown), _TEXT_SCHEMA))
    occurring = cut_lineage(texts.select(F.explode("_codes").alias("_code")).distinct())
    # Without an id a question has no set of its own.
    named = by_question.where(F.col("question_id").isNotNull())
    shared = named.select("question_id", F.explode("_words").alias("_code")).join(broadcast_if_small(occurring), "_code", "left_semi")
    own = cut_lineage(shared.groupBy("question_id").agg(F.sort_array(F.collect_list("_code")).alias("_codes")))
    words = cut_lineage(own.groupBy("_codes").agg(F.min("question_id").alias("_set")).select("_set", "_codes"))
    sets = own.join(words, "_codes").select("question_id", "_set")
    # All questions without an id count as one, which has the set of another of the very same words.
    nameless = by_question.where(F.col("question_id").isNull()).select("_words")  # a row at most
    twin = named.join(F.broadcast(nameless), "_words").agg(F.min("question_id").alias("question_id"))
    lent = sets.join(F.broadcast(twin), "question_id").select(F.lit(None).cast("long").alias("question_id"), "_set")
    return Search(cut_lineage(sets.unionByName(lent)), words, texts)


def kinds(rows: pa.Table, shown: int) -> pa.Table:
    """Texts of the same words and weight are a kind: the first ``shown`` of each, of which the first counts for all.

    No list shows others, so rows of kinds can take the place of the texts and be met with further ones.
    """
    if not rows.num_rows:
        return rows
    rows = rows.combine_chunks()
    ids, weights, times = (rows.column(i).to_numpy() for i in range(3))
    codes = rows.column(3).combine_chunks()
    ends = np.ascontiguousarray(codes.offsets.to_numpy(), np.int64) * 8
    whole = pa.Array.from_buffers(pa.large_binary(), rows.num_rows, [
        None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(codes.values.to_numpy(), np.int64))])
    same = whole.dictionary_encode().indices.to_numpy()
    order = np.lexsort((ids, weights, same))
    same, weights = same[order], weights[order]
    starts = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]) | (weights[1:] != weights[:-1])]))
    sizes = np.diff(starts, append=order.size)
    counts = np.zeros(order.size, np.int64)
    counts[starts] = np.add.reduceat(times[order], starts)
    kept = np.arange(order.size) - np.repeat(starts, sizes) < shown
    return rows.take(pa.array(order[kept])).set_column(2, rows.schema.field(2), pa.array(counts[kept]))


def _first_of_kinds(shown: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each task's kinds; a task whose texts are nearly all of different kinds hands them on as they come."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= KINDS_AT_ONCE:
                met = kinds(pa.Table.from_batches(held), shown)
                if met.num_rows > KINDS_AT_ONCE // 2:
                    yield from met.to_batches(max_chunksize=TEXTS_AT_ONCE)
                    held, size = [], 0
                else:
                    held, size = met.to_batches(), met.num_rows
        if held:
            yield from kinds(pa.Table.from_batches(held), shown).to_batches(max_chunksize=TEXTS_AT_ONCE)

    return work


class Unions:
    """How many texts each set of words hits, and the first of them, met block by block in their order.

    A word of a block of texts is a row of bits; those of a set are united and counted. Memory holds
    one block and the sets, never text-question pairs. Only sets with a word in the block are met, and for
    those with one alone the word is counted, not the set.
    """

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, shown: int):
        self.ids, self.sets = ids, np.repeat(np.arange(ids.size), sizes)
        self.codes, words = np.unique(codes, return_inverse=True)
        self.words = words.astype(np.int32)
        self.hits = np.zeros(ids.size, np.int64)
        self.have = np.zeros(ids.size, np.int64)
        self.best = np.zeros((ids.size, shown, 2), np.int64)

    def add(self, ords: np.ndarray, weights: np.ndarray, times: np.ndarray, owner: np.ndarray, codes: np.ndarray) -> None:
        """Texts of one block by number and weight, with how many each stands for; ``codes`` are the words of the texts ``owner``."""
        if not (self.codes.size and codes.size):
            return
        word = np.minimum(np.searchsorted(self.codes, codes), self.codes.size - 1)
        known = self.codes[word] == codes
        word, owner = word[known], owner[known]
        present = np.unique(word)
        line = np.full(self.codes.size, -1, np.int32)
        line[present] = np.arange(present.size)
        bits = np.zeros((present.size, TEXTS_AT_ONCE // 8), np.uint8)
        np.bitwise_or.at(bits.reshape(-1), line[word] * np.int64(bits.shape[1]) + (owner >> 3), np.right_shift(128, owner & 7).astype(np.uint8))
        bits = bits.view(np.uint64)
        planes = _planes(times)
        # The words that are in the block, set by set.
        lines = line[self.words]
        met = np.flatnonzero(lines >= 0)
        lines, sets = lines[met], self.sets[met]
        starts = np.flatnonzero(np.diff(sets, prepend=-1))
        sets, sizes = sets[starts], np.diff(starts, append=lines.size)
        alone = sizes == 1
        by_word = lines[starts[alone]]
        counts = _counted(bits, planes)
        self.hits[sets[alone]] += counts[by_word]
        self._first(sets[alone], by_word, bits, ords, weights)
        sets, starts, sizes = sets[~alone], starts[~alone], sizes[~alone]
        order = np.argsort(-sizes, kind="stable")  # so the sets that have an i-th word come first
        for begin in range(0, order.size, SETS_AT_ONCE):
            some = order[begin : begin + SETS_AT_ONCE]
            at, number = starts[some], sizes[some]
            united = bits[lines[at]]
            for i in range(1, int(number[0])):
                n = int(np.searchsorted(-number, -i))  # the sets of more than i words
                united[:n] |= bits[lines[at[:n] + i]]
            self.hits[sets[some]] += _counted(united, planes)
            self._first(sets[some], np.arange(some.size), united, ords, weights)

    def _first(self, sets: np.ndarray, rows: np.ndarray, bits: np.ndarray, ords: np.ndarray, weights: np.ndarray) -> None:
        """Append the first texts of this block, by their rows of bits, to the lists that are not full."""
        short = self.have[sets] < self.best.shape[1]
        sets, rows = sets[short], rows[short]
        for begin in range(0, sets.size, SETS_AT_ONCE):
            some = sets[begin : begin + SETS_AT_ONCE]
            open_ = np.unpackbits(bits[rows[begin : begin + SETS_AT_ONCE]].view(np.uint8), axis=1).view(bool)
            for _ in range(self.best.shape[1]):
                at = open_.argmax(axis=1)
                on = np.flatnonzero(open_[np.arange(at.size), at] & (self.have[some] < self.best.shape[1]))
                at, who = at[on], some[on]
                self.best[who, self.have[who]] = np.stack([-weights[at], ords[at]], axis=1)
                self.have[who] += 1
                open_[on, at] = False

    def rows(self) -> Iterator[pa.RecordBatch]:
        hit = np.flatnonzero(self.hits)
        for begin in range(0, hit.size, SETS_AT_ONCE):
            part = hit[begin : begin + SETS_AT_ONCE]
            have = self.have[part]
            best = self.best[part][np.arange(self.best.shape[1]) < have[:, None]]
            texts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(best[:, i])) for i in range(2)], fields=list(_FIRST.value_type))
            first = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(have)]).astype(np.int32), texts)
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[part]), pa.array(self.hits[part]), first], ["_set", "hits", "first"])


def _planes(times: np.ndarray) -> list[tuple[int, np.ndarray | None]]:
    """The texts that count, by the binary digits of their numbers; None stands for all, once each."""
    if (times == 1).all():
        return [(0, None)]
    full = np.zeros(TEXTS_AT_ONCE, np.int64)
    full[: times.size] = times
    digits = [(d, (full >> d & 1).astype(bool)) for d in range(int(times.max()).bit_length())]
    return [(d, np.packbits(plane).view(np.uint64)) for d, plane in digits if plane.any()]


def _counted(bits: np.ndarray, planes: list[tuple[int, np.ndarray | None]]) -> np.ndarray:
    counts = np.zeros(len(bits), np.int64)
    for digit, plane in planes:
        counts += np.bitwise_count(bits if plane is None else bits & plane).sum(axis=1, dtype=np.int64) << digit
    return counts


def _count_cells(shown: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A cell holds sets of words, then texts, most severe first; cells follow one another in a task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, unions = None, [], None
        for batch in batches:
            cells, which = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(which) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
                if cells[a] != cell:
                    if unions is not None:
                        yield from unions.rows()
                    cell, sets, unions = cells[a], [], None
                part = batch.slice(a, b - a)
                if which[a] == 0:
                    codes = part.column(5)
                    sets.append((part.column(2).to_numpy(), codes.value_lengths().to_numpy().astype(np.int64), codes.flatten().to_numpy()))
                    continue
                if unions is None:
                    columns = zip(*sets, strict=True) if sets else [[np.zeros(0, np.int64)]] * 3
                    unions = Unions(*map(np.concatenate, columns), shown)
                for start in range(0, part.num_rows, TEXTS_AT_ONCE):
                    texts = part.slice(start, TEXTS_AT_ONCE)
                    codes = texts.column(5)
                    owner = np.repeat(np.arange(texts.num_rows), codes.value_lengths().to_numpy())
                    unions.add(*(texts.column(i).to_numpy() for i in (2, 3, 4)), owner, codes.flatten().to_numpy())
        if unions is not None:
            yield from unions.rows()

    return work


def _hits_of_sets(found: Search, shown: int) -> DataFrame:
    """(_set, hits, _first) of each set of words that hits a text; ``_first`` are the ``shown`` most severe texts.

    Texts are dealt to a fixed number of groups, and each group meets all sets, in parts if there are very many
    or the groups are fewer than the cores: a cell of both is counted in one task, which reads the texts in their order. A group gives
    one row for a set, so what is shuffled grows with texts and questions, not with their product; the product
    is bits, united in memory.
    """
    cores = found.texts.sparkSession.sparkContext.defaultParallelism
    number = found.words.count()
    groups = max(1, min(cores, TEXT_GROUPS, -(-found.texts.count() // TEXTS_AT_ONCE)))
    parts = max(1, -(-number // SETS_IN_MEMORY), min(cores // groups, -(-number // SETS_AT_ONCE)))
    small_arrow_batches(found.texts)

    def dealt(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n))

    def cell(group: Column, part: Column) -> Column:
        return (group * parts + part).cast("int")

    every_group = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: cell(g, dealt("_set", parts)))
    every_part = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: cell(dealt(ORD, groups), p))
    nothing = F.lit(0).cast("long")
    sets = found.words.select(
        F.explode(every_group).alias("_cell"),
        F.lit(0).alias("_kind"), F.col("_set").alias("_id"), nothing.alias("_weight"), nothing.alias("_times"), "_codes")
    texts = found.texts.select(
        F.explode(every_part).alias("_cell"), F.lit(1).alias("_kind"), F.col(ORD).alias("_id"), "_weight", "_times", "_codes")
    cells = sets.unionByName(texts).repartitionById(groups * parts, "_cell")
    ordered = cells.sortWithinPartitions("_cell", "_kind", F.desc("_weight"), "_id")
    counted = ordered.mapInArrow(_count_cells(shown), "_set long, hits long, first array<struct<lack:long,ord:long>>")
    first = F.slice(F.sort_array(F.flatten(F.collect_list("first"))), 1, shown)
    return counted.groupBy("_set").agg(F.sum("hits").alias("hits"), first.alias("_first"))


def _listed(hits: DataFrame, owner: str) -> DataFrame:
    """(owner, hits, rank, _ord); a null ``_ord`` comes first."""
    listed = hits.select(owner, "hits", F.posexplode("_first").alias("_at", "_text"))
    number = F.col("_text.ord")
    return listed.select(owner, "hits", (F.col("_at") + 1).alias("rank"), F.when(number != NO_ORD, number).alias(ORD))


def keyword_hits(questions: DataFrame, df: DataFrame, shown: int = SHOWN) -> DataFrame:
    """Per question the number of texts with at least one hit and the first of them.

    Gives (question_id, hits, rank, _ord) for the ``shown`` most severe texts; a question without
    a hit has no row.
    """
    found = search(questions, df, shown)
    return _listed(found.sets.join(_hits_of_sets(found, shown), "_set"), "question_id")


# --- reports and lists -------------------------------------------------------------------------

def _first_rows(df: DataFrame, counts: DataFrame) -> DataFrame:
    """The first rows, ``LISTED`` at most, of every list an answer may show: (_list, _key, _weight, _ord).

    One narrow pass: complaints by place and all rows by category, the high-severity, negative
    and positive rows. The last are in source order, the others by severity. A list is made of whole
    combinations of place and labels, so of each of these the first rows are enough; ``counts`` is ``label_counts(df)``.
    """
    names = _label_names(df)
    bounds = counts.select(*[F.col(n).alias(f"_of_{n}") for n in names], "_bound")
    df = df.select(ORD, *names)
    if is_small(bounds):
        near = F.col(ORD).isNull() | F.col("_bound").isNull() | (F.col(ORD) <= F.col("_bound"))
        same = reduce(Column.__and__, [F.col(n).eqNullSafe(F.col(f"_of_{n}")) for n in names])
        df = df.join(F.broadcast(bounds), same & near, "left_semi")
    weight, place = _weight(df), F.col("location")

    def entry(name: str, key: Column, when: Column, rank: Column = weight) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("_list"), key.alias("_key"), rank.alias("_weight")))

    none = F.lit("")
    if is_analyzed(df):
        sentiment, category = F.col("sentiment"), F.col("category")
        lists = [
            entry("location", place, place.isNotNull() & sentiment.isin(COMPLAINT_SENTIMENTS)),
            entry("category", category, category.isNotNull()),
            entry("high_severity", none, F.col("severity") == "High"),
            entry("negative_digest", none, sentiment == "Negative"),
            entry("positive", none, sentiment == "Positive", F.lit(0).cast("long")),
        ]
    else:
        lists = [entry("location", place, place.isNotNull())]
    listed = df.select(ORD, F.inline(F.array_compact(F.array(*lists))))
    return top_rows(listed, ["_list", "_key"], [F.desc("_weight"), F.asc(ORD)], LISTED, "_rank").drop("_rank")


def _best(mentions: DataFrame, rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(question_id, rank, _ord): groups do not overlap, so their first rows hold those of the union."""
    named = rows.where(F.col("_list") == key).select(F.col("_key").alias(key), "_weight", ORD)
    met = mentions.join(named, key)
    return top_rows(met, ["question_id"], [F.desc("_weight"), F.asc(ORD)], limit, "rank").select(
        "question_id", "rank", ORD
    )


def _bullet_texts(df: DataFrame, best: DataFrame, owner: str) -> DataFrame:
    """The bullet lines of each owner's ranked rows as one text, from one scan of the records.

    ``best`` is read twice, so it has to be a stored table. Each record is fetched once, however
    many owners show it.
    """
    wanted = best.select(ORD).distinct()
    some = [r[0] for r in wanted.limit(FEW_ROWS + 1).collect()]
    if len(some) <= FEW_ROWS:  # numbers in the plan reach the scan, before columns are made
        lines = df.where(F.col(ORD).isin(some)).select(ORD, bullet_line(df).alias("_line"))
    else:
        lines = df.select(ORD, bullet_line(df).alias("_line")).join(broadcast_if_small(wanted), ORD)
    ranked = [F.max(F.when(F.col("rank") == i, F.col("_line"))) for i in range(1, LISTED + 1)]
    ids = [F.max(F.when(F.col("rank") == i, F.col(ORD))).cast("string") for i in range(1, LISTED + 1)]
    return best.join(lines, ORD).groupBy(owner).agg(
        F.concat_ws("\n", *ranked).alias("_bullets"), F.concat_ws(",", *ids).alias("row_ids")
    )


def _more(total: Column, limit: int) -> Column:
    return F.coalesce(F.concat(F.lit("\n"), more_line(total, limit)), F.lit(""))


def _totals(mentions: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """(question_id, names, reports, shown) of the groups each question names; counts add up."""
    shown = F.lit(True)
    if key == "location" and is_analyzed(counts):
        shown = F.col("sentiment").isin(COMPLAINT_SENTIMENTS)
    groups = counts.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.sum("_n").alias("reports"), F.sum(F.when(shown, F.col("_n")).otherwise(0)).alias("shown"),
        F.min("_first").alias("first"),
    )
    return mentions.join(groups, key).groupBy("question_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("first", key))), lambda s: s[key]), ", "
        ).alias("names"),
        F.sum("reports").alias("reports"), F.sum("shown").alias("shown"),
    )


def _report(questions: DataFrame, df: DataFrame, key: str, limit: int) -> DataFrame:
    counts = cut_lineage(label_counts(df))
    named = mentioned_locations if key == "location" else mentioned_categories
    mentions = cut_lineage(named(questions, counts))
    best = cut_lineage(_best(mentions, _first_rows(df, counts), key, limit))
    listed = _bullet_texts(df, best, "question_id")
    return _totals(mentions, counts, key).join(listed, "question_id", "left").select(
        "question_id", "names", "reports", "shown",
        F.coalesce("row_ids", F.lit("")).alias("row_ids"),
        F.concat(F.coalesce("_bullets", F.lit("")), _more(F.col("shown"), limit)).alias("bullets"),
    )


def location_report(questions: DataFrame, df: DataFrame, limit: int = 5) -> DataFrame:
    """For questions that name places: their reports, how many complain, and the worst of these."""
    return _report(questions, df, "location", limit)


def category_report(questions: DataFrame, df: DataFrame, limit: int = 5) -> DataFrame:
    """For questions that name categories: all their reports and the worst of these."""
    return _report(questions, df, "category", limit)


def top_counts(df: DataFrame, column: str, k: int, but: list[str] | None = None) -> DataFrame:
    """The ``k`` most frequent values as (rank, value, n), without those that are in lower case one of ``but``."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(
        _count(df).alias("n")
    )
    if but is not None:
        # Spark would move the condition to the records, where a column that is made would be made twice.
        counted = counted.select(F.inline(F.array(F.struct("value", "n")))).where(~F.lower("value").isin(but))
    best = counted.orderBy(F.desc("n"), "value").limit(k)
    return best.withColumn("rank", F.expr("row_number() over (order by n desc, value)")).select(
        "rank", "value", "n"
    )


def top_locations(df: DataFrame, k: int = 3) -> DataFrame:
    return top_counts(complaints(df), "location", k)


def top_categories(df: DataFrame, k: int = 4) -> DataFrame:
    return top_counts(complaints(df), "category", k)


def top_actions(df: DataFrame, k: int = 5) -> DataFrame:
    return top_counts(df, "suggested_action", k, but=NON_ACTIONS)


def negative_digest(df: DataFrame, k: int = 3) -> DataFrame:
    """Number of negative rows, their top categories and top places as (part, rank, value, n)."""
    negative = df.where(F.col("sentiment") == "Negative")
    total = negative.agg(_count(df).alias("n")).select(
        F.lit("total").alias("part"), F.lit(1).alias("rank"), F.lit("").alias("value"), "n"
    )
    pairs = F.array(*[
        F.struct(F.lit(c).alias("part"), F.col(c).alias("value")) for c in ("category", "location")
    ])
    weights = ["_n"] if "_n" in df.columns else []
    best = most_frequent(negative.select(*weights, F.inline(pairs)), ["part"], "value", k, _count(df))
    return total.unionByName(best.select("part", "rank", "value", "n"))


def positive_list(df: DataFrame, limit: int = 5) -> DataFrame:
    return df.where(F.col("sentiment") == "Positive").orderBy(ORD).limit(limit)


def count_report(df: DataFrame) -> DataFrame:
    """Total and sentiment counts, or total and number of places before analysis."""
    if not is_analyzed(df):
        return df.agg(
            _count(df).alias("total"), F.count_distinct("location").alias("locations")
        ).select(F.inline(F.array(
            F.struct(F.lit("total").alias("value"), F.col("total").alias("n")),
            F.struct(F.lit("locations").alias("value"), F.col("locations").alias("n")),
        )))
    total = df.agg(_count(df).alias("n")).select(F.lit("total").alias("value"), "n")
    sentiments = df.where(F.col("sentiment").isNotNull()).groupBy(F.col("sentiment").alias("value"))
    return total.unionByName(sentiments.agg(_count(df).alias("n")))


# --- routing and answers -----------------------------------------------------------------------

def _flag(questions: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    marked = ids.select("question_id").distinct().withColumn(name, F.lit(True))
    return questions.join(marked, "question_id", "left").withColumn(
        name, F.coalesce(name, F.lit(False))
    )


def _route(questions: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The first intent that fits each question, null where only its words can tell; and the mentions."""
    q = F.col("_q")
    yes = F.lit(is_analyzed(counts))
    places = cut_lineage(mentioned_locations(questions, counts))
    categories = cut_lineage(mentioned_categories(questions, counts)) if is_analyzed(counts) else None
    routed = _flag(questions, places, "_place")
    routed = routed.withColumn("_category", F.lit(False)) if categories is None else _flag(routed, categories, "_category")
    ranked = complaints(counts).agg(F.count("category")).scalar() > 0 if is_analyzed(counts) else F.lit(False)
    greeting = F.regexp_replace(q, r"[!?. ]+\z", "").isin(GREETINGS) | _has(q, GREETING_PHRASES)
    intent = (
        F.when(greeting, "greeting")
        .when(F.col("_place"), "location")
        .when(_has(q, PLACE_WORDS) & _has(q, PLACE_RANK_WORDS), "top_locations")
        .when(yes & _has(q, HIGH_WORDS), "high_severity")
        .when(_has(q, ACTION_WORDS), "top_actions")
        .when(_has(q, NEGATIVE_WORDS), "negative_digest")
        .when(yes & _has(q, POSITIVE_WORDS), "positive")
        .when(ranked & _has(q, CATEGORY_WORDS), "top_categories")
        .when(_has(q, COUNT_WORDS), "count")
        .when(F.col("_category"), "category")
    )
    routed = routed.withColumn("_q", _folded(F.col("question"))).withColumn("intent", intent)
    return cut_lineage(routed.drop("_q", "_place", "_category")), places, categories


def _route_words(routed: DataFrame, found: Search) -> DataFrame:
    """Settle the questions left by whether any of their words occurs in a text."""
    marked = _flag(routed, found.sets, "_hit")
    last = F.when(F.col("_hit"), "keyword").otherwise("none")
    return marked.withColumn("intent", F.coalesce("intent", last)).drop("_hit")


def route_questions(questions: DataFrame, df: DataFrame) -> DataFrame:
    """Add the first intent that fits each question as ``intent``.

    Words are matched as substrings, so "stop" contains "top". Texts are searched only for the
    questions that fit nothing else.
    """
    routed, _, _ = _route(questions, cut_lineage(label_counts(df)))
    return _route_words(routed, search(routed.where(F.col("intent").isNull()), df))


def _listing(first: int, last: int) -> Column:
    """``value (n), value (n)`` for the given ranks."""
    item = F.concat("value", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    return F.concat_ws(", ", *[F.max(F.when(F.col("rank") == i, item)) for i in range(first, last + 1)])


def _of_rank(name: str, rank: int = 1) -> Column:
    return F.max(F.when(F.col("rank") == rank, F.col(name)))


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def fixed_answers(df: DataFrame, counts: DataFrame) -> DataFrame:
    """(intent, head, more) for the intents whose answer depends on the data alone.

    The lines of a list, if the intent has one, belong between ``head`` and ``more``. ``counts`` is
    ``label_counts(df)``; the records themselves are read for the suggested actions only.
    """
    analyzed = is_analyzed(counts)
    total, nothing = F.col("total"), F.lit("")

    def row(intent: str, one: DataFrame, head: Column, more: Column = nothing) -> DataFrame:
        return one.select(F.lit(intent).alias("intent"), head.alias("head"), more.alias("more"))

    texts = [("greeting", GREETING_TEXT), ("none", NOT_ENOUGH_TEXT)]
    label = "negative/mixed reports" if analyzed else "reports"
    places = top_locations(counts, 3).agg(
        _of_rank("value").alias("top"), _of_rank("n").alias("n"), _listing(2, 3).alias("next")
    )
    answers = [row(
        "top_locations", places,
        F.coalesce(
            _text("**", F.col("top"), f"** has the most {label} (", F.col("n"), "). Next: ", F.col("next"), "."),
            F.lit(NOT_ENOUGH_TEXT),
        ),
    )]
    if analyzed:
        high = counts.where(F.col("severity") == "High").agg(_count(counts).alias("total"))
        answers.append(row("high_severity", high, F.when(total == 0, NO_HIGH_TEXT).otherwise(
            _text(total, " report(s) are High severity:\n")), _more(total, 6)))
        digest = negative_digest(counts, 3).agg(
            F.max(F.when(F.col("part") == "total", F.col("n"))).alias("total"),
            *[
                F.concat_ws(", ", *[
                    F.max(F.when(
                        (F.col("part") == c) & (F.col("rank") == i),
                        F.concat("value", F.lit(" ("), F.col("n").cast("string"), F.lit(")")),
                    )) for i in (1, 2, 3)
                ]).alias(c) for c in ("category", "location")
            ],
        )
        answers.append(row("negative_digest", digest, F.when(total == 0, NO_NEGATIVE_TEXT).otherwise(
            _text("There are ", total, " negative reports. Top categories: ", F.col("category"),
                  ". Top locations: ", F.col("location"), ".\n")), _more(total, 5)))
        positive = counts.where(F.col("sentiment") == "Positive").agg(_count(counts).alias("total"))
        answers.append(row("positive", positive, F.when(total == 0, NO_POSITIVE_TEXT).otherwise(
            _text("There are ", total, " positive reports:\n")), _more(total, 5)))
        ranked = top_categories(counts, 4).agg(
            _of_rank("value").alias("top"), _of_rank("n").alias("n"), _listing(2, 4).alias("next")
        )
        answers.append(row("top_categories", ranked, _text(
            "The most common problem category is **", F.col("top"), "** (", F.col("n"),
            " reports). Next: ", F.col("next"), ".")))
        counted = count_report(counts).agg(
            F.max(F.when(F.col("value") == "total", F.col("n"))).alias("total"),
            F.array_join(F.transform(
                F.array_sort(F.collect_list(F.when(
                    F.col("value") != "total", F.struct((-F.col("n")).alias("n"), "value")))),
                lambda s: F.concat(s["value"], F.lit(" "), (-s["n"]).cast("string"))), ", ").alias("list"),
        )
        answers.append(row("count", counted, _text(
            "There are ", total, " feedback records: ", F.col("list"), ".")))
    else:
        texts.append(("negative_digest", NO_LABELS_YET_TEXT))
        counted = counts.agg(_count(counts).alias("total"), F.count_distinct("location").alias("places"))
        answers.append(row("count", counted, _text(
            "There are ", total, " feedback records across ", F.col("places"), " locations.")))
    if analyzed and "suggested_action" in df.columns:
        listed = top_actions(df, 5).agg(F.concat_ws(
            "\n", *[F.concat(F.lit("- "), _of_rank("value", i)) for i in range(1, 6)]).alias("list"))
        answers.append(row("top_actions", listed, F.when(F.col("list") == "", NOT_ENOUGH_TEXT).otherwise(
            _text("Commonly suggested improvements:\n", F.col("list")))))
    else:
        texts.append(("top_actions", NO_ACTIONS_YET_TEXT))
    plain = df.sparkSession.createDataFrame([(*t, "") for t in texts], "intent string, head string, more string")
    return reduce(DataFrame.unionByName, answers, plain)


def answer_questions(questions: DataFrame, df: DataFrame, error: str | None = None) -> DataFrame:
    """(question_id, intent, answer, mode, error), one row per question.

    ``error`` is the reason why no model answered; answers always come from the data, so the
    mode is ``local``. The records are scanned five times, however many questions there are: for
    the counts, the words, the first rows of the lists, the actions, and the lines shown.
    """
    ending = [F.lit("local").alias("mode"), F.lit(error).cast("string").alias("error")]
    counts = cut_lineage(label_counts(df))
    if counts.isEmpty():
        return questions.select(
            "question_id", F.lit("none").alias("intent"), F.lit(NOT_ENOUGH_TEXT).alias("answer"), *ending
        )
    analyzed = is_analyzed(counts)
    first, places, categories = _route(questions, counts)
    found = search(first.where(F.col("intent").isNull()), df)
    routed = cut_lineage(_route_words(first, found))
    rows = cut_lineage(_first_rows(df, counts))

    def of(intent: str, mentions: DataFrame) -> DataFrame:
        return mentions.join(routed.where(F.col("intent") == intent), "question_id", "left_semi")

    name, reports, shown = F.col("names"), F.col("reports"), F.col("shown")
    extra = _text(" (", shown, " negative/mixed)") if analyzed else F.lit("")
    placed = of("location", places)
    own = _totals(placed, counts, "location").select("question_id", F.when(
        F.lit(analyzed) & (shown == 0),
        _text("**", name, "** has ", reports, " report(s) and none of them are negative or mixed."),
    ).otherwise(_text("**", name, "** has ", reports, " report(s)", extra, ":\n")).alias("own"), _more(shown, 5).alias("own_more"))
    hits = cut_lineage(_hits_of_sets(found, SHOWN))
    best = [_best(placed, rows, "location", 5)]
    fixed_lists = rows.where(F.col("_list").isin("high_severity", "negative_digest", "positive"))
    kept = top_rows(fixed_lists, ["_list"], [F.desc("_weight"), F.asc(ORD)], LISTED, "rank").where(
        (F.col("_list") == "high_severity") | (F.col("rank") <= 5)
    )
    if categories is not None:
        sorted_out = of("category", categories)
        own = own.unionByName(_totals(sorted_out, counts, "category").select(
            "question_id", _text(reports, " report(s) in **", name, "**:\n").alias("own"), _more(shown, 5).alias("own_more")
        ))
        best.append(_best(sorted_out, rows, "category", 5))
    owned = [b.select(F.col("question_id").cast("string").alias("owner"), "rank", ORD) for b in best]
    # Questions with the same words share their lines until the end.
    of_set = _text("words ", F.col("_set")).alias("owner")
    owned.append(_listed(hits, "_set").select(of_set, "rank", ORD))
    everything = reduce(DataFrame.unionByName, owned, kept.select(F.col("_list").alias("owner"), "rank", ORD))
    bullets = cut_lineage(_bullet_texts(df, cut_lineage(everything), "owner")).drop("row_ids")
    fixed = fixed_answers(df, counts).join(bullets.withColumnRenamed("owner", "intent"), "intent", "left").select(
        "intent", F.concat("head", F.coalesce("_bullets", F.lit("")), "more").alias("answer")
    )
    listed = own.join(
        bullets.select(F.col("owner").try_cast("long").alias("question_id"), "_bullets"), "question_id", "left"
    ).select("question_id", F.concat("own", F.coalesce("_bullets", F.lit("")), "own_more").alias("own"))
    by_words = hits.select("_set", "hits", of_set).join(bullets, "owner", "left").select("_set", _text(
        "Found ", F.col("hits"), " related report(s):\n", F.coalesce("_bullets", F.lit("")), _more(F.col("hits"), SHOWN)).alias("own"))
    listed = listed.unionByName(found.sets.join(by_words, "_set").select("question_id", "own"))
    return (
        routed.join(F.broadcast(fixed), "intent", "left")  # a dozen rows at most
        .join(listed, "question_id", "left")
        .select("question_id", "intent", F.coalesce("own", "answer").alias("answer"), *ending)
    )
