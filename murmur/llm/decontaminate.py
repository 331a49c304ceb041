"""Benchmark decontamination with native expressions: which words of a text occur in test items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import unused

# What separates words, once A-Z are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_WINDOWS = 1_000_000  # some 100 bytes each with ten short words: 100 MB in an executor
BROADCAST_BYTES = 64 << 20
BLOCK = 128  # words of a text whose windows are made together
MARK = -1  # window length of the row that stands for the document itself


def words(text: Column) -> Column:
    """The words of a text, none for null. Only A-Z are lower-cased, other letters stay."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    # lower() is the cheap way and means the same where every character is one byte.
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, SEPARATORS), "")


def item_windows(benchmark: DataFrame, size: int = 10, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows of the test items: ``(hash, length, words, items)``.

    An item shorter than a window is one window, an item without words none. ``items`` lists
    the ids, as text, of the items that hold the window.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return (
        items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
        .groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.xxhash64("words").alias("hash"), F.size("words").alias("length"), "words", "items")
    )


def hits(docs: DataFrame, windows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """One row per window occurrence in a document, and one that stands for the document.

    Columns: ``keys``, ``n_words``, ``position`` (from 0), ``length`` (-1 for the document
    itself) and ``items``. Documents are scanned once: windows are hashed, looked up in the
    broadcast windows and verified word by word, all within one stage. If the windows are too
    many or too long for a broadcast, Spark joins them by a shuffle instead.
    """
    n_windows, n_bytes, lengths = windows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.array_join("words", " "))), F.lit(0)), F.collect_set("length")
    ).head()
    small = n_windows <= BROADCAST_WINDOWS and n_bytes <= BROADCAST_BYTES
    widest = max(lengths, default=1)
    rows = docs.select(*keys, words(F.col(text)).alias("w"))
    # A window's words travel beside its hash, so a text is cut into blocks first: whole texts
    # beside each of their windows would be quadratic.
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(BLOCK))
    blocks = F.transform(starts, lambda i: F.struct(i.alias("offset"), F.slice("w", i + 1, BLOCK + widest - 1).alias("w")))
    rows = rows.select(*keys, F.size("w").cast("long").alias("n_words"), F.explode(blocks).alias("b"))
    rows = rows.select(*keys, "n_words", "b.offset", "b.w")
    none = F.array().cast("array<struct<position:int,length:int,hash:bigint>>")
    own = F.array(F.struct(F.lit(0).alias("position"), F.lit(MARK).alias("length"), F.lit(0).cast("long").alias("hash")))

    def scan(length: int) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.least(F.size("w") - length, F.lit(BLOCK - 1)), F.lit(0)))
        windows_ = F.transform(places, lambda i: F.struct(
            i.alias("position"), F.lit(length).alias("length"), F.xxhash64(F.slice("w", i + 1, length)).alias("hash")
        ))
        return F.when(F.size("w") >= length, windows_).otherwise(none)

    scans = [F.when(F.col("offset") == 0, own).otherwise(none) if small else none]
    scans += map(scan, sorted(lengths))  # at most as many as a window has words
    rows = rows.select(*keys, "n_words", "offset", "w", F.explode(F.concat(*scans)).alias("s"))
    found = F.slice("w", F.col("s.position") + 1, F.greatest("s.length", F.lit(0)))
    if not small:  # only the window goes through the shuffle
        rows = rows.withColumn("w", found)
    position = (F.col("offset") + F.col("s.position")).alias("position")
    rows = rows.select(*keys, "n_words", position, "s.length", "s.hash", "w", F.col("s.position").alias("place"))
    itself = docs.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("hash"), F.lit(MARK).alias("length"),
        F.array().cast("array<string>").alias("words"), F.array().cast("array<string>").alias("items"),
    )
    known = (itself.unionByName(windows) if small else windows).select("hash", "words", "items")
    found = F.slice("w", F.col("place") + 1, F.greatest("length", F.lit(0))) if small else F.col("w")
    # Written as two comparisons, the check is made for rows whose hash was found; an equality
    # would become part of the join key and be computed for every window of every text.
    same = (found >= F.col("words")) & (found <= F.col("words"))
    met = rows.join(F.broadcast(known) if small else known, "hash").where(same)
    met = met.select(*keys, "n_words", "position", "length", "items")
    if small:
        return met
    # One shuffled key for all documents would be hot: here they stand for themselves.
    own = docs.select(*keys, F.size(words(F.col(text))).cast("long").alias("n_words"))
    return met.unionByName(own.select(
        "*", F.lit(0).alias("position"), F.lit(MARK).alias("length"), F.array().cast("array<string>").alias("items")))


def covered(spans: Column) -> Column:
    """How many positions sorted ``(position, end)`` spans cover together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(state, span):
        start = F.greatest(state["end"], span["position"])
        return F.struct(
            F.greatest(state["end"], span["end"]).alias("end"),
            (state["n"] + F.greatest(span["end"] - start, F.lit(0))).alias("n"),
        )

    return F.aggregate(spans, zero, step, lambda state: state["n"])


def report(
    docs: DataFrame, benchmark: DataFrame, size: int = 10,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """``(doc_id, n_words, n_hit, spans, items)`` for every row of ``docs``.

    A word is hit if it lies in an occurrence of a window of ``size`` words of a test item.
    ``spans`` lists the occurrences as ``(position, end)`` in words, ``items`` the ids of the
    items concerned, as sorted text. Null and blank texts have no words and no hits; equal rows
    (same id and text) are reported as often as they occur; a null id is an id like any other.
    Empty tables give empty results, other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("_text"), F.col(text).alias("text"))
    found = hits(rows, item_windows(benchmark, size, item_id, text), ["doc_id", "_text"])
    mark = F.col("length") == MARK
    span = F.when(~mark, F.struct("position", (F.col("position") + F.col("length")).alias("end")))
    # Grouped by document: at most its own windows meet in a task.
    docs_ = found.groupBy("doc_id", "_text").agg(
        F.max("n_words").alias("n_words"), F.count_if(mark).alias("_copies"),
        F.sort_array(F.collect_set(span)).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    return docs_.select(
        "doc_id", "n_words", covered(F.col("spans")).alias("n_hit"), "spans", "items",
        F.explode(F.array_repeat(F.lit(0), F.col("_copies").cast("int"))).alias("_copy"),
    ).drop("_copy")


def remove_documents(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, min_hit: int = 1,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """The documents with fewer than ``min_hit`` hit words, with all their columns.

    Rows are told apart by id and text; rows without an id are judged like others.
    """
    own_id, own_text = unused(docs, "_id", "_text")
    found = (
        report_keys(docs, benchmark, size, doc_id, text, item_id).where(F.col("n_hit") >= min_hit)
        .select(F.col("_id").alias(own_id), F.col("_text").alias(own_text))
    )
    same = F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(text)) == F.col(own_text))
    return docs.join(found, same, "left_anti")


def report_keys(docs, benchmark, size, doc_id, text, item_id) -> DataFrame:
    """``(_id, _text, n_hit)`` of the documents that have hits at all."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text"), F.col(text).alias("text"))
    found = hits(rows, item_windows(benchmark, size, item_id, text), ["_id", "_text"])
    span = F.struct("position", (F.col("position") + F.col("length")).alias("end"))
    return (
        found.where(F.col("length") != MARK).groupBy("_id", "_text")
        .agg(covered(F.sort_array(F.collect_set(span))).alias("n_hit"))
    )


def remove_spans(
    docs: DataFrame, benchmark: DataFrame, size: int = 10,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """The documents with the hit words cut out of their texts; clean texts stay untouched.

    A changed text consists of its remaining words, lower-cased and joined with spaces.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(F.col(text)).alias("_text"), F.col(text).alias("text"))
    found = hits(rows, item_windows(benchmark, size, item_id, text), ["_id", "_text"])
    own_id, own_text, own_spans, own_hit = unused(docs, "_id", "_text", "_spans", "_hit")
    spans = (
        found.where(F.col("length") != MARK).groupBy("_id", "_text")
        .agg(F.collect_set(F.struct("position", (F.col("position") + F.col("length")).alias("end"))).alias("spans"))
        .select(F.col("_id").alias(own_id), F.col("_text").alias(own_text), F.col("spans").alias(own_spans))
    )
    hit = F.array_distinct(F.flatten(F.transform(
        F.col(own_spans), lambda s: F.sequence(s["position"], s["end"] - 1))))
    left = F.transform(
        F.filter(
            F.transform(words(F.col(text)), lambda w, i: F.struct(i.alias("i"), w.alias("w"))),
            lambda x: ~F.array_contains(F.col(own_hit), x["i"]),
        ),
        lambda x: x["w"],
    )
    same = F.col(doc_id).eqNullSafe(F.col(own_id)) & (F.xxhash64(F.col(text)) == F.col(own_text))
    joined = docs.join(spans, same, "left").withColumn(own_hit, hit)
    return joined.withColumn(
        text, F.when(F.col(own_hit).isNull(), F.col(text)).otherwise(F.array_join(left, " "))
    ).select(*[F.col(f"`{c}`") for c in docs.columns])
