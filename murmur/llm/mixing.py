"""Mixing sources to target weights by Poisson replication, with native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm.common import unused

BROADCAST_SOURCES = 100_000
BROADCAST_BYTES = 64 << 20
TABLE_RATE = 1000.0  # up to this rate a source's whole distribution is a table
CELLS = 512  # cells that the values around a larger rate are cut into
REACH = 12  # standard deviations on each side that those values cover
MOST_RATE = 1e13  # beyond it, whole numbers near a rate are no longer exact in the terms
BLOCK = 10_000  # copies of a document that are made at once
DIGITS = 13  # hex digits of a digest that make a uniform number: 52 bits, exact in a double


def uniform(*parts: Column) -> Column:
    """A number in (0, 1), hash-seeded by the parts; nulls count as empty text."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    digits = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(float(16**DIGITS))


def source_rates(docs: DataFrame, weights: dict[str, float] | None, total: float | None, source: str, size: Column) -> DataFrame:
    """``(source, size, rate)``: how often a document of the source is repeated on average.

    ``size`` is what the weights are shares of. The rate is the source's share of the weights
    times the wanted ``total`` (default: the size of all documents), divided by its size. A
    source without a weight gets none; without weights all sources count alike.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        weight = F.lit(1.0)
    elif weights:
        named = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))])
        weight = F.coalesce(F.element_at(named, F.col("source")), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    weighed = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    every, everything = weighed.agg(F.sum("weight"), F.sum("size")).head()
    wanted = float(everything or 0) if total is None else float(total)
    share = F.col("weight") / F.lit(every) if every else F.lit(0.0)
    rate = F.when(F.col("size") > 0, share * F.lit(wanted) / F.col("size")).otherwise(0.0)
    return weighed.select("source", "size", rate.alias("rate"))


def distribution(rate: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2, ... as an array, for rates to TABLE_RATE.

    It ends where what is missing to 1 no longer shows in a uniform number of 52 bits. The
    terms are taken from logarithms, so that a large mean does not start from zero.
    """
    end = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(
        (-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all")
    )

    def step(state, k):
        log = state["log"] + F.log(rate / k)
        total = state["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(state["all"], F.array(total)).alias("all"))

    full = F.aggregate(F.sequence(F.lit(1), end), zero, step, lambda state: state["all"])
    return F.when(rate > 0, full).otherwise(F.array(F.lit(1.0)))


def probability(k: Column, rate: Column) -> Column:
    """The Poisson probability of ``k`` near a rate above TABLE_RATE, by its saddle point.

    The logarithm of k! is Stirling's with two further terms, and what is left,
    k log(k / rate) + rate - k, is a series in (k - rate) / (k + rate): no large numbers cancel.
    """
    k = k.cast("double")

    def deviance(v: Column) -> Column:
        square, series = v * v, F.lit(0.0)
        for odd in (15, 13, 11, 9, 7, 5, 3):
            series = 1 / F.lit(float(odd)) + square * series
        return (k - rate) * v + 2 * k * v * square * series

    # The array of one gives v a name, so it is computed once.
    apart = F.transform(F.array((k - rate) / (k + rate)), deviance)[0]
    stirling = 1 / (12 * k) - 1 / (360 * k * k * k)  # the next term is below 1e-18
    return F.exp(-stirling - apart) / F.sqrt(2 * math.pi * k)


def cells(rates: DataFrame) -> DataFrame:
    """``(source, rate, first, width, cells)`` for sources with a rate above TABLE_RATE.

    ``cells`` is the distribution function at the ends of CELLS cells of ``width`` values each, from
    ``first`` on, up to a factor that makes the last one 1. Each cell is a row until its terms are added up.
    """
    spread = F.ceil(F.sqrt("rate"))
    wide = rates.select(
        "source", "rate", (F.floor("rate") - REACH * spread).alias("first"),
        F.ceil(2 * REACH * spread / F.lit(float(CELLS))).cast("long").alias("width"),
    )
    each = wide.select("*", F.explode(F.sequence(F.lit(0), F.lit(CELLS - 1))).alias("cell"))
    each = each.repartition("source", "cell")
    start = F.col("first") + F.col("cell") * F.col("width")
    mass = F.aggregate(
        F.sequence(start, start + F.col("width") - 1), F.lit(0.0), lambda total, k: total + probability(k, F.col("rate")))
    sums = each.withColumn("mass", mass).groupBy("source", "rate", "first", "width").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("cell", "mass"))), lambda c: c["mass"]).alias("mass"))

    def add(state, m):
        total = F.coalesce(F.try_element_at(state, F.lit(-1)), F.lit(0.0)) + m
        return F.concat(state, F.array(total))

    added = sums.withColumn("added", F.aggregate("mass", F.array().cast("array<double>"), add))
    end = F.element_at("added", -1)
    return added.select("source", "rate", "first", "width", F.transform("added", lambda c: c / end).alias("cells"), end.alias("mass"))


def count_below(drawn: Column, cdf: Column, rate: Column, first: Column, width: Column, table: Column, mass: Column) -> Column:
    """How many values have a distribution function below the uniform number ``drawn``.

    From a table, the values are counted. Around a large rate the cells are counted first, then the
    values within the next cell, whose terms are added to what lies before it.
    """
    cell = F.least(F.size(F.filter(table, lambda c: c < drawn)), F.lit(CELLS - 1))
    start = first + cell * width
    before = F.when(cell > 0, F.element_at(table, F.greatest(cell, F.lit(1)))).otherwise(0.0)

    def step(state, k):
        total = state["sum"] + probability(k, rate) / mass
        return F.struct(total.alias("sum"), (state["n"] + (total < drawn).cast("long")).alias("n"))

    zero = F.struct(before.alias("sum"), start.alias("n"))
    large = F.aggregate(F.sequence(start, start + width - 1), zero, step, lambda state: state["n"])
    small = F.size(F.filter(cdf, lambda c: c < drawn)).cast("long")
    return F.when(first.isNull(), small).otherwise(large)


def repeated(rows: DataFrame, count: str, copy: str, large: bool) -> DataFrame:
    """Every row ``count`` times, numbered from 0 in the column ``copy``.

    With ``large`` counts a row is first repeated once for each block of copies, in two
    steps, and the blocks are dealt to tasks; no step makes more than BLOCK rows of one.
    """
    def numbers(first: Column, end: Column) -> Column:
        return F.explode(F.sequence(first, end - 1))

    n = F.col(count)
    names = [F.col(f"`{c}`") for c in rows.columns if c != count]
    few = rows.where(n <= BLOCK) if large else rows
    made = few.where(n > 0).select(*names, numbers(F.lit(0).cast("long"), n).alias(copy))
    if not large:
        return made
    outer, block = BLOCK * BLOCK, F.col(copy)
    many = rows.where(n > BLOCK).select(*names, n, numbers(F.lit(0).cast("long"), F.ceil(n / outer).cast("long")).alias(copy))
    many = many.repartition(*names_to_deal(rows, count), copy)
    end = F.least(F.ceil(n / BLOCK).cast("long"), (block + 1) * BLOCK)
    many = many.select(*names, n, numbers(block * BLOCK, end).alias(copy)).repartition(*names_to_deal(rows, count), copy)
    end = F.least(n, (block + 1) * BLOCK)
    return made.unionByName(many.select(*names, numbers(block * BLOCK, end).alias(copy)))


def names_to_deal(rows: DataFrame, count: str) -> list[Column]:
    """What blocks of copies are dealt by: one hash of the row's plain columns, so equal rows are spread too."""
    plain = [F.col(f"`{c}`") for c, t in rows.dtypes if c != count and not t.startswith(("array", "map", "struct", "variant"))]
    return [F.xxhash64(*plain)] if plain else []


def counted(
    docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 42,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> tuple[DataFrame, str, str, bool]:
    """The documents with their rate and Poisson count, the names of these two columns, and
    whether counts may exceed a block of copies."""
    size = F.coalesce(F.length(F.col(text)), F.lit(0)).cast("long")
    rates = source_rates(docs, weights, total, source, size)
    entries = F.when(F.col("rate") <= TABLE_RATE, F.col("rate") + 12 * F.sqrt("rate") + 30).otherwise(CELLS)
    n, n_bytes, most = rates.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 8 * entries), F.lit(0.0)),
        F.coalesce(F.max("rate"), F.lit(0.0)),
    ).head()
    if not most <= MOST_RATE:
        raise ValueError(f"a document would be repeated {most:.3g} times; at most {MOST_RATE:.0e} are counted exactly")
    own = docs.drop("copy", "rate", "shuffle_key")
    names = unused(own, "_source", "_rate", "_cdf", "_u", "_count", "_first", "_width", "_cells", "_mass")
    source_, rate, cdf, drawn, repeats, first, width, cells_, mass = names
    few = rates.where(F.col("rate") <= TABLE_RATE) if most > TABLE_RATE else rates
    table = few.select(
        F.col("source").alias(source_), F.col("rate").alias(rate), distribution(F.col("rate")).alias(cdf),
        F.lit(None).cast("long").alias(first), F.lit(None).cast("long").alias(width),
        F.lit(None).cast("array<double>").alias(cells_), F.lit(None).cast("double").alias(mass),
    )
    if most > TABLE_RATE:
        table = table.unionByName(cells(rates.where(F.col("rate") > TABLE_RATE)).select(
            F.col("source").alias(source_), F.col("rate").alias(rate), F.lit(None).cast("array<double>").alias(cdf),
            F.col("first").alias(first), F.col("width").alias(width), F.col("cells").alias(cells_), F.col("mass").alias(mass)))
    if n <= BROADCAST_SOURCES and n_bytes <= BROADCAST_BYTES:
        table = F.broadcast(table)
    u = uniform(F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), unnamed(F.col(text))))
    # Below the join the number is a column; beside the arrays it would be computed for each entry.
    joined = own.withColumn(drawn, u).join(table, F.col(source).eqNullSafe(F.col(source_)))
    n_copies = count_below(*[F.col(c) for c in (drawn, cdf, rate, first, width, cells_, mass)])
    rows = joined.select(*[F.col(f"`{c}`") for c in own.columns], rate, n_copies.alias(repeats))
    return rows, rate, repeats, most + REACH * math.sqrt(most) + 30 > BLOCK


def unnamed(text: Column) -> Column:
    """What stands for the id of a row without one."""
    return F.concat(F.lit("text|"), F.coalesce(F.sha2(text.cast("string"), 256), F.lit("")))


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 42,
    doc_id: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """Every document as often as its Poisson count says, in a globally shuffled order.

    The target weights are shares of characters. The count of a document inverts the Poisson
    distribution with its source's rate at a uniform number seeded by ``seed`` and the id, or the
    text's digest for a row without an id, so it does not depend on where and when a row is read.
    The result has all columns of ``docs`` and ``copy`` (from 0), ``rate``, ``shuffle_key``. Rows
    are dealt to partitions by the key and sorted by it within each: one global random order.

    A rate may be large, as that of a short source among long ones is. Up to 1,000 the whole
    distribution is a table; beyond, it is added up from the terms around the rate, exactly up
    to rounding; above 10**13 there is a ValueError. Copies of one document are made in
    blocks by many tasks.

    A null source is a source of its own; a null text has no characters. A source without
    characters or weight gets rate 0 and no rows. Repeated rows, which without an id
    means equal texts, get the same count each. Empty
    tables give empty results. Columns of ``docs`` named like one of the three new ones are
    replaced.
    """
    rows, rate, repeats, large = counted(docs, weights, total, seed, doc_id, source, text)
    copies = repeated(rows, repeats, "copy", large)
    own = [F.col(f"`{c}`") for c in copies.columns if c not in (rate, "copy")]
    copies = copies.select(*own, F.col(rate).alias("rate"), "copy")
    key = F.when(F.col(doc_id).isNull(), F.xxhash64(F.lit(seed), unnamed(F.col(text)), F.col("copy"))).otherwise(
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col("copy")))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return copies.withColumn("shuffle_key", key).repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")
