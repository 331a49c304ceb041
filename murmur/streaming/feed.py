"""The append and analysis steps on a stream of files, with the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from murmur.operators.enrich import analyze
from murmur.operators.lexicon import Lexicon
from murmur.schema import CLEAN_SCHEMA, ORD
from murmur.sources.append import last_number, new_rows


def read_feed(spark: SparkSession, folder: str, schema: T.StructType = CLEAN_SCHEMA) -> DataFrame:
    """Clean feedback arriving as Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def analyze_feed(feed: DataFrame, lexicon: Lexicon, target: str, checkpoint: str) -> StreamingQuery:
    """Append the analysed rows to a Parquet table, each file once.

    The rule analysis is a projection and keeps no state, so it runs on a stream as it is. One
    run takes all files present and stops; schedule it, or leave out the trigger to keep it on.
    """
    return (
        analyze(feed, lexicon).writeStream.format("parquet").outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


STORED = "feedback_id string, date timestamp_ntz, location string, feedback string"
BATCH = "batch"
BEFORE = -1  # the batch number of what was there before the stream


def appended(spark: SparkSession, target: str) -> DataFrame:
    """The rows of all committed batches, with their batch number.

    A batch counts once its mark is written; what a failed one left behind is not read.
    """
    marks = _marks(spark, target).select(BATCH).distinct()
    return _rows(spark, target).join(F.broadcast(marks), BATCH, "left_semi")  # one number for each batch


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(f"{schema}, {BATCH} long").parquet(path)
    except AnalysisException:  # nothing is written yet
        return spark.createDataFrame([], f"{schema}, {BATCH} long")


def _rows(spark: SparkSession, target: str) -> DataFrame:
    return _table(spark, f"{target.rstrip('/')}/rows", STORED)


def _marks(spark: SparkSession, target: str) -> DataFrame:
    return _table(spark, f"{target.rstrip('/')}/marks", "last long")


def _write(df: DataFrame, target: str, part: str, batch: int) -> None:
    """Each batch has a folder of its own, so writing it again replaces what a failed try left."""
    df.write.mode("overwrite").parquet(f"{target.rstrip('/')}/{part}/{BATCH}={batch}")


def start_append(existing: DataFrame, target: str) -> None:
    """Take over an existing table as what is there before the first batch."""
    _write(existing.select(*[c.split()[0] for c in STORED.split(", ")]), target, "rows", BEFORE)
    mark = existing.sparkSession.createDataFrame([(last_number(existing),)], "last long")
    _write(mark.coalesce(1), target, "marks", BEFORE)


def append_batch(incoming: DataFrame, batch: int, target: str) -> None:
    """Append what is new in one batch: first its rows, then the mark that commits it.

    Known texts and the largest id are those of earlier batches alone, so a batch that is repeated
    after a failure gives the same rows with the same ids, in the same folder. The mark holds the largest id, and
    stored ids are not read again.
    """
    spark = incoming.sparkSession
    earlier = F.col(BATCH) < batch
    last = _marks(spark, target).where(earlier).agg(F.max("last")).head()[0] or 0
    marked = appended(spark, target).where(earlier)
    ordered = incoming if ORD in incoming.columns else incoming.withColumn(ORD, F.monotonically_increasing_id())
    _write(new_rows(marked, ordered, last), target, "rows", batch)
    added = _rows(spark, target).where(F.col(BATCH) == batch)
    mark = added.agg((F.count(F.lit(1)) + F.lit(last)).alias("last"))
    _write(mark.coalesce(1), target, "marks", batch)


def append_feed(feed: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append the new texts of a stream to a table, each once, with ids that count on.

    Spark may run a batch again with the same number; ``append_batch`` makes that harmless.
    """
    return (
        feed.writeStream.foreachBatch(lambda df, batch: append_batch(df, batch, target))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
