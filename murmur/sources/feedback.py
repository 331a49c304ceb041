"""Reading, checking, previewing and exporting feedback tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from murmur.functions.ordering import with_ordinal
from murmur.schema import ORD, REQUIRED_COLUMNS, ValidationError

# Cell contents a CSV reader takes as missing.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def load_feedback(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    multi_line: bool = False,
    null_tokens: list[str] = NULL_TOKENS,
    sequence: str | None = None,
) -> DataFrame:
    """Read a feedback table with the source's row order in ``_ord``.

    CSV columns are all strings named by the header, extra columns pass through. Large files are
    split. A file with line breaks inside quoted cells must be read whole by one task: pass
    ``multi_line=True`` for those.
    """
    try:
        if fmt == "csv":
            df = (
                spark.read.option("header", True).option("multiLine", multi_line)
                .option("quote", '"').option("escape", '"').csv(path)
            )
        else:
            df = spark.read.format(fmt).load(path)
    except AnalysisException as error:
        raise ValidationError(f"Could not read the {fmt.upper()} file: {error}") from error
    if not df.columns:
        raise ValidationError(f"The {fmt.upper()} file is empty.")
    if df.isEmpty():
        raise ValidationError("The dataset contains no rows.")
    df = with_ordinal(df, sequence)
    if fmt != "csv":
        return df
    cells = [c for c in df.columns if c != ORD]
    return df.select(
        *[F.when(~F.col(f"`{c}`").isin(null_tokens), F.col(f"`{c}`")).alias(c) for c in cells], ORD
    )


@dataclass
class Loaded:
    rows: DataFrame  # as ``load_feedback`` gives them
    rejected: DataFrame  # (path, record, cells): lines that do not have the header's number of cells
    n_rejected: int


def load_checked(
    spark: SparkSession, path: str, quarantine: str, null_tokens: list[str] = NULL_TOKENS, multi_line: bool = False
) -> Loaded:
    """Read a CSV table and set aside the lines that do not fit its header.

    A line with too few or too many cells, as bad quotes make them, would be padded or cut silently. Here
    such lines are written as they stand to the Parquet table ``quarantine`` (appended), with the file they are
    from, and counted. The other rows keep their order.
    """
    names = load_feedback(spark, path, multi_line=multi_line, null_tokens=null_tokens).drop(ORD).columns
    (bad,) = _unused(names, "_corrupt_record")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, bad]])
    read = (
        spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("quote", '"')
        .option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad)
        .option("columnPruning", False)  # a parser that skips unused cells does not count them
        .csv(path)
    )
    numbered = with_ordinal(read)
    target = f"{quarantine.rstrip('/')}/load={uuid.uuid4().hex}"
    faulty = read.where(F.col(f"`{bad}`").isNotNull())
    faulty.select(
        F.col("_metadata.file_path").alias("path"), F.col(f"`{bad}`").alias("record"), F.array(*[F.col(f"`{n}`") for n in names]).alias("cells"),
    ).write.parquet(target)
    rejected = spark.read.schema("path string, record string, cells array<string>").parquet(target)
    cells = [F.when(~F.col(f"`{c}`").isin(null_tokens), F.col(f"`{c}`")).alias(c) for c in names]
    # Spark refuses a query on the faults alone, such as a count; the second condition always holds.
    looked_at = F.coalesce(F.length(F.col(f"`{names[0]}`")) >= 0, F.lit(True))
    rows = numbered.where(F.col(f"`{bad}`").isNull() & looked_at).select(*cells, ORD)
    return Loaded(rows, rejected, rejected.count())


def _unused(taken: list[str], name: str) -> list[str]:
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return [name]


def validate_columns(df: DataFrame) -> DataFrame:
    """Reject a table without the required columns; looks at the schema only."""
    missing = [c for c in REQUIRED_COLUMNS if c not in df.columns]
    if missing:
        raise ValidationError(
            f"Missing required column(s): {', '.join(missing)}. "
            f"Expected columns: {', '.join(REQUIRED_COLUMNS)}."
        )
    return df


def safe_load_and_clean(
    spark: SparkSession, path: str, **options
) -> tuple[DataFrame | None, str | None]:
    """The clean table and no error, or no table and the message to show."""
    from murmur.operators.cleaning import clean_feedback, require_rows

    try:
        return require_rows(clean_feedback(load_feedback(spark, path, **options))), None
    except ValidationError as error:
        return None, str(error)
    except Exception as error:
        return None, f"Unexpected error while loading the dataset: {error}"


def preview(df: DataFrame, rows: int = 10) -> DataFrame:
    return df.orderBy(ORD).limit(rows)


def dataset_summary(df: DataFrame) -> DataFrame:
    """Record count, distinct locations and date span; 0 or null for a missing column."""
    absent = F.lit(None).cast("timestamp_ntz")
    has_location, has_date = "location" in df.columns, "date" in df.columns
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        (F.count_distinct("location") if has_location else F.max(F.lit(0).cast("long")))
        .alias("unique_locations"),
        (F.min("date") if has_date else F.min(absent)).alias("first_date"),
        (F.max("date") if has_date else F.max(absent)).alias("last_date"),
    ).withColumn("unique_locations", F.coalesce("unique_locations", F.lit(0).cast("long")))


def file_slug(name: str) -> str:
    """``Feedback (Full)`` gives ``feedback_full``."""
    return name.lower().replace(" ", "_").replace("(", "").replace(")", "")


def export_csv(df: DataFrame, folder: str, name: str, order: str = ORD) -> str:
    """Write a dataset as a folder of CSV parts, each with a header; returns its path.

    A table with its row order (``order``) is cut into ranges of it, sorted within: read by
    name, the parts give the rows in order, and no task holds more than its range.
    """
    if order in df.columns:
        df = df.repartitionByRange(order).sortWithinPartitions(order)
    target = f"{folder.rstrip('/')}/{file_slug(name)}"
    flat = [
        F.array_join(F.col(f"`{f.name}`"), ", ").alias(f.name)
        if f.dataType.typeName() == "array" else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(target)
    return target
