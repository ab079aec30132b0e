"""Catalog files: six-column CSV with an exact header, or a superset for intake."""

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry import fixed_values as fv
from attestry.functions.text import collapse


class SourceError(ValueError):
    """A file does not have the shape its reader requires."""


def number_rows(df: DataFrame, name: str = "source_row_number") -> DataFrame:
    """1-based numbers in file order without sorting the rows of a file scan.

    Spark packs splits into tasks by size, so the order of tasks says nothing;
    a split is named by its file and first byte.  Rows are counted per split, and
    only those counts (one row per split) pass through a window.  Inside a task
    the rows of one split lie together, so the task's running number less the
    split's smallest one is a row's place in its split.
    """
    tagged = df.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__from"),
                       F.monotonically_increasing_id().alias("__id"))
    sizes = tagged.groupBy("__file", "__from").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__file", "__from").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__file", "__from", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = tagged.join(starts, ["__file", "__from"])
    return numbered.select(*df.columns, (F.col("__start") + F.col("__id") - F.col("__first") + 1).alias(name))


def _open_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False):
    """Files are split over tasks unless cells may hold line breaks (`multi_line`: one task per file)."""
    return (spark.read.option("header", True).option("multiLine", multi_line).option("quote", '"')
            .option("escape", '"').option("encoding", encoding)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def file_headers(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[tuple[list[str], str]]:
    """The distinct first lines of all files, each as cells and with one file that has it; one job, which also refuses bytes that
    are no UTF-8.  Text lines keep their bytes as they are, so each line is tested where it lies; a header is one line."""
    utf8 = encoding.upper().replace("-", "") == "UTF8"
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first"), F.monotonically_increasing_id().alias("at"))
    broken = F.max(F.expr("NOT is_valid_utf8(value)")) if utf8 else F.lit(False)
    head = F.min_by("value", F.when(F.col("first"), F.col("at")))       # null positions are left out
    files = lines.groupBy("file").agg(head.alias("head"), broken.alias("broken"))
    found = files.groupBy("head", "broken").agg(F.min("file").alias("file")).orderBy(F.desc("broken"), "file").limit(100).collect()
    for r in found:
        if r["broken"]:
            raise SourceError(f"not UTF-8: {r['file']}")
    return [(next(csv.reader([(r["head"] or "").lstrip("\ufeff").rstrip("\r")]), []), r["file"]) for r in found]


def one_header(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[str]:
    """The header that all files share; files that differ are refused, whatever their order."""
    headers = file_headers(spark, path, encoding)
    if not headers:
        raise SourceError(f"no file with a header at {path}")
    for cells, file in headers[1:]:
        if cells != headers[0][0]:
            raise SourceError(f"files differ in their headers: {file} has {cells}, {headers[0][1]} has {headers[0][0]}")
    return headers[0][0]


def read_catalog_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read the working file.  The header of every file must match exactly; a blank cell is ''."""
    header = one_header(spark, path)
    if tuple(header) != fv.CATALOG_COLUMNS:
        raise SourceError(f"catalog header must be {fv.CATALOG_COLUMNS}, found {tuple(header)}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in fv.CATALOG_COLUMNS])
    raw = (_open_csv(spark, path, multi_line=multi_line).schema(schema).option("enforceSchema", True)
           .option("mode", "FAILFAST").csv(path))
    numbered = number_rows(raw)
    return input_rows(numbered.na.fill("", list(fv.CATALOG_COLUMNS)))


def input_rows(raw: DataFrame, row_number: str = "source_row_number") -> DataFrame:
    """Map the file's columns to field names, keeping the row number."""
    return raw.select(F.col(row_number).cast("bigint").alias("source_row_number"),
                      *[F.col(c).alias(c.lower()) for c in fv.CATALOG_COLUMNS])


def not_blank(df: DataFrame, columns: list[str]):
    cond = F.lit(False)
    for c in columns:
        cond = cond | (F.length(collapse(F.coalesce(F.col(c), F.lit("")))) > 0)
    return cond


def row_count(df: DataFrame, columns: list[str], expected: int | None = None) -> DataFrame:
    """One row: non-blank rows, all rows, and whether the expected count is met."""
    return df.agg(F.count_if(not_blank(df, columns)).alias("data_rows"), F.count("*").alias("all_rows")
                  ).withColumn("as_expected", F.lit(True) if expected is None
                               else F.col("data_rows") == F.lit(expected))


def intake_rows(df: DataFrame, required: tuple[str, ...] = fv.CATALOG_COLUMNS) -> DataFrame:
    """Intake accepts extra columns, refuses missing ones, and drops blank rows."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise SourceError(f"missing required columns: {missing}")
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.where(not_blank(df, strings))


def read_batch_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Intake of a batch: the text must be UTF-8, all files have one header with the required columns, and at least one row is
    not blank."""
    header = one_header(spark, path)
    if len(set(header)) != len(header):
        raise SourceError(f"the header repeats {sorted({c for c in header if header.count(c) > 1})}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = intake_rows(_open_csv(spark, path, multi_line=multi_line).schema(schema).csv(path))
    if rows.isEmpty():
        raise SourceError("the file has no data rows")
    return rows


#: rows of a compressed file at most, as one task reads it whole
FILE_ROWS = 200_000


def write_csv(df: DataFrame, path: str, quote_all: bool = False, compression: str | None = None) -> None:
    out = df.write if compression is None else df.write.option("compression", compression).option("maxRecordsPerFile", FILE_ROWS)
    (out.mode("errorifexists").option("header", True).option("quoteAll", quote_all)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
