"""File sources: CSV, text, JSON, numeric matrices, and recursive discovery.

Each reads with a declared schema where the format allows one; inference is a second pass over the
data and may narrow types, so it is the fallback.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Schema = StructType | str

# The spelling of text formats, the same for reading and writing. Spark's defaults cut
# microseconds and trim blanks, so a file would not read back as it was written.
TIMESTAMP_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_csv(spark: SparkSession, path: str, schema: Schema | None = None, **options) -> DataFrame:
    """CSV with a header. With ``schema`` timestamps are read as the CSV sink spells them."""
    reader = spark.read.options(**CSV_OPTIONS)
    if schema is None:
        return reader.option("inferSchema", True).options(**options).csv(path)
    return reader.schema(schema).options(**{**TIMESTAMP_OPTIONS, **options}).csv(path)


def read_text(spark: SparkSession, path: str, whole: bool = False, **options) -> DataFrame:
    """One row per line, or with ``whole`` one row per file, which must then fit in memory."""
    return spark.read.options(**options).text(path, wholetext=whole)


def read_json(
    spark: SparkSession, path: str, schema: Schema | None = None, document: bool = False, **options
) -> DataFrame:
    """JSON lines, which split across tasks, or with ``document`` one JSON value per file."""
    reader = spark.read.option("multiLine", document)
    if schema is None:
        return reader.options(**options).json(path)
    return reader.schema(schema).options(**{**TIMESTAMP_OPTIONS, **options}).json(path)


def read_matrix(spark: SparkSession, path: str, columns: int | None = None, **options) -> DataFrame:
    """Rows of whitespace-separated numbers as ``array<double>``. Blank and ``#`` lines are skipped.

    A word that is not a number fails the job, and so does a row without exactly ``columns`` of them.
    """
    line = F.trim(F.regexp_replace("value", "#.*$", ""), F.lit(" \t\r"))
    lines = spark.read.options(**options).text(path).select(line.alias("line"))
    numbers = F.transform(F.split("line", r"\s+"), _number)
    if columns is not None:
        wrong = F.raise_error(F.lit(f"a matrix row does not have {columns} numbers")).cast("array<double>")
        numbers = F.when(F.size(numbers) == columns, numbers).otherwise(wrong)
    return lines.filter(F.col("line") != "").select(numbers.alias("values"))


def _number(word):
    value = word.try_cast("double")
    return F.when(value.isNotNull(), value).otherwise(
        F.raise_error(F.concat(F.lit("not a number: "), word)).cast("double")
    )


def discover_files(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """Files under ``root`` at any depth whose name matches: ``(relative_path, size_bytes, modified)``.

    The listing runs as a Spark job when there are many folders. File contents are not read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return files.select(
        relative_path(F.col("path"), root).alias("relative_path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )


def read_sources(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """Matching files with their text, one row per file: ``(relative_path, text)``."""
    files = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
    )
    return files.select(
        relative_path(F.col("_metadata.file_path"), root).alias("relative_path"), F.col("value").alias("text")
    )


def relative_path(path, root: str):
    """``path`` below ``root``; file URIs differ in their leading part, so ``root`` is searched for."""
    base = "/" + root.split("://", 1)[-1].removeprefix("file:").strip("/") + "/"
    return F.substring(path, F.locate(base, path) + F.lit(len(base)), F.length(path))
