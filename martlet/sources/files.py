"""Reading product files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.schema import RAW_PRODUCT

_CORRUPT = "_corrupt_record"


def load_products(source: str | DataFrame, spark: SparkSession | None = None,
                  schema: T.StructType = RAW_PRODUCT) -> DataFrame:
    """A product table from a JSON array file, a CSV file, Parquet, or a frame.

    ``.jsonl`` is one object per line, which Spark can split; a JSON array is read
    by one task per file.
    """
    if isinstance(source, DataFrame):
        return source
    ending = PurePosixPath(source).suffix.lower()
    if ending == ".json":
        return spark.read.schema(schema).option("multiLine", True).json(source)
    if ending == ".jsonl":
        return spark.read.schema(schema).json(source)
    if ending == ".csv":
        flat = T.StructType([f if isinstance(f.dataType, T.AtomicType) else T.StructField(f.name, T.StringType())
                             for f in schema.fields])
        # columns are matched by the names in the header
        found = spark.read.option("header", True).csv(source).columns
        wanted = T.StructType([f if (f := next((x for x in flat.fields if x.name == c), None)) is not None
                               else T.StructField(c, T.StringType()) for c in found])
        return spark.read.schema(wanted).option("header", True).option("enforceSchema", False).csv(source)
    if ending == ".parquet":
        return spark.read.parquet(source)
    raise ValueError(f"unsupported file format: {source}")


def load_directory(spark: SparkSession, path: str, glob: str = "*.json",
                   schema: T.StructType = RAW_PRODUCT, lines: bool = False) -> DataFrame:
    """All files of a directory with ``source_file``; unreadable ones are left out."""
    return _tagged(spark, path, glob, schema, lines).where(F.col(_CORRUPT).isNull()).drop(_CORRUPT)


def unreadable_files(spark: SparkSession, path: str, glob: str = "*.json",
                     schema: T.StructType = RAW_PRODUCT, lines: bool = False) -> DataFrame:
    """(source_file, records) that could not be parsed."""
    bad = _tagged(spark, path, glob, schema, lines).where(F.col(_CORRUPT).isNotNull())
    return bad.groupBy("source_file").agg(F.count(F.lit(1)).alias("records"))


def _tagged(spark, path, glob, schema, lines):
    checked = T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())])
    files = (spark.read.schema(checked).option("multiLine", not lines).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", _CORRUPT).option("pathGlobFilter", glob).json(path))
    # Spark refuses to read the corrupt-record column alone; this is always true
    first = F.col(schema.fields[0].name).cast("string")
    files = files.where(first.isNull() | (F.length(first) >= 0))
    return files.select("*", F.col("_metadata.file_name").alias("source_file"))
