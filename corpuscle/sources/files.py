"""File sources. Order is explicit: lists get a position column, files their name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def whole_texts(spark: SparkSession, path: str, pattern: str = "*.txt", recursive: bool = False) -> DataFrame:
    """(file_name, text): one row a file, UTF-8."""
    reader = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("text"))


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """(file_name, path, size, modified) without reading contents."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return reader.load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON objects by line, with a declared schema; lines that don't parse come as _corrupt."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object or array a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Files of one object whose keys are data: (file_name, key, value)."""
    texts = whole_texts(spark, path, "*.json")
    return texts.select("file_name", F.explode(F.from_json("text", f"map<string,{value}>")))


def book_by_number(books: DataFrame, number: int) -> DataFrame:
    """The row whose 'NN-' or 'N-' file name has the number; the padded name first."""
    own = books.filter(F.regexp_extract("file_name", r"^(\d+)-", 1).try_cast("int") == number)
    return own.orderBy(F.length(F.regexp_extract("file_name", r"^(\d+)-", 1)).desc(), "file_name").limit(1)
