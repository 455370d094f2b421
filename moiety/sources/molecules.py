"""Readers of structure files: one row per record of .smi, .mol and .sdf files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_smiles(spark: SparkSession, path: str) -> DataFrame:
    """(id, molfile) of lines "SMILES title"; ids follow file order within a partition, gaps between."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("molfile"), F.regexp_extract("value", r"^\s*\S+\s+(.*)$", 1).alias("title"))


def read_sdf(spark: SparkSession, path: str, line_end: str = "\n") -> DataFrame:
    """(id, molfile, data) of an SD file's records, split at $$$$ by the reader itself, so large files split too.

    A data item's value may have several lines and ends at an empty one; of items that repeat a key
    the first counts. ``line_end`` is the file's (``\\r\\n`` for files from Windows).
    """
    records = spark.read.option("lineSep", f"$$$${line_end}").text(path).select(F.regexp_replace("value", "\r\n", "\n").alias("value")).filter(F.trim(F.translate("value", "\n", "")) != "")
    block = F.regexp_extract("value", r"(?s)^(.*?M  END)", 1)
    item = F.lit(r"(?m)^>.*?<([^>\n]*)>.*\n((?:[^\n]+(?:\n|\z))*)")
    keys, values = (F.regexp_extract_all("value", item, k) for k in (1, 2))
    pairs = F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x: F.struct(x["k"].alias("k"), F.regexp_replace(x["v"], r"\n\z", "").alias("v")))
    first = F.filter(pairs, lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    return records.select(F.monotonically_increasing_id().alias("id"), block.alias("molfile"), F.map_from_entries(first).alias("data"))


def read_molfiles(spark: SparkSession, path: str) -> DataFrame:
    """(id, molfile, path): one row per file."""
    return spark.read.text(path, wholetext=True).select(F.monotonically_increasing_id().alias("id"), F.col("value").alias("molfile"), F.col("_metadata.file_path").alias("path"))
