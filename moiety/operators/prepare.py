"""Texts to index rows, in one Arrow step; what cannot be indexed keeps its message."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moiety.functions import fingerprints
from moiety.functions.matching import sizes
from moiety.functions.structures import stored
from moiety.operators.rows import COLUMNS, SCHEMA, from_graph


def index_row(compound: int | str, text: str) -> dict:
    """One row of the index, with ``message`` (a warning, or the error where atoms is None)."""
    empty = dict.fromkeys(COLUMNS) | {"compound": compound, "message": None}
    try:
        g, warning = stored(text)
        levels = fingerprints.circular(g)
        bits = sorted(fingerprints.substructure_bits(g))
        row = empty | from_graph(g) | dict(zip(("n_heavy", "n_hyd", "n_xbond", "n_hbond"), sizes(g)))
        row |= {"name": g.name, "sub_bits": bits, "sub_size": len(bits), "sim_levels": levels, "message": warning}
        return row | {f"sim_cum_{r}": n for r, n in enumerate(accumulate(map(len, levels)))}
    except (ValueError, LookupError, ArithmeticError, TypeError, RecursionError, AttributeError) as e:
        return empty | {"message": str(e) or type(e).__name__}


def distinct(table: DataFrame, id_column: str = "id", structure_column: str = "molfile") -> tuple[DataFrame, DataFrame]:
    """Each text once as (compound, structure), where compound is its digest, and the members (row, compound) of each."""
    text = F.col(structure_column).cast("string")
    rows = table.select(F.coalesce(F.sha2(text, 256), F.lit("")).alias("row"), F.col(id_column).cast("long").alias("compound"), text.alias("structure"))
    return rows.select(F.col("row").alias("compound"), "structure").distinct(), rows.select("row", "compound")


def each(found: DataFrame, members: DataFrame | None) -> DataFrame:
    """Rows found by the number of a row (as ``compound``), for every one of its ``members`` (row, compound)."""
    if members is None:
        return found
    return found.withColumnRenamed("compound", "row").join(members, "row").select(*found.columns)


def parse(texts: DataFrame) -> DataFrame:
    """Index rows plus ``message`` of (compound, structure): null for a clean row; with null atoms the row failed.

    Reading a structure takes milliseconds, so rows are first spread over all tasks, however few files they come from.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"{SCHEMA}, message string".replace("compound long", f"compound {texts.schema['compound'].dataType.simpleString()}")
    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # index rows are large
                own = batch.slice(at, 500)
                yield pa.RecordBatch.from_pylist([index_row(*x) for x in zip(own.column(0).to_pylist(), own.column(1).to_pylist())], schema=schema)

    spark = texts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return texts.select("compound", "structure").repartition(tasks, "compound").mapInArrow(step, ddl)


def prepare(table: DataFrame, id_column: str = "id", structure_column: str = "molfile") -> DataFrame:
    """``parse`` of every row of a table; each text is read once."""
    texts, members = distinct(table, id_column, structure_column)
    return each(parse(texts), members)


def split(prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index rows, errors and warnings)."""
    return prepared.filter(F.col("atoms").isNotNull()).drop("message"), prepared.filter(F.col("message").isNotNull()).select("compound", "message")


def postings(rows: DataFrame, id_column: str = "compound", with_column: str | None = None) -> DataFrame:
    """(field, bit, compound): one row per distinct bit of ``sub_bits``, and of ``sim_levels`` over all levels; and one more column."""
    c = [F.col(id_column).alias("compound"), *([F.col(with_column)] if with_column else [])]
    sub = rows.select(F.lit("sub").alias("field"), F.explode(F.array_distinct("sub_bits")).alias("bit"), *c)
    sim = rows.select(F.lit("sim").alias("field"), F.explode(level_union("sim_levels")).alias("bit"), *c)
    return sub.unionByName(sim)


def level_union(levels) -> F.Column:
    """Distinct bits over all levels."""
    return F.array_distinct(F.flatten(levels))


def posting_scan(posting: DataFrame, field: str, bits: list) -> DataFrame:
    """Posting rows of these bits; postings are clustered by (field, bit), so a scan prunes to them."""
    return posting.filter((F.col("field") == field) & F.col("bit").isin(list(bits)))


def holders_of_all(posting: DataFrame, field: str, bits: list) -> DataFrame:
    """(compound) of those in the postings of every bit."""
    found = posting_scan(posting, field, bits).groupBy("compound").agg(F.count("*").alias("n"))
    return found.filter(F.col("n") == len(set(bits))).select("compound")


def holders_of_any(posting: DataFrame, field: str, bits: list) -> DataFrame:
    """(compound) of those in the postings of some bit."""
    return posting_scan(posting, field, bits).select("compound").distinct()


def clustered(posting: DataFrame) -> DataFrame:
    """Postings as they are stored: ranges of (field, bit, compound), so that a bit that all have is split too."""
    return posting.repartitionByRange("field", "bit", "compound").sortWithinPartitions("field", "bit", "compound")


def cumulative_sizes(levels: DataFrame) -> DataFrame:
    """(id, lvl, size) of (id, lvl, n): members up to each level."""
    from pyspark.sql import Window

    return levels.select("id", "lvl", F.sum("n").over(Window.partitionBy("id").orderBy("lvl")).alias("size"))


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("field", "bit").agg(F.count("*").alias("df"))
