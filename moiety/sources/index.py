"""Versioned Parquet indexes of molecule tables, kept in step by an audit queue.

``<root>/<index>/segments/<name>/{molecules,members,postings,docfreq}`` are immutable, as are the lists
of ids in ``deletes/<name>``. ``molecules`` and ``postings`` hold each distinct text of a segment once,
under a number; ``members`` says which compounds have it, and deletes take these away. ``v=<N>/manifest.json`` says of which segments a version consists and
which lists apply to each, so a sync writes what is new and merges small segments only. The catalog
names the current version of each index; it is written as a new numbered file, and the highest
number counts, so readers keep the version they opened and a crash leaves the old catalog. Changes
wait in ``<root>/<index>/audit`` and are settled by ``sync_data``.
"""

from __future__ import annotations

import json
import re
import time
import uuid
import warnings
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moiety.operators import search
from moiety.operators.rows import SCHEMA
from moiety.operators.prepare import clustered, distinct, each, parse, postings, split

_NAME = re.compile(r"^[a-zA-Z0-9_]+$")
#: Rows of a file, some tens of MB: what one task of a search reads and verifies.
ROWS_PER_FILE = 5_000
#: Seconds after which a claim on a catalog number that led to no catalog is given up.
STALE = 60
ROWS, MEMBERS = f"{SCHEMA}, text_key string", "row long, compound long"
POSTINGS, DOCFREQ = "field string, bit int, compound long", "field string, bit int, df long"
AUDIT = "compound long, delete boolean"
ERRORS = "timestamp timestamp, version int, compound long, message string"


@dataclass
class Entry:
    """One row of the catalog."""

    id: int
    index_name: str
    schema_name: str
    table_name: str
    id_column: str = "id"
    structure_column: str = "molfile"
    threads: int = 4
    segments: int = 4
    buffered_docs: int = 1000
    buffer_size: float = 64.0
    version: int = 0


@dataclass
class Segment:
    """Part of a version: its compounds, how many of them are deleted, and the lists that say which."""

    name: str
    rows: int
    deletes: int = 0
    gone: list[str] = field(default_factory=list)


@dataclass
class View:
    """One version: rows and postings of distinct texts (``compound`` is a row's number here), and who has them."""

    rows: DataFrame
    members: DataFrame
    posting: DataFrame
    docfreq: DataFrame

    def each(self, found: DataFrame) -> DataFrame:
        return each(found, self.members)


class Conflict(RuntimeError):
    """Another writer changed the catalog meanwhile."""


class IndexStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._open: dict[str, tuple[int, DataFrame]] = {}

    # files, through Hadoop so that any shared file system works

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _move(self, a: str, b: str) -> None:
        fs, p = self._fs(a)
        if not fs.rename(p, self._fs(b)[1]):
            raise OSError(f"{a} cannot become {b}")

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _read_text(self, path: str) -> str:
        fs, p = self._fs(path)
        stream = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path: str, text: str) -> None:
        temp = f"{path}.{uuid.uuid4().hex}.tmp"
        fs, p = self._fs(temp)
        out = fs.create(p)
        out.write(bytearray(text.encode()))
        out.close()
        self._move(temp, path)

    # catalog

    def _numbers(self, kind: str) -> list[int]:
        return sorted(int(n.split(".")[0]) for n in self._names(f"{self.root}/catalog") if n.endswith(f".{kind}"))

    def _read_catalog(self) -> tuple[int, list[Entry]]:
        newest = max(self._numbers("json"), default=0)
        return newest, [Entry(**x) for x in json.loads(self._read_text(f"{self.root}/catalog/{newest:010d}.json"))] if newest else []

    def catalog(self) -> list[Entry]:
        return self._read_catalog()[1]

    def _write_catalog(self, entries: list[Entry], base: int) -> None:
        """The catalog after ``base``; Conflict if another one came, or is being written."""
        fs, folder = self._fs(f"{self.root}/catalog")
        fs.mkdirs(folder)
        number = max([base, *self._numbers("claim")]) + 1
        claim = self._fs(f"{self.root}/catalog/{number:010d}.claim")[1]
        fresh = [n for n in self._numbers("claim") if n > base and time.time() - fs.getFileStatus(self._fs(f"{self.root}/catalog/{n:010d}.claim")[1]).getModificationTime() / 1000 < STALE]
        if fresh or not fs.createNewFile(claim):
            raise Conflict("the catalog is being changed")
        if max(self._numbers("json"), default=0) != base:
            fs.delete(claim, False)
            raise Conflict("the catalog was changed")
        self._write_text(f"{self.root}/catalog/{number:010d}.json", json.dumps([asdict(x) for x in entries]))
        for kind in ("json", "claim"):
            for n in self._numbers(kind):
                if n < base or kind == "claim" and n <= number:
                    fs.delete(self._fs(f"{self.root}/catalog/{n:010d}.{kind}")[1], False)

    def entry(self, index: str) -> Entry:
        for e in self.catalog():
            if e.index_name == index:
                return e
        raise ValueError(f"there is no index {index!r}")

    def _synced(self, index: str) -> Entry:
        e = self.entry(index)
        if e.version == 0:
            raise ValueError(f"index {index!r} has not been synced yet")
        return e

    # maintenance

    def add_index(self, index_name: str, schema_name: str, table_name: str, id_column: str = "id", structure_column: str = "molfile", threads: int = 4, segments: int = 4, buffered_docs: int = 1000, buffer_size: float = 64.0, table: DataFrame | None = None) -> Entry:
        """Register an index, and queue every row that the table has."""
        if not _NAME.match(index_name or ""):
            raise ValueError("an index name holds letters, digits and _ only")
        for name, value in (("threads", threads), ("segments", segments), ("buffered_docs", buffered_docs), ("buffer_size", buffer_size)):
            if value <= 0:
                raise ValueError(f"{name} must be above 0")
        base, all_ = self._read_catalog()
        if any(e.index_name == index_name for e in all_):
            raise ValueError(f"index {index_name!r} exists")
        e = Entry(1 + max((x.id for x in all_), default=0), index_name, schema_name, table_name, id_column, structure_column, threads, segments, buffered_docs, float(buffer_size))
        self._write_catalog([*all_, e], base)
        source = table if table is not None else self._source(e)
        self.enqueue(index_name, source.select(F.col(id_column).cast("long").alias("compound"), F.lit(False).alias("delete")))
        return e

    def remove_index(self, index_name: str) -> None:
        self.entry(index_name)
        base, all_ = self._read_catalog()
        self._write_catalog([e for e in all_ if e.index_name != index_name], base)
        self._close(index_name)
        self._remove(f"{self.root}/{index_name}")

    def _source(self, e: Entry) -> DataFrame:
        return self.spark.table(f"{e.schema_name}.{e.table_name}" if e.schema_name else e.table_name)

    def enqueue(self, index: str, changes: DataFrame) -> None:
        """Append (compound, delete) events."""
        changes.select(F.col("compound").cast("long"), F.col("delete").cast("boolean")).write.mode("append").parquet(f"{self.root}/{index}/audit")

    def capture(self, index: str, old: DataFrame, new: DataFrame) -> None:
        """Queue the difference of two snapshots (id, structure): changed and removed rows as deletes too."""
        e = self.entry(index)
        self.enqueue(index, snapshot_changes(old, new, e.id_column, e.structure_column))

    def pending(self, index: str) -> DataFrame:
        path = f"{self.root}/{index}/audit"
        events = self.spark.read.schema(AUDIT).parquet(path) if self._exists(path) else self.spark.createDataFrame([], AUDIT)
        return collapse(events)

    def _manifest(self, index: str, version: int) -> list[Segment]:
        return [Segment(**x) for x in json.loads(self._read_text(f"{self.root}/{index}/v={version}/manifest.json"))] if version else []

    def _file(self, index: str, segment: Segment, what: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{index}/segments/{segment.name}/{what}")

    def _live(self, index: str, segment: Segment) -> DataFrame:
        """A segment's members that are not deleted."""
        df = self._file(index, segment, "members", MEMBERS)
        if not segment.gone:
            return df
        gone = self.spark.read.schema("compound long").parquet(*[f"{self.root}/{index}/deletes/{x}" for x in segment.gone])
        return df.join(gone, "compound", "left_anti").select("row", "compound")

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        out = None
        for part in parts:
            out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _view(self, index: str, segments: list[Segment]) -> View:
        """The segments' rows under numbers that are unique among them."""
        n = len(segments)

        def whole(what: str, schema: str, column: str = "compound") -> DataFrame:
            parts = (self._live(index, x) if what == "members" else self._file(index, x, what, schema) for x in segments)
            return self._union([df.withColumn(column, F.col(column) * n + i) if n > 1 else df for i, df in enumerate(parts)], schema)

        df = self._union([self._file(index, x, "docfreq", DOCFREQ) for x in segments], DOCFREQ).groupBy("field", "bit").agg(F.sum("df").alias("df"))
        return View(whole("molecules", ROWS), whole("members", MEMBERS, "row"), whole("postings", POSTINGS), df)

    def _write_segment(self, index: str, rows: DataFrame, members: DataFrame, expected: int, optimize: bool) -> Segment:
        """Of index rows with a text's digest as compound, and members (row: that digest, compound)."""
        name = uuid.uuid4().hex
        path = f"{self.root}/{index}/segments/{name}"
        if optimize:  # files keep a bounded number of rows however large the segment is
            rows = rows.repartition(max(1, -(-expected // ROWS_PER_FILE)), "compound").sortWithinPartitions("n_heavy", "compound")
        rows.withColumnRenamed("compound", "text_key").withColumn("compound", F.monotonically_increasing_id()).write.parquet(f"{path}/molecules")
        stored = self.spark.read.schema(ROWS).parquet(f"{path}/molecules")
        numbers = stored.select(F.col("text_key").alias("row"), F.col("compound").alias("number"))
        members.join(numbers, "row").select(F.col("number").alias("row"), "compound").write.parquet(f"{path}/members")
        own = self.spark.read.schema(MEMBERS).parquet(f"{path}/members")
        clustered(postings(stored)).write.parquet(f"{path}/postings")
        # a bit's frequency counts compounds, not rows
        held = stored.select("compound", "sub_bits", "sim_levels").join(own.groupBy(F.col("row").alias("compound")).agg(F.count("*").alias("n")), "compound")
        postings(held, with_column="n").groupBy("field", "bit").agg(F.sum("n").alias("df")).write.parquet(f"{path}/docfreq")
        return Segment(name, own.count())

    def sync_data(self, index: str, verbose: bool = False, optimize: bool = True, table: DataFrame | None = None) -> int:
        """Settle the queue in a new version: deletes go, rows that still exist are read anew.

        Pending rows become a segment, and their ids a list of deletes for older segments that hold them.
        With ``optimize``, the smallest segments are merged until there are no more than the index asks for.
        """
        base, all_ = self._read_catalog()
        e = self.entry(index)
        source = table if table is not None else self._source(e)
        waiting = self._names(f"{self.root}/{index}/audit")
        pending = self.pending(index)
        version, here = e.version + 1, f"{self.root}/{index}"
        fresh = source.select(F.col(e.id_column).cast("long").alias("compound"), F.col(e.structure_column).cast("string").alias("structure")).join(pending.select("compound"), "compound")
        temp = f"{here}/tmp-{uuid.uuid4().hex}"
        # the source is read once, and each text parsed once; everything else reads what that wrote
        fresh.write.parquet(f"{temp}/fresh")
        texts, members = distinct(self.spark.read.schema("compound long, structure string").parquet(f"{temp}/fresh"), "compound", "structure")
        members.write.parquet(f"{temp}/members")
        members = self.spark.read.schema("row string, compound long").parquet(f"{temp}/members")
        parse(texts).write.parquet(f"{temp}/prepared")
        good, bad = split(self.spark.read.schema(f"{SCHEMA}, message string".replace("compound long", "compound string")).parquet(f"{temp}/prepared"))
        segments = self._manifest(index, e.version)
        if segments:  # a compound read anew replaces its old row, also if it was only queued as an insert
            name = uuid.uuid4().hex
            pending.select("compound").write.parquet(f"{here}/deletes/{name}")
            gone = self.spark.read.schema("compound long").parquet(f"{here}/deletes/{name}")
            for x in segments:
                n = self._live(index, x).select("compound").join(gone, "compound", "left_semi").count()
                if n:
                    x.deletes, x.gone = x.deletes + n, [*x.gone, name]
            segments = [x for x in segments if x.rows > x.deletes]
        n = good.count()  # from Parquet statistics of one column
        if n or not segments:
            segments.append(self._write_segment(index, good, members if n else members.limit(0), n, optimize))
        if optimize:
            merged = []
            for group in balanced_merge([x.rows - x.deletes for x in segments], e.segments):
                own = [segments[i] for i in group]
                live = sum(x.rows - x.deletes for x in own)
                # a segment most of whose rows are deleted is written again too
                again = len(own) > 1 or 2 * live < own[0].rows
                merged.append(self._merged(index, own, live) if again else own[0])
            segments = merged
        # a join with no rows on one side ends before its other scan, whose tasks would then miss the files of temp
        if not bad.isEmpty():
            notes = each(bad, members).select(F.current_timestamp().alias("timestamp"), F.lit(version).alias("version"), "compound", "message")
            notes.write.mode("append").parquet(f"{here}/errors")
        if verbose:
            print(f"{index}: version {version}, {sum(x.rows - x.deletes for x in segments)} molecules in {len(segments)} segments")
        self._remove(temp)
        self._remove(f"{here}/v={version}")  # what a failed call may have left
        fs, p = self._fs(f"{here}/v={version}")
        fs.mkdirs(p)
        self._write_text(f"{here}/v={version}/manifest.json", json.dumps([asdict(x) for x in segments]))
        self._write_catalog([Entry(**asdict(x) | {"version": version}) if x.index_name == index else x for x in all_], base)
        for name in waiting:  # events that came meanwhile stay
            self._remove(f"{here}/audit/{name}")
        return version

    def _merged(self, index: str, own: list[Segment], live: int) -> Segment:
        """One segment of what is live in several; a text that more than one has is kept once."""
        view = self._view(index, own)
        members = view.members.join(view.rows.select(F.col("compound").alias("row"), "text_key"), "row").select(F.col("text_key").alias("row"), "compound")
        rows = view.rows.join(view.members.select(F.col("row").alias("compound")), "compound", "left_semi").dropDuplicates(["text_key"])
        return self._write_segment(index, rows.drop("compound").withColumnRenamed("text_key", "compound"), members, live, True)

    def cleanup(self, index: str) -> list[str]:
        """Remove every version but the current one, and what no version needs; names that are none of ours are warned of."""
        e, gone = self.entry(index), []
        used = self._manifest(index, e.version)
        for name in self._names(f"{self.root}/{index}"):
            if name.startswith("tmp-") or (name.startswith("v=") and name != f"v={e.version}"):
                self._remove(f"{self.root}/{index}/{name}")
                gone.append(name)
            elif name not in ("audit", "errors", "segments", "deletes", f"v={e.version}"):
                warnings.warn(f"unknown entry {name}", stacklevel=2)
        for kind, names in (("segments", {x.name for x in used}), ("deletes", {y for x in used for y in x.gone})):
            for name in self._names(f"{self.root}/{index}/{kind}"):
                if name not in names:
                    self._remove(f"{self.root}/{index}/{kind}/{name}")
                    gone.append(f"{kind}/{name}")
        return gone

    # reading

    def _close(self, index: str) -> None:
        if index in self._open:
            self._open.pop(index)[1].unpersist()

    def view(self, index: str, cache: bool = False) -> View:
        """The current version; with ``cache`` its rows are kept in memory."""
        e = self._synced(index)
        out = self._view(index, self._manifest(index, e.version))
        if cache:
            if index in self._open and self._open[index][0] != e.version:
                self._close(index)
            if index not in self._open:
                self._open[index] = (e.version, out.rows.cache())
            out.rows = self._open[index][1]
        return out

    def molecules(self, index: str, cache: bool = False) -> DataFrame:
        v = self.view(index, cache)
        return v.each(v.rows.drop("text_key"))

    def ids(self, index: str) -> DataFrame:
        """(compound) of the current version; none before the first sync."""
        return self.view(index).members.select("compound") if self.entry(index).version else self.spark.createDataFrame([], "compound long")

    def docfreq(self, index: str) -> DataFrame:
        """(field, bit, df) in compounds; deleted ones count until their segment is merged, as only the order of bits depends on it."""
        return self.view(index).docfreq

    def postings(self, index: str) -> DataFrame:
        v = self.view(index)
        return v.each(v.posting)

    def errors(self, index: str) -> DataFrame:
        path = f"{self.root}/{index}/errors"
        return self.spark.read.schema(ERRORS).parquet(path) if self._exists(path) else self.spark.createDataFrame([], ERRORS)

    def index_size(self, index: str) -> int:
        return sum(x.rows - x.deletes for x in self._manifest(index, self._synced(index).version))

    def segments(self, index: str) -> DataFrame:
        """(name, molecules, deletes, size) of each segment of the current version: live rows, deleted ones, bytes."""
        rows = []
        for x in self._manifest(index, self._synced(index).version):
            fs, p = self._fs(f"{self.root}/{index}/segments/{x.name}")
            rows.append((x.name, x.rows - x.deletes, x.deletes, fs.getContentSummary(p).getLength()))
        return self.spark.createDataFrame(rows, "name string, molecules int, deletes int, size long")

    def substructure_search(self, index: str, query: str, cache: bool = False, **args) -> DataFrame:
        v = self.view(index, cache)
        return search.substructure_search(v.rows, query, docfreq=v.docfreq, posting=v.posting, members=v.members, **args)

    def similarity_search(self, index: str, query: str, cache: bool = False, **args) -> DataFrame:
        v = self.view(index, cache)
        return search.similarity_search(v.rows, query, docfreq=v.docfreq, posting=v.posting, members=v.members, **args)


def collapse(events: DataFrame) -> DataFrame:
    """One row per compound: delete unless every event was an insert."""
    return events.groupBy("compound").agg(F.bool_or("delete").alias("delete"))


def snapshot_changes(old: DataFrame, new: DataFrame, id_column: str = "id", structure_column: str = "molfile") -> DataFrame:
    """(compound, delete) of two snapshots, null-safe: new rows as inserts, changed and removed ones as deletes."""
    a = old.select(F.col(id_column).cast("long").alias("compound"), F.struct(F.col(structure_column).alias("s")).alias("was"))
    b = new.select(F.col(id_column).cast("long").alias("compound"), F.struct(F.col(structure_column).alias("s")).alias("now"))
    both = a.join(b, "compound", "full_outer")
    changed = both.filter(F.col("was").isNull() | F.col("now").isNull() | ~F.col("was.s").eqNullSafe(F.col("now.s")))
    return changed.select("compound", F.col("was").isNotNull().alias("delete"))


def event_changes(events: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(compound, delete) of a log (compound, kind): INSERT, UPDATE, DELETE, TRUNCATE as delete of all ``ids`` (compound).

    Without ``ids`` a TRUNCATE fails when it is read.
    """
    known, emptied = F.col("kind").isin("INSERT", "UPDATE", "DELETE"), F.col("kind") == "TRUNCATE"
    if ids is None:
        known = F.when(emptied, F.raise_error(F.lit("TRUNCATE needs the ids of the index")).cast("boolean")).otherwise(known)
    out = events.filter(known).select("compound", (F.col("kind") != "INSERT").alias("delete"))
    if ids is None:
        return out
    all_ = events.filter(emptied).limit(1).select(F.lit(True).alias("delete"))
    return out.unionByName(ids.select(F.col("compound").cast("long")).crossJoin(all_))


def balanced_merge(sizes: list[int], most: int) -> list[list[int]]:
    """Which segments to merge: while there are more than ``most``, the smallest joins the ``most``-th largest."""
    groups = [([i], n) for i, n in enumerate(sizes)]
    while len(groups) > most:
        groups.sort(key=lambda g: (-g[1], g[0]))
        small = groups.pop()
        into = groups[most - 1]
        groups[most - 1] = (into[0] + small[0], into[1] + small[1])
    return [sorted(g) for g, _ in groups]
