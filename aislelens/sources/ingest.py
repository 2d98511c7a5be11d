"""Incremental ingest of export drops into bronze tables.

``Bronze`` is a table fed from files. Each ``ingest`` takes the files of a drop folder that it does not know yet and
writes one commit: ``commit=<n>/rows`` (partitioned into readable and unreadable records), ``commit=<n>/files`` (the
ledger: path, length, modification time, digest of the records, counts) and last an empty ``_COMMITTED``, which
makes both visible at once. A commit that was cut short has no such file; the next ingest writes its number anew.

- Known files (path, length and time as in the ledger) are not read again. A drop without news makes no commit.
- A file that brings the same records as another one is a copy: its rows do not count twice.
- A file that comes again with other content replaces its earlier rows; a file that vanishes keeps them.
- Schemas may drift: columns are matched by name, declared columns that a file lacks are NULL, columns that are not
  declared are kept as text in the map ``_extra``. A value that its declared type can't hold makes the record unreadable.
- Unreadable records go to a side table with their text and file, and are counted in the ledger.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import folder_names
from .exports import CORRUPT, RAW_SCHEMAS

LEDGER = "path string, length long, modified long, digest string, rows long, unreadable long, commit long"
COMMITTED = "_COMMITTED"
EXTRA = "_extra"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _name(path: Column | str):
    """Paths as the scan reports them and as the store lists them, in one form."""
    if isinstance(path, Column):
        return F.regexp_replace(path, "^file:/+", "file:/")
    return "file:/" + path[5:].lstrip("/") if path.startswith("file:") else path


def list_files(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """(path, length, modification time) of the data files below a folder; none if it does not exist."""
    at, fs = _fs(spark, folder)
    if not fs.exists(at):
        return []
    out, found = [], fs.listFiles(at, True)
    while found.hasNext():
        f = found.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((_name(f.getPath().toUri().toString()), f.getLen(), f.getModificationTime()))
    return sorted(out)


def _header(spark: SparkSession, path: str) -> str:
    """The first line of a file."""
    at, fs = _fs(spark, path)
    stream = fs.open(at)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        return reader.readLine() or ""
    finally:
        stream.close()


def _decoded(path: str) -> str:
    from urllib.parse import unquote
    return unquote(path)


class Bronze:
    """A bronze table at ``root``, fed from export files of one format (csv with a header, json lines, parquet)."""

    def __init__(self, spark: SparkSession, root: str, table: str, fmt: str = "csv", schema: str | None = None):
        if fmt not in ("csv", "json", "parquet"):
            raise ValueError(f"no such export format: {fmt}")
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt
        self.schema: T.StructType = T._parse_datatype_string(schema or RAW_SCHEMAS[table])

    # -- commits and ledger ---------------------------------------------------
    def _commit(self, n: int, part: str = "") -> str:
        return os.path.join(self.root, f"commit={n}", part).rstrip("/")

    def commits(self) -> list[int]:
        """The numbers of the complete commits."""
        numbers = [int(x.split("=")[1]) for x in folder_names(self.spark, self.root) if x.startswith("commit=")]
        return sorted(n for n in numbers if COMMITTED in folder_names(self.spark, self._commit(n)))

    def ledger(self, until: int | None = None) -> DataFrame:
        """What is known of each file and commit, up to a commit."""
        paths = [self._commit(n, "files") for n in self.commits() if until is None or n <= until]
        if not paths:
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(*paths)

    def ingest(self, drop: str) -> int | None:
        """Takes in the new files of a drop folder; the commit's number, or None if nothing is new."""
        spark = self.spark
        listed = spark.createDataFrame(list_files(spark, drop), "path string, length long, modified long")
        done = self.commits()
        new = listed.join(self.ledger(), ["path", "length", "modified"], "left_anti").collect()  # one row a new file
        if not new:
            return None
        n = done[-1] + 1 if done else 1
        rows = self._read([_decoded(r["path"]) for r in new])
        (rows.withColumn("_commit", F.lit(n).cast("long")).withColumn("_unreadable", F.col(CORRUPT).isNotNull())
         .write.mode("overwrite").partitionBy("_unreadable").parquet(self._commit(n, "rows")))
        stored = self._stored([n])
        seen = [F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))) if c == EXTRA else F.col(c)
                for c in [*self.schema.names, EXTRA, CORRUPT]]
        sums = stored.groupBy(F.col("_file").alias("path")).agg(
            F.count("*").alias("rows"), F.count_if("_unreadable").alias("unreadable"),
            F.bit_xor(F.xxhash64(*seen)).alias("_x"), F.sum(F.xxhash64(F.lit(1), *seen).cast("decimal(38,0)")).alias("_s"))
        digest = F.sha2(F.concat_ws(":", F.coalesce("rows", F.lit(0)), F.coalesce("_x", F.lit(0)), F.coalesce("_s", F.lit(0))), 256)
        files = spark.createDataFrame(new, listed.schema).join(sums, "path", "left").select(
            "path", "length", "modified", digest.alias("digest"), F.coalesce("rows", F.lit(0)).alias("rows"),
            F.coalesce("unreadable", F.lit(0)).alias("unreadable"), F.lit(n).cast("long").alias("commit"))
        files.coalesce(1).write.mode("overwrite").parquet(self._commit(n, "files"))
        at, fs = _fs(spark, self._commit(n, COMMITTED))
        fs.create(at, False).close()  # fails if another ingest was first
        return n

    # -- reading exports --------------------------------------------------------
    def _read(self, paths: list[str]) -> DataFrame:
        """The records of files: declared columns, _extra, the unreadable text, the file's path."""
        if self.fmt == "json":
            return self._read_json(paths)
        layouts: dict = {}
        for path in paths:  # one header or footer a file; files of one layout are read together
            if self.fmt == "csv":
                layout = _header(self.spark, path)
            else:
                layout = self.spark.read.parquet(path).schema.json()
            layouts.setdefault(layout, []).append(path)
        read = self._read_csv if self.fmt == "csv" else self._read_parquet
        parts = [read(layout, group) for layout, group in layouts.items()]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.schema}

    def _shaped(self, df: DataFrame, there: dict[str, Column], extra: list[Column], corrupt: Column) -> DataFrame:
        known = [there.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]
        none = F.lit(None).cast("map<string,string>")
        more = F.map_filter(F.create_map(*extra), lambda k, v: v.isNotNull()) if extra else none
        more = F.when(F.size(more) > 0, more) if extra else none
        return df.select(*known, more.alias(EXTRA), corrupt.alias(CORRUPT), _name(F.col("_metadata.file_path")).alias("_file"))

    def _read_csv(self, header: str, paths: list[str]) -> DataFrame:
        spark, types = self.spark, self._types()
        quoted = spark.createDataFrame([(header,)], "h string")
        width = len(header) + 1
        names = quoted.select(F.from_csv("h", ", ".join(f"c{k} string" for k in range(header.count(",") + 1)),
                                         {"maxCharsPerColumn": str(width)}).alias("n")).first()["n"]
        names = [x for x in names if x is not None] if header else []
        if not names or len(set(names)) < len(names):  # no usable header: every line is unreadable
            lines = spark.read.text(paths)
            return self._shaped(lines, {}, [], F.coalesce("value", F.lit("")))
        schema = T.StructType([T.StructField(x, types.get(x, T.StringType())) for x in names] + [T.StructField(CORRUPT, T.StringType())])
        rows = (spark.read.schema(schema).option("header", "true").option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", CORRUPT).csv(paths))
        extra = [c for x in names if x not in types for c in (F.lit(x), F.col(f"`{x}`"))]
        return self._shaped(rows, {x: F.col(f"`{x}`") for x in names if x in types}, extra, F.col(CORRUPT))

    def _read_json(self, paths: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(CORRUPT, T.StringType())])
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        rows = (self.spark.read.text(paths).filter(F.trim("value") != "")
                .select("_metadata", F.from_json("value", schema, options).alias("r"),
                        F.map_filter(F.from_json("value", "map<string,string>"),
                                     lambda k, v: ~k.isin(*self.schema.names) & v.isNotNull()).alias("more")))
        known = [F.col("r").getField(c).alias(c) for c in self.schema.names]
        more = F.when((F.size("more") > 0) & F.col("r").getField(CORRUPT).isNull(), F.col("more"))
        return rows.select(*known, more.alias(EXTRA), F.col("r").getField(CORRUPT).alias(CORRUPT),
                           _name(F.col("_metadata.file_path")).alias("_file"))

    def _read_parquet(self, layout: str, paths: list[str]) -> DataFrame:
        import json

        types, schema = self._types(), T.StructType.fromJson(json.loads(layout))
        rows = self.spark.read.schema(schema).parquet(*paths)
        there, bad = {}, F.lit(False)
        for f in schema:
            if f.name in types:
                value = F.col(f"`{f.name}`")
                there[f.name] = value.try_cast(types[f.name])
                bad |= value.isNotNull() & there[f.name].isNull()
        extra = [c for f in schema if f.name not in types for c in (F.lit(f.name), F.col(f"`{f.name}`").cast("string"))]
        text = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema]))
        return self._shaped(rows, there, extra, F.when(bad, text))

    # -- what stands ------------------------------------------------------------
    def _stored(self, commits: list[int]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField(EXTRA, T.MapType(T.StringType(), T.StringType())),
                               T.StructField(CORRUPT, T.StringType()), T.StructField("_file", T.StringType()),
                               T.StructField("_commit", T.LongType()), T.StructField("_unreadable", T.BooleanType())])
        if not commits:
            return self.spark.createDataFrame([], schema)
        out = None
        for kind in (False, True):
            paths = [p for n in commits if f"_unreadable={str(kind).lower()}" in folder_names(self.spark, self._commit(n, "rows"))
                     for p in [self._commit(n, f"rows/_unreadable={str(kind).lower()}")]]
            if paths:
                part = (self.spark.read.schema(T.StructType(schema.fields[:-1])).parquet(*paths)
                        .withColumn("_unreadable", F.lit(kind)))
                out = part if out is None else out.unionByName(part)
        return self.spark.createDataFrame([], schema) if out is None else out

    def _carriers(self, until: int | None = None) -> DataFrame:
        """(_file, _commit) whose rows stand: of each content that a file has now, the first that brought it."""
        ledger = self.ledger(until)
        content = F.struct("length", "digest")
        latest = ledger.groupBy("path").agg(F.max_by(content, "commit").alias("c")).select("c.*").distinct()
        first = ledger.groupBy("length", "digest").agg(F.min(F.struct("commit", "path")).alias("f"))
        return first.join(latest, ["length", "digest"], "left_semi").select(
            F.col("f.path").alias("_file"), F.col("f.commit").alias("_commit"))

    def _standing(self, until: int | None = None) -> DataFrame:
        commits = [n for n in self.commits() if until is None or n <= until]
        return self._stored(commits).join(self._carriers(until), ["_file", "_commit"], "left_semi")

    def current(self, extra: bool = False, until: int | None = None) -> DataFrame:
        """The table's rows as they stand after all commits, or after commit ``until``."""
        rows = self._standing(until).filter(~F.col("_unreadable"))
        return rows.select(*self.schema.names, *([EXTRA] if extra else []))

    def unreadable(self) -> DataFrame:
        """The side table: (file, record) that could not be read."""
        return self._standing().filter("_unreadable").select(F.col("_file").alias("file"), F.col(CORRUPT).alias("record"))

    def feed(self, since: int) -> DataFrame:
        """What changed after commit ``since``: rows that came (_sign 1) and that no longer stand (_sign -1).

        Only commits that hold such rows are read.
        """
        now, then = self._carriers(), self._carriers(since)
        came, gone = now.exceptAll(then), then.exceptAll(now)
        out = None
        for sign, files in ((1, came), (-1, gone)):
            touched = [r["_commit"] for r in files.select("_commit").distinct().collect()]
            rows = self._stored(sorted(touched)).join(files, ["_file", "_commit"], "left_semi").filter(~F.col("_unreadable"))
            rows = rows.select(*self.schema.names, F.lit(sign).alias("_sign"))
            out = rows if out is None else out.unionByName(rows)
        return out
