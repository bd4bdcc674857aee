"""Reading and writing tables: text scans, CSV export and versioned Parquet tables."""

from __future__ import annotations

import csv
import uuid
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreflow.functions.numbers import finite
from scoreflow.functions.text import clean_id
from scoreflow.operators.keyed import without_keys

# RFC 4180: quotes inside a field are doubled.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

# A whole line as one cell: no quotes, and a separator that no header holds.
LINE_OPTIONS = {
    "header": False, "multiLine": True, "sep": "\x01", "quote": "", "escape": "", "maxColumns": 2,
    "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False,
}


def as_text(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def file_lines(spark: SparkSession, file: str) -> DataFrame:
    """Lines of one file in column ``value``, read by one task however large the file is, so their order is the file's."""
    return spark.read.schema("value string").options(**LINE_OPTIONS).csv(file)


def csv_headers(spark: SparkSession, path: str, at_once: int = 200) -> dict[str, tuple[str, ...]]:
    """Header of each file under ``path``, by file name; files without a line have none.

    Only the start of a file is read, ``at_once`` files in one job. A large file is not split for it, so the
    first line is that of the file and not that of a later split. Blank lines before it are skipped, as
    they are when the rows are read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    files = sorted(r.path for r in listed.collect() if r.length)
    headers = {}
    for start in range(0, len(files), at_once):
        firsts = [file_lines(spark, f).limit(1).select(F.lit(f).alias("file"), "value") for f in files[start : start + at_once]]
        for row in reduce(DataFrame.unionByName, firsts).collect():
            headers[row.file] = tuple(next(csv.reader([row.value.removeprefix("\ufeff")]), ()))
    return headers


def read_csv(spark: SparkSession, path: str, multiline: bool = False, columns: list[str] | None = None) -> DataFrame:
    """Header row plus text cells; empty cells are null.

    Each file is read by its own header and aligned by name, so files may differ in the order of their columns.
    A file whose columns differ from ``columns`` (or else from those of the first file) raises, named. A file
    with a column named twice raises too. ``multiline`` is for tables with line breaks inside cells. A file is
    then read by one task, so write such tables as many files.
    """
    headers = csv_headers(spark, path)
    if not headers:
        raise ValueError(f"no CSV header under {path}")
    wanted = list(columns or next(iter(headers.values())))
    alike: dict[tuple[str, ...], list[str]] = {}
    for file, header in headers.items():
        missing, extra = sorted(set(wanted) - set(header)), sorted(set(header) - set(wanted))
        doubled = sorted({c for c in header if header.count(c) > 1})
        if missing or extra or doubled:
            raise ValueError(f"header of {file} differs: missing {missing}, unexpected {extra}, repeated {doubled}")
        alike.setdefault(header, []).append(file)
    # Spark compares the header of each file with the given columns once more while it reads.
    reader = spark.read.options(**CSV_OPTIONS, multiLine=multiline, enforceSchema=False)
    frames = [
        reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in header])).csv(files)
        for header, files in alike.items()
    ]
    return reduce(DataFrame.unionByName, frames).select([F.col(f"`{c}`") for c in wanted])


def write_csv(df: DataFrame, path: str) -> None:
    """Export as text; null, NaN and infinite cells become empty."""
    as_text(sanitize(df)).write.options(**CSV_OPTIONS, emptyValue="").mode("overwrite").csv(path)


def sanitize(df: DataFrame) -> DataFrame:
    """NaN and infinities in floating-point columns become null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select([finite(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types; raises if one is missing or extra."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    extra = [c for c in df.columns if c not in schema.names]
    if missing or extra:
        raise ValueError(f"header differs: missing {sorted(missing)}, unexpected {sorted(extra)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def part_of(student_id: Column, parts: int) -> Column:
    """Part of a student: a hash bucket, so that a few students touch few parts."""
    return F.pmod(F.xxhash64(clean_id(student_id)), F.lit(parts)).cast("int")


#: Trimmed id of a row in tables split by student: lookups compare it, so Parquet's filters can skip rows.
TRIMMED = "_trimmed_id"
#: Columns of the files that are no columns of the table.
HIDDEN = ("v", "part", TRIMMED)
BLOOM = {f"parquet.bloom.filter.enabled#{TRIMMED}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}


class ChangedTable(RuntimeError):
    """Another run has published a version of the table since it was read."""


class TableStore:
    """Parquet tables under one root: each a list of folders named in numbered mark files.

    A write goes to new folders and becomes visible with the next mark, which is written under
    another name and renamed without overwriting: a reader sees a whole mark, and of two runs that
    start from one version the second gets :class:`ChangedTable` (appends and upserts then start
    again from the new version). Tables kept per student are split into ``parts`` by student: an
    upsert rewrites, and a lookup reads, only the parts of the students it names. Choose ``parts``
    so that a part of the largest table is some gigabytes. With ``retain``, folders named only in
    marks older than the last ``retain`` are removed after each write. The root must be on storage
    all executors share.
    """

    RETRIES = 5
    END = "."
    #: Folders of a part from which on a write that replaces nothing puts them together.
    FOLDERS = 8

    def __init__(self, spark: SparkSession, root: str, parts: int = 16, retain: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.parts = parts
        self.retain = retain
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)

    # --- folders and marks

    def _folder(self, name: str, folder: str = "") -> str:
        return f"{self.root}/{name}/{folder}".rstrip("/")

    def _marks(self, name: str) -> list[int]:
        top = self._path(self._folder(name))
        if not self._fs.exists(top):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(top)]
        return sorted(int(n[len("_mark.") :]) for n in names if n.startswith("_mark.") and n[len("_mark.") :].isdigit())

    def _marked(self, name: str, number: int) -> list[str]:
        stream = self._fs.open(self._path(self._folder(name, f"_mark.{number}")))
        try:
            lines = bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()
        if len(lines) < 2 or lines[-1] != self.END:
            raise RuntimeError(f"mark {number} of table {name} under {self.root} is broken")
        return lines[:-1]

    def _current(self, name: str) -> tuple[int, list[str]]:
        """Number and folders of the newest mark; (0, none) for an absent table."""
        marks = self._marks(name)
        return (marks[-1], self._marked(name, marks[-1])) if marks else (0, [])

    def _folders(self, name: str) -> list[str]:
        return self._current(name)[1]

    def _part_folders(self, name: str, version: str) -> list[str]:
        inner = [f.getPath().getName() for f in self._fs.listStatus(self._path(self._folder(name, version)))]
        parts = [f"{version}/{n}" for n in sorted(inner) if n.startswith("part=")]
        return parts or [version]

    def number(self, name: str) -> int:
        """Number of the newest mark; 0 for an absent table."""
        return self._current(name)[0]

    def exists(self, name: str) -> bool:
        return bool(self._folders(name))

    # --- versions

    def _write(self, name: str, folder: str, df: DataFrame, sort_by: list[str] | None, placed: bool) -> None:
        if sort_by is None:
            writer = df.write
        else:
            rows = df.withColumn("part", part_of(F.col("student_id"), self.parts))
            # Rebalancing groups the rows of a part and splits a part that is too large.
            placed = (rows if placed else rows.hint("rebalance", "part")).withColumn(TRIMMED, clean_id(F.col("student_id")))
            writer = placed.sortWithinPartitions("part", TRIMMED, *sort_by).write.options(**BLOOM).partitionBy("part")
        writer.parquet(self._folder(name, folder))

    def stage(
        self, name: str, df: DataFrame, sort_by: list[str] | None = None, label: str | None = None, placed: bool = False
    ) -> str:
        """Write a new version without showing it; returns its label.

        With ``sort_by`` the rows are split by student and sorted inside their part;
        without it they are written as they come, with no shuffle. ``placed``: the rows come row by row from a
        version split by student, so they lie by part already and are not shuffled for it again.
        """
        version = f"v={label + '~' if label else ''}{uuid.uuid4().hex}"
        self._write(name, version, sanitize(df), sort_by, placed)
        return version

    def _show(self, name: str, folders: list[str], seen: int) -> None:
        """Make ``folders`` the table, if mark ``seen`` is still its newest."""
        written = self._path(self._folder(name, f"_new-{uuid.uuid4().hex}"))
        stream = self._fs.create(written, False)
        try:
            stream.write(bytearray("\n".join([*folders, self.END]).encode()))
        finally:
            stream.close()
        if self._current(name)[0] == seen:
            try:
                self._context.rename(written, self._path(self._folder(name, f"_mark.{seen + 1}")), self._keep)
            except Py4JJavaError as error:
                if "FileAlreadyExists" not in str(error.java_exception):
                    raise
            else:
                if self.retain:
                    self.vacuum(name, self.retain)
                return
        self._fs.delete(written, False)
        raise ChangedTable(f"table {name} under {self.root} has a newer version than {seen}")

    def publish(self, name: str, version: str) -> None:
        """Make a staged version the whole table, whatever it held."""
        folders = self._part_folders(name, version)
        self._again(lambda: self._show(name, folders, self._current(name)[0]))

    def _again(self, action: Callable[[], None]) -> None:
        for left in range(self.RETRIES, -1, -1):
            try:
                return action()
            except ChangedTable:
                if not left:
                    raise

    def discard(self, name: str, version: str) -> None:
        """Remove a staged version that is not to be published."""
        self._fs.delete(self._path(self._folder(name, version)), True)

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(self._folder(name)), True)

    def vacuum(self, name: str, retain: int = 1) -> None:
        """Remove all marks but the last ``retain`` and the folders that only they name."""
        marks = self._marks(name)
        old, kept = marks[:-retain], marks[-retain:]
        used = {f for number in kept for f in self._marked(name, number)}
        for number in old:
            gone = set(self._marked(name, number)) - used
            self._fs.delete(self._path(self._folder(name, f"_mark.{number}")), False)
            for folder in gone:
                self.discard(name, folder)

    def compact(self, name: str, schema: T.StructType, sort_by: list[str] | None = None) -> None:
        """Rewrite an appended table as one version; its batch labels are lost."""
        seen, folders = self._current(name)
        if folders:
            version = self.stage(name, self._load(name, folders, schema).drop(*HIDDEN), sort_by)
            self._show(name, self._part_folders(name, version), seen)

    # --- reads

    def _load(self, name: str, folders: list[str], schema: T.StructType | None) -> DataFrame:
        if not folders:
            if schema is None:
                raise LookupError(f"no table {name} under {self.root}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.option("basePath", self._folder(name))
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(*[self._folder(name, f) for f in folders])

    def read(self, name: str, schema: T.StructType | None = None) -> DataFrame:
        """All rows; an absent table is an empty frame of the given schema."""
        return self._load(name, self._folders(name), schema).drop(*HIDDEN)

    def read_version(self, name: str, version: str, schema: T.StructType) -> DataFrame:
        return self._load(name, [version], schema).drop(*HIDDEN)

    def read_batch(self, name: str, batch: str, schema: T.StructType) -> DataFrame:
        own = [f for f in self._folders(name) if f.startswith(f"v={batch}~")]
        return self._load(name, own, schema).drop(*HIDDEN)

    def parts_of(self, ids: DataFrame) -> list[int]:
        """Parts that hold the given students; never more than ``parts`` numbers."""
        return [r.part for r in ids.select(part_of(F.col("student_id"), self.parts).alias("part")).distinct().collect()]

    def read_parts(self, name: str, schema: T.StructType, parts: list[int]) -> DataFrame:
        """Rows of the given parts; the other parts are pruned before the scan."""
        rows = self._load(name, self._folders(name), schema)
        return (rows.filter(F.col("part").isin(parts)) if "part" in rows.columns else rows).drop(*HIDDEN)

    def read_student(self, name: str, schema: T.StructType, student_id: str) -> DataFrame:
        """Rows of one student (id compared trimmed).

        The rows of a file are sorted by the trimmed id, which has a bloom filter: besides the part, the scan reads
        only the row groups and pages that may hold the student.
        """
        wanted = student_id.strip()
        one = self.spark.range(1).select(F.lit(wanted).alias("student_id"))
        rows = self._load(name, self._folders(name), T.StructType([*schema.fields, T.StructField(TRIMMED, T.StringType())]))
        if "part" in rows.columns:
            own = rows.filter(F.col("part").isin(self.parts_of(one)) & (F.col(TRIMMED) == wanted))
        else:
            own = rows.filter(clean_id(F.col("student_id")) == wanted)
        return own.drop(*HIDDEN)

    # --- writes

    def overwrite(self, name: str, df: DataFrame, sort_by: list[str] | None = None) -> None:
        self.publish(name, self.stage(name, df, sort_by))

    def scratch(self, name: str, df: DataFrame) -> DataFrame:
        """The frame as stored rows: for results that several later steps read."""
        self.overwrite(name, df)
        return self.read(name)

    def append(
        self, name: str, df: DataFrame, schema: T.StructType, batch: str, sort_by: list[str] | None = None, placed: bool = False
    ) -> None:
        """Add rows under a batch label; writing the same label again replaces its rows at once.

        A header that differs from ``schema`` raises and leaves the table as it is.
        """
        version = self.stage(name, conform(df, schema), sort_by, batch, placed)

        def add() -> None:
            seen, folders = self._current(name)
            self._show(name, [*(f for f in folders if not f.startswith(f"v={batch}~")), version], seen)

        self._again(add)

    def upsert(
        self, name: str, df: DataFrame, schema: T.StructType, keys: list[str], sort_by: list[str],
        gone: DataFrame | None = None, parts: list[int] | None = None,
    ) -> None:
        """Replace the rows whose key occurs in ``df``, a frame with a student id.

        ``gone``: stored keys whose old rows go, in place of those of ``df``. ``parts``: parts that hold all
        students of both, where they are known already.
        """
        self.admit(name, self.stage(name, conform(df, schema), sort_by), schema, keys, sort_by, gone, parts)

    def admit(
        self, name: str, version: str, schema: T.StructType, keys: list[str], sort_by: list[str],
        gone: DataFrame | None = None, parts: list[int] | None = None, unmet: int | None = None,
    ) -> None:
        """:meth:`upsert` of the rows of a staged version, which are not written again.

        Only the rows that stay of the old ones are, in a version of their own, so a part has a folder for them and
        one for the new rows. ``unmet``: number of a mark in which no key of the version occurs. While it is the
        newest, nothing is replaced and no old row is written, but a part of many folders is put together.
        """
        new = self.read_version(name, version, schema)
        leaving = new if gone is None else gone
        own = self._part_folders(name, version)
        if parts is not None:
            touched = {f"part={p}" for p in parts}
        else:
            touched = {f.split("/")[-1] for f in own} | {f"part={p}" for p in (self.parts_of(gone) if gone is not None else [])}

        def replace() -> None:
            seen, folders = self._current(name)
            hit = [f for f in folders if f.split("/")[-1] in touched or "/" not in f]
            if unmet is not None and unmet == seen:
                hit = self._crowded(hit)
                stays = self._load(name, hit, schema).drop(*HIDDEN) if hit else None
            else:
                stays = self._staying(self._load(name, hit, schema).drop(*HIDDEN), leaving, keys) if hit else None
            kept = None if stays is None else self.stage(name, stays, sort_by)
            rest = [f for f in self._part_folders(name, kept) if "/" in f] if kept else []
            try:
                self._show(name, [*(f for f in folders if f not in hit), *rest, *own], seen)
            except ChangedTable:
                if kept:
                    self.discard(name, kept)
                raise
            if kept and not rest:
                self.discard(name, kept)

        try:
            self._again(replace)
        except ChangedTable:
            self.discard(name, version)
            raise

    def _crowded(self, folders: list[str]) -> list[str]:
        """Those of the folders whose part has ``FOLDERS`` of them or more."""
        places = [f.split("/")[-1] for f in folders]
        return [f for f, place in zip(folders, places, strict=True) if "/" in f and places.count(place) >= self.FOLDERS]

    def _staying(self, old: DataFrame, leaving: DataFrame, keys: list[str]) -> DataFrame | None:
        """Old rows whose key does not occur in ``leaving``; None where that is known to be no row.

        Where as many rows come as there are, the keys alone are compared first: if all are replaced, as in a repeated
        run, the old rows need not be shuffled whole for it. Both counts come from the footers of the files.
        """
        there = old.count()
        if not there or (leaving.count() >= there and without_keys(old.select(keys), leaving, keys).isEmpty()):
            return None
        return without_keys(old, leaving, keys)
