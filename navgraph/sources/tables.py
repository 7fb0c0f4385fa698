"""Tables in the shared folder that readers see whole or not at all: named ones behind a pointer file, and several that change together."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from navgraph.session import shared_dir

#: Files of a table up to which its pointer tells which keys each holds.
MAX_INDEXED_FILES = 20_000
#: How long a table that has been replaced stays, for those that still read it.
GRACE_S = 24 * 3600
#: Tries of a commit whose version others took.
MAX_TRIES = 20


def _path(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of the files below a path, from its store's listing; nothing is read."""
    fs, place = _path(spark, path)
    if not fs.exists(place):
        return []
    found, out = fs.listFiles(place, True), []
    while found.hasNext():
        status = found.next()
        out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return sorted(out)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of the shared folder; None if it isn't there."""
    fs, place = _path(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file where readers see all of it or nothing; False, and nothing is changed, if there is one already.

    It is written beside its place and renamed without overwriting, which file
    systems such as HDFS do in one step, so of several writers one wins. Where
    a store has no such rename there may be one writer at a time.
    """
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    fs, place = _path(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".{uuid.uuid4().hex}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = sc._gateway.new_array(rename, 1)
    how[0] = getattr(rename, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(place), how)
    except Exception:
        fs.delete(beside, False)
        if fs.exists(place):
            return False
        raise
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _path(spark, path)
    fs.delete(place, True)


@dataclass(frozen=True)
class Kept:
    """A kept table, and for each of its files the least and greatest value of the key it is laid out by."""

    spark: SparkSession
    folder: str
    schema: T.StructType
    key: str | None = None
    files: list[tuple[str, object, object]] = field(default_factory=list)

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def holding(self, values: Iterable) -> DataFrame:
        """The rows whose key is one of a few ``values``, from the files that can hold them alone."""
        values = sorted({v for v in values if v is not None})
        if not self.files:
            return self.df.filter(F.col(self.key).isin(values)) if values else self.df.limit(0)
        paths = [f for f, low, high in self.files if low is not None and any(low <= v <= high for v in values)]
        found = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.df.limit(0)
        return found.filter(F.col(self.key).isin(values))


def fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """A hash of the names, sizes and times of the files at ``paths``, which change when the data do; their contents aren't read."""
    import hashlib

    return hashlib.md5(json.dumps([list_files(spark, p) for p in paths]).encode()).hexdigest()


def _kept_at(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/navgraph/kept"
    return base, f"{base}/{name}.json"


def is_kept(spark: SparkSession, name: str) -> bool:
    """Whether the table is there already."""
    return read_text(spark, _kept_at(spark, name)[1]) is not None


def kept(spark: SparkSession, name: str, build: Callable[[], DataFrame], key: str | None = None, filtered: Iterable[str] = (), of: str = "", distinct: bool = False) -> Kept:
    """The table ``name`` of the shared folder; if it isn't there, it is built first.

    A table lies in a folder of its own, named by chance, which no one finds
    until all of it is written: then a pointer file names it. So a table that is
    being written, or whose writer was lost, is never read, and of several that
    build it at once all use the first one's. ``key`` lays it out by ranges of
    that column, sorted, and the pointer then knows each file's range;
    ``filtered`` columns get Bloom filters; ``distinct`` drops repeated rows of a
    table with a key, where they lie together. ``of`` says what the table is made
    of: once it is there, older tables of the same kind are taken away, their
    pointers at once and their folders a day after.
    """
    base, pointer = _kept_at(spark, name)
    text = read_text(spark, pointer)
    if text is None:
        folder = f"{base}/{name}-{uuid.uuid4().hex}"
        df = build()
        if key:
            df = df.repartitionByRange(key)
            df = (df.distinct() if distinct else df).sortWithinPartitions(key)
        writer = df.write
        for c in filtered:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(folder)
        files: list[tuple] = []
        if key:
            ranges = spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(key), F.max(key))
            files = [tuple(r) for r in ranges.limit(MAX_INDEXED_FILES + 1).collect()]
            files = files if len(files) <= MAX_INDEXED_FILES else []
        text = json.dumps({"folder": folder, "schema": df.schema.json(), "key": key, "files": files, "of": of, "made": time.time()})
        if not publish(spark, pointer, text):
            remove(spark, folder)
            text = read_text(spark, pointer)
        elif of:
            retire(spark, of, keep=pointer)
    told = json.loads(text)
    return Kept(spark, told["folder"], T.StructType.fromJson(json.loads(told["schema"])), told["key"], [tuple(f) for f in told["files"]])


def retire(spark: SparkSession, of: str, keep: str, grace_s: float = GRACE_S) -> list[str]:
    """Take tables made of ``of`` away but that of the pointer ``keep``: pointers now, folders once their table is older than the grace. Returns the folders that went."""
    base, gone = f"{shared_dir(spark)}/navgraph/kept", []
    for path, _, _ in list_files(spark, base):
        if not path.endswith((".json", ".old")) or path.endswith(keep):
            continue
        text = read_text(spark, path)
        told = json.loads(text) if text else {}
        if told.get("of") != of:
            continue
        if time.time() - told["made"] > grace_s:
            remove(spark, told["folder"])
            remove(spark, path)
            gone.append(told["folder"])
        elif path.endswith(".json"):
            publish(spark, f"{path}.{uuid.uuid4().hex}.old", text)
            remove(spark, path)
    return gone


class Commits:
    """Several tables in one folder that change together: a version is a manifest, a small file that lists the folders of every table."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.base = spark, base

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        names = [f.rsplit("/", 1)[1] for f, _, _ in list_files(self.spark, f"{self.base}/_commits")]
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(read_text(self.spark, f"{self.base}/_commits/{version:020d}.json")) if version else {}

    def append(self, replace: Iterable[str] = (), **tables: DataFrame) -> int:
        """Add rows to each of the tables, all of them or none; those named in ``replace`` are put in place of what was there. Returns the version that has them.

        Tables are written one after the other to folders that no manifest
        names. If one fails, what was written is deleted as far as can be, and
        nothing was ever seen of it. The last step is one small file. If another
        writer took its version, appended rows go after that one's; a commit that
        replaces something is given up, as it may rest on what is there no more.
        """
        made: dict[str, dict] = {}
        replace, read = set(replace), self.version()
        try:
            for name, df in tables.items():
                folder = f"{self.base}/{name}/{uuid.uuid4().hex}"
                made[name] = {"folder": folder, "schema": df.schema.json()}
                df.write.parquet(folder)
            for _ in range(MAX_TRIES):
                version = self.version()
                if replace and version != read:
                    break
                now = self.manifest(version)
                for name, new in made.items():
                    before = now.get(name, {"folders": [], "schema": new["schema"]})
                    if before["schema"] != new["schema"]:
                        raise ValueError(f"{name} has other columns than before")
                    now[name] = before | {"folders": [*([] if name in replace else before["folders"]), new["folder"]]}
                if publish(self.spark, f"{self.base}/_commits/{version + 1:020d}.json", json.dumps(now)):
                    return version + 1
            raise RuntimeError("others committed in the meantime")
        except BaseException:
            for new in made.values():
                remove(self.spark, new["folder"])
            raise

    def read(self, name: str, version: int | None = None, since: int = 0) -> DataFrame | None:
        """A table as of a version (the last), or what was appended to it after the version ``since``; None if there is nothing. All tables of one version belong together."""
        found = self.manifest(version).get(name)
        if found is None:
            return None
        known = set(self.manifest(since).get(name, {}).get("folders", ())) if since else set()
        folders = [f for f in found["folders"] if f not in known]
        return self.spark.read.schema(T.StructType.fromJson(json.loads(found["schema"]))).parquet(*folders) if folders else None
