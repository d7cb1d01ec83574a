"""The nine tables as Parquet folders on a shared file system, published by version files.

A version file names the folders that make up every table. Writers add folders that no version names yet and publish the next
version last, in one rename: readers see all of a change or nothing of it, however many tables it has. Folders are never
changed, so a job may read the table that it rewrites, and frames of an old version stay readable.

Tables in BUCKETED are written by buckets of a hash of their key. Deleting by that key reads and writes the buckets
that hold one of the keys; the next version names the other buckets where they are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from devident.schemas import LEDGERS, TABLES
from devident.session import shuffle_partitions

#: the column whose hash decides the bucket
BUCKETED = {"model_runs": "aggregated_input_id", "scores": "model_run_id"}
BUCKETS = 64
#: files a bucket's rows of one write go to at most, so that a key with very many rows isn't one task
BUCKET_FILES = 4
_SCHEMAS = TABLES | LEDGERS


class Store:
    """Typed tables below one folder. One writer at a time; a second one that publishes meanwhile is refused.

    `buckets` counts for what this store writes; a table keeps what it was written with until it is replaced.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    def _path(self, place: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{place}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, place: str) -> list[str]:
        folder, fs = self._path(place)
        return sorted(entry.getPath().getName() for entry in fs.listStatus(folder)) if fs.exists(folder) else []

    def version(self) -> dict:
        """The newest published version: its number, and per table a list of folders with their buckets."""
        published = [n for n in self._names("_versions") if n.startswith("v-")]
        if not published:
            return {"version": 0, "tables": {}}
        path, fs = self._path(f"_versions/{published[-1]}")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: dict) -> None:
        place, fs = self._path(f"_versions/v-{version['version']:08d}.json")
        draft, _ = self._path(f"_versions/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(version).encode()))
        finally:
            stream.close()
        if fs.exists(place) or not fs.rename(draft, place):
            raise RuntimeError(f"version {version['version']} was published by another writer")

    def _read(self, name: str, parts: list[dict], wanted: set[int] | None = None) -> DataFrame:
        """The rows of folders, of the wanted buckets only if given."""
        paths = []
        for part in parts:
            if part["buckets"] is None:
                paths.append(f"{self.root}/{part['folder']}")
            else:
                chosen = [b for b in part["buckets"] if wanted is None or b in wanted]
                paths += [f"{self.root}/{part['folder']}/bucket={b}" for b in chosen]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMAS[name])
        return self.spark.read.schema(_SCHEMAS[name]).option("recursiveFileLookup", "true").parquet(*paths)

    def table(self, name: str) -> DataFrame:
        """The table's current rows; an empty table before the first write."""
        return self._read(name, self.version()["tables"].get(name, []))

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.table(name) for name in TABLES}

    @contextmanager
    def change(self) -> Iterator[Change]:
        """Changes to any tables, published together at the end of the block; if it fails, none is."""
        change = Change(self, self.version())
        yield change
        self._publish({"version": change.read["version"] + 1, "tables": change.parts})

    def append(self, name: str, rows: DataFrame) -> None:
        """Add complete rows (see `with_defaults`)."""
        with self.change() as change:
            change.append(name, rows)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Write the table anew."""
        with self.change() as change:
            change.replace(name, rows)

    def register(self) -> None:
        register(self.tables())


class Change:
    """What the next version will be. Reads through the store show the version before it."""

    def __init__(self, store: Store, read: dict):
        self.store, self.read = store, read
        self.parts: dict[str, list[dict]] = {name: list(parts) for name, parts in read["tables"].items()}

    def _buckets(self, name: str) -> int:
        """How many buckets the table has: all its folders have the same number."""
        return next((p["of"] for p in self.parts.get(name, []) if p["buckets"] is not None), self.store.buckets)

    def _write(self, name: str, rows: DataFrame, buckets: int) -> list[dict]:
        folder = f"{name}/{uuid.uuid4().hex}"
        target, rows = f"{self.store.root}/{folder}", rows.select(*_SCHEMAS[name].names)
        if name not in BUCKETED:
            rows.write.parquet(target)
            return [{"folder": folder, "buckets": None}]
        dealt = rows.withColumn("bucket", _bucket(BUCKETED[name], buckets))
        tasks = shuffle_partitions(rows.sparkSession)
        dealt.repartition(tasks, "bucket", F.pmod(F.xxhash64("id"), F.lit(BUCKET_FILES))).write.partitionBy("bucket").parquet(target)
        held = sorted(int(n.split("=")[1]) for n in self.store._names(folder) if n.startswith("bucket="))
        return [{"folder": folder, "buckets": held, "of": buckets}] if held else []

    def append(self, name: str, rows: DataFrame) -> None:
        self.parts[name] = self.parts.get(name, []) + self._write(name, rows, self._buckets(name))

    def replace(self, name: str, rows: DataFrame) -> None:
        self.parts[name] = self._write(name, rows, self.store.buckets)

    def delete(self, name: str, gone: DataFrame) -> None:
        """Delete the rows that agree with a row of `gone` in all its columns, one of which is the bucketed key.

        Only buckets of these keys are read and written. The driver gets the numbers of the buckets, which are fixed.
        """
        key, parts, number = BUCKETED[name], self.parts.get(name, []), self._buckets(name)
        touched = {r[0] for r in gone.select(_bucket(key, number)).distinct().collect()}
        meant = [p for p in parts if p["buckets"] is not None and touched & set(p["buckets"])]
        if not meant:
            return
        kept = self.store._read(name, meant, touched).join(gone.distinct(), gone.columns, "left_anti")
        left = [p if p["buckets"] is None else p | {"buckets": [b for b in p["buckets"] if b not in touched]} for p in parts]
        self.parts[name] = [p for p in left if p["buckets"] is None or p["buckets"]] + self._write(name, kept, number)


def _bucket(key: str, number: int):
    return F.pmod(F.xxhash64(F.col(key)), F.lit(number)).cast("int")


def register(tables: Mapping[str, DataFrame]) -> None:
    """Make tables visible to `spark.sql` under their names."""
    for name, table in tables.items():
        table.createOrReplaceTempView(name)
