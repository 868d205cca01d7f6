"""Tables that change together: immutable folders of Parquet, and one manifest for each commit that names those that count.

A writer puts new folders beside the old and then one manifest, created only if its number is free: readers see all of a
commit or nothing, and of two writers on one state the second is told. Replaced folders stay until vacuum().
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import _fs, delete_file

TRIES, DELAY, FACTOR = 3, 0.1, 2  # attempts of a transaction, seconds before the second, and by how much they grow
SMALL, LARGE = 64 << 20, 256 << 20  # folders below SMALL are compacted to files of about LARGE bytes
SEQ = "__seq"


class Conflict(RuntimeError):
    """Another commit came first."""


@dataclass(frozen=True)
class Snapshot:
    """One state of all tables: of each table its folders (rows and keys, by kind) with their bytes and the commit that
    wrote them, and of each stream the last batch."""

    version: int = 0
    tables: dict[str, list[dict]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def folders(self, name: str, kind: str = "rows") -> list[str]:
        return [p["folder"] for p in self.tables.get(name, []) if p["kind"] == kind]


@dataclass
class Change:
    """What a commit does to a table: rows to add, folders to drop, and for tables with a key the keys whose rows of earlier
    commits no longer count. numbered: rows and keys have their commits' numbers already."""

    add: DataFrame | None = None
    keys: DataFrame | None = None
    drop: frozenset[str] = frozenset()
    numbered: bool = False


class Store:
    """Tables below root. keyed names, for some of them, a column: rows of a key are written together, and only the newest
    commit's that mentions the key count (merge on read)."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, T.StructType], keyed: dict[str, str] | None = None):
        self.spark, self.root, self.tables, self.keyed = spark, root.rstrip("/"), tables, keyed or {}

    # reading

    def _numbers(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.root}/_commits")
        return sorted(int(n[:-5]) for n in (f.getPath().getName() for f in fs.listStatus(p)) if n.endswith(".json") and n[:-5].isdigit()) if fs.exists(p) else []

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest state, or an older one whose manifest is still there."""
        numbers = self._numbers()
        if version is None and not numbers:
            return Snapshot()
        fs, p = _fs(self.spark, f"{self.root}/_commits/{numbers[-1] if version is None else version:012d}.json")
        stream = fs.open(p)
        try:
            return Snapshot(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def _kind(self, name: str) -> T.StructType:
        return T.StructType([*self.tables[name].fields, T.StructField(SEQ, T.LongType())]) if name in self.keyed else self.tables[name]

    def _load(self, folders: list[str], kind: T.StructType) -> DataFrame:
        return self.spark.read.schema(kind).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], kind)

    def _keys(self, name: str, at: Snapshot) -> DataFrame:
        """key and the number of the newest commit that mentions it."""
        key = self.keyed[name]
        kind = T.StructType([self.tables[name][key], T.StructField(SEQ, T.LongType())])
        return self._load(at.folders(name, "keys"), kind).groupBy(key).agg(F.max(SEQ).alias(SEQ))

    def _rows(self, name: str, at: Snapshot, folders: list[str] | None = None) -> DataFrame:
        """Rows that count, with their commit's number where the table has a key."""
        rows = self._load(at.folders(name) if folders is None else folders, self._kind(name))
        parts = at.tables.get(name, [])
        if name not in self.keyed or len(at.folders(name, "keys")) < 2 and len({p.get("commit") for p in parts}) < 2 and all("commit" in p for p in parts):  # rows of one commit all count
            return rows
        return rows.join(self._keys(name, at), [self.keyed[name], SEQ], "left_semi")

    def read(self, name: str, at: Snapshot | None = None) -> DataFrame:
        return self._rows(name, at or self.snapshot()).select(*self.tables[name].names)

    # changes

    def put(self, name: str, rows: DataFrame) -> Change:
        """rows in place of what the table has of their keys; only they are written."""
        return Change(rows, rows.select(self.keyed[name]).distinct())

    def rewritten(self, name: str, at: Snapshot, touched: Callable[[DataFrame], DataFrame], made: Callable[[DataFrame], DataFrame]) -> Change:
        """A change of a table without key: touched keeps the rows that change, made turns rows into their next version; only
        folders with touched rows are written anew."""
        rows = self._load(at.folders(name), self.tables[name]).withColumn("__folder", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+/[^/]+)/[^/]+$", 1)) if at.folders(name) else None
        if rows is None:
            return Change()
        found = [r[0] for r in touched(rows).select("__folder").distinct().collect()]  # names of folders
        return Change(made(self._load(found, self.tables[name])), drop=frozenset(found)) if found else Change()

    def without(self, name: str, at: Snapshot, keys: DataFrame, on: str) -> Change:
        """The table without the rows whose column `on` is among keys (a column of that name)."""
        if self.keyed.get(name) == on:
            return Change(keys=keys.select(on).distinct())
        return self.rewritten(name, at, lambda rows: rows.join(keys, on, "left_semi"), lambda rows: rows.join(keys, on, "left_anti"))

    def updated(self, name: str, at: Snapshot, where: Column, made: Callable[[DataFrame], DataFrame]) -> Change:
        return self.rewritten(name, at, lambda rows: rows.filter(where), made)

    # commits

    def _write(self, df: DataFrame, name: str, kind: str, commit: int) -> dict:
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        fs, p = _fs(self.spark, f"{self.root}/{folder}")
        return {"folder": folder, "kind": kind, "bytes": fs.getContentSummary(p).getLength(), "commit": commit}

    def commit(self, at: Snapshot, changes: dict[str, Change], batch: tuple[str, int] | None = None) -> Snapshot:
        """The state after the changes of one or several tables, all of them based on `at`. Raises Conflict if another
        commit has come since; what was written then belongs to no state."""
        number = at.version + 1
        tables = {n: list(parts) for n, parts in at.tables.items()}
        for name, change in changes.items():
            parts = [p for p in tables.get(name, []) if p["folder"] not in change.drop]
            numbered = lambda df, change=change: df if change.numbered else df.withColumn(SEQ, F.lit(number).cast("long"))
            if change.add is not None:
                rows = numbered(change.add) if name in self.keyed else change.add
                parts.append(self._write(rows.select(*self._kind(name).names), name, "rows", number))
            if change.keys is not None:
                parts.append(self._write(numbered(change.keys).select(self.keyed[name], SEQ), name, "keys", number))
            tables[name] = parts
        made = Snapshot(number, tables, at.batches | ({batch[0]: batch[1]} if batch else {}))
        self._publish(made)
        return made

    def _publish(self, made: Snapshot) -> None:
        """The manifest under its number, by a rename that fails if there is one. On file systems without such a rename
        writers must take turns."""
        fs, folder = _fs(self.spark, f"{self.root}/_commits")
        fs.mkdirs(folder)
        jvm = self.spark.sparkContext._jvm
        Path = jvm.org.apache.hadoop.fs.Path
        side = fs.makeQualified(Path(folder, f".{uuid.uuid4().hex}"))
        out = fs.create(side, False)
        out.write(json.dumps({"version": made.version, "tables": made.tables, "batches": made.batches}).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(side.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(side, fs.makeQualified(Path(folder, f"{made.version:012d}.json")), none)
        except Exception as e:
            fs.delete(side, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(f"commit {made.version} is taken") from e
            raise

    def transact(self, make: Callable[[Snapshot], dict[str, Change]], batch: tuple[str, int] | None = None) -> Snapshot:
        """commit() of what make makes of the newest state, tried again on the state after a conflict. A stream's batch
        (name, number) that was committed before changes nothing."""
        for attempt in range(TRIES):
            at = self.snapshot()
            if batch and at.batches.get(batch[0], -1) >= batch[1]:
                return at
            try:
                return self.commit(at, make(at), batch)
            except Conflict:
                if attempt + 1 == TRIES:
                    raise
                time.sleep(DELAY * FACTOR**attempt)
        raise AssertionError

    def append(self, **rows: DataFrame) -> Snapshot:
        """Rows added to several tables at once; in tables with a key they take the place of their keys' rows."""
        return self.transact(lambda _: {n: self.put(n, df) if n in self.keyed else Change(df) for n, df in rows.items()})

    # upkeep

    def compact(self, name: str, small: int = SMALL, large: int = LARGE) -> Snapshot:
        """Small folders of a table as one, without rows that no longer count; a reader sees the same rows."""

        def make(at: Snapshot) -> dict[str, Change]:
            few = [p for p in at.tables.get(name, []) if p["kind"] == "rows" and p["bytes"] < small]
            keys = at.folders(name, "keys")
            if len(few) < 2 and len(keys) < 2:
                return {}
            files = -(-sum(p["bytes"] for p in few) // large) or 1
            rows = self._rows(name, at, [p["folder"] for p in few]).coalesce(files)
            return {name: Change(rows, self._keys(name, at) if keys else None, frozenset([*(p["folder"] for p in few), *keys]), True)}

        return self.transact(make)

    def vacuum(self, keep: int = 1, older_than: timedelta = timedelta(days=1)) -> int:
        """Deletes manifests but the newest `keep`, and folders that none of those names and that are older than any writer
        may take; returns how many folders went."""
        numbers, gone = self._numbers(), 0
        used = {p["folder"] for n in numbers[-keep:] for parts in self.snapshot(n).tables.values() for p in parts}
        for n in numbers[:-keep]:
            delete_file(self.spark, f"{self.root}/_commits/{n:012d}.json")
        before = (time.time() - older_than.total_seconds()) * 1000
        for name in self.tables:
            fs, p = _fs(self.spark, f"{self.root}/{name}")
            for f in fs.listStatus(p) if fs.exists(p) else []:
                if f"{name}/{f.getPath().getName()}" not in used and f.getModificationTime() <= before:
                    fs.delete(f.getPath(), True)
                    gone += 1
        return gone
