"""State tables under one snapshot: a run writes beside what is in force, and one file, put in place last, puts all of it in force.

``<root>/_snapshots/<n>.json`` names every table's folders; the greatest number is in force, and readers, retries and later runs go by
one snapshot only. A run that dies at any point leaves folders that no snapshot names: the next run neither sees nor overwrites them, and
``retain`` drops them. Of two runs that started from one snapshot the second to commit fails.

A keyed table is hashed by its key into buckets, a folder each. Replacing the rows of some keys reads and writes the buckets of these keys; the
others' folders are named again by the new snapshot. A snapshot holds a few numbers a bucket, and buckets are a setting of the store:
pick them for some hundred MB each. A log table gets a folder a run, and ``fold`` makes one of them. Data goes through Spark, snapshots
through the file system Spark uses for that path.
"""

from __future__ import annotations

import json
import subprocess
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


@dataclass
class Table:
    """``folders`` are (folder, its buckets in force); no key means folders without buckets."""

    schema: dict[str, Any]
    key: str | None = None
    buckets: int = 1
    folders: list[tuple[str, list[int]]] = field(default_factory=list)


@dataclass
class Snapshot:
    number: int = 0
    tables: dict[str, Table] = field(default_factory=dict)
    #: The last batch of each stream that is in the tables.
    batches: dict[str, int] = field(default_factory=dict)


class Conflict(RuntimeError):
    """Another run has committed since this one began."""


class StateStore:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    @property
    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, folder: str) -> list[str]:
        """What lies in a folder; none if there is none."""
        fs, path = self._fs, self._path(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def size(self, folder: str) -> int:
        return int(self._fs.getContentSummary(self._path(folder)).getLength())

    def delete(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def numbers(self) -> list[int]:
        return [int(x[:-5]) for x in self.names("_snapshots") if x[:-5].isdigit() and x.endswith(".json")]

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The snapshot in force, or an earlier one that is still there; an empty one if there is none."""
        n = max(self.numbers(), default=0) if number is None else number
        if not n:
            return Snapshot()
        stream = self._fs.open(self._path(f"_snapshots/{n:012d}.json"))
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        tables = {k: Table(t["schema"], t["key"], t["buckets"], [(f, b) for f, b in t["folders"]]) for k, t in said["tables"].items()}
        return Snapshot(n, tables, said["batches"])

    def put(self, snapshot: Snapshot) -> None:
        """Puts a snapshot in force: written beside, then renamed to its number, which must be free."""
        said = {"tables": {k: vars(t) for k, t in snapshot.tables.items()}, "batches": snapshot.batches}
        fs, tmp, to = self._fs, self._path(f"_snapshots/.{uuid.uuid4().hex}"), self._path(f"_snapshots/{snapshot.number:012d}.json")
        out = fs.create(tmp, False)
        out.write(json.dumps(said).encode())
        out.close()
        if fs.exists(to) or not fs.rename(tmp, to):
            fs.delete(tmp, False)
            raise Conflict(f"snapshot {snapshot.number} of {self.root} is there already")

    def begin(self) -> Transaction:
        return Transaction(self)

    def read(self, name: str, schema: StructType | str) -> DataFrame:
        """The table in force, or an empty one of the schema."""
        return self.begin().read(name, schema)

    def current(self, name: str) -> DataFrame:
        """The table in force; it must exist."""
        if name not in self.snapshot().tables:
            raise ValueError(f"no table {name!r} below {self.root}")
        return self.read(name, "x int")

    log = read

    def write(self, name: str, df: DataFrame, key: str | None = None) -> DataFrame:
        """Exchanges one table as a run of its own."""
        run = self.begin()
        run.write(name, df, key)
        run.commit()
        return self.current(name)

    def wipe(self, *names: str) -> None:
        """Empties tables; earlier snapshots keep theirs."""
        run = self.begin()
        run.wipe(*names)
        run.commit()

    def retain(self, snapshots: int = 1) -> None:
        """Keeps the snapshot in force and ``snapshots`` before it, and drops all folders that none of them names. No other run may be under way."""
        numbers = sorted(self.numbers())
        for n in numbers[: -1 - snapshots]:
            self.delete(f"_snapshots/{n:012d}.json")
        used = {(k, f, b) for n in numbers[-1 - snapshots :] for k, t in self.snapshot(n).tables.items() for f, bs in t.folders for b in (bs or [-1])}
        folders = {x[:2] for x in used}
        for name in self.names(""):
            for f in self.names(name) if not name.startswith("_") else ():
                if (name, f) not in folders:
                    self.delete(f"{name}/{f}")
                    continue
                for b in self.names(f"{name}/{f}"):
                    if b.startswith("_b=") and (name, f, int(b[3:])) not in used:
                        self.delete(f"{name}/{f}/{b}")
        self.delete("_passing")


class Transaction:
    """One run's view and changes: what it read first, with what it has written since."""

    def __init__(self, store: StateStore):
        self.store, self.spark, self.base = store, store.spark, store.snapshot()
        self.tables, self.batches = dict(self.base.tables), dict(self.base.batches)
        self.id = uuid.uuid4().hex[:12]

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(buckets)).cast("int")

    def _read(self, name: str, table: Table, folders: list[tuple[str, list[int]]]) -> DataFrame:
        schema = StructType.fromJson(table.schema)
        paths = [f"{self.store.root}/{name}/{f}" + (f"/_b={b}" if table.key else "") for f, bs in folders for b in (bs if table.key else [0])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, name: str, schema: StructType | str, keys: DataFrame | None = None) -> DataFrame:
        """The table as this run sees it; with ``keys``, a column of the table's keys, only the buckets these lie in."""
        table = self.tables.get(name)
        if table is None:
            return self.spark.createDataFrame([], schema)
        if keys is None or not table.key:
            return self._read(name, table, table.folders)
        wanted = set(self._buckets_of(keys, table))
        return self._read(name, table, [(f, left) for f, bs in table.folders if (left := [b for b in bs if b in wanted])])

    def _buckets_of(self, keys: DataFrame, table: Table) -> list[int]:
        """Numbers of buckets, as many as there are buckets at most."""
        return sorted(r[0] for r in keys.select(self._bucket(keys.columns[0], table.buckets)).distinct().collect())

    def passing(self, name: str, df: DataFrame) -> DataFrame:
        """A table of this run only: computed once and read back."""
        path = f"{self.store.root}/_passing/{self.id}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _put(self, name: str, df: DataFrame, table: Table) -> list[tuple[str, list[int]]]:
        """Writes rows below a new folder; the folder with its buckets, or nothing if there are no rows."""
        folder = f"{self.id}-{uuid.uuid4().hex[:6]}"
        path = f"{self.store.root}/{name}/{folder}"
        if not table.key:
            df.write.parquet(path)
            return [(folder, [])]
        df.withColumn("_b", self._bucket(table.key, table.buckets)).hint("rebalance", "_b").write.partitionBy("_b").parquet(path)
        found = sorted(int(x[3:]) for x in self.store.names(f"{name}/{folder}") if x.startswith("_b="))
        return [(folder, found)] if found else []

    def write(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """Exchanges the whole table."""
        table = Table(df.schema.jsonValue(), key, self.store.buckets if key else 1)
        table.folders = self._put(name, df, table)
        self.tables[name] = table

    def replace(self, name: str, key: str, keys: DataFrame, rows: DataFrame, keep: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Exchanges rows of the buckets that ``keys``, whose column is named like the key, lie in: of the rows there those stay that ``keep`` leaves (by default those of
        other keys), and ``rows``, all of such keys, are added."""
        table = self.tables.get(name)
        if table is None:
            self.write(name, rows, key)
            return
        if table.key != key:
            raise ValueError(f"{name} is hashed by {table.key}, not {key}")
        touched = self._buckets_of(keys, table)
        if not touched:
            return
        old = self._read(name, table, [(f, left) for f, bs in table.folders if (left := [b for b in bs if b in set(touched)])])
        kept = keep(old) if keep else old.join(keys.select(key).distinct(), key, "left_anti")
        rest = [(f, left) for f, bs in table.folders if (left := [b for b in bs if b not in set(touched)])]
        self.tables[name] = Table(table.schema, key, table.buckets, rest + self._put(name, kept.select(*rows.columns).unionByName(rows), table))

    def append(self, name: str, df: DataFrame) -> None:
        """Adds a folder to a log table."""
        table = self.tables.get(name) or Table(df.schema.jsonValue())
        self.tables[name] = Table(table.schema, None, 1, table.folders + self._put(name, df, table))

    def fold(self, name: str, how: Callable[[DataFrame], DataFrame], most: int = 16) -> None:
        """Makes one folder of a log table that has more than ``most``; ``how`` may sum its rows up."""
        table = self.tables.get(name)
        if table and len(table.folders) > most:
            self.tables[name] = Table(table.schema, None, 1, self._put(name, how(self._read(name, table, table.folders)), table))

    def wipe(self, *names: str) -> None:
        for n in names:
            if t := self.tables.get(n):
                self.tables[n] = Table(t.schema, t.key, t.buckets)

    def commit(self, batch: tuple[str, int] | None = None) -> int:
        """Puts all changes of the run in force at once; ``batch`` names the batch of a stream that they come from."""
        batches = self.batches | ({batch[0]: batch[1]} if batch else {})
        number = self.base.number + 1
        self.store.put(Snapshot(number, self.tables, batches))
        self.store.delete(f"_passing/{self.id}")
        return number

    def written_bytes(self, names: Iterable[str] | None = None) -> dict[str, tuple[int, int]]:
        """Of each table, bytes that this run has written, and bytes of the table now."""
        out = {}
        for name in names or self.tables:
            sizes = [(f, sum(self.store.size(f"{name}/{f}/_b={b}") for b in bs) if self.tables[name].key else self.store.size(f"{name}/{f}")) for f, bs in self.tables[name].folders]
            out[name] = sum(n for f, n in sizes if f.startswith(self.id)), sum(n for _, n in sizes)
        return out


def latest(runs: DataFrame, order: str = "run_id") -> DataFrame:
    """The newest report."""
    return runs.agg(F.max_by(F.struct(*runs.columns), order).alias("x")).select("x.*")


def work_dir(spark: SparkSession) -> str:
    """The cluster's shared folder as ``spark.checkpoint.dir`` names it; a temporary one where that is unset and the master is local, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def resolve_commit(root: str) -> str | None:
    """Commit of a local working copy, null where there is none."""
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], cwd=root, capture_output=True, text=True, timeout=10, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.strip() or None if done.returncode == 0 else None


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, fields by name, nulls written."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
