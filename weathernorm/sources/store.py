"""Keyed tables in Parquet: upsert, find, list, remove, apply.

Rows are dealt to buckets by a hash of their partition columns. A write reads and rewrites only the buckets
that it touches, into a new folder, and then becomes current by one small file, a snapshot, that says which
folder holds each bucket, and the table's schema. Snapshots are numbered, and a number can be taken once:
of two writers at a time one fails, and a write that breaks off leaves the store as it was. Files are never
changed; ``vacuum`` deletes those that no recent snapshot names.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_KEY = ["location_id", "poll", "unit", "source", "process_id", "date", "variable"]
ARTEFACT_KEY = ["location_id", "duration_hour", "hours", "height", "met_type", "buffer_km", "fire_source", "fire_split_regions"]


def scratch(spark: SparkSession) -> str:
    """A folder for tables of one job, below the checkpoint folder that the driver and all executors share. Only where
    that is unset in local mode (tests) a temporary one is made."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(at)
    return at


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the scratch folder: computed once, however often it is read."""
    at = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def same_key(key: Sequence[str], prefix: str = "_") -> Column:
    """Whether the key equals the columns of its names with a prefix; NULLs are equal."""
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same


def upserted(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """The existing rows whose key is not among the new ones, and the new rows; NULL keys are equal."""
    keys = new.select(*(F.col(k).alias(f"_{k}") for k in key)).distinct()
    return existing.join(keys, same_key(key), "left_anti").unionByName(new, allowMissingColumns=True)


def normal_key(value) -> str | None:
    """A key's value as stored: several values become one sorted, comma-joined text."""
    if isinstance(value, list | tuple | set):
        return ",".join(sorted(str(v) for v in value))
    return None if value is None else str(value)


#: Bytes of a row group before compression: what a search may pass over.
ROW_GROUP = 4 << 20
#: Values of the partition columns that a write sends to every task, at most.
FEW = 1_000_000
#: The column by which rows that are :meth:`Store.placed` lie.
PLACE = "_place"


class ConcurrentWrite(RuntimeError):
    """Another writer was faster; nothing was changed."""


class Store:
    """A keyed table below a path that all executors share.

    A key may have many rows, which a write replaces together; with ``unique`` a write that repeats a key is refused.
    Rows are sorted by ``sort_by`` (the key) in files whose row groups have statistics of these columns, and Bloom
    filters, so that a search reads the row groups that may hold what it asks for.
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], partition: Sequence[str] = ("location_id",), schema: T.StructType | str | None = None, buckets: int = 64, unique: bool = False, sort_by: Sequence[str] | None = None) -> None:
        self.spark, self.path, self.key, self.partition, self.buckets = spark, path.rstrip("/"), list(key), list(partition), buckets
        self.unique, self.sort_by = unique, list(sort_by or key)
        empty = schema or ", ".join(f"{k} string" for k in key)
        self.schema = T._parse_datatype_string(empty) if isinstance(empty, str) else empty

    # ---- snapshots ---------------------------------------------------------------------------
    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _snapshots(self) -> list[str]:
        fs, folder = self._at("snapshots")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def _load(self, name: str) -> dict | None:
        text = "\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/snapshots/{name}").collect())
        try:
            return json.loads(text)
        except ValueError:  # a writer broke off here
            return None

    def _current(self) -> tuple[int, dict | None]:
        """The last number taken, and the last whole snapshot."""
        names = self._snapshots()
        whole = next((s for name in reversed(names) if (s := self._load(name)) is not None), None)
        return int(names[-1]) if names else 0, whole

    def _commit(self, number: int, snapshot: dict) -> None:
        fs, path = self._at(f"snapshots/{number + 1:012d}")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise ConcurrentWrite(f"snapshot {number + 1} exists") from e
        out.write(json.dumps(snapshot).encode())
        out.close()

    # ---- reading -----------------------------------------------------------------------------
    def _rows(self, snapshot: dict | None, buckets: Sequence[int] | None = None) -> DataFrame:
        if snapshot is None:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType.fromJson(snapshot["schema"])
        folders = [f"{self.path}/{folder}/_bucket={b}" for b, folder in snapshot["buckets"].items() if buckets is None or int(b) in buckets]
        # with the written schema: nothing is guessed from values or folder names
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """All rows; a store that holds nothing has no rows, and the columns that it was made with."""
        return self._rows(self._current()[1])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in self.partition)), F.lit(self.buckets)).cast("int")

    def find(self, **keys) -> DataFrame:
        """Rows that match every key given (None is no condition); regions that are NULL are "none". Only the bucket
        of a wholly given partition is read."""
        snapshot = self._current()[1]
        wanted = {k: normal_key(v) for k, v in keys.items() if v is not None}
        buckets = None
        if snapshot is not None and all(c in wanted for c in self.partition):
            one = self.spark.createDataFrame([tuple(wanted[c] for c in self.partition)], ", ".join(f"{c} string" for c in self.partition))
            buckets = [one.select(self._bucket()).first()[0]]
        df = self._rows(snapshot, buckets)
        for name, value in wanted.items():
            # in the column's own type, which Parquet's statistics know
            same = F.col(name) == F.lit(value).try_cast(df.schema[name].dataType)
            df = df.filter(same | F.col(name).isNull() if name.endswith("regions") and value == "none" else same)
        return df

    def keys(self) -> DataFrame:
        return self.read().select(*self.key).distinct()

    # ---- writing -----------------------------------------------------------------------------
    def _replace(self, number: int, snapshot: dict | None, rows: DataFrame, touched: Sequence[int] | None, lying: DataFrame | None = None) -> None:
        """Makes ``rows`` the whole content of the buckets touched (None: of all). They are dealt to tasks by bucket, but the rows
        of ``lying``, which come with them, are written by the tasks that have them."""
        folder, schema = f"rows-{uuid.uuid4().hex}", rows.schema
        if rows is not lying:
            # tasks of about one size, whatever the buckets' sizes: large ones are split, small ones share a task
            rows = rows.withColumn("_bucket", self._bucket()).hint("rebalance", F.col("_bucket"))
            if lying is not None:
                rows = rows.unionByName(lying.withColumn("_bucket", self._bucket()), allowMissingColumns=True)
        else:
            rows = rows.withColumn("_bucket", self._bucket())
        writer = rows.sortWithinPartitions("_bucket", *self.sort_by).write.partitionBy("_bucket").option("parquet.block.size", ROW_GROUP)
        for c in self.key:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(f"{self.path}/{folder}")
        fs, path = self._at(folder)
        written = {name.removeprefix("_bucket=") for s in fs.listStatus(path) if (name := s.getPath().getName()).startswith("_bucket=")}
        if touched is None and not written:
            return
        kept = {b: f for b, f in (snapshot or {"buckets": {}})["buckets"].items() if touched is not None and int(b) not in touched}
        self._commit(number, {"schema": schema.jsonValue(), "buckets": kept | {b: folder for b in sorted(written, key=int)}})

    def _apart(self, rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Of stored rows those whose partition columns have the values of some keys, and the others: they need no join and no
        shuffle to be written again. Where the values are too many for each task (``FEW``), all rows are the first."""
        values = written(keys.select(*(F.col(c).alias(f"_{c}") for c in self.partition)).distinct(), "partitions")
        if values.count() > FEW:
            return rows, None
        same = same_key(self.partition)
        return rows.join(F.broadcast(values), same, "left_semi"), rows.join(F.broadcast(values), same, "left_anti")

    def placed(self, rows: DataFrame, parts: int) -> DataFrame:
        """``rows`` with a column ``PLACE``, shuffled by it into at least ``parts`` parts, each of whole series of one bucket: steps by
        it and other columns, and a write of what ``lies`` there, need no other shuffle."""
        each = -(-parts // self.buckets)
        part = F.pmod(F.xxhash64(*(F.col(c).cast("string") for c in self.partition), F.lit(PLACE)), F.lit(each)).cast("int")
        return rows.withColumn(PLACE, self._bucket() * each + part).repartitionById(self.buckets * each, F.col(PLACE))

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())  # at most ``buckets``

    def put(self, new: DataFrame, lies: bool = False) -> None:
        """Replaces what has the same keys. A column of another type than the stored one is an error. The first rows of a store
        can be written by the tasks that have them (``lies``), in a file for each of their buckets: for rows that are :meth:`placed`,
        or in few parts."""
        number, snapshot = self._current()
        if snapshot is not None:
            stored = {f.name: f.dataType for f in T.StructType.fromJson(snapshot["schema"])}
            if other := [f"{f.name}: {f.dataType.simpleString()}" for f in new.schema if stored.get(f.name, f.dataType) != f.dataType]:
                raise TypeError(f"columns of other types are stored: {', '.join(other)}")
        if self.unique and not new.groupBy(*self.key).count().filter("count > 1").isEmpty():
            raise ValueError("a key is repeated")
        if snapshot is None:  # computed once: its buckets are those that were written
            self._replace(number, None, new, None, new if lies else None)
        elif touched := self._touched(new):
            own, others = self._apart(self._rows(snapshot, touched), new)
            self._replace(number, snapshot, upserted(own, new, self.key), touched, others)

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The stored rows that have the values of some columns, the partition's among them; reads their buckets only."""
        snapshot, names = self._current()[1], keys.columns
        rows = self._rows(snapshot, self._touched(keys)) if snapshot is not None else self._rows(None)
        return rows.join(keys.select(*(F.col(k).alias(f"_{k}") for k in names)).distinct(), same_key(names), "left_semi")

    def exchange(self, gone: DataFrame, new: DataFrame) -> None:
        """Takes out the rows that have the values of ``gone`` (columns of the key, the partition's among them) and puts in
        the new ones, in one write of the buckets of both."""
        number, snapshot = self._current()
        touched = sorted({*self._touched(gone), *self._touched(new)})
        if touched:
            names = gone.columns
            match = gone.select(*(F.col(k).alias(f"_{k}") for k in names)).distinct()
            own, others = (None, None) if snapshot is None else self._apart(self._rows(snapshot, touched), gone)
            rows = new if own is None else own.join(match, same_key(names), "left_anti").unionByName(new, allowMissingColumns=True)
            self._replace(number, snapshot, rows, touched, others)

    def put_results(self, results: DataFrame, **constants: str) -> None:
        """Results with constant columns (process, pollutant, unit, source) attached, upserted."""
        self.put(results.withColumns({k: F.lit(v) for k, v in constants.items()}))

    def put_fires(self, results: DataFrame, trajectory_key: Mapping[str, object]) -> None:
        """Fire results of many locations, all stored under one trajectory's key."""
        self.put(results.withColumns({k: F.lit(normal_key(v)).cast("string") for k, v in trajectory_key.items()}))

    def _without(self, number: int, snapshot: dict, gone: DataFrame) -> int:
        n, touched = gone.count(), self._touched(gone)
        if n:
            match = gone.select(*(F.col(k).alias(f"_{k}") for k in self.key)).distinct()
            self._replace(number, snapshot, self._rows(snapshot, touched).join(match, same_key(self.key), "left_anti"), touched)
        return n

    def remove(self, **keys) -> int:
        """Deletes what matches, and says how many rows that were."""
        number, snapshot = self._current()
        return 0 if snapshot is None else self._without(number, snapshot, self.find(**keys))

    def purge(self, payload: Sequence[str]) -> int:
        """Drops rows without any payload, and says how many that were."""
        number, snapshot = self._current()
        if snapshot is None:
            return 0
        rows, empty = self._rows(snapshot), F.lit(True)
        for c in payload:
            empty = empty & F.col(c).isNull()
        n, touched = rows.filter(empty).count(), self._touched(rows.filter(empty))
        if n:
            self._replace(number, snapshot, self._rows(snapshot, touched).filter(~empty), touched)
        return n

    def apply(self, f, **keys) -> int:
        """Replaces each stored series (all rows of one key, without its date) that matches by what a function makes of
        it (a pandas frame in and out, of the same columns); says how many rows were stored."""
        found = self.find(**keys)
        series = [k for k in self.key if k not in ("date", "variable")]
        number, snapshot = self._current()
        if snapshot is None or found.isEmpty():
            return 0
        made = found.groupBy(*series).applyInPandas(f, found.schema)
        touched = self._touched(found)
        match = found.select(*(F.col(k).alias(f"_{k}") for k in series)).distinct()
        others = self._rows(snapshot, touched).join(match, same_key(series), "left_anti")
        self._replace(number, snapshot, others.unionByName(made), touched)
        return self.find(**keys).count()

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the folders that none of the last ``keep`` whole snapshots names, and all older snapshots; says how
        many folders went. Readers and writers of older snapshots must have ended."""
        names = self._snapshots()
        whole = [(name, s) for name in names if (s := self._load(name)) is not None][-keep:]
        if not whole:
            return 0
        used = {folder for _, s in whole for folder in s["buckets"].values()}
        for name in names:
            if name < whole[0][0]:
                fs, path = self._at(f"snapshots/{name}")
                fs.delete(path, False)
        fs, root = self._at("")
        old = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("rows-") and s.getPath().getName() not in used]
        for path in old:
            fs.delete(path, True)
        return len(old)
