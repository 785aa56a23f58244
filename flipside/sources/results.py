"""Run results, the results store with skip-what-is-done, and example export."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flipside.schema import RUN_RESULT
from flipside.session import checkpointed


def read_run_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per run file; missing parts of a file become NULL, missing files are skipped."""
    runs = (
        spark.read.option("ignoreMissingFiles", "true").schema(RUN_RESULT).json(paths, multiLine=True)
    )
    # The run is named by the folder that holds its result file.
    return runs.withColumn("run", F.element_at(F.split(F.input_file_name(), "/"), -2))


def explode_training_log(runs: DataFrame) -> DataFrame:
    return runs.select("run", F.explode("training_log").alias("s")).select("run", "s.epoch", "s.loss")


def unnest_metrics(runs: DataFrame, column: str = "metrics") -> DataFrame:
    return runs.select("run", F.explode(column).alias("metric", "value"))


def pending_jobs(jobs: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Jobs without a stored result."""
    return jobs.join(done.select(*keys), list(keys), "left_anti")


@dataclass
class _Version:
    """What a store holds: data folders, each with the masks written since, and the keys' schema."""

    number: int
    parts: list[dict]
    schema: str | None


class _Store:
    """A results store: data folders that never change and numbered version files that name the valid ones.

    A version file is written aside and renamed to the next number at the end,
    so a write that stops half-way changes nothing, and of two writes that
    began with the same version the second one finds its number taken.
    """

    _renaming = threading.Lock()  # local file systems rename over an existing file

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def version(self) -> _Version:
        log = self._path("versions")
        numbers = [int(f.getPath().getName()) for f in self.fs.listStatus(log) if f.getPath().getName().isdigit()] if self.fs.exists(log) else []
        if not numbers:
            return _Version(0, [], None)
        stream = self.fs.open(self._path(f"versions/{max(numbers)}"))
        try:
            found = json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return _Version(max(numbers), found["parts"], found["schema"])

    def commit(self, parts: list[dict], schema: str, after: int) -> bool:
        """Make `parts` version after + 1; False when another write was first."""
        aside, final = self._path(f"versions/_{uuid.uuid4().hex}"), self._path(f"versions/{after + 1}")
        stream = self.fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps({"parts": parts, "schema": schema}).encode()))
        finally:
            stream.close()
        with self._renaming:
            done = not self.fs.exists(final) and self.fs.rename(aside, final)
        if not done:
            self.fs.delete(aside, False)
        return done

    def write(self, df: DataFrame, by: Sequence[str] = ()) -> str:
        """A new folder with the rows of `df`."""
        name = f"data/write={uuid.uuid4().hex}"
        df.write.partitionBy(*by).parquet(f"{self.path}/{name}")
        return name

    def read(self, version: _Version) -> DataFrame | None:
        """The rows of a version; masks take away the partitions that were replaced later."""
        if version.schema is None:
            return None
        schema = T.StructType.fromJson(json.loads(version.schema))
        by_mask: dict[tuple, list[str]] = {}
        for part in version.parts:
            by_mask.setdefault(tuple(part["masks"]), []).append(f"{self.path}/{part['data']}")  # appends share their masks
        out = self.spark.createDataFrame([], schema)
        for masks, folders in by_mask.items():
            rows = self.spark.read.option("basePath", f"{self.path}/data").schema(schema).parquet(*folders).select(*schema.names)
            if masks:
                gone = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/{m}" for m in masks]).drop("write")
                named = gone.withColumnsRenamed({c: f"__{c}" for c in gone.columns})
                rows = rows.join(named, [rows[c].eqNullSafe(named[f"__{c}"]) for c in gone.columns], "left_anti")
            out = out.unionByName(rows)
        return out


def read_results(spark: SparkSession, path: str) -> DataFrame | None:
    """What is stored; None when nothing is."""
    store = _Store(spark, path)
    return store.read(store.version())


def write_results(df: DataFrame, path: str, keys: Sequence[str], mode: str = "keep", partition_by: Sequence[str] = ("method", "dataset_id")) -> DataFrame:
    """Store results under their keys and return what is stored for the keys of `df`.

    mode='keep' adds only rows whose keys are not stored yet; 'overwrite'
    replaces the rows with the same keys and leaves the others of a partition
    as they are; 'fetch_only' never writes.  Of rows with equal keys in one call
    one is stored.  A call shows all of its rows at once, at its end; when
    another call on the store ended meanwhile, it starts again from that state.
    Replaced and half-written data folders stay until the store is removed.
    """
    if mode not in ("keep", "overwrite", "fetch_only"):
        raise ValueError(f"unknown mode {mode!r}")
    spark, keys = df.sparkSession, list(keys)
    store = _Store(spark, path)
    wanted = df.select(*keys).distinct()
    if mode == "fetch_only":
        stored = store.read(store.version())
        return (stored if stored is not None else df.limit(0)).join(wanted, keys, "left_semi")
    # Computed once, whatever the number of attempts.
    one = checkpointed(df.dropDuplicates(keys))
    while True:
        now = store.version()
        stored, parts = store.read(now), now.parts
        fresh = one if stored is None else one.select(*stored.columns)
        if stored is not None and mode == "keep":
            fresh = fresh.join(stored.select(*keys), keys, "left_anti")
        elif stored is not None:
            touched = one.select(*partition_by).distinct()
            rest = stored.join(touched, list(partition_by), "left_semi").join(one.select(*keys), keys, "left_anti")
            fresh = fresh.unionByName(rest)
            mask = store.write(touched)
            parts = [{"data": p["data"], "masks": [*p["masks"], mask]} for p in parts]
        data = store.write(fresh, partition_by)
        if store.commit([*parts, {"data": data, "masks": []}], now.schema or one.schema.json(), now.number):
            break
    return store.read(store.version()).join(wanted, keys, "left_semi")


def append_results(df: DataFrame, path: str, partition_by: Sequence[str] = ("method", "dataset_id")) -> None:
    """Add all rows of `df`, visible at once when the call ends."""
    store = _Store(df.sparkSession, path)
    data = store.write(df, partition_by)
    while True:
        now = store.version()
        if store.commit([*now.parts, {"data": data, "masks": []}], now.schema or df.schema.json(), now.number):
            return


def example_rows(pairs: DataFrame, features: Sequence[str], n: int = 5, order: Sequence[str] = ("dataset_id", "row_id")) -> DataFrame:
    """First n rows with inputs, true and predicted delta and both results."""

    def arr(*cols):
        return F.array(*cols)

    top = pairs.orderBy(*order).limit(n)
    return top.select(
        *order,
        arr(*[F.col(f) for f in features]).alias("query_x"),
        F.col("y_cf_class").alias("target_label"),
        arr(*[F.col(f"d_{f}") for f in features]).alias("true_delta"),
        arr(*[F.col(f"p_{f}") for f in features]).alias("pred_delta"),
        arr(*[F.col(f) + F.col(f"d_{f}") for f in features]).alias("x_cf_true"),
        arr(*[F.col(f) + F.col(f"p_{f}") for f in features]).alias("x_cf_pred"),
    )


def export_examples(pairs: DataFrame, features: Sequence[str], path: str, n: int = 5) -> None:
    example_rows(pairs, features, n).coalesce(1).write.mode("overwrite").json(path)
