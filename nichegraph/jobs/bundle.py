"""Steps of a workflow as tables in a folder, with what each cost; a run that was killed goes on where it stopped."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Of the layout of tables and manifests; bundles of another version are computed anew.
VERSION = 1
METRICS = "step string, rows long, seconds double, peak_mb double, resumed boolean, key string"


def files_key(spark: SparkSession, path: str) -> str:
    """A hash of the names, sizes and times of a path's files, whose contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    row = files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    return hashlib.sha256("/".join(map(str, row)).encode()).hexdigest()


def peak_mb(spark: SparkSession) -> float | None:
    """The most heap and off-heap memory that an executor has held so far, by its heartbeats; None before the first."""
    executors, found = spark.sparkContext._jsc.sc().statusStore().executorList(False), []
    for i in range(executors.size()):
        metrics = executors.apply(i).peakMemoryMetrics()
        if metrics.isDefined():
            found.append(sum(metrics.get().getMetricValue(m) for m in ("JVMHeapMemory", "JVMOffHeapMemory")) / 2**20)
    return max(found, default=None)


class Bundle:
    """A folder with a table per step, a manifest per finished step, and one of the whole, published last.

    A step's key is a hash of its name, parameters, the layout's version and the keys of the steps that it follows. A step
    whose manifest has the key is read; another is computed, and with it all that follow, as their keys change.
    A step's manifest goes before its table is written and comes after, so a table that a killed run left half written is never read.
    """

    def __init__(self, spark: SparkSession, folder: str, restart: bool = False):
        self.spark, self.folder, self.restart = spark, folder.rstrip("/"), restart
        self.keys: dict[str, str] = {}
        self.manifests: list[dict] = []

    def _file(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.json")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _write(self, name: str, what: dict) -> None:
        fs, path = self._file(name)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(what, indent=1, sort_keys=True).encode()))
        out.close()

    def _read(self, name: str) -> dict:
        fs, path = self._file(name)
        if not fs.exists(path):
            return {}
        try:
            return json.loads(self.spark.read.text(str(path), wholetext=True).first()[0])
        except (ValueError, TypeError):  # cut short by a killed run
            return {}

    def step(self, name: str, make: Callable[[], DataFrame], after: tuple[str, ...] = (), **parameters) -> DataFrame:
        """The step's table, as it was written in this run or, with the same key, in an earlier one."""
        asked = {"version": VERSION, "step": name, "parameters": parameters, "after": {a: self.keys[a] for a in after}}
        key = self.keys[name] = hashlib.sha256(json.dumps(asked, sort_keys=True).encode()).hexdigest()
        manifest, start = {} if self.restart else self._read(f"steps/{name}"), time.time()
        resumed = manifest.get("key") == key
        if not resumed:
            fs, path = self._file(f"steps/{name}")
            fs.delete(path, False)
            rows = Observation(name)
            df = make()
            df.observe(rows, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{self.folder}/{name}")
            manifest = asked | {"key": key, "schema": json.loads(df.schema.json()), "rows": rows.get["rows"], "seconds": round(time.time() - start, 3), "peak_mb": peak_mb(self.spark)}
            self._write(f"steps/{name}", manifest)
        self.manifests.append(manifest | {"resumed": resumed})
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def metrics(self) -> DataFrame:
        """(step, rows, seconds, peak_mb, resumed, key): what each step cost when it was computed; peak_mb up to its end."""
        return self.spark.createDataFrame([tuple(m[c.split()[0]] for c in METRICS.split(", ")) for m in self.manifests], METRICS)

    def publish(self) -> None:
        """Writes the metrics' table and then the manifest of the whole."""
        self.metrics().coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/timings")
        self._write("manifest", {"version": VERSION, "steps": self.manifests, "seconds": sum(m["seconds"] for m in self.manifests)})
