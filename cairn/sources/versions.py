"""Tables in versions: a commit adds files and says which keys they replace, so that it writes no more than its own rows.

A table is a folder. Rows lie in data/part=<id>/bucket=<n>, the keys that a commit replaces in gone/<id>, and log/<version>.json says
which of them a version consists of. A row counts if no later commit has replaced its key; that is decided where it is read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.sizes import maybe_broadcast

#: Times that a commit looks for the next free version.
ATTEMPTS = 100


class Conflict(RuntimeError):
    """Another writer has changed what this one has read."""


class VersionedTable:
    """A table whose rows are replaced by the values of one column, and lie in folders by a hash of one (the same or another).

    Any number of writers may commit at a time. Readers see one version as a whole, the last one unless they name another.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, by: str = "source", bucket_by: str | None = None, buckets: int = 32):
        self.spark, self.path, self.schema, self.by, self.bucket_by, self.buckets = spark, path.rstrip("/"), schema, by, bucket_by or by, buckets
        self._where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._where(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _names(self, folder: str) -> list[str]:
        at = self._where(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        """The last version, -1 where nothing has been committed."""
        return max((int(n[:-5]) for n in self._names("log") if n[0].isdigit() and n.endswith(".json")), default=-1)

    def state(self, version: int) -> dict:
        """What a version consists of: parts (id, version, buckets) and gone (id, version, buckets of the keys)."""
        if version < 0:
            return {"parts": [], "gone": []}
        stream = self._fs.open(self._where(f"{self.path}/log/{version:020d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, state: dict) -> bool:
        """Whether this writer has made that version: the file appears whole, and only for one writer."""
        jvm = self.spark.sparkContext._jvm
        draft, final = (self._where(f"{self.path}/log/{name}") for name in (f".{uuid.uuid4().hex}", f"{version:020d}.json"))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename may replace what is there, a link never does
                local = [jvm.java.nio.file.Paths.get(self._fs.makeQualified(p).toUri()) for p in (final, draft)]
                jvm.java.nio.file.Files.createLink(*local)
            else:
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
        except Exception:
            if not self._fs.exists(final):
                raise
            return False
        finally:
            self._fs.delete(draft, False)
        return True

    def _commit(self, change: Callable[[dict, int], dict]) -> int:
        """Makes the next version from the last one, again if another writer has been faster; change may raise Conflict."""
        for _ in range(ATTEMPTS):
            last = self.version()
            if self._publish(last + 1, change(self.state(last), last + 1)):
                return last + 1
        raise Conflict(f"no free version of {self.path} in {ATTEMPTS} attempts")

    # rows

    def bucket(self, value: Column) -> Column:
        """The folder of a value; null has its own."""
        return F.when(value.isNull(), -1).otherwise(F.pmod(F.xxhash64(value), F.lit(self.buckets))).cast("int")

    def _write(self, rows: DataFrame, sort: tuple[str, ...] = ()) -> dict:
        part = uuid.uuid4().hex
        out = rows.withColumn("bucket", self.bucket(F.col(self.bucket_by)))
        out = out.sortWithinPartitions("bucket", *sort) if sort else out
        out.write.partitionBy("bucket").parquet(f"{self.path}/data/part={part}")
        return {"id": part, "buckets": sorted(int(n.split("=")[1]) for n in self._names(f"data/part={part}") if n.startswith("bucket="))}

    def replace(self, rows: DataFrame, gone: DataFrame | None = None, expect: int | None = None, sort: tuple[str, ...] = (), keys: DataFrame | None = None) -> int:
        """Commits rows in place of all rows with their keys, and without any row in place of the keys in gone; the new version.

        keys, where given, has the keys of rows in its one column, so that rows, which may be dear to make, are only made to be written.
        With expect, the version that rows were made from, a Conflict is raised if a later one has replaced a key that hashes like one
        of these. Without it the later commit counts. A writer that ends before its commit has changed nothing that is read.
        """
        keys = (rows if keys is None else keys).select(self.by)
        keys = keys if gone is None else keys.unionAll(gone.select(self.by))
        keys = keys.distinct().withColumn("bucket", self.bucket(F.col(self.by)))
        mark = uuid.uuid4().hex
        keys.write.parquet(f"{self.path}/gone/{mark}")
        touched = sorted(r["bucket"] for r in self.spark.read.parquet(f"{self.path}/gone/{mark}").select("bucket").distinct().collect())  # at most buckets + 1
        part = self._write(rows, sort)

        def change(state: dict, version: int) -> dict:
            if expect is not None and any(g["version"] > expect and set(g["buckets"]) & set(touched) for g in state["gone"]):
                raise Conflict(f"{self.path} has changed since version {expect}")
            parts = [{**part, "version": version}] if part["buckets"] else []
            return {"parts": state["parts"] + parts, "gone": [*state["gone"], {"id": mark, "version": version, "buckets": touched}]}

        return self._commit(change)

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version; with buckets, of those folders only."""
        return self._rows(self.state(self.version() if version is None else version), buckets).drop("bucket", "part")

    def _rows(self, state: dict, buckets: list[int] | None = None) -> DataFrame:
        """The rows that count, with part and bucket."""
        paths, versions = [], {}
        for p in state["parts"]:
            own = p["buckets"] if buckets is None else [b for b in p["buckets"] if b in buckets]
            paths += [f"{self.path}/data/part={p['id']}/bucket={b}" for b in own]
            versions[p["id"]] = p["version"]
        schema = f"{self.schema}, part string, bucket int"
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)
        first = min(versions.values())
        gone = [g for g in state["gone"] if g["version"] > first]  # nothing that is read is older
        if not gone:
            return rows
        marks = self.spark.read.schema(f"{self.by} {rows.schema[self.by].dataType.simpleString()}").parquet(*[f"{self.path}/gone/{g['id']}" for g in gone])
        number = lambda of, names: F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[of]
        folder = F.regexp_extract(F.col("_metadata.file_path"), r"/gone/([0-9a-f]+)/", 1)
        last = marks.select(F.col(self.by).alias("_by"), number(folder, {g["id"]: g["version"] for g in gone}).alias("_gone")).groupBy("_by").agg(F.max("_gone").alias("_gone"))
        joined = rows.join(maybe_broadcast(last), F.col(self.by).eqNullSafe(F.col("_by")), "left")
        return joined.where(F.col("_gone").isNull() | (number(F.col("part"), versions) >= F.col("_gone"))).drop("_by", "_gone")

    def compact(self) -> int:
        """Writes all rows that count into one part; rows that others commit meanwhile stay as they are. The new version."""
        base = self.version()
        state = self.state(base)
        old = {p["id"] for p in state["parts"]}
        part = self._write(self._rows(state).drop("bucket", "part").repartition(self.bucket(F.col(self.bucket_by))))

        def change(now: dict, version: int) -> dict:
            if not old <= {p["id"] for p in now["parts"]}:
                raise Conflict(f"{self.path} has been compacted since version {base}")
            later = [p for p in now["parts"] if p["id"] not in old]
            return {"parts": ([{**part, "version": base}] if part["buckets"] else []) + later, "gone": [g for g in now["gone"] if g["version"] > base]}

        return self._commit(change)

    def vacuum(self) -> None:
        """Deletes what the last version does not use. No reader of an older one and no writer may be at work."""
        last = self.version()
        state = self.state(last)
        for folder, kept in (("data", {f"part={p['id']}" for p in state["parts"]}), ("gone", {g["id"] for g in state["gone"]}), ("log", {f"{last:020d}.json"})):
            for name in set(self._names(folder)) - kept:
                self._fs.delete(self._where(f"{self.path}/{folder}/{name}"), True)
