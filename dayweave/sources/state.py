"""State that batches are written over: one row a key, kept in plain Parquet files.

Keys are dealt to buckets. A batch rewrites the buckets that it touches, beside the old files, and a manifest that names the files of every
bucket makes the result visible in one step; readers of an older version are not disturbed. A manifest also holds the last batch of each
writer, so a batch that a restarted stream sends again changes nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayweave.sources.shared import staged


class ConcurrentWrite(RuntimeError):
    """Another writer made the version first; merge again to build on it."""


class KeyedTable:
    """A table of one row per keys below path; of rows of one key that with the greatest order stays, of equals the one written later.

    Null keys are a key like any other. A bucket should hold some hundred megabytes: choose as many as the table will need, since the
    number is fixed with the first batch (ValueError if another one is asked for later).
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = 64):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    # ---- versions ----

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def versions(self) -> list[int]:
        fs, at = self._fs(), self._at("versions")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _manifest(self, version: int | None = None) -> dict | None:
        found = self.versions()
        if version is None and not found:
            return None
        version = found[-1] if version is None else version
        if version not in found:
            raise ValueError(f"{self.path} has no version {version}; it has {found}")
        return json.loads("\n".join(r.value for r in self.spark.read.text(self._at("versions", f"{version:012d}.json").toString()).collect()))

    def _publish(self, manifest: dict) -> None:
        fs, name = self._fs(), f"{manifest['version']:012d}.json"
        draft, final = self._at("versions", f".{name}.{uuid.uuid4().hex}"), self._at("versions", name)
        out = fs.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise ConcurrentWrite(f"version {manifest['version']} of {self.path} exists already")

    # ---- reading ----

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        places = [f"{self.path}/data/{place}/_bucket={b}" for b, place in sorted(manifest["places"].items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the last one); ValueError if nothing was ever written, or no such version is kept."""
        manifest = self._manifest(version)
        if manifest is None:
            raise ValueError(f"{self.path} has no version yet")
        return self._rows(manifest)

    # ---- writing ----

    def merge(self, batch: DataFrame, batch_id: int, writer: str = "") -> bool:
        """Writes a batch over the table; False, and no change, if this writer's batch was written before.

        Only the buckets that hold a key of the batch are read and written. New columns are null in older rows.
        """
        old = self._manifest() or {"version": -1, "buckets": self.buckets, "batches": {}, "places": {}, "schema": None}
        if old["buckets"] != self.buckets:
            raise ValueError(f"{self.path} has {old['buckets']} buckets, not {self.buckets}")
        if batch_id <= old["batches"].get(writer, -1):
            return False
        batch = staged(batch, "keyed-batch")
        where = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(where).distinct().collect())  # at most a row a bucket
        rows, schema = batch.withColumn("_new", F.lit(1)), batch.schema
        if old["schema"]:
            rows = rows.unionByName(self._rows(old, touched).withColumn("_new", F.lit(0)), allowMissingColumns=True)
            schema = T.StructType([f for f in rows.schema.fields if f.name != "_new"])
        names = [f"`{f.name}`" for f in schema.fields]
        rank = F.struct(F.col(f"`{self.order}`"), F.col("_new"), F.xxhash64(*[F.to_json(F.struct(*names))]))
        best = rows.groupBy(*[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(self.keys)]).agg(F.max_by(F.struct(*names), rank).alias("_row"))
        place = f"{old['version'] + 1:012d}-{uuid.uuid4().hex}"
        if touched:
            out = best.select("_row.*").withColumn("_bucket", where)
            out.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{place}")
        self._publish({
            "version": old["version"] + 1, "buckets": self.buckets, "batches": {**old["batches"], writer: batch_id},
            "places": {**old["places"], **{str(b): place for b in touched}}, "schema": T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]).jsonValue(),
        })
        return True

    def sink(self, rows: DataFrame, checkpoint: str, writer: str = ""):
        """Starts a stream that merges every batch of rows; restarts repeat at most the last batch, which then changes nothing."""
        return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: self.merge(batch, batch_id, writer) and None).start()

    def vacuum(self, keep: int = 2) -> int:
        """Deletes all but the last `keep` versions and the files that only they name (those of failed merges as well): how many folders went."""
        fs, found = self._fs(), self.versions()
        kept = found[-keep:]
        named = {place for v in kept for place in self._manifest(v)["places"].values()}
        gone = [s.getPath() for s in fs.listStatus(self._at("data")) if s.getPath().getName() not in named] if fs.exists(self._at("data")) else []
        for v in found:
            if v not in kept:
                fs.delete(self._at("versions", f"{v:012d}.json"), False)
        for path in gone:
            fs.delete(path, True)
        return len(gone)
