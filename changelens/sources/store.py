"""A stored table with upserts: hash buckets of Parquet under versions that are swapped whole.

A version is a manifest that names, for each bucket, the folder its rows are in. An upsert reads
and rewrites only the buckets its keys fall into, with a Spark write into a new folder, and then
puts a new manifest beside the old ones by one rename. Until then readers see the version
before, and a write that breaks off leaves nothing but a folder that is deleted. Of two writers
that start from the same version the second one fails at the rename.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from changelens.sources.tables_sink import shared_folder, stored
from changelens.sources.upsert import first_wins, last_wins


class StoredTable:
    """A table at `path`, one row for each value of `keys`. The number of buckets is the
    table's for good; choose it so that a bucket fits a task."""

    def __init__(self, spark: SparkSession, keys: list[str], path: str | None = None, buckets: int = 32) -> None:
        self.spark, self.keys, self.buckets = spark, list(keys), buckets
        self.path = (path or shared_folder(spark)).rstrip("/")

    # --- versions ------------------------------------------------------------------------

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        where, fs = self._hadoop(f"{self.path}/_versions")
        if not fs.exists(where):
            return []
        return sorted(int(n[:-5]) for n in (s.getPath().getName() for s in fs.listStatus(where)) if n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "schema": None, "folders": {}}
            version = known[-1]
        # The file is one line; Spark reads it from wherever the table is.
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{version:08}.json").first()[0])

    def _commit(self, version: int, schema: StructType, folders: dict[str, str]) -> None:
        text = json.dumps({"version": version, "schema": schema.jsonValue(), "folders": folders})
        draft, fs = self._hadoop(f"{self.path}/_versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        final, _ = self._hadoop(f"{self.path}/_versions/{version:08}.json")
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:  # this rename never replaces a file
            context.rename(draft, final, self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            fs.delete(draft, False)
            raise

    # --- reading -------------------------------------------------------------------------

    def _rows(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of some buckets, or of all; None if there are none."""
        folders = [f for b, f in manifest["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return None
        return self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(*[f"{self.path}/{f}" for f in sorted(folders)])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        manifest = self._manifest(version)
        if manifest["schema"] is None:
            raise ValueError("nothing has been written yet")
        rows = self._rows(manifest)
        return self.spark.createDataFrame([], StructType.fromJson(manifest["schema"])) if rows is None else rows

    # --- writing -------------------------------------------------------------------------

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _rewrite(self, manifest: dict, schema: StructType, rows: DataFrame, touched: list[int]) -> int:
        """A version in which the touched buckets hold these rows (with _bucket)."""
        folder = f"data/{uuid.uuid4().hex}"
        where, fs = self._hadoop(f"{self.path}/{folder}")
        try:
            rows.repartition(max(1, len(touched)), "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            written = {s.getPath().getName().split("=")[1] for s in fs.listStatus(where) if "=" in s.getPath().getName()}
            folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | {b: f"{folder}/_bucket={b}" for b in written}
            self._commit(manifest["version"] + 1, schema, folders)
        except Exception:
            fs.delete(where, True)
            raise
        return manifest["version"] + 1

    def upsert(self, batch: DataFrame, order: str, pick: str = "last", replace: bool = True) -> int:
        """The batch's rows over the stored ones; the new version's number. Of rows of one key in
        the batch the last by `order` counts, or the first. Without replace, stored rows stay."""
        manifest = self._manifest()
        fresh = self._bucketed((last_wins if pick == "last" else first_wins)(batch, self.keys, order).select(*batch.columns))
        schema = batch.schema if manifest["schema"] is None else StructType.fromJson(manifest["schema"])
        if [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in batch.schema]:
            raise ValueError("the batch has other columns than the table")
        before = self._rows(manifest)
        if not replace and before is not None:
            fresh = fresh.join(before.select(*self.keys), self.keys, "left_anti").select(*fresh.columns)
        fresh = stored(fresh)
        touched = [r[0] for r in fresh.select("_bucket").distinct().collect()]  # as many as buckets at most
        old = self._rows(manifest, touched)
        if old is not None:
            old = self._bucketed(old).join(fresh.select(*self.keys), self.keys, "left_anti").select(*fresh.columns)
        return self._rewrite(manifest, schema, fresh if old is None else old.unionByName(fresh), touched)

    def delete(self, keys: DataFrame) -> int:
        """The version without the rows that match `keys` (all or some of the key columns)."""
        manifest = self._manifest()
        rows = self.read()
        gone = stored(self._bucketed(rows.join(keys.distinct(), keys.columns, "left_semi").select(*rows.columns)).select(*self.keys, "_bucket"))
        touched = [r[0] for r in gone.select("_bucket").distinct().collect()]
        left = self._rows(manifest, touched)
        if left is None:
            return self._rewrite(manifest, rows.schema, self._bucketed(rows.where("false")), [])
        return self._rewrite(manifest, rows.schema, self._bucketed(left).join(gone.select(*self.keys), self.keys, "left_anti").select(*rows.columns, "_bucket"), touched)


def write_generations(facts: DataFrame, path: str | None = None) -> str:
    """Facts with a column `generation`, a folder for each; salted so that a large generation is
    several tasks' work."""
    path = path or shared_folder(facts.sparkSession)
    facts.repartition("generation", F.pmod(F.xxhash64(*facts.columns), F.lit(8))).write.mode("append").partitionBy("generation").parquet(path)
    return path


def active_rows(facts: DataFrame, pointers: DataFrame, repository: int) -> DataFrame:
    """The facts of a repository's active generation: pointers (repository, generation) are the
    dimension, and its row prunes the folders that are read when the query runs."""
    return facts.join(F.broadcast(pointers.where(F.col("repository") == repository)), "generation")
