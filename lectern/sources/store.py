"""A stored collection of chunks that is changed by whole units: a source, a document.

Rows lie in slots by a hash of their unit.  A change writes the slots that it touches anew into a folder
of its own and then commits that folder as the next version in one step; readers see the last committed version
of each slot, so a job that is lost on the way leaves the old state, and running it again leaves the new one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.storage import drop_table, materialize


class Conflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class Store:
    """Rows of ``schema`` under ``path``, changed by units: equal values of the columns ``unit``, null being a value.

    ``slots`` bounds what a change reads and writes besides its own rows: a slot should hold about a
    gigabyte.  It is fixed when the store is first written.  What is kept in the driver is a number for each slot.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, unit: tuple[str, ...] = ("collection", "source"), slots: int = 64):
        self.spark, self.path, self.unit, self.slots = spark, path.rstrip("/"), unit, slots
        known = spark.createDataFrame([], schema).schema
        self.schema = T.StructType([T.StructField(f.name, f.dataType) for f in known.fields])
        self.names = self.schema.fieldNames()

    # What is stored

    def _file_system(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def versions(self) -> dict[int, tuple[int, str]]:
        """The last committed version of each slot that was ever written, and the folder that it was written to."""
        files, folder = self._file_system(f"{self.path}/commits")
        if not files.exists(folder):
            return {}
        rows = self.spark.read.schema("version int, folder string, slots array<int>").json(f"{self.path}/commits")
        last = rows.select(F.struct("version", "folder").alias("v"), F.explode("slots").alias("slot")).groupBy("slot").agg(F.max("v").alias("v"))
        return {r["slot"]: tuple(r["v"]) for r in last.collect()}

    def _slots(self, versions: dict[int, tuple[int, str]], slots: list[int] | None = None) -> DataFrame:
        by_folder: dict[str, list[int]] = {}
        for slot, (_, folder) in versions.items():
            if slots is None or slot in slots:
                by_folder.setdefault(folder, []).append(slot)
        if not by_folder:
            return self.spark.createDataFrame([], self.schema)
        kept = T.StructType([*self.schema.fields, T.StructField("__folder", T.StringType()), T.StructField("__slot", T.IntegerType())])
        live = F.lit(False)
        for folder, own in sorted(by_folder.items()):
            live = live | ((F.col("__folder") == folder) & F.col("__slot").isin(own))
        # A condition on the folders alone: nothing but live slots is read.
        return self.spark.read.schema(kept).parquet(f"{self.path}/data").where(live).select(*self.names)

    def read(self) -> DataFrame:
        """The rows as they stand now; a later change doesn't alter what this one shows until ``vacuum``."""
        return self._slots(self.versions())

    # Changes

    def slot(self) -> Column:
        return F.pmod(F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in self.unit)), F.lit(self.slots)).cast("int")

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.slot()).distinct().collect())

    def _commit(self, rows: DataFrame, slots: list[int], versions: dict[int, tuple[int, str]]) -> None:
        if not slots:
            return
        version, folder = max((v for v, _ in versions.values()), default=0) + 1, f"w{uuid.uuid4().hex}"
        placed = rows.select(*self.names, self.slot().alias("__slot"))
        # A slot's rows go to a few tasks each, by another hash than the slot's, so that no task holds a hot unit alone.
        parts = placed.repartition("__slot", F.pmod(F.xxhash64(*self.names[:1]), F.lit(4)))
        parts.write.partitionBy("__slot").parquet(f"{self.path}/data/__folder={folder}")
        # Only one writer can create the file of a version; the rename makes the whole of it visible.
        files, made = self._file_system(f"{self.path}/commits/{version:08d}.json")
        _, taken = self._file_system(f"{self.path}/claims/{version:08d}")
        if files.exists(made) or not files.createNewFile(taken):
            raise Conflict(f"version {version} of {self.path} is taken")
        _, draft = self._file_system(f"{self.path}/claims/{version:08d}.json")
        out = files.create(draft, True)
        out.write(bytearray(json.dumps({"version": version, "folder": folder, "slots": slots}).encode()))
        out.close()
        files.mkdirs(made.getParent())
        if not files.rename(draft, made):
            raise Conflict(f"version {version} of {self.path} is taken")

    def unlock(self) -> None:
        """Free what a writer that was lost between its claim and its commit has claimed; no other may be writing."""
        files, claims = self._file_system(f"{self.path}/claims")
        files.delete(claims, True)

    def _same_unit(self, left: DataFrame, right: DataFrame) -> Column:
        same = F.lit(True)
        for c in self.unit:
            same = same & left[c].eqNullSafe(right[f"__u_{c}"])
        return same

    def replace(self, units: DataFrame, rows: DataFrame | None = None, covered: bool = False) -> None:
        """``rows`` in place of all rows of ``units`` and of their own units; a unit without rows is gone.

        ``covered`` says that ``units`` names all units that the rows have.  Else the rows are written beforehand,
        as they tell their units; they are worked out once in either case.
        """
        versions = self.versions()
        fresh = rows if rows is None or covered else materialize(rows.select(*self.names), "fresh")
        own = units.select(*self.unit) if fresh is rows else units.select(*self.unit).unionByName(fresh.select(*self.unit))
        slots = self._touched(own)
        named = own.distinct().select(*(F.col(c).alias(f"__u_{c}") for c in self.unit))
        stored = self._slots(versions, slots)
        kept = stored.join(named, self._same_unit(stored, named), "left_anti")
        try:
            self._commit(kept if fresh is None else kept.unionByName(fresh.select(*self.names)), slots, versions)
        finally:
            if fresh is not rows:
                drop_table(fresh)

    def upsert(self, rows: DataFrame, key: tuple[str, ...] = ("collection", "chunk_id")) -> None:
        """``rows`` in place of the stored ones of their keys, whatever unit those are in; of repeated new keys one stays."""
        versions = self.versions()
        fresh = rows.select(*self.names).dropDuplicates(list(key))
        keys = fresh.select(*(F.col(c).alias(f"__k_{c}") for c in key))
        stored = self._slots(versions)
        same = F.lit(True)
        for c in key:
            same = same & stored[c].eqNullSafe(keys[f"__k_{c}"])
        found = stored.join(keys, same, "left_semi").select(*self.unit)
        slots = self._touched(found.unionByName(fresh.select(*self.unit)))
        old = self._slots(versions, slots)
        same = F.lit(True)
        for c in key:
            same = same & old[c].eqNullSafe(keys[f"__k_{c}"])
        self._commit(old.join(keys, same, "left_anti").unionByName(fresh), slots, versions)

    def remove(self, gone: Column) -> DataFrame:
        """Rows that fulfil ``gone`` leave; the units they were in with how many each has lost (the driver holds a row a unit)."""
        versions = self.versions()
        stored = self._slots(versions)
        lost = stored.where(gone).groupBy(*self.unit).agg(F.count("*").alias("deleted")).collect()
        schema = T.StructType([*(self.schema[c] for c in self.unit), T.StructField("deleted", T.LongType())])
        report = self.spark.createDataFrame(lost, schema)
        slots = self._touched(report)
        self._commit(self._slots(versions, slots).where(~F.coalesce(gone, F.lit(False))), slots, versions)
        return report

    def vacuum(self) -> None:
        """Delete what no reader of the present state needs; readers that began before may fail."""
        live = {(slot, folder) for slot, (_, folder) in self.versions().items()}
        files, data = self._file_system(f"{self.path}/data")
        for written in files.listStatus(data) if files.exists(data) else []:
            folder = written.getPath().getName().removeprefix("__folder=")
            for slot in files.listStatus(written.getPath()) if written.isDirectory() else []:
                name = slot.getPath().getName()
                if name.startswith("__slot=") and (int(name.removeprefix("__slot=")), folder) not in live:
                    files.delete(slot.getPath(), True)
