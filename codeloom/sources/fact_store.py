"""Facts kept between runs, by content. A file's key is the hash of its path, its code and the detectors' version, so a file that
has not changed, or has come back, or has moved to another table, is not parsed again.

Each run that meets new keys writes their facts and the keys themselves (a file may have no facts) to a folder of its own, both
split by the first digits of the key, and then names that folder in a new list of folders. The list is written under a new
number at once, so a run that breaks off leaves the last list in force, and nothing that a reader may hold is changed. compact()
writes what the given files still need to one folder and deletes the others."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..detect import engine
from .store import forget, stored
from .tables import spread

_KEYS = "key string"
_KEPT = "key string, " + engine.FACTS.removeprefix("file_id string, ")
#: Change it with any change of what detectors find
VERSION = "3"
#: Rows that a task writes, more or less
TOGETHER = 100_000
#: Times that a run tries to name its folder while others do so too
TRIES = 20


class FactStore:
    """found = FactStore(spark, path, "security").facts(files). All work is Spark's; the driver holds the names of folders."""

    def __init__(self, spark: SparkSession, path: str, *detectors: str, version: str = VERSION, splits: int = 16):
        self.spark, self.path, self.detectors, self.version, self.splits = spark, path.rstrip("/"), detectors, version, splits
        #: Files of the last call of facts(), and those of them that were parsed
        self.files = self.parsed = 0

    # --- folders

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _numbers(self) -> list[int]:
        fs, at = self._fs(), self._at("lists")
        if not fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())

    def folders(self) -> list[str]:
        """Those in force."""
        numbers = self._numbers()
        if not numbers:
            return []
        rows = self.spark.read.text(f"{self.path}/lists/{numbers[-1]:09d}").collect()  # a line for each folder
        return sorted(r.value for r in rows if r.value)

    def _commit(self, folders: list[str], alone: bool = False) -> None:
        """A new list, in one rename: the folders besides those in force, or alone. Where another run takes the number first, what
        that run has named is kept and the next number is tried."""
        fs = self._fs()
        fs.mkdirs(self._at("lists"))
        for _ in range(TRIES):
            number = max([0, *self._numbers()]) + 1
            named = folders if alone else [*self.folders(), *folders]
            draft, to = self._at(f"drafts/{uuid.uuid4().hex}"), self._at(f"lists/{number:09d}")
            self.spark.createDataFrame([(f,) for f in named] or [("",)], "value string").coalesce(1).write.text(draft.toString())
            if not fs.exists(to) and fs.rename(draft, to):
                return
            fs.delete(draft, True)
        raise RuntimeError(f"the lists of {self.path} are taken by other runs")

    def _read(self, part: str, schema: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, split int")
        top = f"{self.path}/{part}"
        found = self.spark.read.schema(f"{schema}, run string, split int").option("basePath", top)
        return found.parquet(*(f"{top}/run={f}" for f in folders)).drop("run")

    def _write(self, df: DataFrame, folder: str, part: str, keys: int) -> None:
        """keys: how many there are; the more, the more tasks share a split."""
        shares = 1 + keys // (TOGETHER * self.splits)
        task = F.col("split") * shares + F.pmod(F.xxhash64("key"), F.lit(shares)).cast("int")
        df.repartitionById(self.splits * shares, task).sortWithinPartitions("split", "key").write.partitionBy("split").parquet(f"{self.path}/{part}/run={folder}")

    # --- facts

    def keyed(self, files: DataFrame) -> DataFrame:
        """file_id, path, code, key, split. Null code has no key and no facts; a null path is told from an empty one."""
        path = F.col("path") if "path" in files.columns else F.lit(None).cast("string")
        head = F.lit(f"{self.version}|{','.join(sorted(self.detectors))}|")
        key = F.sha2(F.concat(head, F.coalesce(F.concat(F.lit("="), path), F.lit("-")), F.lit("\0"), F.col("code")), 256)
        split = F.pmod(F.conv(F.substring(key, 1, 4), 16, 10).cast("int"), F.lit(self.splits))
        return files.select("file_id", path.alias("path"), "code", key.alias("key"), split.alias("split")).filter("code is not null")

    def facts(self, files: DataFrame) -> DataFrame:
        """engine.facts of the files, of which those alone are parsed that no run has seen. Files that are gone have none."""
        folders, keyed = self.folders(), self.keyed(files)
        known = self._read("keys", _KEYS, folders)
        self.files = keyed.count()
        new = keyed.hint("merge").join(known, ["key", "split"], "left_anti")
        # one file for each key: equal files have equal facts
        new = stored(new.groupBy("key", "split").agg(F.first("path").alias("path"), F.first("code").alias("code")), "new-files")
        try:
            self.parsed = new.count()
            if self.parsed:
                folder = uuid.uuid4().hex
                found = engine.facts(spread(new).select(F.col("key").alias("file_id"), "path", "code"), *self.detectors).withColumnRenamed("file_id", "key")
                split = F.pmod(F.conv(F.substring("key", 1, 4), 16, 10).cast("int"), F.lit(self.splits))
                self._write(found.withColumn("split", split), folder, "facts", self.parsed)
                self._write(new.select("key", "split"), folder, "keys", self.parsed)
                self._commit([folder])
                folders = [*folders, folder]
        finally:
            forget(new)
        kept = self._read("facts", _KEPT, folders)
        return keyed.select("file_id", "key", "split").hint("merge").join(kept, ["key", "split"]).select(*(c.split()[0] for c in engine.FACTS.split(", ")))

    def compact(self, files: DataFrame) -> int:
        """Keeps what these files need, in one folder, and deletes the rest; the number of keys that went. Nobody else may read."""
        folders = self.folders()
        needed = self.keyed(files).select("key", "split").distinct()
        keys = self._read("keys", _KEYS, folders)
        before, folder = keys.count(), uuid.uuid4().hex
        self._write(self._read("facts", _KEPT, folders).hint("merge").join(needed, ["key", "split"], "left_semi"), folder, "facts", before)
        self._write(keys.hint("merge").join(needed, ["key", "split"], "left_semi").distinct(), folder, "keys", before)
        self._commit([folder], alone=True)
        fs = self._fs()
        for f in folders:
            for part in ("facts", "keys"):
                fs.delete(self._at(f"{part}/run={f}"), True)
        for number in self._numbers()[:-1]:
            fs.delete(self._at(f"lists/{number:09d}"), True)
        return before - self._read("keys", _KEYS, [folder]).count()
