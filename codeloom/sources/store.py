"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset and everything runs on one machine, a folder of its own; on a cluster, an error."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: executors need a folder that they share")
        path = f"file://{tempfile.mkdtemp(prefix='codeloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written and read back: a lost executor costs no recomputation, and the plan starts anew."""
    path = f"{shared_dir(df.sparkSession)}/codeloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._codeloom_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes what stored() wrote. Nothing that is still to run may read it."""
    if path := getattr(df, "_codeloom_path", None):
        spark = df.sparkSession
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


class Tables:
    """stored() for the steps of one operator, which deletes them once its result is stored."""

    def __init__(self) -> None:
        self.made: list[DataFrame] = []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        self.made.append(stored(df, name))
        return self.made[-1]

    def last(self, df: DataFrame, name: str) -> DataFrame:
        out = stored(df, name)
        self.drop()
        return out

    def drop(self, keep: DataFrame | None = None) -> None:
        for df in self.made:
            if df is not keep:
                forget(df)
        self.made = []
