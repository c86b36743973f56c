"""Where intermediate tables go, and how Python workers find this package."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
#: Python workers give the memory of freed arrays back instead of keeping it between tasks.
ALLOCATOR = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}
#: Rows that go to a Python worker at once.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Python workers on this machine find the package, which a cluster gets with --py-files or on its image, and hold little memory between tasks."""
    env = spark.sparkContext.environment
    for name, value in ALLOCATOR.items():
        env.setdefault(name, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # Spark's default; whole texts make such batches large
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, a temporary folder if all of Spark is in this one process, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.gettempdir()}/lexarium-checkpoints"
    return folder.rstrip("/")


class Cuts:
    """Tables written to the shared folder to cut the lineage; a later stage reads them again after any lost executor."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
        self.names: list[str] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        schema = df.schema
        self.names.append(name)
        del df
        self.collect()
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(conf).delete(path, True)

    def collect(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished stages.  On a cluster a first pass alone leaves those of the last job; a second one a moment later finds them."""
        gc.collect()
        for pause in (0.3, 0):
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(pause)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Most bytes of a table that is broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, a written table of ids and numbers, marked for broadcast if its rows take at most BROADCAST_BYTES; a larger one is left to the planner, which shuffles it."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 16 if t in ("string", "binary") else F.lit(16) for c, t in df.dtypes), F.lit(0))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES else df


def crc_part(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have."""
    while wanted.lower() in {c.lower() for c in df.columns}:
        wanted += "_"
    return wanted
