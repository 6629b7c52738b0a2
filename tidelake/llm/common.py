"""Shared plumbing: table access, tables in the cluster's shared folder, column handling."""

from __future__ import annotations

import atexit
import gc
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship_code(spark: SparkSession) -> None:
    """Give executors this package, once a context, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_tidelake_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="tidelake-code-")  # on the driver, which serves it while it lives
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder, "tidelake.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._tidelake_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares (``spark.checkpoint.dir``).

    Only a local master without that setting gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="tidelake-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


_written: list[tuple[SparkSession, str]] = []


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            delete_path(spark, path)
        except Exception:  # the JVM may be gone at exit; the folder is scratch space
            return


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, swept when the driver ends."""
    path = f"{shared_dir(spark)}/tidelake-{label}-{uuid.uuid4().hex[:12]}"
    _written.append((spark, path))
    return path


class Stage:
    """A table written once to the shared folder and read back.

    It cuts lineage: a lost executor costs at most the tasks it was running."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        self.schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)
        _written[:] = [x for x in _written if x[1] != self.path]


def staged(df: DataFrame, label: str) -> DataFrame:
    return Stage(df, label).read()


def forget_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of about ``per_block`` rows; at least one, no upper cap."""
    return max(1, math.ceil(rows / per_block))


def spread(df: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Deal rows out evenly by a unique key, into as many partitions as shuffles have."""
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, F.xxhash64(key))
