"""What the operators share: the shared folder, written intermediate tables, crc32 folds."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietfield.plans.tables import shared_dir

PACKAGE = Path(__file__).resolve().parents[1]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    sc = spark.sparkContext
    root = str(PACKAGE.parent)
    if root not in sc.environment.get("PYTHONPATH", "").split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, sc.environment.get("PYTHONPATH")) if x)
        if not sc.master.startswith("local[") and sc.master != "local":
            out = Path(tempfile.mkdtemp()) / f"{PACKAGE.name}.zip"
            with zipfile.ZipFile(out, "w") as z:
                for p in PACKAGE.rglob("*.py"):
                    z.write(p, p.relative_to(PACKAGE.parent))
            sc.addPyFile(str(out))


class Scratch:
    """Tables that an operator writes to the shared folder to cut lineage: lost executors re-read, not recompute.

    ``drop`` removes tables (and lets Spark clean the shuffles behind them) when nothing reads them any more.
    What a returned DataFrame still reads stays in the shared folder, as with checkpoint().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        ship_code(spark)

    def write(self, df: DataFrame, name: str, codec: str = "zstd", compact: bool = False) -> DataFrame:
        """``compact``: in a quarter of the files, for tables that are small beside the input.

        spark.sql.shuffle.partitions grows with the input (the user sets it so), and so does the number of files.
        """
        path = f"{self.root}/{name}"
        if compact:
            df = df.coalesce(max(parallelism(self.spark) // 4, 2 * self.spark.sparkContext.defaultParallelism))
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.free()

    def free(self) -> None:
        """Shuffle files go once the driver's garbage is collected; ask for it now rather than in half an hour."""
        for _ in range(2):  # the first round finds what the second lets go
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.2)


#: Groups that may count as large: each has 1/LARGE of all rows at least, so no more than LARGE are broadcast.
LARGE, LEAST = 2000, 32


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """Rows (a written table) with what their groups say, keys without nulls; ``size`` is the number of a group's rows.

    Groups with more than 1/LARGE of all rows are broadcast and so are their rows spared a shuffle; others are joined.
    """
    limit = max(rows.count() // LARGE, LEAST)
    large = F.broadcast(groups.where(F.col(size) > limit))
    rest = rows.join(large, keys, "left_anti").join(groups.where(F.col(size) <= limit), keys)
    return rest.unionByName(rows.join(large, keys))


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
