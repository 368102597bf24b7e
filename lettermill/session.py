"""Session helpers: the shared scratch folder, cutting lineage, spreading small inputs."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "lettermill", cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and local runs; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_own: dict[str, str] = {}
_written: list[str] = []


def scratch(spark: SparkSession) -> str:
    """The folder every executor shares: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine may leave it unset; it gets a folder that goes with the process. Elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="lettermill-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
        path = "file://" + _own[sc.applicationId]
    return path.rstrip("/")


def release(spark: SparkSession) -> int:
    """Delete what :func:`cut` wrote, once no frame built on it is needed any more; the number of folders."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_written)
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the plan above starts from files that survive a lost executor."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, least: int = 4 << 20) -> DataFrame:
    """Give an input of under ``least`` bytes a core one partition a core before a CPU-bound Python stage; a larger one is left as it lies.

    Sizes are the file sizes the optimiser knows, so nothing runs to find out.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(want) if size < want * least else df


def merged(df: DataFrame) -> DataFrame:
    """Marks a side that grows with the data: joins with it sort and merge, whatever size the optimiser guesses (it does not count ``explode``)."""
    return df.hint("merge")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bounded(df: DataFrame, most: int) -> DataFrame:
    """``df`` as a local relation, safe to broadcast; raises where it has more than ``most`` rows, so nothing is dropped."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows where a small table is needed")
    return df.sparkSession.createDataFrame(rows, df.schema)


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """One row a key, chosen by the rows' own content so that it does not depend on partitioning. Rows with a null key form one key."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_best"))
    return best.select(*keys, "_best.*").select(*df.columns)
