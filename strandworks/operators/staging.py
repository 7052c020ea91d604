"""Tables written between rounds, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a local folder for a local master and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return path or os.path.join(tempfile.gettempdir(), "checkpoints")


_PATHS: list[str] = []


def staged(df: DataFrame) -> DataFrame:
    """Written as Parquet and read back: lineage ends here and survives a lost executor."""
    path, schema = f"{shared_dir(df.sparkSession)}/round-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    _PATHS.append(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def staged_all(*dfs: DataFrame) -> list[DataFrame]:
    """Several tables written at once, so that small ones share the executors."""
    with ThreadPoolExecutor(len(dfs)) as pool:
        return list(pool.map(staged, dfs))


_SHARED: dict[tuple, list[tuple]] = {}


def shared(spark: SparkSession, key: tuple, build) -> list[DataFrame]:
    """Tables of ``build()``, written once for each ``key`` of an application and read again as long as they are there."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def there(path):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    key = (spark.sparkContext.applicationId, *key)
    if key not in _SHARED or not all(there(path) for path, _ in _SHARED[key]):
        def write(df):
            path = f"{shared_dir(spark)}/shared-{uuid.uuid4().hex}"
            df.write.parquet(path)
            return path, df.schema

        made = build()
        with ThreadPoolExecutor(len(made)) as pool:
            out = list(pool.map(write, made))
        _SHARED[key] = out
    return [spark.read.schema(schema).parquet(path) for path, schema in _SHARED[key]]


@contextmanager
def rounds(spark: SparkSession):
    """Tables staged inside are deleted at the end, but for what the yielded function keeps."""
    begin, kept = len(_PATHS), []

    def keep(df: DataFrame) -> DataFrame:
        out = staged(df)
        kept.append(_PATHS[-1])
        return out

    yield keep
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _PATHS[begin:] if p not in kept]:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    _PATHS[begin:] = kept
