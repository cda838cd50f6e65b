"""Scratch tables in the storage that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``.

    A session on one machine that names none, as in tests, gets a temporary
    folder, which goes when Python ends. On a cluster a machine's own folder would
    be lost with the machine, so that there the setting is needed.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.conf.get("spark.app.id", None) or "session"
    if named:
        return f"{named.rstrip('/')}/attestry-{app}"
    if not (spark.conf.get("spark.master", None) or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _local:
        _local[app] = tempfile.mkdtemp(prefix="spark-scratch-")
        atexit.register(shutil.rmtree, _local[app], ignore_errors=True)
    return _local[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, so that an expensive stage runs once and its result
    outlives any executor. An empty frame keeps its schema.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
