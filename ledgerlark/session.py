"""Spark session helpers.

On a cluster the session comes from the platform; these helpers only fill in
settings that are unset (tests, bench, local runs).  Lineage is cut with
reliable ``checkpoint()`` into ``spark.checkpoint.dir`` — read from the session,
set here only when missing.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # windows-1254 (Turkish) CSV files need the legacy charset list
    "spark.sql.legacy.javaCharsets": "true",
}

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerlark") -> SparkSession:
    """A local[*] session for tests and the bench."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("LEDGERLARK_DRIVER_MEM", "16g")))
    for key, value in _LOCAL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``: a folder that driver and executors share.

    Only a ``local`` master, where there is one machine, gets a scratch folder when the
    setting is missing; any other session must name one.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="ledgerlark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss); never localCheckpoint."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) under the shared checkpoint folder and read it back.

    Cuts lineage like a checkpoint, and the reread table has a known size, so that joins on it
    are planned by it.  The files stay until the folder's own retention removes them.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/ledgerlark/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def drop_table(kept: DataFrame) -> None:
    """Remove a table that ``keep_table`` wrote; only for tables that no later step and no returned DataFrame reads."""
    context = kept.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(kept.kept_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, an execution's shuffle files go when it ends (not when the driver next collects garbage).

    For steps that each write a table and are followed by steps that read it.
    """
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_RELEASE)
        else:
            spark.conf.set(_RELEASE, before)
