"""Session helpers: building a session, reading the input tables, shared scratch
space, staged tables.

Nothing here is specific to one operator; every operator module takes an
existing ``SparkSession`` / ``DataFrame`` and returns a ``DataFrame``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every session of ours wants, on a laptop or a cluster.  Shuffle
# partition counts are *not* set here for clusters: AQE coalesces small
# partitions and splits skewed ones at run time.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # the JVM does not compile longer methods; an operator whose rows need one is then generated in pieces
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str = "local[8]", app: str = "tallyspark",
                  shuffle_partitions: int = 8, extra: dict | None = None) -> SparkSession:
    """Session for tests and the bench (local mode)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.driver.memory", "16g"))
    for k, v in {**BASE_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings to a session we did not build."""
    for k, v in BASE_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked settings are left as the cluster has them
            pass


TASKS_PER_CORE = 4
BROADCAST_MEASURED = 64 << 20


def compiled_rows(spark: SparkSession) -> None:
    """Settings of the registered queries, in a session that we did not build too: wide row logic is run as compiled code;
    stages have several tasks a core, so that none waits for one that is longer (tasks of a MB at least); and a side of a
    join that was measured to be small is sent to the tasks, so that the other side needs no shuffle of its own."""
    name = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(name, BASE_CONF[name])
    tasks = str(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionNum", tasks)
    spark.conf.set("spark.sql.files.minPartitionNum", tasks)
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", str(BROADCAST_MEASURED))


TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables and stream checkpoints.

    Uses ``spark.checkpoint.dir`` as configured for the cluster.  Only when it is
    unset *and* the session is local (tests, the bench) do we create one, once per application
    (the setting itself cannot be changed in a running session).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on this cluster")
        app = spark.sparkContext.applicationId
        d = _own_roots.get(app) or tempfile.mkdtemp(prefix="tallyspark-ckpt-")
        _own_roots[app] = d
    spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Runtime settings for what is run inside."""
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def batch_rows(spark: SparkSession, rows: int):
    """Rows of an Arrow batch for what is run inside."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows)})


def stage_table(df: DataFrame, name: str = "stage", codec: str | None = None) -> DataFrame:
    """Cut lineage with a Parquet table written in the shared scratch folder: columnar and
    compressed (cheaper than a row checkpoint), readable after an executor loss, and
    every consumer reads the same rows.  ``codec``: other than the session's."""
    path = scratch_path(df.sparkSession, name)
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return df.sparkSession.read.parquet(path)
