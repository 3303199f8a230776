"""Sessions: a local one for tests and benches, and shipping the package to executors that can't import it."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession, functions as F

_SHIPPED: set[str] = set()


def build(cpus: str | int = "*", partitions: int = 8, memory: str = "8g", **conf) -> SparkSession:
    """A local session with the settings that the queries expect anywhere: adaptive plans and UTC."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("tessera")
    for k, v in ({"spark.sql.shuffle.partitions": partitions, "spark.sql.adaptive.enabled": "true", "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"} | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors as a zip, once for each application (Spark distributes and fetches it)."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        with tempfile.NamedTemporaryFile(suffix=".zip", prefix="tessera-", delete=False) as f, zipfile.ZipFile(f, "w") as z:
            for folder, _, names in os.walk(root):
                for n in names:
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.join("tessera", os.path.relpath(os.path.join(folder, n), root)))
        spark.sparkContext.addPyFile(f.name)
        _SHIPPED.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where the session names none and runs in one JVM (as in tests) a folder of this machine is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark.sparkContext, "getCheckpointDir", lambda: None)()
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; its files go when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settled(df, name: str):
    """A frame as a table in the shared folder: lineage ends there, and lost executors cost what they were working on."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> SparkSession:
    """Let Arrow batches hold at most so many rows and bytes: rows here are whole texts, and the buffers of a batch stay
    allocated in the executor's JVM. Smaller settings of the session stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)  # the driver keeps the text of every plan, literals and all
    return spark


#: Characters of a plan's text that the driver keeps for its listeners and logs.
PLAN_TEXT = 64 << 10


def lean(spark: SparkSession) -> SparkSession:
    """small_batches(), and driver and executors give back what earlier work left: Spark drops shuffles and broadcasts
    that nothing refers to once the driver's JVM collects, and a collected heap shrinks. Where that doesn't reach an
    executor, nothing but its memory differs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    tasks = 2 * spark.sparkContext.defaultParallelism
    spark.range(0, tasks, 1, tasks).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
    return small_batches(spark)
