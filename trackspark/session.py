"""Session settings and the one place that decides where lineage is cut."""

from __future__ import annotations

import pathlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def local_session(app: str = "trackspark", cores: str = "8", **conf: str) -> SparkSession:
    """Session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    limit_methods(spark)
    return spark


def limit_methods(spark: SparkSession) -> None:
    """Wide plans make methods over 8,000 bytes, which HotSpot never compiles: such a stage took a hundred times as long.

    With this documented limit Spark runs the stage operator by operator instead.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, once per application, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = pathlib.Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="spark-package-", dir="/tmp")  # read by the driver only, which serves it
    archive = shutil.make_archive(f"{folder}/trackspark", "zip", root_dir=root, base_dir="trackspark")
    context.addPyFile(archive)
    _SHIPPED.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as named by the cluster.

    Only a local master may fall back to a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = _LOCAL.setdefault(spark.sparkContext.applicationId, "")
    if not folder:
        folder = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and read them back.

    The result survives the loss of any executor, has a known size for the
    optimizer and carries no plan history into the next round of a loop.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
