"""Session settings and the shared folder used to cut long plans."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# a hot key may fill one join partition: split it even where that needs one more shuffle.
# Wide aggregates and sorts take up to sixty times the bytes of their shuffled rows: tasks of 8 MB keep
# a task at some hundred MB, and there are partitions enough for that up to 8 GB of one shuffle. A shuffle of
# so many partitions sorts the rows of a map task in memory: scans of 16 MB keep that small as well
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1000",
    "spark.sql.files.maxPartitionBytes": "16m",
    # the JVM interprets methods above 8,000 bytes for ever: a stage that would generate one, such as the final
    # projection of the wide game frame, runs operator by operator
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
SETTINGS = {
    **RUNTIME,
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, cores: int | None = None, **conf) -> SparkSession:
    """A session with the library's defaults; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName("diamondlake")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = (builder.config("spark.sql.shuffle.partitions", str(cores or 8))
                       .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
                       .config("spark.driver.memory", "8g")
                       .config("spark.ui.enabled", "false"))
    for k, v in {**SETTINGS, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Set the join settings the plans count on in a session made elsewhere."""
    for k, v in RUNTIME.items():
        spark.conf.set(k, v)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in `spark.checkpoint.dir`; a temporary one only for local masters."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="diamondlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import the library, wherever they start: once per application.

    The sources go as one archive of some kilobytes to the shared folder and are added as Spark
    adds any Python file.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    path = context._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/{root.name}-{uuid.uuid4().hex}.zip")
    system = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = system.create(path)
    out.write(bytearray(data.getvalue()))
    out.close()
    context.addPyFile(system.makeQualified(path).toString())
    _SHIPPED.add(context.applicationId)


class Stage:
    """Intermediate tables of one run, written under the shared folder as Parquet.

    A frame that several branches read is written once and read back with its columns prunable;
    losing an executor later costs a re-read, not a recomputation.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
