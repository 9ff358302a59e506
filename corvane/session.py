"""The Spark session that tests, benches and scripts use."""

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, driver_memory: str = "6g", **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and last-wins map merging; `conf` is added as given."""
    builder = (
        SparkSession.builder.master(master)
        .appName("corvane")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Arrow batches of texts are kept small: a task holds several copies of one. The first value is Spark's default.
ARROW_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m")
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package, once per application, as they may not have it installed; limit the bytes of an
    Arrow batch where the session leaves Spark's default. The limit stays in the session."""
    key, default, limit = ARROW_BYTES
    if spark.conf.get(key) == default:
        spark.conf.set(key, limit)
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="corvane-")) / "corvane.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark


_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where that is unset, one of our own for this application, if driver and
    executors are one process; else RuntimeError, as a folder of one machine would lose rows."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_root.setdefault(context.applicationId, f"file://{tempfile.mkdtemp(prefix='spark-settled-')}")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; it goes when the driver's JVM ends."""
    path = f"{shared_root(spark)}/settled/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
