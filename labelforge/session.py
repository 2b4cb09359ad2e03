"""Session helpers: a tuned local session for tests, and written intermediate tables."""

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "8", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder for written intermediate tables, visible to all executors.

    It is the session's ``spark.checkpoint.dir``. Where none is set, a session
    whose executors run in the driver's process gets a temporary folder, one
    per application; any other raises, as executors on other machines would
    each write to a disk of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set; executors of {master} need a folder that they all share")
        if app not in _local_folders:
            _local_folders[app] = "file://" + tempfile.mkdtemp(prefix="labelforge-")
        folder = _local_folders[app]
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives the loss of executors, is computed once (a
    checkpoint without a cache computes its plan twice) and is read by column.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    # removed when the application ends; until then any lost executor's work can be read again
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """``df`` to be broadcast if it has at most ``most`` rows, else as it is. For small lists, as it counts them."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = pathlib.Path(__file__).resolve().parent
        path = pathlib.Path(tempfile.mkdtemp(prefix="labelforge-")) / "labelforge_pkg.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, str(file.relative_to(root.parent)))
        spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
