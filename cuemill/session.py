"""Session helpers: table access, partition counts and the shared folder for materialised steps."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cuemill")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application, so that it needn't be installed on the executors. The
    archive lies in the shared folder; on a cluster without one the package has to be installed."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    try:
        target = f"{shared_dir(spark)}/cuemill-{uuid.uuid4().hex}.zip"
    except RuntimeError:
        return
    root, packed = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    path = sc._jvm.org.apache.hadoop.fs.Path(target)  # the shared folder may be of any file system
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(path)
    out.write(packed.getvalue())
    out.close()
    fs.deleteOnExit(path)
    sc.addPyFile(target)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder of this machine is used; on a cluster it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), f"cuemill-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new folder's name in the shared folder. Results are lazy, so it has to stay while the application runs; it is
    deleted when that ends."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _forget_at_end(spark.sparkContext, path)
    return path


def _forget_at_end(sc, path: str) -> None:
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(where.getParent())
    # only what exists can be marked
    if fs.mkdirs(where):
        fs.deleteOnExit(where)
        fs.delete(where, True)
