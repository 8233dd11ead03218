"""Session defaults for local use and tests; on a cluster the submitter's settings win."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, fields

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "lodestone", cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # call sites of columns take most of the time of building long plans
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@dataclass(frozen=True)
class Config:
    """What an installation sets: where tables are kept, and what its models are reached by."""

    store: str
    model_key: str
    embedder: str = "hashing"
    dimensions: int = 64

    @staticmethod
    def read(spark: SparkSession, environ: Mapping[str, str] = os.environ) -> Config:
        """From spark.lodestone.* settings, then LODESTONE_* variables; a setting without a default has to be there."""
        found = {}
        for f in fields(Config):
            value = spark.conf.get(f"spark.lodestone.{f.name}", None) or environ.get(f"LODESTONE_{f.name.upper()}")
            if value:
                found[f.name] = int(value) if f.name == "dimensions" else value
        if missing := [f.name for f in fields(Config) if f.default is MISSING and f.name not in found]:
            raise ValueError(f"not configured: {', '.join(missing)}")
        return Config(**found)


def ensure_importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster the package is expected on the executors (wheel or ``--py-files``); this only prepends the path.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a single-machine master; any other master is refused, since a
    machine-local folder would lose files there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", folder)
    path, system = file_system(spark, folder)
    system.deleteOnExit(path)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is there goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    held, system = file_system(spark, path)
    system.deleteOnExit(held)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, and lost executors cost only their tasks."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held, held.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
