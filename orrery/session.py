"""Session settings shared by tests, the benchmark and interactive use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application, a folder of this machine for intermediate tables; only where ``spark.checkpoint.dir`` is unset and all runs here.
_LOCAL: dict[str, str] = {}


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects; on a cluster, pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; where it is unset and all runs on this machine (tests), a folder here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="orrery-")
        base = _LOCAL[app]
    return base.rstrip("/")


#: For rows of megabytes: Parquet looks at the size of a page and of a row group after 100 rows only, and a row group is read as one batch.
_LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "16", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "16"}


def durable(df: DataFrame, name: str, large_rows: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, the lineage ends there, and a lost executor costs nothing.

    With ``large_rows`` (of megabytes) few of them are held at a time by those who write and read the table, however many a task has.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(_LARGE_ROWS if large_rows else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
