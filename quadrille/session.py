"""Session helpers: a local session for tests, and a folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quadrille")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which every executor can reach.

    Only where the setting is absent and the master is local is a folder of this machine used;
    on a cluster without the setting this raises, since executors could not share such a folder.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quadrille-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written as Parquet to the folder that all executors share and read again: this cuts the lineage."""
    spark, path, setting = df.sparkSession, fresh_path(df.sparkSession, label), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")  # once the table is whole nothing reads the shuffles that made it
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def bucketed(df: DataFrame, label: str, by: str, most: int | None = None) -> tuple[DataFrame, str]:
    """df as a table in the shared folder, hashed and sorted by a column, so that joins on it move the other side only; and its name, to be dropped by.

    Buckets are as many as shuffle partitions, or `most` if that is less: each is a task, however small."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    name = f"quadrille_{uuid.uuid4().hex}"
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), most or 1 << 30))
    df.repartition(n, by).write.format("parquet").bucketBy(n, by).sortBy(by).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.written_path = path
    return out, name


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by `written` that nothing will read again; what was made of them must be written too."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_path)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
