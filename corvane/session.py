"""Session settings and table access shared by operators and queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution. Partition counts are left to the cluster's own settings."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"} | conf
    return SparkSession.builder.master(master).config(map=settings).getOrCreate()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(table) if name == "documents" else table


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        import tempfile

        root = tempfile.mkdtemp(prefix="corvane-") if spark.sparkContext.master.startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
        spark.conf.set("spark.checkpoint.dir", root if ":" in root else f"file://{root}")
    return spark.conf.get("spark.checkpoint.dir").rstrip("/")


def index_root(table: DataFrame, name: str) -> tuple[str, bool]:
    """Where the index called name of a table of files lies in the shared folder, and whether it is there: another folder for other files.
    It goes as the driver ends."""
    import hashlib

    spark, told = table.sparkSession, []
    for file in sorted(table.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        told.append(f"{file} {status.getLen()} {status.getModificationTime()}")
    root = f"{shared_folder(spark)}/corvane/{name}-{hashlib.sha256(chr(10).join(told).encode()).hexdigest()[:32]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    there = store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/current"))
    if not there:
        store.delete(path, True)  # what a driver that ended too early left
        store.deleteOnExit(path)
    return root, there


def spread(table: DataFrame) -> DataFrame:
    """A table of fewer pieces than there are cores, dealt to all of them, as work on texts is long; a larger one as it is."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table._jdf.queryExecution().toRdd().getNumPartitions() < cores else table
