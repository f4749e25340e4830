"""Tables between the steps of an iteration: written to the folder that all machines share, read again, and dropped."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffles of a query end with it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, in local mode a temporary folder, else the warehouse, which must then not be a folder of each machine."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if sc.applicationId not in _own_dir:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            _own_dir[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        else:
            warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
            if warehouse.startswith(("file:", "/")):
                raise ValueError("set spark.checkpoint.dir: the warehouse is a local folder, of which each machine has its own")
            _own_dir[sc.applicationId] = f"{warehouse}/folioforge-{sc.applicationId}"
    return _own_dir[sc.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage is cut, and lost executors cost no recomputation."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    # nothing reads the shuffles of a written table again: they go at once, not when the driver happens to collect its garbage
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables that nothing reads any more."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)
