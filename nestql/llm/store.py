"""Shared scratch space: written tables cut lineage, so a lost executor never forces an operator to start over.

Everything lives under ``spark.checkpoint.dir``, which the cluster shares. Where that is unset a folder of our own is made and
set, if Spark runs on a single machine; on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: For our own tables only. Without its native library Hadoop starts a process (chmod) for each local file and folder, and another for each
#: file's checksums; until it runs it shares the JVM's memory. Plain local files have no checksums. Other file systems aren't affected.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI or path."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="nestql-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """A folder for one run of an operator. Tables the result still reads go when Python exits; others on drop()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.id = uuid.uuid4().hex
        self.root = f"{shared_root(spark)}/nestql-{name}-{self.id}"
        self.tables: list[str] = []
        atexit.register(self.close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Materialise df and return it as read back."""
        df.write.mode("overwrite").options(**PLAIN).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_bucketed(self, df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
        """Materialise df bucketed by key: later groupings by key read it in place, without an exchange."""
        table = f"nestql_{name}_{self.id}"
        df.write.mode("overwrite").options(**PLAIN).option("path", self.path(name)).bucketBy(buckets, key).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            for t in self.tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {t}")
            self.drop()
        except Exception:  # the session may be gone at exit
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Batches of whole texts must stay small, those that are read and Arrow's: a batch is held in memory at once, in the JVM and in Python."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20), ("spark.sql.parquet.columnarReaderBatchSize", rows)):
        now = str(spark.conf.get(name)).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
