"""Write an intermediate result once and read it back, cutting its lineage."""

from __future__ import annotations

import tempfile
import uuid
from threading import Lock

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, folder: str | None = None) -> str | None:
    """The folder for intermediate tables, or None if nobody has named one.

    ``folder`` itself, else the one given to ``sparkContext.setCheckpointDir``,
    else ``spark.checkpoint.dir``. It must be one that all machines see, so none
    is ever made up here.
    """
    return (
        folder
        or spark.sparkContext.getCheckpointDir()
        or spark.conf.get("spark.checkpoint.dir", None)
    )


def own_folder(spark: SparkSession) -> None:
    """Name a folder where nobody has and all tasks run in this process, as in tests.

    On a cluster nothing is named: only the user knows a folder that all machines see.
    """
    if shared_folder(spark) is None and spark.sparkContext.master.split("[")[0] == "local":
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quotelens-"))


class Staging:
    """Parquet tables in the shared folder, deleted together after use.

    ::

        with Staging(spark) as staging:
            build_mart(tables, params, staging).write.parquet(...)

    A result that reads staged tables is lazy: delete them only when it is
    written. Tables nobody deletes go when the JVM ends in good order. Without a
    folder ``table`` gives its frame back and the plan stays one lazy query;
    ``required`` raises instead, for plans that must not compute a part twice.

    With a ``key``, which stands for inputs and parameters, tables keep their places
    from one run to the next: one that is there whole is read, not written again, so
    a run that was cut off goes on after its last table. They then stay until
    :meth:`delete`, and a name may be used once.
    """

    def __init__(
        self, spark: SparkSession, folder: str | None = None, required: bool = False, key: str | None = None
    ):
        self._spark = spark
        self._folder = shared_folder(spark, folder)
        self._key = key
        self._paths: list[str] = []
        self._bucketed: list[str] = []
        #: Names of tables that an earlier run had left whole.
        self.resumed: list[str] = []
        self._lock = Lock()
        if required and self._folder is None:
            raise ValueError("name a folder all machines see in spark.checkpoint.dir")

    @property
    def enabled(self) -> bool:
        return self._folder is not None

    def table(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` written and read back.

        ``by``: a column whose values share a bucket, of as many as the session has
        shuffle partitions. Joins and sums on it of tables so staged shuffle nothing,
        and a frame that is partitioned by it already is written as it is.
        """
        if self._folder is None:
            return df
        buckets = int(self._spark.conf.get("spark.sql.shuffle.partitions"))
        path = self._place(f"{name}-by-{by}-{buckets}" if by else name)
        there = self._key is not None and self._exists(path, "_SUCCESS")
        if there:
            self.resumed.append(name)
        if by is None:
            if not there:
                df.write.mode("overwrite").parquet(path)
            found = self._spark.read.schema(df.schema).parquet(path)
        else:
            table = f"quotelens_{uuid.uuid4().hex}"
            if not there:
                rows = df.repartition(buckets, by).write.format("parquet").mode("overwrite")
                rows.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(table)
            else:
                columns = df._jdf.schema().toDDL()
                self._spark.sql(
                    f"CREATE TABLE {table} ({columns}) USING parquet"
                    f" CLUSTERED BY (`{by}`) SORTED BY (`{by}`) INTO {buckets} BUCKETS LOCATION '{path}'"
                )
            with self._lock:
                self._bucketed.append(table)
            found = self._spark.table(table)
        if self._key is None:
            at, files = self._file_system(path)
            files.deleteOnExit(at)
        return found

    def inner(self) -> Staging:
        """Staging in the same folder for tables that go before the others do."""
        return Staging(self._spark, self._folder)

    def _place(self, name: str) -> str:
        folder = f"{self._folder.rstrip('/')}/quotelens"
        if self._key is None:
            path = f"{folder}/{name}-{uuid.uuid4().hex}"
        else:
            path = f"{folder}/run-{self._key}/{name}"
        with self._lock:
            if path in self._paths:
                raise ValueError(f"{name} is staged twice in the run {self._key}")
            self._paths.append(path)
        return path

    def _file_system(self, path: str):
        at = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _exists(self, path: str, name: str) -> bool:
        at, files = self._file_system(f"{path}/{name}")
        return files.exists(at)

    def delete(self) -> None:
        """Delete every table written or read so far."""
        while self._bucketed:
            self._spark.sql(f"DROP TABLE IF EXISTS {self._bucketed.pop()}")
        while self._paths:
            at, files = self._file_system(self._paths.pop())
            files.delete(at, True)
        if self._key is not None:
            at, files = self._file_system(f"{self._folder.rstrip('/')}/quotelens/run-{self._key}")
            files.delete(at, True)

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, kind, *_) -> None:
        # What a run with a key has written is what the next one goes on from.
        if self._key is None or kind is None:
            self.delete()
