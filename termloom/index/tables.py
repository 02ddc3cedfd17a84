"""Where an index keeps its tables and manifests: what a store must offer, and the store on a Hadoop file system."""

from __future__ import annotations

import tempfile
import uuid
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="termloom-")
    return f"{shared}/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` as it is now, written to a scratch folder: each use reads it there instead of deriving it again."""
    folder = scratch(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class Store(Protocol):
    """Tables are written once and named by relative paths; ``create`` is the one operation that must be atomic."""

    spark: SparkSession

    def write(self, df: DataFrame, name: str) -> None: ...

    def read(self, names: list[str], schema: str) -> DataFrame:
        """The union of tables, of that schema; empty for no names."""
        ...

    def create(self, name: str, text: str) -> bool:
        """A small file, whole or not at all. False if it is there already, whoever made it."""
        ...

    def text(self, name: str) -> str: ...

    def names(self, folder: str = "") -> list[str]: ...

    def age(self, name: str) -> float:
        """Seconds since it was written."""
        ...

    def delete(self, name: str = "") -> None: ...


class Files:
    """A folder of any file system that Spark can write to and that can rename without overwriting, as HDFS and local disks do."""

    def __init__(self, spark: SparkSession, root: str, format: str = "parquet"):
        self.spark, self.root, self.format = spark, root.rstrip("/"), format
        self._jvm = spark._jvm
        hadoop = spark._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(hadoop)
        uri = self._fs.makeQualified(self._path("")).toUri()
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(uri, hadoop)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def write(self, df: DataFrame, name: str) -> None:
        df.write.format(self.format).save(f"{self.root}/{name}")

    def read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.format(self.format).schema(schema).load([f"{self.root}/{n}" for n in names])

    def create(self, name: str, text: str) -> bool:
        self._fs.mkdirs(self._path(""))
        whole = f"{name}.{uuid.uuid4().hex}.tmp"
        out = self._fs.create(self._path(whole), False)
        out.write(bytearray(text.encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark._sc._gateway.new_array(rename, 1)
        how[0] = rename.NONE
        try:
            self._context.rename(self._fs.makeQualified(self._path(whole)), self._fs.makeQualified(self._path(name)), how)
        except Exception as e:
            self.delete(whole)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str = "") -> list[str]:
        p = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def age(self, name: str) -> float:
        now = self._jvm.java.lang.System.currentTimeMillis()
        return max(0.0, (now - self._fs.getFileStatus(self._path(name)).getModificationTime()) / 1000)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._path(name), True)
