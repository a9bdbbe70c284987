"""Writers (SNK01-SNK25) and a versioned table that stands for row-level changes."""

from __future__ import annotations

import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marginalia.sources.readers import EXTENSIONS


def write_any(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> None:
    """By `fmt`, else by the extension of the folder's name; nested values go to CSV as JSON text."""
    fmt = fmt or EXTENSIONS.get(PurePosixPath(path).suffix.lower())
    if fmt not in EXTENSIONS.values():
        raise ValueError(f"unsupported format: {path}")
    writer = (as_json_text(df) if fmt == "csv" else df).write.mode(mode)
    (writer.option("header", True).option("escape", '"') if fmt == "csv" else writer).format(fmt).save(path)


def as_json_text(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps as JSON text."""
    return df.select(*(F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else F.col(f"`{f.name}`") for f in df.schema.fields))


class VersionedTable:
    """A folder of versions with a pointer to the current one; one writer, any number of readers.

    A version is written in full before the pointer is changed, so a reader never
    sees half of one, and a lost job leaves the last version in place.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def current(self) -> str | None:
        pointer = self._path("CURRENT")
        if not self.fs.exists(pointer):
            return None
        return self.spark.read.text(f"{self.folder}/CURRENT").first()[0]

    def read(self, schema: T.StructType | str | None = None) -> DataFrame:
        """The current version; an empty table of `schema` before the first."""
        name = self.current()
        if name is None:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def append(self, df: DataFrame) -> str:
        """The next version: the current rows and these."""
        return self.write(df if self.current() is None else self.read().unionByName(df))

    def truncate(self) -> str:
        """The next version: no rows, the same columns; the table must have a version."""
        return self.write(self.read().limit(0))

    def write(self, df: DataFrame) -> str:
        name = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        out = self.fs.create(self._path("CURRENT.next"), True)
        out.write(bytearray(name.encode()))
        out.close()
        self.fs.delete(self._path("CURRENT"), False)
        self.fs.rename(self._path("CURRENT.next"), self._path("CURRENT"))
        return name
