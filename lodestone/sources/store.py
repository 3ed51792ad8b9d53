"""Named Parquet tables under one folder of any file system Spark can reach."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    """Tables that can be read, appended to, replaced and dropped.

    A replacement is written beside the version it is computed from and becomes
    current once it is complete; a job that dies half way leaves the old version
    in place.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self._spark = spark
        self.root = root.rstrip("/")

    def _fs(self, path: str):
        jpath = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return jpath.getFileSystem(self._spark._jsc.hadoopConfiguration()), jpath

    def _versions(self, name: str) -> list[int]:
        """Complete versions of a table, oldest first."""
        fs, path = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        found = []
        for status in fs.listStatus(path):
            version = status.getPath().getName()
            done, mark = self._fs(f"{self.root}/{name}/{version}/_SUCCESS")
            if version.startswith("v") and done.exists(mark):
                found.append(int(version[1:]))
        return sorted(found)

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}"

    def exists(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str, schema: str) -> DataFrame:
        """The current version, or an empty relation of the schema."""
        versions = self._versions(name)
        if not versions:
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(self._path(name, versions[-1]))

    def append(self, name: str, df: DataFrame) -> None:
        versions = self._versions(name)
        df.write.mode("append").parquet(self._path(name, versions[-1] if versions else 1))

    def replace(self, name: str, df: DataFrame) -> None:
        versions = self._versions(name)
        version = versions[-1] + 1 if versions else 1
        df.write.mode("overwrite").parquet(self._path(name, version))
        for old in versions[:-1]:
            fs, path = self._fs(self._path(name, old))
            fs.delete(path, True)

    # ---- bucketed tables ----

    def buckets(self, name: str) -> int:
        """Number of buckets of a table: that of its folder, or what a new one would get."""
        fs, path = self._fs(f"{self.root}/{name}")
        held = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return int(held[0][1:] if held else self._spark.conf.get("spark.sql.shuffle.partitions"))

    def _bucketed(self, name: str, schema: str, key: str, sort: str) -> str:
        """Name of an external table over the folder, declared in this session if need be.

        The number of buckets is part of the folder's name, so every application
        declares the table alike.
        """
        buckets = self.buckets(name)
        folder = f"{self.root}/{name}/b{buckets}"
        table = f"lodestone_{name}_{hashlib.md5(folder.encode()).hexdigest()}"
        if not self._spark.catalog.tableExists(table):
            self._spark.sql(
                f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({sort}) "
                f"INTO {buckets} BUCKETS LOCATION '{folder}'"
            )
        return table

    def read_bucketed(self, name: str, schema: str, key: str, sort: str) -> DataFrame:
        table = self._bucketed(name, schema, key, sort)
        self._spark.catalog.refreshTable(table)
        return self._spark.table(table)

    def append_bucketed(self, name: str, df: DataFrame, schema: str, key: str, sort: str) -> None:
        """Append rows hashed into buckets by ``key``, each file sorted by ``sort``."""
        self.read_bucketed(name, schema, key, sort)
        table = self._bucketed(name, schema, key, sort)
        df.select(*self._spark.table(table).columns).write.insertInto(table)

    def drop(self, *names: str) -> None:
        for name in names:
            fs, path = self._fs(f"{self.root}/{name}")
            fs.delete(path, True)
