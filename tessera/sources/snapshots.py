"""Tables kept as immutable snapshots: append, insert, upsert and swap.

Parquet has no row updates. A table is a folder of data parts and of numbered version files; a version lists
the parts that make it up, so an append writes its own rows only and names the older parts again. A version
file is created in one step that fails if it is there, so readers see the old table or the new one, a
failed write leaves no trace, and of two writers the second gets a conflict.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tessera.operators.fact_index import upsert as _upsert
from tessera.operators.lineage import insert_new


class Conflict(RuntimeError):
    """The table changed between reading and writing."""


class Snapshots:
    """One table under ``root`` (any file system Spark can write)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The current snapshot's number, 0 before the first."""
        p = self._path(f"{self.root}/versions")
        if not self._fs.exists(p):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(p)), default=0)

    def parts(self, version: int | None = None) -> list[str]:
        """The folders that make up a version."""
        v = version or self.version()
        if not v:
            raise LookupError(f"no snapshot under {self.root}")
        stream = self._fs.open(self._path(f"{self.root}/versions/{v}"))
        try:
            return [p for p in bytes(stream.readAllBytes()).decode().split("\n") if p]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/data/{p}" for p in self.parts(version)])

    def _commit(self, rows: DataFrame, seen: int, older: list[str]) -> int:
        new, part = seen + 1, uuid.uuid4().hex
        if self.version() != seen:
            raise Conflict(f"{self.root} is at {self.version()}, not {seen}")
        target = self._path(f"{self.root}/data/{part}")
        rows.write.mode("errorifexists").parquet(target.toString())
        try:
            stream = self._fs.create(self._path(f"{self.root}/versions/{new}"), False)
        except Py4JJavaError as e:  # another writer was first
            self._fs.delete(target, True)
            raise Conflict(f"{self.root} got snapshot {new} from another writer") from e
        try:
            stream.write(bytearray("\n".join([*older, part]).encode()))
        finally:
            stream.close()
        return new

    def replace(self, df: DataFrame, expected: int | None = None) -> int:
        """Write ``df`` as the next snapshot; Conflict if the current one is not ``expected`` any more."""
        return self._commit(df, self.version() if expected is None else expected, [])

    def append(self, rows: DataFrame) -> int:
        """Add rows; what is there is not read."""
        v = self.version()
        return self._commit(rows, v, self.parts(v) if v else [])

    def insert(self, rows: DataFrame, key: list[str]) -> int:
        """Rows whose key is new; the others change nothing."""
        v = self.version()
        if not v:
            return self.replace(rows.dropDuplicates(key), v)
        return self._commit(insert_new(self.read(v), rows, key), v, self.parts(v))

    def upsert(self, rows: DataFrame, gone: DataFrame | None = None) -> int:
        """Rows replace those of their memory_id; ``gone`` (memory_id) are removed."""
        v = self.version()
        return self.replace(rows if not v else _upsert(self.read(v), rows, gone), v)
