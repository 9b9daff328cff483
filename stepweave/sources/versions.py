"""Stage tables in versions: written beside each other, committed by a pointer.

A table is a folder. A version is written into a folder of its own below it and
only then named by the next numbered pointer, a small file that exactly one
writer can make. Readers take the newest pointer when they open the table and
keep to its version, so a table may be overwritten by what was just read of it,
and readers never see half of one. A writer that dies leaves a folder that no
pointer names; ``vacuum`` takes away what no kept pointer names.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from stepweave.sources.tables import shared_dir


@dataclass(frozen=True)
class Stages:
    """Stage tables below a folder that all executors share."""

    spark: SparkSession
    base: str

    @classmethod
    def of(cls, spark: SparkSession, name: str = "stages") -> Stages:
        return cls(spark, f"{shared_dir(spark)}/{name}")

    def _path(self, *parts: str) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self, name: str) -> list[int]:
        fs, folder = self._path(name, "_pointers")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []

    def _pointer(self, name: str, version: int) -> dict[str, Any] | None:
        """What a pointer says; null while its writer has not finished it."""
        fs, path = self._path(name, "_pointers", f"{version:010d}")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        except ValueError:
            return None
        finally:
            stream.close()

    def versions(self, name: str) -> list[int]:
        return [v for v in self._numbers(name) if self._pointer(name, v)]

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def _commit(self, name: str, what: dict[str, Any]) -> int:
        """The number of the pointer; the next one where another writer was first."""
        version = max(self._numbers(name), default=0) + 1
        while True:
            fs, path = self._path(name, "_pointers", f"{version:010d}")
            try:
                stream = fs.create(path, False)  # by one writer only
            except Py4JJavaError:
                if not fs.exists(path):
                    raise
                version += 1
                continue
            stream.write(bytearray(json.dumps(what).encode()))
            stream.close()
            return version

    def write(self, name: str, df: DataFrame, bucket_by: str | None = None, buckets: int = 16) -> DataFrame:
        """Commit ``df`` as the next version, in buckets by a column if one is
        named, and return it as read back."""
        held = f"v-{uuid.uuid4().hex}"
        path = f"{self.base}/{name}/{held}"
        writer = df.write.option("compression", "zstd")
        if bucket_by:
            table = f"stage_{held[2:]}"
            writer.bucketBy(buckets, bucket_by).sortBy(bucket_by).format("parquet").option("path", path).saveAsTable(table)
        else:
            writer.parquet(path)
        version = self._commit(name, {"folder": held, "schema": df.schema.json(), "bucket_by": bucket_by, "buckets": buckets})
        return self.read(name, version=version)

    def read(self, name: str, *columns: str, version: int | None = None) -> DataFrame:
        """The newest version, or an earlier one, to which the frame keeps."""
        known = self.versions(name)
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"no version {version or ''} of {name} below {self.base}")
        what = self._pointer(name, version or known[-1])
        path = f"{self.base}/{name}/{what['folder']}"
        if what["bucket_by"]:
            table = f"stage_{what['folder'][2:]}"
            if not self.spark.catalog.tableExists(table):
                from pyspark.sql.types import StructType

                fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in StructType.fromJson(json.loads(what["schema"])))
                self.spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({fields}) USING parquet CLUSTERED BY (`{what['bucket_by']}`) SORTED BY (`{what['bucket_by']}`) INTO {what['buckets']} BUCKETS LOCATION '{path}'")
            df = self.spark.table(table)
        else:
            df = self.spark.read.parquet(path)
        return df.select(*columns) if columns else df

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Take away all but the newest ``keep`` versions, and folders that no
        pointer names; readers of these fail. The number of folders taken."""
        known = self.versions(name)
        kept = {self._pointer(name, v)["folder"] for v in known[-keep:]}
        for v in [v for v in self._numbers(name) if v not in known[-keep:]]:
            fs, path = self._path(name, "_pointers", f"{v:010d}")
            fs.delete(path, False)
        fs, folder = self._path(name)
        gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in kept]
        for path in gone:
            self.spark.sql(f"DROP TABLE IF EXISTS stage_{path.getName()[2:]}")
            fs.delete(path, True)
        return len(gone)
