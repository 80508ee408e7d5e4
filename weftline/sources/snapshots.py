"""Versioned Parquet snapshots, published all at once.

Layout: ``<root>/v=<n>/<relation>/*.parquet`` and a pointer file ``<root>/CURRENT`` with the number of the
current version.  A version is written beside the current one and becomes visible by one rename of the
pointer; a reader sees the old state or the new one, never a mixture.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class SnapshotStore:
    """A directory of snapshots on any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str, keep: int = 3):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        self._jvm = spark._jvm
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, at: str):
        return self._jvm.org.apache.hadoop.fs.Path(at)

    def current(self) -> int:
        """The published version; 0 before the first publication."""
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return 0
        stream = self._fs.open(at)
        try:
            return int(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())

    def publish(self, relations: dict[str, DataFrame]) -> int:
        """Write all relations, then move the pointer. Relations that aren't given are carried over."""
        before = self.current()
        version = max([before, *self.versions()]) + 1
        staging = f"{self.root}/_staging-{uuid.uuid4().hex}"
        for name, df in relations.items():
            df.write.parquet(f"{staging}/{name}")
        if before:
            for s in self._fs.listStatus(self._path(f"{self.root}/v={before}")):
                name = s.getPath().getName()
                if name not in relations:
                    self.spark.read.parquet(f"{self.root}/v={before}/{name}").write.parquet(f"{staging}/{name}")
        if not self._fs.rename(self._path(staging), self._path(f"{self.root}/v={version}")):
            raise OSError(f"version {version} can't be put in place under {self.root}")
        pointer = self._path(f"{self.root}/_pointer-{uuid.uuid4().hex}")
        out = self._fs.create(pointer, True)
        out.write(bytearray(str(version).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(pointer, self._path(f"{self.root}/CURRENT"), options)
        for old in [v for v in self.versions() if v < version][: -(self.keep - 1) or None]:
            self._fs.delete(self._path(f"{self.root}/v={old}"), True)
        return version

    def read(self, relation: str, version: int | None = None) -> DataFrame:
        """A relation of the current or a named version."""
        v = version or self.current()
        if not v:
            raise FileNotFoundError(f"nothing has been published under {self.root}")
        return self.spark.read.parquet(f"{self.root}/v={v}/{relation}")
