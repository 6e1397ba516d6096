"""Tables in versions: each write is a folder of its own, published by renaming a small file last."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

from paceline.sources.tables import upsert


class Table:
    """A table under ``root``: folders of Parquet, and in ``_published`` a file a version, numbered, that names its folder.

    Readers take the highest number and so see one whole version, whatever is being written. A write that fails before
    its file is renamed leaves the table as it was. Two writers that started from one version can't both publish the
    next: the later one gets an error. Old versions stay for readers that have begun, until ``expire``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.path = lambda name: self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self.files = self.path("_published").getFileSystem(self.conf)

    def versions(self) -> dict[int, str]:
        """Published numbers and their folders."""
        if not self.files.exists(self.path("_published")):
            return {}
        names = [s.getPath().getName() for s in self.files.listStatus(self.path("_published"))]
        return {int(n): self._said(n) for n in names if n.isdigit()}

    def _said(self, name: str) -> str:
        stream = self.files.open(self.path(f"_published/{name}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        """The newest version; None before the first."""
        known = self.versions()
        return self.spark.read.parquet(f"{self.root}/{known[max(known)]}") if known else None

    def publish(self, df: DataFrame, after: int | None = None) -> int:
        """Write ``df`` and make it the version that follows ``after``, by default the newest one now."""
        after = max(self.versions(), default=0) if after is None else after
        folder = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        return self._point(after + 1, folder)

    def _point(self, number: int, folder: str) -> int:
        self.files.mkdirs(self.path("_published"))
        new = self.path(f"_published/new-{folder}")
        stream = self.files.create(new, True)
        stream.writeBytes(folder)
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.conf)
        plain = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # not over another file
        try:
            context.rename(new, self.path(f"_published/{number:010d}"), plain)
        except Exception as e:
            self.files.delete(new, False)
            raise RuntimeError(f"version {number} of {self.root} wasn't published: another writer was first") from e
        return number

    def upsert(self, new: DataFrame, keys: list[str]) -> int:
        """The newest version without the rows whose key ``new`` has, and with ``new``, as the next version."""
        known = self.versions()
        if not known:
            return self.publish(new, 0)
        old = self.spark.read.parquet(f"{self.root}/{known[max(known)]}")
        return self.publish(upsert(old, new, keys), max(known))

    def expire(self, keep: int = 2, hours: float = 24.0) -> int:
        """Remove all but the newest ``keep`` versions, and folders of writes that were never published and are older than ``hours``."""
        known = self.versions()
        old = sorted(known)[: -keep or None]
        for number in old:
            self.files.delete(self.path(f"_published/{number:010d}"), False)
        left, gone = set(self.versions().values()), 0
        for s in self.files.listStatus(self.path("_published").getParent()):
            name, age = s.getPath().getName(), time.time() - s.getModificationTime() / 1000
            if name.startswith("data-") and name not in left and (name in known.values() or age > hours * 3600):
                gone += self.files.delete(s.getPath(), True)
        return gone
