"""Versioned manifests in a directory that any Hadoop file system can hold."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..errors import Corrupt, InvalidArgument, Locked, NotFound, WrongVersion

FORMAT = 1


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where none is named, a local session has one of its own; a cluster has none, as its machines share no local folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.nearfield.folder", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise InvalidArgument("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = f"file://{tempfile.mkdtemp(prefix='nearfield-')}"
        spark.conf.set("spark.nearfield.folder", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again; the files go when the application ends."""
    path = new_folder(df.sparkSession, label)
    added(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, label: str) -> str:
    """An empty folder in the shared one; it goes when the application ends."""
    path = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = made.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(made)  # it is marked for deletion only if it is there
    files.deleteOnExit(made)
    return path


def added(df: DataFrame, path: str) -> None:
    """Add ``df``'s rows to the table at ``path``."""
    df.write.mode("append").parquet(path)


class Store:
    """Manifest n is the file ``manifest-n.json``; the greatest n is the collection's state.

    A new state is one file made under another name and renamed, so a reader sees the old state or the new one.  Where a
    file system's rename refuses an existing target, as HDFS does, of two writers one fails; on a local disk or an object
    store there must be one writer at a time.  Data directories are written before the manifest that names them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        if not self._fs.exists(self._root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._root)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def read(self) -> dict:
        versions = self.versions()
        if not versions:
            raise NotFound(self.path)
        stream = self._fs.open(self._at(f"manifest-{versions[-1]:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            state = json.loads(text)
        except ValueError as e:
            raise Corrupt(self.path) from e
        if not isinstance(state, dict) or "format" not in state or "config" not in state:
            raise Corrupt(self.path)
        if state["format"] != FORMAT:
            raise WrongVersion(f"format {state['format']}")
        return state

    def write(self, state: dict) -> None:
        state = state | {"format": FORMAT}
        target = self._at(f"manifest-{state['version']:08d}.json")
        if self._fs.exists(target):
            raise Locked("another writer has been faster")
        made = self._at(f".{uuid.uuid4().hex}")
        stream = self._fs.create(made, False)
        stream.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        stream.close()
        if not self._fs.rename(made, target):
            self._fs.delete(made, False)
            raise Locked("another writer has been faster")

    def prune(self) -> None:
        """Delete all manifests but the latest."""
        for version in self.versions()[:-1]:
            self._fs.delete(self._at(f"manifest-{version:08d}.json"), False)

    def new_name(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def delete(self, name: str | None = None) -> None:
        self._fs.delete(self._at(name) if name else self._root, True)

    def bytes(self, names: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._at(n)).getLength() for n in names if self._fs.exists(self._at(n)))
