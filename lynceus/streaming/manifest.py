"""Which state folders count: a manifest that is replaced as a whole.

Each version of the manifest is a file of its own, written aside and then renamed, so a reader finds a whole one whatever
happens in between. Folders that neither the last nor the previous version names are removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

PREFIX, SEGMENT = "manifest-", "segment-"


class Folder:
    """The few file operations the manifest needs, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(""))] if self.fs.exists(self._at("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        aside = f".{name}-{uuid.uuid4().hex}"
        stream = self.fs.create(self._at(aside), True)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        if not self.fs.rename(self._at(aside), self._at(name)):
            raise RuntimeError(f"{self.path}/{name} exists: is another query writing this state?")

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def _versions(folder: Folder) -> list[int]:
    return sorted(int(n[len(PREFIX):]) for n in folder.names() if n.startswith(PREFIX))


def current(folder: Folder) -> dict:
    """The last manifest: version, last_batch and segments (name, level)."""
    versions = _versions(folder)
    if not versions:
        return {"version": 0, "last_batch": -1, "segments": []}
    return json.loads(folder.read(f"{PREFIX}{versions[-1]:012d}"))


def replace(folder: Folder, last_batch: int, segments: list[dict]) -> None:
    """Writes the next version, then removes what only older ones named."""
    before = current(folder)
    version = before["version"] + 1
    folder.put(f"{PREFIX}{version:012d}", json.dumps({"version": version, "last_batch": last_batch, "segments": segments}))
    named = {s["name"] for s in (*before["segments"], *segments)}
    for name in folder.names():
        old = name.startswith(PREFIX) and int(name[len(PREFIX):]) < version - 1
        if old or (name.startswith(SEGMENT) and name not in named):
            folder.remove(name)


def paths(folder: Folder) -> list[str]:
    return [f"{folder.path}/{s['name']}" for s in current(folder)["segments"]]


def new_segment() -> str:
    return f"{SEGMENT}{uuid.uuid4().hex}"
