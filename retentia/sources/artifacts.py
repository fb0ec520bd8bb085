"""Versioned artifacts: a run is visible whole or not at all.

A run writes its parts into a new version folder and then one manifest, whose files' names and sizes it lists. Readers take the newest
manifest whose files are all there as listed. A run that fails writes no manifest, so readers keep the version before it; nothing is
overwritten or deleted.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Version:
    number: int
    name: str
    path: str


class BrokenVersion(ValueError):
    """No manifest under the root has all its files."""


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _files(self, path: str) -> dict[str, int]:
        """Names below ``path`` and sizes of its data files."""
        fs, p = self._fs(path)
        if not fs.exists(p):
            return {}
        base, out = fs.resolvePath(p).toString().rstrip("/") + "/", {}
        found = fs.listFiles(p, True)
        while found.hasNext():
            f = found.next()
            name = f.getPath().toString()
            if not f.getPath().getName().startswith((".", "_")):
                out[name[len(base):] if name.startswith(base) else name.rsplit(path.rstrip("/") + "/", 1)[-1]] = int(f.getLen())
        return out

    def _manifests(self) -> list[tuple[int, str]]:
        """Numbers and names of complete manifests, newest first."""
        fs, p = self._fs(f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(p)]
        done = [n for n in names if fs.exists(self._fs(f"{self.root}/manifests/{n}/_SUCCESS")[1])]
        return sorted(((int(n.split("-")[0]), n) for n in done), reverse=True)

    def begin(self) -> Version:
        """A new folder to write a run's parts into; nobody reads it yet."""
        last = self._manifests()
        number = (last[0][0] if last else 0) + 1
        name = f"{number:08d}-{uuid.uuid4().hex}"
        return Version(number, name, f"{self.root}/versions/{name}")

    def publish(self, version: Version, **facts) -> Version:
        """Make ``version`` the current one: its manifest is written last, in one piece."""
        files = self._files(version.path)
        if not files:
            raise BrokenVersion(f"nothing was written to {version.path}")
        text = json.dumps({"number": version.number, "name": version.name, "files": files, "facts": facts})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{self.root}/manifests/{version.name}")
        return version

    def current(self) -> Version | None:
        """The newest version whose files are all there with the listed sizes; None if nothing was published."""
        listed = self._manifests()
        for number, name in listed:
            got = self.spark.read.text(f"{self.root}/manifests/{name}").first()
            want = json.loads(got["value"])["files"]
            have = self._files(f"{self.root}/versions/{name}")
            if all(have.get(f) == n for f, n in want.items()):
                return Version(number, name, f"{self.root}/versions/{name}")
        if listed:
            raise BrokenVersion(f"no version under {self.root} has all its files")
        return None

    def version(self, name: str) -> Version:
        return Version(int(name.split("-")[0]), name, f"{self.root}/versions/{name}")

    def facts(self, version: Version) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version.name}").first()["value"])["facts"]
