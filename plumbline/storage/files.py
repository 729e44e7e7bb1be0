"""Small files with atomic, exclusive creation."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Files:
    """A folder's small files; Spark itself reads and writes the tables below it.

    A file is written as a draft, which then gets its name: on a local or
    mounted disk by a hard link, elsewhere by Hadoop's rename without
    overwriting.  Both fail if the name is taken, which is what
    compare-and-swap needs, and a writer that dies leaves a draft only.
    Object stores whose rename isn't exclusive don't give this.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        plain = self.root.removeprefix("file://")
        self.local = plain if "://" not in plain else None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _hadoop(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def read(self, name: str) -> bytes | None:
        """The file's bytes, None if there is none."""
        if self.local is not None:
            try:
                with open(f"{self.local}/{name}", "rb") as f:
                    return f.read()
            except (FileNotFoundError, NotADirectoryError):
                return None
        system, at = self._hadoop(name)
        if not system.exists(at):
            return None
        stream = system.open(at)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def create(self, name: str, content: bytes) -> bool:
        """Write a file that isn't there; False if it is."""
        if self.local is not None:
            to = f"{self.local}/{name}"
            os.makedirs(os.path.dirname(to), exist_ok=True)
            draft = f"{to}.{uuid.uuid4().hex}.tmp"
            with open(draft, "xb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            try:
                os.link(draft, to)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        system, at = self._hadoop(name)
        _, draft = self._hadoop(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = system.create(draft, False)
        try:
            stream.write(bytearray(content))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, at, options)
            return True
        except Exception:
            if system.exists(at):
                return False
            raise
        finally:
            system.delete(draft, False)

    def names(self, folder: str) -> list[str]:
        """Names in a folder, in order; none if there is no folder."""
        if self.local is not None:
            try:
                return sorted(n for n in os.listdir(f"{self.local}/{folder}") if not n.endswith(".tmp"))
            except (FileNotFoundError, NotADirectoryError):
                return []
        system, at = self._hadoop(folder)
        return sorted(n for s in system.listStatus(at) if not (n := s.getPath().getName()).endswith(".tmp")) if system.exists(at) else []

    def sizes(self, folder: str) -> dict[str, int]:
        """Bytes of all files below a folder, by path from the root."""
        system, at = self._hadoop(folder)
        out: dict[str, int] = {}
        if system.exists(at):
            todo = system.listFiles(at, True)
            while todo.hasNext():
                s = todo.next()
                name = s.getPath().getName()
                if not name.startswith(("_", ".")):
                    out[s.getPath().toUri().getPath()] = s.getLen()
        return out

    def rename(self, a: str, b: str) -> bool:
        system, at = self._hadoop(a)
        return bool(system.rename(at, self._hadoop(b)[1]))

    def copy(self, name: str, to: Files, overwrite: bool = False) -> None:
        """Copy a file or a folder to the same name in another place, if it isn't there."""
        system, at = self._hadoop(name)
        other, target = to._hadoop(name)
        if other.exists(target) and not overwrite:
            return
        # a copy that breaks off is not seen under the name
        draft = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{to.path(name)}.{uuid.uuid4().hex}.part")
        util = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil
        util.copy(system, at, other, draft, False, self.spark.sparkContext._jsc.hadoopConfiguration())
        other.mkdirs(target.getParent())
        other.rename(draft, target)

    def exists(self, name: str) -> bool:
        system, at = self._hadoop(name)
        return bool(system.exists(at))

    def delete(self, name: str) -> None:
        system, at = self._hadoop(name)
        system.delete(at, True)

    def read_json(self, name: str) -> Any:
        found = self.read(name)
        return None if found is None else json.loads(found)


def canonical(value: Any) -> bytes:
    """Canonical JSON of a manifest: it is hashed."""
    return json.dumps(value, sort_keys=True, separators=(",", ":")).encode()
