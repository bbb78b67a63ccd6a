"""The scan's state in versions, and the lease that admits one run at a time."""

from __future__ import annotations

import json
import os
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from ..functions.scratch import read_or_empty

RANGES, ALIASES = "path string, start long, `end` long, sha256 string", "tool string, old_id string, event_id string"
BACKUPS = "path string, length long, modified timestamp"


class Superseded(RuntimeError):
    """Another run took the lease, or wrote the version, that this one was about to write."""


class Folder:
    """A folder in which small files are created once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def create(self, name: str, text: str) -> bool:
        """Whether this call made the file, whole. A local folder's files are linked into place, others
        rely on their file system's exclusive creation."""
        to = self._at(name)
        self.fs.mkdirs(to.getParent())
        if self.fs.getScheme() == "file":
            at = to.toUri().getPath()
            own = f"{at}.{uuid.uuid4().hex}"
            try:
                with open(own, "x") as f:
                    f.write(text)
                    f.flush()
                    os.fsync(f.fileno())
                os.link(own, at)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(own)
        try:
            out = self.fs.create(to, False)
        except Py4JJavaError:
            if self.fs.exists(to):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def text(self, name: str) -> str:
        source = self.fs.open(self._at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def versions(self) -> list[int]:
        return sorted(int(m[1]) for n in self.names("versions") if (m := re.fullmatch(r"v=(\d+)", n)))

    def seconds_old(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self._at(name)).getModificationTime() / 1000


class Lease:
    """The right to work, as a number: the highest that was ever created. It is over when a higher one is."""

    def __init__(self, state: State, number: int):
        self.state, self.number = state, number

    def holds(self) -> bool:
        return self.state.leases()[-1:] == [self.number]

    def release(self) -> None:
        """Marks this lease, and no other, as over."""
        self.state.create(f"leases/{self.number}.over", "")


class State(Folder):
    """Which ranges of which file were taken, with their digests, the aliases, and the store's files by
    which repeats were told.

    A version is a small file v=N that names the folder of its data, and is created only if no one
    else has: of two writers that began with the same version one fails, and loses nothing but its
    pass. Losing all of it costs a full scan and changes nothing, as ids in the store are permanent.
    """

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path)
        self.base = 0

    def leases(self) -> list[int]:
        return sorted(int(n) for n in self.names("leases") if n.isdigit())

    def lease(self, seconds: float) -> Lease | None:
        """The next number, if the last lease is over or so old that the watchdog has ended its run. Of many
        that ask at once, one creates it."""
        found = self.leases()
        last = found[-1] if found else 0
        if last and not self.fs.exists(self._at(f"leases/{last}.over")):
            if self.seconds_old(f"leases/{last}") <= seconds:
                return None
        if not self.create(f"leases/{last + 1}", ""):
            return None
        for old in found[:-1]:
            for name in (str(old), f"{old}.over"):
                self.fs.delete(self._at(f"leases/{name}"), False)
        return Lease(self, last + 1)

    def age(self) -> float | None:
        """Seconds since the last version."""
        found = self.versions()
        return self.seconds_old(f"versions/v={found[-1]}") if found else None

    def _data(self, version: int) -> str | None:
        """The folder of a version; none if its writer died within the file."""
        try:
            return json.loads(self.text(f"versions/v={version}"))["data"]
        except (ValueError, KeyError, TypeError):
            return None

    def read(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(ranges, aliases, backups) of the last version, upon which write() builds."""
        found = self.versions()
        self.base = found[-1] if found else 0
        data = next((d for v in reversed(found) if (d := self._data(v))), "none")
        at = lambda table, schema: read_or_empty(self.spark, f"{self.path}/{data}/{table}", schema)
        return at("ranges", RANGES), at("aliases", ALIASES), at("backups", BACKUPS)

    def write(self, ranges: DataFrame, aliases: DataFrame, backups: DataFrame | None = None, lease: Lease | None = None) -> None:
        """The version after the one that was read. It fails if that exists by now, or the lease is over."""
        data = f"data-{uuid.uuid4().hex}"
        ranges.select("path", "start", "end", "sha256").write.parquet(f"{self.path}/{data}/ranges")
        aliases.select("tool", "old_id", "event_id").write.parquet(f"{self.path}/{data}/aliases")
        if backups is not None:
            backups.select("path", "length", "modified").write.parquet(f"{self.path}/{data}/backups")
        if lease and not lease.holds():
            raise Superseded("the lease is over")
        if not self.create(f"versions/v={self.base + 1}", json.dumps({"data": data, "lease": lease.number if lease else None})):
            raise Superseded(f"version {self.base + 1} was written by another run")
        self.base += 1
        for v in self.versions():
            if v < self.base:
                old = self._data(v)
                if old:
                    self.fs.delete(self._at(old), True)
                self.fs.delete(self._at(f"versions/v={v}"), False)
