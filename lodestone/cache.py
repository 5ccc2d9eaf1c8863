"""A cache of transformed texts: Parquet, keyed by the hash of a text and of what was asked of it."""

from __future__ import annotations

import hashlib
import os
import shutil
import time
import uuid
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Changes whenever a transform gives other results.
VERSION = "2"
STALE_DAYS = 30


class CacheStore(Protocol):
    """What a pack needs of a cache; ``key`` names a row."""

    def load(self, spark: SparkSession) -> DataFrame | None: ...

    def save(self, used: DataFrame) -> None: ...


class ParquetCache:
    """A cache of one project below ``folder``. A save keeps only what the last run used, and puts it in place at once."""

    def __init__(self, identity: str, folder: str | Path | None = None) -> None:
        self.folder = Path(folder or default_folder())
        self.path = self.folder / hashlib.sha1(f"{VERSION}|{identity}".encode()).hexdigest()[:16]

    def load(self, spark: SparkSession) -> DataFrame | None:
        """The rows of the last run; None if there are none (or of another version)."""
        return spark.read.parquet(str(self.path)) if any(self.path.glob("*.parquet")) else None

    def save(self, used: DataFrame) -> None:
        """Write beside the old rows, then swap; projects that weren't packed for a month go."""
        fresh = self.folder / f"{self.path.name}.{uuid.uuid4().hex}"
        used.dropDuplicates(["key"]).write.parquet(str(fresh))
        old = self.folder / f"{self.path.name}.old"
        if self.path.exists():
            shutil.rmtree(old, ignore_errors=True)
            os.rename(self.path, old)
        os.rename(fresh, self.path)
        shutil.rmtree(old, ignore_errors=True)
        os.utime(self.path)
        prune(self.folder)


def default_folder() -> Path:
    return Path(os.environ.get("XDG_CACHE_HOME") or Path.home() / ".cache") / "lodestone"


def prune(folder: str | Path, days: float = STALE_DAYS) -> int:
    """Delete the caches of projects that weren't packed for some days; how many."""
    limit, gone = time.time() - days * 86_400, 0
    for p in Path(folder).iterdir() if Path(folder).is_dir() else ():
        if p.is_dir() and p.stat().st_mtime < limit:
            shutil.rmtree(p, ignore_errors=True)
            gone += 1
    return gone


def info(folder: str | Path | None = None) -> dict[str, int]:
    """How many projects are cached, in how many files and bytes."""
    folder = Path(folder or default_folder())
    files = [f for f in folder.rglob("*.parquet")] if folder.is_dir() else []
    return {"projects": sum(p.is_dir() for p in folder.iterdir()) if folder.is_dir() else 0, "files": len(files), "bytes": sum(f.stat().st_size for f in files)}


def clear(folder: str | Path | None = None) -> int:
    """Delete all caches; how many there were."""
    return prune(folder or default_folder(), 0) if Path(folder or default_folder()).is_dir() else 0


def retained(cache: DataFrame, used: DataFrame) -> DataFrame:
    """The rows of a cache whose keys a run used."""
    return cache.join(used.select("key").distinct(), "key", "left_semi")


def counts(looked_up: DataFrame) -> DataFrame:
    """Hits and misses of a run: one row, from rows with ``hit``."""
    return looked_up.agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
