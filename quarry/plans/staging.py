"""Lineage cuts: intermediate tables in the folder that all executors share.

``stage`` writes a frame as Parquet below ``spark.checkpoint.dir`` and reads it
back. A lost executor therefore costs only the tasks it was running, and a
frame that is used twice (or that holds non-deterministic values such as
partition ids) is computed once.

Tables belong to the run that wrote them: ``scope()`` is a context of the
calling thread, and when it ends it deletes what was staged within it, except what
it was told to keep, which goes to the scope around it. No run ever deletes
another's tables. What belongs to no scope lives until the driver ends.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


class Scope:
    """The staged paths of one run."""

    def __init__(self, outer: Scope | None = None):
        self.outer, self.paths, self.kept = outer, {}, set()

    def keep(self, *frames: DataFrame) -> None:
        """Spare the tables that these frames read, however many steps lie between."""
        for df in frames:
            read = {_bare(os.path.dirname(f)) for f in df.inputFiles()}
            read |= {_bare(df._quarry_path)} if hasattr(df, "_quarry_path") else set()
            self.kept |= {p for p in self.paths if any(r == _bare(p) or r.startswith(f"{_bare(p)}/") for r in read)}

    def close(self) -> None:
        for path, spark in self.paths.items():
            if path in self.kept and self.outer is not None:
                self.outer.paths[path] = spark
            elif path not in self.kept:
                with contextlib.suppress(Exception):  # the session may have ended
                    drop_path(spark, path)
        self.paths = {}


#: What no run owns.
_LASTING = Scope()
_CURRENT: ContextVar[Scope] = ContextVar("quarry-scope", default=_LASTING)
_FIRST = threading.Lock()
_REGISTERED: list[bool] = []


@contextlib.contextmanager
def scope() -> Iterator[Scope]:
    """A run of the calling thread: ``with scope() as run: ... run.keep(result)``."""
    own = Scope(_CURRENT.get())
    token = _CURRENT.set(own)
    try:
        yield own
    finally:
        _CURRENT.reset(token)
        own.close()


def scoped(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """``function`` in a scope of its own, which keeps what the returned frame still reads."""

    @functools.wraps(function)
    def run(*args, **options) -> DataFrame:
        with scope() as own:
            out = function(*args, **options)
            own.keep(out)
        return out

    return run


def _bare(path: str) -> str:
    """A path without scheme and authority, as listings of files may write them in several ways."""
    return unquote(urlparse(path).path).rstrip("/")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names. Only a local session, where there is one machine, may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.quarry.local.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"quarry-{uuid.uuid4().hex}")
        spark.conf.set("spark.quarry.local.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str, lasting: bool = False) -> str:
    """A fresh path below the shared folder; it belongs to the current scope, or to the session if ``lasting``."""
    path = f"{checkpoint_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    with _FIRST:
        if not _REGISTERED:
            atexit.register(release)
            _REGISTERED.append(True)
    (_LASTING if lasting else _CURRENT.get()).paths[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return _at(spark.read.schema(df.schema).parquet(path), path)


def _at(df: DataFrame, path: str) -> DataFrame:
    df._quarry_path = path
    return df


def discard(*frames: DataFrame) -> None:
    """Delete staged tables now that everything made from them is staged itself."""
    for df in frames:
        path, at = df._quarry_path, _CURRENT.get()
        drop_path(df.sparkSession, path)
        while at is not None:
            at.paths.pop(path, None)
            at = at.outer


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Delete every table that belongs to the session; results that read them end with this."""
    _LASTING.close()
