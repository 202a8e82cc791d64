"""Versioned artifacts: tables saved as "<prefix><number>.parquet" in a folder, listed, loaded, and fetched again when newer.

A version appears as a whole or not at all: it is written under another name and renamed. `kept` holds what is built from files in the
session's shared folder, named by the package's version and a fingerprint of those files (paths, lengths, times), so that each later query reads it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import __version__
from ..storage import checkpoint_dir


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, folder: str, prefix: str) -> list[tuple[int, str, int]]:
    """(number, path, time) of the artifacts with this prefix, in order of their numbers; none where the folder is missing."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return []
    found = [(re.fullmatch(re.escape(prefix) + r"(\d+)(?:\.\w+)?", s.getPath().getName()), s) for s in fs.listStatus(p)]
    return sorted((int(m[1]), s.getPath().toString(), s.getModificationTime()) for m, s in found if m)


def next_name(spark: SparkSession, folder: str, prefix: str) -> str:
    """The name after the newest one."""
    return f"{prefix}{max((v[0] for v in versions(spark, folder, prefix)), default=0) + 1}.parquet"


def save(df: DataFrame, folder: str, prefix: str) -> str:
    """Writes the next version and returns its path."""
    spark = df.sparkSession
    path = f"{folder}/{next_name(spark, folder, prefix)}"
    _write(df, path)
    return path


def load(spark: SparkSession, folder: str, prefix: str, version: int | None = None) -> DataFrame:
    """The newest version, or the one asked for; without any, an error that names what is missing."""
    found = [path for number, path, _ in versions(spark, folder, prefix) if version in (None, number)]
    if not found:
        raise FileNotFoundError(f"no artifact {prefix}{'*' if version is None else version} in {folder}")
    return spark.read.parquet(found[-1])


def fetch_if_newer(spark: SparkSession, remote: str, local: str) -> bool:
    """Copies a file or folder if it is newer than the local one, or if there is none. What can't be fetched is a warning; the local one stays in use."""
    try:
        (rfs, r), (lfs, target) = _fs(spark, remote), _fs(spark, local)
        if lfs.exists(target) and lfs.getFileStatus(target).getModificationTime() >= rfs.getFileStatus(r).getModificationTime():
            return False
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{local}.{uuid.uuid4().hex}")
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(rfs, r, lfs, part, False, spark.sparkContext._jsc.hadoopConfiguration())
        lfs.delete(target, True)
        return bool(lfs.rename(part, target))
    except Exception as e:
        warnings.warn(f"{remote} can't be fetched, {local} stays in use: {str(e).splitlines()[0]}", stacklevel=2)
        return False


def fingerprint(df: DataFrame) -> str | None:
    """Of the files a table is read from: paths, lengths and times. None if it isn't read from files."""
    found = []
    for f in sorted(df.inputFiles()):
        fs, p = _fs(df.sparkSession, f)
        s = fs.getFileStatus(p)
        found.append((f, s.getLen(), s.getModificationTime()))
    return hashlib.blake2b(repr(found).encode(), digest_size=12).hexdigest() if found else None


def kept(source: DataFrame, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """build(), made once for the files that `source` is read from and read from the shared folder afterwards."""
    spark, mark = source.sparkSession, fingerprint(source)
    if mark is None:
        return build()
    path = f"{checkpoint_dir(spark)}/kept/{name}-{__version__}-{mark}.parquet"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        _write(build(), path)
    return spark.read.parquet(path)


def _write(df: DataFrame, path: str) -> None:
    fs, target = _fs(df.sparkSession, path)
    part = f"{path}.{uuid.uuid4().hex}"
    df.write.parquet(part)
    source = df.sparkSession._jvm.org.apache.hadoop.fs.Path(part)
    if fs.exists(target) or not fs.rename(source, target):
        fs.delete(source, True)  # another driver was faster
