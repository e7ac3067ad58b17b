"""Versions of a stored table set: numbered JSON files, of which a new one appears whole or not at all."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the version."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _fs(spark, path)
    return fs.exists(at)


def names(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder; nothing where there is none."""
    at, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _fs(spark, path)
    fs.delete(at, True)


def signature(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files below some paths: another one where a table was written anew."""
    rows = []
    for path in paths:
        at, fs = _fs(spark, path)
        found = fs.listFiles(at, True)
        while found.hasNext():
            f = found.next()
            rows.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(rows)).encode()).hexdigest()


def versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(n[:-5]) for n in names(spark, folder) if n.endswith(".json") and n[:-5].isdigit())


def read(spark: SparkSession, folder: str, version: int | None = None) -> dict | None:
    """The newest version (or the one given), null where there is none."""
    known = versions(spark, folder)
    if not known:
        return None
    at, fs = _fs(spark, f"{folder}/{known[-1] if version is None else version}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, version: int, content: dict) -> None:
    """Write a version under another name and give it its own in one step; raises Conflict where it is taken."""
    hidden, fs = _fs(spark, f"{folder}/.{uuid.uuid4().hex}")
    stream = fs.create(hidden, True)
    stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    stream.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, _ = _fs(spark, f"{folder}/{version}.json")
    try:
        context = hadoop.FileContext.getFileContext(hidden.toUri(), spark._jsc.hadoopConfiguration()) if hidden.toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
        context.rename(hidden, target, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Exception as error:
        fs.delete(hidden, False)
        if "FileAlreadyExists" in str(error):
            raise Conflict(f"version {version} of {folder} exists") from error
        raise
