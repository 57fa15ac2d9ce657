"""Tables that change by whole versions: a reader sees one version or another, never half.

Data goes to new folders first.  A version is one small file under ``_versions``, named by its
number, which lists the folders that make up the table; it is created only if no file has that
number, and ends in a line of its own, so the highest whole file is the current version.  A
writer that dies leaves folders that no version lists.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, where = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Versions of the table, oldest first."""
    return sorted(int(n) for n in _children(spark, f"{path}/_versions") if re.fullmatch(r"\d+", n))


def _listed(spark: SparkSession, path: str, number: int) -> dict[str, str] | None:
    fs, where = _fs(spark, f"{path}/_versions/{number}")
    stream = fs.open(where)
    try:
        *lines, end = bytes(stream.readAllBytes()).decode().split("\n")
    finally:
        stream.close()
    return {k: f"{path}/{v}" for k, v in (line.split("\t", 1) for line in lines)} if end == "end" else None


def current(spark: SparkSession, path: str) -> dict[str, str]:
    """The parts of the current version, and the folders they are in."""
    return next((found for n in reversed(numbers(spark, path)) if (found := _listed(spark, path, n)) is not None), {})


def new_folder(path: str) -> str:
    return f"{path}/data-{uuid.uuid4().hex}"


def last(spark: SparkSession, path: str) -> int | None:
    known = numbers(spark, path)
    return known[-1] if known else None


def commit(spark: SparkSession, path: str, parts: dict[str, str], after: int | None) -> int:
    """Makes ``parts`` the version after number ``after``, as ``last`` told it before the parts
    were read; raises FileExistsError if another writer has made that version meanwhile."""
    number = 0 if after is None else after + 1
    fs, where = _fs(spark, f"{path}/_versions/{number}")
    try:
        out = fs.create(where, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e):
            raise FileExistsError(f"version {number} of {path}") from None
        raise
    out.write(("".join(f"{k}\t{v.removeprefix(path + '/')}\n" for k, v in parts.items()) + "end").encode())
    out.close()
    return number


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes all but the last ``keep`` versions, and data folders that none of these list.  Not
    to be run beside a writer, whose folders no version lists yet.  Returns how many folders went."""
    known = numbers(spark, path)
    kept = {f for n in known[-keep:] for f in (_listed(spark, path, n) or {}).values()}
    for n in known[:-keep]:
        fs, where = _fs(spark, f"{path}/_versions/{n}")
        fs.delete(where, False)
    gone = [f"{path}/{c}" for c in _children(spark, path) if c.startswith("data-") and not any(k == f"{path}/{c}" or k.startswith(f"{path}/{c}/") for k in kept)]
    for folder in gone:
        fs, where = _fs(spark, folder)
        fs.delete(where, True)
    return len(gone)
