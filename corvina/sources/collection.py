"""Versioned collections: data folders that are never overwritten, and numbered manifests that say which of them make a version.

A manifest ``manifests/00000001.json`` is put only if there is none of that number, so of two writers one is refused and tries again on
what the other wrote.  Readers take the highest manifest that is complete (it ends with a line end), so there is no step at which a
reader finds nothing, and what a reader began to read stays until it is vacuumed.  A manifest bears the time it was made: older versions are the backups.

A collection of no version is read as an error; one of no rows has its schema.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRIES = 10


class Conflict(Exception):
    """Another writer put the version first."""


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, root: str):
    return _path(spark, root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _manifests(spark: SparkSession, root: str) -> dict[int, str]:
    """Version -> path of the manifests, complete or not; one for each version that was not vacuumed."""
    fs, folder = _fs(spark, root), _path(spark, f"{root}/manifests")
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return {int(n[:8]): f"{root}/manifests/{n}" for n in names if n.endswith(".json") and n[:8].isdigit()}


def _told(spark: SparkSession, path: str) -> dict | None:
    """A manifest, or None where it is still being written."""
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        raw = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(raw) if raw.endswith("\n") else None


def latest(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The highest complete version and its manifest; (0, None) if there is none."""
    found = _manifests(spark, root)
    for version in sorted(found, reverse=True):
        if told := _told(spark, found[version]):
            return version, told
    return 0, None


def _put(spark: SparkSession, root: str, version: int, told: dict) -> None:
    path = _path(spark, f"{root}/manifests/{version:08d}.json")
    try:
        out = _fs(spark, root).create(path, False)
    except Py4JJavaError as e:
        raise Conflict(f"{root} has a version {version}") from e
    try:
        out.write(bytearray((json.dumps(told) + "\n").encode()))
    finally:
        out.close()


def _commit(rows: DataFrame, root: str, version: int, kept: list[str], note: str) -> int:
    """Writes ``rows`` and puts a manifest of them and the folders ``kept`` as ``version``."""
    spark, folder = rows.sparkSession, f"data/{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/{folder}")
    at = spark.range(1).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("at")).first()["at"]
    try:
        _put(spark, root, version, {"version": version, "at": at, "note": note, "folders": [*kept, folder], "schema": rows.schema.jsonValue()})
    except Conflict:
        _fs(spark, root).delete(_path(spark, f"{root}/{folder}"), True)
        raise
    return version


def write(rows: DataFrame, root: str) -> int:
    """A version of ``rows`` alone; returns its number."""
    return _again(lambda version, told: _commit(rows, root, version + 1, [], "write"), rows.sparkSession, root)


def append(rows: DataFrame, root: str) -> int:
    """A version with ``rows`` beside what is there, which is not written again."""

    def step(version: int, told: dict | None) -> int:
        like = rows if told is None else rows.select(*[F.col(f["name"]) for f in told["schema"]["fields"]])
        return _commit(like, root, version + 1, told["folders"] if told else [], "append")

    return _again(step, rows.sparkSession, root)


def rewrite(spark: SparkSession, root: str, change: Callable[[DataFrame], DataFrame], note: str = "rewrite") -> int:
    """A version of what ``change`` makes of the latest; made again from the start where another writer came first."""

    def step(version: int, told: dict | None) -> int:
        return _commit(change(_rows(spark, root, told)), root, version + 1, [], note)

    return _again(step, spark, root)


def upsert(spark: SparkSession, root: str, new: DataFrame, key: str = "id", deleted: DataFrame | None = None) -> int:
    """Rows of ``new`` replace those of equal key, rows of ``deleted`` go."""

    def change(old: DataFrame) -> DataFrame:
        kept = old.join(new.select(key), key, "left_anti")
        if deleted is not None:
            kept = kept.join(deleted.select(key), key, "left_anti")
        return kept.unionByName(new, allowMissingColumns=True)

    return rewrite(spark, root, change, "upsert")


def _again(step: Callable[[int, dict | None], int], spark: SparkSession, root: str) -> int:
    for k in range(TRIES):
        try:
            version, told = latest(spark, root)
            # what another writer is about to complete counts as a version too
            return step(max([version, *_manifests(spark, root)]) if k else version, told)
        except Conflict:
            if k == TRIES - 1:
                raise
    raise AssertionError


def _rows(spark: SparkSession, root: str, told: dict | None) -> DataFrame:
    if told is None:
        raise ValueError(f"{root} has no version")
    return spark.read.schema(T.StructType.fromJson(told["schema"])).parquet(*[f"{root}/{f}" for f in told["folders"]])


def read(spark: SparkSession, root: str, version: int | None = None, as_of: str | None = None) -> DataFrame:
    """The latest version, a numbered one, or the last made until ``as_of`` (a time)."""
    if version is None and as_of is None:
        return _rows(spark, root, latest(spark, root)[1])
    found = _manifests(spark, root)
    for v in sorted(found, reverse=True):
        told = _told(spark, found[v]) if version in (None, v) else None
        if told and (as_of is None or told["at"] <= as_of):
            return _rows(spark, root, told)
    raise ValueError(f"{root} has no such version")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Deletes all but the last ``keep`` versions: their manifests first, then folders that no manifest names; returns these.

    Folders that a writer has not committed yet are spared if they are newer than the oldest manifest that is kept.
    """
    fs, found = _fs(spark, root), _manifests(spark, root)
    whole = [v for v in sorted(found, reverse=True) if _told(spark, found[v])]
    for v in whole[keep:]:
        fs.delete(_path(spark, found[v]), False)
    kept = {f for v in whole[:keep] for f in _told(spark, found[v])["folders"]}
    oldest = min((fs.getFileStatus(_path(spark, found[v])).getModificationTime() for v in whole[:keep]), default=0)
    gone = [s for s in fs.listStatus(_path(spark, f"{root}/data")) if f"data/{s.getPath().getName()}" not in kept and s.getModificationTime() < oldest]
    for s in gone:
        fs.delete(s.getPath(), True)
    return sorted(s.getPath().getName() for s in gone)
