"""Loads that are stored whole or not at all.

A load writes its tables into a folder of its own, `batches/<name>/<attempt>`. One small
file, `batches/<name>/COMMITTED`, created last and only where there is none, makes them
part of the target: it names the attempt and holds the counts. Readers take committed
attempts only, so a load that dies leaves nothing to be seen. Repeating it writes a new
attempt; repeating a committed one changes nothing. Of two writers of one name the first
to commit wins, on any storage that creates a file only once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from basketwise.session import hadoop_path

FOLDER, MANIFEST = "batches", "COMMITTED"


@dataclass(frozen=True)
class Batch:
    """A committed load: its name, the attempt that holds its tables, and what its writer noted."""

    name: str
    attempt: str
    notes: dict

    def path(self, target: str, part: str) -> str:
        return f"{_place(target, self.name)}/{self.attempt}/{part}"


def committed(spark: SparkSession, target: str) -> list[Batch]:
    """All committed batches of a target, by name."""
    pattern, files = hadoop_path(spark, f"{target}/{FOLDER}/*/{MANIFEST}")
    found = [_read(spark, str(status.getPath())) for status in files.globStatus(pattern) or []]
    return sorted((batch for batch in found if batch), key=lambda batch: batch.name)


def find(spark: SparkSession, target: str, name: str) -> Batch | None:
    """The committed batch of this name."""
    return _read(spark, f"{_place(target, name)}/{MANIFEST}")


def paths(spark: SparkSession, target: str, part: str) -> list[str]:
    """The folders that hold a part, such as a table, of the committed batches."""
    return [batch.path(target, part) for batch in committed(spark, target)]


def store(spark: SparkSession, target: str, name: str | None, write: Callable[[str], dict]) -> Batch:
    """Let `write` fill a folder and commit it under `name`, or a new name; returns what is committed.

    `write` returns notes, plain values, for the manifest. If it fails, its folder goes. If the
    name is committed already, before or meanwhile, that batch stays and is returned.
    """
    name = uuid.uuid4().hex if name is None else name
    done = find(spark, target, name)
    if done:
        return done
    attempt = uuid.uuid4().hex
    folder = f"{_place(target, name)}/{attempt}"
    try:
        notes = write(folder)
    except BaseException:
        _delete(spark, folder)
        raise
    own = Batch(name, attempt, notes)
    while not _create(spark, f"{_place(target, name)}/{MANIFEST}", own):
        other = find(spark, target, name)
        if other:
            _delete(spark, folder)
            return other
        # Its writer died while writing it.
        _delete(spark, f"{_place(target, name)}/{MANIFEST}")
    return own


def remove(spark: SparkSession, target: str, batch: Batch) -> None:
    """Take a committed batch away, its manifest first."""
    _delete(spark, f"{_place(target, batch.name)}/{MANIFEST}")
    _delete(spark, _place(target, batch.name))


def _place(target: str, name: str) -> str:
    return f"{target}/{FOLDER}/{quote(name, safe='')}"


def _create(spark: SparkSession, path: str, batch: Batch) -> bool:
    """Write a manifest where there is none."""
    where, files = hadoop_path(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(where):
            return False
        raise
    try:
        out.write(bytearray(json.dumps({"attempt": batch.attempt, "notes": batch.notes}).encode() + b"\n"))
    finally:
        out.close()
    return True


def _read(spark: SparkSession, path: str) -> Batch | None:
    """The manifest at `path`; none if there is none or it is not whole."""
    where, files = hadoop_path(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    if not text.endswith("\n"):
        return None
    held = json.loads(text)
    return Batch(unquote(where.getParent().getName()), held["attempt"], held["notes"])


def _delete(spark: SparkSession, path: str) -> None:
    where, files = hadoop_path(spark, path)
    files.delete(where, True)
