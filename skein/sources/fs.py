"""Small files in whatever store a path names, through Hadoop's file systems."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The content of a small file, None if there is none."""
    jvm, place, fs = _at(spark, path)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, sorted; nothing if there is none."""
    _, place, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(place)) if fs.exists(place) else []


def put_new_file(path: str, content: str) -> bool:
    """put_new for a path of this machine or a mounted one, without Spark: the whole file appears at once, by a link."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fresh = f"{path}.{uuid.uuid4().hex}.new"
    with open(fresh, "w", encoding="utf-8") as f:
        f.write(content)
    try:
        os.link(fresh, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(fresh)
    return True


def put_new(spark: SparkSession, path: str, content: str) -> bool:
    """Write a small file that does not exist yet; False, and nothing is written, if it does.

    Other file systems than the local one create it exclusively, so that a reader may find it empty until it is closed.
    """
    _, place, fs = _at(spark, path)
    if fs.getUri().getScheme() == "file":
        return put_new_file(place.toUri().getPath(), content)
    try:
        stream = fs.create(place, False)
    except Py4JJavaError as e:
        if fs.exists(place):
            return False
        raise e
    try:
        stream.write(bytearray(content.encode()))
    finally:
        stream.close()
    return True


def delete(spark: SparkSession, path: str) -> None:
    _, place, fs = _at(spark, path)
    fs.delete(place, True)
