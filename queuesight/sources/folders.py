"""Folders on any file system that Spark knows, from the driver: names and small files only."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, sorted; none if it does not exist."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(place))


def is_folder(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place) and files.getFileStatus(place).isDirectory()


def create_json(spark: SparkSession, path: str, value: dict) -> None:
    """Write a small file that must not be there yet: of two writers one fails."""
    place, files = _place(spark, path)
    if files.exists(place):
        raise FileExistsError(path)
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{spark._jvm.java.util.UUID.randomUUID()}")
    out = files.create(fresh, True)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri(), spark._jsc.hadoopConfiguration())
    options = spark._sc._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)  # refuses to replace
    try:
        context.rename(fresh, place, options)
    except Exception as problem:
        files.delete(fresh, False)
        if files.exists(place):
            raise FileExistsError(path) from problem
        raise


def read_json(spark: SparkSession, path: str) -> dict:
    place, files = _place(spark, path)
    stream = files.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
