"""Small files and listings through Hadoop's file systems, so that a path may be on any of them."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, directory: str) -> list[str]:
    """The names in a directory, sorted; none if it is absent."""
    where, fs = _at(spark, directory)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file, or None if it is absent."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the path and moves over it in one step: readers see the old text or the new one."""
    jvm = spark.sparkContext._jvm
    staged, fs = _at(spark, f"{path}.staged")
    stream = fs.create(staged, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    final = jvm.org.apache.hadoop.fs.Path(path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(staged).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(staged), fs.makeQualified(final), how)


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a file or folder; whether there was one."""
    where, fs = _at(spark, path)
    return bool(fs.delete(where, True))
