"""Folder checks and file times through the Hadoop file system API, so that
they hold on any storage that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, bytes, modification time) of the entries of a folder."""
    fs, p = _fs(spark, path)
    return [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)]


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def stamp(spark: SparkSession, path: str) -> tuple:
    """Size and newest change of a file or folder: the version of an input."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return ()
    if fs.getFileStatus(p).isFile():
        s = fs.getFileStatus(p)
        return (s.getLen(), s.getModificationTime())
    files = fs.listStatus(p)
    return (sum(f.getLen() for f in files), max((f.getModificationTime() for f in files), default=0), len(files))


def order_folders(spark: SparkSession, path: str) -> None:
    """Give the files of sub-folder number n (by name) the n-th modification
    time, the order in which a file stream reads them."""
    fs, p = _fs(spark, path)
    folders = sorted((f for f in fs.listStatus(p) if f.isDirectory()), key=lambda f: f.getPath().getName())
    base = 1_000_000_000_000
    for n, folder in enumerate(folders):
        for f in fs.listStatus(folder.getPath()):
            fs.setTimes(f.getPath(), base + 1000 * n, -1)
