"""Files that are created once: what commits and claims of several drivers are decided by."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file if there is none of its name; of several that try, one succeeds, and no reader sees half of it.

    Local files are linked under their name when they are whole; other file systems create
    without overwriting, which HDFS and object stores with conditional writes do atomically.
    """
    where, system = _at(spark, path)
    parent = where.getParent()
    system.mkdirs(parent)
    jvm = spark._jvm
    data = bytearray(text.encode())
    try:
        if system.getUri().getScheme() == "file":
            target = jvm.java.nio.file.Path.of(where.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            draft = target.resolveSibling(f".{target.getFileName()}-{jvm.java.util.UUID.randomUUID()}")
            jvm.java.nio.file.Files.write(draft, data, spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 0))
            try:
                jvm.java.nio.file.Files.createLink(target, draft)
            finally:
                jvm.java.nio.file.Files.delete(draft)
        else:
            out = system.create(where, False)
            out.write(data)
            out.close()
    except Exception as e:  # noqa: BLE001  only an existing file is a lost race
        if "AlreadyExists" in str(e):
            return False
        raise
    return True


def overwrite(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file of one writer."""
    where, system = _at(spark, path)
    out = system.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None if there is none."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return None
    source = system.open(where)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; drafts, which begin with a point, are left out."""
    where, system = _at(spark, path)
    if not system.exists(where):
        return []
    found = [x.getPath().getName() for x in system.listStatus(where)]
    return sorted(x for x in found if not x.startswith("."))


def modified(spark: SparkSession, path: str) -> float:
    """When a file was written last, by the file system's clock."""
    where, system = _at(spark, path)
    return system.getFileStatus(where).getModificationTime() / 1000
