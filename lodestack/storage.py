"""Written tables in the folder that all executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where none is named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own_dir:
        _own_dir["dir"] = "file://" + tempfile.mkdtemp(prefix="lodestack-")
    return _own_dir["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestack/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, codec: str = "zstd", bag: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The path is added to ``bag``, for ``discard`` once nothing reads the table any more."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    if bag is not None:
        bag.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, bag: list[str]) -> None:
    """Deletes the written tables of ``bag`` and empties it."""
    while bag:
        delete_path(spark, bag.pop())


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def delete_path(spark: SparkSession, path: str) -> None:
    system, target = _file_system(spark, path)
    system.delete(target, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    system, target = _file_system(spark, path)
    return system.exists(target)


def rename_path(spark: SparkSession, source: str, target: str) -> None:
    """Fails where ``target`` is there: a folder would move into it."""
    system, old = _file_system(spark, source)
    new = _file_system(spark, target)[1]
    if system.exists(new):
        raise FileExistsError(target)
    if not system.rename(old, new):
        raise OSError(f"{source} cannot be renamed to {target}")


def files_of(spark: SparkSession, paths: list[str]) -> list[tuple[str, int, int]]:
    """(path, bytes, time of change) of those of the files that are listed, in the order of their paths; folders are listed once each."""
    wanted, out = set(paths), []
    for folder in sorted({p.rpartition("/")[0] for p in paths}):
        system, target = _file_system(spark, folder)
        for found in system.listStatus(target):
            uri = found.getPath().toUri()
            names = {uri.toString(), found.getPath().toString(), "file://" + uri.getPath()}
            if names & wanted:
                out.append((found.getPath().toString(), found.getLen(), found.getModificationTime()))
    return sorted(out)


def join_parts(spark: SparkSession, folder: str, out: str, head: bytes = b"", tail: bytes = b"") -> None:
    """One local file of ``head``, the part files of ``folder`` by name, and ``tail``; a block of bytes at a time."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    system, target = _file_system(spark, folder)
    stream = jvm.java.io.FileOutputStream(out)
    try:
        stream.write(bytearray(head))
        for part in sorted((x.getPath() for x in system.listStatus(target) if x.getPath().getName().startswith("part-")), key=lambda p: p.getName()):
            source = system.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, conf, False)
            finally:
                source.close()
        stream.write(bytearray(tail))
        stream.getFD().sync()
    finally:
        stream.close()
