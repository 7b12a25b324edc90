"""Small files beside the data: on local paths, or through Hadoop's file systems where the path names one."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def _remote(path: str):
    """(file system, path class) of a path with a scheme."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError(f"{path} needs a running session")
    jvm = spark.sparkContext._jvm
    kind = jvm.org.apache.hadoop.fs.Path
    return kind(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), kind, jvm


def exists(path: str) -> bool:
    if "://" not in path:
        return Path(path).exists()
    fs, kind, _ = _remote(path)
    return fs.exists(kind(path))


def read_text(path: str) -> str | None:
    """The text of a file, None where there is none."""
    if "://" not in path:
        file = Path(path)
        return file.read_text() if file.exists() else None
    fs, kind, jvm = _remote(path)
    if not fs.exists(kind(path)):
        return None
    stream = fs.open(kind(path))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(path: str, text: str) -> None:
    """Replace a file as a whole: readers see the old text or the new one."""
    if "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        new = f"{path}.new"
        with open(new, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(new, path)
        return
    fs, kind, jvm = _remote(path)
    new = kind(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
    overwrite = SparkSession.getActiveSession().sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(new, kind(path), overwrite)


def stamp(paths: list[str]) -> tuple:
    """Size and time of files: differs when one of them was written again."""
    found = []
    for p in sorted(paths):
        fs, kind, _ = _remote(p)
        status = fs.getFileStatus(kind(p))
        found.append((p, status.getLen(), status.getModificationTime()))
    return tuple(found)
