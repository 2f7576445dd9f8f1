"""Small numbered files that are written once, for announcements that writers may race for.

A file appears whole or not at all, and never over another one. On HDFS and stores with its
semantics that is a rename that refuses to overwrite, on a local disk a hard link.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_DIGITS = 20


def numbered(folder: str, number: int) -> str:
    """The path of an announcement; names sort as their numbers do."""
    return f"{folder.rstrip('/')}/{number:0{_DIGITS}d}.json"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def read(spark: SparkSession, path: str) -> dict:
    found, system = _path(spark, path)
    stream = system.open(found)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, content: dict) -> bool:
    """Write the file unless there is one; tells whether it was written. Of several writers one succeeds."""
    jvm = spark._jvm
    target, system = _path(spark, path)
    system.mkdirs(target.getParent())
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_{uuid.uuid4().hex}")
    stream = system.create(draft, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    try:
        if system.getScheme() == "file":
            # A local rename would replace what is there; a link does not.
            local = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(local.get(target.toUri().getPath(), _none(spark)), local.get(draft.toUri().getPath(), _none(spark)))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration())
            options = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(system.makeQualified(draft), system.makeQualified(target), options)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        system.delete(draft, False)
    return True


def _none(spark: SparkSession):
    return spark._sc._gateway.new_array(spark._jvm.java.lang.String, 0)


def newest(spark: SparkSession, folder: str) -> int | None:
    """The highest number announced in the folder, where numbers run from 0 without a gap.

    Found by doubling and halving, so the folder is never listed however many there are.
    """

    def there(number: int) -> bool:
        return exists(spark, numbered(folder, number))

    if not there(0):
        return None
    step = 1
    while there(step):
        step *= 2
    low = step // 2  # is there, unless it is 0, which is there too
    while step - low > 1:
        middle = (low + step) // 2
        low, step = (middle, step) if there(middle) else (low, middle)
    return low
