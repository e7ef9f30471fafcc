"""Session helpers: a tuned local session for tests and benches, and the shared folder for cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "8g", app: str = "strandline") -> SparkSession:
    """A local[cpus] session with the settings that the library is tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir as the cluster sets it. Where it is unset, a local session has one of its own."""
    set_dir = spark.conf.get("spark.checkpoint.dir", "")
    if set_dir:
        return set_dir.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"strandline-{os.getpid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


class files:  # noqa: N801
    """Small files and folders on any file system that Spark knows."""

    def __init__(self, spark: SparkSession) -> None:
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.conf), place

    def names(self, folder: str) -> list[str]:
        """The names in a folder, none if there is no such folder."""
        fs, place = self._at(folder)
        return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []

    def text(self, path: str) -> str:
        fs, place = self._at(path)
        stream = fs.open(place)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Writes beside and renames, so that no reader sees half of it."""
        fs, place = self._at(path)
        _, draft = self._at(f"{path.rpartition('/')[0]}/.{path.rpartition('/')[2]}")
        stream = fs.create(draft, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not fs.rename(draft, place):
            raise OSError(f"could not write {path}")

    def delete(self, path: str) -> None:
        fs, place = self._at(path)
        fs.delete(place, True)
