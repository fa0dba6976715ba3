"""Numbered commits of a folder: a run counts only once its marker is there, and the marker appears whole."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Commits:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def all(self) -> list[dict]:
        """What was committed, in order."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/commits")):
            return []
        rows = self.spark.read.text(f"{self.path}/commits").collect()
        return sorted((json.loads(r[0]) for r in rows), key=lambda c: c["number"])

    def add(self, what: dict) -> None:
        """Create the marker of ``what['number']`` by a rename, which either happens whole or not at all."""
        fs, path = self._fs()
        aside, final = path(f"{self.path}/.commit-{what['run']}"), path(f"{self.path}/commits/{what['number']:08d}.json")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(what).encode()))
        out.close()
        fs.mkdirs(path(f"{self.path}/commits"))
        if fs.exists(final) or not fs.rename(aside, final):
            raise RuntimeError(f"run {what['number']} was committed by another writer")
