"""Tables that change together: each commit writes what changed, then one manifest that names it all.

A manifest is a small JSON file of the folder and the run's token; the newest complete one is the state. Data is
written before it, so a run that dies leaves the old state, and a run whose token is already there changes
nothing. Two runs that start from one state both create the next number; the second fails and is to
start anew. Files go through the path's own Hadoop file system, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another run has committed since this one read its state."""


class Versions:
    """The versions under a root folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._log = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifests")
        self._fs = self._log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifests(self) -> list[dict]:
        """Complete manifests, oldest first; one that was cut off is passed over."""
        if not self._fs.exists(self._log):
            return []
        out = []
        for status in self._fs.listStatus(self._log):
            stream = self._fs.open(status.getPath())
            try:
                text = bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
            try:
                out.append(json.loads(text))
            except ValueError:
                continue
        return sorted(out, key=lambda m: m["version"])

    def state(self) -> dict:
        return (self.manifests() or [{"version": 0, "token": None, "tables": {}}])[-1]

    def read(self, name: str, state: dict | None = None) -> DataFrame:
        """A table as of a state, the newest by default."""
        return self.spark.read.parquet(f"{self.root}/{(state or self.state())['tables'][name]}")

    def commit(self, changes: dict[str, DataFrame], token: str, base: dict | None = None) -> int:
        """The version that holds the changes; base is the state that they were made from."""
        known = self.manifests()
        done = [m["version"] for m in known if m["token"] == token]
        if done:
            return done[0]
        base = base or (known or [self.state()])[-1]
        tables = dict(base["tables"])
        for name, rows in changes.items():
            tables[name] = f"{name}-{uuid.uuid4().hex}"
            rows.write.parquet(f"{self.root}/{tables[name]}")
        self._publish({"version": base["version"] + 1, "token": token, "tables": tables})
        return base["version"] + 1

    def _publish(self, manifest: dict) -> None:
        taken = {m["version"] for m in self.manifests()}
        path = self._jvm.org.apache.hadoop.fs.Path(self._log, f"{manifest['version']:012d}.json")
        if manifest["version"] in taken:
            raise Conflict(f"version {manifest['version']} is there already")
        if self._fs.exists(path):  # cut off before it was complete
            self._fs.delete(path, False)
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise Conflict(f"version {manifest['version']} is being written") from e
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
