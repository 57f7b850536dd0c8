"""Append-only deltas, a manifest per commit, and compaction: a table that a stream keeps up to date.

A batch writes its own rows into one folder and commits it by a manifest, a small file that names the folders in force.
Nothing that is committed is changed. After ``every`` deltas all folders in force are merged into one; what newer manifests
no longer name is removed ``keep`` manifests later, so that readers of an older one can finish.
"""

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """Rows below ``path`` in the shared folder, reduced by ``merge``.

    ``merge`` must give the same rows however its input was cut and merged before. Then a reader's answer depends neither on
    batches nor on compaction: writing costs the batch, reading at most one merged table and ``every`` deltas.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], every: int = 8, keep: int = 4):
        self.spark, self.path, self.merge, self.every, self.keep = spark, path.rstrip("/"), merge, every, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        where = self._path(f"{self.path}/commits")
        if not self._files.exists(where):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(where)]
        return sorted(int(n) for n in names if n.isdigit())

    def _manifest(self, number: int) -> dict:
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        source = self._files.open(self._path(f"{self.path}/commits/{number}"))
        try:
            return json.loads(text.toString(source, "UTF-8"))
        finally:
            source.close()

    def _commit(self, number: int, manifest: dict) -> None:
        """A manifest appears whole or not at all: it is written aside and renamed."""
        draft, final = (self._path(f"{self.path}/{name}") for name in (f"drafts/{number}", f"commits/{number}"))
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        self._files.mkdirs(final.getParent())
        if not self._files.rename(draft, final):
            raise OSError(f"commit {number} of {self.path} exists already")

    def append(self, batch: DataFrame, epoch: int) -> None:
        """Commit a batch once: a repeated epoch writes nothing, an unfinished one is written anew."""
        done = self._commits()
        last = self._manifest(done[-1]) if done else {"epoch": -1, "folders": []}
        if epoch <= last["epoch"]:
            return
        folders = last["folders"] + [f"delta-{epoch}"]
        self.merge(batch).write.mode("overwrite").parquet(f"{self.path}/{folders[-1]}")
        if len(folders) > self.every:
            merged = f"merged-{epoch}"
            self._read(folders, batch.schema).write.mode("overwrite").parquet(f"{self.path}/{merged}")
            folders = [merged]
        number = done[-1] + 1 if done else 0
        self._commit(number, {"epoch": epoch, "folders": folders})
        self._expire(done + [number])

    def _expire(self, numbers: list[int]) -> None:
        """Remove manifests before the last ``keep`` and the folders that only those name."""
        old, kept = numbers[:-self.keep], numbers[-self.keep:]
        if not old:
            return
        named = {f for n in kept for f in self._manifest(n)["folders"]}
        for n in old:
            for f in set(self._manifest(n)["folders"]) - named:
                self._files.delete(self._path(f"{self.path}/{f}"), True)
            self._files.delete(self._path(f"{self.path}/commits/{n}"), False)

    def _read(self, folders: list[str], schema) -> DataFrame:
        return self.merge(self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders]))

    def read(self, schema) -> DataFrame:
        """The merged rows of the newest commit; none before the first."""
        done = self._commits()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self._read(self._manifest(done[-1])["folders"], schema)
