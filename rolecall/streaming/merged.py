"""Tables that batches add to: hash buckets, runs that are merged level by level, one commit each.

A table has a key and a `fold`, which merges rows of one key and gives the same whatever the
order and grouping it is applied in (a minimum, a sum, a union of sketches).  So a batch
reads nothing of the table: it is folded by itself and written as one more run of the
buckets it touches.  A bucket with `fanout` runs of a level has them merged into one run of
the next, so a reader finds a number of runs that grows with the logarithm of the batches.

What belongs to the table is what its newest commit lists.  A commit is written beside its
place and renamed into it; a batch that dies before leaves the table as it was, one that
is run again after its commit changes nothing, and buckets are always swapped whole.
"""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import empty_table


@dataclass(frozen=True)
class MergedTable:
    spark: SparkSession
    path: str
    ddl: str
    keys: tuple[str, ...]
    fold: Callable[[DataFrame], DataFrame]
    buckets: int = 16
    fanout: int = 4

    # -- commits ----------------------------------------------------------------
    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _names(self, *parts: str) -> list[str]:
        fs, at = self._fs(), self._at(*parts)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def state(self) -> dict:
        """The newest commit: its number, the last batch, and the runs (bucket, level, folder)."""
        found = [n for n in self._names("commits") if n.endswith(".json")]
        if not found:
            return {"commit": 0, "batch": -1, "runs": [], "dead": []}
        return json.loads(self.spark.read.text(f"{self.path}/commits/{found[-1]}").first().value)

    def _commit(self, state: dict) -> None:
        fs, name = self._fs(), f"{state['commit']:012d}.json"
        aside = self._at("commits", f".{name}.{uuid.uuid4().hex}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not fs.rename(aside, self._at("commits", name)):
            raise RuntimeError(f"{self.path}: commit {state['commit']} exists")
        # Readers of the commit before may still be at work: what it alone lists goes with the next one.
        for old in [n for n in self._names("commits") if n.endswith(".json")][:-2]:
            fs.delete(self._at("commits", old), False)

    # -- rows ---------------------------------------------------------------------
    def _columns(self) -> list[str]:
        return [c.split()[0] for c in self.ddl.split(", ")]

    def _write(self, rows: DataFrame) -> tuple[str, list[int]]:
        """The folder of a new run, and the buckets it has."""
        folder = f"run-{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        self.fold(rows).select(*self._columns(), bucket.alias("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return folder, [int(n.split("=")[1]) for n in self._names("data", folder) if n.startswith("bucket=")]

    def _read(self, runs: list[list]) -> DataFrame:
        paths = [f"{self.path}/data/{folder}/bucket={bucket}" for bucket, _, folder in runs]
        return self.spark.read.schema(self.ddl).parquet(*paths) if paths else empty_table(self.spark, self.ddl)

    def read(self) -> DataFrame:
        """The rows of the table, one a key."""
        return self.fold(self._read(self.state()["runs"])).select(self._columns())

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add a batch; one that is not newer than the last changes nothing."""
        state = self.state()
        if batch <= state["batch"]:
            return
        folder, touched = self._write(rows)
        self._clear(state)
        self._commit({"commit": state["commit"] + 1, "batch": batch, "dead": [],
                      "runs": state["runs"] + [[b, 0, folder] for b in touched]})
        self.compact()

    def compact(self) -> list[int]:
        """Merge the levels that are full; the numbers of runs each merge read."""
        read = []
        while True:
            state = self.state()
            runs: dict[tuple[int, int], list[list]] = {}
            for run in state["runs"]:
                runs.setdefault((run[1], run[0]), []).append(run)
            full = {k for k, v in runs.items() if len(v) >= self.fanout}
            if not full:
                return read
            level = min(k[0] for k in full)
            old = [r for k in full if k[0] == level for r in runs[k]]
            folder, touched = self._write(self._read(old))
            kept = [r for r in state["runs"] if r not in old]
            self._clear(state)
            self._commit({"commit": state["commit"] + 1, "batch": state["batch"], "dead": old,
                          "runs": kept + [[b, level + 1, folder] for b in touched]})
            read.append(len(old))

    def _clear(self, state: dict) -> None:
        """Delete the runs that the commit before the newest listed last."""
        for bucket, _, folder in state["dead"]:
            self._fs().delete(self._at("data", folder, f"bucket={bucket}"), True)
