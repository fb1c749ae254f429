"""The write path: statements arrive in batches, are judged against what stands, and are stored with their edges exactly once.

A store is a folder with two Parquet tables, ``trace`` (what happened to every statement) and ``edges`` (which fact retired
which), and a ledger. A batch writes its part of both tables under its own number and then commits: one ledger entry,
moved into place in a single step. Readers see committed parts alone, so facts and edges appear together or not at
all. A batch that was cut off leaves no trace that is read, and writing it again replaces its files; a batch that is
committed is not written again. ``compact`` folds committed parts into one, by the same protocol.

    store = FactStore(spark, "hdfs://.../facts")
    arriving.writeStream.foreachBatch(store.write).option("checkpointLocation", ...).start()

A batch reads what stands in the banks it touches, not the whole store, and only pairs of a new statement with what stands
are judged.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import remember_trace
from ..operators.graph import cut, shared_folder
from ..plans import dialect
from ..sources.relations import said

TRACE = "bank long, ord long, day string, text string, status string, duplicate_of long"
EDGES = "bank long, old_ord long, new_ord long"


class FactStore:
    """One writer at a time: a stream's batches, or calls of ``write`` with rising numbers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = lambda *parts: hadoop.Path("/".join((self.path, *parts)))
        self._fs = self._at("_ledger").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    # ── what is committed ──
    def parts(self) -> list[str]:
        """Folder names of the committed parts: the newest compacted one and every batch after it."""
        if not self._fs.exists(self._at("_ledger")):
            return []
        names = sorted(s.getPath().getName().removesuffix(".json") for s in self._fs.listStatus(self._at("_ledger")) if s.getPath().getName().endswith(".json"))
        upto = [n for n in names if n.startswith("upto-")]
        after = int(upto[-1].removeprefix("upto-")) if upto else -1
        return upto[-1:] + [n for n in names if n.startswith("batch-") and int(n.removeprefix("batch-")) > after]

    def _read(self, table: str, schema: str, parts: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{table}/{p}" for p in (self.parts() if parts is None else parts)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def trace(self) -> DataFrame:
        """Every statement that was written, with its status: stored, duplicate or rejected."""
        return self._read("trace", TRACE)

    def edges(self) -> DataFrame:
        """Who retired whom."""
        return self._read("edges", EDGES)

    def standing(self) -> DataFrame:
        """Stored facts that nothing retired."""
        parts = self.parts()
        gone = self._read("edges", EDGES, parts).select("bank", F.col("old_ord").alias("ord"))
        return self._read("trace", TRACE, parts).where("status = 'stored'").join(gone, ["bank", "ord"], "left_anti").select("bank", "ord", "day", "text")

    # ── writing ──
    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Store a batch of statements ``(bank, ord, day, text)``; ``ord`` rises within a bank from batch to batch.

        Safe to repeat. A statement whose (bank, ord) is stored already, or comes twice in a batch, is written once.
        """
        if batch.sparkSession is not self.spark:  # a stream's batches have a session of their own
            return FactStore(batch.sparkSession, self.path).write(batch, batch_id)
        name = f"batch-{batch_id:020d}"
        if self._done(name, batch_id):
            return
        arrived = batch.selectExpr("CAST(bank AS BIGINT) AS bank", "CAST(ord AS BIGINT) AS ord", "CAST(day AS STRING) AS day", "text").dropDuplicates(["bank", "ord"])
        arrived = cut(arrived.join(self.trace().select("bank", "ord"), ["bank", "ord"], "left_anti"))
        banks = arrived.select("bank").distinct()
        # what stands in these banks, and the new statements: features and pairs are computed over these rows alone
        rows = cut(self.standing().join(banks, "bank", "left_semi").unionByName(arrived))
        told = remember_trace(self.spark, None, {"said": rows, "arrived": arrived.select("bank", "ord")})
        folder = f"{self.path}/trace/{name}"
        written = told.join(arrived, ["bank", "ord"]).select("bank", "ord", "day", "text", "status", "duplicate_of", "retired")
        written.write.mode("overwrite").parquet(folder)
        again = self.spark.read.schema(TRACE + ", retired string").parquet(folder)
        old = F.explode(F.filter(F.split("retired", ","), lambda x: x != "").cast("array<bigint>"))
        edges = again.select("bank", old.alias("old_ord"), F.col("ord").alias("new_ord"))
        self._write_edges(edges, name)
        self._commit(name, {"batch": batch_id})

    def compact(self) -> None:
        """Fold all committed parts into one and delete them; nobody may be reading the old parts meanwhile."""
        parts = self.parts()
        if len(parts) < 2:
            return
        last = int(parts[-1].split("-")[1])
        name = f"upto-{last:020d}"
        self._read("trace", TRACE, parts).write.mode("overwrite").parquet(f"{self.path}/trace/{name}")
        self._write_edges(self._read("edges", EDGES, parts), name)
        self._commit(name, {"upto": last})
        for part in parts:
            for place in (("trace", part), ("edges", part), ("_ledger", f"{part}.json")):
                self._fs.delete(self._at(*place), True)

    def _write_edges(self, edges: DataFrame, name: str) -> None:
        edges.write.mode("overwrite").parquet(f"{self.path}/edges/{name}")

    def _done(self, name: str, batch_id: int) -> bool:
        parts = self.parts()
        return name in parts or any(p.startswith("upto-") and int(p.removeprefix("upto-")) >= batch_id for p in parts)

    def _commit(self, name: str, entry: dict) -> None:
        """One entry, written aside and moved into place, which the file system does in a single step."""
        aside, place = self._at("_ledger", f".{name}-{uuid.uuid4().hex}"), self._at("_ledger", f"{name}.json")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps(entry), "utf-8"))
        out.close()
        if not self._fs.rename(aside, place) and not self._fs.exists(place):
            raise RuntimeError(f"could not commit {name}")


def remembered_in_batches(spark: SparkSession, sf_dir: str | None, inputs: dict[str, DataFrame] | None = None, batches: int = 3) -> DataFrame:
    """All statements written as ``batches`` batches, each bank's in order, into a store of its own: what happened to each, and what it retired.

    Equal to writing them all at once.
    """
    rows = dialect.run(spark, sf_dir, lambda d: f"WITH {said(d)} SELECT bank, ord, day, text, ntile({batches}) OVER (PARTITION BY bank ORDER BY day, ord) AS part FROM said", inputs)
    rows = cut(rows)
    store = FactStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    for k in range(batches):
        store.write(rows.where(F.col("part") == k + 1), k)
    edges = store.edges().groupBy("bank", F.col("new_ord").alias("ord")).agg(F.sort_array(F.collect_list("old_ord")).alias("gone"))
    return store.trace().join(edges, ["bank", "ord"], "left").select("bank", "ord", "status", "duplicate_of", F.coalesce(F.array_join("gone", ","), F.lit("")).alias("retired"))


def queries() -> dict:
    return {"remembered_in_batches": remembered_in_batches}
