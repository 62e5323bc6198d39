"""Landed pages and linked tables: chains of cursors, batches that are there whole or not at all, and a ledger of runs."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.sources.files import replace_scope

#: Pages of a chain that are followed, and states that end a run.
MOST_PAGES = 1000
TERMINAL = ("complete", "successful_empty", "partial", "network_failure", "auth_failure", "invalid_request", "rate_limited", "server_failure", "http_failure", "schema_drift")


def follow_cursors(pages: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """Each chain of landed pages followed from its first page (S-04): chain, state, cursors (of the pages that were read,
    in order; null for the first) and row_count.

    pages(chain, cursor, next_cursor, failure, n_rows): cursor is null for the first page; failure is null for a page that
    was fetched; an empty next_cursor is none. A page landed twice counts once, a failure before a page. state:
    complete at a page without a next; the failure's name, with all pages before it kept; missing_page where a next isn't
    there; partial_pagination after `most` pages, as in a chain that comes back to itself. A chain has at most `most` pages in
    memory at a time: others can't be on its way twice.
    """
    one = pages.groupBy("chain", F.coalesce("cursor", F.lit("")).alias("at")).agg(F.max("failure").alias("failure"), F.max(F.nullif("next_cursor", F.lit(""))).alias("next"), F.max("n_rows").alias("n"))
    chains = one.groupBy("chain").agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("failure", "next", "n")))).alias("m"))
    start = F.struct(F.lit("").alias("at"), F.array().cast("array<string>").alias("cursors"), F.lit(0).cast("long").alias("row_count"), F.lit(None).cast("string").alias("state"))

    def step(acc, _):
        page = F.get(F.array(F.try_element_at("m", acc["at"])), F.lit(0))
        read = page.isNotNull() & page["failure"].isNull()
        state = F.when(page.isNull(), "missing_page").when(~read, page["failure"]).when(page["next"].isNull(), "complete")
        moved = F.struct(F.when(read, F.coalesce(page["next"], F.lit(""))).otherwise(acc["at"]).alias("at"), F.when(read, F.concat(acc["cursors"], F.array(acc["at"]))).otherwise(acc["cursors"]).alias("cursors"), (acc["row_count"] + F.when(read, F.coalesce(page["n"], F.lit(0))).otherwise(0)).alias("row_count"), state.alias("state"))
        return F.when(acc["state"].isNotNull(), acc).otherwise(moved)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)
    got = chains.select("chain", end.alias("e"))
    return got.select("chain", F.coalesce("e.state", F.lit("partial_pagination")).alias("state"), F.transform("e.cursors", lambda c: F.nullif(c, F.lit(""))).alias("cursors"), F.col("e.row_count").alias("row_count"))


# ---- a ledger of runs ---------------------------------------------------------------------------------------------------


def create_once(spark: SparkSession, path: str, content: str) -> bool:
    """Makes a file that isn't there, with its content; false if it is. Of two writers at a time one wins. On a file system
    of the machine by a link, which is made whole or not at all; elsewhere by the store's own create without overwriting."""
    at = urlparse(path)
    if at.scheme in ("", "file"):
        os.makedirs(os.path.dirname(at.path), exist_ok=True)
        handle, draft = tempfile.mkstemp(dir=os.path.dirname(at.path), prefix=".draft-")
        with os.fdopen(handle, "w") as f:
            f.write(content)
        try:
            os.link(draft, at.path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        return False
    try:
        out = fs.create(target, False)
    except Exception as e:
        if fs.exists(target):
            return False
        raise e
    out.write(bytearray(content.encode()))
    out.close()
    return True


class Ledger:
    """Runs in a folder: each is opened once and ended once, in whatever order writers come (T-08)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def open(self, run_id: str, started_at: str, **about: str) -> bool:
        """Whether this call opened the run."""
        return create_once(self.spark, f"{self.folder}/{run_id}.running", json.dumps({"run_id": run_id, "started_at": started_at, "state": "running", **about}))

    def close(self, run_id: str, state: str, completed_at: str, **about: str) -> bool:
        """Whether this call ended the run: the first to do so stands. A state that ends nothing, no time, or a run that
        was never opened is an error."""
        if state not in TERMINAL or not completed_at:
            raise ValueError(f"a run ends in one of {TERMINAL}, at a time")
        if self.runs().where(F.col("run_id") == run_id).isEmpty():
            raise ValueError(f"run {run_id} was never opened")
        return create_once(self.spark, f"{self.folder}/{run_id}.ended", json.dumps({"run_id": run_id, "completed_at": completed_at, "state": state, **about}))

    def runs(self) -> DataFrame:
        """run_id, state, started_at and completed_at of each run."""
        rows = self.spark.read.schema("run_id string, state string, started_at string, completed_at string").json(f"{self.folder}/*.*[gd]")
        by = rows.groupBy("run_id").agg(F.max("started_at").alias("started_at"), F.max("completed_at").alias("completed_at"), F.max(F.when(F.col("state") != "running", F.col("state"))).alias("ended"))
        return by.select("run_id", F.coalesce("ended", F.lit("running")).alias("state"), "started_at", "completed_at")


# ---- linked tables ------------------------------------------------------------------------------------------------------


def linked_sink(folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the frames that `tables` make of a batch, each written as the batch's partition of its own table
    (S-09, S-16), then a mark. A batch that is tried again replaces what it had written, whichever write failed; a batch
    with a mark isn't written again. The batch is persisted, so that all tables are of the same rows."""

    def write(batch: DataFrame, number: int) -> None:
        ledger = Ledger(batch.sparkSession, f"{folder}/marks")
        mark = f"{ledger.folder}/{number:012d}"
        if exists(batch.sparkSession, mark):
            return
        held = batch.persist()
        try:
            for name, make in tables.items():
                replace_scope(make(held).withColumn("batch", F.lit(number).cast("long")), f"{folder}/{name}", ["batch"])
            create_once(batch.sparkSession, mark, json.dumps({"batch": number}))
        finally:
            held.unpersist()

    return write


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_linked(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a table whose batch has its mark: all linked tables show the same batches."""
    marks = spark.read.schema("batch long").json(f"{folder}/marks")
    return spark.read.parquet(f"{folder}/{name}").join(F.broadcast(marks), "batch", "left_semi")


def snapshot_tables() -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Snapshots, canonical offerings and raw rows of a batch of quotes(snapshot_id, book, player, side, point, price, seen):
    an offering's number orders a snapshot's offerings, and each raw row has that of its own."""
    key = ["snapshot_id", "book", "player", "side", "point"]
    number = F.struct(*key[1:])

    def numbered(rows: DataFrame) -> DataFrame:
        lists = rows.groupBy("snapshot_id").agg(F.array_sort(F.collect_set(number)).alias("__all"))
        return lists.select("snapshot_id", F.posexplode("__all").alias("offering", "__o")).select("snapshot_id", "offering", "__o.*")

    return {
        "snapshots": lambda rows: rows.groupBy("snapshot_id").agg(F.count("*").alias("n_raw"), F.max("seen").alias("seen")),
        "offerings": lambda rows: numbered(rows).join(rows.groupBy(*key).agg(F.max_by("price", F.struct("seen", "price")).alias("price"), F.count("*").alias("n_raw")), key),
        "raw": lambda rows: rows.join(numbered(rows), key).select("snapshot_id", "offering", "price", "seen"),
    }
