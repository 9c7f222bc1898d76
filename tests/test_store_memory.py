"""Python's memory over whole queries, the store's making included: 16,000 sessions in one executor of 4 cores, and all of their rows."""

import re
import threading
from collections import defaultdict
from pathlib import Path

import psutil
import pytest
from pyspark.sql import functions as F

from lakeloom.functions.text import crop
from lakeloom.plans import stored

SESSIONS, TURNS, BUDGET = 16_000, 6, 5000
#: MB of all Python workers together: some 750 were seen, and over 1,400 while workers held whole batches.
MOST = 1000


def workers_mb(jvm):
    """MB of the JVM's Python processes without mapped files; shared pages count once.

    Its other children are left out: one that is starting shows the JVM's memory.
    """
    total = 0
    for p in psutil.Process(jvm).children(recursive=True):
        try:
            if "python" in p.name():
                total += sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text())))
        except (OSError, psutil.Error):
            pass
    return total / 1024


def peak(spark, f):
    """The workers' peak MB while f() runs, and its result."""
    jvm, seen, over = spark._jvm.java.lang.ProcessHandle.current().pid(), [0.0], threading.Event()

    def watch():
        while not over.wait(0.1):
            seen.append(workers_mb(jvm))

    t = threading.Thread(target=watch)
    t.start()
    try:
        return f(), max(seen)
    finally:
        over.set()
        t.join()


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    """Conversations of some 3 kB: a system turn, then users and assistants in turn, of invented words."""
    at = tmp_path_factory.mktemp("many")
    turn = F.col("id") % TURNS
    said = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit("w"), F.conv(F.substring(F.sha2(F.concat_ws("-", F.col("id"), i), 256), 1, 4), 16, 36))), " ")
    role = F.when(turn == 0, "system").when(turn % 2 == 1, "user").otherwise("assistant")
    spark.range(SESSIONS * TURNS, numPartitions=4).select((F.col("id") / TURNS).cast("long").alias("conv_id"), turn.alias("turn"), role.alias("role"), said.alias("text")).write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.fixture(autouse=True)
def no_store(spark):
    stored.drop_stores(spark)
    yield
    stored.drop_stores(spark)


def test_topic_shards_hold_a_piece_of_the_sessions(spark, data):
    rows, mb = peak(spark, lambda: stored.mining_topic_shards(spark, data).select("session_id", "line_no", "shard", "line").collect())
    assert mb < MOST
    users = spark.read.parquet(f"{data}/conversations.parquet").filter((F.col("role") == "user") & (F.col("conv_id") % 2 == 0))
    said = {(str(r.c), r.n): r.t for r in users.select(F.col("conv_id").alias("c"), (F.col("turn") + 2).alias("n"), crop(F.col("text")).alias("t")).collect()}
    assert len(rows) == len(said) == SESSIONS // 2 * (TURNS // 2)
    assert all(r.line.endswith(f"• {said[r.session_id, r.line_no]}\n") for r in rows)
    size, shard_of = defaultdict(int), defaultdict(set)
    for r in rows:
        size[r.session_id] += len(r.line)
        shard_of[r.session_id].add(r.shard)
    shard = filled = 0
    for s in sorted(size):
        assert shard_of[s] == {shard}
        filled += size[s]
        if filled >= BUDGET:
            shard, filled = shard + 1, 0


def test_boundaries_hold_a_piece_of_the_sessions(spark, data):
    rows, mb = peak(spark, lambda: stored.store_boundaries(spark, data).collect())
    assert mb < MOST
    first = 1_767_225_600_000
    assert sorted(tuple(r) for r in rows) == sorted((str(c), 2, f"{c}-0", None, "auto", 1000, 0, first) for c in range(SESSIONS))
