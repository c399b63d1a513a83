"""Streams that are stopped and started again, against their batch results."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from marginalia.operators import sessions
from marginalia.streaming import append_log, events, merge_table

TURN = "session_id string, at int, question string, answer string"


@pytest.fixture
def rocksdb(spark):
    spark.conf.set(*append_log.STORE)
    yield
    spark.conf.unset(append_log.STORE[0])


def run(stream, out, checkpoint, mode="append", **writer):
    """One run of a stream over what is there; each call is a restart from the checkpoint."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = q.foreachBatch(writer["batch"]).start() if "batch" in writer else q.format("parquet").option("path", out).start()
    q.awaitTermination()


def test_numbers_go_on_across_restarts(spark, rocksdb, tmp_path):
    rng = random.Random(1)
    stored = [("s0", 1, "q", "a"), ("s0", 2, "q", "a"), ("old", 1, "q", "a")]
    turns = spark.createDataFrame(stored, "session_id string, turn_index int, question string, answer string")
    new, at = [], 0
    source, checkpoint, out = (f"{tmp_path}/{x}" for x in ("in", "checkpoint", "out"))
    for trigger in range(3):
        rows = []
        for _ in range(40):
            at += 1
            rows.append((rng.choice(["s0", "s1", "s2", None]), at, f"q{rng.randint(0, 3)}", None if at % 5 == 0 else f"a{at}"))
        new += rows
        spark.createDataFrame(rng.sample(rows, len(rows)), TURN).repartition(2).write.mode("append").parquet(f"file://{source}/t{trigger}")
        stream = spark.readStream.schema(TURN).parquet(f"file://{source}/*")
        run(append_log.numbered(stream, turns), f"file://{out}", f"file://{checkpoint}")
    got = sorted(map(tuple, spark.read.parquet(f"file://{out}").collect()), key=str)
    fresh = spark.createDataFrame([r for r in new if r[0]], TURN)
    want = sessions.appended(turns, fresh).join(turns, ["session_id", "turn_index"], "left_anti").select("session_id", F.col("turn_index").cast("bigint"), "question", "answer")
    assert got == sorted(map(tuple, want.collect()), key=str)
    for s, first in (("s0", 3), ("s1", 1), ("s2", 1)):
        numbers = sorted(r[1] for r in got if r[0] == s)
        assert numbers == list(range(first, first + len(numbers)))


def test_forgotten_sessions_begin_anew(spark, rocksdb, tmp_path):
    spark.createDataFrame([("s", 0, "q", "a")], TURN).write.parquet(f"file://{tmp_path}/in/t0")
    stream = append_log.numbered(spark.readStream.schema(TURN).parquet(f"file://{tmp_path}/in/*"), expire_ms=1000)
    q = stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/cp").format("parquet").option("path", f"file://{tmp_path}/out").trigger(processingTime="2 seconds").start()
    try:
        for trigger in range(2):
            for _ in range(40):
                if len(done := spark.read.schema("turn_index bigint").parquet(f"file://{tmp_path}/out").collect() if (tmp_path / "out").exists() else []) > trigger:
                    break
                time.sleep(0.5)
            assert len(done) == trigger + 1
            if trigger == 0:
                time.sleep(2)
                spark.createDataFrame([("s", 1, "q", "a")], TURN).write.parquet(f"file://{tmp_path}/in/t1")
    finally:
        q.stop()
    assert [r.turn_index for r in done] == [1, 1]


MARK = "book_id string, reader string, chapter int, at int"


def marks(seed, n):
    rng = random.Random(seed)
    return [(f"b{rng.randint(0, 3)}", f"r{rng.randint(0, 4)}", rng.randint(1, 99), rng.randint(0, 20)) for _ in range(n)]


@pytest.mark.parametrize("every", [2, 100])
def test_killed_stream_merges_each_batch_once(spark, tmp_path, every):
    keys = ["book_id", "reader"]
    last = merge_table.MergeTable(spark, f"file://{tmp_path}/last", merge_table.latest(keys, ["at"]), every)
    seen = merge_table.MergeTable(spark, f"file://{tmp_path}/seen", merge_table.first_seen(keys), every)
    counts = lambda d: d.select(*keys, F.col("chapter").alias("first_chapter_number"), F.lit(1).cast("bigint").alias("mention_count"))
    died = []

    def add(rows, number):
        last.add(rows, number)
        seen.add(counts(rows), number)
        if number in (1, 4) and number not in died:  # killed after the write, before the commit
            died.append(number)
            raise RuntimeError("killed")

    rows = []
    for trigger in range(6):
        more = marks(trigger, 30)
        rows += more
        spark.createDataFrame(more, MARK).repartition(2).write.parquet(f"file://{tmp_path}/in/t{trigger}")
        for _ in range(2):
            try:
                run(spark.readStream.schema(MARK).parquet(f"file://{tmp_path}/in/*"), None, f"file://{tmp_path}/cp", batch=add)
                break
            except Exception as e:
                assert "killed" in str(e)
    assert died == [1, 4]
    batch = spark.createDataFrame(rows, MARK)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    assert same(merge_table.latest(keys, ["at"])(batch), last.read())
    assert same(merge_table.first_seen(keys)(counts(batch)), seen.read())
    assert seen.read().agg(F.sum("mention_count")).first()[0] == len(rows)
    # Batches that come again later change nothing either, nor does a half-written one count.
    before = sorted(map(tuple, seen.read().collect()))
    seen.add(counts(spark.createDataFrame(marks(5, 30), MARK)), 5)
    (tmp_path / "seen" / "batch=99").mkdir()
    assert sorted(map(tuple, seen.read().collect())) == before
    seen.compact()
    seen.add(counts(spark.createDataFrame(marks(5, 30), MARK)), 5)
    assert sorted(map(tuple, seen.read().collect())) == before


def test_no_batches_no_table(spark, tmp_path):
    assert merge_table.MergeTable(spark, f"file://{tmp_path}/t", merge_table.latest(["k"], ["at"])).read() is None


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


EVENT = "event_id bigint, ts timestamp, user_id bigint"


def test_interval_join_drops_only_what_the_watermark_drops(spark, tmp_path):
    # Minutes of views and purchases, trigger by trigger; the watermark is an hour behind each side's latest minute of the triggers before.
    views = [[(1, 0, 1), (2, 30, 2), (3, 50, 1)], [(4, 200, 1), (5, 130, 2)], [(6, 100, 1), (7, 190, 2), (8, 210, None)], [(9, 500, 1)]]
    buys = [[(101, 5, 1), (102, 39, 2)], [(103, 205, 1), (104, 135, 2)], [(105, 105, 1), (106, 195, 2), (107, 55, 1), (108, 211, None)], [(109, 505, 1)]]
    for k in range(4):
        for name, rows in (("views", views[k]), ("buys", buys[k])):
            spark.createDataFrame([(i, at(m), u) for i, m, u in rows], EVENT).coalesce(1).write.parquet(f"file://{tmp_path}/{name}/t{k}")
        a, b = (spark.readStream.schema(EVENT).parquet(f"file://{tmp_path}/{n}/*") for n in ("views", "buys"))
        run(events.followed(a, b), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    got = {(r.first_id, r.then_id) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    whole = {k: spark.createDataFrame([(i, at(m), u) for rows in x for i, m, u in rows], EVENT) for k, x in (("views", views), ("buys", buys))}
    batch = {(r.first_id, r.then_id) for r in events.followed(whole["views"], whole["buys"]).collect()}
    assert batch == {(1, 101), (2, 102), (3, 107), (4, 103), (5, 104), (6, 105), (7, 106), (9, 109)}
    # In the third trigger both sides have seen minute 200 and more: view 6 and purchases 105 and 107 come more than an hour behind it.
    assert got == batch - {(6, 105), (3, 107)}
