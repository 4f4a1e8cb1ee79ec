"""Streams with state and timers against their twins in batch."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import events, timed


@pytest.fixture
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    timed.keep_state_in_rocksdb(spark)
    yield
    spark.conf.set(name, before)


def started(frame, name, path):
    return frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).start()


def until(query, ready, seconds=60):
    end = time.time() + seconds
    while not ready() and time.time() < end:
        assert query.exception() is None
        time.sleep(0.3)
    query.stop()


def test_the_last_burst_fires_without_a_later_event(spark, rocksdb, tmp_path):
    rng, base = random.Random(2), datetime(2024, 5, 1)
    rows, t = [], 0
    for i in range(120):
        t += rng.choice([0, 1, 2, 3, 4, 9])
        rows.append((f"s{i % 3}", base + timedelta(seconds=t)))
    data = spark.createDataFrame(rows, "source_id string, ts timestamp")
    for part in range(3):  # three micro-batches
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], data.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    want = {tuple(r) for r in events.debounce(data, "source_id", gap="3 seconds").collect()}
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = started(timed.debounce_timed(stream, "source_id", gap=3), "timed_bursts", f"{tmp_path}/checkpoint")
    found = lambda: {tuple(r) for r in spark.table("timed_bursts").collect()}
    until(query, lambda: len(found()) >= len(want))
    assert found() == want and len(want) > 6


def test_bursts_call_the_ingest_once_each(spark, rocksdb, tmp_path):
    """STR-3: one event, and nothing after it, has the source ingested."""
    from lodestar.plans import control

    data = spark.createDataFrame([("s1", datetime(2024, 1, 1))], "source_id string, ts timestamp")
    data.write.parquet(f"{tmp_path}/in")
    called = []
    bursts = timed.debounce_timed(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), "source_id", gap=1)
    query = events.on_burst(bursts, control.reingest(called.append), f"{tmp_path}/checkpoint", "timed_ingest")
    until(query, lambda: called)
    assert called == ["s1"]


def test_tags_cut_over_batches(spark, rocksdb, tmp_path):
    rng = random.Random(4)
    answers, rows = {}, []
    for i in range(8):
        text = "".join(rng.choice(["<think>", "</think>", "a", "<", "th", "ink>", "é ", "</"]) for _ in range(rng.randint(1, 14)))
        step = rng.randint(1, 4)
        cut = [text[j : j + step] for j in range(0, len(text), step)]
        answers[f"q{i}"] = cut
        rows += [(f"q{i}", j, token, j == len(cut) - 1) for j, token in enumerate(cut)]
    schema = "answer_id string, seq int, token string, done boolean"
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] % 1000 * 4 // (1 + max(x[1] for x in rows if x[0] == r[0])) == part] or [("none", 0, None, True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = started(timed.token_channels_stream(stream), "timed_channels", f"{tmp_path}/checkpoint")
    join = lambda pieces, kind: "".join(t for k, t in pieces if k == kind)
    want = {a: tuple(join(events.split_channels(cut), kind) for kind in ("token", "thinking")) for a, cut in answers.items()}

    def found():
        out = {}
        for r in spark.table("timed_channels").orderBy("answer_id", "seq").collect():
            assert r.text
            out.setdefault(r.answer_id, []).append((r.kind, r.text))
        return {a: tuple(join(p, kind) for kind in ("token", "thinking")) for a, p in out.items()}

    want = {a: w for a, w in want.items() if any(w)}
    until(query, lambda: found() == want)
    assert found() == want
    batch = events.token_channels(spark.createDataFrame(rows, schema)).groupBy("answer_id", "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    assert {(r.answer_id, r.kind, r.text) for r in batch.collect()} == {(a, kind, text) for a, w in want.items() for kind, text in zip(("token", "thinking"), w) if text}


def test_an_answer_that_breaks_off_gives_up_what_is_held(spark, rocksdb, tmp_path):
    schema = "answer_id string, seq int, token string, done boolean"
    spark.createDataFrame([("a", 0, "hello <thi", False), ("b", 0, "<think>why </th", None)], schema).write.parquet(f"{tmp_path}/in")
    query = started(timed.token_channels_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), idle=1), "timed_idle", f"{tmp_path}/checkpoint")
    found = lambda: sorted(map(tuple, spark.table("timed_idle").collect()))
    until(query, lambda: len(found()) == 4)
    assert found() == [("a", 0, "token", "hello "), ("a", 1, "token", "<thi"), ("b", 0, "thinking", "why "), ("b", 1, "thinking", "</th")]
