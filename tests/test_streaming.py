import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.streaming import events


def naive_channels(text):
    out, inside = {"token": "", "thinking": ""}, False
    while text:
        tag = events.CLOSE if inside else events.OPEN
        head, found, rest = text.partition(tag)
        out["thinking" if inside else "token"] += head
        inside, text = inside ^ bool(found), rest
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<think>", "</think>", "a", "<", "th", "ink>", "b c", "</", "", ">"]), max_size=14), st.integers(1, 5))
def test_channels_whatever_the_cuts(parts, step):
    text = "".join(parts)
    pieces = events.split_channels([text[i : i + step] for i in range(0, len(text), step)])
    got = {"token": "", "thinking": ""}
    for kind, piece in pieces:
        assert piece
        got[kind] += piece
    assert got == naive_channels(text)


def test_debounce_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(1)
    rows, t = [], 0.0
    for i in range(300):
        t += rng.choice([1, 3, 9, 10, 11, 40])
        rows.append((i % 3, t))
    data = spark.createDataFrame(rows, "source int, s double").select("source", F.timestamp_seconds("s").alias("ts"))
    data.write.parquet(f"{tmp_path}/in")
    batch = {tuple(r) for r in events.debounce(data, "source").collect()}
    stream = events.debounce(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), "source", watermark="10 seconds")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("bursts").collect()} == batch


def test_events_exactly_at_the_gap_are_one_burst(spark):
    rows = spark.createDataFrame([(1, 0), (1, 10), (1, 21)], "source int, s int").select("source", F.timestamp_seconds("s").alias("ts"))
    assert sorted(r.n_events for r in events.debounce(rows, "source").collect()) == [1, 2]


def progress(rng, n):
    kinds = ["scanning", "progress", "extracting_progress", "embedding_start", "embedding_progress", "indexing_progress", "paused", "resumed", "error", "done"]
    return [(i % 4, i, rng.choice(kinds), rng.randint(0, 9), rng.randint(10, 20), "oops") for i in range(n)]


def test_progress_fold_batch_stream_and_loop_agree(spark, tmp_path):
    rows = progress(random.Random(3), 200)
    data = spark.createDataFrame(rows, "source int, seq int, type string, current long, total long, message string")
    want = {}
    for source, _, kind, current, total, message in rows:
        snap = want.setdefault(str(source), events.empty_snapshot())
        want[str(source)] = events.apply_event(snap, {"type": kind, "current": current, "total": total, "message": message})
    got = {r.key: r.asDict() for r in events.fold_progress(data, "source", "seq").collect()}
    assert {k: {n: v for n, v in r.items() if n != "key"} for k, r in got.items()} == want
    data.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = events.fold_progress_stream(spark.readStream.schema(data.schema).parquet(f"{tmp_path}/in"), "source", "seq")
    q = stream.writeStream.format("memory").queryName("snapshots").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: {n: v for n, v in r.asDict().items() if n != "key"} for r in spark.table("snapshots").collect()} == want


def test_changes_sse_and_marks(spark):
    rows = [(1, "modified", "/a/b.txt", None, False), (1, "moved", "/a/x.tmp", "/a/y.txt", False), (1, "created", "/a/~$b.docx", None, False), (1, "opened", "/a/b.txt", None, False), (1, "deleted", "/a", None, True)]
    data = spark.createDataFrame(rows, "source_id int, event_type string, src_path string, dest_path string, is_directory boolean")
    assert sorted(r.path for r in events.changes(data).collect()) == ["/a/b.txt", "/a/y.txt"]
    sent = spark.createDataFrame([("token", "hi"), ("done", "")], "type string, payload string")
    body = "".join(r.body for r in events.to_sse(sent).collect()) + "data: {broken\n: comment\n"
    parsed = events.parse_sse(spark.createDataFrame([(1, body)], "id int, body string")).select("event.type", "event.payload").collect()
    assert sorted(map(tuple, parsed)) == [("done", ""), ("token", "hi")]
    marks = spark.createDataFrame([(1, 1, 5.0), (1, 2, 3.0), (1, 3, 9.0)], "k int, o int, v double")
    assert [r.mark for r in events.running_mark(marks, "k", "v", "o").orderBy("o").collect()] == [5.0, 5.0, 9.0]
