"""Streaming operators: change events, debouncing, the progress fold and the filter of thinking tokens (STR-1..6)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..session import task_count

#: The debounce time, event types that count, names of transient files.
DEBOUNCE = "10 seconds"
CHANGES = ("created", "modified", "deleted", "moved")
TRANSIENT_PREFIXES = ("~$", ".~lock.", ".#")
TRANSIENT_SUFFIXES = (".tmp", ".temp", ".swp", ".swx", ".swo", ".part", ".crdownload", ".bak", ".orig")
OPEN, CLOSE = "<think>", "</think>"


def transient(path: Column) -> Column:
    """PRJ-7."""
    name = F.element_at(F.split(path, "/"), -1)
    test = F.lit(False)
    for p in TRANSIENT_PREFIXES:
        test = test | F.startswith(name, F.lit(p))
    for s in TRANSIENT_SUFFIXES:
        test = test | F.endswith(F.lower(name), F.lit(s))
    return test


def changes(events: DataFrame) -> DataFrame:
    """STR-1, PRJ-8: real changes of files (source_id, ts, event_type, src_path, dest_path, is_directory), by the path after it."""
    rows = events.withColumn("path", F.coalesce("dest_path", "src_path"))
    return rows.filter(F.col("event_type").isin(*CHANGES) & ~F.coalesce("is_directory", F.lit(False)) & ~transient(F.col("path")))


def file_changes(spark, path: str) -> DataFrame:
    """SRC-28: a stream of new and rewritten files below ``path``; deletions need the listing diff."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"))


def debounce(events: DataFrame, key: str, ts: str = "ts", gap: str = DEBOUNCE, watermark: str | None = None) -> DataFrame:
    """STR-2: one row per burst of events of a key; it ends ``gap`` after the last one. The same plan in batch and streaming.

    On a stream give ``watermark``; in append mode the last burst of all keys is held until a later event passes it.
    """
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if watermark:
        rows = rows.withWatermark(ts, watermark)
    bursts = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n_events"), F.max(ts).alias("last_ts"))
    return bursts.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n_events", "last_ts")


def on_burst(bursts: DataFrame, action: Callable[[DataFrame, int], None], checkpoint: str, name: str):
    """STR-3, STR-10: runs ``action`` on the bursts of each batch; the name admits one query at a time."""
    return bursts.writeStream.queryName(name).outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(action).start()


def decode_progress(calls: DataFrame) -> DataFrame:
    """STR-6: events (type, current, total, file) from calls (current, total, file): a negative total marks the later phases, marks in ``file`` tell them apart."""
    total, file = F.abs(F.col("total")), F.col("file")
    kind = (
        F.when(F.col("total") >= 0, "progress").when(file == "__embedding__", "embedding_start").when(F.startswith(file, F.lit("__extract__:")), "extracting_progress")
        .when(F.startswith(file, F.lit("__embed_progress__:")), "embedding_progress").otherwise("indexing_progress")
    )
    batch = F.split(F.substring_index(file, ":", -1), "/")
    inner = kind == "embedding_progress"
    return calls.select(
        *[c for c in calls.columns if c not in ("current", "total", "file")], kind.alias("type"),
        F.when(inner, batch[0].try_cast("long")).when(kind == "embedding_start", 0).otherwise(F.col("current")).alias("current"),
        F.when(inner, F.try_element_at(batch, F.lit(2)).try_cast("long")).otherwise(total).alias("total"),
        F.when(kind == "extracting_progress", F.substr(file, F.lit(len("__extract__:") + 1))).when(kind.isin("progress", "indexing_progress"), file).alias("file"),
    )


PHASES = {"scanning": "scanning", "extracting_progress": "extracting", "embedding_start": "embedding", "indexing_progress": "indexing", "cancelled": "cancelled", "done": "done", "error": "error"}
SNAPSHOT = "key string, phase string, active boolean, paused boolean, error string, scan_current long, scan_total long, extract_current long, extract_total long, embed_current long, embed_total long, index_current long, index_total long"


def fold_progress(events: DataFrame, key: str, seq: str) -> DataFrame:
    """STR-4 in batch: the snapshot that each key's events (type, current, total, message) leave, as conditional latest values; no sort, no group in one task."""
    e = F.col("type")
    latest = lambda value, *types: F.max_by(value, F.when(e.isin(*types), F.col(seq)))
    phase = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    begun, moved = F.max(F.when(e == "embedding_start", F.col(seq))), F.max(F.when(e == "embedding_progress", F.col(seq)))
    return events.groupBy(F.col(key).cast("string").alias("key")).agg(
        F.coalesce(latest(phase[e], *PHASES), F.lit("idle")).alias("phase"), (F.count_if(e.isin("cancelled", "done", "error")) == 0).alias("active"),
        F.coalesce(latest(e == "paused", "paused", "resumed"), F.lit(False)).alias("paused"), latest(F.col("message"), "error").alias("error"),
        F.coalesce(latest(F.col("current"), "progress"), F.lit(0)).alias("scan_current"), F.coalesce(latest(F.col("total"), "progress"), F.lit(0)).alias("scan_total"),
        F.coalesce(latest(F.col("current"), "extracting_progress"), F.lit(0)).alias("extract_current"), F.coalesce(latest(F.col("total"), "extracting_progress", "embedding_start"), F.lit(0)).alias("extract_total"),
        F.when(F.coalesce(moved > begun, moved.isNotNull()), latest(F.col("current"), "embedding_progress")).otherwise(F.lit(0)).alias("embed_current"),
        F.when(F.coalesce(moved > begun, moved.isNotNull()), latest(F.col("total"), "embedding_progress")).otherwise(F.lit(0)).alias("embed_total"),
        F.coalesce(latest(F.col("current"), "indexing_progress"), F.lit(0)).alias("index_current"), F.coalesce(latest(F.col("total"), "indexing_progress"), F.lit(0)).alias("index_total"),
    )


def apply_event(snap: dict, event: dict) -> dict:
    """One step of STR-4."""
    kind, current, total = event["type"], event.get("current"), event.get("total")
    if kind in PHASES:
        snap["phase"] = PHASES[kind]
    for name, types in (("scan", ("progress",)), ("extract", ("extracting_progress",)), ("embed", ("embedding_progress",)), ("index", ("indexing_progress",))):
        if kind in types:
            snap |= {f"{name}_current": current, f"{name}_total": total}
    if kind == "embedding_start":
        snap |= {"extract_total": total, "embed_current": 0, "embed_total": 0}
    if kind in ("paused", "resumed"):
        snap["paused"] = kind == "paused"
    if kind in ("cancelled", "done", "error"):
        snap["active"] = False
    if kind == "error":
        snap["error"] = event.get("message")
    return snap


def empty_snapshot() -> dict:
    return {"phase": "idle", "active": True, "paused": False, "error": None} | {f"{n}_{x}": 0 for n in ("scan", "extract", "embed", "index") for x in ("current", "total")}


def fold_progress_stream(events: DataFrame, key: str, seq: str) -> DataFrame:
    """STR-4 on a stream (update mode): a snapshot of constant size is the state of each key."""
    names = [x.split()[0] for x in SNAPSHOT.split(", ")[1:]]

    def fold(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        snap = dict(zip(names, state.get)) if state.exists else empty_snapshot()
        for row in pd.concat(list(frames)).sort_values("seq").to_dict("records"):
            snap = apply_event(snap, row)
        state.update(tuple(snap[n] for n in names))
        yield pd.DataFrame([{"key": keys[0]} | snap])[["key", *names]]

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(seq).alias("seq"), "type", "current", "total", "message")
    return rows.groupBy("key").applyInPandasWithState(fold, SNAPSHOT, ", ".join(SNAPSHOT.split(", ")[1:]), "update", GroupStateTimeout.NoTimeout)


def running_mark(events: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """AGG-24, WIN-6: the highest value so far."""
    return events.withColumn("mark", F.max(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def held_back(text: str, tag: str) -> int:
    """SCL-34: characters at the end that may be the beginning of ``tag``."""
    return next((n for n in range(min(len(text), len(tag) - 1), 0, -1) if tag.startswith(text[-n:])), 0)


def channel_step(held: str, inside: bool, token: str) -> tuple[list[tuple[str, str]], str, bool]:
    """STR-5, one token: the (kind, text) pieces that it settles, and the text held back and the channel after it."""
    out, held = [], held + token
    while True:
        tag, kind = (CLOSE, "thinking") if inside else (OPEN, "token")
        at = held.find(tag)
        cut = at if at >= 0 else len(held) - held_back(held, tag)
        if cut:
            out.append((kind, held[:cut]))
        if at < 0:
            return out, held[cut:], inside
        held, inside = held[at + len(tag) :], not inside


def split_channels(tokens: list[str]) -> list[tuple[str, str]]:
    """STR-5: (kind, text) pieces of a token stream, "thinking" inside of tags and "token" outside; tags may straddle tokens."""
    out, held, inside = [], "", False
    for token in tokens:
        pieces, held, inside = channel_step(held, inside, token)
        out += pieces
    return out + ([("thinking" if inside else "token", held)] if held else [])


def token_channels(tokens: DataFrame, key: str = "answer_id", seq: str = "seq", token: str = "token") -> DataFrame:
    """STR-5 for every answer: (answer_id, seq, kind, text). A task walks over its sorted tokens; of an answer it holds only what its channel holds back."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, held, inside, n, begun = None, "", False, 0, False
        for batch in source:
            out: list[tuple] = []
            for own, text in zip(batch.column("answer_id").to_pylist(), batch.column("token").to_pylist()):
                if own != answer or not begun:
                    if held:
                        out.append((answer, n, "thinking" if inside else "token", held))
                    answer, held, inside, n, begun = own, "", False, 0, True
                pieces, held, inside = channel_step(held, inside, text or "")
                for kind, piece in pieces:
                    out.append((answer, n, kind, piece))
                    n += 1
            yield told(out, batch.column("answer_id").type)
        if held:
            yield told([(answer, n, "thinking" if inside else "token", held)], batch.column("answer_id").type)

    def told(out: list[tuple], answer_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (answer_type, pa.int32(), pa.string(), pa.string()))], ["answer_id", "seq", "kind", "text"])

    rows = tokens.select(F.col(key).alias("answer_id"), F.col(seq).alias("seq"), F.col(token).alias("token"))
    dealt = rows.repartition(task_count(tokens.sparkSession), "answer_id").sortWithinPartitions("answer_id", "seq")
    return dealt.mapInArrow(run, f"answer_id {tokens.schema[key].dataType.simpleString()}, seq int, kind string, text string")


def channels_of(text: Column) -> tuple[Column, Column]:
    """SCL-18, STR-5 on whole answers: (visible text, thinking text), without Python."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), F.array_join(F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1)), "")


def parse_sse(lines: DataFrame, column: str = "body", schema: str = "type string, payload string") -> DataFrame:
    """SRC-30: the events of server-sent bodies; malformed lines are left out."""
    line = lines.select(*[c for c in lines.columns if c != column], F.posexplode(F.split(column, "\r?\n")).alias("pos", "line")).filter(F.startswith("line", F.lit("data: ")))
    return line.withColumn("event", F.from_json(F.substr("line", F.lit(7)), schema)).filter(F.col("event").isNotNull() & F.col(f"event.{schema.split()[0]}").isNotNull()).drop("line")


def to_sse(events: DataFrame) -> DataFrame:
    """SNK-10: each row as one server-sent event."""
    return events.select(F.concat(F.lit("data: "), F.to_json(F.struct("*")), F.lit("\n\n")).alias("body"))
