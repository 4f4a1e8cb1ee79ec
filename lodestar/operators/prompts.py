"""Prompts, citations and device plans (SCL-19, WIN-7, JOIN-11, AGG-22, AGG-23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

#: Our own template; the places of context and question are marked.
TEMPLATE = "Answer the question from the numbered passages only and cite the passages you use by their id in square brackets.\n\nPassages:\n<<<CONTEXT>>>\n\nQuestion: <<<QUESTION>>>\nAnswer:"
NO_HITS = "The indexed documents do not hold enough information to answer."
#: MiB of each component, whether it counts as own, its place in each priority; the reserve.
COMPONENTS = (("embeddings", 2620, True, 3, 1), ("reranker", 800, True, 2, 5), ("whisper", 450, True, 4, 3), ("ocr", 150, True, 5, 4), ("llm", 3000, False, 1, 6), ("vision", 3500, False, 6, 2))
RESERVE_SHARE, RESERVE_MIB = 0.10, 512


def context_lines(hits: DataFrame) -> DataFrame:
    """SCL-19, WIN-7: (qid, context): one line for each hit (qid, rank, chunk_id, file_name, text) of a question's top k."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "file_name", "text"))), lambda h: F.format_string("[%d] (chunk_id=%s, archivo=%s) %s", h["rank"], h["chunk_id"].cast("string"), h["file_name"], h["text"]))
    return hits.groupBy("qid").agg(F.array_join(lines, "\n").alias("context"))


def prompts(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, question, prompt, has_hits) of every question, also without hits."""
    rows = questions.join(context_lines(hits), "qid", "left")
    filled = F.replace(F.replace(F.lit(TEMPLATE), F.lit("<<<CONTEXT>>>"), F.coalesce("context", F.lit(""))), F.lit("<<<QUESTION>>>"), F.col("question"))
    return rows.select("qid", "question", filled.alias("prompt"), F.col("context").isNotNull().alias("has_hits"))


def citations(hits: DataFrame, full_context: bool = False) -> DataFrame:
    """PRJ-11."""
    text = F.col("text") if full_context else tx.snippet(F.col("text"))
    return hits.select("qid", "rank", "chunk_id", "file_id", "file_name", "page", "score", text.alias("snippet"))


def cited(answers: DataFrame, given: DataFrame) -> DataFrame:
    """JOIN-11: (qid, chunk_id, ordinal): ids that an answer cites and that it was given, numbered as given."""
    marks = answers.select("qid", F.explode(tx.cited_ids(F.col("answer"))).alias("chunk_id"))
    return marks.join(given.select("qid", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("rank").alias("ordinal")), ["qid", "chunk_id"])


def device_plan(requests: DataFrame) -> DataFrame:
    """AGG-22, AGG-23: a greedy fold for each request (priority, overrides map<string,string>, vram_mib).

    Forced components come first in the listed order and always go to the GPU, over the budget if need be; the others follow by
    priority while they fit. Adds devices map, budget_mib, gpu_used_mib, overhead_bytes, overflow, feasible. Without a GPU all
    stay on the CPU.
    """
    parts = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("name"), F.lit(c).alias("cost"), F.lit(own).alias("own"), F.lit(s).alias("search"), F.lit(g).alias("ingest")) for i, (n, c, own, s, g) in enumerate(COMPONENTS)])
    want = lambda p: F.coalesce(F.try_element_at(F.col("overrides"), p["name"]), F.lit("auto"))
    budget = F.when(F.col("vram_mib") > 0, F.col("vram_mib") - F.greatest(F.floor(F.col("vram_mib") * RESERVE_SHARE), F.lit(RESERVE_MIB)).cast("int")).otherwise(0)
    keyed = F.transform(parts, lambda p: F.struct(
        F.when(want(p) == "gpu", 0).otherwise(1).alias("group"), F.when(want(p) == "gpu", p["place"]).when(F.col("priority") == "ingest", p["ingest"]).otherwise(p["search"]).alias("order"),
        p["name"].alias("name"), p["cost"].alias("cost"), p["own"].alias("own"), want(p).alias("want"),
    ))
    state = F.struct(F.col("budget_mib").alias("left"), F.array().cast("array<struct<name:string,device:string,over:boolean,cost:int,own:boolean>>").alias("plan"))

    def step(s: Column, p: Column) -> Column:
        fits = (p["cost"] <= s["left"]) & (p["want"] != "cpu") & (F.col("vram_mib") > 0)
        on_gpu = fits | ((p["want"] == "gpu") & (F.col("vram_mib") > 0))
        done = F.struct(p["name"].alias("name"), F.when(on_gpu, "cuda").otherwise("cpu").alias("device"), (on_gpu & ~fits).alias("over"), p["cost"].alias("cost"), p["own"].alias("own"))
        return F.struct((s["left"] - F.when(fits, p["cost"]).otherwise(0)).alias("left"), F.concat(s["plan"], F.array(done)).alias("plan"))

    total = lambda plan, keep: F.aggregate(F.filter(plan, keep), F.lit(0).cast("long"), lambda a, p: a + p["cost"])
    rows = requests.withColumn("budget_mib", budget).withColumn("_plan", F.aggregate(F.array_sort(keyed), state, step)["plan"])
    return rows.select(
        *requests.columns, "budget_mib", F.map_from_entries(F.transform("_plan", lambda p: F.struct(p["name"], p["device"]))).alias("devices"),
        total(F.col("_plan"), lambda p: (p["device"] == "cuda") & p["own"] & ~p["over"]).alias("gpu_used_mib"), (total(F.col("_plan"), lambda p: (p["device"] == "cuda") & p["own"]) * 1024 * 1024).alias("overhead_bytes"),
        F.transform(F.filter("_plan", lambda p: p["over"]), lambda p: p["name"]).alias("overflow"), (F.size(F.filter("_plan", lambda p: p["over"])) == 0).alias("feasible"),
    )
