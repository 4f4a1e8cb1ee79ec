"""Operators on the file catalog: statistics, pages, searches by name, the incremental diff and mutations.

No operator collects rows or leaves the JVM. A page is a sort with offset and limit (a top-k in the plan); totals are
counted once and joined as one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..functions.formats import changed

#: The columns that a page may be sorted by.
SORTABLE = ("name", "size", "modified_at", "created_at")
#: Categories that are indexed, and those that are with multimedia on.
TEXTUAL, MULTIMEDIA = ("text", "document"), ("image", "audio", "video")
DIFF_STATES = ("deleted", "new", "modified", "retry", "unchanged")


def totals(files: DataFrame, size: str = "size") -> DataFrame:
    """AGG-1, AGG-2: total_count and total_size, 0 for no rows."""
    return files.agg(F.count("*").alias("total_count"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size"))


def by_category(files: DataFrame, category: str = "category", size: str = "size") -> DataFrame:
    """AGG-3: count and size of each category, the most first."""
    return files.groupBy(category).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("total_size")).orderBy(F.desc("n"), category)


def last_indexed(files: DataFrame, key: str | None, at: Column) -> DataFrame:
    """AGG-4: the latest time, by ``key`` or over all; null if there is none."""
    return (files.groupBy(key) if key else files).agg(F.max(at).alias("last_indexed"))


def status_counts(files: DataFrame, source: str = "source_id", status: str = "index_status") -> DataFrame:
    """AGG-6: files of each source by index status."""
    count = lambda s: F.count_if(F.col(status) == s).alias(f"n_{s}")
    return files.groupBy(source).agg(F.count("*").alias("n_files"), *map(count, ("done", "skipped", "failed")))


def done_sources(sources: DataFrame) -> DataFrame:
    """AGG-5: sources with status done."""
    return sources.agg(F.count_if(F.col("status") == "done").alias("n_done"))


def summary(files: DataFrame, sources: DataFrame, indexed_at: Column) -> DataFrame:
    """PIPE-8: the one-row summary; categories as an array, most files first."""
    groups = files.groupBy("category").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    listed = groups.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "category", "n", "total_size"))).alias("g"))  # one per category
    listed = listed.select(F.transform("g", lambda x: F.struct(x["category"].alias("category"), x["n"].alias("n"), x["total_size"].alias("total_size"))).alias("categories"))
    one = lambda df: F.broadcast(df)  # noqa: E731  one row each
    return totals(files).join(one(listed)).join(one(last_indexed(files, None, indexed_at))).join(one(done_sources(sources)))


def equality(files: DataFrame, **wanted) -> DataFrame:
    """PRJ-1..3: all conditions hold; a list means any of its values, None no condition."""
    for column, value in wanted.items():
        if value is None or isinstance(value, (list, tuple, set)) and not value:
            continue
        files = files.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return files


def with_source(files: DataFrame, source_id: str | None) -> DataFrame:
    """PRJ-3: a source that isn't a valid id sets no condition."""
    valid = source_id and len(source_id) == 24 and all(c in "0123456789abcdefABCDEF" for c in source_id)
    return files.filter(F.col("source_id") == source_id) if valid else files


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """TOP-10, TOP-11: one page; beyond the end it is empty."""
    if number < 1 or not 1 <= size <= 500:
        raise ValueError("a page begins at 1 and has 1 to 500 rows")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def sorted_page(files: DataFrame, sort_by: str = "size", sort_dir: str = "desc", number: int = 1, size: int = 50, key: str = "file_id") -> DataFrame:
    """TOP-9: by a column of the allowed ones (else by size), descending unless asc is asked for; ties by ``key``."""
    column = sort_by if sort_by in SORTABLE else "size"
    return page(files, number, size, F.asc(column) if sort_dir == "asc" else F.desc(column), F.asc(key))


def page_count(total: Column, size: int) -> Column:
    """TOP-12: at least one."""
    return F.greatest(F.ceil(total / size), F.lit(1)).cast("long")


def pages_of(total: int, size: int) -> int:
    return max(math.ceil(total / size), 1)


def name_search(files: DataFrame, query: str, *columns: str) -> DataFrame:
    """PRJ-4: any word of the query in any of the columns."""
    return files.filter(tx.any_word_in(F.lit(query), *[F.col(c) for c in columns or ("name", "path")]))


def indexable(files: DataFrame, multimedia: bool = False) -> DataFrame:
    """PRJ-5: categories that are indexed."""
    return files.filter(F.col("category").isin(*TEXTUAL, *(MULTIMEDIA if multimedia else ())))


def orphans(files: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """JOIN-4: files whose source is gone."""
    return files.join(sources, key, "left_anti")


def incremental_diff(catalog: DataFrame, listing: DataFrame, key: str = "path", tolerance: float = 2.0) -> DataFrame:
    """JOIN-3, SCL-30, SET-1: key and state of each path: deleted, new, modified, retry (indexed without success) or unchanged.

    Both sides have ``key``, modified_at and size; the catalog has index_status as well. One full outer join on the key.
    """
    old = catalog.select(key, F.col("modified_at").alias("old_time"), F.col("size").alias("old_size"), "index_status", F.lit(True).alias("old"))
    new = listing.select(key, F.col("modified_at").alias("new_time"), F.col("size").alias("new_size"), F.lit(True).alias("new"))
    state = (
        F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "new")
        .when(changed(F.col("old_time"), F.col("new_time"), F.col("old_size"), F.col("new_size"), tolerance), "modified")
        .when(F.coalesce("index_status", F.lit("pending")).isin("failed", "pending"), "retry").otherwise("unchanged")
    )
    return old.join(new, key, "full_outer").select(key, state.alias("state"))


def to_index(diff: DataFrame, key: str = "path") -> DataFrame:
    """SET-2: new, modified and retried paths."""
    return diff.filter(F.col("state").isin("new", "modified", "retry")).select(key).distinct()


def upsert(table: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """SNK-2, SNK-3: ``rows`` replace those of ``table`` with the same keys; of several the last in ``seq``, if there is one."""
    if "seq" in rows.columns:
        latest = Window.partitionBy(*keys).orderBy(F.desc("seq"))
        rows = rows.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank", "seq")
    else:
        rows = rows.dropDuplicates(list(keys))
    return table.join(rows, list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """SNK-4: the rows that don't fulfil the condition (null counts as not)."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(table: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """SNK-5."""
    return table.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def replace_by_file(chunks: DataFrame, prepared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SNK-6: (chunks with those of the prepared files replaced, file_id and index_status of each): null vectors are dropped, all null failed."""
    usable = prepared.filter("dense IS NOT NULL")
    status = prepared.groupBy("file_id").agg(F.count("dense").alias("indexed_chunks")).withColumn("index_status", F.when(F.col("indexed_chunks") > 0, "done").otherwise("failed"))
    return delete_keys(chunks, prepared, "file_id").unionByName(usable, allowMissingColumns=True), status


def remove_source(source_id: str, sources: DataFrame, files: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SNK-7: all three tables without the source."""
    gone = F.col("source_id") == source_id
    return delete_where(sources, gone), delete_where(files, gone), delete_where(chunks, gone)


def add_source(sources: DataFrame, source: DataFrame) -> DataFrame:
    """SNK-8: ``source`` (one row) is appended; its path must be a folder of a file system that Spark reads, and new."""
    if source.join(sources, "path", "left_semi").head(1):
        raise ValueError("a source with this path exists")
    spark, path = source.sparkSession, source.first()["path"]
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(folder) or not system.getFileStatus(folder).isDirectory():
        raise FileNotFoundError(f"no such folder: {path}")
    return sources.unionByName(source, allowMissingColumns=True)


def toggle_auto_index(sources: DataFrame, source_id: str) -> DataFrame:
    """SNK-9."""
    return sources.withColumn("auto_index", F.when(F.col("source_id") == source_id, ~F.col("auto_index")).otherwise(F.col("auto_index")))


def write_partition(rows: DataFrame, path: str, by: str = "source_id") -> None:
    """SNK-1: rewrites only the partitions that ``rows`` has; readers of others aren't disturbed."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def serialise(rows: DataFrame) -> DataFrame:
    """SNK-12: each row as JSON, timestamps in ISO form."""
    return rows.select(F.to_json(F.struct("*"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("json"))


def ingest_counters(results: DataFrame) -> DataFrame:
    """AGG-21: files by outcome and chunks in all."""
    count = lambda s: F.count_if(F.col("index_status") == s).alias(f"n_{s}")
    return results.agg(*map(count, ("done", "skipped", "failed")), F.coalesce(F.sum("indexed_chunks"), F.lit(0)).alias("chunks"))


def model_panel(catalog: DataFrame, installed: DataFrame) -> DataFrame:
    """JOIN-10, SET-6, TOP-13, PRJ-18: known models with what is installed of them, then installed ones that aren't known."""
    known = catalog.join(installed.select("model_id", F.col("size").alias("installed_size"), "capabilities"), "model_id", "left")
    known = known.select("model_id", F.coalesce("installed_size", "size_hint").alias("size"), F.col("installed_size").isNotNull().alias("installed"), F.when(F.col("capabilities").isNull(), F.col("category")).otherwise(capability_kind(F.col("capabilities"))).alias("category"), "power")
    other = installed.join(catalog, "model_id", "left_anti").select("model_id", "size", F.lit(True).alias("installed"), capability_kind(F.col("capabilities")).alias("category"), F.lit(None).cast("int").alias("power"))
    order = F.create_map(*[F.lit(x) for pair in (("llm", 0), ("vision", 1), ("audio", 2), ("ocr", 3), ("pdf", 4), ("otro", 5)) for x in pair])
    rows = known.unionByName(other)
    return rows.withColumn("kind_order", F.coalesce(order[F.col("category")], F.lit(99))).withColumn("power", F.coalesce("power", F.lit(99))).orderBy("kind_order", "power", "model_id")


def capability_kind(capabilities: Column) -> Column:
    """PRJ-18: what a model is used for first."""
    has = lambda c: F.array_contains(capabilities, c)
    return F.when(has("completion") & ~has("embedding"), "llm").when(has("vision"), "vision").otherwise("otro")


def recent_queries(log: DataFrame, n: int = 6) -> DataFrame:
    """TOP-14: distinct queries, the latest first."""
    return log.groupBy("query").agg(F.max("ts").alias("ts")).orderBy(F.desc("ts"), "query").limit(n)


def newest_first(sources: DataFrame, at: str = "created_at", key: str = "source_id") -> DataFrame:
    """SRC-26: all sources, the latest first."""
    return sources.orderBy(F.desc(at), F.asc(key))


def point_count(chunks: DataFrame, **wanted) -> DataFrame:
    """SRC-27: an exact count of the points that fulfil the conditions."""
    return equality(chunks, **wanted).agg(F.count("*").alias("points"))


def payload_rows(points: DataFrame) -> DataFrame:
    """PRJ-10: (id, payload struct) as rows; what a payload lacks gets its default."""
    held = {f.name for f in points.schema["payload"].dataType.fields}
    part = lambda name, kind: F.col(f"payload.{name}").cast(kind) if name in held else F.lit(None).cast(kind)
    columns = [part(n, "string").alias(n) for n in ("chunk_id", "file_id", "source_id", "file_name")]
    columns += [F.coalesce(part("text", "string"), F.lit("")).alias("text"), part("page", "int").alias("page"), F.coalesce(part("category", "string"), F.lit("other")).alias("category")]
    columns += [F.coalesce(part(n, "int"), F.lit(0)).alias(n) for n in ("chunk_idx", "offset_start", "offset_end")]
    return points.select("id", *columns)


def with_label(files: DataFrame, sources: DataFrame) -> DataFrame:
    """JOIN-12: files with their source's name; files whose source is gone stay, without one."""
    return files.join(sources.select("source_id", F.col("name").alias("source_label")), "source_id", "left")


def ensure_table(spark, name: str, columns: str, required: tuple[str, ...] = ("dense",), by: str = "source_id") -> bool:
    """SNK-1: whether the table was made. One that has the ``required`` columns stays as it is; any other is dropped and made anew, partitioned."""
    if spark.catalog.tableExists(name):
        if set(required) <= set(spark.table(name).columns):
            return False
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet PARTITIONED BY ({by})")
    return True
