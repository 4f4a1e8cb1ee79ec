"""More registered queries: scalar functions, predicates, mutations and the composite plans, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import formats as fm
from .functions import text as tx
from .operators import catalog as ct
from .operators import chunking, encoders
from .operators import evaluate as ev
from .operators import retrieval as rt
from .plans import pipelines
from .queries import _HASHED, _KNN, _TOKENS, _hashed_index, _hashed_vectors, _hybrid_sql, _query_vectors, _text_index, _top, _vector_index, _vectors, query
from .session import staging_path
from .sources import extract, scan
from .streaming import events as st


def _pick(items, by):
    """The items in turn, by a whole number."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (by % len(items) + 1).cast("int"))


def _shown(column):
    """A value as text, null as NULL."""
    return F.coalesce(F.col(column).cast("string"), F.lit("NULL"))


#: Whether bytes b look like text: none is NUL, under 5 % of the first 8 KB are control bytes.
_TEXTY = """octet_length(b) > 0 AND NOT list_contains({0}, '00') AND len(list_filter({0}, lambda x: x <= '08' OR x BETWEEN '0E' AND '1F' OR x = '7F')) < 0.05 * len({0})""".format("regexp_extract_all(left(hex(b), 16384), '..')")


# ---- sources -------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_partkey % 6 IN (4, 5) AS visible FROM part")
def visible_paths(t):
    path = F.concat(_pick(["/.git/x/", "/node_modules/", "/a/$x/", "/a/", "/a/b.c/", "/Node_Modules/"], F.col("p_partkey")), F.when(F.col("p_partkey") % 6 == 3, "Thumbs.DB").otherwise(F.col("p_name")))
    return t("part").select("p_partkey", scan.visible(path).alias("visible"))


@query(f"""SELECT doc_id, {_TEXTY} AS texty FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ''::BLOB WHEN 1 THEN encode(text) WHEN 2 THEN unhex('00') || encode(text) ELSE unhex('010101010101010101') || encode(text) END AS b FROM documents)""")
def text_sniffed(t):
    """Empty, plain, with a NUL, with nine control bytes."""
    mode, body = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    put = lambda hexed: F.concat(F.unhex(F.lit(hexed)), body)
    content = F.when(mode == 0, F.lit("").cast("binary")).when(mode == 1, body).when(mode == 2, put("00")).otherwise(put("01" * 9))
    return t("documents").select("doc_id", scan.looks_like_text(content).alias("texty"))


@query("SELECT p_partkey, p_partkey % 5 <> 4 OR p_partkey % 2 = 0 AS indexable, CASE p_partkey % 5 WHEN 0 THEN 'text' WHEN 1 THEN 'document' WHEN 2 THEN 'image' WHEN 3 THEN 'video' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'text' ELSE 'other' END END AS category FROM part")
def indexable_files(t):
    ext, texty = _pick([".md", ".pdf", ".png", ".mkv", ".zzz"], F.col("p_partkey")), F.col("p_partkey") % 2 == 0
    return t("part").select("p_partkey", scan.is_indexable(ext, texty).alias("indexable"), scan.category(ext, texty).alias("category"))


@query("SELECT doc_id, doc_id % 5 IN (0, 1) AS plain, doc_id % 5 <> 4 AS with_media FROM documents")
def category_gate(t):
    rows = t("documents").select("doc_id", _pick(["text", "document", "image", "audio", "other"], F.col("doc_id")).alias("category"))
    mark = lambda kept, name: kept.select("doc_id", F.lit(True).alias(name))
    marked = rows.join(mark(ct.indexable(rows), "plain"), "doc_id", "left").join(mark(ct.indexable(rows, True), "with_media"), "doc_id", "left")
    return marked.select("doc_id", F.coalesce("plain", F.lit(False)).alias("plain"), F.coalesce("with_media", F.lit(False)).alias("with_media"))


@query(f"""SELECT doc_id, CASE WHEN read THEN 'text' END AS extractor, CASE WHEN read THEN text END AS text, CASE WHEN NOT read THEN 'unsupported' END AS error FROM (SELECT doc_id, text, doc_id % 3 < 2 OR {_TEXTY} AS read FROM (SELECT *, encode(text) AS b FROM documents))""")
def extracted_texts(t):
    """By extension, and as text by its looks."""
    files = t("documents").select("doc_id", _pick([".txt", ".MD", ".zzz"], F.col("doc_id")).alias("extension"), F.encode("text", "UTF-8").alias("content"))
    return extract.extract(files, key="doc_id").select("doc_id", "extractor", "text", "error")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_nationkey LIMIT 10")
def sources_newest(t):
    return ct.newest_first(t("nation").select("n_nationkey", "n_name", "n_regionkey"), "n_regionkey", "n_nationkey").limit(10)


@query("SELECT count(*) AS points FROM embeddings WHERE label IN (2, 4)")
def point_count(t):
    return ct.point_count(t("embeddings"), label=[2, 4])


@query("SELECT vec_id AS id, 'c' || vec_id AS chunk_id, 'NULL' AS file_id, 'NULL' AS source_id, 'NULL' AS file_name, CASE WHEN label = 3 THEN '' ELSE 'text ' || label END AS text, CASE WHEN label = 5 THEN '7' ELSE 'NULL' END AS page, CASE WHEN label < 5 THEN 'text' ELSE 'other' END AS category, 0::INT AS chunk_idx, label::INT AS offset_start, 0::INT AS offset_end FROM embeddings")
def payload_defaults(t):
    label = F.col("label")
    payload = F.struct(F.concat(F.lit("c"), "vec_id").alias("chunk_id"), F.when(label != 3, F.concat(F.lit("text "), label)).alias("text"), F.when(label == 5, 7).alias("page"), F.when(label < 5, "text").alias("category"), F.when(label != 0, label).alias("offset_start"))
    rows = ct.payload_rows(t("embeddings").select(F.col("vec_id").alias("id"), payload.alias("payload")))
    return rows.withColumns({c: _shown(c) for c in ("file_id", "source_id", "file_name", "page")})


@query("""SELECT doc_id, chunk_id, left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id
  FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS h FROM (SELECT doc_id, source || '::' || doc_id AS chunk_id FROM documents))""")
def point_ids(t):
    name = tx.chunk_id(F.col("source"), F.col("doc_id"))
    return t("documents").select("doc_id", name.alias("chunk_id"), tx.point_id(name).alias("point_id"))


@query("SELECT s_suppkey, n_name AS source_label FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON s_nationkey = n_nationkey")
def source_labels(t):
    sources = t("nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("name"))
    return ct.with_label(t("supplier").withColumnRenamed("s_nationkey", "source_id"), sources).select("s_suppkey", "source_label")


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations")
def page_starts(t):
    return chunking.page_offsets(t("conversations"), "conv_id", "turn").select("conv_id", "turn", "start")


@query("SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'NULL' WHEN o < 100 THEN '3' WHEN o < 500 THEN '5' ELSE '8' END AS page FROM (SELECT event_id, event_id % 701 AS o FROM events)")
def chunk_pages(t):
    page = lambda n, at: F.struct(F.lit(n).alias("page"), F.lit(at).alias("start"))
    pages = F.when(F.col("event_id") % 11 == 0, F.array().cast("array<struct<page:int,start:int>>")).otherwise(F.array(page(3, 0), page(5, 100), page(8, 500)))
    return t("events").select("event_id", chunking.page_at(pages, F.col("event_id") % 701).alias("page")).withColumn("page", _shown("page"))


@query(r"""SELECT doc_id, rtrim(CASE WHEN doc_id % 2 = 0 THEN 'Descripcion: ' || source || CASE WHEN b <> '' THEN chr(10) || chr(10) ELSE '' END ELSE '' END || CASE WHEN b <> '' THEN 'Texto en la imagen: ' || b ELSE '' END, chr(10)) AS text FROM (SELECT *, trim(text, ' ') AS b FROM documents)""")
def image_texts(t):
    return t("documents").select("doc_id", tx.image_text(F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.lit(" ")), F.col("text")).alias("text"))


@query("""SELECT conv_id, CASE WHEN a <> '' AND c <> '' THEN a || chr(10) || chr(10) || c ELSE a || c END AS text FROM (SELECT conv_id, coalesce(string_agg(trim(text, ' '), ' ' ORDER BY turn) FILTER (WHERE trim(text, ' ') <> '' AND conv_id % 3 > 0), '') AS a,
  coalesce(string_agg('[' || printf('%02d:%02d', i * 45 // 60, i * 45 % 60) || '] ' || role, chr(10) ORDER BY i) FILTER (WHERE i < 4 AND i % 2 = 0), '') AS c FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) GROUP BY 1)""")
def video_texts(t):
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))  # one conversation
    made = t("conversations").groupBy("conv_id").agg(rows.alias("x"))
    segments = F.when(F.col("conv_id") % 3 > 0, F.transform("x", lambda x: x["text"]))
    captions = F.transform("x", lambda x, i: F.when(i % 2 == 0, x["role"]))
    return made.select("conv_id", tx.video_text(segments, captions, 45, 4).alias("text"))


# ---- scalar functions ----------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{FFFD}]', ' ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' ') AS text FROM documents")
def sanitised(t):
    return t("documents").select("doc_id", tx.sanitise(F.col("text")).alias("text"))


@query("SELECT doc_id, 'query: ' || text AS e5, text AS other FROM documents")
def model_prefixes(t):
    return t("documents").select("doc_id", tx.model_prefix(F.col("text"), "multilingual-E5-large", "query").alias("e5"), tx.model_prefix(F.col("text"), "bge-m3", "query").alias("other"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN source || chr(10) || text ELSE text END AS text FROM documents")
def embed_texts(t):
    return t("documents").select("doc_id", tx.embed_text(F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", ""), F.col("text")).alias("text"))


@query("SELECT doc_id, left(text, 2000) AS text FROM documents")
def passages(t):
    return t("documents").select("doc_id", tx.passage(F.col("text")).alias("text"))


@query("SELECT event_id, round_even(event_id * 250 / 1000.0::DOUBLE, 0)::INT AS kbps FROM events")
def kilobits(t):
    return t("events").select("event_id", fm.kilobits(F.col("event_id") * 250).alias("kbps"))


@query("SELECT doc_id, doc_id % 3 = 0 AND text IS NOT NULL AS valid FROM documents")
def object_ids(t):
    h = F.md5("text")
    value = F.when(F.col("doc_id") % 3 == 0, F.left(h, F.lit(24))).when(F.col("doc_id") % 3 == 1, F.concat(F.left(h, F.lit(23)), F.lit("g")))
    return t("documents").select("doc_id", tx.object_id_valid(value).alias("valid"))


@query("SELECT p_partkey, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 2 = 0 THEN ':7b' ELSE '' END AS name, p_partkey % 3 <> 0 AS valid FROM part")
def model_names(t):
    bare = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    name = F.concat(F.lit(" "), bare, F.when(F.col("p_partkey") % 2 == 0, ":7b").otherwise(":latest"))
    return t("part").select("p_partkey", tx.model_name(name).alias("name"), tx.model_name_valid(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-"), bare)).otherwise(bare)).alias("valid"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '' ELSE strftime(ts, '%-d %b %Y, %-H:%M') END AS at FROM events")
def absolute_dates(t):
    return t("events").select("event_id", fm.date_time(F.when(F.col("event_id") % 7 != 0, F.col("ts"))).alias("at"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1800 ELSE [45, 600, 900, 1800, 45][doc_id % 5 + 1] END::INT AS seconds FROM documents")
def extraction_timeouts(t):
    return t("documents").select("doc_id", fm.extraction_timeout(_pick(["text", "audio", "image", "video", "document"], F.col("doc_id")), F.col("doc_id") % 7 == 0).alias("seconds"))


@query("SELECT doc_id, ['nvidia', 'amd', 'intel', 'apple', 'other'][doc_id % 5 + 1] AS vendor FROM documents")
def gpu_vendors(t):
    return t("documents").select("doc_id", fm.gpu_vendor(_pick(["GeForce 1650", "AMD Radeon 780M", "Intel Arc", "Apple M2", "Voodoo"], F.col("doc_id"))).alias("vendor"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN format('{:,}', n_chars) WHEN 1 THEN CASE WHEN doc_id % 3 = 0 THEN '—' ELSE (n_chars % 5000 + 1) || '×' || (n_chars % 3000 + 1) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' (' || doc_id % 5 || ' ppi)' END END
  WHEN 2 THEN printf('%d:%02d', n_chars // 60, n_chars % 60) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' (' || doc_id % 5 || ' kbps)' END ELSE '—' END AS shown FROM documents""")
def media_summaries(t):
    d, n = F.col("doc_id"), F.col("n_chars")
    meta = F.struct(n.alias("wordCount"), n.cast("int").alias("duration"), F.when(d % 3 != 0, n % 5000 + 1).cast("int").alias("width"), (n % 3000 + 1).cast("int").alias("height"), (d % 5).cast("double").alias("ppi"), (d % 5).cast("int").alias("bitrate"), F.lit(None).cast("double").alias("fps"))
    return t("documents").select("doc_id", fm.media_summary(_pick(["text", "image", "audio", "other"], d), meta).alias("shown"))


@query(r"""SELECT conv_id, turn, CASE WHEN regexp_matches(b, '[\pL\pN]') AND len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) >= 3 AND NOT (len(w) >= 8 AND len(list_distinct(list_transform(w, lambda x: lower(x)))) <= 2) THEN b ELSE '' END AS caption FROM (
  SELECT *, list_filter(string_split(b, ' '), lambda x: x <> '') AS w FROM (SELECT conv_id, turn, regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(c, '<\|[^|]*\|>|!{2,}[^!]*!{2,}', ' ', 'g'), '^[^\n:]{1,80}:\s*\n+', ''), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), '^[\s,.;:–—-]+', '') AS b
  FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Caption:' || chr(10) || text WHEN 1 THEN '<|im|> -- ' || text WHEN 2 THEN repeat('la ', 9) ELSE text END AS c FROM conversations)))""")
def captions(t):
    mode = F.col("turn") % 4
    raw = F.when(mode == 0, F.concat(F.lit("Caption:\n"), "text")).when(mode == 1, F.concat(F.lit("<|im|> -- "), "text")).when(mode == 2, F.repeat(F.lit("la "), F.lit(9))).otherwise(F.col("text"))
    return t("conversations").select("conv_id", "turn", tx.caption(raw).alias("caption"))


@query("""SELECT item_id AS qid, i - 1 AS variant, CASE i WHEN 1 THEN text WHEN 2 THEN 'what is known of ' || item_id WHEN 3 THEN 'an unlike question ' || item_id END AS question FROM benchmark, unnest([1, 2, 3]) AS u(i)""")
def expanded_queries(t):
    questions = t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
    written = F.concat(F.lit("1. what is known of "), "qid", F.lit('\n- short\n2) "an unlike question '), "qid", F.lit('"\n* WHAT is known of '), "qid")
    return encoders.expanded(questions, written, 3).select("qid", F.col("variant").cast("long").alias("variant"), "question")


@query("SELECT doc_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS words FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)")
def distinct_in_order(t):
    words = F.filter(F.split("text", " "), lambda x: x != "")
    return t("documents").select("doc_id", F.array_distinct(words).alias("words"))


@query("SELECT a.vec_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: round((z[1]::DOUBLE + z[2]::DOUBLE) / 2, 6)) AS mean FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_means(t):
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    right = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("right"))
    mean = encoders.mean_of_halves(as_double("embedding"), as_double("right"))
    return t("embeddings").join(right, "vec_id").select("vec_id", F.transform(mean, lambda x: fm.rounded(x, 6)).alias("mean"))


# ---- mutations -----------------------------------------------------------------------------------------------------


@query("SELECT vec_id, file_id, fresh FROM (SELECT vec_id, label AS file_id, false AS fresh FROM embeddings WHERE label < 6 AND label NOT IN (SELECT label FROM embeddings WHERE label % 2 = 1) UNION ALL SELECT vec_id, label, true FROM embeddings WHERE label % 2 = 1 AND vec_id % 3 <> 0)")
def replaced_chunks(t):
    rows = t("embeddings").select("vec_id", F.col("label").alias("file_id"), F.col("embedding").alias("dense"))
    old = rows.filter("file_id < 6").withColumn("fresh", F.lit(False))
    new = rows.filter("file_id % 2 = 1").withColumn("dense", F.when(F.col("vec_id") % 3 != 0, F.col("dense"))).withColumn("fresh", F.lit(True))
    return ct.replace_by_file(old, new)[0].select("vec_id", "file_id", "fresh")


@query("SELECT (SELECT count(*) FROM region WHERE r_regionkey <> 2) AS sources, (SELECT count(*) FROM nation WHERE n_regionkey <> 2) AS files, (SELECT count(*) FROM supplier WHERE s_nationkey % 5 <> 2) AS chunks")
def removed_source(t):
    sources = t("region").select(F.col("r_regionkey").cast("string").alias("source_id"))
    files = t("nation").select(F.col("n_regionkey").cast("string").alias("source_id"))
    chunks = t("supplier").select((F.col("s_nationkey") % 5).cast("string").alias("source_id"))
    left = [x.agg(F.count("*").alias(n)) for x, n in zip(ct.remove_source("2", sources, files, chunks), ("sources", "files", "chunks"))]
    return left[0].crossJoin(left[1]).crossJoin(left[2])  # one row each


@query("SELECT n_nationkey::VARCHAR AS source_id, CASE WHEN n_nationkey = 7 THEN n_nationkey % 2 <> 0 ELSE n_nationkey % 2 = 0 END AS auto_index FROM nation")
def toggled_source(t):
    rows = t("nation").select(F.col("n_nationkey").cast("string").alias("source_id"), (F.col("n_nationkey") % 2 == 0).alias("auto_index"))
    return ct.toggle_auto_index(rows, "7")


@query("""SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"at":"1970-01-01T00:00:' || printf('%02d', doc_id % 60) || '.000000Z"}' AS json FROM documents""")
def serialised(t):
    return ct.serialise(t("documents").select("doc_id", "lang", "n_chars", F.timestamp_seconds(F.col("doc_id") % 60).alias("at")))


@query("SELECT count(*) FILTER (WHERE doc_id % 4 < 2) AS n_done, count(*) FILTER (WHERE doc_id % 4 = 2) AS n_skipped, count(*) FILTER (WHERE doc_id % 4 = 3) AS n_failed, sum(CASE WHEN doc_id % 4 < 2 THEN n_chars // 2048 + 1 ELSE 0 END)::BIGINT AS chunks FROM documents")
def ingest_counters(t):
    status = _pick(["done", "done", "skipped", "failed"], F.col("doc_id"))
    return ct.ingest_counters(t("documents").select(status.alias("index_status"), F.when(F.col("doc_id") % 4 < 2, F.floor(F.col("n_chars") / 2048) + 1).otherwise(0).alias("indexed_chunks")))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE source = 'src3'")
def written_partition(t):
    """Each source is a partition; a second write replaces only its own."""
    rows = t("documents").select("doc_id", "lang", "n_chars", "source")
    spark, path = rows.sparkSession, staging_path(rows.sparkSession, "catalog")
    ct.write_partition(rows.withColumn("lang", F.when(F.col("source") != "src3", F.col("lang"))), path, "source")
    ct.write_partition(rows.filter("source = 'src3'"), path, "source")
    return spark.read.schema(rows.schema).parquet(path).filter("source = 'src3' AND lang IS NOT NULL").drop("source")


@query("SELECT event_id, event_type, round(value, 3) AS value FROM events")
def csv_results(t):
    rows = t("events").select("event_id", "event_type", fm.rounded(F.col("value"), 3).alias("value"))
    path = staging_path(rows.sparkSession, "results")
    pipelines.write_results(rows, path)
    return rows.sparkSession.read.option("header", True).schema("event_id long, event_type string, value double").csv(path)


@query("""SELECT 'data: {"event_id":' || event_id || ',"event_type":"' || event_type || '"}' || chr(10) || chr(10) AS body FROM events""")
def sse_bodies(t):
    return st.to_sse(t("events").select("event_id", "event_type"))


# ---- composite plans -----------------------------------------------------------------------------------------------


def _chunks(t, dense: bool = False):
    """Every document is one chunk; with its vector if ``dense``, which only diversity reads where indexes are given."""
    rows = t("documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("file_id"), F.col("source").alias("source_id"), F.col("lang").alias("category"), F.concat("source", F.lit(".txt")).alias("file_name"), F.lit(None).cast("int").alias("page"), "text", F.lit("").alias("context"))
    if not dense:
        return rows.withColumn("dense", F.lit(None).cast("array<float>"))
    return rows.join(_hashed_vectors(t).select(F.col("id").alias("chunk_id"), F.col("vector").alias("dense")), "chunk_id")


def _asked(t):
    return t("benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def _options(t, **given):
    """Options with the kept indexes of the chunks, which are whole documents."""
    return pipelines.Options(indexes=pipelines.Indexes(_hashed_index(t), _text_index(t)), **given)


def _plain(t):
    return _options(t, scorer=None, use_mmr=False)


@query(f"SELECT qid, id AS chunk_id, score, rank FROM ({_top(_hybrid_sql(5), 5)})")
def retrieve_plain(t):
    """No reranker, no diversity: the hybrid ranking's final slice."""
    return pipelines.retrieve(_asked(t), _chunks(t), 5, _plain(t)).select("qid", "chunk_id", "score", "rank")


_SHARE = f"""SELECT h.qid, h.id, round(len(list_intersect(list_distinct({_TOKENS.format('b.text')}), list_distinct({_TOKENS.format('left(d.text, 2000)')})))::DOUBLE / len(list_distinct({_TOKENS.format('b.text')})), 6) AS score
  FROM ({_top(_hybrid_sql(10), 10)}) h JOIN benchmark b ON b.item_id = h.qid JOIN documents d ON d.doc_id = h.id"""


@query(f"SELECT qid, id AS chunk_id, score, rank FROM ({_top(f'SELECT * FROM ({_SHARE}) QUALIFY score >= max(score) OVER (PARTITION BY qid) - 0.2', 5)})")
def retrieve_reranked(t):
    """Twice as many fetched, scored by shared tokens, cut by a margin, the best five."""
    return pipelines.retrieve(_asked(t), _chunks(t), 5, _options(t, use_mmr=False, margin=0.2)).select("qid", "chunk_id", "score", "rank")


@query(f"""SELECT qid, id AS chunk_id, score, rank FROM ({_top(f"SELECT qid, id, CASE WHEN n = 1 THEN own ELSE round(fused, 9) END AS score FROM (SELECT h.qid, id, sum(1.0::DOUBLE / (60 + rank)) AS fused, max(score) AS own, 1 AS n FROM ({_top(_hybrid_sql(10), 10)}) h GROUP BY 1, 2)", 5)})""")
def retrieve_multi_single(t):
    """Without variants the question's own ranking decides, scores as they were."""
    variants = encoders.expanded(_asked(t))
    return pipelines.retrieve_multi(variants, _chunks(t), 5, _plain(t)).select("qid", "chunk_id", "score", "rank")


@query(f"""WITH RECURSIVE c AS (SELECT qid, id, score, n, round(CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1 END, 12) AS rel FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS n, min(score) OVER (PARTITION BY qid) AS lo, max(score) OVER (PARTITION BY qid) AS hi
    FROM (SELECT * FROM ({_SHARE}) QUALIFY score >= max(score) OVER (PARTITION BY qid) - 0.2))),
  vec AS (SELECT doc_id AS id, bucket, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS v FROM ({_HASHED.format(id='doc_id', table='documents')}) WHERE doc_id IN (SELECT id FROM c)),
  near AS (SELECT a.qid, a.id, b.id AS other, coalesce(sum(x.v * y.v), 0) AS cos FROM c a JOIN c b ON a.qid = b.qid JOIN vec x ON x.id = a.id JOIN vec y ON y.id = b.id AND y.bucket = x.bucket GROUP BY ALL),
  p(qid, picked, pick) AS (SELECT qid, [arg_max(id, (rel, -id))], 1 FROM c WHERE n > 5 GROUP BY qid
    UNION ALL SELECT qid, list_append(picked, arg_max(id, (round(0.7 * rel - 0.3 * worst, 12), score, -id))), pick + 1 FROM (
      SELECT p.qid, p.picked, p.pick, c.id, c.rel, c.score, (SELECT coalesce(max(cos), 0) FROM near n WHERE n.qid = c.qid AND n.id = c.id AND list_contains(p.picked, n.other)) AS worst FROM p JOIN c ON p.qid = c.qid AND NOT list_contains(p.picked, c.id)) WHERE pick < 5 GROUP BY qid, picked, pick)
  SELECT q.qid, q.id AS chunk_id, c.score, q.rank::BIGINT AS rank FROM (SELECT qid, unnest(picked) AS id, generate_subscripts(picked, 1) AS rank FROM p WHERE pick = 5 UNION ALL SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) FROM c WHERE n <= 5) q JOIN c USING (qid, id)""")
def retrieve_diverse(t):
    """Reranker, margin and diversity together: of twice as many, five that differ."""
    return pipelines.retrieve(_asked(t), _chunks(t, dense=True), 5, _options(t, margin=0.2)).select("qid", "chunk_id", "score", "rank")


@query(f"""WITH h AS (SELECT qid, id, score, rank FROM ({_top(_hybrid_sql(10), 10)})), r AS (SELECT qid, 0 AS variant, id, score, rank FROM h UNION ALL SELECT qid - 1, 1, id, score, rank FROM h WHERE qid - 1 IN (SELECT item_id FROM benchmark)),
  f AS (SELECT qid, id, CASE WHEN n = 1 THEN max(score) ELSE round(sum(1.0::DOUBLE / (60 + rank)), 9) END AS score FROM r JOIN (SELECT qid, count(DISTINCT variant) AS n FROM r GROUP BY 1) USING (qid) GROUP BY qid, id, n)
  SELECT qid, id AS chunk_id, score, rank FROM ({_top('SELECT * FROM f', 5)})""")
def retrieve_multi(t):
    """Each question and, as its variant, the next one: two rankings, fused, the best five."""
    own = _asked(t)
    variants = own.select("qid", F.lit(0).alias("variant"), "question").unionByName(own.select((F.col("qid") - 1).alias("qid"), F.lit(1).alias("variant"), "question").join(own.select("qid"), "qid", "left_semi"))
    return pipelines.retrieve_multi(variants, _chunks(t), 5, _plain(t)).select("qid", "chunk_id", "score", "rank")


@query(f"""SELECT qid, CASE WHEN c IS NULL THEN 'The indexed documents do not hold enough information to answer.' ELSE split_part(c, chr(10), 1) END AS answer, c IS NOT NULL AS has_hits
  FROM (SELECT item_id AS qid, '[1] (chunk_id=' || id || ', archivo=' || source || '.txt) ' || d.text AS c FROM benchmark LEFT JOIN ({_top(_hybrid_sql(5), 1)}) h ON h.qid = item_id LEFT JOIN documents d ON d.doc_id = h.id)""")
def ask_answers(t):
    return pipelines.ask(_asked(t), _chunks(t), 5, _plain(t))[1].select("qid", "answer", "has_hits")


@query(f"SELECT qid, rank, id AS chunk_id, source AS file_id, source || '.txt' AS file_name, 'NULL' AS page, score, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS snippet FROM ({_top(_hybrid_sql(5), 5)}) h JOIN documents d ON d.doc_id = h.id")
def ask_citations(t):
    return pipelines.ask(_asked(t), _chunks(t), 5, _plain(t))[0].withColumn("page", _shown("page"))


@query(f"""WITH h AS (SELECT h.qid, d.source, min(h.rank) AS first FROM ({_top(_hybrid_sql(5), 5)}) h JOIN documents d ON d.doc_id = h.id GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS place FROM h),
  x AS (SELECT item_id AS qid, count(o.source) FILTER (WHERE o.source IN ('src1', 'src2', 'src3')) / 3.0::DOUBLE AS recall, coalesce(1.0::DOUBLE / min(place) FILTER (WHERE o.source IN ('src1', 'src2', 'src3')), 0) AS rr, item_id::DOUBLE AS latency FROM benchmark LEFT JOIN o ON o.qid = item_id GROUP BY item_id)
  SELECT count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, round(avg(rr), 6) AS mrr, quantile_cont(latency, 0.5) AS p50, quantile_cont(latency, 0.95) AS p95, quantile_cont(latency, 0.99) AS p99 FROM x""")
def scored_pipeline(t):
    dataset = _asked(t).withColumns({"relevant_ids": F.array(F.lit("src1"), F.lit("src2"), F.lit("src3")), "latency": F.col("qid").cast("double")})
    return pipelines.score_pipeline(dataset, _chunks(t), 5, _plain(t)).withColumns({"mean_recall": F.round("mean_recall", 6), "mrr": F.round("mrr", 6)})


@query("SELECT p_partkey AS file_id, p_name AS name FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) ORDER BY p_name, p_partkey LIMIT 15 OFFSET 15")
def listed_files(t):
    """A blank query lists the category by name."""
    first = t("part").agg(F.min("p_brand")).first()[0]
    files = t("part").select(F.col("p_partkey").alias("file_id"), F.col("p_name").alias("name"), F.col("p_name").alias("path"), F.col("p_brand").alias("category"))
    return pipelines.search_files("  ", None, files, page=2, category=first).select("file_id", "name")


@query(f"""SELECT qid, place, source AS file_id, round(score, 4) AS relevance_score, total FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS place, count(*) OVER (PARTITION BY qid) AS total FROM (
  SELECT h.qid, d.source, h.score, h.rank, row_number() OVER (PARTITION BY h.qid, d.source ORDER BY h.score DESC, h.rank) AS r FROM ({_top(_hybrid_sql(20), 20)}) h JOIN documents d ON d.doc_id = h.id) WHERE r = 1) WHERE place <= 15""")
def searched_files(t):
    """Every question through the search: the best chunk of each file, a page of files."""
    files = t("documents").select(F.col("source").alias("file_id")).distinct()
    return pipelines.search(_asked(t), _chunks(t), files, options=_plain(t)).select("qid", "place", "file_id", "relevance_score", "total")


@query(f"SELECT q.vec_id AS qid, count(DISTINCT label) AS n_files FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 50 = 0) q JOIN ({_top(_KNN, 10, 'qid, label')}) h ON h.qid = q.vec_id GROUP BY 1")
def distinct_files(t):
    hits = _vector_index(t).top(_query_vectors(t), 10).join(_vectors(t).select("id", "label"), "id")
    return hits.select("qid", "label").distinct().groupBy("qid").agg(F.count("*").alias("n_files"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) + 0.0 AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(t):
    right = t("embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("right"))
    return t("embeddings").join(right, "vec_id").select("vec_id", (fm.rounded(rt.cosine(F.col("embedding"), F.col("right")), 6) + 0.0).alias("cosine"))


@query("SELECT event_type, list_sort(list(value))[greatest(floor(0.95 * count(*))::INT, 1)] AS p95 FROM events GROUP BY 1")
def p95_by_rank(t):
    return t("events").groupBy("event_type").agg(ev.p95_by_rank("value").alias("p95"))
