"""SRC-1..6: listing folders, classifying files and sniffing text."""

from __future__ import annotations

import mimetypes
import os
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage

# The extensions of each category.
CATEGORIES = {
    "text": "txt md markdown html htm css js mjs cjs ts tsx jsx json jsonl xml yaml yml toml ini cfg conf env sh bat ps1 sql csv tsv log py java go rs c cpp h hpp cs php rb swift kt r m tex rst".split(),
    "document": "pdf docx doc odt ods odp pptx ppt xlsx xls rtf epub".split(),
    "image": "png jpg jpeg gif webp svg bmp tiff tif ico avif".split(),
    "audio": "mp3 m4a wav ogg oga flac aac wma opus aiff".split(),
    "video": "mp4 avi mpeg mpg mov mkv webm wmv flv m4v 3gp".split(),
}
# Folders and files that are never read, the bytes and the share of control bytes of the text test.
IGNORED_DIRS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", ".next")
IGNORED_FILES = ("desktop.ini", "thumbs.db", "thumbs.db:encryptable", ".ds_store", "ntuser.dat", "ntuser.ini")
SNIFF_BYTES, CONTROL_SHARE = 8192, 0.05
CONTROL = bytes([*range(0x00, 0x09), *range(0x0E, 0x20), 0x7F])

FILES = "path string, name string, extension string, size long, created_at timestamp, modified_at timestamp"


def extension(path: Column) -> Column:
    """With its dot, in lower case; empty for none and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r".(\.[^.]*)$", 1))


def category(ext: Column, texty: Column) -> Column:
    """SRC-3: by extension; others are text if they look like it."""
    out = None
    for name, known in CATEGORIES.items():
        hit = ext.isin(*[f".{e}" for e in known])
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(texty, "text").otherwise("other")


def mime_type(ext: Column, texty: Column) -> Column:
    """SRC-3: by extension; text/plain for others that look like text."""
    known = [(f".{e}", mimetypes.types_map.get(f".{e}")) for own in CATEGORIES.values() for e in own]
    table = F.create_map(*[F.lit(x) for e, m in known if m for x in (e, m)])
    listed = ext.isin(*[e for e, _ in known])
    return F.coalesce(table[ext], F.when(~listed & texty, F.lit("text/plain")), F.lit("application/octet-stream"))


def looks_like_text(content: Column) -> Column:
    """SRC-4: no NUL and under 5 % control bytes in the first 8 KB; empty files don't."""
    head = F.decode(F.substring(content, 1, SNIFF_BYTES), "ISO-8859-1")
    length = F.length(head)
    control = length - F.length(F.regexp_replace(head, r"[\x00-\x08\x0E-\x1F\x7F]", ""))
    return F.coalesce((length > 0) & ~F.contains(head, F.lit("\x00")) & (control < CONTROL_SHARE * length), F.lit(False))


def visible(path: Column) -> Column:
    """PRJ-6: no part hidden or ignored."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folders, name = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.element_at(parts, -1)
    hidden = lambda p: F.startswith(p, F.lit(".")) | F.startswith(p, F.lit("$"))
    return ~(F.exists(folders, lambda p: hidden(p) | p.isin(*IGNORED_DIRS)) | hidden(name) | F.lower(name).isin(*IGNORED_FILES))


def visible_entry(name: str, folder: bool) -> bool:
    """PRJ-6 of one name."""
    return name[0] not in ".$" and (name not in IGNORED_DIRS if folder else name.lower() not in IGNORED_FILES)


def _entries(folder: str) -> Iterator[tuple[str, os.stat_result, bool]]:
    """(path, stat, whether a folder) of what is visible in one folder, by name; what can't be read is left out, links to folders aren't followed."""
    try:
        found = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    for entry in found:
        try:
            inner = entry.is_dir(follow_symlinks=False)
            if visible_entry(entry.name, inner) and (inner or entry.is_file()):
                yield entry.path, entry.stat(), inner
        except OSError:
            continue


def walk_all(root: str) -> Iterator[tuple[str, os.stat_result, bool]]:
    """(path, stat, whether a folder) of everything visible below ``root``; hidden folders aren't entered."""
    for path, stat, folder in _entries(root):
        yield path, stat, folder
        if folder:
            yield from walk_all(path)


def walk(root: str) -> Iterator[tuple[str, float, float, int]]:
    """SRC-1 on the driver's own file system: (path, created, modified, size) of visible files."""
    for path, s, folder in walk_all(root):
        if not folder:
            yield path, s.st_ctime, s.st_mtime, s.st_size


_LISTED = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("created_at", pa.timestamp("us", "UTC")), ("modified_at", pa.timestamp("us", "UTC")), ("head", pa.binary())])


def _list_folders(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = {f".{e}" for own in CATEGORIES.values() for e in own}
    for batch in source:
        for folder in batch.column("path").to_pylist():
            rows = []
            for path, s, inner in _entries(folder):
                head = None
                if not inner and os.path.splitext(path)[1].lower() not in known:
                    try:
                        with open(path, "rb") as f:
                            head = f.read(SNIFF_BYTES)
                    except OSError:
                        continue
                rows.append((path, inner, s.st_size, int(s.st_ctime * 1e6), int(s.st_mtime * 1e6), head))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _LISTED.types)], schema=_LISTED)


def _read_files(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        for i in range(batch.num_rows):  # one file at a time
            try:
                with open(batch.column("path")[i].as_py(), "rb") as f:
                    content = f.read()
            except OSError:
                content = None
            yield batch.slice(i, 1).append_column("content", pa.array([content], pa.binary()))


def scan_tree(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """SRC-1, SRC-2 of a folder that all executors mount, listed by them: path, name, extension, category, mime_type, size, created_at, modified_at (and content).

    A level of folders is listed at a time, dealt over tasks; hidden and ignored folders are never entered. Of files whose
    extension says nothing, the first SNIFF_BYTES are read; whole files only for ``content``, and only those that can be indexed
    (null for others and for what can't be read). Files that go away meanwhile are left out.
    """
    level, found = spark.createDataFrame([(root.rstrip("/") or "/",)], "path string"), None
    while True:
        rows = stage(level.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_list_folders, "path string, folder boolean, size long, created_at timestamp, modified_at timestamp, head binary"), "listed-folders")
        found = rows if found is None else found.unionByName(rows)
        level = rows.filter("folder").select("path")
        if level.isEmpty():
            break
    texty, ext = looks_like_text(F.col("head")), extension(F.col("path"))
    files = found.filter("NOT folder").select("path", F.element_at(F.split("path", "/"), -1).alias("name"), ext.alias("extension"), category(ext, texty).alias("category"), mime_type(ext, texty).alias("mime_type"), "size", "created_at", "modified_at")
    if not content:
        return files
    wanted = files.filter("category <> 'other'").repartition(spark.sparkContext.defaultParallelism)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    return wanted.mapInArrow(_read_files, ddl + ", content binary").unionByName(files.filter("category = 'other'").withColumn("content", F.lit(None).cast("binary")))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """SRC-1, SRC-2 of a local folder, names that begin with an underscore included: the columns of FILES."""
    at = lambda t: datetime.fromtimestamp(t, timezone.utc)
    rows = [(p, os.path.basename(p), os.path.splitext(p)[1].lower(), size, at(c), at(m)) for p, c, m, size in walk(root)]
    return spark.createDataFrame(rows, FILES)


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """SRC-1, SRC-2 of any file system, listed by Spark (which skips names that begin with an underscore): path, name, extension, category, mime_type, size, modified_at (and content)."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    bare = F.regexp_replace(F.col("path"), "^file:/+", "/")
    inside = F.substr(bare, F.lit(len(root.removeprefix("file:").rstrip("/")) + 1))
    rows = read.select(bare.alias("path"), inside.alias("_in"), F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), "content").filter(visible(F.col("_in")))
    texty, ext = looks_like_text(F.col("content")), extension(F.col("path"))
    columns = ["path", F.element_at(F.split("path", "/"), -1).alias("name"), ext.alias("extension"), category(ext, texty).alias("category"), mime_type(ext, texty).alias("mime_type"), "size", F.lit(None).cast("timestamp").alias("created_at"), "modified_at"]
    return rows.select(*columns, *(["content"] if content else []))


def is_indexable(ext: Column, texty: Column) -> Column:
    """SRC-5."""
    return category(ext, texty) != "other"
