"""Text functions as Spark columns (SCL-1..29): no Python on the executors unless a docstring says so."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters of a token.
TOKEN = "[a-z0-9à-öø-ÿ]+"
_TOKEN_BYTES = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789", np.uint8))
#: Separators of path parts, and borders inside a part (camel case, acronym, digits).
PATH_SEPARATORS = r"[_\-\s]+"
PATH_BORDERS = r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=\D)(?=\d)|(?<=\d)(?=\D)"
#: Shares of characters beyond which a text layer is taken for broken.
CONTROL_SHARE, LATIN_EXTENDED_SHARE = 0.02, 0.10
#: Lengths of snippets and passages.
CITATION_CHARS, SEARCH_CHARS, PASSAGE_CHARS = 200, 300, 2000


def tokens(text: Column) -> Column:
    """Lower-case tokens of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_runs(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """For Arrow functions: (all tokens, one text's after the other's; how many each text has) of lower-case texts, as ``tokens`` finds
    them: the runs of the bytes that tokens have, cut where texts begin."""
    texts = pc.fill_null(texts, "")
    edges = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset) if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    lead = data == 0xC3  # à to ÿ without ÷ are C3 A0 to C3 BF without C3 B7
    lead[:-1] &= (data[1:] >= 0xA0) & (data[1:] != 0xB7)
    held = _TOKEN_BYTES[data] | lead
    held[1:] |= lead[:-1]
    begin = held.copy()
    begin[1:] &= ~held[:-1]
    first = edges[:-1][edges[:-1] < len(data)]
    begin[first] |= held[first]
    starts = np.flatnonzero(begin)
    offsets = np.append(np.cumsum(held)[starts] - 1, held.sum()).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[held])), np.diff(np.searchsorted(starts, edges))


def word_count(text: Column) -> Column:
    """SCL-4: pieces between white space that aren't empty; null counts as empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def char_count(text: Column) -> Column:
    """SCL-5: code points."""
    return F.length(F.coalesce(text, F.lit("")))


def _normalised(text: pa.Array) -> pa.Array:
    """A text at a time; nulls stay."""
    return pa.array((t if t is None or unicodedata.is_normalized("NFC", t) else unicodedata.normalize("NFC", t) for t in (x.as_py() for x in text)), pa.string(), size=len(text))


_nfc = F.arrow_udf(_normalised, T.StringType())


def sanitise(text: Column) -> Column:
    """SCL-1: NFC (an Arrow UDF, Spark has none), control characters and U+FFFD to spaces, runs of white space to one.

    Characters below U+0300 neither combine nor change: only texts that have others go to Python.
    """
    composed = F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x{2FF}]"), text)), text)
    return F.trim(F.regexp_replace(F.regexp_replace(composed, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f�]", " "), r"\s+", " "))


def model_prefix(text: Column, model: str, kind: str) -> Column:
    """SCL-2: ``kind`` ("query" or "passage") before the text for models of the e5 family."""
    return F.concat(F.lit(f"{kind}: "), text) if "e5" in model.lower() else text


def embed_text(context: Column, text: Column) -> Column:
    """PRJ-9: the path context above the text, where there is one."""
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat_ws("\n", context, text)).otherwise(text)


def garbled_shares(text: Column) -> tuple[Column, Column]:
    """SCL-9: (share of control characters, share of Latin-Extended letters among the visible)."""
    length = F.length(text)
    visible = F.regexp_replace(text, r"\s", "")
    control = length - F.length(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""))
    latin = F.length(visible) - F.length(F.regexp_replace(visible, r"[Ā-ɏ]", ""))
    share = lambda n, of: F.when(of > 0, n / of).otherwise(F.lit(0.0))
    return share(control, length), share(latin, F.length(visible))


def looks_garbled(text: Column) -> Column:
    """SCL-9: blank texts aren't."""
    control, latin = garbled_shares(text)
    return F.coalesce((F.length(F.regexp_replace(text, r"\s", "")) > 0) & ((control > CONTROL_SHARE) | (latin > LATIN_EXTENDED_SHARE)), F.lit(False))


def strip_markup(markup: Column) -> Column:
    """SCL-11: text of a markup string: style and script blocks, then tags out, white space to one space."""
    bare = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\n\r\f]+", " "))


def path_part_tokens(part: Column) -> Column:
    """SCL-6: lower-case pieces of one path component."""
    pieces = F.flatten(F.transform(F.split(part, PATH_SEPARATORS), lambda x: F.split(x, PATH_BORDERS)))
    return F.filter(F.transform(pieces, lambda x: F.trim(F.lower(x))), lambda x: x != "")


def path_context(path: Column, root: Column) -> Column:
    """SCL-7: distinct tokens of the folders below ``root`` and of the file's stem; outside of it, of the last three folders."""
    bare = F.rtrim(F.coalesce(root, F.lit("")), F.lit("/"))
    inside = F.coalesce(root.isNotNull() & (root != "") & F.startswith(path, F.concat(bare, F.lit("/"))), F.lit(False))
    parts = F.filter(F.split(F.when(inside, F.substr(path, F.length(bare) + 2)).otherwise(path), "/"), lambda x: x != "")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    folders = F.when(inside, folders).otherwise(F.slice(folders, F.greatest(F.size(folders) - 2, F.lit(1)), F.lit(3)))
    stem = F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("")), r"(?<=.)\.[^.]*$", "")
    each = F.flatten(F.transform(F.concat(folders, F.array(stem)), path_part_tokens))
    return F.array_join(F.array_distinct(each), " ")


def snippet(text: Column, length: int = CITATION_CHARS) -> Column:
    """PRJ-11: the beginning, with an ellipsis if there is more."""
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length)), F.lit("..."))).otherwise(text)


def search_snippet(text: Column) -> Column:
    return F.trim(F.left(text, F.lit(SEARCH_CHARS)))


def passage(text: Column) -> Column:
    """SCL-28."""
    return F.left(text, F.lit(PASSAGE_CHARS))


def escape_regex(text: Column) -> Column:
    """SCL-10: metacharacters escaped."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}])", r"\\$1")


def any_word_in(query: Column, *columns: Column) -> Column:
    """PRJ-4: whether any word of the query is in any of the columns, whatever the case; words are literal."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: w != "")
    haystack = F.concat_ws("\n", *[F.lower(c) for c in columns])  # words hold no line feed
    return F.exists(words, lambda w: F.contains(haystack, w))


def strip_think(text: Column) -> Column:
    """SCL-18: thinking blocks out."""
    return F.regexp_replace(text, r"(?s)<think>.*?</think>", "")


def clean_variant(line: Column) -> Column:
    """SCL-17: numbering, bullets and wrapping quotes off a query variant."""
    bare = F.regexp_replace(F.trim(line), r"^[\d\-*•·]+[.)]?\s*", "")
    return F.when(bare.rlike(r"(?s)^([\"'«]).*\1$") & (F.length(bare) >= 2), F.trim(F.substring(bare, F.lit(2), F.length(bare) - 2))).otherwise(bare)


def query_variants(question: Column, lines: Column, n: int) -> Column:
    """PRJ-16: the first ``n`` usable variants: 10 to 300 characters, unlike the question and each other."""
    usable = F.filter(F.transform(lines, clean_variant), lambda v: (F.length(v) >= 10) & (F.length(v) <= 300) & (F.lower(v) != F.lower(question)))
    indexed = F.filter(usable, lambda v, i: F.array_position(F.transform(usable, F.lower), F.lower(v)) == i + 1)
    return F.slice(indexed, 1, n)


def caption(text: Column) -> Column:
    """SCL-16 and PRJ-15: a caption without markers and preamble; empty if it says nothing."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|[^|]*\|>|!{2,}[^!]*!{2,}", " ")
    bare = F.regexp_replace(bare, r"^[^\n:]{1,80}:\s*\n+", "")
    bare = F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"^[\s,.;:–—-]+", "")
    words = F.filter(F.split(bare, " "), lambda w: w != "")
    lettered = F.filter(words, lambda w: w.rlike(r"\p{L}"))
    dull = (F.size(words) >= 8) & (F.size(F.array_distinct(F.transform(words, F.lower))) <= 2)
    return F.when(bare.rlike(r"[\p{L}\p{N}]") & (F.size(lettered) >= 3) & ~dull, bare).otherwise("")


def object_id_valid(value: Column) -> Column:
    """SCL-26."""
    return F.coalesce(value.rlike("^[0-9a-fA-F]{24}$"), F.lit(False))


def model_name(value: Column) -> Column:
    """SCL-27: without the default tag."""
    return F.regexp_replace(F.trim(value), ":latest$", "")


def model_name_valid(value: Column) -> Column:
    """SCL-27."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._/:-]{0,200}$"), F.lit(False))


def cited_ids(answer: Column) -> Column:
    """JOIN-11: ids in square brackets, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[([^\[\]]+)\]"), F.lit(1)))


#: Fixed value: the URL namespace of version 5 UUIDs.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def chunk_id(file_id: Column, number: Column) -> Column:
    """PRJ-17."""
    return F.concat_ws("::", file_id, number)


def point_id(name: Column) -> Column:
    """PRJ-17: the version 5 UUID of a name in the URL namespace, by built-in functions."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    at = lambda start, length: F.substring(h, start, length)
    variant = F.translate(at(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", at(1, 8), at(9, 4), F.concat(F.lit("5"), at(14, 3)), F.concat(variant, at(18, 3)), at(21, 12))


def image_text(caption: Column, ocr: Column) -> Column:
    """SRC-23: what is kept of an image: its caption and the text in it, those that aren't blank."""
    part = lambda label, x: F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.concat(F.lit(label), F.trim(x)))
    return F.concat_ws("\n\n", part("Descripcion: ", caption), part("Texto en la imagen: ", ocr))


def transcript(segments: Column) -> Column:
    """SRC-22: the segments of a recording, without blank ones, joined by spaces; empty for none."""
    return F.array_join(F.filter(F.transform(F.coalesce(segments, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != ""), " ")


def video_text(segments: Column, captions: Column, interval: int, most: int) -> Column:
    """SRC-24: the transcript, then one line for each captioned frame (at most ``most``) with its time."""
    from .formats import frame_time

    lines = F.transform(F.slice(captions, 1, most), lambda c, i: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("["), frame_time(i, interval), F.lit("] "), c)))
    return F.concat_ws("\n\n", F.nullif(transcript(segments), F.lit("")), F.nullif(F.array_join(lines, "\n"), F.lit("")))
