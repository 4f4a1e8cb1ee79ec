import pytest
from pyspark.sql import functions as F

from lodestar.functions import formats as fm
from lodestar.functions import routing
from lodestar.functions import text as tx


def one(spark, column, **values):
    types = {str: "string", int: "long", float: "double", list: "array<string>", bool: "boolean"}
    schema = ", ".join(f"{k} {types.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("path", "root", "want"),
    [
        ("/src/games/levelMap.png", "/src", "games level map"), ("/photos/2023/IMG_8472.jpg", "/", "photos 2023 img 8472"), ("/a/b/group_7-8.docx", "/a", "b group 7 8"),
        ("/x/HTMLFile.txt", "/x", "html file"), ("/one/two/three/four/five.md", None, "two three four five"), ("/one/two.md", "/other", "one two"), ("/a/same/same.txt", "/a", "same"),
    ],
)
def test_path_context(spark, path, root, want):
    rows = spark.createDataFrame([(path, root)], "p string, r string")
    assert rows.select(tx.path_context(F.col("p"), F.col("r"))).first()[0] == want


def test_counts_and_sanitise(spark):
    assert one(spark, tx.word_count(F.col("t")), t="  a b\tc\n ") == 3
    assert one(spark, tx.word_count(F.col("t")), t="   ") == 0
    assert one(spark, tx.char_count(F.col("t")), t="a😀b") == 3
    assert one(spark, tx.sanitise(F.col("t")), t="é\x07  b�c") == "é b c"


def test_garbled(spark):
    check = lambda t: one(spark, tx.looks_garbled(F.col("t")), t=t)
    assert not check("A healthy line of text, é ñ ü.")
    assert check("bad\x01\x02\x03text") and check("Ăăą Ćć word Đđ")
    assert not check("  \n ") and not check("")


def test_variants_and_captions(spark):
    lines = F.array(*map(F.lit, ["1. How large is the moon?", "- \"what size is the moon\"", "short", "HOW LARGE IS THE MOON?", "The Question Itself Here", "* another variant of it"]))
    assert one(spark, tx.query_variants(F.lit("the question itself here"), lines, 3)) == ["How large is the moon?", "what size is the moon", "another variant of it"]
    caption = lambda t: one(spark, tx.caption(F.col("t")), t=t)
    assert caption("<|im_start|> Here it is:\n\n, a man on a bench") == "a man on a bench"
    assert caption("!!!IMAGE!!!") == "" and caption("two words") == "" and caption("go go go go go go go go go") == ""


def test_search_helpers(spark):
    assert one(spark, tx.any_word_in(F.lit("a.b zz"), F.col("n")), n="xA.By") is True
    assert one(spark, tx.any_word_in(F.lit("a.b"), F.col("n")), n="aXb") is False
    assert one(spark, tx.escape_regex(F.col("t")), t="a.b*(c)") == r"a\.b\*\(c\)"
    assert one(spark, tx.snippet(F.col("t")), t="x" * 201) == "x" * 200 + "..."
    assert one(spark, tx.cited_ids(F.col("t")), t="so [f::1] and [g::2], [f::1]") == ["f::1", "g::2"]
    assert one(spark, tx.strip_think(F.col("t")), t="a<think>b\nc</think>d<think>e</think>") == "ad"
    assert one(spark, tx.object_id_valid(F.col("t")), t="5f" * 12) is True


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("", "search"), ("report.pdf", "search"), ("por qué", "search"), ("what is rust", "ask"), ("budget 2024", "search"), ("REF-0042 contract signed copy", "search"), ("explica el contrato", "ask"),
        ("is it late?", "ask"), ("three plain words", "ask"), ("invoice", "search"), ("Q3 2024 results", "search"), ("resume este documento", "ask"), ("datos sobre ventas", "ask"),
    ],
)
def test_router(spark, query, want):
    assert one(spark, routing.route(F.col("q")), q=query) == want


def test_formats(spark):
    size = lambda n: one(spark, fm.human_size(F.col("n")), n=n)
    assert [size(n) for n in (0, 512, 1536, 5 * 2**20, 3 * 2**30)] == ["0 B", "0.5 KB", "1.5 KB", "5.0 MB", "3.00 GB"]
    assert [one(spark, fm.duration(F.col("n")), n=n) for n in (59, 60, 61)] == ["59s", "1m", "1m 1s"]
    assert [one(spark, fm.relevance_percent(F.col("s")), s=s) for s in (0.0, 2.0, float("nan"))] == [50, 88, None]
    assert one(spark, fm.frame_time(F.col("i"), 30), i=5) == "02:30"
    assert one(spark, fm.frame_rate(F.col("r")), r="30000/1001") == 30.0
    assert one(spark, fm.frame_rate(F.col("r")), r="1/0") is None
    assert one(spark, fm.visible_pages(F.col("p"), F.lit(9)), p=1) == [1, 2, 3, 9]
    assert one(spark, fm.percent(F.col("a"), F.col("b")), a=1, b=0) == 0
    assert one(spark, fm.index_status(F.col("e"), F.lit(0)), e="empty text") == "skipped"


def test_change_test_is_strict_at_two_seconds(spark):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:02' b, timestamp'2024-01-01 00:00:02.000001' c")
    same, other = rows.select(fm.changed(F.col("a"), F.col("b"), F.lit(1), F.lit(1)), fm.changed(F.col("a"), F.col("c"), F.lit(1), F.lit(1))).first()
    assert (same, other) == (False, True)


def test_relative_time(spark):
    row = spark.sql("select timestamp'2024-01-01 00:00:00' a, timestamp'2024-03-05 00:00:00' b").select(fm.relative_time(F.col("a"), F.col("b")).alias("r")).first().r
    assert (row.amount, row.unit) == (-2, "month")
