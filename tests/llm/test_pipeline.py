import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from lodestar.llm import secret_scan


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.lower())


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def corpus(folder, spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(260):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        if i % 6 == 5:
            text = [w.upper() + "!!" for w in text]
        labels.append((i, int(i % 6 != 5), 0))
        rows.append([i, " ".join(text), rng.choice(["en", "fr"]), f"src{i % 5}"])
    for i in range(0, 60, 7):  # exact copies, near copies and secrets among the clean
        rows.append([1000 + i, rows[i][1], "en", "src0"])
        edited = rows[i + 1][1].split(" ")
        edited[3] = "edited"
        rows.append([2000 + i, " ".join(edited), "en", "src0"])
        rows[i + 2][1] += ' token = "0123456789abcdef0123" end'
    rows += [[3000, None, "en", "src1"], [3001, "", "en", "src1"]]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([x for x in labels if x[0] < 200], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, results = docs.columns, []
    for name, function in corpus_pipeline.STAGES:
        out = function(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        results.append({r.doc_id: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect())
        if name != "best_fit_packing":
            assert docs.columns == columns
    good, distinct, apart, clean, packed = results
    assert good.keys() == {r[0] for r in rows if "!!" not in (r[1] or "")}
    last = {}
    for d, r in good.items():
        last[r.text or ""] = max(d, last.get(r.text or "", -1))
    assert distinct.keys() == set(last.values())
    ids, root = sorted(distinct), {d: d for d in distinct}
    find = lambda x: x if root[x] == x else find(root[x])
    sets = {d: shingles(distinct[d].text or "") for d in ids}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and sets[a]:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert apart.keys() == {d for d in ids if find(d) == d}
    assert clean.keys() == apart.keys()
    for d, r in clean.items():
        assert (r.text == apart[d].text) == ("token = " not in (apart[d].text or ""))
        assert "0123456789abcdef" not in (r.text or "") and r.n_chars == len(r.text or "")
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {}
    for r in packed:
        size[r.doc_id] = size.get(r.doc_id, 0) + r.length
    assert size == {d: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in clean.items()}


def test_run_ends_with_the_last_stage(spark, tmp_path):
    corpus(tmp_path, spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
    assert len(corpus_pipeline.STAGES) == 5 and secret_scan.BASE_KINDS[0] == "assign"


CLASHES = ["_sha", "_dedup", "_kept", "_key", "_gone", "_id", "_edges", "row", "hot", "key", "keep_id", "class_id", "node", "spans", "host", "path"]


def test_stages_keep_null_ids_repeated_rows_and_columns_named_like_helpers(spark, tmp_path):
    text = lambda i: " ".join(f"w{(i * 37 + j * j) % 500}" for j in range(60))
    rows = [(i, text(i)) for i in range(40)] + [(None, text(3)), (None, text(90)), (7, text(7)), (50, text(5)), (51, None), (52, ""), (53, "long " * 40_000)]
    docs = spark.createDataFrame([(d, t, "en", "a", len(t or ""), *CLASHES) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, str(tmp_path)), name)
        assert docs.columns[5:] == CLASHES and all(tuple(r)[5:] == tuple(CLASHES) for r in docs.collect())
    left = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    want = [(i, t) for i, t in rows[:40] if i != 5] + [(None, text(90)), (50, text(5)), (52, ""), (53, "long " * 40_000)]
    assert left == sorted((str(d), t) for d, t in want)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(want)


def test_every_stage_takes_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, str(tmp_path)).count() == 0
