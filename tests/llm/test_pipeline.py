"""The pipeline against a plain version of each stage, and its stages on odd input."""

import random
import re

import corpus_pipeline
from tests.conftest import SF01
from tests.llm.plain import find_links, groups, luhn, shingles

LINE = "A passage of this length stands in very many of the documents."


def corpus(spark):
    words = "the river runs down to the old mill and turns its wheel all day while children play near by".split()
    texts = {}
    for i in range(30):
        own = [words[(i * 7 + j * (i % 5 + 1)) % len(words)] + ("" if j % 3 else str(i * j)) for j in range(60)]
        texts[i] = " ".join(own)
    for i in range(6):
        texts[i] += "\n" + LINE
    texts[30], texts[31] = texts[10], texts[11] + " end"  # copies
    texts[32] = texts[12] + "\nmail me at some.one@host.example.org or call +1 (202) 555-0143"
    texts[33], texts[34], texts[35] = None, "", "12 34 !!"
    rows = [(i, t, "en", "s", 0, "x") for i, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, doc string")


def test_stages(spark):
    docs = corpus(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["language_id"](spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    docs = spark.createDataFrame(kept, docs.schema)

    lines = stage["line_dedup"](spark, docs, "").collect()
    want = {r["doc_id"]: r["text"] if r["doc_id"] == 5 else r["text"].replace("\n" + LINE, "") for r in kept}
    assert {r["doc_id"]: r["text"] for r in lines} == want
    assert all(r["n_chars"] == len(r["text"]) and r["doc"] == "x" for r in lines)
    docs = spark.createDataFrame(lines, docs.schema)

    near = stage["near_dedup"](spark, docs, "").collect()
    sets = {r["doc_id"]: shingles(r["text"], 5) for r in lines}
    label = groups(sets, find_links(sets))
    assert {r["doc_id"] for r in near} == {i for i in sets if label[i] == i}
    docs = spark.createDataFrame(near, docs.schema)

    masked = {r["doc_id"]: r["text"] for r in stage["pii"](spark, docs, "").collect()}
    assert set(masked) == {r["doc_id"] for r in near}
    assert not any("@" in t or "555-0143" in t for t in masked.values())
    assert luhn("4111111111111111")


def test_run_keeps_every_token(spark, tmp_path):
    corpus(spark).write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and 33 not in {r["doc_id"] for r in rows}


def test_empty_input(spark):
    docs = corpus(spark).filter("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        assert out.count() == 0
        if name != "packing":
            assert out.columns == docs.columns


def test_language_id_rejects_what_was_not_learned(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rng = random.Random(3)
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    words = [(i, " ".join(letters(rng.randint(3, 9)) for _ in range(60))) for i in range(-20, 0)]
    known = [r["text"].split() for r in docs.filter("lang = 'en' and length(text) > 2000").orderBy("doc_id").limit(30).collect()]
    short = [(i, " ".join(w[50:58])) for i, w in enumerate(known, -60)]
    added = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in words + short], docs.schema)
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    for left_out in ("de", "en"):
        given = docs.selectExpr("doc_id", "text", f"nullif(lang, '{left_out}') as lang", "source", "n_chars").unionByName(added)
        kept = {r["doc_id"] for r in stage(spark, given, "").select("doc_id").collect()}
        foreign = {r["doc_id"] for r in docs.filter(f"lang = '{left_out}'").select("doc_id").collect()}
        learned = {r["doc_id"] for r in docs.filter(f"lang <> '{left_out}'").select("doc_id").collect()}
        assert len(kept & foreign) <= 0.1 * len(foreign)
        assert len(kept & learned) >= 0.99 * len(learned)
        assert not kept & {i for i, _ in words}
        if left_out != "en":
            assert kept >= {i for i, _ in short}


def test_near_dedup_loses_no_text_of_a_repeated_id(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("aeinorst") for _ in range(6)) for _ in range(200))
    a, b = text(), text()
    near = " ".join([*a.split()[:-3], "x", "y", "z"])
    rows = [(3, b, 1), (10, a, 2), (10, b, 3), (20, near, 4), (None, text(), 5), (30, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long")
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    kept = {r["row"] for r in out.collect()}
    assert len(kept & {1, 3}) == len(kept & {2, 4}) == 1 and {5, 6} <= kept
