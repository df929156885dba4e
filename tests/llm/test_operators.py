"""Operators against plain versions on small fixtures: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftline.llm import byte_bpe, language_model, near_dedup, quality, queries, vector_search
from driftline.llm.common import bucket_of
from driftline.llm.language_id import RankModel, identify_languages
from driftline.llm.language_model import START, LogBilinear, score_documents
from driftline.llm.line_dedup import dedup_lines
from driftline.llm.near_dedup import near_duplicates
from driftline.llm.packing import pack_documents, sum_of_squares
from driftline.llm.pii import BASE, find_pii, mask_pii
from driftline.llm.sharding import longest_first, shard_documents
from tests.llm.plain import base_spans, find_links, groups, shingles, words

SCHEMA = "doc_id long, text string, lang string, source string, n long, piece int, label string, rep long"
BPE = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def frame(spark, texts, langs=None):
    """Documents with columns whose names the operators use inside."""
    rows = [(i, t, (langs or {}).get(i), None if (i or 0) % 3 else "s", 1, 2, "x", 7) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def odd_texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 8))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [(i, text(rng.randint(1, 120))) for i in range(60)]
    base = text(100).split()
    for i in range(60, 90):  # near copies of one text, more and less changed
        own = list(base)
        for _ in range(i % 14):
            own[rng.randrange(100)] = rng.choice(vocabulary)
        texts.append((i, " ".join(own)))
    texts += [(90, None), (91, ""), (92, " \n\t"), (93, "word"), (94, "WORD\n"), (95, "é́ ÉCOLE Straße ΣΑΣ ﬁ İx 日本語 <|endoftext|> don't 12½"), (96, text(20_000)), (97, "a" * 5000)]
    texts += [(5, texts[5][1]), (None, "null id text"), (98, "a.b@c.d_e@f.gh 1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.004")]
    return texts


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, odd_texts()).repartition(5).cache()


def test_language_id(spark):
    rng = random.Random(1)
    alphabets = {"xx": "abcde", "yy": "defgh", "zz": "éèàùç"}
    texts = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(5)) for _ in range(40))) for i, k in enumerate(list(alphabets) * 20)]
    langs = {i: k for i, k in enumerate(list(alphabets) * 20)} | {100: None}
    texts += [(100, None), (101, "12 !"), (102, ""), (None, "abc abd"), (3, texts[3][1])]
    held_out = bucket_of("doc_id", 3) == 1
    got = identify_languages(frame(spark, texts, langs), ~held_out).collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["lang_pred"] == ("und" if r["doc_id"] in (100, 101, 102) else langs.get(r["doc_id"], "xx"))
    nothing = identify_languages(frame(spark, texts), ~held_out).collect()
    assert {(r["lang_pred"], r["score"]) for r in nothing} == {("und", 0.0)}


def plain_grams(text):
    """n-grams of up to three symbols, most frequent first, ties by their letters; words are parted by one space."""
    line = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    line = re.sub(" +", " ", line)
    times = Counter(line[i : i + n] for n in (1, 2, 3) for i in range(len(line) - n + 1))
    del times[" "]
    # Shorter n-grams have smaller codes; the space comes before all letters.
    return sorted(times, key=lambda g: (-times[g], len(g), g))


def test_language_id_equals_plain_distances(spark):
    rng = random.Random(8)
    alphabets = {f"l{k:02}": "".join(rng.sample("abcdefghijklmnopqrstuvwxyzéß", 12)) for k in range(25)}
    text = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(n))
    learned = [(i, text(alphabets[k], 30), k) for i, k in enumerate(list(alphabets) * 3)]
    asked = [(1000 + i, text(rng.choice(list(alphabets.values())), rng.randint(1, 40)), None) for i in range(80)]
    asked += [(2000, "ж", None), (2001, "a", None), (2002, "Same Same", None), (2003, "z" * 3000, None)]
    table = spark.createDataFrame(learned + asked, "doc_id long, text string, lang string")
    size = 40
    profiles = {k: {g: i for i, g in enumerate(plain_grams(" ".join(t for _, t, own in learned if own == k))[:size])} for k in alphabets}
    got = {r["doc_id"]: r for r in identify_languages(table, F.col("lang").isNotNull(), size=size).collect()}
    for i, t, _ in learned + asked:
        own = plain_grams(t)[:size]
        apart = {k: sum(abs(p[g] - j) if g in p else size for j, g in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(1 - apart[best] / (len(own) * size)), t


def test_language_id_of_many_languages():
    size, langs = 300, 20_000
    rng = np.random.default_rng(3)
    profiles = pd.DataFrame(
        {
            "lang": np.repeat([f"l{i:05}" for i in range(langs)], size),
            "code": (rng.integers(0, 50_000, (langs, 1)) * 400 + np.arange(size)).ravel() + (1 << 41),
            "place": np.tile(np.arange(size), langs),
        }
    )
    model = RankModel(profiles, size)
    kept = sum(a.nbytes for a in (model.codes, model.first, model.listed, model.lang, model.place))
    assert kept <= 40 * len(profiles) and model.predict("some words") == ("l00000", 0.0)


def test_line_dedup(spark):
    long_line = "x" * 39 + "É"
    texts = [(i, f"own line {i}\n \t{long_line.swapcase() if i % 2 else long_line} \nend") for i in range(7)]
    texts = [(i, t.replace("é", "É")) for i, t in texts]
    texts += [(10, long_line + "\n" + long_line), (11, "y" * 39), (12, None), (13, ""), (None, long_line), (3, texts[3][1])]
    texts += [(i, "z" * 40) for i in range(20, 24)] + [(20, "z" * 40)]  # four documents only
    got = dedup_lines(frame(spark, texts).repartition(4)).collect()
    assert len(got) == len(texts)
    for r in got:
        t = dict(texts)[r["doc_id"]] or ""
        gone = r["doc_id"] is not None and r["doc_id"] < 7
        want = [x for x in t.split("\n") if not (gone and x.strip().lower() == long_line.lower())]
        assert r["kept_text"] == "\n".join(want) and r["n_lines"] == t.count("\n") + 1 and r["n_dropped"] == gone


def test_near_dedup(docs):
    got = near_duplicates(docs, words=2, percent=80).collect()
    sets = {i: shingles(t, 2) for i, t in odd_texts() if i is not None}
    label = groups(sets, find_links(sets))
    assert len(got) == len(odd_texts())
    for r in got:
        i = r["doc_id"]
        assert r["n_shingles"] == (len(sets[i]) if i is not None else 2)
        assert r["component_id"] == label.get(i) and (i is None or r["kept"] == (label[i] == i))


@pytest.mark.parametrize("block, short", [(2000, 64), (15, 6)])
def test_near_dedup_of_large_groups_beside_others(spark, monkeypatch, block, short):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "SHORT", short)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("aeinorst") for _ in range(6)) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for i in range(150):  # one large group, members at the edge of it, and documents that share a part of it at other sizes
        own = list(base)
        for _ in range(rng.choice([0, 1, 2, 5, 9, 14, 20])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        cut = rng.choice([120, 120, 110, 100, 97, 60])
        texts.append((i, " ".join(own[:cut] + [rng.choice(vocabulary) for _ in range(rng.choice([0, 0, 20, 200]))])))
    table = spark.createDataFrame(texts, "doc_id long, text string")
    for size in (1, 2):
        got = near_duplicates(table, words=size, percent=80).collect()
        sets = {i: shingles(t, size) for i, t in texts}
        component = groups(sets, find_links(sets))
        assert {r["doc_id"]: r["component_id"] for r in got} == component and len(set(component.values())) > 5


def test_near_dedup_leaves_chance_meetings_to_the_lists(spark):
    rows = [(v, rep, 100, 10, 2) for v, rep in [(1, 1), (1, 2), (2, 1), (2, 3), (3, 3), (4, 3)]]  # 1 meets 2 and 3 once each
    rows += [(v, rep, 100, 10, 2) for v in (7, 8) for rep in (11, 12)]  # copies meet twice
    rows += [(9, rep, 100, 10, listed) for rep, listed in ((21, 1), (22, 2))]  # 21 is in no other list
    lists = spark.createDataFrame(rows, "v long, rep long, n long, common int, listed int")
    pairs = near_dedup.leader_pairs(lists, 80, 1).collect()
    assert sorted((r["a"], r["b"]) for r in pairs) == [(11, 12), (21, 22)]


def test_pii(docs, spark):
    for r in find_pii(docs).collect():
        text = dict(odd_texts())[r["doc_id"]]
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"]]
        assert [s for s in spans if s[0] in BASE] == base_spans(text)
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice(["a@b", ".c", "1.2", ".3", "+1 ", "4111 1111 1111 1111", "5-5", " ", "é", "@", "12", "(3)", "x"]) for _ in range(30))) for i in range(300)]
    texts += [(1000, "1" * 3000 + "." * 10), (1001, "a" * 200_000), (1002, "a.b" * 5000 + "@x.y"), (1003, "x@" + "a." * 20_000)]
    for r in find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        if r["doc_id"] != 1001:  # the plain pattern takes quadratic time there
            got = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in BASE]
            assert got == base_spans(dict(texts)[r["doc_id"]])
    one = spark.createDataFrame([(1, "IBAN DE89 3704 0044 0532 0130 00, ssn 123-45-6789, no 123-45-6789 mail a@b.cd")], "doc_id long, text string")
    found = {(s["kind"], s["text"]) for s in find_pii(one).first()["spans"]}
    assert found == {("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "123-45-6789"), ("email", "a@b.cd")}
    assert mask_pii(one).first()["text"] == "IBAN [IBAN], ssn [SSN], no 123-45-6789 mail [EMAIL]"


ACCOUNTS = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "NL91ABNA0417164300", "NO9386011117947", "MT84MALT011000012345MTLCAST001S"]


def test_pii_finds_accounts_before_words(spark):
    after = [" Bank", " Thanks", " BIC COBADEFFXXX", " 12345", " 2024 and more", ", then", "", " A1", "\nDE", " AT12"]
    before = ["pay ", "IBAN ", "AB12 ", "no DE12 ", "IBAN: AT12 "]
    cases = []
    for account in ACCOUNTS:
        parted = " ".join(account[i : i + 4] for i in range(0, len(account), 4))
        cases += [(b, own, a) for own in (account, parted) for b in before[:2] for a in after]
    cases += [(b, own, " Bank") for own in (ACCOUNTS[0], "DE89 3704 0044 0532 0130 00") for b in before]
    cases.append(("IBAN ", "XX40" + "1" * 14, " Bank"))  # a code without a known length
    rows = [(i, b + own + a) for i, (b, own, a) in enumerate(cases)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for r in find_pii(table).collect():
        b, own, a = cases[r["doc_id"]]
        spans = [(s["start"], s["end"], s["text"]) for s in r["spans"] if s["kind"] == "iban"]
        if own[:2] != "XX" or _mod97(own):
            assert spans == [(len(b), len(b) + len(own), own)], (b, own, a)
    none = ["DE89370400440532013001 Bank", "DE8937040044053201300 Bank", "DE893704004405320130000 x", "xDE89370400440532013000", "DE89370400440532013000Bank"]
    for r in find_pii(spark.createDataFrame(list(enumerate(none)), "doc_id long, text string")).collect():
        assert not [s for s in r["spans"] if s["kind"] == "iban"]


def _mod97(account):
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def test_pii_context_of_lists(spark):
    texts = ["SSN: 123-45-6789, 234-56-7890; 345-67-8901 and 456-78-9012\n567-89-0123", "ssn 123-45-6789, order 234-56-7890, 345-67-8901", "123-45-6789, ssn 234-56-7890"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [s["text"] for s in r["spans"] if s["kind"] == "ssn"] for r in find_pii(table).collect()}
    assert found == {0: ["123-45-6789", "234-56-7890", "345-67-8901", "456-78-9012", "567-89-0123"], 1: ["123-45-6789"], 2: ["234-56-7890"]}
    masked = {r["doc_id"]: r["text"] for r in mask_pii(table).collect()}
    assert masked == {0: "SSN: [SSN], [SSN]; [SSN] and [SSN]\n[SSN]", 1: "ssn [SSN], order 234-56-7890, 345-67-8901", 2: "123-45-6789, ssn [SSN]"}


def test_pii_in_texts_of_many_matches(spark):
    emails = ", ".join(f"user{i}@example.com" for i in range(200_000))
    numbers = "ssn " + ", ".join(f"{100 + i % 500}-45-{1000 + i % 9000}" for i in range(20_000))  # one list, announced once
    counts = [0, 1, 2, 63, 64, 65, 127, 128, 129, 300]  # around the ends of blocks
    small = [(10 + n, "".join(f"tél a{i}@b.c " for i in range(n)) + "end") for n in counts]
    table = spark.createDataFrame([(0, emails), (1, numbers), *small], "doc_id long, text string").repartition(4)
    begun = time.time()
    found = {r["doc_id"]: r["spans"] for r in find_pii(table).collect()}
    masked = {r["doc_id"]: r["text"] for r in mask_pii(table).collect()}
    assert time.time() - begun < 60
    places = lambda i: [(s["start"], s["end"]) for s in found[i]]
    assert places(0) == [m.span() for m in re.finditer("user[0-9]+@example.com", emails)]
    assert places(1) == [m.span() for m in re.finditer("[0-9]{3}-45-[0-9]{4}", numbers)]
    assert masked[0] == ", ".join(["[EMAIL]"] * 200_000) and masked[1] == "ssn " + ", ".join(["[SSN]"] * 20_000)
    for i, text in small:
        assert places(i) == [m.span() for m in re.finditer("a[0-9]+@b.c", text)] and masked[i] == re.sub("a[0-9]+@b.c", "[EMAIL]", text)


def test_quality(docs):
    got = quality.judge(docs.withColumn("source", F.lit(None).cast("string"))).collect()
    for r in got:
        text = dict(odd_texts())[r["doc_id"]] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times = Counter(runs)
        repeated = len({p for i, x in enumerate(runs) if times[x] > 1 for p in range(i, i + 5)})
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 10 or 100 * repeated > 20 * len(w)) and not (r["base_failed"] and r["kept"])
    assert len(got) == len(odd_texts())


def dirty_groups():
    """Rows of groups of which 5 to 40 % are junk, and what each row is."""
    rng = random.Random(6)
    word = lambda low, high: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(low, high)))
    clean = lambda: " ".join(word(2, 8) for _ in range(60))
    junk = {"symbols": lambda: " ".join(word(3, 5) + "#%$" for _ in range(60)), "word_length": lambda: " ".join(word(25, 35) for _ in range(60))}
    rows, dirty = [], {}
    for kind, text in junk.items():
        for percent in (5, 9, 10, 11, 15, 25, 40):
            for k in range(300):
                bad = 100 * k < percent * 300
                dirty[len(rows)] = [kind] if bad else []
                rows.append((len(rows), text() if bad else clean(), "en", f"{kind}{percent}"))
    return rows, dirty


def test_quality_fences_of_dirty_groups(spark):
    rows, dirty = dirty_groups()
    for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect():
        assert r["failed"] == dirty[r["doc_id"]] and r["kept"] == (not r["failed"]), rows[r["doc_id"]][3]


def test_quality_equals_its_sql_on_dirty_groups(spark, tmp_path):
    rows, dirty = dirty_groups()
    columns = ["doc_id", "text", "lang", "source"]
    few = [(len(rows) + i, t, None, "few") for i, t in enumerate([None, "", "a b", rows[0][1], "x " * 60])]  # a group below the least size
    pd.DataFrame(rows + few, columns=columns).to_parquet(tmp_path / "documents.parquet")
    got = queries.op6_quality_rules(spark, str(tmp_path)).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    expected = con.execute(queries.ORACLE["op6_quality_rules"]).df().sort_values("doc_id", ignore_index=True)
    for column in expected:
        assert got[column].tolist() == expected[column].tolist(), column
    assert got["kept"].tolist()[: len(rows)] == [not dirty[i] for i in range(len(rows))]


def test_packing(docs):
    tokenizer = Tokenizer.from_file(BPE)
    got = pack_documents(docs, BPE, group_rows=40).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], set()).add((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in odd_texts():
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = [ids[s : s + 2048] for s in range(0, len(ids), 2048)]
        assert by_id[i] == {(k, k * 2048, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(parts)}, i
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 2048 and sum(r["doc_id"] == 5 for r in got) == 2


def test_sum_of_squares_rule():
    rng = np.random.default_rng(0)
    sizes = rng.integers(1, 21, 300)
    bins, _ = sum_of_squares(sizes, 20)
    fill, squares = {}, lambda gaps: sum(n * n for n in Counter(g for g in gaps if g).values())
    for size, target in zip(sizes.tolist(), bins.tolist()):
        gaps = {b: 20 - f for b, f in fill.items()}
        options = [squares([*(g - size if b == c else g for b, g in gaps.items())]) for c in gaps if gaps[c] >= size]
        options.append(squares([*gaps.values(), 20 - size]))
        fill[target] = fill.get(target, 0) + size
        assert fill[target] <= 20 and squares([20 - f for f in fill.values()]) == min(options)


def test_sharding(docs, spark):
    texts = odd_texts()
    for heap_rows, bundles in ((50_000, 1024), (20, 8)):
        got = shard_documents(docs, 4, heap_rows=heap_rows, bundles=bundles).collect()
        home = {}
        slots = {}
        for r in got:
            text = dict(texts)[r["doc_id"]] or ""
            assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode())
            assert home.setdefault(text, r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
            slots.setdefault(r["shard"], []).append(r["slot"])
        assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        # No shard is above the mean by more than the largest group, which nothing could part.
        loads, whole = Counter(), Counter()
        for r in got:
            loads[r["shard"]] += r["size"]
            whole[dict(texts)[r["doc_id"]] or ""] += r["size"]
        assert max(loads.values()) <= sum(loads.values()) / 4 + max(whole.values())
    assert longest_first(np.array([5, 4, 3, 3, 3]), 2).tolist() == [0, 1, 1, 0, 1]
    assert shard_documents(docs.filter("false")).count() == 0


@pytest.mark.parametrize("heap_rows, bundles", [(50_000, 1024), (500, 64)])
def test_shards_are_near_equal(spark, heap_rows, bundles):
    rng = random.Random(4)
    texts = [(i, f"{i % 1500} " + "x" * int(1.01 ** (i % 500) * 5)) for i in range(3000)]
    rng.shuffle(texts)
    got = shard_documents(spark.createDataFrame(texts, "doc_id long, text string"), heap_rows=heap_rows, bundles=bundles).collect()
    loads = Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    mean = sum(loads.values()) / 8
    assert len(loads) == 8 and max(loads.values()) <= 1.02 * mean and min(loads.values()) >= 0.98 * mean


def test_byte_bpe(docs):
    ranks = byte_bpe.read_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN, digests=True).collect():
        text = dict(odd_texts())[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe_splits_like_the_library():
    encoder = byte_bpe.DuckEncoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab thein \n\t'1.é\x1c\xa0") for _ in range(80)) for _ in range(200)]
    texts += ["ab" * 300, "".join(rng.choice("abcdefghij") for _ in range(400)), "  x", "x  ", " \n a"]
    encoder.learn({m for t in texts for m in encoder.pattern.findall(t)})
    for t in texts:
        assert [int(i) for m in encoder.pattern.findall(t) for i in encoder.known[m][0].split()] == library.encode_ordinary(t)


def test_language_model(spark, docs):
    held_out = bucket_of("doc_id", 7) == 2
    got = score_documents(docs, ~held_out, vocabulary_size=64, width=8).collect()
    texts = odd_texts()
    train = [t for i, t in texts if zlib.crc32(str(i if i is not None else "").encode()) % 7 != 2]
    counts = Counter(w for t in train for w in [*words(t), b""])
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(texts)
    for r in got:
        w = [*words(dict(texts)[r["doc_id"]]), b""]
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["n_tokens"] == len(w) and r["train_tokens"] == n
        assert r["n_known"] == sum(x in counts for x in w) and r["score"] < 0
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    assert score_documents(docs.filter("false"), ~held_out).count() == 0
    untrained = score_documents(docs, F.lit(False), vocabulary_size=64, width=8).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)


def test_language_model_packs_tokens_and_numbers_blocks(spark):
    numbers = np.array([0, 1, 255, 256, 70_000, 2**31 - 1, 5], np.int32)
    assert language_model.unpacked(language_model.packed(numbers)).tolist() == numbers.tolist()
    assert language_model.packed(np.arange(100, dtype=np.int32)) == bytes(range(100)) + bytes(300)
    docs = spark.createDataFrame([(i, f"a b w{i}") for i in range(40)], "doc_id long, text string").repartition(4)
    rows = language_model.tokenised(docs, F.lit(True), "doc_id", "text")
    assert dict(rows.dtypes)["block"] == "bigint"
    found = rows.filter("word is not null").groupBy("block", "number").count().collect()
    assert len({r["block"] for r in found}) == 4 and {r["count"] for r in found} == {1}


def test_language_model_is_normalised():
    for size in (2, 3, 60):
        counts = np.concatenate([[0.0], [50.0], np.sort(np.random.default_rng(1).pareto(1, size - 2) + 1)[::-1]])
        model = LogBilinear(counts, 4)
        model.table[:, -1] += np.random.default_rng(2).normal(size=model.length).astype(np.float32)
        assert model.cuts[0] == 1 and model.cuts[-1] == size and (np.diff(model.cuts) > 0).all()
        assert math.isclose(model.class_noise.sum(), 1)
        target = np.arange(1, size)
        for near, far in ((START, START), (1, START), (size - 1, 1)):
            logs = model.log_probabilities(np.full(size - 1, near), np.full(size - 1, far), target)
            assert math.isclose(np.exp(logs).sum(), 1, rel_tol=1e-5)


def test_language_model_scores_are_those_of_its_parameters(spark, monkeypatch):
    """Every score again, word by word and with plain loops, from the fitted parameters; held-out texts gain over unigrams."""
    rng = random.Random(5)
    topics = [[f"{t}{i}" for i in range(30)] for t in "abc"]
    texts = []
    for i in range(900):
        own = topics[i % 3]
        texts.append((i, " ".join(own[min(int(rng.expovariate(0.15)), 29)] for _ in range(rng.randint(1, 60)))))
    texts += [(900, None), (901, ""), (902, "unseen words \x1c a1\na2"), (None, texts[0][1]), (904, "a1 " * 70_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    models = []
    fitted = language_model.fit
    monkeypatch.setattr(language_model, "fit", lambda *args, **more: models.append(fitted(*args, **more)) or models[-1])
    training = F.col("doc_id") % 4 != 1
    got = {r["doc_id"]: r for r in score_documents(docs, F.coalesce(training, F.lit(True)), vocabulary_size=60, width=8).collect()}
    (model,) = models
    assert model.size == 60 and 3 < model.classes < 30
    split = {i: [*words(t), b""] for i, t in texts}
    counts = Counter(w for i, t in split.items() if i is None or i % 4 != 1 for w in t)
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    ids = {w: k for k, w in enumerate(ranked[:58], start=2)}
    rest = {w: counts[w] for w in ranked[58:]}
    rest_total = sum(rest.values()) + len(rest) + 1
    table, size = model.table.astype(float), model.size

    def plain(tokens):
        near = far = START
        total = 0.0
        for w in tokens:
            v = ids.get(w, 1)
            h = [table[-2][i] * table[near][i] + table[-1][i] * table[far][i] for i in range(8)] + [1.0]
            score = lambda row: math.exp(sum(x * y for x, y in zip(h, table[row])))  # noqa: B023, E731
            c = next(k for k in range(model.classes) if model.cuts[k] <= v < model.cuts[k + 1])
            total += math.log10(score(2 * size + c) / sum(score(2 * size + k) for k in range(model.classes)))
            total += math.log10(score(size + v) / sum(score(size + u) for u in range(model.cuts[c], model.cuts[c + 1])))
            if v == 1:
                total += math.log10((rest.get(w, 0) + 1) / rest_total)
            near, far = v, near
        return total

    for i, t in split.items():
        if i is None or i % 9 == 0 or 900 <= i < 904:
            assert math.isclose(got[i]["score"], plain(t), rel_tol=1e-4), i
    assert got[904]["n_tokens"] == 70_001 and math.isfinite(got[904]["score"])
    held_out = [r for i, r in got.items() if i is not None and i < 900 and i % 4 == 1]
    gain = sum(r["score"] - r["base_score"] for r in held_out) / sum(r["n_tokens"] for r in held_out)
    assert gain > 0.15  # the topic of a text is worth up to log10(3)


def test_language_model_grows_with_its_tokens_and_averages_by_word(spark):
    sizes = [language_model.words_modelled(n) for n in (0, 10**6, 8 * 10**6, 10**9)]
    assert all(abs(a - b) <= 1 for a, b in zip(sizes, [2, 4802, 9602, 48002]))
    # A word that one text alone holds moves as far with many learners as with one.
    counts = np.concatenate([[0.0], [10.0], np.full(8, 500.0), [40.0]])
    common = np.random.default_rng(3).integers(2, 10, 4000).astype(np.uint16)
    rare = np.tile(np.array([2, 10], np.uint16), 20)
    rows = [(True, 4000, float(i), common.tobytes()) for i in range(12)] + [(True, 40, 0.5, rare.tobytes())]
    schema = "train boolean, n_tokens bigint, log_counts double, model binary"
    moved = []
    for parts in (1, 6):
        table = spark.createDataFrame(rows, schema).repartition(parts)
        start = LogBilinear(counts, 4)
        model = language_model.fit(table, counts * (1 if parts == 1 else 100), np.uint16, width=4, rounds=1)
        moved.append(np.abs(model.table[10, :4] - start.table[10, :4]).sum())
    assert moved[0] > 0 and 0.5 < moved[1] / moved[0] < 2


def test_vector_search(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 16)).astype(np.float32)
    vectors[200:700] = vectors[200]  # a third of all rows alike
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [1.0, None] * 8), (None, [1.0] * 16), (0, rows[0][1]), (2200, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = vector_search.search(table, F.col("id") % 50 == 0).collect()
    unit = vector_search.unit(vectors.astype(float))
    answers = {}
    for r in got:
        answers.setdefault(r["query_id"], []).append(r)
        assert math.isclose(r["score"], float(unit[r["query_id"]] @ unit[r["vec_id"]]), abs_tol=1e-9)
    assert set(answers) == set(range(0, 1500, 50))
    hits = 0
    for q, own in answers.items():
        own.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in own}
        score = np.round(unit @ unit[q], 9)
        score[q] = -2
        hits += len(set(np.lexsort((np.arange(1500), -score))[:5]) & {r["vec_id"] for r in own})
    assert hits >= 0.9 * 5 * len(answers)
    few = vector_search.search(table.filter("vec_id in (0, 1, 50)").dropDuplicates(["vec_id"]), F.col("id") % 50 == 0).collect()
    assert {(r["query_id"], r["vec_id"]) for r in few} == {(0, 1), (0, 50), (50, 0), (50, 1)}
    assert vector_search.search(table.filter("false"), F.col("id") % 50 == 0).count() == 0


def test_vector_search_finds_neighbours_of_outliers(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 16))
    vectors = np.concatenate([centres[np.arange(4000) % 20] + rng.normal(scale=0.02, size=(4000, 16)), rng.normal(size=(60, 16))])
    vectors[rng.choice(4000, 800, replace=False)] = vectors[0]  # a fifth of all rows alike
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    asked = (F.col("id") % 40 == 1) | (F.col("id") >= 4000)
    answers = {}
    for r in vector_search.search(table, asked, list_length=40).collect():
        answers.setdefault(r["query_id"], []).append(r["vec_id"])
    unit, hits = vector_search.unit(vectors), {}
    for q in [*range(1, 4000, 40), *range(4000, 4060)]:
        score = np.round(unit @ unit[q], 9)
        score[q] = -2
        hits[q] = len(set(np.lexsort((np.arange(len(unit)), -score))[:5]) & set(answers.get(q, [])))
    assert all(len(answers.get(q, [])) == 5 for q in hits)
    assert np.mean([h for q, h in hits.items() if q >= 4000]) >= 0.9 * 5
    assert np.mean([h for q, h in hits.items() if q < 4000]) >= 0.9 * 5


def test_empty_tables(docs):
    none = docs.filter("false")
    for result in (
        identify_languages(none, F.lit(True)),
        dedup_lines(none),
        near_duplicates(none),
        find_pii(none),
        quality.judge(none),
        pack_documents(none, BPE),
        byte_bpe.encode_documents(none, RANKS, public_tokenizers.PATTERN),
    ):
        assert result.count() == 0


def test_byte_bpe_on_long_matches():
    encoder = byte_bpe.DuckEncoder(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(8)
    kanji = [chr(c) for c in range(0x3041, 0x3097)] + [chr(c) for c in range(0x4E00, 0x9FA0)]
    texts = ["".join(rng.choice(kanji) for _ in range(300_000)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000))]
    texts += ["".join(rng.choice("etaoin") for _ in range(3000)), "a" * 20_000, "=-" * 5000, "\n" * 5000]
    start = time.perf_counter()
    encoder.learn({m for t in texts for m in encoder.pattern.findall(t)})
    assert time.perf_counter() - start < 60
    for t in texts:
        known = [encoder.known[m] for m in encoder.pattern.findall(t)]
        assert [int(i) for ids, _ in known for i in ids.split()] == library.encode_ordinary(t)
        assert b"".join(raw for _, raw in known) == t.encode()


def test_byte_bpe_forgets_in_two_generations(monkeypatch):
    encoder = byte_bpe.DuckEncoder(RANKS, public_tokenizers.PATTERN)
    monkeypatch.setattr(byte_bpe, "CACHED_WORDS", 50)
    for i in range(0, 400, 20):
        matches = {f" wordy{j}x" for j in range(i, i + 40)}
        encoder.learn(matches)
        assert matches <= set(encoder.known) and len(encoder.known) <= 90 and len(encoder.older) <= 90
        assert all(encoder.known[m][1] == m.encode() for m in matches)


def test_packing_parts_equal_rows_and_fills_sequences(spark):
    """Rows alike in all but their place do not fall into one group; sequences are nearly full."""
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three four five").alias("text"))
    rows = pack_documents(docs, BPE, group_rows=500).collect()
    tokens = sum(r["length"] for r in rows)
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert len(rows) == 6000 and max(used.values()) <= 2048
    assert len({s % 12 for s in used}) == 12  # all twelve groups
    assert len(used) <= -(-tokens // 2048) + 12  # one sequence a group that is not full


def test_near_dedup_pools_the_texts_of_one_id(spark):
    rng = random.Random(6)
    text = lambda: " ".join("".join(rng.choice("aeinorst") for _ in range(6)) for _ in range(200))
    a, b, c = text(), text(), text()
    near = " ".join([*a.split()[:-3], "x", "y", "z"])
    rows = [(10, a), (10, b), (3, b), (4, near), (20, c), (21, c), (30, text()), (None, a), (40, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted({(r["doc_id"] or -1, r["component_id"], r["kept"]) for r in near_duplicates(docs, words=2).collect()})
    assert [x for x in got if x[0] >= 0] == [(3, 3, True), (4, 3, False), (10, 3, False), (20, 20, True), (21, 20, False), (30, 30, True), (40, 40, True)]
    assert (-1, None, True) in got and near_duplicates(docs, words=2).count() == len(rows)


def test_vector_search_walks_few_centroids():
    rng = np.random.default_rng(5)
    centres = vector_search.unit(rng.normal(size=(40, 16)))
    centroids = vector_search.unit(np.repeat(centres, 25, axis=0) + 0.05 * rng.normal(size=(1000, 16)))
    graph = vector_search.CentroidGraph(centroids)
    queries = vector_search.unit(centres[rng.integers(0, 40, 100)] + 0.02 * rng.normal(size=(100, 16)))
    length = np.full(1000, 50)
    widths = []
    search = graph.search
    graph.search = lambda q, w: widths.extend([w] * len(q)) or search(q, w)
    near = {}
    for place, list_ in vector_search.reached_lists(graph, queries, length, 24, 1.25):
        for p, x in zip(place.tolist(), list_.tolist()):
            near.setdefault(p, set()).add(x)
    assert set(near) == set(range(100)) and sum(widths) < 0.1 * 1000 * 100
    exact = np.argmax(queries @ centroids.T, axis=1)
    assert sum(int(exact[q]) in near[q] for q in range(100)) >= 95
    wide = list(vector_search.reached_lists(graph, queries[:3], np.zeros(1000, int), 24, 1.25))  # nothing held: all lists
    assert sum(len(x) for _, x in wide) >= 3
