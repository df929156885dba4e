"""Vector codes, hard negatives and secrets against plain versions: nulls, ties, repeated rows, long texts, empty tables, clashing names."""

import math
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftline.llm import hard_negatives as hn
from driftline.llm import queries, secrets
from driftline.llm import vector_codes as vc
from driftline.llm.hard_negatives import Tree, best_first, hard_negatives, tile_order
from driftline.llm.oracle import ORACLE
from driftline.llm.secrets import entropy_spans, find_secrets, mask_secrets, secret_spans
from driftline.llm.vector_codes import compress, decode, distinct_parts, nearest_entries, with_label_error

SCHEMA = "vec_id long, embedding array<float>, label int, id long, v int, tile int, error long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], label, 1, 2, 3, 4) for i, x, label in rows], SCHEMA)


def odd_vectors(n=400, size=8, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=size).round(2), int(rng.integers(4))) for i in range(n)]
    rows += [(n + i, rows[7][1], rows[7][2] if i % 2 else 3) for i in range(150)]  # copies, in two labels
    rows += [(900, None, 1), (901, [None] * size, 1), (902, [math.nan] * size, 1), (903, [math.inf] * size, 2), (904, [0.0] * size, 2)]
    rows += [(905, [1.0] * 5, 1), (906, [], 1), (907, rng.normal(size=size), None), (1000, [1e30] * size, 0), (1100, [-1e30] + [0.5] * (size - 1), 1)]
    return rows + [rows[3], rows[200], rows[200]]  # repeated rows


# --- vector codes ---


def plain_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, x, label) for i, x, label in rows if x is not None and len(x) == 8 and all(c is not None and math.isfinite(c) for c in x)]
    quantised = [[max(-vc.BOUND, min(vc.BOUND, math.floor(float(np.float32(c)) * scale))) for c in x] for _, x, _ in kept]
    split = [[tuple(q[p * 2 : p * 2 + 2]) for q in quantised] for p in range(parts)]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0], quantised[k]))[:entries]
    books = [[split[p][k] for k in first] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda part, book: min(range(len(book)), key=lambda e: (distance(part, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for part in split[p]:
                members.setdefault(nearest(part, books[p]), []).append(part)
            for e, mine in members.items():
                books[p][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    out = []
    for k, (i, _, label) in enumerate(kept):
        code = [nearest(split[p][k], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{c:02x}" for c in code), sum(distance(split[p][k], books[p][c]) for p, c in enumerate(code))))
    return out, books


@pytest.mark.parametrize("entries,tasks", [(16, 1), (16, 5), (256, 3)])
def test_codes(spark, entries, tasks):
    rows = odd_vectors()
    coded, books = compress(vectors(spark, rows).repartition(tasks), entries=entries)
    got = [(r["id"], r["label"], bytes(r["codes"]).hex(), r["error"]) for r in coded.collect()]
    expected, plain = plain_codes(rows, entries=entries)
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert [[tuple(int(c) for c in e) for e in b] for b in books] == plain
    sums = {}
    for _, label, _, error in expected:
        sums[label] = sums.get(label, 0) + error
    told = with_label_error(coded).collect()
    assert len(told) == len(expected) and all(r["label_error"] == sums[r["label"]] for r in told)


def test_codes_on_empty_and_small_tables(spark):
    coded, books = compress(vectors(spark, []))
    assert coded.count() == 0 and books == [] and with_label_error(coded).count() == 0
    coded, books = compress(vectors(spark, [(5, [1.0] * 8, None), (None, [2.0] * 8, None)]))
    told = with_label_error(coded).collect()
    assert sorted(bytes(r["codes"]).hex() for r in told) == ["00000000", "01010101"] and [len(b) for b in books] == [2] * 4
    assert {r["label_error"] for r in told} == {0}


def test_walk_shares_prefixes_and_equals_all_distances():
    rng = np.random.default_rng(0)
    parts = rng.integers(-3, 3, size=(3000, 5)).astype(np.int32)
    leaves, weight, leaf = distinct_parts(parts)
    assert (leaves[leaf] == parts).all() and weight.sum() == len(parts) and len({tuple(x) for x in parts.tolist()}) == len(leaves)
    for top in (1, 1 << 26):
        book = parts[:40].astype(np.int64) * top
        distance = ((leaves[:, None].astype(np.int64) * top - book[None]) ** 2).sum(axis=2)
        for block in (1, 7, 512, 10_000):
            for order in (slice(None), rng.permutation(len(leaves))):
                entry, error = nearest_entries(leaves[order].astype(np.int64) * top, book, block)
                assert (entry == distance[order].argmin(axis=1)).all() and (error == distance[order].min(axis=1)).all()


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8) * 0.1 + (i % 5), 0) for i in range(300)]
    coded, books = compress(vectors(spark, rows), entries=32)
    by_id = {i: np.float32(x) for i, x, _ in rows}
    worst = max(np.abs(decode(bytes(r["codes"]), books) - by_id[r["id"]]).max() for r in coded.collect())
    assert worst < 0.35


# --- hard negatives ---


def plain_negatives(rows, anchors, positives=5, negatives=10, low=30, high=90, scale=256, size=8):
    seen = {}
    for i, x, label in rows:
        if i is None or label is None or x is None or len(x) != size or not all(c is not None and math.isfinite(c) for c in x):
            continue
        v = [max(-vc.BOUND, min(vc.BOUND, math.floor(float(np.float32(c)) * scale))) for c in x]
        seen[i] = min(seen.get(i, (label, v)), (label, v))
    score = lambda a, b: sum(x * y for x, y in zip(seen[a][1], seen[b][1]))
    out = []
    for a in filter(anchors, seen):
        ranked = sorted((-score(a, b), b) for b in seen if b != a)
        for s, p in [x for x in ranked if seen[x[1]][0] == seen[a][0]][:positives]:
            near = [(t, b) for t, b in ranked if seen[b][0] != seen[a][0] and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, p, rank, b, -s, -t) for rank, (t, b) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("tile,block,leaf", [(10_000, 10_000, 64), (60, 5, 4), (25, 3, 1)])
def test_negatives(spark, tile, block, leaf):
    rows = odd_vectors()
    rows += [(100, rows[50][1], 2), (None, rows[1][1], 2)]  # an id twice
    found = hard_negatives(vectors(spark, rows).repartition(3), F.col("id") % 20 == 0, tile=tile, block=block, leaf=leaf)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, lambda i: i % 20 == 0)


def test_negatives_on_few_rows(spark):
    assert hard_negatives(vectors(spark, []), F.col("id") % 2 == 0).count() == 0
    rows = [(0, [1.0] * 8, 1), (1, [1.0] * 8, 1), (2, [0.5] * 8, 2), (3, [-1.0] * 8, 2), (4, [1.0] * 8, 3)]
    found = hard_negatives(vectors(spark, rows), F.col("id") % 2 == 0)
    assert sorted(map(tuple, found.collect())) == plain_negatives(rows, lambda i: i % 2 == 0) == [(0, 1, 1, 2, 524288, 262144)]


def test_queue_leaves_out_boxes():
    """On clustered rows few leaves are opened, and the answers are those of all products."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16)) * 400
    rows = np.floor(centres[np.arange(6000) % 60] + rng.normal(size=(6000, 16)) * 10)
    pages = tile_order(rows, 32)
    assert sorted(np.concatenate(pages)) == list(range(6000)) and max(map(len, pages)) <= 32 and len(pages) < 300
    order = np.concatenate(pages)
    starts = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    low, high = (np.array([f(rows[p], axis=0) for p in pages]) for f in (np.min, np.max))
    zero = np.zeros(len(pages), np.int64)
    tree = Tree(low, high, zero, zero)
    anchors, opened = rows[:40], []
    args = (starts, order, np.zeros(6000, np.int64), rows[order], anchors, np.arange(40), np.ones(40, np.int64))
    who, _, near, score = best_first(tree, *args, np.full((40, 1), hn.NONE), np.full((40, 1), -hn.NONE), False, 10, opened)
    for a in range(40):
        exact = sorted((-int(rows[a] @ rows[b]), b) for b in range(6000))[:10]
        assert [(-s, n) for s, n in zip(score[who == a], near[who == a])] == exact
    assert sum(opened) < 0.25 * 40 * len(pages)
    # A window nobody can reach opens nothing.
    opened.clear()
    top = int((np.abs(anchors) @ np.maximum(np.abs(low), np.abs(high)).T).max()) + 1
    best_first(tree, *args, np.full((40, 1), top), np.full((40, 1), 2 * top), False, 10, opened)
    assert not opened


# --- secrets ---

PLAIN = {
    "assign": (re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[1]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def plain_entropy(run):
    """Stretches of windows, every window counted from scratch."""
    out = []
    for i in range(len(run) - 19):
        w = run[i : i + 20]
        counts = [w.count(c) for c in set(w)]
        weight = sum(secrets.WEIGHT[c] for c in counts)
        tally = [0] * 6
        for c in w:
            tally[secrets._class_of(ord(c))] += 1
        steps = sum(abs(ord(a) - ord(b)) <= 1 for a, b in zip(w, w[1:]))
        if weight <= secrets.class_limit(tally) and 2 * steps < 20:
            if out and i <= out[-1][1]:
                out[-1][1] = i + 20
            else:
                out.append([i, i + 20])
    return [tuple(x) for x in out]


def odd_secrets():
    rng = random.Random(4)
    key = lambda n, alphabet="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(alphabet) for _ in range(n))
    texts = [None, "", "no secrets", f"é́日 key {key(40)} end", f"a {key(32, '0123456789ABCDEF')}", f"sha256: {key(64, '0123456789ABCDEF')}"]
    texts += [f"EXAMPLE{key(30)}", "550E8400-E29B-41D4-A716-446655440000", f"x={key(24)}/{key(24)}", f"img;base64,{key(60)}"]
    texts += ["ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijk", "internationalization2024", "thisIsALongCamelCaseName2", "_".join("abc" for _ in range(30)) + "1"]
    texts += ["token=password:abcdefghijklmnop", "Token : 'abc.def.ghi.jkl'", "API_KEY=short", "token=" + "=" * 30, "apikey = \"" + key(30) + "\"", "secret" * 9 + ":" + "s" * 12]
    texts += ["AKIA" + key(16, "ABCDEFGHIJ0123456789"), "AKIAAKIA12", "AKIAshort", "0123456789abcdef0", "0123456789abcde", "passwd:\n" + "a" * 20, "ſecret=abcdefghijklmnop"]
    texts += [" ".join(key(rng.randint(10, 60), rng.choice(["0123456789abcdef", "abcdefghij0123456789", "ABCDEFab01+/=_-xyzXYZ789"])) for _ in range(6)) for _ in range(40)]
    return [*texts, "x " * 200_000 + key(24), key(20_000), texts[3]]


def secret_frame(spark, texts):
    rows = [(None if i == 4 else i % 60, t, "kind", 3, "spans") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, start int, spans string")


def test_secrets(spark):
    texts = odd_secrets()
    docs = secret_frame(spark, texts).repartition(4)
    got = sorted((str(r["doc_id"]), tuple((s["kind"], s["start"], s["end"]) for s in r["spans"])) for r in find_secrets(docs).collect())
    allow, before = [re.compile(p) for p in secrets.ALLOW], [re.compile(p) for p in secrets.ALLOW_BEFORE]
    expected = []
    for i, text in enumerate(texts):
        text = text or ""
        base = [(k, m.start(), m.end()) for k, (p, ok) in PLAIN.items() for m in p.finditer(text) if ok(m)]
        found = []
        for m in re.finditer("[A-Za-z0-9+/_=-]+", text):
            if any(p.search(m[0]) for p in allow) or any(p.search(text[max(0, m.start() - 24) : m.start()]) for p in before):
                continue
            spans = [(m.start() + a, m.start() + b) for a, b in plain_entropy(m[0])]
            found += [("entropy", a, b) for a, b in spans if not any(x <= a and b <= y for _, x, y in base)]
        spans = sorted(base + found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        expected.append((str(None if i == 4 else i % 60), tuple(spans)))
    assert got == sorted(expected)
    assert find_secrets(docs.limit(0)).count() == 0


def test_secrets_query_equals_its_sql_on_planted_rows(spark, tmp_path):
    texts = [t for t in odd_secrets() if t is None or (len(t) < 5000 and "ſ" not in t)]
    pd.DataFrame({"doc_id": range(len(texts)), "text": texts}).to_parquet(tmp_path / "documents.parquet")
    got = queries.op13_secrets(spark, str(tmp_path)).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    expected = con.execute(ORACLE["op13_secrets"]).df().sort_values("doc_id", ignore_index=True)
    for column in expected:
        assert got[column].tolist() == expected[column].tolist(), column
    assert "entropy" in " ".join(got["spans"])


def test_entropy_of_windows():
    rng = random.Random(9)
    for alphabet, least in (("0123456789abcdef", 0.97), ("abcdefghijklmnopqrstuvwxyz0123456789", 0.95), ("ABCDEFGHabcdefghijklmnopqrst0123456789+/", 0.95)):
        keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]
        assert sum(bool(entropy_spans(k)) for k in keys) >= least * 300
        assert [s[:2] for k in keys[:50] for s in entropy_spans(k)] == [s for k in keys[:50] for s in plain_entropy(k)]
    words = ["internationalisierung", "aaaaaaaaaaaaaaaaaaaaaaaa1", "12345678901234567890123", "getElementByIdFromDocument2", "usr/lib/python3/dist-packages/a", "abcdefghijklmnopqrstuvwxyz0123456789"]
    assert not any(entropy_spans(w) for w in words)
    assert all(0 <= bits <= math.log2(20) for _, _, bits in entropy_spans("".join(rng.choice("abcdef0123456789xyzXYZ") for _ in range(5000))))


def test_masked_secrets(spark):
    docs = secret_frame(spark, odd_secrets())
    masked = mask_secrets(docs)
    assert masked.columns == docs.columns
    texts = [r["text"] for r in masked.collect()]
    assert texts[0] is None and texts[2] == "no secrets" and texts[18] == "[SECRET]\""
    assert not any(secret_spans(t, [re.compile("SECRET")], []) and re.search("[0-9a-f]{16}", t) for t in texts if t)
