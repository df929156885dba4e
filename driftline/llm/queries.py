"""The numbered queries over whole tables, and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.llm import secrets
from driftline.llm.byte_bpe import encode_documents
from driftline.llm.common import bucket_of, table
from driftline.llm.hard_negatives import hard_negatives
from driftline.llm.language_id import identify_languages
from driftline.llm.language_model import score_documents
from driftline.llm.line_dedup import dedup_lines
from driftline.llm.near_dedup import near_duplicates
from driftline.llm.oracle import ORACLE as MORE
from driftline.llm.packing import pack_documents
from driftline.llm.pii import BASE, find_pii, span_digest
from driftline.llm.quality import judge
from driftline.llm.sharding import shard_documents
from driftline.llm.vector_codes import books_digest, compress, with_label_error
from driftline.llm.vector_search import search


def op1_language_id(spark, sf_dir):
    held_out = bucket_of("doc_id", 3) == 1
    rows = identify_languages(table(spark, sf_dir, "documents"), ~held_out)
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_vector_search(spark, sf_dir):
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op3_lm_scoring(spark, sf_dir):
    held_out = bucket_of("doc_id", 7) == 2
    rows = score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return rows.withColumn("train", ~F.col("train")).withColumnRenamed("train", "held_out")


def op4_pii(spark, sf_dir):
    rows = find_pii(table(spark, sf_dir, "documents"))
    count = lambda kind: F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}")
    return rows.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(span_digest("spans", BASE).cast("binary"), 256).alias("base_sha256"),
        span_digest("spans").alias("spans"),
    )


def op5_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents")).drop("failed")


def op7_line_dedup(spark, sf_dir):
    rows = dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op8_sharding(spark, sf_dir):
    return shard_documents(table(spark, sf_dir, "documents"))


def op9_byte_bpe(spark, sf_dir):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return encode_documents(table(spark, sf_dir, "documents"), path, pattern, digests=True)


def op10_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op11_vector_codes(spark, sf_dir):
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("codes")).alias("code")
    return with_label_error(coded).select(
        F.col("id").alias("vec_id"), code, "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("id") % 100 == 0)


def op13_secrets(spark, sf_dir):
    rows = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        *[secrets.count_of("spans", k).alias(f"n_{k}") for k in secrets.BASE],
        F.sha2(span_digest("spans", secrets.BASE).cast("binary"), 256).alias("base_sha256"),
        span_digest("spans", secrets.KINDS).alias("spans"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_vector_search,
        op3_lm_scoring,
        op4_pii,
        op5_best_fit_packing,
        op6_quality_rules,
        op7_line_dedup,
        op8_sharding,
        op9_byte_bpe,
        op10_minhash_near_dedup,
        op11_vector_codes,
        op12_hard_negatives,
        op13_secrets,
    )
}

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}
_PIECES = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS o, '{kind}' AS kind, string_split_regex(t, '{p}') AS gs, regexp_extract_all(t, '{p}') AS ms FROM docs"
    for i, (kind, p) in enumerate(_PII.items(), 1)
)

ORACLE: dict[str, str] = {
    "op4_pii": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        pieces AS ({_PIECES}),
        flat AS (
            SELECT doc_id, o, kind, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g
            FROM pieces WHERE len(ms) > 0
        ),
        placed AS (
            SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS a,
                   CAST(sum(length(g) + length(m)) OVER (PARTITION BY doc_id, o ORDER BY i) AS BIGINT) AS e
            FROM flat
        ),
        spans AS (
            SELECT doc_id, o, kind, e - length(m) AS s, e FROM placed WHERE CASE kind
                WHEN 'email' THEN true
                WHEN 'ip' THEN list_max(list_transform(string_split(m, '.'), lambda x: CAST(x AS HUGEINT))) <= 255
                WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(d)), lambda k:
                    CASE WHEN k % 2 = 0 THEN CAST(d[length(d) - k] AS INT)
                         ELSE (2 * CAST(d[length(d) - k] AS INT)) // 10 + (2 * CAST(d[length(d) - k] AS INT)) % 10 END)) % 10 = 0
                WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
                WHEN 'iban' THEN list_reduce(list_prepend(0, list_transform(string_split(a[5:] || a[1:4], ''),
                    lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)),
                    lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1
                ELSE NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')
                     AND regexp_matches(lower(right(g, 40)), 'ssn|social security|tax id') END
        ),
        told AS (
            SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
                   count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o <= 4) AS base,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans
            FROM spans GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
               coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
        FROM docs LEFT JOIN told USING (doc_id)
    """,
    "op10_minhash_near_dedup": f"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ),
        shingles AS (
            SELECT DISTINCT doc_id, unnest(
                CASE WHEN len(w) = 1 THEN [w[1]]
                     ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
            FROM words WHERE len(w) > 0
        ),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        ids AS (SELECT s, row_number() OVER () AS k FROM shingles GROUP BY s HAVING count(*) > 1),
        shared AS (SELECT doc_id, k FROM shingles JOIN ids USING (s)),
        pairs AS (
            SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
            FROM shared x JOIN shared y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
            WHERE 100 * common >= 80 * (p.n + q.n - common)
        ),
        edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, r) AS (
            SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = r
        ),
        lowest AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM lowest LEFT JOIN sizes USING (doc_id)
    """,
    "op6_quality_rules": """
        WITH words AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS t,
                   regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                   list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls
            FROM documents
        ),
        windows AS (
            SELECT doc_id, unnest(range(1, len(w) - 3)) AS p,
                   unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS x
            FROM words WHERE len(w) >= 5
        ),
        repeated AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1),
        covered AS (
            SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 5)) AS q FROM repeated) GROUP BY doc_id
        ),
        m AS (
            SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
                   CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
                   CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
            FROM words LEFT JOIN covered USING (doc_id)
        ),
        v AS (
            SELECT *, least(1000, 1000 * n_symbols // greatest(word_chars, 1)) AS v1,
                   least(1000, 1000 * n_dup_lines // greatest(n_lines, 1)) AS v2,
                   least(1000, 1000 * n_repeat_words // greatest(n_words, 1)) AS v3,
                   least(1000, 10 * word_chars // greatest(n_words, 1)) AS v4
            FROM m
        ),
        own AS (
            SELECT lang, source, count(*) AS docs,
                   quantile_disc(v1, [0.5, 0.55, 0.75, 0.9]) AS a, quantile_disc(v2, [0.5, 0.55, 0.75, 0.9]) AS b,
                   quantile_disc(v3, [0.5, 0.55, 0.75, 0.9]) AS c, quantile_disc(v4, [0.5, 0.55, 0.75, 0.9]) AS d FROM v GROUP BY ALL
        ),
        by_lang AS (
            SELECT lang, count(*) AS docs,
                   quantile_disc(v1, [0.5, 0.55, 0.75, 0.9]) AS a, quantile_disc(v2, [0.5, 0.55, 0.75, 0.9]) AS b,
                   quantile_disc(v3, [0.5, 0.55, 0.75, 0.9]) AS c, quantile_disc(v4, [0.5, 0.55, 0.75, 0.9]) AS d FROM v GROUP BY ALL
        ),
        overall AS (
            SELECT quantile_disc(v1, [0.5, 0.55, 0.75, 0.9]) AS a, quantile_disc(v2, [0.5, 0.55, 0.75, 0.9]) AS b,
                   quantile_disc(v3, [0.5, 0.55, 0.75, 0.9]) AS c, quantile_disc(v4, [0.5, 0.55, 0.75, 0.9]) AS d FROM v
        ),
        picked AS (
            SELECT own.lang, own.source, CASE WHEN own.docs >= 200 THEN [own.a, own.b, own.c, own.d]
                WHEN by_lang.docs >= 200 THEN [by_lang.a, by_lang.b, by_lang.c, by_lang.d]
                ELSE [overall.a, overall.b, overall.c, overall.d] END AS q
            FROM own JOIN by_lang ON own.lang IS NOT DISTINCT FROM by_lang.lang, overall
        ),
        fenced AS (
            SELECT lang, source, list_transform([1, 2, 3, 4], lambda i: [
                q[i][2] + 3 * (q[i][2] - q[i][1]) + margins[i], q[i][3] + 3 * (q[i][3] - q[i][1]) + margins[i],
                q[i][4] + 3 * (q[i][4] - q[i][1]) + margins[i], q[i][3], q[i][4]]) AS f
            FROM picked, (SELECT [50, 100, 100, 50] AS margins)
        ),
        limits AS (
            SELECT lang, source, list_transform(f, lambda x:
                CASE WHEN x[4] > x[1] THEN x[1] WHEN x[5] > x[2] THEN x[2] ELSE x[3] END) AS top FROM fenced
        ),
        judged AS (
            SELECT v.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
                   v1 > top[1] OR v2 > top[2] OR v3 > top[3] OR v4 > top[4] AS above
            FROM v JOIN limits p ON v.lang IS NOT DISTINCT FROM p.lang AND v.source IS NOT DISTINCT FROM p.source
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT above AS kept FROM judged
    """,
    "op7_line_dedup": f"""
        WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (
            SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, unnest(ls) AS line FROM split
        ),
        keyed AS (SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS k FROM lines),
        frequent AS (
            SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
            GROUP BY k HAVING count(DISTINCT doc_id) >= 5
        ),
        marked AS (
            SELECT doc_id, pos, line, coalesce(doc_id <> keeper, false) AS gone FROM keyed LEFT JOIN frequent USING (k)
        )
        SELECT doc_id, count(*) AS n_lines, CAST(sum(gone::int) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
} | MORE
