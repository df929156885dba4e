"""The catalog queries as SQL for another engine, written independently of the operators."""

from __future__ import annotations

F5 = ["nswprice", "nswdemand", "vicprice", "vicdemand", "transfer"]
_COLS = ", ".join(F5)

FEATURES = """
fx AS (
  SELECT CAST(event_id AS VARCHAR) AS "eventID", event_id, ts, event_type AS segment,
    value AS nswprice,
    CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS nswdemand,
    CAST(hour(ts) AS DOUBLE) AS vicprice, CAST(user_id AS DOUBLE) AS vicdemand,
    CAST(minute(ts) AS DOUBLE) AS transfer
  FROM events)"""

SHIFTED = (
    FEATURES
    + """,
sh AS (
  SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN nswprice * 1.5 ELSE nswprice END AS nswprice)
  FROM fx)"""
)

TRUTH = (
    FEATURES
    + """,
truth AS (
  SELECT *, CASE WHEN nswprice * 0.08 + nswdemand * -0.03 + 0.0
      + (CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) / 4294967296.0 - 0.5) * 2 > 0
    THEN 'UP' ELSE 'DOWN' END AS label
  FROM fx)"""
)

RAW = (
    TRUTH
    + """,
raw AS (
  SELECT * REPLACE (CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 103 = 0 THEN 'FLAT' ELSE label END AS label)
  FROM truth)"""
)

LABELS = (
    TRUTH
    + """,
sent AS (
  SELECT "eventID", event_id, label, ts + to_minutes(event_id % 7) AS label_arrival_time FROM truth),
label_log AS (
  SELECT "eventID", label, label_arrival_time FROM sent WHERE event_id % 11 <> 0
  UNION ALL
  SELECT "eventID", CASE label WHEN 'UP' THEN 'DOWN' ELSE 'UP' END, label_arrival_time + INTERVAL 60 MINUTE
  FROM sent WHERE event_id % 11 <> 0 AND event_id % 13 = 0
  UNION ALL
  SELECT CAST(event_id + 1000000000 AS VARCHAR), label, label_arrival_time FROM sent WHERE event_id % 97 = 0),
latest AS (
  SELECT "eventID", label, label_arrival_time FROM (
    SELECT *, row_number() OVER (PARTITION BY "eventID" ORDER BY label_arrival_time DESC) AS rn FROM label_log)
  WHERE rn = 1)"""
)

PREDICTIONS = (
    LABELS
    + """,
pred AS (
  SELECT "eventID", nswprice, nswdemand, vicprice, vicdemand, transfer,
    CASE WHEN ts < TIMESTAMP '2024-01-16'
      THEN CASE WHEN nswprice * 0.08 + nswdemand * -0.03 > 0 THEN 'UP' ELSE 'DOWN' END
      ELSE CASE WHEN nswprice * 0.01 + nswdemand * -0.03 + 1.0 > 0 THEN 'UP' ELSE 'DOWN' END END AS predicted_label,
    ts AS prediction_time,
    CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'lr_v1' ELSE 'lr_v2' END AS model_version
  FROM fx),
labelled AS (
  SELECT p.*, l.label AS true_label, l.label_arrival_time, p.predicted_label = l.label AS is_correct
  FROM pred p JOIN latest l ON p."eventID" = l."eventID")"""
)


def eddm(partition: str) -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return (
        PREDICTIONS
        + f""",
numbered AS (
  SELECT "eventID", model_version, is_correct AS ok,
    row_number() OVER ({part}ORDER BY label_arrival_time, "eventID") AS pos
  FROM labelled),
err AS (
  SELECT *, pos - coalesce(lag(pos) OVER ({part}ORDER BY pos), 0) AS distance,
    row_number() OVER ({part}ORDER BY pos) AS i
  FROM numbered WHERE NOT ok),
stat AS (
  SELECT *, avg(distance) OVER w AS m, CASE WHEN i >= 2 THEN avg(distance) OVER w + 2 * stddev_samp(distance) OVER w END AS c
  FROM err WINDOW w AS ({part}ORDER BY pos ROWS UNBOUNDED PRECEDING)),
best AS (
  SELECT *, max(c) OVER ({part}ORDER BY pos ROWS UNBOUNDED PRECEDING) AS top FROM stat),
judged AS (
  SELECT n."eventID", n.model_version, n.pos, n.ok, b.distance, CASE WHEN b.i >= 50 THEN b.c / b.top END AS ratio,
    count(b.i) OVER w AS num_errors,
    coalesce(last_value(b.m IGNORE NULLS) OVER w, 0.0) AS mean_distance,
    coalesce(max(b.top) OVER w, 0.0) AS max_mean_std
  FROM numbered n LEFT JOIN best b ON n."eventID" = b."eventID"
  WINDOW w AS ({part.replace("model_version", "n.model_version")}ORDER BY n.pos ROWS UNBOUNDED PRECEDING)),
shown AS (
  SELECT "eventID", model_version, pos, ok,
    CASE WHEN ratio < 0.90 THEN 'drift' WHEN ratio < 0.95 THEN 'warning' ELSE 'normal' END AS status,
    coalesce(ratio >= 0.90 AND ratio < 0.95, false) AS warning, coalesce(ratio < 0.90, false) AS drift,
    round(ratio, 6) AS ratio, num_errors, round(mean_distance, 6) AS mean_distance, round(max_mean_std, 6) AS max_mean_std
  FROM judged)"""
    )


def kswin(key: str) -> str:
    """h of every window of the shifted features, per feature and `key`, in `tested`."""
    part = f"PARTITION BY {key} " if key else ""
    k = f"{key}, " if key else ""
    jk = f"d.{key} = v.{key} AND " if key else ""
    dk = f"d.{key}, " if key else ""
    return (
        SHIFTED
        + f""",
pos AS (
  SELECT *, row_number() OVER ({part}ORDER BY ts, event_id) AS pos FROM sh),
hashed AS (
  SELECT {k}pos, CAST('0x' || substr(md5('42:' || pos), 1, 15) AS BIGINT) AS draw FROM pos),
tops AS (SELECT {k}max(pos) AS top FROM pos {"GROUP BY " + key if key else ""}),
spread AS (
  SELECT {"h." + key + ", " if key else ""}h.pos, h.draw,
    unnest(generate_series(greatest(h.pos, 1336), least(h.pos + 1335, t.top))) AS anchor
  FROM hashed h JOIN tops t ON {"h." + key + " = t." + key if key else "true"}),
drawn AS (
  SELECT {k}pos, anchor, anchor - pos < 336 AS cur,
    anchor - pos < 336 OR row_number() OVER (
      PARTITION BY {k}anchor, anchor - pos < 336 ORDER BY draw, pos) <= 336 AS used
  FROM spread),
long AS (
  SELECT {k}event_id, pos, feature, value FROM (
    SELECT {k}event_id, pos, {_COLS} FROM pos) UNPIVOT (value FOR feature IN ({_COLS}))),
counted AS (
  SELECT {dk}v.feature, d.anchor, v.value, sum(CASE WHEN d.cur THEN -1 ELSE 1 END) AS step
  FROM drawn d JOIN long v ON {jk}d.pos = v.pos
  WHERE d.used GROUP BY ALL),
running AS (
  SELECT {k}feature, anchor, abs(sum(step) OVER (PARTITION BY {k}feature, anchor ORDER BY value)) AS gap
  FROM counted),
tested AS (
  SELECT {k}feature, anchor AS pos, CAST(max(gap) AS INTEGER) AS h FROM running GROUP BY ALL)"""
    )


def kswin_thinned(key: str) -> str:
    """Drifts left after each restart of the window, in `kept`."""
    k = f"{key}, " if key else ""
    same = f"c.{key} = n.{key} AND " if key else ""
    return (
        kswin(key)
        + f""",
hits AS (SELECT * FROM tested WHERE h >= 45),
linked AS (
  SELECT n.*, (SELECT min(c.pos) FROM hits c WHERE {same}c.feature = n.feature AND c.pos >= n.pos + 1000) AS following
  FROM hits n),
kept AS (
  SELECT * FROM linked n WHERE pos = (SELECT min(c.pos) FROM hits c WHERE {same}c.feature = n.feature)
  UNION ALL
  SELECT l.* FROM kept n JOIN linked l ON {same.replace("c.", "l.")}l.feature = n.feature AND l.pos = n.following)"""
    )


P_EXACT = """round(least(1.0, CASE WHEN h = 0 THEN 1.0 ELSE 2 * list_sum(list_transform(
  generate_series(1, 336 // greatest(h, 1)),
  lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
    * exp(2 * lgamma(337) - lgamma(337 - k * h) - lgamma(337 + k * h)))) END), 9) AS p_value"""


def requests(cooldown: int, timeout: int | None) -> str:
    spans = (
        eddm("model_version")
        + f""",
fin AS (SELECT model_version, pos FROM shown WHERE pos % 2000 = 0),
spans AS (
  SELECT s.model_version, s.pos,
    coalesce((SELECT max(f.pos) FROM fin f WHERE f.model_version = s.model_version AND f.pos <= s.pos), 0) AS since
  FROM shown s WHERE s.drift),
open_ AS (SELECT * FROM spans WHERE since = 0 OR pos >= since + {cooldown})"""
    )
    if timeout is None:
        return f"WITH {spans} SELECT model_version, since, min(pos) AS pos FROM open_ GROUP BY ALL"
    return f"""WITH RECURSIVE {spans},
linked AS (
  SELECT n.*, (SELECT min(c.pos) FROM open_ c
    WHERE c.model_version = n.model_version AND c.since = n.since AND c.pos >= n.pos + {timeout}) AS following
  FROM open_ n),
kept AS (
  SELECT * FROM linked n WHERE pos = (
    SELECT min(c.pos) FROM open_ c WHERE c.model_version = n.model_version AND c.since = n.since)
  UNION ALL
  SELECT l.* FROM kept n JOIN linked l
    ON l.model_version = n.model_version AND l.since = n.since AND l.pos = n.following)
SELECT model_version, since, pos FROM kept"""


_SHOWN = (
    '"eventID", model_version, pos, status, warning, drift, ratio, num_errors, mean_distance, max_mean_std FROM shown'
)

_DECODED = (
    FEATURES
    + """,
decoded AS (
  SELECT event_id, CASE WHEN event_id % 50 NOT IN (0, 3) THEN "eventID" END AS "eventID",
    CASE WHEN event_id % 50 NOT IN (0, 1) THEN nswprice END AS nswprice,
    CASE WHEN event_id % 50 <> 0 THEN nswdemand END AS nswdemand,
    CASE WHEN event_id % 50 <> 0 THEN vicprice END AS vicprice,
    CASE WHEN event_id % 50 <> 0 THEN vicdemand END AS vicdemand,
    CASE WHEN event_id % 50 NOT IN (0, 2) THEN transfer END AS transfer
  FROM fx)"""
)

_ENCODED = "WITH " + RAW + ' SELECT "eventID", label, CAST(CASE label WHEN \'UP\' THEN 1 WHEN \'DOWN\' THEN 0 ELSE {} END AS {}) AS encoded FROM raw'

ORACLE = {
    "event_key": """
WITH raw AS (
  SELECT l_orderkey, strftime(l_shipdate, '%Y%m%d') AS d, CAST(l_linenumber AS VARCHAR) AS n,
    '0' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS p FROM lineitem)
SELECT l_orderkey, d AS date, d || n || p AS "eventID", d || '-' || n || '-' || p AS separated FROM raw""",
    "event_key_legacy": """
SELECT l_orderkey, l_linenumber,
  lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || CASE WHEN l_linenumber = 1 THEN 'x' ELSE '' END AS raw,
  CASE WHEN l_linenumber = 1 THEN lpad(CAST(l_orderkey AS VARCHAR), 8, '0') || 'x'
    ELSE CAST(l_orderkey AS VARCHAR) END AS "eventID"
FROM lineitem""",
    "event_key_collisions": """
SELECT CAST(l_suppkey AS VARCHAR) || CAST(l_linenumber AS VARCHAR) AS "eventID",
  count(DISTINCT (l_suppkey, l_partkey % 3)) AS sources
FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_suppkey, l_partkey % 3)) > 1""",
    "feature_projection": f'WITH {FEATURES} SELECT "eventID", {_COLS} FROM fx',
    "label_projection": f'WITH {TRUTH} SELECT "eventID", label FROM truth',
    "json_decode": f"WITH {_DECODED} SELECT * FROM decoded",
    "scorable_rows": f"WITH {_DECODED} SELECT * FROM decoded WHERE event_id % 50 > 3",
    "reject_rows": f"""WITH {_DECODED} SELECT event_id, "eventID",
  CASE event_id % 50 WHEN 1 THEN 'bad nswprice' WHEN 2 THEN 'bad transfer' ELSE 'no key' END AS reason
FROM decoded WHERE event_id % 50 <= 3""",
    "constraint_violations": """
SELECT 'unique' AS rule, 'eventID' AS "column", count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS violations
FROM lineitem
UNION ALL SELECT 'not null', 'eventID', 0
UNION ALL SELECT 'not null', 'true_label', count(*) FILTER (l_returnflag = 'R') FROM lineitem
UNION ALL SELECT 'length', 'eventID', count(*) FILTER (length(l_orderkey || '-' || l_linenumber) > 6) FROM lineitem
UNION ALL SELECT 'length', 'true_label', 0
UNION ALL SELECT 'length', 'model_version', count(*) FILTER (l_partkey > 999) FROM lineitem""",
    "label_encode_train": _ENCODED.format("1", "INTEGER"),
    "label_encode_retrain": _ENCODED.format("0", "INTEGER"),
    "label_encode_strict": _ENCODED.format("NULL", "DOUBLE"),
    "feature_array": f"""WITH {FEATURES} SELECT "eventID", 5 AS width, nswprice AS first, transfer AS last,
  round(nswprice + nswdemand + vicprice + vicdemand + transfer, 6) AS total FROM fx""",
    "chrono_split": f"""WITH {FEATURES} SELECT "eventID", event_id,
  CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= 3500 THEN 'past' ELSE 'live' END AS part FROM fx""",
    "hash_split": """
SELECT CAST(event_id AS VARCHAR) AS "eventID",
  CASE WHEN CAST('0x' || substr(md5('42:' || event_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.8
    THEN 'train' ELSE 'test' END AS part
FROM events""",
    "latest_label": f"WITH {LABELS} SELECT * FROM latest",
    "latest_n_labelled": f"""WITH {PREDICTIONS} SELECT "eventID", true_label, {_COLS} FROM labelled
ORDER BY label_arrival_time DESC, "eventID" LIMIT 2000""",
    "retrain_guard": f"""WITH {PREDICTIONS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY label_arrival_time DESC, "eventID") AS rn,
    count(*) OVER (PARTITION BY model_version) AS n FROM labelled)
SELECT "eventID", model_version, true_label FROM ranked WHERE rn <= 3000 AND n >= 3000""",
    "linear_score": f"""WITH {FEATURES} SELECT "eventID",
  CASE WHEN nswprice * 0.08 + nswdemand * -0.03 > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM fx""",
    "prediction_rows": f"WITH {PREDICTIONS} SELECT * FROM pred",
    "accuracy": f"""WITH {TRUTH} SELECT count(*) AS rows,
  round(avg(CASE WHEN (nswprice * 0.08 + nswdemand * -0.03 > 0) = (label = 'UP') THEN 1.0 ELSE 0.0 END), 9) AS accuracy
FROM truth""",
    "attach_by_key": """
WITH k AS (SELECT l_orderkey || '-' || l_linenumber AS "eventID", l_extendedprice, l_quantity FROM lineitem)
SELECT "eventID", l_extendedprice, min(l_quantity) OVER (PARTITION BY "eventID") AS l_quantity FROM k""",
    "label_join": f"""WITH {PREDICTIONS} SELECT "eventID", predicted_label, true_label, model_version,
  label_arrival_time, is_correct FROM labelled""",
    "orphan_labels": f"""WITH {LABELS} SELECT "eventID", label, label_arrival_time FROM label_log
WHERE "eventID" NOT IN (SELECT "eventID" FROM fx)""",
    "pending_predictions": f"""WITH {PREDICTIONS} SELECT "eventID", predicted_label, model_version FROM pred
WHERE "eventID" NOT IN (SELECT "eventID" FROM label_log)""",
    "pending_documents": """SELECT doc_id, lang, n_chars FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "prediction_table": f"""WITH {PREDICTIONS} SELECT p.*, l.label AS true_label, l.label_arrival_time
FROM pred p LEFT JOIN latest l ON p."eventID" = l."eventID" """,
    "idempotent_append": f"""WITH {PREDICTIONS} SELECT "eventID", predicted_label,
  CASE WHEN prediction_time < TIMESTAMP '2024-01-20' THEN 0 ELSE 1 END AS batch_id FROM pred""",
    "error_distance": f'WITH {eddm("")} SELECT "eventID", pos, distance FROM judged WHERE NOT ok',
    "eddm_status": f"WITH {eddm('')} SELECT {_SHOWN}",
    "eddm_by_model": f"WITH {eddm('model_version')} SELECT {_SHOWN}",
    "eddm_errors": f"WITH {eddm('model_version')} SELECT {_SHOWN} WHERE NOT ok",
    "prequential_accuracy": f"""WITH {PREDICTIONS} SELECT "eventID", row_number() OVER w AS pos,
  CAST(sum(is_correct::INT) OVER w AS BIGINT) AS correct, round(avg(is_correct::INT) OVER w, 9) AS accuracy
FROM labelled WINDOW w AS (ORDER BY label_arrival_time, "eventID" ROWS UNBOUNDED PRECEDING)""",
    "recent_accuracy": f"""WITH {PREDICTIONS} SELECT "eventID", model_version,
  row_number() OVER (PARTITION BY model_version ORDER BY label_arrival_time, "eventID") AS pos,
  round(avg(is_correct::INT) OVER w, 9) AS accuracy
FROM labelled WINDOW w AS (PARTITION BY model_version ORDER BY label_arrival_time, "eventID" ROWS 499 PRECEDING)""",
    "ordered_index": """SELECT event_type AS segment, event_id,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events""",
    "draw_sample": """WITH pos AS (
  SELECT event_type AS segment, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS pos FROM events)
SELECT * FROM pos QUALIFY row_number() OVER (PARTITION BY segment ORDER BY substr(md5('42:' || pos), 1, 15), pos) <= 336""",
    "unpivot_features": f"""WITH {FEATURES} SELECT segment, event_id, feature, value
FROM (SELECT segment, event_id, {_COLS} FROM fx) UNPIVOT (value FOR feature IN ({_COLS}))""",
    "ks_two_sample": f"""WITH {SHIFTED}, long AS (
  SELECT segment, feature, ts < TIMESTAMP '2024-01-16' AS old, value
  FROM (SELECT segment, ts, {_COLS} FROM sh) UNPIVOT (value FOR feature IN ({_COLS}))),
sizes AS (SELECT segment, feature, count(*) FILTER (old) AS n, count(*) FILTER (NOT old) AS m FROM long GROUP BY ALL),
running AS (
  SELECT DISTINCT segment, feature, value, count(*) FILTER (old) OVER w AS a, count(*) FILTER (NOT old) OVER w AS b
  FROM long WINDOW w AS (PARTITION BY segment, feature ORDER BY value)),
gaps AS (
  SELECT segment, feature, n, m, max(abs(a * m - b * n)) AS gap
  FROM running JOIN sizes USING (segment, feature) GROUP BY ALL),
scaled AS (SELECT *, gap / (n * m)::DOUBLE AS d, gap / (n * m)::DOUBLE * sqrt(n * m / (n + m)::DOUBLE) AS x FROM gaps)
SELECT segment, feature, n AS n_reference, m AS n_current, round(d, 9) AS ks_statistic,
  round(CASE WHEN x < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(generate_series(1, 100),
    lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * (k * x) ** 2))))) END, 9) AS p_value
FROM scaled""",
    "kswin_anchors": f"""WITH {kswin("segment")}
SELECT segment, feature, event_id, pos, h, round(h / 336.0::DOUBLE, 9) AS ks_statistic, {P_EXACT}, h >= 45 AS drift
FROM tested JOIN pos USING (segment, pos)""",
    "kswin_drift": f"""WITH RECURSIVE {kswin_thinned("")}
SELECT feature, event_id, pos, h, round(h / 336.0::DOUBLE, 9) AS ks_statistic, {P_EXACT} FROM kept JOIN pos USING (pos)""",
    "kswin_drift_by_segment": f"""WITH RECURSIVE {kswin_thinned("segment")}
SELECT segment, feature, event_id, pos, h FROM kept JOIN pos USING (segment, pos)""",
    "kswin_readiness": f"""WITH RECURSIVE {kswin_thinned("segment")},
filled AS (
  SELECT l.segment, l.feature, l.pos, coalesce(336 + l.pos - 1 - k.pos, least(l.pos - 1, 1336)) AS fill
  FROM long l LEFT JOIN kept k
    ON k.segment = l.segment AND k.feature = l.feature AND l.pos > k.pos AND l.pos <= k.pos + 1000)
SELECT segment, feature, pos, fill, fill = 1336 AS ready FROM filled""",
    "lr_first_order": f"""WITH {TRUTH}, m AS (
  SELECT count(*) AS rows, avg(CASE label WHEN 'UP' THEN 1.0::DOUBLE ELSE 0 END) AS intercept,
    {", ".join(f"sum(CASE label WHEN 'UP' THEN {c} ELSE 0 END) / sum({c}) AS {c}" for c in F5)}
  FROM truth)
SELECT rows, feature, round(share, 4) AS share FROM m UNPIVOT (share FOR feature IN (intercept, {_COLS}))""",
    "current_model": f"""WITH {PREDICTIONS} SELECT model_version AS name, count(*) AS rows,
  CAST(regexp_extract(model_version, '([0-9]+)$', 1) AS INTEGER) AS version
FROM pred GROUP BY 1 ORDER BY version DESC LIMIT 1""",
    "retrain_requests": requests(100, 300),
    "retrain_requests_open": requests(0, None),
    "stream_score": f"""WITH {_DECODED} SELECT "eventID", {_COLS},
  CASE WHEN nswprice * 0.08 + nswdemand * -0.03 > 0 THEN 'UP' ELSE 'DOWN' END AS predicted_label,
  'lr_v1' AS model_version FROM decoded WHERE event_id % 50 > 3""",
    "stream_label_join": f"""WITH {PREDICTIONS} SELECT p."eventID", predicted_label, l.label AS true_label,
  predicted_label = l.label AS is_correct
FROM pred p JOIN label_log l ON p."eventID" = l."eventID"
  AND l.label_arrival_time BETWEEN prediction_time AND prediction_time + INTERVAL 2 HOUR""",
    "stream_labelled_table": f"""WITH {PREDICTIONS} SELECT p."eventID", predicted_label, l.label AS true_label,
  l.label_arrival_time FROM pred p JOIN latest l ON p."eventID" = l."eventID" """,
    "stream_labelled_once": f'WITH {PREDICTIONS} SELECT "eventID", model_version FROM labelled',
    "stream_orphans": f"""WITH {LABELS} SELECT "eventID", label FROM label_log
WHERE "eventID" NOT IN (SELECT "eventID" FROM fx)""",
    "ks_equal_sizes": """WITH pos AS (
  SELECT l_linenumber, l_extendedprice AS p, row_number() OVER (
    PARTITION BY l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos FROM lineitem),
paired AS (
  SELECT l_linenumber, (pos - 1) // 2 AS pair, arg_min(p, pos) AS a, arg_max(p, pos) AS b
  FROM pos GROUP BY ALL HAVING count(*) = 2),
long AS (SELECT a AS v, 1 AS x, 0 AS y FROM paired UNION ALL SELECT b, 0, 1 FROM paired),
running AS (SELECT sum(x) OVER w AS a, sum(y) OVER w AS b FROM long WINDOW w AS (ORDER BY v)),
gap AS (SELECT (SELECT count(*) FROM paired) AS n, CAST(max(abs(a - b)) AS BIGINT) AS h FROM running)
SELECT n AS n_reference, n AS n_current, round(h / n::DOUBLE, 9) AS ks_statistic,
  round(least(1.0, 2 * list_sum(list_transform(generate_series(1, n // h), lambda k: (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
    * exp(2 * lgamma(n + 1) - lgamma(n + 1 - k * h) - lgamma(n + 1 + k * h))))), 9) AS p_value FROM gap""",
    "registry_advance": f"""WITH {PREDICTIONS}, seen AS (SELECT model_version AS name, count(*) AS rows FROM pred GROUP BY 1)
SELECT CAST((SELECT count(*) FROM seen) AS INTEGER) AS version, name, 'models/' || (SELECT count(*) FROM seen) AS path, rows
FROM seen ORDER BY name DESC LIMIT 1""",
    "csv_round_trip": """SELECT strftime(l_shipdate, '%Y.%m.%d') AS date, CAST(l_linenumber AS VARCHAR) AS day,
  '0.' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS period FROM lineitem""",
    "stream_score_swap": f"""WITH {_DECODED} SELECT d."eventID",
  CASE WHEN (ts < TIMESTAMP '2024-01-09' AND d.nswprice * 0.08 + d.nswdemand * -0.03 > 0)
    OR (ts >= TIMESTAMP '2024-01-09' AND d.nswprice * 0.01 + d.nswdemand * -0.03 + 1.0 > 0) THEN 'UP' ELSE 'DOWN' END AS predicted_label,
  CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 'lr_v1' ELSE 'lr_v2' END AS model_version
FROM decoded d JOIN fx USING (event_id) WHERE event_id % 50 > 3""",
    "stream_eddm": f"WITH {eddm('model_version')} SELECT {_SHOWN}",
    "stream_kswin": f"""WITH RECURSIVE {kswin_thinned("segment")}
SELECT segment, feature, event_id, pos, h FROM kept JOIN pos USING (segment, pos)""",
    "stream_once_per_key": f'WITH {LABELS} SELECT DISTINCT "eventID" FROM label_log',
    "correctness_flag": f"""WITH {PREDICTIONS} SELECT p."eventID", coalesce(p.predicted_label = l.label, false) AS is_correct
FROM pred p LEFT JOIN latest l ON p."eventID" = l."eventID" """,
    "reject_reasons": """SELECT event_id, CASE event_id % 50 WHEN 0 THEN 'not json' WHEN 1 THEN 'bad type nswprice'
  WHEN 2 THEN 'missing transfer' ELSE 'no key' END AS reason FROM events WHERE event_id % 50 <= 3""",
    "ks_unequal_exact": """WITH RECURSIVE lines AS (
  SELECT l_suppkey, l_linenumber, l_extendedprice AS v, l_returnflag = 'R' AS old FROM lineitem),
sizes AS (SELECT l_suppkey, l_linenumber, count(*) FILTER (old) AS n, count(*) FILTER (NOT old) AS m FROM lines GROUP BY ALL),
running AS (
  SELECT l_suppkey, l_linenumber, count(*) FILTER (old) OVER w AS a, count(*) FILTER (NOT old) OVER w AS b
  FROM lines WINDOW w AS (PARTITION BY l_suppkey, l_linenumber ORDER BY v)),
gaps AS (
  SELECT l_suppkey, l_linenumber, n, m, CAST(max(abs(a * m - b * n)) AS BIGINT) AS gap
  FROM running JOIN sizes USING (l_suppkey, l_linenumber) GROUP BY ALL),
kinds AS (SELECT DISTINCT n, m, gap FROM gaps WHERE n > 0 AND m > 0 AND gap > 0),
walk AS (
  SELECT n, m, gap, 0 AS k, 0 AS i, 1.0::DOUBLE AS p FROM kinds
  UNION ALL
  SELECT n, m, gap, k + 1, i + d, sum(p * (CASE d WHEN 1 THEN n - i ELSE m - (k - i) END) / (n + m - k))
  FROM walk, (VALUES (0), (1)) step(d)
  WHERE abs(i * m - (k - i) * n) < gap AND k < n + m AND (CASE d WHEN 1 THEN n - i ELSE m - (k - i) END) > 0
  GROUP BY n, m, gap, k, i + d),
outside AS (SELECT n, m, gap, sum(p) AS p FROM walk WHERE abs(i * m - (k - i) * n) >= gap GROUP BY ALL)
SELECT l_suppkey, l_linenumber, n AS n_reference, m AS n_current, round(gap / CASE WHEN n * m > 0 THEN n * m END::DOUBLE, 9) AS ks_statistic,
  round(CASE WHEN n = 0 OR m = 0 THEN 'nan'::DOUBLE WHEN gap = 0 THEN 1.0 ELSE least(1.0, p) END, 9) AS p_value,
  CASE WHEN n > 0 AND m > 0 THEN 'exact' ELSE 'limit' END AS method
FROM gaps LEFT JOIN outside USING (n, m, gap)""",
    "registry_race": f"""WITH {PREDICTIONS}, seen AS (SELECT model_version, count(*) AS rows FROM pred GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY model_version) AS INTEGER) AS version,
  'lr_v' || row_number() OVER (ORDER BY model_version) AS name, CAST((SELECT sum(rows) FROM seen) AS BIGINT) AS all_rows FROM seen""",
    "retrain_moments": f"""WITH {PREDICTIONS}, last AS (
  SELECT * FROM labelled ORDER BY label_arrival_time DESC, "eventID" LIMIT 2000),
m AS (
  SELECT count(*) AS rows, avg(CASE true_label WHEN 'UP' THEN 1.0::DOUBLE ELSE 0 END) AS intercept,
    {", ".join(f"sum(CASE true_label WHEN 'UP' THEN {c} ELSE 0 END) / sum({c}) AS {c}" for c in F5)}
  FROM last)
SELECT rows, feature, round(share, 3) AS share, 'lr_v2' AS name FROM m UNPIVOT (share FOR feature IN (intercept, {_COLS}))""",
    "stream_eddm_late": f"WITH {eddm('model_version')} SELECT {_SHOWN}",
    "stream_kswin_late": f"""WITH RECURSIVE {kswin_thinned("segment")}
SELECT segment, feature, event_id, pos, h FROM kept JOIN pos USING (segment, pos)""",
    "stream_pending": f"""WITH {PREDICTIONS} SELECT "eventID", predicted_label, model_version FROM pred
WHERE "eventID" NOT IN (SELECT "eventID" FROM label_log)""",
    "stream_expired": f"""WITH {PREDICTIONS}, clock AS (
  SELECT greatest((SELECT max(prediction_time) FROM pred), (SELECT max(label_arrival_time) FROM label_log)) - INTERVAL 3 DAY AS mark)
SELECT "eventID", 'prediction' AS kind FROM pred, clock
WHERE "eventID" NOT IN (SELECT "eventID" FROM label_log) AND prediction_time < mark
UNION ALL SELECT "eventID", 'label' FROM label_log, clock
WHERE "eventID" NOT IN (SELECT "eventID" FROM fx) AND label_arrival_time < mark""",
    "stream_latest_n": f"""WITH {PREDICTIONS} SELECT "eventID", true_label, {_COLS} FROM labelled
ORDER BY label_arrival_time DESC, "eventID" LIMIT 2000""",
    "stream_requests": f"WITH {eddm('model_version')} SELECT model_version, min(pos) AS pos FROM shown WHERE drift GROUP BY 1",
    "stream_rate_limited": """SELECT CAST((event_id % 6) // 2 AS INTEGER) AS batch_id, count(*) AS rows FROM events GROUP BY 1""",
    "stream_score_registry": f"""WITH {_DECODED} SELECT d."eventID",
  CASE WHEN (ts < TIMESTAMP '2024-01-09' AND d.nswprice * 0.08 + d.nswdemand * -0.03 > 0)
    OR (ts >= TIMESTAMP '2024-01-09' AND d.nswprice * 0.01 + d.nswdemand * -0.03 + 1.0 > 0) THEN 'UP' ELSE 'DOWN' END AS predicted_label,
  CASE WHEN ts < TIMESTAMP '2024-01-09' THEN 'lr_v1' ELSE 'lr_v2' END AS model_version
FROM decoded d JOIN fx USING (event_id) WHERE event_id % 50 > 3""",
}
