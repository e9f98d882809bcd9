"""DuckDB SQL with the same meaning as the registered queries, over whole tables."""

from __future__ import annotations

from catalog.views import (
    FIRST_DAY,
    MODEL_OF_SENSOR,
    N_CLASSES,
    ODD_LABELS,
    SCORE_UNIT,
    SENSORS,
    TRAIN_ONLY_SENSOR,
)

# Spelled out here and not taken from the code under test.
SEEDS = list(range(20))
TRAIN_COLUMNS = [
    "uid", "timestamp", "sensor_type", *[f"field_{i}" for i in range(8)], "session_id", "user_id",
]
PAIRS = [("RF", "GBT"), ("LR", "SVM"), ("RF", "Dummy_stratified")]
SUMMARISED = {
    "field_0": "field_0", "field_1": "field_1", "field_2": "field_2", "field_3": "field_3",
    "field_4": "field_4", "field_5": "field_5", "field_6": "field_6", "field_7": "field_7",
    "mag": "mag_012",
}
METRICS = (
    "n_events duration_ms "
    "field_0_mean field_0_p50 field_0_std field_0_min field_0_max field_0_nn "
    "field_1_mean field_1_p50 field_1_std field_1_min field_1_max field_1_nn "
    "field_2_mean field_2_p50 field_2_std field_2_min field_2_max field_2_nn "
    "field_3_mean field_3_p50 field_3_std field_3_min field_3_max field_3_nn "
    "field_4_mean field_4_p50 field_4_std field_4_min field_4_max field_4_nn "
    "field_5_mean field_5_p50 field_5_std field_5_min field_5_max field_5_nn "
    "field_6_mean field_6_p50 field_6_std field_6_min field_6_max field_6_nn "
    "field_7_mean field_7_p50 field_7_std field_7_min field_7_max field_7_nn "
    "mag_mean mag_p50 mag_std mag_min mag_max mag_nn event_rate"
).split()

COLUMNS = (
    ["uid", "timestamp", "sensor_type"]
    + [f"field_{i}" for i in range(8)]
    + ["session_id", "user_id"]
)
TEST_COLUMNS = ", ".join(f'"{c}"' for c in COLUMNS if c != "user_id")

# --- shared relations -------------------------------------------------------

SENSOR_EVENTS = """
sensor_events AS (
  SELECT cast(event_id AS varchar) AS uid,
         epoch_us(ts) // 1000 AS "timestamp",
         CASE event_type WHEN 'click' THEN '1' WHEN 'error' THEN '2' WHEN 'purchase' THEN '4'
                         WHEN 'signup' THEN '5' ELSE '19' END AS sensor_type,
         value AS field_0,
         cast(json_extract_string(props, '$.k') AS double) AS field_1,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE cast(event_id % 7 AS double) END AS field_2,
         CASE WHEN event_type IN ('purchase', 'view') THEN value * 0.5 END AS field_3,
         CASE WHEN event_type = 'view' THEN cast(event_id % 13 AS double) END AS field_4,
         cast(NULL AS double) AS field_5, cast(NULL AS double) AS field_6,
         cast(NULL AS double) AS field_7,
         concat(cast(user_id AS varchar), '-',
                cast(cast(floor((dayofmonth(ts) - 1) / 6) AS int) AS varchar)) AS session_id,
         cast(user_id AS varchar) AS user_id
  FROM events)"""
TRAIN = "train AS (SELECT * FROM sensor_events WHERE session_id NOT LIKE '%-4')"
TEST = (
    f"test AS (SELECT {TEST_COLUMNS} FROM sensor_events "
    f"WHERE session_id LIKE '%-4' AND sensor_type <> '{TRAIN_ONLY_SENSOR}')"
)
MIXED = (
    "mixed AS (SELECT * REPLACE (CASE WHEN field_1 >= 98 "
    "THEN cast(cast(user_id AS int) + 1 AS varchar) ELSE user_id END AS user_id) "
    "FROM sensor_events)"
)
SESSIONS = "sessions AS (SELECT DISTINCT session_id, user_id FROM sensor_events)"
CLASS_SESSIONS = (
    "sessions AS (SELECT DISTINCT session_id, "
    f"cast(cast(user_id AS int) % {N_CLASSES} AS varchar) AS user_id FROM sensor_events)"
)
SEED_LIST = f"seeds AS (SELECT unnest({SEEDS}) AS seed)"
ONE_SEED = "seeds AS (SELECT unnest([0]) AS seed)"
# What the fits see: the sessions before the unseen period, four classes of users.
LEARNABLE_SESSIONS = (
    "sessions AS (SELECT DISTINCT session_id, "
    f"cast(cast(user_id AS int) % {N_CLASSES} AS varchar) AS user_id "
    "FROM sensor_events WHERE session_id NOT LIKE '%-4')"
)
LEARNABLE_TEST = (
    f"SELECT DISTINCT session_id, cast(cast(user_id AS int) % {N_CLASSES} AS varchar) AS user_id "
    f"FROM sensor_events WHERE session_id LIKE '%-4' AND sensor_type <> '{TRAIN_ONLY_SENSOR}'"
)
DENSE = (
    "dense AS (SELECT * REPLACE (split_part(session_id, '-', 2) AS session_id) FROM sensor_events)"
)


def with_(*relations: str, recursive: bool = False) -> str:
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(relations) + "\n"


def hashed(text: str) -> str:
    """The first 32 bits of an md5 as a number in [0, 1)."""
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296.0)"


# --- features ---------------------------------------------------------------


def digest_sql(source: str, name: str = "digest", extra: str = "") -> str:
    stats = []
    for prefix, column in SUMMARISED.items():
        stats += [
            f"avg({column}) AS {prefix}_mean",
            f"quantile_disc({column}, 0.5) AS {prefix}_p50",
            f"stddev_samp({column}) AS {prefix}_std",
            f"min({column}) AS {prefix}_min",
            f"max({column}) AS {prefix}_max",
            f"count({column}) AS {prefix}_nn",
        ]
    return f"""{name} AS (
  SELECT *, n_events / (duration_ms + 1.0) AS event_rate FROM (
    SELECT session_id, sensor_type, count(*) AS n_events,
           max("timestamp") - min("timestamp") AS duration_ms, {", ".join(stats)}{extra}
    FROM (SELECT *, sqrt(field_0 * field_0 + field_1 * field_1 + field_2 * field_2) AS mag_012
          FROM {source})
    GROUP BY session_id, sensor_type))"""


_COUNTS = {m for m in METRICS if m in ("n_events", "duration_ms") or m.endswith("_nn")}


def _digest_column(metric: str) -> str:
    return metric if metric in _COUNTS else f"round({metric}, 6) AS {metric}"


DIGEST_SELECT = "SELECT session_id, sensor_type, " + ", ".join(map(_digest_column, METRICS))


def wide_sql(digest: str, name: str, sensors: list[str]) -> str:
    cells = ", ".join(
        f"max(CASE WHEN sensor_type = '{s}' THEN {m} END) AS sensor_{s}_{m}"
        for s in sensors
        for m in METRICS
    )
    return f"{name} AS (SELECT session_id, {cells} FROM {digest} GROUP BY session_id)"


def wide_columns(sensors: list[str]) -> str:
    return ", ".join(
        f"sensor_{s}_{m}" if m in _COUNTS else f"round(sensor_{s}_{m}, 6) AS sensor_{s}_{m}"
        for s in sensors
        for m in METRICS
    )


def aligned_columns(present: list[str], digits: int | None = 6) -> str:
    cells = []
    for s in SENSORS:
        for m in METRICS:
            name = f"sensor_{s}_{m}"
            value = f"coalesce({name}::DOUBLE, 0.0)" if s in present else "0.0::DOUBLE"
            cells.append(f"round({value}, {digits}) AS {name}" if digits else f"{value} AS {name}")
    return ", ".join(cells)


def odd_columns() -> str:
    return ", ".join(
        f"round(coalesce(sensor_{s}_{m}::DOUBLE, 0.0), 6) AS sensor_{ODD_LABELS[s]}_{m}"
        for s in SENSORS
        for m in METRICS
    )


SEEN = [s for s in SENSORS if s != TRAIN_ONLY_SENSOR]
TRAIN_WIDE = [SENSOR_EVENTS, TRAIN, digest_sql("train"), wide_sql("digest", "wide", SENSORS)]
TEST_WIDE = [SENSOR_EVENTS, TEST, digest_sql("test"), wide_sql("digest", "wide", SEEN)]
LABELS = "labels_ AS (SELECT DISTINCT session_id, user_id FROM {})"

# --- splits -----------------------------------------------------------------


def split_sql(test_size: float, seeds: str = SEED_LIST) -> list[str]:
    return [
        seeds,
        "totals AS (SELECT count(*) AS n, "
        f"cast(ceil({test_size} * count(*)) AS BIGINT) AS n_valid FROM sessions)",
        """classes AS (
  SELECT seed, user_id, n_class, (n_class * n_valid) // n AS base,
         row_number() OVER (PARTITION BY seed
                            ORDER BY (n_class * n_valid) % n DESC,
                                     md5(concat(seed, ':', user_id)), user_id) AS turn,
         n_valid - sum((n_class * n_valid) // n) OVER (PARTITION BY seed) AS open_places
  FROM (SELECT user_id, count(*) AS n_class FROM sessions GROUP BY user_id), totals, seeds)""",
        """splits AS (
  SELECT s.seed, s.session_id, s.user_id,
         s.turn <= c.base + (CASE WHEN c.turn <= c.open_places THEN 1 ELSE 0 END) AS is_valid
  FROM (SELECT seed, session_id, user_id,
               row_number() OVER (PARTITION BY seed, user_id
                                  ORDER BY md5(concat(seed, ':', session_id)), session_id) AS turn
        FROM sessions, seeds) s
  JOIN classes c ON c.seed = s.seed AND c.user_id = s.user_id)""",
        "train_sizes AS (SELECT seed, user_id, count(*) AS n_train FROM splits "
        "WHERE NOT is_valid GROUP BY seed, user_id)",
    ]


MOST_FREQUENT = """most_frequent AS (
  SELECT 'Dummy_most_frequent' AS model, v.seed, v.session_id, v.user_id, t.user_id AS prediction
  FROM splits v
  JOIN (SELECT seed, user_id, row_number() OVER (PARTITION BY seed
               ORDER BY n_train DESC, user_id) AS turn FROM train_sizes) t
    ON t.seed = v.seed AND t.turn = 1
  WHERE v.is_valid)"""
STRATIFIED = f"""stratified AS (
  SELECT 'Dummy_stratified' AS model, v.seed, v.session_id, v.user_id, c.user_id AS prediction
  FROM (SELECT s.*, floor({hashed("concat('draw:', s.seed, ':', session_id)")} * n) AS at
        FROM splits s JOIN (SELECT seed, sum(n_train) AS n FROM train_sizes GROUP BY seed) t
          ON t.seed = s.seed
        WHERE is_valid) v
  JOIN (SELECT seed, user_id, n_train,
               sum(n_train) OVER (PARTITION BY seed ORDER BY substr(md5(user_id), 1, 3), user_id
                                  ROWS UNBOUNDED PRECEDING) AS upto
        FROM train_sizes) c
    ON c.seed = v.seed AND v.at >= c.upto - c.n_train AND v.at < c.upto)"""


def macro_f1_sql(predictions: str) -> str:
    return f"""SELECT model, seed, round(avg(2 * hits / (2 * hits + wrong)), 6) AS macro_f1 FROM (
  SELECT model, seed, class, sum(hit) AS hits, sum(1 - hit) AS wrong FROM (
    SELECT model, seed, user_id AS class, CASE WHEN user_id = prediction THEN 1 ELSE 0 END AS hit
    FROM {predictions}
    UNION ALL
    SELECT model, seed, prediction, 0 FROM {predictions} WHERE user_id <> prediction)
  GROUP BY model, seed, class)
GROUP BY model, seed"""


# --- evaluation -------------------------------------------------------------


def scores_sql(digits: int) -> str:
    names = " ".join(f"WHEN '{s}' THEN '{m}'" for s, m in MODEL_OF_SENSOR.items())
    return f"""scores AS (
  SELECT CASE sensor_type {names} END AS model,
         cast("timestamp" // 86400000 - {FIRST_DAY} AS int) AS seed,
         round(avg(field_0) / {SCORE_UNIT}, {digits}) AS macro_f1
  FROM sensor_events GROUP BY ALL)"""


PAIR_VALUES = ", ".join(f"('{a}', '{b}')" for a, b in PAIRS)
DIFFERENCES = f"""pairs(model_a, model_b) AS (VALUES {PAIR_VALUES}),
differences AS (
  SELECT p.model_a, p.model_b, a.seed, a.macro_f1 AS score_a, b.macro_f1 AS score_b,
         a.macro_f1 - b.macro_f1 AS difference
  FROM pairs p
  JOIN scores a ON a.model = p.model_a
  JOIN scores b ON b.model = p.model_b AND b.seed = a.seed)"""
SUMMARY = """summary AS (
  SELECT model, avg(macro_f1) AS mean_macro_f1, stddev_pop(macro_f1) AS std_macro_f1,
         min(macro_f1) AS min_macro_f1, max(macro_f1) AS max_macro_f1
  FROM scores GROUP BY model)"""
# Rank subsets per sum, one more rank per step; 1-based lists.
WAYS = """ways AS (
  SELECT 0 AS r,
         list_transform(range(0, 700), lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS c
  UNION ALL
  SELECT r + 1, list_transform(range(0, 700),
           lambda s: (c[s + 1] + CASE WHEN s >= r + 1 THEN c[s - r] ELSE 0.0 END)::DOUBLE)
  FROM ways WHERE r < 50)"""
# erfc(x) = 1 - erf(x) by its power series; x stays below 4 here.
ERFC = (
    "(1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), "
    "lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * "
    "exp((2 * k + 1) * ln(x + 1e-300) - lgamma(k + 1)) / (2 * k + 1))))"
)
SIGNED_RANKS = f"""ranked AS (
  SELECT *, count(*) OVER (PARTITION BY model_a, model_b, abs(difference)) AS ties,
         rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(difference)) AS low_rank
  FROM differences WHERE difference <> 0),
rank_sums AS (
  SELECT model_a, model_b, count(*) AS n, sum(ties * ties - 1) AS tie_term,
         least(sum(CASE WHEN difference > 0 THEN low_rank + (ties - 1) / 2 ELSE 0 END),
               sum(CASE WHEN difference < 0 THEN low_rank + (ties - 1) / 2 ELSE 0 END)) AS w
  FROM ranked GROUP BY model_a, model_b),
means AS (
  SELECT model_a, model_b, avg(score_a) AS mean_a, avg(score_b) AS mean_b,
         avg(difference) AS mean_difference, count(*) AS n_all
  FROM differences GROUP BY model_a, model_b),
tested AS (
  SELECT *, (n = n_all AND tie_term = 0 AND n <= 50) AS exact,
         abs(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - tie_term / 48)
           / sqrt(2) AS x
  FROM means JOIN rank_sums USING (model_a, model_b)),
with_p AS (
  SELECT t.*, CASE WHEN exact
      THEN least(1.0, 2 * list_sum(c[1:cast(floor(w) AS BIGINT) + 1]) / pow(2, n))
      ELSE {ERFC} END AS p_value
  FROM tested t JOIN ways ON ways.r = least(t.n, 50))
SELECT model_a, model_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(mean_difference, 6) AS mean_difference, w::DOUBLE AS wilcoxon_statistic,
       round(p_value, 6) AS p_value, p_value < 0.05 AS significant_at_0_05
FROM with_p"""
# Sign choices per doubled rank sum, one more rank (of ties the mean) per step and pair.
EXACT_WITH_TIES = """, ordered AS (
  SELECT model_a, model_b, cast(2 * low_rank + ties - 1 AS INT) AS doubled,
         row_number() OVER (PARTITION BY model_a, model_b ORDER BY abs(difference), seed) AS r
  FROM ranked),
choices AS (
  SELECT model_a, model_b, 0::BIGINT AS r, list_transform(range(0, 1400),
         lambda i: CASE WHEN i = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) AS c
  FROM means
  UNION ALL
  SELECT o.model_a, o.model_b, o.r, list_transform(range(0, 1400),
         lambda s: (c[s + 1] + CASE WHEN s >= o.doubled THEN c[s - o.doubled + 1] ELSE 0.0 END)::DOUBLE)
  FROM choices JOIN ordered o
    ON o.model_a = choices.model_a AND o.model_b = choices.model_b AND o.r = choices.r + 1),
exact_p AS (
  SELECT t.*, least(1.0, 2 * list_sum(c[1:cast(floor(2 * w) AS BIGINT) + 1]) / pow(2, n)) AS p_value
  FROM tested t JOIN choices USING (model_a, model_b) WHERE r = n)
SELECT model_a, model_b, round(mean_a, 6) AS mean_a, round(mean_b, 6) AS mean_b,
       round(mean_difference, 6) AS mean_difference, w::DOUBLE AS wilcoxon_statistic,
       round(p_value, 6) AS p_value, p_value < 0.05 AS significant_at_0_05
FROM exact_p"""
GRID_IDS = " ".join(
    f"WHEN '{m}' THEN {i}" for i, m in enumerate(sorted(MODEL_OF_SENSOR.values()))
)


def _null_count(column: str, table: str = "") -> str:
    return f'count_if("{column}" IS NULL)::BIGINT AS "{column}"'


def _user_sessions(source: str) -> str:
    return (
        "SELECT user_id, count(DISTINCT session_id) AS n_sessions "
        f"FROM {source} GROUP BY user_id"
    )


def _sizes(source: str) -> str:
    return f"(SELECT session_id, count(*) AS size FROM {source} GROUP BY session_id)"


SIZE_STATS = (
    "quantile_disc(size, 0.5) AS p50, quantile_disc(size, 0.9) AS p90, "
    "quantile_disc(size, 0.99) AS p99, max(size) AS max_count"
)


def oracle_sql() -> dict[str, str]:
    base = with_(SENSOR_EVENTS)
    train_rows = with_(SENSOR_EVENTS, TRAIN) + "SELECT * FROM train"
    splits = [SENSOR_EVENTS, SESSIONS, *split_sql(0.2)]
    class_splits = [SENSOR_EVENTS, CLASS_SESSIONS, *split_sql(0.2)]
    learnable = [SENSOR_EVENTS, LEARNABLE_SESSIONS, *split_sql(0.2, ONE_SEED)]
    learnable_all = [SENSOR_EVENTS, LEARNABLE_SESSIONS, *split_sql(0.2)]
    dense_digest = with_(SENSOR_EVENTS, DENSE, digest_sql("dense")) + DIGEST_SELECT + " FROM digest"
    mixed = with_(SENSOR_EVENTS, MIXED)
    all_digest = with_(SENSOR_EVENTS, digest_sql("sensor_events")) + DIGEST_SELECT + " FROM digest"
    scaler_cells = ", ".join(f"sensor_{s}_{m}" for s in SENSORS for m in METRICS)
    aligned_train = (
        with_(*TRAIN_WIDE, LABELS.format("train"))
        + f"SELECT w.session_id, {aligned_columns(SENSORS)}, l.user_id "
        "FROM wide w LEFT JOIN labels_ l ON l.session_id = w.session_id"
    )
    aligned_test = with_(*TEST_WIDE) + f"SELECT session_id, {aligned_columns(SEEN)} FROM wide"
    return {
        "csv_roundtrip_train": train_rows,
        "parquet_roundtrip_train": train_rows,
        "csv_roundtrip_test": with_(SENSOR_EVENTS, TEST) + "SELECT * FROM test",
        "predictions_sink": with_(*splits, STRATIFIED)
        + f"SELECT session_id, prediction AS user_id FROM stratified WHERE seed = {SEEDS[-1]}",
        "dataset_audit_tables": with_(SENSOR_EVENTS, TRAIN, TEST)
        + """SELECT 'train' AS table_name, count(*) AS n_rows,
       count(DISTINCT session_id) AS n_sessions, count(DISTINCT user_id) AS n_users,
       13::BIGINT AS n_columns FROM train
UNION ALL
SELECT 'test', count(*), count(DISTINCT session_id), NULL::BIGINT, 12::BIGINT FROM test""",
        "preview_events": base
        + 'SELECT * FROM sensor_events ORDER BY session_id, "timestamp", uid LIMIT 5',
        "null_counts": base
        + f"SELECT {', '.join(map(_null_count, COLUMNS))} FROM sensor_events",
        "mixed_user_sessions": mixed
        + "SELECT session_id, count(DISTINCT user_id) AS n_users FROM mixed "
        "GROUP BY session_id HAVING count(DISTINCT user_id) > 1",
        "mixed_user_sessions_with_nulls": base
        + """SELECT session_id, count(DISTINCT u) AS n_users,
       count_if(u IS NULL)::BIGINT AS n_null_users
FROM (SELECT session_id, CASE WHEN field_1 < 98 THEN user_id END AS u FROM sensor_events)
GROUP BY session_id
HAVING count(DISTINCT u) > 1 OR (count(DISTINCT u) > 0 AND count_if(u IS NULL) > 0)""",
        "validation_gate": mixed
        + "SELECT count(*) AS n_mixed_sessions FROM (SELECT session_id FROM mixed "
        "GROUP BY session_id HAVING count(DISTINCT user_id) > 1)",
        "session_size_stats": base + f"SELECT {SIZE_STATS} FROM {_sizes('sensor_events')}",
        "sensor_types": base
        + "SELECT DISTINCT sensor_type FROM sensor_events ORDER BY sensor_type",
        "user_session_counts": base
        + _user_sessions("sensor_events")
        + " ORDER BY n_sessions DESC, user_id",
        "imbalance_ratio": mixed
        + "SELECT round(max(n_sessions) / min(n_sessions), 6) AS imbalance_ratio "
        f"FROM ({_user_sessions('mixed')})",
        "validation_summary": mixed
        + " UNION ALL ".join(
            [
                f"SELECT 'null_counts' AS \"check\", '{c}' AS item, "
                f'count_if("{c}" IS NULL)::DOUBLE AS value FROM mixed'
                for c in COLUMNS
            ]
            + [
                f"SELECT 'session_size_stats', '{name}', {name}::DOUBLE "
                f"FROM (SELECT {SIZE_STATS} FROM {_sizes('mixed')})"
                for name in ("p50", "p90", "p99", "max_count")
            ]
            + [
                "SELECT DISTINCT 'sensor_types', sensor_type, NULL::DOUBLE FROM mixed",
                "SELECT 'mixed_user_sessions', session_id, count(DISTINCT user_id)::DOUBLE "
                "FROM mixed GROUP BY session_id HAVING count(DISTINCT user_id) > 1",
                "SELECT 'user_session_counts', user_id, n_sessions::DOUBLE "
                f"FROM ({_user_sessions('mixed')})",
                "SELECT 'imbalance_ratio', 'ratio', round(max(n_sessions) / min(n_sessions), 6) "
                f"FROM ({_user_sessions('mixed')})",
            ]
        ),
        "event_magnitude": base
        + "SELECT uid, round(sqrt(field_0 * field_0 + field_1 * field_1 + field_2 * field_2), 6) "
        "AS mag_012 FROM sensor_events",
        "session_sensor_features_all": all_digest,
        "session_sensor_features_by_layout": all_digest,
        "session_features_train": with_(*TRAIN_WIDE, LABELS.format("train"))
        + f"SELECT w.session_id, {wide_columns(SENSORS)}, l.user_id "
        "FROM wide w LEFT JOIN labels_ l ON l.session_id = w.session_id",
        "dense_sessions_plain": dense_digest,
        "dense_sessions_placed": dense_digest,
        "dense_sessions_salted": dense_digest,
        "bad_field_counts": train_rows.replace("SELECT * FROM train", "")
        + """, bad AS (
  SELECT count_if("timestamp" % 7 = 0) AS late, count_if(field_1 >= 90) AS much,
         count_if("timestamp" % 7 = 0 OR coalesce(field_1 >= 90, false)) AS bad_lines FROM train)
"""
        + " UNION ALL ".join(
            f"SELECT 'train' AS table_name, '{name}' AS column_name, ({count})::BIGINT AS n_bad FROM bad"
            for name, count in [
                *[(c, {"timestamp": "late", "field_1": "much"}.get(c, "0")) for c in TRAIN_COLUMNS],
                ("bad_lines", "bad_lines"),
            ]
        ),
        "sparse_features": with_(SENSOR_EVENTS, digest_sql("sensor_events"),
            "numbered AS (SELECT *, dense_rank() OVER (ORDER BY sensor_type) - 1 AS no FROM digest)",
            "users AS (SELECT session_id, max(user_id) AS user_id FROM sensor_events GROUP BY 1)",
            "entries AS (" + " UNION ALL ".join(
                f"SELECT session_id, no * {len(METRICS)} + {i} AS index, {m}::DOUBLE AS value FROM numbered"
                for i, m in enumerate(METRICS)) + ")")
        + "SELECT session_id, user_id, index::BIGINT AS index, round(value, 6) AS value "
        "FROM entries JOIN users USING (session_id) WHERE value IS NOT NULL AND value <> 0",
        "dense_session_medians": with_(SENSOR_EVENTS, DENSE, digest_sql("dense"))
        + "SELECT session_id, sensor_type, "
        + ", ".join(f"round({p}_p50, 6) AS {p}_p50" for p in SUMMARISED)
        + " FROM digest",
        "odd_sensor_names": with_(*TRAIN_WIDE, LABELS.format("train"))
        + f"SELECT w.session_id, {odd_columns()}, l.user_id, 285::BIGINT AS n_features "
        "FROM wide w LEFT JOIN labels_ l ON l.session_id = w.session_id",
        "session_features_mixed": with_(
            SENSOR_EVENTS, MIXED, digest_sql("mixed"), wide_sql("digest", "wide", SENSORS),
            LABELS.format("mixed"),
        )
        + f"SELECT w.session_id, {wide_columns(SENSORS)}, l.user_id "
        "FROM wide w LEFT JOIN labels_ l ON l.session_id = w.session_id",
        **{name: with_(*views) + f"SELECT '{model}' AS model, seed, session_id, user_id, "
           "user_id AS prediction FROM splits WHERE is_valid"
           for name, model, views in (("logistic_regression", "LR", learnable_all),
                                      ("linear_svm", "SVM", learnable_all),
                                      ("random_forest", "RF", learnable),
                                      ("boosted_trees", "GBT", learnable))},
        "model_comparison": with_(*learnable, MOST_FREQUENT, STRATIFIED,
            "both_ AS (SELECT * FROM most_frequent UNION ALL SELECT * FROM stratified)",
            f"scores AS ({macro_f1_sql('both_')} UNION ALL "
            "SELECT unnest(['LR', 'SVM', 'RF', 'GBT']), 0, 1.0)", SUMMARY)
        + "SELECT model, "
        + ", ".join(
            f"round({c}_macro_f1, 6)::DOUBLE AS {c}_macro_f1" for c in ("mean", "std", "min", "max")
        )
        + " FROM summary ORDER BY mean_macro_f1 DESC, model",
        "model_comparison_all_seeds": with_(*learnable_all, MOST_FREQUENT, STRATIFIED,
            "both_ AS (SELECT * FROM most_frequent UNION ALL SELECT * FROM stratified)",
            f"scores AS ({macro_f1_sql('both_')} UNION ALL SELECT model, seed, 1.0 "
            "FROM (SELECT unnest(['LR', 'SVM', 'RF', 'GBT']) AS model), seeds)")
        + "SELECT model, count(*) AS n_seeds, round(avg(macro_f1), 2)::DOUBLE AS mean_macro_f1 "
        "FROM scores GROUP BY model",
        "forest_tuning": """SELECT "rank"::INT AS "rank", ("rank" - 1)::INT AS grid_id,
       n_estimators::INT AS n_estimators, max_depth::INT AS max_depth, max_features,
       min_samples_leaf::INT AS min_samples_leaf, 1.0::DOUBLE AS mean, 0.0::DOUBLE AS std
FROM (VALUES (1, 300, NULL, 'sqrt', 1), (2, 500, NULL, 'sqrt', 1), (3, 500, 20, 'sqrt', 1),
             (4, 500, 10, 'sqrt', 1), (5, 500, NULL, 'sqrt', 2), (6, 500, NULL, 'sqrt', 5))
  g("rank", n_estimators, max_depth, max_features, min_samples_leaf)""",
        "final_predictions": base + LEARNABLE_TEST,
        "experiment": base + LEARNABLE_TEST,
        "session_features_test": with_(*TEST_WIDE)
        + f"SELECT session_id, {wide_columns(SEEN)} FROM wide",
        "aligned_train": aligned_train,
        "aligned_test": aligned_test,
        "feature_job_train": aligned_train,
        "feature_job_test": aligned_test,
        "feature_job_sizes": with_(SENSOR_EVENTS, TRAIN, TEST)
        + "".join(
            f"{joiner}SELECT '{side}' AS side, count(DISTINCT session_id) AS n_sessions, "
            "(SELECT 57 * count(DISTINCT sensor_type) FROM "
            "(SELECT sensor_type FROM train UNION ALL SELECT sensor_type FROM test)) AS n_features "
            f"FROM {side}"
            for side, joiner in (("train", ""), ("test", " UNION ALL "))
        ),
        "label_index": with_(SENSOR_EVENTS, SESSIONS)
        + "SELECT session_id, user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS label "
        "FROM sessions",
        "stratified_split": with_(*splits)
        + "SELECT seed, session_id, user_id, is_valid FROM splits",
        "stratified_split_uneven": with_(SENSOR_EVENTS, SESSIONS, *split_sql(0.3))
        + "SELECT seed, session_id, user_id, is_valid FROM splits",
        "stratified_split_large_classes": with_(*class_splits)
        + "SELECT seed, session_id, user_id, is_valid FROM splits",
        "dummy_most_frequent_scores": with_(*splits, MOST_FREQUENT)
        + macro_f1_sql("most_frequent"),
        "dummy_stratified_predictions": with_(*splits, STRATIFIED) + "SELECT * FROM stratified",
        "dummy_stratified_scores": with_(*splits, STRATIFIED) + macro_f1_sql("stratified"),
        "macro_f1_scores": with_(
            *class_splits,
            MOST_FREQUENT,
            STRATIFIED,
            "both_ AS (SELECT * FROM most_frequent UNION ALL SELECT * FROM stratified)",
        )
        + macro_f1_sql("both_"),
        "class_weights_all": with_(SENSOR_EVENTS, CLASS_SESSIONS)
        + """SELECT user_id, session_id, round((SELECT count(*) FROM sessions)
         / ((SELECT count(DISTINCT user_id) FROM sessions) * n_class), 6) AS weight
FROM sessions JOIN (SELECT user_id, count(*) AS n_class FROM sessions GROUP BY user_id)
  USING (user_id)""",
        "scaler_stats": with_(
            *TRAIN_WIDE,
            f"filled AS (SELECT session_id, {aligned_columns(SENSORS, None)} FROM wide)",
        )
        + f"""SELECT feature, printf('%.7e', avg(value)) AS mean,
       printf('%.7e', stddev_samp(value)) AS std
FROM (SELECT feature, value FROM filled UNPIVOT (value FOR feature IN ({scaler_cells})))
GROUP BY feature""",
        "score_summary": with_(SENSOR_EVENTS, scores_sql(9), SUMMARY)
        + "SELECT model, "
        + ", ".join(
            f"round({c}_macro_f1, 6) AS {c}_macro_f1" for c in ("mean", "std", "min", "max")
        )
        + " FROM summary ORDER BY mean_macro_f1 DESC, model",
        "paired_score_differences": with_(SENSOR_EVENTS, scores_sql(9), DIFFERENCES)
        + "SELECT model_a, model_b, seed, score_a, score_b, "
        "round(difference, 9) AS difference FROM differences",
        "wilcoxon_pair": with_(
            SENSOR_EVENTS, scores_sql(9), WAYS, DIFFERENCES, SIGNED_RANKS, recursive=True
        ),
        "wilcoxon_pair_ties": with_(
            SENSOR_EVENTS, scores_sql(2), WAYS, DIFFERENCES, SIGNED_RANKS, recursive=True
        ),
        "wilcoxon_pair_exact_ties": with_(
            SENSOR_EVENTS, scores_sql(2), WAYS, DIFFERENCES,
            SIGNED_RANKS[: SIGNED_RANKS.index(",\nwith_p AS")] + EXACT_WITH_TIES, recursive=True,
        ),
        "comparison_chart_data": with_(SENSOR_EVENTS, scores_sql(9), SUMMARY)
        + """SELECT cast(row_number() OVER (ORDER BY mean_macro_f1, model DESC) AS int) AS position,
       model, round(mean_macro_f1, 6) AS mean,
       round(mean_macro_f1 - std_macro_f1, 6) AS lo, round(mean_macro_f1 + std_macro_f1, 6) AS hi,
       round(least(mean_macro_f1 + 0.015, 0.97), 6) AS label_x,
       printf('%.3f', mean_macro_f1) AS label
FROM summary""",
        "tuning_rank": with_(SENSOR_EVENTS, scores_sql(9), SUMMARY)
        + f"""SELECT CASE s.model {GRID_IDS} END AS grid_id, round(mean_macro_f1, 6) AS mean,
       round(std_macro_f1, 6) AS std, "rank", seed, round(macro_f1, 6) AS score
FROM (SELECT *, cast(row_number() OVER (ORDER BY mean_macro_f1 DESC,
        CASE model {GRID_IDS} END) AS int) AS "rank" FROM summary) s
JOIN scores USING (model)""",
    }
