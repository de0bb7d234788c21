"""Splits, folds, fitting and calibration (SURVEY sections I and J)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from formbook.catalog.features import KEYS, features_of
from formbook.catalog.ranking import METRIC_NAMES, METRIC_SELECT, metrics_sql, scored_frame, scored_of
from formbook.catalog.registry import query, r6
from formbook.catalog.sqltext import sql
from formbook.plans import contest, metrics as M, models as L, splits as I
from formbook.schemas import FEATURE_CLASSES, active_features
from formbook.session import staged

# Strategies over the contest seasons 1995-2001.
SPLITS = (
    I.Split("plain", (1995, 1998), (1999, 1999), (2000, 2001)),
    I.era_split(("all", 1995, 2001)),
    I.rolling_split(2000, train=3),
)
STRATEGY_SQL = """strategies(strategy, role, lo, hi) AS (VALUES ('plain', 'train', 1995, 1998), ('plain', 'val', 1999, 1999), ('plain', 'test', 2000, 2001),
  ('all_within_era', 'train', 1995, 1999), ('all_within_era', 'val', 2000, 2000), ('all_within_era', 'test', 2001, 2001),
  ('rolling_3_1_1_test2000', 'train', 1996, 1998), ('rolling_3_1_1_test2000', 'val', 1999, 1999), ('rolling_3_1_1_test2000', 'test', 2000, 2000))"""


@query(
    "i1_split_labels",
    sql(
        """SELECT event_id, entity_id, CASE WHEN season <= 1998 THEN 'train' WHEN season = 1999 THEN 'val' ELSE 'test' END AS role FROM contest
        WHERE season BETWEEN 1995 AND 2001""",
        "contest",
    ),
)
def i1(spark, folder):
    return I.checked_split(contest.facts(spark, folder), SPLITS[0]).select(*KEYS, "role")


@query(
    "i2_all_strategies",
    sql(
        f"""WITH {STRATEGY_SQL} SELECT strategy, role, COUNT(DISTINCT event_id) AS events, COUNT(*) AS rows, CAST(SUM(winner) AS BIGINT) AS winners
        FROM contest JOIN strategies ON season BETWEEN lo AND hi GROUP BY strategy, role""",
        "contest",
    ),
)
def i2(spark, folder):
    out = I.split_sizes(contest.facts(spark, folder), SPLITS)
    return out.select("strategy", "role", "events", "rows", "winners")


@query(
    "e30_split_balance",
    sql(
        f"""WITH {STRATEGY_SQL} SELECT role, COUNT(*) AS rows, round(1.0 * SUM(winner) / COUNT(*), 6) AS win_rate, round(1.0 * (COUNT(*) - SUM(winner)) / SUM(winner), 6) AS negatives_per_positive
        FROM contest JOIN strategies ON season BETWEEN lo AND hi WHERE strategy = 'plain' GROUP BY role""",
        "contest",
    ),
)
def e30(spark, folder):
    out = I.split_sizes(contest.facts(spark, folder), SPLITS[:1])
    return out.select("role", "rows", r6("win_rate"), r6("negatives_per_positive"))


@query(
    "i5_expanding_folds",
    sql(
        """WITH folds(fold, val_season) AS (VALUES (1, 1997), (2, 1998), (3, 1999))
        SELECT fold, val_season, event_id, entity_id, CASE WHEN season = val_season THEN 'val' ELSE 'train' END AS role
        FROM contest JOIN folds ON season <= val_season WHERE season <= 1999""",
        "contest",
    ),
)
def i5(spark, folder):
    train = contest.facts(spark, folder).where("season <= 1999")
    out = I.label_folds(train, 3, window=(1995, 1999))
    return out.select("fold", "val_season", *KEYS, "role")


@query(
    "j2_class_weights",
    sql(
        """SELECT COUNT(*) AS n, CAST(SUM(winner) AS BIGINT) AS positives, round((COUNT(*) - SUM(winner)) / SUM(winner), 6) AS pos_weight,
        round(COUNT(*) / (2.0 * (COUNT(*) - SUM(winner))), 6) AS weight_0, round(COUNT(*) / (2.0 * SUM(winner)), 6) AS weight_1 FROM contest""",
        "contest",
    ),
)
def j2(spark, folder):
    out = L.class_balance(contest.facts(spark, folder))
    return out.select("n", "positives", r6("pos_weight"), r6("weight_0"), r6("weight_1"))


@query(
    "j3_exact_medians",
    sql(
        """SELECT 'grid' AS feature, median(grid) AS median FROM contest UNION ALL SELECT 'position', median(position) FROM contest
        UNION ALL SELECT 'temp', median(temp) FROM contest UNION ALL SELECT 'finish_order', median(finish_order) FROM contest""",
        "contest",
    ),
)
def j3(spark, folder):
    return L.exact_medians(contest.facts(spark, folder), ["grid", "position", "temp", "finish_order"])


@query(
    "j3_imputed_and_flagged",
    sql(
        """SELECT event_id, entity_id, COALESCE(temp, (SELECT median(temp) FROM contest WHERE season <= 1998)) AS temp, CASE WHEN temp IS NULL THEN 1.0 ELSE 0.0 END AS temp_missing,
        CAST(grid AS DOUBLE) AS grid FROM contest""",
        "contest",
    ),
)
def j3_imputed(spark, folder):
    df = contest.facts(spark, folder)
    pre = L.fit_preprocess(df.where("season <= 1998"), ["temp", "grid"], scale=False)
    return df.select(*KEYS, *[v.alias(n) for n, v in pre.expressions().items()])


@query(
    "j4_population_scaling",
    sql(
        """WITH st AS (SELECT AVG(grid) AS m, stddev_pop(grid) AS s FROM contest WHERE season <= 1998)
        SELECT event_id, entity_id, round((grid - m) / s, 6) AS grid FROM contest, st""",
        "contest",
    ),
)
def j4(spark, folder):
    df = contest.facts(spark, folder)
    pre = L.fit_preprocess(df.where("season <= 1998"), ["grid"], scale=True)
    return df.select(*KEYS, r6(pre.expressions()["grid"], "grid"))


def learning_frame(spark, folder):
    """The feature table with outcome order, staged once per session."""

    def build():
        order = contest.facts(spark, folder).select(*KEYS, "finish_order")
        return features_of(spark, folder).join(order, list(KEYS))

    return staged(spark, ("features", folder), build, ("season",)).withColumn(
        "season", F.col("season").cast("long")
    )


COLUMNS = active_features()


def with_checks(scored, *columns):
    """What SQL can check of a fit's scores: their rows, that all are probabilities,
    and that they tell rows apart."""
    spread = scored.agg(F.count_distinct("p") > 1).scalar()
    inside = F.coalesce(F.col("p").between(0, 1), F.lit(False))
    return scored.select(*columns, inside.alias("p_in_unit"), spread.alias("p_varies"))


def scores_sql(columns: str, where: str) -> str:
    return sql(f"SELECT {columns}, TRUE AS p_in_unit, TRUE AS p_varies FROM contest WHERE {where}", "contest")


def in_unit(*names: str):
    """Are all of these metrics known and between 0 and 1?"""
    parts = [F.coalesce(F.col(n).between(0, 1), F.lit(False)) for n in names]
    return reduce(lambda a, b: a & b, parts).alias("metrics_in_unit")


UNIT_METRICS = ("top1_accuracy", "top3_recall", "winner_mrr", "brier_score", "ece")
LATE = scores_sql("event_id, entity_id", "season > 1999")


@query("j5_logistic_regression", LATE)
def j5(spark, folder):
    df = learning_frame(spark, folder)
    model = L.fit("logreg", df.where("season <= 1999"), COLUMNS)
    return with_checks(model.score(df.where("season > 1999")), *KEYS)


@query("j6_random_forest", LATE)
def j6(spark, folder):
    df = learning_frame(spark, folder)
    params = {"numTrees": 20, "maxDepth": 8}
    model = L.fit("random_forest", df.where("season <= 1999"), COLUMNS, params=params)
    return with_checks(model.score(df.where("season > 1999")), *KEYS)


@query("j7_boosted_trees", LATE)
def j7(spark, folder):
    df = learning_frame(spark, folder)
    params = {"maxIter": 10, "maxDepth": 4}
    model = L.fit("boosted_trees", df.where("season <= 1999"), COLUMNS, params=params)
    return with_checks(model.score(df.where("season > 1999")), *KEYS)


# Every fold that five seasons allow.
FOLDS = 4


@query(
    "j8_cross_validation",
    sql(
        """SELECT CAST(DENSE_RANK() OVER (ORDER BY season) AS INTEGER) AS fold, season AS val_season, COUNT(DISTINCT event_id) AS n_events,
        COUNT(*) AS n_rows, TRUE AS metrics_in_unit FROM contest WHERE season BETWEEN 1996 AND 1999 GROUP BY season""",
        "contest",
    ),
)
def j8(spark, folder):
    train = learning_frame(spark, folder).where("season <= 1999")
    out = L.cross_validate(train, "logreg", COLUMNS, FOLDS)
    return out.select("fold", "val_season", "n_events", "n_rows", in_unit(*UNIT_METRICS))


@query(
    "j9_fold_summary",
    sql(
        f"WITH {metrics_sql('scored', 'season')} "
        + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, round(AVG({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std FROM metric"
            for m in METRIC_NAMES
        ),
        "scored",
    ),
)
def j9(spark, folder):
    # Seasons stand in for folds: each was scored without a fit on itself.
    folds = M.metrics(scored_frame(scored_of(spark, folder), "event_id", "season"), ["season"])
    return L.fold_summary(folds).select("metric", r6("mean"), r6("std"))


# Draws of a registered search; every draw meets every fold.
DRAWS = 8


@query(
    "j10_random_search",
    sql(
        f"""SELECT config, TRUE AS metrics_in_unit, CAST(1 AS BIGINT) AS best_configs, CAST({FOLDS} AS BIGINT) AS folds, events
        FROM (SELECT CAST(unnest(range({DRAWS})) AS INTEGER) AS config), (SELECT COUNT(DISTINCT event_id) AS events FROM contest WHERE season BETWEEN 1996 AND 1999)""",
        "contest",
    ),
)
def j10(spark, folder):
    train = learning_frame(spark, folder).where("season <= 1999")
    out = L.search(train, "logreg", COLUMNS, FOLDS, DRAWS)
    best = out.agg(F.count_if("best")).scalar()
    return out.select(
        F.col("config").cast("int").alias("config"), in_unit("top1"), best.alias("best_configs"), "folds", "events"
    )


@query(
    "j10_halving_search",
    sql(
        f"""WITH per_season AS (SELECT season, COUNT(DISTINCT event_id) AS n, ROW_NUMBER() OVER (ORDER BY season) AS fold
          FROM contest WHERE season BETWEEN 1996 AND 1999 GROUP BY season),
        kept AS (SELECT fold, n, CASE fold WHEN 1 THEN {DRAWS} WHEN 2 THEN {DRAWS // 2} WHEN 3 THEN {DRAWS // 4} ELSE {DRAWS // 8} END AS draws FROM per_season)
        SELECT fold AS folds, draws - COALESCE(LEAD(draws) OVER (ORDER BY fold), 0) AS configs,
          CAST(SUM(n) OVER (ORDER BY fold) AS BIGINT) AS events, CASE WHEN fold = {FOLDS} THEN 1 ELSE 0 END AS best_configs FROM kept""",
        "contest",
    ),
)
def j10_halving(spark, folder):
    # Eight draws meet the first fold, four the second, two the third, one the last.
    train = learning_frame(spark, folder).where("season <= 1999")
    out = L.search(train, "logreg", COLUMNS, FOLDS, DRAWS, halving=2)
    return out.groupBy("folds").agg(
        F.count(F.lit(1)).alias("configs"), F.max("events").alias("events"), F.count_if("best").alias("best_configs")
    )


@query("j12_out_of_fold", scores_sql("event_id, entity_id, season, winner", "season BETWEEN 1996 AND 1999"))
def j12(spark, folder):
    train = learning_frame(spark, folder).where("season <= 1999")
    return with_checks(L.out_of_fold(train, "logreg", COLUMNS, FOLDS), *KEYS, "season", "winner")


@query("j13_isotonic_calibration", LATE)
def j13(spark, folder):
    df = learning_frame(spark, folder)
    model = L.fit_calibrated(df.where("season <= 1999"), "logreg", COLUMNS, 2)
    return with_checks(model.score(df.where("season > 1999")), *KEYS)


@query(
    "j25_native_importance",
    "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{FEATURE_CLASSES[c]}', TRUE)" for c in COLUMNS) + ") AS t(feature, class, has_importance)",
)
def j25(spark, folder):
    df = learning_frame(spark, folder).where("season <= 1999")
    out = L.importance(spark, L.fit("logreg", df, COLUMNS), FEATURE_CLASSES)
    # Which missing flags there are depends on the fit's rows; features are known.
    known = F.coalesce(F.col("importance") >= 0, F.lit(False)).alias("has_importance")
    return out.where(~F.col("is_missing_flag")).select("feature", "class", known)


@query(
    "j26_permutation_importance",
    sql(
        "SELECT feature, 5 AS repeats, n_events, TRUE AS drop_in_unit FROM (VALUES "
        + ", ".join(f"('{c}')" for c in COLUMNS)
        + ") AS t(feature), (SELECT COUNT(DISTINCT event_id) AS n_events FROM contest WHERE season > 1999)",
        "contest",
    ),
)
def j26(spark, folder):
    # Every column of the model, on seasons that it was not fitted on.
    df = learning_frame(spark, folder)
    model = L.fit("logreg", df.where("season <= 1999"), COLUMNS)
    late = df.where("season > 1999").select("event_id", "entity_id", "winner", *COLUMNS)
    out = L.permutation_importance(model.score, late, COLUMNS)
    inside = F.coalesce(F.abs("top1_drop_mean") <= 1, F.lit(False))
    return out.select("feature", F.col("repeats").cast("int").alias("repeats"), "n_events", inside.alias("drop_in_unit"))


WEIGHTS = {"grid": -1.5, "quali_position": -0.5, "points": 0.25, "finished": 2.0}


@query(
    "j27_linear_contributions",
    sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS feature, round(AVG(abs({w} * ({c} - m))), 6) AS mean_abs FROM contest, (SELECT AVG({c}) AS m FROM contest)"
            for c, w in WEIGHTS.items()
        ),
        "contest",
    ),
)
def j27(spark, folder):
    out = L.linear_contributions(contest.facts(spark, folder), WEIGHTS)
    return out.select("feature", r6("mean_abs"))


@query(
    "j28_case_studies",
    sql(
        """WITH w AS (SELECT * FROM scored WHERE winner = 1)
        SELECT 'winner_highest_confidence' AS label, event_id, entity_id, round(p, 6) AS p FROM (SELECT * FROM w ORDER BY p DESC, event_id LIMIT 1)
        UNION ALL SELECT 'winner_lowest_confidence', event_id, entity_id, round(p, 6) FROM (SELECT * FROM w ORDER BY p, event_id LIMIT 1)
        UNION ALL SELECT 'season_opener', event_id, entity_id, round(p, 6) FROM (SELECT * FROM w WHERE season = 1999 ORDER BY round LIMIT 1)""",
        "scored",
    ),
)
def j28(spark, folder):
    out = L.case_studies(scored_of(spark, folder), 1999)
    return out.select("label", "event_id", "entity_id", r6("p"))


@query(
    "j29_stage_fit",
    sql(
        "SELECT COUNT(DISTINCT event_id) AS n_events, COUNT(*) AS n_rows, TRUE AS metrics_in_unit FROM contest WHERE season = 1999",
        "contest",
    ),
)
def j29(spark, folder):
    df = I.checked_split(learning_frame(spark, folder), SPLITS[0])
    _, table = L.fit_for_stage(df, "production", "logreg", COLUMNS)
    return table.select("n_events", "n_rows", in_unit(*UNIT_METRICS))


@query(
    "j30_one_time_test",
    sql(
        "WITH test_rows AS (SELECT * FROM pole_scored WHERE season >= 2000), raw_rows AS (SELECT * REPLACE (CAST(p_raw AS DOUBLE) AS p) FROM test_rows), "
        f"{metrics_sql('raw_rows', '1')} SELECT {METRIC_SELECT} FROM metric",
        "pole_scored",
    ),
)
def j30(spark, folder):
    df = I.checked_split(learning_frame(spark, folder), SPLITS[0])
    out = L.score_test_once(df, "pole_baseline", COLUMNS)
    return out.select(*[r6(m) for m in METRIC_NAMES], "n_events", "n_rows")
