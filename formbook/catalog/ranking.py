"""Shares, ranks and metrics of scored events (F15-F23, J1, J14-J23)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from formbook.catalog.features import KEYS, pick
from formbook.catalog.registry import query, r6
from formbook.catalog.sqltext import sql
from formbook.functions import scalars as S
from formbook.operators.dedup import keep_best
from formbook.operators.frames import Prior, prior_frames
from formbook.operators.hot import average_rank
from formbook.operators.joins import checked_join, join_back
from formbook.plans import contest, metrics as M, scoring
from formbook.plans.features import CONTEST
from formbook.session import staged
from formbook.sources.tables import table


def scored_of(spark, folder):
    """Contest rows scored by 1 / qualifying position, staged once."""
    return _scored(spark, folder, "scored", 1.0 / F.col("quali_position"))


def pole_of(spark, folder):
    """Contest rows scored by the pole rule, staged once."""
    return _scored(spark, folder, "pole-scored", scoring.pole_probability(F.col("grid")))


def _scored(spark, folder, name, raw):
    def build():
        facts = contest.facts(spark, folder).withColumn("p_raw", raw)
        return scoring.ranked_by_share(scoring.with_share(facts, "p_raw", "p"), "p")

    return staged(spark, (name, folder), build, ("season",)).withColumn("season", F.col("season").cast("long"))


def scored_frame(df, *keys):
    return M.as_scored(df, "p", "winner", "finish_order", *(keys or ("event_id",)))


@query(
    "f15_centred_mean",
    sql(
        """WITH yearly AS (SELECT season, AVG(CASE WHEN grid = 1 THEN winner END) * 100 AS conversion FROM contest GROUP BY season)
        SELECT season, round(conversion, 6) AS conversion,
        round(CASE WHEN COUNT(conversion) OVER w >= 3 THEN AVG(conversion) OVER w END, 6) AS rolling
        FROM yearly WINDOW w AS (ORDER BY season ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
        "contest",
    ),
)
def f15(spark, folder):
    from formbook.plans.analytics import centred_mean

    yearly = contest.facts(spark, folder).groupBy("season").agg(
        (F.avg(F.when(F.col("grid") == 1, F.col("winner"))) * 100).alias("conversion")
    )
    out = centred_mean(yearly, "season", "conversion", "rolling")
    return out.select("season", r6("conversion"), r6("rolling"))


@query(
    "f16_expanding_hit_rate",
    sql(
        """WITH hits AS (SELECT season, round, event_id, MAX(CASE WHEN predicted_rank = 1 THEN winner END) AS hit FROM scored GROUP BY ALL)
        SELECT season, round, hit, round(AVG(hit) OVER (PARTITION BY season ORDER BY round), 6) AS cumulative FROM hits""",
        "scored",
    ),
)
def f16(spark, folder):
    hits = scored_of(spark, folder).groupBy("season", "round", "event_id").agg(
        F.max(F.when(F.col("predicted_rank") == 1, F.col("winner"))).alias("hit")
    )
    so_far = Window.partitionBy("season").orderBy("round")
    rate = F.avg("hit").over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("cumulative", rate).select("season", "round", "hit", r6("cumulative"))


@query(
    "f17_event_share",
    sql("SELECT event_id, entity_id, round(p, 6) AS p FROM scored", "scored"),
)
def f17(spark, folder):
    facts = contest.facts(spark, folder).withColumn("p_raw", 1.0 / F.col("quali_position"))
    return pick(scoring.with_share(facts, "p_raw", "p"), "p")


@query(
    "f18_deterministic_rank",
    sql("SELECT event_id, entity_id, predicted_rank FROM pole_scored", "pole_scored"),
)
def f18(spark, folder):
    return pick(pole_of(spark, folder), "predicted_rank")


@query(
    "f19_pessimistic_rank",
    sql(
        """SELECT event_id, COUNT(CASE WHEN p >= pw THEN 1 END) AS winner_rank FROM (
        SELECT *, MAX(CASE WHEN winner = 1 THEN p END) OVER (PARTITION BY event_id) AS pw FROM pole_scored) GROUP BY event_id""",
        "pole_scored",
    ),
)
def f19(spark, folder):
    table_ = M.per_event_metrics(scored_frame(pole_of(spark, folder)).drop("order"))
    return table_.select("event_id", "winner_rank")


@query(
    "f20_average_tie_rank",
    sql(
        """SELECT event_id, entity_id, RANK() OVER (PARTITION BY event_id ORDER BY points)
        + (COUNT(*) OVER (PARTITION BY event_id, points) - 1) / 2.0 AS tie_rank FROM contest""",
        "contest",
    ),
)
def f20(spark, folder):
    df = average_rank(
        contest.facts(spark, folder).select(*KEYS, "points"), ["event_id"], "points", "tie_rank"
    )
    return pick(df, "tie_rank")


@query(
    "f21_priority_dedup",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
    l_returnflag, l_linestatus FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber
    ORDER BY CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END DESC, l_shipdate DESC, l_partkey DESC, l_suppkey DESC,
    l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC) AS rn FROM lineitem) WHERE rn = 1""",
)
def f21(spark, folder):
    lines = table(spark, folder, "lineitem")
    best = keep_best(
        lines,
        ["l_orderkey", "l_linenumber"],
        [
            (F.col("l_linestatus") == "F").cast("int"),
            *[
                F.col(c)
                for c in (
                    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag",
                )
            ],
        ],
    )
    return best.drop("l_shipdate")


@query(
    "f22_recent_form_of_favourite",
    sql(
        """WITH form AS (SELECT *, AVG(p) OVER (PARTITION BY season, entity_id ORDER BY round ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM scored),
        team AS (SELECT season, round, group_id, SUM(p) AS s, COUNT(*) AS n FROM scored GROUP BY ALL),
        prior_team AS (SELECT season, round, group_id, (SUM(s) OVER w) / (SUM(n) OVER w) AS team_mean FROM team
          WINDOW w AS (PARTITION BY season, group_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_id, entity_id, round(recent, 6) AS recent, round(team_mean, 6) AS team_mean
        FROM form JOIN prior_team USING (season, round, group_id) WHERE predicted_rank = 1""",
        "scored",
    ),
)
def f22(spark, folder):
    df = favourite_form(scored_of(spark, folder))
    return df.where("predicted_rank = 1").select(*KEYS, r6("recent"), r6("team_mean"))


def favourite_form(scored):
    """Mean share over the last three rounds, and of the group so far, per row."""
    order = [("round", True), ("event_id", True)]
    own = prior_frames(
        scored, ["season", "entity_id"], order, [Prior("recent", F.col("p"), "avg", 3)]
    )
    per_round = scored.groupBy("season", "group_id", "event_id", "round").agg(
        F.sum("p").alias("s"), F.count(F.lit(1)).alias("n")
    )
    sums = prior_frames(
        per_round,
        ["season", "group_id"],
        order,
        [Prior("_s", F.col("s"), "sum"), Prior("_n", F.col("n"), "sum")],
    )
    team = sums.select("event_id", "group_id", F.try_divide("_s", "_n").alias("team_mean"))
    return checked_join(own, team, ["event_id", "group_id"])


@query(
    "f23_gap_to_runner_up",
    sql(
        """SELECT event_id, round(MAX(CASE WHEN predicted_rank = 1 THEN p END) - MAX(CASE WHEN predicted_rank = 2 THEN p END), 6) AS gap
        FROM scored GROUP BY event_id""",
        "scored",
    ),
)
def f23(spark, folder):
    return runner_up_gap(scored_of(spark, folder)).select("event_id", r6("gap"))


def runner_up_gap(scored):
    """Share of the first minus share of the second; only two rows per event matter."""
    place = F.col("predicted_rank")
    return (
        scored.where(place <= 2)
        .groupBy("event_id")
        .agg(
            (F.max(F.when(place == 1, F.col("p"))) - F.max(F.when(place == 2, F.col("p")))).alias(
                "gap"
            )
        )
    )


@query(
    "f24_last_known_label",
    sql(
        """SELECT entity_id, arg_max(position_text, season * 100 + round) FILTER (WHERE position_text IS NOT NULL) AS last_text,
        arg_max(group_id, season * 100 + round) AS last_group FROM contest GROUP BY entity_id""",
        "contest",
    ),
)
def f24(spark, folder):
    from formbook.operators.dedup import last_known

    return last_known(
        contest.facts(spark, folder),
        ["entity_id"],
        ["season", "round"],
        {"position_text": "last_text", "group_id": "last_group"},
    )


@query(
    "j1_pole_rule",
    sql("SELECT event_id, entity_id, CAST(p_raw AS DOUBLE) AS p FROM pole_scored", "pole_scored"),
)
def j1(spark, folder):
    df = contest.facts(spark, folder).withColumn("p", scoring.pole_probability(F.col("grid")))
    return pick(df, "p")


@query(
    "j14_batch_scoring",
    sql(
        """SELECT event_id, entity_id, group_id, season, round, CAST(p_raw AS DOUBLE) AS win_probability_raw,
        round(p, 6) AS win_probability, predicted_rank FROM pole_scored""",
        "pole_scored",
    ),
)
def j14(spark, folder):
    df = scoring.score(contest.facts(spark, folder), scoring.pole_probability(F.col("grid")))
    return df.select(
        *KEYS, "group_id", "season", "round", "win_probability_raw", r6("win_probability"),
        "predicted_rank",
    )


def per_event_sql(source):
    """CTE text ``pe``: the per-event metric table of a scored CTE."""
    return f"""marked AS (SELECT *, MAX(CASE WHEN winner = 1 THEN p END) OVER (PARTITION BY event_id) AS pw,
      RANK() OVER (PARTITION BY event_id ORDER BY p DESC) + (COUNT(*) OVER (PARTITION BY event_id, p) - 1) / 2.0 AS ra,
      RANK() OVER (PARTITION BY event_id ORDER BY finish_order) + (COUNT(*) OVER (PARTITION BY event_id, finish_order) - 1) / 2.0 AS rb
      FROM {source}),
    pe0 AS (SELECT event_id, season, COUNT(*) AS n_entrants, MAX(pw) AS winner_prob, COUNT(CASE WHEN p >= pw THEN 1 END) AS winner_rank,
      MAX(p) AS max_prob, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS spearman_corr FROM marked GROUP BY event_id, season),
    pe AS (SELECT *, winner_rank = 1 AS top1_hit, winner_rank <= 3 AS top3_hit, 1.0 / winner_rank AS reciprocal_rank FROM pe0)"""


PER_EVENT_SELECT = """SELECT event_id, n_entrants, round(winner_prob, 6) AS winner_prob, winner_rank, round(max_prob, 6) AS max_prob,
  top1_hit, top3_hit, round(reciprocal_rank, 6) AS reciprocal_rank, round(spearman_corr, 6) AS spearman_corr FROM pe"""


@query("j15_per_event_table", sql(f"WITH {per_event_sql('scored')} {PER_EVENT_SELECT}", "scored"))
def j15(spark, folder):
    return _per_event(scored_of(spark, folder))


@query(
    "j15_per_event_table_ties",
    sql(f"WITH {per_event_sql('pole_scored')} {PER_EVENT_SELECT}", "pole_scored"),
)
def j15_ties(spark, folder):
    return _per_event(pole_of(spark, folder))


def _per_event(df):
    out = M.per_event_metrics(scored_frame(df))
    return out.select(
        "event_id", "n_entrants", r6("winner_prob"), "winner_rank", r6("max_prob"), "top1_hit",
        "top3_hit", r6("reciprocal_rank"), r6("spearman_corr"),
    )


@query(
    "j16_ranking_averages",
    sql(
        f"""WITH {per_event_sql('scored')} SELECT round(AVG(CAST(top1_hit AS INT)), 6) AS top1_accuracy,
        round(AVG(CAST(top3_hit AS INT)), 6) AS top3_recall, round(AVG(reciprocal_rank), 6) AS winner_mrr,
        round(AVG(winner_prob), 6) AS avg_winner_probability FROM pe""",
        "scored",
    ),
)
def j16(spark, folder):
    out = M.event_averages(M.per_event_metrics(scored_frame(scored_of(spark, folder)).drop("order")))
    return out.select(*[r6(c) for c in ("top1_accuracy", "top3_recall", "winner_mrr", "avg_winner_probability")])


@query(
    "j17_spearman",
    sql(
        f"WITH {per_event_sql('pole_scored')} SELECT event_id, round(spearman_corr, 6) AS spearman_corr FROM pe",
        "pole_scored",
    ),
)
def j17(spark, folder):
    out = M.spearman(scored_frame(pole_of(spark, folder)), ["event_id"])
    return out.select("event_id", r6("spearman_corr"))


@query(
    "j18_winner_rank_counts",
    sql(
        f"WITH {per_event_sql('scored')} SELECT winner_rank, COUNT(*) AS events FROM pe GROUP BY winner_rank",
        "scored",
    ),
)
def j18(spark, folder):
    table_ = M.per_event_metrics(scored_frame(scored_of(spark, folder)).drop("order"))
    return M.winner_rank_counts(table_)


LOSS_SQL = """AVG(-CASE WHEN winner = 1 THEN ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p)))
  ELSE ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p))) END)"""


@query(
    "j19_row_losses",
    sql(
        f"SELECT round({LOSS_SQL}, 6) AS log_loss, round(AVG(pow(p - winner, 2)), 6) AS brier_score, COUNT(*) AS n_rows FROM scored",
        "scored",
    ),
)
def j19(spark, folder):
    out = M.row_losses(scored_frame(scored_of(spark, folder)))
    return out.select(r6("log_loss"), r6("brier_score"), "n_rows")


BIN_SQL = (
    "CASE "
    + " ".join(f"WHEN p <= {i + 1} * CAST(0.1 AS DOUBLE) THEN {i}" for i in range(9))
    + " ELSE 9 END"
)


def calibration_sql(source, keys=""):
    return f"""cal AS (SELECT {keys} {BIN_SQL} AS bin, AVG(p) AS mean_predicted, AVG(winner) AS fraction_positive, COUNT(*) AS count
    FROM {source} GROUP BY ALL)"""


@query(
    "j20_calibration_table",
    sql(
        f"""WITH {calibration_sql('scored')} SELECT round(bin * 0.1, 6) AS bin_lower, round((bin + 1) * 0.1, 6) AS bin_upper,
        round(mean_predicted, 6) AS mean_predicted, round(fraction_positive, 6) AS fraction_positive, count FROM cal""",
        "scored",
    ),
)
def j20(spark, folder):
    out = M.calibration_table(scored_frame(scored_of(spark, folder)))
    return out.select(
        r6("bin_lower"), r6("bin_upper"), r6("mean_predicted"), r6("fraction_positive"), "count"
    )


@query(
    "j21_calibration_error",
    sql(
        f"""WITH {calibration_sql('scored')} SELECT round(SUM(count * abs(fraction_positive - mean_predicted)) / SUM(count), 6) AS ece FROM cal""",
        "scored",
    ),
)
def j21(spark, folder):
    out = M.ece(M.calibration_table(scored_frame(scored_of(spark, folder))))
    return out.select(r6("ece"))


METRIC_NAMES = (
    "top1_accuracy", "top3_recall", "winner_mrr", "avg_winner_probability", "median_winner_rank",
    "spearman_corr", "log_loss", "brier_score", "ece",
)


def metrics_sql(source, key):
    """Full metric rows of a scored CTE by ``key`` (a column or a constant)."""
    return f"""{per_event_sql(source)}, {calibration_sql(source, key + ' AS k,')},
    head AS (SELECT {key} AS k, AVG(CAST(top1_hit AS INT)) AS top1_accuracy, AVG(CAST(top3_hit AS INT)) AS top3_recall,
      AVG(reciprocal_rank) AS winner_mrr, AVG(winner_prob) AS avg_winner_probability, median(winner_rank) AS median_winner_rank,
      COUNT(*) AS n_events, AVG(spearman_corr) AS spearman_corr FROM pe GROUP BY ALL),
    losses AS (SELECT {key} AS k, {LOSS_SQL} AS log_loss, AVG(pow(p - winner, 2)) AS brier_score, COUNT(*) AS n_rows FROM {source} GROUP BY ALL),
    eces AS (SELECT k, SUM(count * abs(fraction_positive - mean_predicted)) / SUM(count) AS ece FROM cal GROUP BY k),
    metric AS (SELECT * FROM head JOIN losses USING (k) JOIN eces USING (k))"""


METRIC_SELECT = ", ".join(f"round({m}, 6) AS {m}" for m in METRIC_NAMES) + ", n_events, n_rows"


@query(
    "j22_metric_row",
    sql(
        f"WITH {metrics_sql('scored', '1')} SELECT {METRIC_SELECT}, top1_accuracy > 0.7 AS leakage_alarm FROM metric",
        "scored",
    ),
)
def j22(spark, folder):
    out = M.metrics(scored_frame(scored_of(spark, folder)))
    return out.select(*[r6(m) for m in METRIC_NAMES], "n_events", "n_rows", "leakage_alarm")


@query(
    "j23_metrics_by_season",
    sql(f"WITH {metrics_sql('scored', 'season')} SELECT k AS season, {METRIC_SELECT} FROM metric", "scored"),
)
def j23(spark, folder):
    out = M.metrics_by_season(scored_frame(scored_of(spark, folder), "event_id", "season"))
    return out.select("season", *[r6(m) for m in METRIC_NAMES], "n_events", "n_rows")


@query(
    "b21_evaluation_input",
    sql(
        """SELECT COUNT(*) AS rows, COUNT(CASE WHEN p IS NULL OR isnan(p) THEN 1 END) AS missing_p,
        COUNT(CASE WHEN p < 0 OR p > 1 THEN 1 END) AS p_outside_unit, COUNT(CASE WHEN winner NOT IN (0, 1) THEN 1 END) AS y_not_binary,
        (SELECT COUNT(*) FROM (SELECT event_id FROM scored GROUP BY event_id HAVING SUM(winner) <> 1)) AS events_without_one_winner
        FROM scored""",
        "scored",
    ),
)
def b21(spark, folder):
    return M.input_problems(scored_frame(scored_of(spark, folder)))


@query(
    "b20_scoring_input",
    sql(
        """SELECT COUNT(*) AS rows, COUNT(CASE WHEN event_id IS NULL THEN 1 END) AS null_events,
        COUNT(*) - COUNT(DISTINCT (event_id, entity_id)) AS repeated_rows FROM contest""",
        "contest",
    ),
)
def b20(spark, folder):
    return scoring.check_scoring_input(contest.facts(spark, folder), ["grid"])


@query(
    "d15_two_model_comparison",
    sql(
        """WITH m AS (SELECT event_id, MAX(CASE WHEN winner = 1 THEN entity_id END) AS winner_id, MAX(CASE WHEN predicted_rank = 1 THEN entity_id END) AS model_pick FROM scored GROUP BY event_id),
        b AS (SELECT event_id, MAX(CASE WHEN predicted_rank = 1 THEN entity_id END) AS baseline_pick FROM pole_scored GROUP BY event_id)
        SELECT *, winner_id = model_pick AS model_top1_hit, winner_id = baseline_pick AS baseline_top1_hit FROM m JOIN b USING (event_id)""",
        "scored", "pole_scored",
    ),
)
def d15(spark, folder):
    return M.compare_models(scored_of(spark, folder), pole_of(spark, folder))


@query(
    "d16_previous_round",
    sql(
        """SELECT c.event_id, c.entity_id, b.predicted_rank - c.predicted_rank AS rank_gain, round(c.p - b.p, 6) AS share_gain
        FROM scored c LEFT JOIN scored b ON b.season = c.season AND b.entity_id = c.entity_id AND b.round = c.round - 1""",
        "scored",
    ),
)
def d16(spark, folder):
    now = scored_of(spark, folder)
    before = now.select(
        "season",
        "entity_id",
        (F.col("round") + 1).alias("round"),
        F.col("predicted_rank").alias("_rank"),
        F.col("p").alias("_p"),
    )
    both = now.join(before, ["season", "entity_id", "round"], "left")
    return both.select(
        *KEYS,
        (F.col("_rank") - F.col("predicted_rank")).alias("rank_gain"),
        r6(F.col("p") - F.col("_p"), "share_gain"),
    )


@query(
    "c20_tiers",
    sql(
        """SELECT event_id, entity_id, CASE WHEN p >= 0.5 THEN 'Strong favorite' WHEN p >= 0.3 THEN 'Clear favorite' WHEN p >= 0.2 THEN 'Slight edge' ELSE 'Wide open' END AS tier,
        CASE WHEN p >= 0.5 THEN 5 WHEN p >= 0.3 THEN 4 WHEN p >= 0.2 THEN 3 ELSE 2 END AS stars FROM scored""",
        "scored",
    ),
)
def c20(spark, folder):
    return scored_of(spark, folder).select(
        *KEYS, S.tier_label("p").alias("tier"), S.tier_stars("p").alias("stars")
    )


@query(
    "c21_grid_display",
    sql(
        """SELECT event_id, entity_id, CASE WHEN grid IS NULL THEN '—' WHEN grid = 0 THEN 'PL'
        WHEN length(CAST(grid AS VARCHAR)) < 2 THEN lpad(CAST(grid AS VARCHAR), 2, '0') ELSE CAST(grid AS VARCHAR) END AS grid_text,
        CASE WHEN grid <> 0 THEN grid - predicted_rank END AS grid_delta FROM scored""",
        "scored",
    ),
)
def c21(spark, folder):
    return scored_of(spark, folder).select(
        *KEYS,
        S.grid_text("grid").alias("grid_text"),
        S.grid_delta("grid", "predicted_rank").alias("grid_delta"),
    )


@query(
    "c22_favourite_reasons",
    sql(
        """WITH form AS (SELECT *, AVG(p) OVER (PARTITION BY season, entity_id ORDER BY round ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS recent FROM scored),
        team AS (SELECT season, round, group_id, SUM(p) AS s, COUNT(*) AS n FROM scored GROUP BY ALL),
        prior_team AS (SELECT season, round, group_id, (SUM(s) OVER w) / (SUM(n) OVER w) AS team_mean FROM team
          WINDOW w AS (PARTITION BY season, group_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT event_id, entity_id, concat_ws('|', CASE WHEN grid = 1 THEN 'Pole position' END,
          CASE WHEN grid > 0 AND grid <= 3 AND grid <> 1 THEN 'Front-row start' END,
          CASE WHEN quali_position <= 3 AND grid <> 1 THEN 'Strong qualifying pace' END,
          CASE WHEN recent > 0.2 THEN 'Excellent recent form' END,
          CASE WHEN team_mean > 0.15 THEN 'Strong constructor' END) AS reasons
        FROM form JOIN prior_team USING (season, round, group_id) WHERE predicted_rank = 1""",
        "scored",
    ),
)
def c22(spark, folder):
    df = favourite_form(scored_of(spark, folder)).where("predicted_rank = 1")
    grid, quali = F.col("grid"), F.col("quali_position")
    reasons = S.any_of(
        {
            "Pole position": grid == 1,
            "Front-row start": (grid > 0) & (grid <= 3) & (grid != 1),
            "Strong qualifying pace": (quali <= 3) & (grid != 1),
            "Excellent recent form": F.col("recent") > 0.20,
            "Strong constructor": F.col("team_mean") > 0.15,
        }
    )
    return df.select(*KEYS, F.array_join(reasons, "|").alias("reasons"))


@query(
    "c23_confidence_reasons",
    sql(
        """WITH top2 AS (SELECT event_id, MAX(CASE WHEN predicted_rank = 1 THEN p END) - MAX(CASE WHEN predicted_rank = 2 THEN p END) AS gap FROM scored GROUP BY event_id)
        SELECT event_id, entity_id, concat_ws('|', CASE WHEN gap >= 0.15 THEN 'Clear separation from the field' END,
        CASE WHEN gap < 0.05 THEN 'Tight race' END, CASE WHEN grid = 1 THEN 'Favorite started from pole' END,
        CASE WHEN grid > 5 THEN 'Favorite started outside the top 5' END) AS reasons FROM scored JOIN top2 USING (event_id) WHERE predicted_rank = 1""",
        "scored",
    ),
)
def c23(spark, folder):
    scored = scored_of(spark, folder)
    top = checked_join(scored.where("predicted_rank = 1"), runner_up_gap(scored), ["event_id"])
    gap, grid = F.col("gap"), F.col("grid")
    reasons = S.any_of(
        {
            "Clear separation from the field": gap >= 0.15,
            "Tight race": gap < 0.05,
            "Favorite started from pole": grid == 1,
            "Favorite started outside the top 5": grid > 5,
        }
    )
    return top.select(*KEYS, F.array_join(reasons, "|").alias("reasons"))


@query(
    "c23_whole_reasons",
    sql(
        f"""WITH top2 AS (SELECT event_id, MAX(CASE WHEN predicted_rank = 1 THEN p END) - MAX(CASE WHEN predicted_rank = 2 THEN p END) AS gap FROM scored GROUP BY event_id)
        SELECT event_id, entity_id, round(gap, 6) AS gap, concat_ws('|', CASE WHEN gap >= 0.15 THEN printf('{S.CLEAR_LABEL}', gap * 100) WHEN gap < 0.05 THEN '{S.TIGHT_LABEL}' END,
        CASE WHEN grid = 1 THEN '{S.POLE_LABEL}' WHEN grid > 5 THEN printf('{S.LATE_LABEL}', grid) END, '{S.ERA_CAVEAT}') AS reasons
        FROM scored JOIN top2 USING (event_id) WHERE predicted_rank = 1""",
        "scored",
    ),
)
def c23_whole(spark, folder):
    scored = scored_of(spark, folder)
    top = checked_join(scored.where("predicted_rank = 1"), runner_up_gap(scored), ["event_id"])
    return top.select(*KEYS, r6("gap"), F.array_join(S.confidence_reasons("gap", "grid"), "|").alias("reasons"))


@query(
    "c24_probability_clip",
    sql(
        "SELECT event_id, entity_id, round(greatest(1e-6, least(1 - 1e-6, p)), 9) AS p FROM pole_scored",
        "pole_scored",
    ),
)
def c24(spark, folder):
    df = pole_of(spark, folder)
    return df.select(*KEYS, F.round(S.clip_probability("p"), 9).alias("p"))
