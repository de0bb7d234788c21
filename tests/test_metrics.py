"""Metrics of three events of four entrants, computed by hand."""

import pytest
from pyspark.sql import functions as F

from formbook.plans import gates, metrics as M, scoring

ROWS = [
    (1, 1, 0.7, 1), (1, 0, 0.2, 2), (1, 0, 0.06, 3), (1, 0, 0.04, 4),
    (2, 0, 0.5, 2), (2, 1, 0.3, 1), (2, 0, 0.15, 3), (2, 0, 0.05, 4),
    (3, 0, 0.4, 4), (3, 0, 0.3, 3), (3, 0, 0.2, 2), (3, 1, 0.1, 1),
]


@pytest.fixture
def scored(spark):
    return spark.createDataFrame(ROWS, "event_id long, y long, p double, order long")


def test_headline_metrics(scored):
    row = M.metrics(scored).first()
    assert row["top1_accuracy"] == pytest.approx(1 / 3)
    assert row["top3_recall"] == pytest.approx(2 / 3)
    assert row["winner_mrr"] == pytest.approx(7 / 12)
    assert row["avg_winner_probability"] == pytest.approx(1.1 / 3)
    assert row["n_events"] == 3 and row["n_rows"] == 12 and not row["leakage_alarm"]


def test_spearman_per_event(scored):
    got = {r["event_id"]: r["spearman_corr"] for r in M.per_event_metrics(scored).collect()}
    assert got == {1: pytest.approx(1.0), 2: pytest.approx(0.8), 3: pytest.approx(-1.0)}


def test_split_events_give_the_same_table(spark, scored):
    plain = {tuple(r) for r in M.per_event_metrics(scored).drop("spearman_corr").collect()}
    rho = {r[0]: r["spearman_corr"] for r in M.per_event_metrics(scored).collect()}
    try:
        spark.conf.set("spark.formbook.hotGroupRows", "2")
        spark.conf.set("spark.formbook.hotGroupSplits", "3")
        split = M.per_event_metrics(scored)
        assert {tuple(r) for r in split.drop("spearman_corr").collect()} == plain
        for r in split.collect():
            assert r["spearman_corr"] == pytest.approx(rho[r["event_id"]])
    finally:
        spark.conf.unset("spark.formbook.hotGroupRows")
        spark.conf.unset("spark.formbook.hotGroupSplits")


def test_winner_rank_counts(scored):
    table = M.winner_rank_counts(M.per_event_metrics(scored))
    assert {r["winner_rank"]: r["events"] for r in table.collect()} == {1: 1, 2: 1, 4: 1}


def test_ties_count_against_the_winner(spark):
    tied = spark.createDataFrame(
        [(1, y, 0.25) for y in (0, 1, 0, 0)] + [(2, 1, 0.4), (2, 0, 0.4), (2, 0, 0.2)],
        "event_id long, y long, p double",
    )
    got = {r["event_id"]: r["winner_rank"] for r in M.per_event_metrics(tied).collect()}
    assert got == {1: 4, 2: 2}


def test_constant_event_has_no_correlation(spark):
    flat = spark.createDataFrame(
        [(1, 1, 0.5, 1), (1, 0, 0.5, 2)], "event_id long, y long, p double, order long"
    )
    assert M.per_event_metrics(flat).first()["spearman_corr"] is None
    assert M.metrics(flat).first()["spearman_corr"] is None


def test_calibration_error(spark):
    rows = [(i, 0, 0.1) for i in range(50)] + [(50 + i, 1, 0.9) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, y long, p double")
    assert M.ece(M.calibration_table(df)).first()["ece"] == pytest.approx(0.1)
    assert M.row_quality(df).first()["ece"] == pytest.approx(0.1)


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.11,), (1.0,)], "p double")
    bins = [r[0] for r in df.select(M.probability_bin(F.col("p"), 10)).collect()]
    assert bins == [0, 0, 1, 9]


def test_input_problems(spark):
    bad = spark.createDataFrame(
        [(1, 1, 0.5), (1, 1, 1.5), (2, 0, None), (2, 3, 0.1)], "event_id long, y long, p double"
    )
    row = M.input_problems(bad).first()
    assert row["p_outside_unit"] == 1 and row["missing_p"] == 1 and row["y_not_binary"] == 1
    # Event 1 has two winners, event 2 sums to three.
    assert row["events_without_one_winner"] == 2


def test_event_in_two_seasons_is_refused(spark):
    df = spark.createDataFrame(
        [(1, 1, 0.5, 2020), (1, 0, 0.5, 2021)], "event_id long, y long, p double, season long"
    )
    with pytest.raises(M.EvaluationError):
        M.metrics_by_season(df)


def test_shares_and_ranks(spark):
    df = spark.createDataFrame(
        [(1, 2, 0.2), (1, 1, 0.2), (1, 3, 0.6), (2, 1, 0.0), (2, 2, 0.0)],
        "event_id long, entity_id long, raw double",
    )
    got = {
        (r["event_id"], r["entity_id"]): (round(r["win_probability"], 6), r["predicted_rank"])
        for r in scoring.score(df, F.col("raw")).collect()
    }
    # Equal shares go by entity; an event without any score is shared equally.
    assert got == {
        (1, 3): (0.6, 1), (1, 1): (0.2, 2), (1, 2): (0.2, 3), (2, 1): (0.5, 1), (2, 2): (0.5, 2),
    }


def _field(spark):
    return spark.createDataFrame(
        [(1, i, float(i), i / 4, False, 4) for i in range(1, 5)],
        "event_id long, entity_id long, grid_adjusted double, grid_position_norm double, "
        "pit_lane_start boolean, field_size long",
    )


def test_what_if_with_the_real_grid_changes_nothing(spark):
    same = spark.createDataFrame([(1, 2, 2)], "event_id long, entity_id long, new_grid int")
    raw = 1.0 / F.col("grid_adjusted")
    for r in scoring.what_if(_field(spark), same, raw).collect():
        assert r["real_share"] == pytest.approx(r["simulated_share"])


def test_what_if_pit_lane_and_bad_grid(spark):
    pit = spark.createDataFrame([(1, 1, 0)], "event_id long, entity_id long, new_grid int")
    out = scoring.what_if(_field(spark), pit, 1.0 / F.col("grid_adjusted"))
    moved = out.where("entity_id = 1").first()
    assert moved["grid_adjusted"] == 5 and moved["grid_position_norm"] == 1.0
    assert moved["pit_lane_start"] and moved["simulated_rank"] == 4
    assert out.agg(F.sum("simulated_share")).first()[0] == pytest.approx(1.0)
    bad = spark.createDataFrame([(1, 1, 9)], "event_id long, entity_id long, new_grid int")
    with pytest.raises(scoring.ScoringInputError):
        scoring.what_if(_field(spark), bad, F.lit(1.0))


def test_what_if_each_agrees_with_one_at_a_time(spark):
    raw = 1.0 / F.col("grid_adjusted")
    each = scoring.what_if_each(_field(spark), raw, F.lit(1.0))
    want = {r["entity_id"]: r["simulated_share"] for r in each.collect()}
    for entity in (1, 2, 3, 4):
        change = spark.createDataFrame([(1, entity, 1)], "event_id long, entity_id long, new_grid int")
        got = scoring.what_if(_field(spark), change, raw).where(F.col("entity_id") == entity).first()
        assert got["simulated_share"] == pytest.approx(want[entity])


def _metric_row(spark, top1, rho):
    return spark.createDataFrame([(top1, rho)], "top1_accuracy double, spearman_corr double")


@pytest.mark.parametrize(
    ("candidate", "served", "refused"),
    [
        ((0.50, 0.60), (0.50, 0.60), set()),
        ((0.48, 0.59), (0.50, 0.60), set()),
        ((0.46, 0.60), (0.50, 0.60), {"top1_accuracy"}),
        ((0.50, 0.58), (0.50, 0.60), {"spearman_corr"}),
        ((0.50, None), (0.50, 0.60), set()),
    ],
)
def test_regression_checks(spark, candidate, served, refused):
    out = gates.regression_checks(_metric_row(spark, *candidate), _metric_row(spark, *served))
    assert {r["check"] for r in out.where("refused").collect()} == refused


def test_promotion_verdict_paths(spark):
    features = spark.createDataFrame(
        [("a", "good"), ("b", "wet_form")], "feature string, grp string"
    )
    scored = spark.createDataFrame(
        [(1, 0.5), (1, 0.5), (2, 0.7), (2, 0.3)], "event_id long, win_probability double"
    )
    fine = scored.where("event_id = 2")
    schema = features.select("feature")
    row = _metric_row(spark, 0.5, 0.5)

    def refused(**kw):
        args = {
            "candidate": row, "served": row, "schema": schema.where("feature = 'a'"),
            "features": features, "scored": fine, **kw,
        }
        verdict = gates.promotion_verdict(**args)
        return {r["check"] for r in verdict.where("refused").collect()}

    assert refused() == set()
    assert refused(schema=schema) == {"excluded_features"}
    assert refused(scored=scored) == {"degenerate_output"}
    assert refused(served=None) == set()
    assert refused(served_has_metrics=False) == {"baseline_metrics"}
    assert refused(served_has_metrics=False, force_baseline=True) == set()
    with pytest.raises(gates.PromotionRefused, match="degenerate"):
        gates.require_promotable(
            gates.promotion_verdict(row, row, schema, features, scored)
        )


def test_parity_reports_only_real_differences(spark):
    schema = (
        "event_id long, entity_id long, qualifying_position long, grid_adjusted double, "
        "pit_lane_start boolean, form double"
    )
    real = spark.createDataFrame(
        [(1, 1, 1, 1.0, False, 2.0), (2, 1, 1, 5.0, True, None), (2, 2, 2, 1.0, False, 3.0)], schema
    )
    made = spark.createDataFrame(
        [(1, 1, 1, 1.0, False, 2.5), (2, 1, 1, 1.0, True, None), (2, 2, 2, 2.0, False, 3.0)], schema
    )
    rows = gates.parity(real, made, ["grid_adjusted", "form"]).collect()
    got = {(r["event_id"], r["entity_id"], r["column"]): r["expected"] for r in rows}
    assert got == {
        (1, 1, "form"): False, (2, 1, "grid_adjusted"): True, (2, 2, "grid_adjusted"): True,
    }
    lost = gates.parity(real, made.where("event_id = 1"), ["form"]).where("event_id = 2")
    assert lost.count() == 2 and lost.where("expected").count() == 0
