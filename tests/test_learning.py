"""Splits, preprocessing, fits, calibration and tracking."""

import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from formbook.plans import models as L
from formbook.plans import splits as I
from formbook.plans import tracking as T
from formbook.plans import scoring
from formbook.plans.metrics import EvaluationError


def seasons(spark, lo=2010, hi=2026):
    return spark.range(lo, hi + 1).select(
        F.col("id").alias("season"), F.explode(F.array(F.lit(1), F.lit(2))).alias("round")
    ).select(
        "season", "round", (F.col("season") * 100 + F.col("round")).alias("event_id"),
        (F.col("round") == 1).cast("long").alias("winner"),
    )


def test_preset_windows():
    p = I.presets()
    assert p["historical"].roles() == [("train", (2010, 2021)), ("val", (2022, 2023)), ("test", (2024, 2024))]
    assert p["hybrid_era"].roles() == [("train", (2014, 2019)), ("val", (2020, 2020)), ("test", (2021, 2021))]
    assert p["ground_effect"].roles() == [("train", (2022, 2023)), ("val", (2024, 2024)), ("test", (2025, 2025))]
    r = I.rolling_split(2024)
    assert (r.train, r.val, r.test, r.folds) == ((2018, 2022), (2023, 2023), (2024, 2024), 4)


@pytest.mark.parametrize(
    "make",
    [
        lambda: I.Split("x", (2012, 2010), (2013, 2013), (2014, 2014)),
        lambda: I.Split("x", (2010, 2012), (2012, 2013), (2014, 2014)),
        lambda: I.Split("x", (2010, 2012), (2013, 2013), (2025, 2025)),
        lambda: I.era_split(("open", 2026, None)),
        lambda: I.era_split(("short", 2010, 2012)),
        lambda: I.rolling_split(2024, train=1),
    ],
)
def test_unsound_splits_are_refused(make):
    with pytest.raises(I.SplitError):
        make()


def test_split_keeps_events_apart(spark):
    df = I.checked_split(seasons(spark), I.presets()["historical"])
    got = {r["role"]: r["n"] for r in df.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"train": 24, "val": 4, "test": 2}
    with pytest.raises(I.SplitError, match="no rows"):
        I.checked_split(seasons(spark, 2010, 2022), I.presets()["historical"])
    mixed = seasons(spark).withColumn("event_id", F.lit(1))
    with pytest.raises(I.SplitError, match="two roles"):
        I.checked_split(mixed, I.presets()["historical"])


def test_expanding_folds(spark):
    train = seasons(spark, 2010, 2013)
    folds = I.label_folds(train, 2, window=(2010, 2021))
    got = folds.groupBy("fold", "role").agg(F.min("season"), F.max("season")).collect()
    assert {tuple(r) for r in got} == {
        (1, "train", 2010, 2011), (1, "val", 2012, 2012),
        (2, "train", 2010, 2012), (2, "val", 2013, 2013),
    }
    with pytest.raises(I.SplitError):
        I.label_folds(train, 4)
    with pytest.raises(I.SplitError, match="outside"):
        I.label_folds(seasons(spark), 2, window=(2010, 2021))


def test_exact_medians(spark, cut_small):
    df = spark.createDataFrame(
        [(1.0, 1), (2.0, None), (3.0, 7), (10.0, 7), (None, 7)], "a double, b long"
    )
    got = {r["feature"]: r["median"] for r in L.exact_medians(df, ["a", "b"]).collect()}
    assert got == {"a": 2.5, "b": 7.0}
    many = spark.range(1001).select((F.col("id") * 3).alias("a"))
    assert L.exact_medians(many, ["a"]).first()["median"] == 1500


def test_scaling_is_population_and_fit_on_training_rows(spark):
    train = spark.createDataFrame([(0.0, None), (10.0, 4.0), (5.0, 2.0)], "x double, y double")
    pre = L.fit_preprocess(train, ["x", "y"], scale=True)
    assert pre.flagged == ["y"] and pre.medians == {"x": 5.0, "y": 3.0}
    assert pre.stds["x"] == pytest.approx((50 / 3) ** 0.5)
    other = spark.createDataFrame([(None, None)], "x double, y double")
    row = other.select(*[v.alias(n) for n, v in pre.expressions().items()]).first()
    assert row["x"] == 0 and row["y"] == 0 and row["y_missing"] > 0
    flat = L.fit_preprocess(train.withColumn("x", F.lit(1.0)), ["x"], scale=True)
    assert flat.stds["x"] == 1.0


def learnable(spark, shuffled=False):
    """Six seasons of ten events; the first grid place always wins."""
    field = F.explode(F.sequence(F.lit(1), F.lit(6)))
    df = spark.range(60).select(
        (2000 + F.floor(F.col("id") / 10)).alias("season"), (F.col("id") % 10 + 1).alias("round"),
        F.col("id").alias("event_id"), field.alias("entity_id"),
    )
    place = (F.col("entity_id") + F.col("event_id")) % 6 + 1
    df = df.withColumns(
        {
            "grid_adjusted": place.cast("double"),
            "noise": (F.abs(F.xxhash64("event_id", "entity_id")) % 100).cast("double"),
            "finish_order": place.cast("long"),
        }
    )
    won = (F.col("entity_id") == F.abs(F.xxhash64(F.lit(7), "event_id")) % 6 + 1) if shuffled else place == 1
    return df.withColumn("winner", won.cast("long"))


COLUMNS = ["grid_adjusted", "noise"]


@pytest.mark.parametrize(
    ("name", "params"),
    [("logreg", {}), ("random_forest", {"numTrees": 10, "maxDepth": 4}), ("boosted_trees", {"maxIter": 5, "maxDepth": 3, "featureSubsetStrategy": "all"})],
)
def test_candidates_learn_a_planted_signal(spark, name, params):
    df = learnable(spark)
    scored = L.fit(name, df.where("season < 2004"), COLUMNS, params=params).score(df.where("season >= 2004"))
    from formbook.plans import metrics as M

    row = M.metrics(M.as_scored(scored, "p")).first()
    assert row["top1_accuracy"] == 1.0 and row["leakage_alarm"]


def test_shuffled_target_destroys_the_signal(spark):
    df = learnable(spark, shuffled=True)
    row = L.cross_validate(df, "logreg", COLUMNS, 2).agg(F.avg("top1_accuracy")).first()
    assert row[0] < 0.6


def test_no_positive_rows_raise(spark):
    with pytest.raises(L.TrainingError):
        L.fit("logreg", learnable(spark).withColumn("winner", F.lit(0)), COLUMNS)
    with pytest.raises(KeyError):
        L.fit("nothing", learnable(spark), COLUMNS)
    model = L.fit("pole_baseline", learnable(spark), COLUMNS)
    with pytest.raises(L.ModelSchemaError):
        model.score(learnable(spark).drop("grid_adjusted"))


def test_calibration_is_monotone_bounded_and_stored(spark, tmp_path):
    df = learnable(spark)
    train = df.where("season < 2005")
    model = L.fit_calibrated(train, "logreg", COLUMNS, 2)
    raw = L.fit("logreg", train, COLUMNS).score(df, "raw").select("event_id", "entity_id", "raw")
    both = model.score(df).join(raw, ["event_id", "entity_id"]).orderBy("raw").select("raw", "p").collect()
    ps = [r["p"] for r in both]
    assert all(a <= b + 1e-12 for a, b in zip(ps, ps[1:])) and 1e-6 <= min(ps) <= max(ps) <= 1 - 1e-6
    L.save(spark, model, str(tmp_path / "m"))
    again = L.load(spark, str(tmp_path / "m")).score(df).orderBy("event_id", "entity_id")
    want = model.score(df).orderBy("event_id", "entity_id").select("p").collect()
    assert [r["p"] for r in again.select("p").collect()] == pytest.approx([r["p"] for r in want])


def test_search_marks_the_best(spark):
    assert L.draw_configs("logreg", 3) == L.draw_configs("logreg", 3)
    assert all(1e-3 <= c["C"] <= 10 for c in L.draw_configs("logreg", 20))
    with pytest.raises(L.TrainingError):
        L.draw_configs("pole_baseline", 1)
    table = spark.createDataFrame(
        [(0, 0.5, 0.3), (1, 0.6, 0.4), (2, 0.6, 0.2)], "config long, top1 double, log_loss double"
    )
    assert [r["config"] for r in L.mark_best(table).where("best").collect()] == [2]


def test_permutation_importance(spark):
    df = learnable(spark)

    def score(frame):
        return frame.withColumn("p", scoring.pole_probability("grid_adjusted"))

    got = {r["feature"]: r for r in L.permutation_importance(score, df, COLUMNS, 3).collect()}
    assert got["noise"]["top1_drop_mean"] == 0 and got["noise"]["top1_drop_std"] == 0
    assert got["grid_adjusted"]["top1_drop_mean"] > 0.5


def test_importance_table(spark):
    model = L.fit("logreg", learnable(spark), COLUMNS)
    rows = {r["feature"]: r for r in L.importance(spark, model, {"grid_adjusted": "stable"}).collect()}
    assert rows["grid_adjusted"]["importance"] > rows["noise"]["importance"]
    assert rows["grid_adjusted"]["class"] == "stable" and rows["noise"]["class"] == "derived"


def test_tracking_is_idempotent_and_waits_for_winners(spark):
    facts = learnable(spark).where("season = 2005").withColumn(
        "winner", F.when(F.col("event_id") == 55, 0).otherwise(F.col("winner"))
    )

    def score(frame):
        return frame.withColumn("p", scoring.pole_probability("grid_adjusted"))

    none = facts.select("event_id").where("false")
    report = T.score_new_events(score, facts, none, {"name": "pole"})
    assert report.count() == 9 and report.where("event_id = 55").count() == 0
    assert T.score_new_events(score, facts.where("event_id <> 55"), report).count() == 0
    # Entrants twice in an event, and scores that are no probabilities, are refused.
    one = facts.where("event_id = 54")
    twice = one.where("winner = 0")
    with pytest.raises(scoring.ScoringInputError, match="repeated_rows"):
        T.score_new_events(score, one.unionByName(twice), none)
    with pytest.raises(EvaluationError, match="p_outside_unit"):
        T.score_new_events(lambda df: score(df).withColumn("p", F.col("p") + 1), one, none)
    with pytest.raises(EvaluationError, match="missing_p"):
        T.score_new_events(lambda df: score(df).withColumn("p", F.lit(None).cast("double")), one, none)
    assert T.extend_report(report, report).count() == 9
    row = T.summarise_tracking(report).first()
    assert row["n_events"] == 9 and row["small_sample"] and row["top1_accuracy"] == 1.0


def test_materialise_refuses_a_known_event(spark):
    rows = spark.createDataFrame(
        [(1, 2020, 1, 1)], "event_id long, season long, round long, venue_id long"
    )
    with pytest.raises(T.MaterialiseError, match="already"):
        T.materialise(rows, rows, rows, rows, rows, rows, rows)


def test_calibration_tells_close_scores_apart(spark):
    from pyspark.sql import functions as F

    from formbook.plans.models import fit_isotonic

    # Scores within a millionth of each other, as shares of large fields are.
    df = spark.range(2000).select(
        (1e-7 + F.col("id") * 1e-10).alias("p"), (F.col("id") % 2000 >= 1000).cast("double").alias("y")
    )
    mapped = fit_isotonic(df).transform(df.withColumnRenamed("p", "_p"))
    got = {r["_calibrated"] for r in mapped.where("y = 0").collect()}, {r["_calibrated"] for r in mapped.where("y = 1").collect()}
    assert got == ({0.0}, {1.0})


def test_calibration_is_exact_over_many_ranges(spark, monkeypatch):
    from pyspark.sql import functions as F

    from formbook.operators import pooling
    from formbook.plans import models

    df = spark.range(4000).select((F.col("id") / 4000).alias("p"), (F.col("id") % 4000 >= 2000).cast("double").alias("y"))
    monkeypatch.setattr(pooling.pooled_blocks, "__defaults__", (100,))
    mapped = models.fit_isotonic(df).transform(df.withColumnRenamed("p", "_p"))
    assert mapped.where("abs(_calibrated - y) > 1e-9").count() == 0


class _Stub:
    """Scores the winner higher the nearer C is to 1; the smallest C fails every event."""

    def __init__(self, c):
        self.c = c

    def score(self, df):
        from pyspark.sql import functions as F

        near = 1 / (1 + abs(math.log(self.c)))
        return df.withColumn("p", F.when(F.col("winner") == 1, F.lit(near)).otherwise(F.lit(0.2)))


def test_search_prepares_once_a_fold_and_halves(spark, monkeypatch):
    rows = [(s * 10 + e, s, k, int(k == 0)) for s in range(2000, 2005) for e in range(2) for k in range(3)]
    df = spark.createDataFrame(rows, "event_id long, season long, entity_id long, winner long").cache()
    prepared, fitted = [], []
    monkeypatch.setattr(L, "prepare", lambda name, train, columns, target: prepared.append(train.count()) or "ready")

    def stub(train, columns, target, params, ready):
        assert ready == "ready"
        fitted.append(params["C"])
        return _Stub(params["C"])

    monkeypatch.setitem(L.CANDIDATES, "logreg", stub)
    whole = L.search(df, "logreg", ["entity_id"], 4, 8).collect()
    assert (prepared, len(fitted)) == ([6, 12, 18, 24], 32)
    assert {(r["folds"], r["events"]) for r in whole} == {(4, 8)}
    fitted.clear()
    halved = L.search(df, "logreg", ["entity_id"], 4, 8, halving=2).collect()
    assert len(fitted) == 15 and sorted(r["folds"] for r in halved) == [1] * 4 + [2] * 2 + [3, 4]
    best = [[r["config"] for r in t if r["best"]] for t in (whole, halved)]
    assert best[0] == best[1] and len(best[0]) == 1
    again = L.search(df, "logreg", ["entity_id"], 4, 8, parallel=1).collect()
    assert sorted(map(str, again)) == sorted(map(str, whole))
    df.unpersist()


def observe(spark):
    """From now on the session holds what it observed."""
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get == {"n": 3}


def test_search_after_an_observed_write(spark):
    observe(spark)
    df = learnable(spark)
    for halving, folds in ((None, [2, 2]), (2, [1, 2])):
        rows = L.search(df, "logreg", COLUMNS, 2, 2, halving=halving).collect()
        assert sorted(r["folds"] for r in rows) == folds and sum(r["best"] for r in rows) == 1
        assert {r["top1"] for r in rows} == {1.0}


@pytest.mark.parametrize(("name", "params"), [("logreg", {}), ("random_forest", {"numTrees": 5, "maxDepth": 3})])
def test_calibration_after_an_observed_write(spark, name, params):
    observe(spark)
    df = learnable(spark)
    model = L.fit_calibrated(df.where("season < 2005"), name, COLUMNS, 2, params=params)
    best = F.max_by("winner", "p")
    rows = model.score(df.where("season = 2005")).groupBy("event_id").agg(best.alias("won"), F.max("p").alias("p")).collect()
    assert len(rows) == 10 and all(r["won"] == 1 and 0.5 < r["p"] < 1 for r in rows)


def test_search_of_logistic_draws_shares_passes_and_metrics(spark, monkeypatch):
    from formbook.operators import logistic
    from formbook.plans import metrics as M

    df = learnable(spark).cache()
    passes, plans, sums, made = [], [], logistic._sums, M.metrics
    monkeypatch.setattr(logistic, "_sums", lambda rows, design, trials, *a: passes.append(len(trials)) or sums(rows, design, trials, *a))
    monkeypatch.setattr(M, "metrics", lambda *a, **k: plans.append(1) or made(*a, **k))
    rows = L.search_folds(df, "logreg", COLUMNS, 2, 4)
    # All draws of a fold meet in a pass, and in one plan of metrics.
    assert max(passes) == 3 and len(plans) == 2
    monkeypatch.undo()
    configs = L.draw_configs("logreg", 4)
    for config, year, top1, loss, events in rows:
        model = L.fit("logreg", df.where(F.col("season") < year), COLUMNS, params=configs[config])
        row = M.metrics(M.as_scored(model.score(df.where(F.col("season") == year)), "p", order=None)).first()
        assert (top1, events) == (row["top1_accuracy"], row["n_events"])
        assert loss == pytest.approx(row["log_loss"], rel=1e-3)
    df.unpersist()


def test_logistic_fit_is_the_optimum(spark):
    import random

    from pyspark.ml.classification import LogisticRegression

    rng = random.Random(4)
    rows = []
    for i in range(600):
        a, b = rng.gauss(5, 2), rng.choice([None, rng.random()])
        rows.append((int(rng.random() < 1 / (1 + math.exp(5 - a))), a, b))
    df = spark.createDataFrame(rows, "winner int, a double, b double").repartition(3)
    ready = L.prepare("logreg", df, ["a", "b"])
    for c in (0.01, 1.0):
        made = L.fit("logreg", df, ["a", "b"], params={"C": c, "tol": 1e-9}, ready=ready).model
        plain = LogisticRegression(
            featuresCol="_features", labelCol="_y", weightCol="_w", standardization=False, regParam=1 / (c * ready.total), maxIter=500, tol=1e-12
        ).fit(ready.pre.assemble(ready.rows))
        assert list(made.coefficients) == pytest.approx(list(plain.coefficients), abs=1e-4)
        assert made.intercept == pytest.approx(plain.intercept, abs=1e-4)
    # Labels other than 0 and 1 are refused.
    with pytest.raises(L.TrainingError):
        L.fit("logreg", df.withColumn("winner", F.col("winner") * 2), ["a", "b"])


def test_profile_reads_rows_not_cells(spark):
    rows = [(float(i % 7) - 3, None if i % 3 else -float(i), float("nan") if i % 10 == 0 else 1e9 + i, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    moments, brackets = L.profile(df, list("abcd"))
    for c in "abcd":
        want = df.select(F.count("*"), F.count(c), F.avg(c), F.var_pop(c)).first()
        got = tuple(moments[c][k] for k in ("n", "there", "mean", "var"))
        assert got[:2] == want[:2] and (c in "d" or got[2:] == pytest.approx(tuple(want)[2:], nan_ok=True))
    medians = {r["feature"]: r["median"] for r in L.exact_medians(df, list("abcd"), brackets).collect()}
    assert set(medians) == set("abc")
    for c in "abc":
        assert brackets[c][0] <= medians[c] <= brackets[c][1] or math.isnan(medians[c])
        assert medians[c] == df.select(F.median(c)).first()[0]
    pre = L.fit_preprocess(df.drop("c"), ["a", "b", "d"], scale=True)
    assert pre.medians == {"a": medians["a"], "b": medians["b"]} and pre.flagged == ["b", "d"]
