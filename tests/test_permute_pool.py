"""Keyed permutations, pooling of violators, interval joins and numbering."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from formbook.operators.permute import numbered, permuted
from formbook.operators.pooling import pooled_blocks
from formbook.plans import models as L


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 2500, 2501])
def test_every_key_permutes_all_numbers(spark, n):
    keys = [0, 1, 7]
    at = spark.range(n).select(F.col("id").alias("at"), F.explode(F.array(*[F.lit(k).cast("long") for k in keys])).alias("key"))
    rows = at.withColumn("to", permuted(F.col("at"), n, F.col("key"), 3)).collect()
    made = {k: [r["to"] for r in sorted(rows, key=lambda r: r["at"]) if r["key"] == k] for k in keys}
    assert all(sorted(v) == list(range(n)) for v in made.values())
    if n > 100:
        assert made[0] != made[1] and made[0] != list(range(n))
        # No shift in disguise, and few fixed points.
        assert len({(t - i) % n for i, t in enumerate(made[0])}) > n / 4
        assert sum(t == i for i, t in enumerate(made[0])) < 20


def test_numbers_are_dense(spark):
    df = spark.range(1000).repartition(7).withColumn("x", F.col("id") * 2)
    rows, n = numbered(df.where("id % 3 <> 1"))
    got = [r["_at"] for r in rows.collect()]
    assert n == len(got) == 667 and sorted(got) == list(range(n))
    assert numbered(df.limit(0))[1] == 0


def learnable(spark, n_events=60):
    rng = random.Random(5)
    rows = []
    for event in range(n_events):
        strength = [rng.random() for _ in range(6)]
        best = max(range(6), key=lambda i: strength[i] + rng.random() * 0.2)
        rows += [(event, i, int(i == best), s, rng.random()) for i, s in enumerate(strength)]
    return spark.createDataFrame(rows, "event_id long, entity_id long, winner int, strength double, noise double")


def test_importance_of_all_columns_of_a_fitted_model(spark):
    df = learnable(spark)
    model = L.fit("logreg", df, ["strength", "noise"])
    got = {r["feature"]: r for r in L.permutation_importance(model.score, df, ["strength", "noise"], 4).collect()}
    assert got["strength"]["top1_drop_mean"] > 0.4 > abs(got["noise"]["top1_drop_mean"])
    assert all(r["repeats"] == 4 and r["n_events"] == 60 for r in got.values())
    # Reruns agree.
    again = {r["feature"]: r["top1_drop_mean"] for r in L.permutation_importance(model.score, df, ["noise"], 4).collect()}
    assert set(again) == {"noise"}


def test_importance_shuffles_rows_once_per_repeat(spark, monkeypatch):
    df = learnable(spark)
    plans = []

    def score(frame):
        plans.append(frame)
        return frame.withColumn("p", F.col("strength"))

    L.permutation_importance(score, df, ["strength", "noise"], 3)
    # Features are expanded above the join that fetches donors.
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    join = next(i for i, x in enumerate(lines) if "Join Inner" in x and "_from" in x)
    features = next(i for i, x in enumerate(lines) if "feature#" in x and "Generate" in x)
    repeats = [i for i, x in enumerate(lines) if "repeat#" in x and "Generate" in x]
    assert features < join < repeats[-1] and "Sort" not in plan


def plain_isotonic(points):
    blocks = []
    for p, y, w in sorted(points):
        blocks.append([p, p, y * w, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0], b[1], blocks[-1][2] + b[2], blocks[-1][3] + b[3]]
    return blocks


@pytest.mark.parametrize("shape", ["random", "falling", "rising", "late_drop"])
def test_blocks_equal_the_plain_fit(spark, shape):
    rng = np.random.default_rng(7)
    n = 100_000 if shape == "random" else 3000
    p = np.sort(rng.random(n))
    y = {
        "random": (rng.random(n) < p**2).astype(float), "falling": 1 - p, "rising": p,
        "late_drop": np.where(np.arange(n) == n - 1, -1e6, p),
    }[shape]
    df = spark.createDataFrame([(float(a), float(a), float(b), 1.0) for a, b in zip(p, y)], "lo double, hi double, total double, weight double")
    got = sorted(tuple(r) for r in pooled_blocks(df, range_blocks=4096 if shape == "random" else 200).collect())
    want = plain_isotonic([(float(a), float(b), 1.0) for a, b in zip(p, y)])
    assert len(got) == len(want)
    assert np.allclose(np.array(got), np.array(want), rtol=1e-9)


def test_calibration_of_many_scores(spark, monkeypatch):
    from formbook.operators import pooling

    rng = np.random.default_rng(8)
    p = rng.random(20_000).round(4)
    y = (rng.random(20_000) < p).astype(int)
    df = spark.createDataFrame(list(zip(p.tolist(), y.tolist())), "p double, y int")
    whole = L.fit_isotonic(df)
    monkeypatch.setattr(pooling.pooled_blocks, "__defaults__", (512,))
    parts = L.fit_isotonic(df)
    assert np.allclose(whole.boundaries.toArray(), parts.boundaries.toArray())
    assert np.allclose(whole.predictions.toArray(), parts.predictions.toArray())
    blocks = plain_isotonic([(a, y[p == a].mean(), (p == a).sum()) for a in sorted(set(p))])
    means = sorted({round(b[2] / b[3], 9) for b in blocks})
    assert np.allclose(sorted(set(np.round(parts.predictions.toArray(), 9))), means)


def plain_held(rows, windows):
    out = []
    for key, v in rows:
        for name, lo, hi in windows:
            if v is not None and (lo is None or lo <= v) and (hi is None or v <= hi):
                out.append((key, name))
    return sorted(out)


@pytest.mark.parametrize("kind", ["long", "double", "date"])
def test_interval_join_equals_all_pairs(spark, kind):
    import datetime as dt

    from formbook.operators.intervals import interval_join

    rng = random.Random(11)
    def make(x):
        return {"long": x, "double": x / 7, "date": dt.date(2000, 1, 1) + dt.timedelta(days=x)}[kind]

    rows = [(i, make(rng.choice([rng.randint(0, 3000), 77]))) for i in range(400)] + [(900, None)]
    windows = []
    for i in range(300):
        lo, length = rng.randint(-200, 3100), rng.choice([0, 1, 3, 50, 2000, 9000])
        if kind == "date":
            lo = max(lo, -200)
        windows.append((i, make(lo), make(lo + length)))
    windows += [(500, None, make(100)), (501, make(2900), None), (502, None, None), (503, make(50), make(10)), (504, make(77), make(77))]
    df = spark.createDataFrame(rows, f"key long, v {kind}")
    table = spark.createDataFrame(windows, f"name long, lo {kind}, hi {kind}")
    made = interval_join(df, "v", table, "lo", "hi", ["name"])
    assert sorted((r["key"], r["name"]) for r in made.collect()) == plain_held(rows, windows)
    outer = interval_join(df, "v", table.where("name = 504"), "lo", "hi", ["name"], "left")
    assert outer.count() == len(rows)
    assert interval_join(df, "v", table.limit(0), "lo", "hi", ["name"], "left").count() == len(rows)
    assert interval_join(df.limit(0), "v", table, "lo", "hi", ["name"]).count() == 0


def test_ten_thousand_windows_need_no_nested_loop(spark):
    from formbook.operators.intervals import interval_join

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).select((F.col("id") * 5).alias("v"))
        windows = spark.range(10_000).select(F.col("id").alias("name"), F.col("id").alias("lo"), (F.col("id") + F.col("id") % 40).alias("hi"))
        made = interval_join(df, "v", windows, "lo", "hi", ["name"])
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = sum(1 for i in range(10_000) for v in range(-(-i // 5) * 5, i + i % 40 + 1, 5) if v < 10_000)
        assert made.count() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("shape", ["one_event", "same_prefix"])
def test_numbering_divides_rows_alike_in_their_first_columns(spark, shape):
    from formbook.operators import hot
    from formbook.operators.keys import mint_keys

    if shape == "one_event":
        rows = [(2001, 1, i % 7, f"ref{i:05d}") for i in range(5000)]
    else:
        rows = [(2001, 1, 1, f"https://example.org/a/very/long/path/{i:05d}") for i in range(5000)]
    incoming = spark.createDataFrame(rows, "season long, round long, place long, ref string")
    dim = spark.createDataFrame([("known", 10)], "ref string, id long")
    spark.conf.set("spark.formbook.hotGroupRows", "500")
    try:
        order = [("season", True), ("round", True), ("place", True), ("ref", True)]
        parts = hot.range_parts(incoming, [], order).groupBy("_part").count().agg(F.max("count")).first()[0]
        assert parts <= 2 * 500
        got = {r["ref"]: r["id"] for r in mint_keys(incoming, dim, "ref", "id", "season", "round", "place").collect()}
    finally:
        spark.conf.unset("spark.formbook.hotGroupRows")
    want = {r[3]: 11 + i for i, r in enumerate(sorted(rows))}
    assert got == want


@pytest.mark.parametrize("shape", ["many", "ties", "odd_values", "outside"])
def test_medians_from_brackets_are_exact(spark, monkeypatch, shape):
    rng = np.random.default_rng(12)
    n = 3001 if shape != "ties" else 3000
    a = rng.normal(size=n) if shape != "ties" else rng.integers(0, 3, n).astype(float)
    b = [None if i % 3 == 0 else float(x) for i, x in enumerate(rng.exponential(size=n))]
    c = [float("nan") if shape == "odd_values" and i % 10 == 0 else float(i % 2) for i in range(n)]
    df = spark.createDataFrame([(float(x), y, z, None) for x, y, z in zip(a, b, c)], "a double, b double, c double, d double")
    brackets = {k: (5.0, 6.0, n if k != "b" else sum(x is not None for x in b)) for k in "abc"} | {"d": (None, None, 0)} if shape == "outside" else None
    got = {r["feature"]: r["median"] for r in L.exact_medians(df, list("abcd"), brackets).collect()}
    want = {"a": np.median(a), "b": np.median([x for x in b if x is not None]), "c": np.median(np.nan_to_num(c, nan=9.0))}
    assert got == want


def test_medians_shuffle_values_of_brackets_only(spark):
    df = spark.range(200_000).select(F.rand(3).alias("a"), F.rand(4).alias("b"))
    made = L.exact_medians(df, ["a", "b"])
    pre = L.fit_preprocess(df, ["a", "b"], scale=True)
    assert pre.medians == {r["feature"]: r["median"] for r in made.collect()}
    for c in "ab":
        rows = df.select(F.avg(c), F.stddev_pop(c), F.median(c)).first()
        assert (pre.means[c], pre.stds[c], pre.medians[c]) == pytest.approx(tuple(rows))
    ends = {r["feature"]: r["ends"] for r in L._per_column(df, ["a", "b"], L.BRACKETS).collect()}
    inside = sum(df.where(F.col(c).between(*ends[c])).count() for c in "ab")
    assert 0 < inside < 2000


def test_importance_of_a_logistic_model_equals_scoring_each_feature(spark):
    rng = random.Random(9)
    rows = []
    for event in range(40):
        for i in range(7):
            a = rng.choice([None, float(rng.randint(0, 3))])
            rows.append((event, i, int(i == event % 7) if event % 9 else None, a, rng.gauss(0, 3) + (i == event % 7), 4.0))
    df = spark.createDataFrame(rows, "event_id long, entity_id long, winner int, a double, b double, c double")
    columns = ["a", "b", "c"]
    model = L.fit("logreg", df.where("winner IS NOT NULL"), columns)
    scored = []

    def each(frame):
        scored.append(frame)
        return model.score(frame)

    want = {r["feature"]: tuple(r) for r in L.permutation_importance(each, df, columns, 3).collect()}
    assert "feature" in scored[0].columns
    seen = []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(L.Fitted, "score", lambda self, frame, out="p": seen.append(frame))
        made = L.permutation_importance(model.score, df, columns, 3)
    # No frame of rows times features is scored.
    assert not seen
    got = {r["feature"]: tuple(r) for r in made.collect()}
    assert got.keys() == want.keys()
    for name in got:
        assert got[name][1:] == pytest.approx(want[name][1:])
    assert got["c"][1] == 0 and got["b"][1] > 0


@pytest.mark.parametrize("n", [1, 2, 1001])
def test_permutation_in_batches_is_that_of_the_expression(spark, n):
    seed, rounds = 42, 32
    size, at, key = F.lit(n).cast("long"), F.col("id"), F.col("key")

    def step(x, k):
        other = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, k), size) - x, size)
        chosen = F.xxhash64(k, F.lit(seed), key, F.greatest(x, other)).bitwiseAND(F.lit(1))
        return F.when(chosen == 1, other).otherwise(x)

    df = spark.range(n).withColumn("key", F.explode(F.array(*[F.lit(k).cast("long") for k in (-1, 0, 3)])))
    both = df.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), at, step).alias("a"), permuted(at, n, key, seed).alias("b"))
    assert both.where("a <> b OR b IS NULL").count() == 0
    # No loop is interpreted row by row.
    plan = df.select(permuted(at, n, key, seed))._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan
