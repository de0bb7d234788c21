"""Stored state against the batch build, event by event and for many events at once."""

import random

import pytest
from pyspark.sql import functions as F

from formbook.operators.joins import calendar_of
from formbook.plans import contest, gates, state
from formbook.plans.features import build_features
from formbook.schemas import FEATURE_COLUMNS

FACTS = (
    "event_id long, season long, round long, venue_id long, entity_id long, group_id long, winner long, finish_order long, "
    "finished long, points long, quali_position long, grid long, q1 string, q2 string, q3 string"
)
KEYS = ["event_id", "entity_id"]


def make(seed=1, seasons=3, rounds=5, entities=9):
    """Facts in which entities skip events, change groups and start late."""
    rng = random.Random(seed)
    rows = []
    for season in range(2001, 2001 + seasons):
        for number in range(1, rounds + 1):
            field = [e for e in range(1, entities + 1) if rng.random() < 0.8 and (e < 8 or season > 2001)]
            places, quali = rng.sample(range(1, len(field) + 1), len(field)), rng.sample(range(1, len(field) + 1), len(field))
            for e, place, q in zip(field, places, quali):
                missed = rng.random() < 0.1
                rows.append((
                    season * 100 + number, season, number, (number * season) % 4, e, e % 3 + (season > 2002), int(place == 1), place,
                    int(rng.random() < 0.8), max(0, 11 - 2 * place), None if missed else q, None if missed else (0 if e == 5 else q),
                    f"1:{20 + q}.{rng.randint(100, 999)}", f"1:{19 + q}.5" if q <= 6 else None, f"1:{18 + q}.25" if q <= 3 else None,
                ))
    return rows


@pytest.fixture(scope="module")
def world(spark):
    facts = spark.createDataFrame(make(), FACTS).cache()
    events = sorted({(r["season"], r["round"], r["event_id"]) for r in facts.collect()})
    wet = [(e, None if e % 5 == 0 else float(e % 3), 20.0 + e % 7, float(e % 2), e % 2 == 0) for _, _, e in events]
    weather = spark.createDataFrame(wet, "event_id long, precip double, race_temp_c double, quali_precip_mm double, conditions_changed boolean").cache()
    standings, groups = contest.standings(facts).cache(), contest.group_standings(facts).cache()
    batch = build_features(facts.withColumn("grid", F.col("quali_position")), standings, groups, weather).cache()
    return facts, events, weather, standings, groups, batch


def cells(df):
    def tidy(v):
        return round(v, 9) if isinstance(v, float) else v

    rows = df.select(*KEYS, "group_id", "venue_id", "season", "round", *FEATURE_COLUMNS).collect()
    return sorted(tuple(tidy(v) for v in r) for r in rows)


def test_look_up_equals_batch_for_every_event_of_a_season(spark, world, tmp_path):
    facts, events, weather, standings, groups, batch = world
    states = state.build(facts.where("season < 2003"), weather)
    for at, (_, _, event) in enumerate(e for e in events if e[0] == 2003):
        state.save(states, f"{tmp_path}/{at}")
        states = state.load(spark, f"{tmp_path}/{at}")
        coming = facts.where(F.col("event_id") == event)
        # Of the event itself only entrants and qualifying; of history only states.
        known = coming.select("event_id", "season", "round", "venue_id").distinct()
        calendar = calendar_of(facts.where(F.col("event_id") <= event))
        made = state.materialise(known, coming, coming, states, standings.where(F.col("event_id") < event), groups.where(F.col("event_id") < event), weather, calendar)
        assert cells(made) == cells(batch.where(F.col("event_id") == event))
        states = state.advance(states, coming, weather)
    with pytest.raises(state.StateError, match="have seen"):
        state.advance(states, facts.where("season = 2003"), weather)


@pytest.mark.parametrize("hot", [False, True])
def test_many_events_equal_batch(spark, world, hot):
    facts, _, weather, standings, groups, batch = world
    if hot:
        spark.conf.set("spark.formbook.hotGroupRows", "3")
        spark.conf.set("spark.formbook.hotGroupSplits", "4")
        spark.conf.set("spark.formbook.broadcastRows", "2")
    try:
        made = state.materialise_many(facts, facts, standings, groups, weather)
        assert cells(made) == cells(batch)
    finally:
        for name in ("hotGroupRows", "hotGroupSplits", "broadcastRows"):
            spark.conf.unset(f"spark.formbook.{name}")


def test_some_events_equal_batch(world):
    facts, _, weather, standings, groups, batch = world
    some = F.col("event_id").isin(200101, 200203, 200305)
    made = state.materialise_many(facts.where(some), facts, standings, groups, weather)
    assert cells(made) == cells(batch.where(some))


def test_a_planted_leak_is_found(world):
    facts, _, weather, standings, groups, batch = world
    made = state.materialise_many(facts, facts, standings, groups, weather)
    assert gates.parity(batch, made, FEATURE_COLUMNS).where("NOT expected").count() == 0
    # A form that counts the event itself.
    own = facts.select(*KEYS, F.col("winner").alias("_own"))
    leaky = batch.join(own, KEYS).withColumn("driver_wins_last_5", F.coalesce("driver_wins_last_5", F.lit(0.0)) + F.col("_own"))
    found = gates.parity(leaky, made, FEATURE_COLUMNS).where("NOT expected")
    assert {r["column"] for r in found.collect()} == {"driver_wins_last_5"}
    # A model that uses it gives other shares, also where no grid has moved.
    def shares(df):
        raw = F.coalesce("driver_wins_last_5", F.lit(0.0)) + 1
        total = df.groupBy("event_id").agg(F.sum(raw).alias("_t"))
        return df.join(total, "event_id").select(*KEYS, (raw / F.col("_t")).alias("win_probability"))

    still = facts.select("event_id", F.lit(False).alias("moved")).distinct()
    assert gates.share_differences(shares(batch), shares(made), still).first()["unmoved_shares_off"] == 0
    assert gates.share_differences(shares(leaky), shares(made), still).first()["unmoved_shares_off"] > 0
    lost = gates.share_differences(shares(batch), shares(made.where("event_id > 200101")), still).first()
    assert lost["unmoved_shares_off"] == facts.where("event_id = 200101").count()


def test_merged_states_equal_one_state(world):
    facts, _, weather, _, _, _ = world
    whole = state.build(facts, weather)
    parts = [state.build(facts.where(c), weather) for c in ("season = 2001", "season = 2002", "season = 2003")]
    for kind, shape in state.shapes().items():
        merged = state.merge([p[kind] for p in parts], shape)
        columns = sorted(whole[kind].columns)
        # Sums of means may differ in the last bit.
        told = [F.round(c, 9).alias(c) if c.startswith("sum_") else F.col(c) for c in columns]
        rows = [sorted(str(r) for r in df.select(told).collect()) for df in (whole[kind], merged)]
        assert rows[0] == rows[1]


def test_entry_lists_are_checked(spark, world):
    facts, _, weather, standings, groups, _ = world
    past, coming = facts.where("event_id < 200305"), facts.where("event_id = 200305")
    event = coming.select("event_id", "season", "round", "venue_id").distinct()
    entities = facts.select("entity_id").distinct()

    def built(roster=coming, quali=coming, dimensions=None):
        return state.entry_list(event, roster, quali, dimensions)

    # No qualifying yet: NULLs, not made-up places.
    rows = built(quali=coming.limit(0), dimensions={"entity_id": entities}).collect()
    assert rows and all(r["quali_position"] is None and r["grid"] is None for r in rows)
    # A repeated qualifying row of another event is no matter here.
    elsewhere = coming.unionByName(past.where("event_id = 200304")).unionByName(past.where("event_id = 200304"))
    assert built(quali=elsewhere).count() == coming.count()
    refused = {
        "no entrants": {"roster": coming.limit(0)},
        "named twice": {"roster": coming.unionByName(coming.limit(1))},
        "more than one qualifying row": {"quali": coming.unionByName(coming.limit(1))},
        "unresolved entity_id": {"dimensions": {"entity_id": entities.where("entity_id > 1")}},
        "repeated entity_id": {"dimensions": {"entity_id": entities.unionByName(entities)}},
    }
    for what, given in refused.items():
        with pytest.raises(state.StateError, match=what):
            built(**given)
    states = state.build(past, weather)
    calendar = calendar_of(facts)
    with pytest.raises(state.StateError, match="have seen"):
        old = past.where("event_id = 200304")
        state.materialise(old.select("event_id", "season", "round", "venue_id").distinct(), old, old, states, standings, groups, weather, calendar)
    with pytest.raises(state.StateError, match="exactly one"):
        state.materialise(calendar_of(facts, "event_id", "venue_id"), coming, coming, states, standings, groups, weather, calendar)


def test_look_up_of_an_entity_without_history(spark, world):
    facts, _, weather, standings, groups, _ = world
    states = state.build(facts.where("event_id < 200305"), weather)
    coming = facts.where("event_id = 200305")
    new = coming.limit(1).withColumns({"entity_id": F.lit(99).cast("long"), "group_id": F.lit(77).cast("long")})
    event = coming.select("event_id", "season", "round", "venue_id").distinct()
    row = state.materialise(event, new, new, states, standings, groups, weather, calendar_of(facts)).first()
    assert row["driver_experience_races"] == 0 and row["driver_circuit_starts"] == 0 and row["driver_circuit_wins"] == 0.0
    for name in ("driver_wins_last_3", "driver_avg_finish_last_5", "constructor_wins_last_3", "qualifying_gap_to_teammate"):
        assert row[name] is None
