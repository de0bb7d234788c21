"""Sources, repair, rules and the raw-to-features run."""

import pytest
from pyspark.sql import functions as F

from formbook import schemas as H
from formbook.operators import quality as Q
from formbook.operators.keys import number_after, reconcile
from formbook.plans import pipeline
from formbook.sources import files

RAW = (
    "resultId long, raceId long, driverId long, constructorId long, grid long, position long, "
    "positionText string, points double, laps long, statusId long"
)


def results(spark, *rows):
    return spark.createDataFrame(rows, RAW)


def test_repair_prefers_finished_then_latest(spark):
    raw = results(
        spark,
        (1, 1, 1, 1, 1, 1, "1", 25.0, 50, 1),
        (9, 1, 1, 1, 1, None, "R", 0.0, 10, 3),
        (2, 1, 2, 1, 2, None, "R", 0.0, 5, 3),
        (3, 1, 2, 1, 2, None, "R", 0.0, 6, 3),
        (4, 2, 1, 1, 1, None, "4", 12.0, 50, 1),
    )
    fixed = pipeline.repair_results(pipeline.clean_results(raw))
    got = {(r["raceId"], r["driverId"]): (r["resultId"], r["position"]) for r in fixed.collect()}
    assert got == {(1, 1): (1, 1), (1, 2): (3, None), (2, 1): (4, 4)}
    again = pipeline.repair_results(fixed)
    assert sorted(map(str, again.collect())) == sorted(map(str, fixed.collect()))


@pytest.mark.parametrize(
    ("text", "status_id", "want"),
    [
        ("7", None, "Finished"), ("R", 1, "Retired"), ("D", None, "Disqualified"),
        ("E", None, "Disqualified"), ("N", None, "Did Not Start"), ("F", None, "Did Not Start"),
        ("W", None, "Withdrawn"), (None, 1, "Finished"), (None, 92, "Disqualified"),
        ("?", 54, "Did Not Start"), ("?", 5, "Retired"), (None, None, "Other"),
    ],
)
def test_result_status(spark, text, status_id, want):
    from formbook.functions.scalars import result_status

    df = spark.createDataFrame([(text, status_id)], "t string, s long")
    assert df.select(result_status("t", "s")).first()[0] == want


def test_missing_ids_raise(spark):
    bad = results(spark, (1, 1, None, 1, 1, 1, "1", 25.0, 50, 1))
    with pytest.raises(Q.QualityError, match="driverId"):
        pipeline.clean_results(bad)
    with pytest.raises(H.SchemaError):
        pipeline.clean_results(bad.drop("raceId"))


def test_all_broken_rules_are_reported_together(spark):
    raw = results(
        spark,
        (1, 1, 1, 1, 1, None, "1", -5.0, 50, 1),
        (2, 1, 1, 1, 1, 40, "R", 0.0, 50, 3),
    )
    report = pipeline.results_report(pipeline.clean_results(raw))
    n = {r["rule"]: r["n"] for r in report.collect()}
    assert n["points outside [0, None]"] == 1 and n["finished without position"] == 1
    assert n["unfinished with position"] == 1 and n["position outside [1, 34]"] == 1
    assert n["repeated (race, driver)"] == 2
    with pytest.raises(Q.QualityError) as error:
        Q.require(report)
    assert "points" in str(error.value) and "repeated" in str(error.value)
    row = Q.verdict(report).first()
    assert (row["passed"], row["errors"], row["warnings"]) == (False, 3, 2)


def write(folder, name, text):
    (folder / f"{name}.csv").write_text(text)


@pytest.fixture
def racing_folder(tmp_path):
    rows = ["resultId,raceId,driverId,constructorId,number,grid,position,positionText,positionOrder,points,laps,time,milliseconds,fastestLap,rank,fastestLapTime,fastestLapSpeed,statusId"]
    quali = ["qualifyId,raceId,driverId,constructorId,number,position,q1,q2,q3"]
    own = ["driverStandingsId,raceId,driverId,points,position,positionText,wins"]
    team = ["constructorStandingsId,raceId,constructorId,points,position,positionText,wins"]
    n = 0
    for race in (1, 2):
        for driver in (1, 2):
            n += 1
            place = driver if race == 1 else 3 - driver
            points = 25 if place == 1 else 18
            rows.append(f"{n},{race},{driver},{driver},\\N,{driver},{place},{place},{place},{points},50,\\N,\\N,\\N,\\N,1:20.000,\\N,1")
            if not (race == 2 and driver == 2):
                quali.append(f"{n},{race},{driver},{driver},\\N,{driver},1:25.000,\\N,\\N")
            own.append(f"{n},{race},{driver},{points},{place},{place},1")
            team.append(f"{n},{race},{driver},{points},{place},{place},1")
    write(tmp_path, "results", "\n".join(rows) + "\n")
    write(tmp_path, "qualifying", "\n".join(quali) + "\n")
    write(tmp_path, "driver_standings", "\n".join(own) + "\n")
    write(tmp_path, "constructor_standings", "\n".join(team) + "\n")
    write(tmp_path, "races", "raceId,year,round,circuitId,name,date,url\n1,2020,1,7,A GP,2020-03-01,x\n2,2020,2,7,B GP,2020-03-08,y\n")
    write(tmp_path, "circuits", "circuitId,circuitRef,name,location,country,lat,lng,alt\n7,seven,Seven,Town,Land,1.5,2.5,\\N\n")
    write(tmp_path, "drivers", "driverId,driverRef,code,forename,surname,dob,nationality\n1,one,ONE,A,One,1990-01-01,X\n2,two,TWO,B,Two,N/A,Y\n")
    write(tmp_path, "constructors", "constructorId,constructorRef,name,nationality\n1,c1,Red,X\n2,c2,Blue,Y\n")
    write(tmp_path, "race_weather", "raceId,race_precip_mm,race_temp_c,quali_precip_mm,conditions_changed\n1,0.0,20,0.5,True\n2,1.0,18,,\n")
    return tmp_path


def test_raw_to_features(spark, racing_folder, tmp_path):
    out = tmp_path / "out"
    dry = pipeline.run(spark, str(racing_folder), str(out), dry_run=True)
    assert not out.exists()
    tables = pipeline.run(spark, str(racing_folder), str(out))
    master = {(r["raceId"], r["driverId"]): r for r in tables["master"].collect()}
    assert tables["master"].columns == list(H.MASTER_COLUMNS) and len(master) == 4
    assert master[2, 2]["qualifying_position"] is None and master[2, 2]["winner"] == 1
    assert master[1, 1]["race_name"] == "A GP" and master[1, 2]["driver_dob"] is None
    features = {(r["raceId"], r["driverId"]): r for r in tables["features"].collect()}
    assert tables["features"].columns == list(H.FEATURE_TABLE_COLUMNS)
    assert features[2, 1]["driver_wins_last_3"] == 1
    assert features[2, 1]["driver_standing_points_prev"] == 25
    assert features[1, 1]["driver_standing_points_prev"] is None
    assert features[1, 1]["conditions_changed"] == 1.0
    assert features[2, 1]["conditions_changed"] is None
    assert sorted(map(str, dry["features"].collect())) == sorted(map(str, tables["features"].collect()))


def test_run_reports_every_table_and_keeps_the_last_good_one(spark, racing_folder, tmp_path):
    out = str(tmp_path / "out")
    report = pipeline.run(spark, str(racing_folder), out)["report"]
    n = {(r["table"], r["rule"]): (r["severity"], r["n"]) for r in report.collect()}
    assert {t for t, _ in n} == {"results", "qualifying", "inputs", "master", "features"}
    assert n["features", "driver_standing_position_prev is null"] == ("note", 2)
    assert n["master", "row count differs from the step before"] == ("error", 0)
    assert n["master", "races without one winner"] == ("warning", 0)
    assert spark.read.parquet(f"{out}/interim/results.parquet").count() == 4
    bad = (racing_folder / "results.csv").read_text().replace(",25,50,", ",-25,50,", 1)
    (racing_folder / "results.csv").write_text(bad)
    with pytest.raises(Q.QualityError, match="points"):
        pipeline.run(spark, str(racing_folder), out)
    assert spark.read.parquet(f"{out}/interim/results.parquet").where("points < 0").count() == 0
    assert spark.read.parquet(f"{out}/interim/results.parquet.pending").where("points < 0").count() == 1
    assert spark.read.parquet(f"{out}/master.parquet").count() == 4


def test_a_write_counts_its_rules_without_another_job(spark, tmp_path):
    df = spark.range(1000).withColumn("part", F.col("id") % 3)
    rules = [Q.Rule("odd", "warning", F.col("id") % 2 == 1), Q.Rule("large", "error", F.col("id") > 5000)]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "")
    seen = files.write_checked(df, str(tmp_path / "t"), rules, ["part"], lambda counts, rows: None)
    written = len(tracker.getJobIdsForGroup("observed"))
    assert (seen.count(), seen.broken("odd"), seen.broken("large")) == (1000, 500, 0)
    assert len(tracker.getJobIdsForGroup("observed")) == written
    spark.sparkContext._jsc.clearJobGroup()
    got = [tuple(r) for r in seen.report().orderBy("rule").collect()]
    assert got == [tuple(r) for r in Q.run_rules(df, rules).orderBy("rule").collect()]
    empty = files.write_checked(df.limit(0), str(tmp_path / "e"), rules)
    assert empty.count() == 0 and spark.read.parquet(str(tmp_path / "e")).count() == 0


def test_rule_samples_are_the_smallest_keys(spark):
    df = spark.range(0, 100, 1, 7).withColumn("k", 99 - F.col("id"))
    rules = [Q.Rule("all", "error", F.lit(True)), Q.Rule("few", "error", F.col("k").isin(98, 3)), Q.Rule("none", "error", F.lit(None).cast("boolean"))]
    got = {r["rule"]: (r["n"], r["sample"] and [s["k"] for s in r["sample"]]) for r in Q.run_rules_sampled(df, rules, ["k"]).collect()}
    assert got == {"all": (100, [0, 1, 2, 3, 4]), "few": (2, [3, 98]), "none": (0, None)}
    plan = Q.run_rules_sampled(df, rules, ["k"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_dimension_without_a_row_is_an_error(spark, racing_folder):
    write(racing_folder, "drivers", "driverId,driverRef,code,forename,surname,dob,nationality\n1,one,ONE,A,One,1990-01-01,X\n")
    with pytest.raises(Q.QualityError, match="driverId without"):
        pipeline.run(spark, str(racing_folder), str(racing_folder / "out"), dry_run=True)


def test_null_tokens_and_missing_files(spark, tmp_path):
    write(tmp_path, "t", 'a,b\n1,\\N\n2,NA\n3,N/A\n4,""\n5,null\n6,x\n')
    struct = H._struct(a=H._L, b=H._S)
    df = files.load_csv(spark, str(tmp_path / "t.csv"), struct)
    assert [r["b"] for r in df.orderBy("a").collect()] == [None] * 5 + ["x"]
    with pytest.raises(files.SourceError):
        files.load_csv(spark, str(tmp_path / "no.csv"), struct)
    assert files.load_csv(spark, str(tmp_path / "no.csv"), struct, required=False).count() == 0
    (tmp_path / "notes.txt").write_text("x")
    assert list(files.load_folder(spark, str(tmp_path))) == ["t.csv"]
    empty = tmp_path / "empty"
    empty.mkdir()
    assert files.load_folder(spark, str(empty)) == {}


def test_value_that_does_not_fit_raises(spark, tmp_path):
    write(tmp_path, "t", "a\nseven\n")
    df = files.load_csv(spark, str(tmp_path / "t.csv"), H._struct(a=H._L))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        df.collect()


def test_publish_all_or_nothing(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a.parquet"))
    with pytest.raises(files.SourceError, match="b"):
        files.publish(spark, str(tmp_path), str(tmp_path / "snap"), ["a", "b"])
    assert not (tmp_path / "snap").exists()
    files.publish(spark, str(tmp_path), str(tmp_path / "snap"), ["a"])
    assert spark.read.parquet(str(tmp_path / "snap/a.parquet")).count() == 3


def test_fingerprint_ignores_order_not_content(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k long, v string")
    print_ = files.fingerprint(df).first()["fingerprint"]
    assert files.fingerprint(df.orderBy(F.desc("k"))).first()["fingerprint"] == print_
    assert print_.startswith("3rows-")
    for other in (df.distinct(), df.where("k = 2"), df.withColumn("v", F.lit("c"))):
        assert files.fingerprint(other).first()["fingerprint"] != print_


def test_change_report_leaves_out_empty_tables(spark, tmp_path):
    rows = spark.range(2)
    names = files.write_change_report({"a": rows, "b": rows.where("id < 0")}, str(tmp_path / "r"))
    assert names == ["a"] and not (tmp_path / "r/b").exists()


def test_key_reconciliation(spark):
    dim = spark.createDataFrame([("x", 4), ("y", 7)], "ref string, id long")
    seen = spark.createDataFrame(
        [("new2", 5), ("x", 1), ("new1", 5), ("new2", 9), ("first", 2)], "ref string, seq long"
    )
    got = {r["ref"]: r["id"] for r in reconcile(seen, dim, "ref", "id", "seq").collect()}
    assert got == {"x": 4, "first": 8, "new1": 9, "new2": 10}


def test_row_ids_continue(spark, cut_small):
    old = spark.createDataFrame([(41,)], "id long")
    new = spark.range(20).select(F.col("id").alias("at"))
    got = {r["at"]: r["id"] for r in number_after(new, old, "id", [("at", True)]).collect()}
    assert got == {i: 42 + i for i in range(20)}


def test_path_length_of_a_closed_ring(spark, cut_small):
    from formbook.operators.paths import path_length

    points = [(1, i, 0.0, float(i)) for i in range(5)] + [(1, 5 + i, 0.0, float(3 - i)) for i in range(3)]
    df = spark.createDataFrame(points, "k long, at long, lat double, lon double")
    degree = 2 * 3.141592653589793 * 6_371_000 / 360
    got = path_length(df, ["k"], [("at", True)], closed=True).first()["metres"]
    assert got == pytest.approx(8 * degree, rel=1e-9)
