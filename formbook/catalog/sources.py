"""Scans and sinks (SURVEY section A). Files are written from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from formbook.catalog.features import KEYS
from formbook.catalog.registry import query, r6
from formbook.catalog.sqltext import sql
from formbook.operators.setops import concat
from formbook.plans import contest
from formbook.session import new_path
from formbook.sources import files
from formbook.sources.tables import table


@query(
    "a1_csv_scan",
    sql(
        """SELECT event_id, entity_id, position, q2, CASE WHEN entity_id % 3 <> 0 THEN round(temp, 6) END AS temp,
        position_text FROM contest""",
        "contest",
    ),
)
def a1(spark, folder):
    path = new_path(spark, "csv")
    raw = contest.facts(spark, folder).select(
        *KEYS,
        "position",
        F.coalesce("q2", F.lit("N/A")).alias("q2"),
        F.when(F.col("entity_id") % 3 == 0, "NA")
        .otherwise(F.coalesce(F.col("temp").cast("string"), F.lit("\\\\N")))
        .alias("temp"),
        "position_text",
    )
    files.append_csv(raw, path, raw.columns)
    from formbook.schemas import _struct, _D, _L, _S

    schema = _struct(event_id=_L, entity_id=_L, position=_L, q2=_S, temp=_D, position_text=_S)
    df = files.load_csv(spark, path, schema)
    return df.withColumn("temp", F.round("temp", 6))


@query(
    "a2_folder_scan",
    """SELECT 'customer.csv' AS name, (SELECT COUNT(*) FROM customer) AS n UNION ALL
    SELECT 'nation.csv', (SELECT COUNT(*) FROM nation) UNION ALL SELECT 'region.csv', (SELECT COUNT(*) FROM region)""",
)
def a2(spark, folder):
    base = new_path(spark, "folder")
    for name in ("customer", "nation", "region"):
        df = table(spark, folder, name)
        files.append_csv(df, f"{base}/{name}.csv", df.columns)
    table(spark, folder, "region").write.mode("overwrite").json(f"{base}/notes.json")
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in files.load_folder(spark, base).items()
    ]

    return concat(counts)


@query("a4_pruned_parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem")
def a4(spark, folder):
    return files.scan_parquet(spark, f"{folder}/lineitem.parquet", "l_orderkey", "l_quantity")


@query(
    "a6_json_field_scan",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COALESCE(json_extract_string(props, '$.missing'), 'none') AS missing FROM events""",
)
def a6(spark, folder):
    events = table(spark, folder, "events", "event_id", "props")
    parsed = F.from_json("props", "k long, missing string")
    return events.select("event_id", parsed.alias("p")).select(
        "event_id", "p.k", F.coalesce("p.missing", F.lit("none")).alias("missing")
    )


def result_payloads(facts):
    """Contest rows as the nested entries of a result payload."""
    entry = F.struct(
        F.struct(
            F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("driverId"),
            F.lit("Given").alias("givenName"),
            F.lit("Family").alias("familyName"),
        ).alias("Driver"),
        F.struct(
            F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("constructorId"),
            F.lit("Group").alias("name"),
        ).alias("Constructor"),
        F.col("entity_id").cast("string").alias("number"),
        F.col("grid").cast("string").alias("grid"),
        F.coalesce("position_text", F.lit("R")).alias("positionText"),
        F.col("points").cast("string").alias("points"),
        F.when(F.col("finished") == 1, F.col("finish_order").cast("string")).alias("laps"),
        F.when(
            F.col("finished") == 1,
            F.struct(F.col("q1").alias("time"), F.lit("1000").alias("millis")),
        ).alias("Time"),
        F.when(
            F.col("q2").isNotNull(),
            F.struct(
                F.lit("5").alias("lap"),
                F.col("quali_position").cast("string").alias("rank"),
                F.struct(F.col("q2").alias("time")).alias("Time"),
            ),
        ).alias("FastestLap"),
    )
    return facts.select("season", "round", "event_id", "finish_order", entry.alias("entry"))


PAGE = 1000


def result_pages(facts):
    """Payloads of an event in pages, so that no array holds a whole event."""
    page = F.floor((F.col("finish_order") - 1) / PAGE)
    entries = F.sort_array(F.collect_list(F.struct("finish_order", "entry")))
    paged = result_payloads(facts).groupBy("season", "round", page.alias("page")).agg(
        F.transform(entries, lambda x: x["entry"]).alias("Results")
    )
    return paged.select("season", "round", (F.col("page") * PAGE).alias("offset"), "Results")


@query(
    "a6_nested_results",
    sql(
        """SELECT season, round, 'e' || entity_id AS entity_ref, 'g' || group_id AS group_ref, grid, CASE WHEN finished = 1 THEN finish_order END AS position,
        COALESCE(position_text, 'R') AS position_text, CASE WHEN finished = 1 THEN 1 ELSE 31 END AS status_id, CAST(points AS DOUBLE) AS points,
        CASE WHEN finished = 1 THEN finish_order END AS laps, CASE WHEN finished = 1 THEN q1 END AS time,
        CASE WHEN q2 IS NOT NULL THEN quali_position END AS fastest_lap_rank, q2 AS fastest_lap_time,
        finish_order AS position_order FROM contest""",
        "contest",
    ),
)
def a6_nested(spark, folder):
    path = new_path(spark, "json")
    result_pages(contest.facts(spark, folder)).write.mode("overwrite").json(path)
    flat = files.flatten_results(spark.read.schema(files.RESULT_PAYLOAD).json(path))
    return flat.drop("number", "milliseconds", "fastest_lap")


@query(
    "a6_nested_qualifying",
    sql(
        """SELECT season, round, 'e' || entity_id AS entity_ref, 'g' || group_id AS group_ref, entity_id AS number, quali_position AS position,
        q1, q2, q3 FROM contest""",
        "contest",
    ),
)
def a6_qualifying(spark, folder):
    path = new_path(spark, "json")
    entry = F.struct(
        *_references(),
        F.col("entity_id").cast("string").alias("number"),
        F.col("quali_position").cast("string").alias("position"),
        F.col("q1").alias("Q1"),
        F.col("q2").alias("Q2"),
        F.col("q3").alias("Q3"),
    )
    _paged(contest.facts(spark, folder), entry, "quali_position", "QualifyingResults").write.mode("overwrite").json(path)
    return files.flatten_qualifying(spark.read.schema(files.QUALIFYING_PAYLOAD).json(path))


@query(
    "a6_nested_standings",
    sql(
        """SELECT s.season, s.round, 'e' || s.entity_id AS entity_ref, CAST(s.points AS DOUBLE) AS points, s.position, 'P' || s.position AS position_text,
        CAST(s.wins AS BIGINT) AS wins FROM standings s""",
        "standings",
    ),
)
def a6_standings(spark, folder):
    path = new_path(spark, "json")
    entry = F.struct(
        _references()[0],
        F.col("points").cast("string").alias("points"),
        F.col("position").cast("string").alias("position"),
        F.concat(F.lit("P"), F.col("position").cast("string")).alias("positionText"),
        F.col("wins").cast("string").alias("wins"),
    )
    rows = contest.standings(contest.facts(spark, folder))
    _paged(rows, entry, "position", "Standings").write.mode("overwrite").json(path)
    # Entries of persons name no group.
    return files.flatten_standings(spark.read.schema(files.STANDINGS_PAYLOAD).json(path)).drop("group_ref")


def _references():
    """The Driver and Constructor of a payload entry."""
    who = F.struct(
        F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("driverId"),
        F.lit("Given").alias("givenName"),
        F.lit("Family").alias("familyName"),
    )
    team = F.struct(F.concat(F.lit("g"), F.col("group_id").cast("string")).alias("constructorId"), F.lit("Group").alias("name"))
    return [who.alias("Driver"), team.alias("Constructor")]


def _paged(rows, entry, place, name):
    """Entries of an event as payloads of at most ``PAGE`` of them."""
    page = F.floor((F.col(place) - 1) / PAGE)
    paged = rows.groupBy("season", "round", page.alias("page")).agg(F.collect_list(entry).alias(name))
    return paged.select("season", "round", (F.col("page") * PAGE).alias("offset"), name)


def payload_files(spark, folder):
    """Folders of payload files of each kind, made from the contest."""
    facts = contest.facts(spark, folder)
    qualified = F.struct(
        *_references(),
        F.col("entity_id").cast("string").alias("number"),
        F.col("quali_position").cast("string").alias("position"),
        *[F.col(f"q{k}").alias(f"Q{k}") for k in (1, 2, 3)],
    )
    total = [F.col(c).cast("string").alias(c) for c in ("points", "position", "wins")]
    standings, groups, _ = contest.season_tables(spark, folder)
    pages = {
        "results": result_pages(facts),
        "qualifying": _paged(facts, qualified, "quali_position", "QualifyingResults"),
        "entity_standings": _paged(standings, F.struct(_references()[0], *total), "position", "Standings"),
        "group_standings": _paged(groups, F.struct(_references()[1], *total), "position", "Standings"),
    }
    paths = {kind: new_path(spark, kind) for kind in pages}
    for kind, path in paths.items():
        pages[kind].write.json(path)
    return paths


@query(
    "a7_geojson_points",
    """SELECT 0 AS at, l_quantity AS lon, l_tax AS lat FROM lineitem UNION ALL
    SELECT 1, CAST(l_partkey AS DOUBLE), l_discount FROM lineitem""",
)
def a7(spark, folder):
    path = new_path(spark, "geojson")
    ends = F.array(
        F.array("l_quantity", "l_tax"),
        F.array(F.col("l_partkey").cast("double"), F.col("l_discount")),
    )
    table(spark, folder, "lineitem", "l_quantity", "l_tax", "l_partkey", "l_discount").select(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), ends.alias("coordinates")).alias("geometry"),
    ).write.mode("overwrite").json(path)
    return files.line_points(spark, path, one_per_file=False).select("at", "lon", "lat")


@query(
    "a8_parquet_sink",
    sql("SELECT season, event_id, entity_id, points FROM contest", "contest"),
)
def a8(spark, folder):
    path = new_path(spark, "sink")
    df = contest.facts(spark, folder).select("season", *KEYS, "points")
    files.write_parquet(df, path, ["season"])
    return spark.read.parquet(path)


@query(
    "a9_csv_append_sink",
    sql("SELECT event_id, entity_id, position FROM contest", "contest"),
)
def a9(spark, folder):
    path = new_path(spark, "append")
    df = contest.facts(spark, folder)
    files.append_csv(df.where("season <= 1998"), path, [*KEYS, "position"])
    files.append_csv(df.where("season > 1998"), path, [*KEYS, "position"])
    from formbook.schemas import _struct, _L

    return files.load_csv(spark, path, _struct(event_id=_L, entity_id=_L, position=_L))


@query(
    "a10_change_report",
    sql(
        """SELECT 'results' AS "table", COUNT(*) AS rows FROM contest WHERE season >= 2001 UNION ALL
        SELECT 'qualifying', COUNT(*) FROM contest WHERE season >= 2001 AND q2 IS NOT NULL""",
        "contest",
    ),
)
def a10(spark, folder):
    new = contest.facts(spark, folder).where("season >= 2001")
    return files.change_report(
        {
            "results": new,
            "qualifying": new.where("q2 IS NOT NULL"),
            "weather": new.where("season < 0"),
        }
    )


SNAPSHOT = (
    "region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)


@query("a11_snapshot", " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS rows FROM {t}" for t in SNAPSHOT))
def a11(spark, folder):
    target = new_path(spark, "snapshot")
    files.publish(spark, folder, target, SNAPSHOT)
    counts = [
        spark.read.parquet(f"{target}/{t}.parquet").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("name"), "rows")
        for t in SNAPSHOT
    ]
    return concat(counts)


LINE_TEXT = ", ".join(
    f"coalesce(CAST({f'CAST({c} AS DECIMAL(38,6))' if c in ('l_quantity', 'l_extendedprice', 'l_discount', 'l_tax') else c} AS VARCHAR), '\\N')"
    for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate",
    )
)


@query(
    "a12_fingerprint",
    f"""WITH r AS (SELECT CAST('0x' || substr(md5(concat_ws('|', {LINE_TEXT})), 1, 12) AS BIGINT) AS v FROM lineitem)
    SELECT COUNT(*) AS rows, COUNT(*) || 'rows-' || substr(sha256(COUNT(*) || ':' || CAST(SUM(v) AS VARCHAR)), 1, 12) AS fingerprint,
    substr(sha256('l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, '
    || 'l_tax double, l_returnflag string, l_linestatus string, l_shipdate ' || (SELECT CASE typeof(l_shipdate) WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'timestamp' END FROM lineitem LIMIT 1)), 1, 12) AS schema_hash FROM r""",
)
def a12(spark, folder):
    lines = table(spark, folder, "lineitem")
    return files.fingerprint(lines).withColumn("schema_hash", F.lit(files.schema_hash(lines)))


@query("a13_freshness", "SELECT * FROM (VALUES ('orders', TRUE), ('customer', TRUE)) AS t(name, is_stamped)")
def a13(spark, folder):
    # File times are not in the tables: SQL can only tell that each has one, not later than now.
    stamps = [
        files.freshness(table(spark, folder, n)).select(F.lit(n).alias("name"), "fresh_at")
        for n in ("orders", "customer")
    ]
    stamped = F.coalesce(F.col("fresh_at") <= F.current_timestamp(), F.lit(False)).alias("is_stamped")
    return stamps[0].unionByName(stamps[1]).select("name", stamped)
