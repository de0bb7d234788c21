"""CSV, JSON and GeoJSON scans; CSV and parquet sinks; snapshots and stamps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formbook.functions.scalars import NULL_TOKENS, null_tokens
from formbook.operators import quality as Q

NULL_TOKEN = NULL_TOKENS[0]


class SourceError(FileNotFoundError):
    """A source path that is not there."""


def paths_at(spark: SparkSession, pattern: str) -> list[str]:
    """Paths matching a glob, through the Hadoop file system of the path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(path)
    return sorted(str(s.getPath().toString()) for s in found) if found else []


def load_csv(
    spark: SparkSession, path: str, schema: T.StructType | None = None, required: bool = True
) -> DataFrame:
    """A headed CSV with every NULL token read as NULL.

    Without ``schema`` all columns stay text. With it, columns are cast; a
    value that does not fit its type raises when it is read. A missing path
    raises, or gives an empty frame of ``schema`` when ``required`` is False.
    """
    if not paths_at(spark, path):
        if required or schema is None:
            raise SourceError(path)
        return spark.createDataFrame([], schema)
    # The values come as text so that any token may stand for NULL in any type.
    reader = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        text = T.StructType([T.StructField(n, T.StringType()) for n in schema.names])
        reader = reader.schema(text).option("enforceSchema", False)
    raw = reader.csv(path)
    clean = raw.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in raw.columns])
    if schema is None:
        return clean
    return clean.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])


def load_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every ``*.csv`` of a folder by name; an empty folder gives an empty dict."""
    return {p.rsplit("/", 1)[1]: load_csv(spark, p) for p in paths_at(spark, f"{folder}/*.csv")}


def scan_parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


# --- fixed values: shape of the nested payloads ---------------------------------
_WHO = "struct<driverId:string,givenName:string,familyName:string>"
_TEAM = "struct<constructorId:string,name:string>"
RESULT_PAYLOAD = (
    "season long, round long, offset long, Results array<struct<"
    f"Driver:{_WHO},Constructor:{_TEAM},number:string,grid:string,positionText:string,"
    "points:string,laps:string,Time:struct<time:string,millis:string>,"
    "FastestLap:struct<lap:string,rank:string,Time:struct<time:string>>>>"
)
QUALIFYING_PAYLOAD = (
    "season long, round long, QualifyingResults array<struct<"
    f"Driver:{_WHO},Constructor:{_TEAM},number:string,position:string,"
    "Q1:string,Q2:string,Q3:string>>"
)
STANDINGS_PAYLOAD = (
    "season long, round long, Standings array<struct<"
    f"Driver:{_WHO},Constructor:{_TEAM},points:string,position:string,positionText:string,"
    "wins:string>>"
)
# ------------------------------------------------------------------------------


def flatten_results(payloads: DataFrame) -> DataFrame:
    """One row per result; the place in the array is the finishing order.

    A payload that is one of several pages of an event says in ``offset`` how many
    results stand on the pages before it.
    """
    from formbook.functions.scalars import finish_normalised

    rows = payloads.select(
        "season", "round", F.coalesce("offset", F.lit(0)).alias("_start"), F.posexplode("Results").alias("_at", "r")
    )
    return rows.select(
        "season",
        "round",
        (F.col("_start") + F.col("_at") + 1).cast("long").alias("position_order"),
        F.col("r.Driver.driverId").alias("entity_ref"),
        F.col("r.Constructor.constructorId").alias("group_ref"),
        F.col("r.number").try_cast("long").alias("number"),
        F.col("r.grid").try_cast("long").alias("grid"),
        finish_normalised("r.positionText").alias("_f"),
        F.coalesce("r.points", F.lit("0")).try_cast("double").alias("points"),
        F.col("r.laps").try_cast("long").alias("laps"),
        F.col("r.Time.time").alias("time"),
        F.col("r.Time.millis").try_cast("long").alias("milliseconds"),
        F.col("r.FastestLap.lap").try_cast("long").alias("fastest_lap"),
        F.col("r.FastestLap.rank").try_cast("long").alias("fastest_lap_rank"),
        F.col("r.FastestLap.Time.time").alias("fastest_lap_time"),
    ).select("*", "_f.position", "_f.position_text", "_f.status_id").drop("_f")


def flatten_qualifying(payloads: DataFrame) -> DataFrame:
    rows = payloads.select("season", "round", F.explode("QualifyingResults").alias("r"))
    return rows.select(
        "season",
        "round",
        F.col("r.Driver.driverId").alias("entity_ref"),
        F.col("r.Constructor.constructorId").alias("group_ref"),
        F.col("r.number").try_cast("long").alias("number"),
        F.col("r.position").try_cast("long").alias("position"),
        F.col("r.Q1").alias("q1"),
        F.col("r.Q2").alias("q2"),
        F.col("r.Q3").alias("q3"),
    )


def flatten_standings(payloads: DataFrame) -> DataFrame:
    """Entity rows carry ``entity_ref``, group rows only ``group_ref``."""
    rows = payloads.select("season", "round", F.explode("Standings").alias("r"))
    return rows.select(
        "season",
        "round",
        F.col("r.Driver.driverId").alias("entity_ref"),
        F.col("r.Constructor.constructorId").alias("group_ref"),
        F.col("r.points").try_cast("double").alias("points"),
        F.col("r.position").try_cast("long").alias("position"),
        F.col("r.positionText").alias("position_text"),
        F.col("r.wins").try_cast("long").alias("wins"),
    )


def line_points(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """(file, at, lon, lat): the ordered points of LineString features.

    Either each file is one feature, or each line is (which Spark can split).
    """
    schema = "geometry struct<type:string,coordinates:array<array<double>>>"
    lines = spark.read.schema(schema).option("multiLine", one_per_file).json(path)
    return (
        lines.where("geometry.type = 'LineString'")
        .select(F.col("_metadata.file_name").alias("file"), F.posexplode("geometry.coordinates"))
        .select("file", F.col("pos").alias("at"), F.col("col")[0].alias("lon"), F.col("col")[1].alias("lat"))
    )


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), dry_run: bool = False
) -> bool:
    """Overwrite ``path``; a dry run writes nothing. True when written.

    The rebalance hint gives files of even size per partition value and splits
    a value that holds most of the rows.
    """
    if dry_run:
        return False
    out = df.hint("rebalance", *partition_by) if partition_by else df
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return True


def write_checked(
    df: DataFrame,
    path: str,
    rules: Sequence[Q.Rule],
    partition_by: Sequence[str] = (),
    check: Callable[[Q.Observed, DataFrame], None] | None = None,
) -> Q.Observed:
    """Overwrite ``path`` with rows that keep all error rules, which the write counts.

    Rows go to a folder beside ``path`` first. It takes the place of ``path`` only
    when no error rule is broken and ``check`` (counts, written rows) does not raise;
    else ``path`` stays as it was, and the rows stay to be looked at.
    """
    spark = df.sparkSession
    pending = f"{path}.pending"
    out = df.hint("rebalance", *partition_by) if partition_by else df
    seen = Q.Observed(out, rules)
    seen.rows.write.mode("overwrite").partitionBy(*partition_by).parquet(pending)
    if check is not None:
        check(seen, spark.read.schema(df.schema).parquet(pending).select(*df.columns))
    else:
        Q.require(seen.report())
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (pending, path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(to, True)
    if not fs.rename(at, to):
        raise SourceError(f"{pending} could not be moved to {path}")
    return seen


def append_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Append in a fixed column order with NULL written as its token."""
    df.select(*columns).write.mode("append").option("header", True).option(
        "nullValue", NULL_TOKEN
    ).option("emptyValue", "").csv(path)


def change_report(new_rows: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) over the new rows of a run; tables without any are left out."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in new_rows.items()
    ]
    report = counts[0]
    for more in counts[1:]:
        report = report.unionByName(more)
    return report.where("rows > 0")


def write_change_report(new_rows: dict[str, DataFrame], folder: str) -> list[str]:
    """The totals and one folder per table with new rows; returns their names."""
    change_report(new_rows).write.mode("overwrite").json(f"{folder}/summary")
    spark = next(iter(new_rows.values())).sparkSession
    written = sorted(r["table"] for r in spark.read.schema("table string, rows long").json(f"{folder}/summary").collect())
    for name in written:
        append_csv(new_rows[name], f"{folder}/{name}", new_rows[name].columns)
    return written


def publish(spark: SparkSession, source: str, target: str, names: Sequence[str]) -> None:
    """Copy parquet tables to a snapshot, or none when one is missing."""
    missing = [n for n in names if not paths_at(spark, f"{source}/{n}.parquet")]
    if missing:
        raise SourceError(f"nothing published, missing {missing}")
    for name in names:
        spark.read.parquet(f"{source}/{name}.parquet").write.mode("overwrite").parquet(
            f"{target}/{name}.parquet"
        )


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, fingerprint): a content hash that row order does not change.

    A row is its values as text (numbers with fractions to six places, null as a
    mark of its own); the leading digits of its MD5 are summed, so that repeated rows
    do not cancel and other engines can compute the same.
    """

    def text(name: str, kind: str) -> Column:
        value = F.col(name).cast("decimal(38,6)") if kind in ("double", "float") or "decimal" in kind else F.col(name)
        return F.coalesce(value.cast("string"), F.lit("\\N"))

    digits = F.substring(F.md5(F.concat_ws("|", *[text(c, k) for c, k in df.dtypes])), 1, 12)
    number = F.conv(digits, 16, 10).cast("decimal(38,0)")
    parts = df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(number), F.lit(0)).alias("s"))
    digest = F.substring(F.sha2(F.concat_ws(":", F.col("rows"), F.col("s").cast("string")), 256), 1, 12)
    return parts.select(
        "rows", F.concat(F.col("rows").cast("string"), F.lit("rows-"), digest).alias("fingerprint")
    )


def schema_hash(df: DataFrame) -> str:
    """Hash of column names, order and types."""
    import hashlib

    return hashlib.sha256(", ".join(f"{c} {t}" for c, t in df.dtypes).encode()).hexdigest()[:12]


def freshness(df: DataFrame) -> DataFrame:
    """Latest modification time of the files behind a scan."""
    return df.select(F.col("_metadata.file_modification_time").alias("t")).agg(
        F.max("t").alias("fresh_at")
    )
