"""Column expressions of the contest domain; no Python functions run on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------
NULL_TOKENS = ("\\N", "\\\\N", "", "NA", "N/A")
DEFAULT_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
LAP_TIME = r"^\s*(?:(\d+):)?(\d{1,2}(?:\.\d+)?)\s*$"
STATUS_BY_CODE = {
    "R": "Retired",
    "D": "Disqualified",
    "E": "Disqualified",
    "N": "Did Not Start",
    "F": "Did Not Start",
    "W": "Withdrawn",
}
FINISHED_IDS = (1,)
DISQUALIFIED_IDS = (2, 92, 96)
NOT_STARTED_IDS = (54, 77, 81, 97)
GENERIC_FINISHED_ID, GENERIC_RETIRED_ID = 1, 31
ALLOWED_STATUSES = (
    "Finished", "Retired", "Disqualified", "Did Not Start", "Withdrawn", "Other",
)
WET_MM = 0.2
PENALTY_PLACES = 3
PROBABILITY_EPS = 1e-6
TIERS = (
    (0.50, "Strong favorite", 5),
    (0.30, "Clear favorite", 4),
    (0.20, "Slight edge", 3),
    (0.0, "Wide open", 2),
)
EARTH_RADIUS_M = 6_371_000.0
CLEAR_GAP, TIGHT_GAP, LATE_START = 0.15, 0.05, 5
CLEAR_LABEL = "Clear separation from the field (+%.0f%% over 2nd)"
TIGHT_LABEL = "Tight race — several close contenders"
POLE_LABEL = "Favorite started from pole"
LATE_LABEL = "Favorite started outside the top 5 (P%d)"
ERA_CAVEAT = (
    "Edge is biggest in dominance seasons (e.g. 2023) — competitive seasons run closer to the pole pick."
)
# ------------------------------------------------------------------------------


def _c(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def null_tokens(col, tokens=NULL_TOKENS + DEFAULT_NULL_TOKENS) -> Column:
    """Text with every NULL token turned to NULL."""
    return F.when(~_c(col).isin(*tokens), _c(col))


def result_status(position_text, status_id) -> Column:
    """Outcome category from the position text, then from the status id."""
    text, sid = _c(position_text), _c(status_id)
    out = F.when(text.rlike(r"^\d+$"), "Finished")
    for code, label in STATUS_BY_CODE.items():
        out = out.when(text == code, label)
    return (
        out.when(sid.isin(*FINISHED_IDS), "Finished")
        .when(sid.isin(*DISQUALIFIED_IDS), "Disqualified")
        .when(sid.isin(*NOT_STARTED_IDS), "Did Not Start")
        .when(sid.isNotNull(), "Retired")
        .otherwise("Other")
    )


def is_finished(status) -> Column:
    return _c(status) == "Finished"


def repaired_position(position, position_text, finished) -> Column:
    """A finisher's missing position read from digits in the position text."""
    digits = F.regexp_extract(_c(position_text), r"^(\d+)$", 1)
    return F.when(
        _c(finished) & _c(position).isNull(), digits.try_cast("long")
    ).otherwise(_c(position))


def is_winner(order) -> Column:
    return F.coalesce(_c(order) == 1, F.lit(False)).cast("long")


def lap_seconds(text) -> Column:
    """``[M:]SS[.sss]`` as seconds; NULL when malformed."""
    t = _c(text)
    minutes = F.coalesce(F.regexp_extract(t, LAP_TIME, 1).try_cast("double"), F.lit(0.0))
    seconds = F.regexp_extract(t, LAP_TIME, 2).try_cast("double")
    return minutes * 60 + seconds


def strict_lap_seconds(text) -> Column:
    """``M:SS.sss`` with the colon required; NULL when malformed."""
    t = _c(text)
    minutes = F.trim(F.substring_index(t, ":", 1)).try_cast("int")
    seconds = F.trim(F.substring(t, F.locate(":", t) + 1, F.length(t))).try_cast("double")
    return F.when(t.contains(":"), minutes * 60 + seconds)


def best_time(*times) -> Column:
    """The first time that is there, latest session first."""
    return F.coalesce(*[_c(t) for t in times])


def adjusted_grid(grid, field_size) -> Column:
    """Grid 0 (pit lane) becomes one past the field."""
    return F.when(_c(grid) == 0, _c(field_size) + 1).otherwise(_c(grid))


def over_threshold(value: Column, threshold: float) -> Column:
    return F.coalesce(value > threshold, F.lit(False))


def finish_normalised(text) -> Column:
    """(position, position_text, status_id) of a raw position text."""
    t = _c(text)
    digits = t.rlike(r"^\d+$")
    return F.struct(
        F.when(digits, t.try_cast("long")).alias("position"),
        t.alias("position_text"),
        F.when(digits, GENERIC_FINISHED_ID).otherwise(GENERIC_RETIRED_ID).cast("long").alias(
            "status_id"
        ),
    )


def flag_from_text(text) -> Column:
    """"True"/"False" text as 1.0/0.0; anything else NULL."""
    return F.when(_c(text) == "True", 1.0).when(_c(text) == "False", 0.0)


def is_wet(precip) -> Column:
    """NULL stays NULL: unknown weather is neither wet nor dry."""
    return _c(precip) > WET_MM


def condition_changed(before, during) -> Column:
    return is_wet(before) != is_wet(during)


def clip_probability(p) -> Column:
    # least and greatest skip NULL, so an unknown probability is kept apart.
    clipped = F.greatest(F.lit(PROBABILITY_EPS), F.least(F.lit(1 - PROBABILITY_EPS), _c(p)))
    return F.when(_c(p).isNotNull(), clipped)


def tier_label(p) -> Column:
    return _tier(p, 1)


def tier_stars(p) -> Column:
    return _tier(p, 2).cast("long")


def _tier(p, slot: int) -> Column:
    out = None
    for tier in TIERS[:-1]:
        hit = _c(p) >= tier[0]
        out = F.when(hit, tier[slot]) if out is None else out.when(hit, tier[slot])
    return out.otherwise(TIERS[-1][slot])


def grid_text(grid) -> Column:
    """"PL" for the pit lane, a dash for unknown, else two digits or more."""
    g = _c(grid)
    text = g.cast("long").cast("string")
    return (
        F.when(g.isNull(), "—")
        .when(g == 0, "PL")
        .otherwise(F.when(F.length(text) < 2, F.lpad(text, 2, "0")).otherwise(text))
    )


def grid_delta(grid, rank) -> Column:
    return F.when(_c(grid) != 0, _c(grid) - _c(rank))


def event_label(name, season, round_) -> Column:
    """The name, or "Round N · season" when there is none."""
    return F.coalesce(
        _c(name),
        F.concat(F.lit("Round "), _c(round_).cast("string"), F.lit(" · "), _c(season).cast("string")),
    )


def full_name(first, last) -> Column:
    return F.concat_ws(" ", _c(first), _c(last))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    half_lat = (p2 - p1) / 2
    half_lon = F.radians(_c(lon2) - _c(lon1)) / 2
    chord = F.pow(F.sin(half_lat), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(half_lon), 2)
    metres = 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(chord)))
    # least skips NULL: without an end point there is no leg.
    return F.when(chord.isNotNull(), metres)


def confidence_reasons(gap, grid) -> Column:
    """What speaks for or against a favourite, in order; the caveat always does.

    ``gap`` is its lead over the runner-up (NULL without one), ``grid`` its start.
    """
    gap, grid = _c(gap), _c(grid)
    return F.array_compact(
        F.array(
            F.when(gap >= CLEAR_GAP, F.format_string(CLEAR_LABEL, gap * 100)).when(gap < TIGHT_GAP, F.lit(TIGHT_LABEL)),
            F.when(grid == 1, F.lit(POLE_LABEL)).when(grid > LATE_START, F.format_string(LATE_LABEL, grid)),
            F.lit(ERA_CAVEAT),
        )
    )


def any_of(reasons: dict[str, Column]) -> Column:
    """Labels whose condition holds, in the given order."""
    return F.array_compact(
        F.array(*[F.when(cond, F.lit(label)) for label, cond in reasons.items()])
    )
