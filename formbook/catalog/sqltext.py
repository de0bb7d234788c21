"""SQL building blocks for the checks: the contest view and what derives from it.

Every check is a list of named CTEs put before a final SELECT by ``sql``.
"""

from __future__ import annotations

CONTEST = """
agg AS (
  SELECT year(o_orderdate) AS season, month(o_orderdate) AS round,
         o_custkey AS entity_id, CAST(c_nationkey AS BIGINT) AS group_id,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS score,
         MIN(o_orderkey) AS first_order,
         MAX(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished
  FROM orders JOIN customer ON o_custkey = c_custkey
  GROUP BY year(o_orderdate), month(o_orderdate), o_custkey, c_nationkey),
ranked AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY season, round ORDER BY score DESC, entity_id) AS finish_order,
            ROW_NUMBER() OVER (PARTITION BY season, round ORDER BY first_order, entity_id) AS quali_position
  FROM agg),
contest AS (
  SELECT CAST(season * 100 + round AS BIGINT) AS event_id, CAST(season AS BIGINT) AS season,
         CAST(round AS BIGINT) AS round, CAST(round AS BIGINT) AS venue_id, entity_id, group_id,
         finish_order, CAST(finished AS BIGINT) AS finished, quali_position,
         CASE WHEN entity_id % 17 = 0 THEN 0 ELSE quali_position END AS grid,
         CAST(CASE WHEN finish_order = 1 THEN 1 ELSE 0 END AS BIGINT) AS winner,
         CASE WHEN finished = 1 THEN finish_order END AS position,
         CAST(CASE finish_order WHEN 1 THEN 25 WHEN 2 THEN 18 WHEN 3 THEN 15 WHEN 4 THEN 12 WHEN 5 THEN 10
              WHEN 6 THEN 8 WHEN 7 THEN 6 WHEN 8 THEN 4 WHEN 9 THEN 2 WHEN 10 THEN 1 ELSE 0 END AS BIGINT) AS points,
         concat('1:', lpad(CAST(20 + entity_id * 7 % 30 AS VARCHAR), 2, '0'), '.', lpad(CAST(entity_id * 131 % 1000 AS VARCHAR), 3, '0')) AS q1,
         CASE WHEN quali_position <= 15 THEN concat('1:', lpad(CAST(19 + entity_id * 7 % 30 AS VARCHAR), 2, '0'), '.', lpad(CAST(entity_id * 97 % 1000 AS VARCHAR), 3, '0')) END AS q2,
         CASE WHEN quali_position <= 10 THEN concat('1:', lpad(CAST(19 + entity_id * 7 % 30 AS VARCHAR), 2, '0'), '.', lpad(CAST(entity_id * 61 % 1000 AS VARCHAR), 3, '0')) END AS q3,
         CASE WHEN (season + round) % 13 = 0 THEN NULL ELSE CAST((season * 31 + round * 17) % 10 AS DOUBLE) / 10 END AS precip,
         CASE WHEN (season + round) % 11 = 0 THEN NULL ELSE CAST((season * 7 + round * 3) % 30 AS DOUBLE) END AS temp,
         CASE WHEN (season + round) % 7 = 0 THEN NULL ELSE CAST((season * 13 + round * 29) % 10 AS DOUBLE) / 10 END AS quali_precip,
         CASE WHEN finished = 1 THEN CAST(finish_order AS VARCHAR) WHEN entity_id % 5 = 0 THEN 'R' WHEN entity_id % 5 = 1 THEN 'D'
              WHEN entity_id % 5 = 2 THEN 'W' WHEN entity_id % 5 = 3 THEN 'N' END AS position_text,
         CAST(CASE WHEN finished = 1 THEN 1 WHEN entity_id % 6 = 0 THEN 2 WHEN entity_id % 6 = 1 THEN 96 WHEN entity_id % 6 = 2 THEN 54
              WHEN entity_id % 6 = 3 THEN 81 WHEN entity_id % 6 = 4 THEN 3 END AS BIGINT) AS status_id,
         first_order AS result_id
  FROM ranked)"""

# Outcome category of each contest row.
STATUSED = """
statused AS (
  SELECT *, CASE WHEN regexp_matches(position_text, '^[0-9]+$') THEN 'Finished'
      WHEN position_text = 'R' THEN 'Retired' WHEN position_text IN ('D', 'E') THEN 'Disqualified'
      WHEN position_text IN ('N', 'F') THEN 'Did Not Start' WHEN position_text = 'W' THEN 'Withdrawn'
      WHEN status_id = 1 THEN 'Finished' WHEN status_id IN (2, 92, 96) THEN 'Disqualified'
      WHEN status_id IN (54, 77, 81, 97) THEN 'Did Not Start' WHEN status_id IS NOT NULL THEN 'Retired'
      ELSE 'Other' END AS result_status
  FROM contest)"""

CALENDAR = """
calendar AS (SELECT DISTINCT event_id, season, round, venue_id FROM contest)"""

STANDINGS = """
standing_sums AS (
  SELECT event_id, season, round, entity_id,
         CAST(SUM(points) OVER w AS BIGINT) AS points, CAST(SUM(winner) OVER w AS BIGINT) AS wins
  FROM contest WINDOW w AS (PARTITION BY season, entity_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
standings AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY points DESC, entity_id) AS position FROM standing_sums)"""

GROUP_EVENTS = """
group_events AS (
  SELECT group_id, event_id, season, round, venue_id, MAX(winner) AS win,
         CAST(SUM(CASE WHEN finish_order <= 3 THEN 1 ELSE 0 END) AS BIGINT) AS podiums,
         AVG(1.0 - finished) AS dnf_rate, AVG(finish_order) AS finish,
         CAST(SUM(points) AS BIGINT) AS points, MAX(precip) AS precip
  FROM contest GROUP BY group_id, event_id, season, round, venue_id)"""

GROUP_STANDINGS = """
group_standing_sums AS (
  SELECT event_id, season, round, group_id,
         CAST(SUM(points) OVER w AS BIGINT) AS points, CAST(SUM(win) OVER w AS BIGINT) AS wins
  FROM group_events WINDOW w AS (PARTITION BY season, group_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
group_standings AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY points DESC, group_id) AS position FROM group_standing_sums)"""

PREV_EVENT = """
prev_map AS (SELECT event_id, LAG(event_id) OVER (ORDER BY season, round) AS prev_event_id FROM calendar)"""

CONDITIONS = """
conditions AS (
  SELECT DISTINCT event_id, precip, temp, quali_precip,
         CASE WHEN (quali_precip > 0.2) <> (precip > 0.2) THEN 'True'
              WHEN (quali_precip > 0.2) = (precip > 0.2) THEN 'False' ELSE '' END AS changed_text
  FROM contest)"""

# A prediction per row: 1 / qualifying position, shared within the event.
SCORED = """
scored AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY p DESC, entity_id) AS predicted_rank FROM (
    SELECT *, p_raw / SUM(p_raw) OVER (PARTITION BY event_id) AS p FROM (
      SELECT *, 1.0 / quali_position AS p_raw FROM contest)))"""

# The pole rule: 1 for adjusted grid 1.
POLE_SCORED = """
pole_scored AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY p DESC, entity_id) AS predicted_rank FROM (
    SELECT *, CASE WHEN SUM(p_raw) OVER w <= 0 THEN 1.0 / COUNT(*) OVER w ELSE p_raw / SUM(p_raw) OVER w END AS p FROM (
      SELECT *, CASE WHEN grid = 1 THEN 1.0 ELSE 0.0 END AS p_raw FROM contest)
    WINDOW w AS (PARTITION BY event_id)))"""

PARTS = {
    "contest": ((), CONTEST),
    "statused": (("contest",), STATUSED),
    "calendar": (("contest",), CALENDAR),
    "standings": (("contest",), STANDINGS),
    "group_events": (("contest",), GROUP_EVENTS),
    "group_standings": (("group_events",), GROUP_STANDINGS),
    "prev_map": (("calendar",), PREV_EVENT),
    "conditions": (("contest",), CONDITIONS),
    "scored": (("contest",), SCORED),
    "pole_scored": (("contest",), POLE_SCORED),
}


def sql(select: str, *needs: str) -> str:
    """``select`` with the named CTEs (and what they need) in front.

    A ``select`` that starts with WITH keeps its own CTEs after them.
    """
    ordered: list[str] = []

    def add(name: str) -> None:
        for below in PARTS[name][0]:
            add(below)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    text = select.strip()
    ctes = ",".join(PARTS[n][1] for n in ordered)
    if not ctes:
        return text
    if text[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{text[5:]}"
    return f"WITH {ctes}\n{text}"
