"""formbook: contest analytics on PySpark DataFrames.

Facts carry one row per (event, entity). Entities belong to groups, events to
venues and seasons, and only what was known before an event may describe it.
"""
