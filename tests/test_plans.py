"""The plans are the ones meant: pruned scans, limits before the shuffle, few shuffles."""

import re

import pytest
from pyspark.sql import functions as F

from formbook.catalog.features import features_of
from formbook.catalog.joins import top_k
from formbook.plans import contest

FOLDER = "/root/testdata/sf0.001"


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.fixture
def facts(spark):
    return contest.facts(spark, FOLDER)


def test_season_filter_prunes_partitions_and_columns(facts, capsys):
    text = plan(facts.where("season = 1998").select("entity_id", "points"), capsys)
    assert re.search(r"PartitionFilters: \[.*season", text)
    read = re.search(r"ReadSchema: (.*)", text).group(1)
    assert "points" in read and "quali_position" not in read


def test_top_k_limits_before_the_shuffle(facts, capsys):
    out = top_k(facts, ["event_id"], [F.desc("points"), F.asc("entity_id")], 3)
    text = plan(out, capsys)
    assert text.count("WindowGroupLimit") >= 2


def test_feature_build_shuffles_rows_by_entity_once(spark, capsys):
    text = plan(features_of(spark, FOLDER), capsys)
    # The second is the narrow branch that pools weather deltas per event.
    assert len(re.findall(r"hashpartitioning\(entity_id#\d+L?, ", text)) <= 2
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_no_python_runs_on_rows(spark, capsys):
    text = plan(features_of(spark, FOLDER), capsys)
    assert "Python" not in text and "ArrowEval" not in text
