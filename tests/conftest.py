import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from formbook.session import build_session

    session = build_session(
        "tests", "local[8]", **{"spark.sql.shuffle.partitions": 4, "spark.driver.memory": "6g"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cut_small(spark):
    """Treat groups above three rows as hot, in sixteen pieces."""
    spark.conf.set("spark.formbook.hotGroupRows", "3")
    spark.conf.set("spark.formbook.hotGroupSplits", "16")
    yield
    spark.conf.unset("spark.formbook.hotGroupRows")
    spark.conf.unset("spark.formbook.hotGroupSplits")
