from __future__ import annotations

import pytest

from kpiloom.session import local_session
from tests.fixtures import g1_raw


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, name="kpiloom-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def raw(spark):
    return g1_raw(spark).cache()


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path)


# Tiny inputs: what Spark saves by compiling and re-planning, it spends many times over.
# The comparison with SQL and the plan tests run with the defaults.
LIGHT = {
    "spark.sql.codegen.wholeStage": "false",
    "spark.sql.adaptive.enabled": "false",
    "spark.sql.shuffle.partitions": "2",
}


@pytest.fixture(scope="module")
def light(spark):
    before = {key: spark.conf.get(key) for key in LIGHT}
    for key, value in LIGHT.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.set(key, value)
