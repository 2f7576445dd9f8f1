"""Where lineage is cut, seen from sessions of their own."""

from __future__ import annotations

import subprocess
import sys
import textwrap

import pytest

from kpiloom import session


def _in_new_session(code: str) -> str:
    done = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, timeout=300, check=True
    )
    return done.stdout


def test_the_folder_the_cluster_names_is_used(folder):
    out = _in_new_session(f"""
        from pyspark.sql import SparkSession
        from kpiloom.session import cut_lineage, ensure_checkpoint_dir
        spark = (SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
                 .config("spark.checkpoint.dir", "{folder}/shared").getOrCreate())
        cut_lineage(spark.range(5)).count()
        print("DIR", ensure_checkpoint_dir(spark), spark.sparkContext.getCheckpointDir())
    """)
    line = next(part for part in out.splitlines() if part.startswith("DIR"))
    assert line.count(f"{folder}/shared") == 2


class FakeContext:
    master = "spark://host:7077"

    def getCheckpointDir(self):
        return None


class FakeSession:
    sparkContext = FakeContext()

    class conf:
        @staticmethod
        def get(_name, default):
            return default


def test_a_cluster_never_gets_a_local_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(FakeSession())


def test_a_local_session_gets_one_of_its_own(spark):
    assert session.ensure_checkpoint_dir(spark) == session.ensure_checkpoint_dir(spark)
