import re

import pytest

import __spark_entry__
from corpusloom.llm import queries
from corpusloom.llm.common import shared_dir
from tests.duck import connection, from_duck, from_spark

SF = "/root/testdata/sf0.01"


def test_every_operator_is_registered_once():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", ["op1_warc_archive", "op5_mix_to_weights", "op6_quality_rules", "op7_substring_dedup", "op11_byte_dedup", "op13_prefix_trie"])
def test_queries_equal_their_sql(spark, name):
    found = from_spark(queries.queries()[name](spark, SF))
    assert found == from_duck(connection(SF), queries.oracle_sql()[name])


def test_on_a_cluster_the_shared_folder_must_be_named():
    class Far:
        master = "spark://x"

    class Unset:
        sparkContext = Far()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_dir(Unset())


def test_a_session_without_a_shared_folder_gets_its_own(spark, monkeypatch):
    from corpusloom.llm import common

    class Unset:
        def __init__(self, session):
            self.sparkContext = session.sparkContext
            self.conf = self

        def get(self, key, default=None):
            return default

    before = spark.sparkContext.getCheckpointDir()
    own = common.shared_dir(Unset(spark))
    assert own.startswith("file://") and common.shared_dir(Unset(spark)) == own
    if before:
        spark.sparkContext.setCheckpointDir(before)
