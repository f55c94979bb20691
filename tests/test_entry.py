import importlib
import sys

import pytest

import __spark_entry__ as entry
from goldlink.plans import catalog, scratch


@pytest.mark.parametrize("missing", ["corpus_pipeline", "goldlink.llm", "zstandard", "ahocorasick"])
def test_core_queries_survive_what_is_missing(monkeypatch, missing):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("goldlink.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    fresh = importlib.reload(entry)
    assert set(fresh.queries()) == set(catalog.QUERIES) and set(fresh.oracle_sql()) == set(catalog.ORACLE_SQL)


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


def test_scratch_tables_are_discarded(spark):
    before = scratch.tables()
    kept = scratch.materialize(spark.range(3), "kept")
    scratch.materialize(spark.range(4), "gone")
    scratch.discard_since(before, keep=kept)
    assert len(scratch.tables() - before) == 1 and kept.count() == 3
    scratch.discard(kept)
    assert scratch.tables() == before


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())
