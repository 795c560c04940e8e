"""The entry points and the lineage cuts hold without the optional subpackage and off a single machine."""

import sys
import types

import pytest

import __spark_entry__ as entry
from strandloom.operators import lineage
from strandloom.plans.queries import QUERIES


@pytest.mark.parametrize("missing", ["strandloom.llm.queries", "strandloom.llm", "ahocorasick"])
def test_queries_without_a_dependency(monkeypatch, missing):
    for name in [n for n in sys.modules if n.startswith("strandloom.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    assert set(entry.queries()) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(QUERIES)


def test_queries_without_the_pipeline(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in entry.queries() and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("master,fails", [("local", False), ("local[4]", False), ("local-cluster[3,2,1024]", True), ("spark://host:7077", True), ("yarn", True)])
def test_shared_folder_must_be_named_on_a_cluster(master, fails):
    placed = []
    conf = types.SimpleNamespace(get=lambda k, d=None: d)
    context = types.SimpleNamespace(master=master, getConf=lambda: conf, getCheckpointDir=lambda: placed[-1] if placed else None, setCheckpointDir=placed.append)
    session = types.SimpleNamespace(sparkContext=context)
    if fails:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            lineage.shared_dir(session)
        assert not placed
        conf.get = lambda k, d=None: "hdfs:///shared"
    assert lineage.shared_dir(session) == placed[-1] == lineage.shared_dir(session)
