from types import SimpleNamespace

import pytest

from scenespark.operators import ordered
from scenespark.sources import tables


def fake(master, where=None):
    context = SimpleNamespace(master=master, at=None)
    context.getCheckpointDir = lambda: context.at
    context.setCheckpointDir = lambda path: setattr(context, "at", path)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda name, other: where))


def test_a_cluster_needs_a_shared_folder():
    assert ordered.checkpoints(fake("local[4]")) and ordered.checkpoints(fake("local"))
    assert ordered.checkpoints(fake("spark://host:7077", "/shared")) == "/shared"
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            ordered.checkpoints(fake(master))


def test_csv_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v,note\n007,1.50,"a, b"\n8,,\n9\n')
    rows = tables.read_text_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [tuple(r) for r in rows] == [("007", "1.50", "a, b"), ("8", "", ""), ("9", "", "")]
