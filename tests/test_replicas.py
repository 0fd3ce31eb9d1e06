from cotejo.plans import stats
from tests.oracle import ROOT


def test_as_many_replicas_as_the_reference(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(stats.stats, "bootstrap_ratio", lambda *a, **k: asked.update(k))
    stats.cluster_bootstrap_ci(spark, ROOT)
    assert asked["replicas"] == 10_000
