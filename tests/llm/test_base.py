"""Written tables: what the driver no longer needs goes."""

from types import SimpleNamespace

import pytest

from tokenmill.llm import base


def test_stored_collects_garbage(spark, monkeypatch):
    monkeypatch.setattr(base, "HEAP_SHARE", 0, raising=False)
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = whole()
    t = base.stored(spark.range(10), "test-garbage")
    assert whole() > before
    assert sorted(r.id for r in t.collect()) == list(range(10))


@pytest.mark.parametrize(("taken", "calls"), [(40, 0), (50, 0), (51, 1), (100, 1)])
def test_release_only_a_grown_heap(taken, calls):
    asked = []
    heap = SimpleNamespace(totalMemory=lambda: taken, maxMemory=lambda: 100)
    lang = SimpleNamespace(Runtime=SimpleNamespace(getRuntime=lambda: heap), System=SimpleNamespace(gc=lambda: asked.append(1)))
    base.release(SimpleNamespace(sparkContext=SimpleNamespace(_jvm=SimpleNamespace(java=SimpleNamespace(lang=lang)))))
    assert len(asked) == calls
