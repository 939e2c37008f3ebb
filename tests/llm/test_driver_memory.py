"""The driver collects its garbage between the jobs of a stage once its heap has grown; before, only when it was full."""

from docloom.llm import common


def test_a_grown_heap_is_collected_between_jobs(spark, monkeypatch):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if b.getName() == "G1 Old Generation")
    monkeypatch.setattr(common, "HELD", 1.0)
    before = whole()
    common.saved(spark.range(1), "first")
    assert whole() == before and not common.tidy(spark)
    monkeypatch.setattr(common, "HELD", 0.0)
    common.saved(spark.range(1), "next")
    assert whole() > before and common.tidy(spark)
