"""What the driver must not hold."""

import os

from packwright.llm import quality
from packwright.plans import shared


def test_quality_is_fit_in_a_task(spark, monkeypatch):
    driver, fit = os.getpid(), quality.fit_rows

    def elsewhere(*args, **options):
        assert os.getpid() != driver
        return fit(*args, **options)

    rows = [(i, f"good words stand here {i}. " * 3 if i % 2 else f"x{i} ** " * 9) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit_rows", elsewhere)
    model = quality.fit_quality(docs, labels)
    scored = quality.score_quality(docs, model, keep=["doc_id"]).join(labels, "doc_id")
    assert scored.where("(score >= 0.5) <> (quality = 1)").count() == 0
    assert quality.fit_quality(docs, labels.where("quality = 1")) is None


def test_freed_memory_outside_the_heap_is_returned(spark, monkeypatch):
    asked = []

    class Server:
        def invoke(self, name, *rest):
            asked.append(rest[0])
            return server.invoke(name, *rest)

    factory = type(spark.sparkContext._jvm.java.lang.management.ManagementFactory)
    server, call = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), factory.__getattr__
    monkeypatch.setattr(factory, "__getattr__", lambda self, name: Server if name == "getPlatformMBeanServer" else call(self, name))
    shared.released(spark)
    assert asked == ["systemTrimNativeHeap"]
