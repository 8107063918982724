"""Intermediate results and the driver's memory."""

from cellforge import storage


def test_freed_memory_of_the_driver_is_returned_after_each_step(spark, monkeypatch):
    said = []
    trim = storage.trim
    monkeypatch.setattr(storage, "trim", lambda session: said.append(trim(session)))
    assert storage.stored(spark.range(5)).count() == 5
    assert len(said) == 1 and "trim" in said[0].lower()
