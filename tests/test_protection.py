"""Protected decisions as stream state, and two writers of one path."""

import datetime as dt
import random
import threading
from types import SimpleNamespace

import pandas as pd
import pytest

from lumensift import vocab as V
from lumensift.sources import catalog
from lumensift.streaming import decisions, protection


def _events(rng, n):
    t = dt.datetime(2024, 1, 1)
    return [(f"/p/{rng.randrange(12)}.jpg", t + dt.timedelta(minutes=rng.randrange(9000)), i, rng.random() < 0.15, f"s{i}", None if i % 5 == 0 else f"n{i}") for i in range(n)]


def test_stream_with_a_restart_equals_the_rule(spark, tmp_path):
    rng = random.Random(4)
    rows = _events(rng, 160)
    rng.shuffle(rows)
    rows += rows[:30]  # seen again
    source = str(tmp_path / "events")
    frame = lambda x: spark.createDataFrame(x, protection.EVENT).coalesce(1)
    stream = lambda: spark.readStream.schema(protection.EVENT).option("maxFilesPerTrigger", 1).parquet(source)
    for a, b in ((0, 40), (40, 90)):
        frame(rows[a:b]).write.mode("append").parquet(source)
    protection.run(stream(), str(tmp_path / "out"), str(tmp_path / "mark"), late="100 days")
    for a, b in ((90, 130), (130, 190)):
        frame(rows[a:b]).write.mode("append").parquet(source)
    protection.run(stream(), str(tmp_path / "out"), str(tmp_path / "mark"), late="100 days")
    got = sorted(map(tuple, protection.standing(spark, str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, protection.rule(frame(rows)).collect())) and sum(r[-1] for r in got) == 160
    assert len(list((tmp_path / "out").iterdir())) >= 4


def test_a_decision_between_reading_and_writing_is_kept(spark, tmp_path, monkeypatch):
    """The other writer commits after the stream has read the table and before it writes."""
    table = str(tmp_path / "table")
    schema = "path string, review_status string, review_note string"
    catalog.save(spark, spark.createDataFrame([("/a", V.UNREVIEWED, ""), ("/b", V.UNREVIEWED, "")], schema), table)
    load, once = catalog.load, threading.Event()

    def slow(spark_, path, version=None):
        out = load(spark_, path, version)
        if not once.is_set():
            once.set()
            catalog.save(spark_, spark_.createDataFrame([("/a", V.CONFIRMED, "human")], schema), table)
        return out

    monkeypatch.setattr(catalog, "load", slow)
    spark.createDataFrame([("/a", V.AI_REVIEWED, "ai", 1), ("/b", V.AI_REVIEWED, "ai", 2)], schema + ", seq long").write.parquet(str(tmp_path / "in"))
    updates = spark.readStream.schema(schema + ", seq long").parquet(str(tmp_path / "in"))
    decisions.merge_stream(updates, table, str(tmp_path / "mark")).awaitTermination()
    got = {r["path"]: (r["review_status"], r["review_note"]) for r in load(spark, table).collect()}
    assert got == {"/a": (V.CONFIRMED, "human"), "/b": (V.AI_REVIEWED, "ai")}


def test_two_writers_of_one_version(spark, tmp_path):
    table, one = str(tmp_path / "t"), spark.createDataFrame([("/a", "x")], "path string, review_note string")
    assert catalog.save(spark, one, table, after=None) == 0 and catalog.save(spark, one, table, after=None) is None
    assert catalog.save(spark, one, table, after=0) == 1 and catalog.save(spark, one, table, after=0) is None and catalog.save(spark, one, table) == 2
    assert pytest.approx(catalog.current(spark, table)) == 2


@pytest.mark.parametrize("held", [100_000, 50])
def test_the_state_is_asked_once_a_key_and_micro_batch(monkeypatch, held):
    """A key's events don't cost a question each."""
    calls = []

    class State:
        def __init__(self, empty):
            self.value = empty

        def __getattr__(self, name):
            calls.append(name)
            return {
                "exists": lambda: self.value is not None, "get": lambda: iter(self.value) if isinstance(self.value, list) else self.value, "update": lambda x: setattr(self, "value", x), "appendList": lambda x: self.value.extend(x), "clear": lambda: setattr(self, "value", [] if isinstance(self.value, list) else None),
                "containsKey": lambda k: k in self.value, "updateValue": lambda k, v: self.value.update({k: v}), "getValueState": lambda *_: State(None), "getListState": lambda *_: State([]), "getMapState": lambda *_: State({}),
                "listTimers": lambda: iter([]), "registerTimer": lambda t: None, "deleteTimer": lambda t: None,
            }[name]

    monkeypatch.setattr(protection, "HELD", held, raising=False)
    rng = random.Random(9)
    events = [e[1:] for e in _events(rng, 400)]
    events += events[:60]
    own = protection.Protection(1000)
    own.init(State(None))
    calls.clear()
    cut = [events[a : a + 80] for a in range(0, len(events), 80)]
    table = lambda x: pd.DataFrame(x, columns=["at", "event_id", "human", "status", "note"])
    out = [r for n in (0, 3) for r in own.handleInputRows(("/p",), iter([table(x) for x in cut[n : n + 3]]), None)]
    best = max(events, key=lambda e: (e[2], e[0], e[1]))
    assert out[-1].iloc[0][["event_id", "n_events"]].tolist() == [best[1], 400]
    assert len(calls) < 40 and calls.count("registerTimer") == 1 and "listTimers" not in calls
    last = max(e[0] for e in events).timestamp() * 1000 + 1000
    for at, left in ((last - 500, 400), (last, 0)):
        calls.clear()
        own.handleExpiredTimer(("/p",), None, SimpleNamespace(getExpiryTimeInMs=lambda at=at: at))
        assert len(own.seen.value) == left and ("registerTimer" in calls) == (left > 0)
    assert own.stands.value[0] is True
