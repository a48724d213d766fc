import pytest
from compare import assert_same

from siltstone.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf, name):
    assert_same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name], sf)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_allocator_against_a_plain_replay(spark, sf):
    rows = sorted(catalogue.port_allocate(spark, sf).join(spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts"), "event_id").collect(), key=lambda r: (r["ts"], r["event_id"]))
    held = {}
    for r in rows:
        mine = held.setdefault(r["pool"], set())
        if r["action"] == "release":
            mine.discard(r["slot"])
            want = ("released", None)
        elif len(mine) >= catalogue.QUOTA:
            want = ("quota", None)
        else:
            free = min(set(range(8000, 9000)) - mine)
            mine.add(free)
            want = ("ok", free)
        assert (r["result"], r["allocated"]) == want
