"""Skewed keys and orphan references on small fixtures."""

from datetime import datetime as dt

from pyspark.sql import functions as F

from weft.operators import orphans as O
from weft.operators.skew import connections, heavy_keys, joined_aggregates

REL = "id string, sourceId string, targetId string, reason string, observedAt timestamp_ntz, ingestedAt timestamp_ntz"


def test_heavy_keys_count_null_rows(spark):
    rows = spark.createDataFrame([("a",)] * 3 + [("b",)] + [(None,)] * 96, "k string")
    assert [tuple(r) for r in heavy_keys(rows, "k", 0.03).collect()] == [("a", 3, 0, 0)]
    records = spark.createDataFrame([("a", 1), ("a", 2), ("q", 1), (None, 1)], "id string, n int")
    assert [tuple(r) for r in heavy_keys(rows, "k", 0.01, records).orderBy("k").collect()] == [("a", 3, 2, 6), ("b", 1, 0, 0)]
    assert heavy_keys(rows.limit(0), "k", 0.02).count() == 0


def test_heavy_keys_ignore_clashing_columns(spark):
    rows = spark.createDataFrame([("a", 1, 2), ("a", 1, 2)], "k string, n int, whole int")
    assert heavy_keys(rows, "k", 0.5).first()["n"] == 2


def test_joined_aggregates_equal_the_join(spark):
    left = spark.createDataFrame([("x", 1), ("x", 2), ("y", 5), (None, 9), ("z", 1)], "k string, v int")
    right = spark.createDataFrame([("x", "A"), ("x", "A"), ("x", "B"), ("y", "B"), (None, "A"), ("q", "C")], "k string, g string")
    ours = joined_aggregates(left, right, "k", "k", ["g"], {"v": F.col("v")})
    plain = left.join(right, "k").groupBy("g").agg(F.count("*").alias("pairs"), F.sum("v").alias("v"))
    assert sorted(map(tuple, ours.select("g", "pairs", "v").collect())) == sorted(map(tuple, plain.collect()))


def test_connections_of_a_hub_and_a_lonely_node(spark):
    e = spark.createDataFrame([("a", "h")] * 4 + [("h", "h"), (None, "h"), ("b", None)], "sourceId string, targetId string")
    n = spark.createDataFrame([("h", 1), ("h", 2), ("lonely", 1), (None, 1)], "id string, incoming int")
    assert {tuple(r) for r in connections(e, n).collect()} == {("h", 6, 1, 7), ("lonely", 0, 0, 0)}


def _refs(spark, rows):
    return O.references(spark.createDataFrame(rows, REL))


def _pending(state):
    return {(r["id"], r["ref_end"]) for r in state.pending.collect()}


def test_orphans_resolve_reopen_and_resolve_again(spark):
    t = [dt(2025, m, 1) for m in range(1, 8)]
    refs = _refs(spark, [("r1", "Function:a", "Function:b", "", t[0], t[0]), ("r1", "Function:a", "Function:b", "", t[0], t[1]), ("r2", None, "comm_9", "leiden-algorithm", t[0], t[0])]).drop("at")
    none = "id string, indexedAt timestamp_ntz"
    dels = "nodeId string, deletedAt timestamp_ntz"

    def entries(nodes, deletions, fixed=()):
        return O.parents(spark.createDataFrame(nodes, none), [spark.createDataFrame([(x,) for x in fixed], "id string")], spark.createDataFrame(deletions, dels)).drop("at")

    s = O.advance(O.empty(spark), refs, entries([("Function:a", t[0])], []))
    assert _pending(s) == {("r1", "target"), ("r2", "target")}
    s = O.advance(s, refs.limit(0), entries([("Function:b", t[1])], [], ["comm_9"]))  # a late parent exists
    assert _pending(s) == set()
    s = O.advance(s, refs.limit(0), entries([], [("Function:b", t[2]), (None, t[2])]))
    assert _pending(s) == {("r1", "target")}
    s = O.advance(s, refs.limit(0), entries([("Function:b", t[3])], [("Function:b", t[0])]))
    assert _pending(s) == set()
    s = O.advance(s, refs, entries([], []))  # the same references again
    assert _pending(s) == set()


def test_steps_do_not_matter(spark, sf):
    from weft.queries.general import _states

    rows = [sorted((r["id"], r["ref_end"]) for r in _states(spark, sf, cuts)[-1][1].pending.select("id", "ref_end").distinct().collect()) for cuts in ([], ["2025-03-01"], ["2025-02-01", "2025-05-01", "2025-08-01"])]
    assert rows[0] == rows[1] == rows[2] and rows[0]


def test_empty_tables(spark):
    refs = _refs(spark, []).drop("at")
    e = O.parents(spark.createDataFrame([], "id string, indexedAt timestamp_ntz"), [], spark.createDataFrame([], "nodeId string, deletedAt timestamp_ntz")).drop("at")
    assert O.advance(O.empty(spark), refs, e).pending.count() == 0


def test_shuffle_way_equals_broadcast_way(spark, monkeypatch):
    refs = _refs(spark, [(f"r{i}", "Function:a", f"Function:{i % 3}", "", dt(2025, 1, 1), dt(2025, 1, 1)) for i in range(30)]).drop("at")
    e = O.parents(spark.createDataFrame([("Function:1", dt(2025, 1, 2))], "id string, indexedAt timestamp_ntz"), [], spark.createDataFrame([], "nodeId string, deletedAt timestamp_ntz")).drop("at")
    a = _pending(O.advance(O.empty(spark), refs, e))
    monkeypatch.setattr(O, "BROADCAST", -1)
    assert a == _pending(O.advance(O.empty(spark), refs, e)) and len(a) == 50


def test_a_step_reads_and_writes_only_what_it_touches(spark, tmp_path):
    at = dt(2025, 1, 1)
    refs = _refs(spark, [(f"r{i}", f"Function:{i % 40}", "Function:hub" if i % 3 else None, "", at, at) for i in range(300)]).drop("at")
    none, dels = spark.createDataFrame([], "id string, indexedAt timestamp_ntz"), "nodeId string, deletedAt timestamp_ntz"
    nodes = spark.createDataFrame([("Function:hub", at), *[(f"Function:{i}", at) for i in range(30)]], none.schema)
    s = O.advance(O.empty(spark, str(tmp_path / "s"), buckets=32), refs, O.parents(nodes, [], spark.createDataFrame([], dels)).drop("at"))
    before = _pending(s)
    deletion = O.parents(none, [], spark.createDataFrame([("Function:7", dt(2025, 2, 1))], dels)).drop("at")
    t = O.advance(s, refs.limit(0), deletion)
    assert _pending(t) - before == {(f"r{i}", "source") for i in range(300) if i % 40 == 7} and before <= _pending(t)
    for table in ("index", "pending"):
        assert len(list((tmp_path / "s" / table / "v=2").glob("bucket=*"))) == 1
        assert sum(v != [1] for v in t.store.held[table].values()) == 1
    assert not list((tmp_path / "s" / "refs" / "v=2").glob("bucket=*")) and _pending(s) == before
