"""Micro-fixtures: cascades, ranks, reachability, traces, roll-ups, changes."""

import pytest
from pyspark.sql import functions as F

from weft import catalog
from weft.functions.text import framework_factor, is_test, name_factor, normal_path
from weft.operators.derive import cluster_rollup, cohesion, community_names, entry_points, longest_per_ends, propagate_labels, structure, without_contained
from weft.operators.dml import delete_files, read_csv, referential, update_columns, upsert, write_csv
from weft.plans.graphview import write_graph
from weft.operators.resolve import longest_prefix, resolve_calls, resolve_imports
from weft.operators.search import bm25, nearest, reciprocal_ranks
from weft.plans.patterns import Step, match, oriented, top_n
from weft.plans.traverse import components, paths, reach

EDGE = "src string, dst string, type string, confidence double, step int"


def edges(spark, rows):
    return spark.createDataFrame([(a, b, t, c, 0) for a, b, t, c in rows], EDGE)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_call_cascade(spark):
    s = spark.createDataFrame([(1, "a.ts", "foo", "a:foo"), (2, "b.ts", "foo", "b:foo"), (3, "b.ts", "bar", "b:bar"), (4, "c.ts", "bar", "c:bar"), (5, "d.ts", "only", "d:only")], "seq long, file string, name string, id string")
    i = spark.createDataFrame([("a.ts", "c.ts")], "file string, imported string")
    c = spark.createDataFrame([("a.ts", "foo"), ("a.ts", "bar"), ("x.ts", "foo"), ("x.ts", "only"), ("x.ts", "missing")], "file string, called string")
    got = {(r["file"], r["called"]): (r["target"], r["confidence"], r["reason"]) for r in resolve_calls(c, s, i).collect()}
    assert got == {("a.ts", "foo"): ("a:foo", 0.85, "same-file"), ("a.ts", "bar"): ("c:bar", 0.9, "import-resolved"), ("x.ts", "foo"): ("a:foo", 0.3, "fuzzy-global"), ("x.ts", "only"): ("d:only", 0.5, "fuzzy-global")}


@pytest.mark.parametrize("base, order", [(1, "CABD"), (0, "CABD")])
def test_rank_fusion(spark, base, order):
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "k string, rank int")
    b = spark.createDataFrame([("C", 1), ("D", 2)], "k string, rank int")
    r = reciprocal_ranks({"kw": a, "vec": b}, "k", base).orderBy(F.desc("score"), "k").collect()
    assert "".join(x["k"] for x in r) == order and r[0]["sources"] == "kw,vec"
    assert r[0]["score"] == pytest.approx(1 / (62 + base) + 1 / (60 + base))


def test_blast_radius(spark):
    e = edges(spark, [("a", "b", "CALLS", 0.9), ("b", "c", "CALLS", 0.5), ("c", "a", "CALLS", 0.85), ("c", "d", "CALLS", 0.3)])
    start = spark.createDataFrame([("a",)], "id string")
    assert rows(reach(e, start, 3), "id", "depth") == [("b", 1), ("c", 2), ("d", 3)]
    assert rows(reach(e, start, 3, least=0.5), "id", "depth") == [("b", 1), ("c", 2)]
    assert rows(reach(e, start, 1, "in"), "id", "depth") == [("c", 1)]


def test_skipped_nodes_are_not_entered(spark):
    e = edges(spark, [("x", "t", "CALLS", 1.0), ("t", "u", "CALLS", 1.0)])
    skip = spark.createDataFrame([("t",)], "id string")
    assert reach(e, spark.createDataFrame([("x",)], "id string"), 3, skip=skip).count() == 0


def test_traces(spark):
    e = spark.createDataFrame([("e", "f"), ("e", "g"), ("f", "h")], "src string, dst string")
    assert rows(paths(e, spark.createDataFrame([("e",)], "id string"), 10).select(F.array_join("path", "").alias("p")), "p") == [("efh",)]
    cycle = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p")], "src string, dst string")
    assert rows(paths(cycle, spark.createDataFrame([("p",)], "id string"), 10).select(F.array_join("path", "").alias("p")), "p") == [("pqr",)]


def test_trace_dedup(spark):
    p = spark.createDataFrame([(list(x),) for x in ("efhz", "fhz", "exz")], "path array<string>")
    assert rows(longest_per_ends(without_contained(p)).select(F.array_join("path", "").alias("p")), "p") == [("efhz",)]


def test_cluster_rollup(spark):
    c = spark.createDataFrame([("comm_0", "Auth", None, 6, 0.5), ("comm_1", "Auth", None, 2, 1.0), ("comm_2", "Db", None, 4, 0.9)], "id string, heuristicLabel string, label string, symbolCount int, cohesion double")
    assert rows(cluster_rollup(c), "id", "name", "symbols", "cohesion", "parts") == [("comm_0", "Auth", 8, 0.625, 2)]


def test_cohesion_and_names(spark):
    g = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "x")], "src string, dst string")
    m = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, community int")
    assert cohesion(g, m).first()["cohesion"] == pytest.approx(0.8)
    m = spark.createDataFrame([(1, "n", p) for p in ("src/auth/a.ts", "src/auth/b.ts", "src/db/c.ts", "src/utils/d.ts")] + [(2, n, "src/x.ts") for n in ("loadA", "loadB", "loadC")] + [(3, "q", None)], "community int, name string, filePath string")
    assert rows(community_names(m), "community", "label") == [(1, "Auth"), (2, "load"), (3, "Cluster_1")]


def test_structure(spark):
    p = spark.createDataFrame([("src/a/x.ts",), ("src/a/x.ts",), ("top.ts",)], "path string")
    assert rows(structure(p), "src", "dst") == [("Folder:src", "Folder:src/a"), ("Folder:src/a", "File:src/a/x.ts")]


def test_cut_comes_before_threshold(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.3, 0.95]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in nearest(v, [1.0, 0.0], 2, 0.6).collect()] == [1]


def test_entry_scores(spark):
    n = spark.createDataFrame([("h", "Function", "handleLogin", "src/routes/login.ts", True), ("f", "Function", "formatDate", "src/lib/x.ts", False), ("t", "Function", "run", "src/a.test.ts", True)], "id string, label string, name string, filePath string, isExported boolean")
    e = edges(spark, [("h", f"c{i}", "CALLS", 1.0) for i in range(4)] + [(f"d{i}", "f", "CALLS", 1.0) for i in range(3)] + [("f", "y", "CALLS", 1.0), ("f", "z", "CALLS", 1.0), ("t", "y", "CALLS", 1.0)])
    assert rows(entry_points(n, e), "id", "score") == [("f", 0.15), ("h", 30.0)]


def test_imports(spark):
    f = spark.createDataFrame([("src/a/x.ts", 1), ("src/a/y.ts", 2), ("src/lib/auth.ts", 3), ("src/b/index.ts", 4)], "path string, seq long")
    i = spark.createDataFrame([("src/a/x.ts", r) for r in ("./y", "../b", "@/lib/auth", "react")], "file string, raw string")
    assert rows(resolve_imports(i, f, [("@/", "src/")]), "raw", "resolved") == [("../b", "src/b/index.ts"), ("./y", "src/a/y.ts"), ("@/lib/auth", "src/lib/auth.ts")]


def test_longest_prefix(spark):
    p = spark.createDataFrame([("/srv/a/b/c.ts",), ("/srv/ab/c.ts",)], "path string")
    r = spark.createDataFrame([("/srv/a/",), ("/srv/a/b",), ("/srv",)], "root string")
    assert rows(longest_prefix(p, r), "path", "root") == [("/srv/a/b/c.ts", "/srv/a/b"), ("/srv/ab/c.ts", "/srv")]


def test_components_against_union_find(spark):
    import random

    random.seed(3)
    pairs = [(f"n{random.randrange(60)}", f"n{random.randrange(60)}") for _ in range(45)] + [("hub", f"s{i}") for i in range(40)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(pairs, "src string, dst string")), "id", "component"))
    assert got == {x: find(x) for p in pairs for x in p}


def test_propagation_is_deterministic(spark):
    g = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "z"), ("x", "z"), ("c", "x")], "src string, dst string")
    a = rows(propagate_labels(g), "id", "community")
    assert a == rows(propagate_labels(g.repartition(3)), "id", "community") and len(a) == 6


def test_match_binds_chains(spark):
    n = spark.createDataFrame([("f", "Function", "f"), ("m", "Method", "m"), ("c", "Community", "c")], "id string, label string, name string")
    e = edges(spark, [("f", "m", "CALLS", 1.0), ("m", "c", "MEMBER_OF", 1.0), ("f", "f", "CALLS", 1.0)])
    got = match(n, e, "Function", [Step("CALLS", label="Method"), Step("MEMBER_OF")])
    assert rows(got, "n0_id", "n1_id", "n2_id") == [("f", "m", "c")]
    assert oriented(e, "both").where("here = 'f' and there = 'f'").count() == 2


def test_top_n_breaks_ties(spark):
    d = spark.createDataFrame([("g", i % 2, i) for i in range(6)], "g string, v int, id int")
    assert rows(top_n(d, ["g"], [F.desc("v"), F.col("id")], 2), "id") == [(1,), (3,)]


def test_changes(spark, tmp_path):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    c = spark.createDataFrame([("b", 9), ("b", 8), ("c", 3)], "id string, v int")
    assert rows(upsert(t, c, "id", F.col("v")), "id", "v") == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(update_columns(t, spark.createDataFrame([("a", None), ("b", 5)], "id string, v int"), "id", ["v"]), "id", "v") == [("a", 1), ("b", 5)]
    n = spark.createDataFrame([("x", "f", "File"), ("y", "g", "File")], "id string, filePath string, label string")
    e = edges(spark, [("x", "y", "CALLS", 1.0), ("y", "y", "CALLS", 1.0), ("y", "gone", "CALLS", 1.0)])
    assert rows(referential(e, n), "src", "dst") == [("x", "y"), ("y", "y")]
    kept, left, gone = delete_files(n, e, spark.createDataFrame([("f",)], "filePath string"))
    assert rows(kept, "id") == [("y",)] and rows(gone, "id") == [("x",)] and rows(left, "src", "dst") == [("y", "gone"), ("y", "y")]
    write_graph(n, e, str(tmp_path))
    plan = spark.read.parquet(f"{tmp_path}/nodes").where("label = 'File'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(label" in plan


def test_bm25_of_nothing(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "cache cache lock")], "id long, text string")
    assert rows(bm25(d, "text", ["cache"], keep=["id"]), "id") == [(3,)]
    assert bm25(d.limit(0), "text", ["cache"], keep=["id"]).count() == 0


def test_text_functions(spark):
    one = spark.range(1)
    got = one.select(normal_path(F.lit("a/./b/../c")).alias("p"), is_test(F.lit("src/a.test.ts")).alias("t"), name_factor(F.lit("getUser")).alias("u"), name_factor(F.lit("main")).alias("m"), framework_factor(F.lit("src/routes/x.ts")).alias("f")).first()
    assert tuple(got) == ("a/c", True, 0.3, 1.5, 2.5)


def test_csv_keeps_every_value(spark, tmp_path):
    values = [None, "", "\\N", "\\\\N", "\\", "a\r\nb", "a\rb\n", "\r", "\n", " x ", "\tx\t", " \r\n ", 'q"q', '"', '\\"', "a,b", "\x00z", "\ufeffx", "x" * 70_000]
    df = spark.createDataFrame([(i, None if i % 5 == 4 else f"id{i}", v) for i, v in enumerate(values)], "seq long, id string, content string")
    write_csv(df, f"{tmp_path}/csv")
    got = read_csv(spark, f"{tmp_path}/csv", "seq long, id string, content string")
    assert rows(got, "seq", "id", "content") == rows(df, "seq", "id", "content")


def test_whole_tables(spark, sf):
    q = catalog.QUERIES
    nodes_, codes = spark.read.parquet(f"{sf}/embeddable_nodes.parquet"), spark.read.parquet(f"{sf}/parsed_nodes.parquet")
    back = q["csv_round_trip"](spark, sf)
    assert back.exceptAll(nodes_.select(*back.columns)).isEmpty() and back.count() == nodes_.count() and back.where("contains(content, '\r')").count() > 0
    assert q["json_export"](spark, sf).count() == codes.count() and q["first_lines"](spark, sf).count() == nodes_.where("content is not null").count()