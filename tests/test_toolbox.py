"""The graph language, the tools, stems, stored postings and the bucketed store on small fixtures."""

import pytest
from pyspark.sql import functions as F

from weft.functions.stem import stem
from weft.operators.cluster import membership_edges
from weft.operators.postings import build_index, search, search_files
from weft.plans.language import Graph, QueryError

NODE = "id string, label string, name string, filePath string, language string, isExported boolean, repo string"


@pytest.fixture(scope="module")
def g(spark):
    n = spark.createDataFrame([("a", "Function", "alpha", "x/a.py", "python", True, "r"), ("b", "Function", "beta", "x/b.py", None, False, "r"), ("c", "Class", "Gamma", None, None, None, None), ("d", "Class", None, "x/d.py", None, None, "r")], NODE)
    e = spark.createDataFrame([("1", "a", "b", "CALLS", 0.9, 0), ("2", "b", "a", "CALLS", 0.4, 0), ("3", "a", "c", "USES", 1.0, 2), ("4", "a", "gone", "CALLS", 1.0, 0), ("5", "b", "b", "CALLS", 1.0, 0)], "id string, src string, dst string, type string, confidence double, step int")
    return Graph(spark, n, e)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "text,want",
    [
        ("MATCH (n) RETURN count(*) AS n", [(4,)]),
        ("MATCH (n:Class) RETURN n.name", [("Gamma",), (None,)]),
        ("MATCH (a)-[:CALLS]->(b) RETURN a.id, b.id", [("a", "b"), ("b", "a"), ("b", "b")]),
        ("MATCH (a)<-[r:CALLS {confidence: 0.9}]-(b) RETURN a.id, b.id, r.type", [("b", "a", "CALLS")]),
        ("MATCH (a {id: 'a'})--(b) RETURN DISTINCT b.id", [("b",), ("c",)]),
        ("MATCH (a)-[:CALLS*2]->(b) RETURN a.id, b.id", [("a", "a"), ("a", "b"), ("b", "a"), ("b", "b"), ("b", "b")]),
        ("MATCH (n) OPTIONAL MATCH (n)-[:USES]->(m) RETURN n.id, m.name", [("a", "Gamma"), ("b", None), ("c", None), ("d", None)]),
        ("MATCH (n) WHERE n.name IS NULL OR (n.name CONTAINS 'et' AND NOT n.isExported) RETURN n.id", [("b",), ("d",)]),
        ("MATCH (n) WITH n.label AS l, count(*) AS c ORDER BY l LIMIT 1 RETURN l, c + 1 AS d", [("Class", 3)]),
        ("MATCH (n:Class) RETURN n.id AS x UNION MATCH (n:Class) RETURN n.id AS x", [("c",), ("d",)]),
        ("MATCH (n) WHERE n.id IN $ids RETURN n.id ORDER BY n.name DESC SKIP 1 LIMIT 1", [("a",)]),
        ("MATCH (n {name: $name}) RETURN n.id", []),
        ("UNWIND ['it''s', \"b\"] AS x RETURN toUpper(x) AS y", [("B",), ("IT'S",)]),
        ("MATCH (a:Function) RETURN sum(CASE WHEN a.isExported THEN 1 ELSE 0 END) AS s, max(size(split(a.filePath, '/'))) AS m", [(1, 2)]),
    ],
)
def test_statements(g, text, want):
    assert rows(g.query(text, ids=["a", "b"], name="x' OR 1=1 //")) == sorted(want, key=str)


@pytest.mark.parametrize("text", ["MATCH (a), (b) RETURN a.id", "MATCH (n) RETURN m.id", "MATCH (n)", "CREATE (n)", "MATCH (n) RETURN n.id LIMIT", "MATCH (a)-[*]->(b) RETURN a.id", "MATCH (n) RETURN n.secret", "MATCH (n) DELETE n", "MATCH (n) WHERE n.id = $none RETURN n.id"])
def test_refused_statements(g, text):
    with pytest.raises(QueryError):
        g.query(text)


def test_stems():
    pairs = "caresses caress ponies poni agreed agre plastered plaster motoring motor conflated conflat hopping hop filing file happy happi sky sky relational relat vietnamization vietnam triplicate triplic electrical electr replacement replac adoption adopt probate probat controll control roll roll"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2] and stem("n2x") == "n2x" and stem("日本") == "日本"


def test_postings(spark, tmp_path):
    t = spark.createDataFrame([("File", "1", "a", "pruned baskets, pruned lists"), ("Class", "2", "a", "basket"), ("File", "3", "b", "nothing here"), ("File", "4", None, "basket"), ("File", "5", "c", None), ("File", "6", "d", "")], "label string, id string, filePath string, text string")
    build_index(t, str(tmp_path / "i"))
    assert {r["id"] for r in search(spark, str(tmp_path / "i"), "Prune a basket").collect()} == {"1", "2", "4"}
    assert [r["filePath"] for r in search_files(spark, str(tmp_path / "i"), "baskets").collect()] == ["a"]
    assert search(spark, str(tmp_path / "i"), "zzz").count() == 0 and search(spark, str(tmp_path / "i"), "").count() == 0


def test_tools(spark, sf):
    from weft.toolbox import Toolbox

    t = Toolbox(spark, sf)
    assert t.context("no such name at all").count() == 0 and t.impact("no such name at all").count() == 0
    assert "content" in t.context("Class:shared/model/entity.py:Entity", include_content=True).columns
    with_tests = t.impact("Class:shared/model/entity.py:Entity", include_tests=True).count()
    assert with_tests >= t.impact("Class:shared/model/entity.py:Entity").count() > 0
    up = {r["id"] for r in t.impact("File:shared/model/entity.py", max_depth=1).collect()}
    assert isinstance(up, set)
    with pytest.raises(ValueError):
        t.rename("Entity", "no name")
    assert t.rename("merge_session", "combined").where("new_line like '%combined%'").count() > 0
    hybrid = t.hybrid("basket prune", [0.1] * len(spark.read.parquet(f"{sf}/embeddings.parquet").first()["embedding"]), names=spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.concat(F.lit("v"), "vec_id").alias("id")))
    assert {"keyword", "vector"} <= set(",".join(r["sources"] for r in hybrid.collect()).split(","))


def test_membership_edges(spark):
    m = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "id string, community string")
    assert rows(membership_edges(m)) == [("a", "comm_x", "MEMBER_OF"), ("b", "comm_x", "MEMBER_OF"), ("c", "comm_y", "MEMBER_OF")]
