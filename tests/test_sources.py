"""Scans, archives, configurations, parsing and streams on fixtures."""

import io
import zipfile

from pyspark.sql import functions as F

from weft.operators.embed import embed, embedding_text
from weft.sources.parser import enclosing, parse
from weft.sources.repository import go_module, path_aliases, scan, unzip
from weft.streaming.events import current, distinct_events, run_once, sessions, upsert_stream, windowed


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src/a.ts").write_text("export const a = 1;\n")
    (tmp_path / "src/b.bin").write_bytes(b"\xff\xfe")
    (tmp_path / "node_modules/x.js").write_text("x")
    assert sorted(r["path"] for r in scan(spark, str(tmp_path)).collect()) == ["src/a.ts", "src/b.bin"]


def test_unzip(spark):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("root/src/a.py", "x = 1")
        z.writestr("root/.git/config", "y")
    got = unzip(spark.createDataFrame([("a.zip", bytearray(b.getvalue())), ("bad.zip", bytearray(b"no"))], "path string, content binary"))
    assert [(r["archive"], r["path"]) for r in got.collect()] == [("a.zip", "src/a.py")]


def test_configuration(spark):
    text = '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*", "lib/*"], /* two */ "~": ["x"],}}}'
    got = spark.range(1).select(path_aliases(F.lit(text)).alias("a"), go_module(F.lit("// c\nmodule example.org/x\n\ngo 1.22\n")).alias("m")).first()
    assert got["a"] == {"@/": "src/", "~": "x"} and got["m"] == "example.org/x"


def test_parse(spark):
    files = [
        ("a.py", "import os\nclass A(B):\n    def m(self):\n        return helper(1)\n\ndef _f():\n    pass\n"),
        ("a.ts", "import { x } from './b';\nexport class C extends D {\n  run(): void {\n    go();\n  }\n}\nconst h = (a) => a;\n"),
        ("a.go", 'package p\n\nimport "fmt"\n\nfunc Main() {\n\tfmt.Println("x")\n}\n'), ("bad.py", "def ("), ("none.py", None), ("n.txt", "x"),
    ]
    p = parse(spark.createDataFrame(files, "path string, content string"))
    d = {(r["file"], r["label"], r["name"], r["exported"]) for r in p.where("kind = 'definition'").collect()}
    assert d == {("a.py", "Class", "A", True), ("a.py", "Method", "m", True), ("a.py", "Function", "_f", False), ("a.ts", "Class", "C", True), ("a.ts", "Method", "run", False), ("a.ts", "Function", "h", False), ("a.go", "Function", "Main", True)}
    assert {(r["file"], r["name"]) for r in p.where("kind = 'import'").collect()} == {("a.py", "os"), ("a.ts", "./b"), ("a.go", "fmt")}
    assert {(r["name"], r["detail"]) for r in p.where("kind = 'heritage'").collect()} == {("A", "B"), ("C", "D")}
    assert [r["file"] for r in p.where("kind = 'unparsed'").collect()] == ["bad.py"]
    c = enclosing(p.where("kind = 'call'"), p.where("kind = 'definition'"))
    assert {(r["name"], r["caller"]) for r in c.collect()} == {("helper", "m"), ("go", "run"), ("Println", "Main")}


def test_embeddings(spark):
    n = spark.createDataFrame([("a", "File", "x.ts", "s/x.ts", "let a;"), ("b", "Folder", "s", "s", None), ("c", "Class", None, None, None)], "id string, label string, name string, filePath string, content string")
    t = embedding_text(n)
    got = {r["id"]: r["embedding"] for r in embed(t, spark.createDataFrame([("c",)], "id string")).collect()}
    assert set(got) == {"a"} and abs(sum(x * x for x in got["a"]) - 1) < 1e-5


def test_streams_equal_batches(spark, sf, tmp_path):
    src = str(tmp_path / "events")
    batch = spark.read.parquet(f"{sf}/events.parquet")
    batch.orderBy("ts").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(batch.schema).parquet(src)
    got = run_once(distinct_events(stream).select("event_id"), "d1", checkpoint=str(tmp_path / "c1"))
    assert got.count() == batch.select("event_id").distinct().count()
    w = run_once(windowed(stream), "w1", "complete", str(tmp_path / "c2"))
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, windowed(batch).collect()))
    s = run_once(sessions(stream), "s1", "complete", str(tmp_path / "c3"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, sessions(batch).collect()))


def test_upsert_stream(spark, tmp_path):
    src, target = str(tmp_path / "in"), str(tmp_path / "t")
    schema = "id string, v int"
    for i, rows in enumerate([[("a", 1), ("b", 1)], [("a", 3), ("a", 2), ("c", 1)], [("b", 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        upsert_stream(spark.readStream.schema(schema).parquet(src), target, "id", "v", str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, current(spark, target).select("id", "v").collect())) == [("a", 3), ("b", 1), ("c", 1)]


def test_orphan_stream_equals_batch(spark, sf, tmp_path):
    from weft.operators.orphans import parents, references
    from weft.queries.general import p6_found
    from weft.sources.tables import table
    from weft.streaming.orphans import CHANGES, changes_of, follow, waiting

    refs = references(table(spark, sf, "graph_relationships")).drop("at")
    fixed = [table(spark, sf, t).select("id") for t in ("shared_nodes", "communities", "processes")]
    all_changes = changes_of(refs, parents(table(spark, sf, "parsed_nodes"), fixed, table(spark, sf, "node_deletions")).drop("at"))
    src, target = str(tmp_path / "in"), str(tmp_path / "t")
    names = [c.split()[0] for c in CHANGES.split(", ")]
    a, b = all_changes.select(*names).repartition(4).randomSplit([0.5, 0.5], 7)
    for part in (a, b):
        part.coalesce(1).write.mode("append").parquet(src)
        follow(spark.readStream.schema(CHANGES).parquet(src), target, str(tmp_path / "c")).awaitTermination()
    got = sorted(map(tuple, waiting(spark, target).select("id", "ref_end").distinct().collect()))
    assert got == sorted(map(tuple, p6_found(spark, sf).collect()))
