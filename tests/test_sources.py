import json

from conftest import rows
from pyspark.sql import functions as F

from tarnwork.operators import eventlog
from tarnwork.sources import code, git_log, markdown, records
from tarnwork.streaming import log as stream

SHA1, SHA2 = "a" * 40, "b" * 40


def test_git_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text(f"{SHA1}|feat: a | b|Ann|ann@x.example|2025-01-01T10:00:00+01:00\n\n3\t0\tsrc/a.rs\n-\t-\timg.png\n{SHA2}|fix|Bob||2025-01-02T10:00:00Z\n0\t2\tsrc/b c.rs\n")
    commits, files = git_log.read_git_log(spark, str(tmp_path / "log.txt"))
    assert rows(commits.select("sha", "message", "author_name")) == [(SHA1, "feat: a | b", "Ann"), (SHA2, "fix", "Bob")]
    assert rows(files) == sorted([(SHA1, "src/a.rs", "added", 3, 0), (SHA1, "img.png", "modified", None, None), (SHA2, "src/b c.rs", "deleted", 0, 2)], key=repr)
    (tmp_path / "tags.txt").write_text("v1|abc|2025|Ann|first | really\nbroken\n")
    assert rows(git_log.read_tags(spark, str(tmp_path / "tags.txt"))) == [("v1", "abc", "2025", "Ann", "first | really")]
    (tmp_path / "ls.txt").write_text("a\n\nb\n")
    assert git_log.read_tracked_files(spark, str(tmp_path / "ls.txt")).count() == 2


SESSION = """---
id: 20250101-100000
title: "First try"
branch: main
files_changed: 12
---
# Session
## Goals
- [x] read
- [ ] write
## Decisions
- use Parquet
* cut lineage
## Other
- no
"""
BELIEF = """---
id: cold-index
persona: architect
confidence: 0.8
---
# cold-index

Cold indexes stay cold.

## Evidence
- [[20250101-100000]] weight 0.9
- a paper by X
- [[unknown]]
## Attacked-By
- [[b]] (status: defeated)
- [[c]]
## Applied-In
- here
"""


def test_markdown(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "s.md").write_text(SESSION)
    (tmp_path / "deep" / "b.md").write_text(BELIEF)
    (tmp_path / "x.txt").write_text("no")
    docs = markdown.read_markdown(spark, str(tmp_path))
    assert docs.count() == 2
    s = docs.where(F.contains("file_path", F.lit("s.md")))
    r = markdown.sessions(s).first()
    assert (r["id"], r["title"], r["branch"], r["files_changed"]) == ("20250101-100000", "First try", "main", 12)
    assert rows(markdown.session_goals(s).select("pos", "content", "completed")) == [(0, "read", True), (1, "write", False)]
    assert rows(markdown.observations(s).select("observation_type", "content")) == [("decision", "cut lineage"), ("decision", "use Parquet")]
    b = docs.where(F.contains("file_path", F.lit("b.md")))
    r = markdown.belief_docs(b).first()
    assert (r["id"], r["statement"], r["confidence"], r["evidence_count"], r["attacked_by"], r["defeated_attacks"], r["applied_in"]) == ("cold-index", "Cold indexes stay cold.", 0.8, 3, 2, 1, 1)
    known = spark.createDataFrame([("20250101-100000",)], "id string")
    assert rows(markdown.verified_evidence(b, known)) == [("cold-index", 1, 1)]
    legacy = spark.createDataFrame([("l.md", "# T\n**Status**: done\n**Purpose**: why\n")], "file_path string, text string")
    p = markdown.patterns(legacy).first()
    assert (p["id"], p["title"], p["status"], p["purpose"]) == ("l", "T", "done", "why")


def test_code(spark):
    py = "import os\nfrom a.b import c as d, e\nLIMIT = 3\nclass K(X):\n    size: int = 0\n    @wrap(1)\n    async def run(self, n) -> int:\n        os.path.join(n)\n        return helper(n)\n"
    rs = "use crate::db::Pool;\npub const MAX: u32 = 10;\npub struct S {\n}\npub async fn load(&mut self, n: u8) -> Result<S> {\n    open(n);\n    println!(\"x\");\n}\n"
    bad = "def ("
    out = code.parse_sources(spark.createDataFrame([("m.py", py), ("l.rs", rs), ("bad.py", bad), ("n.py", None), ("x.unknown", "fn a() {}")], "path string, source string")).collect()
    facts = {(r["path"], r["kind"], r["name"]) for r in out}
    assert {("m.py", "import", "os"), ("m.py", "import", "a.b"), ("m.py", "constant", "LIMIT"), ("m.py", "type", "K"), ("m.py", "member", "size"), ("m.py", "function", "run"), ("m.py", "call", "helper"), ("m.py", "call", "os.path.join"), ("m.py", "call", "wrap")} <= facts
    assert {("l.rs", "import", "crate::db::Pool"), ("l.rs", "constant", "MAX"), ("l.rs", "type", "S"), ("l.rs", "function", "load"), ("l.rs", "call", "open"), ("l.rs", "call", "println!")} <= facts
    assert not [f for f in facts if f[0] in ("bad.py", "n.py", "x.unknown")]
    load = next(r for r in out if r["name"] == "load")
    assert load["is_public"] and load["is_async"] and load["returns"] == "Result<S>" and len(load["parameters"]) == 2


def test_read_sources(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "b.py").write_text("z")
    (tmp_path / "c.bin").write_bytes(b"\x00")
    (tmp_path / ".gitignore").write_text("# made files\n/gen/\n*_pb2.py\ndeep/**/skip.py\n!keep_pb2.py\n")
    for name in ("gen/x.py", "sub/gen.py", "a_pb2.py", "sub/keep_pb2.py", "deep/a/b/skip.py", "deep/a/skip.pyx"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("q")
    r = code.read_sources(spark, str(tmp_path)).collect()
    assert sorted(x["path"].rsplit(str(tmp_path) + "/", 1)[1] for x in r) == ["a.py", "sub/gen.py", "sub/keep_pb2.py"]
    a = next(x for x in r if x["path"].endswith("/a.py"))
    assert a["line_count"] == 2 and a["size"] == 12
    assert code.read_sources(spark, str(tmp_path), ignore=[]).count() == 6


def test_ignore_files_in_folders(spark, tmp_path):
    for name, body in ((".gitignore", "*.go\n/a/skip.py\n"), ("a/.gitignore", "/b.py\n!keep.go\nc/\n"), ("a/d/.gitignore", "*.py\n")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    for name in ("x.go", "b.py", "a/b.py", "a/skip.py", "a/keep.go", "a/c/z.py", "a/d/y.py", "a/d/e/y.py", "a/e/b.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("q")
    got = sorted(x["path"].rsplit(str(tmp_path) + "/", 1)[1] for x in code.read_sources(spark, str(tmp_path)).collect())
    assert got == ["a/e/b.py", "a/keep.go", "b.py"]


def test_records(spark, tmp_path):
    (tmp_path / "20250101.jsonl").write_text("\n".join(json.dumps({"id": str(i), "timestamp": i, "content": "c", "domains": ["x"]}) for i in range(3)) + "\nbroken\n")
    assert records.read_persona(spark, str(tmp_path / "20250101.jsonl")).count() == 3
    assert [r["id"] for r in records.read_persona(spark, str(tmp_path / "20250101.jsonl"), after="1").collect()] == ["2"]
    (tmp_path / "q.json").write_text(json.dumps({"name": "n", "queries": [{"id": "1", "query": "a", "relevant_docs": ["d"]}, {"id": "2", "query": "b"}]}))
    assert rows(records.read_query_set(spark, str(tmp_path / "q.json")).select("query_id", F.size("relevant_docs"))) == [("1", 1), ("2", 0)]
    (tmp_path / "i.json").write_text(json.dumps([{"number": 3, "title": "t", "state": "OPEN", "labels": [{"name": "bug"}], "author": {"login": "ann"}, "createdAt": "c", "url": "u"}]))
    r = records.read_forge(spark, str(tmp_path / "i.json")).first()
    assert (r["number"], r["state"], r["labels"], r["author"]) == (3, "open", '["bug"]', "ann")
    df = spark.createDataFrame([(1, "a|b")], "n int, s string")
    assert json.loads(records.to_json_rows(df).first()[0]) == {"n": 1, "s": "a|b"}
    assert "| 1 | a\\|b |" in records.report({"T": df})


def test_partitioned_log_prunes(spark, tmp_path):
    log = spark.createDataFrame([(1, "git.commit", "t", "a", None, "{}"), (2, "git.tag", "t", "b", None, "{}")], "seq bigint, event_type string, timestamp string, source_id string, source_file string, data string")
    eventlog.write_partitioned(log, str(tmp_path / "log"))
    df = eventlog.scan(spark.read.parquet(str(tmp_path / "log")), types=["git.tag"])
    assert df.count() == 1 and all("event_type=git.tag" in f for f in df.where("seq > 0").select(F.input_file_name()).distinct().toPandas().iloc[:, 0])


def test_streams(spark, tmp_path):
    data = [(i, f"2024-01-0{1 + i % 3} 10:00:00", i % 2, "view" if i % 2 else "click", 1.5, "{}") for i in range(30)]
    df = spark.createDataFrame(data, "event_id bigint, t string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("t").cast("timestamp")).select("event_id", "ts", "user_id", "event_type", "value", "props")
    df.unionByName(df.limit(5)).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = stream.read_events(spark, str(tmp_path / "in"))

    def run(name, sdf, mode="complete"):
        q = sdf.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run("dedup", stream.deduplicated(events, late="30 days"), "append").count() == 30
    counts = run("counts", stream.windowed_counts(events, late="30 days"))
    assert counts.agg(F.sum("n")).first()[0] == 35 and counts.count() == 6
    assert run("sessions", stream.session_windows(events, late="30 days")).count() == 6
    q = stream.keep_latest(events.select("user_id", "ts", "event_id"), str(tmp_path / "latest"), ["user_id"], ["ts", "event_id"], str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "latest" / "v0")).select("user_id", "event_id")) == [(0, 26), (1, 29)]


def test_log_in_small_splits(spark, tmp_path):
    sha = [f"{i:040x}" for i in range(1, 40)]
    lines = []
    for i, x in enumerate(sha):
        lines += [f"{x}|subject | {i}|Ann|a@x.example|2024-01-02T03:04:05+00:00", ""] + [f"{n}\t0\tsrc/f{i}_{n}.rs" for n in range(i % 5)]
    (tmp_path / "log.txt").write_text("\r\n".join(lines) + "\r\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257b")
    try:
        commits, files = git_log.read_git_log(spark, str(tmp_path / "log.txt"))
        assert commits.count() == 39
        got = {(r["sha"], r["file_path"]) for r in files.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == {(x, f"src/f{i}_{n}.rs") for i, x in enumerate(sha) for n in range(i % 5)}


def test_tracker_pages_on_any_file_system(spark, tmp_path):
    from tarnwork.sources import forge

    (tmp_path / "1.json").write_text('[{"number": 3, "title": "a", "state": "OPEN", "labels": [{"name": "bug"}, "docs"], "author": {"login": "ann"}, "updatedAt": "2024-02-01T00:00:00Z", "url": "u"}, {"title": "no number"}]')
    (tmp_path / "2.json").write_text('{"number": 7, "title": "b", "labels": null, "user": {"login": "bob"}, "updated_at": "2023-01-01T00:00:00Z"}')
    (tmp_path / "3.json").write_text("broken")
    rows = {r["number"]: r for r in forge.read_forge(spark, str(tmp_path)).collect()}
    assert set(rows) == {3, 7} and rows[3]["labels"] == '["bug","docs"]' and rows[3]["state"] == "open" and rows[7]["author"] == "bob" and rows[7]["labels"] == "[]"
    all_rows = forge.read_forge(spark, str(tmp_path))
    assert [r["number"] for r in forge.read_forge(spark, str(tmp_path), since="2024-01-01").collect()] == [3]
    assert forge.counts(all_rows).collect()[0][1:] == (2, 7) and forge.one(all_rows, "issue", 7).first()["title"] == "b" and forge.one(all_rows, "issue", 9).count() == 0
