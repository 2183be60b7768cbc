import json

import pytest
from pyspark.sql import functions as F

from tarnwork import api
from tarnwork.sources import config, forge, records


@pytest.fixture(scope="module")
def engine(spark):
    f = spark.createDataFrame
    tables = {
        "commits": f([("a" * 40, "feat: add fusion of ranked lists", "Ann", "2025-01-01"), ("b" * 40, "fix: parser of tags", "Bob", "2025-01-02")], "sha string, message string, author_name string, timestamp string"),
        "commit_files": f([("a" * 40, "src/fusion.rs"), ("b" * 40, "src/tags.rs")], "sha string, file_path string"),
        "patterns": f([("p1", "# Fusion of lists", "core", "why lists are fused", "rank")], "id string, title string, layer string, purpose string, tags string"),
        "beliefs": f([("cold-index", "a cold index stays cold", "rust", 1, 1, 0, 2, 1, "active")], "id string, statement string, facets string, evidence_count int, evidence_verified int, cited_by_beliefs int, cited_by_sessions int, applied_in int, status string"),
        "belief_code_reach": f([("cold-index", "src/tags.rs", 0.5)], "belief_id string, file_path string, reach_score double"),
        "function_facts": f([("src/fusion.rs", "rrf_fuse", "Vec"), ("src/tags.rs", "read_tags", None)], "file string, name string, return_type string"),
        "co_changes": f([("src/fusion.rs", "src/tags.rs", 3)], "file_a string, file_b string, count bigint"),
        "knowledge": f([("1", 1, None, ["x"], "cli", "prefers fusion"), ("2", 2, "1", ["x"], "cli", "prefers lists")], "id string, timestamp bigint, supersedes string, domains array<string>, source string, content string"),
        "index_state": f([("src/fusion.rs", 10, 400), ("src/tags.rs", 5, 200)], "path string, lines bigint, bytes bigint"),
        "import_facts": f([("src/tags.rs", "crate::fusion")], "file string, import_path string"),
        "eventlog": f([(1, "git.commit", "t", "a", None, "{}")], "seq bigint, event_type string, timestamp string, source_id string, source_file string, data string"),
        "module_signals": f([("src/fusion.rs", 2, "high", 9, False, False)], "path string, importer_count bigint, activity_level string, commit_count bigint, is_entry_point boolean, is_test_file boolean"),
    }
    return api.Engine(spark, tables)


def test_search(engine):
    out = engine.search(["fusion of ranked lists", "cold index"], 5).orderBy("query_id", "rank").collect()
    first = {q: [r for r in out if r["query_id"] == q][0] for q in ("0", "1")}
    assert first["0"]["doc_id"] in ("a" * 40, "p1") and first["1"]["doc_id"] == "cold-index"
    assert max(r["rank"] for r in out) <= 5 and any("persona:cli:2" == r["doc_id"] for r in out) and not any("persona:cli:1" == r["doc_id"] for r in out)
    only = engine.search("fusion", content_type="code", only=["lexical"]).collect()
    assert [r["doc_id"] for r in only] == ["src/fusion.rs::rrf_fuse"] and only[0]["importer_count"] == 2
    assert engine.search("fusion", min_score=9.0).count() == 0
    why = engine.why("cold index", "cold-index").collect()
    assert {"lexical", "belief"} <= {r["source"] for r in why}


def test_planning_and_neighbours(engine):
    assert engine.plan("rrf_fuse") == "lexical" and engine.plan("how are lists ranked together") == "semantic"
    near = engine.neighbours("p1", 3).collect()
    assert near and near[0]["doc_id"] == "a" * 40 and "p1" not in {r["doc_id"] for r in near}
    assert {r["doc_id"] for r in engine.neighbours("p1", 3, content_type="beliefs").collect()} <= {"cold-index"}
    assert api.clamp(None) == 10 and api.clamp(1000) == 100 and api.clamp(-1) == 1


def test_structure_and_reports(engine):
    assert engine.orient("src/").first()["path"] == "src/fusion.rs"
    assert engine.assay("functions", "RRF").count() == 1 and engine.assay("importers", "fusion").count() == 1 and engine.assay("inventory").count() == 2
    assert engine.moments().count() == 1 and engine.context("fusion").count() == 1 and engine.belief_metrics().first()["flags"] == ""
    assert "| rust | 2 | 15 |" in records.report(engine.report())
    with pytest.raises(KeyError):
        engine.assay("nothing")


def test_log_round_trip(engine):
    res = engine.search("fusion of ranked lists", 3).where("query_id = '0'")
    event = engine.append(engine.log_search("s", "q_1", "fusion", res))
    grown = api.Engine(engine.spark, {"eventlog": engine.tables["eventlog"].unionByName(event)})
    assert grown.result_at("q_1", 1).first()["doc_id"] == res.where("rank = 1").first()["doc_id"]


RECIPE = "version: 1\nembedding_model: small  # default\nprojections:\n  semantic:\n    layers: [768, 1024, 256]\n    epochs: 10\n    batch_size: 32\n"


def test_config(tmp_path):
    (tmp_path / "r.yaml").write_text(RECIPE)
    want = {"version": 1, "embedding_model": "small", "projections": {"semantic": {"layers": [768, 1024, 256], "epochs": 10, "batch_size": 32}}}
    assert config.read_recipe(str(tmp_path / "r.yaml")) == want == config._indented(RECIPE)
    (tmp_path / "bad.yaml").write_text("projections:\n  x:\n    layers: [1]\n")
    with pytest.raises(ValueError, match="two layers"):
        config.read_recipe(str(tmp_path / "bad.yaml"))
    (tmp_path / "m.toml").write_text('[models.small]\ndimensions = 384\n')
    assert config.read_registry(str(tmp_path / "m.toml"))["models"]["small"]["dimensions"] == 384


def test_forge_source(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps([{"number": 1, "title": "t", "state": "OPEN", "labels": [{"name": "bug"}], "author": {"login": "ann"}, "updatedAt": "2025-01-02", "url": "u"}, {"title": "no number"}]))
    (tmp_path / "2.json").write_text(json.dumps([{"number": 2, "state": "closed", "labels": ["x"], "user": {"login": "bob"}, "updated_at": "2024-01-01"}]))
    forge.register(spark)
    df = spark.read.format("forge").option("path", str(tmp_path)).load()
    assert sorted((r["number"], r["state"], r["labels"], r["author"]) for r in df.collect()) == [(1, "open", '["bug"]', "ann"), (2, "closed", '["x"]', "bob")]
    assert spark.read.format("forge").option("path", str(tmp_path)).option("since", "2025").load().select(F.count(F.lit(1))).first()[0] == 1


def test_log_of_uses_and_ratings(spark):
    from tarnwork.api import Engine
    from tarnwork.operators import feedback

    log = spark.createDataFrame([(5, "x", "2024-01-01T00:00:00Z", None, None, "{}")], "seq bigint, event_type string, timestamp string, source_id string, source_file string, data string")
    e = Engine(spark, {"eventlog": log})
    e.tables["eventlog"] = log.unionByName(e.append(e.log_use("s1", "q1", 'src/"a".rs', 2)))
    e.tables["eventlog"] = e.tables["eventlog"].unionByName(e.append(e.log_feedback("s1", "q1", "good", None)))
    use, rating = feedback.usage(e.tables["eventlog"]).first(), feedback.ratings(e.tables["eventlog"]).first()
    assert (use["query_id"], use["doc_id"], use["rank"], use["session_id"]) == ("q1", 'src/"a".rs', 2, "s1")
    assert (rating["query_id"], rating["signal"], rating["comment"], rating["session_id"]) == ("q1", "good", None, "s1")
    assert rating["seq"] > use["seq"] > 5
