import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from tarnwork.functions.text import INTENT_WEIGHTS, SOURCES
from tarnwork.operators import assay, backlog, beliefs, evaluation, eventlog, feedback, fusion, graph, intervals, knn, training, verify


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


LOG = "seq bigint, event_type string, timestamp string, source_id string, source_file string, data string"


def test_event_log(spark):
    log = frame(spark, [(1, "git.commit", "t", "a", None, '{"message":"x"}')], LOG)
    new = frame(spark, [(0, "git.commit", "t", "b", None, "{}"), (0, "git.tag", "t", "c", None, "{broken")], LOG)
    added = eventlog.append(log, new).collect()
    assert len(added) == 1 and added[0]["seq"] > 1 and added[0]["source_id"] == "b"
    assert eventlog.scan(log, types=["x"]).count() == 0 and eventlog.scan(log, prefix="git.", source_id="a").count() == 1
    payloads = frame(spark, [('{"a":1}',), ('"{\\"a\\":1}"',), ('{"v":2,"payload":{"a":1}}',), ('{"v":2,"payload":"{\\"a\\":1}"}',), ("{",), (None,)], "data string")
    assert [r[0] for r in payloads.select(F.get_json_object(eventlog.payload(F.col("data")), "$.a")).collect()] == ["1"] * 4 + [None] * 2
    assert eventlog.federate({"x": log, "y": log.drop("data")}).groupBy("repo").count().count() == 2


def test_upserts(spark):
    old, new = frame(spark, [(1, "a", "e"), (2, "b", "f")], "k bigint, v string, evidence string"), frame(spark, [(2, "c", None), (3, "d", None)], "k bigint, v string, evidence string")
    assert rows(eventlog.upsert(old, new, ["k"])) == [(1, "a", "e"), (2, "c", None), (3, "d", None)]
    assert rows(eventlog.upsert(old, new, ["k"], ("evidence",))) == [(1, "a", "e"), (2, "c", "f"), (3, "d", None)]
    assert rows(eventlog.insert_or_ignore(old, new, ["k"])) == [(1, "a", "e"), (2, "b", "f"), (3, "d", None)]
    assert rows(eventlog.replace_by_key(old, frame(spark, [(9, "b", "z")], "k bigint, v string, evidence string"), "v")) == [(1, "a", "e"), (9, "b", "z")]
    assert rows(eventlog.prune_missing(old, frame(spark, [("a",)], "v string"), "v")) == [(1, "a", "e")]
    assert rows(eventlog.latest(frame(spark, [(1, 5, "x"), (1, 7, "y"), (2, 1, None)], "k bigint, seq bigint, v string"), ["k"], ["seq"])) == [(1, 7, "y"), (2, 1, None)]


def test_feedback(spark):
    q = '{"session_id":"s","query_id":"q1","query":"w","mode":"m","results":[{"doc_id":"src/a","rank":1,"score":0.5},{"doc_id":"zzz","rank":2,"score":0.4}]}'
    c = '{"sha":"c1","session_id":"s","files":[{"path":"src/a.rs","change_type":"modified"},{"path":"src/b.rs","change_type":"added"}]}'
    log = frame(spark, [(1, "scry.query", "t", "q1", None, q), (2, "git.commit", "t", "c1", None, c), (3, "scry.use", "t", "q1", None, '{"query_id":"q1","rank":1}'), (4, "scry.feedback", "t", "q1", None, '{"query_id":"q1","signal":"good"}'), (5, "scry.feedback", "t", "q1", None, '{"query_id":"q1","signal":"bad"}')], LOG)
    assert {(r["doc_id"], r["is_hit"]) for r in feedback.query_hits(log).collect()} == {("src/a", 1), ("zzz", 0)}
    a = feedback.query_analysis(log).first()
    assert (a["use_count"], a["used_ranks"], a["feedback_signal"]) == (1, "1", "good")
    assert feedback.commit_files(log).count() == 2 and feedback.commit_files(log, one_row_per_commit=True).count() == 1
    assert feedback.result_at(log, "q1", 2).first()["doc_id"] == "zzz"
    assert feedback.precision(feedback.query_hits(log)).first()["hit_rate"] == 0.5


def test_latest_interval(spark):
    p = frame(spark, [(1, "u", 100), (2, "u", 5_000), (3, "v", 10)], "id bigint, k string, s bigint").withColumn("at", F.timestamp_seconds("s")).drop("s")
    i = frame(spark, [(1, "u", 0, 4000), (2, "u", 50, 90_000), (3, "v", 20, 30)], "sid bigint, k string, a bigint, b bigint").select("sid", "k", F.timestamp_seconds("a").alias("begin"), F.timestamp_seconds("b").alias("end"))
    got = intervals.latest_match(p, i, ["k"], "at", "begin", "end", "id", "sid", width_s=600)
    assert rows(got.select("id", "sid")) == [(1, 2), (2, 2)]


def test_moments(spark):
    commits = frame(spark, [("a", "init", "2024"), ("b", "BREAKING change", "2025"), ("c", "refactor x", "2025"), ("d", "migrate db", "2025"), ("e", "plain", "2025"), ("f", "big", None)], "sha string, message string, timestamp string")
    files = frame(spark, [("e", f"f{i}") for i in range(4)] + [("f", f"f{i}") for i in range(6)], "sha string, file_path string")
    got = {r["sha"]: r["moment_type"] for r in assay.moments(commits, files, big=5, major=3).collect()}
    assert got == {"a": "genesis", "b": "breaking", "c": "rewrite", "d": "migration", "e": "major", "f": "big_bang"}
    s = assay.moments_summary(commits, files, big=5, major=3).first()
    assert (s["total_commits"], s["big_bang"], s["major"], s["breaking"], s["migration"], s["rewrite"], s["genesis"]) == (6, 1, 1, 1, 1, 1, 1)
    assert assay.moments(commits.limit(0), files).count() == 0


def test_size_rank_matches_percent_rank(spark):
    df = frame(spark, [("a", 1), ("b", 5), ("c", 5), ("d", 9)], "path string, bytes bigint")
    assert {r[0]: r[1] for r in assay.size_rank(df).collect()} == {"a": 0.0, "b": 1 / 3, "c": 1 / 3, "d": 1.0}
    assert assay.size_rank(df.limit(1)).first()["file_size_rank"] == 0.5


def test_importers_and_search(spark):
    m = frame(spark, [("src/a/b.rs",), ("src/a.rs",), ("src/z.rs",)], "path string")
    i = frame(spark, [("x", "crate::a::b::f"), ("y", "crate::a"), ("x", "crate::a")], "file string, import_path string")
    assert {r[0]: r[1] for r in assay.importer_counts(m, i).collect()} == {"src/a/b.rs": 1, "src/a.rs": 2}
    assert assay.search(frame(spark, [("a_b",), ("axb",), (None,)], "n string"), ["n"], "A_B", ["n"]).count() == 1
    t = frame(spark, [("s1", "f", "2024-01-02", "x"), ("s2", "f", "2024-01-05", "y"), ("s3", "g", "2023-01-01", "z")], "sha string, file_path string, d string, author_name string").withColumn("day", F.col("d").cast("date"))
    r = assay.recent_changes(t, "2024-01-01").collect()
    assert [(x["file_path"], x["sha"], x["n_changes"]) for x in r] == [("f", "s2", 2)]
    assert assay.recent_changes(t, "2020-01-01", limit=1, compat=True).count() == 1


def test_co_change_is_symmetric_and_capped(spark):
    files = frame(spark, [("1", "b"), ("1", "a"), ("1", "a"), ("2", "a"), ("3", "a"), ("3", "b"), *[("4", f"x{i}") for i in range(5)]], "sha string, file_path string")
    assert rows(assay.co_change_pairs(files, most=4)) == [("a", "b", 2)]


LISTS = "query_id string, source string, doc_id string, score double"


def test_fusion(spark):
    lists = fusion.ranked(frame(spark, [("q", "lexical", "A", 2.0), ("q", "lexical", "B", 1.0), ("q", "semantic", "B", 0.9), ("q", "semantic", "C", 0.8)], LISTS))
    got = [(r["doc_id"], sorted(r["sources"])) for r in fusion.rrf(lists).orderBy("rank").collect()]
    assert got == [("B", ["lexical", "semantic"]), ("A", ["lexical"]), ("C", ["semantic"])]
    assert [r["doc_id"] for r in fusion.rrf(lists, limit=2).orderBy("rank").collect()] == ["B", "A"]
    intents = frame(spark, [("q", "temporal")], "query_id string, intent string")
    b = fusion.rrf_by_intent(lists, intents).where("doc_id = 'A'").first()["fused_score"]
    assert b == round(2.0 / 61, 9)
    w = fusion.why(fusion.rrf(lists), "B").orderBy("source").collect()
    assert [(x["source"], x["source_rank"]) for x in w] == [("lexical", 2), ("semantic", 1)]
    with pytest.raises(ValueError):
        fusion.engine({"lexical": None})


@settings(max_examples=15, deadline=None)
@given(st.permutations(list("abcdef")))
def test_rrf_does_not_depend_on_the_order_of_rows(spark, order):
    data = [("q", "lexical", x, float(ord(x) % 3)) for x in order] + [("q", "semantic", x, float(ord(x))) for x in order[::-1]]
    got = [(r["doc_id"], r["fused_score"]) for r in fusion.rrf(fusion.ranked(frame(spark, data, LISTS))).orderBy("rank").collect()]
    want = [(r["doc_id"], r["fused_score"]) for r in fusion.rrf(fusion.ranked(frame(spark, sorted(data), LISTS))).orderBy("rank").collect()]
    assert got == want


def test_belief_merge_expansion_impact(spark):
    v, t = frame(spark, [("q", "a", 0.8), ("q", "b", 0.5), ("q", "n", 0.0)], "query_id string, doc_id string, score double"), frame(spark, [("q", "a", 2.0), ("q", "c", 4.0)], "query_id string, doc_id string, score double")
    assert {r["doc_id"]: r["score"] for r in fusion.merge_belief_lists(v, t).collect()} == {"a": round(0.56 + 0.15, 6), "b": 0.5, "c": 1.0}
    hits = frame(spark, [("q", "s1", 1.0, 1), ("q", "s2", 0.5, 2)], "query_id string, doc_id string, score double, rank bigint")
    ex = fusion.expand_commits(hits, frame(spark, [("s2", "x"), ("s1", "z"), ("s1", "y")], "sha string, file_path string")).orderBy("place").collect()
    assert [(r["doc_id"], r["score"]) for r in ex] == [("s1", 1.0), ("s2", 0.5), ("y", 0.9), ("z", 0.9), ("x", 0.45)]
    reach = frame(spark, [(f"b{i}", "f", i / 10) for i in range(5)], "belief_id string, file_path string, reach_score double")
    assert [r["belief_id"] for r in fusion.belief_impact(frame(spark, [("f::g",)], "doc_id string"), reach).orderBy("rn").collect()] == ["b4", "b3", "b2"]


def test_intent_weights_cover_all_sources():
    assert all(len(w) == len(SOURCES) for w in INTENT_WEIGHTS.values())


def test_graph(spark):
    e = frame(spark, [(1, "a", "b", "Uses", 1.0, "x"), (2, "a", "c", "Knows", 1.0, None)], "edge_id bigint, from_node string, to_node string, edge_type string, weight double, evidence string")
    n = frame(spark, [("b", ["rust"]), ("c", ["python"])], "id string, domains array<string>")
    assert rows(graph.related(n, e, "a", ["Uses"]).select("id", "weight")) == [("b", 1.0)]
    usage = frame(spark, [(1, i < 4) for i in range(5)], "edge_id bigint, useful boolean")
    s = graph.usage_stats(e, usage).withColumn("w", graph.learned_weight(F.col("weight"), F.col("useful"), F.col("total")))
    assert {r["edge_id"]: round(r["w"], 6) for r in s.collect()} == {1: 0.9 + 0.1 * 1.8, 2: 1.0}
    assert rows(graph.route(frame(spark, [("bb", ["rust"]), ("cc", ["python"])], "id string, domains array<string>"), "rust lifetimes").select("id")) == [("bb",)] and graph.route(n, "hello").count() == 2
    new = frame(spark, [(1, "a", "b", "Uses", 2.0, None)], "edge_id bigint, from_node string, to_node string, edge_type string, weight double, evidence string")
    assert graph.add_edges(e, new).where("to_node = 'b'").first()["evidence"] == "x"
    nodes, edges = graph.delete_node(n, e, "b")
    assert nodes.count() == 1 and edges.count() == 1
    hits = frame(spark, [("b", "d1", 1.0), ("c", "d2", 1.05)], "repo string, doc_id string, score double")
    assert graph.routed_search(hits, e, "a").first()["doc_id"] == "d1"
    assert rows(graph.detect_domains(frame(spark, [("r", "Cargo.toml"), ("r", "x/package.json"), ("s", "y")], "repo string, path string"))) == [("r", ["javascript", "rust"])]


def test_verification(spark):
    tables = {"call_graph": frame(spark, [("a", "insert_event", "f1"), ("b", "insert_event", "f1")], "caller string, callee string, file string").withColumn("call_type", F.lit("direct")), "commits": frame(spark, [("s", "refactor", "t")], "sha string, message string, timestamp string"), "commit_files": frame(spark, [("s", "f")], "sha string, file_path string")}
    claims = [("assay", 'callers --pattern "insert_event" | count(distinct file)', "= 1"), ("assay", "callers", "= 1"), ("temporal", "derive-moments | summary.rewrite", "= 2"), ("sql", "select count(*) from commits", ">= 1"), ("sql", "-- x\nwith a as (select 1 as n) select n from a", "= 1"), ("sql", "select nothing from commits", "= 1"), ("sql", "drop table commits", "= 1"), ("other", "", "= 1")]
    got = {r["label"]: r["status"] for r in verify.verify(spark, [{"belief_id": "b", "label": str(i), "type": t, "text": x, "expect": e} for i, (t, x, e) in enumerate(claims)], tables).collect()}
    assert [got[str(i)] for i in range(len(claims))] == ["pass", "error", "contested", "pass", "pass", "error", "error", "error"]
    md = '# x\n## Verification\n```verify type="sql" label="l" expect="> 1"\nselect 1\n```\n## Other\n```verify type="sql"\nselect 2\n```\n'
    assert verify.parse_blocks(md) == [{"type": "sql", "label": "l", "expect": "> 1", "text": "select 1"}]
    for bad in ("", "-- only", "update x set a=1", "select 1; drop table x", "with a as (delete from x) select 1"):
        with pytest.raises(verify.Refused):
            verify.check_sql(bad)
    assert verify.check_sql("select updated_at from x;") == "select updated_at from x"


def test_beliefs(spark):
    b = frame(spark, [("a-b", 0, 0, 0, 0, 0, "active"), ("c-d", 2, 0, 1, 0, 1, None)], "id string, evidence_count int, evidence_verified int, cited_by_beliefs int, cited_by_sessions int, applied_in int, status string")
    reach = frame(spark, [(" C-D ", "f")], "belief_id string, file_path string")
    got = {r["id"]: r["flags"] for r in beliefs.audit(b, reach).collect()}
    assert got == {"a-b": "no-evidence,unused,no-applications,floating", "c-d": "unverified"}
    texts = frame(spark, [("a-b", "see a-b and c-d"), (None, "c-d, again c-d"), ("x", None)], "owner string, text string")
    assert rows(beliefs.citations(b, texts)) == [("c-d", 2)]
    near = frame(spark, [("a-b", "s1", 0.9), ("a-b", "s2", 0.5)], "belief_id string, sha string, score double")
    files = frame(spark, [("s1", "x.rs"), ("s1", "x.md"), ("s2", "y.rs")], "sha string, file_path string")
    fns = frame(spark, [("x.rs", "f_ab"), ("x.rs", "g")], "file string, name string")
    g = beliefs.grounding(near, files, fns)
    assert [(r["file_path"], r["function_count"]) for r in g.collect()] == [("x.rs", 2)]


def test_evaluation(spark):
    r = frame(spark, [("q1", "a", 1), ("q1", "b", 2), ("q2", "z", 1)], "query_id string, doc_id string, rank bigint")
    g = frame(spark, [("q1", "b"), ("q1", "c"), ("q2", "y")], "query_id string, doc string")
    q = frame(spark, [("q1",), ("q2",), ("q3",)], "query_id string")
    assert rows(evaluation.per_query(q, r, g)) == [("q1", 0.5, 0.5, 0.5), ("q2", 0.0, 0.0, 0.0), ("q3", 0.0, 1.0, 1.0)]
    p = evaluation.nearest_rank_percentiles(frame(spark, [(float(x),) for x in (10, 20, 30, 40, 40)], "v double"), "v", (0, 50, 95, 100)).first()
    assert (p["p0"], p["p50"], p["p95"], p["p100"]) == (10, 30, 40, 40)
    assert rows(evaluation.repo_recall(frame(spark, [("q", "a:x"), ("q", "y")], "query_id string, doc_id string"), frame(spark, [("q", "A"), ("q", "b")], "query_id string, repo string"))) == [("q", 0.5)]
    contains = evaluation.per_query(q, frame(spark, [("q1", "src/a.rs:42", 1)], "query_id string, doc_id string, rank bigint"), frame(spark, [("q1", "src/a.rs")], "query_id string, doc string"), contains=True)
    assert contains.where("query_id = 'q1'").first()["rr"] == 1.0


def test_knn_exact_and_indexed(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(10, 16))
    m = (centre[rng.integers(0, 10, 600)] + 0.4 * rng.normal(size=(600, 16))).astype(np.float32)
    v = frame(spark, [(i, [float(x) for x in r]) for i, r in enumerate(m)] + [(9999, None)], "vec_id bigint, embedding array<float>")
    q = v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    exact = {}
    for r in knn.knn(v, q, 10).collect():
        exact.setdefault(r["query_id"], set()).add(r["vec_id"])
    u = knn.unit(m.astype(np.float64))
    s = u[::20] @ u.T
    for i, query in enumerate(range(0, 600, 20)):
        s[i, query] = -9
        assert exact[query] == set(np.argsort(-s[i])[:10].tolist())
    centres = knn.fit_centres(v, 12)
    index = knn.build_index(v, centres)
    assert index.count() == 600
    found = {}
    for r in knn.probe_index(index, centres, q, 10, 6).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(found.get(k, set()) & e) / 10 for k, e in exact.items()]) >= 0.9
    old = knn.BLOCK_VALUES
    knn.BLOCK_VALUES = 100
    try:
        again = {(r["query_id"], r["vec_id"]) for r in knn.knn(v, q, 10).collect()}
    finally:
        knn.BLOCK_VALUES = old
    assert again == {(k, x) for k, e in exact.items() for x in e}
    assert knn.knn(v.limit(0), q, 3).count() == 0 and knn.knn(v, q.limit(0), 3).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        knn.knn(v, frame(spark, [(1, [1.0, 2.0])], "query_id bigint, embedding array<float>"), 3).collect()


def test_projection_and_triplets(spark, tmp_path):
    p = training.Projection(8, 16, 4)
    x = np.random.default_rng(1).normal(size=(5, 8))
    p.save(str(tmp_path / "w.npz"))
    again = training.Projection.load(str(tmp_path / "w.npz"))
    df = frame(spark, [([float(y) for y in r],) for r in x], "v array<double>")
    got = np.array([r[0] for r in df.select(again.column(spark, F.col("v"))).collect()])
    assert got.shape == (5, 4) and np.allclose(np.sort(got, 0), np.sort(p(x), 0))
    rng = np.random.default_rng(3)
    base = rng.normal(size=(200, 8))
    losses = training.train(p, np.stack([base, base + 0.3 * rng.normal(size=base.shape), rng.normal(size=base.shape)], 1), epochs=40, rate=0.5)
    assert losses[-1] < losses[0]
    co = frame(spark, [("a", "b", 3), ("a", "c", 1), ("d", "e", 2), ("f", "g", 2)], "file_a string, file_b string, count bigint")
    for r in training.cochange_triplets(co).collect():
        assert (r["anchor"], r["positive"]) in {("a", "b"), ("d", "e"), ("f", "g")} and r["negative"] not in {r["anchor"], r["positive"], "c" if r["anchor"] == "a" else ""}
    obs = frame(spark, [(s, f"{s}{i}") for s in "xyz" for i in range(4)], "session_id string, item string")
    out = training.session_triplets(obs).collect()
    assert out and all(r["anchor"][0] == r["positive"][0] != r["negative"][0] for r in out)


def test_backlog(spark):
    refs = frame(spark, [("r", 1, "d2", None, None), ("r", 2, "d3", None, None), ("r", 3, "d1", "t", None), ("r", 4, "d1", None, "x")], "repo string, ref_number bigint, discovered string, resolved string, error string")
    assert [r["ref_number"] for r in backlog.pending_refs(refs).collect()] == [2, 1]
    assert rows(backlog.backlog_counts(refs)) == [("r", 4, 1, 1, 2)]
    done = backlog.resolve(refs, frame(spark, [("r", 4, "now", None), ("r", 1, None, "gone")], "repo string, ref_number bigint, resolved string, error string"))
    assert {r["ref_number"]: (r["resolved"], r["error"]) for r in done.collect()} == {1: (None, "gone"), 2: (None, None), 3: ("t", None), 4: ("now", None)}
    ev = frame(spark, [(1, "a", 5), (2, "b", 9), (3, "c", 5)], "seq bigint, sha string, pr_ref bigint")
    assert rows(backlog.discover_refs(ev, frame(spark, [(9,)], "ref_number bigint"))) == [(5, "a")]
    k = frame(spark, [("1", 1, None, ["x"]), ("2", 2, "1", ["x"]), ("3", 3, None, ["y"])], "id string, timestamp bigint, supersedes string, domains array<string>")
    assert [r["id"] for r in backlog.knowledge(k).collect()] == ["3", "2"] and [r["id"] for r in backlog.knowledge(k, ["x"]).collect()] == ["2"]
    m = frame(spark, [("s", "0.1", "0.2", "pending"), ("s", "0.1", "0.10", "pending"), ("s", "0.1", "0.05", "pending")], "spec_id string, current string, version string, status string")
    assert rows(backlog.next_milestone(m)) == [("s", "0.10")]
