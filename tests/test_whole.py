"""Whole jobs: what a cut would lose."""

import pytest

from conftest import rows
from tarnwork.operators import training
from tarnwork.queries import assay, knowledge, retrieval

CO = "file_a string, file_b string, count bigint"


def frame(spark, data, schema):
    return spark.createDataFrame(data, schema)


def stored(spark, path, **tables):
    """A folder of tables, as queries read them."""
    for name, (data, schema) in tables.items():
        frame(spark, data, schema).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def test_cochange_anchors_sum_rows_of_either_order(spark, tmp_path):
    d = stored(spark, tmp_path, co_changes=([("a", "b", 1), ("b", "a", 1), ("a", "c", 1), ("c", "a", None), *[(f"x{i}", f"y{i}", 1) for i in range(200)]], CO))
    got = knowledge.triplets_cochange(spark, d).collect()
    assert {(r["anchor"], r["positive"]) for r in got} == {("a", "b"), ("b", "a")}
    assert all(r["negative"] not in ("a", "b", "c" if r["anchor"] == "a" else "") for r in got)
    assert rows(training.cochange_triplets(spark.read.parquet(f"{d}/co_changes.parquet")).select("anchor", "positive")) == [("a", "b")]


def test_days_of_commits_written_in_any_form(spark, tmp_path):
    times = {"iso": "2026-05-01T00:30:00+02:00", "mail": "Sun, 3 May 2026 10:00:00 +0000", "epoch": "1777975200", "ctime": "Tue May 5 11:00:00 2026", "nbsp": " 2026-05-06T09:00:00Z", "slash": "05/07/2026 09:00", "old": "Mon, 5 Jan 2026 10:00:00 +0000"}
    commits = [(k, "message", "ann", "ann@here.example", v, None) for k, v in times.items()]
    files = [(k, f"src/{k}.rs", "modified", 1, 0) for k in times] + [(k, "src/all.rs", "modified", 1, 0) for k in times] + [("ctime", "src/epoch.rs", "modified", 1, 0)]
    d = stored(
        spark, tmp_path,
        commits=(commits, "sha string, message string, author_name string, author_email string, timestamp string, branch string"), commit_files=(files, "sha string, file_path string, change_type string, lines_added int, lines_removed int"),
        repo_zones=([("x/here", "here", "UTC")], "repo string, name string, zone string"), co_changes=([], CO),
        eventlog=([], "seq bigint, event_type string, timestamp string, source_id string, source_file string, data string"),
    )
    got = {r["file_path"]: (r["day"], r["sha"], r["n_changes"]) for r in assay.recent_changes(spark, d).collect()}
    assert got == {
        "src/iso.rs": ("2026-04-30", "iso", 1), "src/mail.rs": ("2026-05-03", "mail", 1), "src/epoch.rs": ("2026-05-05", "ctime", 2), "src/ctime.rs": ("2026-05-05", "ctime", 1),
        "src/nbsp.rs": ("2026-05-06", "nbsp", 1), "src/slash.rs": ("2026-05-07", "slash", 1), "src/all.rs": ("2026-05-07", "slash", 6),
    }
    levels = {r["path"]: r["activity_level"] for r in assay.module_signals(spark, d).collect()}
    assert levels["src/mail.rs"] == levels["src/iso.rs"] == "medium" and levels["src/old.rs"] == "dormant"


def test_cochange_precision_looks_at_partners_of_either_order(spark, tmp_path):
    co = [("a", "z", 3), ("b", "a", 2), ("a", "b", 2), *[("a", f"p{i:02}", 3) for i in range(9)]]
    d = stored(spark, tmp_path, co_changes=(co, CO), commit_files=([("1", "a"), ("1", "b")], "sha string, file_path string"))
    got = {r["file_a"]: (r["p5"], r["p10"]) for r in knowledge.cochange_precision(spark, d).collect()}
    assert got["a"] == (0.2, 0.1) and got["b"] == (1.0, 1.0) and got["z"] == (0.0, 0.0) and len(got) == 12


def test_imports_sum_the_rows_of_a_pair(spark, tmp_path):
    d = stored(spark, tmp_path, co_changes=([("src/core/a.rs", "src/rank_b.rs", 1), ("src/core/a.rs", "src/rank_b.rs", 1), ("src/core/c.rs", "src/d.rs", 1), ("src/d.rs", "src/core/c.rs", 1), ("src/core/e.rs", "src/f.rs", 1), ("src/core/e.rs", "src/f.rs", None)], CO))
    want = [("src/core/a.rs", "crate::rank_b"), ("src/core/c.rs", "crate::d"), ("src/d.rs", "crate::core::c")]
    assert rows(assay.imports(spark, d)) == want
    assert rows(assay.imports_of(spark, d)) == want[:2] and [r["file"] for r in assay.importers_of(spark, d).collect()] == ["src/core/a.rs"]


def test_every_anchor_has_a_negative_if_there_is_one(spark):
    co = frame(spark, [("hub", f"p{i:03}", 2) for i in range(300)] + [("x", "y", 2)], CO)
    got = training.cochange_triplets(co, both_ways=True).collect()
    assert len(got) == 602 and {r["negative"] for r in got if r["anchor"] == "hub"} <= {"x", "y"}
    few = frame(spark, [("a", "b"), ("a", "c"), ("d", "b")], "caller string, callee string")
    with pytest.warns(UserWarning, match="1 anchors have no negative"):
        assert rows(training.dependency_triplets(few)) == [("d", "b", "c")]


def test_federation_cuts_each_repository_by_itself(spark, tmp_path):
    texts = [(i, "index decision", "zz_many") for i in range(250)] + [(900, "index " + "other words " * 30, "one")] + [(1000 + i, "nothing here", "none_of_it") for i in range(600)]
    d = stored(spark, tmp_path, documents=([(i, t, "en", s, len(t), "notes", None) for i, t, s in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint, kind string, path string"))
    got = [r["doc_id"] for r in retrieval.repo_federation(spark, d).where("query_id = 'q2'").orderBy("rank").collect()]
    assert got[:2] == ["[one] 900", "[zz_many] 0"] and len(got) == 10


def test_nearest_in_blocks_and_slices(spark, monkeypatch):
    import numpy as np

    from tarnwork.operators import knn

    rng = np.random.default_rng(2)
    m = np.round(rng.normal(size=(120, 6)), 1)
    m[10], m[11:14], m[40] = 0, m[9], m[5]  # a zero vector, ties and a copy
    v = spark.createDataFrame([(i, [float(x) for x in r], "x") for i, r in enumerate(m)] + [(None, [1.0] * 6, ""), (500, None, "")], "vec_id bigint, embedding array<double>, label string").repartition(3)
    q = v.where("vec_id % 4 = 0").selectExpr("vec_id as query_id", "embedding")
    u = knn.unit(m)
    s = np.round(u @ u.T, 9)
    want = {(i, j) for i in range(0, 120, 4) for j in sorted((x for x in range(120) if x != i), key=lambda x: (-s[i, x], x))[:7]}
    for block, scores in ((8_000_000, 4_000_000), (60, 50)):
        monkeypatch.setattr(knn, "BLOCK_VALUES", block)
        monkeypatch.setattr(knn, "SCORES", scores)
        assert {(r["query_id"], r["vec_id"]) for r in knn.knn(v, q, 7).collect()} == want
    assert knn.knn(v, q.limit(0), 7).count() == 0 and knn.knn(v.limit(0), q, 7).count() == 0


def test_containment_search_in_passes(spark, monkeypatch):
    from tarnwork.operators import assay

    co = spark.createDataFrame([(f"src/f{i % 7}.rs", f"src/g{i % 11}.rs", i) for i in range(60)], "file_a string, file_b string, count bigint")
    q = spark.createDataFrame([(f"q{i}", f"f{i % 7} g{i % 11} rs") for i in range(9)] + [("none", " ")], "query_id string, query string")
    one = sorted(map(tuple, assay.temporal_neighbours(co, q).collect()))
    monkeypatch.setattr(assay, "BATCH", 2)
    assert one and sorted(map(tuple, assay.temporal_neighbours(co, q).collect())) == one


def test_size_ranks(spark):
    from tarnwork.operators.assay import size_rank

    sizes = [0, 0, 1, 5, 5, 5, 1000, 1001, 1002, 2**40, 2**40 + 1, 2**40]
    df = spark.createDataFrame([(str(i), b) for i, b in enumerate(sizes)], "path string, bytes bigint")
    got = {r["path"]: r["file_size_rank"] for r in size_rank(df).collect()}
    assert got == {str(i): sum(x < b for x in sizes) / (len(sizes) - 1) for i, b in enumerate(sizes)}
    assert [r["file_size_rank"] for r in size_rank(df.limit(1)).collect()] == [0.5] and size_rank(df.limit(0)).count() == 0
