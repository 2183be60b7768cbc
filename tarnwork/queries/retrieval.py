"""Vector search, rank fusion, federation, routing, enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions import text, vectors
from tarnwork.operators import fts, fusion, graph, knn
from tarnwork.operators.assay import temporal_neighbours
from tarnwork.operators.eventlog import with_payload
from tarnwork.operators.evaluation import precision_at
from tarnwork.operators.training import Projection, hashed_embedding
from tarnwork.plans.shaping import table
from tarnwork.queries import assay
from tarnwork.queries.search import BATCH_SQL, DOCS, INTENT, _batch, _bm25_sql, _docs

INTENTS = list(text.INTENT_WEIGHTS)


def _nearest(spark, d, k: int) -> DataFrame:
    v, q = knn.every_hundredth(spark, d)
    return knn.knn(v, q, k)


def knn_cosine(spark, d):
    return _nearest(spark, d, 10).withColumn("score", F.round("score", 6))


def knn_precision_at_k(spark, d):
    """Share of the 5 and 10 nearest with the query's own label, over min(k, vectors of that label)."""
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    sizes = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("expected"))
    near = _nearest(spark, d, 10).join(labels, "vec_id").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own")), "query_id").join(sizes.withColumnRenamed("label", "own"), "own")
    hit = near.withColumn("hit", F.col("own") == F.col("label"))
    return hit.groupBy("query_id").agg(F.round(precision_at(hit, 5), 6).alias("p5"), F.round(precision_at(hit, 10), 6).alias("p10"))


def knn_ann(spark, d):
    """The inverted-list index over every row; three of four lists probed, as the vectors hardly
    cluster (recall is tested against brute force). Lists grow with the rows, to 256."""
    v, q = knn.every_hundredth(spark, d)
    lists = min(256, max(16, v.count() // 50_000))
    centres = knn.fit_centres(v, lists)
    return knn.probe_index(knn.build_index(v, centres), centres, q, 10, 3 * lists // 4)


def vector_stats(spark, d):
    v = table(spark, d, "embeddings")
    unit = vectors.l2_normalise(F.col("embedding"))
    norm = F.aggregate(unit, F.lit(0.0), lambda a, x: a + x * x)
    return v.groupBy(F.col("label").cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(norm), 6).alias("mean_norm"), F.round(F.avg(vectors.euclidean(unit, F.transform(unit, lambda x: -x))), 6).alias("mean_span"))


def mlp_project(spark, d):
    p = Projection(64, 32, 16)
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return v.select("vec_id", F.posexplode(p.column(spark, F.col("embedding"))).alias("dim", "value")).withColumns({"dim": F.col("dim").cast("bigint"), "value": F.round("value", 6) + 0.0})


def _lists(spark, d) -> DataFrame:
    """Three ranked lists of vectors per query vector: by cosine, by closeness of ids within the label, and overall."""
    v = table(spark, d, "embeddings").select("vec_id", "label")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    near = _nearest(spark, d, 20).select("query_id", F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"), F.lit("semantic").alias("source"))
    gap = -F.abs(F.col("vec_id") - F.col("query_id")).cast("double")
    # the queries are a hundredth of the rows, each id only meets ids at most 60 (same label: 600) away
    def close(width: int, source: str, same: bool) -> DataFrame:
        b = lambda c: F.floor(F.col(c) / width)
        laid = q.withColumn("_b", F.explode(F.array(b("query_id") - 1, b("query_id"), b("query_id") + 1)))
        met = v.withColumn("_b", b("vec_id")).join(laid, "_b").where((F.col("vec_id") != F.col("query_id")) & (F.abs(F.col("vec_id") - F.col("query_id")) <= width))
        met = met.where("label = own") if same else met
        return met.select("query_id", F.col("vec_id").alias("doc_id"), gap.alias("score"), F.lit(source).alias("source"))

    ranked = fusion.ranked(near.unionByName(close(600, "lexical", True)).unionByName(close(60, "temporal", False)))
    return ranked.where("rank <= 20")


def rrf_fuse(spark, d):
    return fusion.rrf(_lists(spark, d), 10).select("query_id", "doc_id", "fused_score", "rank", F.array_join("sources", ",").alias("sources"))


def _intents(spark, d) -> DataFrame:
    names = F.array(*(F.lit(x) for x in INTENTS))
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.get(names, F.pmod(F.floor(F.col("vec_id") / 100), F.lit(len(INTENTS))).cast("int")).alias("intent"))


def rrf_weighted(spark, d):
    return fusion.rrf_by_intent(_lists(spark, d), _intents(spark, d), 10).select("query_id", "doc_id", "fused_score", "rank", F.array_join("sources", ",").alias("sources"))


def rrf_why(spark, d):
    """Provenance of vector 1 wherever it is among the first ten."""
    return fusion.why(fusion.rrf(_lists(spark, d), 50).withColumn("doc_id", F.col("doc_id").cast("string")), "1").withColumn("raw_score", F.round("raw_score", 6))


def _hybrid(spark, d, batch: DataFrame) -> DataFrame:
    """Lexical, semantic (hashed embedding), belief and co-change sources fused for a batch of questions."""
    docs = _docs(spark, d)
    idx = fts.index(docs, "doc_id", "text")
    terms = fts.query_terms(batch)
    lexical = fts.bm25(idx, terms, 20)
    embedded = idx.select(F.col("doc_id").alias("vec_id"), hashed_embedding(F.col("tokens")).alias("embedding"))
    asked = batch.select(F.expr("bigint(substring(query_id, 2))").alias("query_id"), hashed_embedding(fts.tokens(F.col("query"))).alias("embedding"))
    semantic = knn.knn(embedded, asked, 20, skip_self=False).select(F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query_id"), F.col("vec_id").alias("doc_id"), "score")
    beliefs = fts.bm25(fts.index(table(spark, d, "beliefs").dropDuplicates(["id"]), "id", "id", "statement", "facets"), terms, 20)
    co = table(spark, d, "co_changes").groupBy("file_a", "file_b").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))
    temporal = temporal_neighbours(co, batch, 10).withColumnRenamed("file", "doc_id")
    intents = batch.select("query_id", text.intent(F.col("query")).alias("intent"))
    fused = fusion.engine({"lexical": lexical, "semantic": semantic, "belief": beliefs, "temporal": temporal, "persona": None}, intents, 10)
    return fused.select("query_id", "doc_id", "fused_score", "rank", F.array_join("sources", ",").alias("sources"))


def hybrid_search(spark, d):
    """The fused search for four questions."""
    return _hybrid(spark, d, _batch(spark))


def hybrid_questions(spark, d):
    """The fused search for all test questions."""
    return _hybrid(spark, d, table(spark, d, "eval_items").select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query")).where("query is not null").distinct())


def _commit_hits(spark, d) -> DataFrame:
    commits = table(spark, d, "commits").select("sha", "message").where("sha is not null").dropDuplicates(["sha"])
    return fts.bm25(fts.index(commits, "sha", "message"), fts.query_terms(_batch(spark)), 10)


def lexical_commit_expand(spark, d):
    return fusion.expand_commits(_commit_hits(spark, d), table(spark, d, "commit_files"))


def annotated_hits(spark, d):
    """Files of found commits with their structural annotations."""
    hits = fusion.expand_commits(_commit_hits(spark, d), table(spark, d, "commit_files")).where("derived = 1")
    return fusion.annotate(hits.select("query_id", "doc_id", "place"), assay._signals(spark, d)).select("query_id", "doc_id", "place", "importer_count", "activity_level", "is_entry_point")


def belief_merge(spark, d):
    """Belief search: a vector-like score (confidence) and full text, merged 0.7 to 0.3."""
    beliefs = table(spark, d, "beliefs").select("id", "statement", "confidence").where("id is not null").dropDuplicates(["id"])
    words = fts.bm25(fts.index(beliefs, "id", "statement"), fts.query_terms(_batch(spark)), 30)
    ids = [q for q, _ in (("q1", 0), ("q2", 0))]
    best = beliefs.where("confidence > 0.85").select(F.explode(F.array(*(F.lit(x) for x in ids))).alias("query_id"), F.col("id").alias("doc_id"), F.col("confidence").alias("score"))
    return fusion.merge_belief_lists(best, words, limit=20)


def belief_impact(spark, d):
    hits = table(spark, d, "commit_files").select(F.col("file_path").alias("doc_id"))
    reach = table(spark, d, "belief_code_reach").select(F.lower(F.trim("belief_id")).alias("belief_id"), "file_path", "reach_score").where("belief_id is not null and reach_score is not null").groupBy("belief_id", "file_path").agg(F.max("reach_score").alias("reach_score"))
    return fusion.belief_impact(hits, reach)


def repo_federation(spark, d):
    """Every source of documents is a repository of its own, each gives its own best hits."""
    docs = _docs(spark, d).withColumn("repo", F.coalesce(F.lower(F.trim("source")), F.lit("none")))
    hits = fts.bm25(fts.index(docs, "doc_id", "text"), fts.query_terms(_batch(spark)), 200, docs.select("doc_id", "repo"))
    lists = hits.select("query_id", "repo", F.lit("lexical").alias("source"), F.col("doc_id").cast("string").alias("doc_id"), "score")
    return fusion.federated(lists, 10).select("query_id", "doc_id", "fused_score", "rank")


EDGE_TYPES = ("Uses", "LearnsFrom", "TestsWith", "Knows")


def trade_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes(id, domains), edges(edge_id, from_node, to_node, edge_type, weight) and usage(edge_id, useful) of nations that trade."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("bigint").alias("domain"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_returnflag")
    c, s = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    flows = li.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    ends = flows.select(F.col("s_nationkey").cast("bigint").alias("from_node"), F.col("c_nationkey").cast("bigint").alias("to_node"), "l_quantity", "l_returnflag").where("from_node != to_node")
    key = (F.col("from_node") * 1000 + F.col("to_node")).alias("edge_id")
    kind = F.get(F.array(*(F.lit(x) for x in EDGE_TYPES)), F.pmod(F.col("from_node") + F.col("to_node"), F.lit(4)).cast("int"))
    edges = ends.groupBy("from_node", "to_node").agg(F.round(F.avg("l_quantity") / 25.0, 6).alias("weight")).select(key, "from_node", "to_node", kind.alias("edge_type"), "weight")
    return nation, edges, ends.select(key, (F.col("l_returnflag") == "R").alias("useful"))


def related_nodes(spark, d):
    nodes, edges, _ = trade_graph(spark, d)
    return graph.related(nodes, edges, 3, ["Uses", "LearnsFrom"]).select("id", "name", "weight")


def edge_usage_stats(spark, d):
    _, edges, usage = trade_graph(spark, d)
    return graph.usage_stats(edges, usage).select("edge_id", "edge_type", "total", "useful")


def learn_weights(spark, d):
    _, edges, usage = trade_graph(spark, d)
    return graph.usage_stats(edges, usage).select("edge_id", F.round(graph.learned_weight(F.col("weight"), F.col("useful"), F.col("total")), 4).alias("weight"))


def graph_counts(spark, d):
    _, edges, _ = trade_graph(spark, d)
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_edges"), F.count_distinct("from_node").alias("n_from"))


def routed_search(spark, d):
    """Suppliers of nations related to nation 3, balances weighted by the relation."""
    _, edges, _ = trade_graph(spark, d)
    hits = table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("repo"), F.col("s_name").alias("doc_id"), F.col("s_acctbal").alias("score"))
    return graph.routed_search(hits, edges, 3, 10)


def enriched(spark, d):
    """Content of all files, commits and beliefs that belief reach rows name, in one join."""
    reach = table(spark, d, "belief_code_reach")
    hits = reach.select(F.lit("belief").alias("content_type"), F.lower(F.trim("belief_id")).alias("doc_id")).unionByName(reach.select(F.lit("pattern").alias("content_type"), F.col("file_path").alias("doc_id"))).distinct()
    known = table(spark, d, "beliefs").groupBy("id").agg(F.max("statement").alias("content")).select(F.lit("belief").alias("content_type"), "id", "content").unionByName(table(spark, d, "patterns").groupBy("id").agg(F.max("purpose").alias("content")).select(F.lit("pattern").alias("content_type"), "id", "content"))
    return fusion.enrich(hits, known)


def enriched_families(spark, d):
    """Every result of the eight families, by number and length of what it shows."""
    log = with_payload(table(spark, d, "eventlog")).select("seq", "event_type", "source_id", "payload").where("payload is not null")
    one = lambda name, key: table(spark, d, name).where(F.col(key).isNotNull()).dropDuplicates([key])
    docs = fusion.family_documents(log, assay.functions(spark, d), one("patterns", "id"), one("commits", "sha"), one("beliefs", "id"), table(spark, d, "co_changes"), assay.call_graph(spark, d)).distinct()
    hits = docs.select("content_type", F.col("id").alias("doc_id")).distinct()
    return fusion.enrich(hits, docs).groupBy("content_type").agg(F.count_distinct("doc_id").alias("n"), F.sum(F.length("content")).alias("n_chars"), F.min("content").alias("least"), F.max("content").alias("most"))


def knn_precision_summary(spark, d):
    """Mean precision at 5 and 10 against what random picks would give: the share of the label's other vectors."""
    per = knn_precision_at_k(spark, d)
    v = table(spark, d, "embeddings").select("vec_id", "label")
    sizes = v.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("others"))
    n = v.count()
    chance = v.where("vec_id % 100 = 0").join(F.broadcast(sizes), "label").select(F.col("vec_id").alias("query_id"), F.try_divide(F.col("others"), F.lit(n - 1)).alias("chance"))
    return per.join(chance, "query_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p5"), 6).alias("p5"), F.round(F.avg("p10"), 6).alias("p10"), F.round(F.avg("chance"), 6).alias("random"))


QUERIES = {
    f.__name__: f
    for f in (
        knn_cosine, knn_precision_at_k, knn_ann, vector_stats, mlp_project, rrf_fuse, rrf_weighted, rrf_why, hybrid_search, hybrid_questions, lexical_commit_expand, annotated_hits, belief_merge, belief_impact, repo_federation, related_nodes, edge_usage_stats, learn_weights,
        graph_counts, routed_search, enriched, enriched_families, knn_precision_summary,
    )
}

NEAR = """v as (select vec_id, embedding::double[] as e, label from embeddings), nr as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) as score, q.label as own, v.label from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
    nk as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from nr)"""
LISTS = f"""{NEAR}, li as (select query_id, vec_id as doc_id, round(score, 6) as score, 'semantic' as source, rank from nk where rank <= 20
    union all select query_id, vec_id, g, 'lexical', rk from (select q.vec_id as query_id, v.vec_id, -abs(v.vec_id - q.vec_id)::double as g, row_number() over (partition by q.vec_id order by abs(v.vec_id - q.vec_id), v.vec_id) as rk
        from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id and v.label = q.label and abs(v.vec_id - q.vec_id) <= 600) where rk <= 20
    union all select query_id, vec_id, g, 'temporal', rk from (select q.vec_id as query_id, v.vec_id, -abs(v.vec_id - q.vec_id)::double as g, row_number() over (partition by q.vec_id order by abs(v.vec_id - q.vec_id), v.vec_id) as rk
        from v q join v on q.vec_id % 100 = 0 and v.vec_id <> q.vec_id and abs(v.vec_id - q.vec_id) <= 60) where rk <= 20)"""
WEIGHT = "case " + " ".join(f"when intent = '{i}' and source = '{s}' then {w}" for i, ws in text.INTENT_WEIGHTS.items() for s, w in zip(text.SOURCES, ws, strict=True) if w != 1.0) + " else 1.0 end"
INTENT_OF = "(['" + "', '".join(INTENTS) + "'])[(query_id // 100) % 5 + 1]"
FUSED = "select query_id, doc_id, fused_score, row_number() over (partition by query_id order by fused_score desc, doc_id) as rank, sources from fz qualify rank <= 10"
GRAPH = """fl as (select s_nationkey::bigint as from_node, c_nationkey::bigint as to_node, l_quantity, l_returnflag from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey),
    us as (select from_node * 1000 + to_node as edge_id, l_returnflag = 'R' as useful from fl),
    ed as (select from_node * 1000 + to_node as edge_id, from_node, to_node, (['Uses', 'LearnsFrom', 'TestsWith', 'Knows'])[(from_node + to_node) % 4 + 1] as edge_type, round(avg(l_quantity) / 25.0, 6) as weight from fl group by from_node, to_node),
    st as (select ed.*, count(useful) as total, count(*) filter (useful) as useful from ed left join us using (edge_id) group by all)"""
REACH = "rc as (select lower(trim(belief_id)) as belief_id, file_path, max(reach_score) as reach_score from belief_code_reach where belief_id is not null and reach_score is not null group by 1, 2)"
COMMIT_HITS = f"{BATCH_SQL}, cd as (select distinct on (sha) sha as doc_id, message as body from commits where sha is not null order by sha, message), {_bm25_sql('cd')}"
EXPANDED = f"""{COMMIT_HITS}, fi as (select distinct query_id, s.doc_id as sha, file_path, score, rank from s join commit_files cf on cf.sha = s.doc_id), fw as (select *, row_number() over (partition by query_id, sha order by file_path) as n from fi),
    al as (select query_id, doc_id, score, 0::bigint as derived, rank from s union all select query_id, file_path, round(score * 0.9, 6), 1, rank from fw where n <= 15),
    ex as (select query_id, doc_id, score, derived, row_number() over (partition by query_id order by derived, rank, doc_id) as place from al)"""

def _mlp_sql() -> str:
    p = Projection(64, 32, 16)
    numbers = lambda xs: "[" + ", ".join(repr(float(x)) for x in xs) + "]"
    hidden = ", ".join(f"greatest(list_dot_product(e, {numbers(w)}) + {float(b)!r}, 0.0)" for w, b in zip(p.w1, p.b1, strict=True))
    outputs = " union all ".join(f"select vec_id, {i}::bigint as dim, round(list_dot_product(h, {numbers(w)}) + {float(b)!r}, 6) + 0.0 as value from h" for i, (w, b) in enumerate(zip(p.w2, p.b2, strict=True)))
    return f"with v as (select vec_id, embedding::double[] as e from embeddings), h as (select vec_id, [{hidden}] as h from v) {outputs}"


HASHED = """{0}_w as (select {1} as id, ('0x' || left(md5(term), 8))::bigint as h from (select {1}, unnest({2}) as term from {3})), {0}_v as (select id, h % 64 as b, sum(case when (h >> 16) & 1 = 1 then 1 else -1 end)::double as x from {0}_w group by 1, 2),
    {0}_u as (select {0}_v.id, b, x / n as x from {0}_v join (select id, sqrt(sum(x * x)) as n from {0}_v group by 1 having sum(x * x) > 0) m on m.id = {0}_v.id)"""
WORDS_OF = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
QUESTION_SQL = "batch as (select distinct 'q' || item_id as query_id, text as query from eval_items where text is not null)"
HYBRID = f"""with {BATCH_SQL}, {DOCS}, {_bm25_sql('dc', 'lx', 20)}, bb as (select distinct on (id) id as doc_id, concat_ws(' ', id, statement, facets) as body from beliefs order by id), {_bm25_sql('bb', 'bl', 20)},
    {HASHED.format('qv', 'query_id', WORDS_OF.format('query'), 'batch')}, {HASHED.format('dv', 'doc_id', WORDS_OF.format('body'), 'dc')},
    cs as (select query_id, doc_id, round(coalesce(x, 0), 9) as score from batch cross join (select doc_id from dc) left join (select qv_u.id as q, dv_u.id as d, sum(qv_u.x * dv_u.x) as x from qv_u join dv_u using (b) group by 1, 2) on q = query_id and d = doc_id),
    sm as (select query_id, doc_id, score from cs qualify row_number() over (partition by query_id order by score desc, doc_id) <= 20),
    w as (select query_id, query, unnest(list_distinct(string_split(lower(query), ' '))) as term from batch), co as (select file_a, file_b, sum(coalesce("count", 0))::bigint as n from co_changes group by 1, 2),
    b2 as (select file_a as seed, file_b as file, n, 0 as side from co union all select file_b, file_a, n, 1 from co), m as (select *, row_number() over (partition by query_id, term, side order by n desc, file, seed) as rn from b2 join w on contains(lower(seed), term)),
    tm as (select query_id, file as doc_id, sum(n)::double as score from m where rn <= 30 and not contains(lower(file), lower(query)) group by 1, 2 qualify row_number() over (partition by query_id order by sum(n) desc, file) <= 10),
    al as (select query_id, doc_id::varchar as doc_id, score, 'lexical' as source from lx union all select query_id, doc_id::varchar, score, 'semantic' from sm union all select query_id, doc_id, score, 'belief' from bl union all select query_id, doc_id, score, 'temporal' from tm),
    li as (select al.*, {INTENT} as intent, row_number() over (partition by al.query_id, source order by score desc, doc_id) as rank from al join (select query_id, query, lower(query) as l from batch) using (query_id)),
    fz as (select query_id, doc_id, round(sum(({WEIGHT})::double / (60 + rank)), 9) as fused_score, string_agg(distinct source, ',' order by source) as sources from li where rank <= 20 group by 1, 2)
    {FUSED}"""

SQL = {
    "mlp_project": _mlp_sql(),
    "hybrid_search": HYBRID,
    "hybrid_questions": HYBRID.replace(BATCH_SQL, QUESTION_SQL, 1),
    "knn_cosine": f"with {NEAR} select query_id, vec_id, round(score, 6) as score, rank from nk where rank <= 10",
    "knn_precision_at_k": f"""with {NEAR}, sz as (select label as own, count(*) - 1 as expected from v group by 1) select query_id, round(count(*) filter (rank <= 5 and own = label) / greatest(least(5, max(expected)), 1), 6) as p5,
        round(count(*) filter (rank <= 10 and own = label) / greatest(least(10, max(expected)), 1), 6) as p10 from nk join sz using (own) where rank <= 10 group by 1""",
    "knn_precision_summary": f"""with {NEAR}, sz as (select label as own, count(*) - 1 as expected from v group by 1), pq as (select query_id, own, round(count(*) filter (rank <= 5 and own = label) / greatest(least(5, max(expected)), 1), 6) as p5,
        round(count(*) filter (rank <= 10 and own = label) / greatest(least(10, max(expected)), 1), 6) as p10 from nk join sz using (own) where rank <= 10 group by 1, 2) select count(*) as n, round(avg(p5), 6) as p5, round(avg(p10), 6) as p10, round(avg(expected / ((select count(*) from v) - 1)), 6) as random from pq join sz using (own)""",
    "enriched_families": assay.SIGNALS.split("imc as")[0].rstrip().rstrip(",") + f""", {assay.CALLS}, el as (select seq, event_type, source_id, p from pl where p is not null),
        fd as (select distinct 'forge' as ct, seq::varchar as id, case event_type when 'forge.pr' then 'PR' else 'Issue' end || ' #' || source_id || ': ' || coalesce(json_extract_string(p, '$.title'), '') || case when coalesce(json_extract_string(p, '$.body'), '') <> '' then chr(10) || left(json_extract_string(p, '$.body'), 200) else '' end as content from el where event_type in ('forge.issue', 'forge.pr')
            union all select distinct 'event', seq::varchar, coalesce(json_extract_string(p, '$.content'), json_extract_string(p, '$.message'), '') from el where event_type not like 'forge.%' and event_type not like 'code.%'
            union all select 'belief', id, coalesce(statement, '') || ' (use: ' || coalesce(cited_by_beliefs, 0) || '+' || coalesce(cited_by_sessions, 0) || ', truth: ' || coalesce(evidence_count, 0) || '/' || coalesce(evidence_verified, 0) || ')' from (select distinct on (id) * from beliefs where id is not null order by id)
            union all select 'commit', sha, message from (select distinct on (sha) * from commits where sha is not null order by sha, message) union all select 'pattern', id, concat_ws(' — ', title, purpose) from (select distinct on (id) * from patterns where id is not null order by id)
            union all select 'code', file || '::' || name, file || '::' || name || coalesce(' -> ' || max(return_type), '') from fn group by 2, file, name
            union all select 'temporal', a, 'changes with ' || count(distinct b) || ' files' from (select file_a as a, file_b as b from co_changes union all select file_b, file_a from co_changes) where a is not null group by 2 union all select 'dependency', caller, 'calls ' || count(distinct callee) || ' functions' from cg group by 2)
        select ct as content_type, count(distinct id) as n, sum(length(content))::bigint as n_chars, min(content) as least, max(content) as most from fd group by 1""",
    "vector_stats": "select label::bigint as label, count(*) as n, 1.0::double as mean_norm, 2.0::double as mean_span from embeddings group by 1",
    "rrf_fuse": f"with {LISTS}, fz as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as fused_score, string_agg(distinct source, ',' order by source) as sources from li group by 1, 2) {FUSED}",
    "rrf_weighted": f"with {LISTS}, lw as (select *, {INTENT_OF} as intent from li), fz as (select query_id, doc_id, round(sum(({WEIGHT})::double / (60 + rank)), 9) as fused_score, string_agg(distinct source, ',' order by source) as sources from lw group by 1, 2) {FUSED}",
    "rrf_why": f"""with {LISTS}, fz as (select query_id, doc_id, round(sum(1.0::double / (60 + rank)), 9) as fused_score from li group by 1, 2), r as (select *, row_number() over (partition by query_id order by fused_score desc, doc_id) as rank from fz)
        select r.query_id, r.rank, fused_score, source, li.rank as source_rank, round(score, 6) as raw_score from r join li on li.query_id = r.query_id and li.doc_id = r.doc_id where r.doc_id = 1 and r.rank <= 50""",
    "lexical_commit_expand": f"with {EXPANDED} select * from ex",
    "annotated_hits": assay.SIGNALS.rstrip() + f", {EXPANDED} select query_id, doc_id, place, importer_count, activity_level, is_entry_point from ex left join sg on sg.path = ex.doc_id where derived = 1",
    "belief_merge": f"""with {BATCH_SQL}, bd as (select distinct on (id) id as doc_id, coalesce(statement, '') as body, confidence from beliefs where id is not null order by id), {_bm25_sql('bd', 's', 30)},
        vv as (select q as query_id, doc_id, confidence as v from bd, (values ('q1'), ('q2')) t(q) where confidence > 0.85), tt as (select query_id, doc_id, score / max(score) over (partition by query_id) as t from s),
        bt as (select coalesce(vv.query_id, tt.query_id) as query_id, coalesce(vv.doc_id, tt.doc_id) as doc_id, round(case when t is null then v when v is null then t else 0.7 * v + 0.3 * t end, 6) as score from vv full join tt on vv.query_id = tt.query_id and vv.doc_id = tt.doc_id)
        select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from bt qualify rank <= 20""",
    "belief_impact": f"""with {REACH}, h as (select distinct file_path as doc_id from commit_files) select doc_id, belief_id, reach_score, row_number() over (partition by doc_id order by reach_score desc, belief_id) as rn from h join rc on rc.file_path = h.doc_id qualify rn <= 3""",
    "repo_federation": f"""with {BATCH_SQL}, {DOCS}, {_bm25_sql('dc', 's', 10**9)}, rp as (select distinct on (doc_id) doc_id, coalesce(lower(trim(source)), 'none') as repo from documents order by doc_id),
        r as (select query_id, '[' || repo || '] ' || doc_id as doc_id, row_number() over (partition by query_id, repo order by score desc, doc_id::varchar) as rank from s join rp using (doc_id) qualify rank <= 200), fz as (select query_id, doc_id, round(1.0::double / (60 + rank), 9) as fused_score from r)
        select query_id, doc_id, fused_score, row_number() over (partition by query_id order by fused_score desc, doc_id) as rank from fz qualify rank <= 10""",
    "related_nodes": f"with {GRAPH} select n_nationkey::bigint as id, n_name as name, max(weight) as weight from ed join nation on n_nationkey = to_node where from_node = 3 and edge_type in ('Uses', 'LearnsFrom') group by 1, 2",
    "edge_usage_stats": f"with {GRAPH} select edge_id, edge_type, total, useful from st",
    "learn_weights": f"with {GRAPH} select edge_id, round(case when total >= 5 then greatest(0.5, least(2.0, 0.9 * weight + 0.1 * (1 + useful / total))) else weight end, 4) as weight from st",
    "graph_counts": f"with {GRAPH} select edge_type, count(*) as n_edges, count(distinct from_node) as n_from from ed group by 1",
    "routed_search": f"""with {GRAPH}, w as (select to_node as repo, max(case edge_type when 'TestsWith' then 1.2 when 'LearnsFrom' then 1.1 when 'Uses' then 1.1 else 1.0 end)::double as w from ed where from_node = 3 group by 1)
        select s_nationkey::bigint as repo, s_name as doc_id, round(s_acctbal * coalesce(w, 1.0), 6) as score from supplier left join w on w.repo = s_nationkey order by score desc, repo, doc_id limit 10""",
    "enriched": """with h as (select distinct * from (select 'belief' as content_type, lower(trim(belief_id)) as doc_id from belief_code_reach union all select 'pattern', file_path from belief_code_reach)),
        k as (select 'belief' as content_type, id as doc_id, max(statement) as content from beliefs group by 2 union all select 'pattern', id, max(purpose) from patterns group by 2) select content_type, doc_id, content from h left join k using (content_type, doc_id)""",
}
