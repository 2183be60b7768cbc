"""Relationship graph of projects: nodes, edges, usage, learned weights, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.eventlog import upsert

# How much more a result of a related project counts, by relation.
RELATION_WEIGHTS = {"TestsWith": 1.2, "LearnsFrom": 1.1, "Uses": 1.1}
# Words of a query that call for routing by domain.
DOMAIN_HINTS = ["cairo", "rust", "typescript", "javascript", "python", "go", "java", "c++", "cpp", "solidity", "prolog", "dojo", "starknet", "mcp", "ecs", "vector", "embedding"]
ALPHA, LEAST_USES, LOW, HIGH = 0.1, 5, 0.5, 2.0


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (from_node, to_node, edge_type); evidence survives where the new row has none."""
    return upsert(edges, new, ["from_node", "to_node", "edge_type"], keep_if_null=("evidence",))


def delete_node(nodes: DataFrame, edges: DataFrame, node: str) -> tuple[DataFrame, DataFrame]:
    return nodes.where(F.col("id") != node), edges.where((F.col("from_node") != node) & (F.col("to_node") != node))


def related(nodes: DataFrame, edges: DataFrame, node: str, types: list[str]) -> DataFrame:
    """Nodes an edge of one of the types leads to from `node`, with the largest weight."""
    near = edges.where((F.col("from_node") == node) & F.col("edge_type").isin(types)).groupBy(F.col("to_node").alias("id")).agg(F.max("weight").alias("weight"))
    return nodes.join(near, "id")


def usage_stats(edges: DataFrame, usage: DataFrame) -> DataFrame:
    """Edges with their number of uses and useful uses."""
    counted = usage.groupBy("edge_id").agg(F.count(F.lit(1)).alias("total"), F.count_if("useful").alias("useful"))
    return edges.join(counted, "edge_id", "left").withColumns({"total": F.coalesce("total", F.lit(0)), "useful": F.coalesce("useful", F.lit(0))})


def learned_weight(weight: Column, useful: Column, total: Column, alpha: float = ALPHA) -> Column:
    """Moving average towards 1 + useful / total, within bounds; unchanged for few uses."""
    moved = (1 - alpha) * weight + alpha * (1 + useful / total)
    return F.when(total >= LEAST_USES, F.greatest(F.lit(LOW), F.least(F.lit(HIGH), moved))).otherwise(weight)


def mark_useful(usage: DataFrame, used: DataFrame) -> DataFrame:
    """Usage rows of a query whose document was used become useful; used: (query_id, doc_id)."""
    hit = used.select("query_id", "doc_id").distinct().withColumn("_hit", F.lit(True))
    return usage.join(hit, ["query_id", "doc_id"], "left").withColumn("useful", F.col("useful") | F.coalesce("_hit", F.lit(False))).drop("_hit")


def route(nodes: DataFrame, query: str) -> DataFrame:
    """Nodes whose id or a domain occurs in a query that names a domain; all nodes if none or all do."""
    low = F.lit(query.lower())
    if not any(h in query.lower() for h in DOMAIN_HINTS):
        return nodes
    hit = F.contains(low, F.lower("id")) | F.exists("domains", lambda x: F.contains(low, F.lower(x)))
    n_all, n_hit = nodes.agg(F.count(F.lit(1)), F.count_if(hit)).first()
    return nodes if n_hit in (0, n_all) else nodes.where(hit)


def relation_weight(edge_type: Column) -> Column:
    out = F.lit(1.0)
    for name, w in RELATION_WEIGHTS.items():
        out = F.when(edge_type == name, F.lit(w)).otherwise(out)
    return out


def routed_search(hits: DataFrame, edges: DataFrame, home: str, limit: int = 10) -> DataFrame:
    """Hits (repo, doc_id, score) of several repositories, weighted by their relation to `home`."""
    w = edges.where(F.col("from_node") == home).groupBy(F.col("to_node").alias("repo")).agg(F.max(relation_weight(F.col("edge_type"))).alias("w"))
    scored = hits.join(w, "repo", "left").withColumn("score", F.round(F.col("score") * F.coalesce("w", F.lit(1.0)), 6)).drop("w")
    return scored.orderBy(F.desc("score"), "repo", "doc_id").limit(limit)


def detect_domains(files: DataFrame) -> DataFrame:
    """(repo, domains) from the manifests among files(repo, path)."""
    name = F.element_at(F.split("path", "/"), -1)
    domain = F.when(name == "Cargo.toml", "rust").when(name == "package.json", "javascript").when(name == "Scarb.toml", "cairo").when(name.isin("pyproject.toml", "setup.py"), "python").when(name == "go.mod", "go")
    return files.select("repo", domain.alias("d")).where("d is not null").groupBy("repo").agg(F.array_sort(F.collect_set("d")).alias("domains"))
