"""Entity and dependency graphs of many documents at once."""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage, dealt
from .classify import once

@dataclass(frozen=True)
class Caps:
    """Most nodes, edges and mentions kept per document, and label lengths; None keeps all."""

    nodes: int | None = None
    edges: int | None = None
    dates: int | None = None
    amounts: int | None = None
    obligations: int | None = None
    jurisdictions: int | None = None
    penalties: int | None = None
    label: int | None = None
    action: int | None = None


#: The sizes of the small graph that a page shows.
DISPLAY = Caps(25, 40, 5, 5, 15, 3, 5, 60, 40)


def _first(items: Column | str, n: int | None) -> Column:
    return F.slice(items, 1, n) if n is not None else F.col(items) if isinstance(items, str) else items


def _short(text: Column, n: int | None) -> Column:
    return F.substring(text, 1, n) if n is not None else text


def entity_nodes(docs: DataFrame, text: str, caps: Caps = Caps()) -> DataFrame:
    """nodes of each document text, an array of (node_type, label, key), with its obligations and parties.

    Order: parties, dates, amounts, penalties, jurisdictions, then obligation
    parties and targets; a repeated key keeps its first place.
    """
    t = F.col(text)
    df = once(docs.select("doc_id", t.alias(text)), F.struct(
        X.parties(t).alias("_p"), X.dates(t).alias("_d"), X.money(t).alias("_m"), X.penalties(t).alias("_f"),
        F.array_sort(X.jurisdictions(t)).alias("_j"), _first(X.obligations(t), caps.obligations).alias("_o")))

    def node(kind, label, key):
        return F.struct(F.lit(kind).alias("node_type"), _short(label, caps.label).alias("label"),
                        F.concat(F.lit(f"{kind}:"), key).alias("key"))
    listed = F.concat(
        F.transform("_p", lambda p: node("party", p["short_name"], F.lower(p["short_name"]))),
        F.transform(_first("_d", caps.dates), lambda d: node("date", d, d)),
        F.transform(_first("_m", caps.amounts), lambda m: node("money", m, m)),
        F.transform("_f", lambda p: node("penalty", p, F.lower(p))),
        F.transform("_j", lambda j: node("jurisdiction", j, F.lower(j))),
        F.flatten(F.transform("_o", lambda o: F.array(
            node("party", o["subject"], F.lower(o["subject"])),
            node("obligation", _short(o["action"], caps.action), F.lower(_short(o["action"], caps.action)))))))
    df = once(df, F.struct(listed.alias("_n")))
    df = once(df, F.struct(F.transform("_n", lambda n: n["key"]).alias("_keys")))
    first = F.filter("_n", lambda n, i: F.array_position("_keys", n["key"]) == i + 1)
    return once(df, F.struct(_first(first, caps.nodes).alias("nodes"))).select("doc_id", "nodes", "_o", "_p")


def entity_graph(docs: DataFrame, text: str, caps: Caps = Caps(), keep: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): obligation edges and edges from the first party.

    Both ends of an edge are places in the document's own list of nodes, so edges are made in the row of their document.
    keep: both are used, so the lists are made once and kept.
    """
    df = once(entity_nodes(docs, text, caps), F.struct(F.transform("nodes", lambda n: n["key"]).alias("_at")))

    def edge(source, target, relation):
        return F.struct(source.alias("source"), target.alias("target"), relation.alias("relation"))
    duties = F.filter(F.transform("_o", lambda o: edge(
        F.array_position("_at", F.concat(F.lit("party:"), F.lower(o["subject"]))),
        F.array_position("_at", F.concat(F.lit("obligation:"), F.lower(_short(o["action"], caps.action)))), o["modal"])),
        lambda e: (e["source"] > 0) & (e["target"] > 0))

    def extra(kind, relation, cap):
        own = F.transform("nodes", lambda n, i: F.when(n["node_type"] == kind, edge(F.lit(1).cast("long"), (i + 1).cast("long"), F.lit(relation))))
        return _first(F.array_compact(own), cap)
    listed = F.concat(duties, *[F.when(F.size("_p") > 0, extra(*x)).otherwise(F.filter(extra(*x), lambda e: F.lit(False))) for x in (
        ("jurisdiction", "governed by", caps.jurisdictions), ("date", "dated", caps.dates), ("money", "involves payment", caps.amounts),
        ("penalty", "subject to", caps.penalties))])
    df = df.select("doc_id", "nodes", _first(listed, caps.edges).alias("edges"))
    if keep:
        df = cut_lineage(df)

    def node(place):
        return F.concat(F.lit("n"), place.cast("string"))
    nodes = df.select("doc_id", F.posexplode("nodes").alias("node_no", "_x")).select(
        "doc_id", node(F.col("node_no")).alias("node_id"), "_x.node_type", "_x.label")
    edges = df.select("doc_id", F.explode("edges").alias("_e")).select(
        "doc_id", node(F.col("_e.source") - 1).alias("source_id"), node(F.col("_e.target") - 1).alias("target_id"), "_e.relation")
    return nodes, edges


def unified(clauses: DataFrame, nodes: DataFrame, edges: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clause nodes plus entity nodes; only edges between existing nodes survive."""
    own = clauses.select("doc_id", F.col("clause_id").cast("string").alias("node_id"), F.lit("clause").alias("node_type"),
                         F.col("section_name").alias("label"))
    every = own.unionByName(nodes.select("doc_id", "node_id", "node_type", "label"))
    dep = dependencies.select("doc_id", F.col("source_id").cast("string").alias("source_id"),
                              F.col("target_id").cast("string").alias("target_id"), "relation")
    ids = every.select("doc_id", "node_id")
    kept = edges.unionByName(dep).join(dealt(ids.withColumnRenamed("node_id", "source_id")), ["doc_id", "source_id"], "left_semi").join(
        dealt(ids.withColumnRenamed("node_id", "target_id")), ["doc_id", "target_id"], "left_semi")
    return every, kept.select("doc_id", "source_id", "target_id", "relation")


def relationship_rows(edges: DataFrame, dependencies: DataFrame) -> DataFrame:
    def rows(df, kind):
        return df.select("doc_id", F.lit(kind).alias("source_type"), F.col("source_id").cast("string").alias("source_id"),
                         F.lit(kind).alias("target_type"), F.col("target_id").cast("string").alias("target_id"), "relation")
    return rows(edges, "entity").unionByName(rows(dependencies, "clause"))


def dependents(edges: DataFrame) -> DataFrame:
    """(doc_id, node, dependent): sources with an edge to the node."""
    return edges.select("doc_id", F.col("target_id").alias("node"), F.col("source_id").alias("dependent")).distinct()


def reachable(edges: DataFrame, hops: int = 3) -> DataFrame:
    """(doc_id, start, node, hop): first hop at which a node is reached, start excluded, for every start node.

    Each round extends the frontier by one join and removes what was seen before.
    """
    step = edges.select("doc_id", F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    seen = step.filter("node <> next").select("doc_id", F.col("node").alias("start"), F.col("next").alias("node"), F.lit(1).alias("hop"))
    frontier = seen
    for hop in range(2, hops + 1):
        grown = frontier.join(step, ["doc_id", "node"]).select("doc_id", "start", F.col("next").alias("node")).filter(
            "start <> node").distinct()
        frontier = cut_lineage(grown.join(seen, ["doc_id", "start", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Shortest directed path per (doc_id, source, target), smallest node list on ties; breadth-first over all pairs.

    Without max_hops the search ends when no new node is met.
    """
    step = edges.select("doc_id", F.col("source_id").alias("node"), F.col("target_id").alias("next")).distinct()
    front = pairs.select("doc_id", "source", "target", F.col("source").alias("node"), F.array("source").alias("path"))
    found = front.filter("source = target").select("doc_id", "source", "target", "path")
    front = front.filter("source <> target")
    visited = front.select("doc_id", "source", "target", "node")
    for _ in range(max_hops) if max_hops is not None else itertools.count():
        grown = front.join(step, ["doc_id", "node"]).select("doc_id", "source", "target", F.col("next").alias("node"),
                                                            F.array_append("path", F.col("next")).alias("path"))
        best = grown.groupBy("doc_id", "source", "target", "node").agg(F.min("path").alias("path"))
        best = cut_lineage(best.join(visited, ["doc_id", "source", "target", "node"], "left_anti"))
        found = found.unionByName(best.filter("node = target").select("doc_id", "source", "target", "path"))
        front = best.join(best.filter("node = target").select("doc_id", "source", "target"), ["doc_id", "source", "target"], "left_anti")
        visited = visited.unionByName(best.select("doc_id", "source", "target", "node"))
        if front.isEmpty():
            break
    return found


def ego_edges(edges: DataFrame, centres: DataFrame, radius: int = 1) -> DataFrame:
    """Edges among the nodes within ``radius`` undirected steps of each (doc_id, centre)."""
    both = edges.select("doc_id", F.col("source_id").alias("node"), F.col("target_id").alias("next")).unionByName(
        edges.select("doc_id", F.col("target_id").alias("node"), F.col("source_id").alias("next"))).distinct()
    ball = centres.select("doc_id", "centre", F.col("centre").alias("node"))
    for _ in range(radius):
        ball = ball.unionByName(ball.join(both, ["doc_id", "node"]).select("doc_id", "centre", F.col("next").alias("node"))).distinct()
    inside = edges.join(ball.withColumnRenamed("node", "source_id"), ["doc_id", "source_id"])
    return inside.join(ball.withColumnRenamed("node", "target_id"), ["doc_id", "centre", "target_id"], "left_semi")
