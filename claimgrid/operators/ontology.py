"""Ontology as node, edge and closure tables.

Edges point from the specific to the general term. The closure is computed once, semi-naively: each round joins only the
pairs that the last one found, checkpoints them and stops when there are none, so cycles and any depth are fine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import grounding
from ..runtime import checkpoint
from ..schema import NS_ORDER

PAIR = ("ns", "id", "p_ns", "p_id")


def closure(edges: DataFrame, rels: tuple[str, ...] = ("isa", "partof")) -> DataFrame:
    """(ns, id, p_ns, p_id): all pairs of a term and a more general one; a term is not its own."""
    step = edges.where(F.col("rel").isin(*rels)).select(*(F.col(a).alias(b) for a, b in zip(("s_ns", "s_id", "t_ns", "t_id"), PAIR, strict=True))).distinct()
    step = checkpoint(step.where("not (ns = p_ns and id = p_id)"))
    rounds, new = [step], step
    hop = step.select(F.col("ns").alias("p_ns"), F.col("id").alias("p_id"), F.col("p_ns").alias("q_ns"), F.col("p_id").alias("q_id"))
    while not new.isEmpty():
        more = new.join(hop, ["p_ns", "p_id"]).select("ns", "id", F.col("q_ns").alias("p_ns"), F.col("q_id").alias("p_id")).where("not (ns = p_ns and id = p_id)").distinct()
        for r in rounds:
            more = more.join(r, list(PAIR), "left_anti")
        new = checkpoint(more)
        rounds.append(new)
    return reduce(DataFrame.union, rounds)


def isrel(pairs: DataFrame, closed: DataFrame) -> DataFrame:
    """``pairs(ns, id, p_ns, p_id)`` with ``rel``: whether the second term is above the first (or it is the same)."""
    known = closed.withColumn("__r", F.lit(True))
    return pairs.join(known, list(PAIR), "left").withColumn("rel", F.coalesce("__r", F.lit(False))).drop("__r")


def parents(terms: DataFrame, closed: DataFrame) -> DataFrame:
    return terms.join(closed, ["ns", "id"])


def children(terms: DataFrame, closed: DataFrame, ns_filter: list[str] | None = None) -> DataFrame:
    below = closed.select(F.col("p_ns").alias("ns"), F.col("p_id").alias("id"), F.col("ns").alias("c_ns"), F.col("id").alias("c_id"))
    out = terms.join(below, ["ns", "id"])
    return out.where(F.col("c_ns").isin(*ns_filter)) if ns_filter else out


def direct(edges: DataFrame, rels: tuple[str, ...], up: bool = True) -> DataFrame:
    """(ns, id, o_ns, o_id): neighbours by one edge of ``rels``, towards the general (``up``) or the specific term."""
    a, b = ("s", "t") if up else ("t", "s")
    return edges.where(F.col("rel").isin(*rels)).select(F.col(f"{a}_ns").alias("ns"), F.col(f"{a}_id").alias("id"), F.col(f"{b}_ns").alias("o_ns"), F.col(f"{b}_id").alias("o_id"))


def top_level_parents(terms: DataFrame, closed: DataFrame) -> DataFrame:
    above = parents(terms, closed)
    return above.join(closed.select(F.col("ns").alias("p_ns"), F.col("id").alias("p_id")).distinct(), ["p_ns", "p_id"], "left_anti")


def mappings(terms: DataFrame, xref_closed: DataFrame) -> DataFrame:
    return terms.join(xref_closed, ["ns", "id"])


def map_to(terms: DataFrame, xref_closed: DataFrame, ns2: str) -> DataFrame:
    """The one equivalent of each term in ``ns2``; null if there is none or more than one."""
    found = xref_closed.where(F.col("p_ns") == ns2).groupBy("ns", "id").agg(F.min("p_id").alias("mapped"), F.countDistinct("p_id").alias("n")).where("n = 1").drop("n")
    return terms.join(found, ["ns", "id"], "left")


def replacement(terms: DataFrame, edges: DataFrame) -> DataFrame:
    first = edges.where("rel = 'replaced_by'").groupBy(F.col("s_ns").alias("ns"), F.col("s_id").alias("id")).agg(F.min(F.struct("t_ns", "t_id")).alias("r"))
    return terms.join(first, ["ns", "id"], "left").withColumn("r_ns", F.col("r.t_ns")).withColumn("r_id", F.col("r.t_id")).drop("r")


def node_property(terms: DataFrame, nodes: DataFrame, prop: str) -> DataFrame:
    return terms.join(nodes.select("ns", "id", prop), ["ns", "id"], "left")


def id_from_name(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """``names(ns, name)`` to id among terms that are not obsolete; of several, the greatest."""
    known = nodes.where("not coalesce(obsolete, false)").groupBy("ns", "name").agg(F.max("id").alias("id"))
    return names.join(known, ["ns", "name"], "left")


def nodes_from_suffix(nodes: DataFrame, suffix: str) -> DataFrame:
    return nodes.where(F.concat_ws(":", "ns", "id").endswith(suffix))


def label(ns: Column, id_: Column) -> Column:
    return F.concat_ws(":", ns, id_)


def reverse_label(node: Column) -> Column:
    return F.struct(F.substring_index(node, ":", 1).alias("ns"), F.regexp_replace(node, "^[^:]*:", "").alias("id"))


def standardize_db_refs(agents: DataFrame, nodes: DataFrame, edges: DataFrame, xref_closed: DataFrame, order: tuple[str, ...] = NS_ORDER) -> DataFrame:
    """Replaces obsolete references and adds equivalents: of several sources for a namespace the one first in ``order`` wins, then the least id. Names come from the first grounding."""
    key = ["stmt_id", "idx"]
    refs = agents.select(*key, F.explode("db_refs").alias("ns", "id"))
    refs = replacement(refs, edges).select(*key, F.coalesce("r_ns", "ns").alias("ns"), F.coalesce("r_id", "id").alias("id"))
    rank = F.coalesce(F.array_position(F.array(*(F.lit(n) for n in order)), F.col("ns")).cast("int"), F.lit(0))
    rank = F.when(rank == 0, 1000).otherwise(rank)
    own = refs.select(*key, F.col("ns").alias("ns"), "id", F.lit(0).alias("far"), rank.alias("rank"))
    far = refs.withColumn("rank", rank).join(xref_closed, ["ns", "id"]).select(*key, F.col("p_ns").alias("ns"), F.col("p_id").alias("id"), F.lit(1).alias("far"), "rank")
    best = own.union(far).groupBy(*key, "ns").agg(F.min(F.struct("far", "rank", "id")).alias("b"))
    maps = best.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("ns", F.col("b.id")))).alias("__refs"))
    out = agents.join(maps, key, "left").withColumn("db_refs", F.coalesce("__refs", "db_refs")).drop("__refs")
    named = nodes.select(F.concat_ws(":", "ns", "id").alias("__g"), F.col("name").alias("__n"))
    return out.withColumn("__g", grounding(F.col("db_refs"), order)).join(named, "__g", "left").withColumn("name", F.coalesce("__n", "name")).drop("__g", "__n")
