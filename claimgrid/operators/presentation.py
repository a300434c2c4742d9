"""Grouping and ranking for display: agent pair, relation, assertion; counts of sources; sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import SYMMETRIC, Corpus
from .network import edges

# The verb of each type.
VERBS = {"Activation": "activates", "Inhibition": "inhibits", "IncreaseAmount": "increases the amount of", "DecreaseAmount": "decreases the amount of", "Phosphorylation": "phosphorylates", "Dephosphorylation": "dephosphorylates", "Complex": "binds", "Gef": "is a GEF for", "Gap": "is a GAP for", "GtpActivation": "activates"}


def relation_key(names: Column, stmt_type: Column) -> Column:
    """Type and argument names; names of symmetric types in order."""
    return F.concat_ws("|", stmt_type, F.array_join(F.when(stmt_type.isin(*SYMMETRIC), F.array_sort(names)).otherwise(names), "|"))


def group_and_sort(c: Corpus, level: str = "relation", sort_by: str = "ev_count", limit: int | None = None) -> DataFrame:
    """Groups by ``agent-pair`` or ``relation`` with summed evidence counts, the greatest belief and the number of assertions, ranked.

    An assertion counts once in a group however many edges it gives it.
    """
    e = edges(c, complex_members=5)
    keys = ["agA_name", "agB_name"] + (["stmt_type"] if level == "relation" else [])
    one = e.groupBy(*keys, "stmt_hash").agg(F.max("evidence_count").alias("ev"), F.max("belief").alias("b"))
    g = one.groupBy(*keys).agg(F.sum("ev").alias("ev_count"), F.max(F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(0.0))).alias("belief"), F.count("*").alias("n_stmts"))
    order = [F.desc(sort_by), *keys]
    if limit is not None:
        return g.orderBy(*order).limit(limit)
    return g


def source_counts(c: Corpus) -> DataFrame:
    return c.evidence.groupBy("stmt_id", "source_api").agg(F.count("*").alias("n"))


def english(names: Column, stmt_type: Column, residue: Column | None = None, position: Column | None = None) -> Column:
    verb = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in VERBS.items() for x in p)), stmt_type), F.lit("affects"))
    base = F.concat_ws(" ", names[0], verb, names[1])
    if residue is not None:
        base = F.when(residue.isNotNull(), F.concat(base, F.lit(" on "), residue, F.coalesce(position, F.lit("")))).otherwise(base)
    return F.concat(base, F.lit("."))


def first_evidence(c: Corpus, limit: int) -> DataFrame:
    """At most ``limit`` evidences of each assertion, in order."""
    w = Window.partitionBy("stmt_id").orderBy("ord", "source_api", "source_id")
    return c.evidence.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def agent_texts_with_grounding(c: Corpus) -> DataFrame:
    """(text, groundings, n): how often a text has which grounding, the most frequent first."""
    rows = c.agents.select(F.try_element_at("db_refs", F.lit("TEXT")).alias("text"), F.array_sort(F.map_entries(F.map_filter("db_refs", lambda k, v: ~k.isin("TEXT", "TEXT_NORM")))).alias("refs")).where("text is not null")
    flat = rows.select("text", F.explode_outer("refs").alias("r")).groupBy("text", F.col("r.key").alias("ns"), F.col("r.value").alias("id")).agg(F.count("*").alias("n"))
    total = rows.groupBy("text").agg(F.count("*").alias("total"))
    listed = flat.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("n", "ns", "id")), False).alias("groundings"))
    return listed.join(total, "text")


def ungrounded_texts(c: Corpus) -> DataFrame:
    only = F.forall(F.map_keys("db_refs"), lambda k: k == "TEXT")
    return c.agents.where(only).groupBy(F.try_element_at("db_refs", F.lit("TEXT")).alias("text")).agg(F.count("*").alias("n")).where("text is not null")
