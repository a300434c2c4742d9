"""Pruning of influence maps: rules as nodes, edges(u, v, sign) say which rule helps or hinders which."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def prune_mutual(e: DataFrame, parameters: DataFrame | None = None) -> DataFrame:
    """Without self-loops, without nodes of ``parameters(node)``, and without both edges of a mutual pair whose other children are the same.

    Children are compared by their number and two sums of hashes less the partner's, so no node's children are gathered in one row; only
    mutual edges are candidates, so no pair of unrelated nodes is formed.
    """
    e = e.where("u <> v")
    if parameters is not None:
        for end in ("u", "v"):
            e = e.join(parameters.select(F.col("node").alias(end)), end, "left_anti")
    h = lambda c, seed: F.xxhash64(F.lit(seed), F.col(c)).cast("decimal(38,0)")
    pairs = e.select("u", "v").distinct()
    kids = pairs.groupBy("u").agg(F.count("*").alias("n"), F.sum(h("v", 1)).alias("h1"), F.sum(h("v", 2)).alias("h2"))
    mutual = pairs.join(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"])
    of = lambda x: kids.select(F.col("u").alias(x), *(F.col(k).alias(f"{x}_{k}") for k in ("n", "h1", "h2")))
    both = mutual.join(of("u"), "u").join(of("v"), "v")
    same = (F.col("u_n") == F.col("v_n")) & (F.col("u_h1") - h("v", 1) == F.col("v_h1") - h("u", 1)) & (F.col("u_h2") - h("v", 2) == F.col("v_h2") - h("u", 2))
    return e.join(both.where(same).select("u", "v"), ["u", "v"], "left_anti")


def prune_subject_object(e: DataFrame, rules: DataFrame) -> DataFrame:
    """Without edges from a rule whose object is not the next rule's subject; ``rules(rule, subject, object)``, and edges of rules that lack either stay."""
    o = rules.select(F.col("rule").alias("u"), F.col("object").alias("__o"))
    s = rules.select(F.col("rule").alias("v"), F.col("subject").alias("__s"))
    return e.join(o, "u", "left").join(s, "v", "left").where("__o is null or __s is null or __o = __s").select(*e.columns)


def prune_degraded(e: DataFrame, rules: DataFrame) -> DataFrame:
    """Without positive edges (sign 1) from a rule that lowers a thing's amount to a rule that binds it; ``rules(rule, kind, subject, object)``."""
    low = rules.where("kind = 'DecreaseAmount'").select(F.col("rule").alias("u"), F.col("object").alias("__x"))
    bind = rules.where("kind = 'Complex'").select(F.col("rule").alias("v"), F.explode(F.array_distinct(F.array("subject", "object"))).alias("__x"))
    gone = e.where("sign = 1").join(low, "u").join(bind, ["v", "__x"]).select("u", "v").distinct().withColumn("sign", F.lit(1))
    return e.join(gone, ["u", "v", "sign"], "left_anti").select(*e.columns)
