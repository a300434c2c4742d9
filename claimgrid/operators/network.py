"""Edge tables, directed and signed networks, and simple interchange networks."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import grounding, statement_keys
from ..runtime import checkpoint
from ..schema import SIGNS, SYMMETRIC, Corpus, descendants
from .belief import RAND, SYST


def sign_of(stmt_type: Column, signs: dict[str, int] = SIGNS) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in signs.items() for x in p)), stmt_type)


def edges(c: Corpus, exclude: tuple[str, ...] = (), complex_members: int = 3, keep_self_loops: bool = True) -> DataFrame:
    """Directed edges (agA_*, agB_*, stmt_type, evidence_count, stmt_hash, residue, position, source_counts, belief, initial_sign).

    Two arguments give an edge from the first to the second; a complex of up to ``complex_members`` members one for each ordered pair; assertions with fewer than
    two arguments give none. The pairs come from one array for each assertion, not from a self-join.
    """
    ref = lambda refs: F.split(grounding(refs), ":", 2)
    counts = c.evidence.groupBy("stmt_id", "source_api").agg(F.count("*").alias("n")).groupBy("stmt_id").agg(F.sum("n").alias("evidence_count"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("source_api", "n")))).alias("source_counts"))
    st = c.statements if "mk_hash" in c.statements.columns else c.statements.join(statement_keys(c).select("stmt_id", "mk_hash"), "stmt_id")
    drop = [t for e in exclude for t in descendants(e)]
    st = st.where(~F.col("stmt_type").isin(*drop)) if drop else st
    if "args" in st.columns:
        own = F.filter("args", lambda a: a["name"].isNotNull())
        with_args = st.withColumn("args", F.array_sort(F.transform(own, lambda a: F.struct(a["idx"].alias("idx"), a["name"].alias("name"), ref(a["db_refs"])[0].alias("ns"), ref(a["db_refs"])[1].alias("id")))))
    else:
        agent = F.struct("idx", "name", ref(F.col("db_refs"))[0].alias("ns"), ref(F.col("db_refs"))[1].alias("id"))
        with_args = st.join(c.agents.where("name is not null").groupBy("stmt_id").agg(F.array_sort(F.collect_list(agent)).alias("args")), "stmt_id")
    both = with_args.where(F.size("args") >= 2).join(counts, "stmt_id", "left")
    sym = F.col("stmt_type").isin(*SYMMETRIC)
    pair = lambda i, j: F.struct(i.alias("a"), j.alias("b"))
    every = F.flatten(F.transform("args", lambda x: F.transform(F.filter("args", lambda y: y["idx"] != x["idx"]), lambda y: pair(x, y))))
    pairs = F.when(sym & (F.size("args") <= complex_members), every).when(~sym, F.array(pair(F.col("args")[0], F.col("args")[1])))
    out = both.withColumn("e", F.explode(pairs)).select(
        F.col("e.a.name").alias("agA_name"), F.col("e.a.ns").alias("agA_ns"), F.col("e.a.id").alias("agA_id"), F.col("e.b.name").alias("agB_name"), F.col("e.b.ns").alias("agB_ns"), F.col("e.b.id").alias("agB_id"),
        "stmt_type", F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"), F.col("mk_hash").alias("stmt_hash"), "residue", "position", "source_counts", "belief", sign_of(F.col("stmt_type")).alias("initial_sign"),
    )
    return out if keep_self_loops else out.where("agA_name <> agB_name")


def _flat_belief(method: str) -> Column:
    if method == "complementary":
        return 1 - F.product(1 - F.coalesce("belief", F.lit(0.0)))
    if method == "max":
        return F.max("belief")
    raise ValueError(method)


def to_digraph(e: DataFrame, method: str = "complementary") -> DataFrame:
    """One edge for each ordered pair: the assertions' hashes and the flattened belief."""
    return e.groupBy("agA_name", "agB_name").agg(F.array_sort(F.collect_set("stmt_hash")).alias("hashes"), F.sum("evidence_count").alias("evidence_count"), _flat_belief(method).alias("belief"))


def to_signed_graph(e: DataFrame, signs: dict[str, int] = SIGNS, method: str = "complementary") -> DataFrame:
    """One edge for each ordered pair and sign (0 positive, 1 negative); edges without a sign are left out."""
    signed = e.withColumn("sign", F.coalesce("initial_sign", sign_of(F.col("stmt_type"), signs))).where("sign is not null")
    return signed.groupBy("agA_name", "agB_name", "sign").agg(F.array_sort(F.collect_set("stmt_hash")).alias("hashes"), _flat_belief(method).alias("belief"))


def simple_scorer_belief(e: DataFrame) -> DataFrame:
    """Belief of each pair from the summed numbers of evidences of its sources."""
    rates = F.create_map(*(F.lit(x) for k in RAND for x in (k, float(RAND[k])))), F.create_map(*(F.lit(x) for k in SYST for x in (k, float(SYST[k]))))
    n = e.select("agA_name", "agB_name", F.explode("source_counts").alias("source", "n")).groupBy("agA_name", "agB_name", "source").agg(F.sum("n").alias("n"))
    err = F.coalesce(F.try_element_at(rates[1], "source"), F.lit(0.05)) + F.pow(F.coalesce(F.try_element_at(rates[0], "source"), F.lit(0.3)), "n")
    return n.groupBy("agA_name", "agB_name").agg((1 - F.product(err)).alias("belief"))


def node_table(e: DataFrame) -> DataFrame:
    """(name, ns, id): of several groundings of a name the least."""
    both = e.select(F.col("agA_name").alias("name"), F.col("agA_ns").alias("ns"), F.col("agA_id").alias("id")).union(e.select("agB_name", "agB_ns", "agB_id"))
    return both.groupBy("name").agg(F.min(F.struct("ns", "id")).alias("g")).select("name", "g.ns", "g.id")


def signed_nodes(signed: DataFrame) -> DataFrame:
    """Edges (u, us, v, vs) over doubled nodes: a positive edge keeps the sign of a path, a negative one turns it."""
    ends = F.explode(F.array(*(F.struct(F.lit(s).alias("us"), F.when(F.col("sign") == 0, F.lit(s)).otherwise(F.lit(1 - s)).alias("vs")) for s in (0, 1))))
    return signed.where("sign is not null").withColumn("s", ends).select(F.col("agA_name").alias("u"), "s.us", F.col("agB_name").alias("v"), "s.vs", *(c for c in ("belief",) if c in signed.columns))


def prune_signed_nodes(e: DataFrame) -> DataFrame:
    """Again and again without the edges of negative nodes that nothing leads to."""
    e = checkpoint(e)
    n = e.count()
    while True:
        reached = e.select(F.col("v").alias("u"), F.col("vs").alias("us")).distinct()
        e = checkpoint(e.where("us = 0").union(e.where("us = 1").join(reached, ["u", "us"], "left_semi").select(*e.columns)))
        now = e.count()
        if now == n:
            return e
        n = now


def signed_to_edge_sign(us: Column, vs: Column) -> Column:
    return us.bitwiseXOR(vs)


def neighbours(e: DataFrame, reverse: bool = False, most: int | None = None) -> DataFrame:
    """(node, other, belief, rank): neighbours by belief, the highest first, then by name."""
    a, b = ("agB_name", "agA_name") if reverse else ("agA_name", "agB_name")
    out = e.select(F.col(a).alias("node"), F.col(b).alias("other"), F.coalesce("belief", F.lit(0.0)).alias("belief"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("belief"), "other")))
    return out if most is None else out.where(F.col("rank") <= most)


def sif(e: DataFrame, unsigned: bool = False) -> DataFrame:
    """``source sign target`` lines with sign 1, -1 or (unsigned) 0; one line for each pair, of the assertion with the greatest hash."""
    one = e.groupBy("agA_name", "agB_name").agg(F.max_by("initial_sign", "stmt_hash").alias("s"))
    rel = F.when(F.col("s") == 0, 1).when(F.col("s") == 1, -1).otherwise(0)
    out = one.withColumn("rel", rel)
    return (out if unsigned else out.where("rel <> 0")).select(F.concat_ws(" ", "agA_name", F.col("rel").cast("string"), "agB_name").alias("line"))


def boolean_net(e: DataFrame) -> DataFrame:
    """(node, rule): any positive parent, and no negative one."""
    signed = e.where("initial_sign is not null").select("agA_name", "agB_name", "initial_sign").distinct()
    by = signed.groupBy("agB_name").agg(*(F.array_join(F.array_sort(F.collect_set(F.when(F.col("initial_sign") == s, F.col("agA_name")))), " or ").alias(n) for s, n in ((0, "plus"), (1, "minus"))))
    rule = F.when(F.col("minus") == "", F.concat(F.lit("("), "plus", F.lit(")"))).when(F.col("plus") == "", F.concat(F.lit("not ("), "minus", F.lit(")"))).otherwise(F.concat(F.lit("("), "plus", F.lit(") and not ("), "minus", F.lit(")")))
    return by.select(F.col("agB_name").alias("node"), rule.alias("rule"))


def classify_hub(e: DataFrame, hub: str) -> DataFrame:
    """(node, direction, n): most frequent direction of each neighbour of ``hub``: 1 upstream, -1 downstream, 0 complex; ties to the greater."""
    rel = e.where((F.col("agA_name") == hub) | (F.col("agB_name") == hub))
    node = F.when(F.col("agA_name") == hub, F.col("agB_name")).otherwise(F.col("agA_name"))
    way = F.when(F.col("stmt_type").isin(*SYMMETRIC), 0).when(F.col("agA_name") == hub, -1).otherwise(1)
    n = rel.select(node.alias("node"), way.alias("direction")).groupBy("node", "direction").agg(F.count("*").alias("n"))
    return n.groupBy("node").agg(F.max_by("direction", F.struct("n", "direction")).alias("direction"), F.max("n").alias("n"))


