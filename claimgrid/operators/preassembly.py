"""Duplicates, refinements and contradictions.

Duplicates are one hash aggregation. Refinement candidates come from an equi-join on (type, roles, keys) of two arguments, where a more specific
argument reaches its own key, those of its ancestors, and the key of an absent argument; the few pairs that this proposes are then
checked in the row for all arguments, site and state. No pair of assertions is formed that does not share such keys.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entity_key, evidence_key, statement_keys
from ..runtime import checkpoint
from ..schema import OPPOSITES, SYMMETRIC, Corpus, exploded

ABSENT = "~"


def combine_duplicates(c: Corpus) -> Corpus:
    """One assertion for each key, its stmt_id the least of the group; evidence is united and equal evidence kept once. Evidence bears the key's mk_hash.

    Rows that repeat a stmt_id count once. With arguments on the row the heads' ids are one narrow aggregation by key, combined before the shuffle, as is
    the removal of equal evidence; only distinct evidence meets its head by key, so a very common assertion is no hot key. A corpus that was combined before
    has its mk_hash told anew.
    """
    if "mk_hash" in {*c.statements.columns, *c.evidence.columns}:
        c = replace(c, statements=c.statements.drop("mk_hash"), evidence=c.evidence.drop("mk_hash"))
    if "args" in c.statements.columns:
        whole = statement_keys(c).drop("mk")
        to = whole.groupBy("mk_hash").agg(F.min("stmt_id").alias("stmt_id"))
        # only hashes are dealt out by key; the heads' rows meet them by stmt_id, so columns that nobody asks for stay behind
        heads = c.statements.drop("ev").join(to, "stmt_id").dropDuplicates(["stmt_id"])
        own = whole.select("mk_hash", F.explode("ev").alias("__x")).select("mk_hash", "__x.*") if "ev" in whole.columns else c.evidence.join(whole.select("stmt_id", "mk_hash"), "stmt_id").drop("stmt_id")
        distinct = own.withColumn("__ek", evidence_key()).dropDuplicates(["mk_hash", "__ek"]).drop("__ek")
        evidence = distinct.join(to, "mk_hash")
        return replace(c, statements=heads, agents=exploded(heads, "args"), evidence=evidence.select("stmt_id", *(x for x in own.columns if x != "mk_hash"), "mk_hash"))
    keyed = statement_keys(c).select("stmt_id", "mk_hash")
    to = keyed.groupBy("mk_hash").agg(F.min("stmt_id").alias("__to"))
    ids = keyed.join(to, "mk_hash").select("stmt_id", "__to", "mk_hash")
    heads = to.select(F.col("__to").alias("stmt_id"), "mk_hash")
    statements = c.statements.join(heads, "stmt_id").dropDuplicates(["stmt_id"])
    agents = c.agents.join(heads.select("stmt_id"), "stmt_id", "left_semi").dropDuplicates(["stmt_id", "idx"])
    evidence = c.evidence.join(ids, "stmt_id").withColumn("stmt_id", F.col("__to")).withColumn("__ek", evidence_key()).dropDuplicates(["stmt_id", "__ek"]).drop("__to", "__ek")
    return replace(c, statements=statements.drop("ev"), agents=agents, evidence=evidence)


def entity_groups(c: Corpus) -> DataFrame:
    """(stmt_id, stmt_type, agents): the keys of the arguments in order, absent ones as ``~``."""
    if "args" in c.statements.columns:
        own = F.array_sort(F.transform("args", lambda a: F.struct(a["idx"].alias("idx"), F.coalesce(entity_key(a["name"], a["db_refs"]), F.lit(ABSENT)).alias("k"))))
        return c.statements.withColumn("keys", F.transform(own, lambda a: a["k"]))
    keys = c.agents.select("stmt_id", "idx", F.coalesce(entity_key(F.col("name"), F.col("db_refs")), F.lit(ABSENT)).alias("k"))
    args = keys.groupBy("stmt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "k"))), lambda a: a["k"]).alias("keys"))
    return c.statements.join(args, "stmt_id")


def reach(closed: DataFrame) -> DataFrame:
    """(k, up): a key and what it refines."""
    return closed.select(F.concat_ws(":", "ns", "id").alias("k"), F.concat_ws(":", "p_ns", "p_id").alias("up"))


def _site_refines() -> Column:
    one = lambda a: F.col(f"g_{a}").isNull() | (F.col(f"g_{a}") == F.col(a))
    return one("residue") & one("position") & one("from_location") & one("to_location") & F.col("g_is_active").eqNullSafe(F.col("is_active")) & (F.col("g_activity").isNull() | F.col("g_activity").eqNullSafe(F.col("activity")) | (F.col("g_activity") == "activity"))


def state_refines(s: Column, g: Column) -> Column:
    """Every state of the general argument ``g`` is one of the specific one's, ``s`` (structs of an agent's columns)."""
    covered = lambda col, test: F.coalesce(F.forall(g[col], lambda y: F.coalesce(F.exists(s[col], lambda x: test(x, y)), F.lit(False))), F.lit(True))
    wide = lambda x, y: y.isNull() | y.eqNullSafe(x)
    mods = covered("mods", lambda x, y: (x["mod_type"].eqNullSafe(y["mod_type"]) | (y["mod_type"] == "modification")) & x["is_modified"].eqNullSafe(y["is_modified"]) & wide(x["residue"], y["residue"]) & wide(x["position"], y["position"]))
    muts = covered("mutations", lambda x, y: wide(x["residue_from"], y["residue_from"]) & wide(x["position"], y["position"]) & wide(x["residue_to"], y["residue_to"]))
    bound = covered("bound", lambda x, y: x["is_bound"].eqNullSafe(y["is_bound"]) & entity_key(x["name"], x["db_refs"]).eqNullSafe(entity_key(y["name"], y["db_refs"])))
    own, other = s["activity"], g["activity"]
    act = other["activity_type"].isNull() & other["is_active"].isNull() | (other["is_active"].eqNullSafe(own["is_active"]) & (other["activity_type"].eqNullSafe(own["activity_type"]) | (other["activity_type"] == "activity")))
    return mods & muts & bound & act & wide(s["location"], g["location"])


def matches_all(s: Column, g: Column, fits) -> Column:
    """Whether the members of ``s`` can be dealt to those of ``g``, as many, one each, so that ``fits(s, g)`` holds.

    The sets of members of ``s`` that some dealing of the first members of ``g`` takes are folded as bit masks; sets that members leave equal are held once.
    """
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j.cast("int"))
    numbered = F.transform(s, lambda x, j: F.struct(x.alias("x"), bit(j).alias("bit")))
    free = lambda mask, y: F.filter(numbered, lambda m: (mask.bitwiseAND(m["bit"]) == 0) & fits(m["x"], y))
    step = lambda masks, y: F.array_distinct(F.flatten(F.transform(masks, lambda mask: F.transform(free(mask, y), lambda m: mask.bitwiseOR(m["bit"])))))
    return (F.size(s) == F.size(g)) & (F.size(F.aggregate(g, F.array(F.lit(0).cast("long")), step)) > 0)


#: Rows of a look-up table that may go to all executors.
FEW = 1 << 20


def _few(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed frame, as a broadcast if its rows, counted, are at most ``FEW``."""
    return F.broadcast(df) if df.count() <= FEW else df


def _grouped(c: Corpus, site: list[str]) -> DataFrame:
    """(stmt_id, stmt_type, sym, members, site columns): arguments in order of idx, one for each; from the row where it carries them."""
    parts = ("mods", "mutations", "bound", "activity", "location")
    own = ["stmt_id", "stmt_type", F.col("stmt_type").isin(*SYMMETRIC).alias("sym"), *site]
    if "args" in c.statements.columns:
        one = lambda i: F.filter("args", lambda a: a["idx"] == i)[0]
        slim = lambda a: F.struct(a["idx"].alias("idx"), F.coalesce(entity_key(a["name"], a["db_refs"]), F.lit(ABSENT)).alias("k"), *(a[p].alias(p) for p in parts))
        members = F.transform(F.array_sort(F.array_distinct(F.transform("args", lambda a: a["idx"]))), lambda i: slim(one(i)))
        return c.statements.select(*own, members.alias("members")).where("size(members) > 0")
    rows = c.agents.dropDuplicates(["stmt_id", "idx"]).select("stmt_id", "idx", F.coalesce(entity_key(F.col("name"), F.col("db_refs")), F.lit(ABSENT)).alias("k"), *parts)
    members = rows.groupBy("stmt_id").agg(F.array_sort(F.collect_list(F.struct("idx", "k", *parts)), lambda x, y: F.when(x["idx"] < y["idx"], -1).when(x["idx"] > y["idx"], 1).otherwise(0)).alias("members"))
    return c.statements.select(*own).join(members, "stmt_id")


def _proposed(groups: DataFrame, higher: DataFrame, present: DataFrame, absent: bool, stated: bool, many: bool) -> DataFrame:
    """(refiner, refined) that may refine each other: two arguments of the general one (its only one; of over two the rarest) are those of the specific one or above them.

    Type, number, places and both keys are one hash; the specific assertion spreads each two of its arguments over what is above them. With one or two
    arguments that is the whole assertion, so one with the same arguments and neither site nor state, which could only refine its equal, does not propose them.
    """
    two = F.expr("case when n = 1 then array(named_struct('i', 0, 'j', -1)) else flatten(transform(sequence(0, n - 2), i -> transform(sequence(i + 1, n - 1), j -> named_struct('i', i, 'j', j)))) end")
    at = lambda p, f: F.get("members", F.col(f"p.{p}"))[f]
    place = lambda p: F.when(F.col("sym"), -1).otherwise(at(p, "idx"))
    cells = groups.select("stmt_id", "stmt_type", "n", "sym", "plain", "members", F.explode(two).alias("p")).select("stmt_id", "stmt_type", "n", "sym", "plain", F.col("p.i").alias("pi"), F.col("p.j").alias("pj"), place("i").alias("ri"), place("j").alias("rj"), at("i", "k").alias("ki"), at("j", "k").alias("kj"))

    def hashed(a: Column, b: Column) -> Column:
        turn = F.col("sym") & (a > b)
        return F.xxhash64("stmt_type", "n", "ri", "rj", F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b))

    rows = cells
    for x in ("i", "j"):
        rows = rows.join(higher.select(F.col("k").alias(f"k{x}"), F.col("ups").alias(f"u{x}")), f"k{x}", "left")
    none = F.array().cast("array<string>")
    options = lambda x: F.concat(F.array(f"k{x}"), F.coalesce(f"u{x}", none), F.when(F.col(f"k{x}") != ABSENT, F.array(F.lit(ABSENT))).otherwise(none) if absent else none)
    every = F.flatten(F.transform(options("i"), lambda a: F.transform(options("j"), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    whole = F.filter(every, lambda t: (F.col("n") > 2) | ~F.col("plain") | (t["a"] != F.col("ki")) | F.coalesce(t["b"] != F.col("kj"), F.lit(False)))
    mine = rows.select("stmt_id", F.explode(F.array_distinct(F.transform(whole, lambda t: hashed(t["a"], t["b"])))).alias("h"))
    general = cells.where("n <= 2")
    if not stated:  # then only an argument that has something below it leads anywhere
        for x in ("i", "j"):
            general = general.join(present.select(F.col("k").alias(f"k{x}"), F.lit(True).alias(f"t{x}")), f"k{x}", "left")
        general = general.where(F.col("ti").isNotNull() | F.col("tj").isNotNull() | (F.col("ki") == ABSENT) | F.coalesce(F.col("kj") == ABSENT, F.lit(False)))
    lead = general.select(F.col("stmt_id").alias("refined"), hashed(F.col("ki"), F.col("kj")).alias("h"))
    if many:
        large = groups.where("n > 2").select("stmt_id", "stmt_type", "n", "sym", F.posexplode("members").alias("at", "m")).select("stmt_id", "stmt_type", "n", "sym", "at", F.when(F.col("sym"), -1).otherwise(F.col("m.idx")).alias("role"), F.col("m.k").alias("k"))
        freq = large.groupBy("stmt_type", "n", "role", "k").agg(F.count("*").alias("f"))
        order = F.struct((F.col("k") == ABSENT).alias("absent"), "f", "at")
        rarest = large.join(freq, ["stmt_type", "n", "role", "k"]).groupBy("stmt_id", "stmt_type", "n", "sym").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), "at", "role", "k"))), 1, 2).alias("l"))
        first = F.array_sort(F.transform("l", lambda x: F.struct(x["at"].alias("at"), x["role"].alias("role"), x["k"].alias("k"))))
        led = rarest.withColumn("l", first).select(F.col("stmt_id").alias("refined"), "stmt_type", "n", "sym", F.col("l")[0]["role"].alias("ri"), F.col("l")[1]["role"].alias("rj"), F.col("l")[0]["k"].alias("ki"), F.col("l")[1]["k"].alias("kj"))
        lead = lead.union(led.select("refined", hashed(F.col("ki"), F.col("kj")).alias("h")))
    return lead.join(mine, "h").where("stmt_id <> refined").select(F.col("stmt_id").alias("refiner"), "refined").distinct()


def refinements(c: Corpus, closed: DataFrame, with_state: bool = True, split: DataFrame | None = None, also=None) -> DataFrame:
    """(refiner, refined): pairs of assertions of a type where each argument of the first is that of the second, below it, or where the second has none, and has all its states.

    The members of symmetric types may be in any order: as many on both sides, and a one-to-one match between them. ``split(stmt_id, side)`` keeps pairs
    across sides only; ``also(pairs)`` is a filter of the caller's over (refiner, refined). A pair is proposed by an equi-join on two arguments of the
    general assertion at once (see ``_proposed``); the rest is told in the row from both sides' arguments, of those that were proposed alone.
    """
    site = ["residue", "position", "activity", "is_active", "from_location", "to_location"]
    groups = checkpoint(_grouped(c, site))
    states = ["mods", "mutations", "bound"]
    plain = F.coalesce(F.forall("members", lambda m: reduce(Column.__and__, [F.coalesce(F.size(m[x]), F.lit(0)) <= 0 for x in states]) & m["activity"]["activity_type"].isNull() & m["activity"]["is_active"].isNull() & m["location"].isNull()), F.lit(True)) & reduce(Column.__and__, [F.col(x).isNull() for x in site if x != "is_active"])
    groups = groups.withColumn("n", F.size("members")).withColumn("plain", plain)
    told = groups.agg(F.max(F.exists("members", lambda m: m["k"] == ABSENT)).alias("absent"), F.max(~F.col("plain") & (F.col("n") <= 2)).alias("stated"), F.max(F.col("n") > 2).alias("many")).first()
    # what is above a key, as far as some assertion speaks of it
    up = reach(closed)
    tops = _few(checkpoint(up.select(F.col("up").alias("k")).distinct()))
    present = checkpoint(groups.select(F.explode("members.k").alias("k")).join(tops, "k").distinct())
    higher = _few(checkpoint(up.join(_few(present).withColumnRenamed("k", "up"), "up").groupBy("k").agg(F.collect_set("up").alias("ups"))))
    proposed = checkpoint(_proposed(groups, higher, _few(present), bool(told["absent"]), bool(told["stated"]), bool(told["many"])))
    ids = _few(checkpoint(proposed.select(F.col("refiner").alias("stmt_id")).union(proposed.select("refined")).distinct()))
    near = checkpoint(groups.join(ids, "stmt_id", "left_semi"))
    # the arguments with all that is above them
    flat = near.select("stmt_id", F.explode("members").alias("m")).select("stmt_id", F.col("m.k").alias("k")).distinct().join(higher, "k", "left")
    above = flat.groupBy("stmt_id").agg(F.map_from_entries(F.collect_list(F.struct("k", F.concat(F.array("k", F.lit(ABSENT)), F.coalesce("ups", F.array().cast("array<string>"))).alias("ups")))).alias("ups"))
    low = near.join(above, "stmt_id").select(F.col("stmt_id").alias("refiner"), F.col("members").alias("s_members"), "ups", *site)
    high = near.select(F.col("stmt_id").alias("refined"), F.col("members").alias("g_members"), "sym", *(F.col(x).alias(f"g_{x}") for x in site))
    fits = lambda s, g: F.array_contains(F.element_at("ups", s["k"]), g["k"]) & (state_refines(s, g) if with_state else F.lit(True))
    in_order = (F.size("s_members") == F.size("g_members")) & F.forall(F.zip_with("s_members", "g_members", lambda s, g: (s["idx"] == g["idx"]) & fits(s, g)), lambda x: F.coalesce(x, F.lit(False)))
    out = proposed.join(low, "refiner").join(high, "refined").where(_site_refines() & F.when(F.col("sym"), matches_all(F.col("s_members"), F.col("g_members"), fits)).otherwise(in_order)).select("refiner", "refined").distinct()
    if split is not None:
        out = out.join(split.select(F.col("stmt_id").alias("refiner"), F.col("side").alias("x")), "refiner").join(split.select(F.col("stmt_id").alias("refined"), F.col("side").alias("y")), "refined").where("x <> y").select("refiner", "refined")
    out = checkpoint(out if also is None else also(out).select("refiner", "refined"))
    # of assertions that refine each other (equal ones) neither does
    back = out.select(F.col("refiner").alias("refined"), F.col("refined").alias("refiner"))
    return checkpoint(out.join(back, ["refiner", "refined"], "left_anti"))


def combine_related(c: Corpus, closed: DataFrame, return_toplevel: bool = True, **kwargs) -> Corpus:
    pairs = refinements(c, closed, **kwargs)
    out = c.with_(refinements=pairs)
    if not return_toplevel:
        return out
    top = c.statements.join(pairs.select(F.col("refined").alias("stmt_id")), "stmt_id", "left_anti")
    return out.keep(top)


def refinement_closure(pairs: DataFrame) -> DataFrame:
    from .ontology import closure

    edges = pairs.select(F.lit("").alias("s_ns"), F.col("refiner").cast("string").alias("s_id"), F.lit("").alias("t_ns"), F.col("refined").cast("string").alias("t_id"), F.lit("isa").alias("rel"))
    return closure(edges).select(F.col("id").cast("long").alias("refiner"), F.col("p_id").cast("long").alias("refined"))


def assert_no_cycle(pairs: DataFrame) -> None:
    closed = refinement_closure(pairs)
    back = closed.select(F.col("refiner").alias("refined"), F.col("refined").alias("refiner"))
    if not closed.join(back, ["refiner", "refined"], "left_semi").isEmpty():
        raise ValueError("refinements have a cycle")


def flatten_evidence(c: Corpus, collect_from: str = "supported_by") -> DataFrame:
    """(stmt_id, support_type, evidence columns): an assertion's own evidence and that of all assertions that refine it (or that it refines: ``supports``)."""
    closed = refinement_closure(c.refinements)
    near, far = ("refined", "refiner") if collect_from == "supported_by" else ("refiner", "refined")
    own = c.evidence.withColumn("support_type", F.lit("direct"))
    more = c.evidence.join(closed.select(F.col(far).alias("stmt_id"), F.col(near).alias("__for")), "stmt_id").withColumn("stmt_id", F.col("__for")).drop("__for").withColumn("support_type", F.lit(collect_from))
    return own.unionByName(more).withColumn("__ek", evidence_key()).dropDuplicates(["stmt_id", "support_type", "__ek"]).drop("__ek")


def flatten_stmts(c: Corpus, heads: DataFrame) -> DataFrame:
    """stmt_ids of ``heads`` and of all that refine them."""
    closed = refinement_closure(c.refinements)
    below = closed.join(heads.select(F.col("stmt_id").alias("refined")), "refined", "left_semi").select(F.col("refiner").alias("stmt_id"))
    return heads.select("stmt_id").union(below).distinct()


def find_contradicts(c: Corpus, closed: DataFrame) -> DataFrame:
    """(a, b): a positive and an opposite assertion (or two active forms with opposite activity) whose arguments match or refine each other either way, at the same site."""
    g = entity_groups(c).where(F.size("keys") >= 1)
    plus = g.where(F.col("stmt_type").isin(*OPPOSITES)).withColumn("opp", F.element_at(F.create_map(*(F.lit(x) for p in OPPOSITES.items() for x in p)), F.col("stmt_type"))).where(F.size("keys") == 2)
    a = plus.select(F.col("stmt_id").alias("a"), F.col("opp").alias("stmt_type"), F.col("keys")[0].alias("a0"), F.col("keys")[1].alias("a1"), F.col("residue").alias("ra"), F.col("position").alias("pa")).where(f"a0 <> '{ABSENT}' and a1 <> '{ABSENT}'")
    b = g.where(F.size("keys") == 2).select(F.col("stmt_id").alias("b"), "stmt_type", F.col("keys")[0].alias("b0"), F.col("keys")[1].alias("b1"), F.col("residue").alias("rb"), F.col("position").alias("pb")).where(F.col("stmt_type").isin(*OPPOSITES.values()))
    up = reach(closed)
    near = checkpoint(up.select(F.col("k").alias("x"), F.col("up").alias("y")).union(up.select(F.col("up").alias("x"), F.col("k").alias("y"))))
    one_site = F.col("ra").eqNullSafe(F.col("rb")) & F.col("pa").eqNullSafe(F.col("pb"))
    # each positive assertion is led by its rarer argument, which alone is spread over the ontology; the other is then told for the pairs that met
    n_first, n_second = (b.groupBy("stmt_type", F.col(f"b{i}").alias(f"a{i}")).agg(F.count("*").alias(f"n{i}")) for i in (0, 1))
    told = checkpoint(a.join(n_first, ["stmt_type", "a0"], "left").join(n_second, ["stmt_type", "a1"], "left").withColumn("by", F.when(F.coalesce("n0", F.lit(0)) <= F.coalesce("n1", F.lit(0)), 0).otherwise(1)).drop("n0", "n1"))
    met = None
    for i in (0, 1):
        mine = told.where(F.col("by") == i)
        spread = mine.withColumn("t", F.col(f"a{i}")).union(mine.join(near, F.col(f"a{i}") == F.col("x")).select(*mine.columns, F.col("y").alias("t")))
        found = spread.join(b.withColumnRenamed("stmt_type", "b_type"), (F.col("stmt_type") == F.col("b_type")) & (F.col("t") == F.col(f"b{i}"))).where(one_site).select("a", "b", F.col(f"a{1 - i}").alias("p"), F.col(f"b{1 - i}").alias("q"))
        met = found if met is None else met.union(found)
    same = met.where("p = q").select("a", "b")
    related = met.where("p <> q").join(near, (F.col("p") == F.col("x")) & (F.col("q") == F.col("y"))).select("a", "b")
    hit = same.union(related)
    forms = g.where("stmt_type = 'ActiveForm'").select("stmt_id", F.col("keys")[0].alias("k"), "activity", "is_active")
    f = forms.where("is_active").alias("f").join(forms.where("not is_active").alias("h"), (F.col("f.k") == F.col("h.k")) & F.col("f.activity").eqNullSafe(F.col("h.activity"))).select(F.col("f.stmt_id").alias("a"), F.col("h.stmt_id").alias("b"))
    return hit.union(f).distinct()


def align_statements(left: Corpus, right: Corpus) -> DataFrame:
    """(left_id, right_id, mk_hash): a full outer match by key; of several with a key on the right only the first."""
    one = statement_keys(left).select(F.col("stmt_id").alias("left_id"), "mk_hash")
    two = statement_keys(right).groupBy("mk_hash").agg(F.min("stmt_id").alias("right_id"))
    return one.join(two, "mk_hash", "full_outer").select("left_id", "right_id", "mk_hash")


def normalize_equivalences(agents: DataFrame, equal_closed: DataFrame, ns: str, rank: DataFrame) -> DataFrame:
    """Arguments of ``ns`` moved to the best-ranked of their equal terms; ``rank(id, rank)``, less is better."""
    sets = equal_closed.where((F.col("ns") == ns) & (F.col("p_ns") == ns)).select("id", F.col("p_id").alias("o"))
    sets = sets.union(sets.select(F.col("id"), F.col("id").alias("o"))).distinct()
    best = sets.join(rank.select(F.col("id").alias("o"), "rank"), "o").groupBy("id").agg(F.min_by("o", F.struct("rank", "o")).alias("__best"))
    out = agents.withColumn("__id", F.try_element_at("db_refs", F.lit(ns))).join(best.withColumnRenamed("id", "__id"), "__id", "left")
    moved = F.map_concat(F.map_filter("db_refs", lambda k, v: k != ns), F.create_map(F.lit(ns), F.col("__best")))
    return out.withColumn("db_refs", F.when(F.col("__best").isNotNull(), moved).otherwise(F.col("db_refs"))).drop("__id", "__best")
