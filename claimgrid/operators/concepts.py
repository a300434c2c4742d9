"""Events, influences and associations over concepts: changes, times, groundings, refinement and contradiction.

An event is an argument with a change: ``events(stmt_id, idx, ns, id, polarity)``, polarity 1, -1 or null; an Influence has two (0 causes 1), an Association
members in any order, an Event one. Overall polarity is the product of the known ones. Pairs of assertions come from equi-joins of the type and
the first concept's key with what is above it; the other concepts and polarities are told for the pairs that meet.

Cases: a concept without a grounding is its name under the namespace ``NAME``; an unknown polarity is neither sign; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .ontology import closure

EVENTS = "stmt_id long, idx int, ns string, id string, polarity int"


# changes, times and groundings as expressions


def polarity_refines(s: Column, g: Column) -> Column:
    """A known change refines an unknown one; otherwise they are the same."""
    return (s.isNotNull() & g.isNull()) | s.eqNullSafe(g)


def quantity_refines(s: Column, g: Column) -> Column:
    """Structs of entity, value, unit, polarity: the entity is the same, and an unknown value is refined by any, a known one by its equal."""
    return polarity_refines(s["polarity"], g["polarity"]) & s["entity"].eqNullSafe(g["entity"]) & (g["value"].isNull() | (s["value"].eqNullSafe(g["value"]) & s["unit"].eqNullSafe(g["unit"]) & s["value"].isNotNull()))


def time_refines(s: Column, g: Column) -> Column:
    """Structs of start and end: later start, and an earlier end where both have one; a start refines none."""
    inside = (s["start"] > g["start"]) & (s["end"].isNull() | g["end"].isNull() | (s["end"] < g["end"]))
    return s["start"].isNotNull() & (g["start"].isNull() | F.coalesce(inside, F.lit(False)))


def event_refines(concept_refines: Column, s_polarity: Column, g_polarity: Column, ignore_polarity: bool = False) -> Column:
    return concept_refines if ignore_polarity else concept_refines & polarity_refines(s_polarity, g_polarity)


def overall_polarity(polarities: Column) -> Column:
    """Product of the known signs of the first two; null if both are unknown."""
    a, b = F.try_element_at(polarities, F.lit(1)), F.try_element_at(polarities, F.lit(2))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a * b)


def polarity_count(polarities: Column) -> Column:
    return F.size(F.filter(polarities, lambda p: p.isNotNull()))


def change_refines(s: Column, g: Column) -> Column:
    """Arrays of polarities: not fewer known ones, and the same overall one unless the general has none."""
    so, go = overall_polarity(s), overall_polarity(g)
    return (polarity_count(s) >= polarity_count(g)) & ((so.isNotNull() & go.isNull()) | so.eqNullSafe(go))


def influence_key(subj: Column, obj: Column, polarities: Column) -> Column:
    """Identity of an influence: +/+ equals -/-, and an unknown sign beside + equals + beside an unknown one."""
    return F.concat_ws("|", F.lit("Influence"), subj, obj, polarity_count(polarities).cast("string"), F.coalesce(overall_polarity(polarities).cast("string"), F.lit("~")))


def compositional_rank(entry: Column) -> Column:
    """Order of a compositional grounding, an array of (concept, score) that may hold nulls: the theme's score, the number of parts, their mean score, their names."""
    known = F.filter(entry, lambda g: g.isNotNull() & g["concept"].isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, g: acc + g["score"].cast("double"))
    return F.struct(known[0]["score"].cast("double").alias("theme"), F.size(known).alias("n"), (total / F.size(known)).alias("mean"), F.array_join(F.transform(known, lambda g: g["concept"]), "|").alias("names"))


def sorted_compositional(groundings: Column) -> Column:
    """Entries, the best first."""
    order = lambda x, y: F.when(compositional_rank(x) > compositional_rank(y), -1).when(compositional_rank(x) < compositional_rank(y), 1).otherwise(0)
    return F.array_sort(groundings, order)


def top_compositional(groundings: Column) -> Column:
    return F.try_element_at(sorted_compositional(groundings), F.lit(1))


# relations of concepts


def opposites(edges: DataFrame) -> DataFrame:
    """(ns, id, o_ns, o_id): terms that a chain of ``is_opposite`` edges leads to."""
    return closure(edges, ("is_opposite",)).select("ns", "id", F.col("p_ns").alias("o_ns"), F.col("p_id").alias("o_id"))


def is_opposite(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """``pairs(ns, id, o_ns, o_id)`` with ``opposite``."""
    return pairs.join(opposites(edges).withColumn("__o", F.lit(True)).distinct(), ["ns", "id", "o_ns", "o_id"], "left").withColumn("opposite", F.coalesce("__o", F.lit(False))).drop("__o")


def _key(ns: str = "ns", id_: str = "id") -> Column:
    return F.concat_ws(":", ns, id_)


def _wide(statements: DataFrame, events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    one = events.select("stmt_id", "idx", _key().alias("k"), "polarity").dropDuplicates(["stmt_id", "idx"])
    args = one.groupBy("stmt_id").agg(F.array_sort(F.collect_list(F.struct("idx", "k", "polarity"))).alias("m"))
    return statements.where(F.col("stmt_type").isin(*kinds)).select("stmt_id", "stmt_type").join(args, "stmt_id").select("stmt_id", "stmt_type", F.transform("m", lambda x: x["k"]).alias("ks"), F.transform("m", lambda x: x["polarity"]).alias("ps"))


def _above(closed: DataFrame) -> DataFrame:
    """(k, up): a key and what is above it."""
    return closed.select(_key().alias("k"), F.concat_ws(":", "p_ns", "p_id").alias("up")).distinct()


def _told(pairs: DataFrame, table: DataFrame, name: str) -> DataFrame:
    """Rows of ``pairs(p, q)`` with whether (p, q) is in ``table(k, up)``."""
    return pairs.join(table.select(F.col("k").alias("p"), F.col("up").alias("q"), F.lit(True).alias("__x")), ["p", "q"], "left").withColumn(name, F.coalesce("__x", F.lit(False))).drop("__x")


def _matched(a: DataFrame, b: DataFrame, closed: DataFrame, edges: DataFrame | None) -> DataFrame:
    """Pairs (a, b) that share a first concept (equal, above or below, or opposite), with a row (a, b, i, j, refines, opposite) for each two of their concepts."""
    up = _above(closed)
    near = up.union(up.select(F.col("up").alias("k"), F.col("k").alias("up")))
    if edges is not None:
        near = near.union(opposites(edges).select(_key().alias("k"), F.concat_ws(":", "o_ns", "o_id").alias("up")))
    near = checkpoint(near.distinct())
    first = a.select(F.col("stmt_id").alias("a"), "stmt_type", F.explode("ks").alias("k")) if edges is None else a.select(F.col("stmt_id").alias("a"), "stmt_type", F.explode("ks").alias("k"))
    spread = first.withColumn("t", F.col("k")).union(first.join(near, "k").select("a", "stmt_type", "k", F.col("up").alias("t")))
    met = spread.join(b.select(F.col("stmt_id").alias("b"), "stmt_type", F.explode("ks").alias("t")), ["stmt_type", "t"]).where("a <> b").select("a", "b").distinct()
    whole = met.join(a.select(F.col("stmt_id").alias("a"), "stmt_type", F.col("ks").alias("ka"), F.col("ps").alias("pa")), "a").join(b.select(F.col("stmt_id").alias("b"), F.col("ks").alias("kb"), F.col("ps").alias("pb")), "b").where(F.size("ka") == F.size("kb"))
    cells = whole.select("a", "b", "stmt_type", "ka", "kb", "pa", "pb", F.posexplode("ka").alias("i", "p")).select("*", F.posexplode("kb").alias("j", "q"))
    cells = _told(_told(cells, up, "below"), up.select(F.col("up").alias("k"), F.col("k").alias("up")), "over")
    if edges is not None:
        cells = _told(cells, opposites(edges).select(_key().alias("k"), F.concat_ws(":", "o_ns", "o_id").alias("up")).distinct(), "opposite")
    else:
        cells = cells.withColumn("opposite", F.lit(False))
    return cells.withColumn("refines", (F.col("p") == F.col("q")) | F.col("below"))


def _dealt(cells: DataFrame, fits: Column) -> DataFrame:
    """(a, b) whose concepts match one to one in every place (Influence, Event) or in some order (Association)."""
    in_place = F.when(F.col("stmt_type") == "Association", F.lit(True)).otherwise(F.col("i") == F.col("j"))
    rows = cells.where(in_place & fits).groupBy("a", "b").agg(F.max(F.size("ka")).alias("n"), F.collect_set(F.struct("i", "j")).alias("c"))
    # members are few: fold sets of taken places as bit masks, one member after the other
    bit = lambda j: F.call_function("shiftleft", F.lit(1).cast("long"), j.cast("int"))
    step = lambda masks, i: F.array_distinct(F.flatten(F.transform(masks, lambda m: F.transform(F.filter(F.col("c"), lambda x: (x["i"] == i) & (m.bitwiseAND(bit(x["j"])) == 0)), lambda x: m.bitwiseOR(bit(x["j"]))))))
    return rows.where(F.size(F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), F.array(F.lit(0).cast("long")), step)) > 0).select("a", "b")


def refinements(statements: DataFrame, events: DataFrame, closed: DataFrame) -> DataFrame:
    """(refiner, refined) among Influences, Associations and Events: every concept is the other's or below it, and the change refines the other's."""
    w = checkpoint(_wide(statements, events, ("Influence", "Association", "Event")))
    cells = _matched(w, w, closed, None).where(change_refines(F.col("pa"), F.col("pb")))
    out = checkpoint(_dealt(cells, F.col("refines")).select(F.col("a").alias("refiner"), F.col("b").alias("refined")))
    return out.join(out.select(F.col("refiner").alias("refined"), F.col("refined").alias("refiner")), ["refiner", "refined"], "left_anti")


def contradictions(statements: DataFrame, events: DataFrame, closed: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b), a < b: influences or associations of two whose concepts are all related (or all opposite) with other overall signs, or one opposite and one related with the same sign.

    The first assertion's concepts are both spread over what is related or opposite to them and spoken of at all; pairs are an equi-join on type and both concepts.
    """
    w = checkpoint(_wide(statements, events, ("Influence", "Association")).where(F.size("ks") == 2))
    rows = w.withColumn("sign", overall_polarity(F.col("ps"))).where("sign is not null").select("stmt_id", "stmt_type", F.col("ks")[0].alias("k0"), F.col("ks")[1].alias("k1"), "sign")
    up = _above(closed)
    related = up.union(up.select(F.col("up").alias("k"), F.col("k").alias("up"))).withColumn("kind", F.lit("r"))
    opposed = opposites(edges).select(_key().alias("k"), F.concat_ws(":", "o_ns", "o_id").alias("up")).withColumn("kind", F.lit("o"))
    near = related.union(opposed).where("kind = 'o' or k <> up").distinct()
    spoken = rows.select(F.col("k0").alias("up")).union(rows.select("k1")).distinct()
    near = checkpoint(near.join(spoken, "up", "left_semi"))
    # both concepts are in the key, so a very common concept alone brings nothing together
    a = rows
    for i in (0, 1):
        same = a.withColumn(f"t{i}", F.col(f"k{i}")).withColumn(f"x{i}", F.lit("r"))
        a = same if near.isEmpty() else same.union(a.join(near.withColumnsRenamed({"k": f"k{i}", "up": f"t{i}", "kind": f"x{i}"}), f"k{i}").select(*same.columns))
    b = rows.select(F.col("stmt_id").alias("b"), "stmt_type", F.col("k0").alias("t0"), F.col("k1").alias("t1"), F.col("sign").alias("b_sign"))
    turned = rows.where("stmt_type = 'Association'").select("stmt_id", "stmt_type", F.col("k1").alias("t0"), F.col("k0").alias("t1"), "sign")
    met = a.withColumnRenamed("stmt_id", "a").join(b.union(turned), ["stmt_type", "t0", "t1"]).where("a < b")
    return met.where("(x0 = x1) <> (sign = b_sign)").select("a", "b").distinct()


def normalize_opposites(events: DataFrame, edges: DataFrame, nodes: DataFrame, ns: str) -> DataFrame:
    """Events whose concept has an opposite in ``ns`` become those of the better of the two (positive before negative polarity of the term, then the lesser id); a known change is turned round with it."""
    both = opposites(edges).where((F.col("ns") == ns) & (F.col("o_ns") == ns)).select("id", F.col("o_id").alias("o"))
    every = both.union(both.select("id", F.col("id").alias("o"))).distinct()
    rank = nodes.where(F.col("ns") == ns).select(F.col("id").alias("o"), (-F.coalesce("polarity", F.lit(1))).alias("r"))
    best = every.join(rank, "o", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("r", F.lit(-1)).alias("r"), "o")).alias("b")).select("id", F.col("b.o").alias("__to"), F.lit(ns).alias("ns"))
    out = events.join(best, ["ns", "id"], "left")
    moved = F.coalesce(F.col("__to") != F.col("id"), F.lit(False))
    return out.withColumn("polarity", F.when(moved, -F.col("polarity")).otherwise(F.col("polarity"))).withColumn("id", F.coalesce("__to", "id")).select(*events.columns)


def from_agents(agents: DataFrame, ns_order: tuple[str, ...] = ("WM", "UN")) -> DataFrame:
    """Events of an agents table with a ``polarity`` column (null where there is none): the first grounding, or the name."""
    found = F.coalesce(*(F.when(F.try_element_at("db_refs", F.lit(n)).isNotNull(), F.struct(F.lit(n).alias("ns"), F.try_element_at("db_refs", F.lit(n)).alias("id"))) for n in ns_order), F.struct(F.lit("NAME").alias("ns"), F.col("name").alias("id")))
    polarity = F.col("polarity").cast("int") if "polarity" in agents.columns else F.lit(None).cast("int")
    return agents.select("stmt_id", "idx", found.alias("g"), polarity.alias("polarity")).select("stmt_id", "idx", "g.ns", "g.id", "polarity")
