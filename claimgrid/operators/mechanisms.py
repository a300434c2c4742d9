"""Mechanisms that follow from others, as joins on argument keys. Each result row names its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import entity_key
from ..schema import ADDING, REMOVING, Corpus, descendants


def wide(c: Corpus) -> DataFrame:
    """(stmt_id, stmt_type, site, a0_*, a1_*): assertions of two arguments on a row."""
    if "args" in c.statements.columns:
        at = lambda i: F.try_element_at(F.filter("args", lambda a: a["idx"] == i), F.lit(1))
        side = lambda i: [at(i)["name"].alias(f"a{i}_name"), entity_key(at(i)["name"], at(i)["db_refs"]).alias(f"a{i}_k"), at(i)["mods"].alias(f"a{i}_mods"), at(i)["activity"].alias(f"a{i}_activity")]
        return c.statements.select("*", *side(0), *side(1)).drop("args", "ev").withColumnRenamed("activity", "stmt_activity")
    a = c.agents.withColumn("k", entity_key(F.col("name"), F.col("db_refs"))).select("stmt_id", "idx", "name", "k", "mods", "activity")
    one = lambda i: a.where(F.col("idx") == i).select("stmt_id", *(F.col(x).alias(f"a{i}_{x}") for x in ("name", "k", "mods", "activity")))
    return c.statements.join(one(0), "stmt_id", "left").join(one(1), "stmt_id", "left").withColumnRenamed("activity", "stmt_activity")


def _mod_types():
    return F.create_map(*(F.lit(x) for t in ADDING for x in (t.lower(), t)))


def infer_complexes(c: Corpus) -> DataFrame:
    """(sources, stmt_type, a, b): enzyme and substrate of a modification meet."""
    return wide(c).where(F.col("stmt_type").isin(*ADDING, *REMOVING) & F.col("a0_k").isNotNull()).select(F.array("stmt_id").alias("sources"), F.lit("Complex").alias("stmt_type"), F.col("a0_k").alias("a"), F.col("a1_k").alias("b"))


def infer_activations(c: Corpus) -> DataFrame:
    """A modification that makes an active (or inactive) form activates (or inhibits) its substrate."""
    w = wide(c)
    forms = w.where("stmt_type = 'ActiveForm'").select(F.col("stmt_id").alias("f"), F.col("a0_k").alias("k"), F.col("is_active").alias("on"), F.explode("a0_mods").alias("m")).select("f", "k", "on", F.try_element_at(_mod_types(), F.col("m.mod_type")).alias("t"), F.col("m.residue").alias("r"), F.col("m.position").alias("p"))
    mods = w.where(F.col("stmt_type").isin(*ADDING) & F.col("a0_k").isNotNull())
    hit = mods.join(forms, (F.col("a1_k") == F.col("k")) & (F.col("stmt_type") == F.col("t")) & F.col("residue").eqNullSafe(F.col("r")) & F.col("position").eqNullSafe(F.col("p")))
    return hit.select(F.array("stmt_id", "f").alias("sources"), F.when(F.col("on"), "Activation").otherwise("Inhibition").alias("stmt_type"), F.col("a0_k").alias("a"), F.col("a1_k").alias("b")).distinct()


def infer_active_forms(c: Corpus) -> DataFrame:
    """(sources, k, is_active, mods): a kinase that regulates and modifies a protein: the modified protein is its (in)active form."""
    w = wide(c)
    reg = w.where(F.col("stmt_type").isin(*descendants("RegulateActivity"))).where("a0_activity.is_active and a0_activity.activity_type = 'kinase'").select(F.col("stmt_id").alias("r"), F.col("a0_k").alias("x"), F.col("a1_k").alias("y"), (F.col("stmt_type") != "Inhibition").alias("is_active"))
    mods = w.where(F.col("stmt_type").isin(*ADDING)).select(F.col("stmt_id").alias("m"), F.col("a0_k").alias("x"), F.col("a1_k").alias("y"), F.concat_ws(",", F.lower("stmt_type"), F.coalesce("residue", F.lit("~")), F.coalesce("position", F.lit("~"))).alias("mod"))
    return reg.join(mods, ["x", "y"]).groupBy("r", F.col("y").alias("k"), "is_active").agg(F.array_sort(F.collect_set("m")).alias("ms"), F.array_sort(F.collect_set("mod")).alias("mods")).select(F.concat(F.array("r"), "ms").alias("sources"), "k", "is_active", "mods")


def infer_modifications(c: Corpus) -> DataFrame:
    """Regulation of a protein whose active form is a modified one: the regulator modifies it so."""
    w = wide(c)
    forms = w.where("stmt_type = 'ActiveForm'").select(F.col("stmt_id").alias("f"), F.col("a0_k").alias("y"), "is_active", F.explode("a0_mods").alias("m"))
    reg = w.where(F.col("stmt_type").isin("Activation", "Inhibition")).select(F.col("stmt_id").alias("r"), F.col("a0_k").alias("x"), F.col("a1_k").alias("y"), (F.col("stmt_type") == "Activation").alias("plus"))
    hit = reg.join(forms, "y").where(F.col("m.is_modified"))
    kind = F.try_element_at(_mod_types(), F.col("m.mod_type"))
    from ..schema import INVERSE

    undo = F.create_map(*(F.lit(x) for t in ADDING for x in (t, INVERSE[t])))
    return hit.select(F.array("r", "f").alias("sources"), F.when(F.col("plus") == F.col("is_active"), kind).otherwise(F.try_element_at(undo, kind)).alias("stmt_type"), F.col("x").alias("a"), F.col("y").alias("b"), F.col("m.residue").alias("residue"), F.col("m.position").alias("position")).where("stmt_type is not null")


def replace_complexes(c: Corpus, inferred: DataFrame | None = None) -> Corpus:
    """Without the complexes whose two members an inferred one already has."""
    inferred = infer_complexes(c) if inferred is None else inferred
    pairs = inferred.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    w = wide(c).where("stmt_type = 'Complex'").select("stmt_id", F.least("a0_k", "a1_k").alias("x"), F.greatest("a0_k", "a1_k").alias("y"))
    gone = w.join(pairs, ["x", "y"], "left_semi").select("stmt_id")
    return c.keep(c.statements.join(gone, "stmt_id", "left_anti"))


def replace_activations(c: Corpus, inferred: DataFrame | None = None) -> Corpus:
    inferred = infer_activations(c) if inferred is None else inferred
    known = inferred.select("stmt_type", F.col("a").alias("a0_k"), F.col("b").alias("a1_k")).distinct()
    gone = wide(c).join(known, ["stmt_type", "a0_k", "a1_k"], "left_semi").select("stmt_id")
    return c.keep(c.statements.join(gone, "stmt_id", "left_anti"))


def gather_activities(c: Corpus) -> DataFrame:
    """(name, activities): those in arguments' states and those that regulations and active forms speak of."""
    states = c.agents.where("activity is not null").select("name", F.col("activity.activity_type").alias("act"))
    said = c.statements.where("activity is not null").join(c.agents, "stmt_id").where(F.col("idx") == F.when(F.col("stmt_type").isin(*descendants("RegulateActivity")), 1).otherwise(0)).select("name", c.statements["activity"].alias("act"))
    return states.union(said).groupBy("name").agg(F.array_sort(F.collect_set("act")).alias("activities"))


def gather_modifications(c: Corpus) -> DataFrame:
    """(name, sites): every modification of an argument, in its state or by an assertion."""
    key = lambda t, r, p: F.concat_ws(",", F.lower(t), F.coalesce(r, F.lit("~")), F.coalesce(p, F.lit("~")))
    states = c.agents.select("name", F.explode("mods").alias("m")).select("name", key(F.col("m.mod_type"), F.col("m.residue"), F.col("m.position")).alias("site"))
    made = c.statements.where(F.col("stmt_type").isin(*ADDING)).join(c.agents.where("idx = 1").select("stmt_id", "name"), "stmt_id").select("name", key(F.col("stmt_type"), F.col("residue"), F.col("position")).alias("site"))
    return states.union(made).groupBy("name").agg(F.array_sort(F.collect_set("site")).alias("sites"))


def reduce_modifications(c: Corpus) -> DataFrame:
    """(stmt_id, residue, position): an unspecific site becomes the substrate's only specific one of that type."""
    sub = c.statements.where(F.col("stmt_type").isin(*ADDING)).join(c.agents.where("idx = 1").select("stmt_id", "name"), "stmt_id")
    only = sub.where("position is not null").groupBy("name", "stmt_type").agg(F.count_distinct("residue", "position").alias("n"), F.min(F.struct("residue", "position")).alias("s")).where("n = 1").select("name", "stmt_type", "s")
    return sub.join(only, ["name", "stmt_type"], "left").select("stmt_id", F.when(F.col("position").isNull() & F.col("s").isNotNull(), F.col("s.residue")).otherwise(F.col("residue")).alias("residue"), F.coalesce("position", "s.position").alias("position"))


def add_reverse_effects(c: Corpus) -> DataFrame:
    """(stmt_type, k, residue, position): a dephosphorylation for each phosphorylated site without one, and a decrease for each amount that is only increased."""
    w = wide(c)
    site = ["k", "residue", "position"]
    get = lambda t: w.where(F.col("stmt_type") == t).select(F.col("a1_k").alias("k"), F.coalesce("residue", F.lit("~")).alias("residue"), F.coalesce("position", F.lit("~")).alias("position")).distinct()
    undo = get("Phosphorylation").join(get("Dephosphorylation"), site, "left_anti").select(F.lit("Dephosphorylation").alias("stmt_type"), *site)
    down = get("IncreaseAmount").select("k").distinct().join(get("DecreaseAmount").select("k"), "k", "left_anti").select(F.lit("DecreaseAmount").alias("stmt_type"), "k", F.lit("~").alias("residue"), F.lit("~").alias("position"))
    return undo.union(down)


def require_active_forms(c: Corpus) -> Corpus:
    """Modifications and regulations once for each active form of their first argument, which takes on that form's modifications and partners.

    Assertions whose first argument has no active form stay as they are. New ids are hashes of the old id and the form, evidence goes along.
    """
    first = c.agents.where("idx = 0")
    forms = c.statements.where("stmt_type = 'ActiveForm' and is_active").select("stmt_id").join(first, "stmt_id").select(F.col("name").alias("__n"), F.col("mods").alias("__mods"), F.col("bound").alias("__bound"))
    forms = forms.withColumn("__f", F.xxhash64(F.to_json(F.struct("__mods", "__bound")))).dropDuplicates(["__n", "__f"])
    kinds = sorted({*ADDING, *REMOVING, *descendants("RegulateAmount"), *descendants("RegulateActivity")})
    who = c.statements.where(F.col("stmt_type").isin(*kinds)).select("stmt_id").join(first.select("stmt_id", "name"), "stmt_id")
    hit = who.join(forms, F.col("name") == F.col("__n")).select("stmt_id", F.xxhash64("stmt_id", "__f").alias("__new"), "__mods", "__bound")
    renamed = lambda df: df.join(hit.select("stmt_id", "__new"), "stmt_id", "left").withColumn("stmt_id", F.coalesce("__new", "stmt_id")).select(*df.columns)
    both = lambda own, more: F.when((F.col("idx") == 0) & F.col("__new").isNotNull() & F.col(more).isNotNull(), F.concat(F.coalesce(F.col(own), F.slice(more, 1, 0)), F.col(more))).otherwise(F.col(own))
    agents = c.agents.join(hit, "stmt_id", "left").withColumn("mods", F.array_distinct(both("mods", "__mods"))).withColumn("bound", both("bound", "__bound")).withColumn("stmt_id", F.coalesce("__new", "stmt_id")).select(*c.agents.columns)
    return c.with_(statements=renamed(c.statements), agents=agents, evidence=renamed(c.evidence), refinements=None)


def reduce_activities(c: Corpus) -> Corpus:
    """The unspecific activity of a regulation's object becomes the one specific activity that the corpus knows of it; with none or several it stays."""
    one = gather_activities(c).withColumn("a", F.filter("activities", lambda a: a != "activity")).where(F.size("a") == 1).select(F.col("name").alias("__n"), F.col("a")[0].alias("__a"))
    obj = c.agents.where("idx = 1").select("stmt_id", "name").join(one, F.col("name") == F.col("__n")).select("stmt_id", "__a")
    st = c.statements.join(obj, "stmt_id", "left")
    plain = F.col("stmt_type").isin(*descendants("RegulateActivity")) & (F.coalesce("activity", F.lit("activity")) == "activity")
    return c.with_(statements=st.withColumn("activity", F.when(plain & F.col("__a").isNotNull(), F.col("__a")).otherwise(F.col("activity"))).select(*c.statements.columns))
