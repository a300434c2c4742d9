"""Filters over a corpus. Each keeps whole assertions; arguments and evidence follow by their stmt_id.

Filters on the assertion's own columns reach the scan; those on arguments or evidence aggregate the child table by
stmt_id (combined before the shuffle) or use a semi- or anti-join.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import is_grounded
from ..schema import ADDING, INVERSE, REMOVING, SYMMETRIC, TEXT_NS, Corpus, descendants


def _agents_hold(c: Corpus, condition: Column, policy: str = "all") -> DataFrame:
    """stmt_ids whose arguments all (or one of them, at least) satisfy the condition; arguments that are null don't count."""
    test = F.coalesce(condition, F.lit(False))
    fold = F.bool_and(test) if policy == "all" else F.bool_or(test)
    return c.agents.where("name is not null").groupBy("stmt_id").agg(fold.alias("ok")).where("ok").select("stmt_id")


def _no_agents(c: Corpus) -> DataFrame:
    return c.statements.join(c.agents.where("name is not null").select("stmt_id"), "stmt_id", "left_anti").select("stmt_id")


def _semi(c: Corpus, ids: DataFrame, invert: bool = False) -> Corpus:
    return c.keep(c.statements.join(ids, "stmt_id", "left_anti" if invert else "left_semi"))


def filter_by_type(c: Corpus, stmt_type: str, invert: bool = False) -> Corpus:
    hit = F.col("stmt_type").isin(*descendants(stmt_type))
    return c.keep(c.statements.where(~hit if invert else hit))


def _bound_ok(test) -> Column:
    return F.coalesce(F.forall("bound", lambda b: test(b)), F.lit(True))


def _strip_bound(c: Corpus, test) -> Corpus:
    return c.with_(agents=c.agents.withColumn("bound", F.filter("bound", test)))


def filter_grounded_only(c: Corpus, remove_bound: bool = False) -> Corpus:
    """Every argument has a reference besides its text. Ungrounded bound partners drop the assertion, or are removed."""
    bound = lambda b: is_grounded(b["db_refs"])
    if remove_bound:
        c = _strip_bound(c, bound)
    ids = _agents_hold(c, is_grounded(F.col("db_refs")) & _bound_ok(bound))
    return _semi(c, ids.union(_no_agents(c)))


def _has_ref(refs: Column, names: Iterable[str]) -> Column:
    return F.coalesce(F.arrays_overlap(F.map_keys(refs), F.array(*(F.lit(n) for n in names))), F.lit(False))


def filter_genes_only(c: Corpus, specific_only: bool = False, remove_bound: bool = False) -> Corpus:
    names = ("HGNC", "UP") if specific_only else ("HGNC", "UP", "FPLX")
    bound = lambda b: _has_ref(b["db_refs"], names)
    if remove_bound:
        c = _strip_bound(c, bound)
    return _semi(c, _agents_hold(c, _has_ref(F.col("db_refs"), names) & _bound_ok(bound)).union(_no_agents(c)))


def filter_belief(c: Corpus, belief_cutoff: float) -> Corpus:
    out = c.keep(c.statements.where(F.col("belief") >= belief_cutoff))
    if c.refinements is None:
        return out
    ids = out.statements.select("stmt_id")
    pairs = c.refinements.join(ids.withColumnRenamed("stmt_id", "refiner"), "refiner", "left_semi").join(ids.withColumnRenamed("stmt_id", "refined"), "refined", "left_semi")
    return out.with_(refinements=pairs.select("refiner", "refined"))


def filter_gene_list(c: Corpus, gene_list: list[str], policy: str, closure: DataFrame | None = None, onto_nodes: DataFrame | None = None, remove_bound: bool = False, invert: bool = False) -> Corpus:
    """Policy ``one`` or ``all`` over argument names. With ``closure`` and ``onto_nodes``, families of the genes count, too."""
    if policy not in ("one", "all"):
        return c
    names = c.spark.createDataFrame([(g,) for g in sorted(set(gene_list))], "g string")
    if closure is not None and onto_nodes is not None:
        up = closure.where("p_ns = 'FPLX'").join(onto_nodes.join(names, F.col("name") == F.col("g"), "left_semi").select("ns", "id"), ["ns", "id"], "left_semi").select(F.col("p_id").alias("g"))
        names = names.union(up).distinct()
    listed = c.agents.select("stmt_id", "idx", "name", F.lit(True).alias("main")).where("name is not null")
    if not remove_bound:
        listed = listed.union(c.agents.select("stmt_id", "idx", F.explode("bound").alias("b")).select("stmt_id", "idx", "b.name", F.lit(False)))
    hit = listed.join(names.withColumn("__in", F.lit(True)), F.col("name") == F.col("g"), "left")
    fold = F.bool_or if policy == "one" else F.bool_and
    ids = hit.groupBy("stmt_id").agg(fold(F.coalesce("__in", F.lit(False))).alias("ok")).where("ok").select("stmt_id")
    return _semi(c, ids, invert)


def filter_concept_names(c: Corpus, name_list: list[str], policy: str, invert: bool = False) -> Corpus:
    if policy not in ("one", "all"):
        return c
    return _semi(c, _agents_hold(c, F.col("name").isin(*name_list), policy), invert)


def filter_by_db_refs(c: Corpus, namespace: str, values: list[str], policy: str, invert: bool = False, match_suffix: bool = False) -> Corpus:
    """Policy ``any`` or ``all`` over arguments whose reference is in ``values``; ``invert`` holds for each argument, and one without the namespace never counts."""
    ref = F.try_element_at("db_refs", F.lit(namespace))
    hit = F.array_contains(F.transform(F.array(*(F.lit(v) for v in values)), lambda v: ref.endswith(v)), True) if match_suffix else ref.isin(*values)
    return _semi(c, _agents_hold(c, ref.isNotNull() & (~hit if invert else hit), "one" if policy in ("one", "any") else "all"))


def filter_human_only(c: Corpus, organisms: DataFrame, remove_bound: bool = False) -> Corpus:
    """``organisms(id, is_human)`` of UP ids: an argument without a UP id passes, one with an id that is not known to be human does not. Bound partners count alike, or are removed with ``remove_bound``."""
    human = organisms.where("is_human").select(F.col("id").alias("up"), F.lit(True).alias("__h")).distinct()
    up = lambda refs: F.try_element_at(refs, F.lit("UP"))
    if remove_bound:
        rows = c.agents.select("stmt_id", "idx", F.posexplode("bound").alias("at", "b")).withColumn("up", up(F.col("b.db_refs")))
        gone = rows.where("up is not null").join(human, "up", "left_anti").groupBy("stmt_id", "idx").agg(F.collect_set("at").alias("__gone"))
        kept = F.filter("bound", lambda b, i: ~F.array_contains("__gone", i))
        c = c.with_(agents=c.agents.join(gone, ["stmt_id", "idx"], "left").withColumn("bound", F.when(F.col("__gone").isNotNull(), kept).otherwise(F.col("bound"))).select(*c.agents.columns))
    every = c.agents.select("stmt_id", up(F.col("db_refs")).alias("up"))
    if not remove_bound:
        every = every.union(c.agents.select("stmt_id", F.explode("bound").alias("b")).select("stmt_id", up(F.col("b.db_refs"))))
    bad = every.where("up is not null").join(human, "up", "left_anti").select("stmt_id")
    return _semi(c, bad, invert=True)


def _by_evidence(c: Corpus, keep: Column, without: bool = True) -> Corpus:
    """``keep``: an aggregate over the evidence of an assertion; ``without``: what becomes of those that have none."""
    told = c.evidence.groupBy("stmt_id").agg(keep.alias("__ok"))
    if without:
        return _semi(c, told.where("not __ok").select("stmt_id"), invert=True)
    return _semi(c, told.where("__ok").select("stmt_id"))


def filter_direct(c: Corpus) -> Corpus:
    return _by_evidence(c, F.coalesce(F.bool_or("direct"), F.lit(True)))


def filter_no_hypothesis(c: Corpus) -> Corpus:
    return _by_evidence(c, ~F.bool_and(F.coalesce("hypothesis", F.lit(False))))


def filter_no_negated(c: Corpus) -> Corpus:
    return _by_evidence(c, ~F.bool_and(F.coalesce("negated", F.lit(False))))


def filter_evidence_source(c: Corpus, source_apis: list[str], policy: str = "one") -> Corpus:
    has = [F.bool_or(F.coalesce(F.col("source_api") == s, F.lit(False))) for s in source_apis]
    one, every = F.lit(False), F.lit(True)
    for h in has:
        one, every = one | h, every & h
    return _by_evidence(c, {"one": one, "all": every, "none": ~one}[policy], without=policy == "none")


def filter_retracted_sources(c: Corpus, retracted: DataFrame) -> Corpus:
    """``retracted(pmid)``: its evidence goes, and assertions with no evidence left."""
    pmid = F.coalesce("pmid", F.try_element_at("text_refs", F.lit("PMID")))
    evidence = c.evidence.withColumn("__pmid", pmid).join(retracted.select(F.col("pmid").alias("__pmid")), "__pmid", "left_anti").select(*c.evidence.columns)
    return _semi(c.with_(evidence=evidence), evidence.select("stmt_id"))


def filter_top_level(c: Corpus) -> Corpus:
    """Assertions that are no general version of another one."""
    return c.keep(c.statements.join(c.refinements.select(F.col("refined").alias("stmt_id")), "stmt_id", "left_anti"))


def filter_inconsequential_mods(c: Corpus, whitelist: dict[str, list[tuple]] | None = None) -> Corpus:
    """Drops modifications of a site that no argument's state ever mentions (or the whitelist: name to (type, residue, position))."""
    used = c.agents.select("name", F.explode("mods").alias("m")).select("name", "m.mod_type", "m.residue", "m.position")
    if whitelist:
        used = used.union(c.spark.createDataFrame([(n, *m) for n, ms in whitelist.items() for m in ms], "name string, mod_type string, residue string, position string"))
    used = used.distinct().withColumnsRenamed({"name": "n", "residue": "r", "position": "p"})
    kinds = F.create_map(*(F.lit(x) for t in ADDING for x in (t, t.lower()))), F.create_map(*(F.lit(x) for t in REMOVING for x in (t, INVERSE[t].lower())))
    mods = c.statements.where(F.col("stmt_type").isin(*ADDING, *REMOVING)).withColumn("k", F.coalesce(F.try_element_at(kinds[0], "stmt_type"), F.try_element_at(kinds[1], "stmt_type")))
    subs = mods.join(c.agents.where("idx = 1").select("stmt_id", "name"), "stmt_id")
    dead = subs.join(used, (F.col("name") == F.col("n")) & (F.col("k") == F.col("mod_type")) & F.col("residue").eqNullSafe(F.col("r")) & F.col("position").eqNullSafe(F.col("p")), "left_anti").select("stmt_id")
    return _semi(c, dead, invert=True)


def filter_inconsequential_acts(c: Corpus, whitelist: dict[str, list[str]] | None = None) -> Corpus:
    used = c.agents.where("activity.is_active is not null").select(F.col("name").alias("n"), F.col("activity.activity_type").alias("a"))
    if whitelist:
        used = used.union(c.spark.createDataFrame([(n, a) for n, v in whitelist.items() for a in v], "n string, a string"))
    acts = c.statements.where(F.col("stmt_type").isin(*descendants("RegulateActivity"))).select("stmt_id", F.coalesce("activity", F.lit("activity")).alias("act")).join(c.agents.where("idx = 1").select("stmt_id", "name"), "stmt_id")
    dead = acts.join(used.distinct(), (F.col("name") == F.col("n")) & (F.col("act") == F.col("a")), "left_anti").select("stmt_id")
    return _semi(c, dead, invert=True)


def filter_inconsequential(c: Corpus, mods: bool = True, acts: bool = True, mod_whitelist=None, act_whitelist=None, checkpoint=lambda df: df.checkpoint()) -> Corpus:
    """Both filters again and again until nothing more goes."""
    before = -1
    while True:
        if mods:
            c = filter_inconsequential_mods(c, mod_whitelist)
        if acts:
            c = filter_inconsequential_acts(c, act_whitelist)
        c = c.with_(statements=checkpoint(c.statements), agents=checkpoint(c.agents))
        now = c.statements.count()
        if now == before:
            return c
        before = now


def get_unreachable_mods(c: Corpus) -> DataFrame:
    """(name, mods): states that arguments are said to have and that no assertion brings about."""
    kinds = F.create_map(*(F.lit(x) for t in ADDING for x in (t, t.lower())))
    made = c.statements.where(F.col("stmt_type").isin(*ADDING)).join(c.agents.where("idx = 1").select("stmt_id", "name"), "stmt_id").select("name", F.element_at(kinds, F.col("stmt_type")).alias("t"), F.coalesce("residue", F.lit("~")).alias("r"), F.coalesce("position", F.lit("~")).alias("p"))
    used = c.agents.select("name", F.explode("mods").alias("m")).select("name", F.col("m.mod_type").alias("t"), F.coalesce("m.residue", F.lit("~")).alias("r"), F.coalesce("m.position", F.lit("~")).alias("p")).distinct()
    return used.join(made, ["name", "t", "r", "p"], "left_anti").groupBy("name").agg(F.array_sort(F.collect_set(F.concat_ws(",", "t", "r", "p"))).alias("mods"))


def filter_mutation_status(c: Corpus, mutations: dict[str, list[tuple[str, str, str]]], deletions: list[str]) -> Corpus:
    """Drops assertions with deleted genes or with mutations that are not listed (name to (from, position, to))."""
    known = {f"{n}|{a}|{p}|{b}" for n, ms in mutations.items() for a, p, b in ms}
    unlisted = F.exists("mutations", lambda m: ~F.concat_ws("|", "name", m["residue_from"], m["position"], m["residue_to"]).isin(*(known or {""})))
    gone = F.col("name").isin(*(deletions or [""])) | F.exists("bound", lambda b: b["name"].isin(*(deletions or [""])))
    return _semi(c, c.agents.where(F.coalesce(unlisted, F.lit(False)) | F.coalesce(gone, F.lit(False))).select("stmt_id"), invert=True)


def _first_name_in(c: Corpus, names: DataFrame) -> DataFrame:
    return c.agents.where("idx = 0").join(names.select(F.col(names.columns[0]).alias("name")), "name", "left_semi").select("stmt_id")


def filter_enzyme_kinase(c: Corpus, kinases: DataFrame) -> Corpus:
    """Phosphorylations need a known kinase as enzyme; all else stays."""
    good = _first_name_in(c, kinases)
    bad = c.statements.where("stmt_type = 'Phosphorylation'").join(good, "stmt_id", "left_anti").select("stmt_id")
    return _semi(c, bad, invert=True)


def filter_mod_nokinase(c: Corpus, kinases: DataFrame) -> Corpus:
    """Modifications other than phosphorylations need an enzyme that is no kinase."""
    others = c.statements.where(F.col("stmt_type").isin(*(t for t in (*ADDING, *REMOVING) if t != "Phosphorylation")))
    named = c.agents.where("idx = 0 and name is not null").select("stmt_id")
    bad = others.join(_first_name_in(c, kinases), "stmt_id", "left_semi").select("stmt_id").union(others.join(named, "stmt_id", "left_anti").select("stmt_id"))
    return _semi(c, bad, invert=True)


def filter_transcription_factor(c: Corpus, factors: DataFrame) -> Corpus:
    bad = c.statements.where(F.col("stmt_type").isin(*descendants("RegulateAmount"))).join(_first_name_in(c, factors), "stmt_id", "left_anti").select("stmt_id")
    return _semi(c, bad, invert=True)


def filter_uuid_list(c: Corpus, ids: DataFrame, invert: bool = True) -> Corpus:
    """Drops the listed stmt_ids, or keeps only them (``invert=False``)."""
    return _semi(c, ids.select(F.col(ids.columns[0]).alias("stmt_id")), invert)


def filter_by_curation(c: Corpus, hashes: DataFrame, curations: DataFrame, incorrect_policy: str = "any", correct_tags: tuple[str, ...] = ("correct",), update_belief: bool = True) -> Corpus:
    """``hashes(stmt_id, mk_hash)``, ``curations(pa_hash, source_hash, tag)`` and evidence with source_hash.

    A correct tag saves the assertion (and sets its belief to 1); else it goes at any incorrect tag, or once all its evidence is incorrect. Evidence tagged
    incorrect goes in any case.
    """
    by = curations.groupBy("pa_hash").agg(F.bool_or(F.col("tag").isin(*correct_tags)).alias("right"), F.bool_or(~F.col("tag").isin(*correct_tags)).alias("wrong"))
    st = c.statements.join(hashes, "stmt_id").join(by, F.col("mk_hash") == F.col("pa_hash"), "left")
    tagged = curations.where(~F.col("tag").isin(*correct_tags)).select("pa_hash", F.col("source_hash").alias("sh")).distinct()
    ev = c.evidence.drop("mk_hash").join(hashes, "stmt_id").join(tagged, (F.col("mk_hash") == F.col("pa_hash")) & (F.col("source_hash") == F.col("sh")), "left_anti").select(*c.evidence.columns)
    right, wrong = F.coalesce("right", F.lit(False)), F.coalesce("wrong", F.lit(False))
    if incorrect_policy == "any":
        st = st.where(right | ~wrong)
    else:
        left = ev.select("stmt_id").distinct().withColumn("__has", F.lit(True))
        st = st.join(left, "stmt_id", "left").where(right | ~wrong | F.coalesce("__has", F.lit(False)))
    if update_belief:
        st = st.withColumn("belief", F.when(right, 1.0).otherwise(F.col("belief")))
    return c.with_(evidence=ev).keep(st.select(*c.statements.columns))


def filter_complexes_by_size(c: Corpus, members_allowed: int = 5) -> Corpus:
    large = c.agents.groupBy("stmt_id").agg(F.count("*").alias("n")).where(F.col("n") > members_allowed).select("stmt_id")
    bad = c.statements.where(F.col("stmt_type").isin(*SYMMETRIC)).join(large, "stmt_id", "left_semi").select("stmt_id")
    return _semi(c, bad, invert=True)


def filter_db_highbelief(c: Corpus, db_names: list[str], belief_cutoff: float) -> Corpus:
    """Belief at the cutoff, or evidence of one of the databases."""
    from_db = c.evidence.where(F.col("source_api").isin(*db_names)).select("stmt_id").distinct().withColumn("__db", F.lit(True))
    return c.keep(c.statements.join(from_db, "stmt_id", "left").where((F.col("belief") >= belief_cutoff) | F.coalesce("__db", F.lit(False))).select(*c.statements.columns))


def validation_report(c: Corpus, patterns: DataFrame) -> DataFrame:
    """(stmt_id, violation): unknown namespaces, ids that don't match ``patterns(ns, pattern)``, wrong argument counts, bad text references."""
    refs = c.agents.select("stmt_id", F.explode("db_refs").alias("ns", "id")).where(~F.col("ns").isin(*TEXT_NS))
    told = refs.join(F.broadcast(patterns), "ns", "left")
    bad_ref = told.where(F.col("pattern").isNull() | ~F.expr("id rlike pattern")).select("stmt_id", F.when(F.col("pattern").isNull(), F.concat(F.lit("unknown namespace "), "ns")).otherwise(F.concat(F.lit("bad id "), "ns", F.lit(":"), "id")).alias("violation"))
    n = c.agents.where("name is not null").groupBy("stmt_id").agg(F.count("*").alias("n"))
    need = F.when(F.col("stmt_type").isin(*SYMMETRIC, *descendants("RegulateActivity"), "Gef", "Gap", "Influence"), 2).otherwise(1)
    few = c.statements.join(n, "stmt_id", "left").where(F.coalesce("n", F.lit(0)) < need).select("stmt_id", F.lit("missing argument").alias("violation"))
    ev = c.evidence.where("pmid is not null and not pmid rlike '^[0-9]+$'").select("stmt_id", F.lit("bad pmid").alias("violation"))
    return bad_ref.union(few).union(ev).distinct()
