"""Whole recipes over a corpus, and the places where a caller's own functions go.

``matches``, ``RefinementFilter``, ``Scorer`` and ``Grounder`` are the hooks: an own key of identity, own conditions on refinements, own beliefs, an own
recogniser of texts. Hooks work on DataFrames (a grounder on Arrow batches of distinct texts), never on one row at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import statement_keys
from ..runtime import checkpoint
from ..schema import NS_ORDER, Corpus, exploded
from . import belief, mechanisms, preassembly
from .filters import filter_by_type

# identity


def combine_by(c: Corpus, matches: Callable[[Corpus], DataFrame]) -> Corpus:
    """Duplicates by a caller's key: ``matches(c)`` gives (stmt_id, key). The head is the least stmt_id; evidence is united and equal evidence kept once."""
    from ..functions.keys import evidence_key

    keys = matches(c).select("stmt_id", "key")
    to = keys.groupBy("key").agg(F.min("stmt_id").alias("__to"))
    ids = keys.join(to, "key").select("stmt_id", "__to")
    heads = to.select(F.col("__to").alias("stmt_id"))
    statements = c.statements.drop("ev").join(heads, "stmt_id", "left_semi").dropDuplicates(["stmt_id"])
    agents = exploded(statements, "args") if "args" in statements.columns else c.agents.join(heads, "stmt_id", "left_semi").dropDuplicates(["stmt_id", "idx"])
    evidence = c.evidence.join(ids, "stmt_id").withColumn("stmt_id", F.col("__to")).withColumn("__k", evidence_key()).dropDuplicates(["stmt_id", "__k"]).drop("__to", "__k")
    return replace(c, statements=statements, agents=agents, evidence=evidence)


# refinements


class RefinementFilter:
    """A condition on refinements. ``pairs`` gives candidates (refiner, refined) from those of the filters before it (null for the first)."""

    def pairs(self, c: Corpus, given: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def more_specific(self, c: Corpus, ids: DataFrame) -> DataFrame:
        return self.pairs(c).join(ids.select(F.col("stmt_id").alias("refined")), "refined", "left_semi").select(F.col("refined").alias("stmt_id"), F.col("refiner").alias("other"))

    def less_specific(self, c: Corpus, ids: DataFrame) -> DataFrame:
        return self.pairs(c).join(ids.select(F.col("stmt_id").alias("refiner")), "refiner", "left_semi").select(F.col("refiner").alias("stmt_id"), F.col("refined").alias("other"))

    def related(self, c: Corpus, ids: DataFrame) -> DataFrame:
        return self.more_specific(c, ids).union(self.less_specific(c, ids)).distinct()


@dataclass
class OntologyFilter(RefinementFilter):
    """The whole rule: entities, states and sites over a closed ontology."""

    closed: DataFrame
    with_state: bool = True

    def pairs(self, c: Corpus, given: DataFrame | None = None) -> DataFrame:
        found = preassembly.refinements(c, self.closed, self.with_state)
        return found if given is None else found.join(given, ["refiner", "refined"], "left_semi")

    def extend(self, old: Corpus, known: DataFrame, new: Corpus) -> tuple[Corpus, DataFrame]:
        """A corpus with further assertions and its pairs: those known, and those with a new assertion on either side (old ones are not compared again)."""
        cols = [x for x in old.statements.columns if x in new.statements.columns and x not in ("args", "ev")]
        both = Corpus(old.statements.select(*cols).unionByName(new.statements.select(*cols)), old.agents.unionByName(new.agents), old.evidence.unionByName(new.evidence, allowMissingColumns=True))
        fresh = new.statements.select(F.col("stmt_id").alias("n"))
        touch = lambda p: p.join(fresh.withColumnRenamed("n", "refiner").withColumn("__a", F.lit(1)), "refiner", "left").join(fresh.withColumnRenamed("n", "refined").withColumn("__b", F.lit(1)), "refined", "left").where("__a is not null or __b is not null").select("refiner", "refined")
        more = preassembly.refinements(both, self.closed, self.with_state, also=touch)
        return both.with_(refinements=known.unionByName(more).distinct()), known.unionByName(more).distinct()


@dataclass
class SplitFilter(RefinementFilter):
    """Only pairs across groups: ``sides(stmt_id, side)``."""

    sides: DataFrame

    def pairs(self, c: Corpus, given: DataFrame | None = None) -> DataFrame:
        if given is None:
            raise ValueError("a split needs the pairs of another filter before it")
        a, b = (self.sides.select(F.col("stmt_id").alias(n), F.col("side").alias(f"__{n}")) for n in ("refiner", "refined"))
        return given.join(a, "refiner").join(b, "refined").where("__refiner <> __refined").select("refiner", "refined")


@dataclass
class ConditionFilter(RefinementFilter):
    """A caller's condition over the two assertions' columns, named ``s_*`` (specific) and ``g_*`` (general)."""

    condition: Column
    columns: tuple[str, ...] = ("stmt_type", "residue", "position", "activity", "belief")

    def pairs(self, c: Corpus, given: DataFrame | None = None) -> DataFrame:
        if given is None:
            raise ValueError("a condition needs the pairs of another filter before it")
        side = lambda n, p: c.statements.select(F.col("stmt_id").alias(n), *(F.col(x).alias(f"{p}_{x}") for x in self.columns))
        return given.join(side("refiner", "s"), "refiner").join(side("refined", "g"), "refined").where(self.condition).select("refiner", "refined")


def refine(c: Corpus, filters: list[RefinementFilter]) -> DataFrame:
    """Pairs that all filters leave, in their order."""
    return reduce(lambda found, f: f.pairs(c, found), filters[1:], filters[0].pairs(c))


def refinements_graph(c: Corpus, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(mk_hash, belief), edges(specific, general)) by hash."""
    keys = statement_keys(c).select("stmt_id", "mk_hash", "belief")
    edges = pairs.join(keys.select(F.col("stmt_id").alias("refiner"), F.col("mk_hash").alias("specific")), "refiner").join(keys.select(F.col("stmt_id").alias("refined"), F.col("mk_hash").alias("general")), "refined").select("specific", "general").distinct()
    return keys.groupBy("mk_hash").agg(F.max("belief").alias("belief")), edges


def extend_refinements_graph(nodes: DataFrame, edges: DataFrame, new: DataFrame, less_specific: DataFrame) -> tuple[DataFrame, DataFrame]:
    """With ``new(mk_hash, belief)`` and edges to what they refine, ``less_specific(specific, general)``."""
    return nodes.unionByName(new).dropDuplicates(["mk_hash"]), edges.unionByName(less_specific).distinct()


def ranked_statements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(mk_hash, rank): longest way down to an assertion that nothing refines, so every assertion comes after those that refine it. Rounds go on to the fixed point; a cycle is an error."""
    e = checkpoint(edges)
    rank = checkpoint(nodes.select("mk_hash", F.lit(0).alias("rank")))
    moved, rounds, most = True, 0, nodes.count()
    while moved:
        up = rank.join(e.withColumnRenamed("specific", "mk_hash"), "mk_hash").groupBy(F.col("general").alias("mk_hash")).agg((F.max("rank") + 1).alias("new"))
        both = checkpoint(rank.join(up, "mk_hash", "left").select("mk_hash", "rank", F.greatest("rank", F.coalesce("new", F.lit(0))).alias("new")))
        moved, rounds = not both.where("new > rank").isEmpty(), rounds + 1
        rank = both.select("mk_hash", F.col("new").alias("rank"))
        if rounds > most:
            raise ValueError("refinements have a cycle")
    return rank


# beliefs


class Scorer:
    """Beliefs from a corpus: (stmt_id, belief). ``check`` tells of sources that it has no rates for."""

    def score(self, c: Corpus) -> DataFrame:
        raise NotImplementedError

    def check(self, c: Corpus) -> None:
        return None


@dataclass
class SimpleScorer(Scorer):
    priors: DataFrame | None = None
    subtypes: DataFrame | None = None

    def score(self, c: Corpus) -> DataFrame:
        return belief.score_evidence(c.evidence, self.priors if self.priors is not None else belief.priors(c.spark), self.subtypes)

    def check(self, c: Corpus) -> None:
        belief.check_priors(c.evidence, self.priors if self.priors is not None else belief.priors(c.spark))


@dataclass
class LearnedScorer(Scorer):
    """A fitted model over ``belief.features``."""

    model: object
    sources: list[str]

    def score(self, c: Corpus) -> DataFrame:
        return belief.predict_proba(self.model, belief.features(c, self.sources)).select("stmt_id", F.col("probability").alias("belief"))

    def log_score(self, c: Corpus) -> DataFrame:
        return self.score(c).withColumn("belief", F.log("belief"))

    def predict(self, c: Corpus) -> DataFrame:
        return self.score(c).select("stmt_id", (F.col("belief") >= 0.5).cast("int").alias("label"))


@dataclass
class HybridScorer(Scorer):
    first: Scorer
    second: Scorer

    def score(self, c: Corpus) -> DataFrame:
        return belief.hybrid(self.first.score(c), self.second.score(c))


def noise_prior(evidence: DataFrame, types: DataFrame, subtypes: DataFrame | None = None) -> DataFrame:
    """``evidence`` with ``prior``: the random error of its subtype (``subtypes(source_api, subtype, rand)``), else of its source (``types(source_api, rand)``)."""
    out = evidence.withColumn("subtype", belief.evidence_subtype()).join(types.select("source_api", F.col("rand").alias("__t")), "source_api", "left")
    if subtypes is None:
        return out.withColumn("prior", F.col("__t")).drop("__t")
    return out.join(subtypes.select("source_api", "subtype", F.col("rand").alias("__s")), ["source_api", "subtype"], "left").withColumn("prior", F.coalesce("__s", "__t")).drop("__s", "__t")


def hierarchy_probs(c: Corpus, scorer: Scorer | None = None) -> DataFrame:
    """(mk_hash, belief) from an assertion's own evidence and that of all that refine it."""
    ev = belief.hierarchy_evidence(c)
    scores = (scorer or SimpleScorer()).score(replace(c, evidence=ev))
    return statement_keys(c).select("stmt_id", "mk_hash").join(scores, "stmt_id", "left").select("mk_hash", F.coalesce("belief", F.lit(0.0)).alias("belief"))


# recipes


def run_preassembly_duplicate(c: Corpus, scorer: Scorer | None = None, matches: Callable[[Corpus], DataFrame] | None = None) -> Corpus:
    merged = preassembly.combine_duplicates(c) if matches is None else combine_by(c, matches)
    return belief.with_belief(merged, (scorer or SimpleScorer()).score(merged))


def run_preassembly_related(c: Corpus, filters: list[RefinementFilter], scorer: Scorer | None = None, return_toplevel: bool = True, flatten_evidence: bool = False, flatten_evidence_collect_from: str = "supported_by", belief_cutoff: float | None = None) -> Corpus:
    """Refinements by the filters, beliefs along them, and, if asked for, evidence along them, a cutoff, and only what refines nothing else."""
    linked = c.with_(refinements=checkpoint(refine(c, filters)))
    scores = (scorer or SimpleScorer()).score(replace(linked, evidence=belief.hierarchy_evidence(linked)))
    out = belief.with_belief(linked, scores)
    if flatten_evidence:
        out = out.with_(evidence=preassembly.flatten_evidence(out, flatten_evidence_collect_from).drop("support_type"))
    if return_toplevel:
        out = out.keep(out.statements.join(out.refinements.select(F.col("refined").alias("stmt_id")), "stmt_id", "left_anti")).with_(refinements=out.refinements)
    if belief_cutoff is not None:
        from .filters import filter_belief

        out = filter_belief(out, belief_cutoff)
    return out


def run_preassembly(c: Corpus, closed: DataFrame, return_toplevel: bool = True, scorer: Scorer | None = None, matches: Callable[[Corpus], DataFrame] | None = None, extra_filters: list[RefinementFilter] | None = None, flatten_evidence: bool = False, flatten_evidence_collect_from: str = "supported_by", run_refinement: bool = True, belief_cutoff: float | None = None) -> Corpus:
    """Duplicates, then refinements, with beliefs at either step."""
    unique = run_preassembly_duplicate(c, scorer, matches)
    if not run_refinement:
        return unique
    return run_preassembly_related(unique, [OntologyFilter(closed), *(extra_filters or [])], scorer, return_toplevel, flatten_evidence, flatten_evidence_collect_from, belief_cutoff)


def run_mechlinker(c: Corpus, reduce_activities: bool = False, reduce_modifications: bool = False, replace_activations: bool = False, require_active_forms: bool = False) -> Corpus:
    """Steps in this order, each only if asked for."""
    if reduce_activities:
        c = mechanisms.reduce_activities(c)
    if reduce_modifications:
        sites = mechanisms.reduce_modifications(c).select("stmt_id", F.col("residue").alias("__r"), F.col("position").alias("__p"))
        st = c.statements.join(sites, "stmt_id", "left").withColumn("residue", F.coalesce("__r", "residue")).withColumn("position", F.coalesce("__p", "position")).drop("__r", "__p")
        c = c.with_(statements=st)
    if replace_activations:
        c = mechanisms.replace_activations(c)
    return mechanisms.require_active_forms(c) if require_active_forms else c


def gene_network(parts: list[Corpus], closed: DataFrame, genes: list[str], policy: str = "all") -> Corpus:
    """Several sources' assertions among the given genes, put together, preassembled, the most specific kept."""
    from .filters import filter_gene_list, filter_grounded_only

    whole = united(parts)
    return run_preassembly(filter_gene_list(filter_grounded_only(whole), genes, policy), closed)


def united(parts: list[Corpus]) -> Corpus:
    cols = [x for x in parts[0].statements.columns if x not in ("args", "ev") and all(x in p.statements.columns for p in parts)]
    return Corpus(reduce(DataFrame.unionByName, (p.statements.select(*cols) for p in parts)), reduce(DataFrame.unionByName, (p.agents for p in parts)), reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (p.evidence for p in parts)))


def subnetwork(c: Corpus, nodes: DataFrame) -> Corpus:
    """Assertions all of whose arguments are among ``nodes(name)``."""
    known = nodes.select("name", F.lit(True).alias("__in")).distinct()
    ok = c.agents.where("name is not null").join(known, "name", "left").groupBy("stmt_id").agg(F.bool_and(F.coalesce("__in", F.lit(False))).alias("ok")).where("ok").select("stmt_id")
    return c.keep(c.statements.join(ok, "stmt_id", "left_semi"))


def relevant(c: Corpus, prior: DataFrame, policy: str | None = None) -> Corpus:
    """``prior_one``: one argument at least is of the prior's ``prior(name)``; ``prior_all``: all are; else all assertions."""
    if policy not in ("prior_one", "prior_all"):
        return c
    if policy == "prior_all":
        return subnetwork(c, prior)
    ids = c.agents.join(prior.select("name").distinct(), "name", "left_semi").select("stmt_id")
    return c.keep(c.statements.join(ids, "stmt_id", "left_semi"))


def normalize_active_forms(c: Corpus) -> Corpus:
    """Active forms without a modification or mutation go, equal ones of the rest are merged; all else stays."""
    has = c.agents.where("size(coalesce(mods, array())) > 0 or size(coalesce(mutations, array())) > 0").select("stmt_id")
    forms = filter_by_type(c, "ActiveForm")
    forms = preassembly.combine_duplicates(forms.keep(forms.statements.join(has, "stmt_id", "left_semi")))
    return united([filter_by_type(c, "ActiveForm", invert=True), forms])


def replace_activities(c: Corpus) -> Corpus:
    """An argument's plain activity flag becomes each of its known active (or inactive) forms; the combinations are assertions of their own, and the flag stays where no form is known."""
    forms = filter_by_type(c, "ActiveForm").agents.select("stmt_id", "name", F.col("mods").alias("f_mods"), F.col("mutations").alias("f_mutations"))
    known = forms.join(c.statements.select("stmt_id", F.col("is_active").alias("f_active"), F.col("activity").alias("f_type")), "stmt_id").select("name", "f_type", "f_active", "f_mods", "f_mutations").where("f_mods is not null or f_mutations is not null")
    rest = filter_by_type(c, "ActiveForm", invert=True)
    a = rest.agents
    own = [x for x in a.columns if x != "stmt_id"]
    hit = a.join(known.withColumnRenamed("name", "__n"), (a["name"] == F.col("__n")) & (a["activity"]["is_active"] == F.col("f_active")) & (a["activity"]["activity_type"] == F.col("f_type")), "left")
    found = F.col("__n").isNotNull()
    merged = lambda x: F.when(found, F.array_union(F.coalesce(x, F.filter(F.col(f"f_{x}"), lambda y: F.lit(False))), F.coalesce(f"f_{x}", F.col(x)))).otherwise(F.col(x))
    opts = hit.withColumn("mods", merged("mods")).withColumn("mutations", merged("mutations")).withColumn("activity", F.when(~found, F.col("activity"))).select("stmt_id", *own)
    choices = opts.groupBy("stmt_id", "idx").agg(F.collect_list(F.struct(*own)).alias("o")).groupBy("stmt_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", "o"))).alias("c"))
    lists = F.transform(F.array_sort(F.map_keys("c")), lambda i: F.element_at("c", i))
    product = lambda acc, o: F.flatten(F.transform(acc, lambda done: F.transform(o, lambda x: F.concat(done, F.array(x)))))
    none = F.filter(F.element_at(F.map_values("c"), 1), lambda x: F.lit(False))
    every = choices.select("stmt_id", F.posexplode(F.aggregate(lists, F.array(none), product)).alias("k", "x"))
    combo = rest.statements.select("stmt_id").distinct().join(every, "stmt_id", "left").withColumn("new", F.when(F.coalesce("k", F.lit(0)) == 0, F.col("stmt_id")).otherwise(F.xxhash64("stmt_id", "k")))
    agents = combo.select(F.col("new").alias("stmt_id"), F.explode("x").alias("x")).select("stmt_id", "x.*").select(*a.columns)
    ids = combo.select("stmt_id", "new")
    move = lambda df: df.join(ids, "stmt_id").withColumn("stmt_id", F.col("new")).drop("new")
    return rest.with_(statements=move(rest.statements.drop("args", "ev")), agents=agents, evidence=move(rest.evidence), refinements=None)


def apply_state(agents: DataFrame, states: DataFrame) -> DataFrame:
    """Arguments with the states of ``states(name, mods, mutations, bound, location)`` added to their own, by name."""
    s = states.select("name", *(F.col(x).alias(f"__{x}") for x in ("mods", "mutations", "bound", "location")))
    out = agents.join(s, "name", "left")
    for x in ("mods", "mutations"):
        out = out.withColumn(x, F.when(F.col(f"__{x}").isNull(), F.col(x)).when(F.col(x).isNull(), F.col(f"__{x}")).otherwise(F.array_union(x, f"__{x}")))
    out = out.withColumn("bound", F.when(F.col("__bound").isNull(), F.col("bound")).when(F.col("bound").isNull(), F.col("__bound")).otherwise(F.concat("bound", "__bound")))
    return out.withColumn("location", F.coalesce("location", "__location")).select(*agents.columns)


def implicit_activities(c: Corpus) -> DataFrame:
    """(name, activity): activities that assertions imply of their subjects: kinase of what phosphorylates, phosphatase of what removes that, catalytic of other modifications, gef, gap, and transcription of what changes amounts."""
    kind = (
        F.when(F.col("stmt_type") == "Phosphorylation", "kinase").when(F.col("stmt_type") == "Dephosphorylation", "phosphatase")
        .when(F.col("stmt_type").endswith("ation") & ~F.col("stmt_type").isin("Activation", "GtpActivation", "Translocation", "Association", "Conversion", "Migration"), "catalytic")
        .when(F.col("stmt_type") == "Gef", "gef").when(F.col("stmt_type") == "Gap", "gap").when(F.col("stmt_type").isin("IncreaseAmount", "DecreaseAmount"), "transcription")
    )
    first = c.agents.where("idx = 0 and name is not null").select("stmt_id", "name")
    return c.statements.select("stmt_id", kind.alias("activity")).where("activity is not null").join(first, "stmt_id").select("name", "activity").distinct()


def expanded_complexes(closed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ns, id, members): complexes of the hierarchy whose members that have members of their own are replaced by these, to the last."""
    leaves = closed.join(closed.select(F.col("p_ns").alias("ns"), F.col("p_id").alias("id")).distinct(), ["ns", "id"], "left_anti")
    named = leaves.join(nodes.select("ns", "id", "name"), ["ns", "id"], "left")
    return named.groupBy(F.col("p_ns").alias("ns"), F.col("p_id").alias("id")).agg(F.array_sort(F.collect_set(F.coalesce("name", F.concat_ws(":", leaves["ns"], leaves["id"])))).alias("members"))


def prioritize(ns1: Column, ns2: Column, order: tuple[str, ...] = NS_ORDER) -> Column:
    """-1 where the first namespace comes before the second in the order, 1 where it comes after, 0 for equal ones; unknown ones come last."""
    rank = lambda n: F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(x) for x in order)), n), F.lit(0)), F.lit(len(order) + 1))
    return F.when(ns1 == ns2, 0).when(rank(ns1) < rank(ns2), -1).when(rank(ns1) > rank(ns2), 1).otherwise(0)


# grounding by a caller's recogniser


def ground(c: Corpus, grounder: Callable[[list[str]], list[dict[str, str] | None]], ungrounded_only: bool = False, context: DataFrame | None = None) -> Corpus:
    """References from a recogniser of texts, which gets batches of distinct texts (with ``context(text, context)``, texts with a tab and their context) and gives references or None."""
    from ..functions.keys import is_grounded

    text = F.try_element_at("db_refs", F.lit("TEXT"))
    a = c.agents.withColumn("__t", text)
    wanted = a.where(F.col("__t").isNotNull() & (~is_grounded(F.col("db_refs")) if ungrounded_only else F.lit(True))).select(F.col("__t").alias("text")).distinct()
    asked = wanted.withColumn("ask", F.col("text"))
    if context is not None:
        asked = wanted.join(context.select("text", "context"), "text", "left").withColumn("ask", F.concat_ws("\t", "text", "context"))

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"text": pdf["text"], "refs": [list(r.items()) if r else None for r in grounder(pdf["ask"].tolist())]})

    found = asked.select("text", "ask").mapInPandas(batches, "text string, refs array<struct<k:string,v:string>>").where("refs is not null").select(F.col("text").alias("__t"), F.map_from_entries("refs").alias("__refs"))
    keep = is_grounded(F.col("db_refs")) if ungrounded_only else F.lit(False)
    new = F.map_concat(F.map_filter("__refs", lambda k, v: k != "TEXT"), F.create_map(F.lit("TEXT"), F.col("__t")))
    out = a.join(found, "__t", "left").withColumn("db_refs", F.when(F.col("__refs").isNotNull() & ~keep, new).otherwise(F.col("db_refs")))
    return c.with_(agents=out.select(*c.agents.columns))


def agent_matches(pairs_: Column, other: Column) -> Column:
    """Whether two arrays of argument keys agree in every place, an absent one (null) with anything."""
    return (F.size(pairs_) == F.size(other)) & F.forall(F.zip_with(pairs_, other, lambda x, y: x.isNull() | y.isNull() | (x == y)), lambda ok: ok)


# incremental assembly


def incremental(old: Corpus, known: DataFrame, new: Corpus, closed: DataFrame, scorer: Scorer | None = None) -> Corpus:
    """New assertions put to an assembled corpus: duplicates meet their heads, only pairs with a new assertion are compared, beliefs are worked out again."""
    merged = preassembly.combine_duplicates(united([old.with_(refinements=None), new]))
    heads = merged.statements.select("stmt_id")
    old_ids = old.statements.select("stmt_id")
    fresh = checkpoint(heads.join(old_ids, "stmt_id", "left_anti"))
    still = known.join(heads.withColumnRenamed("stmt_id", "refiner"), "refiner", "left_semi").join(heads.withColumnRenamed("stmt_id", "refined"), "refined", "left_semi").select("refiner", "refined")
    mark = lambda n: fresh.select(F.col("stmt_id").alias(n), F.lit(1).alias(f"__{n}"))
    touch = lambda p: p.join(mark("refiner"), "refiner", "left").join(mark("refined"), "refined", "left").where("__refiner is not null or __refined is not null").select("refiner", "refined")
    pairs = checkpoint(still.unionByName(preassembly.refinements(merged, closed, also=touch)).distinct())
    linked = merged.with_(refinements=pairs)
    return belief.with_belief(linked, (scorer or SimpleScorer()).score(replace(linked, evidence=belief.hierarchy_evidence(linked))))
