"""Refinement matching, families, recipes, hooks, concepts, sentences, rules, look-ups, ontology tables, literature and reader output."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from claimgrid.functions import identifiers
from claimgrid.functions.keys import statement_keys
from claimgrid.operators import analysis, assembly, concepts, english, lookups, network, ontology, preassembly, rules, transforms
from claimgrid.schema import ACT, AGENTS, BOUND, EVIDENCE, MOD, MUT, ONTO_EDGES, ONTO_NODES, STATEMENTS, Corpus, exploded, packed
from claimgrid.sources import literature, ontology_tables
from claimgrid.sources.reach import documents, entities, event_counts, reach


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """Small tables and long expressions: interpreting them is faster than compiling them. The registered queries are tested compiled."""
    conf = {"spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def stmt(i, kind, residue=None, position=None, activity=None, is_active=None, a=None, b=None):
    return (i, kind, residue, position, activity, is_active, a, b, None)


def agent(i, idx, name, refs=None, mods=None, muts=None, bound=None, activity=None, location=None, role=None):
    return (i, role or ("subj", "obj")[min(idx, 1)], idx, name, refs or {"TEXT": name}, mods, muts, bound, activity, location)


def ev(i, source="reach", ord_=0, text=None, pmid="1", direct=None):
    return (i, ord_, source, f"{i}-{ord_}", pmid, text, None, None, direct, None, None)


def corpus(spark, statements, agents, evidence=()):
    return Corpus(spark.createDataFrame(statements, STATEMENTS), spark.createDataFrame(agents, AGENTS), spark.createDataFrame(list(evidence), EVIDENCE))


def ids(c):
    return sorted(r[0] for r in c.statements.select("stmt_id").collect())


def pairs(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def closed(spark):
    return ontology.closure(spark.createDataFrame([("HGNC", "1", "FPLX", "MEK", "isa"), ("HGNC", "2", "FPLX", "MEK", "isa"), ("FPLX", "MEK", "FPLX", "ROOT", "isa"), ("HGNC", "3", "FPLX", "ROOT", "isa")], ONTO_EDGES))


G = {k: {"HGNC": str(k)} for k in range(1, 6)} | {"MEK": {"FPLX": "MEK"}, "ROOT": {"FPLX": "ROOT"}}
UP = {1: {"MEK", "ROOT"}, 2: {"MEK", "ROOT"}, 3: {"ROOT"}, "MEK": {"ROOT"}}


def test_complex_refinement_matches_members(spark, closed):
    rng = random.Random(5)
    members = [(1, 2, 3), ("MEK", "MEK", "ROOT"), (1, 4, 5), ("ROOT", "ROOT", "ROOT"), (3, 3, "MEK"), (1, 2), ("MEK", "ROOT"), (2, 1, 1, 3), ("MEK", "MEK", "MEK", "ROOT"), (4, "MEK", 5), ("ROOT", 4, 5)]
    members += [tuple(rng.choice(list(G)) for _ in range(rng.randint(2, 4))) for _ in range(20)]
    members = [m for i, m in enumerate(members) if sorted(map(str, m)) not in [sorted(map(str, o)) for o in members[:i]]]
    c = corpus(spark, [stmt(i, "Complex") for i in range(len(members))], [agent(i, k, str(x), G[x]) for i, m in enumerate(members) for k, x in enumerate(m)])
    above = lambda s, g: s == g or g in UP.get(s, ())
    fits = lambda a, b: len(a) == len(b) and any(all(above(s, g) for s, g in zip(p, b, strict=True)) for p in itertools.permutations(a))
    want = sorted((i, j) for i, a in enumerate(members) for j, b in enumerate(members) if i != j and fits(a, b) and not fits(b, a))
    assert pairs(preassembly.refinements(c, closed)) == want


def test_states_are_part_of_the_match(spark, closed):
    p = lambda res, pos: [("phosphorylation", res, pos, True)]
    rows = [agent(1, 0, "x", G[4], p("S", "222")), agent(1, 1, "y", G[5]), agent(2, 0, "y", G[5]), agent(2, 1, "x", G[4], p(None, None)), agent(3, 0, "y", G[5], p(None, None)), agent(3, 1, "x", G[4])]
    rows += [agent(4, 0, "x", G[4], p("S", "222")), agent(4, 1, "y", G[5]), agent(5, 0, "x", G[4]), agent(5, 1, "y", G[5])]
    rows += [agent(6, 0, "x", G[4], bound=[("z", {"HGNC": "9"}, True)], location="nucleus"), agent(6, 1, "y", G[5]), agent(7, 0, "x", G[4], bound=[("z", {"HGNC": "9"}, False)]), agent(7, 1, "y", G[5])]
    c = corpus(spark, [stmt(i, "Complex") for i in (1, 2, 3)] + [stmt(i, "Activation") for i in (4, 5, 6, 7)], rows)
    assert pairs(preassembly.refinements(c, closed)) == [(1, 2), (4, 5), (6, 5), (7, 5)]
    assert pairs(preassembly.refinements(c, closed, also=lambda x: x.where("refiner <> 6"))) == [(1, 2), (4, 5), (7, 5)]


def test_families_expand_in_every_place(spark, closed):
    nodes = spark.createDataFrame([("HGNC", str(i), f"M{i}", "gene", False, None) for i in (1, 2, 3)], ONTO_NODES)
    c = corpus(spark, [stmt(1, "Complex"), stmt(2, "Activation"), stmt(3, "Phosphorylation")], [agent(1, 0, "A", G[4]), agent(1, 1, "B", G[5]), agent(1, 2, "MEK", G["MEK"]), agent(2, 0, "MEK", G["MEK"]), agent(2, 1, "MEK", G["MEK"]), agent(3, 1, "A", G[4])], [ev(1), ev(2)])
    e = transforms.expand_families(c, closed, nodes)
    got = sorted(tuple(sorted((r["idx"], r["name"]) for r in g)) for _, g in itertools.groupby(e.agents.orderBy("stmt_id").collect(), key=lambda r: r["stmt_id"]))
    assert got == sorted([((0, "A"), (1, "B"), (2, "M1")), ((0, "A"), (1, "B"), (2, "M2")), *(((0, f"M{i}"), (1, f"M{j}")) for i in (1, 2) for j in (1, 2)), ((1, "A"),)])
    assert e.statements.count() == 7 and e.evidence.count() == 6 and e.statements.select("stmt_id").distinct().count() == 7


def test_packed_corpora_give_the_same(spark, closed):
    loose = corpus(spark, [stmt(1, "Complex"), stmt(2, "Complex"), stmt(2, "Complex"), stmt(3, "Phosphorylation", "S", "5")], [agent(1, 0, "x", G[1], mods=[("phosphorylation", "S", "1", True)]), agent(1, 1, "y", G[2]), agent(2, 0, "y", G[2]), agent(2, 1, "x", G[1], mods=[("phosphorylation", "S", "1", True)]), agent(3, 0, "x", G[1]), agent(3, 1, "y", G[2])], [ev(1), ev(2, "biopax"), ev(2, "biopax", 1), ev(3)])
    cols = [c for c in loose.agents.columns if c != "stmt_id"]
    evs = [c for c in loose.evidence.columns if c != "stmt_id"]
    tight = packed(loose.statements.join(loose.agents.groupBy("stmt_id").agg(F.collect_list(F.struct(*cols)).alias("args")), "stmt_id").join(loose.evidence.groupBy("stmt_id").agg(F.collect_list(F.struct(*evs)).alias("ev")), "stmt_id"))
    key = lambda c: sorted(map(tuple, statement_keys(c).select("stmt_id", "mk", "mk_hash").distinct().collect()))
    assert key(loose) == key(tight)
    for c in (loose, tight):
        d = preassembly.combine_duplicates(c)
        assert ids(d) == [1, 3] and d.evidence.where("stmt_id = 1").count() == 3 and d.agents.count() == 4 and d.evidence.select("mk_hash").distinct().count() == 2
        assert network.edges(d).count() == 3
    moved = tight.with_(agents=tight.agents.withColumn("name", F.lit("z")))
    assert "args" not in moved.statements.columns and moved.agents.select("name").distinct().count() == 1
    assert exploded(tight.keep(tight.statements.where("stmt_id = 3")).statements, "args").count() == 2


def test_recipes_and_hooks(spark, closed):
    c = corpus(spark, [stmt(1, "Phosphorylation", "S", "5"), stmt(2, "Phosphorylation"), stmt(3, "Phosphorylation", "S", "5"), stmt(4, "Activation")], [a for i, s in ((1, 1), (2, "MEK"), (3, 1), (4, 3)) for a in (agent(i, 0, str(s), G[s]), agent(i, 1, "t", G[5]))], [ev(1), ev(2, "signor"), ev(3, "biopax"), ev(4)])
    out = assembly.run_preassembly(c, closed)
    assert ids(out) == [1, 4] and pairs(out.refinements) == [(1, 2)]
    every = assembly.run_preassembly(c, closed, return_toplevel=False, flatten_evidence=True)
    assert every.evidence.where("stmt_id = 2").count() == 3 and ids(assembly.run_preassembly(c, closed, run_refinement=False)) == [1, 2, 4]
    by_type = assembly.combine_by(c, lambda c: c.statements.select("stmt_id", F.col("stmt_type").alias("key")))
    assert ids(by_type) == [1, 4] and by_type.evidence.where("stmt_id = 1").count() == 3
    only = assembly.ConditionFilter(F.col("s_residue").isNotNull() & F.col("g_residue").isNotNull())
    assert pairs(assembly.refine(every, [assembly.OntologyFilter(closed), only])) == []
    sides = spark.createDataFrame([(1, "a"), (2, "b"), (4, "a")], "stmt_id long, side string")
    assert pairs(assembly.refine(every, [assembly.OntologyFilter(closed), assembly.SplitFilter(sides)])) == [(1, 2)]
    nodes, edges = assembly.refinements_graph(every, every.refinements)
    rank = {r["mk_hash"]: r["rank"] for r in assembly.ranked_statements(nodes, edges).collect()}
    assert sorted(rank.values()) == [0, 0, 1]
    with pytest.raises(ValueError):
        assembly.ranked_statements(nodes, edges.union(edges.select(F.col("general").alias("specific"), F.col("specific").alias("general"))))
    new = corpus(spark, [stmt(10, "Phosphorylation"), stmt(11, "Phosphorylation", "S", "5")], [a for i, s in ((10, "ROOT"), (11, 1)) for a in (agent(i, 0, str(s), G[s]), agent(i, 1, "t", G[5]))], [ev(10), ev(11, "trips")])
    both = assembly.incremental(every.with_(statements=every.statements.drop("mk_hash"), evidence=every.evidence.drop("mk_hash")), every.refinements, new, closed)
    assert pairs(both.refinements) == [(1, 2), (1, 10), (2, 10)] and ids(both) == [1, 2, 4, 10]
    grown, known = assembly.OntologyFilter(closed).extend(every, every.refinements, new.keep(new.statements.where("stmt_id = 10")))
    assert pairs(known) == [(1, 2), (1, 10), (2, 10)]
    grounded = assembly.ground(corpus(spark, [stmt(1, "Activation")], [agent(1, 0, "aa"), agent(1, 1, "bb", {"TEXT": "bb", "HGNC": "7"})]), lambda texts: [{"HGNC": "1"} if t == "aa" else None for t in texts], ungrounded_only=True)
    assert {r["name"]: r["db_refs"].get("HGNC") for r in grounded.agents.collect()} == {"aa": "1", "bb": "7"}
    assert ids(assembly.subnetwork(c, spark.createDataFrame([("1",), ("t",)], "name string"))) == [1, 3]
    assert ids(assembly.relevant(c, spark.createDataFrame([("3",)], "name string"), "prior_one")) == [4] and ids(assembly.relevant(c, sides.select(F.lit("3").alias("name")))) == [1, 2, 3, 4]
    assert {tuple(r) for r in assembly.implicit_activities(c).collect()} == {("1", "kinase"), ("MEK", "kinase")}
    forms = corpus(spark, [stmt(1, "ActiveForm", activity="kinase", is_active=True), stmt(2, "Activation"), stmt(3, "ActiveForm", activity="kinase", is_active=True)], [agent(1, 0, "a", mods=[("phosphorylation", "S", "1", True)]), agent(2, 0, "a", activity=("kinase", True)), agent(2, 1, "b"), agent(3, 0, "a")], [ev(2)])
    replaced = assembly.replace_activities(forms).agents.where("name = 'a'").first()
    assert replaced["activity"] is None and replaced["mods"][0]["position"] == "1"
    assert ids(assembly.normalize_active_forms(forms)) == [1, 2]
    order = spark.createDataFrame([("FPLX", "HGNC"), ("GO", "HGNC"), ("XX", "GO"), ("GO", "GO")], "a string, b string").select(assembly.prioritize(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in order] == [-1, 1, 1, 0]


def test_analysis(spark, closed):
    c = corpus(spark, [stmt(1, "Activation"), stmt(2, "Activation"), stmt(3, "Complex")], [agent(1, 0, "a"), agent(1, 1, "b"), agent(2, 0, "a"), agent(2, 1, "b"), agent(3, 0, "a", {"TEXT": "a", "HGNC": "1"}), agent(3, 1, "b", {"UP": "P1"})], [ev(1, text="said"), ev(2, text="said", pmid="x1"), ev(3)])
    assert analysis.agent_texts(c.agents).count() == 5 and pairs(analysis.sentences_for_text(c, "a", 1)) == [("1", "said")]
    assert analysis.bad_pmids(c).first()["pmid"] == "x1" and pairs(analysis.repeated_in_sentence(c)) == []
    twice = corpus(spark, [stmt(1, "Activation"), stmt(2, "Activation")], [agent(i, k, n) for i in (1, 2) for k, n in enumerate("ab")], [ev(1, text="said"), ev(2, text="said")])
    assert pairs(analysis.repeated_in_sentence(twice)) == [(2,)]
    assert ids(analysis.retain_molecular_complexes(c)) == [3]
    patterns = spark.createDataFrame([("HGNC", r"^\d+$")], "ns string, pattern string")
    gm = spark.createDataFrame([("a", {"HGNC": "x"}), ("b", {"ZZ": "1"}), ("c", {"HGNC": "BRAF"})], "text string, refs map<string,string>")
    assert analysis.check_grounding_map(gm, patterns).count() == 3
    genes = spark.createDataFrame([("BRAF", "1097")], "name string, id string")
    assert {r["text"]: r["refs"] for r in analysis.replace_gene_symbols(gm, genes).collect()} == {"a": {}, "b": {"ZZ": "1"}, "c": {"HGNC": "1097"}}
    assert analysis.source_counts(c, ("reach", "signor")).first()["counts"]["signor"] == 0
    m = analysis.grouped_metrics(analysis.metrics(c, {"double_ev": F.col("ev_count") * 2}), ["stmt_type"], {"ev_count": "sum", "double_ev": F.max, "ag_count": "ave"})
    assert {r["stmt_type"]: (r["ev_count"], r["double_ev"], r["ag_count"], r["n_stmts"]) for r in m.collect()} == {"Activation": (2, 2, 2.0, 2), "Complex": (1, 2, 2.0, 1)}
    assert {r["stmt_id"]: r["found"] for r in analysis.compare_overlap(c, c.keep(c.statements.where("stmt_id = 3")), closed).collect()} == {1: False, 2: False, 3: True}
    assert pairs(analysis.agents_equal(c.agents, c.agents).where("left_id < right_id")) == [(1, 2)] and pairs(analysis.statements_equal(c, c)) == [(1, 1), (2, 2), (3, 3)]
    assert analysis.to_graph(c).where("relation = 'HGNC'").count() == 1 and analysis.generic_copy(c, True).agents.where("map_contains_key(db_refs, 'TEXT')").count() == 0


def test_concepts(spark):
    onto = ontology.closure(spark.createDataFrame([("WM", "rain", "WM", "weather", "isa"), ("WM", "hail", "WM", "weather", "isa")], ONTO_EDGES))
    opp = spark.createDataFrame([("WM", "rain", "WM", "drought", "is_opposite"), ("WM", "drought", "WM", "rain", "is_opposite")], ONTO_EDGES)
    st = spark.createDataFrame([(i, "Influence") for i in range(1, 7)] + [(7, "Association"), (8, "Association"), (9, "Event"), (10, "Event")], "stmt_id long, stmt_type string")
    rows = [(1, "rain", 1, "crop", 1), (2, "weather", None, "crop", None), (3, "weather", None, "crop", -1), (4, "drought", 1, "crop", 1), (5, "rain", -1, "crop", -1), (6, "rain", None, "crop", 1)]
    e = [(i, k, "WM", n, p) for i, a, pa, b, pb in rows for k, (n, p) in enumerate(((a, pa), (b, pb)))]
    e += [(7, 0, "WM", "crop", 1), (7, 1, "WM", "rain", 1), (8, 0, "WM", "weather", 1), (8, 1, "WM", "crop", None), (9, 0, "WM", "rain", 1), (10, 0, "WM", "weather", None)]
    events = spark.createDataFrame(e, concepts.EVENTS)
    assert pairs(concepts.refinements(st, events, onto)) == [(1, 2), (1, 6), (3, 2), (5, 2), (5, 6), (6, 2), (7, 8), (9, 10)]
    assert pairs(concepts.contradictions(st, events, onto, opp)) == [(1, 3), (1, 4), (3, 5), (3, 6), (4, 5), (4, 6)]
    nodes = spark.createDataFrame([("WM", "rain", "rain", None, False, 1), ("WM", "drought", "drought", None, False, -1)], ONTO_NODES)
    moved = {(r["stmt_id"], r["idx"]): (r["id"], r["polarity"]) for r in concepts.normalize_opposites(events, opp, nodes, "WM").collect()}
    assert moved[4, 0] == ("rain", -1) and moved[1, 0] == ("rain", 1) and moved[4, 1] == ("crop", 1)
    times = spark.createDataFrame([((5, 8), (4, 9)), ((5, 9), (4, 9)), ((5, None), (4, 9)), ((5, 8), (None, None)), ((None, 8), (4, 9)), ((4, 8), (4, 9))], "s struct<start:int,end:int>, g struct<start:int,end:int>")
    assert [r[0] for r in times.select(concepts.time_refines(F.col("s"), F.col("g"))).collect()] == [True, False, True, True, False, False]
    g = spark.createDataFrame([([[("a", 0.5), ("b", 0.9)], [("a", 0.5), None], [("c", 0.7)]],)], "g array<array<struct<concept:string,score:double>>>")
    assert [x[0]["concept"] for x in g.select(concepts.sorted_compositional(F.col("g")).alias("s")).first()["s"]] == ["c", "a", "a"]
    assert concepts.refinements(st.limit(0), events.limit(0), onto).count() == 0


def test_sentences(spark):
    rows = {
        1: (stmt(1, "Phosphorylation", "S", "222"), [agent(1, 0, "A", mods=[("phosphorylation", "S", None, True)]), agent(1, 1, "B")], "Serine-phosphorylated A phosphorylates B on S222."),
        2: (stmt(2, "Phosphorylation", "T"), [agent(2, 1, "B")], "B is phosphorylated on threonine."),
        3: (stmt(3, "Complex"), [agent(3, 0, "A"), agent(3, 1, "B"), agent(3, 2, "C")], "A binds B and C."),
        4: (stmt(4, "Translocation", a="cytoplasm", b="nucleus"), [agent(4, 0, "x", bound=[("y", {}, True), ("z", {}, False)])], "X bound to y and not bound to z translocates from the cytoplasm to the nucleus."),
        5: (stmt(5, "ActiveForm", activity="kinase", is_active=False), [agent(5, 0, "A", muts=[("600", "V", "E")])], "A-V600E is kinase-inactive."),
        6: (stmt(6, "IncreaseAmount"), [agent(6, 1, "B")], "B is produced."),
        7: (stmt(7, "Gef"), [agent(7, 0, "SOS", activity=("gtpbound", False)), agent(7, 1, "RAS", location="membrane")], "GDP-bound inactive SOS is a GEF for RAS in the membrane."),
        8: (stmt(8, "Conversion"), [agent(8, 0, "E"), agent(8, 1, "x", role="obj_from"), agent(8, 2, "y", role="obj_to"), agent(8, 3, "z", role="obj_to")], "E catalyzes the conversion of x into y and z."),
        9: (stmt(9, "Phosphorylation"), [agent(9, 0, "A", mods=[("phosphorylation", "S", "1", True), ("phosphorylation", None, "2", True)]), agent(9, 1, "B")], "A phosphorylated on S1 and amino acid 2 leads to the phosphorylation of B."),
        10: (stmt(10, "Autophosphorylation", "Y", "9"), [agent(10, 0, "A")], "A phosphorylates itself on Y9."),
        11: (stmt(11, "Demethylation"), [agent(11, 0, "A", mods=[("methylation", None, None, False)]), agent(11, 1, "B")], "Unmethylated A demethylates B."),
    }
    c = corpus(spark, [r[0] for r in rows.values()], [a for r in rows.values() for a in r[1]], [ev(9, direct=False), ev(1, direct=True), ev(1, ord_=1, direct=False)])
    got = {r["stmt_id"]: r["sentence"] for r in english.sentences(c).collect()}
    assert got == {i: r[2] for i, r in rows.items()}
    listed = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "w array<string>").select(english.join_list(F.col("w"))).collect()
    assert [r[0] for r in listed] == ["", "a", "a and b", "a, b, and c"]


def test_rules(spark):
    c = corpus(spark, [stmt(1, "Phosphorylation", "S", "222"), stmt(2, "Complex"), stmt(3, "IncreaseAmount"), stmt(4, "DecreaseAmount"), stmt(5, "Translocation", b="nucleus"), stmt(6, "Dephosphorylation", "S", "222"), stmt(7, "Activation", activity="kinase"), stmt(8, "Phosphorylation")], [agent(1, 0, "A"), agent(1, 1, "B"), agent(2, 0, "A"), agent(2, 1, "B"), agent(2, 2, "C-1"), agent(3, 0, "A"), agent(3, 1, "B"), agent(4, 1, "B"), agent(5, 0, "A"), agent(6, 0, "P"), agent(6, 1, "B"), agent(7, 0, "A", mods=[("phosphorylation", None, None, True)]), agent(7, 1, "P"), agent(8, 1, "B")])
    one = rules.rules(c).cache()
    lines = {r["rule"]: r["line"] for r in rules.rule_lines(one).collect()}
    assert lines["A_phosphorylation_B_S222"] == "A_phosphorylation_B_S222: A() + B(S222~u) -> A() + B(S222~p) kf_ab_phosphorylation"
    assert lines["P_dephosphorylation_B_S222"].startswith("P_dephosphorylation_B_S222: P() + B(S222~p) -> P() + B(S222~u)")
    assert lines["A_B_bind"] == "A_B_bind: A(b) + B(a) -> A(b!1).B(a!1) kf_ab_bind" and "A_C_1_dissociate" in lines and len(lines) == 12
    assert lines["A_produces_B"] == "A_produces_B: A() -> A() + B(S222~u,a,c_1) kf_ab_synth" and lines["B_degraded"] == "B_degraded: B() -> 0 kf_b_deg"
    assert lines["A_translocates_cytoplasm_to_nucleus"].endswith("A(loc~cytoplasm) -> A(loc~nucleus) kf_a_cytoplasm_nucleus")
    assert lines["A_phospho_activates_P_kinase"].endswith("A(phospho~p) + P(kinase~inactive) -> A(phospho~p) + P(kinase~active) kf_ap_act")
    m = {r["monomer"]: r["sites"] for r in rules.monomers(one).collect()}
    assert m["A"]["phospho"] == ["u", "p"] and m["A"]["loc"] == ["cytoplasm", "nucleus"] and m["B"]["a"] == [] and set(m) == {"A", "B", "C_1", "P"}
    multi = {r["rule"]: r["line"] for r in rules.rule_lines(rules.rules(c, {"phosphorylation": "two_step", "complex": "multi_way", "activation": "michaelis_menten", "increaseamount": "hill"}), "kappa").collect()}
    assert {"A_phosphorylation_bind_B_S222", "A_dissoc_B", "A_B_C_1_bind_fwd", "A_B_C_1_bind_rev"} <= set(multi)
    assert multi["A_phospho_activates_P_kinase"].endswith("@ 'kc_ap_act / (Km_ap_act * A_phospho_activates_P_kinase_obj_obs)'") and "^ n_ab_synth" in multi["A_produces_B"]
    assert multi["A_B_C_1_bind_fwd"] == "'A_B_C_1_bind_fwd' A(b[.],c_1[.]), B(a[.],c_1[.]), C_1(a[.],b[.]) -> A(b[2],c_1[3]), B(a[2],c_1[6]), C_1(a[3],b[6]) @ 'kf_abc_bind'"
    by_id = spark.createDataFrame([(1, "atp_dependent")], "stmt_id long, policy string")
    other = {r["rule"] for r in rules.rules(c, {"other": "interactions_only"}, by_id).collect()}
    assert {"A_bind_atp", "A_dissoc_atp", "A_dissoc_B", "P_dephosphorylation_B_S222", "A_increaseamount_B"} <= other
    start = {r["monomer"]: r["value"] for r in rules.initial_conditions(rules.monomers(one), expression=spark.createDataFrame([("C-1", 5.0)], "name string, value double")).collect()}
    assert start == {"A": 10_000.0, "B": 10_000.0, "C_1": 5.0, "P": 10_000.0}
    found = rules.matching_patterns(c.agents.where("stmt_id = 7 and idx = 0"), one).collect()
    assert {r["rule"] for r in found} == {"A_phospho_activates_P_kinase"}
    text = rules.model_lines(c)
    assert [r["section"] for r in text.groupBy("section").count().orderBy("section").collect()] == [1, 2, 3, 4] and rules.rules(c.keep(c.statements.limit(0))).count() == 0


def test_identifiers(spark):
    rows = spark.createDataFrame([("UP", "P1"), ("HGNC", "5"), ("CHEBI", "15996"), ("CHEMBL", "25"), ("LINCS", "LSM-1"), ("SIGNOR", "S1"), ("TEXT", "x"), ("HMS-LINCS", "7"), ("UPPRO", "PRO_1")], "ns string, id string")
    url = identifiers.identifiers_url(F.col("ns"), F.col("id"))
    got = {r["ns"]: r["u"] for r in rows.select("ns", url.alias("u")).collect()}
    assert got["UP"] == "https://identifiers.org/uniprot:P1" and got["CHEBI"] == "https://identifiers.org/CHEBI:15996" and got["CHEMBL"] == "https://identifiers.org/chembl.compound:CHEMBL25" and got["TEXT"] is None
    assert got["LINCS"].endswith("lincs.smallmolecule:LSM-1") and got["SIGNOR"].endswith("?id=S1")
    back = {r["ns"]: tuple(r["p"]) for r in rows.where("ns <> 'TEXT'").select("ns", identifiers.parse_identifiers_url(url).alias("p")).collect()}
    assert back == {"UP": ("UP", "P1"), "HGNC": ("HGNC", "5"), "CHEBI": ("CHEBI", "CHEBI:15996"), "CHEMBL": ("CHEMBL", "CHEMBL25"), "LINCS": ("LINCS", "LSM-1"), "SIGNOR": ("SIGNOR", "S1"), "HMS-LINCS": ("HMS-LINCS", "7"), "UPPRO": ("UPPRO", "PRO_1")} or back["CHEBI"][1] == "CHEBI:15996"
    b = identifiers.Bioregistry({"uniprot": {}, "chebi": {"banana": "CHEBI"}, "hgnc": {}, "fplx": {"synonyms": ["FAM"]}, "chembl.compound": {"banana": "CHEMBL", "banana_peel": ""}})
    cur = {r["ns"]: r["c"] for r in rows.select("ns", b.curie(F.col("ns"), F.col("id")).alias("c")).collect()}
    assert cur["UP"] == "uniprot:P1" and cur["CHEBI"] == "chebi:15996" and cur["SIGNOR"] is None
    one = spark.range(1).select(b.ns_id_from_curie(F.lit("chebi:5")).alias("a"), b.curie(F.lit("CHEMBL"), F.lit("CHEMBL25")).alias("b"), b.ensure_prefix_if_needed(F.lit("CHEBI"), F.lit("5")).alias("c"), b.prefix(F.lit("FAM")).alias("d")).first()
    assert tuple(one["a"]) == ("CHEBI", "CHEBI:5") and one["b"] == "chembl.compound:25" and one["c"] == "CHEBI:5" and one["d"] == "fplx"


@pytest.fixture(scope="module")
def terms(spark):
    t = [("HGNC", "1", "BRAF", "gene with protein product", False, ["OLD"], [], None), ("HGNC", "2", "TWO", "RNA", False, ["OLD", "BRAF"], [], None), ("HGNC", "3", "BRAF", None, True, None, None, None), ("GO", "GO:1", "nucleus", "cellular_component", False, ["core"], ["GO:9"], None)]
    t += [("MESH", "D1", "flu", None, False, None, None, ["C01.5"]), ("MESH", "D2", "illness", None, False, None, None, ["C01"]), ("MGI", "7", "Braf", None, False, ["b1"], None, None)]
    x = [("HGNC", "1", "UP", "P2"), ("HGNC", "1", "UP", "P1"), ("MGI", "7", "HGNC", "1"), ("CHEMBL", "CHEMBL25", "CHEBI", "CHEBI:15365"), ("DRUGBANK", "DB1", "CHEBI", "CHEBI:1")]
    return lookups.Terms(spark.createDataFrame(t, lookups.TERMS), spark.createDataFrame(x, lookups.XREFS), spark.createDataFrame([("ECCODE", "1.1.1", "is_a", "ECCODE", "1.1")], lookups.RELATIONS), spark.createDataFrame([("kinase", None, "BRAF"), ("mesh.primary", "C9", "D1")], lookups.SETS))


def test_lookups(spark, terms):
    def look(name, *keys):
        return {r["key"]: r["value"] for r in lookups.lookup(name, spark.createDataFrame([(k,) for k in keys], "key string"), terms).collect()}

    assert look("hgnc.get_hgnc_name", "1", "3", "8") == {"1": "BRAF", "3": "BRAF", "8": None} and look("hgnc.get_hgnc_id", "BRAF", "OLD") == {"BRAF": "1", "OLD": None}
    assert look("hgnc.get_current_hgnc_id", "BRAF", "OLD", "none") == {"BRAF": ["1"], "OLD": ["1", "2"], "none": None}
    assert look("hgnc.get_uniprot_id", "1", "1") == {"1": "P1"} and look("chebi.get_chebi_id_from_chembl", "25", "CHEMBL25") == {"25": "CHEBI:15365", "CHEMBL25": "CHEBI:15365"}
    assert look("go.get_primary_id", "GO:9", "1", "GO:7") == {"GO:9": "GO:1", "1": "GO:1", "GO:7": None} and look("go.get_valid_location", "core", "GO:9", "x") == {"core": "nucleus", "GO:9": "nucleus", "x": None}
    assert look("hgnc.get_hgnc_name_from_mgi_name", "Braf") == {"Braf": "BRAF"} and look("hgnc.is_kinase", "BRAF", "TWO") == {"BRAF": True, "TWO": False}
    assert look("mesh.is_disease", "D1", "C9", "D8") == {"D1": True, "C9": True, "D8": False} and look("mesh.has_tree_prefix:C01.5", "D1", "D2") == {"D1": True, "D2": False}
    assert look("ec.get_parents", "1.1.1") == {"1.1.1": ["1.1"]} and look("drugbank.get_db_mapping", "DB1") == {"DB1": "CHEBI:CHEBI:1"} and look("mgi.get_id_from_name_synonym", "b1") == {"b1": ["7"]}
    isa = lookups.tree_isa(spark.createDataFrame([("D1", "D2"), ("D2", "D1")], "a string, b string"), terms).collect()
    assert {(r["a"], r["b"]): r["isa"] for r in isa} == {("D1", "D2"): True, ("D2", "D1"): False}
    close = ontology.closure(spark.createDataFrame([("CHEBI", "CHEBI:2", "CHEBI", "CHEBI:1", "isa")], ONTO_EDGES))
    assert pairs(lookups.most_specific(spark.createDataFrame([(1, 0, "1"), (1, 1, "2"), (2, 0, "1")], "gid int, pos int, id string"), close)) == [(1, "CHEBI:2"), (2, "CHEBI:1")]
    with pytest.raises(KeyError):
        lookups.lookup("no.such", spark.createDataFrame([("a",)], "key string"), terms)
    assert all(look(n, "zzz")["zzz"] in (None, [], False) for n in random.Random(1).sample(sorted(lookups.LOOKUPS), 6))


def test_ontology_tables(spark, tmp_path):
    t = ontology_tables
    put = lambda name, text: (tmp_path / name).write_text(text) and str(tmp_path / name)
    hgnc = t.hgnc(spark, put("hgnc.tsv", "\t".join("abcdefghijklm") + "\nHGNC:1\tBRAF\tx\tApproved\t\t673\tP1, P2\tMGI:5\tRGD:6\tOLD1, OLD2\tENSG1\tgene with protein product\t2.7.1\nHGNC:2\tGONE\tsymbol withdrawn, see [HGNC:1](x)\tSymbol Withdrawn\t\t\t\t\t\t\t\t\t\n"))
    entry = [{"namespace": "cellular_component", "id": "GO:1", "name": "a complex", "synonyms": [], "xrefs": [], "alt_ids": ["GO:9"], "relations": {"is_a": ["GO:2"], "has_part": ["GO:3"]}}, {"namespace": "biological_process", "id": "GO:4", "name": "b", "relations": {"has_part": ["GO:1"], "odd": ["GO:2"]}}]
    go = t.obo(spark, put("go.json", json.dumps(entry)), "GO")
    mesh = t.mesh(spark, put("mesh.tsv", "D1\tflu\tC01.5\t\nD2\till\tC01\tsick\nD3\tenz\tD08.1\t\n"), put("sup.tsv", "C9\tD1|D2\n"), put("map.tsv", "D1\tDOID\tDOID:1\nD3\tUP\tP1\n"))
    fam = t.families(spark, put("e.csv", "MEK\n"), put("r.csv", "HGNC,BRAF,isa,FPLX,MEK\n"), put("m.tsv", "PF\tPF1\tMEK\nMESH\tD3\tMEK\nXX\t1\tMEK\n"), hgnc.terms.where("ns = 'HGNC' and not obsolete").select("name", "id"))
    prot = t.proteins(spark, put("up.tsv", "i\tg\tm\th\te\ts\tf\nP1\tBRAF\tX_HUMAN\t1\t673\tQ1,Q2\tPRO_1=chain\n"))
    lspci = t.small_molecule_groups(spark, put("l.tsv", "i\tn\tm\n1\tmol\tCHEBI:CHEBI:5|CHEMBL:C1\n"))
    hms = t.small_molecules(spark, put("hms.tsv", "i\tn\tc\tb\tp\n10-101\tdrug\t5\tC1\t\n10-999\tno\t\t\t\n"))
    every = t.united(hgnc, go, mesh, fam, prot, lspci, hms, t.named(spark, put("mi.tsv", "MI1\tmir\n"), "MIRBASE"), t.pairs(spark, put("p.tsv", "5\tC1\n"), "CHEBI", "CHEMBL", both=True), t.mappings_with_names(spark, put("b.tsv", "MESH\tD1\tflu\tMONDO\tMO1\tflu\n")))
    nodes, edges = t.build(every)
    n = {(r["ns"], r["id"]): r for r in nodes.collect()}
    assert n["HGNC", "1"]["type"] == "human_gene_protein" and n["HGNC", "2"]["obsolete"] and n["HGNC", "2"]["name"] == "BRAF" and n["GO", "GO:9"]["obsolete"] and n["UPPRO", "PRO_1"]["type"] == "human_gene_protein_fragment" and n["MESH", "D3"]["type"] == "human_gene_protein" and n["HMS-LINCS", "10"]["name"] == "drug"
    e = {(r["s_ns"], r["s_id"], r["rel"], r["t_ns"], r["t_id"]) for r in edges.collect()}
    for x in (("HGNC", "1", "xref", "UP", "P2"), ("GO", "GO:1", "isa", "GO", "GO:2"), ("GO", "GO:3", "partof", "GO", "GO:1"), ("MESH", "D1", "isa", "MESH", "D2"), ("HGNC", "1", "isa", "FPLX", "MEK"), ("FPLX", "MEK", "xref", "PF", "PF1"), ("UPPRO", "PRO_1", "partof", "UP", "P1"), ("UP", "Q1", "replaced_by", "UP", "P1"), ("GO", "GO:9", "replaced_by", "GO", "GO:1"), ("CHEBI", "CHEBI:5", "isa", "LSPCI", "1"), ("CHEBI", "CHEBI:5", "xref", "CHEMBL", "C1"), ("MONDO", "MO1", "xref", "MESH", "D1"), ("ACTIVITY", "kinase", "isa", "ACTIVITY", "catalytic"), ("MODIFICATION", "phosphorylation", "isa", "MODIFICATION", "modification")):
        assert x in e, x
    assert not any(s == ("GO", "GO:1") for s in ((r[0], r[1]) for r in e if r[4] == "GO:4")) and ("FPLX", "MEK", "xref", "MESH", "D3") not in e
    assert t.remove_edges(edges, edges.limit(1)).count() == edges.count() - 1
    assert t.invalid_nodes(nodes, spark.createDataFrame([("HGNC", "^x")], "ns string, pattern string")).where("ns = 'HGNC'").count() == 2


def test_literature(spark, tmp_path):
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">12</PMID><Article><Journal><ISSN IssnType="Print">1111-2222</ISSN><JournalIssue><Volume>5</Volume><PubDate><Year>2010</Year><Month>Mar</Month></PubDate></JournalIssue><Title>J One</Title></Journal><ArticleTitle>On  kinases</ArticleTitle><Pagination><MedlinePgn>456-7</MedlinePgn></Pagination><Abstract><AbstractText Label="A">First.</AbstractText><AbstractText>Second.</AbstractText></Abstract><AuthorList><Author><LastName>Doe</LastName><ForeName>J</ForeName></Author></AuthorList><PublicationTypeList><PublicationType UI="D1">Retracted Publication</PublicationType></PublicationTypeList><DataBankList><DataBank><DataBankName>ClinicalTrials.gov</DataBankName><AccessionNumberList><AccessionNumber>NCT00000001</AccessionNumber></AccessionNumberList></DataBank></DataBankList></Article><MedlineJournalInfo><NlmUniqueID>99</NlmUniqueID><ISSNLinking>3333-4444</ISSNLinking></MedlineJournalInfo><MeshHeadingList><MeshHeading><DescriptorName UI="D9" MajorTopicYN="Y">Flu</DescriptorName></MeshHeading></MeshHeadingList></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/x</ArticleId></ArticleIdList></PubmedData></PubmedArticle><PubmedArticle><MedlineCitation><PMID>13</PMID></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    (tmp_path / "a.xml").write_text(xml)
    got = literature.articles(literature.records(spark, str(tmp_path / "a.xml")))
    r = {x["pmid"]: x for x in got.collect()}
    a = r["12"]
    assert (a["doi"], a["title"], a["abstract"], a["page"], a["volume"], a["authors"], a["nct_ids"], a["retracted"]) == ("10.1/x", "On kinases", "First. Second.", "456-457", "5", ["J Doe"], ["NCT00000001"], True)
    assert tuple(a["published"])[:2] == (2010, 3) and a["mesh_annotations"][0]["major"] and a["issn"]["print"] == "1111-2222" and r["13"]["authors"] == [] and not r["13"]["retracted"]
    assert pairs(literature.retractions(got)) == [("12",)] and pairs(literature.pmids_for_mesh(got, spark.createDataFrame([("D9",)], "mesh string"))) == [("D9", "12")]
    assert literature.issns_for_journals(got).first()["issns"] == ["3333-4444", "1111-2222"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "f.xml").write_text("<article><title>T &amp; U</title><p>One <b>two</b>.</p><table-wrap><p>no</p></table-wrap><p>NCT12345678 three</p></article>")
    docs = literature.documents(spark, str(tmp_path / "t"))
    assert literature.full_texts(docs).first()["text"] == "T & U\nOne two.\nNCT12345678 three" and literature.trials_of_text(docs).first()["nct_id"] == "NCT12345678"
    assert literature.filter_paragraphs(literature.paragraphs(docs), ["two"]).first()["text"] == "One two."


def frame(i, kind, sub, args, **more):
    return {"frame-id": i, "type": kind, "subtype": sub, "verbose-text": f"said {i}", "found-by": "rule", "sentence": "s1", "is-direct": True, "arguments": args, **more}


def test_reach(spark, tmp_path):
    arg = lambda kind, i, text=None: {"type": kind, "argument-type": "entity", "arg": i, "text": text}
    ent = lambda i, text, ns, id_, mods=(): {"frame-id": i, "text": text, "type": "protein", "sentence": "s1", "start-pos": {"offset": 10}, "end-pos": {"offset": 13}, "xrefs": [{"namespace": ns, "id": id_}], "alt-xrefs": [{"namespace": ns, "id": "MOUSE", "species": "mouse"}], "modifications": list(mods)}
    ents = [ent("a", "AKT", "uniprot", "P1"), ent("b", "BAD", "uniprot", "P2#PRO_7"), ent("c", "MEK", "be", "MEK", [{"type": "phosphorylated", "site": "Ser-218"}, {"type": "mutation", "evidence": "V600E"}]), ent("n", "nucleus", "go", "GO:1")]
    events = [
        frame("e1", "protein-modification", "phosphorylation", [arg("theme", "b"), arg("site", "x", "S136 and serine 112")]), frame("r1", "regulation", "positive-regulation", [arg("controlled", "e1"), arg("controller", "a")]),
        frame("r2", "regulation", "negative-regulation", [arg("controlled", "e1"), arg("controller", "c")]), frame("e2", "complex-assembly", None, [arg("theme", "a"), arg("theme", "c")]), frame("e3", "complex-assembly", None, [arg("theme", "a")], **{"is-direct": None}),
        frame("e4", "activation", "positive-activation", [arg("controlled", "a"), {"type": "controller", "argument-type": "complex", "args": {"x1": "b", "x2": "c"}}]), frame("e5", "activation", "negative-activation", [arg("controlled", "c"), arg("controller", "a")], **{"is-negated": True}),
        frame("e6", "translocation", None, [arg("theme", "a"), arg("destination", "n")]), frame("e7", "translocation", None, [arg("theme", "a")]), frame("e8", "amount", None, [arg("theme", "b")]), frame("e9", "regulation", "negative-regulation", [arg("controlled", "e8"), arg("controller", "a")]),
        frame("e10", "activation", "positive-activation", [arg("controlled", "c"), arg("controller", "a")]), frame("e11", "conversion", None, [arg("controller", "a"), arg("substrate", "b"), arg("product", "c")]),
    ]
    doc = {"events": {"frames": events}, "entities": {"frames": ents}, "sentences": {"frames": [{"frame-id": "s1", "text": "x", "start-pos": {"offset": 4}, "sections": ["Intro"]}]}}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "PMC1.json").write_text(json.dumps(doc))
    (tmp_path / "d" / "bad.json").write_text("not json")
    c = reach(spark, str(tmp_path / "d"), citation=F.regexp_extract("path", r"PMC(\d+)", 1))
    kinds = {r["stmt_type"]: r["count"] for r in c.statements.groupBy("stmt_type").count().collect()}
    assert kinds == {"Phosphorylation": 3, "Dephosphorylation": 2, "Complex": 1, "Activation": 1, "Translocation": 1, "DecreaseAmount": 1, "Conversion": 1}
    sites = {(r["stmt_type"], r["residue"], r["position"]) for r in c.statements.where("residue is not null").collect()}
    assert sites == {(t, "S", p) for t in ("Phosphorylation", "Dephosphorylation") for p in ("136", "112")} | {("Phosphorylation", "S", "218")}
    bad = c.agents.where("name = 'BAD'").first()
    assert bad["db_refs"] == {"UPPRO": "PRO_7", "TEXT": "BAD"} and c.agents.where("name = 'MEK' and size(mutations) = 1").count() > 0
    bound = c.agents.where("size(bound) > 0").first()
    assert bound["name"] == "BAD" and bound["bound"][0]["name"] == "MEK" and c.statements.where("stmt_type = 'Translocation'").first()["to_location"] == "nucleus"
    e = c.evidence.first()
    assert e["pmid"] == "1" and json.loads(e["annotations"])["sections"] == ["Intro"]
    docs = documents(spark, str(tmp_path / "d")).withColumn("citation", F.lit(None).cast("string"))
    assert {r["type"]: r["n"] for r in event_counts(docs).collect()}["activation"] == 3 and entities(docs, sentence_coords=True).where("name = 'AKT'").first()["begin"] == 6
    assert entities(docs, organisms=("mouse",)).where("name = 'AKT'").first()["db_refs"]["UP"] == "MOUSE"
