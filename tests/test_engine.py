"""The engine on small literal corpora: closed forms, edge cases, round trips."""

import json

import pytest
from pyspark.sql import functions as F

from claimgrid.functions.keys import hash_of, is_grounded
from claimgrid.operators import belief, filters, mechanisms, network, ontology, paths, preassembly, transforms
from claimgrid.plans.pipeline import Pipeline
from claimgrid.plans.query import HasAgent, HasEvidenceBound, HasSources, HasType, from_json
from claimgrid.schema import AGENTS, EVIDENCE, ONTO_EDGES, STATEMENTS, Corpus, descendants, empty_corpus
from claimgrid.sources import sinks, statement_json, tabular
from claimgrid.streaming.incremental import incremental_sink


def stmt(i, kind, residue=None, position=None, activity=None, is_active=None, b=None):
    return (i, kind, residue, position, activity, is_active, None, None, b)


def agent(i, idx, name, refs=None, mods=None, activity=None):
    return (i, "subj" if idx == 0 else "obj", idx, name, refs or {"TEXT": name}, mods, None, None, activity, None)


def ev(i, source, negated=False, pmid="1", hyp=False, direct=None, ord_=0, text=None):
    return (i, ord_, source, str(ord_), pmid, text, None, None, direct, hyp, negated)


def corpus(spark, statements, agents, evidence=()):
    return Corpus(spark.createDataFrame(statements, STATEMENTS), spark.createDataFrame(agents, AGENTS), spark.createDataFrame(list(evidence), EVIDENCE))


def ids(c):
    return sorted(r[0] for r in c.statements.select("stmt_id").collect())


@pytest.fixture(scope="module")
def small(spark):
    g = {"HGNC": "1"}
    return corpus(
        spark,
        [stmt(1, "Phosphorylation", "S", "222"), stmt(2, "Phosphorylation"), stmt(3, "Activation"), stmt(4, "Inhibition"), stmt(5, "Complex"), stmt(6, "Phosphorylation", "S", "222")],
        [agent(1, 0, "A", g), agent(1, 1, "B", {"HGNC": "2"}), agent(2, 0, "F", {"FPLX": "FAM"}), agent(2, 1, "B", {"HGNC": "2"}), agent(3, 0, "A", g), agent(3, 1, "B", {"HGNC": "2"}), agent(4, 0, "A", g), agent(4, 1, "B", {"HGNC": "2"}), agent(5, 0, "B", {"HGNC": "2"}), agent(5, 1, "zz"), agent(6, 0, "A2", g), agent(6, 1, "B", {"HGNC": "2"})],
        [ev(1, "reach"), ev(1, "reach", ord_=1, pmid="2"), ev(2, "signor"), ev(3, "reach", negated=True), ev(4, "signor", hyp=True, direct=False), ev(6, "reach"), ev(6, "biopax", ord_=3)],
    )


@pytest.fixture(scope="module")
def closed(spark):
    return ontology.closure(spark.createDataFrame([("HGNC", "1", "FPLX", "FAM", "isa"), ("FPLX", "FAM", "FPLX", "TOP", "isa"), ("FPLX", "TOP", "FPLX", "FAM", "isa")], ONTO_EDGES))


def test_types_and_hash(spark):
    assert "GtpActivation" in descendants("regulateactivity") and "Dephosphorylation" in descendants("Modification")
    with pytest.raises(ValueError):
        descendants("Nonsense")
    import hashlib

    got = spark.range(1).select(hash_of(F.lit("abc")).alias("s"), hash_of(F.lit("abc"), 16).alias("f")).first()
    h = hashlib.md5(b"abc").hexdigest()
    assert (got["s"], got["f"]) == (16**14 // 2 - int(h[:14], 16), 16**16 // 2 - int(h, 16) // 16**16)


def test_closure_survives_cycles(closed):
    got = {(r["id"], r["p_id"]) for r in closed.collect()}
    assert got == {("1", "FAM"), ("1", "TOP"), ("FAM", "TOP"), ("TOP", "FAM")}


def test_duplicates_refinements_and_belief(spark, small, closed):
    c = preassembly.combine_duplicates(small)
    assert ids(c) == [1, 2, 3, 4, 5] and c.evidence.where("stmt_id = 1").count() == 3
    again = preassembly.combine_duplicates(c.with_(statements=c.statements.drop("mk_hash")))
    assert ids(again) == ids(c)
    full = preassembly.combine_related(c, closed, return_toplevel=False)
    assert [tuple(r) for r in full.refinements.collect()] == [(1, 2)]
    preassembly.assert_no_cycle(full.refinements)
    assert ids(preassembly.combine_related(c, closed)) == [1, 3, 4, 5]
    own = {r["stmt_id"]: r["belief"] for r in belief.set_prior_probs(full).statements.collect()}
    assert own[1] == pytest.approx(1 - (0.05 + 0.3**2) * (0.01 + 0.2)) and own[3] == 0 and own[5] == 0
    up = {r["stmt_id"]: r["belief"] for r in belief.set_hierarchy_probs(full).statements.collect()}
    assert up[2] == pytest.approx(1 - 0.11 * (0.05 + 0.3**2) * 0.21) and all(0 <= b <= 1 for b in up.values())
    assert [tuple(sorted(r)) for r in preassembly.find_contradicts(c, closed).collect()] == [(3, 4)]
    flat = preassembly.flatten_evidence(full)
    assert flat.where("stmt_id = 2 and support_type = 'supported_by'").count() == 3


def test_filters(spark, small):
    assert ids(filters.filter_by_type(small, "RegulateActivity")) == [3, 4]
    assert ids(filters.filter_grounded_only(small)) == [1, 2, 3, 4, 6]
    assert ids(filters.filter_genes_only(small, specific_only=True)) == [1, 3, 4, 6]
    assert ids(filters.filter_direct(small)) == [1, 2, 3, 5, 6]
    assert ids(filters.filter_no_hypothesis(small)) == [1, 2, 3, 5, 6]
    assert ids(filters.filter_no_negated(small)) == [1, 2, 4, 5, 6]
    assert ids(filters.filter_evidence_source(small, ["reach", "biopax"], "all")) == [6]
    assert ids(filters.filter_evidence_source(small, ["reach"], "none")) == [2, 4, 5]
    assert ids(filters.filter_gene_list(small, ["A"], "one")) == [1, 3, 4] and ids(filters.filter_gene_list(small, ["A"], "nonsense")) == ids(small)
    assert ids(filters.filter_by_db_refs(small, "FPLX", ["FAM"], "any")) == [2]
    assert ids(filters.filter_by_db_refs(small, "HGNC", ["1"], "any", invert=True)) == [1, 2, 3, 4, 5, 6]
    assert ids(filters.filter_retracted_sources(small, spark.createDataFrame([("1",)], "pmid string"))) == [1]
    kin = spark.createDataFrame([("A",)], "name string")
    assert ids(filters.filter_enzyme_kinase(small, kin)) == [1, 3, 4, 5]
    assert ids(filters.filter_inconsequential_mods(small)) == [3, 4, 5]
    assert ids(filters.filter_inconsequential_mods(small, {"B": [("phosphorylation", "S", "222")]})) == [1, 3, 4, 5, 6]
    assert filters.filter_direct(empty_corpus(spark)).statements.count() == 0
    assert spark.createDataFrame([({"TEXT": "x", "HGNC": ""},)], "r map<string,string>").where(is_grounded(F.col("r"))).count() == 0


def test_transforms(spark, small):
    renamed = transforms.rename_db_ref(small, "HGNC", "EGID").agents
    assert renamed.where("map_contains_key(db_refs, 'HGNC')").count() == 0
    bad = corpus(spark, [stmt(1, "Activation")], [agent(1, 0, "x", {"UP": "P12345-2", "CHEMBL": "25", "FPLX": "A-B", "X": None})], [(1, 0, "reach", None, "abc", None, {"pmid": "77", "doi": "nope"}, None, None, None, None)])
    fixed = transforms.fix_invalidities(bad)
    assert fixed.agents.first()["db_refs"] == {"UP": "P12345", "UPISO": "P12345-2", "CHEMBL": "CHEMBL25", "FPLX": "A_B"} and fixed.evidence.first()["pmid"] == "77"
    gm = spark.createDataFrame([("zz", {"HGNC": "9"})], "text string, refs map<string,string>")
    assert transforms.map_grounding(small, gm).agents.where("name = 'zz'").first()["db_refs"] == {"HGNC": "9", "TEXT": "zz"}
    lines = spark.createDataFrame([("er,HGNC,5,UP,P1",), ("er,HGNC,6,UP,",)], "value string").coalesce(1)
    assert transforms.parse_grounding_map(lines).first()["refs"] == {"HGNC": "6"}


def test_network_and_paths(spark):
    e = spark.createDataFrame([("a", "b", 0.9, 0), ("b", "c", 0.8, 1), ("c", "d", 0.7, 1), ("a", "c", 0.2, 0), ("d", "a", 0.5, 0)], "u string, v string, belief double, sign int")
    start = spark.createDataFrame([("a",)], "start string")
    assert {tuple(r["path"]) for r in paths.bfs_search(e, start, 2).collect()} == {("a", "b"), ("a", "c"), ("a", "c", "d")}
    pair = spark.createDataFrame([("a", "d")], "source string, target string")
    assert {tuple(r["path"]) for r in paths.simple_paths(e, pair, 3).collect()} == {("a", "b", "c", "d")}
    assert {tuple(r["path"]) for r in paths.shortest_paths(e, pair, 4).collect()} == {("a", "c", "d")}
    costs = {r["node"]: r["cost"] for r in paths.open_dijkstra(e.withColumn("weight", 1 - F.col("belief")), start).collect()}
    assert costs["c"] == pytest.approx(0.3) and costs["d"] == pytest.approx(0.6)
    signed = network.signed_nodes(e.select(F.col("u").alias("agA_name"), F.col("v").alias("agB_name"), "sign"))
    st = spark.createDataFrame([(1, "Activation", "a", "d"), (2, "Inhibition", "a", "d"), (3, "Complex", "a", "d"), (4, "Activation", "q", "d"), (5, "Inhibition", "a", "b")], "stmt_id long, stmt_type string, subj string, obj string")
    got = {r["stmt_id"]: r["result_code"] for r in paths.check_model(signed, st, 5, 3).collect()}
    assert got == {1: paths.FOUND, 2: paths.FOUND, 3: paths.BAD_TYPE, 4: paths.NO_SUBJECT, 5: paths.NO_PATH}


def test_mechanisms(spark):
    mod = [("phosphorylation", "S", "10", True)]
    c = corpus(spark, [stmt(1, "Phosphorylation", "S", "10"), stmt(2, "ActiveForm", activity="kinase", is_active=True), stmt(3, "Activation")], [agent(1, 0, "A"), agent(1, 1, "B"), agent(2, 0, "B", mods=mod), agent(3, 0, "A", activity=("kinase", True)), agent(3, 1, "B")])
    assert [(r["stmt_type"], r["a"], r["b"]) for r in mechanisms.infer_activations(c).collect()] == [("Activation", "A", "B")]
    assert mechanisms.infer_modifications(c).first()["stmt_type"] == "Phosphorylation"
    assert mechanisms.infer_active_forms(c).first()["mods"] == ["phosphorylation,S,10"]
    assert ids(mechanisms.replace_activations(c)) == [1, 2]
    assert mechanisms.add_reverse_effects(c).first()["stmt_type"] == "Dephosphorylation"


def test_pipeline_and_queries(spark, small):
    p = Pipeline().append("filter_grounded_only").append("filter_by_type", "Modification")
    assert ids(Pipeline.from_json(p.to_json()).run(small)) == [1, 2, 6]
    with pytest.raises(KeyError):
        Pipeline().append("no_such_step")
    with pytest.raises(TypeError):
        Pipeline().append("filter_belief")
    tree = (HasType(["Modification"], include_subclasses=True) & HasSources(["reach"])) | ~HasAgent("A") & HasEvidenceBound(["== 0"])
    rows = from_json(json.loads(json.dumps(tree.to_json()))).get(small).collect()
    assert sorted(r["stmt_id"] for r in rows) == [1, 5, 6]


def test_sources_and_sinks(spark, small, tmp_path):
    (tmp_path / "t.tsv").write_text("TF1\tG1\tActivation\t1;2\nTF2\tG2\tUnknown\t3\nTF1\tG2\tRepression\t4\n")
    genes = spark.createDataFrame([("TF1", "11", "P1"), ("G1", "12", "P2,P3")], "symbol string, hgnc string, up string")
    t = tabular.trrust(spark, str(tmp_path / "t.tsv"), genes)
    assert t.statements.count() == 3 and t.agents.where("name = 'G1'").first()["db_refs"] == {"TEXT": "G1", "HGNC": "12"}
    (tmp_path / "s.sif").write_text("a POSITIVE b\nb -1 c\n")
    assert sorted(r[0] for r in tabular.signed_lines(spark, str(tmp_path / "s.sif")).statements.select("stmt_type").collect()) == ["Activation", "Inhibition"]
    good = {"type": "Phosphorylation", "id": "u1", "enz": {"name": "A", "db_refs": {"HGNC": "1"}}, "sub": {"name": "B", "db_refs": {}}, "residue": "S", "evidence": [{"source_api": "reach", "epistemics": {"negated": True}}], "supports": ["u2"]}
    two = {"type": "Complex", "id": "u2", "members": [{"name": "A"}, {"name": "B"}]}
    (tmp_path / "x.jsonl").write_text("\n".join([json.dumps(good), json.dumps(two), '{"type": "Nothing"}', "not json"]))
    c, bad = statement_json.read(spark, str(tmp_path / "x.jsonl"))
    assert c.statements.count() == 2 and bad.count() == 2 and c.refinements.count() == 1 and c.agents.count() == 4
    assert json.loads(statement_json.to_json(c).where("value like '%Phos%'").first()["value"])["evidence"][0]["negated"] is True
    sinks.dump(small, str(tmp_path / "dump"))
    assert ids(sinks.load(spark, str(tmp_path / "dump"))) == ids(small)
    assert sinks.tsv(small).where("stmt_id = 1").first()["sentence"] == "A phosphorylates B on S222."


def test_incremental_counts(spark, tmp_path):
    schema = "mk_hash long, source_api string, negated boolean"
    src = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame([(1, "reach", False), (k, "signor", False)], schema).coalesce(1).write.mode("append").json(str(src))
    sink = incremental_sink(str(tmp_path / "counts"))
    run = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(src)).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = sorted(p.name for p in (tmp_path / "counts").iterdir())[-1]
    got = {(r["mk_hash"], r["source_api"]): r["n"] for r in spark.read.parquet(str(tmp_path / "counts" / last)).collect()}
    assert got == {(1, "reach"): 2, (0, "signor"): 1, (1, "signor"): 1}


def test_exports(spark, small, tmp_path):
    lines = {r[0].strip() for r in sinks.graphviz(small).collect()}
    assert '"A" -> "B" [arrowhead=tee];' in lines and '"B" -> "zz" [arrowhead=dot];' in lines and '"zz" -> "B" [arrowhead=dot];' not in lines
    cards = {r["stmt_id"]: json.loads(r["value"]) for r in sinks.index_cards(small).collect()}
    assert cards[1]["interaction"]["interaction_type"] == "adds_modification" and cards[1]["interaction"]["modifications"][0]["location"] == "222"
    assert cards[1]["interaction"]["participant_a"]["identifier"] == "HGNC:1" and [m["entity_text"] for m in cards[5]["interaction"]["entities"]] == ["B", "zz"]
    assert cards[5]["interaction"]["entities"][1]["identifier"] == "GENERIC"
    got = sinks.cx(small).groupBy("aspect").count().collect()
    assert {r["aspect"] for r in got} == {"nodes", "edges", "edgeCitations"}
    sinks.write_cx(small, str(tmp_path / "cx"))
    sinks.write_graphviz(small, str(tmp_path / "dot"))
    assert (tmp_path / "cx" / "aspect=nodes").exists() and (tmp_path / "dot" / "body").exists()
    assert sinks.cx(empty_corpus(spark)).count() == 0 and sinks.graphviz(empty_corpus(spark)).count() == 0


def test_active_forms_and_activities(spark):
    mods = [("phosphorylation", "S", "1", True)]
    c = corpus(spark, [stmt(1, "Phosphorylation"), stmt(2, "ActiveForm", activity="activity", is_active=True), stmt(3, "ActiveForm", activity="activity", is_active=True), stmt(4, "Activation"), stmt(5, "Activation", activity="kinase")], [agent(1, 0, "A"), agent(1, 1, "B"), agent(2, 0, "A", mods=mods), agent(3, 0, "A", mods=[("phosphorylation", "T", "2", True)]), agent(4, 0, "C"), agent(4, 1, "B"), agent(5, 0, "C"), agent(5, 1, "B")], [ev(1, "reach")])
    out = mechanisms.require_active_forms(c)
    assert out.statements.groupBy("stmt_type").count().where("stmt_type = 'Phosphorylation'").first()["count"] == 2 and out.statements.count() == 6 and out.evidence.count() == 2
    one = out.statements.where("stmt_type = 'Phosphorylation'").join(out.agents.where("idx = 0"), "stmt_id").select(F.col("mods")[0]["position"]).collect()
    assert sorted(r[0] for r in one) == ["1", "2"]
    assert {r["stmt_id"]: r["activity"] for r in mechanisms.reduce_activities(c).statements.where("stmt_type = 'Activation'").collect()} == {4: "kinase", 5: "kinase"}


def test_influence_map(spark):
    from claimgrid.operators import influence

    e = spark.createDataFrame([("a", "a", 1), ("a", "b", 1), ("b", "a", 1), ("a", "c", 1), ("b", "c", -1), ("p", "a", 1), ("x", "y", 1), ("y", "x", 1), ("x", "c", 1)], "u string, v string, sign int")
    kept = influence.prune_mutual(e, spark.createDataFrame([("p",)], "node string"))
    assert sorted((r["u"], r["v"]) for r in kept.collect()) == [("a", "c"), ("b", "c"), ("x", "c"), ("x", "y"), ("y", "x")]
    rules = spark.createDataFrame([("a", "DecreaseAmount", "S", "T"), ("b", "Complex", "U", "V"), ("c", "Complex", "T", None)], "rule string, kind string, subject string, object string")
    assert ("a", "b") not in {(r["u"], r["v"]) for r in influence.prune_subject_object(e, rules).collect()} and influence.prune_subject_object(e, rules).where("u = 'a' and v = 'c'").count() == 1
    assert influence.prune_degraded(e, rules).where("u = 'a' and v = 'c'").count() == 0 and influence.prune_degraded(e, rules).where("u = 'b' and v = 'c'").count() == 1
