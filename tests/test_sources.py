"""Readers of curated tables and of saved reader output, on rows written here."""

import json

import pytest
from pyspark.sql import functions as F

from claimgrid.sources import curated, readers


def write(path, text):
    path.write_text(text)
    return str(path)


def said(c):
    """(type, names in order, residue, position) of each assertion, sorted."""
    args = c.agents.groupBy("stmt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda a: a["name"]).alias("names"))
    return sorted((r["stmt_type"], tuple(r["names"]), r["residue"], r["position"]) for r in c.statements.join(args, "stmt_id").collect())


def two(kind, a, b, residue=None, position=None):
    return (kind, (a, b), residue, position)


SIGNOR = "ENTITYA TYPEA IDA DATABASEA ENTITYB TYPEB IDB DATABASEB EFFECT MECHANISM RESIDUE SEQUENCE TAX_ID CELL_DATA TISSUE_DATA MODULATOR_COMPLEX TARGET_COMPLEX MODIFICATIONA MODASEQ MODIFICATIONB MODBSEQ PMID DIRECT NOTES ANNOTATOR SENTENCE SCORE SIGNOR_ID".split()


def signor_row(effect, mechanism, site="", ida="P1", dba="UNIPROT", pmid="11", k=1):
    row = dict.fromkeys(SIGNOR, "") | {"ENTITYA": "A", "TYPEA": "protein", "IDA": ida, "DATABASEA": dba, "ENTITYB": "B", "TYPEB": "protein", "IDB": "P2-PRO_7", "DATABASEB": "UNIPROT", "EFFECT": effect, "MECHANISM": mechanism, "RESIDUE": site, "PMID": pmid, "DIRECT": "YES", "SIGNOR_ID": f"S{k}"}
    return ";".join(row[c] for c in SIGNOR)


def test_signor(spark, tmp_path):
    rows = [
        signor_row("up-regulates quantity by expression", "transcriptional regulation"),
        signor_row("down-regulates", "phosphorylation", '"Ser12;Thr30"', k=2),
        signor_row("up-regulates", "binding", k=3, pmid="PMC9"),
        signor_row("unknown", "cleavage", k=4),
        signor_row("up-regulates activity", "chemical activation", ida="SIGNOR-C1", dba="SIGNOR", k=5, pmid="Other"),
    ]
    path = write(tmp_path / "s.csv", "\n".join([";".join(SIGNOR), *rows]))
    nested = write(tmp_path / "c.csv", 'SIGNOR ID;COMPLEX NAME;LIST OF ENTITIES\nSIGNOR-C1;one;"P5,  SIGNOR-C2"\nSIGNOR-C2;two;"P6,  SIGNOR-C1"\nSIGNOR-C3;three;"P7"\n')
    c = curated.signor(spark, path, nested)
    assert said(c) == sorted(
        [two("IncreaseAmount", "A", "B"), two("Inhibition", "A", "B"), two("Phosphorylation", "A", "B", "S", "12"), two("Phosphorylation", "A", "B", "T", "30"), ("ActiveForm", ("B",), None, None)]
        + [two("Activation", "A", "B"), two("Complex", "A", "B"), ("ActiveForm", ("B",), None, None)]
        + [two("Activation", "P5", "B"), two("Complex", "P5", "P6"), two("Complex", "P5", "P6")]
    )
    forms = {r["is_active"]: r for r in c.statements.where("stmt_type = 'ActiveForm'").join(c.agents, "stmt_id").collect()}
    assert [m["position"] for m in forms[False]["mods"]] == ["12", "30"] and forms[True]["bound"][0]["name"] == "A"
    assert forms[True]["db_refs"] == {"UP": "P2", "UPPRO": "PRO_7"}
    assert c.evidence.where("source_id = 'S3'").first()["text_refs"] == {"PMCID": "PMC9"} and c.evidence.where("source_id = 'S5'").first()["text_refs"] is None
    assert c.agents.where("name = 'P5' and role = 'subj'").first()["bound"][0]["name"] == "P6"
    assert c.agents.where("activity.activity_type = 'transcription'").count() == 1
    assert curated.signor(spark, path).statements.count() == 9


def test_ctd(spark, tmp_path):
    row = "drug{0}\tD1\t50-00\tG\t7\tprotein\tHomo\t9606\t{1}\t{2}\t1|2"
    path = write(tmp_path / "g.tsv", "\n".join(["# remark", row.format(1, "drug1 acts", "increases^expression|affects^binding"), row.format(2, "drug2 cuts", "decreases^reaction|increases^phosphorylation"), row.format(3, "x with drug3", "increases^reaction|increases^activity")]))
    c = curated.ctd(spark, path)
    assert said(c) == [two("Dephosphorylation", "drug2", "G"), two("IncreaseAmount", "drug1", "G")] and c.evidence.count() == 4
    path = write(tmp_path / "d.tsv", "drug\tD1\t50-00\till\tMESH:D9\ttherapeutic\t\t\t\t5\ndrug\tD1\t50-00\till\tMESH:D9\tmarker/mechanism\t\t\t\t5\n")
    c = curated.ctd(spark, path, "chemical_disease")
    assert said(c) == [two("Inhibition", "drug", "ill")] and c.agents.where("idx = 1").first()["db_refs"] == {"MESH": "D9"}
    assert said(curated.ctd(spark, write(tmp_path / "e.tsv", "G\t7\till\tOMIM:5\ttherapeutic\t\t\t\t5\n"), "gene_disease")) == [two("Inhibition", "G", "ill")]


def test_gnbr(spark, tmp_path):
    one = write(tmp_path / "1.tsv", "path\tV+\tV+.ind\tE+\tE+.ind\tQ\tQ.ind\tH\tH.ind\nA|b|C\t3\t1\t2\t0\t0\t0\t1\t1\n")
    two_ = write(tmp_path / "2.tsv", "77\t0\tf\t0\tg\t1\tfoo\tbar\t10(Tax:9);11\t12\tGene\tGene\ta|B|c\tFoo bars.\n78\t0\tf\t0\tg\t1\tfoo\tbar\tnull\t12\tGene\tGene\ta|x|c\tNo.\n")
    c = curated.gnbr(spark, one, two_)
    assert said(c) == sorted([two("Activation", "foo", "bar")] * 2 + [two("Complex", "foo", "bar")] * 2)
    assert {r["db_refs"]["EGID"] for r in c.agents.where("idx = 0").collect()} == {"10", "11"}
    assert "IncreaseAmount" in {s[0] for s in said(curated.gnbr(spark, one, two_, indicator_only=False))}


def test_hprd(spark, tmp_path):
    ids = write(tmp_path / "i", "1\tAA\tg\tNP1\t101\t-\tQ1\tn\n2\tBB\tg\tNP2\t102\t-\tQ2\tn\n3\tCC\tg\tNP3\t-\t-\tQ3\tn\n")
    cplx = write(tmp_path / "c", "X1\t1\tAA\tNP1\tin vivo\t5,6\nX1\t2\tBB\tNP2\tin vivo\t5,6\nX2\t1\tAA\tNP1\t-\t7\nX2\t3\tCC\tNP3\t-\t7\n")
    ptm = write(tmp_path / "p", "2\tBB\t2_1\tNP2\t12;-\tS\tAA\t1\tPhosphorylation\tin vitro\t8\n2\tBB\t2_1\tNP2\t9\tK\t-\t-\tAcetylation\tin vitro\t8\n2\tBB\t2_1\tNP2\t9\tK\t-\t-\tNitration\tin vitro\t8\n")
    ppi = write(tmp_path / "b", "AA\t 1\tNP1\tBB\t2\tNP2\tyeast\t9\nAA\t1\tNP1\tCC\t3\tNP3\tyeast\t9\n")
    c = curated.hprd(spark, ids, cplx, ptm, ppi)
    assert said(c) == [("Acetylation", ("BB",), "K", "9"), two("Complex", "AA", "BB"), two("Complex", "AA", "BB"), two("Phosphorylation", "AA", "BB", "S", "12")]
    assert c.agents.where("name = 'BB' and idx = 1").count() == 4
    with pytest.raises(ValueError):
        curated.hprd(spark, ids)


def test_mitab(spark, tmp_path):
    v = "uniprotkb:P1\tuniprotkb:P2-PRO_5\t-\t-\t-\t-\tpsi-mi:\"MI:0018\"(two hybrid)\t-\t{}\ttaxid:9606\ttaxid:11103\tpsi-mi:\"MI:0915\"(x)\t-\tvirhostnet-rid:4|nbr:9\tvirhostnet-miscore:0.3\t-"
    c = curated.virhostnet(spark, write(tmp_path / "v", v.format("pubmed:123") + "\n" + v.format("pubmed:https(//doi.org/10.1/ab)") + "\n"))
    assert said(c) == [two("Complex", "P1", "P2-PRO_5")] * 2
    assert sorted(json.dumps(r["text_refs"]) for r in c.evidence.collect()) == ['{"DOI": "10.1/ab"}', '{"PMID": "123"}'] and c.evidence.first()["source_id"] == "4"

    def w(kind, exp_a, bio="-"):
        return "\t".join(["wormbase:WBGene1", "wormbase:WBGene2", "-", "-", "wormbase:aa-1(public_name)|x", "wormbase:bb-2(public_name)", "m", "-", "pubmed:5|doi:10.2/x", "-", "-", f'psi-mi:"MI:1"({kind})', "-", "wormbase:WBI1", "-", "-", bio, "-", exp_a, "-", "-", "-"])

    rows = [w("genetic enhancement", 'psi-mi:"MI:2"(enhanced gene)'), w("mutual genetic enhancement", 'psi-mi:"MI:2"(enhancer gene)'), w("physical", 'psi-mi:"MI:3"(bait)'), w("phosphorylation reaction", "-", 'psi-mi:"MI:4"(enzyme)'), w("physical", "-")]
    c = curated.wormbase(spark, write(tmp_path / "w", "\n".join(rows)), spark.createDataFrame([("WBGene1", "91", "aa-1")], "wormbase string, entrez string, symbol string"))
    assert said(c) == [two("Complex", "aa-1", "bb-2"), two("IncreaseAmount", "bb-2", "aa-1"), two("Phosphorylation", "aa-1", "bb-2")]
    assert c.agents.where("name = 'aa-1'").first()["db_refs"] == {"WB": "WBGene1", "EGID": "91"} and {r["pmid"] for r in c.evidence.collect()} == {"5"}


def test_sites_and_drugs(spark, tmp_path):
    head = "acc\tsequence\tposition\tcode\tpmids\tkinases\tsource\tspecies\tentry_date\n"
    path = write(tmp_path / "p", head + "Q1-2\tMS\t4\tS\t12\tAKT\tLTP\tHomo sapiens\td\nQ2\tMS\t4\tS\tn/a\t\tLTP\tHomo sapiens\td\nQ3\tMS\t4\tS\t1\tAKT\tLTP\tMus musculus\td\n")
    assert said(curated.phosphoelm(spark, path)) == [two("Phosphorylation", "AKT", "Q1-2", "S", "4")]
    assert said(curated.phosphoelm(spark, path, skip_empty=False))[0] == ("Phosphorylation", ("Q2",), "S", "4") or len(said(curated.phosphoelm(spark, path, skip_empty=False))) == 2
    head = "gene_concept_id\tgene_name\tinteraction_source_db_name\tinteraction_type\tdrug_concept_id\tdrug_name\n"
    path = write(tmp_path / "d", head + "h:1\tG\tX\tinhibitor\tchembl:CHEMBL1\tdrug\nh:1\tG\tX\tone,two\trxcui:5\tother\nh:1\tG\tDrugBank\tinhibitor\trxcui:5\tthird\nh:1\tG\tX\tinhibitor\t\tfourth\n")
    genes = spark.createDataFrame([("G", "1")], "symbol string, hgnc string")
    assert said(curated.dgi(spark, path, genes)) == [two("Inhibition", "drug", "G")]
    more = spark.createDataFrame([("one,two", "Complex")], "interaction string, stmt_type string")
    c = curated.dgi(spark, path, genes, more)
    assert said(c) == [two("Complex", "other", "G"), two("Inhibition", "drug", "G")] and c.agents.where("name = 'drug'").first()["db_refs"] == {"CHEMBL": "CHEMBL1"}


def test_xml_readers(spark, tmp_path):
    target = "<target><id>BE1</id><name>T{0}</name><actions>{1}</actions><references><articles>{2}</articles><links>{3}</links></references><polypeptide><external-identifiers><external-identifier><resource>UniProtKB</resource><identifier>P9</identifier></external-identifier></external-identifiers></polypeptide></target>"
    targets = target.format(1, "<action>agonist</action><action>other</action>", "<article><pubmed-id>5</pubmed-id></article><article><pubmed-id>6</pubmed-id></article>", "") + target.format(2, "", "", "<link><url>http://u</url></link>")
    drug = f'<drugbank xmlns="http://x"><drug type="b"><drugbank-id primary="true">DB2</drugbank-id><drugbank-id>DB1</drugbank-id><name>D</name><cas-number>1-2</cas-number><external-identifiers><external-identifier><resource>ChEBI</resource><identifier>77</identifier></external-identifier></external-identifiers><targets>{targets}</targets></drug></drugbank>'
    c = readers.drugbank(spark, write(tmp_path / "d.xml", drug))
    assert said(c) == [two("Activation", "D", "T1"), two("Inhibition", "D", "T2")]
    assert c.agents.where("name = 'D'").first()["db_refs"] == {"DRUGBANK": "DB1", "CAS": "1-2", "CHEBI": "CHEBI:77"}
    assert c.agents.where("name = 'T1'").first()["db_refs"] == {"DRUGBANKV4.TARGET": "BE1", "UP": "P9"}
    assert sorted((r["pmid"] or "", (r["text_refs"] or {}).get("URL")) for r in c.evidence.collect()) == [("", "http://u"), ("5", None), ("6", None)]
    ent = '<Entity id="{0}" cui="C{0}" name="n{0}" text="t{0}"/>'
    pred = '<Predication {0}><Subject entityID="1"/><Predicate type="{1}"/><Object entityID="{2}"/></Predication>'
    xml = f'<SemRepAnnotation><Document><Utterance text="Said.">{ent.format(1)}{ent.format(2)}{pred.format("", "TREATS", 2)}{pred.format(chr(110) + "egated=" + chr(34) + "true" + chr(34), "CAUSES", 2)}{pred.format("", "ISA", 2)}{pred.format("", "CAUSES", 9)}</Utterance></Document></SemRepAnnotation>'
    c = readers.semrep(spark, write(tmp_path / "s.xml", xml))
    assert said(c) == [two("Activation", "n1", "n2"), two("Inhibition", "n1", "n2")] and c.evidence.where("negated").count() == 1


def test_rlimsp(spark, tmp_path):
    ent = lambda t, i, ids=(), **m: {"entityText": t, "sentenceIndex": i, "entityId": [{"source": s, "idString": v} for s, v in ids], **m}
    arg = lambda **m: {"relationType": "PHOSPHORYLATION", "argument": [{"role": r, "entity_duid": e} for r, e in m.items()]}
    doc = {
        "docId": "9", "text": "One. Two is here. Three.", "sentence": [{"charStart": 0, "charEnd": 3, "index": 0}, {"charStart": 5, "charEnd": 16, "index": 1}],
        "entity": {"k": ent("K", 1, [("UniProt", "P1")]), "s": ent("S", 1, [("Entrez", "4")]), "x": {**ent("Ser-12", 1), "attribute": [{"value": "Ser-12"}]}, "t": ent("phosphorylates", 1), "a": ent("autophosphorylation", 1), "m": ent("M", 1, [("UniProt", "P1"), ("UniProt", "P2")])},
        "relation": {"r1": arg(KINASE="k", SUBSTRATE="s", SITE="x", TRIGGER="t"), "r2": arg(KINASE="k", SUBSTRATE="k", TRIGGER="a"), "r3": arg(SUBSTRATE="m", TRIGGER="t"), "r4": arg(KINASE="k", TRIGGER="t"), "r5": arg(SUBSTRATE="s", TRIGGER="t")},
    }
    c = readers.rlimsp(spark, write(tmp_path / "r.jsonl", json.dumps(doc) + "\n" + json.dumps(doc) + "\nnot json"), "pmid")
    assert said(c) == [("Autophosphorylation", ("K",), None, None), ("Phosphorylation", ("K", "S"), "S", "12"), ("Phosphorylation", ("S",), None, None)]
    assert {(r["pmid"], r["text"]) for r in c.evidence.collect()} == {("9", "Two is here.")}


def test_json_readers(spark, tmp_path):
    rec = {"id": "gene:5", "hs_gene_symbol": "G", "pert_type": " KO ", "geo_id": "x", "organism": "human", "cell_type": "c", "up_genes": [["U", 1.5]], "down_genes": [["D", -1]]}
    path = write(tmp_path / "c.json", json.dumps([rec, rec | {"pert_type": "mutant"}]))
    assert said(readers.creeds(spark, path)) == [two("DecreaseAmount", "G", "U"), two("IncreaseAmount", "G", "D")]
    assert said(readers.creeds(spark, path, genes=spark.createDataFrame([("U", "3")], "symbol string, hgnc string"))) == [two("DecreaseAmount", "G", "U")]
    mod = {"enzyme": "P1", "substrate": "P2", "residue_type": "S", "residue_offset": 4, "modification": "phosphorylation", "references": ["SIGNOR:1", "X:2", "Y:https/PMC3"]}
    c = readers.omnipath_mods(spark, write(tmp_path / "o.json", json.dumps([mod, mod | {"references": ["SIGNOR:1"]}, mod | {"modification": "strange"}])))
    assert said(c) == [two("Phosphorylation", "P1", "P2", "S", "4")] and c.evidence.count() == 2
    lr = {"source": "COMPLEX:P1_P2", "target": "P3", "sources": ["X", "Y"], "references": ["X:2", "X:123456789"], "consensus_stimulation": 1, "consensus_inhibition": 0}
    c = readers.omnipath_ligrec(spark, write(tmp_path / "l.json", json.dumps([lr, lr | {"source": "P4", "consensus_inhibition": 1}])))
    assert said(c) == [two("Activation", "P1", "P3"), ("Complex", ("P1", "P2", "P3"), None, None), two("Complex", "P4", "P3")]
    part = lambda n, **m: {"entity_type": "protein", "entity_text": [n], "identifier": f"HGNC:{n}", **m}
    card = lambda kind, **m: json.dumps({"pmc_id": "PMC1", "evidence": ["said"], "interaction": {"interaction_type": kind, **m}})
    site = {"modification_type": "Phosphorylation", "aa_code": "S", "location": "5"}
    cards = [card("adds_modification", participant_a=part("1"), participant_b=part("2"), modifications=[site, site | {"location": "6"}]), card("binds", participant_a=part("1"), participant_b=part("2")), card("binds", participant_a=part("1")), card("complexes_with", participant_a={"entities": [part("1"), part("2"), part("3")]}), card("translocates", participant_b=part("1"), to_location_id="GO:1"), card("increases", participant_a=part("1"), participant_b=part("2"))]
    c = readers.index_cards(spark, write(tmp_path / "i.jsonl", "\n".join(cards)), "cards")
    assert said(c) == [two("Complex", "1", "2"), ("Complex", ("1", "2", "3"), None, None), two("Phosphorylation", "1", "2", "S", "5"), two("Phosphorylation", "1", "2", "S", "6"), ("Translocation", ("1",), None, None)]
    assert c.statements.where("stmt_type = 'Translocation'").first()["to_location"] == "GO:1"


def test_networks(spark, tmp_path):
    el = lambda i, done=True: {"id": i, "name": i.upper(), "type": "ggp", "completed": done, "association": {"namespace": "HGNC", "id": "HGNC:1", "dbXrefs": [{"db": "ncbi", "id": "5"}, {"db": "zz", "id": "6"}]}}
    act = lambda kind, *e: {"id": kind, "type": kind, "entries": [{"id": i, "group": g} for i, g in e]}
    doc = {"id": "d", "text": "said", "citation": {"pmid": "4"}, "elements": [el("a"), el("b"), el("u", False), act("phosphorylation", ("a", None), ("b", "negative")), act("transcription-translation", ("a", None), ("b", "unsigned")), act("binding", ("a", None), ("b", None)), act("methylation", ("a", None), ("u", "positive"))]}
    c = readers.biofactoid(spark, write(tmp_path / "b.json", json.dumps([doc])))
    assert said(c) == [two("Complex", "A", "B"), two("Inhibition", "A", "B"), two("Phosphorylation", "A", "B")]
    assert c.agents.first()["db_refs"] == {"HGNC": "1", "EGID": "5"} and c.evidence.first()["pmid"] == "4"
    cx = [{"nodes": [{"@id": 1, "n": "A"}, {"@id": 2, "n": "B"}, {"@id": 3, "n": "C"}]}, {"nodeAttributes": [{"po": 1, "n": "alias", "v": ["UniProt:P1", "z"]}]}, {"edges": [{"@id": 7, "s": 1, "t": 2, "i": "phosphorylates"}, {"@id": 8, "s": 1, "t": 3, "i": "binds"}, {"@id": 9, "s": 1, "t": 2, "i": "near"}]}, {"edgeAttributes": [{"po": 7, "n": "ndex:citation", "v": ["pmid:3", "doi:4", "pmid:"]}]}]
    path = write(tmp_path / "n.cx", json.dumps(cx))
    c = readers.ndex_cx(spark, path, "net", spark.createDataFrame([("B", "2")], "symbol string, hgnc string"))
    assert said(c) == [two("Phosphorylation", "A", "B")] and c.evidence.first()["pmid"] == "3"
    assert said(readers.ndex_cx(spark, path, require_grounding=False)) == [two("Complex", "A", "C"), two("Phosphorylation", "A", "B")]
