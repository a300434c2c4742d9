"""Saved output of machine readers and web services: JSON and XML with explicit schemas, exploded and joined with column functions.

References stay as the source has them. Records that do not fit the schema have nulls and give no assertion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ADDING, BOUND, MOD, REMOVING, Corpus
from .relations import arg, assemble, evd, papers, refs, residue, uniprot_refs
from .tabular import _case

def _null() -> Column:
    return F.lit(None).cast("string")


#: Names of modifications as the sources write them, and their types.
BY_NAME = {t.lower(): t for t in (*ADDING, *REMOVING)}


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def _one_of(col: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), col)


# Actions of drugs on targets.
DRUGBANK = {
    **dict.fromkeys("substrate|agonist|inducer|potentiator|stimulator|cofactor|activator|ligand|chaperone|partial agonist|protector|positive allosteric modulator|positive modulator".split("|"), "Activation"),
    **dict.fromkeys("antagonist|inhibitor|binder|antibody|inactivator|binding|blocker|negative modulator|inverse agonist|neutralizer|weak inhibitor|suppressor|disruptor|inhibitory allosteric modulator|N/A".split("|"), "Inhibition"),
    **dict.fromkeys("downregulator|metabolizer|chelator|degradation|incorporation into and destabilization".split("|"), "DecreaseAmount"),
    "stabilization": "IncreaseAmount",
}
_XREFS = "struct<`external-identifier`:array<struct<resource:string,identifier:string>>>"
_TARGET = f"struct<id:string,name:string,actions:struct<action:array<string>>,polypeptide:array<struct<`external-identifiers`:{_XREFS}>>,references:struct<articles:struct<article:array<struct<`pubmed-id`:string>>>,links:struct<link:array<struct<url:string>>>>>"
_DRUG = f"`drugbank-id` array<struct<_VALUE:string,_primary:string>>, name string, `cas-number` string, `external-identifiers` {_XREFS}, targets struct<target:array<{_TARGET}>>"


def drugbank(spark: SparkSession, path: str) -> Corpus:
    """One assertion for each action of a drug on a target; a target without actions is taken as inhibited."""
    rows = spark.read.format("xml").option("rowTag", "drug").option("ignoreNamespace", True).schema(_DRUG).load(path)
    rows = rows.withColumn("t", F.explode("targets.target")).withColumn("action", F.explode(F.when(F.size("t.actions.action") > 0, F.array_distinct("t.actions.action")).otherwise(F.array(F.lit("N/A")))))
    found = lambda xs, name: F.get(F.filter(xs, lambda x: x["resource"] == name), 0)["identifier"]
    mine = F.col("external-identifiers")["external-identifier"]
    theirs = F.flatten(F.transform("t.polypeptide", lambda p: F.coalesce(p["external-identifiers"]["external-identifier"], F.array().cast("array<struct<resource:string,identifier:string>>"))))
    first = F.array_min(F.filter(F.transform("drugbank-id", lambda d: d["_VALUE"]), lambda d: d.startswith("DB")))
    prefix = lambda v, p: F.when(v.startswith(p), v).otherwise(F.concat(F.lit(p), v))
    drug = arg("subj", F.col("name"), refs(DRUGBANK=first, CAS=F.col("cas-number"), CHEMBL=prefix(found(mine, "ChEMBL"), "CHEMBL"), PUBCHEM=found(mine, "PubChem Compound"), CHEBI=prefix(found(mine, "ChEBI"), "CHEBI:")))
    target = arg("obj", F.col("t.name"), F.map_concat(F.when(F.col("t.id").isNotNull(), F.create_map(F.lit("DRUGBANKV4.TARGET"), F.col("t.id"))).otherwise(F.create_map().cast("map<string,string>")), refs(HGNC=F.regexp_replace(found(theirs, "HUGO Gene Nomenclature Committee (HGNC)"), "^HGNC:", ""), UP=found(theirs, "UniProtKB"))))
    note = F.to_json(F.struct(F.col("action").alias("drugbank_action")))
    pmids = F.filter(F.transform("t.references.articles.article", lambda a: a["pubmed-id"]), lambda p: p.isNotNull())
    urls = F.filter(F.transform("t.references.links.link", lambda a: a["url"]), lambda p: p.isNotNull())
    ev = F.when((F.coalesce(F.size(pmids), F.lit(0)) <= 0) & (F.size(urls) > 0), F.transform(urls, lambda u: evd(text_refs=F.create_map(F.lit("URL"), u), annotations=note))).otherwise(papers(pmids, annotations=note))
    return assemble(rows.select(_case("action", DRUGBANK).alias("stmt_type"), F.array(drug, target).alias("args"), ev.alias("evidence")), "drugbank")


# Predicates and their types.
SEMREP = {"TREATS": "Inhibition", "INHIBITS": "Inhibition", "PREVENTS": "Inhibition", "DISRUPTS": "Inhibition", "STIMULATES": "Activation", "COMPLICATES": "Activation", "AUGMENTS": "Activation", "CAUSES": "Activation", "PRODUCES": "IncreaseAmount"}
_UTTERANCE = "_text string, Entity array<struct<_id:string,_cui:string,_name:string,_text:string>>, Predication array<struct<_negated:string,Subject:struct<_entityID:string>,Predicate:struct<_type:string>,Object:struct<_entityID:string>>>"


def semrep(spark: SparkSession, path: str, predicates: dict[str, str] | None = None) -> Corpus:
    """Predications of utterances, their ends found among the utterance's entities."""
    rows = spark.read.format("xml").option("rowTag", "Utterance").schema(_UTTERANCE).load(path).withColumn("p", F.explode("Predication"))
    rows = rows.withColumn("s", F.expr("get(filter(Entity, e -> e._id = p.Subject._entityID), 0)")).withColumn("o", F.expr("get(filter(Entity, e -> e._id = p.Object._entityID), 0)")).where("s is not null and o is not null")
    end = lambda role, x: arg(role, F.col(f"{x}._name"), refs(TEXT=F.col(f"{x}._text"), UMLS=F.col(f"{x}._cui")))
    ev = evd(text=F.col("_text"), annotations=F.to_json(F.struct(F.col("p.Predicate._type").alias("semrep_predicate"))), negated=F.when(F.col("p._negated") == "true", True))
    return assemble(rows.select(_one_of(F.col("p.Predicate._type"), predicates or SEMREP).alias("stmt_type"), F.array(end("subj", "s"), end("obj", "o")).alias("args"), F.array(ev).alias("evidence")), "semrep")


_ENTITY = "struct<entityText:string,entityType:string,sentenceIndex:int,charStart:int,charEnd:int,attribute:array<struct<value:string>>,entityId:array<struct<source:string,idString:string>>>"
_RLIMSP = f"docId string, pmid string, pmcid string, text string, sentence array<struct<charStart:int,charEnd:int,index:int>>, entity map<string,{_ENTITY}>, relation map<string,struct<relationType:string,argument:array<struct<role:string,entity_duid:string>>>>"


def rlimsp(spark: SparkSession, path: str, doc_id_type: str | None = None) -> Corpus:
    """Phosphorylations in paragraphs, one JSON object a line; equal paragraphs count once. A kinase equal to its substrate under a
    trigger with ``auto`` phosphorylates itself. An end with several UniProt or several Entrez ids is left out."""
    rows = _json(spark, path, _RLIMSP, True).where("text is not null").dropDuplicates(["text"])
    given = F.coalesce(refs(PMID=F.col("pmid"), PMCID=F.col("pmcid")), F.create_map().cast("map<string,string>"))
    if doc_id_type:
        given = F.when(F.size(given) > 0, given).otherwise(refs(**{doc_id_type.upper(): F.col("docId")}))
    rows = rows.withColumn("text_refs", given).select("text", "sentence", "entity", "text_refs", F.explode("relation").alias("key", "rel")).where("rel.relationType = 'PHOSPHORYLATION'")
    for c, r in (("enz", "KINASE"), ("sub", "SUBSTRATE"), ("site", "SITE"), ("trig", "TRIGGER")):
        rows = rows.withColumn(c, F.expr(f"try_element_at(entity, get(filter(rel.argument, a -> a.role = '{r}'), 0).entity_duid)"))
    ids = lambda x, s: F.expr(f"get(filter({x}.entityId, e -> e.source = '{s}'), 0).idString")
    several = lambda x: F.expr(f"coalesce(size(filter({x}.entityId, e -> e.source = 'UniProt')) > 1 or size(filter({x}.entityId, e -> e.source = 'Entrez')) > 1, false)")
    chebi = lambda x: F.concat(F.lit("CHEBI:"), ids(x, "CHEBI"))
    end = lambda role, x: arg(role, F.when(~several(x), F.col(f"{x}.entityText")), refs(TEXT=F.col(f"{x}.entityText"), EGID=ids(x, "Entrez"), UP=ids(x, "UniProt"), CHEBI=chebi(x), MESH=F.substring_index(ids(x, "MESH"), ";", 1), OMIM=F.substring_index(ids(x, "OMIM"), ";", 1)))
    auto = F.coalesce((F.col("enz.entityText") == F.col("sub.entityText")) & F.col("trig.entityText").contains("auto"), F.lit(False))
    spot = F.split(F.get("site.attribute", 0)["value"], "-")
    said = F.expr("filter(transform(array(enz, sub, trig, site), e -> e.sentenceIndex), i -> i is not null)")
    lo, hi = F.array_min(said), F.array_max(said)
    lines = F.transform(F.filter("sentence", lambda s: (s["index"] >= lo) & (s["index"] <= hi)), lambda s: F.substring(F.col("text"), s["charStart"] + 1, s["charEnd"] - s["charStart"]))
    text = F.when(lo.isNotNull(), F.concat(F.array_join(lines, ". "), F.lit(".")))
    ev = evd(pmid=F.try_element_at("text_refs", F.lit("PMID")), text=text, text_refs=F.col("text_refs"), annotations=F.to_json(F.struct(F.col("trig.entityText").alias("trigger"))))
    rows = rows.where(F.col("sub.entityText").isNotNull() & ~several("sub"))
    args = F.when(auto, F.array(end("enz", "sub"))).otherwise(F.array(end("enz", "enz"), end("sub", "sub")))
    return assemble(rows.select(F.when(auto, "Autophosphorylation").otherwise("Phosphorylation").alias("stmt_type"), args.alias("args"), F.array(ev).alias("evidence"), residue(spot[0]).alias("residue"), F.when(F.size(spot) == 2, spot[1]).alias("position")), "rlimsp")


# Perturbations of a gene that lower it or raise it.
CREEDS_LOWERS = ("ko", "deletion", "null mutation", "kd", "deficiency (mutation)", "silencing", "heterozygotic knockout (nf1+/-)", "shrna", "druginhibition", "drug inhibition", "inhibition", "inactivation  (ikk inhibition)", "deficiency", "depletion", "depletion - sirna simut12", "small molecule inhibition", "defectivemutant", "inactivation", "drug", "knockout", "knockdown")
CREEDS_RAISES = ("induction", "knock-in", "oe", "overexpression", "stimulation of gene product", "agonist activation", "drugactivation", "activemutant", "activation (deltanb-cateniner transgenics)", "increase", "activation")
_CREEDS = "id string, hs_gene_symbol string, pert_type string, geo_id string, organism string, cell_type string, do_id string, umls_cui string, disease_name string, smiles string, pubchem_cid string, drugbank_id string, drug_name string, up_genes array<array<string>>, down_genes array<array<string>>"


def creeds(spark: SparkSession, path: str, kind: str = "gene", lines: bool = False, genes: DataFrame | None = None) -> Corpus:
    """Genes whose expression a perturbed gene, a disease or a chemical changes. Lowering a gene and seeing another rise means that
    it decreases the other. ``genes(symbol, hgnc)`` names human targets, and targets it lacks are left out; without it all stay."""
    rows = _json(spark, path, _CREEDS, lines)
    pert = F.lower(F.trim("pert_type"))
    if kind == "gene":
        raises = F.when(pert.isin(*CREEDS_RAISES), True).when(pert.isin(*CREEDS_LOWERS), False)
        subj = arg("subj", F.col("hs_gene_symbol"), refs(EGID=F.regexp_replace("id", "^gene:", "")))
    elif kind == "disease":
        raises, subj = F.lit(True), arg("subj", F.col("disease_name"), refs(DOID=F.col("do_id"), UMLS=F.col("umls_cui")))
    else:
        raises, subj = F.lit(True), arg("subj", F.col("drug_name"), refs(SMILES=F.col("smiles"), PUBCHEM=F.col("pubchem_cid"), DRUGBANK=F.col("drugbank_id")))
    pairs = lambda c, up: F.transform(F.coalesce(c, F.array().cast("array<array<string>>")), lambda g: F.struct(g[0].alias("symbol"), F.lit(up).alias("up")))
    rows = rows.withColumn("raises", raises).where("raises is not null").select("raises", subj.alias("subj"), "organism", "geo_id", "cell_type", F.explode(F.concat(pairs(F.col("up_genes"), True), pairs(F.col("down_genes"), False))).alias("g"))
    hgnc = _null()
    if genes is not None:
        rows = rows.join(genes.select(F.col("symbol").alias("__s"), "hgnc"), F.col("g.symbol") == F.col("__s"), "left").where("organism <> 'human' or hgnc is not null")
        hgnc = F.when(F.col("organism") == "human", F.col("hgnc"))
    ev = evd(annotations=F.to_json(F.struct("cell_type", F.col("geo_id").alias("geo"), "organism")))
    return assemble(rows.select(F.when(F.col("raises") == F.col("g.up"), "IncreaseAmount").otherwise("DecreaseAmount").alias("stmt_type"), F.array("subj", arg("obj", F.col("g.symbol"), refs(TEXT=F.col("g.symbol"), HGNC=hgnc))).alias("args"), F.array(ev).alias("evidence")), "creeds")


# Databases that are read on their own.
OMNIPATH_KNOWN = ("netpath", "signor", "protmapper", "biogrid", "hprd-phos", "phosphoelm")


def _cited(checks: Column) -> Column:
    """``database:reference`` entries of databases that are not read elsewhere, as (db, ref)."""
    each = F.transform("references", lambda r: F.struct(F.substring_index(r, ":", 1).alias("db"), F.regexp_replace(r, "^[^:]*:", "").alias("ref")))
    return F.filter(each, lambda x: ~F.lower(x["db"]).isin(*OMNIPATH_KNOWN) & (checks if checks is not None else F.lit(True)))


def omnipath_mods(spark: SparkSession, path: str, lines: bool = False) -> Corpus:
    """Modifications with at least one reference of a database that is not read elsewhere."""
    rows = _json(spark, path, "enzyme string, substrate string, residue_type string, residue_offset string, modification string, references array<string>", lines)
    rows = rows.withColumn("c", _cited(None)).where(F.size("c") > 0)
    pmc = lambda x: F.lower(x["ref"]).contains("pmc")
    ok = lambda x: x["ref"].rlike(r"^\d+$")
    ev = F.transform("c", lambda x: evd(source_id=x["db"], pmid=F.when(ok(x), x["ref"]), text_refs=F.when(pmc(x), F.create_map(F.lit("PMCID"), F.element_at(F.split(x["ref"], "/"), -1))).when(ok(x), F.create_map(F.lit("PMID"), x["ref"]))))
    end = lambda role, c: arg(role, F.col(c), uniprot_refs(F.col(c)))
    return assemble(rows.select(_case("modification", BY_NAME).alias("stmt_type"), F.array(end("enz", "enzyme"), end("sub", "substrate")).alias("args"), ev.alias("evidence"), residue(F.col("residue_type")).alias("residue"), F.col("residue_offset").alias("position")), "omnipath")


def omnipath_ligrec(spark: SparkSession, path: str, lines: bool = False) -> Corpus:
    """Ligands and receptors bind; where the sources agree on one sign, the ligand also activates or inhibits. ``COMPLEX:a_b`` is
    every member of a binding, and its first member with the others bound in a regulation."""
    rows = _json(spark, path, "source string, target string, sources array<string>, references array<string>, consensus_stimulation string, consensus_inhibition string", lines)
    rows = rows.withColumn("c", F.filter(_cited(None), lambda x: F.length(x["ref"]) <= 8)).where(F.size("c") > 0)
    rows = rows.where(~F.coalesce((F.size("sources") == 1) & F.lower(F.col("sources")[0]).isin(*OMNIPATH_KNOWN), F.lit(False)))
    many = lambda c: F.when(F.lower(c).contains("complex"), F.split(F.substring_index(c, ":", -1), "_")).otherwise(F.array(c))
    whole = lambda role, c: arg(role, many(F.col(c))[0], uniprot_refs(many(F.col(c))[0]), bound=F.transform(F.slice(many(F.col(c)), 2, 1000), lambda m: F.struct(m.alias("name"), uniprot_refs(m).alias("db_refs"), F.lit(True).alias("is_bound"))).cast(f"array<{BOUND}>"))
    yes = lambda c: F.lower(F.coalesce(F.col(c), F.lit("0"))).isin("1", "true")
    up, down = yes("consensus_stimulation"), yes("consensus_inhibition")
    body = F.transform(F.concat(many(F.col("source")), many(F.col("target"))), lambda m: arg("member", m, uniprot_refs(m)))
    kinds = F.array(F.struct(F.lit("Complex").alias("kind"), body.alias("args")), F.struct(F.when(up & ~down, "Activation").when(down & ~up, "Inhibition").alias("kind"), F.array(whole("subj", "source"), whole("obj", "target")).alias("args")))
    ev = F.transform("c", lambda x: evd(source_id=x["db"], pmid=x["ref"], text_refs=F.create_map(F.lit("PMID"), x["ref"])))
    return assemble(rows.select(F.explode(kinds).alias("x"), ev.alias("evidence")).select(F.col("x.kind").alias("stmt_type"), F.col("x.args").alias("args"), "evidence"), "omnipath")


_MOD_FEATURE = "feature_type:string,modification_type:string,aa_code:string,location:string"
_PART = f"entity_type:string,entity_text:array<string>,identifier:string,features:array<struct<{_MOD_FEATURE}>>"
_CARD = f"pmc_id string, evidence array<string>, interaction struct<interaction_type:string,participant_a:struct<{_PART},entities:array<struct<{_PART}>>>,participant_b:struct<{_PART}>,modifications:array<struct<{_MOD_FEATURE}>>,from_location_id:string,to_location_id:string>"


def index_cards(spark: SparkSession, path: str, source_api: str, lines: bool = True) -> Corpus:
    """Modifications (one for each), bindings, complexes of two members or more, translocations; increases and decreases give nothing."""
    rows = _json(spark, path, _CARD, lines).select("pmc_id", "evidence", "interaction.*")

    def end(role: str, p: Column) -> Column:
        text, ac = F.get(p["entity_text"], 0), p["identifier"]
        db, rest = F.lower(F.substring_index(ac, ":", 1)), F.substring_index(ac, ":", -1)
        known = (ac == "GENERIC") | p["entity_type"].isin("protein", "chemical", "gene", "protein_family")
        mods = F.transform(F.filter(p["features"], lambda f: f["feature_type"] == "modification_feature"), lambda f: F.struct(f["modification_type"].alias("mod_type"), f["aa_code"].alias("residue"), f["location"].alias("position"), F.lit(True).alias("is_modified")))
        return arg(role, F.when(known, text), refs(TEXT=text, UP=F.when(db == "uniprot", rest), PUBCHEM=F.when(db == "pubchem", rest), HGNC=F.when(db == "hgnc", rest)), mods=mods.cast(f"array<{MOD}>"))

    said = F.transform(F.coalesce("evidence", F.array().cast("array<string>")), lambda t: evd(text=t, text_refs=refs(PMCID=F.col("pmc_id"))))
    a, b, kind = end("subj", F.col("participant_a")), end("obj", F.col("participant_b")), F.col("interaction_type")
    one = lambda k, args, r=_null(), p=_null(): F.struct(k.alias("kind"), args.alias("args"), r.alias("residue"), p.alias("position"))
    members = F.filter(F.transform("participant_a.entities", lambda e: end("member", e)), lambda m: m["name"].isNotNull())
    none = F.filter(F.array(one(_null(), F.array(a))), lambda x: F.lit(False))
    out = (
        F.when(kind.isin("adds_modification", "removes_modification") & b["name"].isNotNull(), F.transform("modifications", lambda m: one(_one_of(F.lower(m["modification_type"]), BY_NAME), F.array(a, b), m["aa_code"], m["location"])))
        .when((kind == "binds") & a["name"].isNotNull() & b["name"].isNotNull(), F.array(one(F.lit("Complex"), F.array(a, b))))
        .when((kind == "complexes_with") & (F.size(members) >= 2), F.array(one(F.lit("Complex"), members)))
        .when((kind == "translocates") & b["name"].isNotNull() & F.coalesce("from_location_id", "to_location_id").isNotNull(), F.array(one(F.lit("Translocation"), F.array(b))))
        .otherwise(none)
    )
    moved = lambda c: F.when(F.col("x.kind") == "Translocation", F.col(c))
    found = rows.withColumn("said", said).withColumn("x", F.explode(out))
    return assemble(found.select(F.col("x.kind").alias("stmt_type"), F.col("x.args").alias("args"), F.col("said").alias("evidence"), F.col("x.residue").alias("residue"), F.col("x.position").alias("position"), moved("from_location_id").alias("from_location"), moved("to_location_id").alias("to_location")), source_api)


# Interactions with an enzyme and a substrate, and databases of references.
BIOFACTOID_MODS = {"modification": "AddModification", "phosphorylation": "Phosphorylation", "methylation": "Methylation", "demethylation": "Demethylation", "ubiquitination": "Ubiquitination", "deubiquitination": "Deubiquitination"}
BIOFACTOID_DBS = {"Ensembl": "ENSEMBL", "ncbi": "EGID", "MGI": "MGI", "RGD": "RGD"}
_ELEMENT = "struct<id:string,name:string,type:string,completed:boolean,association:struct<namespace:string,id:string,dbXrefs:array<struct<db:string,id:string>>>,entries:array<struct<id:string,`group`:string>>>"
_FACTOID = f"id string, text string, createdDate string, citation struct<pmid:string,doi:string>, elements array<{_ELEMENT}>"


def biofactoid(spark: SparkSession, path: str, lines: bool = False) -> Corpus:
    """Interactions among a document's elements. Signed modifications also regulate; a binding has all its members; transcriptions
    need a sign. Elements that are not completed have no reference and give no end."""
    rows = _json(spark, path, _FACTOID, lines).withColumn("i", F.explode("elements")).where("i.entries is not null")

    def end(role: str, e: Column) -> Column:
        pairs = F.concat(F.array(F.struct(e["association"]["namespace"].alias("db"), e["association"]["id"].alias("id"))), F.coalesce(e["association"]["dbXrefs"], F.array().cast("array<struct<db:string,id:string>>")))
        mapped = F.transform(pairs, lambda p: F.struct(F.when(p["db"].isin("HGNC"), "HGNC").when(p["db"] == "ChEBI", "CHEBI").otherwise(_one_of(p["db"], BIOFACTOID_DBS)).alias("key"), F.when(p["db"] == "HGNC", F.regexp_replace(p["id"], "HGNC:", "")).when(p["db"] == "ChEBI", F.concat(F.lit("CHEBI:"), p["id"])).otherwise(p["id"]).alias("value")))
        good = F.filter(mapped, lambda m: m["key"].isNotNull() & m["value"].isNotNull())
        keys = F.array_distinct(F.transform(good, lambda m: m["key"]))
        last = F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(good, lambda m: m["key"] == k), -1)["value"]))
        return arg(role, F.when(e["completed"], e["name"]), last)

    of = lambda sign: F.expr(f"get(filter(i.entries, e -> e.`group` {sign}), 0).id")
    element = lambda at: F.get(F.filter("elements", lambda e: e["id"] == at), 0)
    sign = F.when(of("= 'positive'").isNotNull(), "positive").when(of("= 'unsigned'").isNotNull(), "unsigned").when(of("= 'negative'").isNotNull(), "negative")
    rows = rows.withColumn("sign", sign).withColumn("s", element(of("is null"))).withColumn("o", element(F.coalesce(of("= 'positive'"), of("= 'unsigned'"), of("= 'negative'"))))
    subj, obj, kind = end("subj", F.col("s")), end("obj", F.col("o")), F.col("i.type")
    pair, both = F.array(subj, obj), subj["name"].isNotNull() & obj["name"].isNotNull()
    one = lambda k, args: F.struct(k.alias("kind"), args.alias("args"))
    effect = F.when(F.col("sign") == "positive", "Activation").when(F.col("sign") == "negative", "Inhibition")
    amount = F.when(F.col("sign") == "positive", "IncreaseAmount").when(F.col("sign") == "negative", "DecreaseAmount")
    members = F.filter(F.transform("i.entries", lambda e: end("member", element(e["id"]))), lambda m: m["name"].isNotNull())
    out = F.when(kind.isin(*BIOFACTOID_MODS) & both, F.array(one(_one_of(kind, BIOFACTOID_MODS), pair), one(effect, pair))).when((kind == "transcription-translation") & both, F.array(one(amount, pair))).when(kind == "binding", F.array(one(F.lit("Complex"), members)))
    ev = evd(pmid=F.col("citation.pmid"), text=F.col("text"), text_refs=refs(PMID=F.col("citation.pmid"), DOI=F.col("citation.doi")), annotations=F.to_json(F.struct(F.col("id").alias("biofactoid_document"), "createdDate")))
    return assemble(rows.select(F.explode(out).alias("x"), ev.alias("ev")).select(F.col("x.kind").alias("stmt_type"), F.col("x.args").alias("args"), F.array("ev").alias("evidence")), "biofactoid")


# Interactions of exchanged networks and their types.
CX = {"phosphorylates": "Phosphorylation", "controls-phosphorylation-of": "Phosphorylation", "in-complex-with": "Complex", "NEGATIVE_INFLUENCE": "Inhibition", "POSITIVE_INFLUENCE": "Activation", "binds": "Complex", "interacts with": "Complex"}
_ATTR = "array<struct<po:long,n:string,v:string>>"
_CX = f"nodes array<struct<`@id`:long,n:string>>, edges array<struct<`@id`:long,s:long,t:long,i:string>>, nodeAttributes {_ATTR}, edgeAttributes {_ATTR}"


def ndex_cx(spark: SparkSession, path: str, network_id: str | None = None, genes: DataFrame | None = None, require_grounding: bool = True) -> Corpus:
    """Aspects of a network (an array of objects). A node is grounded by its UniProt alias or, by name, by ``genes(symbol, hgnc)``;
    ungrounded nodes and their edges are left out unless ``require_grounding`` is false."""
    raw = _json(spark, path, _CX, False)
    part = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    listed = lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array(v))
    alias = part("nodeAttributes").where("n = 'alias'").select(F.col("po").alias("id"), F.explode(listed(F.col("v"))).alias("a"))
    up = alias.where(F.substring_index("a", ":", 1).isin("UniProt", "uniprot knowledgebase")).groupBy("id").agg(F.min(F.substring_index("a", ":", -1)).alias("up"))
    nodes = part("nodes").select(F.col("@id").alias("id"), F.col("n").alias("name")).join(up, "id", "left")
    nodes = nodes.join(genes.select(F.col("symbol").alias("name"), "hgnc"), "name", "left") if genes is not None else nodes.withColumn("hgnc", _null())
    if require_grounding:
        nodes = nodes.where("up is not null or hgnc is not null")
    end = lambda role, x: nodes.select(F.col("id").alias(x), arg(role, F.col("name"), refs(TEXT=F.col("name"), UP=F.col("up"), HGNC=F.col("hgnc"))).alias(role))
    cited = part("edgeAttributes").where("n in ('ndex:citation', 'citation_ids')").select(F.col("po").alias("id"), F.explode(listed(F.col("v"))).alias("c")).where(F.upper("c").rlike("^PMID:.+"))
    pmids = cited.groupBy("id").agg(F.array_sort(F.collect_set(F.expr("substring(c, 6)"))).alias("pmids"))
    edges = part("edges").select(F.col("@id").alias("id"), "s", "t", F.col("i").alias("kind")).join(end("subj", "s"), "s").join(end("obj", "t"), "t").join(pmids, "id", "left")
    return assemble(edges.select(_case("kind", CX).alias("stmt_type"), F.array("subj", "obj").alias("args"), papers(F.col("pmids"), source_id=F.lit(network_id), annotations=F.to_json(F.struct(F.col("id").alias("edge_id")))).alias("evidence")), "ndex")
