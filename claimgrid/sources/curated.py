"""Readers of curated tables with more than two arguments, several assertions a row, or several files.

Readers leave references as the source has them; ``operators.ontology`` standardises names and references. All joins are left
to the optimiser: id tables of a release are far smaller than its interactions, and adaptive execution sees their size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ontology import closure
from ..schema import ADDING, BOUND, MOD, REMOVING, Corpus
from .relations import arg, assemble, evd, papers, refs, residue, uniprot_refs
from .tabular import _case, _csv


def _null() -> Column:
    return F.lit(None).cast("string")


# signor

# Effects and mechanisms, and the types they stand for.
SIGNOR_EFFECTS = {
    "down-regulates": "Inhibition", "down-regulates activity": "Inhibition", "down-regulates quantity": "DecreaseAmount", "down-regulates quantity by destabilization": "DecreaseAmount", "down-regulates quantity by repression": "DecreaseAmount",
    "form complex": "Complex", "up-regulates": "Activation", "up-regulates activity": "Activation", "up-regulates quantity": "IncreaseAmount", "up-regulates quantity by expression": "IncreaseAmount", "up-regulates quantity by stabilization": "IncreaseAmount",
}
SIGNOR_MECHANISMS = {
    "Farnesylation": "Farnesylation", "gtpase-activating protein": "Gap", "deacetylation": "Deacetylation", "demethylation": "Demethylation", "dephosphorylation": "Dephosphorylation", "destabilization": "DecreaseAmount", "guanine nucleotide exchange factor": "Gef",
    "acetylation": "Acetylation", "binding": "Complex", "desumoylation": "Desumoylation", "deubiquitination": "Deubiquitination", "glycosylation": "Glycosylation", "hydroxylation": "Hydroxylation", "chemical activation": "Activation", "chemical inhibition": "Inhibition",
    "trimethylation": "Methylation", "ubiquitination": "Ubiquitination", "monoubiquitination": "Ubiquitination", "polyubiquitination": "Ubiquitination", "methylation": "Methylation", "palmitoylation": "Palmitoylation", "phosphorylation": "Phosphorylation", "stabilization": "IncreaseAmount", "sumoylation": "Sumoylation",
}
# Mechanism, effects and the one type that they stand for together.
SIGNOR_PAIRS = (
    ("transcriptional regulation", ("up-regulates", "up-regulates quantity", "up-regulates quantity by expression"), "IncreaseAmount"),
    ("transcriptional regulation", ("down-regulates", "down-regulates quantity", "down-regulates quantity by repression"), "DecreaseAmount"),
    ("stabilization", ("up-regulates", "up-regulates quantity", "up-regulates quantity by stabilization"), "IncreaseAmount"),
    ("destabilization", ("down-regulates", "down-regulates quantity", "down-regulates quantity by destabilization"), "DecreaseAmount"),
    ("chemical activation", ("up-regulates", "up-regulates activity"), "Activation"),
    ("chemical inhibition", ("down-regulates", "down-regulates activity"), "Inhibition"),
    ("binding", ("form complex",), "Complex"),
)
# Databases of entities that are no proteins, and their namespaces.
SIGNOR_DBS = {"SIGNOR": "SIGNOR", "PUBCHEM": "PUBCHEM", "ChEBI": "CHEBI", "miRBase": "MIRBASE", "DRUGBANK": "DRUGBANK", "RNAcentral": "RNACENTRAL"}


def signor_members(spark: SparkSession, path: str) -> DataFrame:
    """(complex, members): the members of each complex that are no complexes themselves, nested ones opened, each once, sorted."""
    rows = _csv(spark, path, ["complex", "name", "list"], sep=";", quote='"').where("complex <> 'SIGNOR ID'")
    pairs = rows.select("complex", F.explode(F.split("list", r",\s*")).alias("m")).select("complex", F.trim("m").alias("m")).where("m <> ''")
    edges = pairs.select(F.lit("x").alias("s_ns"), F.col("complex").alias("s_id"), F.lit("x").alias("t_ns"), F.col("m").alias("t_id"), F.lit("partof").alias("rel"))
    heads = pairs.select(F.col("complex").alias("p_id")).distinct()
    leaves = closure(edges).join(heads, "p_id", "left_anti")
    return leaves.groupBy(F.col("id").alias("complex")).agg(F.array_sort(F.collect_set("p_id")).alias("members"))


def _signor_member(m: Column) -> Column:
    r = F.when(m.startswith("CHEBI"), refs(CHEBI=m)).when(m.startswith("SIGNOR"), refs(SIGNOR=m)).otherwise(uniprot_refs(m))
    return F.struct(m.alias("name"), r.alias("db_refs"), F.lit(True).alias("is_bound"))


def signor(spark: SparkSession, path: str, complexes: str | None = None) -> Corpus:
    """A row gives one assertion for a known pair of mechanism and effect; otherwise one for its effect, one for its mechanism
    (a modification: one for each site) and the active form that both imply. Each complex of two or more members gives one."""
    rows = _csv(spark, path, sep=";", header=True, quote='"', escape='"', multiLine="true")
    members = signor_members(spark, complexes) if complexes else spark.createDataFrame([], "complex string, members array<string>")

    def side(x: str) -> Column:
        kind, ac, db, parts = F.col(f"TYPE{x}"), F.trim(F.col(f"ID{x}")), F.col(f"DATABASE{x}"), F.transform(F.col(f"members{x}"), _signor_member)
        pid = F.trim(F.regexp_replace(ac, "^[CS]ID:", ""))
        ns = F.when((kind == "mirna") & ac.startswith("URS"), "RNACENTRAL").when(db.isin("PUBCHEM", "ChEBI") & ac.startswith("SID:"), "PUBCHEM.SUBSTANCE").otherwise(_case(f"DATABASE{x}", SIGNOR_DBS))
        r = F.when(db == "UNIPROT", uniprot_refs(ac)).when(ns.isNotNull() & (ac != ""), F.create_map(ns, pid)).otherwise(F.create_map().cast("map<string,string>"))
        whole = F.struct(F.when(parts.isNull(), F.col(f"ENTITY{x}")).otherwise(parts[0]["name"]).alias("name"), F.when(parts.isNull(), r).otherwise(parts[0]["db_refs"]).alias("db_refs"), F.slice(parts, 2, 1000000).cast(f"array<{BOUND}>").alias("bound"))
        return whole

    for x in ("A", "B"):
        rows = rows.join(members.select(F.col("complex").alias(f"ID{x}"), F.col("members").alias(f"members{x}")), f"ID{x}", "left")
    both = None
    for mech, effects, kind in SIGNOR_PAIRS:
        hit = (F.col("MECHANISM") == mech) & F.col("EFFECT").isin(*effects)
        both = F.when(hit, kind) if both is None else both.when(hit, kind)
    effect, mech = _case("EFFECT", SIGNOR_EFFECTS), _case("MECHANISM", SIGNOR_MECHANISMS)
    site = lambda s: F.struct(residue(F.regexp_extract(s, r"^\s*([A-Za-z]+)", 1)).alias("residue"), F.nullif(F.regexp_extract(s, r"(\d+)\s*$", 1), F.lit("")).alias("position"))
    sites = F.when(F.coalesce(F.col("RESIDUE"), F.lit("")) == "", F.array(F.struct(_null().alias("residue"), _null().alias("position")))).otherwise(F.transform(F.split("RESIDUE", ";"), site))
    rows = rows.withColumn("a", side("A")).withColumn("b", side("B")).withColumn("both", both).withColumn("outcome", effect).withColumn("mech", mech).withColumn("sites", sites).where("a.name is not null and b.name is not null")
    changes, up, down = F.col("mech").isin(*ADDING, *REMOVING), F.coalesce(F.col("EFFECT").startswith("up"), F.lit(False)), F.coalesce(F.col("EFFECT").startswith("down"), F.lit(False))
    one = lambda kind, s=None, form="", active=None: F.struct(kind.alias("kind"), (s["residue"] if s is not None else _null()).alias("residue"), (s["position"] if s is not None else _null()).alias("position"), F.lit(form).alias("form"), (active if active is not None else F.lit(None).cast("boolean")).alias("active"))
    none = F.filter(F.array(one(_null())), lambda x: F.lit(False))
    form = lambda name, active: F.array(one(F.lit("ActiveForm"), form=name, active=active))
    apart = F.concat(
        F.array(one(F.col("outcome"))),
        F.when(changes, F.transform("sites", lambda s: one(F.col("mech"), s))).otherwise(F.array(one(F.col("mech")))),
        F.when(changes & F.col("outcome").isNotNull(), form("mods", F.col("mech").isin(*ADDING) == up)).when((F.col("mech") == "Complex") & (up | down), form("bound", up)).otherwise(none),
    )
    found = rows.withColumn("x", F.explode(F.filter(F.when(F.col("both").isNotNull(), F.array(one(F.col("both")))).otherwise(apart), lambda x: x["kind"].isNotNull())))
    kind, active_form = F.col("x.kind"), F.col("x.kind") == "ActiveForm"
    mod_type = F.lower("mech")
    base = F.when(F.col("mech").isin(*REMOVING), F.regexp_replace(mod_type, "^de", "")).otherwise(mod_type)
    mods = F.transform("sites", lambda s: F.struct(base.alias("mod_type"), s["residue"].alias("residue"), s["position"].alias("position"), F.col("mech").isin(*ADDING).alias("is_modified"))).cast(f"array<{MOD}>")
    transcribes = (F.col("MECHANISM") == "transcriptional regulation") & F.col("both").isNotNull()
    a = arg("subj", F.col("a.name"), F.col("a.db_refs"), bound=F.col("a.bound"), activity=F.when(transcribes, F.struct(F.lit("transcription").alias("activity_type"), F.lit(True).alias("is_active"))))
    b = arg("obj", F.col("b.name"), F.col("b.db_refs"), bound=F.col("b.bound"))
    partner = F.array(F.struct(F.col("a.name").alias("name"), F.col("a.db_refs").alias("db_refs"), F.lit(True).alias("is_bound"))).cast(f"array<{BOUND}>")
    state = arg("agent", F.col("b.name"), F.col("b.db_refs"), mods=F.when(F.col("x.form") == "mods", mods), bound=F.when(F.col("x.form") == "bound", partner).otherwise(F.col("b.bound")))
    p = F.col("PMID")
    number = p.rlike(r"^\d+")
    text_refs = F.when(number, F.create_map(F.lit("PMID"), p)).when(p.startswith("PMC"), F.create_map(F.lit("PMCID"), p)).when(p.startswith("NBK"), F.create_map(F.lit("NCBIBOOK"), p))
    ev = evd(source_id=F.col("SIGNOR_ID"), pmid=F.when(number, p), text=F.col("SENTENCE"), text_refs=text_refs, annotations=F.to_json(F.struct("SEQUENCE", "NOTES", "ANNOTATOR", "TAX_ID", "CELL_DATA", "TISSUE_DATA")), direct=F.coalesce(F.col("DIRECT") == "YES", F.lit(False)))
    out = found.select(kind.alias("stmt_type"), F.when(active_form, F.array(state)).otherwise(F.array(a, b)).alias("args"), F.array(ev).alias("evidence"), F.col("x.residue").alias("residue"), F.col("x.position").alias("position"), F.when(active_form, "activity").alias("activity"), F.col("x.active").alias("is_active"))
    bodies = members.where(F.size("members") >= 2).select(F.lit("Complex").alias("stmt_type"), F.transform(F.transform("members", _signor_member), lambda m: arg("member", m["name"], m["db_refs"])).alias("args"), F.array(evd(source_id=F.col("complex"), text=F.concat(F.lit("Inferred from SIGNOR complex "), "complex"))).alias("evidence"), _null().alias("residue"), _null().alias("position"), _null().alias("activity"), F.lit(None).cast("boolean").alias("is_active"))
    return assemble(out.unionByName(bodies), "signor")


# ctd

# Actions on a gene, and their types when they increase and decrease.
CTD = {
    "activity": ("Activation", "Inhibition"), "expression": ("IncreaseAmount", "DecreaseAmount"), "chemical synthesis": ("IncreaseAmount", "DecreaseAmount"), "degradation": ("DecreaseAmount", "IncreaseAmount"), "abundance": ("IncreaseAmount", "DecreaseAmount"), "stability": ("IncreaseAmount", "DecreaseAmount"),
    "phosphorylation": ("Phosphorylation", "Dephosphorylation"), "acetylation": ("Acetylation", "Deacetylation"), "ubiquitination": ("Ubiquitination", "Deubiquitination"), "hydroxylation": ("Hydroxylation", "Dehydroxylation"), "methylation": ("Methylation", "Demethylation"), "farnesylation": ("Farnesylation", "Defarnesylation"),
    "palmitoylation": ("Palmitoylation", "Depalmitoylation"), "ribosylation": ("Ribosylation", "Deribosylation"), "sumoylation": ("Sumoylation", "Desumoylation"),
}
CTD_COLUMNS = {
    "chemical_gene": "c_name c_mesh c_cas g_name g_egid forms organism tax text rels pmids",
    "chemical_disease": "c_name c_mesh c_cas d_name d_id direct inferred score omim pmids",
    "gene_disease": "g_name g_egid d_name d_id direct inferred score omim pmids",
}


def ctd(spark: SparkSession, path: str, subset: str = "chemical_gene") -> Corpus:
    """Chemicals and genes: one assertion for each known action; where a reaction is meant, only rows that begin with the chemical
    count, and a decreased reaction turns the signs. The other subsets: therapeutic rows inhibit the disease."""
    rows = _csv(spark, path, CTD_COLUMNS[subset].split(), comment="#")
    chemical = lambda role: arg(role, F.col("c_name"), refs(MESH=F.col("c_mesh"), CAS=F.col("c_cas")))
    gene = lambda role: arg(role, F.col("g_name"), refs(EGID=F.col("g_egid")))
    disease = arg("obj", F.col("d_name"), F.when(F.col("d_id").contains(":"), F.create_map(F.split("d_id", ":")[0], F.split("d_id", ":")[1]))) if subset != "chemical_gene" else None
    cited = F.split("pmids", r"\|")
    if subset != "chemical_gene":
        first = chemical("subj") if subset == "chemical_disease" else gene("subj")
        return assemble(rows.where("direct = 'therapeutic'").select(F.lit("Inhibition").alias("stmt_type"), F.array(first, disease).alias("args"), papers(cited, annotations=F.lit('{"direct_evidence":"therapeutic"}')).alias("evidence")), "ctd")
    reacts, less = F.exists(F.col("all"), lambda r: r.contains("reaction")), F.array_contains("all", "decreases^reaction")
    rows = rows.withColumn("all", F.split("rels", r"\|")).where(~reacts | F.coalesce(F.col("text").startswith(F.col("c_name")), F.lit(False)))
    types = lambda k: F.create_map(*(F.lit(v) for action, t in CTD.items() for v in (f"increases^{action}", t[k], f"decreases^{action}", t[1 - k])))
    each = rows.withColumn("turned", less).withColumn("r", F.explode(F.array_distinct("all")))
    kind = F.when(F.col("turned"), F.try_element_at(types(1), F.col("r"))).otherwise(F.try_element_at(types(0), F.col("r")))
    return assemble(each.select(kind.alias("stmt_type"), F.array(chemical("subj"), gene("obj")).alias("args"), papers(cited, annotations=F.to_json(F.struct(F.col("r").alias("interaction_action"), "organism", "tax"))).alias("evidence")), "ctd")


# gnbr

# Themes of dependency paths by the kinds of their ends.
GNBR = {
    ("gene", "gene"): {"V+": "Activation", "E+": "IncreaseAmount", "Q": "IncreaseAmount", "H": "Complex"},
    ("chemical", "gene"): {"A+": "Activation", "A-": "Inhibition", "N": "Inhibition", "B": "Complex", "E-": "DecreaseAmount"},
    ("gene", "disease"): {"Te": "Inhibition", "G": "Activation"},
    ("chemical", "disease"): {"T": "Inhibition", "C": "Inhibition", "Pr": "Inhibition", "Pa": "Inhibition"},
}
GNBR_PART2 = "id sentence_num nm_1_form nm_1_loc nm_2_form nm_2_loc nm_1_raw nm_2_raw nm_1_dbid nm_2_dbid type_1 type_2 path sentence".split()


def gnbr(spark: SparkSession, part1: str, part2: str, first: str = "gene", second: str = "gene", indicator_only: bool = True) -> Corpus:
    """Themes of a path joined once with its sentences (not once a theme); several ids of an end give the product of both ends.
    Ids of an unknown form give an end with its text only."""
    scores = _csv(spark, part1, sep="\t", header=True)
    shown = lambda t: (F.col(f"`{t}`").cast("double") > 0) & ((F.col(f"`{t}.ind`").cast("double") == 1) if indicator_only else F.lit(True))
    themes = F.filter(F.array(*(F.when(shown(t), F.struct(F.lit(t).alias("theme"), F.lit(k).alias("kind"))) for t, k in GNBR[first, second].items())), lambda x: x.isNotNull())
    paths = scores.select(F.lower("path").alias("path"), F.explode(themes).alias("t"))
    said = _csv(spark, part2, GNBR_PART2, nullValue="null", quote="").withColumn("path", F.lower("path"))

    def ends(kind: str, n: int) -> Column:
        raw, ac = F.col(f"nm_{n}_raw"), F.col(f"nm_{n}_dbid")
        many = F.split(ac, {"gene": ";", "chemical": r"\|"}.get(kind, r"\n"))
        mesh = lambda i: F.nullif(F.regexp_extract(i, r"^(?:MESH:)?([CD]\d+)$", 1), F.lit(""))
        ids = {
            "gene": lambda i: refs(TEXT=raw, EGID=F.regexp_extract(i, r"^(\d+)(?:\(Tax:\d+\))?$", 1)),
            "chemical": lambda i: refs(TEXT=raw, CHEBI=F.regexp_extract(i, r"^(CHEBI:\d+)$", 1), MESH=mesh(i)),
            "disease": lambda i: refs(TEXT=raw, OMIM=F.regexp_extract(i, r"^(?:OMIM:)?(\d+)$", 1), MESH=mesh(i)),
        }[kind]
        role = ("subj", "obj")[n - 1]
        return F.when(ac.isNotNull(), F.transform(many, lambda i: arg(role, F.coalesce(raw, i), ids(i)))).when(raw.isNotNull(), F.array(arg(role, raw, refs(TEXT=raw))))

    rows = said.join(paths, "path").withColumn("a", F.explode(ends(first, 1))).withColumn("b", F.explode(ends(second, 2)))
    ev = evd(pmid=F.col("id"), text=F.col("sentence"), text_refs=F.when(F.col("id").isNotNull(), F.create_map(F.lit("PMID"), F.col("id"))))
    return assemble(rows.select(F.col("t.kind").alias("stmt_type"), F.array("a", "b").alias("args"), F.array(ev).alias("evidence")), "gnbr")


# hprd

# Modifications that have a type.
HPRD = ("Acetylation", "Deacetylation", "Deglycosylation", "Demethylation", "Dephosphorylation", "Farnesylation", "Glycosylation", "Hydroxylation", "Methylation", "Myristoylation", "Palmitoylation", "Phosphorylation", "Sumoylation", "Ubiquitination")


def hprd(spark: SparkSession, ids: str, complexes: str | None = None, ptms: str | None = None, ppis: str | None = None) -> Corpus:
    """Complexes (two members or more with a gene id), modifications with sites, and pairs; members without a gene id are left out."""
    null = {"nullValue": "-"}
    table = _csv(spark, ids, "hprd symbol refseq_gene refseq egid omim up name".split(), **null).where("egid is not null")
    who = table.select("hprd", F.struct(F.col("symbol").alias("name"), refs(EGID=F.col("egid"), UP=F.when(~F.col("up").contains(","), F.col("up")), REFSEQ_PROT=F.col("refseq")).alias("db_refs")).alias("who"))
    cited = F.filter(F.split("pmids", ","), lambda p: p.rlike(r"^\d+$"))
    named = lambda x: who.select(F.col("hprd").alias(x), F.col("who").alias(f"{x}_who"))
    end = lambda role, c: arg(role, c["name"], c["db_refs"])
    parts: list[DataFrame] = []
    kept = lambda d: d.select("stmt_type", "args", "evidence", "residue", "position")
    bare = lambda d: kept(d.withColumn("residue", _null()).withColumn("position", _null()))
    if complexes:
        rows = _csv(spark, complexes, "cplx hprd symbol refseq kind pmids".split(), **null).join(who, "hprd")
        body = rows.groupBy("cplx").agg(F.array_sort(F.collect_set(F.struct("hprd", F.col("who.name").alias("name"), "refseq", "kind", "pmids"))).alias("m"), F.collect_list(F.struct("hprd", "who")).alias("w"))
        w = F.transform(F.array_sort(F.transform("w", lambda x: F.struct(x["hprd"].alias("h"), x["who"]["name"].alias("n"), F.array_sort(F.map_entries(x["who"]["db_refs"])).alias("r")))), lambda x: arg("member", x["n"], F.map_from_entries(x["r"])))
        body = body.where(F.size("m") >= 2).withColumn("pmids", F.col("m")[0]["pmids"])
        parts.append(bare(body.select(F.lit("Complex").alias("stmt_type"), w.alias("args"), papers(cited, source_id=F.col("cplx")).alias("evidence"))))
    if ptms:
        rows = _csv(spark, ptms, "hprd symbol isoform refseq pos res enz_symbol enz kind how pmids".split(), **null).join(named("hprd"), "hprd").join(named("enz"), "enz", "left")
        kind = F.when(F.col("kind").isin(*HPRD), F.col("kind"))
        parts.append(kept(rows.select(kind.alias("stmt_type"), F.array(end("subj", F.col("enz_who")), end("obj", F.col("hprd_who"))).alias("args"), papers(cited, source_id=F.col("isoform")).alias("evidence"), residue(F.col("res")).alias("residue"), F.split("pos", ";")[0].alias("position"))))
    if ppis:
        rows = _csv(spark, ppis, "symbol_a a refseq_a symbol_b b refseq_b how pmids".split(), **null).withColumn("a", F.trim("a")).withColumn("b", F.trim("b")).join(named("a"), "a").join(named("b"), "b")
        parts.append(bare(rows.select(F.lit("Complex").alias("stmt_type"), F.array(end("subj", F.col("a_who")), end("obj", F.col("b_who"))).alias("args"), papers(cited, source_id=F.concat("a", F.lit("_1"))).alias("evidence"))))
    if not parts:
        raise ValueError("give at least one of complexes, ptms, ppis")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return assemble(out, "hprd")


# MITAB tables

VIRHOSTNET = "host vir host_alt vir_alt host_alias vir_alias exp author publication host_tax vir_tax int_type source_db source_id score dash".split()


def _listed(col: str, db: str) -> Column:
    """The first ``db:value`` of a |-separated MITAB cell, without quotes and remarks."""
    v = F.regexp_extract(col, rf'(?:^|\|)"?{db}"?:"?([^|"(]+)', 1)
    return F.nullif(v, F.lit(""))


def virhostnet(spark: SparkSession, path: str, columns: list[str] | None = None) -> Corpus:
    """A host's and a virus's protein bind. ``columns`` names the columns where a release orders them otherwise."""
    rows = _csv(spark, path, columns or VIRHOSTNET, quote="")
    ids = lambda x: F.when(F.col(x).startswith("uniprotkb:"), uniprot_refs(_listed(x, "uniprotkb"))).otherwise(refs(REFSEQ_PROT=_listed(x, "refseq"), NCBIPROTEIN=_listed(x, "ddbj/embl/genbank")))
    side = lambda role, x: arg(role, F.element_at(F.split(x, ":"), -1), ids(x))
    pmid = F.nullif(F.regexp_extract("publication", r"pubmed:(\d+)$", 1), F.lit(""))
    doi = F.nullif(F.regexp_extract("publication", r"doi\.org/([^)]+)\)", 1), F.lit(""))
    ev = evd(source_id=_listed("source_id", "virhostnet-rid"), pmid=pmid, text_refs=refs(PMID=pmid, DOI=doi), annotations=F.to_json(F.struct("exp", "int_type", "host_tax", "vir_tax", "score")))
    return assemble(rows.select(F.lit("Complex").alias("stmt_type"), F.array(side("subj", "host"), side("obj", "vir")).alias("args"), F.array(ev).alias("evidence")), "virhostnet")


MITAB = "id_a id_b alt_a alt_b alias_a alias_b method author publication tax_a tax_b kind source_db interaction confidence expansion bio_a bio_b exp_a exp_b type_a type_b".split()


def wormbase(spark: SparkSession, path: str, genes: DataFrame | None = None) -> Corpus:
    """Interactions whose ends have roles (agent: enzyme, inhibitor, suppressor, enhancer, epistatic gene; object: the others), or
    baits and preys, which bind. ``genes(wormbase, entrez, symbol)`` completes ids. Rows without roles are left out."""
    rows = _csv(spark, path, quote="", comment="#").toDF
    raw = _csv(spark, path, quote="", comment="#")
    rows = rows(*(MITAB + [f"rest_{k}" for k in range(len(raw.columns) - len(MITAB))])[: len(raw.columns)])
    for x in ("a", "b"):
        rows = rows.withColumn(f"wb_{x}", F.coalesce(_listed(f"id_{x}", "wormbase"), _listed(f"alt_{x}", "ensemblgenomes"))).withColumn(f"eg_{x}", _listed(f"id_{x}", "entrez gene/locuslink")).withColumn(f"sym_{x}", F.coalesce(_listed(f"alias_{x}", "wormbase"), _listed(f"alt_{x}", "entrez gene/locuslink"), _listed(f"id_{x}", "wormbase"), _listed(f"id_{x}", "uniprotkb")))
        if genes is not None:
            g = genes.select(F.col("wormbase").alias(f"wb_{x}"), F.col("entrez").alias("__e"), F.col("symbol").alias("__s"))
            rows = rows.join(g, f"wb_{x}", "left").withColumn(f"eg_{x}", F.coalesce(f"eg_{x}", "__e")).withColumn(f"sym_{x}", F.coalesce("__s", f"sym_{x}")).drop("__e", "__s")
    end = lambda role, x: arg(role, F.col(f"sym_{x}"), F.map_concat(refs(WB=F.col(f"wb_{x}"), EGID=F.col(f"eg_{x}")), F.coalesce(uniprot_refs(_listed(f"id_{x}", "uniprotkb")), F.create_map().cast("map<string,string>"))))
    role = lambda c: F.coalesce(F.regexp_extract(c, r"\(([^)]*)\)", 1), F.lit(""))
    bio, exp = role("bio_a"), role("exp_a")
    acts = bio.isin("enzyme", "inhibitor") | exp.isin("suppressor gene", "enhancer gene", "epistatic gene")
    suffers = (bio == "enzyme target") | exp.isin("suppressed gene", "enhanced gene", "hypostatic gene")
    hybrid = exp.isin("bait", "prey")
    kind = F.coalesce(F.col("kind"), F.lit(""))
    directed = F.when(kind.contains("genetic enhancement") & ~kind.contains("mutual"), "IncreaseAmount").when(kind.contains("suppression") | kind.contains("epistasis (sensu Bateson)"), "DecreaseAmount").when(kind.contains("dephosphorylation reaction"), "Dephosphorylation").when(kind.contains("phosphorylation reaction"), "Phosphorylation").when(kind.contains("demethylation reaction"), "Demethylation").when(kind.contains("methylation reaction"), "Methylation")
    chosen = F.when(acts | suffers, directed).when(hybrid, F.lit("Complex"))
    args = F.when(acts | ~suffers, F.array(end("subj", "a"), end("obj", "b"))).otherwise(F.array(end("subj", "b"), end("obj", "a")))
    pmid, doi = _listed("publication", "pubmed"), _listed("publication", "doi")
    ev = evd(source_id=F.regexp_extract("interaction", r"^([^|(]+)", 1), pmid=pmid, text_refs=refs(PMID=pmid, DOI=doi), annotations=F.to_json(F.struct("method", "kind")))
    return assemble(rows.where("sym_a is not null and sym_b is not null").select(chosen.alias("stmt_type"), args.alias("args"), F.array(ev).alias("evidence")), "wormbase")


# phospho.ELM and the drug-gene table


def phosphoelm(spark: SparkSession, path: str, kinases: DataFrame | None = None, skip_empty: bool = True) -> Corpus:
    """Human sites. ``kinases(text, name, ns, id)`` says what a kinase's text means; without it, or for other texts, the text is the name."""
    rows = _csv(spark, path, header=True).where(F.lower("species") == "homo sapiens").withColumn("kinases", F.nullif(F.trim("kinases"), F.lit("")))
    rows = rows.where("kinases is not null") if skip_empty else rows
    if kinases is not None:
        rows = rows.join(kinases.select(F.col("text").alias("kinases"), F.col("name").alias("k_name"), F.create_map("ns", "id").alias("k_refs")), "kinases", "left")
    else:
        rows = rows.withColumn("k_name", _null()).withColumn("k_refs", F.lit(None).cast("map<string,string>"))
    acc = F.col("acc")
    enz = arg("subj", F.coalesce("k_name", "kinases"), F.coalesce("k_refs", refs(TEXT=F.col("kinases"))))
    sub = arg("obj", acc, F.when(acc.startswith("ENSP"), refs(ENSEMBL=acc)).otherwise(uniprot_refs(acc)))
    pmid = F.when(F.col("pmids").rlike(r"^\d+$"), F.col("pmids"))
    ev = evd(pmid=pmid, text_refs=refs(PMID=pmid), annotations=F.to_json(F.struct("source", "acc", "kinases", "entry_date")))
    return assemble(rows.select(F.lit("Phosphorylation").alias("stmt_type"), F.array(enz, sub).alias("args"), F.array(ev).alias("evidence"), residue(F.col("code")).alias("residue"), F.col("position").alias("position")), "phosphoelm")


# Single interaction words and their types; combined words differ from release to release and are given as a table.
DGI = {
    "Activation": ("positive allosteric modulator", "positive modulator", "activator", "stimulator", "inducer", "cofactor", "potentiator"),
    "Inhibition": ("inhibitor", "blocker", "channel blocker", "suppressor", "gating inhibitor", "inhibitory allosteric modulator", "negative modulator"),
    "IncreaseAmount": ("chaperone",),
    "DecreaseAmount": ("antisense", "antisense oligonucleotide", "cleavage"),
    "Complex": ("agonist", "partial agonist", "antagonist", "partial antagonist", "inverse agonist", "antibody", "modulator", "allosteric modulator", "ligand", "binder", "adduct", "substrate"),
}


def dgi(spark: SparkSession, path: str, genes: DataFrame, kinds: DataFrame | None = None, skip_databases: tuple[str, ...] = ("DrugBank",)) -> Corpus:
    """Drugs on genes. ``genes(symbol, hgnc)`` names human genes, other rows are left out. ``kinds(interaction, stmt_type)`` adds to the
    single words above (combinations such as two words joined by a comma have a type only if it gives one)."""
    rows = _csv(spark, path, header=True).where("gene_concept_id is not null and drug_concept_id is not null").where(~F.coalesce(F.col("interaction_source_db_name").isin(*skip_databases), F.lit(False)))
    known = _case("interaction_type", {w: t for t, words in DGI.items() for w in words})
    if kinds is not None:
        rows = rows.join(kinds.select(F.col("interaction").alias("interaction_type"), F.col("stmt_type").alias("__k")), "interaction_type", "left")
        known = F.coalesce("__k", known)
    rows = rows.withColumn("stmt_type", known).join(genes.select(F.col("symbol").alias("gene_name"), "hgnc"), "gene_name")
    drug = arg("subj", F.col("drug_name"), F.create_map(F.upper(F.substring_index("drug_concept_id", ":", 1)), F.expr("substring(drug_concept_id, instr(drug_concept_id, ':') + 1)")))
    ev = evd(annotations=F.to_json(F.struct(F.col("interaction_type").alias("interactions"), F.col("interaction_source_db_name").alias("source"))))
    return assemble(rows.where("instr(drug_concept_id, ':') > 0").select("stmt_type", F.array(drug, arg("obj", F.col("gene_name"), refs(HGNC=F.col("hgnc")))).alias("args"), F.array(ev).alias("evidence")), "dgi")
