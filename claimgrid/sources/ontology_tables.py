"""Published vocabulary files to term tables, and term tables to an ontology's nodes and edges.

Readers give the tables of ``operators.lookups`` (terms, mappings, relations, sets) from files as their publishers and common resource
builders lay them out. ``NODES`` and ``EDGES`` then name the parts of an ontology; ``build`` unites those that are asked for, checks
ids if patterns are given, and takes out edges that are known to close cycles. All is lazy and read in parallel; nothing is held on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import ensure_prefix, picked
from ..operators.lookups import RELATIONS, SETS, TERMS, XREFS, Terms, tree_numbers
from ..runtime import checkpoint
from ..schema import ADDING, ONTO_EDGES, ONTO_NODES
from .tabular import _csv


def none() -> Column:
    return F.lit(None).cast("string")


def empty(spark: SparkSession) -> Terms:
    return Terms(*(spark.createDataFrame([], d) for d in (TERMS, XREFS, RELATIONS, SETS)))


def united(*parts: Terms) -> Terms:
    return Terms(*(reduce(DataFrame.unionByName, (getattr(p, f) for p in parts)) for f in ("terms", "xrefs", "relations", "sets")))


def term_rows(df: DataFrame, ns: str | Column, id_: str | Column, name: Column | str, kind: Column | None = None, **more: Column) -> DataFrame:
    cols = {"ns": F.lit(ns) if isinstance(ns, str) else ns, "id": F.col(id_) if isinstance(id_, str) else id_, "name": F.col(name) if isinstance(name, str) else name, "type": kind if kind is not None else none(), "obsolete": F.lit(False)}
    lists = dict.fromkeys(("synonyms", "alt_ids", "tree"), F.lit(None).cast("array<string>"))
    return df.select(*((cols | lists | more)[c].alias(c) for c in ("ns", "id", "name", "type", "obsolete", "synonyms", "alt_ids", "tree")))


def xref_rows(df: DataFrame, s_ns: str | Column, s_id: Column, t_ns: str | Column, t_id: Column, both: bool = False) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    one = df.select(lit(s_ns).alias("s_ns"), s_id.alias("s_id"), lit(t_ns).alias("t_ns"), t_id.alias("t_id")).where("s_id <> '' and t_id <> ''")
    return one.unionByName(one.select(F.col("t_ns").alias("s_ns"), F.col("t_id").alias("s_id"), F.col("s_ns").alias("t_ns"), F.col("s_id").alias("t_id"))) if both else one


def _list(c: str, sep: str = ", ") -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), sep.replace("|", r"\|")), lambda x: x != "")


# Columns of the gene table.
HGNC = "id symbol name status alias entrez uniprot mgi rgd previous ensembl locus_type ec".split()


def hgnc(spark: SparkSession, path: str, preferred: DataFrame | None = None) -> Terms:
    """Gene table: a withdrawn symbol has the name of the one that replaced it; lists are split; ``preferred(hgnc_id, up_id)`` overrides the proteins."""
    rows = _csv(spark, path, HGNC, header=True).withColumn("hid", F.regexp_replace("id", "^HGNC:", "")).withColumn("gone", F.col("status") == "Symbol Withdrawn")
    new = F.regexp_extract("name", r"see \[HGNC:\s?(\d+)\]", 1)
    kind = F.when(F.col("locus_type") == "gene with protein product", "human_gene_protein").when(F.col("locus_type").startswith("RNA"), "human_rna").otherwise("human_gene_other")
    current = rows.where("status in ('Approved', 'Entry Withdrawn')")
    old = rows.where("gone").select("hid", new.alias("new")).join(current.select(F.col("hid").alias("new"), F.col("symbol").alias("new_name")), "new")
    terms = term_rows(current, "HGNC", "hid", "symbol", kind, synonyms=_list("previous")).unionByName(term_rows(old, "HGNC", "hid", "new_name", none(), obsolete=F.lit(True)))
    flat = lambda c, prefix="": rows.select("hid", F.explode(_list(c)).alias("x")).withColumn("x", F.regexp_replace("x", f"^{prefix}", "") if prefix else F.col("x"))
    up = flat("uniprot")
    if preferred is not None:
        own = preferred.select(F.col("hgnc_id").alias("hid"), F.col("up_id").alias("p"))
        up = up.join(own, "hid", "left").select("hid", F.coalesce("p", "x").alias("x")).distinct()
    hid, x = F.col("hid"), F.col("x")
    xrefs = [xref_rows(up, "HGNC", hid, "UP", x)] + [xref_rows(flat(c, p), "HGNC", hid, ns, x, both=True) for c, p, ns in (("entrez", "", "EGID"), ("mgi", "MGI:", "MGI"), ("rgd", "RGD:", "RGD"), ("ensembl", "", "ENSEMBL"), ("ec", "", "ECCODE"))]
    t = empty(spark)
    return t.with_(terms=terms, xrefs=reduce(DataFrame.unionByName, xrefs))


def proteins(spark: SparkSession, path: str) -> Terms:
    """``id gene_name mnemonic hgnc entrez secondary features`` by tabs; features are ``id=name`` joined by ``;``, secondary ids joined by ``,``."""
    rows = _csv(spark, path, "id gene_name mnemonic hgnc entrez secondary features".split(), header=True)
    kind = F.when(F.col("mnemonic").endswith("HUMAN"), "human_gene_protein").otherwise("nonhuman_gene_protein")
    parts = rows.select("id", kind.alias("kind"), F.explode(_list("features", ";")).alias("f")).select("id", "kind", F.substring_index("f", "=", 1).alias("fid"), F.regexp_replace("f", "^[^=]*=", "").alias("fname")).where("fid <> ''")
    terms = term_rows(rows, "UP", "id", "gene_name", kind, alt_ids=_list("secondary", ",")).unionByName(term_rows(parts, "UPPRO", "fid", "fname", F.concat("kind", F.lit("_fragment"))))
    xrefs = xref_rows(rows, "UP", F.col("id"), "HGNC", F.col("hgnc")).unionByName(xref_rows(rows, "UP", F.col("id"), "EGID", F.col("entrez"), both=True))
    rel = parts.select(F.lit("UPPRO").alias("ns"), F.col("fid").alias("id"), F.lit("partof").alias("rel"), F.lit("UP").alias("t_ns"), F.col("id").alias("t_id"))
    return empty(spark).with_(terms=terms, xrefs=xrefs, relations=rel)


OBO = "namespace string, id string, name string, synonyms array<string>, xrefs array<struct<namespace:string,id:string>>, alt_ids array<string>, relations map<string,array<string>>"
# Kinds of the terms of a vocabulary.
OBO_TYPES = {"EFO": "experimental_factor", "HP": "disease", "DOID": "disease", "CHEBI": "small_molecule", "IDO": "infectious_disease_concept", "MONDO": "disease", "ECCODE": "molecular_function"}


def obo(spark: SparkSession, path: str, ns: str) -> Terms:
    """An array of entries as JSON: ``namespace`` is a branch of the vocabulary (GO), a target with another prefix is a term of that one."""
    rows = spark.read.schema(OBO).option("multiLine", True).json(path)
    go = F.when(F.col("namespace") == "cellular_component", F.when(F.col("name").contains("complex"), "protein_family_complex").otherwise("cellular_location")).when(F.col("namespace").isin("biological_process", "molecular_function"), "biological_process")
    own = lambda c: F.when(c.contains(":") & ~c.startswith(ns), F.substring_index(c, ":", 1)).otherwise(F.lit(ns))
    bare = lambda c: F.when(c.contains(":") & ~c.startswith(ns), F.regexp_replace(c, "^[^:]*:", "")).otherwise(c)
    id_ = F.col("id")
    terms = term_rows(rows, own(id_), bare(id_), "name", go if ns == "GO" else F.lit(OBO_TYPES.get(ns)), synonyms=F.col("synonyms"), alt_ids=F.col("alt_ids"))
    rel = rows.select(own(id_).alias("ns"), bare(id_).alias("id"), F.explode("relations").alias("rel", "to"), F.col("namespace").alias("__n")).select("ns", "id", "rel", F.explode("to").alias("t"))
    xrefs = rows.select("id", F.explode("xrefs").alias("x"))
    return empty(spark).with_(terms=terms, relations=rel.select("ns", "id", "rel", own(F.col("t")).alias("t_ns"), bare(F.col("t")).alias("t_id")), xrefs=xref_rows(xrefs, ns, F.col("id"), F.upper("x.namespace"), F.col("x.id")))


def mesh(spark: SparkSession, path: str, supplementary: str | None = None, mappings: str | None = None) -> Terms:
    """``id name trees concepts`` by tabs, lists by ``|``; ``supplementary``: ``id primaries``; ``mappings``: ``mesh_id ns id`` (genes and proteins only away from MeSH)."""
    rows = _csv(spark, path, "id name trees concepts".split())
    tree = _list("trees", "|")
    under = lambda *p: F.exists(tree, lambda x: reduce(lambda a, b: a | b, (x.startswith(y) for y in p)))
    kind = F.when(under("D08", "D12"), "human_gene_protein")
    for letter, name in (("D", "small_molecule"), ("A", "anatomical_region"), ("B", "organism"), ("C", "disease"), ("E", "experimental_factor"), ("G", "biological_process")):
        kind = kind.when(under(letter), name)
    out = empty(spark).with_(terms=term_rows(rows, "MESH", "id", "name", kind.otherwise("other"), synonyms=_list("concepts", "|"), tree=tree))
    if supplementary:
        sup = _csv(spark, supplementary, ["sup", "primaries"]).select(F.lit("mesh.primary").alias("name"), F.col("sup").alias("ns"), F.explode(_list("primaries", "|")).alias("id"))
        out = out.with_(sets=sup)
    if mappings:
        m = _csv(spark, mappings, ["m", "ns", "id"])
        out = out.with_(xrefs=xref_rows(m, "MESH", F.col("m"), F.col("ns"), F.col("id")).unionByName(xref_rows(m.where("ns not in ('UP', 'HGNC')"), F.col("ns"), F.col("id"), "MESH", F.col("m"))))
    return out


def families(spark: SparkSession, entities: str, relations: str, mappings: str, genes: DataFrame | None = None) -> Terms:
    """Protein families: names, (ns, id, rel, ns, id) where genes are named by symbol (``genes(name, id)`` gives their ids), and (ns, id, family) mappings of the kinds that are kept."""
    rel = _csv(spark, relations, ["ns", "id", "rel", "t_ns", "t_id"], sep=",")
    if genes is not None:
        known = genes.groupBy(F.col("name").alias("id")).agg(F.min("id").alias("gid"))
        rel = rel.join(known, "id", "left").withColumn("id", F.when(F.col("ns") == "HGNC", F.coalesce("gid", "id")).otherwise(F.col("id")))
    maps = _csv(spark, mappings, ["m_ns", "m_id", "fam"]).where(F.col("m_ns").isin("PF", "IP", "GO", "NCIT", "ECCODE", "HGNC_GROUP", "MESH"))
    xrefs = xref_rows(maps, F.col("m_ns"), F.col("m_id"), "FPLX", F.col("fam")).unionByName(xref_rows(maps.where("m_ns <> 'MESH'"), "FPLX", F.col("fam"), F.col("m_ns"), F.col("m_id")))
    names = _csv(spark, entities, ["id"], sep=",")
    return empty(spark).with_(terms=term_rows(names, "FPLX", "id", "id", F.lit("protein_family_complex")), relations=rel.select("ns", "id", "rel", "t_ns", "t_id"), xrefs=xrefs)


def named(spark: SparkSession, path: str, ns: str, kind: str | None = None, header: bool = False, sep: str = "\t", synonyms: bool = False) -> Terms:
    """``id name [synonyms by |]``: micro RNAs, compounds, drugs, genes of mouse and rat, taxa, cell lines."""
    rows = _csv(spark, path, ["id", "name", "synonyms"] if synonyms else ["id", "name"], sep=sep, header=header)
    return empty(spark).with_(terms=term_rows(rows, ns, "id", "name", F.lit(kind) if kind else None, **({"synonyms": _list("synonyms", "|")} if synonyms else {})))


def pairs(spark: SparkSession, path: str, s_ns: str | None, t_ns: str | None, both: bool = False, header: bool = False, sep: str = "\t") -> Terms:
    """Mappings: two columns of ids, with a column of namespaces before the side whose namespace is not given."""
    cols = [*(() if s_ns else ("s_ns",)), "s_id", *(() if t_ns else ("t_ns",)), "t_id"]
    rows = _csv(spark, path, cols, sep=sep, header=header)
    fixed = lambda ns, side: F.when(ns == "CHEBI", ensure_prefix(ns, F.col(side))).otherwise(F.col(side))
    s, t = (F.lit(s_ns) if s_ns else F.col("s_ns")), (F.lit(t_ns) if t_ns else F.col("t_ns"))
    return empty(spark).with_(xrefs=xref_rows(rows, s, fixed(s, "s_id"), t, fixed(t, "t_id"), both))


def mappings_with_names(spark: SparkSession, path: str) -> Terms:
    """``ns id name ns id name``: curated mappings, used both ways."""
    rows = _csv(spark, path, "s_ns s_id s_name t_ns t_id t_name".split())
    return empty(spark).with_(xrefs=xref_rows(rows, F.col("s_ns"), F.col("s_id"), F.col("t_ns"), F.col("t_id"), both=True))


def small_molecules(spark: SparkSession, path: str) -> Terms:
    """Assay compounds: ``id name chebi chembl pubchem``; salts share the number before the dash, those ending in -999 are left out."""
    rows = _csv(spark, path, "sid name chebi chembl pubchem".split(), header=True).where("sid not like '%-999'").withColumn("base", F.substring_index("sid", "-", 1))
    fixed = {"chebi": ("CHEBI", ensure_prefix(F.lit("CHEBI"), F.col("chebi"))), "chembl": ("CHEMBL", F.col("chembl")), "pubchem": ("PUBCHEM", F.col("pubchem"))}
    one = rows.groupBy("base").agg(F.min_by("name", "sid").alias("name"))
    return empty(spark).with_(terms=term_rows(one, "HMS-LINCS", "base", "name"), xrefs=reduce(DataFrame.unionByName, (xref_rows(rows, "HMS-LINCS", F.col("base"), ns, c, both=True) for ns, c in fixed.values())).distinct())


def small_molecule_groups(spark: SparkSession, path: str) -> Terms:
    """``id name members``: members as ns:id joined by ``|`` are kinds of the group."""
    rows = _csv(spark, path, ["gid", "name", "members"], header=True)
    rel = rows.select("gid", F.explode(_list("members", "|")).alias("m")).select(F.substring_index("m", ":", 1).alias("ns"), F.regexp_replace("m", "^[^:]*:", "").alias("id"), F.lit("isa").alias("rel"), F.lit("LSPCI").alias("t_ns"), F.col("gid").alias("t_id"))
    return empty(spark).with_(terms=term_rows(rows, "LSPCI", "gid", "name", F.lit("small_molecule")), relations=rel)


def member_set(spark: SparkSession, path: str, name: str, column: str, sep: str = "\t") -> Terms:
    """One column of a table with a header as a named set: kinases, phosphatases, transcription factors."""
    rows = spark.read.option("sep", sep).option("header", True).csv(path)
    return empty(spark).with_(sets=rows.select(F.lit(name).alias("name"), none().alias("ns"), F.col(column).alias("id")).where("id is not null").distinct())


# nodes and edges


def nodes_of(t: Terms, ns: str) -> DataFrame:
    """Terms of a vocabulary, and their other ids as obsolete ones."""
    own = t.terms.where(F.col("ns") == ns)
    extra = own.select("ns", F.explode("alt_ids").alias("id"), none().alias("name"), none().alias("type"), F.lit(True).alias("obsolete"))
    known = own.select("id")
    return own.select("ns", "id", "name", "type", "obsolete").unionByName(extra.join(known, "id", "left_anti").select("ns", "id", "name", "type", "obsolete").distinct()).withColumn("polarity", F.lit(None).cast("int"))


def xref_edges(t: Terms, s_ns: tuple[str, ...] | None = None, t_ns: tuple[str, ...] | None = None) -> DataFrame:
    x = t.xrefs
    x = x.where(F.col("s_ns").isin(*s_ns)) if s_ns else x
    x = x.where(F.col("t_ns").isin(*t_ns)) if t_ns else x
    return x.select("s_ns", "s_id", "t_ns", "t_id", F.lit("xref").alias("rel")).distinct()


def replacement_edges(t: Terms, ns: str) -> DataFrame:
    """An id that exactly one term names as another of its ids is replaced by that term."""
    flat = t.terms.where(F.col("ns") == ns).select(F.explode("alt_ids").alias("alt"), "id")
    one = flat.groupBy("alt").agg(F.min("id").alias("t_id"), F.countDistinct("id").alias("n")).where("n = 1")
    return one.select(F.lit(ns).alias("s_ns"), F.col("alt").alias("s_id"), F.lit(ns).alias("t_ns"), "t_id", F.lit("replaced_by").alias("rel"))


# Relations of vocabularies as the ontology names them; ``has_part`` is turned round.
RELS = {"xref": "xref", "isa": "isa", "partof": "partof", "is_a": "isa", "part_of": "partof", "has_part": "partof", "has_functional_parent": "isa", "has_parent_hydride": "isa", "has_role": "isa"}


def hierarchy_edges(t: Terms, ns: str) -> DataFrame:
    """Relations of the known kinds. ``has_part`` counts neither for CHEBI nor for GO terms that are no cellular components, where it closes cycles."""
    rel = t.relations.where((F.col("ns") == ns) & F.col("rel").isin(*RELS))
    if ns == "CHEBI":
        rel = rel.where("rel <> 'has_part'")
    if ns == "GO":
        places = t.terms.where("ns = 'GO' and type in ('cellular_location', 'protein_family_complex')").select("ns", "id")
        rel = rel.where("rel <> 'has_part'").unionByName(rel.where("rel = 'has_part'").join(places, ["ns", "id"], "left_semi"))
    turned = F.col("rel") == "has_part"
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return rel.select(pick("ns", "t_ns").alias("s_ns"), pick("id", "t_id").alias("s_id"), pick("t_ns", "ns").alias("t_ns"), pick("t_id", "id").alias("t_id"), picked(RELS, F.col("rel")).alias("rel")).distinct()


def mesh_hierarchy(t: Terms) -> DataFrame:
    """From each tree number to the term of the number without its last part."""
    n = tree_numbers(t).where("id not like 'C%'")
    up = n.where("tree like '%.%'").withColumn("parent", F.regexp_replace("tree", r"\.[^.]*$", ""))
    own = up.join(n.select(F.col("tree").alias("parent"), F.col("id").alias("t_id")), "parent").where("id <> t_id")
    return own.select(F.lit("MESH").alias("s_ns"), F.col("id").alias("s_id"), F.lit("MESH").alias("t_ns"), "t_id", F.lit("isa").alias("rel")).distinct()


# Which activities are kinds of which.
ACTIVITIES = (("transcription", "activity"), ("catalytic", "activity"), ("gtpbound", "activity"), ("kinase", "catalytic"), ("phosphatase", "catalytic"), ("gef", "catalytic"), ("gap", "catalytic"))


def activity_hierarchy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ACTIVITY", a, "ACTIVITY", b, "isa") for a, b in ACTIVITIES], ONTO_EDGES)


def modification_hierarchy(spark: SparkSession) -> DataFrame:
    """Every kind of modification is a modification, whether it adds or (as a state) is taken away."""
    return spark.createDataFrame([("MODIFICATION", m.lower(), "MODIFICATION", "modification", "isa") for m in ADDING], ONTO_EDGES)


def family_edges(t: Terms) -> DataFrame:
    return t.relations.where(F.col("t_ns").isin("FPLX", "LSPCI", "UP") & F.col("rel").isin("isa", "partof")).select(F.col("ns").alias("s_ns"), F.col("id").alias("s_id"), "t_ns", "t_id", "rel").distinct()


def _family(t: Terms, t_ns: str) -> DataFrame:
    return family_edges(t).where(F.col("t_ns") == t_ns)


CHEMICAL = ("CHEBI", "CHEMBL", "PUBCHEM", "HMDB", "CAS", "DRUGBANK")
#: Parts of an ontology by name: nodes of one vocabulary, or edges of one kind.
NODES: dict[str, Callable[[Terms], DataFrame]] = {n: (lambda t, ns=ns: nodes_of(t, ns)) for n, ns in (
    ("hgnc", "HGNC"), ("uniprot", "UP"), ("uppro", "UPPRO"), ("famplex", "FPLX"), ("mesh", "MESH"), ("ncit", "NCIT"), ("mirbase", "MIRBASE"), ("chembl", "CHEMBL"), ("hms_lincs", "HMS-LINCS"), ("drugbank", "DRUGBANK"), ("lspci", "LSPCI"),
    ("go", "GO"), ("efo", "EFO"), ("hp", "HP"), ("doid", "DOID"), ("chebi", "CHEBI"), ("ido", "IDO"), ("mondo", "MONDO"), ("eccode", "ECCODE"))}
OBO_NS = ("GO", "EFO", "HP", "DOID", "CHEBI", "IDO", "MONDO", "ECCODE")
EDGES: dict[str, Callable[[Terms], DataFrame]] = {
    "hgnc_uniprot_entrez_xrefs": lambda t: xref_edges(t, ("HGNC", "UP", "EGID"), ("HGNC", "UP", "EGID")),
    "hgnc_entrez_xrefs": lambda t: xref_edges(t, ("HGNC",), ("EGID",)).union(xref_edges(t, ("EGID",), ("HGNC",))),
    "famplex_xrefs": lambda t: xref_edges(t, None, ("FPLX",)).union(xref_edges(t, ("FPLX",))),
    "famplex_hierarchy": lambda t: _family(t, "FPLX"),
    "obo_hierarchies": lambda t: reduce(DataFrame.union, (hierarchy_edges(t, ns) for ns in OBO_NS)),
    "obo_replacements": lambda t: reduce(DataFrame.union, (replacement_edges(t, ns) for ns in OBO_NS)),
    "chemical_xrefs": lambda t: xref_edges(t, CHEMICAL, CHEMICAL),
    "mesh_xrefs": lambda t: xref_edges(t, ("MESH",)).union(xref_edges(t, None, ("MESH",)).where("s_ns not in ('UP', 'HGNC', 'FPLX', 'PUBCHEM')")),
    "mesh_hierarchy": mesh_hierarchy,
    "biomappings": lambda t: xref_edges(t),
    "ncit_xrefs": lambda t: xref_edges(t, ("NCIT",)),
    "uppro_hierarchy": lambda t: _family(t, "UP"),
    "uniprot_replacements": lambda t: replacement_edges(t, "UP"),
    "mirbase_xrefs": lambda t: xref_edges(t, ("MIRBASE",), ("HGNC",)).union(xref_edges(t, ("HGNC",), ("MIRBASE",))),
    "hms_lincs_xrefs": lambda t: xref_edges(t, ("HMS-LINCS",)).union(xref_edges(t, None, ("HMS-LINCS",))),
    "pubchem_xrefs": lambda t: xref_edges(t, ("PUBCHEM",), ("MESH",)),
    "lspci": lambda t: _family(t, "LSPCI"),
    "activity_hierarchy": lambda t: activity_hierarchy(t.terms.sparkSession),
    "modification_hierarchy": lambda t: modification_hierarchy(t.terms.sparkSession),
}
# Fixed value: an edge that closes a cycle in a published hierarchy.
BAD_EDGES = (("MESH", "D015835", "MESH", "D013285", "isa"),)


def add_nodes(nodes: DataFrame, more: DataFrame) -> DataFrame:
    """Nodes with others added; of rows with the same term that with a name, and the one that is not obsolete, stands."""
    both = nodes.unionByName(more)
    order = F.struct(F.col("name").isNull().alias("a"), F.coalesce("obsolete", F.lit(False)).alias("b"), "name", "type")
    cols = ("name", "type", "obsolete", "polarity")
    return both.groupBy("ns", "id").agg(F.min_by(F.struct(*cols), order).alias("x")).select("ns", "id", *(f"x.{c}" for c in cols))


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    return edges.unionByName(more).distinct()


def remove_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Without the given edges, where the kind is the same, too."""
    return edges.join(gone, ["s_ns", "s_id", "t_ns", "t_id", "rel"], "left_anti")


def invalid_nodes(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(ns, id, error) of nodes of unknown namespaces or with ids that do not match ``patterns(ns, pattern)``."""
    told = nodes.select("ns", "id").where("ns not in ('ACTIVITY', 'MODIFICATION')").join(patterns, "ns", "left")
    error = F.when(F.col("pattern").isNull(), "unknown namespace").when(~F.rlike(F.col("id"), F.col("pattern")), "bad id")
    return told.withColumn("error", error).where("error is not null").select("ns", "id", "error")


def build(t: Terms, nodes: tuple[str, ...] = tuple(NODES), edges: tuple[str, ...] = tuple(EDGES)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the named parts. The tables are read once, not for each part."""
    spark = t.terms.sparkSession
    t = Terms(*(checkpoint(df) for df in (t.terms, t.xrefs, t.relations, t.sets)))
    every = reduce(DataFrame.unionByName, (NODES[n](t) for n in nodes), spark.createDataFrame([], ONTO_NODES))
    rel = reduce(DataFrame.unionByName, (EDGES[e](t) for e in edges), spark.createDataFrame([], ONTO_EDGES))
    return add_nodes(every, spark.createDataFrame([], ONTO_NODES)), remove_edges(rel.distinct(), spark.createDataFrame(list(BAD_EDGES), ONTO_EDGES))
