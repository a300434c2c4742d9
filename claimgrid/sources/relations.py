"""From rows of binary relations to a corpus; what all tabular sources share.

A relation row has stmt_type, a_name, a_refs, b_name, b_refs, pmids (array), source_id, text, direct. Ids are hashes of the row, so
reading a file again, or after an executor is lost, gives the same ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from ..schema import ACT, BOUND, MOD, MUT, Corpus

COLUMNS = "stmt_type string, a_name string, a_refs map<string,string>, b_name string, b_refs map<string,string>, pmids array<string>, source_id string, text string, direct boolean, residue string, position string"


def refs(**ids: Column) -> Column:
    """A map of the references that are not null or empty; underscores in names stand for dashes."""
    pairs = F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("key"), v.cast("string").alias("value")) for k, v in ids.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & (p["value"] != "")))


def to_corpus(rel: DataFrame, source_api: str) -> Corpus:
    """One assertion for each row with a type, one evidence for each of its papers (one without a paper if it has none)."""
    have = set(rel.columns)
    for name, kind in (("pmids", "array<string>"), ("source_id", "string"), ("text", "string"), ("direct", "boolean"), ("residue", "string"), ("position", "string")):
        if name not in have:
            rel = rel.withColumn(name, F.lit(None).cast(kind))
    rel = rel.where("stmt_type is not null").withColumn("stmt_id", F.xxhash64(F.lit(source_api), "stmt_type", "a_name", F.array_sort(F.map_entries("a_refs")), "b_name", F.array_sort(F.map_entries("b_refs")), F.array_join(F.coalesce("pmids", F.array().cast("array<string>")), ";"), "source_id", "text", "residue", "position"))
    rel = rel.dropDuplicates(["stmt_id"])
    null = lambda t: F.lit(None).cast(t)
    statements = rel.select("stmt_id", "stmt_type", "residue", "position", null("string").alias("activity"), null("boolean").alias("is_active"), null("string").alias("from_location"), null("string").alias("to_location"), null("double").alias("belief"))
    two = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(i).alias("idx"), F.col(f"{x}_name").alias("name"), F.col(f"{x}_refs").alias("db_refs")) for i, (r, x) in enumerate((("subj", "a"), ("obj", "b")))))
    agents = rel.select("stmt_id", F.explode(two).alias("x")).select("stmt_id", "x.*", *(null(t).alias(n) for n, t in (("mods", f"array<{MOD}>"), ("mutations", f"array<{MUT}>"), ("bound", f"array<{BOUND}>"), ("activity", ACT), ("location", "string")))).where("name is not null")
    papers = F.when(F.size("pmids") > 0, F.col("pmids")).otherwise(F.array(F.lit(None).cast("string")))
    evidence = rel.select("stmt_id", "source_id", "text", "direct", F.posexplode(papers).alias("ord", "pmid")).select(
        "stmt_id", "ord", F.lit(source_api).alias("source_api"), "source_id", "pmid", "text", F.when(F.col("pmid").isNotNull(), F.create_map(F.lit("PMID"), F.col("pmid"))).alias("text_refs"), null("string").alias("annotations"), "direct", null("boolean").alias("hypothesis"), null("boolean").alias("negated")
    )
    return Corpus(statements, agents, evidence)


def with_genes(rel: DataFrame, genes: DataFrame | None, side: str) -> DataFrame:
    """``genes(symbol, hgnc, up)`` gives the references of the symbol in ``{side}_name``; unknown symbols keep their text."""
    name = F.col(f"{side}_name")
    if genes is None:
        return rel.withColumn(f"{side}_refs", refs(TEXT=name))
    g = genes.select(F.col("symbol").alias("__s"), "hgnc", "up")
    return rel.join(g, name == F.col("__s"), "left").withColumn(f"{side}_refs", refs(TEXT=name, HGNC=F.col("hgnc"), UP=F.when(~F.col("up").contains(","), F.col("up")))).drop("__s", "hgnc", "up")


ARG = f"struct<role:string,name:string,db_refs:map<string,string>,mods:array<{MOD}>,mutations:array<{MUT}>,bound:array<{BOUND}>,activity:{ACT},location:string>"
EVD = "struct<source_id:string,pmid:string,text:string,text_refs:map<string,string>,annotations:string,direct:boolean,hypothesis:boolean,negated:boolean>"
REST = {"residue": "string", "position": "string", "activity": "string", "is_active": "boolean", "from_location": "string", "to_location": "string"}


def _fill(ddl_fields: list[tuple[str, str]], given: dict[str, Column]) -> Column:
    return F.struct(*((given[n] if given.get(n) is not None else F.lit(None)).cast(t).alias(n) for n, t in ddl_fields))


def arg(role: str, name: Column, db_refs: Column, **more: Column) -> Column:
    """One argument; a null name keeps its place but gives no row."""
    fields = [("role", "string"), ("name", "string"), ("db_refs", "map<string,string>"), ("mods", f"array<{MOD}>"), ("mutations", f"array<{MUT}>"), ("bound", f"array<{BOUND}>"), ("activity", ACT), ("location", "string")]
    return _fill(fields, {"role": F.lit(role), "name": name, "db_refs": db_refs, **more})


def evd(**parts: Column) -> Column:
    """One piece of evidence, of the parts that a source has."""
    return _fill([(n, "boolean" if n in ("direct", "hypothesis", "negated") else "map<string,string>" if n == "text_refs" else "string") for n in ("source_id", "pmid", "text", "text_refs", "annotations", "direct", "hypothesis", "negated")], parts)


def papers(pmids: Column, **parts: Column) -> Column:
    """One piece of evidence for each paper, or one without a paper where there is none."""
    some = F.when(F.size(pmids) > 0, pmids).otherwise(F.array(F.lit(None).cast("string")))
    return F.transform(some, lambda p: evd(pmid=p, text_refs=F.when(p.isNotNull(), F.create_map(F.lit("PMID"), p)), **parts))


def assemble(rel: DataFrame, source_api: str, keep: bool = False) -> Corpus:
    """A corpus of rows with stmt_type, args (array of ``arg``), evidence (array of ``evd``) and any of ``REST``.

    Rows without a type are left out, equal rows are one. Ids are hashes of the row, so a second reading gives the same. ``keep``: the rows are stored, so that the three tables are not made anew from the source.
    """
    for n, t in REST.items():
        if n not in rel.columns:
            rel = rel.withColumn(n, F.lit(None).cast(t))
    rel = rel.select("stmt_type", "args", "evidence", *REST).where("stmt_type is not null")
    rel = rel.withColumn("stmt_id", F.xxhash64(F.lit(source_api), F.to_json(F.struct("stmt_type", "args", "evidence", *REST)))).dropDuplicates(["stmt_id"])
    if keep:
        rel = checkpoint(rel)
    statements = rel.select("stmt_id", "stmt_type", *REST, F.lit(None).cast("double").alias("belief"))
    agents = rel.select("stmt_id", F.posexplode("args").alias("idx", "x")).where("x.name is not null").select("stmt_id", "x.role", "idx", "x.name", F.coalesce("x.db_refs", F.create_map().cast("map<string,string>")).alias("db_refs"), "x.mods", "x.mutations", "x.bound", "x.activity", "x.location")
    evidence = rel.select("stmt_id", F.posexplode("evidence").alias("ord", "e")).select("stmt_id", "ord", F.lit(source_api).alias("source_api"), "e.source_id", "e.pmid", "e.text", "e.text_refs", "e.annotations", "e.direct", "e.hypothesis", "e.negated")
    return Corpus(statements, agents, evidence)


# Three-letter, one-letter names of the residues.
RESIDUES = {"ala": "A", "arg": "R", "asn": "N", "asp": "D", "cys": "C", "gln": "Q", "glu": "E", "gly": "G", "his": "H", "ile": "I", "leu": "L", "lys": "K", "met": "M", "phe": "F", "pro": "P", "ser": "S", "thr": "T", "trp": "W", "tyr": "Y", "val": "V"}


def residue(text: Column) -> Column:
    """The one-letter name of a residue given by either name; null if it is none."""
    low = F.lower(F.trim(text))
    three = F.create_map(*(F.lit(x) for p in RESIDUES.items() for x in p))
    return F.when(low.isin(*(v.lower() for v in RESIDUES.values())), F.upper(low)).otherwise(F.try_element_at(three, low))


def uniprot_refs(ac: Column) -> Column:
    """UP with its chain (``P1-PRO_2``) or isoform (``P1-2``) apart."""
    base, rest = F.split(ac, "-")[0], F.get(F.split(ac, "-"), F.lit(1))
    return refs(UP=base, UPPRO=F.when(rest.startswith("PRO"), rest), UPISO=F.when(~rest.startswith("PRO"), ac))
