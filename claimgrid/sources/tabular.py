"""Readers of curated tables. Each declares its columns, reads lazily with an explicit schema and maps rows with column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Corpus
from .relations import refs, to_corpus, with_genes


def _csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = "\t", header: bool = False, **options: str) -> DataFrame:
    reader = spark.read.option("sep", sep).option("header", header).options(**options)
    if columns:
        reader = reader.schema(", ".join(f"`{c}` string" for c in columns))
    return reader.csv(path)


def _case(col: str, table: dict[str, str]):
    return F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), F.col(col))


def trrust(spark: SparkSession, path: str, genes: DataFrame | None = None) -> Corpus:
    """Transcription factor, target, effect, papers: one assertion for each paper."""
    rows = _csv(spark, path, ["a_name", "b_name", "effect", "papers"])
    rel = rows.select(_case("effect", {"Activation": "IncreaseAmount", "Repression": "DecreaseAmount"}).alias("stmt_type"), "a_name", "b_name", F.explode(F.split("papers", ";")).alias("p")).withColumn("pmids", F.array("p")).drop("p")
    return to_corpus(with_genes(with_genes(rel, genes, "a"), genes, "b"), "trrust")


# Columns of the interaction table.
BIOGRID = "biogrid_int_id entrez_a entrez_b biogrid_a biogrid_b syst_name_a syst_name_b symbol_a symbol_b syn_a syn_b exp_system exp_system_type author publication organism_a organism_b throughput score modification qualifications tags source_db swissprot_a trembl_a refseq_a swissprot_b trembl_b refseq_b".split()


def biogrid(spark: SparkSession, path: str, physical_only: bool = True) -> Corpus:
    rows = _csv(spark, path, BIOGRID, nullValue="-", comment="#")
    rows = rows.where("biogrid_int_id <> 'BioGRID Interaction ID'")
    if physical_only:
        rows = rows.where("exp_system_type = 'physical'")
    side = lambda x: refs(UP=F.when(~F.col(f"swissprot_{x}").contains("|"), F.col(f"swissprot_{x}")), EGID=F.col(f"entrez_{x}"))
    pmid = F.regexp_extract("publication", r"^PUBMED:(\d+)", 1)
    rel = rows.where("symbol_a is not null and symbol_b is not null").select(F.lit("Complex").alias("stmt_type"), F.col("symbol_a").alias("a_name"), side("a").alias("a_refs"), F.col("symbol_b").alias("b_name"), side("b").alias("b_refs"), F.when(pmid != "", F.array(pmid)).alias("pmids"), F.col("biogrid_int_id").alias("source_id"))
    return to_corpus(rel, "biogrid")


def ubibrowser(spark: SparkSession, e3_path: str, dub_path: str) -> Corpus:
    """Ligases and deubiquitinases with their substrates; rows that name a complex or lack an accession are left out."""

    def part(path: str, suffix: str, kind: str) -> DataFrame:
        rows = _csv(spark, path, header=True)
        ac, sub = F.col(f"`SwissProt AC ({suffix})`"), F.col("`SwissProt AC (Substrate)`")
        cited = (F.col("SOURCE") == "MEDLINE") & (F.col("SOURCEID") != "UNIPROT")
        return rows.where(~ac.contains("#") & (ac != "-") & (sub != "-")).select(F.lit(kind).alias("stmt_type"), F.col(f"`Gene Symbol ({suffix})`").alias("a_name"), refs(UP=ac).alias("a_refs"), F.col("`Gene Symbol (Substrate)`").alias("b_name"), refs(UP=sub).alias("b_refs"), F.when(cited, F.array(F.col("SOURCEID"))).alias("pmids"), F.when(cited, F.col("SENTENCE")).alias("text"))

    return to_corpus(part(e3_path, "E3", "Ubiquitination").union(part(dub_path, "DUB", "Deubiquitination")), "ubibrowser")


# Relation names and the types they stand for.
ACSN = {"CATALYSIS": "Activation", "INHIBITION": "Inhibition", "HETERODIMER_ASSOCIATION": "Complex", "CATALYSIS;HETERODIMER_ASSOCIATION": "Complex"}


def acsn(spark: SparkSession, path: str, correspondence: DataFrame, genes: DataFrame | None = None) -> Corpus:
    """``correspondence(entity, symbol)`` names the gene of an entity; relations of other entities are left out."""
    rows = _csv(spark, path, ["a", "kind", "b", "papers"])
    name = lambda x: correspondence.select(F.col("entity").alias(x), F.col("symbol").alias(f"{x}_name"))
    rel = rows.withColumn("stmt_type", _case("kind", ACSN)).join(name("a"), "a").join(name("b"), "b").select("stmt_type", "a_name", "b_name", F.split("papers", ";").alias("pmids"))
    return to_corpus(with_genes(with_genes(rel, genes, "a"), genes, "b"), "acsn")


def tas(spark: SparkSession, path: str, genes: DataFrame, affinity_class_limit: int = 2) -> Corpus:
    """A compound inhibits a human gene: classes up to the limit, one assertion for each id of the compound."""
    rows = _csv(spark, path, header=True, sep=",").where(F.col("tas").cast("int") <= affinity_class_limit)
    g = genes.select(F.col("symbol").alias("b_name"), "hgnc", "up")
    rel = rows.withColumn("b_name", F.col("entrez_gene_symbol")).join(g, "b_name").withColumn("c", F.explode(F.split("compound_ids", r"\|")))
    rel = rel.select(F.lit("Inhibition").alias("stmt_type"), F.col("c").alias("a_name"), refs(LSPCI=F.col("lspci_id"), CHEMBL=F.when(F.col("c").startswith("CHEMBL"), F.col("c")), HMS_LINCS=F.when(F.col("c").startswith("HMSL"), F.substring("c", 5, 50))).alias("a_refs"), "b_name", refs(HGNC=F.col("hgnc"), UP=F.col("up"), EGID=F.col("entrez_gene_id")).alias("b_refs"), F.filter(F.transform(F.split("references", r"\|"), lambda r: F.regexp_extract(r, r"^pubmed:(\d+)", 1)), lambda p: p != "").alias("pmids"))
    return to_corpus(rel, "tas")


def signed_lines(spark: SparkSession, path: str, names: DataFrame | None = None, source_api: str = "minerva") -> Corpus:
    """``source sign target`` lines; ``names(id, name)`` renames the ends. Signs are POSITIVE and NEGATIVE, or 1, -1 and 0."""
    parts = F.split("value", r"\s+")
    rows = spark.read.text(path).select(parts[0].alias("a"), parts[1].alias("s"), parts[2].alias("b")).where("b is not null")
    rel = rows.select(_case("s", {"POSITIVE": "Activation", "NEGATIVE": "Inhibition", "1": "Activation", "0": "Activation", "-1": "Inhibition"}).alias("stmt_type"), F.col("a").alias("a_name"), F.col("b").alias("b_name"))
    if names is not None:
        for x in ("a", "b"):
            rel = rel.join(names.select(F.col("id").alias(f"{x}_name"), F.col("name").alias(f"__{x}")), f"{x}_name", "left").withColumn(f"{x}_name", F.coalesce(f"__{x}", f"{x}_name")).drop(f"__{x}")
    return to_corpus(with_genes(with_genes(rel, None, "a"), None, "b"), source_api)


def geneways(spark: SparkSession, actions: str, mentions: str, symbols: str) -> Corpus:
    """Actions, their mentions and symbols joined; binding and phosphorylation only."""
    a, m, s = (_csv(spark, p, header=True) for p in (actions, mentions, symbols))
    name = lambda x: s.select(F.col("id").alias(x), F.col("symbol").alias(f"{x}_sym"))
    act = a.select("hiid", F.col("up").alias("u"), F.col("dn").alias("d"), F.lower("actiontype").alias("kind"), "plo").join(name("u"), "u").join(name("d"), "d")
    both = act.join(m.select("hiid", F.col("actionmentionid").alias("source_id"), "negative", "pmid"), "hiid").where("negative is null or negative <> '1'")
    rel = both.select(_case("kind", {"bind": "Complex", "phosphorylate": "Phosphorylation"}).alias("stmt_type"), F.col("u_sym").alias("a_name"), F.col("d_sym").alias("b_name"), F.array("pmid").alias("pmids"), "source_id", (F.col("plo") == "P").alias("direct"))
    return to_corpus(with_genes(with_genes(rel, None, "a"), None, "b"), "geneways")
