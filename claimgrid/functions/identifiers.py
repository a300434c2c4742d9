"""Identifiers: namespaces of public registries, CURIEs, URLs and prefixes inside ids, as column expressions.

``registry`` arguments are plain dictionaries of a registry's few hundred prefixes; they become map literals in the plan. Unknown
namespaces and null inputs give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIERS_URL = "https://identifiers.org"
BIOREGISTRY_URL = "https://bioregistry.io"

# Namespaces whose prefix at identifiers.org is not their lower-case name.
IDENTIFIERS = {
    "UP": "uniprot", "UPPRO": "uniprot.chain", "UPISO": "uniprot.isoform", "REFSEQ_PROT": "refseq", "PF": "pfam", "IP": "interpro", "ECCODE": "ec-code", "NONCODE": "noncodev4.rna",
    "LNCRNADB": "rnacentral", "MIRBASEM": "mirbase.mature", "EGID": "ncbigene", "NCBI": "ncbigene", "HGNC_GROUP": "hgnc.genefamily", "LINCS": "lincs.smallmolecule",
    "PUBCHEM": "pubchem.compound", "CHEMBL": "chembl.compound", "CVCL": "cellosaurus",
}
# The same for the Bioregistry.
BIOREGISTRY = {
    "UP": "uniprot", "UPPRO": "uniprot.chain", "UPISO": "uniprot.isoform", "UPLOC": "uniprot.location", "REFSEQ_PROT": "refseq", "PF": "pfam", "IP": "interpro", "NONCODE": "noncodev4.rna",
    "LNCRNADB": "rnacentral", "MIRBASEM": "mirbase.mature", "EGID": "ncbigene", "NCBI": "ncbigene", "HGNC_GROUP": "hgnc.genegroup", "LINCS": "lincs.smallmolecule", "PUBCHEM": "pubchem.compound",
    "CHEMBL": "chembl.compound", "CVCL": "cellosaurus", "HMS-LINCS": "hms.lincs.compound", "NXPFA": "nextprot.family", "TAXONOMY": "ncbitaxon",
}
# URL prefixes of namespaces that no registry resolves.
URL_PREFIXES = {
    "NXPFA": "https://www.nextprot.org/term/FA-", "SIGNOR": "https://signor.uniroma2.it/relation_result.php?id=", "LSPCI": "https://labsyspharm.github.io/lspci/",
    "UN": "https://github.com/clulab/eidos/wiki/JSON-LD#Grounding/", "WDI": "https://github.com/clulab/eidos/wiki/JSON-LD#Grounding/", "FAO": "https://github.com/clulab/eidos/wiki/JSON-LD#Grounding/",
    "HUME": "https://github.com/BBN-E/Hume/blob/master/resource/ontologies/hume_ontology/", "CWMS": "http://trips.ihmc.us/", "SOFIA": "http://cs.cmu.edu/sofia/",
}
# Documents that stand for whole namespaces.
NAMESPACE_URLS = {n: f"https://arty.scai.fraunhofer.de/artifactory/bel/namespace/{d}/{d}-20150601.belns" for n, d in (("SCHEM", "selventa-legacy-chemicals"), ("SCOMP", "selventa-named-complexes"), ("SFAM", "selventa-protein-families"))}
#: Namespaces whose ids hold the namespace (of those that the engine uses), where a registry is not given.
EMBEDDED = ("CHEBI", "GO", "DOID", "HP", "EFO", "BTO", "CL", "UBERON", "MONDO", "IDO", "VO", "FOODON", "PR")


def picked(values: dict[str, str], key: Column) -> Column:
    """The value of a small fixed dictionary; null for other keys."""
    return F.try_element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), key) if values else F.lit(None).cast("string")


def ensure_prefix(ns: Column, id_: Column, with_colon: bool = True) -> Column:
    """The id with its namespace in it, once."""
    prefix = F.concat(ns, F.lit(":" if with_colon else ""))
    return F.when(id_.startswith(prefix), id_).otherwise(F.concat(prefix, id_))


def ensure_chebi_prefix(id_: Column) -> Column:
    return ensure_prefix(F.lit("CHEBI"), id_)


def ensure_chembl_prefix(id_: Column) -> Column:
    return ensure_prefix(F.lit("CHEMBL"), id_, with_colon=False)


def identifiers_ns(ns: Column, known: tuple[str, ...] | None = None) -> Column:
    """Prefix at identifiers.org; ``known``: the prefixes there are (null for others), or none to trust the name."""
    prefix = F.coalesce(picked(IDENTIFIERS, ns), F.lower(ns))
    return prefix if known is None else F.when(prefix.isin(*known), prefix)


def ns_from_identifiers(prefix: Column, known: tuple[str, ...] | None = None) -> Column:
    back = {v: k for k, v in IDENTIFIERS.items()} | {"ncbigene": "EGID"}
    low = F.lower(prefix)
    out = F.coalesce(picked(back, low), F.upper(prefix))
    return out if known is None else F.when(low.isin(*known), out)


def namespace_embedded(ns: Column, embedded: tuple[str, ...] = EMBEDDED) -> Column:
    return F.coalesce(ns.isin(*embedded), F.lit(False))


def ensure_prefix_if_needed(ns: Column, id_: Column, embedded: tuple[str, ...] = EMBEDDED) -> Column:
    return F.when(namespace_embedded(ns, embedded), ensure_prefix(ns, id_)).otherwise(id_)


def ns_id_from_identifiers(prefix: Column, id_: Column, known: tuple[str, ...] | None = None, embedded: tuple[str, ...] = EMBEDDED) -> Column:
    """(ns, id) of a prefix and id of identifiers.org."""
    ns, upper = ns_from_identifiers(prefix, known), F.upper(prefix)
    fixed = F.when(namespace_embedded(upper, embedded) & ~id_.startswith(upper), F.concat_ws(":", upper, id_)).otherwise(id_)
    return F.when(ns.isNotNull(), F.struct(ns.alias("ns"), fixed.alias("id")))


def url_prefix(ns: Column, known: tuple[str, ...] | None = None, embedded: tuple[str, ...] = EMBEDDED) -> Column:
    """What an id is appended to; ids with their namespace in them follow the host alone."""
    prefix = identifiers_ns(ns, known)
    own = F.when(namespace_embedded(ns, embedded), F.lit(IDENTIFIERS_URL + "/")).otherwise(F.concat(F.lit(IDENTIFIERS_URL + "/"), prefix, F.lit(":")))
    return F.coalesce(F.when(~ns.isin(*URL_PREFIXES) & prefix.isNotNull(), own), picked(URL_PREFIXES, ns))


def identifiers_url(ns: Column, id_: Column, known: tuple[str, ...] | None = None) -> Column:
    """A URL of the id; null for texts and where there is none."""
    fixed = F.when(ns == "CHEMBL", ensure_chembl_prefix(id_)).when(ns.isin(*EMBEDDED), ensure_prefix(ns, id_)).otherwise(id_)
    lincs = F.when(id_.startswith("LSM-"), "lincs.smallmolecule").when(id_.startswith("LCL-"), "lincs.cell").otherwise("lincs.protein")
    return (
        F.when(ns.isin("TEXT", "TEXT_NORM"), None)
        .when(ns == "LINCS", F.concat(F.lit(IDENTIFIERS_URL + "/"), lincs, F.lit(":"), id_))
        .when(ns == "HMS-LINCS", F.concat(F.lit("http://lincs.hms.harvard.edu/db/sm/"), id_, F.lit("-101")))
        .when(ns.isin(*NAMESPACE_URLS), picked(NAMESPACE_URLS, ns))
        .otherwise(F.concat(url_prefix(ns, known), fixed))
    )


def parse_identifiers_url(url: Column, known: tuple[str, ...] | None = None) -> Column:
    """(ns, id) of a URL made by ``identifiers_url`` or in identifiers.org's older form with a slash; null if it is neither."""
    pattern = r"^https?://identifiers\.org/([A-Za-z0-9.-]+)[/:]([A-Za-z0-9:_.-]+)"
    prefix, id_ = F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)
    plain = ns_id_from_identifiers(prefix, id_, known)
    pair = lambda n, i: F.struct(n.alias("ns"), i.alias("id"))
    chain = F.regexp_extract(url, r"#(PRO_\w+)", 1)
    part = r"/lincs\.(?:smallmolecule|cell|protein)[:/](.+)$"
    out = F.when(url.rlike(part), pair(F.lit("LINCS"), F.regexp_extract(url, part, 1))).when((prefix != "") & (chain != ""), pair(F.lit("UPPRO"), chain)).when(prefix != "", F.when(plain["ns"] == "HGNC", pair(F.lit("HGNC"), F.regexp_replace(plain["id"], "^HGNC:", ""))).otherwise(plain))
    for ns, start in URL_PREFIXES.items():
        out = out.when(url.startswith(start), pair(F.lit(ns), F.substring(url, len(start) + 1, 1 << 20)))
    out = out.when(url.startswith("http://lincs.hms.harvard.edu/db/sm/"), pair(F.lit("HMS-LINCS"), F.regexp_extract(url, r"/sm/(.+)-\d+$", 1)))
    for ns, whole in NAMESPACE_URLS.items():
        out = out.when(url == whole, pair(F.lit(ns), F.lit(None).cast("string")))
    return out


class Bioregistry:
    """Expressions over a registry given as {prefix: {"banana": ..., "banana_peel": ..., "synonyms": [...]}}: what of a namespace is embedded in its ids, and after what sign."""

    def __init__(self, registry: dict[str, dict]):
        self.registry = registry
        self.bananas = {p: v["banana"] + v.get("banana_peel", ":") for p, v in registry.items() if v.get("banana")}
        self.synonyms = {s: p for p, v in registry.items() for s in v.get("synonyms", ())}

    def prefix(self, ns: Column) -> Column:
        return F.coalesce(picked(BIOREGISTRY, ns), picked(self.synonyms, ns), F.when(F.lower(ns).isin(*self.registry), F.lower(ns)))

    def ns(self, prefix: Column) -> Column:
        back = {v: k for k, v in BIOREGISTRY.items()} | {"ncbigene": "EGID"}
        return F.when(prefix.isin(*self.registry), F.coalesce(picked(back, prefix), F.upper(prefix)))

    def ns_id(self, prefix: Column, id_: Column) -> Column:
        """(ns, id), the id with what its namespace embeds."""
        banana, ns = picked(self.bananas, prefix), self.ns(prefix)
        return F.when(ns.isNotNull(), F.struct(ns.alias("ns"), F.when(banana.isNotNull() & ~id_.startswith(banana), F.concat(banana, id_)).otherwise(id_).alias("id")))

    def ns_id_from_curie(self, curie: Column) -> Column:
        return self.ns_id(F.substring_index(curie, ":", 1), F.regexp_replace(curie, "^[^:]*:", ""))

    def curie(self, ns: Column, id_: Column) -> Column:
        prefix = self.prefix(ns)
        banana = picked(self.bananas, prefix)
        bare = F.when(banana.isNotNull() & id_.startswith(banana), F.substring(id_, F.length(banana) + 1, F.length(id_))).otherwise(id_)
        return F.when(prefix.isNotNull(), F.concat_ws(":", prefix, bare))

    def url(self, ns: Column, id_: Column) -> Column:
        return F.concat(F.lit(BIOREGISTRY_URL + "/"), self.curie(ns, id_))

    def ensure_prefix_if_needed(self, ns: Column, id_: Column) -> Column:
        banana = picked(self.bananas, self.prefix(ns))
        return F.when(banana.isNotNull() & ~id_.startswith(banana), F.concat(banana, id_)).otherwise(id_)
