"""Look-ups of names, ids and mappings as joins with three tables.

``Terms`` holds what vocabularies publish: ``terms(ns, id, name, type, obsolete, synonyms, alt_ids, tree)``, a row a term;
``xrefs(s_ns, s_id, t_ns, t_id)``, a row a mapping, in the direction in which it may be used; ``relations(ns, id, rel, t_ns, t_id)``. Any further table (kinases, papers
of a compound) is a member set ``sets(name, ns, id)``. ``LOOKUPS`` names the look-ups that clients of single databases offer; each takes
``keys(key)`` and gives ``(key, value)`` for every distinct key: null where nothing is found and, of several values, the least (``*_all``: all, sorted). All are
equi-joins, so they run at the size of a corpus; small vocabularies are broadcast by the optimiser, not by a hint.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import EMBEDDED, ensure_chembl_prefix, ensure_prefix

TERMS = "ns string, id string, name string, type string, obsolete boolean, synonyms array<string>, alt_ids array<string>, tree array<string>"
XREFS = "s_ns string, s_id string, t_ns string, t_id string"
RELATIONS = "ns string, id string, rel string, t_ns string, t_id string"
SETS = "name string, ns string, id string"


@dataclass(frozen=True)
class Terms:
    terms: DataFrame
    xrefs: DataFrame
    relations: DataFrame
    sets: DataFrame

    def with_(self, **parts: DataFrame) -> Terms:
        return replace(self, **parts)


def fixed_id(ns: str, key: Column) -> Column:
    """The id as the tables hold it: with its namespace where that belongs to it."""
    return ensure_prefix(F.lit(ns), key) if ns in EMBEDDED else ensure_chembl_prefix(key) if ns == "CHEMBL" else F.regexp_replace(key, f"^{ns}:", "")


def _found(keys: DataFrame, pairs: DataFrame, every: bool = False) -> DataFrame:
    """``pairs(k, value)`` of each key: the least value, or all."""
    fold = F.array_sort(F.collect_set("value")) if every else F.min("value")
    one = pairs.groupBy("k").agg(fold.alias("value"))
    return keys.select("key", "k").distinct().join(one, "k", "left").select("key", "value")


def name_of(ns: str) -> Callable:
    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.terms.where(F.col("ns") == ns).select(F.col("id").alias("k"), F.col("name").alias("value"))
        return _found(keys.withColumn("k", fixed_id(ns, F.col("key"))), own)

    return run


def property_of(ns: str, column: str) -> Callable:
    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.terms.where(F.col("ns") == ns).select(F.col("id").alias("k"), F.col(column).alias("value"))
        return _found(keys.withColumn("k", fixed_id(ns, F.col("key"))), own)

    return run


def entry_of(ns: str) -> Callable:
    """The whole row as JSON."""

    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.terms.where(F.col("ns") == ns).select(F.col("id").alias("k"), F.to_json(F.struct(*t.terms.columns)).alias("value"))
        return _found(keys.withColumn("k", fixed_id(ns, F.col("key"))), own)

    return run


def id_of(ns: str, synonyms: bool = False, every: bool = False) -> Callable:
    """By name among terms that are not obsolete; with ``synonyms`` by one of these where no name is it."""

    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.terms.where((F.col("ns") == ns) & ~F.coalesce("obsolete", F.lit(False)))
        named = own.select(F.col("name").alias("k"), F.col("id").alias("value"))
        out = _found(keys.withColumn("k", F.col("key")), named, every)
        if not synonyms:
            return out
        other = own.select(F.explode("synonyms").alias("k"), F.col("id").alias("value"))
        second = _found(keys.withColumn("k", F.col("key")), other, every).withColumnRenamed("value", "second")
        empty = F.size("value") < 1 if every else F.col("value").isNull()
        return out.join(second, "key").select("key", F.when(F.coalesce(empty, F.lit(True)), F.col("second")).otherwise(F.col("value")).alias("value"))

    return run


def mapped(s_ns: str, t_ns: str, every: bool = False) -> Callable:
    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.xrefs.where((F.col("s_ns") == s_ns) & (F.col("t_ns") == t_ns)).select(F.col("s_id").alias("k"), F.col("t_id").alias("value"))
        return _found(keys.withColumn("k", fixed_id(s_ns, F.col("key"))), own, every)

    return run


def mapped_any(s_ns: str | None, t_ns: str | None) -> Callable:
    """Mappings to (or from) any namespace: values (or keys) are 'NS:ID'."""

    def run(keys: DataFrame, t: Terms) -> DataFrame:
        x, whole = t.xrefs, lambda a: F.concat_ws(":", f"{a}_ns", f"{a}_id")
        if s_ns:
            return _found(keys.withColumn("k", fixed_id(s_ns, F.col("key"))), x.where(F.col("s_ns") == s_ns).select(F.col("s_id").alias("k"), whole("t").alias("value")))
        return _found(keys.withColumn("k", F.col("key")), x.where(F.col("t_ns") == t_ns).select(whole("s").alias("k"), F.col("t_id").alias("value")))

    return run


def through(first: Callable, second: Callable) -> Callable:
    """One look-up after another."""

    def run(keys: DataFrame, t: Terms) -> DataFrame:
        a = first(keys, t).withColumnRenamed("value", "mid")
        b = second(a.select(F.col("mid").alias("key")).where("key is not null").distinct(), t).withColumnRenamed("key", "mid")
        return a.join(b, "mid", "left").select("key", "value")

    return run


def primary(ns: str) -> Callable:
    """The id itself if it is one in use, else that which names it as another of its ids."""

    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.terms.where((F.col("ns") == ns) & ~F.coalesce("obsolete", F.lit(False)))
        pairs = own.select(F.col("id").alias("k"), F.lit(0).alias("r"), F.col("id").alias("v")).union(own.select(F.explode("alt_ids").alias("k"), F.lit(1), F.col("id")))
        best = pairs.groupBy("k").agg(F.min(F.struct("r", "v")).alias("b")).select("k", F.col("b.v").alias("value"))
        return keys.select("key").distinct().withColumn("k", fixed_id(ns, F.col("key"))).join(best, "k", "left").select("key", "value")

    return run


def from_alt(ns: str) -> Callable:
    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.terms.where(F.col("ns") == ns).select(F.explode("alt_ids").alias("k"), F.col("id").alias("value"))
        return _found(keys.withColumn("k", fixed_id(ns, F.col("key"))), own)

    return run


def synonyms_of(ns: str) -> Callable:
    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.terms.where(F.col("ns") == ns).select(F.col("id").alias("k"), F.explode("synonyms").alias("value"))
        return _found(keys.withColumn("k", fixed_id(ns, F.col("key"))), own, every=True)

    return run


def parents_of(ns: str, rels: tuple[str, ...] = ("isa", "is_a")) -> Callable:
    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.relations.where((F.col("ns") == ns) & F.col("rel").isin(*rels)).select(F.col("id").alias("k"), F.col("t_id").alias("value"))
        return _found(keys.withColumn("k", fixed_id(ns, F.col("key"))), own, every=True)

    return run


def member(name: str) -> Callable:
    """Whether the key is in the named set."""

    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.sets.where(F.col("name") == name).select(F.col("id").alias("key"), F.lit(True).alias("value")).distinct()
        return keys.select("key").distinct().join(own, "key", "left").withColumn("value", F.coalesce("value", F.lit(False)))

    return run


def members_of(name: str) -> Callable:
    """Ids that the named set holds under the key (its ``ns``)."""

    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = t.sets.where(F.col("name") == name).select(F.col("ns").alias("k"), F.col("id").alias("value"))
        return _found(keys.withColumn("k", F.col("key")), own, every=True)

    return run


def tree_numbers(t: Terms, ns: str = "MESH") -> DataFrame:
    """(id, tree): a supplementary term (C...) has the numbers of the primary terms that it is mapped to."""
    own = t.terms.where(F.col("ns") == ns).select("id", F.explode("tree").alias("tree"))
    extra = t.sets.where("name = 'mesh.primary'").select(F.col("ns").alias("sup"), F.col("id"))
    return own.where("id not like 'C%'").union(extra.join(own, "id").select(F.col("sup").alias("id"), "tree")).distinct()


def trees(keys: DataFrame, t: Terms) -> DataFrame:
    return _found(keys.withColumn("k", F.col("key")), tree_numbers(t).select(F.col("id").alias("k"), F.col("tree").alias("value")), every=True)


def under(prefix: str) -> Callable:
    """Whether one of the term's tree numbers begins with ``prefix``."""

    def run(keys: DataFrame, t: Terms) -> DataFrame:
        own = tree_numbers(t).where(F.col("tree").startswith(prefix)).select(F.col("id").alias("key"), F.lit(True).alias("value")).distinct()
        return keys.select("key").distinct().join(own, "key", "left").withColumn("value", F.coalesce("value", F.lit(False)))

    return run


def tree_isa(pairs: DataFrame, t: Terms) -> DataFrame:
    """``pairs(a, b)`` with ``isa``: whether a tree number of a begins with one of b."""
    n = tree_numbers(t)
    hit = pairs.distinct().join(n.select(F.col("id").alias("a"), F.col("tree").alias("ta")), "a").join(n.select(F.col("id").alias("b"), F.col("tree").alias("tb")), "b").where(F.col("ta").startswith(F.col("tb"))).select("a", "b", F.lit(True).alias("isa")).distinct()
    return pairs.join(hit, ["a", "b"], "left").withColumn("isa", F.coalesce("isa", F.lit(False)))


def most_specific(groups: DataFrame, closed: DataFrame, ns: str = "CHEBI") -> DataFrame:
    """``groups(gid, pos, id)`` to (gid, id): the first of a list that no other of the list is below."""
    own = groups.withColumn("id", fixed_id(ns, F.col("id")))
    pair = own.alias("x").join(own.alias("y"), F.col("x.gid") == F.col("y.gid")).where("x.id <> y.id").select(F.col("x.gid").alias("gid"), F.col("x.id").alias("p_id"), F.col("y.id").alias("id"))
    general = pair.join(closed.where((F.col("ns") == ns) & (F.col("p_ns") == ns)).select("id", "p_id"), ["id", "p_id"]).select("gid", F.col("p_id").alias("id")).distinct()
    return own.join(general, ["gid", "id"], "left_anti").groupBy("gid").agg(F.min_by("id", "pos").alias("id"))


def valid_location(keys: DataFrame, t: Terms) -> DataFrame:
    """A place's standard label, from its id (with or without GO:), label or synonym."""
    is_id = F.col("key").rlike(r"^(GO:)?\d+$")
    by_id = through(primary("GO"), name_of("GO"))(keys.where(is_id), t)
    by_name = through(id_of("GO", synonyms=True), name_of("GO"))(keys.where(~is_id), t)
    return by_id.union(by_name)


#: Look-ups by database and name. A value is null where nothing is found.
LOOKUPS: dict[str, Callable] = {
    "chebi.get_pubchem_id": mapped("CHEBI", "PUBCHEM"), "chebi.get_chebi_id_from_pubchem": mapped("PUBCHEM", "CHEBI"), "chebi.get_chembl_id": mapped("CHEBI", "CHEMBL"),
    "chebi.get_chebi_id_from_chembl": mapped("CHEMBL", "CHEBI"), "chebi.get_chebi_id_from_cas": mapped("CAS", "CHEBI"), "chebi.get_chebi_name_from_id": name_of("CHEBI"),
    "chebi.get_chebi_id_from_name": id_of("CHEBI"), "chebi.get_inchi_key": mapped("CHEBI", "INCHIKEY"), "chebi.get_primary_id": primary("CHEBI"), "chebi.get_chebi_id_from_hmdb": mapped("HMDB", "CHEBI"),
    "doid.get_doid_name_from_doid_id": name_of("DOID"), "doid.get_doid_id_from_doid_name": id_of("DOID"), "doid.get_doid_id_from_doid_alt_id": from_alt("DOID"),
    "drugbank.get_db_mapping": mapped_any("DRUGBANK", None), "drugbank.get_drugbank_id_from_db_id": mapped_any(None, "DRUGBANK"), "drugbank.get_chebi_id": mapped("DRUGBANK", "CHEBI"),
    "drugbank.get_chembl_id": mapped("DRUGBANK", "CHEMBL"), "drugbank.get_drugbank_id_from_chebi_id": mapped("CHEBI", "DRUGBANK"), "drugbank.get_drugbank_id_from_chembl_id": mapped("CHEMBL", "DRUGBANK"),
    "drugbank.get_drugbank_name": name_of("DRUGBANK"),
    "ec.get_name_from_id": name_of("ECCODE"), "ec.get_id_from_name": id_of("ECCODE"), "ec.get_parents": parents_of("ECCODE"),
    "efo.get_efo_name_from_efo_id": name_of("EFO"), "efo.get_efo_id_from_efo_name": id_of("EFO"),
    "go.get_go_label": name_of("GO"), "go.get_go_id_from_label": id_of("GO"), "go.get_go_id_from_label_or_synonym": id_of("GO", synonyms=True), "go.get_primary_id": primary("GO"),
    "go.get_valid_location": valid_location, "go.get_namespace": property_of("GO", "type"),
    "hgnc.get_uniprot_id": mapped("HGNC", "UP"), "hgnc.get_entrez_id": mapped("HGNC", "EGID"), "hgnc.get_hgnc_from_entrez": mapped("EGID", "HGNC"), "hgnc.get_ensembl_id": mapped("HGNC", "ENSEMBL"),
    "hgnc.get_hgnc_from_ensembl": mapped("ENSEMBL", "HGNC"), "hgnc.get_hgnc_name": name_of("HGNC"), "hgnc.get_hgnc_id": id_of("HGNC"), "hgnc.get_current_hgnc_id": id_of("HGNC", synonyms=True, every=True),
    "hgnc.get_hgnc_from_mouse": mapped("MGI", "HGNC"), "hgnc.get_hgnc_from_rat": mapped("RGD", "HGNC"), "hgnc.get_rat_id": mapped("HGNC", "RGD"), "hgnc.get_mouse_id": mapped("HGNC", "MGI"),
    "hgnc.get_hgnc_entry": entry_of("HGNC"), "hgnc.get_gene_type": property_of("HGNC", "type"), "hgnc.is_kinase": member("kinase"), "hgnc.is_transcription_factor": member("transcription_factor"),
    "hgnc.is_phosphatase": member("phosphatase"), "hgnc.get_enzymes": mapped("HGNC", "ECCODE", every=True), "hgnc.get_hgncs_from_enzyme": mapped("ECCODE", "HGNC", every=True),
    "hgnc.get_hgnc_id_from_mgi_name": through(id_of("MGI"), mapped("MGI", "HGNC")), "hgnc.get_hgnc_name_from_mgi_name": through(through(id_of("MGI"), mapped("MGI", "HGNC")), name_of("HGNC")),
    "hp.get_hp_name_from_hp_id": name_of("HP"), "hp.get_hp_id_from_hp_name": id_of("HP"), "ido.get_ido_name_from_ido_id": name_of("IDO"), "ido.get_ido_id_from_ido_name": id_of("IDO"),
    "mesh.get_mesh_name": name_of("MESH"), "mesh.get_mesh_id_name": id_of("MESH", synonyms=True), "mesh.get_mesh_tree_numbers": trees, "mesh.is_disease": under("C"), "mesh.is_molecular": under("D"),
    "mesh.is_enzyme": under("D08"), "mesh.is_protein": under("D12"), "mesh.get_go_id": mapped("MESH", "GO"), "mesh.get_mesh_id_from_go_id": mapped("GO", "MESH"), "mesh.get_db_mapping": mapped_any("MESH", None),
    "mesh.get_mesh_id_from_db_id": mapped_any(None, "MESH"), "mesh.get_primary_mappings": members_of("mesh.primary"),
    "mgi.get_id_from_name": id_of("MGI"), "mgi.get_name_from_id": name_of("MGI"), "mgi.get_synonyms": synonyms_of("MGI"), "mgi.get_id_from_name_synonym": id_of("MGI", synonyms=True, every=True), "mgi.get_ensembl_id": mapped("MGI", "ENSEMBL"),
    "mirbase.get_mirbase_name_from_mirbase_id": name_of("MIRBASE"), "mirbase.get_mirbase_id_from_mirbase_name": id_of("MIRBASE"), "mirbase.get_hgnc_id_from_mirbase_id": mapped("MIRBASE", "HGNC"),
    "mirbase.get_mirbase_id_from_hgnc_id": mapped("HGNC", "MIRBASE"), "mirbase.get_mirbase_id_from_hgnc_symbol": through(id_of("HGNC"), mapped("HGNC", "MIRBASE")),
    "mondo.get_name_from_id": name_of("MONDO"), "mondo.get_id_from_name": id_of("MONDO"), "mondo.get_id_from_alt_id": from_alt("MONDO"),
    "pubchem.get_inchi_key": mapped("PUBCHEM", "INCHIKEY"), "pubchem.get_json_record": entry_of("PUBCHEM"), "pubchem.get_preferred_compound_ids": mapped("PUBCHEM", "PUBCHEM", every=True), "pubchem.get_pmids": members_of("pubchem.pmid"),
    "pubchem.get_mesh_id": mapped("PUBCHEM", "MESH"),
    "rgd.get_id_from_name": id_of("RGD"), "rgd.get_name_from_id": name_of("RGD"), "rgd.get_synonyms": synonyms_of("RGD"), "rgd.get_id_from_name_synonym": id_of("RGD", synonyms=True, every=True), "rgd.get_ensembl_id": mapped("RGD", "ENSEMBL"),
    "taxonomy.get_taxonomy_id": id_of("TAXONOMY", synonyms=True),
}


def lookup(name: str, keys: DataFrame, t: Terms) -> DataFrame:
    """(key, value) of each distinct ``keys(key)`` by the named look-up; ``mesh.has_tree_prefix:X`` takes its prefix after the colon."""
    if name.startswith("mesh.has_tree_prefix:"):
        return under(name.split(":", 1)[1])(keys, t)
    if name not in LOOKUPS:
        raise KeyError(f"unknown look-up {name!r}")
    return LOOKUPS[name](keys, t)


def prune_standard(relations: DataFrame, rels: tuple[str, ...] = ("is_a", "part_of", "isa", "partof")) -> DataFrame:
    """Relations of the standard kinds only."""
    return relations.where(F.col("rel").isin(*rels))


def prune_empty(terms: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Empty lists of the given columns become null."""
    return terms.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in columns})
