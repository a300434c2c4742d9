"""Output of an event reader: documents with frames of events, entities and sentences, one JSON document a file (or a line).

A document is one row: its entities become a map by frame id and every event finds its arguments, its regulators and its sentence there, so
reading needs no shuffle. Keys written with dashes or underscores are read alike. Events that are negated give nothing; a
modification needs a regulating event, and a negative one turns it into its inverse; a complex needs the flag that says whether it is direct; a
change of place needs a place at one end. Groundings are the reader's own; names and references are standardised by ``operators.ontology``.

Cases: empty and unreadable documents give nothing; an argument without an entity leaves its event out (or is absent, for regulators); a document without a citation
has evidence without a paper.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identifiers import picked
from ..runtime import checkpoint
from ..schema import ADDING, BOUND, INVERSE, MOD, MUT, REMOVING, Corpus
from .relations import REST, RESIDUES, arg, assemble, evd

XREF = "struct<namespace:string,id:string,species:string>"
SPOT = "struct<offset:int>"
ENTITY = f"struct<frame_id:string,text:string,type:string,sentence:string,start_pos:{SPOT},end_pos:{SPOT},xrefs:array<{XREF}>,alt_xrefs:array<{XREF}>,modifications:array<struct<type:string,site:string,evidence:string>>,facets:map<string,array<string>>>"
ARGUMENT = "struct<type:string,argument_type:string,argument_label:string,arg:string,text:string,args:map<string,string>>"
EVENT = f"struct<frame_id:string,type:string,subtype:string,text:string,verbose_text:string,found_by:string,sentence:string,is_negated:boolean,is_hypothesis:boolean,is_direct:boolean,context:array<string>,arguments:array<{ARGUMENT}>>"
SENTENCE = f"struct<frame_id:string,text:string,start_pos:{SPOT},sections:array<string>>"
DOCUMENT = f"events struct<frames:array<{EVENT}>>, entities struct<frames:array<{ENTITY}>>, sentences struct<frames:array<{SENTENCE}>>"

# The reader's namespaces.
NAMESPACES = {
    "uniprot": "UP", "hgnc": "HGNC", "pfam": "PF", "interpro": "IP", "chebi": "CHEBI", "pubchem": "PUBCHEM", "go": "GO", "mesh": "MESH", "hmdb": "HMDB", "simple_chemical": "HMDB", "fplx": "FPLX", "be": "FPLX", "proonto": "PR",
    "taxonomy": "TAXONOMY", "cl": "CL", "tissuelist": "CALOHA", "uberon": "UBERON", "cellosaurus": "CVCL", "uo": "UO", "ncit": "NCIT", "edam.topic": "EDAM.TOPIC", "ncbitaxon": "NCBITAXON", "vo": "VO", "bto": "BTO", "efo": "EFO",
    "swo": "SWO", "iobc": "IOBC", "ohpi": "OHPI", "obi": "OBI", "ino": "INO", "ido": "IDO", "pr": "PR",
}
#: Name of a kind of modification, as a state or a process, to the modification and whether it is there.
STATES = {k: v for a, r in zip(ADDING, REMOVING, strict=True) for k, v in ((a.lower(), (a.lower(), True)), (a.lower().replace("ation", "ated"), (a.lower(), True)), (r.lower(), (a.lower(), False)))}
TYPES = {t.lower(): t for t in (*ADDING, *REMOVING, "Autophosphorylation", "Transphosphorylation")}
FULL_NAMES = {"alanine": "A", "arginine": "R", "asparagine": "N", "aspartate": "D", "cysteine": "C", "glutamine": "Q", "glutamate": "E", "glycine": "G", "histidine": "H", "isoleucine": "I", "leucine": "L", "lysine": "K", "methionine": "M", "phenylalanine": "F", "proline": "P", "serine": "S", "threonine": "T", "tryptophan": "W", "tyrosine": "Y", "valine": "V"}
SITE = r"(?i)^\W*p?(" + "|".join([*FULL_NAMES, *RESIDUES, "[acdefghiklmnpqrstvwy]"]) + r")?(?:\W*|\W*residue\W*)(\d+)?\W*$"


def documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(path, events, entities, sentences): a row a document."""
    raw = spark.read.text(path, wholetext=not lines).select(F.col("_metadata.file_path").alias("path"), "value")
    fixed = F.regexp_replace("value", r'"(\w+)-(\w+)"\s*:', r'"$1_$2":')
    return raw.select("path", F.from_json(fixed, DOCUMENT).alias("d")).where("d is not null").select("path", F.col("d.events.frames").alias("events"), F.col("d.entities.frames").alias("entities"), F.col("d.sentences.frames").alias("sentences"))


def event_counts(docs: DataFrame) -> DataFrame:
    """(type, n): events by type."""
    return docs.select(F.explode("events").alias("e")).groupBy(F.col("e.type").alias("type")).agg(F.count("*").alias("n"))


def sites(text: Column) -> Column:
    """(residue, position) of each part of a site's text, which commas and slashes part; nothing is found in other words."""
    parts = F.split(text, r"\s*(?:,|/| and )\s*")
    code = FULL_NAMES | RESIDUES | {v.lower(): v for v in RESIDUES.values()}

    def one(p: Column) -> Column:
        r, n = F.lower(F.regexp_extract(p, SITE, 1)), F.regexp_extract(p, SITE, 2)
        return F.struct(picked(code, r).alias("residue"), F.when(n != "", n).alias("position"))

    found = F.filter(F.transform(parts, one), lambda s: s["residue"].isNotNull() | s["position"].isNotNull())
    empty = F.array(F.struct(F.lit(None).cast("string").alias("residue"), F.lit(None).cast("string").alias("position")))
    return F.when(text.isNull() | (F.size(found) == 0), empty).otherwise(found)


def entity_refs(e: Column, organisms: tuple[str, ...] = ()) -> Column:
    """References of an entity: of several in a namespace the first; a protein's chain is a reference of its own. Of a protein's alternatives the first of ``organisms`` (species' names, best first) is taken."""
    known = F.filter(F.coalesce(e["xrefs"], F.array().cast(f"array<{XREF}>")), lambda x: picked(NAMESPACES, x["namespace"]).isNotNull() & ((x["namespace"] != "simple_chemical") | x["id"].startswith("HMDB")))
    pair = F.transform(known, lambda x: F.struct(picked(NAMESPACES, x["namespace"]).alias("key"), x["id"].alias("value")))
    if organisms:
        rank = lambda x: F.coalesce(F.array_position(F.array(*(F.lit(o) for o in organisms)), F.lower(x["species"])), F.lit(0))
        options = F.filter(F.coalesce(e["alt_xrefs"], F.array().cast(f"array<{XREF}>")), lambda x: (x["namespace"] == "uniprot") & (rank(x) > 0))
        best = F.array_min(F.transform(options, lambda x: F.struct(rank(x).alias("r"), x["id"].alias("id"))))["id"]
        pair = F.transform(pair, lambda p: F.when((p["key"] == "UP") & best.isNotNull(), F.struct(p["key"].alias("key"), best.alias("value"))).otherwise(p))
    chained = F.transform(pair, lambda p: F.when((p["key"] == "UP") & p["value"].contains("#"), F.struct(F.lit("UPPRO").alias("key"), F.substring_index(p["value"], "#", -1).alias("value"))).otherwise(p))
    keys = F.array_distinct(F.transform(chained, lambda p: p["key"]))
    first = F.transform(keys, lambda k: F.element_at(F.filter(chained, lambda p: p["key"] == k), 1)["value"])
    return F.map_from_arrays(F.concat(keys, F.array(F.lit("TEXT"))), F.concat(first, F.array(e["text"])))


def entity_mods(e: Column) -> Column:
    mods = F.filter(F.coalesce(e["modifications"], F.array().cast("array<struct<type:string,site:string,evidence:string>>")), lambda m: F.lower(m["type"]).isin(*STATES))
    kind, there = {k: v[0] for k, v in STATES.items()}, [k for k, v in STATES.items() if v[1]]
    every = F.transform(mods, lambda m: F.transform(sites(m["site"]), lambda s: F.struct(picked(kind, F.lower(m["type"])).alias("mod_type"), s["residue"].alias("residue"), s["position"].alias("position"), F.lower(m["type"]).isin(*there).alias("is_modified"))))
    return F.flatten(every).cast(f"array<{MOD}>")


def entity_mutations(e: Column) -> Column:
    pattern = r"^p?\.?([A-Za-z]{1,3})(\d+)([A-Za-z]{1,3})$"
    code = RESIDUES | {v.lower(): v for v in RESIDUES.values()}
    at = lambda m, i: F.regexp_extract(m["evidence"], pattern, i)
    found = F.filter(F.coalesce(e["modifications"], F.array().cast("array<struct<type:string,site:string,evidence:string>>")), lambda m: (F.lower(m["type"]) == "mutation") & picked(code, F.lower(F.regexp_extract(m["evidence"], pattern, 1))).isNotNull() & picked(code, F.lower(F.regexp_extract(m["evidence"], pattern, 3))).isNotNull())
    return F.transform(found, lambda m: F.struct(at(m, 2).alias("position"), picked(code, F.lower(at(m, 1))).alias("residue_from"), picked(code, F.lower(at(m, 3))).alias("residue_to"))).cast(f"array<{MUT}>")


def _agent(role: str, e: Column, organisms: tuple[str, ...], keep_mods: bool = True, bound: Column | None = None) -> Column:
    more = {"mutations": entity_mutations(e)}
    if keep_mods:
        more["mods"] = entity_mods(e)
    if bound is not None:
        more["bound"] = bound
    return arg(role, e["text"], F.when(e["text"].isNotNull(), entity_refs(e, organisms)), **more)


def entities(docs: DataFrame, organisms: tuple[str, ...] = (), sentence_coords: bool = False) -> DataFrame:
    """(path, frame_id, name, db_refs, mods, mutations, begin, end): all entities with their places in the document or in their sentence."""
    e = F.col("e")
    rows = docs.select("path", "sentences", F.explode("entities").alias("e")).where("e.text is not null")
    start = F.get(F.filter("sentences", lambda s: s["frame_id"] == F.col("e.sentence")), 0)["start_pos"]["offset"] if sentence_coords else F.lit(0)
    return rows.select("path", "e.frame_id", F.col("e.text").alias("name"), entity_refs(e, organisms).alias("db_refs"), entity_mods(e).alias("mods"), entity_mutations(e).alias("mutations"), (F.col("e.start_pos.offset") - start).alias("begin"), (F.col("e.end_pos.offset") - start).alias("end"))


def _events(docs: DataFrame) -> DataFrame:
    """A row an event that is not negated, with the document's entities by id and the events that regulate it."""
    rows = docs.select("path", "citation", "sentences", F.map_from_entries(F.transform(F.filter("entities", lambda x: x["frame_id"].isNotNull()), lambda x: F.struct(x["frame_id"].alias("key"), x.alias("value")))).alias("ents"), "events", F.explode("events").alias("e"))
    regs = F.filter("events", lambda r: r["type"].isin("regulation", "activation") & (F.try_element_at(r["arguments"], F.lit(1))["arg"] == F.col("e.frame_id")))
    return rows.withColumn("regs", regs).drop("events").where("not coalesce(e.is_negated, false)")


def _kind(a: Column) -> Column:
    return F.coalesce(a["argument_label"], a["type"])


def _first(args: Column, kind: str) -> Column:
    return F.try_element_at(F.filter(args, lambda a: _kind(a) == kind), F.lit(1))


def _entity(a: Column) -> Column:
    """The entity of an argument; of a complex its first member."""
    return F.try_element_at(F.col("ents"), F.coalesce(a["arg"], F.try_element_at(F.map_values(a["args"]), F.lit(1))))


def _partners(a: Column, organisms: tuple[str, ...]) -> Column:
    """The other members of a complex that is an argument, as bound partners."""
    others = F.slice(F.map_values(a["args"]), 2, F.greatest(F.size(F.map_values(a["args"])) - 1, F.lit(0)))
    found = F.filter(F.transform(others, lambda i: F.try_element_at(F.col("ents"), i)), lambda x: x["text"].isNotNull())
    return F.when(a["arg"].isNull(), F.transform(found, lambda x: F.struct(x["text"].alias("name"), entity_refs(x, organisms).alias("db_refs"), F.lit(True).alias("is_bound")))).cast(f"array<{BOUND}>")


def _evidence(said: Column) -> Column:
    s = F.get(F.filter("sentences", lambda x: x["frame_id"] == F.col("e.sentence")), 0)
    context = F.try_element_at(F.col("ents"), F.try_element_at(F.col("e.context"), F.lit(1)))["facets"]
    notes = F.to_json(F.struct(F.col("e.found_by").alias("found_by"), s["sections"].alias("sections"), context.alias("context")))
    return F.array(evd(pmid=F.col("citation"), text=said, text_refs=F.when(F.col("citation").isNotNull(), F.create_map(F.lit("PMID"), F.col("citation"))), annotations=notes, direct=F.col("e.is_direct"), hypothesis=F.col("e.is_hypothesis")))


def modifications(docs: DataFrame, organisms: tuple[str, ...] = ()) -> DataFrame:
    rows = _events(docs).where("e.type = 'protein-modification'").withColumn("t", _entity(_first(F.col("e.arguments"), "theme"))).withColumn("r", F.explode(F.filter("regs", lambda r: r["type"] == "regulation")))
    rows = rows.withColumn("c", _first(F.col("r.arguments"), "controller")).withColumn("x", _entity(F.col("c"))).withColumn("site", F.explode(sites(_first(F.col("e.arguments"), "site")["text"]))).where("t.text is not null")
    kind = picked(TYPES, F.lower("e.subtype"))
    kind = F.when(F.col("r.subtype") == "negative-regulation", picked(dict(INVERSE), kind)).otherwise(kind)
    alone = kind == "Autophosphorylation"
    args = F.when(alone, F.array(_agent("enz", F.col("t"), organisms))).otherwise(F.array(_agent("enz", F.col("x"), organisms), _agent("sub", F.col("t"), organisms)))
    return rows.select(kind.alias("stmt_type"), args.alias("args"), _evidence(F.col("r.verbose_text")).alias("evidence"), F.col("site.residue").alias("residue"), F.col("site.position").alias("position"))


def amounts(docs: DataFrame, organisms: tuple[str, ...] = ()) -> DataFrame:
    rows = _events(docs).where("e.type in ('transcription', 'amount')").withColumn("t", _entity(_first(F.col("e.arguments"), "theme"))).withColumn("r", F.explode("regs")).withColumn("c", _first(F.col("r.arguments"), "controller")).withColumn("x", _entity(F.col("c"))).where("t.text is not null")
    kind = F.when(F.col("r.subtype").startswith("positive"), "IncreaseAmount").otherwise("DecreaseAmount")
    return rows.select(kind.alias("stmt_type"), F.array(_agent("subj", F.col("x"), organisms, bound=_partners(F.col("c"), organisms)), _agent("obj", F.col("t"), organisms)).alias("args"), _evidence(F.col("r.verbose_text")).alias("evidence"))


def complexes(docs: DataFrame, organisms: tuple[str, ...] = ()) -> DataFrame:
    rows = _events(docs).where("e.type = 'complex-assembly' and e.is_direct is not null")
    members = F.filter(F.transform("e.arguments", _entity), lambda x: x["text"].isNotNull())
    return rows.select(F.lit("Complex").alias("stmt_type"), F.transform(members, lambda x: _agent("member", x, organisms)).alias("args"), _evidence(F.col("e.verbose_text")).alias("evidence")).where("size(args) > 0")


def activations(docs: DataFrame, organisms: tuple[str, ...] = ()) -> DataFrame:
    """A regulated modified form tells of the modification: its first state becomes the type and site, and leaves the argument."""
    rows = _events(docs).where("e.type = 'activation'").withColumn("c", _first(F.col("e.arguments"), "controller")).withColumn("x", _entity(F.col("c"))).withColumn("t", _entity(_first(F.col("e.arguments"), "controlled"))).where("x.text is not null and t.text is not null")
    m = F.try_element_at(entity_mods(F.col("t")), F.lit(1))
    plain = F.when(F.col("e.subtype") == "positive-activation", "Activation").otherwise("Inhibition")
    kind = F.coalesce(picked(TYPES, m["mod_type"]), plain)
    return rows.select(kind.alias("stmt_type"), F.array(_agent("subj", F.col("x"), organisms, bound=_partners(F.col("c"), organisms)), _agent("obj", F.col("t"), organisms, keep_mods=False)).alias("args"), _evidence(F.col("e.verbose_text")).alias("evidence"), m["residue"].alias("residue"), m["position"].alias("position"), F.when(kind.isin("Activation", "Inhibition"), "activity").alias("activity"))


def translocations(docs: DataFrame, organisms: tuple[str, ...] = ()) -> DataFrame:
    rows = _events(docs).where("e.type = 'translocation'").withColumn("t", _entity(_first(F.col("e.arguments"), "theme"))).where("t.text is not null")
    place = lambda kind: _entity(_first(F.col("e.arguments"), kind))["text"]
    return rows.select(F.lit("Translocation").alias("stmt_type"), F.array(_agent("agent", F.col("t"), organisms)).alias("args"), _evidence(F.col("e.verbose_text")).alias("evidence"), place("source").alias("from_location"), place("destination").alias("to_location")).where("from_location is not null or to_location is not null")


def conversions(docs: DataFrame, organisms: tuple[str, ...] = ()) -> DataFrame:
    end = lambda kind: _entity(_first(F.col("e.arguments"), kind))
    rows = _events(docs).where("e.type = 'conversion'").withColumn("x", end("controller")).withColumn("s", end("substrate")).withColumn("p", end("product")).where("x.text is not null and s.text is not null and p.text is not null")
    return rows.select(F.lit("Conversion").alias("stmt_type"), F.array(_agent("subj", F.col("x"), organisms), _agent("obj_from", F.col("s"), organisms), _agent("obj_to", F.col("p"), organisms)).alias("args"), _evidence(F.col("e.verbose_text")).alias("evidence"))


PARTS = (modifications, amounts, complexes, activations, translocations, conversions)


def reach(spark: SparkSession, path: str, lines: bool = False, citation: Column | None = None, organisms: tuple[str, ...] = ()) -> Corpus:
    """All assertions of the documents; ``citation``: the paper's id as an expression over ``path``."""
    # six kinds of events and three tables are made of the documents: they are read once, and so are the assertions
    docs = checkpoint(documents(spark, path, lines)).withColumn("citation", citation if citation is not None else F.lit(None).cast("string"))
    whole = lambda df: df.select("stmt_type", "args", "evidence", *((F.col(n) if n in df.columns else F.lit(None).cast(t).alias(n)) for n, t in REST.items()))
    return assemble(reduce(DataFrame.union, (whole(part(docs, organisms)) for part in PARTS)), "reach", keep=True)
