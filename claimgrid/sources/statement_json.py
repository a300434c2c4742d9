"""The native exchange format: one assertion a JSON object, as JSON lines or an array. Records that don't parse are counted, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import statement_keys
from ..schema import ACT, ADDING, BOUND, MOD, MUT, REMOVING, Corpus, descendants

AGENT = f"struct<name:string,db_refs:map<string,string>,mods:array<{MOD}>,mutations:array<{MUT}>,bound_conditions:array<struct<agent:struct<name:string,db_refs:map<string,string>>,is_bound:boolean>>,activity:{ACT},location:string>"
EVIDENCE = "struct<source_api:string,source_id:string,pmid:string,text:string,text_refs:map<string,string>,epistemics:struct<direct:boolean,hypothesis:boolean,negated:boolean>>"
#: Names of the arguments, in order; a type uses some of them.
ROLES = ("enz", "subj", "gef", "gap", "agent", "sub", "obj", "ras")
SCHEMA = f"type string, id string, belief double, residue string, position string, activity string, obj_activity string, is_active boolean, from_location string, to_location string, {', '.join(f'{r} {AGENT}' for r in ROLES)}, members array<{AGENT}>, evidence array<{EVIDENCE}>, supports array<string>, supported_by array<string>, _corrupt string"


def read(spark: SparkSession, path: str, lines: bool = True) -> tuple[Corpus, DataFrame]:
    """The corpus (with refinements if supports are given) and the records that could not be read. A record without an id is known by its whole content."""
    raw = spark.read.schema(SCHEMA).option("multiLine", not lines).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    known = F.col("type").isin(*descendants("Statement"))
    bad = raw.where(F.col("_corrupt").isNotNull() | ~F.coalesce(known, F.lit(False)))
    good = raw.where(F.col("_corrupt").isNull() & known).withColumn("stmt_id", F.when(F.col("id").isNotNull(), F.xxhash64("id", "type")).otherwise(F.xxhash64(F.to_json(F.struct(*raw.columns)))))
    statements = good.select("stmt_id", F.col("type").alias("stmt_type"), "residue", "position", F.coalesce("activity", "obj_activity").alias("activity"), "is_active", "from_location", "to_location", "belief")
    one = lambda a, role: F.struct(F.lit(role).alias("role"), a.alias("a"))
    named = F.filter(F.array(*(one(F.col(r), r) for r in ROLES)), lambda x: x["a"].isNotNull())
    members = F.transform(F.coalesce("members", F.filter(F.array(F.col("enz")), lambda x: F.lit(False))), lambda m: one(m, "member"))
    flat = good.select("stmt_id", F.posexplode(F.concat(named, members)).alias("idx", "x"))
    # an absent enzyme keeps its place
    first = F.when(F.col("x.role").isin("sub", "obj", "ras"), 1).otherwise(F.when(F.col("x.role") == "member", F.col("idx")).otherwise(0))
    bound = F.transform("x.a.bound_conditions", lambda b: F.struct(b["agent"]["name"].alias("name"), b["agent"]["db_refs"].alias("db_refs"), b["is_bound"].alias("is_bound")))
    agents = flat.select("stmt_id", "x.role", first.cast("int").alias("idx"), "x.a.name", "x.a.db_refs", "x.a.mods", "x.a.mutations", bound.cast(f"array<{BOUND}>").alias("bound"), "x.a.activity", "x.a.location")
    evidence = good.select("stmt_id", F.posexplode("evidence").alias("ord", "e")).select("stmt_id", "ord", "e.source_api", "e.source_id", "e.pmid", "e.text", "e.text_refs", F.lit(None).cast("string").alias("annotations"), "e.epistemics.direct", "e.epistemics.hypothesis", "e.epistemics.negated")
    ids = good.select("id", F.col("stmt_id").alias("refined"))
    pairs = good.select(F.col("stmt_id").alias("refiner"), F.explode("supports").alias("id")).join(ids, "id").select("refiner", "refined")
    return Corpus(statements, agents, evidence, pairs), bad


#: Names of the first and the second argument by type; types of one argument have one.
NAMES = {
    **dict.fromkeys((*ADDING, *REMOVING, "Modification", "AddModification", "RemoveModification"), ("enz", "sub")), **dict.fromkeys(("Autophosphorylation", "Transphosphorylation", "SelfModification"), ("enz",)),
    **dict.fromkeys(("Activation", "Inhibition", "GtpActivation", "RegulateActivity", "IncreaseAmount", "DecreaseAmount", "RegulateAmount", "Influence"), ("subj", "obj")),
    **dict.fromkeys(("ActiveForm", "HasActivity", "Translocation", "Migration"), ("agent",)), "Gef": ("gef", "ras"), "Gap": ("gap", "ras"),
}


def to_json(c: Corpus) -> DataFrame:
    """(stmt_id, value): a JSON object for each assertion, its arguments under their names, members of symmetric types in a list, as ``read`` takes them."""
    st = statement_keys(c)
    bound = lambda a: F.transform(a["bound"], lambda b: F.struct(F.struct(b["name"].alias("name"), b["db_refs"].alias("db_refs")).alias("agent"), b["is_bound"].alias("is_bound")))
    whole = lambda a: F.struct(a["name"].alias("name"), a["db_refs"].alias("db_refs"), a["mods"].alias("mods"), a["mutations"].alias("mutations"), bound(a).alias("bound_conditions"), a["activity"].alias("activity"), a["location"].alias("location"))
    by_place = lambda x, y: x["idx"] - y["idx"]
    if "args" not in st.columns:
        cols = [x for x in c.agents.columns if x != "stmt_id"]
        st = st.join(c.agents.groupBy("stmt_id").agg(F.collect_list(F.struct(*cols)).alias("args")), "stmt_id", "left")
    named = F.array_sort(F.filter("args", lambda a: a["name"].isNotNull()), by_place)
    kind, at = F.col("stmt_type"), lambda i: F.try_element_at(F.filter("args", lambda a: (a["idx"] == i) & a["name"].isNotNull()), F.lit(1))
    role = lambda r: [F.when(kind.isin(*types), F.when(at(i).isNotNull(), whole(at(i)))).alias(r) for i in (0, 1) if (types := [t for t, n in NAMES.items() if len(n) > i and n[i] == r])]
    members = F.when(~kind.isin(*NAMES), F.transform(named, whole)).alias("members")
    ev = c.evidence.groupBy("stmt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_api", "source_id", "pmid", "text", "text_refs", F.struct("direct", "hypothesis", "negated").alias("epistemics"))), lambda x, y: x["ord"] - y["ord"]), lambda e: e.dropFields("ord")).alias("evidence"))
    out = st.join(ev, "stmt_id", "left")
    links = []
    if c.refinements is not None:
        text = lambda x: F.array_sort(F.collect_set(F.col(x).cast("string")))
        out = out.join(c.refinements.groupBy(F.col("refiner").alias("stmt_id")).agg(text("refined").alias("supports")), "stmt_id", "left").join(c.refinements.groupBy(F.col("refined").alias("stmt_id")).agg(text("refiner").alias("supported_by")), "stmt_id", "left")
        links = ["supports", "supported_by"]
    activity = kind.isin("Activation", "Inhibition", "GtpActivation", "RegulateActivity")
    plain = [kind.alias("type"), F.col("stmt_id").cast("string").alias("id"), F.col("mk_hash").cast("string").alias("matches_hash"), "residue", "position", F.when(~activity, F.col("activity")).alias("activity"), F.when(activity, F.col("activity")).alias("obj_activity"), "is_active", "from_location", "to_location", "belief"]
    return out.select("stmt_id", F.to_json(F.struct(*plain, *(x for r in ROLES for x in role(r)), members, "evidence", *links)).alias("value"))


def write(c: Corpus, path: str) -> None:
    to_json(c).select("value").write.text(path)
