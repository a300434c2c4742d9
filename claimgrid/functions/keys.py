"""Identity keys and hashes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import NS_ORDER, SYMMETRIC, TEXT_NS, Corpus


def grounding(db_refs: Column, order: tuple[str, ...] = NS_ORDER) -> Column:
    """'NS:ID' of the first namespace of ``order`` with a non-empty id; null if there is none."""
    return F.coalesce(*(F.when(F.try_element_at(db_refs, F.lit(ns)) != "", F.concat(F.lit(ns + ":"), F.try_element_at(db_refs, F.lit(ns)))) for ns in order))


def entity_key(name: Column, db_refs: Column) -> Column:
    """What an argument is: its grounding, or its name if it has none."""
    return F.coalesce(grounding(db_refs), name)


def is_grounded(db_refs: Column) -> Column:
    return F.coalesce(F.exists(F.map_keys(F.map_filter(db_refs, lambda k, v: v.isNotNull() & (v != ""))), lambda k: ~k.isin(*TEXT_NS)), F.lit(False))


def mod_key(m: Column) -> Column:
    return F.concat_ws(",", m["mod_type"], F.coalesce(m["residue"], F.lit("~")), F.coalesce(m["position"], F.lit("~")), m["is_modified"].cast("string"))


def state_key(agent: Column | None = None) -> Column:
    """Modifications, mutations, activity, location and bound partners of an agents row, or of the struct ``agent``."""
    of = (lambda f: F.col(f)) if agent is None else (lambda f: agent[f])
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    mods = F.array_join(F.array_sort(empty(F.transform(of("mods"), mod_key))), ";")
    muts = F.array_join(F.array_sort(empty(F.transform(of("mutations"), lambda m: F.concat_ws(",", F.coalesce(m["residue_from"], F.lit("~")), F.coalesce(m["position"], F.lit("~")), F.coalesce(m["residue_to"], F.lit("~")))))), ";")
    bound = F.array_join(F.transform(F.array_sort(F.transform(F.coalesce(of("bound"), F.array().cast("array<struct<name:string,db_refs:map<string,string>,is_bound:boolean>>")), lambda b: F.struct(b["name"].alias("n"), entity_key(b["name"], b["db_refs"]).alias("k"), b["is_bound"].alias("b")))), lambda b: F.concat_ws(",", b["k"], b["b"].cast("string"))), ";")
    act = F.coalesce(F.concat_ws(",", of("activity")["activity_type"], of("activity")["is_active"].cast("string")), F.lit(""))
    return F.concat_ws("/", mods, muts, act, F.coalesce(of("location"), F.lit("")), bound)


def agent_key(agent: Column | None = None) -> Column:
    """Entity and state of an agents row (or of the struct ``agent``); the entity alone where the agent has no state."""
    of = (lambda f: F.col(f)) if agent is None else (lambda f: agent[f])
    entity = entity_key(of("name"), of("db_refs"))
    plain = F.lit(True)
    for f in ("mods", "mutations", "bound"):
        plain = plain & (F.coalesce(F.size(of(f)), F.lit(-1)) <= 0)
    plain = plain & of("activity")["activity_type"].isNull() & of("activity")["is_active"].isNull() & F.coalesce(of("location") == "", F.lit(True))
    return F.when(plain, entity).otherwise(F.concat(entity, F.lit("{"), state_key(agent), F.lit("}")))


def hash_of(key: Column, nibbles: int = 14) -> Column:
    """Signed hash: half the range less the first ``nibbles`` hex digits of md5."""
    if nibbles > 15:
        return (F.lit(str(1 << (4 * nibbles - 1))).cast("decimal(38,0)") - F.conv(F.substring(F.md5(key.cast("binary")), 1, nibbles), 16, 10).cast("decimal(38,0)")).cast("long")
    return F.lit(1 << (4 * nibbles - 1)) - F.conv(F.substring(F.md5(key.cast("binary")), 1, nibbles), 16, 10).cast("long")


def statement_keys(c: Corpus) -> DataFrame:
    """Statements with mk (type, arguments in role order or sorted, site, activity) and mk_hash; repeated rows of an argument count once."""
    if "args" in c.statements.columns:
        own = F.array_sort(F.array_distinct(F.transform("args", lambda a: F.struct(a["idx"].alias("idx"), F.coalesce(agent_key(a), F.lit("~")).alias("k")))))
        return _keyed(c.statements.withColumn("__args", own))
    args = c.agents.select("stmt_id", "idx", F.coalesce(agent_key(), F.lit("~")).alias("k")).groupBy("stmt_id").agg(F.array_sort(F.collect_set(F.struct("idx", "k"))).alias("__args"))
    return _keyed(c.statements.join(args, "stmt_id", "left"))


def _keyed(joined: DataFrame) -> DataFrame:
    flat = F.transform("__args", lambda a: a["k"])
    parts = F.when(F.col("stmt_type").isin(*SYMMETRIC), F.array_sort(flat)).otherwise(flat)
    tail = F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in ("residue", "position", "activity", "is_active", "from_location", "to_location")))
    return joined.withColumn("mk", F.concat_ws("|", "stmt_type", F.array_join(F.coalesce(parts, F.array().cast("array<string>")), "|"), tail)).withColumn("mk_hash", hash_of(F.col("mk"))).drop("__args")


def evidence_key(evidence: Column | None = None) -> Column:
    """Source, ids, text, annotations and epistemics of an evidence row, or of the struct ``evidence``."""
    of = (lambda f: F.col(f)) if evidence is None else (lambda f: evidence[f])
    return F.concat_ws("|", *(F.coalesce(of(x).cast("string"), F.lit("~")) for x in ("source_api", "source_id", "pmid", "text", "annotations", "direct", "hypothesis", "negated")))


def source_hash() -> Column:
    return hash_of(F.concat(F.coalesce("source_api", F.lit("")), F.coalesce("source_id", F.lit("")), F.coalesce("text", "pmid", F.lit(""))), 16)


def full_hash(c: Corpus) -> DataFrame:
    """(stmt_id, full_hash): the key of the assertion and the sorted keys of its evidence; told in the row where it carries both."""
    if {"args", "ev"} <= set(c.statements.columns):
        keys = F.array_join(F.array_sort(F.transform("ev", evidence_key)), "|")
        return statement_keys(c).select("stmt_id", hash_of(F.concat("mk", F.coalesce(keys, F.lit(""))), 16).alias("full_hash"))
    ev = c.evidence.select("stmt_id", evidence_key().alias("k")).groupBy("stmt_id").agg(F.array_join(F.array_sort(F.collect_list("k")), "|").alias("e"))
    return statement_keys(c).join(ev, "stmt_id", "left").select("stmt_id", hash_of(F.concat("mk", F.coalesce("e", F.lit(""))), 16).alias("full_hash"))


def bag_of_words_key(name: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != ""))), "_")
