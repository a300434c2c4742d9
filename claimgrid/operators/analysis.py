"""Reports over a corpus: its arguments, texts, sentences, groundings and counts; and checks of rows and maps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import evidence_key, full_hash, statement_keys
from ..schema import Corpus

# arguments and texts


def all_agents(c: Corpus) -> DataFrame:
    """Every argument with a name."""
    return c.agents.where("name is not null")


def agent_texts(agents: DataFrame) -> DataFrame:
    """(text): the texts that arguments were read from, as often as they occur."""
    return agents.select(F.try_element_at("db_refs", F.lit("TEXT")).alias("text")).where("text is not null")


def sentences_for_text(c: Corpus, text: str, most: int | None = None) -> DataFrame:
    """(pmid, sentence): the first evidence of each assertion, once for each of its arguments read from ``text``; of more than ``most`` those of the least ids."""
    hit = c.agents.where(F.try_element_at("db_refs", F.lit("TEXT")) == text).select("stmt_id", "idx")
    first = c.evidence.groupBy("stmt_id").agg(F.min_by(F.struct("pmid", "text"), F.struct("ord", "source_api", "source_id")).alias("e"))
    out = hit.join(first, "stmt_id").select("stmt_id", "idx", F.col("e.pmid").alias("pmid"), F.col("e.text").alias("sentence"))
    return (out if most is None else out.orderBy("stmt_id", "idx").limit(most)).select("pmid", "sentence")


def base_map(grouped: DataFrame) -> DataFrame:
    """``grouped(text, total, groundings)`` (of ``agent_texts_with_grounding``) to lines: text, namespace, id, how often."""
    return grouped.select("text", F.explode("groundings").alias("g")).select("text", F.col("g.ns").alias("ns"), F.col("g.id").alias("id"), F.col("g.n").alias("n"))


def save_base_map(grouped: DataFrame, path: str) -> None:
    base_map(grouped).write.csv(path)


def sentences_of_top_texts(c: Corpus, grouped: DataFrame, most_texts: int = 300) -> DataFrame:
    """(text, pmid, sentence) of the most frequent texts."""
    top = grouped.orderBy(F.desc("total"), "text").limit(most_texts).select("text")
    hit = c.agents.select("stmt_id", F.try_element_at("db_refs", F.lit("TEXT")).alias("text")).join(top, "text")
    first = c.evidence.groupBy("stmt_id").agg(F.min_by(F.struct("pmid", "text"), F.struct("ord", "source_api", "source_id")).alias("e"))
    return hit.join(first, "stmt_id").select("text", F.col("e.pmid").alias("pmid"), F.col("e.text").alias("sentence"))


def save_sentences(c: Corpus, grouped: DataFrame, path: str, most_texts: int = 300) -> None:
    sentences_of_top_texts(c, grouped, most_texts).write.csv(path)


def protein_map(grouped: DataFrame, proteins: DataFrame) -> DataFrame:
    """(text, up): texts grounded to a protein whose gene's name is the text in capitals; ``proteins(up, gene)``. Of several the greatest."""
    pairs = base_map(grouped).where("ns = 'UP'").select("text", F.col("id").alias("up")).join(proteins.select("up", "gene"), "up").where(F.upper("text") == F.col("gene"))
    return pairs.groupBy("text").agg(F.max("up").alias("up"))


# counts


def ev_counts(c: Corpus) -> DataFrame:
    return statement_keys(c).select("stmt_id", "mk_hash").join(c.evidence.groupBy("stmt_id").agg(F.count("*").alias("n")), "stmt_id", "left").select("mk_hash", F.coalesce("n", F.lit(0)).alias("n"))


def beliefs(c: Corpus) -> DataFrame:
    return statement_keys(c).select("mk_hash", "belief")


def source_counts(c: Corpus, sources: tuple[str, ...] | None = None) -> DataFrame:
    """(mk_hash, counts): a map of sources to numbers of evidences; with ``sources`` each of these, 0 where there is none."""
    ids = statement_keys(c).select("stmt_id", "mk_hash")
    n = c.evidence.select("stmt_id", "source_api").join(ids, "stmt_id").groupBy("mk_hash", "source_api").agg(F.count("*").alias("n"))
    if sources is None:
        return n.groupBy("mk_hash").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_api", "n")))).alias("counts"))
    each = n.groupBy("mk_hash").agg(*(F.sum(F.when(F.col("source_api") == s, F.col("n")).otherwise(0)).alias(s) for s in sources))
    return each.select("mk_hash", F.create_map(*(x for s in sources for x in (F.lit(s), F.col(f"`{s}`")))).alias("counts"))


def available_sources(c: Corpus, sources: tuple[str, ...] | None = None) -> DataFrame:
    """(source_api): sources with evidence, of the given ones if any."""
    out = c.evidence.select("source_api").where("source_api is not null").distinct()
    return out if sources is None else out.where(F.col("source_api").isin(*sources))


def available_sources_of_counts(counts: DataFrame, sources: tuple[str, ...] | None = None) -> DataFrame:
    out = counts.select(F.explode("counts").alias("source_api", "n")).where("n > 0").select("source_api").distinct()
    return out if sources is None else out.where(F.col("source_api").isin(*sources))


def standardize_counts(rows: DataFrame, key: str = "hash") -> DataFrame:
    """Keys given as text become numbers; what is none goes."""
    return rows.withColumn(key, F.col(key).try_cast("long")).where(F.col(key).isNotNull())


AGGREGATES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "ave": F.avg, "max": F.max, "min": F.min, "count": F.count}


def metrics(c: Corpus, extra: dict[str, Column] | None = None) -> DataFrame:
    """(stmt_id, mk_hash, stmt_type, ev_count, belief, ag_count, ...): the metrics of each assertion; ``extra``: further ones over its columns."""
    n = c.evidence.groupBy("stmt_id").agg(F.count("*").alias("ev_count"))
    args = c.agents.where("name is not null").groupBy("stmt_id").agg(F.count("*").alias("ag_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda a: a["name"]), "|").alias("agents"))
    keyed = statement_keys(c).join(n, "stmt_id", "left").join(args, "stmt_id", "left")
    return keyed.select("stmt_id", "mk_hash", "stmt_type", "agents", F.coalesce("ev_count", F.lit(0)).alias("ev_count"), "belief", F.coalesce("ag_count", F.lit(0)).alias("ag_count"), *((v.alias(k)) for k, v in (extra or {}).items()))


def grouped_metrics(rows: DataFrame, keys: list[str], aggregates: dict[str, str | Callable[[str], Column]], count: str = "n_stmts") -> DataFrame:
    """Metrics by ``keys``: for each column the name of an aggregate of ``AGGREGATES`` or a function that makes one (as a Pandas aggregate UDF does)."""
    folds = [(AGGREGATES[how] if isinstance(how, str) else how)(col).alias(col) for col, how in aggregates.items()]
    return rows.groupBy(*keys).agg(*folds, F.count("*").alias(count))


def ranked(rows: DataFrame, sort_by: str | Column, keys: list[str], most: int | None = None) -> DataFrame:
    """Rows with their place by a metric or an expression over metrics, the greatest first, ties by key."""
    by = F.col(sort_by) if isinstance(sort_by, str) else sort_by
    out = rows.withColumn("__by", by)
    if most is not None:
        return out.orderBy(F.desc_nulls_last("__by"), *keys).limit(most).drop("__by")
    return out.orderBy(F.desc_nulls_last("__by"), *keys).drop("__by")


# checks


def bad_pmids(c: Corpus) -> DataFrame:
    """(stmt_id, ord, pmid) of evidence whose paper is no number."""
    return c.evidence.where(F.col("pmid").isNotNull() & ~F.col("pmid").rlike(r"^\d+$")).select("stmt_id", "ord", "pmid")


def check_grounding_map(grounding_map: DataFrame, patterns: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(text, error) of a map's rows: ids that do not match ``patterns(ns, pattern)``, unknown namespaces, and genes whose id is not that of ``genes(name, id)`` under the mapped name."""
    flat = grounding_map.select("text", F.explode("refs").alias("ns", "id")).where("ns not in ('TEXT', 'TEXT_NORM')")
    told = flat.join(patterns, "ns", "left")
    error = F.when(F.col("pattern").isNull(), F.concat(F.lit("unknown namespace "), "ns")).when(~F.rlike(F.col("id"), F.col("pattern")), F.concat(F.lit("bad id "), F.col("ns"), F.lit(":"), F.col("id")))
    out = told.withColumn("error", error).where("error is not null").select("text", "error")
    if genes is None:
        return out
    unknown = flat.where("ns = 'HGNC'").join(genes.select(F.col("id")).distinct(), "id", "left_anti").select("text", F.concat(F.lit("unknown gene "), "id").alias("error"))
    return out.union(unknown)


def replace_gene_symbols(grounding_map: DataFrame, genes: DataFrame) -> DataFrame:
    """Gene references given by symbol become ids by ``genes(name, id)``; unknown symbols are taken out, their row stays."""
    known = genes.groupBy(F.col("name").alias("__s")).agg(F.min("id").alias("__id"))
    out = grounding_map.withColumn("__s", F.try_element_at("refs", F.lit("HGNC"))).join(known, "__s", "left")
    rest = F.map_filter("refs", lambda k, v: k != "HGNC")
    numeric = F.col("__s").rlike(r"^\d+$")
    refs = F.when(F.col("__s").isNull() | numeric, F.col("refs")).when(F.col("__id").isNotNull(), F.map_concat(rest, F.create_map(F.lit("HGNC"), F.col("__id")))).otherwise(rest)
    return out.withColumn("refs", refs).select(*grounding_map.columns)


def eliminate_exact_duplicates(c: Corpus) -> Corpus:
    """Of assertions with the same key and the same evidence the one with the least id."""
    h = full_hash(c)
    return c.keep(c.statements.join(h.groupBy("full_hash").agg(F.min("stmt_id").alias("stmt_id")).select("stmt_id"), "stmt_id", "left_semi"))


def compatible_refs(a: Column, b: Column) -> Column:
    """No namespace besides the text has another id on the other side."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.forall(F.filter(shared, lambda k: ~k.isin("TEXT", "TEXT_NORM")), lambda k: F.try_element_at(a, k).eqNullSafe(F.try_element_at(b, k)))


def repeated_in_sentence(c: Corpus) -> DataFrame:
    """(stmt_id): assertions that repeat one of a lesser id: same type, same site, the same sentence, and arguments with compatible references.

    Pairs are formed within a sentence, type and site only, and by equal names, so no group is joined with itself as a whole."""
    site = [F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in ("residue", "position", "activity")]
    said = c.evidence.where("text is not null").select("stmt_id", F.xxhash64("source_api", "pmid", "text").alias("s")).distinct()
    args = c.agents.groupBy("stmt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name", F.to_json("db_refs").alias("r")))), lambda a: F.struct(a["name"].alias("name"), a["r"].alias("r"))).alias("args"))
    rows = c.statements.select("stmt_id", F.concat_ws("|", "stmt_type", *site).alias("t")).join(said, "stmt_id").join(args, "stmt_id").withColumn("names", F.transform("args", lambda a: a["name"]))
    w = Window.partitionBy("s", "t", "names", "refs").orderBy("stmt_id")
    exact = rows.withColumn("refs", F.to_json("args")).withColumn("n", F.row_number().over(w))
    firsts = exact.where("n = 1").drop("n", "refs")
    refs = lambda x: F.from_json(x, "map<string,string>")
    a, b = firsts.alias("a"), firsts.alias("b")
    fits = F.forall(F.zip_with("a.args", "b.args", lambda x, y: compatible_refs(refs(x["r"]), refs(y["r"]))), lambda ok: ok)
    near = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.t") == F.col("b.t")) & (F.col("a.names") == F.col("b.names"))).where("a.stmt_id > b.stmt_id").where(fits).select(F.col("a.stmt_id").alias("stmt_id"))
    return exact.where("n > 1").select("stmt_id").union(near).distinct()


def retain_molecular_complexes(c: Corpus, molecular: tuple[str, ...] = ("HGNC", "UP", "FPLX", "CHEBI", "PUBCHEM", "CHEMBL", "HMDB", "UPPRO")) -> Corpus:
    """Only complexes all of whose members have a reference to a molecule."""
    ok = F.coalesce(F.arrays_overlap(F.map_keys("db_refs"), F.array(*(F.lit(n) for n in molecular))), F.lit(False))
    ids = c.agents.where("name is not null").groupBy("stmt_id").agg(F.bool_and(ok).alias("ok")).where("ok").select("stmt_id")
    return c.keep(c.statements.where("stmt_type = 'Complex'").join(ids, "stmt_id", "left_semi"))


def compare_overlap(predicted: Corpus, reference: Corpus, closed: DataFrame) -> DataFrame:
    """(stmt_id, found): whether a predicted assertion is, or refines, one of the reference."""
    from . import preassembly

    one, two = statement_keys(predicted).select("stmt_id", "mk_hash"), statement_keys(reference).select("mk_hash").distinct()
    equal = one.join(two, "mk_hash", "left_semi").select("stmt_id")
    shift = F.xxhash64(F.lit("reference"), "stmt_id")
    tag = lambda df: df.withColumn("stmt_id", shift)
    cols = [x for x in predicted.statements.columns if x in reference.statements.columns and x not in ("args", "ev")]
    both = Corpus(predicted.statements.select(*cols).unionByName(tag(reference.statements.select(*cols))), predicted.agents.unionByName(tag(reference.agents)), predicted.evidence)
    side = predicted.statements.select("stmt_id", F.lit(0).alias("side")).union(tag(reference.statements.select("stmt_id")).select("stmt_id", F.lit(1)))
    mine = predicted.statements.select(F.col("stmt_id").alias("refiner"))
    refining = preassembly.refinements(both, closed, split=side).join(mine, "refiner", "left_semi").select(F.col("refiner").alias("stmt_id"))
    hit = equal.union(refining).distinct().withColumn("found", F.lit(True))
    return predicted.statements.select("stmt_id").join(hit, "stmt_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def agents_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """(left_id, right_id): assertions of the same type whose arguments are equal in every column; ``b`` has the other corpus' agents."""
    whole = lambda df, n: df.groupBy("stmt_id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("idx", "role", "name", F.array_sort(F.map_entries("db_refs")).alias("refs"), "mods", "mutations", "bound", "activity", "location").cast("string")))).cast("binary"), 256).alias("k")).withColumnRenamed("stmt_id", n)
    return whole(a, "left_id").join(whole(b, "right_id"), "k").select("left_id", "right_id")


def statements_equal(left: Corpus, right: Corpus) -> DataFrame:
    """(left_id, right_id): equal type, site, arguments and evidence."""
    ev = lambda c, n: c.statements.select("stmt_id").join(c.evidence.withColumn("k", evidence_key()), "stmt_id", "left").groupBy("stmt_id").agg(F.array_join(F.array_sort(F.collect_list("k")), "|").alias("e")).withColumnRenamed("stmt_id", n)
    site = ["stmt_type", "residue", "position", "activity", "is_active", "from_location", "to_location"]
    st = lambda c, n: c.statements.select(F.col("stmt_id").alias(n), F.concat_ws("|", *(F.coalesce(F.col(x).cast("string"), F.lit("~")) for x in site)).alias("t"))
    pairs = agents_equal(left.agents, right.agents).join(st(left, "left_id"), "left_id").join(st(right, "right_id").withColumnRenamed("t", "u"), "right_id").where("t = u")
    return pairs.join(ev(left, "left_id"), "left_id").join(ev(right, "right_id").withColumnRenamed("e", "f"), "right_id").where(F.coalesce("e", F.lit("")) == F.coalesce("f", F.lit(""))).select("left_id", "right_id")


# arguments as graphs, generic copies


def to_graph(c: Corpus) -> DataFrame:
    """(stmt_id, source, relation, target): an assertion's attributes as edges from it to its arguments and from these to their references and states."""
    st = F.concat(F.lit("s"), F.col("stmt_id").cast("string"))
    ag = F.concat(st, F.lit("/"), F.col("idx").cast("string"))
    own = c.statements.select("stmt_id", F.explode(F.map_filter(F.create_map(*(x for n in ("stmt_type", "residue", "position", "activity", "from_location", "to_location") for x in (F.lit(n), F.col(n)))), lambda k, v: v.isNotNull())).alias("relation", "target")).select("stmt_id", st.alias("source"), "relation", "target")
    to_args = c.agents.select("stmt_id", st.alias("source"), "role", ag.alias("target"))
    names = c.agents.select("stmt_id", ag.alias("source"), F.lit("name").alias("relation"), F.col("name").alias("target"))
    refs = c.agents.select("stmt_id", ag.alias("source"), F.explode("db_refs").alias("relation", "target"))
    mods = c.agents.select("stmt_id", ag.alias("source"), F.explode("mods").alias("m")).select("stmt_id", "source", F.lit("mod").alias("relation"), F.concat_ws(",", "m.mod_type", "m.residue", "m.position", F.col("m.is_modified").cast("string")).alias("target"))
    return own.union(to_args.withColumnRenamed("role", "relation")).union(names).union(refs).union(mods)


def generic_copy(c: Corpus, deeply: bool = False) -> Corpus:
    """Without evidence, beliefs and links; ``deeply`` also without states of the arguments and texts they were read from."""
    from .transforms import strip_agent_context

    out = c.with_(statements=c.statements.withColumn("belief", F.lit(None).cast("double")), evidence=c.evidence.where(F.lit(False)), refinements=None)
    if not deeply:
        return out
    bare = strip_agent_context(out)
    return bare.with_(agents=bare.agents.withColumn("db_refs", F.map_filter("db_refs", lambda k, v: ~k.isin("TEXT", "TEXT_NORM"))))


def sorted_agents(agents: Column) -> Column:
    """Arguments (structs) by their keys."""
    from ..functions.keys import agent_key

    keyed = F.array_sort(F.transform(agents, lambda a: F.struct(agent_key(a).alias("k"), a["idx"].alias("i"))))
    return F.transform(keyed, lambda x: F.element_at(F.filter(agents, lambda a: a["idx"] == x["i"]), 1))
