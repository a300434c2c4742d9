"""Queries over the benchmark tables, one or more for each family of operators, each with its SQL.

The stand-in corpus (``plans.standin``) is used throughout; ``RAW_SQL`` says the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.keys import bag_of_words_key, full_hash, statement_keys
from .operators import belief, filters, mechanisms, network, ontology, paths, preassembly, presentation, transforms
from .plans import query as q
from .plans.pipeline import Pipeline
from .plans.standin import RAW_SQL, corpus, table
from .plans.standin import ontology as onto
from .schema import Corpus, packed
from .streaming.incremental import evidence_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


W = f"WITH {RAW_SQL} "
IDS = W + "SELECT stmt_id, stmt_type FROM st WHERE "
ids = lambda c: c.statements.select("stmt_id", "stmt_type")
#: Distinct assertions with their evidence rows, and their beliefs.
DEDUP = W + """, d AS (SELECT mk_hash, min(stmt_id) AS stmt_id, min(stmt_type) AS stmt_type, min(s) AS s, min(p) AS p, min(sn) AS sn, min(pn) AS pn, min(sk) AS sk, min(pk) AS pk, min(residue) AS residue, min(position) AS position FROM st GROUP BY mk_hash),
ev AS (SELECT DISTINCT mk_hash, src, stmt_id // 80000000000 AS oid, pmid, direct, hyp, negated FROM st),
syst AS (SELECT * FROM (VALUES ('reach', 0.05, 0.3), ('sparser', 0.05, 0.3), ('signor', 0.01, 0.1), ('biopax', 0.01, 0.2)) t(src, syst, rnd)),
err AS (SELECT mk_hash, negated, src, max(syst) + pow(max(rnd), count(*)) AS e FROM ev JOIN syst USING (src) GROUP BY ALL),
bel AS (SELECT mk_hash, coalesce(1 - product(e) FILTER (NOT negated), 0) * (1 - coalesce(1 - product(e) FILTER (negated), 0)) AS belief FROM err GROUP BY mk_hash)
"""


def dedup(spark: SparkSession, sf_dir: str) -> Corpus:
    return preassembly.combine_duplicates(corpus(spark, sf_dir))


def believed(spark: SparkSession, sf_dir: str) -> Corpus:
    return belief.set_prior_probs(dedup(spark, sf_dir))


# filters


@query(IDS + "stmt_type IN ('Activation', 'Inhibition')")
def filter_by_type(spark, d):
    return ids(filters.filter_by_type(corpus(spark, d), "RegulateActivity"))


@query(IDS + "p_grounded")
def filter_grounded_only(spark, d):
    return ids(filters.filter_grounded_only(corpus(spark, d)))


@query(IDS + "p_grounded")
def filter_genes_only(spark, d):
    return ids(filters.filter_genes_only(corpus(spark, d)))


@query(IDS + "direct IS NULL OR direct")
def filter_direct(spark, d):
    return ids(filters.filter_direct(corpus(spark, d)))


@query(IDS + "NOT hyp")
def filter_no_hypothesis(spark, d):
    return ids(filters.filter_no_hypothesis(corpus(spark, d)))


@query(DEDUP + "SELECT d.stmt_id, d.stmt_type FROM d JOIN (SELECT mk_hash FROM ev GROUP BY mk_hash HAVING NOT bool_and(negated)) USING (mk_hash)")
def filter_no_negated(spark, d):
    return ids(filters.filter_no_negated(dedup(spark, d)))


@query(DEDUP + "SELECT d.stmt_id, d.stmt_type FROM d JOIN (SELECT mk_hash FROM ev GROUP BY mk_hash HAVING bool_or(src = 'reach') AND bool_or(src = 'signor')) USING (mk_hash)")
def filter_evidence_source(spark, d):
    return ids(filters.filter_evidence_source(dedup(spark, d), ["reach", "signor"], "all"))


@query(DEDUP + "SELECT stmt_id, stmt_type, round(belief, 9) AS belief FROM d JOIN bel USING (mk_hash) WHERE belief >= 0.8")
def filter_belief(spark, d):
    return filters.filter_belief(believed(spark, d), 0.8).statements.select("stmt_id", "stmt_type", F.round("belief", 9).alias("belief"))


@query(IDS + "sn IN ('supp1', 'supp2', 'supp3') OR pn IN ('supp1', 'supp2', 'supp3')")
def filter_gene_list(spark, d):
    return ids(filters.filter_gene_list(corpus(spark, d), ["supp1", "supp2", "supp3"], "one"))


@query(IDS + "s IN (5, 7)")
def filter_by_db_refs(spark, d):
    return ids(filters.filter_by_db_refs(corpus(spark, d), "HGNC", ["5", "7"], "any"))


@query(IDS + "sn IN ('supp1', 'part2', 'part3') AND pn IN ('supp1', 'part2', 'part3') OR sn = 'supp7' OR pn = 'supp7'")
def filter_concept_names(spark, d):
    c = corpus(spark, d)
    every = filters.filter_concept_names(c, ["supp1", "part2", "part3"], "all")
    one = filters.filter_concept_names(c, ["supp7"], "one")
    return ids(every).union(ids(one)).distinct()


@query(IDS + "stmt_type <> 'Complex'")
def filter_complexes_by_size(spark, d):
    return ids(filters.filter_complexes_by_size(corpus(spark, d), 1))


@query(IDS + "pmid::INT % 10 <> 3")
def filter_retracted_sources(spark, d):
    gone = table(spark, d, "orders").select((F.col("o_orderkey") % 1000).alias("p")).where("p % 10 = 3").select(F.col("p").cast("string").alias("pmid")).distinct()
    return ids(filters.filter_retracted_sources(corpus(spark, d), gone))


def _named(spark, d, n):
    return table(spark, d, "supplier").where(F.col("s_suppkey") % n == 0).select(F.concat(F.lit("supp"), F.col("s_suppkey").cast("string")).alias("name"))


@query(IDS + "stmt_type <> 'Phosphorylation' OR s IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0)")
def filter_enzyme_kinase(spark, d):
    return ids(filters.filter_enzyme_kinase(corpus(spark, d), _named(spark, d, 3)))


@query(IDS + "stmt_type NOT IN ('IncreaseAmount', 'DecreaseAmount') OR s IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 5 = 0)")
def filter_transcription_factor(spark, d):
    return ids(filters.filter_transcription_factor(corpus(spark, d), _named(spark, d, 5)))


@query(IDS + "TRUE")
def filter_mod_nokinase(spark, d):
    return ids(filters.filter_mod_nokinase(corpus(spark, d), _named(spark, d, 3)))


@query(DEDUP + "SELECT stmt_id, stmt_type FROM d JOIN bel USING (mk_hash) WHERE belief >= 0.9 OR mk_hash IN (SELECT mk_hash FROM ev WHERE src = 'signor')")
def filter_db_highbelief(spark, d):
    return ids(filters.filter_db_highbelief(believed(spark, d), ["signor"], 0.9))


CURATED = "cur AS (SELECT mk_hash, CASE WHEN l.toxic = 1 THEN 'grounding' ELSE 'correct' END AS tag FROM labels l JOIN d ON d.stmt_id % 1000 = l.doc_id)"


@query(DEDUP + f", {CURATED}, c AS (SELECT mk_hash, bool_or(tag = 'correct') AS r, bool_or(tag <> 'correct') AS w FROM cur GROUP BY mk_hash) SELECT stmt_id, CASE WHEN r THEN 1.0 ELSE round(belief, 9) END AS belief FROM d JOIN bel USING (mk_hash) LEFT JOIN c USING (mk_hash) WHERE coalesce(r, FALSE) OR NOT coalesce(w, FALSE)")
def filter_by_curation(spark, d):
    c = believed(spark, d)
    cur = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "grounding").otherwise("correct").alias("tag")).join(c.statements.select((F.col("stmt_id") % 1000).alias("doc_id"), F.col("mk_hash").alias("pa_hash")), "doc_id").select("pa_hash", F.lit(0).cast("long").alias("source_hash"), "tag")
    c = c.with_(evidence=c.evidence.withColumn("source_hash", F.lit(1).cast("long")))
    out = filters.filter_by_curation(c.with_(statements=c.statements.drop("mk_hash")), c.statements.select("stmt_id", "mk_hash"), cur)
    return out.statements.select("stmt_id", F.round("belief", 9).alias("belief"))


@query(W + "SELECT stmt_id, 'bad id UP:' || p AS violation FROM st WHERE p_grounded AND NOT regexp_matches(p::VARCHAR, '^[0-9]*[1-9]$')")
def validation_report(spark, d):
    patterns = spark.createDataFrame([("HGNC", "^[0-9]+$"), ("UP", "^[0-9]*[1-9]$")], "ns string, pattern string")
    return filters.validation_report(corpus(spark, d), patterns)


# keys, duplicates, belief


@query(W + "SELECT stmt_id, mk_hash FROM st")
def statement_hash(spark, d):
    return statement_keys(corpus(spark, d)).select("stmt_id", "mk_hash")


@query(W + "SELECT stmt_id, (9223372036854775808::HUGEINT - ('0x' || substr(md5(mk || concat_ws('|', src, stmt_id // 80000000000, pmid, '~', '~', coalesce(direct::VARCHAR, '~'), hyp::VARCHAR, negated::VARCHAR)), 1, 16))::UBIGINT::HUGEINT)::BIGINT AS full_hash FROM st")
def statement_full_hash(spark, d):
    return full_hash(corpus(spark, d))


@query(DEDUP + "SELECT d.mk_hash, d.stmt_id, count(*) AS n_evidence FROM d JOIN ev USING (mk_hash) GROUP BY ALL")
def combine_duplicates(spark, d):
    c = dedup(spark, d)
    return c.statements.select("mk_hash", "stmt_id").join(c.evidence.groupBy("mk_hash").agg(F.count("*").alias("n_evidence")), "mk_hash")


@query(DEDUP + "SELECT mk_hash, round(belief, 9) AS belief FROM bel")
def prior_belief(spark, d):
    return believed(spark, d).statements.select("mk_hash", F.round("belief", 9).alias("belief"))


TOP = "ORDER BY round(belief, 9) DESC, n DESC, mk_hash LIMIT 100"


@query(DEDUP + f"SELECT mk_hash, stmt_type, sn AS subj, pn AS obj, round(belief, 9) AS belief, n AS n_evidence FROM d JOIN bel USING (mk_hash) JOIN (SELECT mk_hash, count(*) AS n FROM ev GROUP BY mk_hash) USING (mk_hash) WHERE belief >= 0.5 {TOP}")
def best_supported(spark, d):
    """Flagship: evidence to keys, duplicates merged, belief, filter, the hundred best."""
    c = filters.filter_belief(believed(spark, d), 0.5)
    n = c.evidence.groupBy("stmt_id").agg(F.count("*").alias("n_evidence"))
    name = lambda i, n: F.filter("args", lambda a: a["idx"] == i)[0]["name"].alias(n)
    return c.statements.join(n, "stmt_id").select("mk_hash", "stmt_type", name(0, "subj"), name(1, "obj"), F.round("belief", 9).alias("belief"), "n_evidence").orderBy(F.desc("belief"), F.desc("n_evidence"), "mk_hash").limit(100)


@query(DEDUP + "SELECT d.stmt_id, coalesce(sum((src = 'reach')::INT), 0)::DOUBLE AS n_reach, coalesce(sum((src = 'signor')::INT), 0)::DOUBLE AS n_signor, count(DISTINCT pmid)::DOUBLE AS n_pmid, 2.0::DOUBLE AS n_agents, (max(residue) IS NOT NULL AND max(position) IS NOT NULL)::INT::DOUBLE AS has_site FROM d JOIN ev USING (mk_hash) GROUP BY d.stmt_id")
def belief_features(spark, d):
    return belief.features(dedup(spark, d), ["reach", "signor"]).drop("stmt_type")


# ontology and refinements

FAM = W + """, fam AS (SELECT CASE WHEN stmt_id % 8 = 7 THEN 'FPLX:' || s_nationkey ELSE sk END AS fk, st.* FROM st JOIN supplier ON s = s_suppkey WHERE stmt_type IN ('Activation', 'Inhibition')),
u AS (SELECT stmt_type, fk, pk, min(s) AS s, min(stmt_id) AS stmt_id FROM fam GROUP BY stmt_type, fk, pk),
r AS (SELECT a.stmt_id AS refiner, b.stmt_id AS refined FROM u a JOIN supplier ON a.fk = 'HGNC:' || s_suppkey JOIN u b ON b.fk = 'FPLX:' || s_nationkey AND a.pk = b.pk AND a.stmt_type = b.stmt_type)
"""


def family_lines(spark, d) -> Corpus:
    """Regulations; every seventh line of an order speaks of the supplier's nation instead of the supplier."""
    c = filters.filter_by_type(corpus(spark, d), "RegulateActivity")
    nation = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("hgnc"), F.col("s_nationkey").cast("string").alias("nk"))
    whole = c.statements
    named = whole.where("stmt_id % 8 = 7").withColumn("hgnc", F.try_element_at(F.filter("args", lambda a: a["idx"] == 0)[0]["db_refs"], F.lit("HGNC"))).join(nation, "hgnc", "left")
    moved = F.transform("args", lambda a: F.when(a["idx"] == 0, a.withField("name", F.concat(F.lit("nation"), "nk")).withField("db_refs", F.create_map(F.lit("FPLX"), F.col("nk")))).otherwise(a))
    return packed(whole.where("stmt_id % 8 <> 7").union(named.withColumn("args", moved).select(*whole.columns)))


def family_corpus(spark, d) -> tuple[Corpus, DataFrame]:
    closed = ontology.closure(onto(spark, d)[1])
    return preassembly.combine_duplicates(family_lines(spark, d)), closed


@query(FAM + "SELECT refiner, refined FROM r")
def refinements(spark, d):
    c, closed = family_corpus(spark, d)
    return preassembly.refinements(c, closed)


@query(FAM + "SELECT stmt_id, stmt_type FROM u WHERE stmt_id NOT IN (SELECT refined FROM r)")
def filter_top_level(spark, d):
    c, closed = family_corpus(spark, d)
    return ids(preassembly.combine_related(c, closed))


@query(FAM + """, ev AS (SELECT DISTINCT u.stmt_id AS sid, src, f.stmt_id // 80000000000 AS oid, pmid, direct, hyp, negated FROM fam f JOIN u USING (stmt_type, fk, pk)),
al AS (SELECT sid, src, negated FROM ev UNION ALL SELECT refined, src, negated FROM ev JOIN r ON sid = refiner WHERE NOT negated),
syst AS (SELECT * FROM (VALUES ('reach', 0.05, 0.3), ('sparser', 0.05, 0.3), ('signor', 0.01, 0.1), ('biopax', 0.01, 0.2)) t(src, syst, rnd)),
err AS (SELECT sid, negated, src, max(syst) + pow(max(rnd), count(*)) AS e FROM al JOIN syst USING (src) GROUP BY ALL)
SELECT sid AS stmt_id, round(coalesce(1 - product(e) FILTER (NOT negated), 0) * (1 - coalesce(1 - product(e) FILTER (negated), 0)), 9) AS belief FROM err GROUP BY sid""")
def hierarchy_belief(spark, d):
    c, closed = family_corpus(spark, d)
    ordered = c.evidence.withColumn("ord", F.xxhash64("source_api", "source_id", "pmid", "direct", "hypothesis", "negated"))
    out = belief.set_hierarchy_probs(preassembly.combine_related(c.with_(evidence=ordered), closed, return_toplevel=False))
    return out.statements.select("stmt_id", F.round("belief", 9).alias("belief"))


@query(FAM + ", ev AS (SELECT DISTINCT u.stmt_id AS sid, src, f.stmt_id // 80000000000 AS oid, pmid, direct, hyp, negated FROM fam f JOIN u USING (stmt_type, fk, pk)), al AS (SELECT sid, 'direct' AS t, * EXCLUDE (sid) FROM ev UNION SELECT refined, 'supported_by', * EXCLUDE (sid, refiner, refined) FROM ev JOIN r ON sid = refiner) SELECT sid AS stmt_id, t AS support_type, count(*) AS n FROM al GROUP BY ALL")
def flatten_evidence(spark, d):
    c, closed = family_corpus(spark, d)
    return preassembly.flatten_evidence(preassembly.combine_related(c, closed, return_toplevel=False)).groupBy("stmt_id", "support_type").agg(F.count("*").alias("n"))


@query(DEDUP + "SELECT x.stmt_id AS a, y.stmt_id AS b FROM d x JOIN d y ON x.stmt_type = 'Activation' AND y.stmt_type = 'Inhibition' AND x.sk = y.sk AND x.pk = y.pk")
def find_contradicts(spark, d):
    return preassembly.find_contradicts(dedup(spark, d), ontology.closure(onto(spark, d)[1]))


@query(DEDUP + "SELECT x.stmt_id AS left_id, y.stmt_id AS right_id, mk_hash FROM (SELECT * FROM d WHERE stmt_type <> 'Inhibition') x FULL JOIN (SELECT * FROM d WHERE stmt_type <> 'Activation') y USING (mk_hash)")
def align_statements(spark, d):
    c = dedup(spark, d)
    c = c.with_(statements=c.statements.drop("mk_hash"))
    return preassembly.align_statements(filters.filter_by_type(c, "Inhibition", invert=True), filters.filter_by_type(c, "Activation", invert=True))


ONTO = """WITH e AS (SELECT 'HGNC' AS ns, s_suppkey::VARCHAR AS id, 'FPLX' AS p_ns, s_nationkey::VARCHAR AS p_id FROM supplier UNION SELECT 'FPLX', n_nationkey::VARCHAR, 'REG', n_regionkey::VARCHAR FROM nation UNION SELECT 'UP', p_partkey::VARCHAR, 'BRAND', p_brand FROM part),
c AS (SELECT * FROM e UNION SELECT a.ns, a.id, b.p_ns, b.p_id FROM e a JOIN e b ON a.p_ns = b.ns AND a.p_id = b.id) """


@query(ONTO + "SELECT * FROM c")
def ontology_closure(spark, d):
    return ontology.closure(onto(spark, d)[1])


@query(ONTO + "SELECT * FROM c WHERE (p_ns, p_id) NOT IN (SELECT (ns, id) FROM e)")
def ontology_top_parents(spark, d):
    nodes, edges = onto(spark, d)
    return ontology.top_level_parents(nodes.select("ns", "id"), ontology.closure(edges)).select("ns", "id", "p_ns", "p_id")


@query(ONTO + "SELECT p_ns AS ns, p_id AS id, ns AS c_ns, id AS c_id FROM c WHERE ns = 'HGNC'")
def ontology_children(spark, d):
    nodes, edges = onto(spark, d)
    return ontology.children(nodes.select("ns", "id"), ontology.closure(edges), ["HGNC"])


@query("SELECT 'FPLX' AS ns, n_name AS name, n_nationkey::VARCHAR AS id FROM nation")
def ontology_id_from_name(spark, d):
    return ontology.id_from_name(table(spark, d, "nation").select(F.lit("FPLX").alias("ns"), F.col("n_name").alias("name")), onto(spark, d)[0])


# transforms


@query(W + "SELECT stmt_id, 'EGID' AS ns, s::VARCHAR AS id FROM st")
def rename_db_ref(spark, d):
    c = transforms.rename_db_ref(corpus(spark, d), "HGNC", "EGID")
    return c.agents.where("idx = 0").select("stmt_id", F.explode("db_refs").alias("ns", "id")).where("ns not in ('TEXT')")


@query(W + "SELECT stmt_id, 'HGNC' AS ns, CASE WHEN s <= 10 THEN 'new' || s ELSE s::VARCHAR END AS id FROM st")
def map_db_refs(spark, d):
    t = table(spark, d, "supplier").where("s_suppkey <= 10").select(F.lit("HGNC").alias("ns"), F.col("s_suppkey").cast("string").alias("old_id"), F.concat(F.lit("new"), F.col("s_suppkey").cast("string")).alias("new_id"))
    return transforms.map_db_refs(corpus(spark, d), t).agents.where("idx = 0").select("stmt_id", F.explode("db_refs").alias("ns", "id")).where("ns = 'HGNC'")


@query(W + "SELECT stmt_id, CASE WHEN s % 2 = 0 THEN 'FPLX' ELSE 'HGNC' END AS ns, CASE WHEN s % 2 = 0 THEN s_nationkey::VARCHAR ELSE s::VARCHAR END AS id FROM st JOIN supplier ON s = s_suppkey")
def map_grounding(spark, d):
    t = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("text"), F.create_map(F.lit("FPLX"), F.col("s_nationkey").cast("string")).alias("refs"))
    return transforms.map_grounding(corpus(spark, d), t).agents.where("idx = 0").select("stmt_id", F.explode("db_refs").alias("ns", "id")).where("ns <> 'TEXT'")


@query("SELECT event_id, round(value / 3600 * 60) AS per_minute FROM events")
def convert_unit(spark, d):
    return table(spark, d, "events").select("event_id", F.round(transforms.convert_unit(F.col("value"), F.lit("hour"), F.lit("minute")), 9).alias("per_minute"))


@query("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '\\s+'), lambda x: x <> ''))), '_') AS k FROM part")
def bag_of_words(spark, d):
    return table(spark, d, "part").select("p_partkey", bag_of_words_key(F.col("p_name")).alias("k"))


# networks

EDGES = DEDUP + """, n AS (SELECT mk_hash, count(*) AS n FROM ev GROUP BY mk_hash),
e AS (SELECT sn AS a, pn AS b, stmt_type, mk_hash, n, CASE WHEN stmt_type IN ('Activation', 'IncreaseAmount') THEN 0 WHEN stmt_type IN ('Inhibition', 'DecreaseAmount') THEN 1 END AS sgn, belief FROM d JOIN n USING (mk_hash) JOIN bel USING (mk_hash)
UNION ALL SELECT pn, sn, stmt_type, mk_hash, n, NULL, belief FROM d JOIN n USING (mk_hash) JOIN bel USING (mk_hash) WHERE stmt_type = 'Complex') """


def edge_table(spark, d):
    return network.edges(believed(spark, d))


@query(EDGES + 'SELECT a AS "agA_name", b AS "agB_name", stmt_type, mk_hash AS stmt_hash, n AS evidence_count, sgn AS initial_sign, round(belief, 9) AS belief FROM e')
def edges(spark, d):
    return edge_table(spark, d).select("agA_name", "agB_name", "stmt_type", "stmt_hash", "evidence_count", "initial_sign", F.round("belief", 9).alias("belief"))


@query(EDGES + 'SELECT a AS "agA_name", b AS "agB_name", count(DISTINCT mk_hash) AS n_stmts, sum(n)::BIGINT AS evidence_count, round(1 - product(1 - belief), 9) AS belief FROM e GROUP BY a, b')
def digraph(spark, d):
    return network.to_digraph(edge_table(spark, d)).select("agA_name", "agB_name", F.size("hashes").cast("long").alias("n_stmts"), "evidence_count", F.round("belief", 9).alias("belief"))


SIGNED = EDGES + ", sg AS (SELECT a, b, sgn, round(1 - product(1 - belief), 9) AS belief FROM e WHERE sgn IS NOT NULL GROUP BY a, b, sgn) "


@query(SIGNED + 'SELECT a AS "agA_name", b AS "agB_name", sgn AS sign, belief FROM sg')
def signed_graph(spark, d):
    return network.to_signed_graph(edge_table(spark, d)).select("agA_name", "agB_name", "sign", F.round("belief", 9).alias("belief"))


@query(SIGNED + "SELECT a AS u, us, b AS v, CASE WHEN sgn = 0 THEN us ELSE 1 - us END AS vs FROM sg, (VALUES (0), (1)) t(us)")
def signed_nodes(spark, d):
    return network.signed_nodes(network.to_signed_graph(edge_table(spark, d))).select("u", "us", "v", "vs")


@query(EDGES + "SELECT a || ' ' || CASE WHEN arg_max(coalesce(sgn, -1), mk_hash) = 0 THEN '1' ELSE '-1' END || ' ' || b AS line FROM e GROUP BY a, b HAVING arg_max(coalesce(sgn, -1), mk_hash) >= 0")
def sif_lines(spark, d):
    return network.sif(edge_table(spark, d).withColumn("initial_sign", F.coalesce("initial_sign", F.lit(-1))).withColumn("initial_sign", F.col("initial_sign")))


@query(EDGES + ", g AS (SELECT b, string_agg(DISTINCT a, ' or ' ORDER BY a) FILTER (sgn = 0) AS p, string_agg(DISTINCT a, ' or ' ORDER BY a) FILTER (sgn = 1) AS m FROM e WHERE sgn IS NOT NULL GROUP BY b) SELECT b AS node, CASE WHEN m IS NULL THEN '(' || p || ')' WHEN p IS NULL THEN 'not (' || m || ')' ELSE '(' || p || ') and not (' || m || ')' END AS rule FROM g")
def boolean_net(spark, d):
    return network.boolean_net(edge_table(spark, d))


@query(EDGES + "SELECT a AS node, b AS other, round(max(belief), 9) AS belief FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY belief DESC, b) AS r FROM (SELECT a, b, round(1 - product(1 - belief), 12) AS belief FROM e GROUP BY a, b)) WHERE r <= 5 GROUP BY a, b")
def top_neighbours(spark, d):
    g = network.to_digraph(edge_table(spark, d)).withColumn("belief", F.round("belief", 12))
    return network.neighbours(g, most=5).select("node", "other", F.round("belief", 9).alias("belief"))


# paths over a graph whose nodes are parts


def part_graph(spark, d):
    p = table(spark, d, "part")
    n = p.count()
    u = F.col("p_partkey")
    one = p.select(u.alias("u"), ((u * 7 + 3) % n + 1).alias("v"), F.round("p_retailprice", 2).alias("weight"), (u % 3 == 0).cast("int").alias("sign"))
    two = p.select(u.alias("u"), ((u * 13 + 5) % n + 1).alias("v"), (F.round("p_retailprice", 2) / 2).alias("weight"), (u % 5 == 0).cast("int").alias("sign"))
    return one.union(two)


GRAPH = "WITH RECURSIVE k AS (SELECT count(*) AS n FROM part), g AS (SELECT p_partkey AS u, (p_partkey * 7 + 3) % n + 1 AS v, (p_partkey % 3 = 0)::INT AS sign FROM part, k UNION ALL SELECT p_partkey, (p_partkey * 13 + 5) % n + 1, (p_partkey % 5 = 0)::INT FROM part, k), starts AS (SELECT p_partkey AS start FROM part WHERE p_size = 1) "


def starts(spark, d):
    return table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("start"))


@query(GRAPH + ", b AS (SELECT start, start AS node, 0 AS level FROM starts UNION SELECT start, v, level + 1 FROM b JOIN g ON node = u WHERE level < 4) SELECT start, node, min(level) AS level FROM b GROUP BY start, node")
def path_levels(spark, d):
    return paths.bfs_levels(part_graph(spark, d), starts(spark, d), 4)


@query(GRAPH + ", s AS (SELECT DISTINCT u, v FROM g), b AS (SELECT start, [start] AS path FROM starts UNION ALL SELECT start, list_append(path, v) FROM b JOIN s ON path[-1] = u WHERE len(path) < 4 AND NOT list_contains(path, v)) SELECT start AS source, path[4] AS target, count(*) AS n FROM b WHERE len(path) = 4 GROUP BY ALL")
def simple_paths(spark, d):
    g = part_graph(spark, d)
    pairs = paths.bfs_levels(g, starts(spark, d), 3).select(F.col("start").alias("source"), F.col("node").alias("target")).where("source <> target")
    every = table(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("source"))
    return paths.simple_paths(g, pairs.join(every, "source", "left_semi"), 3).groupBy("source", "target").agg(F.count("*").alias("n"))


@query(GRAPH + ", b AS (SELECT start, start AS node, 0 AS s, 0 AS l FROM starts UNION SELECT start, u, xor(s, sign), l + 1 FROM b JOIN g ON node = v WHERE l < 3) SELECT start AS target, node AS source, min(l)::INT AS length FROM b WHERE l > 0 AND s = 0 AND NOT (node = start) GROUP BY start, node")
def find_sources(spark, d):
    g = part_graph(spark, d).select(F.col("u").alias("agA_name"), F.col("v").alias("agB_name"), "sign")
    e = network.signed_nodes(g)
    t = starts(spark, d).select(F.col("start").cast("string").alias("node"), F.lit(0).alias("sign"))
    e = e.select(F.col("u").cast("string").alias("u"), "us", F.col("v").cast("string").alias("v"), "vs")
    every = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("source"))
    out = paths.find_sources(e, t, every, 3).where("source <> target")
    return out.select(F.col("target").cast("long").alias("target"), F.col("source").cast("long").alias("source"), F.col("length").cast("int").alias("length"))


@query()
def cheapest_costs(spark, d):
    return paths.open_dijkstra(part_graph(spark, d), starts(spark, d), max_rounds=100)


@query(GRAPH + """, st AS (SELECT p_partkey AS subj, (p_partkey * 49 + 24) % n + 1 AS obj, (p_partkey % 2 = 1)::INT AS sgn FROM part, k),
b AS (SELECT DISTINCT obj AS start, obj AS node, 0 AS s, 0 AS l FROM st UNION SELECT start, u, xor(s, sign), l + 1 FROM b JOIN g ON node = v WHERE l < 8),
f AS (SELECT start, node, s, min(l) AS l FROM b GROUP BY ALL)
SELECT subj AS stmt_id, CASE WHEN l IS NULL THEN 'NO_PATHS_FOUND' WHEN l > 5 THEN 'MAX_PATH_LENGTH_EXCEEDED' ELSE 'PATHS_FOUND' END AS result_code, l::INT AS length FROM st LEFT JOIN f ON start = obj AND node = subj AND s = sgn AND (l > 0)""")
def check_model(spark, d):
    """A statement about every part."""
    p = table(spark, d, "part")
    n = p.count()
    g = part_graph(spark, d).select(F.col("u").cast("string").alias("agA_name"), F.col("v").cast("string").alias("agB_name"), "sign")
    st = p.select(F.col("p_partkey").alias("stmt_id"), F.when(F.col("p_partkey") % 2 == 0, "Activation").otherwise("Inhibition").alias("stmt_type"), F.col("p_partkey").cast("string").alias("subj"), ((F.col("p_partkey") * 49 + 24) % n + 1).cast("string").alias("obj"))
    return paths.check_model(network.signed_nodes(g), st).withColumn("length", F.col("length").cast("int"))


# mechanisms


@query(W + "SELECT stmt_id, sk AS a, pk AS b FROM st WHERE stmt_type = 'Phosphorylation'")
def infer_complexes(spark, d):
    return mechanisms.infer_complexes(corpus(spark, d)).select(F.col("sources")[0].alias("stmt_id"), "a", "b")


@query(W + "SELECT DISTINCT 'Dephosphorylation' AS stmt_type, pk AS k, coalesce(residue, '~') AS residue, coalesce(position, '~') AS position FROM st WHERE stmt_type = 'Phosphorylation' UNION ALL SELECT DISTINCT 'DecreaseAmount', pk, '~', '~' FROM st WHERE stmt_type = 'IncreaseAmount' AND pk NOT IN (SELECT pk FROM st WHERE stmt_type = 'DecreaseAmount')")
def add_reverse_effects(spark, d):
    return mechanisms.add_reverse_effects(corpus(spark, d))


@query(W + "SELECT pn AS name, array_to_string(list_sort(list(DISTINCT 'phosphorylation,' || coalesce(residue, '~') || ',' || coalesce(position, '~'))), ';') AS sites FROM st WHERE stmt_type = 'Phosphorylation' GROUP BY pn")
def gather_modifications(spark, d):
    return mechanisms.gather_modifications(corpus(spark, d)).select("name", F.array_join("sites", ";").alias("sites"))


# presentation, query algebra, pipelines, streams


@query(EDGES + 'SELECT a AS "agA_name", b AS "agB_name", stmt_type, sum(n)::BIGINT AS ev_count, round(max(belief), 9) AS belief, count(*) AS n_stmts FROM (SELECT a, b, stmt_type, mk_hash, max(n) AS n, max(belief) AS belief FROM e GROUP BY ALL) GROUP BY ALL')
def group_relations(spark, d):
    return presentation.group_and_sort(believed(spark, d)).withColumn("belief", F.round("belief", 9))


@query(W + "SELECT 'p' || p AS text, count(*) AS n FROM st WHERE NOT p_grounded GROUP BY p")
def ungrounded_texts(spark, d):
    return presentation.ungrounded_texts(corpus(spark, d))


@query(W + "SELECT 's' || s AS text, count(*) AS total, 'HGNC' AS ns, s::VARCHAR AS id FROM st GROUP BY s UNION ALL SELECT 'p' || p, count(*), CASE WHEN p_grounded THEN 'UP' END, CASE WHEN p_grounded THEN p::VARCHAR END FROM st GROUP BY p, p_grounded")
def agent_texts_with_grounding(spark, d):
    t = presentation.agent_texts_with_grounding(corpus(spark, d))
    return t.select("text", "total", F.col("groundings")[0]["ns"].alias("ns"), F.col("groundings")[0]["id"].alias("id"))


@query(W + "SELECT stmt_id, sn || CASE stmt_type WHEN 'Activation' THEN ' activates ' WHEN 'Inhibition' THEN ' inhibits ' WHEN 'Phosphorylation' THEN ' phosphorylates ' WHEN 'Complex' THEN ' binds ' WHEN 'IncreaseAmount' THEN ' increases the amount of ' ELSE ' decreases the amount of ' END || pn || CASE WHEN residue IS NOT NULL THEN ' on ' || residue || coalesce(position, '') ELSE '' END || '.' AS sentence FROM st")
def english(spark, d):
    c = corpus(spark, d)
    names = c.agents.groupBy("stmt_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "name"))), lambda a: a["name"]).alias("names"))
    return c.statements.join(names, "stmt_id").select("stmt_id", presentation.english(F.col("names"), F.col("stmt_type"), F.col("residue"), F.col("position")).alias("sentence"))


@query(DEDUP + "SELECT d.stmt_id, mk_hash FROM d JOIN (SELECT mk_hash, count(*) AS n, bool_or(src = 'reach') AS re, bool_or(src IN ('signor', 'biopax')) AS db FROM ev GROUP BY mk_hash) USING (mk_hash) WHERE (stmt_type IN ('Activation', 'Inhibition') AND re AND db) OR (n >= 3 AND NOT sn = 'supp1')")
def query_algebra(spark, d):
    tree = (q.HasType(["RegulateActivity"], include_subclasses=True) & q.HasSources(["reach"]) & q.HasDatabases()) | (q.HasEvidenceBound([">= 3"]) & ~q.HasAgent("supp1", role="subj"))
    return q.from_json(tree.to_json()).get(dedup(spark, d)).select("stmt_id", "mk_hash")


@query(W + ", f AS (SELECT * FROM st WHERE p_grounded AND stmt_type <> 'Complex' AND NOT hyp) SELECT mk_hash, min(stmt_id) AS stmt_id FROM f GROUP BY mk_hash")
def json_pipeline(spark, d):
    steps = Pipeline().append("filter_grounded_only").append("filter_by_type", "Complex", invert=True).append("filter_no_hypothesis").append("combine_duplicates")
    return Pipeline.from_json(steps.to_json()).run(corpus(spark, d)).statements.select("mk_hash", "stmt_id")


@query("SELECT date_trunc('hour', ts) AS hour, user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def evidence_stream_counts(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = evidence_counts(ev, "ts", keys=("user_id", "event_type"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "user_id", "event_type", "n")
