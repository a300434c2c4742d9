"""Belief from evidence.

Belief of an assertion is pp * (1 - np): for its positive evidence, 1 - product over sources of (systematic error + random error to
the number of its evidences), and the same for its negated evidence. Random errors multiply, so a source needs only its number
of evidences: a map-side count by (assertion, negated, source) and one small aggregation.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Corpus
from .preassembly import refinement_closure

# Error rates of the sources.
SYST = {"biopax": 0.01, "bel": 0.01, "signor": 0.01, "biogrid": 0.01, "trips": 0.05, "reach": 0.05, "sparser": 0.05, "eidos": 0.05, "medscan": 0.05, "rlimsp": 0.05, "assertion": 0.0}
RAND = {"biopax": 0.2, "bel": 0.1, "signor": 0.1, "biogrid": 0.1, "trips": 0.3, "reach": 0.3, "sparser": 0.3, "eidos": 0.3, "medscan": 0.3, "rlimsp": 0.2, "assertion": 0.0}
BAYES_SYST = 0.05


def priors(spark, syst: dict[str, float] | None = None, rand: dict[str, float] | None = None) -> DataFrame:
    """(source_api, syst, rand): the defaults with the given ones over them."""
    s, r = SYST | (syst or {}), RAND | (rand or {})
    return spark.createDataFrame([(k, float(s[k]), float(r[k])) for k in sorted(s.keys() & r.keys())], "source_api string, syst double, rand double")


def bayesian_priors(spark, counts: dict[str, tuple[int, int]]) -> DataFrame:
    """From (correct, incorrect) counts of each source over the defaults: rand = 1 - min(p / (n + p), 0.95) - 0.05."""
    rand = {k: 1 - min(p / (n + p), 1 - BAYES_SYST) - BAYES_SYST for k, (p, n) in counts.items()}
    return priors(spark, dict.fromkeys(counts, BAYES_SYST), rand)


def check_priors(evidence: DataFrame, table: DataFrame) -> None:
    missing = [r[0] for r in evidence.select("source_api").distinct().join(table, "source_api", "left_anti").limit(20).collect()]
    if missing:
        raise ValueError(f"sources without error rates: {missing}")


def score_evidence(evidence: DataFrame, table: DataFrame, subtypes: DataFrame | None = None) -> DataFrame:
    """(stmt_id, belief) over ``evidence(stmt_id, source_api, negated[, subtype])``; ``subtypes(source_api, subtype, rand)`` replace a source's random error."""
    ev = evidence.withColumn("negated", F.coalesce("negated", F.lit(False)))
    if subtypes is None:
        by = ev.groupBy("stmt_id", "negated", "source_api").agg(F.count("*").alias("n")).join(F.broadcast(table), "source_api").withColumn("err", F.col("syst") + F.pow("rand", "n"))
    else:
        by = ev.groupBy("stmt_id", "negated", "source_api", "subtype").agg(F.count("*").alias("n")).join(F.broadcast(table), "source_api").join(F.broadcast(subtypes.withColumnRenamed("rand", "__r")), ["source_api", "subtype"], "left")
        by = by.groupBy("stmt_id", "negated", "source_api", "syst").agg(F.product(F.pow(F.coalesce("__r", "rand"), "n")).alias("r")).withColumn("err", F.col("syst") + F.col("r"))
    p = by.groupBy("stmt_id").agg(F.product(F.when(~F.col("negated"), F.col("err"))).alias("pos"), F.product(F.when(F.col("negated"), F.col("err"))).alias("neg"))
    return p.select("stmt_id", (F.coalesce(1 - F.col("pos"), F.lit(0.0)) * (1 - F.coalesce(1 - F.col("neg"), F.lit(0.0)))).alias("belief"))


def with_belief(c: Corpus, scores: DataFrame) -> Corpus:
    st = c.statements.drop("belief").join(scores, "stmt_id", "left").withColumn("belief", F.coalesce("belief", F.lit(0.0)))
    return c.with_(statements=st)


def set_prior_probs(c: Corpus, table: DataFrame | None = None) -> Corpus:
    """From each assertion's own evidence."""
    return with_belief(c, score_evidence(c.evidence, table if table is not None else priors(c.spark)))


def hierarchy_evidence(c: Corpus) -> DataFrame:
    """Own evidence, and the evidence of all more specific assertions that is not negated; an evidence row counts once."""
    closed = refinement_closure(c.refinements)
    more = c.evidence.where("not coalesce(negated, false)").join(closed.withColumnRenamed("refiner", "stmt_id"), "stmt_id")
    row = ["source_api", "negated", "ord"]
    return c.evidence.select("stmt_id", *row, F.col("stmt_id").alias("origin")).union(more.select(F.col("refined").alias("stmt_id"), *row, F.col("stmt_id").alias("origin"))).dropDuplicates(["stmt_id", "origin", "ord"])


def set_hierarchy_probs(c: Corpus, table: DataFrame | None = None) -> Corpus:
    return with_belief(c, score_evidence(hierarchy_evidence(c), table if table is not None else priors(c.spark)))


def linked_probs(linked: DataFrame, beliefs: DataFrame) -> DataFrame:
    """``linked(inferred, source)`` to (inferred, belief): the product of the sources' beliefs."""
    return linked.join(beliefs.withColumnRenamed("stmt_id", "source"), "source").groupBy("inferred").agg(F.product("belief").alias("belief"))


def linked_log_probs(linked: DataFrame, beliefs: DataFrame) -> DataFrame:
    """``linked(inferred, source)`` to (inferred, log_belief): the sum of the logarithms, which many sources do not drive to nought."""
    return linked.join(beliefs.withColumnRenamed("stmt_id", "source"), "source").groupBy("inferred").agg(F.sum(F.log("belief")).alias("log_belief"))


def sample_statements(c: Corpus, seed: int = 0) -> Corpus:
    """Each assertion with the probability of its belief; the lot is a hash of its id and the seed, so reruns agree."""
    lot = F.pmod(F.xxhash64("stmt_id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return c.keep(c.statements.where(lot < F.col("belief")))


def evidence_subtype() -> Column:
    """The rule that found an evidence, as its annotations have it; null if they do not."""
    return F.get_json_object("annotations", "$.found_by")


def features(c: Corpus, sources: list[str]) -> DataFrame:
    """Counts by source, numbers of papers and arguments, the type and whether a site is known: the input of a learned scorer."""
    n = c.evidence.groupBy("stmt_id").agg(*(F.sum(F.when(F.col("source_api") == s, 1).otherwise(0)).cast("double").alias(f"n_{s}") for s in sources), F.countDistinct(F.coalesce("pmid", F.lit(""))).cast("double").alias("n_pmid"))
    args = c.agents.groupBy("stmt_id").agg(F.count("name").cast("double").alias("n_agents"))
    site = (F.col("residue").isNotNull() & F.col("position").isNotNull()).cast("double").alias("has_site")
    return c.statements.select("stmt_id", "stmt_type", site).join(n, "stmt_id", "left").join(args, "stmt_id", "left").na.fill(0.0)


def fit_scorer(data: DataFrame, label: str = "label"):
    """A logistic regression over the numeric feature columns."""
    cols = [n for n, t in data.dtypes if t == "double" and n != label]
    return Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label, maxIter=30, regParam=0.01)]).fit(data)


def predict_proba(model, data: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(data).withColumn("probability", vector_to_array("probability")[1])


def hybrid(learned: DataFrame, simple: DataFrame) -> DataFrame:
    """1 - (1 - learned) * (1 - simple), where either may be missing."""
    both = learned.withColumnRenamed("belief", "a").join(simple.withColumnRenamed("belief", "b"), "stmt_id", "full_outer")
    return both.select("stmt_id", (1 - (1 - F.coalesce("a", F.lit(0.0))) * (1 - F.coalesce("b", F.lit(0.0)))).alias("belief"))
