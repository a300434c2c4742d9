"""Tables of the engine and its fixed vocabulary of assertion types.

A corpus is three DataFrames: ``statements`` (one row an assertion), ``agents`` (one row an argument) and ``evidence``
(one row a supporting sentence or record). Nested parts of an agent are arrays of structs; nothing is nested deeper
than one level, so filters and columns reach the Parquet scan.

Statements may carry their arguments and evidence as arrays, ``args`` and ``ev``. Keys, pairs of arguments and filters
are then worked out in the row, without a shuffle, and the other two tables are those arrays exploded. An operator that rewrites
agents or evidence drops the array it has outdated.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MOD = "struct<mod_type:string,residue:string,position:string,is_modified:boolean>"
MUT = "struct<position:string,residue_from:string,residue_to:string>"
BOUND = "struct<name:string,db_refs:map<string,string>,is_bound:boolean>"
ACT = "struct<activity_type:string,is_active:boolean>"

STATEMENTS = "stmt_id long, stmt_type string, residue string, position string, activity string, is_active boolean, from_location string, to_location string, belief double"
AGENTS = f"stmt_id long, role string, idx int, name string, db_refs map<string,string>, mods array<{MOD}>, mutations array<{MUT}>, bound array<{BOUND}>, activity {ACT}, location string"
EVIDENCE = "stmt_id long, ord int, source_api string, source_id string, pmid string, text string, text_refs map<string,string>, annotations string, direct boolean, hypothesis boolean, negated boolean"
REFINEMENTS = "refiner long, refined long"
ONTO_NODES = "ns string, id string, name string, type string, obsolete boolean, polarity int"
ONTO_EDGES = "s_ns string, s_id string, t_ns string, t_id string, rel string"

# Names of the assertion types and how they descend from each other.
ADDING = ("Phosphorylation", "Hydroxylation", "Sumoylation", "Acetylation", "Glycosylation", "Ribosylation", "Ubiquitination", "Farnesylation", "Geranylgeranylation", "Palmitoylation", "Myristoylation", "Methylation")
REMOVING = ("Dephosphorylation", "Dehydroxylation", "Desumoylation", "Deacetylation", "Deglycosylation", "Deribosylation", "Deubiquitination", "Defarnesylation", "Degeranylgeranylation", "Depalmitoylation", "Demyristoylation", "Demethylation")
PARENTS = {
    **dict.fromkeys(ADDING, "AddModification"),
    **dict.fromkeys(REMOVING, "RemoveModification"),
    "AddModification": "Modification", "RemoveModification": "Modification", "Modification": "Statement",
    "SelfModification": "Statement", "Autophosphorylation": "SelfModification", "Transphosphorylation": "SelfModification",
    "RegulateActivity": "Statement", "Activation": "RegulateActivity", "Inhibition": "RegulateActivity", "GtpActivation": "Activation",
    "ActiveForm": "Statement", "HasActivity": "Statement", "Gef": "Statement", "Gap": "Statement", "Complex": "Statement", "Translocation": "Statement",
    "RegulateAmount": "Statement", "IncreaseAmount": "RegulateAmount", "DecreaseAmount": "RegulateAmount",
    "Influence": "Statement", "Association": "Complex", "Conversion": "Statement", "Event": "Statement", "Migration": "Event", "Unresolved": "Statement",
}
#: Namespaces in the order in which a grounding is taken.
NS_ORDER = ("FPLX", "UPPRO", "HGNC", "UP", "CHEBI", "GO", "MESH", "MIRBASE", "DOID", "HP", "EFO")
TEXT_NS = ("TEXT", "TEXT_NORM")
#: Sign of a type's effect on its object: 0 positive, 1 negative.
SIGNS = {"Activation": 0, "GtpActivation": 0, "IncreaseAmount": 0, "Inhibition": 1, "DecreaseAmount": 1}
OPPOSITES = {**dict(zip(ADDING, REMOVING, strict=True)), "Activation": "Inhibition", "IncreaseAmount": "DecreaseAmount"}
INVERSE = {**dict(zip(ADDING, REMOVING, strict=True)), **dict(zip(REMOVING, ADDING, strict=True))}
#: Types without an order among their arguments.
SYMMETRIC = ("Complex", "Association")


def descendants(name: str) -> tuple[str, ...]:
    """The type (found without regard to case) and all types below it."""
    known = {n.lower(): n for n in {*PARENTS, *PARENTS.values()}}
    if name.lower() not in known:
        raise ValueError(f"unknown type {name!r}")
    out, todo = [], [known[name.lower()]]
    while todo:
        out.append(t := todo.pop())
        todo += [c for c, p in PARENTS.items() if p == t]
    return tuple(sorted(out))


@dataclass(frozen=True)
class Corpus:
    """The three tables, and the pairs of specific and general assertions once they are known."""

    statements: DataFrame
    agents: DataFrame
    evidence: DataFrame
    refinements: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.statements.sparkSession

    def with_(self, **parts: DataFrame | None) -> Corpus:
        """With other tables; the arrays of rewritten agents or evidence go."""
        statements = parts.get("statements", self.statements)
        old = [a for a, t in (("args", "agents"), ("ev", "evidence")) if t in parts and a in statements.columns]
        return replace(self, **(parts | ({"statements": statements.drop(*old)} if old else {})))

    def keep(self, statements: DataFrame) -> Corpus:
        """Only these statements; agents and evidence are their arrays, or follow by a semi-join on stmt_id when they are used."""
        ids = statements.select("stmt_id")
        agents = exploded(statements, "args") if "args" in statements.columns else self.agents.join(ids, "stmt_id", "left_semi")
        evidence = exploded(statements, "ev") if "ev" in statements.columns else self.evidence.join(ids, "stmt_id", "left_semi")
        return replace(self, statements=statements, agents=agents, evidence=evidence)

    def transform(self, fn, *args, **kwargs) -> Corpus:
        return fn(self, *args, **kwargs)


def exploded(statements: DataFrame, array: str) -> DataFrame:
    """Rows of agents (``args``) or evidence (``ev``) from the arrays of ``statements``."""
    return statements.select("stmt_id", F.explode(array).alias("__x")).select("stmt_id", "__x.*")


def packed(statements: DataFrame) -> Corpus:
    """A corpus of statements with both arrays."""
    return Corpus(statements, exploded(statements, "args"), exploded(statements, "ev"))


def struct_of(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def empty_corpus(spark: SparkSession) -> Corpus:
    return Corpus(*(spark.createDataFrame([], d) for d in (STATEMENTS, AGENTS, EVIDENCE)))
