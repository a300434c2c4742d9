"""Boolean queries over a corpus. A query compiles to one Column over a row for each assertion, so a whole tree is one filter."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import statement_keys
from ..schema import NS_ORDER, Corpus, descendants

READERS = ("reach", "sparser", "medscan", "trips", "rlimsp", "isi", "eidos", "gnbr", "geneways", "semrep")
DATABASES = ("biopax", "bel", "signor", "biogrid", "ctd", "trrust", "tas", "dgi", "drugbank", "hprd", "virhostnet", "phosphoelm", "omnipath", "acsn", "creeds", "ubibrowser")


def rows(c: Corpus) -> DataFrame:
    """A row for each assertion: mk_hash, sources, ev_count, papers and args(name, role, idx, db_refs)."""
    whole = lambda of: F.struct(of("idx").alias("idx"), of("role").alias("role"), of("name").alias("name"), *(F.coalesce(F.try_element_at(of("db_refs"), F.lit(n)), F.lit("")).alias(n) for n in (*NS_ORDER, "TEXT")))
    ev = c.evidence.groupBy("stmt_id").agg(F.collect_set("source_api").alias("sources"), F.count("*").alias("ev_count"), F.collect_set("pmid").alias("papers"))
    none = F.array().cast("array<string>")
    st = c.statements if "mk_hash" in c.statements.columns else statement_keys(c)
    if "args" in st.columns:
        st = st.withColumn("args", F.array_sort(F.transform("args", lambda a: whole(lambda f: a[f]))))
    else:
        st = st.join(c.agents.groupBy("stmt_id").agg(F.array_sort(F.collect_list(whole(F.col))).alias("args")), "stmt_id", "left")
    return st.join(ev, "stmt_id", "left").withColumn("ev_count", F.coalesce("ev_count", F.lit(0))).withColumn("sources", F.coalesce("sources", none)).withColumn("papers", F.coalesce("papers", none))


class Query:
    def column(self) -> Column:
        raise NotImplementedError

    def __and__(self, other: Query) -> Query:
        return other if isinstance(self, EmptyQuery) else self if isinstance(other, EmptyQuery) else And((self, other))

    def __or__(self, other: Query) -> Query:
        return other if isinstance(self, EmptyQuery) else self if isinstance(other, EmptyQuery) else Or((self, other))

    def __invert__(self) -> Query:
        return Not(self)

    def to_json(self) -> dict:
        plain = lambda v: v.to_json() if isinstance(v, Query) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v
        return {"class": type(self).__name__, "constraint": {k: plain(v) for k, v in vars(self).items()}}

    def get(self, c: Corpus, limit: int | None = None, sort_by: str | None = None, offset: int | None = None) -> DataFrame:
        out = rows(c).where(F.coalesce(self.column(), F.lit(False)))
        if sort_by:
            out = out.orderBy(F.desc(sort_by), "mk_hash", "stmt_id")
        out = out.offset(offset) if offset else out
        return out if limit is None else out.limit(limit)


@dataclass
class EmptyQuery(Query):
    def column(self) -> Column:
        return F.lit(True)


@dataclass
class And(Query):
    queries: tuple[Query, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, (q.column() for q in self.queries))


@dataclass
class Or(Query):
    queries: tuple[Query, ...]

    def column(self) -> Column:
        return reduce(lambda a, b: a | b, (q.column() for q in self.queries))


@dataclass
class Not(Query):
    query: Query

    def column(self) -> Column:
        return ~F.coalesce(self.query.column(), F.lit(False))


@dataclass
class HasOnlySource(Query):
    only_source: str

    def column(self) -> Column:
        return (F.size("sources") == 1) & F.array_contains("sources", self.only_source)


@dataclass
class HasSources(Query):
    sources: list[str]

    def column(self) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, self.sources)), F.col("sources"))) == 0


@dataclass
class HasReadings(Query):
    def column(self) -> Column:
        return F.arrays_overlap("sources", F.array(*map(F.lit, READERS)))


@dataclass
class HasDatabases(Query):
    def column(self) -> Column:
        return F.arrays_overlap("sources", F.array(*map(F.lit, DATABASES)))


@dataclass
class HasHash(Query):
    stmt_hashes: list[int]

    def column(self) -> Column:
        return F.col("mk_hash").isin(*self.stmt_hashes)


@dataclass
class HasAgent(Query):
    agent_id: str
    namespace: str = "NAME"
    role: str | None = None
    agent_num: int | None = None

    def column(self) -> Column:
        field = "name" if self.namespace == "NAME" else self.namespace

        def hit(a: Column) -> Column:
            out = a[field] == self.agent_id
            if self.role is not None:
                out = out & (a["role"] == self.role.lower())
            return out if self.agent_num is None else out & (a["idx"] == self.agent_num)

        return F.exists("args", hit)


@dataclass
class FromPapers(Query):
    papers: list[str]

    def column(self) -> Column:
        return F.arrays_overlap("papers", F.array(*map(F.lit, self.papers)))


@dataclass
class HasNumAgents(Query):
    agent_nums: list[int]

    def column(self) -> Column:
        return F.size("args").isin(*self.agent_nums)


@dataclass
class HasNumEvidence(Query):
    evidence_nums: list[int]

    def column(self) -> Column:
        return F.col("ev_count").isin(*self.evidence_nums)


@dataclass
class HasEvidenceBound(Query):
    bounds: list[str]

    def column(self) -> Column:
        def one(b: str) -> Column:
            m = re.fullmatch(r"\s*(<=|>=|==|!=|<|>)\s*(\d+)\s*", b)
            if not m:
                raise ValueError(f"no comparison: {b!r}")
            n, e = int(m[2]), F.col("ev_count")
            return {"<": e < n, ">": e > n, "<=": e <= n, ">=": e >= n, "==": e == n, "!=": e != n}[m[1]]

        return reduce(lambda a, b: a & b, map(one, self.bounds))


@dataclass
class HasType(Query):
    stmt_types: list[str]
    include_subclasses: bool = False

    def column(self) -> Column:
        names = [d for t in self.stmt_types for d in (descendants(t) if self.include_subclasses else (t,))]
        return F.col("stmt_type").isin(*names)


def from_json(spec: dict) -> Query:
    known = {k.__name__: k for k in (EmptyQuery, And, Or, Not, HasOnlySource, HasSources, HasReadings, HasDatabases, HasHash, HasAgent, FromPapers, HasNumAgents, HasNumEvidence, HasEvidenceBound, HasType)}
    value = lambda v: from_json(v) if isinstance(v, dict) and "class" in v else tuple(map(value, v)) if isinstance(v, list) and any(isinstance(x, dict) for x in v) else v
    return known[spec["class"]](**{k: value(v) for k, v in spec["constraint"].items()})
