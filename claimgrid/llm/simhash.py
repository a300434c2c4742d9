"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are compared as distinct values with their smallest doc_id, so exact copies never
meet each other. The bits are grouped into partitions by their correlation. If two fingerprints differ in at
most ``RADIUS`` bits and thresholds t_1..t_m add up to RADIUS - m + 1, then in some partition i they differ
in at most t_i bits (t_i = -1 leaves a partition out). Each fingerprint has its own thresholds: a dynamic
program over the partitions takes those with the fewest estimated candidates, estimated from exact counts of
pieces of up to ``PIECE_BITS`` bits over all fingerprints (a table of fixed size). A fingerprint probes every
value within t_i of its own in partition i; what meets is verified over all 64 bits.

Hot values: where probes times entries of one (partition, value) pass ``PAIRS``, both sides are cut into
blocks of ``BLOCK`` rows; every pair of blocks is one group that is compared as a matrix and gives only a
spanning forest of its links, so a group of n near copies costs rows as n * n / BLOCK and no pair list.
Components come from alternating star rounds over these links.

Cases: null, empty and blank texts have fingerprint 0 and link like any other; a null doc_id is kept out of
the smallest doc_id unless its whole component has none; repeated rows each get their row; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, table, trimmed, written

RADIUS = 3
BITS = 64
SEED = 42
PIECE_BITS = 11
BLOCK = 1024
PAIRS = 4096
FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: A fingerprint with over a SHARE-th of all rows is frequent.
SHARE = 1000


def fingerprint(text: str | None, n: int = 3) -> int:
    """SimHash of the word n-grams with repeats; a bit is set if it is set in over half of their hashes."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not words:
        return 0
    line, m = b" ".join(words), max(1, len(words) - n + 1)
    begin = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    ends = (begin[n:] - 1).tolist() if len(words) > n else [len(line)]
    counts = np.zeros(BITS, np.int64)
    spans = zip(begin[:m].tolist(), ends, strict=False)
    for lo in range(0, m, CHUNK):
        k = min(CHUNK, m - lo)
        h = np.fromiter((xxh64_intdigest(line[a:b], SEED) for (a, b), _ in zip(spans, range(k))), np.uint64, k)  # noqa: B905
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(counts * 2 > m).tolist()))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of ``docs(doc_id, text)``."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: trimmed(batches(it)), "doc_id long, fp long")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have both bits i and j set: 64 x 64 sums over all of them."""

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, both = 0, np.zeros((BITS, BITS))
        for pdf in it:
            x = np.unpackbits(pdf["fp"].to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n, both = n + len(x), both + (x.T @ x).astype(np.float64)
        if n:
            yield pd.DataFrame({"k": range(BITS), "n": n, "row": [r.tolist() for r in both]})

    rows = fps.mapInPandas(batches, "k int, n long, row array<double>")
    sums = rows.groupBy("k").agg(F.sum("n").alias("n"), *(F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(BITS))).toPandas().sort_values("k")
    if not len(sums):
        return 0, np.zeros((BITS, BITS))
    return int(sums["n"].iloc[0]), sums[[f"c{j}" for j in range(BITS)]].to_numpy()


def partitions(n: int, both: np.ndarray, widths: list[int]) -> list[list[int]]:
    """Bits grouped so that those of one partition are correlated: each group grows by the bit most correlated with it."""
    p = np.diag(both) / max(n, 1)
    var = np.maximum(p * (1 - p), 1e-9)
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.sqrt(np.outer(var, var))
    left, out = set(range(BITS)), []
    for w in widths:
        group = [max(left, key=lambda b: (sum(corr[b][c] for c in left if c != b), -b))]
        left.remove(group[0])
        while len(group) < w:
            best = max(left, key=lambda b: (sum(corr[b][c] for c in group), -b))
            group.append(best)
            left.remove(best)
        out.append(group)
    return out


def pieces_of(parts: list[list[int]]) -> list[list[list[int]]]:
    """Each partition's bits cut evenly into pieces of up to PIECE_BITS."""
    return [[list(x) for x in np.array_split(p, -(-len(p) // PIECE_BITS))] for p in parts]


def gather(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed."""
    u, out = fp.view(np.uint64), np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((u >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out.view(np.int64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64) if x.dtype == np.int64 else x)


def near_counts(counts: np.ndarray, most: int) -> np.ndarray:
    """counts[v] rows have value v; out[d][v]: rows whose value differs from v in exactly d bits, for d up to ``most``."""
    bits = len(counts).bit_length() - 1
    out = np.zeros((most + 1, len(counts)))
    out[0] = counts
    index = np.arange(len(counts))
    for b in range(bits):  # bit by bit: what was at distance d is at d + 1 once this bit flips
        out[1:] += out[:-1][:, index ^ (1 << b)]
    return out


@cache
def ball(bits: int, radius: int) -> np.ndarray:
    """All masks of ``bits`` bits with at most ``radius`` set."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], np.int64)


def thresholds(fp: np.ndarray, pieces: list[list[list[int]]], tables: list[list[np.ndarray]], n: int, radius: int = RADIUS, probe_cost: float = 1.0) -> np.ndarray:
    """For each fingerprint one threshold for each partition, adding up to radius - m + 1, with the least estimated cost."""
    m, top = len(pieces), radius
    cost = np.zeros((m, top + 2, len(fp)))  # cost[i][t + 1]; t = -1 costs nothing
    for i, own in enumerate(pieces):
        at = None  # expected share of rows at distance d in the partition, its pieces taken as independent
        for bits, table_ in zip(own, tables[i], strict=True):
            share = table_[:, gather(fp, bits)] / max(n, 1)
            at = share if at is None else np.array([sum(at[a] * share[d - a] for a in range(d + 1)) for d in range(top + 1)])
        width, within, probes = sum(map(len, own)), np.cumsum(at, axis=0) * n, 0
        for t in range(top + 1):
            probes += len(list(combinations(range(width), t))) if t < 3 else width**3 // 6
            cost[i][t + 1] = within[t] + probe_cost * probes
    need = top - m + 1 + m  # of the t + 1, which are not negative
    best = np.full((need + 1, len(fp)), np.inf)
    best[0] = 0
    taken = np.zeros((m, need + 1, len(fp)), np.int8)
    for i in range(m):
        new = np.full_like(best, np.inf)
        for s in range(need + 1):
            for u in range(min(s, top + 1) + 1):
                x = best[s - u] + cost[i][u]
                better = x < new[s]
                new[s] = np.where(better, x, new[s])
                taken[i][s] = np.where(better, u, taken[i][s])
        best = new
    out, s = np.zeros((m, len(fp)), np.int64), np.full(len(fp), need)
    for i in range(m - 1, -1, -1):
        out[i] = taken[i][s, np.arange(len(fp))] - 1
        s = s - out[i] - 1
    return out


def piece_tables(fps: DataFrame, pieces: list[list[list[int]]], radius: int = RADIUS) -> list[list[np.ndarray]]:
    """Exact counts of every piece's values over all fingerprints, by distance: at most 64 / 6 pieces of 2048 values."""
    flat = [b for own in pieces for b in own]

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = [np.zeros(1 << len(b), np.int64) for b in flat]
        for pdf in it:
            fp = pdf["fp"].to_numpy().astype(np.int64)
            for k, b in enumerate(flat):
                sums[k] += np.bincount(gather(fp, b), minlength=1 << len(b))
        yield pd.concat([pd.DataFrame({"piece": k, "value": np.flatnonzero(s), "n": s[s > 0]}) for k, s in enumerate(sums)])

    got = fps.mapInPandas(batches, "piece int, value int, n long").groupBy("piece", "value").agg(F.sum("n").alias("n")).toPandas()
    out = []
    for k, b in enumerate(flat):
        counts = np.zeros(1 << len(b))
        own = got[got["piece"] == k]
        counts[own["value"].to_numpy()] = own["n"].to_numpy()
        out.append(near_counts(counts, radius))
    it = iter(out)
    return [[next(it) for _ in own] for own in pieces]


def widths_for(n: int) -> list[int]:
    """Partition widths: fewer and wider partitions cost more probes but meet fewer strangers. The least expected sum is taken."""
    best = None
    for m in (4, 3, 2):
        widths = [BITS // m + (i < BITS % m) for i in range(m)]
        spare = RADIUS - m + 1
        probes = m - 1 + (1 + widths[0] if spare else 1) if m > 2 else sum(1 + w for w in widths)
        strangers = probes * n / 2.0 ** min(widths)
        if best is None or 4 * probes + strangers < best[0]:
            best = (4 * probes + strangers, widths)
    return best[1]


def links(fps: DataFrame, n: int) -> DataFrame:
    """Pairs (u, v) of the distinct ``fps(fp)`` within RADIUS: all pairs of ordinary values, a spanning forest of each block pair of hot values."""
    n_known, both = bit_moments(fps)
    parts = partitions(n_known, both, widths_for(n))
    pieces = pieces_of(parts)
    tables = piece_tables(fps, pieces)
    flat = [[b for own in p for b in own] for p in pieces]

    def entries(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            fp = pdf["fp"].to_numpy().astype(np.int64)
            yield pd.DataFrame({"part": np.repeat(np.arange(len(flat), dtype=np.int32), len(fp)), "value": np.concatenate([gather(fp, b) for b in flat]), "fp": np.tile(fp, len(flat))})

    def probes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            whole = pdf["fp"].to_numpy().astype(np.int64)
            for lo in range(0, len(whole), 2048):
                fp = whole[lo : lo + 2048]
                ts = thresholds(fp, pieces, tables, n)
                for i, bits in enumerate(flat):
                    value = gather(fp, bits)
                    for t in range(RADIUS + 1):
                        own = ts[i] == t
                        if own.any():
                            masks = ball(len(bits), t)
                            yield pd.DataFrame({"part": np.int32(i), "value": (value[own][:, None] ^ masks[None, :]).ravel(), "fp": np.repeat(fp[own], len(masks))})

    schema = "part int, value long, fp long"
    left, right = (fps.mapInPandas(lambda it, fn=fn: trimmed(fn(it)), schema) for fn in (entries, probes))
    sizes = left.groupBy("part", "value").agg(F.count("*").alias("n_in"))
    hot_in = checkpoint(sizes.where(F.col("n_in") > PAIRS // 64))
    met = right.join(F.broadcast(hot_in.select("part", "value", "n_in")) if hot_in.count() <= 10_000 else hot_in, ["part", "value"]).groupBy("part", "value").agg(F.count("*").alias("n_probe"), F.max("n_in").alias("n_in"))
    hot = checkpoint(met.where(F.col("n_in") * F.col("n_probe") > PAIRS).withColumnsRenamed({"part": "p", "value": "v"}))
    small = hot.count() <= 10_000
    seen = F.broadcast(hot) if small else hot
    on = lambda d: (d["part"] == hot["p"]) & (d["value"] == hot["v"])
    cold = left.join(seen, on(left), "left_anti").withColumnRenamed("fp", "v_fp")
    probe = right.join(seen, on(right), "left_anti").withColumnRenamed("fp", "u_fp")
    pairs = probe.join(cold, ["part", "value"]).where((F.col("u_fp") < F.col("v_fp")) & (F.bit_count(F.col("u_fp").bitwiseXOR(F.col("v_fp"))) <= RADIUS)).select(F.col("u_fp").alias("u"), F.col("v_fp").alias("v"))

    # hot values: block pairs; a row goes to a block by its hash and meets every block of the other side
    n_blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.lit(1 << 30))
    a = left.join(seen, on(left)).select("part", "value", "fp", (own % n_blocks("n_in")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), n_blocks("n_probe") - 1)).alias("j"), F.lit(0).alias("side"))
    b = right.join(seen, on(right)).select("part", "value", "fp", F.explode(F.sequence(F.lit(0), n_blocks("n_in") - 1)).alias("i"), (own % n_blocks("n_probe")).cast("int").alias("j"), F.lit(1).alias("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf.loc[pdf["side"] == 0, "fp"].unique(), pdf.loc[pdf["side"] == 1, "fp"].unique()
        return pd.DataFrame(forest(x, y), columns=["u", "v"])

    hot_pairs = a.union(b).groupBy("part", "value", "i", "j").applyInPandas(compare, "u long, v long")
    return pairs.union(hot_pairs).distinct()


def forest(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between x and y."""
    up: dict[int, int] = {}

    def root(k: int) -> int:
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    out = []
    for k in x.tolist():
        for o in y[(popcount(y ^ np.int64(k)) <= RADIUS) & (y != k)].tolist():
            a, b = root(k), root(o)
            if a != b:
                up[max(a, b)] = min(a, b)
                out.append((min(k, o), max(k, o)))
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id of the component) for every row of ``docs(doc_id, text)``."""
    rows = written(fingerprints(docs), "fingerprints")
    distinct = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = checkpoint(links(distinct.select("fp"), distinct.count()))
    groups = connected_components(found)
    of = distinct.join(groups.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpoint(of.join(least, "component").select("fp", "component_id", "n"))
    # fingerprints with over a share of all rows are fewer than SHARE: they go out by broadcast and their rows stay where they are
    total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("n") * SHARE > total
    frequent = F.broadcast(named.where(common).select("fp", "component_id"))
    rest = rows.join(frequent, "fp", "left_anti").join(named.where(~common).select("fp", "component_id"), "fp")
    return rows.join(frequent, "fp").select("doc_id", "fp", "component_id").union(rest.select("doc_id", "fp", "component_id"))


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
