"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors of a label are one node with a multiplicity. Nodes of a label are dealt to overlapping cluster
shards (each node goes to its ``overlap`` nearest pivots; shards above ``SHARD`` nodes are split again, level by
level). Each shard builds a graph: its nearest candidates, robust-pruned, with reverse edges. The adjacency lists
of a node's shards are united. Then every node is a query: from the shard's medoid a greedy walk makes ``HOPS``
expansions and goes on while it finds nodes in range, and what it finds is verified in double precision. Shards give
counts and a spanning forest, not pairs; a pair that shares several shards counts in the least of them.
Shards that no pivots split (many nearly equal vectors) are compared exactly, as blocks against blocks; a pair that shares
such shards counts in the least of these, as nothing is missed there.

``audit`` compares the links of vectors whose id is divisible by 50 (a bounded sample of them) with brute force against all rows; below
``TARGET`` recall the build is repeated with more overlap. More links than there are, or a recall below ``LEAST`` at the last build, is an error.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label or vec_id,
link with nothing; vectors of different lengths never link; repeated rows are vectors of their own; empty in, empty out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, connected_components, table, written

COSINE = 0.98
SHARD = 600
FANOUT = 32
#: Cosine above which two pivots count as one.
APART = 0.9
LEVELS = 5
DEGREE = 32
CANDIDATES = 64
NEAREST = 6
ALPHA = 1.2
HOPS = 24
BLOCK = 1024
#: Rows that are dealt out as one.
CHUNK = 1024
#: Bounds of the audit's queries.
AUDITED, AUDIT_BYTES = 20_000, 32 << 20
TARGET = 0.98
LEAST = 0.9


def unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def robust_prune(x: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> list[np.ndarray]:
    """Neighbours of each row of the unit vectors ``x``: nearest first, one is left out if a chosen one is ``alpha`` times nearer to it. The NEAREST always stay; edges go both ways."""
    n = len(x)
    out: list[list[int]] = [[] for _ in range(n)]
    k = min(CANDIDATES, n - 1)
    if k < 1:
        return [np.zeros(0, np.int64) for _ in range(n)]
    for lo in range(0, n, BLOCK):
        sim = x[lo : lo + BLOCK] @ x.T
        sim[np.arange(len(sim)), np.arange(lo, lo + len(sim))] = -np.inf
        near = np.argpartition(-sim, k - 1, axis=1)[:, :k]
        for r, cand in enumerate(near):
            cand = cand[np.argsort(-sim[r, cand], kind="stable")]
            d, between = 1 - sim[r, cand], 1 - x[cand] @ x[cand].T
            alive = np.ones(k, bool)
            for c in range(k):
                if alive[c] or c < NEAREST:
                    out[lo + r].append(int(cand[c]))
                    if len(out[lo + r]) == degree:
                        break
                    alive &= alpha * between[c] > d
    both: list[set[int]] = [set(o) for o in out]
    for i, o in enumerate(out):
        for j in o:
            both[j].add(i)
    kept = []
    for i, b in enumerate(both):  # a node that many chose keeps its own edges and a pruned part of theirs
        near = np.array(sorted(b))
        if len(near) > 2 * degree:
            own = set(out[i])
            rest = np.array([j for j in near.tolist() if j not in own])
            sim = x[rest] @ x[i]
            rest = rest[np.argsort(-sim, kind="stable")]
            alive, d, chosen = np.ones(len(rest), bool), 1 - np.sort(sim)[::-1], []
            while alive.any() and len(chosen) < 2 * degree - len(own):
                c = int(alive.argmax())
                chosen.append(int(rest[c]))
                alive &= alpha * (1 - x[rest] @ x[rest[c]]) > d
                alive[c] = False
            near = np.array(sorted(own | set(chosen)))
        kept.append(near)
    return kept


def range_search(x: np.ndarray, adjacency: list[np.ndarray], hops: int = HOPS, least: float = COSINE) -> np.ndarray:
    """Boolean matrix of the pairs found: a walk for each row of ``x`` from the medoid, on while nodes in range are unexpanded."""
    n = len(x)
    width = max((len(a) for a in adjacency), default=0)
    if n < 2 or not width:
        return np.zeros((n, n), bool)
    padded = np.array([np.concatenate([a, np.full(width - len(a), i)]) for i, a in enumerate(adjacency)], np.int64)
    small = x.astype(np.float32)
    medoid = int(np.argmax(small @ small.mean(axis=0)))
    seen = np.full((n, n), -np.inf, np.float32)
    seen[:, medoid] = small @ small[medoid]
    seen[np.arange(n), np.arange(n)] = -np.inf
    open_ = seen.copy()  # sims of what was seen and not expanded
    active, step, loose = np.arange(n), 0, least - 1e-3
    while len(active):
        best = open_[active].argmax(axis=1)
        top = open_[active, best]
        go = top >= loose if step >= hops else top > -np.inf
        active, best = active[go], best[go]
        if not len(active):
            break
        open_[active, best] = -np.inf
        cand = padded[best]
        q, r = np.nonzero((seen[active[:, None], cand] == -np.inf) & (cand != active[:, None]))
        i, j = active[q], cand[q, r]
        seen[i, j] = open_[i, j] = np.einsum("id,id->i", small[i], small[j])
        step += 1
    found = np.zeros((n, n), bool)
    q, c = np.nonzero(seen >= loose)
    if len(q):
        ok = np.einsum("id,id->i", x[q], x[c]) >= least
        found[q[ok], c[ok]] = True
    return found | found.T


def forest(found: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links, by breadth-first search over the matrix."""
    left, out = np.ones(len(found), bool), []
    for s in range(len(found)):
        if left[s]:
            left[s] = False
            todo = [s]
            while todo:
                i = todo.pop()
                new = np.flatnonzero(found[i] & left)
                left[new] = False
                out += [(int(ids[i]), int(ids[j])) for j in new]
                todo += new.tolist()
    return out


def _result(ids, counts, edges) -> pd.DataFrame:
    rows = [(int(i), None, int(c)) for i, c in zip(ids, counts, strict=True) if c] + [(a, b, 0) for a, b in edges]
    return pd.DataFrame({"u": pd.array([r[0] for r in rows], "Int64"), "v": pd.array([r[1] for r in rows], "Int64"), "n": pd.array([r[2] for r in rows], "Int64")})


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    ids = pdf["node"].to_numpy()
    lists = robust_prune(unit(pdf["embedding"]))
    return pd.DataFrame({"node": ids, "near": [ids[a].tolist() for a in lists]})


NONE = np.iinfo(np.int64).max


def least_common(left, q: np.ndarray, right, c: np.ndarray) -> np.ndarray:
    """Least shard in both the list ``left[q]`` and ``right[c]`` of each pair; NONE if there is none."""

    def square(lists, pad: int) -> np.ndarray:
        width = max(map(len, lists), default=0)
        return np.array([[*s, *[pad] * (width - len(s))] for s in lists], np.int64).reshape(len(lists), width)

    a, b = square(left, NONE), square(right, NONE)
    common = np.full(len(q), NONE)
    for i in range(a.shape[1]):
        for j in range(b.shape[1]):
            x = a[q, i]
            common = np.where(x == b[c, j], np.minimum(common, x), common)
    return common


def _search(pdf: pd.DataFrame) -> pd.DataFrame:
    ids, own = pdf["node"].to_numpy(), int(pdf["shard"].iloc[0])
    place = {int(v): i for i, v in enumerate(ids)}
    found = range_search(unit(pdf["embedding"]), [np.array(sorted({place[j] for j in near if j in place and place[j] != i}), np.int64) for i, near in enumerate(pdf["near"])])
    q, c = np.nonzero(found)
    if not len(q):
        return _result([], [], [])
    here = pdf["shards"].tolist()
    common = least_common(here, q, here, c)
    large = pdf["huge"].tolist()
    common[least_common(large, q, large, c) < NONE] = NONE  # counted where they were compared exactly
    mine = common == own
    counts = np.bincount(q[mine], pdf["copies"].to_numpy()[c[mine]], minlength=len(ids)).astype(np.int64)
    return _result(ids, counts, forest(found, ids))


def nodes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows(vec_id, key), nodes(node, label, dim, embedding, copies)): rows whose key is null link with nothing."""
    e = F.col("embedding")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~bad & F.exists(e, lambda x: x != 0)
    key = F.when(F.coalesce(fine, F.lit(False)), F.md5(F.concat_ws(":", F.col("label").cast("string"), F.array_join(e.cast("array<string>"), ",")).cast("binary")))
    keyed = vectors.select(F.col("vec_id").cast("long"), "label", "embedding", key.alias("key"))
    nodes = keyed.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    return keyed.select("vec_id", "key"), nodes.select("key", "node", "label", F.size("embedding").alias("dim"), "embedding", "copies")


def spread(pivots: np.ndarray) -> np.ndarray:
    """Pivots, in order, without those near an earlier one, so a dense group is not cut up by pivots of its own."""
    kept: list[int] = []
    for i in range(len(pivots)):
        if len(kept) < FANOUT and (not kept or (pivots[kept] @ pivots[i]).max() < APART):
            kept.append(i)
    return pivots[kept]


def _deal(it: Iterator[pa.RecordBatch], overlap: int) -> Iterator[pa.RecordBatch]:
    """Each vector of a chunk to its ``overlap`` nearest pivots."""
    for b in it:
        for i in range(b.num_rows):
            shard, rows, pivots = b.column("shard")[i].as_py(), b.column("rows")[i].values, b.column("pivots")[i].values
            own = rows.field("embedding")
            x = unit(own.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
            order = np.argsort(-(x @ spread(unit(pivots.flatten().to_numpy(zero_copy_only=False).reshape(len(pivots), -1))).T), axis=1, kind="stable")[:, :overlap]
            k = order.shape[1]
            at = pa.array(np.repeat(np.arange(len(rows)), k))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows) * k, shard)), pa.array(order.ravel().astype(np.int32)), rows.field("node").take(at), own.take(at), rows.field("copies").take(at)], names=["parent", "k", "node", "embedding", "copies"])


def shards_of(nodes: DataFrame, overlap: int, shard: int = SHARD) -> DataFrame:
    """(shard, node, label, embedding, copies): each node in its ``overlap`` nearest shards at every level."""
    now = nodes.select(F.xxhash64("label", "dim").alias("shard"), "node", "embedding", "copies")
    done = None
    for level in range(LEVELS):
        now = checkpoint(now)
        sizes = checkpoint(now.groupBy("shard").agg(F.count("*").alias("size")))
        large = sizes.where(F.col("size") > shard)
        ready = now.join(large.select("shard"), "shard", "left_anti")
        done = ready if done is None else done.union(ready)
        if large.isEmpty():
            return done
        # pivots: about as many as shards are wanted, by a hash, FANOUT at most
        want = F.least(F.lit(FANOUT), F.ceil(F.col("size") / shard * overlap * 1.5).cast("int"))
        lot = F.pmod(F.xxhash64("node", F.lit(level)), F.lit(1 << 30)) / float(1 << 30)
        of_large = now.join(large, "shard")
        chosen = of_large.where(lot < want * 2 / F.col("size")).groupBy("shard", "size").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("node", F.lit(level)).alias("h"), "embedding"))), 1, 2 * FANOUT).alias("p"))
        pivots = checkpoint(chosen.select("shard", F.col("p.embedding").alias("pivots"), F.ceil(F.col("size") / CHUNK).cast("int").alias("chunks")).where(F.size("pivots") > 1))
        # rows go out in chunks of about CHUNK, each with its shard's pivots once
        rows = now.join(pivots.select("shard", "chunks"), "shard").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(-level - 1)), F.col("chunks")).cast("int"))
        chunks = rows.groupBy("shard", "chunk").agg(F.collect_list(F.struct("node", "embedding", "copies")).alias("rows"))
        each = pivots.select("shard", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "pivots")
        kind = dict(nodes.dtypes)["embedding"]
        split = chunks.join(each, ["shard", "chunk"]).select("shard", "rows", "pivots").mapInArrow(lambda it: _deal(it, overlap), f"parent long, k int, node long, embedding {kind}, copies long")
        unsplit = now.join(large.select("shard"), "shard", "left_semi").join(pivots.select("shard"), "shard", "left_anti")
        now = split.select(F.xxhash64("parent", "k", F.lit(level)).alias("shard"), "node", "embedding", "copies").union(unsplit.select("shard", "node", "embedding", "copies"))
    return done.union(checkpoint(now))


def _exact(pdf: pd.DataFrame) -> pd.DataFrame:
    """Blocks of an unsplittable shard: side 0 against side 1, a pair of blocks once."""
    a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
    x, y, i, j = unit(a["embedding"]), unit(b["embedding"]), a["node"].to_numpy(), b["node"].to_numpy()
    hit = (x @ y.T >= COSINE) & (i[:, None] != j[None, :])
    q, c = np.nonzero(hit)
    mine = least_common(a["huge"].tolist(), q, b["huge"].tolist(), c) == int(pdf["shard"].iloc[0])
    counts = np.bincount(q[mine], b["copies"].to_numpy()[c[mine]], minlength=len(i)).astype(np.int64)
    n = len(i)
    whole = np.zeros((n + len(j), n + len(j)), bool)
    whole[:n, n:], whole[n:, :n] = hit, hit.T
    return _result(i, counts, forest(whole, np.concatenate([i, j])))


def links_of(nodes: DataFrame, overlap: int) -> DataFrame:
    """(u, v, n): a link of a spanning forest, or (v null) n more linked vectors of u."""
    dealt = written(shards_of(nodes, overlap), "embedding-shards")
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("size"))
    # nodes of a shard too large to be one group are compared exactly over the whole label
    huge = checkpoint(sizes.where(F.col("size") > 4 * SHARD))
    of = dealt.join(huge.select("shard", F.col("shard").alias("h")), "shard", "left").groupBy("node").agg(F.collect_set("shard").alias("shards"), F.collect_set("h").alias("huge"))
    plain = dealt.join(huge.select("shard"), "shard", "left_anti")
    kind = dict(nodes.dtypes)["embedding"]
    graph = plain.select("shard", "node", "embedding").groupBy("shard").applyInPandas(_build, "node long, near array<long>")
    united = graph.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    ready = plain.join(united, "node").join(of, "node").select("shard", "node", "embedding", "copies", "near", "shards", "huge")
    found = ready.groupBy("shard").applyInPandas(_search, "u long, v long, n long")
    if huge.isEmpty():
        return found
    rows = dealt.join(huge, "shard").join(of, "node").select("shard", "node", "embedding", "copies", "huge", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = rows.select("shard", "node", "embedding", "copies", "huge", F.col("b").alias("i"), every.alias("j"), F.lit(0).alias("side"))
    two = rows.select("shard", "node", "embedding", "copies", "huge", every.alias("i"), F.col("b").alias("j"), F.lit(1).alias("side"))
    exact = one.union(two).groupBy("shard", "i", "j").applyInPandas(lambda p: _exact(p) if p["side"].nunique() == 2 else _result([], [], []), "u long, v long, n long")
    return found.union(exact)


def audit(nodes: DataFrame, counts: DataFrame, every: int = 50) -> float:
    """Share of the true links, by brute force against all nodes, that ``counts(node, n)`` holds for the nodes with an id divisible by ``every``.

    Of more such nodes than AUDITED, or than AUDIT_BYTES hold, those with the least hashes are asked: they are broadcast, and every batch of nodes
    is multiplied with them where it lies. A node with more links than true ones is an error.
    """
    found = nodes.where(F.col("node") % every == 0)
    dims = found.agg(F.max("dim")).first()[0]
    if dims is None:
        return 1.0
    asked = found.withColumn("h", F.xxhash64("node")).orderBy("h").limit(max(1, min(AUDITED, AUDIT_BYTES // (8 * dims)))).select("label", "dim", "node", "embedding").collect()
    by: dict[tuple, list[tuple[int, list[float]]]] = {}
    for r in asked:
        by.setdefault((r["label"], r["dim"]), []).append((r["node"], r["embedding"]))
    sent = nodes.sparkSession.sparkContext.broadcast({k: (np.array([n for n, _ in v]), unit([e for _, e in v])) for k, v in by.items()})

    def true(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums = sent.value, {}
        for pdf in it:
            for key, own in pdf.groupby(["label", "dim"], sort=False):
                ids, x = known.get(key, (None, None))
                if ids is None:
                    continue
                t, most = sums.setdefault(key, (np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)))
                for lo in range(0, len(own), BLOCK):
                    some = own.iloc[lo : lo + BLOCK]
                    sim, w = x @ unit(some["embedding"]).T, some["copies"].to_numpy()
                    other = ids[:, None] != some["node"].to_numpy()[None, :]
                    t += ((sim >= COSINE) & other) @ w
                    most += ((sim >= COSINE - 1e-9) & other) @ w  # with those that rounding may let in
        for key, (t, most) in sums.items():
            yield pd.DataFrame({"node": known[key][0], "t": t, "most": most})

    truth = nodes.select("label", "dim", "node", "embedding", "copies").mapInPandas(true, "node long, t long, most long").groupBy("node").agg(F.sum("t").alias("t"), F.sum("most").alias("most"))
    n = F.coalesce("n", F.lit(0))
    t, n, over = truth.join(counts, "node", "left").agg(F.sum("t"), F.sum(F.least(n, F.col("t"))), F.count(F.when(n > F.col("most"), 1))).first()
    if over:
        raise RuntimeError(f"{over} nodes with more links than there are")
    return 1.0 if not t else n / t


def near_duplicates(vectors: DataFrame, overlap: int = 2, target: float = TARGET) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``."""
    rows, nodes = nodes_of(vectors)
    rows, nodes = checkpoint(rows), checkpoint(nodes)
    for more in range(overlap, overlap + 3):
        found = checkpoint(links_of(nodes, more))
        counts = found.where("v is null").groupBy("u").agg(F.sum("n").alias("n")).withColumnRenamed("u", "node")
        recall = audit(nodes, counts)
        if recall >= target:
            break
    else:
        if recall < min(LEAST, target):
            raise RuntimeError(f"recall {recall:.3f} at the last build")
    groups = connected_components(found.where("v is not null").select("u", "v"))
    named = nodes.select("key", "node", "copies").join(counts, "node", "left").join(groups, "node", "left").select("key", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    return rows.join(named, "key", "left").select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embedding_neardup(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
