"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The words of a source, its documents put in a keyed random order, form one stream that is cut into
blocks of ``block_words`` words. A source's target fixes exactly how many block draws it gives (whole
epochs, then a permuted part of one epoch whose last block may be cut). A binary tree over the output
shards splits these quotas: at each node the left half gets a multivariate hypergeometric draw of the
draws that are left, so every shard ends with exact counts of each source and the shards together use
each draw once. A shard's draws of a source are a range of the source's permuted block list, so shards
are disjoint; inside a shard the pieces are shuffled by a keyed hash.

Scale: document offsets are found by sums over (source, hash bin) and a window inside a bin, so a source
with a third of all rows is spread over ``BINS`` groups. The tree needs one number for each source;
the number of sources is checked against ``max_sources``. No text is shuffled.

Cases: a null text has size 0 and is taken 0 times; a null source is a source of its own, the last one;
repeated rows count as rows of their own; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint, table

BINS_HEX = 3
#: numpy's sampler takes fewer than 1e9 items; blocks get longer beyond.
MOST_DRAWS = 500_000_000


@dataclass(frozen=True)
class Source:
    name: str | None
    index: int
    size: int
    target: float
    blocks: int
    mult: int
    add: int
    epochs: int
    part: int
    cut: int

    @property
    def draws(self) -> int:
        return self.epochs * self.blocks + self.part


def fill(sizes: list[int], weights: list[int], most: int = 3) -> list[float]:
    """Targets that share all words by weight; a source stops at ``most`` times its size and the excess goes to the rest by weight."""
    total, left = sum(sizes), sum(weights)
    out, room = [0.0] * len(sizes), total
    order = sorted(range(len(sizes)), key=lambda i: most * sizes[i] / weights[i])
    for k, i in enumerate(order):
        if most * sizes[i] / weights[i] >= room / left:
            for j in order[k:]:
                out[j] = room / left * weights[j]
            break
        out[i] = float(most * sizes[i])
        room, left = room - most * sizes[i], left - weights[i]
    return out


def plan(sizes: list[tuple[str | None, int]], cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 1024) -> tuple[list[Source], int]:
    """Quotas of the sources, ordered by code point with null last, and the block length."""
    ordered = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weights = [cycle[i % len(cycle)] for i in range(len(ordered))]
    targets = fill([n for _, n in ordered], weights, most)
    block = max(block_words, -(-sum(n for _, n in ordered) // MOST_DRAWS))
    out = []
    for i, ((name, size), target) in enumerate(zip(ordered, targets, strict=True)):
        want, blocks = round(target), max(1, -(-size // block))
        mult = max(1, blocks * 618 // 1000)
        while gcd(mult, blocks) != 1:
            mult += 1
        add = blocks // 3
        epochs, rest = divmod(want, size) if size else (0, 0)
        # in permuted order every block is whole but the source's last one
        last, last_at = size - (blocks - 1) * block, (blocks - 1 - add) * pow(mult, -1, blocks) % blocks
        before = lambda k: k * block - (block - last) * (k > last_at)  # noqa: B023, E731
        part = rest // block
        while before(part) < rest:
            part += 1
        cut = rest - before(part - 1) if part else 0
        out.append(Source(name, i, size, target, blocks, mult, add, epochs, part, cut))
    return out, block


def shard_quotas(quotas: list[int], n_shards: int, first: int, end: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards ``first`` to ``end``: (shard, where its range of each source's draws begins, how many draws it has)."""
    todo = [(0, n_shards, np.zeros(len(quotas), np.int64), np.array(quotas, np.int64))]
    while todo:
        lo, hi, begin, counts = todo.pop()
        if hi <= first or lo >= end:
            continue
        if hi - lo == 1:
            yield lo, begin, counts
            continue
        mid, total = (lo + hi) // 2, int(counts.sum())
        left_n = total * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, left_n, method="marginals") if total else counts * 0
        todo += [(mid, hi, begin + left, counts - left), (lo, mid, begin, left)]


def positions(docs: DataFrame, seed: int) -> tuple[DataFrame, list[tuple[str | None, int]]]:
    """Each document's place ``[at, at + size)`` in its source's stream of words, and the sources' sizes."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sized = checkpoint(sized.withColumn("h", F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))).withColumn("bin", F.substring("h", 1, BINS_HEX)))
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("n"))
    before = bins.select("source", "bin", (F.sum("n").over(Window.partitionBy("source").orderBy("bin")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("source", "bin").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = sized.withColumn("run", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(before.withColumnsRenamed({"source": "s", "bin": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("b")))
    sizes = [(r["source"], r["n"]) for r in bins.groupBy("source").agg(F.sum("n").alias("n")).collect()]
    return placed.select("doc_id", "source", "size", (F.col("base") + F.col("run")).alias("at")), sizes


def mix(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, block_words: int = 1024, draws_per_shard: int = 4096, seed: int = 17, max_sources: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Mixes ``docs(doc_id, text, source)``.

    Returns (documents, pieces): documents(doc_id, source, size, at, source_size, target) has a row for each
    input row; pieces(shard, place, source, at, doc_id, size, epoch, word_from, word_to) has a row for each run of words
    that a shard takes of a document, ``place`` giving the order inside the shard.
    """
    spark = docs.sparkSession
    placed, sizes = positions(docs, seed)
    if len(sizes) > max_sources:
        raise ValueError(f"{len(sizes)} sources; at most {max_sources} are mixed")
    sources, block = plan(sizes, cycle, most, block_words)
    rows = [(s.name, s.index, s.size, s.target, s.blocks, s.mult, s.add, s.epochs, s.part, s.cut) for s in sources]
    known = spark.createDataFrame(rows, "name string, idx int, source_size long, target double, blocks long, mult long, offset long, epochs long, part long, cut long")
    documents = placed.join(F.broadcast(known.select("name", "idx", "source_size", "target")), F.col("source").eqNullSafe(F.col("name"))).drop("name")

    quotas = [s.draws for s in sources]
    n_shards = max(1, -(-sum(quotas) // draws_per_shard))

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                found = list(shard_quotas(quotas, n_shards, int(pdf["id"].min()), int(pdf["id"].max()) + 1, seed))
                yield pd.DataFrame([(sh, i, int(b[i]), int(b[i] + c[i])) for sh, b, c in found for i in np.flatnonzero(c)], columns=["shard", "idx", "lo", "hi"])

    cut = spark.range(0, n_shards, 1, max(1, min(n_shards // 64, 10_000))).mapInPandas(leaves, "shard long, idx int, lo long, hi long")
    draws = cut.select("shard", "idx", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("k")).join(F.broadcast(known.drop("name", "source_size", "target")), "idx")
    k = F.col("k") % F.col("blocks")
    draws = draws.select("idx", "shard", F.expr("k div blocks").alias("epoch"), ((k * F.col("mult") + F.col("offset")) % F.col("blocks")).alias("block"),
                         F.when(F.col("k") == F.col("epochs") * F.col("blocks") + F.col("part") - 1, F.when(F.col("part") > 0, F.col("cut"))).alias("cut"))
    over = documents.where("size > 0").select("doc_id", "source", "idx", "size", "at", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))
    begin = F.col("block") * block
    pieces = over.join(draws, ["idx", "block"]).select(
        "shard", "source", "doc_id", "size", "at", "epoch",
        F.greatest(F.col("at"), begin).alias("lo"),
        F.least(F.col("at") + F.col("size"), begin + F.coalesce("cut", F.lit(block))).alias("hi"),
    ).where("lo < hi")
    return documents, pieces.select("shard", F.xxhash64("shard", "epoch", "source", "lo", F.lit(seed)).alias("place"), "source", "at", "doc_id", "size", "epoch", (F.col("lo") - F.col("at")).alias("word_from"), (F.col("hi") - F.col("at")).alias("word_to"))


def with_text(docs: DataFrame, documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """A row of ``docs`` (all its columns) for each epoch in which ``pieces`` takes words of it, with ``text`` and ``n_chars`` of what is taken.

    A text taken whole stays as it is; of a cut one the taken words are joined by single spaces. Rows that share doc_id, source and
    size are told apart by their order (texts on one side, places on the other).
    """
    key = F.xxhash64("doc_id", "source", "size")
    runs = pieces.groupBy("source", "at", "doc_id", "size", "epoch").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n"), F.array_sort(F.collect_list(F.struct("word_from", "word_to"))).alias("parts"))
    ranked = documents.where("size > 0").withColumn("k", key).withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("doc_id", "source", "size", "at"))).select("k", "rn", *(F.col(c).alias(f"__{c}") for c in ("source", "at", "doc_id", "size")))
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("at") == F.col("__at")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")) & (F.col("size") == F.col("__size"))
    wanted = runs.join(ranked, same).select(F.col("k").alias("__k"), F.col("rn").alias("__rn"), F.col("n").alias("__n"), F.col("parts").alias("__parts"))
    cols = docs.columns
    sized = docs.withColumn("__n_words", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    keyed = sized.withColumn("__key", F.xxhash64("doc_id", "source", "__n_words")).withColumn("__nth", F.row_number().over(Window.partitionBy("__key").orderBy("doc_id", "source", "__n_words", "text")))
    got = keyed.join(wanted, (F.col("__key") == F.col("__k")) & (F.col("__nth") == F.col("__rn")))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__parts", lambda p: F.slice(words, (p["word_from"] + 1).cast("int"), (p["word_to"] - p["word_from"]).cast("int")))), " ")
    text = F.when(F.col("__n") == F.col("__n_words"), F.col("text")).otherwise(cut)
    return got.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*cols)


def op1_source_mix(spark, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row for each row of documents."""
    documents, pieces = mix(table(spark, sf_dir, "documents"))
    took = pieces.groupBy("source", "at", "doc_id", "size").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n"))
    took = took.withColumnsRenamed({"source": "s", "at": "a", "doc_id": "d", "size": "z"})
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("at") == F.col("a")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    return documents.join(took, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0)).alias("taken"))
