"""Removal of repeated 200-byte strings by suffix arrays (difference cover) over all bytes that can repeat.

A suffix array of every byte would move some twenty times the input between executors. So an exact filter comes first. Each
200-byte window names one anchor: the 40-byte string inside it with the least hash (the leftmost of equals). Equal windows name equal
anchors at equal offsets, so windows meet only under one anchor. The windows that name one anchor occurrence are neighbours;
the bytes they cover are its span.

1. Anchors are counted by key; what no other occurrence shares is unique and done. A bitmap of the shared keys, of bounded size, lets the
   second pass drop the rest at the source; a false hit only costs a row. Of over 2**24 shared keys each further 2**24 take another pass and bitmap.
2. Equal spans under a key are repeats as a whole.
3. The distinct spans of a key whose occurrences differ are compared byte by byte: a difference-cover suffix array (triples at
   positions 1 and 2 mod 3 are sorted and named, the names sorted by recursion, the remaining suffixes merged in), then every window start with its
   neighbour in suffix order. Spans are dealt by key and sorted in pieces of up to ``PIECE`` bytes that hold whole keys. A key with more than ``HOT``
   distinct spans is compared by counts of its windows' 128-bit hashes instead, which spread over all tasks.
4. Each document gets its starts and the bytes they cover go, once, by a join on the text's hashes.

Cases: null texts are empty; texts under 200 bytes lose nothing; equal rows, copies included, are repeats of each other; matches
never cross documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_intdigest

from .common import checkpoint, table, written

WINDOW, GRAM = 200, 40
CHUNK = 1 << 20
PIECE = 1 << 20
HOT = 2000
#: A class with more than one in SHARE rows counts as frequent; there are fewer than SHARE of them at any size.
SHARE = 1000
M64 = (1 << 64) - 1
#: Bounds of the bitmaps: 2**20 to 2**28 bits.
LEAST_BITS, MOST_BITS, PART_BITS = 20, 28, 19


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM) -> Iterator[tuple[int, int, int]]:
    """(anchor, first start, last start) of the windows of the text, in order; long texts go through in chunks."""
    width = window - gram + 1
    for base in range(0, max(len(text) - window + 1, 0), CHUNK):
        part = text[base : base + CHUNK + window - 1]
        x = np.frombuffer(part, np.uint8)
        h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        size, mult = 1, 0x100000001B3
        while size * 2 <= gram:
            h = h[:-size] * np.uint64(mult) + h[size:]
            mult, size = mult * mult & M64, size * 2
        if size < gram:
            h = h[: len(x) - gram + 1] * np.uint64(0xD6E8FEB86659FD93) + h[gram - size : len(x) - size + 1]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        low = np.uint64((1 << 22) - 1)
        h = (h ^ (h >> np.uint64(32))) & ~low | np.arange(len(h), dtype=np.uint64)  # the leftmost of equals is the least
        rows = np.concatenate([h, np.full(-len(h) % width, np.uint64(M64))]).reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(x) - window + 1
        at = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        yield from zip((at[first] + base).tolist(), (first + base).tolist(), (last + base).tolist(), strict=True)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def span_hash(span: bytes, offset: int) -> int:
    return xxh3_64_intdigest(span, offset)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of ``s`` (values from 1 to below 2**21, fewer than 2**21 of them) by the difference cover {1, 2} mod 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate([s, [0, 0, 0, 0]]).astype(np.uint64)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    triples = t[sample] << np.uint64(42) | t[sample + 1] << np.uint64(21) | t[sample + 2]
    known, names = np.unique(triples, return_inverse=True)
    if len(known) < len(sample):
        order = suffix_array(names + 1)
    else:
        order = np.argsort(names, kind="stable")
    rank = np.zeros(n + 4, np.uint64)
    rank[sample[order]] = np.arange(1, len(sample) + 1, dtype=np.uint64)
    rank[n + 1 :] = 0
    ordered = sample[order]
    ordered = ordered[ordered < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] << np.uint64(32) | rank[zero + 1], kind="stable")]
    # the place of a remaining suffix: how many of either class come before it
    pair = lambda i: t[i] << np.uint64(32) | rank[i + 1]
    triple = lambda i: t[i] << np.uint64(43) | t[i + 1] << np.uint64(22) | rank[i + 2]
    firsts, seconds = ordered[ordered % 3 == 1], ordered[ordered % 3 == 2]
    place = np.arange(len(zero)) + np.searchsorted(pair(firsts), pair(zero)) + np.searchsorted(triple(seconds), triple(zero))
    out, rest = np.empty(n, np.int64), np.ones(n, bool)
    out[place], rest[place] = zero, False
    out[rest] = ordered
    return out


def repeated_starts(spans: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each span, the starts of windows that start elsewhere in ``spans``, too."""
    if not spans:
        return []
    begin = np.cumsum([0] + [len(s) + 1 for s in spans])
    text = np.zeros(begin[-1], np.int64)
    for k, s in enumerate(spans):
        text[begin[k] : begin[k] + len(s)] = np.frombuffer(s, np.uint8) + np.int64(1)
        text[begin[k] + len(s)] = 257 + k  # an end of its own, so nothing goes across
    order = suffix_array(text)
    is_start = np.zeros(len(text), bool)
    for k, s in enumerate(spans):
        is_start[begin[k] : begin[k] + max(len(s) - window + 1, 0)] = True
    order = order[is_start[order]]
    plain = np.minimum(text, 257).astype(np.uint16)
    views = np.lib.stride_tricks.sliding_window_view(plain, window)
    same = np.zeros(len(order), bool)
    # ends first: most neighbours that differ do so there
    close = np.ones(max(len(order) - 1, 0), bool)
    for j in (window - 1, window // 2, 0, window // 4):
        close &= plain[order[:-1] + j] == plain[order[1:] + j]
    for i in np.array_split(np.flatnonzero(close), max(1, int(close.sum()) // 65536)):
        eq = (views[order[i]] == views[order[i + 1]]).all(axis=1)
        same[i[eq]] = same[i[eq] + 1] = True
    hit = np.zeros(len(text), bool)
    hit[order[same]] = True
    return [np.flatnonzero(hit[begin[k] : begin[k + 1]]) for k in range(len(spans))]


def _ids(docs: DataFrame) -> DataFrame:
    """The text with two hashes that stand for the row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64("doc_id", text, F.lit(9)).alias("t2"))


def _keys(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for lo in range(0, b.num_rows, 512):
            keys, spans = [], []
            for text in b.column("text").slice(lo, 512).to_pylist():
                raw = text.encode("utf-8", "surrogatepass")
                for p, first, last in anchors(raw):
                    keys.append(xxh3_64_intdigest(raw[p : p + GRAM]))
                    spans.append(span_hash(raw[first : last + WINDOW], p - first))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.array(spans, np.uint64).view(np.int64))], names=["key", "span"])


def bitmap(keys: DataFrame, bits: int) -> np.ndarray:
    """Bits ``key mod 2**bits`` of all keys, as bytes: put together in pieces of 64 KB on the executors."""
    import pandas as pd

    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(F.shiftright(place, PART_BITS).alias("part"), place.bitwiseAND(F.lit((1 << PART_BITS) - 1)).alias("at")).distinct()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << PART_BITS, np.uint8)
        own[pdf["at"].to_numpy()] = 1
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "bits": [np.packbits(own, bitorder="little").tobytes()]})

    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows.groupBy("part").applyInPandas(pack, "part long, bits binary").collect():
        at = r["part"] << (PART_BITS - 3)
        out[at : at + (1 << (PART_BITS - 3))] = np.frombuffer(r["bits"], np.uint8)
    return out


OCCURRENCE = "key long, span long, t1 long, t2 long, packed long, bytes binary"


def _occurrences(it: Iterator[pa.RecordBatch], shared, mixed, bits: int, turn: int = 0, turns: int = 1) -> Iterator[pa.RecordBatch]:
    some, differ, mask, told = shared.value, mixed.value, (1 << bits) - 1, set()
    for b in it:
        for lo in range(0, b.num_rows, 256):
            rows: list[tuple] = []
            part = b.slice(lo, 256)
            for text, t1, t2 in zip(part.column("text").to_pylist(), part.column("t1").to_pylist(), part.column("t2").to_pylist(), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for p, first, last in anchors(raw):
                    key = xxh3_64_intdigest(raw[p : p + GRAM])
                    k = key & mask
                    if turns > 1 and (key >> 32) % turns != turn:
                        continue
                    if some[k >> 3] >> (k & 7) & 1:
                        span = raw[first : last + WINDOW]
                        h, body = span_hash(span, p - first), None
                        if differ[k >> 3] >> (k & 7) & 1 and (key, h) not in told:  # a class's bytes once for each task
                            if len(told) > 500_000:
                                told.clear()
                            told.add((key, h))
                            body = span
                        rows.append((signed(key), signed(h), t1, t2, first << 16 | (p - first) << 8 | (last - first), body))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary())], names=["key", "span", "t1", "t2", "packed", "bytes"])


def _compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key to the (key, span, first, last) runs of repeated starts; pieces hold whole keys."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for (key, span, _), hit in zip(rows, repeated_starts([r[2] for r in rows]), strict=True):
            if len(hit):
                cut = np.flatnonzero(np.diff(hit) > 1)
                for a, z in zip(hit[np.concatenate([[0], cut + 1])].tolist(), hit[np.concatenate([cut, [len(hit) - 1]])].tolist(), strict=True):
                    out.append((key, span, a, z))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "span", "a", "z"])

    rows, held = [], 0
    for b in it:
        for key, span, body in zip(*(b.column(c).to_pylist() for c in ("key", "span", "bytes")), strict=True):
            if held >= PIECE and key != rows[-1][0]:
                yield solve(rows)
                rows, held = [], 0
            rows.append((key, span, body))
            held += len(body) + 1
    if rows:
        yield solve(rows)


def _windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for key, span, body in zip(*(b.column(c).to_pylist() for c in ("key", "span", "bytes")), strict=True):
            n = len(body) - WINDOW + 1
            h = [xxh3_128_intdigest(body[i : i + WINDOW]) for i in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array([span] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([signed(x >> 64) for x in h], pa.int64()), pa.array([signed(x & M64) for x in h], pa.int64())], names=["key", "span", "a", "h1", "h2"])


def repeats(rows: DataFrame, hot: int = HOT, most_keys: int = 1 << (MOST_BITS - 4)) -> DataFrame:
    """(t1, t2, lo, hi): runs of window starts of a row that occur elsewhere, too."""
    spark = rows.sparkSession
    # equal rows are one identity; their windows still count for each of them
    counts = rows.select("text").mapInArrow(_keys, "key long, span long").groupBy("key").agg(F.count("*").alias("n"), F.min("span").alias("lo"), F.max("span").alias("hi"))
    keys = checkpoint(counts.where("n > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed")))
    n = keys.count()
    # a bitmap holds up to a sixteenth of its bits; of more keys, each share by the key's upper half has a pass of its own
    turns = max(1, -(-n // most_keys))
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * -(-n // turns)).bit_length()))
    found = None
    for turn in range(turns):
        own = keys if turns == 1 else keys.where(F.shiftrightunsigned("key", 32) % turns == turn)
        sent = [spark.sparkContext.broadcast(bitmap(k, bits)) for k in (own, own.where("mixed"))]
        some = written(rows.select("text", "t1", "t2").mapInArrow(lambda it, sent=sent, turn=turn: _occurrences(it, sent[0], sent[1], bits, turn, turns), OCCURRENCE), "suffix-occurrences")
        found = some if found is None else found.union(some)
    classes = checkpoint(found.groupBy("key", "span").agg(F.count("*").alias("n")))
    per_key = classes.groupBy("key").agg(F.count("*").alias("spans"))
    mixed = checkpoint(per_key.where("spans > 1"))
    # classes with over a share of all rows are at most SHARE, so they go out by broadcast and their rows need no shuffle
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    common = F.col("n") * SHARE > total
    frequent = F.broadcast(checkpoint(classes.where(common & (F.col("n") > 1)).select("key", "span")))
    rows_only = found.select("key", "span", "t1", "t2", "packed")
    rest = rows_only.join(frequent, ["key", "span"], "left_anti")
    whole = rows_only.join(frequent, ["key", "span"]).union(rest.join(classes.where(~common & (F.col("n") > 1)).select("key", "span"), ["key", "span"]))
    first, length = F.shiftright("packed", 16), F.col("packed").bitwiseAND(F.lit(255))
    out = whole.select("t1", "t2", first.alias("lo"), (first + length).alias("hi"))
    # distinct spans of keys whose occurrences differ
    bodies = found.where("bytes is not null").select("key", "span", "bytes").join(mixed, "key").dropDuplicates(["key", "span"])
    bodies = checkpoint(bodies)
    plain = bodies.where(F.col("spans") <= hot).select("key", "span", "bytes").repartition("key").sortWithinPartitions("key")
    runs = plain.mapInArrow(_compare, "key long, span long, a long, z long")
    large = bodies.where(F.col("spans") > hot)
    if not large.isEmpty():
        windows = checkpoint(large.select("key", "span", "bytes").mapInArrow(_windows, "key long, span long, a long, h1 long, h2 long"))
        twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
        runs = runs.union(windows.join(twice, ["h1", "h2"]).select("key", "span", "a", F.col("a").alias("z")))
    single = rest.join(classes.where("n = 1").select("key", "span").join(mixed.select("key"), "key"), ["key", "span"])
    parts = single.join(runs, ["key", "span"]).select("t1", "t2", (first + F.col("a")).alias("lo"), (first + F.col("z")).alias("hi"))
    return out.union(parts)


def removed_spans(starts: list[tuple[int, int]] | None, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal byte runs covered by windows that begin in the given runs of starts."""
    out: list[list[int]] = []
    for lo, hi in sorted(starts or ()):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + window)
        else:
            out.append([lo, hi + window])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, hot: int = HOT, most_keys: int = 1 << (MOST_BITS - 4)) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes) and spans (removed byte runs) for every row of ``docs(doc_id, text)``."""
    rows = _ids(docs)
    by_row = repeats(rows, hot, most_keys).distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "hi")).alias("starts")).withColumnsRenamed({"t1": "u1", "t2": "u2"})
    joined = rows.join(by_row, (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left").select("doc_id", "text", "starts")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                n, kept, spans = [], [], []
                for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    gone = removed_spans([(s["lo"], s["hi"]) for s in starts] if starts else None)
                    edges = [0, *(x for s in gone for x in s), len(raw)]
                    n.append(len(raw))
                    kept.append(b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
                    spans.append([{"lo": a, "hi": z} for a, z in gone])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))], names=["doc_id", "n_bytes", "kept", "spans"])

    return joined.mapInArrow(cut, f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, kept binary, spans array<struct<lo:long,hi:long>>")


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row for each row of documents."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
