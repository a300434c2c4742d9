"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items.

Items and documents are normalised alike (A-Z lower-cased; a word is a run of digits, a-z and characters
beyond ASCII). Every 13 consecutive words of an item are a pattern; an item of fewer words, but not none,
is one pattern. Each text is scanned once, whole; matches are kept as word spans and as byte offsets of
the original text.

Scale: documents are not shuffled. An automaton takes up to about ``NODE_BYTES`` bytes of memory for each byte of its items (measured: 243 MB for 0.5 MB),
so the items are cut into blocks of ``automaton_bytes / NODE_BYTES`` bytes, each an automaton of its own in a pass of its own, and the spans found for a
document are united afterwards by a row number, so results don't depend on the number of blocks. An item that is longer than a block is a block's only one.

Cases: null and empty texts have no words and are clean; items without words match nothing; items are told apart by
item_id (null is one id); repeated documents are rows of their own; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, table, trimmed

WINDOW = 13
NODE_BYTES, AUTOMATON_BYTES = 500, 256 << 20
#: UTF-8 byte to byte of the normalised text: letters and digits stay, A-Z become small, other ASCII is a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SPANS = "array<struct<word_from:int,word_to:int,byte_from:int,byte_to:int>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def patterns(items: list[tuple[object, str | None]], window: int = WINDOW) -> dict[str, list[int]]:
    """Normalised pattern, a space on both sides, to the places of its items in ``items``."""
    out: dict[str, list[int]] = {}
    for at, (_, text) in enumerate(items):
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1)) if words else ():
            key = " " + b" ".join(words[i : i + window]).decode("utf-8", "surrogatepass") + " "
            held = out.setdefault(key, [])
            if not held or held[-1] != at:
                held.append(at)
    return out


def automaton(of: dict[str, list[int]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, items in of.items():
        a.add_word(key, (key.count(" ") - 1, items))
    if of:
        a.make_automaton()
    return a


def scan(text: str | None, a) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, the merged spans of hit words, and the items found."""
    words = words_of(text)
    if not words or not len(a):
        return len(words), [], set()
    line = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    starts: list[int] = []
    for end, (n, of) in a.iter(line):
        if not starts:  # places of the spaces, only for texts with a match
            at = line.find(" ")
            while at >= 0:
                starts.append(at)
                at = line.find(" ", at + 1)
        last = bisect_right(starts, end) - 1  # the space after the last word
        first = last - n
        while spans and first <= spans[-1][1]:
            first, last = min(first, spans[-1][0]), max(last, spans.pop()[1])
        spans.append((first, last))
        items.update(of)
    return len(words), spans, items


def byte_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets in the original text of the given word spans."""
    folded = text.encode("utf-8", "surrogatepass").translate(FOLD)
    begin = [i for i in range(len(folded)) if folded[i] != 32 and (i == 0 or folded[i - 1] == 32)]
    end = [i + 1 for i in range(len(folded)) if folded[i] != 32 and (i + 1 == len(folded) or folded[i + 1] == 32)]
    return [(begin[a], end[b - 1]) for a, b in spans]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` with n_words, spans (hit words, and their bytes in the original) and item_ids for every row."""
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total * NODE_BYTES // automaton_bytes))
    parts = []
    rows = docs.select(*(c for c in keep if c != "text"), "text")
    rows = rows if blocks == 1 else checkpoint(rows.withColumn("__row", F.monotonically_increasing_id()))
    held = [c for c in rows.columns if c != "text" or c in keep]
    for k in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        own = [(r["item_id"], r["text"]) for r in block.toLocalIterator()]
        sent = docs.sparkSession.sparkContext.broadcast((patterns(own, window), [None if i is None else str(i) for i, _ in own]))
        parts.append(rows.mapInArrow(lambda it, sent=sent, token=uuid.uuid4().hex: trimmed(_scan_batches(it, sent, token, held)), _schema(rows, held)))
    if blocks == 1:
        return parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    merged = out.groupBy("__row").agg(*(F.first(c).alias(c) for c in keep), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("item_ids")).alias("item_ids"))
    return merged.drop("__row").withColumn("item_ids", F.array_sort(F.array_distinct("item_ids"))).withColumn("spans", merge_spans(F.col("spans")))


def merge_spans(spans):
    """Sorted spans, those that meet or overlap made one."""
    grown = lambda acc, x: F.when((F.size(acc) > 0) & (x["word_from"] <= F.element_at(acc, -1)["word_to"]), F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["word_from"].alias("word_from"), F.greatest(F.element_at(acc, -1)["word_to"], x["word_to"]).alias("word_to"), F.element_at(acc, -1)["byte_from"].alias("byte_from"), F.greatest(F.element_at(acc, -1)["byte_to"], x["byte_to"]).alias("byte_to")))
    )).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), grown)


def _schema(rows: DataFrame, held: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in held) + f", n_words bigint, spans {SPANS}, item_ids array<string>"


_ARROW_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("word_from", "word_to", "byte_from", "byte_to")]))
_AUTOMATA: dict[str, tuple] = {}


def _scan_batches(batches: Iterator[pa.RecordBatch], sent, token: str, held: list[str]) -> Iterator[pa.RecordBatch]:
    if token not in _AUTOMATA:  # once for each worker process
        _AUTOMATA.clear()
        of, ids = sent.value
        _AUTOMATA[token] = (automaton(of), ids)
    a, ids = _AUTOMATA[token]
    for batch in batches:
        n_words, spans, found = [], [], []
        for text in batch.column("text").to_pylist():
            n, words, items = scan(text, a)
            n_words.append(n)
            spans.append([{"word_from": w[0], "word_to": w[1], "byte_from": b[0], "byte_to": b[1]} for w, b in zip(words, byte_spans(text, words), strict=True)] if words else [])
            found.append(sorted({ids[i] for i in items if ids[i] is not None}) + [None] * any(ids[i] is None for i in items))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in held), pa.array(n_words, pa.int64()), pa.array(spans, _ARROW_SPANS), pa.array(found, pa.list_(pa.string()))], names=[*held, "n_words", "spans", "item_ids"])


def n_hit(spans="spans"):
    return F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda acc, x: acc + x["word_to"] - x["word_from"]), F.lit(0))


def contaminated():
    """The contract's rule: at least a twentieth of the words are hit."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row for each row of documents."""
    found = find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    known = F.array_sort(F.array_compact("item_ids"))
    return found.withColumn("n_hit", n_hit()).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join(known, ",").cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(list_slice(w, i, i + 12)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS k
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
