"""Token ids as ORC files in document order, with integer run-length encoding, row indexes and Bloom filters on doc_id.

A row is a document: doc_id, ids (its token ids, the end id last), n_tokens (their number), part (number of the file's range in the
order) and local_start (ids before it in that range). Integer columns are run-length encoded by ORC; each
stripe has row indexes (least and greatest doc_id of every ``ROW_INDEX`` rows) and a Bloom filter on doc_id,
so a look-up reads a few row groups and a scan deals stripes out to tasks. A document's place in the whole
stream is the sum of the ranges before it plus local_start: no window over all rows is needed.

Scale: one range exchange by doc_id carries the texts; tokenising runs inside the sorted ranges, in Arrow
batches of up to ``BATCH_BYTES``, with a cache of twice ``CACHE_WORDS`` pieces. The tokenizer drops white space, and no rule
of it looks across a space, so texts are cut at spaces and each distinct word of a batch is encoded once.

Cases: null and empty texts hold the end id alone; null doc_ids come first; rows that share a doc_id are kept,
in the order of their texts; an empty table writes no rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release_memory, shared_dir, table, trimmed

END_ID = 1
CACHE_WORDS = 200_000
ROW_INDEX = 1000
STRIPE_BYTES = 16 << 20
#: Bytes of text that are encoded at once.
BATCH_BYTES = 6 << 20
SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words whose normal form and cuts are found here, not by the tokenizer's normaliser: visible Latin-1 only, which is in NFC.
PLAIN = re.compile("[!-~\u00a1-\u00ff]+")
#: The tokenizer file's own rule for cutting words, over lower-cased text.
CUTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

#: Visible ASCII signs, a run of which after a word's letters is a piece of its own; and the small letters of Latin-1.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
SMALL = "".join(chr(c) for c in range(97, 256) if chr(c).isalpha() and chr(c) == chr(c).lower())


def byte_letters() -> list[str]:
    """Byte to the letter that byte-level vocabularies write for it: visible Latin-1 as it is, the others in order from U+0100."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Cache(dict):
    """A dict of two generations: when the young one has ``most`` entries it becomes the old one, whose entries come back as they are used."""

    def __init__(self, most: int, make):
        super().__init__()
        self.most, self.make, self.old = most, make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def gathered(flat: np.ndarray, start: np.ndarray, n: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``pick`` of ``flat`` one after another, run i being the n[i] entries from start[i] on; and their lengths."""
    n, start = n[pick], start[pick]
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - n), n)], n


class WordIds:
    """Token ids of texts. ``path``: a tokenizer file with the rules named above.

    Texts are cut at spaces and each distinct word of a batch is looked at once. A word in plain Latin-1 is lower-cased and cut here
    and its pieces go to the library's BPE model; any other, and any that could hold a special token, goes through the library's
    whole chain. Ids are put together by offsets, so nothing is done in Python for each occurrence of a word.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.pieces = Cache(cache_words, self.piece)

    def piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self.letters[b] for b in piece.encode()])
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def word(self, word: str) -> bytes:
        if PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self.pieces[p] for p in CUTS.findall(word.lower())])
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def units(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Ids of units, and for each of the distinct ``words`` the numbers of its two units; unit 0 is empty."""
        plain = pc.and_(pc.match_substring_regex(words, f"^{PLAIN.pattern}$"), pc.invert(pc.match_substring(words, "<|")))
        lower = pc.utf8_lower(words)
        stem, tail = pc.utf8_rtrim(lower, SIGNS), pc.utf8_ltrim(lower, SMALL)
        # letters, then signs or nothing: both together are the word
        fits = pc.and_(plain, pc.and_(pc.utf8_is_alpha(stem), pc.equal(pc.add(pc.utf8_length(stem), pc.utf8_length(tail)), pc.utf8_length(lower))))
        none = pa.scalar(None, words.type)
        stems, tails = (pc.if_else(fits, x, none).dictionary_encode() for x in (stem, tail))
        known, signs = stems.dictionary.to_pylist(), tails.dictionary.to_pylist()
        other = pc.invert(fits).to_numpy(zero_copy_only=False)
        rest = words.filter(pa.array(other)).to_pylist()
        one, two = (pc.fill_null(x.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1 for x in (stems, tails))
        one[other] = 1 + len(known) + np.arange(len(rest))
        two[two > 0] += len(known) + len(rest)
        return [b"", *map(self.pieces.__getitem__, known), *map(self.word, rest), *(self.pieces[t] if t else b"" for t in signs)], np.stack([one, two], axis=1)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (null: empty), one text after another, and the number of ids of each."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        units, pairs = self.units(coded.dictionary)
        size = np.fromiter(map(len, units), np.int64, len(units)) // 4
        flat, n = gathered(np.frombuffer(b"".join(units), "<u4"), np.cumsum(size) - size, size, pairs.ravel())
        n = n.reshape(-1, 2).sum(axis=1)
        ids, n = gathered(flat, np.cumsum(n) - n, n, coded.indices.to_numpy())
        before = np.concatenate([[0], np.cumsum(n)])
        places = split.offsets.to_numpy()
        return ids, np.diff(before[places - places[0]])


_ENCODERS: dict[str, WordIds] = {}


def cuts(texts: pa.Array, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``most`` bytes of text, or one longer text."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > lo and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if len(size):
        yield lo, len(size)


def encode_batches(batches: Iterator[pa.RecordBatch], path: str, end_id: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    encode, part, start = _ENCODERS[path], TaskContext.get().partitionId(), 0
    for whole in batches:
        for lo, hi in cuts(whole.column("text")):
            batch = whole.slice(lo, hi - lo)
            ids, n = encode(batch.column("text"))
            places = np.concatenate([[0], np.cumsum(n + 1)])
            ids = np.insert(ids, np.cumsum(n), end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(n), part, np.int32)), pa.array(start + places[:-1]), pa.array((n + 1).astype(np.int64)), pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids.view("<i4")))], names=["doc_id", "part", "local_start", "n_tokens", "ids"]
            )
            start += int(places[-1])
            release_memory()


def write(docs: DataFrame, at: str, tokenizer: str | None = None, end_id: int = END_ID, bloom_fpp: float = 0.01) -> str:
    """Writes ``docs(doc_id, text)`` to the folder ``at``, files and rows in ascending doc_id order."""
    path = tokenizer or default_tokenizer()
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(lambda it: trimmed(encode_batches(it, path, end_id)), SCHEMA)
    rows.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", str(bloom_fpp)).option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX)).option("orc.stripe.size", str(STRIPE_BYTES)).orc(at)
    return at


def read(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(SCHEMA).orc(at)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        flat, off = ids.values.to_numpy().view("<u4"), ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("local_start"), pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])


def index(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files. The table of ranges has a row for each written partition; ids are read once."""
    rows = files.select("doc_id", "part", "local_start", "ids").mapInArrow(lambda it: trimmed(_sums(it)), "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    ends = files.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    base = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: one row for each row of documents, read back from the files."""
    at = write(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}")
    return index(read(spark, at))
