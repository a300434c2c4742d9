"""The training-data operators against brute force, exact round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimgrid.llm import decontamination, embeddings, html_text, language, mixing, pii, quality, simhash, suffix_dedup, token_files
from claimgrid.llm.common import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


def prose(rng, n, alphabet=("tha", "ore", "in", "el", "as", "ti")):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4))) for _ in range(n))


EDGE = [(1, None, None, None), (2, "", "en", "a"), (3, "x" * 30_000, "en", "a"), (4, "the cat sat", None, "b"), (4, "the cat sat", None, "b"), (None, "the dog", "en", None)]


def found(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.fixture(scope="module")
def edge(spark):
    # columns that clash with names the operators use
    return docs(spark, EDGE).withColumn("size", F.lit("x")).withColumn("component_id", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("key", F.lit(3)).withColumn("target", F.lit(4)).withColumn("score", F.lit(5))


# 1


def test_fill_shares_and_caps():
    assert mixing.fill([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    out = mixing.fill([10, 1000, 1000], [3, 2, 1])
    assert out[0] == 30 and abs(sum(out) - 2010) < 1e-9 and out[1] == 2 * out[2]
    assert mixing.fill([0, 5], [1, 2]) == [0.0, 5.0]


@pytest.mark.parametrize("block", [1, 7, 64])
def test_mix_takes_exact_targets(spark, block):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(0, 60)), "en", rng.choice(["a", "b", "c", None])) for i in range(80)] + [(500, prose(rng, 700), "en", "tiny"), (501, "one two", "en", "z")]
    d = docs(spark, rows)
    documents, pieces = mixing.mix(d, block_words=block, draws_per_shard=16)
    got = {(r["source"]): r["n"] for r in pieces.groupBy("source").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n")).collect()}
    for r in documents.select("source", "target").distinct().collect():
        assert abs(got.get(r["source"], 0) - r["target"]) <= 1
    per = pieces.groupBy("doc_id", "size").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("n")).collect()
    assert all(r["n"] <= 3 * r["size"] for r in per)
    texts = mixing.with_text(d, documents, pieces)
    assert sum(len(WORD.findall(r["text"])) for r in texts.collect()) == sum(got.values())


def test_shards_get_exact_disjoint_quotas():
    quotas = [17, 0, 230, 5]
    leaves = list(mixing.shard_quotas(quotas, 13, 0, 13, 3))
    for i, q in enumerate(quotas):
        ranges = sorted((int(b[i]), int(b[i] + c[i])) for _, b, c in leaves if c[i])
        assert [x for a, z in ranges for x in range(a, z)] == list(range(q))
    assert max(int(c.sum()) for _, _, c in leaves) - min(int(c.sum()) for _, _, c in leaves) <= 1
    assert [int(c.sum()) for _, _, c in mixing.shard_quotas(quotas, 13, 4, 7, 3)] == [int(c.sum()) for s, _, c in sorted(leaves, key=lambda x: x[0]) if 4 <= s < 7]


def test_mix_edges(spark, edge):
    documents, pieces = mixing.mix(edge)
    assert documents.count() == len(EDGE) and pieces.count() > 0
    documents, pieces = mixing.mix(edge.limit(0))
    assert documents.count() == 0 and pieces.count() == 0


# 2


def fp_plain(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_plain(fps):
    up = list(range(len(fps)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


@pytest.mark.parametrize(("pairs", "block"), [(4096, 1024), (16, 8)])
def test_simhash_is_brute_force(spark, monkeypatch, pairs, block):
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(2)
    base = prose(rng, 60).split()
    texts = [prose(rng, rng.randint(0, 40)) for _ in range(60)]
    for _ in range(80):  # near copies of one text
        w = list(base)
        w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    texts += texts[:20] + ["", None, "  \n"]
    d = docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    fps = [fp_plain(t) for t in texts]
    want = groups_plain(fps)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(d).collect()}
    assert [got[i]["fp"] % (1 << 64) for i in range(len(texts))] == fps
    assert [got[i]["component_id"] for i in range(len(texts))] == want


def test_thresholds_always_add_up():
    rng = np.random.default_rng(0)
    fp = rng.integers(-(1 << 63), 1 << 63, 500, dtype=np.int64)
    for widths in ([16] * 4, [22, 21, 21], [32, 32]):
        parts, at = [], 0
        for w in widths:
            parts.append(list(range(at, at + w)))
            at += w
        pieces = simhash.pieces_of(parts)
        tables = [[simhash.near_counts(np.bincount(simhash.gather(fp, b), minlength=1 << len(b)).astype(float), 3) for b in own] for own in pieces]
        t = simhash.thresholds(fp, pieces, tables, len(fp))
        assert (t.sum(axis=0) == 3 - len(widths) + 1).all() and (t >= -1).all()


def test_simhash_edges(spark, edge):
    assert simhash.near_duplicates(edge).count() == len(EDGE)
    assert simhash.near_duplicates(edge.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = dict(found(connected_components(e), "node", "component"))
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


# 3


def test_token_files_round_trip(spark, edge, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(token_files.default_tokenizer())
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("abÉß½'s .,!日́<|>09\n\t") for _ in range(rng.randint(0, 60))), None, None) for i in range(200)] + [(201, "x <|endoftext|>", None, None), (202, None, None, None)]
    at = token_files.write(docs(spark, rows), f"{tmp_path}/ids")
    got = {r["doc_id"]: r for r in token_files.index(token_files.read(spark, at)).collect()}
    start = 0
    for i, t, *_ in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert token_files.index(token_files.read(spark, token_files.write(edge, f"{tmp_path}/edge"))).count() == len(EDGE)
    empty = token_files.write(edge.limit(0), f"{tmp_path}/none")
    assert token_files.index(token_files.read(spark, empty)).count() == 0


def test_token_files_hold_indexes_and_prune(spark, tmp_path):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("the cat"), F.col("id").cast("string")).alias("text"))
    at = token_files.write(rows, f"{tmp_path}/ids")
    orc, conf = spark._jvm.org.apache.orc, spark._jsc.hadoopConfiguration()
    for name in spark.read.format("binaryFile").load(at).select("path").collect():
        reader = orc.OrcFile.createReader(spark._jvm.org.apache.hadoop.fs.Path(name[0]), orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == token_files.ROW_INDEX and str(reader.getCompressionKind()) == "ZSTD"
        if reader.getNumberOfRows():
            every = spark.sparkContext._gateway.new_array(spark._jvm.boolean, 7)
            for k in range(7):
                every[k] = True
            found = reader.rows().readRowIndex(0, every, every)
            assert found.getRowGroupIndex()[1].getEntryCount() == -(-min(reader.getNumberOfRows(), reader.getStripes()[0].getNumberOfRows()) // token_files.ROW_INDEX)
            assert found.getBloomFilterIndex()[1].getBloomFilterCount() > 0 and found.getBloomFilterIndex()[2] is None
    # a look-up reads row groups, not the table
    one = token_files.read(spark, at).where("doc_id = 12345").select("doc_id", "n_tokens")
    assert "EqualTo(doc_id,12345)" in one._jdf.queryExecution().toString() and one.count() == 1
    plan = token_files.read(spark, at).where("doc_id = 12345")._jdf.queryExecution().executedPlan()
    plan.execute().count()
    while not plan.metrics().contains("numFiles"):
        plan = plan.children().head()
    assert 0 < plan.metrics().apply("numOutputRows").value() <= 2 * token_files.ROW_INDEX


def test_token_batches_are_cut_by_bytes():
    import pyarrow as pa

    texts = pa.array(["a" * 10, None, "b" * 30, "", "c" * 5, "d" * 5])
    assert list(token_files.cuts(texts, 12)) == [(0, 2), (2, 3), (3, 6)] and list(token_files.cuts(texts.slice(0, 0))) == []


# 4


@pytest.mark.parametrize("automaton_bytes", [256 << 20, 20_000])
def test_decontamination_is_brute_force(spark, automaton_bytes):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(8)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 2, 14, 20]))) for i in range(12)] + [(90, None), (91, "!!")]
    rows = [(i, line(rng.randint(0, 30)).replace(" ", "-! "), None, None) for i in range(40)] + [(50, items[3][1].upper() + " Ä " + (items[5][1] or ""), None, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontamination.find(docs(spark, rows), bench, automaton_bytes=automaton_bytes).collect()}
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    for i, t, *_ in rows:
        w, hit, its = norm(t), set(), set()
        for k, q in items:
            v = norm(q)
            for win in [v[a : a + 13] for a in range(max(1, len(v) - 12))] if v else []:
                for a in range(len(w) - len(win) + 1):
                    if w[a : a + len(win)] == win:
                        hit |= set(range(a, a + len(win)))
                        its.add(str(k))
        r = got[i]
        assert r["n_words"] == len(w) and sum(s["word_to"] - s["word_from"] for s in r["spans"]) == len(hit) and r["item_ids"] == sorted(its)
        raw = t.encode()
        for s in r["spans"]:
            assert len(norm(raw[s["byte_from"] : s["byte_to"]].decode())) == s["word_to"] - s["word_from"]


def test_decontamination_edges(spark, edge):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find(edge, none).where("size(spans) > 0").count() == 0
    assert decontamination.find(edge.limit(0), none).count() == 0


# 5


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>var a='</p>';</script></head><body>{body}</body></html>"


def test_html_articles_and_style_tree(spark):
    art = page('<nav><a href="/">Home</a></nav><article><h1>A &amp; B</h1><p>one<br>two <b>three</b><p>four&#33;<aside>x</aside><div class="comments"><p>nice</p></div></article><div class="ad">buy</div><footer>f</footer>')
    assert html_text.main_text(art, lambda k: False) == "A & B\none two three\nfour!"
    rows = [(i, f"http://h.example/{i}", page(f'<div class="top"><p>Always the same words here</p></div><div class="body"><p>{"x" * i} text {i}</p>{"<p>more</p>" * (i % 5)}</div>')) for i in range(30)]
    rows += [(90, None, None), (91, "bad url", ""), (92, "http://o.example/", "<p>open <b>never closed"), (92, "http://o.example/", "<p>open <b>never closed"), (93, "http://o.example", "<!-- never ends <p>a")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for listed in (100, 0):
        got = {r["page_id"]: r["text"] for r in html_text.extract(p, listed=listed).collect()}
        assert "Always" not in got[7] and "text 7" in got[7]
        assert got[90] == got[91] == got[93] == "" and got[92] == "open never closed"
    assert html_text.extract(p.limit(0)).count() == 0


def test_html_mirrored_pages_keep_their_text(spark):
    body = lambda i: page(f'<div class="top"><p>Same words</p></div><div class="body"><p>{"y" * 40} text {i} of many</p></div>')
    rows = [(i, f"http://m.example/{i}", body(max(i, 150))) for i in range(200)]
    rows += [(300 + i, f"http://three.example/{i}", page("<div><p>only text here</p></div>")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(f"text {max(i, 150)} of many" in got[i] and "Same" not in got[i] for i in range(200))
    assert all(got[300 + i] == "only text here" for i in range(3))
    # nodes that hold most of a page stay, however often their text is repeated
    assert html_text.main_text(body(1), lambda k: True) == "y" * 40 + " text 1 of many"


def test_html_wrappers_do_not_condemn_articles():
    text = lambda body: html_text.main_text(page(body), lambda k: False)
    assert text("<div class='layout has-sidebar'><article>kept</article><div class='sidebar'>side</div></div>") == "kept"
    assert text("<main><div class='layout has-sidebar'><article>kept</article></div></main>") == "kept"
    assert text("<div class='with-comments'><article>kept</article></div>") == "kept"
    assert text("<article>kept whole</article><div class='related'><article>other</article></div>") == "kept whole"
    assert text("<div class='content'><p>kept</p></div><div class='comments'><article>nice</article></div>") == "kept"
    assert html_text.main_text("<body class='single comments-open'><p>kept</p></body>", lambda k: False) == "kept"


def test_html_style_tree_decides_inside_articles(spark):
    promo = lambda t: f'<div class="x7"><p>{t}</p></div>'
    body = lambda i, t: page(f'<article class="post"><h1>Same heading</h1><p>own words {i} of this text and some more of them</p>{promo(t)}<p>end {i}</p></article><div class="q">beside {i}</div>')
    rows = [(i, f"http://a.example/{i}", body(i, "join our list")) for i in range(40)] + [(40, "http://a.example/40", body(40, "a box of its own"))]
    rows += [(100 + i, f"http://few.example/{i}", body(i, "join our list")) for i in range(5)]  # too few pages to tell
    rows += [(200 + i, f"http://mirror.example/{i}", body(7, "join our list").replace("beside 7", f"beside {i}")) for i in range(20)]  # one article on all pages
    want = lambda i, t: "\n".join(["Same heading", f"own words {i} of this text and some more of them", *([t] if t else []), f"end {i}"])
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    for listed in (100, 0):
        got = {r["page_id"]: r["text"] for r in html_text.extract(p, listed=listed).collect()}
        assert all(got[i] == want(i, "") for i in range(40)) and got[40] == want(40, "a box of its own")
        assert all(got[100 + i] == want(i, "join our list") for i in range(5))
        assert all(got[200 + i] == want(7, "join our list") for i in range(20))


def test_html_deep_pages_take_linear_time():
    import time

    for bad in ("<div>a", "<blockquote>a", "<li><b>", "<p><section><blockquote>"):
        began, n = time.process_time(), 50_000
        text = html_text.main_text("<body>" + bad * n + "</foo></div></p>" * n, lambda k: False)
        assert time.process_time() - began < 20 and text.count("a") in (0, n)


def test_html_edges(spark):
    rows = [(1, "http://e.example/", "<p>one"), (1, "http://e.example/", "<p>one"), (None, None, None), (2, "http://e.example/", ""), (3, "x", "<p>" + "long " * 200_000), (4, "http://e.example/", "\ud7ff<p>&#x110000; &bogus; &amp")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    for c in ("text", "host", "page", "up", "keys", "content", "__row_", "n_chars"):
        p = p.withColumn(c, F.lit("clash"))
    got = html_text.extract(p, keep=("page_id", "host", "keys")).collect()
    assert len(got) == len(rows) and {r["host"] for r in got} == {r["keys"] for r in got} == {"clash"}
    by = {r["page_id"]: r["text"] for r in got}
    assert by[1] == "one" and by[None] == by[2] == "" and len(by[3]) == 5 * 200_000 - 1


# 6, 7


def test_language_on_held_out_texts(spark, edge):
    rng = random.Random(6)
    kinds = {"en": ("the", "and", "ing", "er"), "fr": ("eau", "que", "é", "ment"), "de": ("sch", "ung", "ü", "ver")}
    rows = [(i, prose(rng, rng.randint(3, 60), kinds[k]), k, "s") for i, k in ((i, rng.choice(list(kinds))) for i in range(400))] + [(900, "123 !!", "en", "s"), (901, None, "fr", "s"), (902, "und", None, "s")]
    d = docs(spark, rows)
    model = language.train(d, F.col("doc_id") % 4 != 0)
    got = {r["doc_id"]: r for r in language.predict(d, model).collect()}
    held = [r for r in rows[:400] if r[0] % 4 == 0]
    assert sum(got[i]["lang_pred"] == k for i, _, k, _ in held) >= 0.98 * len(held)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(edge, language.train(edge.limit(0), F.lit(True))).where("lang_pred = 'und'").count() == len(EDGE)


def test_language_learns_more_than_two_hundred(spark):
    rng = random.Random(16)
    kinds = {f"l{k}": tuple(chr(0x4E00 + 7 * k + j) for j in range(6)) for k in range(230)}
    rows = [(i, prose(rng, 12, kinds[k]), k, "s") for i, k in enumerate(list(kinds) * 4)] + [(9000 + i, "same words", "l0", "s") for i in range(50)]
    model = language.train(docs(spark, rows + [(None, "no doc_id", None, "s")] * 3), F.col("doc_id") % 4 != 0)
    assert len(model.languages) == 230 and model.bits < language.DIM_BITS + 1
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs(spark, rows[:920]), model).collect()}
    assert sum(got[i] == k for i, _, k, _ in rows[:920]) >= 0.95 * 920
    assert language.bits_for(4) == 16 and language.bits_for(8000) == 11 and language.bits_for(10**9) == language.LEAST_BITS


def test_language_sample_is_bounded(spark):
    rng = random.Random(17)
    d = docs(spark, [(None if i % 3 else i, prose(rng, 5), "en" if i % 2 else "fr", "s") for i in range(400)])
    seen = []
    real = language.fit
    language.fit, keep = (lambda sample, bits: seen.append(sample) or real(sample, bits)), F.lit(True)
    try:
        language.train(d, keep, per_language=20)
        language.train(d.union(d).union(d), keep, per_language=20)
        language.train(d, keep, sample=10)
        language.train(d, keep, sample_bytes=1)
    finally:
        language.fit = real
    assert 20 <= len(seen[0]) <= 80 and len(seen[2]) <= 30 and len(seen[3]) == 2
    assert sorted(len(p) for _, p in seen[1]) and len(seen[1]) <= 2 * len(seen[0])


def test_quality_on_held_out_texts(spark, edge):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        good = rng.random() < 0.6
        t = prose(rng, 40)
        rows.append((i, t if good else " | ".join(t.split()), "en", "s"))
        labels.append((i, int(good), 0))
    d, la = docs(spark, rows), spark.createDataFrame(labels + [(5000, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    w = quality.train(d, la, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r["score"] for r in quality.score(d, w).collect()}
    held = [(i, q) for i, q, _ in labels if i % 3 == 1]
    assert sum((got[i] >= 0.5) == bool(q) for i, q in held) >= 0.97 * len(held)
    assert quality.score(edge, quality.train(edge, la.limit(0), F.lit(True))).where("score = 0.5").count() == len(EDGE)


# 8


def test_pseudonyms_keep_format_and_links(spark):
    texts = ["card 4111 1111 1111 1111, 4111111111111111.", "born 2024-02-29 / 31/12/1999", "at 10.0.0.255 or 300.1.1.1", "+1 (741) 555-3069 (741) 555-3069", "DE89 3704 0044 0532 0130 00", "a.b9@mail.example.com", 'token = "b44e15e09fd311c3cf31"', "4111111111111112 stays", None, "", "plain"]
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), "k").collect()}
    luhn = lambda s: sum((lambda v: v - 9 if v > 9 else v)(int(c) * (2 if i % 2 else 1)) for i, c in enumerate(reversed(s))) % 10 == 0
    a, b = (f["new"] for f in rows[0]["found"])
    assert a.replace(" ", "") == b and luhn(b) and b != "4111111111111111" and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", a)
    assert [f["kind"] for f in rows[1]["found"]] == ["date", "date"] and [f["kind"] for f in rows[2]["found"]] == ["ip"]
    assert rows[3]["found"][0]["new"].endswith(rows[3]["found"][1]["new"])
    assert rows[4]["found"][0]["kind"] == "iban" and rows[5]["text"].endswith("@mail.example.com") and "b44e15" not in rows[6]["text"]
    assert [rows[i]["text"] for i in (7, 8, 9, 10)] == texts[7:11] and all(len(rows[i]["text"]) == len(texts[i]) for i in (0, 3, 4, 5, 6))


def test_secrets_are_taken_whole(spark):
    long, upper, letters = "aB3" * 300, "9233A8EC" * 3, "abcdefgh" * 3
    texts = [f"token={long} end", f'TOKEN = "{upper}"', f"Password: {letters}"]
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), "k").collect()}
    for i, old in enumerate((long, upper, letters)):
        assert [(f["kind"], f["old"]) for f in rows[i]["found"]] == [("secret", old)] and len(rows[i]["text"]) == len(texts[i])
        assert rows[i]["text"] == texts[i].replace(old, rows[i]["found"][0]["new"]) and old[-16:] not in rows[i]["text"]


def test_cards_before_other_digits(spark):
    card, other = "4111 1111 1111 1111", "4222222222222"
    texts = [f"{card} 123", "4111111111111111 12/27", "4111111111111111 203.0.113.9 x", f"123 {card}", f"{card} 123 {other} 45 a@b.co", f"{card} 12/27/2024, 4111111111111112 12"]
    rows = {r["doc_id"]: r for r in pii.pseudonymise(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), "k").collect()}
    kinds = [[f["kind"] for f in rows[i]["found"]] for i in range(len(texts))]
    assert kinds == [["card"], ["card"], ["card", "ip"], ["card"], ["card", "card", "email"], ["card", "date"]]
    new = rows[0]["found"][0]["new"]
    assert rows[0]["text"] == f"{new} 123" and rows[3]["text"] == f"123 {new}" and rows[1]["text"].endswith(" 12/27")
    assert all((i == 2 or len(rows[i]["text"]) == len(t)) and "1111 1111" not in rows[i]["text"] and "203.0" not in rows[i]["text"] for i, t in enumerate(texts))
    assert rows[5]["text"].endswith(", 4111111111111112 12")


def test_social_security_numbers_stay_valid(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.format_string("no %03d-%02d-%04d.", F.col("id") % 898 + 1, F.col("id") % 99 + 1, F.col("id") * 3 + 1).alias("text")).where("text not like '% 666-%'")
    out = pii.pseudonymise(rows, "k").select(F.explode("found").alias("f")).select("f.*").collect()
    assert len(out) == rows.count() and {r["kind"] for r in out} == {"ssn"}
    assert not any(re.search(pii.NO_SSN, r["new"]) or not re.fullmatch(r"\d{3}-\d{2}-\d{4}", r["new"]) for r in out)
    assert len({r["new"] for r in out}) == len({r["old"] for r in out})


def test_pseudonym_edges(spark):
    d = docs(spark, [(1, "a@b.co", "en", "s"), (1, "a@b.co", "en", "s"), (None, None, None, None), (2, "", None, None), (3, "x" * 200_000 + " 10.0.0.1", None, None)])
    for c in ("found", "kind", "__pieces_", "old", "new"):
        d = d.withColumn(c, F.lit("clash"))
    got = pii.pseudonymise(d, "k", keep=("doc_id", "kind")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 5 and len({r["text"] for r in got if r["doc_id"] == 1}) == 1 and by[None]["text"] is None and by[2]["text"] == ""
    assert by[3]["found"][0]["kind"] == "ip" and {r["kind"] for r in got} == {"clash"}
    assert pii.pseudonymise(d.limit(0), "k").count() == 0


def test_permutations_are_injective(spark):
    n = 73_049
    df = spark.range(n).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("m")).where("pmod(xxhash64(m), 40) = 0")
    out = df.select("m", pii.other_date("k", F.col("m")).alias("o"))
    assert out.select("o").distinct().count() == df.count() and out.where("o not between '1900-01-01' and '2099-12-31'").count() == 0
    four = spark.range(10_000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("m"))
    assert four.select(pii.permuted("k", "x", F.col("m")).alias("o")).distinct().count() == 10_000


# 9


def test_suffix_array_is_sorted():
    rng = random.Random(9)
    for _ in range(100):
        s = np.array([rng.choice([1, 2, 3]) for _ in range(rng.randint(0, 50))], np.int64)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


@pytest.mark.parametrize(("hot", "most_keys"), [(2000, 1 << 24), (2, 1 << 24), (2000, 40)])
def test_repeats_are_brute_force(spark, hot, most_keys):
    rng = random.Random(10)
    shared = [prose(rng, 90) for _ in range(4)]
    texts = [" ".join(rng.choice([prose(rng, rng.randint(1, 40)), rng.choice(shared)[rng.randint(0, 60) :]]) for _ in range(rng.randint(0, 4))) for _ in range(60)]
    texts += [texts[5], texts[5], "z" * 450, "ab" * 300, None, "", "é" * 150]
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), hot, most_keys).collect()}
    for i, r in enumerate(raws):
        gone = {k for s in range(len(r) - 199) if seen[r[s : s + 200]] > 1 for k in range(s, s + 200)}
        kept = bytes(b for k, b in enumerate(r) if k not in gone)
        assert hashlib.sha256(bytes(got[i]["kept"])).digest() == hashlib.sha256(kept).digest(), i
        assert len(got[i]["spans"]) == sum(1 for k in gone if k - 1 not in gone) and got[i]["n_bytes"] == len(r)


def test_repeats_edges(spark, edge):
    assert suffix_dedup.remove_repeats(edge).count() == len(EDGE)
    assert suffix_dedup.remove_repeats(edge.limit(0)).count() == 0


# 10


def test_embedding_links_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 60)
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    x = np.concatenate([c + 0.05 * rng.normal(size=(25, 16)) for c in centres] + [rng.normal(size=(60, 16))])
    rows = [(i, v.astype(np.float32).tolist(), int(i % 2)) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(5)]
    bad = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[0][1], None), (2004, [], 1), (2005, [1.0, None], 1), (2006, [1.0, 2.0], 0)]
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")).collect()}
    u = embeddings.unit([r[1] for r in rows])
    lab = np.array([r[2] for r in rows])
    hit = (u @ u.T >= 0.98) & (lab[:, None] == lab[None, :])
    np.fill_diagonal(hit, False)
    n = hit.sum(axis=1)
    mine = np.array([got[r[0]]["n_links"] for r in rows])
    assert (mine <= n).all() and mine.sum() >= 0.98 * n.sum()
    assert all(got[b[0]]["n_links"] == 0 and got[b[0]]["component_id"] == b[0] and got[b[0]]["kept"] for b in bad)
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_links_in_shards_without_pivots(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "SHARD", 30)
    monkeypatch.setattr(embeddings.shards_of, "__defaults__", (30,))
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(8, 16))
    centres[1] = centres[0] + 0.5 * rng.normal(size=16)
    x = np.concatenate([centres[0] + 0.02 * rng.normal(size=(260, 16))] + [c + 0.02 * rng.normal(size=(20, 16)) for c in centres[1:]])
    nodes = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    dealt = embeddings.shards_of(embeddings.nodes_of(nodes)[1], 2).toPandas()
    size = dealt.groupby("shard")["node"].nunique()
    assert (dealt[dealt["shard"].isin(size[size > 4 * 30].index)].groupby("node").size() > 1).sum() > 4 * 30  # nodes in several huge shards
    u = embeddings.unit(x.astype(np.float32))
    hit = u @ u.T >= 0.98
    np.fill_diagonal(hit, False)
    got = {r["vec_id"]: r["n_links"] for r in embeddings.near_duplicates(nodes).collect()}
    mine, n = np.array([got[i] for i in range(len(x))]), hit.sum(axis=1)
    assert (mine <= n).all() and (mine[:260] == n[:260]).all() and mine.sum() >= 0.98 * n.sum()
    rows = embeddings.nodes_of(nodes)[1]
    with pytest.raises(RuntimeError):
        embeddings.audit(rows, spark.createDataFrame([(i, int(v) + 1) for i, v in enumerate(n)], "node long, n long"))


def test_embedding_links_of_one_large_group(spark):
    rng = np.random.default_rng(14)
    near = rng.normal(size=32) + 0.01 * rng.normal(size=(3000, 32))
    x = np.concatenate([near, rng.normal(size=(3000, 32))]).astype(np.float32)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(1)).withColumn("shard", F.lit(2)).withColumn("copies", F.lit(3))).collect()}
    u = embeddings.unit(x)
    hit = u @ u.T >= 0.98
    np.fill_diagonal(hit, False)
    n, mine = hit.sum(axis=1), np.array([got[i]["n_links"] for i in range(len(x))])
    assert n[:3000].min() == 2999 and (mine[:3000] == n[:3000]).all() and (mine <= n).all() and mine.sum() >= 0.99 * n.sum()
    assert all(got[i]["component_id"] == 0 for i in range(3000))


# pipeline


CLASHES = ("score", "spans", "n_words", "component_id", "__row", "size", "at", "n_hit", "part", "h", "l")


def stage_input(spark):
    """documents with null, repeated, empty and long rows, ties, and columns of clashing names."""
    rng = random.Random(15)
    rows = [(i, prose(rng, 40), ("en", "fr", None)[i % 3], ("a", "b", None)[i % 3], 7) for i in range(12)]
    rows += [(3, rows[3][1], "en", "a", 7), (3, rows[4][1], "fr", "b", 7), (None, rows[5][1], None, None, None), (None, None, None, None, None), (20, "", "en", "a", 0), (21, "123 !!", "en", "a", 7), (22, "z" * 100_000, "en", "a", 7)]
    d = spark.createDataFrame(rows, DOCS)
    for c in CLASHES:
        d = d.withColumn(c, F.lit("clash"))
    return d


def test_every_stage_takes_odd_rows(spark, tmp_path):
    import corpus_pipeline

    bench = [(1, " ".join(f"w{i}" for i in range(20))), (2, None), (None, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = stage_input(spark)
    known = sorted(map(str, d.select(*corpus_pipeline.COLUMNS).collect()))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got, none = stage(spark, d, str(tmp_path)), stage(spark, d.limit(0), str(tmp_path))
        assert none.count() == 0, name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert tuple(got.columns) == tuple(none.columns) == corpus_pipeline.COLUMNS, name
        else:
            assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() == len(known)
            continue
        rows = got.collect()
        if k == 0:  # null, empty and letterless texts go; lang is filled in
            assert len(rows) == len(known) - 3 and all(r["lang"] for r in rows)
        if k == 1:  # one row of each text
            assert sorted(str(r["text"]) for r in rows if r["text"]) == sorted({str(r["text"]) for r in d.collect() if r["text"]}) and len(rows) == len({(r["text"] or "") for r in d.collect()})
        if k == 2:  # all are clean
            assert sorted(map(str, rows)) == known
        if k == 3:  # no text is invented
            assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in d.collect()}


def test_language_stage_without_labels_keeps_documents(spark):
    import corpus_pipeline

    rows = [(1, "some words", None, "a"), (2, "123 !!", None, "a"), (3, None, None, "a"), (4, "\u0436", None, None)]
    got = corpus_pipeline.identify_language(spark, docs(spark, rows).withColumn("n_chars", F.length("text").cast("long")), "").collect()
    assert sorted(r["doc_id"] for r in got) == [1, 4]


def test_decontamination_stage_drops_copies_of_items(spark, tmp_path):
    import corpus_pipeline

    item = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, f"x {item} y", "en", "a"), (2, "clean " * 30, "en", "a"), (None, item, None, None)]
    assert [r["doc_id"] for r in corpus_pipeline.decontaminate(spark, docs(spark, rows), str(tmp_path)).collect()] == [2]


def test_near_duplicate_stage_keeps_unlike_rows(spark):
    import corpus_pipeline

    rng = random.Random(13)
    texts = [prose(rng, 80, (chr(97 + i), chr(105 + i), chr(113 + i) + "x")) for i in range(8)]
    rows = [(None, t, None, None) for t in texts[:3]] + [(7, t, None, None) for t in texts[3:5]] + [(1, texts[5], None, None), (2, texts[5], None, None), (2, texts[6], None, None), (None, texts[7], None, None), (None, texts[7], None, None), (7, texts[3], None, None)]
    got = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows).withColumn("n_chars", F.length("text").cast("long")), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in got) == sorted([(0, t) for t in texts[:3]] + [(7, t) for t in texts[3:5]] + [(1, texts[5]), (2, texts[6]), (0, texts[7])])
