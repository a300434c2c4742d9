"""Main text of web pages with a site style tree.

The trees of all pages of a host are merged: a node is known by its path of tags and classes, and for each node the
host's pages are counted by presentation (the sequence of its children) and by content (its text). Importance is
entropy, 1 when every page differs and 0 when all agree: ``(1 - g**l) * presentation + g**l * content`` with g = 0.9 and l
presentations. Equal pages of a host count once. Branches of low importance are removed from each page, in articles and beside them.

Entropy alone keeps menus whose links differ from page to page and drops the articles of mirrored pages, so what tags, roles and
classes say weighs in beforehand (``WEIGHTS``): what names itself a menu, header, footer, sidebar, notice, advert, form or comments
counts for a part of its entropy, and a branch of an article (or main) has to be repeated on nearly all of ten pages or more. On a page with an article
(or else main) the text is what lies in it. Its branches of low importance go if the page's own text of them is the host's commonest, unless more than half
of the article would go (a mirrored article stays whole); its main heading stays. Elsewhere a branch of low importance goes, but neither html nor body,
nor a branch with over three quarters of a page's text, nor one with over half of it some of which lies in important nodes;
and where nothing would be left, all stays. An article (or main) in a wrapper whose class only
sounds like a menu or the like (say has-sidebar) is added, unless the page has an article with at least as much text elsewhere;
one in a wrapper for comments is added only where nothing else is found.

Scale: pages are parsed once, where they are read, to blocks of text and nodes, in time linear in the page (an open element is found by
its tag, texts are held by their nearest node, contents are hashed from below), and written to the shared folder. The
counts take a row of hashes for each distinct page, equal ones combined before the
shuffle, then rows by host, node and hash, combined too, so a host with a third of all pages is no hot key. The list of unimportant nodes is broadcast up to ``LISTED`` entries;
above that the pages are joined with the rows of their own nodes.

Cases: null and empty pages give an empty text; unclosed and misplaced tags are repaired as browsers do in the common cases; a null url is
a host of its own; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import checkpoint, table, written

GAMMA, LEAST, LISTED = 0.9, 0.35, 200_000
#: Where a branch lies: the part of its entropy's shortfall that counts, and the fewest distinct pages of a host that tell.
BESIDE, IN_MAIN, IN_ARTICLE = 0, 1, 2
WEIGHTS = {BESIDE: (1.0, 3), IN_MAIN: (0.8, 10), IN_ARTICLE: (0.7, 10)}

# Fixed sets of HTML names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
DROPPED = frozenset("head nav aside footer form script style noscript iframe svg math button select textarea template canvas object video audio dialog menu map datalist title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related recommended comment comments disqus respond reply replies widget login search pagination pager toolbar copyright disclaimer".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
#: What condemns a branch: a wrapper's class, a wrapper's class for comments, or what holds for an article inside, too.
BY_CLASS, BY_COMMENTS, WHOLLY = 1, 2, 3
#: An open element that a start tag of the same group ends.
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
SCOPES = frozenset("article main table ul ol dl body html div section".split())
P_SCOPES = SCOPES | {"li", "td", "th", "button"}
#: What an end tag of the second kind does not reach through.
WALLS, HELD_IN = frozenset("article main table".split()), frozenset("p li div span section".split())

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
TAG_END = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*+>""")
ATTRS = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORDS = re.compile(r"[a-z]+")


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes): kinds are text, open and close."""
    i, n = 0, len(html)
    while i < n:
        j = html.find("<", i)
        if j < 0:
            yield "text", html[i:], ""
            return
        if j > i:
            yield "text", html[i:j], ""
        if html.startswith("<!--", j):
            k = html.find("-->", j + 4)
            if html.startswith(("<!-->", "<!--->"), j):
                k = html.index(">", j) - 2
            i = n if k < 0 else k + 3
            continue
        m = NAME.match(html, j + 1)
        if not m:
            if j + 1 < n and html[j + 1] in "!?/":
                k = html.find(">", j)
                i = n if k < 0 else k + 1
            else:
                yield "text", "<", ""
                i = j + 1
            continue
        e = TAG_END.match(html, m.end())
        end = e.end() if e else html.find(">", m.end()) + 1
        if not end:  # a tag that never ends
            return
        name = m.group().lower()
        if name[0] == "/":
            yield "close", name[1:], ""
            i = end
            continue
        yield "open", name, html[m.end() : end - 1]
        i = end
        if name in RAW:
            c = re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, end)
            if name not in DROPPED:
                yield "text", html[end : c.start() if c else n], ""
            yield "close", name, ""
            k = html.find(">", c.start()) if c else -1
            i = n if k < 0 else k + 1


def unimportant(tag: str, attrs: str) -> tuple[int, str]:
    """What says that the branch is not the text (0: nothing, else the tag, role or class); and the class and id as part of the node's name."""
    if tag in DROPPED:
        return WHOLLY, ""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return 0, ""
    got = {m[1].lower(): (m[2] or m[3] or m[4] or "").lower() for m in ATTRS.finditer(attrs)}
    name = got.get("class", "") + "#" + re.sub(r"\d+", "", got.get("id", ""))
    if tag in ("html", "body") or tag in ("article", "main") and "comment" not in name:
        return 0, name
    if got.get("role") in DROPPED_ROLES or "hidden" in got or got.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", got.get("style", "")):
        return WHOLLY, name
    words = DROPPED_WORDS.intersection(WORDS.findall(name))
    return (0 if not words else BY_COMMENTS if words & COMMENT_WORDS else BY_CLASS), name


@dataclass
class Page:
    """Nodes in document order (parents first) and blocks of text; ``key``: path of tags and classes, ``item``: number of the key among ``keys``."""

    up: list[int] = field(default_factory=list)
    key: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    at: list[int] = field(default_factory=list)
    item: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    shown: list[int] = field(default_factory=list)
    content: list[int] = field(default_factory=list)


#: Bits of a node's flags: what condemns it, what condemned a wrapper of its article, where it lies, whether it is a root of the page or a main heading.
BAD, LIFTED, PLACE, STAYS = 0, 2, 4, 6
ROOTS = {"html": 1, "body": 1, "h1": 2}
part = lambda flags, bit: flags >> bit & 3
PLACES = {"article": IN_ARTICLE, "main": IN_MAIN}


def parse(html: str | None) -> Page:
    """One pass over the page; an open element is found by its tag, so the time is linear in the page's length."""
    out = Page()
    up, key, tag, flags, kids, items = out.up, out.key, out.tag, out.flags, [], []
    stack: list[int] = []
    scope: list[int] = []  # height of the nearest of SCOPES, of those that end a p, and of article, main or table, for each open element
    p_scope: list[int] = []
    wall: list[int] = []
    open_at: dict[str, list[int]] = {}
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                out.texts.append(text)
                out.at.append(stack[-1] if stack else -1)
                if stack:
                    items[stack[-1]].append(xxh64_intdigest(text))

    def cut(height: int) -> None:
        while len(stack) > height:
            open_at[tag[stack.pop()]].pop()
            scope.pop(), p_scope.pop(), wall.pop()

    def shut(names: tuple[str, ...], scopes: list[int]) -> None:
        height = max((open_at[n][-1] for n in names if open_at.get(n)), default=-1)
        if height >= 0 and height > scopes[-1]:
            cut(height)

    for kind, name, attrs in tokens(html or ""):
        if kind == "text":
            buffer.append(name)
        elif name in INLINE:
            continue
        elif name in ("br", "wbr", "img") and kind == "open":
            buffer.append(" " if name == "br" else "")
        elif kind == "open":
            flush()
            if name in CLOSES_P:
                shut(("p",), p_scope)
            if name in SELF_CLOSING:
                shut(SELF_CLOSING[name], scope)
            if name in VOID:
                continue
            bad, label = unimportant(name, attrs)
            above = stack[-1] if stack else -1
            over = flags[above] if stack else 0
            place = max(PLACES.get(name, BESIDE), part(over, PLACE))
            if name == "header" and place != IN_ARTICLE:
                bad = WHOLLY
            lifted = part(over, LIFTED)
            if name in PLACES and not bad and 0 < part(over, BAD) < WHOLLY:
                lifted = max(lifted, part(over, BAD))
            elif part(over, BAD):
                bad = max(bad, part(over, BAD))
            here = len(up)
            up.append(above)
            key.append(xxh64_intdigest(f"{key[above] if stack else 0}>{name}.{label}"))
            tag.append(name)
            flags.append(bad << BAD | lifted << LIFTED | place << PLACE | ROOTS.get(name, 0) << STAYS)
            kids.append([])
            items.append([])
            if stack:
                kids[above].append(f"{name}.{label}")
                items[above].append(here - (1 << 62))  # stands for the child's content
            height = len(stack)
            scope.append(height if name in SCOPES else scope[-1] if stack else -1)
            p_scope.append(height if name in P_SCOPES else p_scope[-1] if stack else -1)
            wall.append(height if name in WALLS else wall[-1] if stack else -1)
            open_at.setdefault(name, []).append(height)
            stack.append(here)
        else:
            flush()
            if open_at.get(name):
                height = open_at[name][-1]
                if name not in HELD_IN or height >= wall[-1]:
                    cut(height)
    flush()
    # contents from below; then the nodes of a key together
    own = [0] * len(up)
    for i in range(len(up) - 1, -1, -1):
        found = [x if x >= 0 else own[x + (1 << 62)] for x in items[i]]
        found = [x for x in found if x]
        own[i] = found[0] if len(found) == 1 else xxh64_intdigest(b"".join(x.to_bytes(8, "little") for x in found)) if found else 0
    by: dict[int, int] = {}
    together: list[list[int]] = []
    for i, k in enumerate(key):
        n = by.setdefault(k, len(by))
        out.item.append(n)
        if n == len(together):
            together.append([])
        if up[i] < 0 or not part(flags[up[i]], BAD):
            together[n].append(i)
    out.keys = list(by)
    out.shown = [xxh64_intdigest("|".join(",".join(kids[i]) for i in nodes)) if nodes else 0 for nodes in together]
    out.content = [xxh64_intdigest(b"".join(own[i].to_bytes(8, "little") for i in nodes)) if nodes else 0 for nodes in together]
    return out


def host_of(url: str | None) -> str | None:
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else None


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


NODES = "host long, page long, up array<int>, item array<int>, flags array<int>, texts array<string>, at array<int>, keys array<long>, shown array<long>, content array<long>"


def _parsed(it: Iterator[pa.RecordBatch], keep: tuple[str, ...], rows: int = 256) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in NODES.split(", ")]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
    for whole in it:
        for lo in range(0, whole.num_rows, rows):
            b = whole.slice(lo, rows)
            cols: list[list] = [[] for _ in names]
            for url, html in zip(b.column("__url").to_pylist(), b.column("__html").to_pylist(), strict=True):
                x = parse(html)
                wide = [np.array(v, np.uint64).view(np.int64) for v in (x.keys, x.shown, x.content)]
                for c, v in zip(cols, (signed(xxh64_intdigest(host_of(url) or "")), signed(xxh64_intdigest(html or "")), x.up, x.item, x.flags, x.texts, x.at, *wide), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*keep, *names])


def parsed(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """Columns ``keep`` of ``pages(url, html)`` with blocks and nodes, a row number (__row) and hashes of host and page; written once for both passes."""
    kinds = dict(pages.dtypes)
    kept = [F.col(c).alias(f"__keep_{i}") for i, c in enumerate(keep)]
    names = tuple(f"__keep_{i}" for i in range(len(keep)))
    schema = ", ".join([*(f"{n} {kinds[c]}" for n, c in zip(names, keep, strict=True)), NODES])
    out = pages.select(*kept, F.col("url").alias("__url"), F.col("html").alias("__html")).mapInArrow(lambda it: _parsed(it, names), schema)
    return written(out.withColumn("__row", F.monotonically_increasing_id()), "html-pages", compression="zstd")


def counts(pages: DataFrame) -> DataFrame:
    """(host, node, kind, hash) of the nodes of every parsed page, equal pages of a host once: kind 0 is presentation, 1 content. What lies in condemned branches is not asked about."""
    each = pages.select("host", "page", "keys", "shown", "content").dropDuplicates(["host", "page"])
    rows = each.select("host", F.explode(F.arrays_zip("keys", "shown", "content")).alias("x")).where("x.shown <> 0")
    return rows.select("host", F.col("x.keys").alias("node"), F.posexplode(F.array("x.shown", "x.content")).alias("kind", "hash"))


def importance(rows: DataFrame) -> DataFrame:
    """(host, node, pages, importance, common) of the merged trees; common: the commonest content."""
    each = rows.groupBy("host", "node", "kind", "hash").agg(F.count("*").alias("c"))
    plogp = F.sum(F.col("c") * F.log("c"))
    node = each.groupBy("host", "node").pivot("kind", [0, 1]).agg(F.sum("c").alias("m"), plogp.alias("s"), F.sum(F.lit(1)).alias("l"), F.max(F.struct("c", "hash")).alias("top"))
    entropy = lambda k: F.when(F.col(f"{k}_m") > 1, 1 - F.col(f"{k}_s") / (F.col(f"{k}_m") * F.log(f"{k}_m"))).otherwise(1.0)
    g = F.pow(F.lit(GAMMA), F.col("0_l").cast("double"))
    return node.select("host", "node", F.col("0_m").alias("pages"), ((1 - g) * entropy(0) + g * entropy(1)).alias("importance"), F.col("1_top.hash").alias("common"))


def low(known: tuple[int, float, int | None] | None, place: int) -> bool:
    """Whether a node of (pages, importance, common content) counts as unimportant where it lies."""
    weight, fewest = WEIGHTS[place]
    return known is not None and known[0] >= fewest and 1 - (1 - known[1]) * weight < LEAST


def chosen(up, item, flags, texts, at, content, known) -> str:
    """Text of a parsed page; ``known(i)`` gives (pages, importance, common content) of its i-th key, or None."""
    n, told = len(up), {}

    def is_low(i: int) -> bool:
        k = (item[i], part(flags[i], PLACE))
        if k not in told:
            told[k] = low(known(k[0]), k[1])
        return told[k]

    fine = [b for b in range(len(texts)) if at[b] < 0 or not part(flags[at[b]], BAD)]
    held = max((part(f, PLACE) for f in flags if not part(f, BAD) and not part(f, LIFTED)), default=BESIDE)
    gone = [False] * n
    if held:  # branches of the article with the host's commonest text
        for i in range(n):
            own = part(flags[i], PLACE) == held and not part(flags[i], STAYS) and is_low(i) and known(item[i])[2] in (None, content[item[i]])
            gone[i] = own or up[i] >= 0 and gone[up[i]]
    else:  # branches of low importance that hold no large part of the page
        share, mixed = [0] * n, [False] * n
        for b in fine:
            if at[b] >= 0:
                share[at[b]] += len(texts[b])
                mixed[at[b]] = mixed[at[b]] or not is_low(at[b])
        for i in range(n - 1, -1, -1):
            if up[i] >= 0:
                share[up[i]] += share[i]
                mixed[up[i]] = mixed[up[i]] or mixed[i]
        total = sum(len(texts[b]) for b in fine)
        for i in range(n):
            stays = part(flags[i], STAYS) == 1 or share[i] > total * (0.5 if mixed[i] else 0.75)
            gone[i] = up[i] >= 0 and gone[up[i]] or not stays and is_low(i)
    size = lambda places: sum(len(texts[b]) for b in places)
    lifted = [b for b in fine if at[b] >= 0 and part(flags[at[b]], LIFTED)]
    inside = [b for b in fine if not (at[b] >= 0 and part(flags[at[b]], LIFTED)) and (not held or at[b] >= 0 and part(flags[at[b]], PLACE) == held)]
    found = [b for b in inside if at[b] < 0 or not gone[at[b]]]
    if held and 2 * size(found) < size(inside):
        found = inside
    plain = [b for b in lifted if part(flags[at[b]], LIFTED) == BY_CLASS]
    if held != IN_ARTICLE or size(plain) > size(found):
        found += plain
    return "\n".join(texts[b] for b in sorted(found or lifted or range(len(texts))))


def main_text(html: str | None, unimportant_key) -> str:
    """Text of a page; ``unimportant_key(key)`` tells if a node's texts are the same on all of the host's pages."""
    x = parse(html)
    return chosen(x.up, x.item, x.flags, x.texts, x.at, x.content, lambda i: (1 << 30, 0.0, None) if unimportant_key(x.keys[i]) else None)


def _texts(it: Iterator[pa.RecordBatch], keep: tuple[str, ...], known_of) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for lo in range(0, whole.num_rows, 256):
            b = whole.slice(lo, 256)
            cols = [b.column(c).to_pylist() for c in ("up", "item", "flags", "texts", "at", "content")]
            texts = [chosen(*(c[i] for c in cols), known_of(b, i)) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*(b.column(f"__keep_{i}") for i in range(len(keep))), pa.array(texts, pa.string())], names=[*keep, "text"])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), listed: int = LISTED) -> DataFrame:
    """Columns ``keep`` of ``pages(url, html)`` with the main text of every row."""
    rows = parsed(pages, keep)
    known = importance(counts(rows))
    few = checkpoint(known.where((F.col("importance") < LEAST) & (F.col("pages") >= min(n for _, n in WEIGHTS.values()))))
    kinds = dict(pages.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", text string"
    if few.count() <= listed:
        sent = pages.sparkSession.sparkContext.broadcast({(r["host"], r["node"]): (r["pages"], r["importance"], r["common"]) for r in few.collect()})

        def by_list(b, i):
            host, keys = b.column("host")[i].as_py(), b.column("keys")[i].as_py()
            return lambda k: sent.value.get((host, keys[k]))

        return rows.mapInArrow(lambda it: _texts(it, keep, by_list), schema)

    # too many for a broadcast: each page asks for its own nodes
    asked = rows.select("__row", "host", F.posexplode("keys").alias("nth", "node")).join(few, ["host", "node"]).groupBy("__row").agg(F.collect_list(F.struct("nth", "pages", "importance", "common")).alias("__low"))

    def by_row(b, i):
        return {r["nth"]: (r["pages"], r["importance"], r["common"]) for r in b.column("__low")[i].as_py() or ()}.get

    return rows.join(asked, "__row", "left").mapInArrow(lambda it: _texts(it, keep, by_row), schema)


def op5_html_text(spark, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars: one row for each row of pages."""
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
