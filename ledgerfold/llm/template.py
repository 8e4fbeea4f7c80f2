"""Main text of web pages by equivalence-class template deduction.

Tokens are opening tags and text nodes, told apart by the path of elements they
stand in.  The occurrence vector of a token is its count on every page of its
host.  Vectors are never stored: a sum of page hashes, which Spark adds up with
partial aggregates, stands for them, so a host that holds a third of all pages
is no group in one task.  Tokens with equal vectors are an equivalence class.

A class is valid if it is frequent and large, if its tokens come in the same
order on every page (checked on the places of their first and last
occurrences), and if it nests: the host's root class is the one with the
largest support, and every other class lies between the same two tokens of the
root class on every page.  Valid classes are the host's template; what lies
between its tokens are slots.  The template decides

* whether ``article``, ``main`` and containers named as content hold the text
  of this host: only if at least half of the text in slots is in them;
* which slots are menus: elements of the template outside of those, half or
  more of whose text is links;
* which text is template text: text of a valid class outside of trusted content
  elements.  In those nothing is dropped: near copies of an article on one host
  share its text as they share their template.

All other slots are the main text.  Elements that never hold article text
(``nav``, ``footer``, ``aside``, forms, a ``header`` that heads no article) and
containers wholly named as adverts, notices, menus or comments are left out.

Null html is an empty page; a page without url or host, or on a host with fewer
than three pages, has no template and is read by its elements and names alone;
copies of a page count once in a host's template; rows with equal ids are kept.
Elements nested deeper than 512 are read as if they stood at that depth, and
after a tag with an unbalanced quote tags end at the first ``>``: both keep the
time linear in the page.  An unfinished tag at the end of a page is text.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ledgerfold.llm.graph import arrow_batches
from ledgerfold.session import materialize

LEAST_PAGES, SUPPORT, CLASS_SIZE, HALF, DEPTH = 3, 0.6, 3, 0.5, 512

PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>|[^<]++|<""", re.S)
PLAIN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>|<[!?][^>]*+>|[^<]++|<""", re.S)
OPENS = re.compile(r"</?[a-zA-Z]")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
RAW = {"script", "style", "noscript", "template", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
OUTSIDE = {"head", "nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu"}
# names of containers without article text; they count only if every part of a name is one of them or of PLACE
ADVERTS = {"ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr"}
ASIDES = {"banner", "popup", "modal", "newsletter", "subscribe", "share", "sharing", "social", "related", "recommended", "comment", "comments",
          "disqus", "reply", "replies", "respond", "widget", "toolbar", "pagination", "pager", "login", "signup", "nav", "navbar", "navigation",
          "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "notice", "notices", "complementary", "contentinfo"}
HEADS = {"header", "masthead", "search"}
PLACE = {"site", "page", "main", "top", "bottom", "left", "right", "box", "block", "bar", "list", "section", "container", "wrapper", "area",
         "user", "reader", "global", "primary", "secondary", "thread", "links", "slot", "unit", "posts", "articles"}
CONTENT = {"content", "main", "article", "article-body", "post-body", "post-content", "entry-content", "main-content", "story", "story-body"}
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "td", "th", "dd", "dt", "figcaption"} | INLINE
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "main", "section", "body", "nav", "aside", "footer", "header", "form", "blockquote"}
BREAKS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header",
            "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "figure"}

TOKEN = "token: bigint, parent: bigint, n: int, first: int, last: int, chars: bigint, linked: bigint, kind: int, tag: boolean"


def names_of(attributes: str) -> list[str]:
    out = []
    for m in NAMES.finditer(attributes):
        out += (m[2] or m[3] or m[4] or "").lower().split()
    return out


def is_noise(tag: str, names: list[str], inside: bool = False) -> bool:
    """Element that holds no main text, by its tag or by a whole name; ``inside`` an article headers belong to it."""
    if tag in OUTSIDE or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    listed = ADVERTS if tag in TEXTUAL else ADVERTS | ASIDES if inside else ADVERTS | ASIDES | HEADS
    for name in names:
        parts = [p for p in re.split(r"[-_]+", name) if p]
        if any(p in listed for p in parts) and all(p in listed or p in PLACE for p in parts):
            return True
    return False


def digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=65536)
def child(path: int, label: str) -> int:
    """Key of the path one element further down."""
    return digest(b"<" + path.to_bytes(8, "big", signed=True) + label.encode("utf-8", "replace"))


def text_token(path: int, text: str) -> int:
    """Token of a text node: its path and text."""
    plain = " ".join(entities.unescape(text).split())
    return digest(b"=" + path.to_bytes(8, "big", signed=True) + plain.encode("utf-8", "replace"))


class Page:
    """Text nodes (path, text, block, noise, content kind, in a link, place) and opening tags (path, place) of a page."""

    def __init__(self, source: str):
        self.nodes: list[tuple[int, str, int, bool, int, bool, int]] = []
        self.tags: list[tuple[int, int]] = []
        self.up: dict[int, int] = {}
        self.kinds: dict[int, int] = {}
        stack: list[tuple[str, int, bool, int, bool, bool]] = []  # tag, path, noise, content kind, link, inside an article
        opened, flat = Counter(), Counter()  # open elements by tag; those too deep for the stack
        block, at, end, place, piece = 0, 0, len(source), 0, PIECE
        last = source.rfind(">")

        def pop(tags, scopes=frozenset()):
            if not any(opened[t] for t in tags):
                return
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in tags:
                    for e in stack[k:]:
                        opened[e[0]] -= 1
                    del stack[k:]
                    return
                if stack[k][0] in scopes:
                    return

        def add(text):
            _, path, noise, kind, link, _ = stack[-1] if stack else ("", 0, False, 0, False, False)
            self.nodes.append((path, text, block, noise, kind, link, place))

        while at < end:
            if at > last:  # no tag is finished any more
                add(source[at:].split("<!--", 1)[0])
                break
            m = piece.match(source, at)
            if m[0] == "<" and piece is PIECE and OPENS.match(source, at):
                piece = PLAIN
                m = piece.match(source, at)
            at = m.end()
            place += 1
            tag = m[2]
            if tag is None:
                if m[0][0] != "<" or len(m[0]) == 1:
                    add(m[0])
                continue
            tag = tag.lower()
            if m[1]:
                if tag not in INLINE:
                    block += 1
                if flat[tag]:
                    flat[tag] -= 1
                else:
                    pop({tag})
                continue
            if tag in RAW or (tag == "title" and not opened["svg"]):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
                at = stop.end() if stop else end
                continue
            if tag not in INLINE:
                block += 1
                if tag in BREAKS_P:
                    pop({"p"}, SCOPES)
            if tag in CLOSES and tag != "p":
                pop(CLOSES[tag], SCOPES)
            if tag in VOID:
                if stack and tag in ("br", "hr", "img", "wbr"):
                    add(" ")
                continue
            if len(stack) >= DEPTH:
                flat[tag] += 1
                continue
            names = names_of(m[3]) if m[3] else []
            _, path, noise, kind, link, inside = stack[-1] if stack else ("", 0, False, 0, False, False)
            noise = noise or is_noise(tag, names, inside)
            if not noise:
                kind = 2 if tag in ("article", "main") else max(kind, 1) if any(n in CONTENT for n in names) else kind
            path, above = child(path, tag + "".join(f".{n}" for n in sorted(names))), path
            self.up[path], self.kinds[path] = above, kind
            self.tags.append((path, place))
            stack.append((tag, path, noise, kind, link or tag == "a", inside or tag == "article"))
            opened[tag] += 1

    def above(self, path: int):
        """The path and its ancestors."""
        while path:
            yield path
            path = self.up[path]

    def tokens(self) -> list[tuple]:
        """Rows of ``TOKEN``: every distinct token with its count, places and the characters it holds.

        Characters are those outside of noise; those of a tag lie anywhere in its elements.
        """
        rows: dict[int, list] = {}

        def count(key, parent, at, kind, tag):
            r = rows.get(key)
            if r is None:
                rows[key] = r = [key, parent, 0, at, at, 0, 0, kind, tag]
            r[2] += 1
            r[4] = at
            return r

        for path, at in self.tags:
            count(path, self.up[path], at, self.kinds[path], True)
        held: dict[int, list[int]] = {}
        for path, text, _, noise, kind, link, at in self.nodes:
            size = len(text.strip())
            if not size:
                continue
            r = count(text_token(path, text), path, at, kind, False)
            if not noise:
                r[5] += size
                r[6] += size * link
                own = held.setdefault(path, [0, 0])
                own[0] += size
                own[1] += size * link
        whole = [0, 0]
        for path, (size, linked) in held.items():
            whole[0] += size
            whole[1] += linked
            for p in self.above(path):
                rows[p][5] += size
                rows[p][6] += linked
        rows[0] = [0, 0, 1, -1, -1, whole[0], whole[1], 0, True]  # the page itself
        return [tuple(r) for r in rows.values()]

    def main_text(self, menus=frozenset(), template=frozenset(), trusted: bool = True) -> str:
        """Text of the slots: ``menus`` are elements and ``template`` texts of the template, ``trusted`` tells whether content elements count."""
        kind = max((n[4] for n in self.nodes if not n[3] and not n[1].isspace()), default=0) if trusted else 0
        blocks: dict[int, list[str]] = {}
        for path, text, block, noise, own, *_ in self.nodes:
            if noise or own < kind:
                continue
            if not kind and (any(p in menus for p in self.above(path)) or template and not text.isspace() and text_token(path, text) in template):
                continue
            blocks.setdefault(block, []).append(text)
        lines = (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values())
        return "\n".join(x for x in lines if x)


def host_of(url: str):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def page_tokens(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, page hash, tokens) of every distinct page that has a host and any text or tag."""
    src = pages.select(host_of(url).alias("host"), F.xxhash64(html).alias("page"), F.col(html).alias("html")).where("host <> '' AND html <> ''")
    fields = pa.list_(pa.struct([("token", pa.int64()), ("parent", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32()),
                                 ("chars", pa.int64()), ("linked", pa.int64()), ("kind", pa.int32()), ("tag", pa.bool_())]))
    keys = [f.name for f in fields.value_type]

    def rows(batches):
        for batch in batches:
            out = [[dict(zip(keys, r)) for r in Page(source).tokens()] for source in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, fields)], names=["host", "page", "tokens"])

    return src.mapInArrow(rows, f"host string, page long, tokens array<struct<{TOKEN}>>").groupBy("host", "page").agg(F.first("tokens").alias("tokens"))


def frequent_tokens(parsed: DataFrame) -> DataFrame:
    """(host, token, ..., vector, support, pages) of every token on enough pages of its host."""
    once = parsed.select("host", "page", F.inline("tokens"))
    vectors = once.groupBy("host", "token").agg(
        F.sum(F.xxhash64("page", "n").cast("decimal(38,0)")).alias("vector"), F.count(F.lit(1)).alias("support"), F.avg("first").alias("place"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"), F.max("kind").alias("kind"), F.min("parent").alias("parent"),
        F.min("tag").alias("tag"))
    # a token of one page is never frequent; the page itself is token 0, so its support is the number of pages
    vectors = vectors.where((F.col("support") >= min(LEAST_PAGES * SUPPORT, 2)) | (F.col("token") == 0))
    sizes = vectors.where("token = 0").select("host", F.col("support").alias("pages")).where(F.col("pages") >= LEAST_PAGES)
    return vectors.join(sizes, "host").where(F.col("support") >= SUPPORT * F.col("pages"))


def candidate_classes(frequent: DataFrame) -> DataFrame:
    """(host, class, root, tokens in their order) of every equivalence class that is large enough; the root has the largest support."""
    classes = frequent.where("token <> 0").groupBy("host", "vector", "support").agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("t")).where(F.size("t") >= CLASS_SIZE)
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("support"), F.desc(F.size("t")), "vector"))
    return classes.select("host", rank.alias("class"), (rank == 1).alias("root"), "support", F.col("t.token").alias("tokens"))


def structure(places: dict[int, tuple[int, int]], classes: list[tuple[int, list[int]]]) -> list[tuple[int, bool, int]]:
    """(class, in order, slot of the root class that holds it, -1 if it is not in one slot) of the classes on a page, the root first.

    ``places`` has the first and last place of every token of the page.
    """
    out, root = [], []
    for k, (key, tokens) in enumerate(classes):
        at = [places[t] for t in tokens if t in places]
        if len(at) < len(tokens):  # tokens of a class share their pages
            continue
        ordered = all(a[0] < b[0] and a[1] < b[1] for a, b in zip(at, at[1:]))
        if k == 0:
            root = at
            out.append((key, ordered, 0))
            continue
        if not root:
            continue
        low, high = min(a[0] for a in at), max(a[1] for a in at)
        slots = {sum(r[0] < x for r in root) for x in (low, high)}
        out.append((key, ordered, slots.pop() if len(slots) == 1 else -1))
    return out


def valid_classes(parsed: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes whose tokens keep their order on every page and that nest in one slot of the root class; ``slot`` is added."""
    listed = classes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("class", "tokens"))).alias("classes"))
    places = parsed.select("host", F.transform("tokens", lambda t: F.struct(t["token"], t["first"], t["last"])).alias("t"))
    joined = places.join(listed, "host").select("host", "t", "classes")

    def rows(batches):
        for batch in batches:
            seen = set()
            known, classes = None, []
            for host, t, column in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if host != known:
                    known, classes = host, [(c["class"], c["tokens"]) for c in column.as_py()]
                key, first, last = (t.values.field(k).to_pylist() for k in range(3))
                seen.update((host, *found) for found in structure(dict(zip(key, zip(first, last))), classes))
            out = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int32()),
                                              pa.array([r[2] for r in out], pa.bool_()), pa.array([r[3] for r in out], pa.int32())],
                                             names=["host", "class", "ordered", "slot"])

    found = joined.mapInArrow(rows, "host string, class int, ordered boolean, slot int").groupBy("host", "class").agg(
        F.min("ordered").alias("ordered"), F.min("slot").alias("slot"), F.max("slot").alias("high"))
    good = classes.join(found.where("ordered AND slot >= 0 AND slot = high").select("host", "class", "slot"), ["host", "class"])
    # without a valid root nothing is nested
    return good.join(good.where("root").select("host"), "host", "left_semi")


def template_parts(frequent: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, menus, template, trusted) of every host with a template; see :meth:`Page.main_text`."""
    tokens = classes.select("host", "root", F.explode("tokens").alias("token"))
    f = frequent.join(tokens, ["host", "token"], "left").withColumn("in_template", F.col("root").isNotNull())
    over = f.where("tag").select("host", F.col("token").alias("parent"), F.col("kind").alias("kind_above"))
    f = f.join(over, ["host", "parent"], "left")
    top = F.col("tag") & (F.col("kind") > 0) & (F.coalesce("kind_above", F.lit(0)) == 0) & (F.col("token") != 0)
    menu = F.col("in_template") & F.col("tag") & (F.col("kind") == 0) & (F.col("chars") > 0) & (F.col("linked") >= HALF * F.col("chars"))
    text = F.col("in_template") & ~F.col("tag")
    slots = F.col("chars") - F.col("linked")
    sums = f.groupBy("host").agg(
        F.collect_set(F.when(menu, F.col("token"))).alias("menus"), F.collect_set(F.when(text, F.col("token"))).alias("template"),
        F.max("in_template").alias("any"), F.sum(F.when(top, slots).otherwise(0)).alias("content"),
        F.sum(F.when(text & (F.col("kind") == 0), slots).otherwise(0)).alias("fixed"), F.max(F.when(F.col("token") == 0, slots)).alias("whole"))
    return sums.where("any").select("host", "menus", "template", (F.col("content") >= HALF * (F.col("whole") - F.col("fixed"))).alias("trusted"))


def templates(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(host, class, root, support, tokens, slot) of every valid class: ``slot`` tells between which tokens of the root class it lies."""
    parsed = materialize(page_tokens(pages, url=url, html=html), "page-tokens")
    return valid_classes(parsed, materialize(candidate_classes(frequent_tokens(parsed)), "classes"))


def extract(pages: DataFrame, *, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    arrow_batches(pages.sparkSession, 500)
    parsed = materialize(page_tokens(pages, url=url, html=html), "page-tokens")
    frequent = materialize(frequent_tokens(parsed), "frequent")
    # written: Spark then knows their sizes and moves the pages only if they are too large to send
    classes = materialize(candidate_classes(frequent), "classes")
    fixed = materialize(template_parts(frequent, valid_classes(parsed, classes)), "templates")
    src = pages.select(F.col(page).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).withColumn("host", host_of("url"))
    joined = src.join(fixed, "host", "left").select("page_id", "url", "html", "host", "menus", "template", "trusted")
    schema = T.StructType([T.StructField("page_id", pages.schema[page].dataType), T.StructField("url", pages.schema[url].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def rows(batches):
        known, parts = None, ()
        for batch in batches:
            out = []
            for k, (source, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if host != known:
                    known = host
                    menus, texts, trusted = (batch.column(c)[k].as_py() for c in range(4, 7))
                    parts = (frozenset(menus or ()), frozenset(texts or ()), trusted is not False)
                out.append(Page(source or "").main_text(*parts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(rows, schema)
