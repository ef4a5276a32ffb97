"""HTML extraction (operator 4): template deduction from equivalence classes of same-host pages.

A page is read as tokens: start tags, told apart by the path of containers they open (with classes and ids), and text
blocks, told apart by their container and text.  Tokens of one host with the same occurrence vector (how often on
which page) form an equivalence class.  The vector is kept as a commutative sum of page hashes, so classes come from
one map-side combined aggregation and a hot host is no hot task.  Classes that cover enough pages are valid; nested
by their paths they are the host's template.  Its slots are what stands between a class's tokens:

* the main slot is the innermost container of a class, once on a page, that holds at least MAIN_SHARE of the text that is
  neither in links nor in menus and the like;
* inside it, containers of a class whose text is mostly links are left out;
* a text that belongs to the class of its own container (wherever the container is, it holds this text) is part of the
  template, not of a slot; outside an article also a text that TEXT_SHARE of the pages repeat.

Element names and roles say what menus, headers, footers, side bars and forms are; class names are used where no
template is known, and whole names of containers (reader comments, adverts, notices, side bars) inside an article.  A host with fewer than
LEAST_PAGES pages uses the template of all pages together.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import store
from opinara.llm.url_filter import host_column, host_of

#: A class is valid on this share of the host's pages; a text outside articles is template text on this share.
VALID_SHARE, TEXT_SHARE, LEAST_PAGES = 0.3, 0.5, 4
#: Share of a host's running text that the main slot holds; share of links from which a container is a list of links.
MAIN_SHARE, LINK_SHARE = 0.5, 0.6
#: Pages from which a text in the class of its container is template text even in an article.
LEAST_FIXED = 8

# Element names of HTML by their role.
_BLOCKS = frozenset("html body nav header footer aside div section article main ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend h1 h2 h3 h4 h5 h6 p pre blockquote figure figcaption address hr details summary dialog center".split())
_CONTAINERS = frozenset("body div section article main td center".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_ENDS_P = _BLOCKS - {"html", "body"}
_SPACING = frozenset({"br", "wbr", "img", "td", "th"})
_RAW = frozenset("script style title textarea".split())
_SKIPPED = frozenset("noscript template svg iframe object select button head".split())
_BOILER_TAGS = frozenset("nav footer aside form menu dialog".split())
_MAIN_TAGS = frozenset({"article", "main"})
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_MAIN_NAMES = frozenset("articlebody article-body post-content entry-content article-content main-content story-body".split())
# Class names that speak of other blocks, by any of their parts, outside articles.
_BOILER_NAMES = frozenset(
    "ad ads advert advertisement adverts adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay menu navigation navbar nav topnav breadcrumb breadcrumbs "
    "sidebar side-bar rail widget widgets footer foot copyright legal header masthead topbar comment comments reply replies disqus respond share sharing social related recommended newsletter subscribe signup login search".split()
)
# Whole class names of containers and lists that are no part of an article although they stand in it.
_FOREIGN_NAMES = frozenset(
    "comments comment-list commentlist comment-section reader-comments user-comments disqus_thread ad ads advert adverts advertisement adsbygoogle sponsored promo notice notices cookie-notice cookie-banner cookie-consent popup "
    "sidebar side-bar menu navbar breadcrumb breadcrumbs share social-share sharing related related-posts newsletter newsletter-signup subscribe".split()
)
_FOREIGN_TAGS = _CONTAINERS | {"ul", "ol", "dl", "table"}

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _markup(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """``(begin, end, tag, closing, attributes)`` of every piece of markup, in one pass; comments have no tag.

    A quotation mark counts after ``=`` only, and only where it is closed; elements without text of their own end
    behind their closing tag, an unclosed one at its start tag (scripts and the like: at the end of the page).
    """
    at, n = 0, len(source)
    never: set[str] = set()  # what was looked for in vain stands nowhere further on

    def find(what: str, start: int) -> int:
        if what in never:
            return -1
        found = source.find(what, start)
        if found < 0:
            never.add(what)
        return found

    def closing_tag(name: str, start: int) -> int:
        if name in never:
            return -1
        found = re.compile(rf"</{name}(?=[\s>/])[^>]*>", re.I).search(source, start)
        if found is None:
            never.add(name)
            return -1
        return found.end()

    while (begin := source.find("<", at)) >= 0:
        if source.startswith("<!--", begin):
            end = find("-->", begin + 4)
            at = n if end < 0 else end + 3
            yield begin, at, "", False, ""
            continue
        closing = source.startswith("/", begin + 1)
        name = _NAME.match(source, begin + 1 + closing)
        if name is None:
            if source[begin + 1 : begin + 2] in ("!", "?", "/"):
                end = find(">", begin)
                at = n if end < 0 else end + 1
                yield begin, at, "", False, ""
            else:  # a plain "<"
                at = begin + 1
            continue
        tag, end = name[0].lower(), name.end()
        while True:
            stop = _STOP.search(source, end)
            if stop is None:
                end = n
                break
            end = stop.end()
            if stop[0] == ">":
                break
            before = stop.start() - 1
            while before >= name.end() and source[before].isspace():
                before -= 1
            if source[before] == "=":
                close = find(stop[0], end)
                if close >= 0:
                    end = close + 1
        at = end
        if not closing and (tag in _RAW or tag in _SKIPPED):
            after = closing_tag(tag, end)
            at = after if after >= 0 else n if tag in _RAW else end
        yield begin, at, tag, closing, source[name.end() : end]


def _names(attributes: str) -> list[tuple[str, str]]:
    out = []
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        out += [(key.lower(), name) for name in entities.unescape(a or b or c).lower().split()]
    return out


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Kind:
    """What a start tag is, by its name and attributes alone."""

    __slots__ = ("label", "boiler", "named", "foreign", "main")

    def __init__(self, tag: str, attributes: str):
        self.label, self.boiler, self.named, self.foreign, self.main = tag, tag in _BOILER_TAGS, False, False, tag in _MAIN_TAGS
        for key, name in _names(attributes) if "=" in attributes else ():
            self.label += f"{'.' if key == 'class' else '#' if key == 'id' else '@'}{re.sub(r'[0-9]+', '0', name)}"
            if key == "role":
                self.boiler, self.main = self.boiler or name in _BOILER_ROLES, self.main or name == "main"
            elif name in _MAIN_NAMES:
                self.main = True
            else:
                self.named |= tag not in ("html", "body") and not {name, *re.split(r"[-_]+", name)}.isdisjoint(_BOILER_NAMES)
                self.foreign |= tag in _FOREIGN_TAGS and name in _FOREIGN_NAMES


class _Node:
    """An open container."""

    __slots__ = ("tag", "key", "parent", "kind", "out", "main", "slot", "article", "chars", "links")

    def __init__(self, tag: str, key: int, parent: _Node | None, kind: _Kind, template: Template):
        self.tag, self.key, self.parent, self.kind = tag, key, parent, kind
        self.chars = self.links = 0
        in_article = parent is not None and parent.article
        self.article = in_article or kind.main
        # the header of an article belongs to it, that of the page does not
        foreign = kind.boiler or kind.foreign or (tag == "header" and not in_article) or (kind.named and not self.article and key not in template.members)
        self.out = (parent is not None and parent.out) or foreign or key in template.lists
        self.main = (parent is not None and parent.main) or key in template.main
        self.slot = parent is not None and parent.slot or (kind.main and not self.out)


class Template:
    """A host's template: its classes, and what they say about slots."""

    def __init__(self, told: dict | None = None):
        self.classes = (told or {}).get("classes", [])
        join = lambda name: frozenset(k for c in self.classes for k in c.get(name, ()))
        self.members, self.main, self.lists, self.texts = join("tags"), join("main"), join("lists"), join("texts")


_ROOT = _hash("root")
_KINDS: dict[tuple[str, str], _Kind] = {}
_KEYS: dict[tuple[int, str], int] = {}


def _kind(tag: str, attributes: str) -> _Kind:
    if len(attributes) > 200 or "=" not in attributes:
        return _Kind(tag, attributes)
    if (got := _KINDS.get((tag, attributes))) is None:
        if len(_KINDS) > 20_000:
            _KINDS.clear()
        got = _KINDS[tag, attributes] = _Kind(tag, attributes)
    return got


def _key(parent: int, label: str) -> int:
    if (got := _KEYS.get((parent, label))) is None:
        if len(_KEYS) > 50_000:
            _KEYS.clear()
        got = _KEYS[parent, label] = _hash(parent, label)
    return got


def read_page(page: str | None, template: Template) -> Iterator[tuple[_Node | None, str | None, int]]:
    """A page's tokens in order: ``(container, text, characters in links)``; text is None where a container opens.

    White space inside a block is one space.  Time and memory grow with the page's length, whatever its markup.
    """
    source = page or ""
    stack: list[_Node] = []
    open_tags: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    links, in_link, at = 0, False, 0

    def flush() -> tuple[_Node | None, str, int] | None:
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split()) if parts else ""
        parts.clear()
        n, links = min(links, len(text)), 0
        return (stack[-1] if stack else None, text, n) if text else None

    def pop() -> None:
        node = stack.pop()
        open_tags[node.tag] -= 1
        if node.parent is not None and not node.out:
            node.parent.chars += node.chars
            node.parent.links += node.links

    for begin, end, tag, closing, attributes in _markup(source):
        if begin > at:
            parts.append(source[at:begin])
            links += (begin - at) if in_link else 0
        at = end
        if tag == "a":
            in_link = not closing
        if tag in _SPACING:
            parts.append(" ")
        if tag not in _BLOCKS:
            continue
        if block := flush():
            yield block
        if closing:
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    pop()
                pop()
        elif tag not in _VOID:
            in_link = False
            if stack and ((tag in _ENDS_P and stack[-1].tag == "p") or (tag == "li" and stack[-1].tag == "li")):
                pop()
            kind = _kind(tag, attributes)
            parent = stack[-1] if stack else None
            node = _Node(tag, _key(parent.key if parent else _ROOT, kind.label), parent, kind, template)
            stack.append(node)
            open_tags[tag] += 1
            yield node, None, 0
    parts.append(source[at:])
    if block := flush():
        yield block
    while stack:
        pop()


def text_key(container: int, text: str) -> int:
    return _hash("text", container, text)


_STATS = "host string, kind string, key long, parent long, vector long, pages long, most long, chars long, links long, depth long, container boolean, main boolean, out boolean, heading boolean"
_NAMES = [c.split()[0] for c in _STATS.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[c.split()[1]] for c in _STATS.split(", ")]


def page_tokens(page: str | None) -> dict[tuple[str, int], list]:
    """Tokens of one page: ``(kind, key) -> [times, parent, chars, links, depth, container, main, out, heading]``."""
    seen: dict[tuple[str, int], list] = {}
    nodes: list[tuple[_Node, list]] = []
    depths: dict[int, int] = {}
    for node, text, links in read_page(page, Template()):
        if node is None:
            continue
        if text is None:
            depths[node.key] = depth = depths.get(node.parent.key, 0) + 1 if node.parent else 1
            row = seen.setdefault(("tag", node.key), [0, node.parent.key if node.parent else _ROOT, 0, 0, depth, node.tag in _CONTAINERS, node.kind.main, node.out, False])
            row[0] += 1
            nodes.append((node, row))
        else:
            node.chars += len(text)
            node.links += links
            row = seen.setdefault(("text", text_key(node.key, text)), [0, node.key, 0, 0, 0, False, node.article, node.out, node.tag in ("h1", "h2", "h3", "h4", "h5", "h6")])
            row[0] += 1
    for node, row in nodes:  # sums over whole containers are known now
        row[2] += node.chars
        row[3] += node.links
    return seen


def _stat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: tokens of each host with their part of the occurrence vector (sums wrap at 64 bits)."""
    for batch in batches:
        for first in range(0, batch.num_rows, 256):
            part = batch.slice(first, 256)
            rows: dict[tuple, list] = {}
            for page_id, url, page in zip(*(part.column(c).to_pylist() for c in range(3)), strict=True):
                host = host_of(url)
                seen = page_tokens(page)
                seen["page", 0] = [1, 0, 0, 0, 0, False, False, False, False]
                seen["copy", _hash(page or "")] = [1, 0, 0, 0, 0, False, False, False, False]
                once = _hash(page_id, 1)
                for (kind, key), (times, parent, chars, links, depth, *marks) in seen.items():
                    row = rows.setdefault((host, kind, key), [parent, 0, 0, 0, 0, 0, depth, *marks])
                    row[1] += once if times == 1 else _hash(page_id, times)
                    row[2] += 1
                    row[3] = max(row[3], times)
                    row[4] += chars
                    row[5] += links
            columns = defaultdict(list)
            for (host, kind, key), (parent, vector, *rest) in rows.items():
                vector = (vector + (1 << 63)) % (1 << 64) - (1 << 63)
                for name, value in zip(_NAMES, (host, kind, key, parent, vector, *rest), strict=True):
                    columns[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], t) for n, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def deduce(rows: list[dict]) -> dict:
    """The template of a host from its tokens that occur on at least VALID_SHARE of its pages.

    ``classes``: equivalence classes, outermost first, with the path keys of their containers (``tags``), the class they
    stand in (``within``), and what their slots are: ``main``, ``lists`` (of links) and fixed ``texts``.
    """
    pages = next((r["pages"] for r in rows if r["kind"] == "page"), 0)
    copied = any(r["kind"] == "copy" for r in rows)  # one page makes up a good part of the host
    tags = {r["key"]: r for r in rows if r["kind"] == "tag"}
    groups: dict[tuple, list[dict]] = defaultdict(list)
    for r in rows:
        if r["kind"] in ("tag", "text"):
            groups[r["pages"], r["vector"]].append(r)
    order = sorted(tags.values(), key=lambda r: (r["depth"], r["key"]))

    # the main slot: the innermost container, once on a page, with most of the running text
    running = lambda r: r["chars"] - r["links"]
    whole = max((running(r) for r in order if not r["out"]), default=0)
    fit = [r for r in order if r["container"] and not r["out"] and r["most"] == 1 and running(r) > 0 and running(r) >= MAIN_SHARE * whole]
    main = (([r for r in fit if r["main"]] or fit)[-1:] or [None])[0]
    inside: set[int] = set()
    article: set[int] = set()
    for r in order:
        if main and (r["key"] == main["key"] or r["parent"] in inside):
            inside.add(r["key"])
        if r["main"] or r["parent"] in article:
            article.add(r["key"])

    class_of = {r["key"]: name for name, members in groups.items() for r in members if r["kind"] == "tag"}

    def fixed(r: dict) -> bool:
        if not copied and pages >= LEAST_FIXED and not r["heading"] and class_of.get(r["parent"]) == (r["pages"], r["vector"]):
            return True
        return pages >= LEAST_PAGES and r["pages"] >= TEXT_SHARE * pages and r["parent"] not in article and not r["main"]

    made = []
    for name, members in groups.items():
        own = sorted((r for r in members if r["kind"] == "tag"), key=lambda r: (r["depth"], r["key"]))
        lists = [r["key"] for r in own if r["key"] in inside and r is not main and r["container"] and 0 < LINK_SHARE * r["chars"] <= r["links"]]
        texts = [r["key"] for r in members if r["kind"] == "text" and fixed(r)]
        if own or texts:
            first = own[0] if own else None
            made.append({"name": name, "first": first, "tags": [r["key"] for r in own], "main": [main["key"]] if main in own else [], "lists": lists, "texts": texts})
    made.sort(key=lambda c: (c["first"]["depth"] if c["first"] else 1 << 30, c["name"]))
    number = {c["name"]: k for k, c in enumerate(made)}
    return {"pages": pages, "classes": [{"tags": c["tags"], "within": number.get(class_of.get(c["first"]["parent"])) if c["first"] else None, **{x: c[x] for x in ("main", "lists", "texts")}} for c in made]}


def extract(page: str | None, template: Template) -> str:
    """The main text of one page under its host's template: blocks joined by a newline."""
    in_main, in_article, rest = [], [], []
    for node, text, links in read_page(page, template):
        if text is None or (node is not None and (node.out or text_key(node.key, text) in template.texts)):
            continue
        if node is not None and node.main:
            in_main.append(text)
        if node is not None and node.slot:
            in_article.append(text)
        if links < len(text):
            rest.append(text)
    # a page that does not follow the template: its own article, else its body
    return "\n".join(in_main or in_article or rest)


def _template_batches(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    return pa.table({"host": pa.array([rows[0]["host"]], pa.string()), "template": pa.array([json.dumps(deduce(rows))], pa.string())})


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host string, template string (JSON)`` for every host with enough pages, and for ``*`` (all pages)."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    stats = rows.mapInArrow(store.trimmed(_stat_batches), _STATS)
    keys = ("host", "kind", "key")
    # sums of hashes may wrap: added as decimals, folded back to 64 bits
    total = lambda df: df.groupBy(*keys).agg(
        F.min("parent").alias("parent"),
        F.pmod(F.sum(F.col("vector").cast("decimal(38,0)")), F.expr("cast(9223372036854775807 AS decimal(38,0))")).cast("long").alias("vector"),
        F.sum("pages").alias("pages"),
        F.max("most").alias("most"),
        *(F.sum(c).alias(c) for c in ("chars", "links")),
        F.min("depth").alias("depth"),
        *(F.max(c).alias(c) for c in ("container", "main", "out", "heading")),
    )
    by_host = store.materialise(total(stats), "page-tokens")
    sizes = store.materialise(by_host.where("kind = 'page'").select(F.col("host").alias("h"), F.col("pages").alias("host_pages")), "host-sizes", thin=True)
    whole = sizes.agg(F.sum("host_pages")).first()[0] or 0
    everywhere = total(by_host.where("kind <> 'copy' OR pages > 1").withColumn("host", F.lit("*"))).where(F.col("pages") >= VALID_SHARE * whole)
    # a valid token of a host of LEAST_PAGES pages is on two of them: most tokens never reach the join
    own = by_host.where("pages > 1").join(sizes.where(F.col("host_pages") >= LEAST_PAGES), F.col("host") == F.col("h")).where(F.col("pages") >= F.lit(VALID_SHARE) * F.col("host_pages"))
    frequent = own.select(_NAMES).unionAll(everywhere.select(_NAMES))
    # a host keeps at most 1 / VALID_SHARE times the tokens of one page: small groups, whatever its size
    return frequent.groupBy("host").applyInArrow(_template_batches, "host string, template string")


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, Template] = {}
    for batch in batches:
        texts = []
        for page, told in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if told not in known:
                if len(known) > 1000:
                    known.clear()
                known[told] = Template(json.loads(told) if told else {})
            texts.append(extract(page, known[told]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id long, url string, text string, n_chars long`` of every row.

    Null and empty html give an empty text; null urls share the empty host; repeated rows give repeated rows;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = store.materialise(templates(pages, id_col, url_col, html_col), "templates")
    general = found.where("host = '*'").first()
    general = general["template"] if general else "{}"
    # Spark broadcasts the templates only below its size threshold; beyond it hot hosts are split by AQE
    joined = rows.withColumn("h", host_column(F.col("url"))).join(found.where("host <> '*'"), F.col("h") == F.col("host"), "left")
    return joined.select("page_id", "url", "html", F.coalesce("template", F.lit(general)).alias("template")).mapInArrow(store.trimmed(_extract_batches), "page_id long, url string, text string, n_chars long")
