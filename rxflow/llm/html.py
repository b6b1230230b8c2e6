"""Operator 4: main text of web pages by a site style tree.

The element trees of a host's pages are merged by path (tag, classes, role of each
ancestor). A path's presentation nodes are the sequences of child elements that pages show
there, its content nodes the texts below it. Their importance is the entropy of how pages
share them, with the number of the host's pages that have the path as base: 0 if all pages
show the same, 1 if each shows its own. A branch of importance under ``least`` on at
least ``pages`` pages is cut from each page of the host.

The blocks of an article are nodes of their own, by path and text, as siblings of a path are one node
otherwise. A block's importance is 1 - n log(n) / (m log(m)) for m different main texts of the host with blocks
of that path, n of them with this block. Main texts count as different for a block only if the longest of
their other blocks differ, so an article that a site prints often is not a notice. A page of which all blocks would be cut keeps them.

A tree can't tell varied boilerplate (rotating adverts, comments) from an article, nor an
article that a site prints twice from a notice; so elements whose tag, class or role names
what they are have a prior: those of menus, footers, adverts, forms and the like count as 0, and an
article's own paragraphs as 1. A class or id counts if all words of it are such names, and on containers also by one strong word (comments, sidebar, advert) unless
another tells that it is about the layout (has-sidebar); never on html or body; where names would leave a page without its article or main element, they don't count around it.
Article and main elements with text, and elements named as content, stand for the page; without such text all that is left does. Beside an article, what else they hold
of blocks that are mostly links and of list items goes.

Reading takes time in proportion to a page, also of broken markup, at any depth.

Defined cases: a null or empty html has an empty text; a page without a host is of the host
""; a null url stays null; unclosed elements end with their parent, unclosed quotes and comments with the page or the next tag end;
repeated rows are read each and count in the tree each; very long pages are read whole; other columns of the table are not read,
whatever their names; of equal importance all branches are cut or none; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxflow.llm.common import BROADCAST_ROWS, map_arrow, stored, table, texts, tune

#: Importance under which a branch is cut, and pages of a host that must have it.
LEAST, PAGES = 0.2, 8

_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
#: The rest of a tag up to its end or to a quote that is never closed.
_REST = re.compile(r"[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+")
#: A number too long to be read; it is no character.
_LONG_NUMBER = re.compile(r"&#[0-9]{4000,};?")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_HOST = re.compile(r"://([^/?#]*)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that a tag of the same group ends, unless an element of the second set stands between.
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tr td th figure figcaption article main b i em strong a span code".split())
#: Names of elements that hold a page's text.
_CONTENT = frozenset("content main-content article-content article-body post-content post-body entry-content story-body".split())
#: Elements that are text themselves; a single word of their names hides none.
_INLINE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead b i em strong a span code blockquote pre figure figcaption".split())
_NOISE_TAGS = frozenset("head nav footer aside form script style noscript template iframe button select textarea dialog svg canvas object menu title".split())
#: Words of classes and ids that are noise: a strong one by itself, a weak one if all words of the name are noise.
_STRONG = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions sidebar sidebars breadcrumb breadcrumbs "
    "cookie cookies gdpr newsletter newsletters share sharing related recommended recommendations comment comments commenting commenter disqus livefyre reply replies respond".split()
)
_WEAK = frozenset("banner menu nav navbar navigation footer header masthead consent notice notices alert alerts popup modal subscribe social widget widgets login signup search".split())
_NOISE_NAMES = _STRONG | _WEAK
#: With one of these, a name says how a page is laid out or what it allows, not what the element holds.
_LAYOUT = frozenset("has with no not without layout page site allow allows enabled disabled open closed count".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())


def host_of(url: str | None) -> str:
    m = _HOST.search(url or "")
    return m[1].lower() if m else ""


_BASE, _PRIME = 0x1B873593CC9E2D51, (1 << 61) - 1


class Element:
    __slots__ = ("article", "children", "content", "main", "named", "noise", "path", "start", "tag")

    def __init__(self, tag: str, path: int, noise: bool, main: bool, start: int, named: bool = False, article: bool = False, content: bool = False):
        self.tag, self.path, self.noise, self.main, self.start = tag, path, noise, main, start
        self.article, self.content = article, content or main
        self.named = named  # noise by the names of elements outside of an article alone
        self.children: list[str] = []


def _named(attributes: str) -> tuple[str, str]:
    """Classes and id, and the role."""
    names, role = "", ""
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        if key.lower() == "role":
            role = (a or b or c).strip().lower()
        else:
            names += " " + (a or b or c)
    return names, role


def _parts(name: str) -> list[str]:
    """The words of a class or id, also of one like userComments."""
    return [x.lower() for x in _NAME.findall(name)]


def _noisy(names: str, strong: bool) -> bool:
    """Whether a class or id has no other words than those of noise, or one strong word of it."""
    for name in names.split():
        parts = _parts(name)
        if parts and _NOISE_NAMES.issuperset(parts):
            return True
        if strong and not _STRONG.isdisjoint(parts) and _LAYOUT.isdisjoint(parts):
            return True
    return False


class Page:
    """One pass over a page: its elements' paths with styles and texts, and the blocks of its main text.

    low: paths that the style tree found to matter little on this host.
    """

    def __init__(self, source: str, low: frozenset[int] = frozenset(), measure: bool = False):
        self.measure, self.low = measure, low
        self.nodes: list[tuple[int, int, int]] = []  # path, style, content
        self.sums, self.powers = [0], [1]  # of the hashes of all text outside of raw elements, by which content is told
        self.blocks: dict[bool, list[str]] = {True: [], False: []}  # in an article or main element, and all
        self.paths: list[tuple[int, int]] = []  # path, and path with text, of those in an article or main element
        self.beside: list[bool] = []  # of those, which are links outside of the article elements
        self.open: list[str] = []
        self.linked = 0  # characters of the open block that are links
        self.has_article = self.has_text = False
        self.has_main = self.lost = False
        self._read(source)
        if self.lost and not self.has_main:  # names hid every article: they were not of what it holds
            found = self.nodes
            self.nodes, self.blocks, self.paths, self.beside = [], {True: [], False: []}, [], []
            self.sums, self.has_article, self.has_text = [0], False, False
            self._read(source, rescue=True)
            self.nodes = found

    def _say(self, text: str, noise: bool) -> None:
        if not noise:
            self.open.append(text)
            if self.places.get("a"):
                self.linked += len(text)
        if self.measure and (run := text.strip()):
            self.sums.append((self.sums[-1] * _BASE + xxhash.xxh3_64_intdigest(run.encode())) % _PRIME)

    def _content(self, start: int) -> int:
        """A hash of all text since a place."""
        n = len(self.sums) - 1 - start
        while len(self.powers) <= n:
            self.powers.append(self.powers[-1] * _BASE % _PRIME)
        return (self.sums[-1] - self.sums[start] * self.powers[n]) % _PRIME

    def _flush(self, e: Element) -> None:
        """Ends the open block, which stands in an element."""
        if self.open:
            text = "".join(self.open)
            links, self.linked = 2 * self.linked > len(text), 0
            if "&#" in text and len(text) > 4000:
                text = _LONG_NUMBER.sub("\ufffd", text)
            text = _SPACE.sub(" ", html.unescape(text)).strip()
            self.open = []
            if text:
                self.blocks[False].append(text)
                if e.content:
                    self.blocks[True].append(text)
                    self.beside.append(not e.article and (links or e.tag == "li"))
                    self.has_article, self.has_text = self.has_article or e.article, self.has_text or e.main
                    self.paths.append((e.path, xxhash.xxh3_64_intdigest(f"{e.path} {text}".encode()) >> 1))

    def _close(self, size: int) -> None:
        stack = self.stack
        while len(stack) > size:
            e = stack.pop()
            self.places[e.tag].pop()
            if e.tag in _BLOCK:
                self.around.pop()
                if not e.noise:
                    self._flush(e)
            if self.measure:
                self.nodes.append((e.path, xxhash.xxh3_64_intdigest(",".join(e.children).encode()), self._content(e.start)))

    def _push(self, e: Element) -> None:
        if e.tag in _BLOCK:
            self.around.append(len(self.stack))
        self.places.setdefault(e.tag, []).append(len(self.stack))
        self.stack.append(e)

    def _last(self, tags: frozenset[str]) -> int:
        """Where in the stack the last element of some tags is; 0 if there is none."""
        return max([at[-1] for t in tags if (at := self.places.get(t))], default=0)

    def _tags(self, source: str) -> Iterator[tuple[str, str, bool, str, int]]:
        """The text before each tag, the tag, whether it ends an element, its attributes and where it ends; at last the text left.

        What is sent back says where to go on.
        """
        begin, at, n = 0, 0, len(source)
        while (lt := source.find("<", at)) >= 0:
            m = _TAG.match(source, lt)
            if m:
                first = m.end()
                end = _REST.match(source, first).end()
                while end < n and source[end] != ">":  # at the last quote of its kind, which is no quote then
                    end = _REST.match(source, end + 1).end()
                begin = at = (yield source[begin:lt], m[2].lower(), bool(m[1]), source[first:end], min(end + 1, n)) or min(end + 1, n)
            elif source.startswith(("<!", "<?"), lt):
                mark = "-->" if source.startswith("<!--", lt) else ">"
                end = source.find(mark, lt + 2 * len(mark) - 2)
                yield source[begin:lt], "", False, "", 0
                begin = at = n if end < 0 else end + len(mark)
            else:
                at = lt + 1
        yield source[begin:], "", False, "", n

    def _read(self, source: str, rescue: bool = False) -> None:
        root = Element("", 0, False, False, 0)
        self.stack: list[Element] = [root]
        self.places: dict[str, list[int]] = {"": [0]}
        self.around: list[int] = []
        stack, n, go = self.stack, len(source), None
        tags = self._tags(source)
        while True:
            try:
                text, tag, ends, attributes, at = tags.send(go)
            except StopIteration:
                break
            go = None
            top = stack[-1]
            if text:
                self._say(text, top.noise)
            if not tag:
                continue
            if ends:
                if place := self._last(frozenset([tag])):
                    self._close(place)
                continue
            if tag == "br":
                if not top.noise:
                    self.open.append("\n")
                continue
            if tag in _ENDS:
                same, wall = _ENDS[tag]
                if (place := self._last(same)) > self._last(wall):
                    self._close(place)
            elif tag in _BLOCK and self.around and stack[self.around[-1]].tag == "p":
                self._close(self.around[-1])
            top = stack[-1]
            top.children.append(tag)
            if tag in _VOID:
                if tag == "hr" and not top.noise:
                    self._flush(top)
                continue
            names, role = _named(attributes) if "=" in attributes else ("", "")
            path = xxhash.xxh3_64_intdigest(f"{top.path} {tag}{names.lower()}/{role}".encode()) >> 1
            is_main = tag in ("article", "main") or role in ("main", "article")
            hidden = top.named and is_main
            self.lost = self.lost or hidden
            kept = top.noise and not (hidden and rescue)
            part = not _NOISE_NAMES.isdisjoint(_parts(names))
            own = tag in _NOISE_TAGS or role in _NOISE_ROLES or (tag == "header" and not top.main)
            own = own or (path in self.low and not is_main and (part or not (top.main and tag in _PLAIN)))
            noise, named = kept or own, kept and top.named and not own
            if not noise and not is_main and tag not in ("html", "body") and _noisy(names, tag not in _INLINE):
                noise, named = True, not top.main
            if tag in _BLOCK and not top.noise:
                self._flush(top)
            main = (top.main or is_main) and not noise
            self.has_main = self.has_main or main
            if attributes.endswith("/") and tag not in _BLOCK:
                continue
            article = main and (top.article or tag == "article" or role == "article")
            content = not noise and (top.content or not _CONTENT.isdisjoint(names.lower().split()))
            self._push(Element(tag, path, noise, main, len(self.sums) - 1, named, article, content))
            if tag in _RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                go = end.end() if end else n
                self._close(len(stack) - 1)
        self._close(1)
        self._flush(root)

    @property
    def text(self) -> str:
        if not self.has_text:
            return "\n\n".join(self.blocks[False])
        rows = [(b, key) for b, (_, key), aside in zip(self.blocks[True], self.paths, self.beside) if not (aside and self.has_article)]
        return "\n\n".join([b for b, key in rows if key not in self.low] or [b for b, _ in rows])


def _marks(page: Page) -> Iterator[tuple[int, int, int]]:
    """``path, block, other``: each block of an article (-1: any) with a mark of the main text around it."""
    if not page.has_main:
        return
    of = {key: text for (_, key), text in zip(page.paths, page.blocks[True])}
    long = sorted(set(of.values()), key=lambda x: (-len(x), x))[:2]
    marks = [xxhash.xxh3_64_intdigest(x.encode()) >> 1 for x in long]
    whole = xxhash.xxh3_64_intdigest("\n".join(page.blocks[True]).encode()) >> 1
    for path, key in page.paths:
        yield path, -1, whole
        if len(long) > 1:
            yield path, key, marks[of[key] == long[0]]


def style_tree(pages: DataFrame) -> DataFrame:
    """``host, path, kind, pages, importance`` of the presentation (0) and content (1) nodes of every path, and of the blocks
    of articles (2), whose path is that of their element with their text. Stored."""
    tune(pages.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for url, source in zip(batch["url"].to_pylist(), texts(batch["html"])):
            host = host_of(url)
            once: dict[int, tuple[int, int]] = {}
            page = Page(source, measure=True)
            for path, style, content in page.nodes:  # a path's elements on a page are one node
                s, c = once.get(path, (0, 0))
                once[path] = (s * 31 + style) % 2**63, (c * 31 + content) % 2**63
            for path, (style, content) in once.items():
                seen[host, path, 0, 0, style] += 1
                seen[host, path, 1, 0, content] += 1
            for path, block, other in set(_marks(page)):
                seen[host, path, 2, block, other] = 1
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        cols = [pa.array(x, k) for x, k in zip(zip(*seen), kinds)] if seen else [pa.array([], k) for k in kinds]
        return pa.record_batch([*cols, pa.array(list(seen.values()), pa.int64())], ["host", "path", "kind", "block", "value", "n"])

    rows = map_arrow(pages.select("url", "html"), run, "host string, path long, kind int, block long, value long, n long")
    each = rows.groupBy("host", "path", "kind", "block", "value").agg(F.sum("n").alias("n"))
    logs = F.sum(F.col("n") * F.log(F.col("n").cast("double")))
    sums = stored(each.groupBy("host", "path", "kind", "block").agg(F.sum("n").alias("pages"), logs.alias("s"), F.count("*").alias("others")))
    m = F.col("pages").cast("double")
    nodes = sums.where("kind < 2").select("host", "path", "kind", "pages", F.when(F.col("pages") > 1, (F.log(m) - F.col("s") / m) / F.log(m)).otherwise(1.0).alias("importance"))
    every = sums.where("kind = 2 AND block = -1").select("host", "path", F.col("others").cast("double").alias("m"))
    n, m = F.col("others").cast("double"), F.col("m")
    blocks = sums.where("kind = 2 AND block <> -1 AND others > 1").join(every, ["host", "path"])
    blocks = blocks.select("host", F.col("block").alias("path"), "kind", F.col("others").alias("pages"), (1 - n * F.log(n) / (m * F.log(m))).alias("importance"))
    return stored(nodes.unionByName(blocks))


def low_paths(tree: DataFrame, least: float = LEAST, pages: int = PAGES) -> DataFrame:
    """``host, path`` of the branches to cut, of which neither presentation nor content matters, and of the blocks to cut."""
    both = tree.groupBy("host", "path").agg(F.max("importance").alias("importance"), F.max("pages").alias("pages"))
    return both.where((F.col("pages") >= pages) & (F.col("importance") < least)).select("host", "path")


def extract(pages: DataFrame, least: float = LEAST, min_pages: int = PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    spark = pages.sparkSession
    tune(spark)
    low = stored(low_paths(style_tree(pages), least, min_pages))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    if low.count() <= BROADCAST_ROWS:
        sets: dict[str, set[int]] = {}
        for r in low.toLocalIterator():
            sets.setdefault(r["host"], set()).add(r["path"])
        sent = spark.sparkContext.broadcast({host: frozenset(paths) for host, paths in sets.items()})
        rows = rows.withColumn("low", F.lit(None).cast("array<long>"))
    else:  # a host may hold a third of all pages, so each list goes to as many places
        sent = spark.sparkContext.broadcast({})
        salts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
        lists = low.groupBy("host").agg(F.collect_list("path").alias("low")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(lists, ["host", "salt"], "left")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for url, source, low in zip(batch["url"].to_pylist(), texts(batch["html"]), batch["low"]):
            held = frozenset(low.as_py()) if low.is_valid else sent.value.get(host_of(url), frozenset())
            out.append(Page(source, held).text)
        return pa.record_batch(
            [batch["page_id"], batch["url"], pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )

    return map_arrow(rows.select("page_id", "url", "html", "low"), run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
