"""Main text of web pages by site style trees.

The pages of a host are merged into a tree of style nodes (the path of tags and classes).  A node's presentation is the
sequence of child tags it shows on each page, its content the text blocks right below it.  Both are measured by entropy
over the host's pages: presentation that never varies and blocks that many pages share carry no information.  Branches of
low importance are cut from every page of the host.  Roles that markup states outright (nav, footer, class="ad",
comments, ...) have importance 0, an article or main element 1, as priors of the same measure: what is around it goes, it is
never cut as a whole, and branches inside it are cut at half the importance (``MAIN_CUT``).  A repeated block that shares its
path with blocks that vary is no branch of its own and stays.

Names of roles in a class or id, and forms, are weak priors.  Outside an article or main element such an element counts
where the page's only article or main element is below it, or where it holds more than half of the page's text and the page
has neither; the measure then decides on its branches.  Elements named after comments, whose text varies as main text does,
count only on pages that have nothing else, articles among them.  Inside an article or main element a class that names a role
and nothing else, comments and forms go; an id of that kind (a heading's slug, perhaps) goes only if no paragraph stands in
its element; headings stay, and names with other words (related-work, social-history) say nothing.  Articles and main elements
take the place of the rest of the page only if they hold a fifth of the text that is left.

Markup is read in one pass by the rules of its syntax, in time proportional to its length whatever its state; elements below
the 64th level count as part of their ancestor there.  Null html is an empty page; a null url is a page of a host of its own
that is never measured.  Pages of a host with the same nodes and blocks count as one.  Hosts with fewer than ``LEAST_PAGES``
distinct pages show nothing about their layout: only the priors apply.  A page whose text is all markup has an empty text.
Repeated rows and null ids are rows like others; an empty table gives no rows; other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written

LEAST_PAGES, CUT = 4, 0.2
#: Share of the cut that holds for branches inside an article or main element.
MAIN_CUT = 0.5
#: Ends the path of a branch that is low enough to be cut there too; no path has it.
DEEP = ">"
#: Share of a node's importance that its content has; the rest is presentation.
CONTENT = 0.9
#: Keys of cut branches that go to every task (16 bytes each and the names of their hosts); a larger table is joined by shuffle.
MOST_SENT = 100_000

#: Scanner: every expression is matched at one place and reads each character once.
SPACES = re.compile(r"[ \t\n\f\r]*")
BETWEEN = re.compile(r"[ \t\n\f\r/]*")
TAG_NAME = re.compile(r"[a-zA-Z][^ \t\n\f\r/>]*")
NAME = re.compile(r"=?[^ \t\n\f\r/>=]*")
BARE = re.compile(r"[^ \t\n\f\r>]*")
READ = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style"))
LABEL_WORDS = re.compile(r"[^a-z]+")

#: Tags without text, tags without an end, and tags that end a block.
SILENT = frozenset("script style noscript template title textarea select option button svg math iframe object canvas audio video head".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
RAW_END = {x: re.compile(rf"</{x}(?=[ \t\n\f\r/>])", re.I) for x in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption header footer nav aside form fieldset address details summary hr menu dialog center".split()
)
#: What states a role that is not main text.
ROLE_TAGS = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
ROLE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb "
    "breadcrumbs footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login share "
    "sharing social related recommended comment comments reply replies respond disqus pagination pager skip copyright masthead".split()
)
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
#: Words that only say what kind of box a role has; a name of a role and such words states the role alone.
BOX_WORDS = frozenset(
    "area bar block body box button buttons card cards container content count feed form footer group header heading icon icons inner item "
    "items js left link links list meta outer panel post posts respond right row section shell slot stories story tag text thread title "
    "top bottom unit widget widgets wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset(("article", "main"))
#: Kinds of weak elements: named by a role, named after comments, and inside an article by an id that is a role's name.
WEAK, COMMENTS, SLUG = 1, 2, 3
#: Steps of a path, and characters of a step; deeper elements count as the one at this depth, longer steps by their hash.
DEEPEST, LONGEST_STEP = 64, 40
#: Share of a page's text that articles and main elements must hold for the rest to go.
LEAST_MAIN = 0.2


def key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def scan(html: str) -> Iterator[tuple[int, str, dict | None, bool]]:
    """Markup of a page in one pass, by the rules of the syntax: (kind, name or text, attributes, self-closed), kind 0 text,
    1 start tag, 2 end tag.  Quotes open a value only right behind an equals sign; a quote that is never closed ends at the
    tag's end; a tag that is never closed ends the page."""
    at, n = 0, len(html)
    last = {"'": html.rfind("'"), '"': html.rfind('"'), ">": html.rfind(">"), "--": html.rfind("-->")}
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            yield 0, html[at:], None, False
            return
        follows = html[lt + 1 : lt + 2]
        closing = follows == "/"
        name = TAG_NAME.match(html, lt + 2 if closing else lt + 1)
        if name is None:
            if not closing and follows not in ("!", "?"):
                yield 0, html[at : lt + 1], None, False
                at = lt + 1
                continue
            if lt > at:
                yield 0, html[at:lt], None, False
            if html.startswith("<!--", lt):
                short = next((x for x in ("<!-->", "<!--->") if html.startswith(x, lt)), None)
                at = lt + len(short) if short else html.index("-->", lt + 4) + 3 if last["--"] >= lt + 4 else n
            else:
                at = html.index(">", lt) + 1 if last[">"] > lt else n
            continue
        if lt > at:
            yield 0, html[at:lt], None, False
        at, attributes, ended = name.end(), {}, False
        while True:
            at = BETWEEN.match(html, at).end()
            if at >= n:
                break
            if html[at] == ">":
                at, ended = at + 1, True
                break
            found = NAME.match(html, at)
            at = SPACES.match(html, found.end()).end()
            value = ""
            if html[at : at + 1] == "=":
                at = SPACES.match(html, at + 1).end()
                quote = html[at : at + 1]
                if quote in ("'", '"') and quote:
                    if last[quote] > at:
                        close = html.index(quote, at + 1)
                        value, at = html[at + 1 : close], close + 1
                    else:
                        close = html.index(">", at) if last[">"] > at else n
                        value, at = html[at + 1 : close], close
                else:
                    bare = BARE.match(html, at)
                    value, at = bare[0], bare.end()
            known = found[0].lower() if len(found[0]) < 16 else ""
            if known in READ and known not in attributes:
                attributes[known] = value
        if not ended:
            return
        low = name[0].lower()
        yield (2 if closing else 1), low, attributes, html[at - 2] == "/"
        if not closing and low in RAW and html[at - 2] != "/":
            end = RAW_END[low].search(html, at)
            if end is None:
                return
            at = end.start()


def names(value: str) -> list[list[str]]:
    """Words of every name in a class or id."""
    return [[w for w in LABEL_WORDS.split(x) if w] for x in value.lower().split()]


def is_comments(words: list[str]) -> bool:
    """Whether a name says no more than comments: comment-body, commentlist, reply-form."""
    said = False
    for w in words:
        if w in COMMENT_WORDS or (w.startswith("comment") and w[7:] in BOX_WORDS) or (w.startswith("comments") and w[8:] in BOX_WORDS):
            said = True
        elif w not in BOX_WORDS:
            return False
    return said


def is_role(words: list[str]) -> bool:
    """Whether a name says no more than a role: share-buttons, related-posts; not related-work or social-history."""
    return not ROLE_WORDS.isdisjoint(words) and all(w in ROLE_WORDS or w in BOX_WORDS for w in words)


class Element:
    """An open element: its tag, style path and depth, whether it is silent, the depth of the article or main element around
    it (0: none), the tags of its children, the closest weak element, and the closest block element."""

    __slots__ = ("tag", "path", "depth", "silent", "main", "children", "weak", "block")

    def __init__(self, tag: str, path: str, depth: int, silent: bool, main: int, weak: int, block: Element | None):
        self.tag, self.path, self.depth, self.silent, self.main, self.weak = tag, path, depth, silent, main, weak
        self.children: list[str] = []
        self.block = self if tag in BLOCK else block


class Page:
    """Text blocks of a page with their style paths, and the child tags of its elements."""

    def __init__(self, html: str):
        self.blocks: list[tuple[str, str, int]] = []  # path, text, steps of the path down to an article or main element (0: none)
        self.children: list[tuple[str, str]] = []  # path, tags of the children
        self.block_weak: list[int] = []  # number of the closest weak element around a block (-1: none)
        self.child_weak: list[int] = []
        self.weak: list[tuple[int, int]] = []  # kind of a weak element, number of the weak element around it
        self.prose: set[int] = set()  # weak elements with a paragraph right in them
        self.stack: list[Element] = []
        self.opened: Counter[str] = Counter()
        self.parts: list[str] = []
        for kind, name, attributes, ends in scan(html):
            if kind == 0:
                if not (self.stack and self.stack[-1].silent):
                    self.parts.append(name)
            elif kind == 2:
                self.close(name)
            else:
                self.open(name, attributes)
                if ends and name in RAW:
                    self.close(name)
        while self.stack:
            self.close(self.stack[-1].tag)
        self.flush()
        self.weigh()

    def flush(self) -> None:
        if self.parts:
            raw = "".join(self.parts)
            self.parts = []
            text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if text:
                top = self.stack[-1].block if self.stack else None
                self.blocks.append((top.path if top else "", text, top.main if top else 0))
                self.block_weak.append(top.weak if top else -1)
                if top and top.tag == "p" and top.weak >= 0:
                    self.prose.add(top.weak)

    def open(self, name: str, attributes: dict[str, str]) -> None:
        if name in BLOCK:
            self.flush()
            if name == "p" or name == "li":
                self.end_open(name)
        elif name == "br":
            self.parts.append(" ")
        above = self.stack[-1] if self.stack else None
        if above is not None and name not in ("br", "wbr"):
            above.children.append(name)
        if name in VOID:
            return
        silent, main, weak = (above.silent, above.main, above.weak) if above else (False, 0, -1)
        depth = above.depth + 1 if above else 1
        classes, ids, role = names(attributes.get("class", "")), names(attributes.get("id", "")), attributes.get("role", "").lower()
        inside = main > 0
        if (name in MAIN or role in MAIN) and not main:
            main = min(depth, DEEPEST)
        silent = silent or name in SILENT or name in ROLE_TAGS or (name == "header" and not main) or role in ROLES
        silent = silent or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").lower().replace(" ", "")
        silent = silent or ("hidden" in attributes and name not in ("html", "body"))
        doubt = WEAK if name == "form" else 0
        if name not in ("html", "body"):
            comments = any(map(is_comments, classes)) or any(map(is_comments, ids))
            if inside and name not in HEADINGS:
                # what stands in an article is the author's unless its name is a role's and nothing else
                if comments or name == "form" or any(map(is_role, classes)):
                    silent = True
                elif any(map(is_role, ids)):
                    doubt = SLUG
            elif not inside and comments:
                doubt = COMMENTS
            elif not inside and name not in MAIN:
                found = {w for x in (*classes, *ids) for w in x}
                if not ROLE_WORDS.isdisjoint(found):
                    doubt = COMMENTS if not COMMENT_WORDS.isdisjoint(found) else WEAK
            elif not inside and any(map(is_role, (*classes, *ids))):
                doubt = WEAK
        if doubt and not silent:
            if name in BLOCK:
                self.weak.append((doubt, weak))
                weak = len(self.weak) - 1
            elif doubt != SLUG:
                silent = True
        if depth > DEEPEST:
            path = above.path
        else:
            step = ".".join([name, *(w for x in (*classes, *ids) for w in x)])
            step = step if len(step) <= LONGEST_STEP else f"{step[:20]}.{key(step) & (1 << 64) - 1:x}"
            path = f"{above.path if above else ''}/{step}"
        self.stack.append(Element(name, path, depth, silent, main, weak, above.block if above else None))
        self.opened[name] += 1

    def end_open(self, name: str) -> None:
        """End an open element of the same kind, as the markup's rules do, unless a container stands between."""
        if self.opened[name]:
            for x in reversed(self.stack):
                if x.tag == name:
                    self.close(name)
                    return
                if x.tag in BLOCK:
                    return

    def close(self, name: str) -> None:
        if not self.opened[name]:
            return
        if name in BLOCK:
            self.flush()
        while self.stack:
            if self.stack[-1].tag in BLOCK:
                self.flush()
            x = self.stack.pop()
            self.opened[x.tag] -= 1
            if x.children and not x.silent:
                self.children.append((x.path, " ".join(x.children)))
                self.child_weak.append(x.weak)
            if x.tag == name:
                return

    def weigh(self) -> None:
        """Leave out the weak elements that nothing outweighs."""
        if not self.weak:
            return
        # numbers rise from the outside in, so what holds for the elements around one is known before it
        whole = list(zip(self.blocks, self.block_weak))
        counts = [kind == SLUG and w in self.prose for w, (kind, _) in enumerate(self.weak)]
        doubted: list[bool] = []  # has an element of a kind other than SLUG at or around it
        plain: list[bool] = []  # has none named after comments at or around it
        for kind, outer in self.weak:
            doubted.append(kind != SLUG or (outer >= 0 and doubted[outer]))
            plain.append(kind != COMMENTS and (outer < 0 or plain[outer]))
        if not any(b[2] and (w < 0 or not doubted[w]) for b, w in whole):
            # those around the page's only article or main element, or else those with most of its text
            lifted = self.chains({w for b, w in whole if b[2] and w >= 0 and plain[w]})
            lifted = {w for w in lifted if self.weak[w][0] != SLUG}
            if not lifted:
                size = [0] * len(self.weak)
                for b, w in whole:
                    if w >= 0:
                        size[w] += len(b[1])
                for w in range(len(self.weak) - 1, -1, -1):
                    if self.weak[w][1] >= 0:
                        size[self.weak[w][1]] += size[w]
                total = sum(len(b[1]) for b, _ in whole)
                lifted = {w for w, (kind, _) in enumerate(self.weak) if kind == WEAK and 2 * size[w] > total}
            for w in lifted:
                counts[w] = True
        open_ = self.open_to(counts)
        if not any(w < 0 or open_[w] for _, w in whole):  # comments are all there is
            for w in self.chains({w for w, (kind, _) in enumerate(self.weak) if kind == COMMENTS}):
                counts[w] = True
            open_ = self.open_to(counts)
        self.blocks = [b for b, w in whole if w < 0 or open_[w]]
        self.children = [c for c, w in zip(self.children, self.child_weak) if w < 0 or open_[w]]

    def chains(self, some: set[int]) -> set[int]:
        """The weak elements given and all those around them."""
        out: set[int] = set()
        for w in some:
            while w >= 0 and w not in out:
                out.add(w)
                w = self.weak[w][1]
        return out

    def open_to(self, counts: list[bool]) -> list[bool]:
        """Whether a weak element and all those around it count."""
        out: list[bool] = []
        for w, (_, outer) in enumerate(self.weak):
            out.append(counts[w] and (outer < 0 or out[outer]))
        return out

    def main_text(self, cut: frozenset[int] | set[int]) -> str:
        """Blocks in page order without cut branches.  Where articles and main elements hold a fair share of what is left,
        the rest goes; if all that they hold is cut, it stays."""
        known: dict[tuple[str, bool], bool] = {}
        kept = []
        for path, _, main in self.blocks:
            at = (path, main > 0)
            if at not in known:
                known[at] = bool(cut) and not cut.isdisjoint(cut_keys(path, main))
            kept.append(not known[at])
        inner = [i for i, b in enumerate(self.blocks) if b[2] and kept[i]] or [i for i, b in enumerate(self.blocks) if b[2]]
        outer = [i for i, b in enumerate(self.blocks) if not b[2] and kept[i]]
        size = lambda places: sum(len(self.blocks[i][1]) for i in places)
        shown = inner if inner and size(inner) >= LEAST_MAIN * (size(inner) + size(outer)) else sorted(inner + outer)
        return "\n\n".join(self.blocks[i][1] for i in shown)

    def cut_keys(self) -> set[int]:
        """All keys under which a branch of this page may be cut."""
        return {k for path, main in {(b[0], b[2]) for b in self.blocks} for k in cut_keys(path, main)}


def cut_keys(path: str, main: int) -> list[int]:
    """Keys of the steps of a path; below an article or main element only the steps inside it count, by their deep keys."""
    steps, mark = path.split("/"), DEEP if main else ""
    return [path_key("/".join(steps[: i + 1]) + mark) for i in range(main + 1, len(steps))]


def path_key(path: str) -> int:
    """The 64-bit hash that ``xxhash64`` gives a string column."""
    number = xxhash.xxh64_intdigest(path, 42)
    return number - (1 << 64) if number >> 63 else number


def host() -> Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def style_rows(pages: DataFrame) -> DataFrame:
    """(host, path, kind, feature) of every distinct page of a host: kind 0 the node itself, 1 its child tags, 2 a text block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content, many = [], []
            for html in batch.column(1).to_pylist():
                page = Page(html)
                seen = {(path, 1, key(tags)) for path, tags in page.children} | {(path, 2, key(text)) for path, text, _ in page.blocks}
                seen |= {(path, 0, 0) for path, _, _ in seen}
                rows = sorted(seen)
                content.append(xxhash.xxh3_128_digest(repr(rows)))
                many.append([{"path": p, "kind": k, "feature": f} for p, k, f in rows])
            rows_type = pa.list_(pa.struct([("path", pa.string()), ("kind", pa.int32()), ("feature", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary()), pa.array(many, rows_type)], names=["host", "content", "rows"])

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(host().alias("host"), html.alias("html")).where("host <> ''")
    rows = rows.mapInArrow(run, "host string, content binary, rows array<struct<path:string,kind:int,feature:long>>")
    return rows.dropDuplicates(["host", "content"]).select("host", F.inline("rows"))


def importance(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance) of the style nodes of every host."""
    counts = style_rows(pages).groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("c"))
    sums = counts.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == 0, F.col("c"))).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, F.col("c"))).alias("shown"),
        F.sum(F.when(F.col("kind") == 1, F.col("c") * F.log("c"))).alias("shown_log"),
        F.sum(F.when(F.col("kind") == 2, F.lit(1))).alias("blocks"),
        F.sum(F.when(F.col("kind") == 2, F.log("c"))).alias("blocks_log"),
    )
    # Entropies to the base of the node's number of pages: of c equal shares it is log c, of counts c_i it is log n - sum(c_i log c_i) / n.
    base = F.log(F.greatest(F.col("pages"), F.lit(2)))
    nodes = written(
        sums.select(
            "host", "path", "pages",
            F.coalesce((F.log("shown") - F.col("shown_log") / F.col("shown")) / base, F.lit(0.0)).alias("presentation"),
            F.coalesce("blocks", F.lit(0)).alias("blocks"),
            F.coalesce(F.col("blocks") - F.col("blocks_log") / base, F.lit(0.0)).alias("information"),
        ),
        "style-nodes",
    )
    # Content of a branch: the mean over all blocks below the node.
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(2), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    below = nodes.where("blocks > 0 AND path <> ''").select("host", F.explode(above).alias("path"), "blocks", "information")
    below = below.groupBy("host", "path").agg((F.sum("information") / F.sum("blocks")).alias("content"))
    found = nodes.where("path <> ''").join(below, ["host", "path"])
    return found.select("host", "path", "pages", (F.lit(1 - CONTENT) * F.col("presentation") + F.lit(CONTENT) * F.col("content")).alias("importance"))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, cut: float = CUT) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    low = importance(pages).where((F.col("pages") >= least_pages) & (F.col("importance") < cut))
    deep = F.when(F.col("importance") < cut * MAIN_CUT, F.xxhash64(F.concat("path", F.lit(DEEP))))
    keys = F.array_compact(F.array(F.xxhash64("path"), deep))
    low = written(low.select("host", F.explode(keys).alias("cut")), "cut")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), host().alias("host"))
    if low.count() <= MOST_SENT:
        by_host: dict[str, set[int]] = {}
        for r in low.collect():
            by_host.setdefault(r["host"], set()).add(r["cut"])
        sent = pages.sparkSession.sparkContext.broadcast(by_host)
        rows = rows.withColumn("cuts", F.array().cast("array<long>"))
    else:
        sent = None
        rows = with_own_cuts(rows, low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for html, host, cuts in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4))):
                texts.append(Page(html).main_text(set(cuts) if sent is None else sent.value.get(host, set())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return rows.select("page_id", "url", "html", "host", "cuts").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def with_own_cuts(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Add ``cuts``: those of the host's cut keys that a page has itself.  Each distinct page looks its own keys up, so a
    host of any size is spread over its keys and pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(Page(html).cut_keys()) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], names=["page", "host", "own"])

    marked = rows.withColumn("page", F.md5(F.concat("host", F.lit("\n"), "html")))
    own = marked.select("page", "host", "html").where("host <> ''").mapInArrow(run, "page string, host string, own array<long>")
    own = own.dropDuplicates(["page"]).select("page", "host", F.explode("own").alias("cut"))
    cuts = own.join(low, ["host", "cut"], "left_semi").groupBy("page").agg(F.collect_list("cut").alias("cuts"))
    return marked.join(cuts, "page", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>")))
