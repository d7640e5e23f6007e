"""Main text of pages by wrapper induction: pages of a host are aligned, what stays the same is template."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell.llm.common import cut, joined_evenly, pieces

PIECE_BYTES = 8_000_000
#: Pages with different texts that a place must be aligned on, outside and inside of articles, and the share of them with
#: the reference page's text there, for it to be template.
LEAST_PAGES = 3
LEAST_INSIDE = 4
SAME = 0.9
#: A page with more than this share of the reference page's texts at the places that vary is a near copy of it: what else the
#: two have in common tells nothing of the template.
COPY = 0.5
#: Pages of one layout from which on it has a reference page of its own.
LAYOUT_PAGES = 5

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "img input wbr br picture source".split()
)
CLOSES = {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "option": "option optgroup", "optgroup": "option optgroup", "tr": "tr td th", "td": "td th", "th": "td th",
    "thead": "tr td th tbody tfoot", "tbody": "tr td th thead tbody", "tfoot": "tr td th tbody thead",
}
CLOSES = {tag: frozenset(others.split()) for tag, others in CLOSES.items()}
SCOPE = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])

# What is never main text, by element and by the words of class, id and role.
DROPPED = frozenset("nav footer aside form button select dialog menu svg math object audio video canvas map head fieldset".split())
COMMENTS = frozenset("comment comments commentlist replies reply respond disqus".split())
ROLES = COMMENTS | frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs footer contentinfo masthead sidebar aside complementary ad ads advert adverts advertisement "
    "advertisements adsense banner promo promos sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup "
    "login share sharing social related recommended recommendations teaser teasers widget widgets pagination pager toolbar copyright legal skip search form".split()
)
#: Words before a hyphen that say what a page has or is about, not what an element is.
ABOUT = frozenset("has no with without is not category cat tag topic post-type type format author id page".split())

TOKEN = re.compile(r"""<(?:!--(?s:.)*?(?:-->|\Z)|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>)""")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


class Block:
    """A block element: its mark for alignment, its content as text runs and blocks in order."""

    __slots__ = ("content", "inside", "kids", "mark", "number", "roles", "size", "tag")

    def __init__(self, tag: str, mark: str = "", roles: frozenset[str] = frozenset()):
        self.tag, self.mark, self.roles = tag, mark, roles
        self.content: list[str | Block] = []
        self.kids: list[Block] = []
        #: Its place in the page, whether it is in an article, and the length of all text in it.
        self.number, self.inside, self.size = -1, False, 0

    def own_text(self) -> str:
        return " ".join("".join(x for x in self.content if isinstance(x, str)).split())


@lru_cache(maxsize=4096)
def roles_of(names: str) -> frozenset[str]:
    """What classes, id and role say an element is: words of ``ROLES``, alone or as the last part of a name (main-nav), but
    not where the name tells what the page has (has-sidebar) or is about (category-social)."""
    found = set()
    for name in names.lower().split():
        first, _, last = name.replace("_", "-").rpartition("-")
        if (last in ROLES or last == "header") and first.split("-")[0] not in ABOUT:
            found.add(last)
    return frozenset(found)


def parse(page: str) -> Block:
    """The block elements of a page. Inline elements leave only their text, and a line break a space; raw elements leave
    nothing. End tags that may be left out are understood, stray ones ignored; a page may break off anywhere."""
    root = Block("#root")
    stack, at, n = [root], 0, len(page)
    while at < n:
        found = TOKEN.search(page, at)
        if found is None:
            stack[-1].content.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            stack[-1].content.append(html.unescape(page[at : found.start()]))
        at = found.end()
        tag = found[2]
        if tag is None:
            continue
        tag = tag.lower()
        if found[1]:
            if tag == "p" or tag == "br":
                stack[-1].content.append(" ")
            if tag not in INLINE:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        del stack[depth:]
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "br":
                stack[-1].content.append(" ")
            continue
        closed = CLOSES.get(tag, frozenset())
        for depth in range(len(stack) - 1, 0, -1):
            above = stack[depth].tag
            if above == "p" or above in closed or (above in HEADINGS and tag in HEADINGS):
                del stack[depth:]
                if above == "p":
                    continue
            elif not closed or above in SCOPE.get(tag, frozenset(["table", "select"])):
                break
        marks, roles = "", frozenset()
        if found[3].strip(" /"):
            values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(found[3])}
            marks = " ".join(sorted(values.get("class", "").split()))
            roles = roles_of(" ".join([marks, values.get("id", ""), values.get("role", "")]))
            if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
                roles |= {"popup"}
        node = Block(tag, f"{tag} {marks}", roles)
        stack[-1].content.append(node)
        stack[-1].kids.append(node)
        if tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
    return root


def matching(a: Block, b: Block, memo: dict) -> int:
    """Simple tree matching: the most pairs of nodes of equal mark that keep ancestry and order."""
    if a.mark != b.mark:
        return 0
    if not a.kids or not b.kids:
        return 1
    key = (id(a), id(b))
    if key not in memo:
        start, end, table = _table(a.kids, b.kids, memo)
        memo[key] = 1 + start + end + table[-1][-1]
    return memo[key]


def _leaves(a: Block, b: Block) -> bool:
    return a.mark == b.mark and not a.kids and not b.kids


def _table(xs: list[Block], ys: list[Block], memo: dict) -> tuple[int, int, list[list[int]]]:
    """Leaves of equal mark at either end are matched first, which loses nothing; a table aligns what is between."""
    least = min(len(xs), len(ys))
    start = 0
    while start < least and _leaves(xs[start], ys[start]):
        start += 1
    end = 0
    while end < least - start and _leaves(xs[-1 - end], ys[-1 - end]):
        end += 1
    xs, ys = xs[start : len(xs) - end], ys[start : len(ys) - end]
    table = [[0] * (len(ys) + 1)]
    for x in xs:
        row = [0]
        for j, y in enumerate(ys):
            row.append(max(table[-1][j + 1], row[j], table[-1][j] + matching(x, y, memo)))
        table.append(row)
    return start, end, table


def aligned(a: Block, b: Block) -> list[tuple[Block, Block]]:
    """The matched pairs of nodes of two trees."""
    memo: dict = {}
    pairs, todo = [], [(a, b)]
    while todo:
        x, y = todo.pop()
        if x.mark != y.mark:
            continue
        pairs.append((x, y))
        if not x.kids or not y.kids:
            continue
        start, end, table = _table(x.kids, y.kids, memo)
        todo += zip(x.kids[:start], y.kids[:start], strict=True)
        if end:
            todo += zip(x.kids[-end:], y.kids[-end:], strict=True)
        i, j = len(table) - 1, len(table[0]) - 1
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                todo.append((x.kids[start + i], y.kids[start + j]))
    return pairs


def numbered(root: Block) -> list[Block]:
    """All nodes, each numbered by its place before those below and after it, with what it holds."""
    nodes, todo = [], [(root, False)]
    while todo:
        node, inside = todo.pop()
        node.number, node.inside = len(nodes), inside or node.tag in ("article", "main")
        nodes.append(node)
        todo += [(kid, node.inside) for kid in reversed(node.kids)]
    for node in reversed(nodes):
        node.size = len(node.own_text()) + sum(kid.size for kid in node.kids)
    return nodes


class Page:
    """A parsed page: its nodes, and the texts at those places that could be main text."""

    def __init__(self, page: str):
        self.root = parse(page)
        self.nodes = numbered(self.root)
        shown: set[int] = set()
        _blocks(self.root, self.root.size, frozenset(), [], shown)
        self.texts = {x.number: text for x in self.nodes if x.number in shown and (text := x.own_text())}

    def signature(self) -> int:
        """Equal for pages of equal texts."""
        return int.from_bytes(hashlib.blake2b("\n".join(self.texts.values()).encode(), digest_size=8).digest(), "big", signed=True)


@lru_cache(maxsize=64)
def _reference(page: str) -> Page:
    return Page(page)


def compared(reference: str, page: str) -> tuple[int, list[int], list[int]]:
    """Signature of a page, the places of the reference's texts that it is aligned with, and those where it has the same."""
    base, other = _reference(reference), Page(page)
    found = [(x.number, y.own_text() == base.texts[x.number]) for x, y in aligned(base.root, other.root) if x.number in base.texts]
    return other.signature(), [n for n, _ in found], [n for n, same in found if same]


def extract(page: str, reference: str | None = None, template: frozenset[int] = frozenset(), firm: frozenset[int] = frozenset()) -> str:
    """The main text of a page. ``template``: places of the reference whose text is that of the host, not of the page;
    inside of articles only the ``firm`` ones of them, and none where they are most of an article, since that is a copy."""
    own = Page(page)
    gone: set[int] = set()
    if reference is not None and template:
        base = _reference(reference)
        same = [(x, y) for x, y in aligned(base.root, own.root) if x.number in template and y.own_text() == base.texts[x.number]]
        gone = {y.number for _, y in same if not y.inside}
        firmly = {y.number for x, y in same if y.inside and x.number in firm}
        within = sum(len(text) for n, text in own.texts.items() if own.nodes[n].inside)
        if 2 * sum(len(own.texts.get(n, "")) for n in firmly) <= within:
            gone |= firmly
    blocks: list[str] = []
    for region in _regions(own, gone):
        _blocks(region, own.root.size, gone, blocks)
    return "\n".join(blocks)


def _dropped(node: Block, whole: int) -> bool:
    """Whether an element is of a kind that is never main text. A form, or an element only named so, that holds most of all
    text is no such part of the page."""
    if node.tag in ("html", "body", "main"):
        return False
    if node.roles & COMMENTS or (node.tag in DROPPED and node.tag != "form"):
        return True
    return (node.tag == "form" or bool(node.roles - {"header"})) and 2 * node.size <= whole


def _header(node: Block) -> bool:
    return node.tag == "header" or ("header" in node.roles and node.tag not in ("html", "body", "main", "article") and node.tag not in HEADINGS)


def _regions(page: Page, gone: set[int]) -> list[Block]:
    """Where the main text is: the outermost articles with titles beside them, or the main elements, if they hold half of
    what is neither dropped nor template; else the whole page."""
    articles, mains, titles, todo = [], [], [], [page.root]
    while todo:
        node = todo.pop()
        if _dropped(node, page.root.size) or _header(node):
            continue
        if node.tag == "article":
            articles.append(node)
            continue
        if node.tag == "main":
            mains.append(node)
        if node.tag == "h1":
            titles.append(node)
        todo += reversed(node.kids)
    if not articles and not mains:
        return [page.root]

    def held(regions: list[Block]) -> int:
        blocks: list[str] = []
        for region in regions:
            _blocks(region, page.root.size, gone, blocks)
        return sum(map(len, blocks))

    whole = held([page.root])
    if articles and 2 * held(articles) >= whole:
        return sorted([*articles, *titles], key=lambda x: x.number)
    outermost = [x for x in mains if not any(y is not x and y.number < x.number and x in y.kids for y in mains)]
    return outermost if mains and 2 * held(outermost) >= whole else [page.root]


def _blocks(region: Block, whole: int, gone: set[int] | frozenset[int], blocks: list[str], used: set[int] | None = None) -> None:
    """Append the texts of the blocks of a region in page order, and to ``used`` the places whose text counts. Of a header
    inside an article or main element only headings do, of another header nothing."""
    run: list[str] = []

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            blocks.append(text)

    todo: list = [(region, False, False)]
    while todo:
        item, in_header, after = todo.pop()
        if isinstance(item, str):
            run.append(item)
            continue
        flush()
        if after or (item is not region and _dropped(item, whole)):
            continue
        if _header(item):
            if not item.inside:
                continue
            in_header = True
        todo.append((item, in_header, True))
        shown = item.number not in gone and (not in_header or item.tag in HEADINGS)
        if shown and used is not None:
            used.add(item.number)
        todo += [(x, in_header, False) for x in reversed(item.content) if shown or isinstance(x, Block)]
    flush()


def host_of(url) -> F.Column:
    """The host of an address, in lower case; the empty string where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def layout_of(html) -> F.Column:
    """A number for the block elements and classes that a page uses: pages of one template mostly have one."""
    tags = F.array_except(F.regexp_extract_all(F.lower(html), F.lit("<([a-z][a-z0-9]*)"), 1), F.array(*[F.lit(t) for t in sorted(INLINE)]))
    classes = F.regexp_extract_all(F.lower(html), F.lit(r"""\sclass\s*=\s*["']?([^"'>]*)"""), 1)
    return F.xxhash64(F.array_sort(tags), F.array_sort(F.array_distinct(classes)))


def keyed_pages(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    host = F.when(html != "", host_of(F.col("url"))).otherwise(F.lit(""))
    return pages.select("page_id", "url", html.alias("html"), F.xxhash64(html).alias("h"), host.alias("host"), F.when(host != "", layout_of(html)).otherwise(F.lit(0)).alias("layout"))


def references(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every layout of a host the layout that it is compared with, ``base``, and of every base its ``reference`` page.

    A layout of ``LAYOUT_PAGES`` pages is its own base, a rarer one has the host's most frequent. The reference is the page
    of smallest (page_id, hash).
    """
    first = F.min(F.struct(F.coalesce("page_id", F.lit(2**62)).alias("page_id"), "h")).alias("first")
    layouts = cut(keyed.where("host <> ''").groupBy("host", "layout").agg(first, F.count("*").alias("n")), "layouts")
    most = layouts.groupBy("host").agg(F.max(F.struct("n", "layout")).alias("most"), F.sum("n").alias("all")).where(f"all > {LEAST_PAGES}")
    own = F.when(F.col("n") >= LAYOUT_PAGES, F.col("layout")).otherwise(F.col("most.layout"))
    based = cut(layouts.join(most, "host").select("host", "layout", own.alias("base"), "first"), "bases")
    chosen = based.where("layout = base").select("host", "base", F.col("first.page_id").alias("page_id"), F.col("first.h").alias("h"))
    # By page and not by host alone, which may have a third of all pages.
    pages = keyed.select("host", F.coalesce("page_id", F.lit(2**62)).alias("page_id"), "h", "html").join(chosen, ["host", "page_id", "h"])
    return based.select("host", "layout", "base"), cut(pages.groupBy("host", "base").agg(F.min("html").alias("reference")), "references")


def templates(keyed: DataFrame, based: DataFrame, reference: DataFrame) -> DataFrame:
    """host, base, reference, and the places in it that are template, ``template``, and surely so, ``firm``.

    Every page is aligned with its reference by simple tree matching. Pages of equal texts count once. Places where some
    page differs from the reference vary; a page that has the reference's text at most of them is a near copy and tells
    nothing. What the other pages have in common with the reference is template, by its number of pages and share of
    equal texts. A page becomes a row of places, and these are added up in every task before they travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html", PIECE_BYTES):
                found = [compared(r, page) for page, r in zip(piece.column("html").to_pylist(), piece.column("reference").to_pylist(), strict=True)]
                places = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("host"), piece.column("base"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], places), pa.array([x[2] for x in found], places)],
                    names=["host", "base", "signature", "places", "same"],
                )

    met = keyed.select("host", "layout", "html").join(based, ["host", "layout"]).join(reference, ["host", "base"]).select("host", "base", "html", "reference")
    told = met.mapInArrow(run, "host string, base bigint, signature bigint, places array<int>, same array<int>")
    once = cut(told.groupBy("host", "base", "signature").agg(F.min(F.struct("places", "same")).alias("x")).select("host", "base", "x.places", "x.same"), "alignments")

    def summed(rows: DataFrame) -> DataFrame:
        each = rows.select("host", "base", F.explode("places").alias("place"), "same")
        return each.groupBy("host", "base", "place").agg(F.count("*").alias("n"), F.count_if(F.array_contains("same", F.col("place"))).alias("same"))

    # At most as many places as a page has.
    varying = summed(once).where("same < n").groupBy("host", "base").agg(F.collect_set("place").alias("varying"))
    judged = joined_evenly(once, varying, ["host", "base"])
    alike, open_ = F.size(F.array_intersect("same", "varying")), F.size(F.array_intersect("places", "varying"))
    evidence = judged.where(alike <= COPY * open_).drop("varying")
    places = summed(evidence).where(f"n >= {LEAST_PAGES} AND same >= {SAME} * n")
    sure = F.collect_set(F.when(F.col("n") >= LEAST_INSIDE, F.col("place"))).alias("firm")
    return reference.join(places.groupBy("host", "base").agg(F.collect_set("place").alias("template"), sure), ["host", "base"])


def main_texts(pages: DataFrame) -> DataFrame:
    """For every row of pages: page_id, url and text (blocks in page order, one line each; empty if none).

    NULL and empty pages have an empty text; a NULL or odd url is of no host and is taken without a template, like hosts
    with few pages; repeated pages are answered each; other columns are left aside. page_id must fit a bigint.
    """
    keyed = keyed_pages(pages)
    based, reference = references(keyed)
    known = cut(templates(keyed, based, reference), "templates")
    met = keyed.join(based, ["host", "layout"], "left").join(known, ["host", "base"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html", PIECE_BYTES):
                rows = zip(*(piece.column(c).to_pylist() for c in ("html", "reference", "template", "firm")), strict=True)
                texts = [extract(page, base, frozenset(places or ()), frozenset(firm or ())) for page, base, places, firm in rows]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return met.select("page_id", "url", "html", "reference", "template", "firm").mapInArrow(run, "page_id bigint, url string, text string")
