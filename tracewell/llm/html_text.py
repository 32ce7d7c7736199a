"""Main text of pages by site style trees.

The DOMs of one host's pages are merged into a tree: an element node stands for one place in the pages' markup (the
path of tags and classes from the body, with each parent's own style), and counts the styles its children take (the
sequence of their tags and classes) and the contents its text takes, over all pages that have the place. Importance is
entropy based, between 0 and 1: of a presentation, the entropy of its children's styles over the pages; of a content,
the entropy of its texts over the pages; each to the base of the number of pages, and 1 where only one page has the
place. A branch's importance combines its own presentation with its children's importance, weighing inner levels more.
Branches below THRESHOLD that enough pages share are noise and are removed from every page that has them.

Markup that names itself gives a prior: elements that are navigation, forms, scripts, notices and so on by tag, role, or
whole class name or id have importance 0 wherever they stand, and if a page marks its main content (article, main), text outside
it has importance 0 and its paragraphs and headings inside it are not judged by repetition (a repeated article is an
article still).

A tree is never in one place: tasks emit a row of two hashes for each place and style or content, equal rows are added
up before the shuffle, and importance is aggregated by place. Pages are then read again with the noise places: up to
SHARED of them (their number is counted first) go to every task; more are joined to each page's own places, and those
to the pages by page_id. A host of a third of all pages is spread over its places and contents.

Defined results: null html gives empty text; character references are decoded once; the six ASCII white space
characters collapse, others are text; a page whose every branch would go keeps what its tags and classes let stand;
rows that repeat a page_id are treated as one page's places and are returned each; a null or odd url has the empty
host; a page of any length is one task's tree; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread, written

#: Importance below which a branch is noise, pages that must share it, and the weight of inner levels.
THRESHOLD, LEAST_PAGES, DECAY = 0.3, 5, 0.9
#: Noise places (8 bytes each) that may be sent to every task.
SHARED = 200_000

#: The tree is no deeper than this: blocks nested deeper stand in their order side by side at this depth.
DEEPEST = 200

#: Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
NOISE_TAGS = frozenset("head script style noscript template nav footer aside form iframe object embed svg canvas button select option datalist menu dialog textarea audio video map title".split())
MAIN_TAGS = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body", "option", "optgroup", "legend"}
CLOSED_BY_ITSELF = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = frozenset("ul ol dl table select body html div section article main".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar note status".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies consent gdpr notice notices notification notifications alert alerts disclaimer popup modal overlay sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments commentlist respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup login search searchform widget widgets toolbar pagination pager copyright skip".split()
)

#: Words that may stand before such a name in a class or id without changing what it names.
QUALIFIERS = frozenset("site page main global top bottom left right primary secondary mobile desktop sticky fixed box block bar container wrapper wrap inner outer area section list item link links button icon reader readers user users".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_NAME = re.compile(r"[^a-z0-9]+")


def names_noise(name: str) -> bool:
    """Whether a whole class name or id names a part that is no content: every word of it does, or qualifies one that
    does. (`has-sidebar`, `share-enabled` and `post-header` name something else.)"""
    words = [w for w in _NAME.split(name) if w]
    return any(w in NOISE_NAMES for w in words) and all(w in NOISE_NAMES or w in QUALIFIERS or w.isdigit() for w in words)


class Element:
    __slots__ = ("children", "noise", "style", "tag")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.children, self.style, self.noise = tag, [], tag, tag in NOISE_TAGS
        if attributes:
            found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
            if found.get("class"):
                self.style = f"{tag}.{'.'.join(sorted(found['class'].lower().split()))}"
            hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower() or found.get("aria-hidden") == "true"
            names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
            named = any(map(names_noise, names)) and tag not in ("html", "body", "main", "article", "h1")
            self.noise = self.noise or hidden or named or found.get("role", "").lower() in NOISE_ROLES


def parse(page: str) -> Element:
    """The DOM of a page: elements, and strings for text with character references decoded."""
    root = Element("html")
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a tag are, so that no tag walks the stack
    scopes: list[int] = [0]

    def enter(element: Element) -> None:
        if len(stack) >= DEEPEST:
            element.noise |= stack[-1].noise
            if element.noise or element.tag in BLOCKS:
                stack[DEEPEST - 1].children.append(element)
            else:  # its text is its parent's
                element.children = stack[-1].children
        else:
            stack[-1].children.append(element)
        places.setdefault(element.tag, []).append(len(stack))
        if element.tag in SCOPES:
            scopes.append(len(stack))
        stack.append(element)

    def last(tags: Iterable[str]) -> int:
        """The place of the innermost open element of these tags; 0 for none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def leave(k: int) -> None:
        """Close all elements from the k-th on."""
        gone = stack[k:]
        del stack[k:]
        for e in gone:
            places[e.tag].pop()
        while scopes[-1] >= k:
            scopes.pop()
        if len(stack) > DEEPEST and any(e.children is not stack[-1].children for e in gone):
            rest = Element(stack[-1].tag)  # what follows comes behind the element closed
            rest.style, rest.noise = stack[-1].style, stack[-1].noise
            stack[DEEPEST - 1].children.append(rest)
            stack[-1] = rest

    while m := _MARKUP.search(page, at):
        if m.start() > at:
            stack[-1].children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                stack[-1].children.append(m[0][9:].removesuffix("]]>"))
            continue
        if not m[0].endswith(">"):  # cut off inside a tag
            break
        tag = m[2].lower()
        if m[1]:
            if k := last((tag,)):
                leave(k)
            elif tag == "p":  # without a start it stands for an empty paragraph
                stack[-1].children.append(Element("p"))
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:  # an open paragraph ends, with what is open in it
            while (k := last(("p",))) > scopes[-1]:
                leave(k)
        if (k := last(CLOSED_BY_ITSELF.get(tag, ()))) > scopes[-1]:
            leave(k)
        element = Element(tag, m[3])
        if tag == "header" and not last(MAIN_TAGS):  # an article's own header has its title
            element.noise = True
        if tag in RAW:
            stack[-1].children.append(element)
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag in VOID or m[3].rstrip().endswith("/"):
            stack[-1].children.append(element)
        else:
            enter(element)
    if at < len(page):
        stack[-1].children.append(entities.unescape(page[at:]))
    return root


def main_parts(root: Element) -> list[Element]:
    """The outermost elements that mark main content (inside those, articles), or the whole page if none does."""
    found: list[Element] = []

    def look(e: Element) -> None:
        for c in e.children:
            if isinstance(c, Element) and not c.noise:
                found.append(c) if c.tag in MAIN_TAGS else look(c)

    look(root)
    parts: list[Element] = []
    for e in found:
        inner, found = found, []
        look(e)
        inner, found = found, inner
        parts += inner if e.tag == "main" and inner else [e]
    return parts or [root]


def _hash(*parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def text_of(e: Element) -> str:
    out: list[str] = []

    def walk(x: Element) -> None:
        for c in x.children:
            if isinstance(c, str):
                out.append(c)
            elif not c.noise:
                out.append(" ")
                walk(c)
                out.append(" ")

    walk(e)
    return _SPACE.sub(" ", "".join(out)).strip(" ")


#: Elements whose repetition says nothing where the page marks its main content: an article may be published twice.
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th".split())


def judged(host: str, root: Element) -> Iterator[tuple[Element, int, int, int, bool]]:
    """(element, place, parent's place, its style or content, whether a leaf) of the page's branches, from the body down.

    A leaf has no block children, or is noise by its own name; its content is its text. Elements that mark main content
    are passed through, and prose inside them is not judged."""

    def walk(e: Element, place: int, marked: bool) -> Iterator[tuple[Element, int, int, int, bool]]:
        blocks = [c for c in e.children if isinstance(c, Element) and c.tag in BLOCKS]
        style = 0 if marked else _hash("style", *(c.style for c in blocks))
        for k, c in enumerate(blocks):
            own = _hash(place, style, c.style, 0 if marked else k)
            inner = [] if c.noise else [x.style for x in c.children if isinstance(x, Element) and x.tag in BLOCKS]
            main = c.tag in MAIN_TAGS and not c.noise
            if not main and not (marked and not inner and c.tag in _PROSE):
                yield c, own, place, _hash("style", *inner) if inner else _hash("text", text_of(c)), not inner
            if inner:
                yield from walk(c, own, marked or main)

    yield from walk(root, _hash(host), False)


def extracted(root: Element, host: str, noise: frozenset[int]) -> str:
    """The text of the main parts without noise branches: a line for each block, in page order."""
    gone = {id(e) for e, place, _, _, _ in judged(host, root) if place in noise} if noise else set()

    def lines(drop: set[int]) -> list[str]:
        out: list[str] = []
        run: list[str] = []

        def end() -> None:
            if text := _SPACE.sub(" ", "".join(run)).strip(" "):
                out.append(text)
            run.clear()

        def walk(e: Element) -> None:
            for c in e.children:
                if isinstance(c, str):
                    run.append(c)
                elif c.noise or id(c) in drop:
                    run.append(" ")
                elif c.tag in BLOCKS:
                    end()
                    walk(c)
                    end()
                else:
                    run.append(" " if c.tag == "br" else "")
                    walk(c)

        for part in main_parts(root):
            walk(part)
            end()
        return out

    return "\n".join(lines(gone) or lines(set()))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        row, columns = [], ([], [], [], [])
        for i, (url, page) in enumerate(zip(b.column("url").to_pylist(), b.column("html").to_pylist())):
            for _, *found in judged(host_of(url), parse(page or "")):
                row.append(i)
                for column, value in zip(columns, found):
                    column.append(value)
        ids = b.column("page_id").take(pa.array(row, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.bool_())], ["page_id", "place", "parent", "content", "leaf"])


def _texts(known: frozenset[int] | None):
    """Texts of pages, with noise places from a set that all pages share or from each row's own list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            urls, pages = (b.column(c).to_pylist() for c in ("url", "html"))
            lists = b.column("noise").to_pylist() if known is None else [known] * len(urls)
            for url, page, noise in zip(urls, pages, lists):
                texts.append(extracted(parse(page or ""), host_of(url), noise if known is not None else frozenset(noise or ())))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def importance(places: DataFrame) -> DataFrame:
    """(place, parent, pages, leaf, own): each place's own entropy over the pages that have it."""
    counts = places.groupBy("place", "parent", "content", "leaf").agg(F.countDistinct("page_id").alias("n"))
    sums = counts.groupBy("place", "parent").agg(
        F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("n_log_n"), F.max("leaf").alias("leaf")
    )
    entropy = (F.log("pages") - F.col("n_log_n") / F.col("pages")) / F.log("pages")
    return sums.withColumn("own", F.when(F.col("pages") > 1, entropy).otherwise(1.0)).drop("n_log_n")


def composite(own: DataFrame, levels: int = DEEPEST + 1) -> DataFrame:
    """(place, pages, value): a branch's importance, its children's weighed by the pages that have them.

    Leaves keep their own, and a place with one child place has that child's importance at least: a wrapper says nothing
    about what it wraps. Each round lifts the values of children one level up, until none moves."""
    value = written(own.select("place", "parent", "pages", "leaf", "own", F.col("own").alias("value")), "importance")
    for _ in range(levels):
        up = value.groupBy(F.col("parent").alias("place")).agg((F.sum(F.col("pages") * F.col("value")) / F.sum("pages")).alias("below"), F.count(F.lit(1)).alias("n"))
        lifted = value.join(spread(up, "place"), "place", "left")
        mixed = DECAY * F.col("below") + (1 - DECAY) * F.col("own")
        mixed = F.when(F.col("below").isNull(), F.col("own")).when(F.col("n") == 1, F.greatest("below", mixed)).otherwise(mixed)
        changed = written(lifted.select("place", "parent", "pages", "leaf", "own", mixed.alias("new"), "value"), "importance")
        moved = changed.where(F.abs(F.col("new") - F.col("value")) > 1e-9).limit(1).count()
        value = changed.select("place", "parent", "pages", "leaf", "own", F.col("new").alias("value"))
        if not moved:
            break
    return value


def main_text(pages: DataFrame, threshold: float = THRESHOLD, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", "html")
    with scratch(pages.sparkSession):
        places = written(rows.mapInArrow(_places, f"page_id {kind}, place long, parent long, content long, leaf boolean"), "places")
        values = composite(importance(places))
        noise = written(values.where((F.col("value") < threshold) & (F.col("pages") >= least_pages)).select("place"), "noise")
        few = noise.count() <= SHARED
        known = frozenset(r.place for r in noise.collect()) if few else None
        if not few:
            found = places.select("page_id", "place").join(spread(noise, "place"), "place")
            found = written(found.groupBy(F.col("page_id").alias("__id")).agg(F.collect_set("place").alias("noise")), "noise-of-page", keep=True)
    schema = f"page_id {kind}, url string, text string, n_chars long"
    if few:  # counted above: at most SHARED numbers go to each task, and pages stay where they are
        return rows.mapInArrow(_texts(known), schema)
    both = rows.join(found, F.col("page_id").eqNullSafe(F.col("__id")), "left").select("page_id", "url", "html", "noise")
    return both.mapInArrow(_texts(None), schema)


def op1_main_text(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
