"""Main text of web pages by consensus host paths.

A page is read once into text blocks, each in a container whose path (tags with their first class,
digits generalised) has a 64-bit key made of its parent's key and its own step.  Every container is scored by the
text of its own blocks less its links; a container passes half of that to its parent and a quarter to its grandparent.  The best
container gives way to the outermost article or main element that holds most of the page's text, or else to its
highest ancestor that adds a heading, or that holds no boilerplate and adds no text that is mostly links.  Each page
votes for that path, Spark adds up the votes of a host's pages, and the blocks of every page are taken again under
its host's winning path.  A page with under a quarter of the text there that its own path has is
of another layout, and keeps its own path.

Menus, headers, footers, sidebars, forms, scripts, styles and hidden parts are recognised by tag, role and
state, and never count or come out.  Class and id names are weaker evidence.  A name counts only as a whole: each of its words
must be one of the lists below, so that ``share-price`` or ``banner-story`` is none.  A container that a name makes
a notice, an advert or the like is left out unless it holds an article or most of the page's
text; inside an article, one that a name makes a list of links is left out only if its text is mostly links.  Only names of
reader comments are final.  Headings are never left out by name, paragraphs only by those of adverts and notices.

Containers are nodes with numbers in page order, so reading takes time and memory in proportion to the page, however deep it is.

Defined results: null or empty html gives the empty text; pages without a host share the host '';
ties between paths go to the outer one, then to the smaller key; unclosed elements end with their container or the page;
rows that repeat a page_id are pages of their own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stage, table
from tidemark.session import ship

#: Up to so many hosts, of about 100 bytes each, their paths are sent to all tasks; beyond, texts are dealt out by host and salt.
BROADCAST_HOSTS, SALTS = 50_000, 32
#: A page keeps its own path when its host's has less than one part in so many of the text.
OTHER_LAYOUT = 4
PARSED = "page_id long, url string, host string, own long, keys array<long>, lasts array<int>, at array<int>, texts array<string>"
ROOT = 0
TOKEN = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*)>|<[!?][^>]*(?:>|$)|</?[a-zA-Z][^>]*(?:>|$)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
#: Elements whose content is no markup, and elements whose content is none of the text.
UNPARSED = frozenset("script style textarea title".split())
RAW = frozenset("script style noscript template textarea title svg math iframe object canvas select option button audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body div section article main aside nav header footer form fieldset table tbody thead tfoot tr td th ul ol dl li dd blockquote figure details dialog center menu head".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre dt figcaption caption address summary legend hr br".split())
BOILERPLATE_TAGS = frozenset("nav aside footer form dialog head menu".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond responses disqus discussion".split())
#: Names of adverts and notices, which hold for paragraphs as well; of page heads, which words of articles cancel; of parts beside
#: the text; of lists of links; and words that may stand beside any of these.
ADVERT_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors cookie cookies consent gdpr newsletter".split())
HEAD_NAMES = frozenset("header masthead banner topbar promo promotion".split())
BESIDE_NAMES = frozenset("footer sidebar aside rail widget widgets notice notices notification alert popup modal overlay subscribe signup login search".split())
LINK_NAMES = frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc share sharing social related recommended recommendations trending toolbar skip".split())
NEUTRAL_NAMES = frozenset(
    "site page main global left right top bottom primary secondary inner outer wrapper wrap container content box block bar list links link item items section "
    "area panel slot unit group row col column button buttons icons posts articles stories post article entry mobile desktop sticky fixed small large first last sub mini my the js is has".split()
)
ARTICLE_NAMES = frozenset("article body content entry headline main post story text title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT_TAGS = frozenset(("article", "main"))


def names_of(attributes: dict[str, str]) -> list[set[str]]:
    """The words of each class and id."""
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    return [set(filter(None, re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))) for name in names]


def names_a(names: list[set[str]], kind: frozenset[str]) -> bool:
    """Whether one of the names has a word of this kind, and no word that makes it something else."""
    return any(words & kind and words <= kind | ADVERT_NAMES | HEAD_NAMES | BESIDE_NAMES | LINK_NAMES | NEUTRAL_NAMES for words in names)


def boilerplate(tag: str, attributes: dict[str, str], inside_content: bool) -> str | None:
    """``never`` for what is no article by tag, role or state, ``comment`` by name, ``doubt`` or ``links`` by other names, else None."""
    if tag in BOILERPLATE_TAGS or tag == "header" and not inside_content:
        return "never"
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "never"
    if attributes.get("role", "").lower() in BOILERPLATE_ROLES:
        return "never"
    if tag in ("html", "body") or tag in HEADINGS:
        return None
    names = names_of(attributes)
    if any(words & COMMENT_NAMES for words in names):
        return "comment"
    if tag in CONTENT_TAGS:
        return None
    if names_a(names, ADVERT_NAMES):
        return "doubt"
    if tag == "p":
        return None
    if names_a(names, BESIDE_NAMES):
        return "doubt"
    if names_a(names, LINK_NAMES):
        return "links" if inside_content else "doubt"
    if not inside_content and names_a(names, HEAD_NAMES) and not any(words & ARTICLE_NAMES for words in names):
        return "doubt"
    return None


def step(tag: str, attributes: dict[str, str]) -> str:
    """A generalised path step: the tag, and its first class with digits as #."""
    first = attributes.get("class", "").split()
    return f"{tag}.{re.sub(r'[0-9]+', '#', first[0].lower())}" if first else tag


def skip_raw(page: str, position: int, tag: str, around: str) -> int:
    """Where reading goes on after the start of a RAW element: behind its end, or where the container around it ends first."""
    end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, position)
    if tag in UNPARSED or not around:
        return end.end() if end else len(page)
    depth = 0
    for match in re.compile(rf"<(/?){re.escape(around)}(?=[\s/>])", re.IGNORECASE).finditer(page, position):
        if end and end.start() < match.start():
            break
        depth += -1 if match[1] else 1
        if depth < 0:
            return match.start()
    return end.end() if end else len(page)


@dataclass
class Block:
    """A run of text: its container, the characters that stand in links, whether it is a heading, and the innermost doubtful container it stands in (-1: none)."""

    node: int
    text: str
    links: int
    heading: bool
    doubt: int


@dataclass
class Page:
    """The blocks of a page in order without boilerplate, and its containers in page order.

    ``keys``, ``ups`` and ``lasts`` of a container are its path's key, the container around it, and the last container in
    it; 0 is the page.  ``marked`` are the containers right around boilerplate.
    """

    blocks: list[Block] = field(default_factory=list)
    keys: list[int] = field(default_factory=lambda: [ROOT])
    ups: list[int] = field(default_factory=lambda: [-1])
    lasts: list[int] = field(default_factory=lambda: [0])
    content: list[bool] = field(default_factory=lambda: [False])
    marked: set[int] = field(default_factory=set)

    def under(self, key: int) -> list[str]:
        """The texts of the blocks in the containers of a path."""
        spans, end = [], -1
        for node, (k, last) in enumerate(zip(self.keys, self.lasts, strict=True)):
            if k == key and node > end:
                end = last
                spans.append((node, last))
        return taken(spans, [b.node for b in self.blocks], [b.text for b in self.blocks])


def taken(spans: list[tuple[int, int]], at: list[int], texts: list[str]) -> list[str]:
    """The texts whose containers lie in one of the spans of container numbers."""
    inside: set[int] = set()
    for first, last in spans:
        inside.update(range(first, last + 1))
    return [text for node, text in zip(at, texts, strict=True) if node in inside]


def key_of(parent: int, step: str) -> int:
    """The 64-bit key of a path, made of the key of the path around it and its last step."""
    return int.from_bytes(blake2b(f"{parent} {step}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def read(page: str | None) -> Page:
    """A page's blocks and containers."""
    out = Page()
    # tag, node, left out, inside content, innermost doubtful container around
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, -1)]
    open_tags: Counter[str] = Counter()
    doubtful: list[tuple[int, int, str]] = []  # of each doubtful container: the doubtful one around, the container around, the kind
    articles: set[int] = set()  # doubtful containers that hold an article or main element
    parts: list[str] = []
    links = position = anchors = 0
    heading = False
    hidden = None  # an inline or paragraph element that is boilerplate: its tag and depth
    page = page or ""

    def end_block() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.blocks.append(Block(stack[-1][1], text, min(links, len(text)), heading, stack[-1][4]))
            parts.clear()
        links = 0

    def add(text: str) -> None:
        nonlocal links
        if text and not stack[-1][2] and not hidden:
            parts.append(text)
            if anchors:
                links += len(text)

    def leave() -> str:
        tag, node, *_ = stack.pop()
        open_tags[tag] -= 1
        out.lasts[node] = len(out.keys) - 1
        return tag

    while match := TOKEN.search(page, position):
        add(page[position : match.start()])
        position = match.end()
        closing, tag = match[1], (match[2] or "").lower()
        if not tag:
            continue
        if tag in RAW:
            if not closing and not match[3].endswith("/"):
                position = skip_raw(page, position, tag, stack[-1][0])
            continue
        if tag in BLOCKS:
            end_block()
            heading = tag in HEADINGS and not closing
        if tag == "a":
            anchors = 0 if closing else 1
        if closing:
            if hidden and tag == hidden[0]:
                hidden = (tag, hidden[1] - 1) if hidden[1] > 1 else None
            if tag in CONTAINERS and open_tags[tag]:
                while leave() != tag:
                    pass
                anchors, hidden = 0, None
        elif tag in CONTAINERS:
            attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(match[3])}
            if tag in ("li", "td", "th", "tr", "dd") and stack[-1][0] == tag:
                leave()
            _, around, bad, content, doubt = stack[-1]
            if tag in CONTENT_TAGS:
                at = doubt
                while at >= 0 and at not in articles:
                    articles.add(at)
                    at = doubtful[at][0]
            if not bad and (kind := boilerplate(tag, attributes, content)):
                if kind in ("doubt", "links"):
                    doubtful.append((doubt, around, kind))
                    doubt = len(doubtful) - 1
                else:
                    bad = True
                    out.marked.add(around)
            node = around
            if tag not in ("html", "body"):
                node = len(out.keys)
                out.keys.append(key_of(out.keys[around], step(tag, attributes)))
                out.ups.append(around)
                out.lasts.append(node)
                out.content.append(tag in CONTENT_TAGS)
            stack.append((tag, node, bad, content or tag in CONTENT_TAGS, doubt))
            open_tags[tag] += 1
        elif tag not in VOID:
            if hidden:
                hidden = (hidden[0], hidden[1] + 1) if tag == hidden[0] and tag != "p" else None if hidden[0] == "p" and tag == "p" else hidden
            if match[3] and not hidden:
                attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(match[3])}
                if attributes and boilerplate(tag, attributes, stack[-1][3]) not in (None, "links"):
                    hidden = (tag, 1)
                    out.marked.add(stack[-1][1])
    add(page[position:])
    end_block()
    while stack:
        leave()
    drop_doubtful(out, doubtful, articles)
    return out


def drop_doubtful(page: Page, doubtful: list[tuple[int, int, str]], articles: set[int]) -> None:
    """Leave out the doubtful containers that hold no article and not most of the text, and of lists those that are mostly links."""
    if not doubtful:
        return
    text, links = [0] * len(doubtful), [0] * len(doubtful)
    for block in page.blocks:
        if block.doubt >= 0:
            text[block.doubt] += len(block.text)
            links[block.doubt] += block.links
    for d in range(len(doubtful) - 1, -1, -1):
        if (outer := doubtful[d][0]) >= 0:
            text[outer] += text[d]
            links[outer] += links[d]
    total = sum(len(block.text) - block.links for block in page.blocks)
    gone = []
    for d, (outer, around, kind) in enumerate(doubtful):
        own = d not in articles and 2 * (text[d] - links[d]) <= total and (kind == "doubt" or 2 * links[d] >= text[d])
        if own:
            page.marked.add(around)
        gone.append(own or outer >= 0 and gone[outer])
    page.blocks = [block for block in page.blocks if block.doubt < 0 or not gone[block.doubt]]


def best_path(page: Page) -> int | None:
    """The key of the path with the largest score, widened; an article or main element counts double.

    Containers of one path count together.
    """
    if not page.blocks:
        return None
    parent, depth, content = {ROOT: None}, {ROOT: 0}, set()
    for node in range(1, len(page.keys)):
        key, up = page.keys[node], page.keys[page.ups[node]]
        if key not in parent:
            parent[key], depth[key] = up, depth[up] + 1
        if page.content[node]:
            content.add(key)
    scores: dict[int, float] = defaultdict(float)
    # of a path with all inside it: characters, those in links, headings that aren't links, boilerplate right inside
    whole = {key: [0, 0, 0, 0] for key in parent}
    for block in page.blocks:
        value, at = float(len(block.text) - 2 * block.links), page.keys[block.node]
        sums = whole[at]
        sums[0] += len(block.text)
        sums[1] += block.links
        sums[2] += block.heading and 2 * block.links <= len(block.text)
        for share in (1.0, 0.5, 0.25):
            scores[at] += value * share
            if (at := parent[at]) is None:
                break
    for key in {page.keys[node] for node in page.marked}:
        whole[key][3] += 1
    for key in reversed(parent):  # a path stands after the one around it
        if (up := parent[key]) is not None:
            for i in range(4):
                whole[up][i] += whole[key][i]
    for key in content & scores.keys():
        scores[key] *= 2
    best = min(scores, key=lambda k: (-scores[k], depth[k], k))
    total = whole[ROOT][0] - whole[ROOT][1]
    most = [k for k in content if 2 * (whole[k][0] - whole[k][1]) > total]
    if most:
        return min(most, key=lambda k: (depth[k], k))
    while (outer := parent[best]) is not None:
        size, links, headings, _ = (x - y for x, y in zip(whole[outer], whole[best], strict=True))
        if not headings and (2 * links > size or whole[outer][3]):
            break
        best = outer
    return best


def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, host, html) to PARSED."""
    kinds = {"own": pa.int64(), "keys": pa.list_(pa.int64()), "lasts": pa.list_(pa.int32()), "at": pa.list_(pa.int32()), "texts": pa.list_(pa.string())}
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            out = {name: [] for name in kinds}
            for html in part["html"].to_pylist():
                page = read(html)
                row = (best_path(page), page.keys, page.lasts, [b.node for b in page.blocks], [b.text for b in page.blocks])
                for name, value in zip(kinds, row, strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([part["page_id"].cast(pa.int64()), part["url"], part["host"], *[pa.array(out[name], kind) for name, kind in kinds.items()]], names=["page_id", "url", "host", *kinds])


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PARSED with the host's path to page_id, url, text."""
    for batch in batches:
        texts = []
        for row in batch.select(["own", "path", "keys", "lasts", "at", "texts"]).to_pylist():
            page = Page([Block(node, text, 0, False, -1) for node, text in zip(row["at"], row["texts"], strict=True)], row["keys"], lasts=row["lasts"])
            voted = " ".join(page.under(row["path"])) if row["path"] is not None else ""
            alone = " ".join(page.under(row["own"])) if row["own"] is not None and row["own"] != row["path"] else ""
            texts.append(alone if OTHER_LAYOUT * len(voted) < len(alone) else voted)
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages (page_id, url, html)."""
    spark = pages.sparkSession
    ship(spark)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    parsed = stage(pages.select("page_id", "url", host.alias("host"), "html").mapInArrow(parse, PARSED), "pages")
    counted = parsed.where("own is not null").groupBy("host", F.col("own").alias("path")).agg(F.count("*").alias("votes"))
    winners = stage(counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "path"))["path"].alias("path")), "winners")
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        found = parsed.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = parsed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    texts = found.select("page_id", "url", "own", "path", "keys", "lasts", "at", "texts").mapInArrow(extract, "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    return main_text(table(spark, sf_dir, "pages"))
