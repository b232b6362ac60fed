"""HTML extraction (operator 4): composite text density.

Tags and roles that never hold an article are left out. Every other node gets
its characters per tag, adjusted for links, and weighed down if its class or id
names an advert, a menu and so on; each node's sum is that of its children's
densities. The subtree with the largest sum is the article. The least density on
its path to the body is the threshold: the subtree grows upwards as long as
sizeable neighbours reach it, and nodes with such a name inside it go unless
they reach it in spite of their weight. Work is linear in the page.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import batch, table

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements without content, and elements whose content is not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe template noembed noframes xmp".split())
#: Elements that end a line of text.
BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that an opening tag of these closes, up to the nearest of the elements that hold them.
CLOSES = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
PARAGRAPH_END = BLOCK - {"br", "body", "html", "head"}
#: What is never part of an article.
DROPPED_TAGS = frozenset("head nav footer aside button select textarea script style noscript template iframe svg canvas object menu dialog title input".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Names of what is rarely part of an article; words before a name that say that the element only goes with such a thing.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related "
    "respond share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
ABOUT = frozenset("has no not with without".split())
#: Names that count outside an article only: inside, they hold its title.
HEADER_NAMES = frozenset({"header", "topbar"})
KEPT_TAGS = frozenset({"html", "body", "article", "main"})
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Weight of the density of elements with one of the names; share of the chosen text from which a neighbour is sizeable.
NAMED, SIZEABLE = 0.1, 0.2
ROWS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def is_left_out(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is a menu and so on by its tag or role."""
    if tag in DROPPED_TAGS or (tag == "header" and not inside):
        return True
    if tag in KEPT_TAGS or "role" not in attributes.lower():
        return False
    return any(n.lower() == "role" and (x or y or z).strip().lower() in DROPPED_ROLES for n, x, y, z in ATTRIBUTE.findall(attributes))


def weight(tag: str, attributes: str, inside: bool) -> float:
    """1, or NAMED if the element's class or id names what is rarely part of an article."""
    if not attributes or tag in KEPT_TAGS:
        return 1.0
    for name, x, y, z in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in (x or y or z).split():
                parts = [p.lower() for p in PART.findall(token)]
                for i, p in enumerate(parts):
                    if p in ABOUT:
                        break
                    if p in NAMES or (p in HEADER_NAMES and not inside and i == 0):
                        return NAMED
    return 1.0


class Page:
    """Nodes in page order, and the text between tags with the node that holds it."""

    def __init__(self, source: str):
        self.tag, self.parent, self.end, self.drop, self.weight = ["#page"], [-1], [0], [False], [1.0]
        self.text: list[tuple[int, str]] = []  # node, text; node -1 ends a block
        open_nodes: list[int] = [0]
        depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open nodes of each tag
        blocks: list[int] = []  # depths of the open block elements other than p
        at = inside = 0
        while True:
            found = TAG.search(source, at)
            stop = found.start() if found else len(source)
            if stop > at:
                self.text.append((open_nodes[-1], html.unescape(source[at:stop])))
            if not found:
                break
            at = found.end()
            tag = (found[2] or found[5] or "").lower()
            if not tag:
                continue
            if tag in BLOCK:
                self.text.append((-1, ""))
            if found[1] or found[4]:
                if depths[tag]:
                    inside -= self._close(depths[tag][-1], open_nodes, depths, blocks)
                continue
            closed, bounds = CLOSES.get(tag, ((), ()))
            if tag in PARAGRAPH_END:
                closed = (*closed, "p")
            while True:
                # the nearest node to close and the nearest that bounds the search, without a walk over what is open
                depth = max((depths[x][-1] for x in closed if depths[x]), default=0)
                bound = max([depths[x][-1] for x in bounds if depths[x]] + ([] if tag in CLOSES else blocks[-1:]), default=0)
                if not depth or depth < bound:
                    break
                name = self.tag[open_nodes[depth]]
                inside -= self._close(depth, open_nodes, depths, blocks)
                if tag not in CLOSES or name != "p":
                    break
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(open_nodes[-1])
            self.end.append(node + 1)
            attributes = found[3] or found[6] or ""
            self.drop.append(self.drop[open_nodes[-1]] or is_left_out(tag, attributes, inside > 0))
            self.weight.append(weight(tag, attributes, inside > 0))
            if tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(source, at)
                at = closing.start() if closing else len(source)
                if closing:
                    at = (source.find(">", at) + 1) or len(source)
                self.drop[node] = True
            elif tag not in VOID and not attributes.endswith("/"):
                depths[tag].append(len(open_nodes))
                if tag in BLOCK and tag != "p":
                    blocks.append(len(open_nodes))
                open_nodes.append(node)
                inside += tag in ("article", "main")
        for node in open_nodes:
            self.end[node] = len(self.tag)

    def _close(self, depth: int, open_nodes: list[int], depths: dict[str, list[int]], blocks: list[int]) -> int:
        """Ends the open nodes from this depth on; how many of them hold an article."""
        articles = 0
        while len(open_nodes) > depth:
            node = open_nodes.pop()
            tag = self.tag[node]
            depths[tag].pop()
            if tag in BLOCK and tag != "p":
                blocks.pop()
            self.end[node] = len(self.tag)
            articles += tag in ("article", "main")
        return articles


def sizes(page: Page) -> tuple[list[int], list[int], list[int], list[int]]:
    """Characters, characters in links, tags and links of each node with all below it; none of what is dropped."""
    n = len(page.tag)
    chars, link_chars, tags, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = page.tag[i] == "a" or linked[page.parent[i]]
    for node, text in page.text:
        if node >= 0 and not page.drop[node]:
            size = len(" ".join(text.split()))
            chars[node] += size
            if linked[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if not page.drop[i]:
            p = page.parent[i]
            tags[p] += tags[i] + (page.tag[i] not in VOID)
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
    return chars, link_chars, tags, link_tags


def drop_forms(page: Page) -> None:
    """Drops forms, but for those that hold at least half of the page's text."""
    if "form" not in page.tag:
        return
    chars = sizes(page)[0]
    for i, tag in enumerate(page.tag):
        if page.drop[page.parent[i]] or (tag == "form" and 2 * chars[i] < chars[0]):
            page.drop[i] = i > 0


def densities(page: Page) -> tuple[list[float], list[float], list[int]]:
    """Composite text density of each node, the sum over its children, its characters."""
    n = len(page.tag)
    chars, link_chars, tags, link_tags = sizes(page)
    share = link_chars[0] / chars[0] if chars[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, lc, t, lt = chars[i], link_chars[i], max(tags[i], 1), max(link_tags[i], 1)
        if c and not page.drop[i]:
            base = math.log(c / max(c - lc, 1) * lc + share * c + math.e)
            ratio = c / max(lc, 1) * t / lt
            density[i] = page.weight[i] * c / t * (math.log(ratio) / math.log(base) if base > 1 else math.log(ratio)) if ratio > 1 else 0.0
        if i:
            total[page.parent[i]] += density[i]
    return density, total, chars


def article(page: Page) -> tuple[int, float, list[float], set[int]]:
    """The node whose text is the article's, the threshold, the densities, and the path from the densest place to the body."""
    drop_forms(page)
    density, total, chars = densities(page)
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    kept = [i for i in range(body, page.end[body]) if not page.drop[i]]
    best = max(kept, key=lambda i: (total[i] * page.weight[i], -i), default=body)
    if not total[best]:
        best = max(kept, key=lambda i: (density[i], -i), default=body)
    path = [best]
    while path[-1] != body and page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    threshold = min((density[i] / page.weight[i] for i in path if density[i] > 0), default=0.0)
    root, children = best, {}
    on_path = set(path)
    for i in kept:
        if page.parent[i] in on_path:
            children.setdefault(page.parent[i], []).append(i)
    for above in path[1:]:
        if page.tag[root] == "article" or (page.tag[root] == "main" and page.tag[above] != "article"):
            break
        others = [i for i in children.get(above, []) if i not in on_path and density[i] > 0]
        sizeable = any(density[i] >= threshold and chars[i] >= SIZEABLE * chars[root] for i in others)
        titled = any(page.tag[i] in HEADINGS for i in others) or page.tag[above] in ("article", "main")
        if sizeable or titled or page.tag[root] not in BLOCK or page.tag[root] == "p":
            root = above
    return root, threshold, density, on_path


def main_text(source: str) -> str:
    """The article's text: a line for each block, white space collapsed."""
    page = Page(source)
    root, threshold, density, on_path = article(page)
    for i in range(root + 1, page.end[root]):
        page.drop[i] |= page.drop[page.parent[i]] or (page.weight[i] < 1 and i not in on_path and density[i] < threshold)
    blocks, held = [], []
    for node, text in [*page.text, (-1, "")]:
        if node < 0:
            if held and (line := " ".join("".join(held).split())):
                blocks.append(line)
            held = []
        elif root <= node < page.end[root] and not page.drop[node]:
            held.append(text)
    return "\n".join(blocks)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html).

    A map without shuffle. Null or empty html gives an empty text; broken markup
    is read as far as it goes; repeated rows and null ids and urls give rows like
    any others; further columns are not read.
    """

    def run(batches):
        for rows in batches:
            for at in range(0, rows.num_rows, 256):
                part = rows.slice(at, 256)
                texts = [main_text(x.as_py() or "") for x in part.column(2)]
                yield batch(ROWS, {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": list(map(len, texts))})

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_extraction": op4_html_extraction}
ORACLES: dict[str, str] = {}
