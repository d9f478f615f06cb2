"""Operator 7: main-text extraction by tag-path ratios.

A page is cut into blocks of text, each with its root-to-leaf tag path.  For
every path the text length and the punctuation of its blocks are averaged; both
ratios are smoothed along the page, fused into one score by their product, and
the paths that reach the threshold are the content paths.  The content nodes are
the articles (or the main part) that hold a fair share of the content paths'
weight; on a page without them, the deepest node that holds the bulk of it, with the
headings before it on its path.  Of a content node, all blocks are main text but those of inner containers that hold no
content path and little but links.  Parts that are never article text whatever
their ratios (menus, page headers and footers, sidebars, notices, adverts, forms,
reader comments) are known by tag, role or class and do not count.

Reading takes time in proportion to the page, however broken its markup is: tags
are found one after another, paths and nodes are numbered as they open.

Defined edge cases: null or empty html and pages without text give an empty
string; broken markup is read as far as it goes (an unclosed paragraph ends at
the next block); whole pages are read however long they are; repeated rows give
repeated results; an empty table gives an empty result; only ``page_id``,
``url`` and ``html`` are read, so extra columns never clash.
"""

from __future__ import annotations

import html as references
import math
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

# fixed values of the HTML standard
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never article text.
NEVER = frozenset("nav footer aside form button select menu head title dialog noscript iframe object svg canvas template datalist label legend fieldset input option optgroup search".split())
#: Words of a class, id or role that mark such parts.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus discussion footer form masthead menu modal nav navbar navigation newsletter notice notices popup promo promoted promotion recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that mark a part only outside the article itself.
OUTER = frozenset("header banner search form".split())
#: Elements that hold running text themselves: only words of adverts and comments mark them.
TEXTUAL = frozenset("p li dd dt blockquote pre h1 h2 h3 h4 h5 h6 td th span b i em strong a article".split())
ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored sponsor promo promoted promotion comment comments reply replies disqus related recommended".split())
#: Words that stand beside a mark in the names of such parts; inside an article a name with any other word is no mark.
BESIDE = frozenset("a all and area article articles bar block body bottom box btn button buttons card col column container count counter desktop end entry for form fixed group has head heading holder icon icons in inline inner is item items js layout left link links list main media mobile module of on outer overlay page panel placeholder post posts right row section show site slot sticky stories story text the thread title to tools top unit widget widgets wrap wrapper zone".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea xmp".split())
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTES = re.compile(r"""(?:[^>"']+|"[^"]*"|'[^']*')*""")
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Punctuation that running text has.
_STOPS = re.compile(r"[.,;:!?…。、，！？]")
SMOOTH = 0.35
THRESHOLD = 0.4
#: The share of the weight that makes a node the content, and an article's share of the heaviest one's.
BULK, FAIR = 0.6, 0.15
#: The share of link text from which a container without content paths is a list of links.
LINKS = 0.5
#: Bytes of html whose texts a worker gathers at once.
CHARS = 4_000_000


class Block(NamedTuple):
    text: str
    path: int
    node: int  # the element that holds its first text, or -1
    links: int  # characters inside links


class Page(NamedTuple):
    """Blocks in page order; of each element its parent (or -1) and its tag."""

    blocks: list[Block]
    parent: list[int]
    tag: list[str]


def marked(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element and all it holds is no article text."""
    if tag in NEVER or tag == "header" and not inside:
        return True
    for name, value in _MARK.findall(attributes) if attributes else ():
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and "true" in value:
            return True
        known = ADVERTS if tag in TEXTUAL else MARKS - OUTER if inside else MARKS | OUTER
        for one in value.split():
            # a camel-case or hyphened name counts by its words; inside an article it must be of marks as a whole
            words = set(_WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", one).lower()))
            if words & known and (not inside or words <= MARKS | ADVERTS | BESIDE):
                return tag not in ("html", "body", "main")
    return False


def tags(page: str):
    """(text before, name or None, whether it closes, attributes) of each tag, and the text after the last."""
    low, n = None, len(page)
    at, quoted = 0, True
    text = 0
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield page[text:at], None, False, ""
        elif page.startswith(("<!", "<?"), at):
            end = page.find(">", at)
            end = n if end < 0 else end + 1
            yield page[text:at], None, False, ""
        else:
            name = _NAME.match(page, at + 1)
            if not name:
                at += 1
                continue
            end = name.end()
            if quoted:
                end = _ATTRIBUTES.match(page, end).end()
            if end >= n or page[end] != ">":
                quoted = False  # a quote that nothing closes: from here on quotes do not count
                end = page.find(">", name.end())
                if end < 0:
                    break  # no tag ends any more, so the rest is text
            yield page[text:at], name[0].lstrip("/").lower(), name[0][0] == "/", page[name.end() : end]
            end += 1
            if name[0].lower() in RAW:
                low = page.lower() if low is None else low
                low = low if len(low) == n else page  # where lower case has another length
                end = low.find("</" + name[0].lower(), end)
                if end < 0:
                    return
                end = page.find(">", end) + 1 or n
        at = text = end
    yield page[text:], None, False, ""


def parsed(page: str) -> Page:
    """A page's blocks that may be article text."""
    out: list[Block] = []
    parent, names, paths = [], [], []
    numbers: dict[tuple[int, str], int] = {}
    # an open element: tag, node, whether it is out, whether it is in an article, whether in a link
    stack: list[tuple[str, int, bool, bool, bool]] = []
    opened: dict[str, int] = {}
    parts: list[str] = []
    place, links = -2, 0

    def flush() -> None:
        nonlocal place, links
        if parts and place > -2:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, paths[place] if place >= 0 else -1, place, links))
        parts.clear()
        place, links = -2, 0

    def close(k: int) -> None:
        if any(s[0] in BLOCKS for s in stack[k:]):
            flush()
        for s in stack[k:]:
            opened[s[0]] -= 1
        del stack[k:]

    for text, tag, ends, attributes in tags(page):
        if text and not (stack and stack[-1][2]):
            text = references.unescape(text)
            parts.append(text)
            if text.strip():
                place = (stack[-1][1] if stack else -1) if place == -2 else place
                links += len(text) if stack and stack[-1][4] else 0
        if tag is None or tag in RAW:
            continue
        if ends:
            if not opened.get(tag):
                if tag in BLOCKS:
                    flush()
                continue
            # an inline end tag does not close blocks
            k = len(stack) - 1
            while stack[k][0] != tag and (tag in BLOCKS or stack[k][0] not in BLOCKS):
                k -= 1
            if stack[k][0] == tag:
                close(k)
            continue
        if tag in BLOCKS:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCKS), -1)
            top = stack[k][0] if k >= 0 else ""
            if top == "p" or top == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option") or {top, tag} == {"dt", "dd"} or top in HEADINGS and tag in HEADINGS or top == "head" and tag == "body":
                close(k)
            flush()
        if tag in EMPTY:
            if tag == "br" and not (stack and stack[-1][2]):
                parts.append(" ")
            continue
        if attributes.endswith("/") and tag not in BLOCKS:
            continue
        above, dropped, inside, link = stack[-1][1:] if stack else (-1, False, False, False)
        inside = inside or tag in ("article", "main")
        parent.append(above)
        names.append(tag)
        paths.append(numbers.setdefault((paths[above] if above >= 0 else -1, tag), len(numbers)))
        stack.append((tag, len(parent) - 1, dropped or marked(tag, attributes, inside), inside, link or tag == "a"))
        opened[tag] = opened.get(tag, 0) + 1
        if stack[-1][2] and not dropped and tag in BLOCKS:
            flush()
    flush()
    return Page(out, parent, names)


def ratios(found: list[Block]) -> np.ndarray:
    """Of each block: the fused and smoothed ratios of its tag path, of the page's largest."""
    by_path: dict[int, list[float]] = {}
    for b in found:
        total = by_path.setdefault(b.path, [0, 0, 0])
        total[0] += 1
        total[1] += len(b.text)
        total[2] += len(_STOPS.findall(b.text))
    length = np.array([by_path[b.path][1] / by_path[b.path][0] for b in found])
    stops = np.array([by_path[b.path][2] / by_path[b.path][0] for b in found])
    fused = np.sqrt(smoothed(length) * (1 + smoothed(stops)))
    return fused / max(fused.max(), 1e-9)


def smoothed(values: np.ndarray) -> np.ndarray:
    """Along the page, with part of each neighbour."""
    side = np.concatenate([values[:1], values, values[-1:]])
    return (values + SMOOTH * (side[:-2] + side[2:])) / (1 + 2 * SMOOTH)


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends."""
    found, parent, tag = parsed(page or "")
    if not found:
        return ""
    score = ratios(found)
    by_path: dict[int, list[float]] = {}
    for b, s in zip(found, score.tolist(), strict=True):
        sums = by_path.setdefault(b.path, [0, 0, 0, 0])
        for k, x in enumerate((1, s, len(b.text), b.links)):
            sums[k] += x
    # a path of links is none of content, whatever stands next to it
    content = {p for p, (many, s, size, links) in by_path.items() if s >= THRESHOLD * many and links <= LINKS * size}
    n = len(parent)
    # of each node with all it holds: weight of content paths, characters, those in links
    weight, size, links = [0.0] * n, [0] * n, [0] * n
    total = 0.0
    for b in found:
        w = math.sqrt(len(b.text)) * (1 + len(_STOPS.findall(b.text))) if b.path in content else 0.0
        total += w
        if b.node >= 0:
            weight[b.node] += w
            size[b.node] += len(b.text)
            links[b.node] += b.links
    for k in range(n - 1, -1, -1):  # children come after their parents
        if parent[k] >= 0:
            weight[parent[k]] += weight[k]
            size[parent[k]] += size[k]
            links[parent[k]] += links[k]
    depth, owner = [0] * n, [-1] * n  # and the outermost article or main part around it
    for k in range(n):
        up = parent[k]
        depth[k] = depth[up] + 1 if up >= 0 else 0
        outer = owner[up] if up >= 0 else -1
        # an article in the main part is a node of its own
        owner[k] = k if tag[k] == "article" and (outer < 0 or tag[outer] == "main") or tag[k] == "main" and outer < 0 else outer
    articles: dict[int, float] = {}
    for b in found:
        if b.node >= 0 and owner[b.node] >= 0 and b.path in content:
            articles[owner[b.node]] = articles.get(owner[b.node], 0) + math.sqrt(len(b.text)) * (1 + len(_STOPS.findall(b.text)))
    if articles and sum(articles.values()) >= BULK * total:
        chosen = {k for k, w in articles.items() if w >= FAIR * max(articles.values())}
        inside = [b.node >= 0 and owner[b.node] in chosen for b in found]
        top = chosen
    else:
        bulk = [k for k in range(n) if weight[k] >= BULK * total]
        if not bulk:
            return "\n".join(b.text for b in found if b.path in content)
        # a paragraph is no container
        node = max(bulk, key=lambda k: (depth[k], k))
        while parent[node] >= 0 and tag[node] not in ("div", "section", "td", "body", "center", "dd", "article", "main"):
            node = parent[node]
        below = [False] * n
        for k in range(n):
            below[k] = k == node or parent[k] >= 0 and below[parent[k]]
        inside = [b.node >= 0 and below[b.node] for b in found]
        top = {node}
        # headings before it that stand next to it or to a part around it belong to it; of the page itself only a single h1 does
        around, k, single = set(), parent[node], tag.count("h1") == 1
        while k >= 0:
            around.add(k)
            k = parent[k]
        first = inside.index(True) if True in inside else len(found)
        for i, b in enumerate(found[:first]):
            k = b.node
            while k >= 0 and tag[k] not in HEADINGS and parent[k] not in around:
                k = parent[k]
            if k < 0 or tag[k] not in HEADINGS:
                continue
            up = parent[k]
            while up >= 0 and tag[up] in ("hgroup", "header"):
                up = parent[up]
            if up in around and (tag[up] not in ("body", "html", "table", "tr", "tbody") or single and tag[k] == "h1"):
                inside[i] = True
    # inner containers of links alone
    out = [False] * n
    for k in range(n):
        up = parent[k]
        bare = k not in top and tag[k] in ("div", "section", "ul", "ol", "table", "dl") and not weight[k] and links[k] > LINKS * size[k]
        out[k] = bare or up >= 0 and out[up] and k not in top
    return "\n".join(b.text for b, i in zip(found, inside, strict=True) if i and not out[b.node])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def run(batches):
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHARS, side="right")))
                part = batch.slice(at, to - at)
                texts = [main_text(h.as_py()) for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
                )
                at = to

    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
