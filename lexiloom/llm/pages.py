"""HTML extraction by minimum-cut labelling.

A page becomes a row of text blocks with the path of elements around each. A classifier rates every
block as content or boilerplate; its log-odds are the block's terminal capacity (towards the source
if content is likelier, else towards the sink). Smoothness edges join neighbours in page order, the
stronger the closer they are in the document tree, and each block with the next one of the same
parent. The maximum flow's minimum cut is the labelling of least cost; blocks on the source's side
are the main text.

The classifier has two parts. What a block looks like (length, links, sentence marks, kind of
element) and how the class and id tokens of its containers name it are weighed by a logistic
regression. It learns from pages that mark their main part (article, main) and is never shown these
marks or the kinds of elements around a block: a block is labelled by whether it lies in the main part;
blocks named as something else within the main part have no label. It is fitted on at most
``SAMPLE_PAGES`` pages (the ones with the smallest hash of page_id) and ``SAMPLE_BLOCKS`` blocks spread
over each: the only bounded sample. The log-odds of looks are held within ``LOOKS``. What the page says
about itself (the marks, elements and roles of navigation and the like, hidden parts) adds set amounts.
Where no page of the sample marks its main part, set weights take the regression's place.

A token names its element by its head noun alone: ``cookie-notice`` and ``comment-list`` are chrome,
``share-price`` is a price, and tokens that tell a state (``has-sidebar``, ``cookies-not-set``) name
nothing. Tokens of html, body, main and article say how a page is laid out, so they do not count. What a
container is said to be holds for all in it, but a container around the page's main part (the largest
article, if all of them are in such containers) is a layout and not chrome.

The flow is pushed by exact reductions as long as a block has two edges or fewer, or a terminal
capacity above all of its edges: its flow goes to its neighbours' terminals and the edge between
them, and the block's side follows from theirs afterwards. Pages are nearly always done with that, in
linear time; what remains is finished along shortest augmenting paths, a level graph at a time.

Edge cases: null and empty html give an empty text; unclosed tags, comments, scripts and quotes run
to the next tag or the end; an unclosed button, svg, object or the like ends where the next block starts or
ends, a self-closing one at once; end tags without a start are skipped; character references may lack
their semicolon; a page without any content block gives an empty text; repeated rows give equal rows;
an empty table gives no rows. Whole pages are read, one row at a time. Only page_id, url and html are read.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.session import table

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style)\b[^>]*+>.*?(?:</\1\b[^>]*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements without text of the page.
SKIPPED = frozenset("noscript template title svg iframe textarea select button object math".split())

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins del kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img".split())
#: Elements that a start tag of the same group ends.
_ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
         "th": {"td", "th", "p"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table div section article main body nav aside footer header form td th blockquote".split())

CONTENT_TAGS, CHROME_TAGS = frozenset(("article", "main")), frozenset("nav footer aside form menu dialog".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promotion recommended related "
    "replies reply share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
CONTENT_WORDS = frozenset("article body content entry main post story text".split())
#: Words after a head noun that say no more than "container", and words that make a token tell a state.
TAIL_WORDS = frozenset("area bar block body box button buttons container content form group holder inner item items left links list outer panel region right section slot unit wrap wrapper".split())
STATE_WORDS = frozenset("accepted active closed disabled enabled fixed has hidden hide is no not off on open set show shown sticky visible with without".split())
#: Elements whose class and id tokens tell of the page's layout.
LAYOUT = frozenset(("html", "body", "main", "article"))

#: Log-odds of what the page says about itself: in its main part, outside a main part that it marks,
#: in a container of another purpose by element or role.
W_MAIN, W_OUTSIDE, W_CHROME_TAG = 3.5, -4.0, -9.0
#: Set weights in the order of :func:`looks`, how many of them are of looks proper, and the most that those count.
DEFAULT, PROPER, LOOKS = (-1.0, -3.0, 1.5, 0.5, 0.5, 1.0, 1.0, -0.5, -9.0, -8.0, 1.0), 8, 3.0
SAMPLE_PAGES, SAMPLE_BLOCKS = 2000, 100
#: Capacities of the smoothness edges.
E_NEXT, E_SIBLING = 1.0, 0.5
_BARRIERS = frozenset(("article", "main", "body"))


def names(tokens: str, content: bool = False) -> int:
    """How class or id tokens name an element: 2 if a token is a word of chrome, 1 if its head noun is, else 0.

    A header is chrome of the page, but not within its main part (``content``).
    """
    best, chrome = 0, CHROME_WORDS if content else CHROME_WORDS | {"header"}
    for token in tokens.split():
        parts = [w.lower() for w in _WORDS.findall(token)]
        if len(parts) > 1 and STATE_WORDS.isdisjoint(parts):
            while len(parts) > 1 and parts[-1] in TAIL_WORDS:
                parts.pop()
            if parts[-1] in chrome:
                best = max(best, 1)
        elif len(parts) == 1 and parts[0] in chrome:
            best = 2
    return best


class _Element:
    __slots__ = ("chrome", "content", "depth", "home", "named", "parent", "size", "tag", "words")

    def __init__(self, tag, parent, attributes):
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.content = bool(parent and parent.content) or tag in CONTENT_TAGS
        #: What is said of the element itself; :func:`_inherit` adds its containers'.
        self.chrome = tag in CHROME_TAGS or (tag == "header" and not self.content)
        self.named = 0
        self.words = bool(parent and parent.words)
        self.home = self if tag in CONTENT_TAGS else parent and parent.home
        self.size = 0
        if attributes:
            for name, *values in _ATTRIBUTE.findall(attributes):
                name, value = name.lower(), "".join(values)
                if name == "role":
                    self.chrome = self.chrome or value.lower() in CHROME_ROLES
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    self.chrome = self.chrome or tag not in ("html", "body", "main")
                elif name in ("class", "id") and tag not in LAYOUT:
                    self.named = max(self.named, names(value, self.content))
                    self.words = self.words or not CONTENT_WORDS.isdisjoint(w.lower() for w in _WORDS.findall(value))


def _inherit(elements: list[_Element]) -> None:
    """Hands down what is said of containers; ``elements`` has parents first."""
    homes = [e for e in elements if e.home is e and e.size]
    within: dict[int, bool] = {}
    for e in elements:
        within[id(e)] = bool(e.chrome or e.named) or (e.parent is not None and within[id(e.parent)])
    if homes and all(within[id(e)] for e in homes):
        e = max(homes, key=lambda e: e.size)
        while e is not None:
            e.chrome, e.named = False, 0
            e = e.parent
    for e in elements[1:]:
        e.chrome, e.named = e.chrome or e.parent.chrome, max(e.named, e.parent.named)


def blocks(page: str):
    """(text, element, link characters) of every text block in page order."""
    root = _Element("", None, "")
    stack, out, elements = [root], [], [root]
    open_at: dict[str, list[int]] = {}  # places of the open elements on the stack, by tag
    barriers = [0]  # places of elements that an end tag of another kind does not reach beyond
    parts: list[str] = []
    links = at = 0
    in_link = False

    def flush():
        nonlocal links, empty
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, holder, links))
            if holder.home:
                holder.home.size += len(text)
        parts.clear()
        links, empty = 0, True

    def add(text):
        nonlocal links, holder, empty
        if "&" in text:
            text = html_lib.unescape(text)
        if empty and not text.isspace():
            holder, empty = stack[-1], False
        parts.append(text)
        if in_link:
            links += len(text.strip())

    def close(place):
        for element in stack[place:]:
            open_at[element.tag].pop()
        del stack[place:]
        while barriers[-1] >= place:
            barriers.pop()

    holder, empty = root, True
    tokens = list(_TOKEN.finditer(page))
    closes, waiting = {}, {tag: [] for tag in SKIPPED}  # end tags of skipped elements, by the place of their start
    for n, m in enumerate(tokens):
        if m[3] and (tag := m[3].lower()) in SKIPPED:
            if not m[2]:
                if not m[4].endswith("/>"):
                    waiting[tag].append(n)
            elif waiting[tag]:
                closes[waiting[tag].pop()] = n
    skip_to, to_edge = -1, False
    for n, m in enumerate(tokens):
        if n <= skip_to:
            at = m.end()
            continue
        tag = (m[3] or "").lower()
        if m.start() > at and not to_edge:
            add(page[at : m.start()])
        to_edge = to_edge and (tag in INLINE or tag in SKIPPED or tag in ("option", "optgroup") or not tag)
        at = m.end()
        if not tag or tag in SKIPPED:
            if m[1] or tag:
                parts.append(" ")
            if tag and not m[2] and not m[4].endswith("/>"):
                skip_to, to_edge = closes.get(n, -1), n not in closes
            continue
        if tag == "a":
            in_link = not m[2]
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if m[2]:
            places = open_at.get(tag)
            if places and (tag in _BARRIERS or tag == "html" or places[-1] >= barriers[-1]):
                close(places[-1])
        else:
            ends = _ENDS.get(tag, {"p"})
            while len(stack) > 1 and stack[-1].tag in ends:
                close(len(stack) - 1)
            if not m[4].endswith("/>"):
                open_at.setdefault(tag, []).append(len(stack))
                if tag in _BARRIERS:
                    barriers.append(len(stack))
                stack.append(_Element(tag, stack[-1], m[4]))
                elements.append(stack[-1])
    if at < len(page) and not to_edge:
        add(page[at:])
    flush()
    _inherit(elements)
    return out


def looks(text: str, element: _Element, links: int) -> tuple[float, ...]:
    """What a block looks like and how its containers are named, without the marks around it."""
    tag = element.tag
    return (
        1.0, min(1.0, links / len(text)), min(1.0, len(text) / 200), float(text[-1] in ".!?:;\"'”"), min(1.0, sum(map(text.count, ",;.")) / 5),
        float(tag in ("h1", "h2", "h3")), float(tag in ("p", "blockquote", "pre")), float(tag == "li"),
        float(element.named == 2), float(element.named == 1), float(element.words),
    )


def terminals(row, weights=DEFAULT) -> list[float]:
    """The classifier's log-odds of a page's blocks: positive for content."""
    if not row:
        return []
    marked = any(element.content for _, element, _ in row)
    x, w = np.array([looks(*block) for block in row]), np.asarray(weights)
    seen = (np.clip(x[:, :PROPER] @ w[:PROPER], -LOOKS, LOOKS) + x[:, PROPER:] @ w[PROPER:]).tolist()
    return [x + (W_MAIN if e.content else W_OUTSIDE * marked) + W_CHROME_TAG * e.chrome for x, (_, e, _) in zip(seen, row, strict=True)]


def fit(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression in which both labels weigh the same; the set weights without both labels.

    Weights of names are drawn towards the set ones, so those that no page shows keep them.
    """
    if not len(y) or y.min() == y.max():
        return DEFAULT
    prior = np.where(np.arange(len(DEFAULT)) < PROPER, 0.0, DEFAULT)
    weight, w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())), prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (y - p)) - 0.1 * (w - prior)
        step = np.linalg.solve((x.T * (weight * p * (1 - p))) @ x + 0.1 * np.eye(len(w)), gradient)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(w.tolist())


def train(pages: DataFrame) -> tuple[float, ...]:
    """The weights of looks, from pages that mark their main part."""
    chosen = pages.where("page_id IS NOT NULL").select(F.col("page_id").alias("id")).distinct()
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), "id"), "id").limit(SAMPLE_PAGES)  # bounded: SAMPLE_PAGES numbers
    sample = pages.where("html IS NOT NULL").select("page_id", "html").join(F.broadcast(chosen), F.col("page_id") == F.col("id"))

    def run(batches):
        for batch in batches:
            for page in batch["html"]:
                row = blocks(page.as_py())
                if any(element.content for _, element, _ in row):
                    row = [b for b in row[:: -(-len(row) // SAMPLE_BLOCKS)] if not (b[1].content and b[1].named)]
                    x = np.array([(*looks(*b), float(b[1].content and not b[1].chrome)) for b in row], dtype="<f4")
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["x"])

    # (Repeated ids may give more rows than ids; the limit holds for rows too.)
    rows = sorted(bytes(r.x) for r in sample.select("html").mapInArrow(run, "x binary").limit(SAMPLE_PAGES).collect())
    x = np.frombuffer(b"".join(rows), "<f4").reshape(-1, len(DEFAULT) + 1).astype(float)
    return fit(x[:, :-1], x[:, -1])


def _distance(a: _Element, b: _Element) -> int:
    """Steps between two elements in the tree."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


def edges(row) -> dict[tuple[int, int], float]:
    """Smoothness capacities between blocks."""
    out: dict[tuple[int, int], float] = {}
    latest: dict[int, int] = {}
    for i, (_, element, _) in enumerate(row):
        if i:
            out[i - 1, i] = E_NEXT / (1 + max(0, _distance(row[i - 1][1], element) - 2))
        parent = id(element.parent)
        if parent in latest:
            pair = (latest[parent], i)
            out[pair] = out.get(pair, 0.0) + E_SIBLING
        latest[parent] = i
    return out


def minimum_cut(terminal: list[float], links: dict[tuple[int, int], float]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut.

    ``terminal`` is positive for capacity from the source, negative for capacity to the sink.
    """
    n, t = len(terminal), list(terminal)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (i, j), c in links.items():
        if c > 0:
            near[i][j] = near[i].get(j, 0.0) + c
            near[j][i] = near[j].get(i, 0.0) + c
    gone: list[tuple[int, dict[int, float]]] = []
    done, queue = [False] * n, deque(range(n))
    while queue:
        i = queue.popleft()
        edges_of = near[i]
        if done[i] or (len(edges_of) > 2 and abs(t[i]) < sum(edges_of.values())):
            continue
        done[i] = True
        gone.append((i, edges_of))
        for j in edges_of:
            del near[j][i]
            queue.append(j)
        if abs(t[i]) >= sum(edges_of.values()):  # all its edges carry its flow
            for j, c in edges_of.items():
                t[j] += c if t[i] > 0 else -c
        elif len(edges_of) == 1:  # its one edge carries all of its own
            t[next(iter(edges_of))] += t[i]
        else:
            # Costs of the neighbours' four labellings once this one has its best side.
            (a, ca), (b, cb) = edges_of.items()
            both, none = min(0.0, t[i] + ca + cb), min(ca + cb, t[i])
            only_b, only_a = min(ca, t[i] + cb), min(cb, t[i] + ca)
            between = max(0.0, (only_b + only_a - both - none) / 2)
            t[a] += only_b - both - between
            t[b] += only_a - both - between
            if between > 0:
                near[a][b] = near[a].get(b, 0.0) + between
                near[b][a] = near[b].get(a, 0.0) + between
    side = [False] * n
    rest = [i for i in range(n) if not done[i]]
    if rest:
        for i in _flow(rest, t, near):
            side[i] = True
    for i, edges_of in reversed(gone):
        side[i] = _side(t[i], edges_of, side)
    return side


def _side(own: float, edges_of: dict[int, float], side: list[bool]) -> bool:
    """The cheaper side of a node whose neighbours have theirs."""
    return own + sum(c if side[j] else -c for j, c in edges_of.items()) > 0


def _flow(nodes, terminal, near) -> set[int]:
    """Nodes that the source still reaches after a maximum flow.

    A breadth-first search from the source gives every node its level; paths that climb a level at
    each step are filled until none is left, then levels are found anew.
    """
    source, sink, least = -1, -2, 1e-12
    residual: dict[int, dict[int, float]] = {i: dict(near[i]) for i in nodes} | {source: {}, sink: {}}
    for i in nodes:
        residual[source][i], residual[i][source] = max(terminal[i], 0.0), 0.0
        residual[i][sink], residual[sink][i] = max(-terminal[i], 0.0), 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in residual[i].items():
                if c > least and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level) - {source}
        ahead = {i: [j for j in residual[i] if level.get(j) == level[i] + 1] for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                amount = min(residual[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    residual[a][b] -= amount
                    residual[b][a] += amount
                full = next(k for k, (a, b) in enumerate(zip(path, path[1:], strict=False)) if residual[a][b] <= least)
                del path[full + 1 :]
                continue
            while ahead[i] and residual[i][ahead[i][-1]] <= least:
                ahead[i].pop()
            if ahead[i]:
                path.append(ahead[i][-1])
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


def main_text(page: str | None, weights=DEFAULT) -> str:
    """The content blocks of one page, joined by blank lines."""
    row = blocks(page or "")
    keep = minimum_cut(terminals(row, weights), edges(row))
    return "\n\n".join([b[0] for b, k in zip(row, keep, strict=True) if k])


def extract(pages: DataFrame, weights=DEFAULT) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch["html"]]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_mincut_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return extract(pages, train(pages))


QUERIES = {"op5_mincut_extraction": (op5_mincut_extraction, None)}
