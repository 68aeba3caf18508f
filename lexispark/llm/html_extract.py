"""Main-text extraction from HTML by minimum-cut labelling (operator 4).

A page is cut into text blocks (runs of text between block-level tags). A classifier gives each
block a log-odds of being content; the costs of the two labels are the capacities of its edges
to the terminals. Neighbouring blocks, and neighbouring children of one parent, are joined by
smoothness edges that weaken with their distance in the DOM and where semantic cues change. The
maximum flow's cut is the cheapest labelling of the page; content blocks are joined in page order.

The classifier is a logistic model over features of the text (length, links, punctuation, kind of
tag, place, share of the page's text and headings under the same parent) and two cues, for and against, from the
innermost semantic evidence about a block: tags, roles, words of class and id. It is fitted on a
bounded sample of pages whose evidence labels their blocks; every block is shown twice, with its
cues and without, so that the features of the text must tell blocks apart where a page has no such
markup. The text's part is held between -``TEXT_LIMIT`` and ``TEXT_LIMIT``; a cue weighs what the
fit gives it, at most ``CUE_LIMIT``, so a text that is clear outweighs any cue. Both are of the order
of a block's edges, so a block that its own features leave in doubt gets the label that its
surroundings make cheapest.

Edge cases: null and empty pages give the empty text; broken nesting and unclosed tags are
read leniently; an unclosed script or style runs to the end of the page; hidden elements never
count; very long and deeply nested pages are read whole, in time and memory that follow the page
but for the flow among undecided blocks; blocks of equal cost either way are boilerplate; rows with
a null key and repeated rows are extracted like others; an empty table gives no rows (and the
default weights); extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import map_rows

#: Pages of the fit's sample, and blocks of each, evenly spread, that it takes.
FIT_PAGES = 400
FIT_BLOCKS = 200
TEXT_LIMIT, CUE_LIMIT = 4.0, 3.0
#: Edges between neighbours in the page (over 1 + distance) and between neighbouring children; both
#: are divided by 1 + CUE_CONTRAST for each step between against, none and for.
SMOOTH_NEXT, SMOOTH_SIBLING, CUE_CONTRAST = 1.0, 6.0, 4.0

#: Fixed by HTML: elements that start a block, that have no content, and whose text is no text.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style template noscript textarea iframe object svg math canvas title select".split())
#: Elements that an opening tag closes if it is open in the same container.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | {f"h{n}": {"p"} for n in range(1, 7)} | {t: {"p"} for t in "article aside blockquote div dl fieldset footer form header main nav ol pre section table ul".split()}
SCOPES = frozenset("article aside blockquote body div footer form header main nav ol section table td th ul dl".split())

AGAINST_TAGS = frozenset("nav footer aside form menu dialog button label input fieldset search".split())
FOR_TAGS = frozenset(["article", "main"])
AGAINST_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
FOR_ROLES = frozenset(["main", "article"])
AGAINST_WORDS = frozenset("nav navbar navigation menu menus sidebar side footer header masthead banner ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager comment comments commentlist respond reply replies disqus widget widgets toolbar copyright legal disclaimer tags byline meta skip toc".split())
FOR_WORDS = frozenset("article content main post entry story articlebody maincontent postcontent prose".split())

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")
_WORDS = re.compile(r"[a-z]+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW_TAGS}


class Block:
    __slots__ = ("evidence", "hidden", "home", "link", "tag", "text")

    def __init__(self, text: str, link: int, node: _Node, tag: str):
        self.text, self.link, self.tag = text, link, tag
        self.evidence, self.hidden, self.home = node.evidence, node.hidden, node.home


class _Node:
    """An open element: what it says about the text in it. ``home`` is the block-level element it
    is in (itself, if it is one), ``up`` a block-level element's own parent of that kind."""

    __slots__ = ("depth", "evidence", "hidden", "home", "link", "name", "up")

    def __init__(self, name: str, above: _Node | None, attrs: dict[str, str]):
        self.name = name
        if above is None or name in BLOCK_TAGS:
            self.home, self.up = self, above.home if above else None
            self.depth = self.up.depth + 1 if self.up else 0
        else:
            self.home = above.home
        style = attrs.get("style", "").replace(" ", "").lower()
        self.hidden = bool(above and above.hidden) or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
        self.link = name == "a" or bool(above and above.link)
        own = _own_evidence(name, attrs, above)
        self.evidence = own if own is not None else (above.evidence if above else 0)


class _Stack:
    """Open elements. Where the last one of a name, block or scope is, is known without a search,
    so reading a page takes time that follows its length however deep it is nested."""

    def __init__(self):
        self.nodes = [_Node("#root", None, {})]
        self.named: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def top(self) -> _Node:
        return self.nodes[-1]

    def last(self, name: str) -> int:
        """Place of the last open element of a name; 0, the root's, if there is none."""
        places = self.named.get(name)
        return places[-1] if places else 0

    def last_block(self) -> int:
        return self.blocks[-1] if self.blocks else 0

    def push(self, name: str, attrs: dict[str, str]) -> None:
        at = len(self.nodes)
        self.nodes.append(_Node(name, self.nodes[-1], attrs))
        self.named.setdefault(name, []).append(at)
        if name in BLOCK_TAGS:
            self.blocks.append(at)
        if name in SCOPES:
            self.scopes.append(at)

    def cut(self, at: int) -> None:
        """Close the element at a place and all that are open in it."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            for places in (self.named.get(node.name), self.blocks, self.scopes):
                if places and places[-1] == len(self.nodes):
                    places.pop()

    def open_for(self, name: str) -> None:
        """Close what an opening tag closes in the same container."""
        at = max((self.last(other) for other in CLOSES.get(name, ())), default=0)
        if at and at >= (self.scopes[-1] if self.scopes else 0):
            self.cut(at)

    def end_link(self) -> None:
        """Links do not nest: one that is open in the same block ends where another begins."""
        at = self.last("a")
        if at > self.last_block():
            node = self.nodes[at]
            self.named["a"].pop()
            node.name, node.link = "", self.nodes[at - 1].link


def _own_evidence(name: str, attrs: dict[str, str], above: _Node | None) -> int | None:
    role = attrs.get("role", "").lower()
    if name in AGAINST_TAGS or role in AGAINST_ROLES:
        return -1
    if name in FOR_TAGS or role in FOR_ROLES:
        return 1
    if name == "header":  # an article's own header holds its title
        return 0 if above and above.evidence > 0 else -1
    if name in ("html", "body"):
        return None
    if named := attrs.get("class", "") + " " + attrs.get("id", ""):
        words = set(_WORDS.findall(named.lower()))
        against, favour = words & AGAINST_WORDS, words & FOR_WORDS
        if against and not (favour and against <= {"header", "meta", "tags"}):
            return -1
        if favour and not against:
            return 1
        if against:
            return 0
    return None


def blocks(html: str | None) -> list[Block]:
    """Text blocks in page order, white space normalised, empty ones left out."""
    html = html or ""
    stack, found, parts, linked, at = _Stack(), [], [], 0, 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                holder = stack.last_block()
                found.append(Block(text, min(linked, len(text)), stack.top(), stack.nodes[holder].name if holder else ""))
        parts, linked = [], 0

    def say(raw: str):
        nonlocal linked
        if raw:
            text = unescape(raw)
            parts.append(text)
            if stack.top().link:
                linked += len(text.strip())

    while at < len(html):
        match = _MARKUP.search(html, at)
        if not match:
            say(html[at:])
            break
        say(html[at : match.start()])
        at = match.end()
        name = (match["name"] or "").lower()
        if not name:
            if match["cdata"]:
                say(match["cdata"])
            continue
        if match["close"]:
            place = stack.last(name)
            if name in ("br", "p") and not place:
                parts.append(" ")
            elif place and (name in BLOCK_TAGS or stack.last_block() <= place):  # an inline end tag does not close the blocks inside it
                if stack.last_block() >= place:
                    flush()
                stack.cut(place)
            continue
        if name in RAW_TAGS:
            if name in BLOCK_TAGS:
                flush()
            end = _RAW_END[name].search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK_TAGS:
            flush()
            stack.open_for(name)
        elif name == "a":
            stack.end_link()
        if name not in VOID_TAGS:
            attrs = {}
            if match["attrs"].strip():
                for a in _ATTR.finditer(match["attrs"]):
                    attrs.setdefault((a[1] or a[5]).lower(), unescape(a[2] or a[3] or a[4] or ""))
            if not match["attrs"].rstrip().endswith("/") or name in BLOCK_TAGS or name == "a":
                stack.push(name, attrs)
    flush()
    return found


# --- classifier --------------------------------------------------------------------------

#: Used where a sample has no labelled blocks: bias, then a weight per feature of ``features``.
DEFAULT_WEIGHTS = np.array([-1.0, 0.9, -4.0, 1.5, 0.8, 0.8, -1.0, -0.5, -1.5, 0.5, -1.0, 1.0, 3.0, -3.0])
CUES = 2  # the last features
HEADINGS = frozenset(["h1", "h2", "h3"])


def features(found: list[Block]) -> np.ndarray:
    """Per block: 1, log words, share of linked text, ends a sentence, log sentence marks,
    heading, list item, short without a mark, near the page's ends, share of the page's unlinked
    text in the block's company, loose in the page, a heading in its company; then the cues for and
    against. A block's company are the blocks under the same parent, those with a cue against and
    the others apart."""
    out = np.zeros((len(found), len(DEFAULT_WEIGHTS)))
    free = [len(b.text) - b.link for b in found]
    holders = [b.home.up or b.home for b in found]
    company = [(holder, b.evidence < 0) for holder, b in zip(holders, found, strict=True)]
    under: dict[tuple[_Node, bool], int] = {}
    for at, n in zip(company, free, strict=True):
        under[at] = under.get(at, 0) + n
    headed = {at for at, b in zip(company, found, strict=True) if b.tag in HEADINGS}
    total = max(1, sum(free))
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        marks = b.text.count(". ") + b.text.count("? ") + b.text.count("! ") + b.text.count(", ")
        ends = b.text[-1] in ".!?:\"”»"
        edge = min(i, len(found) - 1 - i) / max(1, len(found))
        share, loose = under[company[i]] / total, holders[i].name in ("#root", "html", "body")
        out[i] = (1, np.log1p(words), b.link / len(b.text), ends, np.log1p(marks), b.tag in HEADINGS, b.tag in ("li", "td", "dd", "option"), words < 6 and not ends, edge < 0.05, share, loose, company[i] in headed, b.evidence > 0, b.evidence < 0)
    return out


def log_odds(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of content, per row of ``features``: the bounded part of the text and the cues' weights."""
    return np.clip(x[:, :-CUES] @ weights[:-CUES], -TEXT_LIMIT, TEXT_LIMIT) + x[:, -CUES:] @ weights[-CUES:]


def labelled_features(html: str | None) -> np.ndarray:
    """Features of at most FIT_BLOCKS blocks of a page that its evidence labels."""
    found = [b for b in blocks(html) if not b.hidden]
    x = features(found)
    x = x[x[:, -CUES:].any(axis=1)]
    return x[np.unique(np.linspace(0, len(x) - 1, FIT_BLOCKS).astype(int))] if len(x) > FIT_BLOCKS else x


def fit(pages: list[str]) -> np.ndarray:
    return fit_features([labelled_features(html) for html in pages])


def fit_features(parts: list[np.ndarray]) -> np.ndarray:
    """Logistic regression (Newton steps) on blocks labelled by their cues, each shown with its
    cues and without."""
    x = np.concatenate([np.empty((0, len(DEFAULT_WEIGHTS))), *parts])
    y = x[:, -CUES]
    if len(np.unique(y)) < 2:
        return DEFAULT_WEIGHTS
    bare = x.copy()
    bare[:, -CUES:] = 0.0
    x, y = np.concatenate([x, bare]), np.concatenate([y, y])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        curvature = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w += np.linalg.solve(curvature, x.T @ (y - p) - 0.5 * w)
    w[-2], w[-1] = np.clip(w[-2], 0.0, CUE_LIMIT), np.clip(w[-1], -CUE_LIMIT, 0.0)
    return w


# --- the cut -----------------------------------------------------------------------------


def _apart(a: _Node, b: _Node) -> int:
    """Steps from one block-level element to the other by their nearest common one."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def smoothness(found: list[Block]) -> dict[tuple[int, int], float]:
    """Edges between blocks that follow each other or follow each other under one parent."""
    edges: dict[tuple[int, int], float] = {}
    last_child: dict[_Node, int] = {}
    contrast = lambda a, b: 1.0 + CUE_CONTRAST * abs(a.evidence - b.evidence)
    for i, b in enumerate(found):
        if i:
            edges[i - 1, i] = SMOOTH_NEXT / (1 + _apart(found[i - 1].home, b.home)) / contrast(found[i - 1], b)
        holder = b.home.up or b.home
        if holder in last_child:
            before = last_child[holder]
            edges[before, i] = edges.get((before, i), 0.0) + SMOOTH_SIBLING / contrast(found[before], b)
        last_child[holder] = i
    return edges


def minimum_cut(logits: np.ndarray, edges: dict[tuple[int, int], float]) -> list[bool]:
    """The labelling (True: content) of least cost; ties are boilerplate.

    Blocks whose own log-odds outweigh all their edges have the sign's label in every optimal
    labelling; they are settled first and their edges become terms of their neighbours. What
    is left goes through a maximum flow.
    """
    own = [float(z) for z in logits]
    near: list[dict[int, float]] = [{} for _ in own]
    for (a, b), weight in edges.items():
        if weight > 0:
            near[a][b] = near[a].get(b, 0.0) + weight
            near[b][a] = near[b].get(a, 0.0) + weight
    label: list[bool | None] = [None] * len(own)
    todo = deque(range(len(own)))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(own[i]) > sum(near[i].values()):
            label[i] = own[i] > 0
            for j, weight in near[i].items():
                own[j] += weight if label[i] else -weight
                del near[j][i]
                todo.append(j)
            near[i] = {}
    for first in range(len(own)):
        if label[first] is None:  # undecided blocks that edges join are cut together
            group, todo = {first}, deque([first])
            while todo:
                for j in near[todo.popleft()]:
                    if j not in group:
                        group.add(j)
                        todo.append(j)
            side = _source_side(sorted(group), own, near)
            for i in group:
                label[i] = i in side
    return [bool(x) for x in label]


def _source_side(open_: list[int], own: list[float], near: list[dict[int, float]]) -> set[int]:
    """Blocks on the source's (content's) side of the cut, by shortest augmenting paths."""
    source, sink = -1, -2
    residual: dict[int, dict[int, float]] = {source: {}, sink: {}}
    for i in open_:
        residual[i] = dict(near[i])
        if own[i] > 0:
            residual[source][i], residual[i][source] = own[i], 0.0
        elif own[i] < 0:
            residual[i][sink], residual[sink][i] = -own[i], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue and sink not in level:
            u = queue.popleft()
            for v, room in residual[u].items():
                if room > 1e-12 and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return level.keys() - {source}
        arcs = {u: iter(list(residual[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                steps = list(zip(path, path[1:], strict=False))
                amount = min(residual[a][b] for a, b in steps)
                for a, b in steps:
                    residual[a][b] -= amount
                    residual[b][a] = residual[b].get(a, 0.0) + amount
                full = next(k for k, (a, b) in enumerate(steps) if residual[a][b] <= 1e-12)
                path = path[: full + 1]
                continue
            for v in arcs[u]:
                if level.get(v) == level[u] + 1 and residual[u][v] > 1e-12:
                    path.append(v)
                    break
            else:
                level.pop(u, None)
                path.pop()


def extract(html: str | None, weights: np.ndarray = DEFAULT_WEIGHTS) -> str:
    """The main text of a page: its content blocks joined by line ends."""
    found = [b for b in blocks(html) if not b.hidden]
    if not found:
        return ""
    chosen = minimum_cut(log_odds(features(found), weights), smoothness(found))
    return "\n".join(b.text for b, content in zip(found, chosen, strict=True) if content)


def fit_from_table(pages: DataFrame, *, key: str = "page_id", html: str = "html") -> np.ndarray:
    """Fit on FIT_PAGES pages, chosen by hash of their key; their blocks' features alone come to
    the driver."""
    usable = pages.select(F.col(key).alias("k"), F.col(html).alias("html")).where("html IS NOT NULL AND k IS NOT NULL")
    chosen = usable.select("k").distinct().orderBy(F.xxhash64("k"), "k").limit(FIT_PAGES)
    kind = dict(usable.dtypes)["k"]

    def make():
        return lambda rows: {"k": rows["k"], "x": [labelled_features(h).astype("<f4").tobytes() for h in rows["html"]]}

    # FIT_PAGES keys: a bounded side. Rows that repeat a key are bounded after the map.
    parts = map_rows(usable.join(F.broadcast(chosen), "k"), f"k {kind}, x binary", make).orderBy(F.xxhash64("k"), "k", "x").limit(FIT_PAGES).collect()
    return fit_features([np.frombuffer(r["x"], "<f4").reshape(-1, len(DEFAULT_WEIGHTS)).astype(np.float64) for r in parts])


def extract_pages(pages: DataFrame, weights: np.ndarray, *, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every page; a narrow map."""
    rows = pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(html).alias("h"))

    def make():
        def step(rows):
            texts = [extract(h, weights) for h in rows["h"]]
            return {"k": rows["k"], "u": rows["u"], "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    made = map_rows(rows, f"k {dict(rows.dtypes)['k']}, u string, text string, n_chars bigint", make)
    return made.select(F.col("k").alias(key), F.col("u").alias(url), "text", "n_chars")
