"""Main text of web pages by wrapper induction.

Pages of a host are parsed into DOM trees; like siblings (tag and class) fold
into one node.  The host's commonest tree is its reference, and every page of
the host is aligned with it by simple tree matching: nodes pair along the
largest alignment of equal tags, in order, equal classes first.  A block counts
at its own path, at the path of the reference's node it is aligned with (so
renamed classes meet) and, outside article and main, at the host as a whole (so
moved menus meet).  Counts go by digest of the whole normalised text over all
pages of the host, pages of equal text once.  A text is template where it is on
``SAME_ON`` pages or more and on half of those that have the node, inside
article or main elements on nine of ten (near copies of an article are not its
template).  The wrapper stores the template's digests; a page loses a block only
if the block's own text is among its nodes'.

Besides, parts whose element says that they are menus, footers, scripts, styles
or controls are no content.  Class, id and role names, forms and headers only
vote: such a part goes unless it holds more than half of the page's text (reader
comments: nine tenths).  Where article or main elements hold a quarter or more of
the text that is left without template, only they count.

Counts are combined in the tasks before they move and spread by page, node and
text, so a host with a third of all pages is spread like any other.  References
and wrappers are broadcast while they are small (measured first) and joined
otherwise.

Defined results: null or empty html, or html without text, gives an empty text
of 0 characters; broken and cut markup is read as far as it goes; pages with a
null url have no wrapper; repeated rows are extracted alike.  Extra columns are
ignored.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skupulse.llm.common import cut
from skupulse.llm.urls import host_of

SAME_ON = 3              # pages of different text a template block must be seen on
DENSE = 4_096            # pairs of children up to which tags alone may match
BROADCAST_BYTES = 32_000_000
CACHE = 20_000

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW_END = {t: re.compile(f"</{t}\\s*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "template", "iframe")}

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
ENDS_P = BLOCKS - {"br", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
AWAY = frozenset("head script style title noscript template iframe nav footer aside button select textarea svg object menu dialog "
                 "label legend option datalist".split())
AWAY_ROLE = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
AWAY_NAME = re.compile(r"(?:^|[-_])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice\w*|popup|modal|newsletter|subscribe|"
                       r"nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|footer\w*|masthead|site-header|page-header|"
                       r"share|sharing|social|pagination|pager|login|signup)(?:$|[-_\d])|^side$|(?:^|[-_])(?:left|right)[-_]?side$|"
                       r"^side[-_](?:col\w*|nav|menu|box|widget)|^related(?:$|[-_](?:post|article|link|content|stor|news|item|reading))")
COMMENT_NAME = re.compile(r"(?:^|[-_])(?:comment\w*|respond|disqus\w*)(?:$|[-_\d])")
STATE = re.compile(r"(?:has|have|with|no|not|without|is)[-_]")  # such a name tells of a part elsewhere
LIST_ENDS = ("ul", "ol", "dl", "table", "select", "div", "body")


def vote(tag: str, main: bool, role: str, names: str) -> int:
    """0: content, 1: no content, 2: reader comments, by what an element is called."""
    if tag in ("html", "body", "article", "main"):
        return 0
    names = [n for n in names.lower().split() if not STATE.match(n)]
    if any(COMMENT_NAME.search(n) for n in names):
        return 2
    return int(role in AWAY_ROLE or tag == "form" or (tag == "header" and not main) or any(AWAY_NAME.search(n) for n in names))


class Page:
    """A folded DOM tree: node 0 is the root, parents come before children;
    texts are (node, text, block)."""

    __slots__ = ("labels", "parents", "children", "texts", "never", "votes", "main", "block")

    def __init__(self):
        self.labels, self.parents, self.children = ["#root"], [-1], [{}]
        self.texts: list[tuple[int, str, int]] = []
        self.never, self.votes, self.main = [False], [0], [False]
        self.block = [0]  # the block that each node's text belongs to

    def child(self, parent: int, tag: str, attrs: str) -> int:
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "").strip() for m in ATTR.finditer(attrs)} if attrs and "=" in attrs else {}
        # parts that differ in what their id or role says do not fold
        role, names = found.get("role", "").lower(), f"{found.get('class', '')} {found.get('id', '')}"
        voted = vote(tag, self.main[parent], role, names)
        label = tag + ("." + re.sub(r"\d+", "#", " ".join(found["class"].split())) if found.get("class") else "") + ("", " -", " --")[voted]
        own = self.children[parent]
        if label in own:
            return own[label]
        node = own[label] = len(self.labels)
        self.labels.append(label)
        self.parents.append(parent)
        self.children.append({})
        self.block.append(node if tag in BLOCKS else self.block[parent])
        self.main.append(self.main[parent] or tag in ("article", "main") or role in ("main", "article"))
        self.never.append(self.never[parent] or tag in AWAY)
        self.votes.append(voted)
        return node

    def away(self) -> list[bool]:
        """Nodes that are no content: a vote decides unless the node holds most of the text."""
        mass = [0] * len(self.labels)
        for node, text, _ in self.texts:
            if not self.never[node]:
                mass[node] += len(text.strip())
        for node in range(len(mass) - 1, 0, -1):
            mass[self.parents[node]] += mass[node]
        out = [False] * len(mass)
        for node in range(1, len(mass)):
            voted = self.votes[node]
            spared = 2 * mass[node] > mass[0] if voted == 1 else 10 * mass[node] > 9 * mass[0]
            out[node] = self.never[node] or out[self.parents[node]] or bool(voted and not spared)
        return out

    def paths(self) -> list[int]:
        """Digest of each node's path of labels."""
        out = [0] * len(self.labels)
        for node in range(1, len(out)):
            out[node] = xxhash.xxh3_64_intdigest(f"{out[self.parents[node]]:x} {self.labels[node]}".encode("utf-8", "surrogatepass"))
        return out

    def shape(self) -> str:
        """The tree as text: parent and label of each node."""
        return "\n".join(f"{p} {x}" for p, x in zip(self.parents[1:], self.labels[1:], strict=True))


class _Open:
    """Open elements, with the places of each tag among them."""

    def __init__(self):
        self.stack: list[tuple[str, int]] = [("#root", 0)]
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str, node: int) -> None:
        for name in (tag, "#block") if tag in BLOCKS and tag != "p" else (tag,):
            self.at.setdefault(name, []).append(len(self.stack))
        self.stack.append((tag, node))

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def close(self, place: int) -> None:
        while place and len(self.stack) > place:
            tag, _ = self.stack.pop()
            for name in (tag, "#block") if tag in BLOCKS and tag != "p" else (tag,):
                self.at[name].pop()


def parse(source: str) -> Page:
    """Read html into a folded tree; whatever is not closed ends with its parent."""
    page, open_, block, at = Page(), _Open(), 0, 0
    size = len(source)
    while at < size:
        m = TOKEN.search(source, at)
        end = m.start() if m else size
        if end > at:
            page.texts.append((open_.stack[-1][1], source[at:end], block))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        block += tag in BLOCKS
        if m[1]:
            open_.close(open_.last((tag,)))
            continue
        if tag in ENDS_P:
            place = open_.last(("p",))
            if place > open_.last(("#block",)):
                open_.close(place)
        if tag in SAME_END:
            place = open_.last(SAME_END[tag])
            if place > open_.last(LIST_ENDS):
                open_.close(place)
        node = page.child(open_.stack[-1][1], tag, m[3])
        if tag in RAW_END:
            stop = RAW_END[tag].search(source, at)
            at = stop.end() if stop else size
        elif tag not in VOID and not m[3].endswith("/"):
            open_.push(tag, node)
    return page


def _tag(label: str) -> str:
    return label.split(".", 1)[0].split(" ", 1)[0]


def _chain(xs, ys, worth: dict) -> list[tuple[int, int]]:
    """The heaviest pairs of two ordered lists that do not cross."""
    table = [[0] * (len(ys) + 1)]
    for c in xs:
        above, line = table[-1], [0]
        for j, d in enumerate(ys):
            line.append(max(above[j + 1], line[j], above[j] + worth.get((c, d), -1)))
        table.append(line)
    out, i, j = [], len(xs), len(ys)
    while i and j:
        if table[i][j] == table[i - 1][j]:
            i -= 1
        elif table[i][j] == table[i][j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((xs[i], ys[j]))
    return out


def align(a_labels, a_children, b_labels, b_children) -> dict[int, int]:
    """Simple tree matching of two ordered trees: nodes of a to nodes of b.  Nodes
    match by tag, and weigh twice where their class is the same too; children are
    matched in order, for the heaviest alignment of what is below.  Beyond
    ``DENSE`` pairs of children only equal labels match, in any order."""
    def tries(x: int, y: int) -> list[tuple[int, int]]:
        xs, ys = a_children[x], b_children[y]
        if len(xs) * len(ys) > DENSE:
            named = {b_labels[d]: d for d in ys}
            return [(c, named[a_labels[c]]) for c in xs if a_labels[c] in named]
        return [(c, d) for c in xs for d in ys if _tag(a_labels[c]) == _tag(b_labels[d])]

    order, below = [(0, 0)], {}
    for pair in order:  # grows as it is read
        below[pair] = tries(*pair)
        order += below[pair]
    weight, chosen = {}, {}
    for x, y in reversed(order):
        worth = {pair: weight[pair] for pair in below[x, y]}
        dense = len(a_children[x]) * len(b_children[y]) <= DENSE
        chosen[x, y] = _chain(a_children[x], b_children[y], worth) if dense and len(worth) > 1 else list(worth)
        weight[x, y] = 1 + (a_labels[x] == b_labels[y]) + sum(worth[pair] for pair in chosen[x, y])
    out, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo += chosen[x, y]
    return out


class Reference:
    """A host's reference tree, read from its shape, and the alignments of the shapes met."""

    def __init__(self, shape: str):
        page = Page()
        for line in shape.split("\n") if shape else []:
            parent, label = line.split(" ", 1)
            page.children[int(parent)][label] = len(page.labels)
            page.parents.append(int(parent))
            page.labels.append(label)
            page.children.append({})
        self.labels, self.children, self.paths = page.labels, [list(c.values()) for c in page.children], page.paths()
        self.known: dict[int, dict[int, int]] = {}

    def partners(self, page: Page) -> dict[int, int]:
        """The reference's path for each node of the page that is aligned."""
        key = xxhash.xxh3_64_intdigest(page.shape().encode("utf-8", "surrogatepass"))
        if key not in self.known:
            if len(self.known) >= 256:
                self.known.clear()
            pairs = align(page.labels, [list(c.values()) for c in page.children], self.labels, self.children)
            self.known[key] = {x: self.paths[y] for x, y in pairs.items()}
        return self.known[key]


def units(page: Page, reference: Reference | None = None) -> list[tuple[list[tuple[int, int]], str]]:
    """([(place, key)], text) of each block that elements and votes leave: digests of
    the places it counts at (odd inside article or main) and of place and text."""
    away, paths = page.away(), page.paths()
    partners = reference.partners(page) if reference else {}
    blocks: list[list] = []
    for node, text, block in page.texts:
        if away[node]:
            continue
        if not blocks or blocks[-1][0] != block:
            blocks.append([block, node, []])
        elif all(t.isspace() for t in blocks[-1][2]):
            blocks[-1][1] = node
        blocks[-1][2].append(text)
    out = []
    for _, node, parts in blocks:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            own, main = page.block[node], page.main[node]
            places = {paths[own] >> 1 << 1 | main: None}
            if own in partners:
                places[partners[own] >> 1 << 1 | main] = None
            if not main:
                places[0] = None
            out.append(([(at, xxhash.xxh3_64_intdigest(f"{at:x} {text}".encode("utf-8", "surrogatepass"))) for at in places], text))
    return out


def main_text(found, same) -> str:
    """The blocks without template; of article and main alone where they hold a quarter."""
    kept = [(keys[0][0] & 1, text) for keys, text in found if not any(key in same for _, key in keys)]
    inside = sum(len(text) for keys, text in found if keys[0][0] & 1)
    outside = sum(len(text) for main, text in kept if not main)
    alone = inside and 3 * inside >= outside
    return "\n".join(text for main, text in kept if main or not alone)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _shapes(batches):
    """host, shape and number of pages, added up within a batch."""
    for batch in batches:
        counts: dict[tuple[int, str], int] = {}
        for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            key = host, parse(source).shape()
            counts[key] = counts.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in counts], pa.int64()), pa.array([x for _, x in counts], pa.string()),
                                          pa.array(list(counts.values()), pa.int64())], ["host", "shape", "n"])


class _Known(dict):
    """What is made of a host's data, for the hosts met."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def of(self, host, value):
        if not value.is_valid:
            return None
        if host not in self:
            if len(self) >= CACHE:
                self.clear()
            self[host] = self.make(value)
        return self[host]


def _seen(batches):
    """host, place, key and page of the blocks; a row with key = place counts the node."""
    references = _Known(lambda value: Reference(value.as_py()))
    for batch in batches:
        hosts, lengths, rows = batch.column("host").to_numpy(zero_copy_only=False), [], []
        shapes = batch.column("shape")
        for i, source in enumerate(batch.column("html").to_pylist()):
            found = units(parse(source), references.of(hosts[i], shapes[i]))
            page = xxhash.xxh3_64_intdigest("\n".join(t for _, t in found).encode("utf-8", "surrogatepass"))
            pairs = {pair for keys, _ in found for pair in keys} | {(at, at) for keys, _ in found for at, _ in keys}
            rows += [(at, key, page) for at, key in pairs]
            lengths.append(len(pairs))
        columns = [pa.array(np.repeat(hosts, lengths))] + [pa.array(_signed([r[k] for r in rows])) for k in range(3)]
        yield pa.RecordBatch.from_arrays(columns, ["host", "path", "key", "page"])


def _beside(rows: DataFrame, side: DataFrame, weight) -> DataFrame:
    """Rows with their host's data: broadcast while small, joined otherwise."""
    bytes_ = side.agg(F.coalesce(F.sum(weight + 64), F.lit(0))).first()[0]
    side = side.withColumnRenamed("host", "s_host")
    return rows.join(F.broadcast(side) if bytes_ <= BROADCAST_BYTES else side, F.col("host") == F.col("s_host"), "left").drop("s_host")


def references(rows: DataFrame) -> DataFrame:
    """(host, shape): the commonest tree of each host, ties by text."""
    shapes = rows.mapInArrow(_shapes, "host long, shape string, n long").groupBy("host", "shape").agg(F.sum("n").alias("n"))
    return shapes.groupBy("host").agg(F.max(F.struct("n", "shape")).alias("top")).select("host", "top.shape")


def wrappers(rows: DataFrame, trees: DataFrame) -> DataFrame:
    """(host, wrapper): the digests of each host's template blocks."""
    seen = _beside(rows, trees, F.length("shape")).select("host", "html", "shape")
    seen = seen.mapInArrow(_seen, "host long, path long, key long, page long").distinct()
    counts = cut(seen.groupBy("host", "path", "key").agg(F.count("*").alias("n")).where(F.col("n") >= SAME_ON))
    nodes = counts.where("key = path").select(F.col("host").alias("n_host"), F.col("path").alias("n_path"), F.col("n").alias("pages"))
    texts = counts.where("key <> path").join(nodes, (F.col("host") == F.col("n_host")) & (F.col("path") == F.col("n_path")))
    # odd paths are those inside article or main
    same = texts.where(F.when(F.col("path").bitwiseAND(1) == 1, 10 * F.col("n") >= 9 * F.col("pages"))
                       .otherwise(2 * F.col("n") >= F.col("pages")))
    return same.groupBy("host").agg(F.collect_list("key").alias("wrapper"))


def _extract(batches):
    trees = _Known(lambda value: Reference(value.as_py()))
    fixed = _Known(lambda value: frozenset(value.values.to_numpy().view(np.uint64).tolist()))
    for batch in batches:
        texts = []
        shapes, known = batch.column("shape"), batch.column("wrapper")
        for i, (host, source) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)):
            same = fixed.of(host, known[i]) or frozenset()
            # without a wrapper no block has to be found at its partner's place
            tree = trees.of(host, shapes[i]) if same else None
            texts.append(main_text(units(parse(source), tree), same) if source else "")
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(np.array([len(t) for t in texts], np.int64))], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"), host_of("url").alias("name"))
    rows = rows.withColumn("host", F.when(F.col("name").isNotNull(), F.xxhash64("name"))).drop("name")
    hosted = rows.where("host is not null and html <> ''").select("host", "html")
    trees = cut(references(hosted))
    side = cut(wrappers(hosted, trees))
    joined = _beside(_beside(rows, trees, F.length("shape")), side, 8 * F.size("wrapper"))
    return (joined.select("page_id", "url", "html", "host", "shape", "wrapper")
            .mapInArrow(_extract, "page_id long, url string, text string, n_chars long"))
