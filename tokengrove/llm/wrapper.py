"""Main text of web pages by wrapper induction.

The DOM trees of a host's pages are aligned by simple tree matching: two nodes match if their labels
(tag and classes) do, and their children are aligned in order so that most nodes match. Folding all
distinct pages of a host, aligned one after the other, gives its template tree: each node knows how many
pages have it, how much text and link text they have there, and whether the text was ever different. A
node whose text is the same on all of at least ``LEAST_PAGES`` pages is template; the others are
slots. The content region is found among the slots on the host's totals: article or main nodes if
together they hold ``PRESENT`` of the text, else the way down from the body as long as one child holds
all of it; menus, lists of links and template beside that child are no text. A page's text is that of
its slots inside the region, and outside it (a host may mix layouts) that of the slots which are more
than links.

What names itself boilerplate (by tag, class or role: menus, headers, footers, sidebars, notices,
adverts, forms, comments) is no content, so hosts of one page or of equal pages, where nothing
can be told from variation, still work: there nothing counts as template. The template overrules
names: see ``overruled``; a page that stays empty is asked by itself.

Copies prove nothing constant: of pages that are equal or near copies (half of the hashes of their
text's five-word shingles agree) one is folded, so a node is template only if it is the same on several
distinct pages. A host whose pages share most of their text counts as one page, and all its text stays.

Scale: templates are folded in each task first and merged per host in two steps, so no task sees
a host's pages; a template's size follows the site's structure, since neighbours of one label
fold into one node. Pages meet the wrapper of their host in a salted join.

Blocks: block-level elements separate; ``br`` is white space. Defined cases: null or empty html
gives an empty text; a null address is the host of all such; pages that repeat are all extracted;
unclosed, misnested and truncated markup is closed where the next block begins or the page ends; an
article or main ends what names itself boilerplate and lacks its end tag.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tokengrove.plans.lineage import cut
from tokengrove.plans.skew import salted_join

LEAST_PAGES = 3
PRESENT = 0.2
#: Hosts that one task folds at a time, and templates that one merge takes in the first step.
HOSTS, MERGED = 500, 64
#: Blocks nested deeper than this stand beside each other; their text stays.
DEEPEST = 150
#: Words of a shingle, hashes of a page's signature, and hashes that name a bucket of it.
SHINGLE, HASHES, BAND = 5, 16, 2
_SEEDS = np.random.default_rng(7).integers(1 << 62, 1 << 63, HASHES, np.uint64) | np.uint64(1)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_BLANK = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
_SPLIT = re.compile(r"[^a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title select svg math object canvas".split())
BLOCKS = frozenset(
    "html body address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul "
    "center option button label".split()
)
MARKED = frozenset("article main".split())
NEVER = frozenset("nav header footer aside form menu dialog button label option fieldset head".split())
TELLING = frozenset(
    "ad ads advert adverts advertisement banner sponsor sponsored promo promoted sidebar sidenav cookie cookies consent "
    "notice alert popup modal overlay menu menubar nav navbar navigation breadcrumb breadcrumbs footer masthead "
    "comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe "
    "signup login search toolbar pagination pager widget skip contentinfo complementary".split()
)
#: Never-nodes that are boilerplate whatever they hold, and names of what may outgrow an article.
FIRM = frozenset("footer menu dialog button label option head".split())
TALK = frozenset("comment comments reply replies respond disqus".split())
#: Elements that an opening tag of the key closes when one is open.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}


class Node:
    __slots__ = ("tag", "label", "never", "parts", "links")

    def __init__(self, tag: str, label: str, never: str):
        self.tag, self.label = tag, label
        self.never = never  # the class, id, role or <tag> that says boilerplate, or nothing
        self.parts: list = []  # blocks of text and nodes, in page order
        self.links = 0  # characters of its own text inside links


def _label(tag: str, attributes: str, told: bool) -> tuple[str, str]:
    never = f"<{tag}>" if told and tag in NEVER else ""
    names = []
    if attributes and "=" in attributes or "hidden" in attributes.lower():
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden":
                if value in ("", "true", "hidden"):
                    never = never or "<hidden>"
                continue
            if name not in ("class", "id", "role"):
                continue
            telling = [word for word in value.split() if not TELLING.isdisjoint(_SPLIT.split(word))]
            if telling:
                never = never or min(telling)
            if name == "class":
                names += sorted(_DIGITS.sub("", value).split())
            elif name == "role":
                names.append("role:" + value)
    return ".".join([tag, *names]), never


def _unclosed(stack: list[Node], rest: str) -> int | None:
    """Where the stack holds the first never-node whose end tag the rest of the page lacks."""
    for i, node in enumerate(stack):
        if node.never and node.tag != "form":
            ends = re.findall(rf"<(/?){node.tag}(?=[\s/>])", rest, re.I)
            if 2 * ends.count("/") - len(ends) < sum(n.tag == node.tag for n in stack):
                return i
    return None


def parse(page: str | None) -> Node:
    """The tree of block elements; inline markup melts into the text around it."""
    page = page or ""
    root = Node("html", "html", "")
    stack = [root]
    text: list[str] = []
    anchor, linked = 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            block = _BLANK.sub(" ", html_lib.unescape("".join(text))).strip()
            text.clear()
            if block:
                stack[-1].parts.append(block)
                stack[-1].links += min(linked, len(block))
        linked = 0

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if anchor:
                linked += len(piece)
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        closing = m.group(1) == "/"
        if tag in RAW:
            if not closing and not m.group(3).endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "a":
            anchor = 0 if closing else 1
        if tag == "br":
            text.append(" ")
        if tag not in BLOCKS:
            continue
        flush()
        anchor = 0
        if tag in ("html", "body"):
            continue
        if closing:
            if any(n.tag == tag for n in stack[1:]):
                while stack[-1].tag != tag:
                    stack.pop()
                stack.pop()
            continue
        # A block that begins ends an open paragraph, and its like.
        if stack[-1].tag == "p":
            stack.pop()
        ended = CLOSES.get(tag)
        if ended:
            while len(stack) > 1 and stack[-1].tag in ended:
                stack.pop()
        if tag == "hr":
            continue
        if tag in MARKED:
            start = _unclosed(stack, page[at:])
            if start is not None:
                del stack[start:]
        # The header of an article holds its title.
        label, never = _label(tag, m.group(3), tag != "header" or not any(n.tag in MARKED for n in stack))
        node = Node(tag, label, never)
        stack[-1].parts.append(node)
        if not m.group(3).endswith("/") and len(stack) < DEEPEST:
            stack.append(node)
    flush()
    return root


# A template node is a list, which JSON carries as it is.
LABEL, PAGES, DIGEST, CHARS, LINKS, NEVER_IS, KIDS = range(7)


def folded(node: Node) -> list:
    """The template of one page: neighbours of one label fold into one node."""
    own = [p for p in node.parts if type(p) is str]
    digest = crc32("\n".join(own).encode("utf-8", "replace")) if own else 0
    kids: list[list] = []
    for kid in node.parts:
        if type(kid) is str:
            continue
        t = folded(kid)
        if kids and kids[-1][LABEL] == t[LABEL]:
            merge(kids[-1], t, siblings=True)
        else:
            kids.append(t)
    return [node.label, 1, digest, sum(map(len, own)), node.links, node.never, kids]


def match_size(a: list, b: list, known: dict) -> int:
    """Nodes of the largest matching of two templates (simple tree matching)."""
    if a[LABEL] != b[LABEL]:
        return 0
    if not a[KIDS] or not b[KIDS]:
        return 1
    key = (id(a), id(b))
    if key not in known:
        known[key] = 1 + _table(a[KIDS], b[KIDS], known)[-1][-1]
    return known[key]


def _table(x: list, y: list, known: dict) -> list[list[int]]:
    rows = [[0] * (len(y) + 1)]
    for a in x:
        above, row = rows[-1], [0]
        for j, b in enumerate(y):
            best = max(row[j], above[j + 1])
            if a[LABEL] == b[LABEL]:
                best = max(best, above[j] + match_size(a, b, known))
            row.append(best)
        rows.append(row)
    return rows


def aligned(x: list, y: list, known: dict) -> list[tuple[int | None, int | None]]:
    """The best ordered alignment of two lists of children, both sides complete."""
    if [k[LABEL] for k in x] == [k[LABEL] for k in y]:
        return [(i, i) for i in range(len(x))]
    rows = _table(x, y, known)
    i, j, out = len(x), len(y), []
    while i or j:
        here = rows[i][j]
        if i and rows[i - 1][j] == here:
            i -= 1
            out.append((i, None))
        elif j and rows[i][j - 1] == here:
            j -= 1
            out.append((None, j))
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def merge(into: list, other: list, siblings: bool = False) -> None:
    """Fold another template of the same label in. ``siblings``: both are of one page."""
    if siblings:
        # One page's run of equal labels: its text as a whole.
        into[DIGEST] = crc32(b"%d %d" % (into[DIGEST], other[DIGEST]))
    else:
        if into[DIGEST] != other[DIGEST]:
            into[DIGEST] = -1  # differs: a slot
        into[PAGES] += other[PAGES]
    into[CHARS] += other[CHARS]
    into[LINKS] += other[LINKS]
    into[NEVER_IS] = other[NEVER_IS] and into[NEVER_IS]
    kids = []
    for i, j in aligned(into[KIDS], other[KIDS], {}):
        if i is None:
            kids.append(other[KIDS][j])
        else:
            if j is not None:
                merge(into[KIDS][i], other[KIDS][j], siblings)
            kids.append(into[KIDS][i])
    into[KIDS] = kids


def constant(t: list, pages: int) -> bool:
    """Whether the text that a node itself holds is the same on most of enough pages."""
    return t[DIGEST] not in (-1, 0) and t[PAGES] >= LEAST_PAGES and t[PAGES] * 2 > pages


def prose(chars: int, links: int) -> bool:
    """Whether text is more than a list of links."""
    return chars > 2 * links


def _marked(label: str) -> bool:
    parts = label.split(".")
    return parts[0] in MARKED or "role:main" in parts


def _varying(t: list, pages: int) -> int:
    """Characters of a node's own text that are neither template nor links."""
    return 0 if constant(t, pages) or not prose(t[CHARS], t[LINKS]) else t[CHARS] - t[LINKS]


def overruled(template: list) -> set[int]:
    """The ids of the never-nodes that are content: they hold most of the varying text outside links.

    Such a name says something else (``content with-sidebar``, a form around the page) or stands on
    all parts of a page (``elementor-widget``), so nodes of one class, id or role count together. Names
    stand where the pages mark their articles, and for readers' comments beside other text.
    """
    pages = template[PAGES]
    total: dict[int, int] = {}

    def add_up(t: list) -> int:
        total[id(t)] = _varying(t, pages) + sum(map(add_up, t[KIDS]))
        return total[id(t)]

    whole = add_up(template)
    taken: set[str | int] = set()  # classes, or ids of nodes that are so by tag

    def key(t: list) -> str | int:
        return id(t) if t[NEVER_IS].startswith("<") else t[NEVER_IS]

    while whole:
        tops: list[list] = []
        marked = 0

        def find(t: list, inside: bool) -> None:
            nonlocal marked
            if t[NEVER_IS] and key(t) not in taken:
                tops.append(t)
                return
            inside = inside or _marked(t[LABEL])
            marked += _varying(t, pages) if inside else 0
            for kid in t[KIDS]:
                find(kid, inside)

        find(template, False)
        if marked > (PRESENT * whole if pages >= LEAST_PAGES else 0):
            break
        free = whole - sum(total[id(t)] for t in tops)
        held: dict[str | int, int] = {}
        for t in tops:
            talk = not TALK.isdisjoint(_SPLIT.split(t[NEVER_IS]))
            if t[LABEL].split(".")[0] not in FIRM and (not talk or free < PRESENT * whole):
                held[key(t)] = held.get(key(t), 0) + total[id(t)]
        most = max(held, key=held.get, default=None)
        if most is None or 2 * held[most] <= whole:
            break
        taken.add(most)
    out: set[int] = set()

    def collect(t: list) -> None:
        if t[NEVER_IS] and key(t) in taken:
            out.add(id(t))
        for kid in t[KIDS]:
            collect(kid)

    if taken:
        collect(template)
    return out


def region(template: list, content: set[int]) -> set[int]:
    """The ids of the nodes whose subtrees are the content region; ``content`` are never-nodes overruled."""

    def weight(t: list) -> int:
        if t[NEVER_IS] and id(t) not in content:
            return 0
        return _varying(t, template[PAGES]) + sum(map(weight, t[KIDS]))

    whole = weight(template)
    named: list[list] = []

    def find(t: list) -> None:
        if t[NEVER_IS] and id(t) not in content:
            return
        if _marked(t[LABEL]) and weight(t) > 0:
            named.append(t)
            return
        for kid in t[KIDS]:
            find(kid)

    find(template)
    if sum(map(weight, named)) > PRESENT * whole:
        return {id(t) for t in named}
    at = template
    while True:
        best = max(at[KIDS], key=weight, default=None)
        if best is None or best[LABEL].split(".")[0] in ("p", "li", "tr", "td") or weight(best) < max(1, weight(at)):
            return {id(at)}
        at = best


class Wrapper:
    """A host's template with its region."""

    def __init__(self, template: list):
        self.template = template
        self.content = overruled(template)
        self.region = region(template, self.content)
        # Equal pages tell nothing: only with a slot in the region can the rest be template.
        self.told = self._varies(template, False)

    def _varies(self, t: list, inside: bool) -> bool:
        inside = inside or id(t) in self.region
        return (inside and t[DIGEST] == -1) or any(self._varies(k, inside) for k in t[KIDS])

    def text(self, page: str | None) -> str:
        out: list[str] = []
        root = parse(page)
        self._walk(root, self.template, False, out)
        if not out:  # the page has nothing but links outside the region
            self._walk(root, self.template, True, out)
        if not out:  # or what it has bears names of boilerplate
            self._walk(root, self.template, True, out, self._unnamed(root))
        return "\n".join(out)

    def _unnamed(self, root: Node) -> set[int]:
        """The ids of the page's nodes whose names its own text overrules."""
        page = folded(root)
        content = overruled(page)
        found: set[int] = set()

        def pair(node: Node, t: list) -> None:
            if id(t) in content:
                found.add(id(node))
            at, last = -1, None
            for p in node.parts:
                if type(p) is not str:
                    at, last = at + (p.label != last), p.label
                    match = t[KIDS][at] if at < len(t[KIDS]) and t[KIDS][at][LABEL] == p.label else None
                    if match is not None:
                        pair(p, match)

        if content:
            pair(root, page)
        return found

    def _walk(
        self, node: Node, t: list | None, inside: bool, out: list[str], unnamed: set[int] = frozenset()
    ) -> None:
        if node.never and id(node) not in unnamed and (t is None or id(t) not in self.content):
            return
        inside = inside or (t is not None and id(t) in self.region)
        fixed = t is not None and self.told and constant(t, self.template[PAGES])
        # Outside the region prose is text as well: the layouts of a host's pages differ.
        taken = not fixed and (inside or prose(sum(len(p) for p in node.parts if type(p) is str), node.links))
        runs: list[list[Node]] = []
        for p in node.parts:
            if type(p) is not str:
                if runs and runs[-1][0].label == p.label:
                    runs[-1].append(p)
                else:
                    runs.append([p])
        place: dict[int, list] = {}
        if t is not None and runs:
            own = [_run(run) for run in runs]
            for i, j in aligned(t[KIDS], own, {}):
                if i is not None and j is not None:
                    for p in runs[j]:
                        place[id(p)] = t[KIDS][i]
        for p in node.parts:
            if type(p) is str:
                if taken:
                    out.append(p)
            else:
                self._walk(p, place.get(id(p)), inside, out, unnamed)


def _run(run: list[Node]) -> list:
    first = folded(run[0])
    for other in run[1:]:
        merge(first, folded(other), siblings=True)
    return first


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#:]*)", 1))


def _prose_of(node: Node, never: bool, said: list[str], named: list[str]) -> None:
    never = never or bool(node.never)
    own = [p for p in node.parts if type(p) is str]
    if prose(sum(map(len, own)), node.links):
        (named if never else said).extend(own)
    for p in node.parts:
        if type(p) is not str:
            _prose_of(p, never, said, named)


def signature(root: Node) -> list[int]:
    """Least hashes of the shingles of a page's text outside links: near copies agree in most of them.

    What names itself boilerplate counts only where it is most of the text.
    """
    said: list[str] = []
    named: list[str] = []
    _prose_of(root, False, said, named)
    if sum(map(len, named)) > sum(map(len, said)):
        said += named
    words = [crc32(w.encode("utf-8", "replace")) for text in said for w in text.split()]
    if not words:
        return []
    ids = np.array(words + [0] * max(0, SHINGLE - len(words)), np.uint64)
    n = len(ids) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n]
        h ^= h >> np.uint64(29)
    # Chunks bound the memory of a long page.
    parts = [
        ((h[at : at + 65536, None] * _SEEDS[None, :]) >> np.uint64(33)).min(axis=0) for at in range(0, n, 65536)
    ]
    return np.min(parts, axis=0).astype(np.int64).tolist()


def distinct_pages(pages: DataFrame) -> DataFrame:
    """``host, order, template``, one row for each group of copies and near copies of ``host, html, order``.

    A page goes if one of a lower order agrees with it in half of the signature; of any group the
    lowest stays. Pages meet the lowest of their buckets only, so no bucket is paired with itself.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, page, order in zip(batch["host"], batch["html"], batch["order"]):
                root = parse(page)
                rows.append((host, order, signature(root), json.dumps(folded(root))))
            yield pd.DataFrame(rows, columns=["host", "order", "sig", "template"])

    sketches = pages.mapInPandas(sketch, "host string, order long, sig array<int>, template string")
    once = sketches.groupBy("host", "sig").agg(F.min(F.struct("order", "template")).alias("first"))
    once = cut(once.select("host", "sig", "first.order", "first.template"))
    bands = F.array(*[F.xxhash64(F.lit(i), F.slice("sig", i + 1, BAND)) for i in range(0, HASHES, BAND)])
    placed = once.where(F.size("sig") > 0).select("host", "order", "sig", F.explode(bands).alias("bucket"))
    least = (
        placed.groupBy("host", "bucket").agg(F.min(F.struct("order", "sig")).alias("least"), F.count("*").alias("n"))
        .where("n > 1").select("host", "bucket", "least")
    )
    equal = F.aggregate(
        F.zip_with("sig", "least.sig", lambda a, b: (a == b).cast("int")), F.lit(0), lambda a, b: a + b
    )
    copies = (
        salted_join(placed, least, ["host", "bucket"], "inner", ["order"])
        .where((F.struct("order", "sig") > F.col("least")) & (2 * equal >= HASHES))
        .select("host", "sig").distinct()
    )
    return once.join(copies, ["host", "sig"], "left_anti").select("host", "order", "template")


def induce_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, wrapper`` (JSON of the template) from every distinct page of the host."""
    rows = pages.select(
        host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"), F.xxhash64(F.col(html_col)).alias("order")
    ).where("html is not null")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}
        for batch in batches:
            for host, template in zip(batch["host"], batch["template"]):
                t = json.loads(template)
                if host in held:
                    merge(held[host], t)
                else:
                    held[host] = t
            if len(held) >= HOSTS:
                yield pd.DataFrame([(h, json.dumps(t)) for h, t in held.items()], columns=["host", "wrapper"])
                held = {}
        if held:
            yield pd.DataFrame([(h, json.dumps(t)) for h, t in held.items()], columns=["host", "wrapper"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(group["wrapper"])  # reruns agree
        whole = json.loads(texts[0])
        for other in texts[1:]:
            merge(whole, json.loads(other))
        return pd.DataFrame({"host": group["host"].iloc[:1], "wrapper": [json.dumps(whole)]})

    ordered = distinct_pages(rows).sortWithinPartitions("host", "order", "template")
    folds = ordered.select("host", "template").mapInPandas(fold, "host string, wrapper string")
    parts = folds.withColumn("_part", F.floor(F.spark_partition_id() / F.lit(MERGED)))
    once = parts.groupBy("host", "_part").applyInPandas(join, "host string, wrapper string")
    return once.groupBy("host").applyInPandas(join, "host string, wrapper string")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    wrappers = cut(induce_wrappers(pages, url_col, html_col))
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        host_of(F.col(url_col)).alias("host"),
    )
    met = salted_join(rows, wrappers, ["host"], "left", ["page_id", "url"])

    @F.pandas_udf("string")
    def extract(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known: dict[str, Wrapper] = {}
        for pages_of, wrapper_of in batches:
            texts = []
            for page, wrapper in zip(pages_of, wrapper_of):
                if page is None or wrapper is None:
                    texts.append("")
                    continue
                if wrapper not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[wrapper] = Wrapper(json.loads(wrapper))
                texts.append(known[wrapper].text(page))
            yield pd.Series(texts, dtype=object)

    return met.select("page_id", "url", extract("html", "wrapper").alias("text")).withColumn(
        "n_chars", F.length("text").cast("long")
    )
