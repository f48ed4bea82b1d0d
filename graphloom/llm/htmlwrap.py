"""Main text of web pages by wrapper inference: a union-free regular expression for the pages of each host.

Pages become balanced token streams (block tags and text runs). Streams of all distinct pages of a host are aligned: equal tags
match, adjacent copies of a tag become a repeated group, tags that only one side has become an optional group, texts that differ become a slot. The
wrapper then says which region holds the article: the one whose slots hold the text. Every page of the host is read with it.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import extended, slices, tidy, written
from graphloom.llm.urlrules import split_url

#: Parts that a host's pages are dealt into by their digest, each aligned on its own first, and the size of all wrappers up to which they are broadcast.
PARTS, BROADCAST_BYTES = 64, 32 << 20
#: Longer constant texts are kept as digests. Pages of a task that are remembered, so that their copies are not sent on.
LONGEST_CONSTANT, REMEMBERED = 40, 200_000
#: Depth to which a wrapper tells tags apart; what lies deeper counts as text of the tag there. Pages are read to any depth.
DEEPEST = 60

_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_RAW = "script|style|noscript|template|textarea|iframe|svg|select|object|title|button|audio|video|canvas"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<({_RAW})\b(?:[^<>"']|"[^"]*"|'[^']*')*(?:/>|>.*?(?:</\1\s*>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^<>]*>|[^<]+|<""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
#: Closed by an opening tag of the same kind.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
_STOPS = {"ul", "ol", "dl", "table"}
#: Tags, and words in class, id or role, of what surrounds an article.
_AROUND_TAGS = frozenset("nav aside footer form dialog fieldset".split())
_AROUND_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation sidebar footer comments disqus notice notices cookie cookies consent gdpr breadcrumb breadcrumbs newsletter subscribe signup login popup modal pagination pager masthead complementary contentinfo".split())
#: Words that surroundings and articles both use: a tag that has one surrounds only where the template fills it, with the same texts on every page.
_UNCLEAR_WORDS = frozenset("side foot aside comment reply replies respond discussion reader alert warning share sharing social related recommended recommendations subscription overlay widget tags search copyright topbar toolbar rail teaser paywall".split())
_MAIN_WORDS = frozenset("articlebody article main maincontent".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


@dataclass
class Node:
    """A block tag, or a text run (tag ``#``)."""

    tag: str
    words: frozenset = frozenset()
    children: list = field(default_factory=list)
    text: str = ""
    linked: int = 0

    @property
    def label(self) -> str:
        return " ".join([self.tag, *sorted(self.words)])


def _attribute_words(attributes: str) -> frozenset:
    if "=" not in attributes:
        return frozenset()
    return frozenset(w.lower() for m in _ATTRIBUTE.finditer(attributes) for w in [*_WORD.findall(m[2] or m[3] or m[4] or ""), (m[2] or m[3] or m[4] or "").lower()]) & (_AROUND_WORDS | _UNCLEAR_WORDS | _MAIN_WORDS)


def parse(page: str) -> Node:
    """The page's balanced tree, of any depth. Unclosed and unopened tags are mended; character references are decoded; a run's white space becomes single spaces."""
    root = Node("#root")
    is_open: Counter = Counter()
    stack, run, linked, link_depth, skipped = [root], [], 0, 0, []

    def flush() -> None:
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                stack[-1].children.append(Node("#", text=text, linked=linked))
            run.clear()
        linked = 0

    def leave(i: int) -> None:
        is_open.subtract(node.tag for node in stack[i:])
        del stack[i:]

    for m in _TOKEN.finditer(page):
        name = m[4]
        if name is None:
            if m[2] is not None:
                piece = m[2]
            elif m[0][0] != "<" or m[0] == "<":
                piece = html.unescape(m[0])
            else:
                continue
            if not skipped:
                run.append(piece)
                linked += len(piece) if link_depth else 0
            continue
        name, closing = name.lower(), bool(m[3])
        if name not in _BLOCKS:
            if name == "br" or name == "hr":
                run.append(" ")
            elif name == "a":
                link_depth = max(0, link_depth + (-1 if closing else 1))
            elif not closing and not skipped and not m[5].endswith("/") and name not in ("img", "input", "wbr", "link", "meta") and (_attribute_words(m[5]) & _AROUND_WORDS):
                skipped.append(name)  # an inline advert or the like
            elif skipped and name == skipped[-1]:
                skipped.pop() if closing else skipped.append(name)
            continue
        skipped.clear()
        link_depth = 0
        flush()
        if name == "hr":
            continue
        if closing:
            if is_open[name]:
                leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == name))
            continue
        if stack[-1].tag == "p" or stack[-1].tag in _HEADINGS and (name in _HEADINGS or name == "p"):
            leave(len(stack) - 1)
        if any(is_open[t] for t in _CLOSES.get(name, ())):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _STOPS and not (name == "tbody" and stack[i].tag != "table"):
                    break
                if stack[i].tag in _CLOSES[name]:
                    leave(i)
                    break
        node = Node(name, _attribute_words(m[5]))
        stack[-1].children.append(node)
        if not m[5].endswith("/"):
            stack.append(node)
            is_open[name] += 1
    flush()
    return root


def _mark(text: str) -> str:
    """A text, or of a long one its digest."""
    return text if len(text) <= LONGEST_CONSTANT else hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=24).hexdigest()


def around(tag: str, words) -> bool:
    """Whether a tag stands for what surrounds an article."""
    return tag in _AROUND_TAGS or bool(words & _AROUND_WORDS) and tag not in ("html", "body", "#root", "article", "main")


def _texts(node: Node):
    """The text runs under a node, without recursion."""
    stack = [node]
    while stack:
        at = stack.pop()
        if at.tag == "#":
            yield at
        else:
            stack += reversed(at.children)


@dataclass
class Wrapper:
    """An expression: ``repeated`` and ``optional`` groups of tags; a text is a constant, or a slot where ``constant`` is None."""

    tag: str
    words: frozenset
    label: str
    children: list = field(default_factory=list)
    repeated: bool = False
    optional: bool = False
    constant: str | None = None
    chars: int = 0
    linked: int = 0
    main: bool = False

    @classmethod
    def of(cls, node: Node, depth: int = 0) -> Wrapper:
        out = cls(node.tag, node.words, node.label, constant=_mark(node.text) if node.tag == "#" else None, chars=len(node.text), linked=node.linked)
        deep = [Node("#", text=" ".join(t.text for t in found), linked=sum(t.linked for t in found))] if depth >= DEEPEST and (found := [*_texts(node)]) and node.tag != "#" else None
        for child in deep or node.children:
            made = cls.of(child, depth + 1)
            if out.children and out.children[-1].label == made.label:
                out.children[-1].align(made)
                out.children[-1].repeated = True
            else:
                out.children.append(made)
        return out

    def align(self, other: Wrapper) -> None:
        """Takes in another expression of the same label: mismatches become slots, optional groups and repeated groups.

        Where labels differ, the side whose label the other one has sooner waits: time is linear in both but for the search of that place.
        """
        if self.constant != other.constant:
            self.constant = None
        self.chars += other.chars
        self.linked += other.linked
        self.repeated |= other.repeated
        self.optional |= other.optional
        a, b, i, j, out = self.children, other.children, 0, 0, []
        in_a, in_b = _places(a), _places(b)
        while i < len(a) or j < len(b):
            if i < len(a) and j < len(b) and a[i].label == b[j].label:
                made = a[i]
                made.align(b[j])
                i, j = i + 1, j + 1
            else:
                if j < len(b) and (i == len(a) or _next(in_b, a[i].label, j) - j < _next(in_a, b[j].label, i) - i):
                    made, j = b[j], j + 1
                else:
                    made, i = a[i], i + 1
                made.optional = True
            if out and out[-1].label == made.label:  # copies that came to stand side by side
                out[-1].align(made)
                out[-1].repeated = True
            else:
                out.append(made)
        self.children = out

    def accepts(self, node: Node, depth: int = 0) -> bool:
        """Whether the page's stream under ``node`` is one that this expression stands for."""
        if node.label != self.label or node.tag == "#" and self.constant is not None and self.constant != _mark(node.text):
            return False
        if depth >= DEEPEST:
            return True
        states = {0}
        for child in node.children:
            now: set[int] = set()
            for k in states:
                while k < len(self.children):
                    if self.children[k].accepts(child, depth + 1):
                        now |= {k, k + 1} if self.children[k].repeated else {k + 1}
                    if not self.children[k].optional and not (self.children[k].repeated and k in states and self.children[k].label == child.label):
                        break
                    k += 1
            states = now
        return any(all(c.optional or c.repeated for c in self.children[k:]) for k in states)

    def weight(self, pages: int) -> tuple[int, int]:
        """Characters of text under here that are neither surroundings nor links: those in slots, and all. Of a single page all are slots."""
        if around(self.tag, self.words):
            return 0, 0
        own = self.chars - self.linked if self.tag == "#" else 0
        parts = [c.weight(pages) for c in self.children]
        return own * (self.constant is None or pages < 2) + sum(p[0] for p in parts), own + sum(p[1] for p in parts)

    def _all(self, by_words: bool = True):
        yield self
        if not (around(self.tag, self.words) if by_words else self.tag in _AROUND_TAGS):
            for c in self.children:
                yield from c._all(by_words)

    def choose(self, pages: int) -> None:
        """Marks the region of the article: of the ``article`` or ``main`` tags the one whose slots hold most, else the smallest tag whose slots hold most of the text."""
        named: list = []
        for by_words in (True, False):
            named = named or [w for w in self._all(by_words) if (w.tag in ("article", "main") or w.words & _MAIN_WORDS) and any(w.weight(pages))]
        at = max(named, key=lambda w: (w.tag == "article" or "articlebody" in w.words, w.weight(pages)), default=None)
        if at is None:
            at, which = self, 0 if self.weight(pages)[0] else 1
            while True:
                inside = [c for c in at.children if c.tag != "#" and c.tag not in _HEADINGS and c.tag not in ("p", "li", "td", "pre", "blockquote") and not c.repeated]
                best = max(inside, key=lambda w: w.weight(pages)[which], default=None)
                if best is None or best.weight(pages)[which] < 0.6 * max(1, at.weight(pages)[which]):
                    break
                at = best
        at.main = True

    def _fixed(self) -> bool:
        return self.constant is not None if self.tag == "#" else all(c._fixed() for c in self.children)

    def _link_chars(self) -> tuple[int, int]:
        parts = [c._link_chars() for c in self.children]
        return sum(p[0] for p in parts) + self.linked * (self.tag == "#"), sum(p[1] for p in parts) + self.chars * (self.tag == "#")

    def packed(self, pages: int) -> list:
        """As JSON: label, whether it is the region, whether the template fills it (the same texts on several pages), whether all is linked, children."""
        linked, chars = self._link_chars() if self.tag in ("ul", "ol") else (0, 1)
        return [self.label, int(self.main), int(pages > 1 and self.tag != "#" and self._fixed()), int(linked > 0.8 * chars), [c.packed(pages) for c in self.children]]

    def plain(self) -> list:
        """As JSON, whole: other wrappers can still be aligned with it."""
        return [self.tag, sorted(self.words), int(self.repeated), int(self.optional), self.constant, self.chars, self.linked, [c.plain() for c in self.children]]

    @classmethod
    def again(cls, x: list) -> Wrapper:
        return cls(x[0], frozenset(x[1]), " ".join([x[0], *x[1]]), [cls.again(c) for c in x[7]], bool(x[2]), bool(x[3]), x[4], x[5], x[6])


def _places(children: list) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, c in enumerate(children):
        out.setdefault(c.label, []).append(i)
    return out


def _next(places: dict[str, list[int]], label: str, start: int) -> float:
    """The first place from ``start`` on that has the label."""
    found = places.get(label, ())
    at = bisect_left(found, start)
    return found[at] if at < len(found) else float("inf")


def _json(x: list) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def merged(trees: list[Wrapper]) -> Wrapper:
    """One wrapper of several, which are used up: neighbours are aligned, then what came of them."""
    while len(trees) > 1:
        for a, b in zip(trees[::2], trees[1::2]):
            a.align(b)
        trees = trees[::2]
    return trees[0]


class Part:
    """A packed wrapper, ready to read pages with."""

    def __init__(self, x: list):
        self.label, self.main, self.fixed, self.linked = x[0], x[1], x[2], x[3]
        self.children = [Part(c) for c in x[4]]
        self.places = _places(self.children)
        self.holds = self.main or any(c.holds for c in self.children)

    def parts(self, children: list[Node]) -> list[Part | None]:
        """For each child of a page's tag the part that describes it, looked for from the last one on, then from the start."""
        at, out = 0, []
        for child in children:
            found = _next(self.places, child.label, at)
            if found == float("inf"):
                found = _next(self.places, child.label, 0)
            else:
                at = found
            out.append(self.children[found] if found != float("inf") else None)
        return out


def _blocks(root: Node, wrapper: Part) -> list[str]:
    """Texts of the article's blocks in page order."""
    out: list[str] = []
    stack: list[tuple[Node, Part | None, str]] = [(root, wrapper, "out")]
    while stack:
        node, part, state = stack.pop()
        if node.tag == "#":
            if state != "out":
                out.append(node.text)
            continue
        if part and part.main:
            state = "named" if node.tag in ("article", "main") or node.words & _MAIN_WORDS else "found"
        more = []
        for child, of in zip(node.children, part.parts(node.children) if part else [None] * len(node.children)):
            if state == "out":
                if child.tag != "#" and (of is not None and of.holds or not around(child.tag, child.words)):
                    more.append((child, of, state))
            elif child.tag == "#":
                more.append((child, of, state))
            elif around(child.tag, child.words) or of is not None and (of.fixed and child.words & _UNCLEAR_WORDS or of.linked and state == "found"):
                continue
            elif child.tag == "header":
                more += [(h, None, state) for h in child.children if h.tag in _HEADINGS]
            else:
                more.append((child, of, state))
        stack += reversed(more)
    return out


def extract(page: str, wrapper: str | Part | None) -> str:
    """The page's main text by its host's wrapper; a page that the wrapper finds nothing on is taken as a host of its own."""
    tree = parse(page)
    out = _blocks(tree, Part(json.loads(wrapper)) if isinstance(wrapper, str) else wrapper) if wrapper else []
    if not out:
        own = Wrapper.of(tree)
        own.choose(1)
        out = _blocks(tree, Part(own.packed(1)))
    return "\n\n".join(out)


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, wrapper) of each host, from all its distinct pages.

    Only the pages' trees are shuffled, dealt by host and digest, so that a very frequent host does no harm; a part's trees are aligned in the order
    of their digests and the parts of a host in theirs, so that the result does not depend on how the rows lie.
    """
    host, _ = split_url(pages[f"`{url}`"])
    rows = pages.select(host.alias("host"), pages[f"`{page}`"].alias("page")).where("page is not null")

    def trees(batches):
        seen: set = set()
        for batch in slices(batches, 1):
            found = []
            for h, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest = hashlib.blake2b(p.encode(), digest_size=16).digest()
                if (h, digest) not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add((h, digest))
                    found.append((h, digest[0] % PARTS, digest, _json(Wrapper.of(parse(p)).plain())))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.string(), pa.int32(), pa.binary(), pa.string()))], ["host", "part", "digest", "tree"])

    def aligned(batches):
        key, last, whole, n = None, None, None, 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), pa.array([n], pa.int64()), pa.array([_json(whole.plain())], pa.string())], ["host", "part", "n", "tree"])
        for batch in batches:
            for h, part, digest, tree in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if key != (h, part):
                    if key:
                        yield out()
                    key, last, whole, n = (h, part), None, None, 0
                if digest != last:
                    made = Wrapper.again(json.loads(tree))
                    whole.align(made) if whole else None
                    whole, last, n = whole or made, digest, n + 1
        if key:
            yield out()

    def finished(batches):
        for batch in batches:
            found = []
            for parts in batch.column(1).to_pylist():
                whole = merged([Wrapper.again(json.loads(x["tree"])) for x in parts])
                pages = sum(x["n"] for x in parts)
                whole.choose(pages)
                found.append(_json(whole.packed(pages)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "wrapper"])

    dealt = rows.mapInArrow(tidy(trees), "host string, part int, digest binary, tree string").repartition("host", "part").sortWithinPartitions("host", "part", "digest")
    parts = dealt.mapInArrow(tidy(aligned), "host string, part int, n long, tree string")
    grouped = parts.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("part", "n", "tree"))).alias("parts"))
    return written(grouped.mapInArrow(finished, "host string, wrapper string"), "wrappers")


def main_texts(pages: DataFrame, url: str = "url", page: str = "html", output: str = "text") -> DataFrame:
    """Adds ``output``, the main text of every page: its blocks in page order, joined by two newlines.

    Left out are menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments: everything outside the region of the
    article, and inside it tags that are made for these, tags of unclear use that the template fills, and, if no ``article`` or ``main`` tag marks the
    region, lists of links. Headings in a ``header`` of the article belong to it. Null and empty pages give an empty text; pages without a host form one group. Repeated rows stay. Other columns stay; one
    named ``output`` is replaced (``__host`` and ``__wrapper`` are reserved).
    """
    made = wrappers(pages, url, page).select(F.col("host").alias("__host"), F.col("wrapper").alias("__wrapper"))
    size = made.agg(F.sum(F.octet_length("__wrapper"))).first()[0] or 0
    host, _ = split_url(F.col(f"`{url}`"))
    kept = [c for c in pages.columns if c != output]
    joined = pages.select(*[f"`{c}`" for c in kept]).withColumn("__host", host).join(F.broadcast(made) if size <= BROADCAST_BYTES else made, "__host", "left")
    joined = joined.select(*[f"`{c}`" for c in kept], "__wrapper")
    at = kept.index(page)

    def work(batches):
        known: dict[str, Part] = {}
        for batch in slices(batches, at):
            texts = []
            for p, w in zip(batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist(), strict=True):
                if w is not None and w not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[w] = Part(json.loads(w))
                texts.append(extract(p, known.get(w)) if p else "")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*batch.schema.names[:-1], output])

    return joined.mapInArrow(tidy(work), extended(joined.drop("__wrapper").schema, **{output: T.StringType()}))
