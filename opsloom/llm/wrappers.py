"""Main text of web pages: pages of one host are aligned into a wrapper, whose slots are judged and read out."""
from __future__ import annotations

import hashlib
import html
import json
import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, stored
from .url_filter import host_of

# Elements of HTML by their part in a page.
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
 h1 h2 h3 h4 h5 h6 head header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
DROPPED = frozenset("aside dialog fieldset footer form head menu nav search".split())
#: Dropped too, but parts of a line.
SILENT = frozenset("audio button canvas datalist label legend noscript object optgroup option select svg template video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | frozenset("# p li dt dd tr td th pre blockquote figcaption caption figure".split())
#: What an opening tag closes, and the element beyond which it does not look.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
          "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
          "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "body": ({"head"}, {"html"})}
# Words of class, id and role by which page parts are known.
UNWANTED = frozenset("""ad ads adbox adslot advert advertisement advertisements advertising adverts adsense alert alertdialog banner bottombar breadcrumb breadcrumbs comment
 commentlist comments complementary consent contentinfo cookie cookies copyright cta dialog discussion disqus feedback follow footer form gdpr header hidden lightbox login
 masthead menu menubar menus modal nav navbar navigation navlinks newsletter notice notices notification overlay pager pagination paging popular popup promo promotion
 recommendations recommended register related replies reply respond reviews search share sharing sidebar sidenav signin signup skip social sponsor sponsored subscribe
 subscription tagcloud teaser toolbar topbar trending widget widgets""".split())
#: Of these, words that containers of an article carry too (``has-sidebar``).
LAYOUT = frozenset("ad ads banner footer header hidden menu nav search sidebar widget widgets".split())
CONTENT = frozenset("article articlebody content entry main post story".split())

DEEPEST = 200
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")


class Node:
    """An element, a group or a text slot (``#``) of a wrapper: once, optional or repeated, with its parts."""

    __slots__ = ("tag", "words", "kids", "many", "optional", "payload")

    def __init__(self, tag: str, words: frozenset = frozenset(), kids: list | None = None, many: bool = False, optional: bool = False, payload=None) -> None:
        self.tag, self.words, self.kids, self.many, self.optional, self.payload = tag, words, kids if kids is not None else [], many, optional, payload

    def plain(self):
        return [self.tag, sorted(self.words), int(self.many) + 2 * int(self.optional), self.payload if self.tag == "#" else [k.plain() for k in self.kids]]

    @classmethod
    def of(cls, plain) -> Node:
        tag, words, flags, rest = plain
        node = cls(tag, frozenset(words), None, bool(flags & 1), bool(flags & 2))
        if tag == "#":
            node.payload = rest
        else:
            node.kids = [cls.of(k) for k in rest]
        return node

    def leaves(self) -> list[Node]:
        return [self] if self.tag == "#" else [leaf for kid in self.kids for leaf in kid.leaves()]


@lru_cache(100_000)
def _attributes(text: str) -> tuple[frozenset, bool]:
    """The words of class, id, role and itemprop without their digits, and whether the element is hidden."""
    words, hidden = set(), False
    for name, value in ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style":
            hidden = hidden or re.search(r"display\s*:\s*none", value) is not None
        elif name in ("class", "id", "role", "itemprop"):
            words.update(re.findall("[a-z]+", value))
    return frozenset(words), hidden


def parse(page: str) -> tuple[Node, list[str], list[int]]:
    """The elements that hold text, the texts in page order and how many of their characters are in links.

    Inline elements are part of their text, ``br`` and the like are white space. Tags without an end are closed
    as HTML closes them; end tags without a beginning are passed over, elements more than 200 deep belong to the one they lie in.
    """
    root = Node("")
    stack, texts, links, pieces = [root], [], [], []
    linked, mute, deep = 0, None, 0
    in_link = False
    strict = True
    at, size, last = 0, len(page), page.rfind(">")

    def text_of(raw: str) -> None:
        nonlocal linked
        if raw and mute is None:
            piece = html.unescape(raw) if "&" in raw else raw
            pieces.append(piece)
            if in_link:
                linked += len("".join(piece.split()))

    def flush() -> None:
        nonlocal linked
        if pieces:
            joined = " ".join("".join(pieces).split())
            if joined:
                stack[-1].kids.append(Node("#", payload=[len(texts)]))
                texts.append(joined)
                links.append(linked)
            pieces.clear()
        linked = 0

    def close(names, limits) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in limits:
                return

    while at < size:
        start = page.find("<", at)
        if start < 0 or start > last:
            text_of(page[at:])
            break
        text_of(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page[start + 1:start + 2] in ("!", "?"):
            at = page.find(">", start) + 1 or size
            continue
        tag = (TAG if strict else PLAIN_TAG).match(page, start)
        if tag is None and strict:
            # Once a quote stays open to the end of the page, tags end at the next ">".
            tag = PLAIN_TAG.match(page, start)
            strict = tag is None
        if tag is None:
            text_of("<")
            at = start + 1
            continue
        at = tag.end()
        closing, name, rest = tag.group(1), tag.group(2).lower(), tag.group(3)
        if mute is not None:
            # Silence ends with its element, or with the block that it lies in.
            own, inner, blocks = mute
            change = -1 if closing else 0 if name in VOID or name in RAW or rest.endswith("/") else 1
            inner, blocks = inner + change * (name == own), blocks + change * (name in BLOCK)
            mute = None if inner == 0 or blocks < 0 else (own, inner, blocks)
            if name in RAW and not closing:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            if blocks >= 0:
                continue
        if name in RAW and not closing:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            if name == "textarea":
                flush()
            continue
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                text_of(" ")
            continue
        if name not in BLOCK:
            if name == "a":
                in_link = not closing
            elif not closing and not rest.endswith("/"):
                words, hidden = _attributes(rest)
                if name in SILENT or hidden or words & UNWANTED and not words & CONTENT:
                    mute = (name, 1, 0)
            continue
        flush()
        in_link = False
        if closing:
            if deep:
                deep -= 1
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == name:
                    del stack[i:]
                    break
            continue
        if name in CLOSES:
            close(*CLOSES[name])
        if stack[-1].tag == "p" or stack[-1].tag in HEADINGS and name in HEADINGS:
            stack.pop()
        if len(stack) > DEEPEST:
            deep += 1
            continue
        words, hidden = _attributes(rest)
        node = Node(name, words | {"hidden", "unseen"} if hidden else words)
        stack[-1].kids.append(node)
        if not rest.endswith("/"):
            stack.append(node)
    flush()
    return root, texts, links


@lru_cache(200_000)
def likeness(tag: str, a: frozenset, other: str, b: frozenset) -> int:
    """2 for equal labels, 1 for the same element with half of the words of the one that has fewer, else 0."""
    if tag != other:
        return 0
    if a == b:
        return 2
    return int(2 * len(a & b) >= min(len(a), len(b)))


def _most_alike(a: list[Node], b: list[Node]) -> Iterator[tuple[Node | None, Node | None]]:
    """The alignment of most likeness; where several have it, a pair comes before a part of ``a`` alone, that before a part of ``b`` alone.

    A part counts as two letters: the first matches that of every part like it, the second that of equal parts, so likeness is the length of a common
    subsequence. A row of that table is an integer with a bit for each letter of ``b``, 0 where the length grows. Rows are made from the end; one in
    about sqrt(len(a)) is kept and those between are made again on the way back.
    """
    n, m = len(a), len(b)
    kinds: dict[tuple, int] = {}
    kind_of = np.array([kinds.setdefault((y.tag, y.words), len(kinds)) for y in reversed(b)])
    sizes = np.array([len(words) for _, words in kinds])
    holders = defaultdict(list)
    for (tag, words), k in kinds.items():
        for key in (tag, *((tag, w) for w in words)):
            holders[key].append(k)
    places = {key: np.array(held) for key, held in holders.items()}
    full = (1 << 2 * m) - 1

    def packed(first, second) -> int:
        return int.from_bytes(np.packbits(np.stack([first, second], axis=1), bitorder="little").tobytes(), "little")

    @lru_cache(256)
    def letters(tag: str, words: frozenset) -> tuple[int, int]:
        # As ``likeness`` has it, for all of b at once.
        shared, alike, none = np.zeros(len(kinds), int), np.zeros(len(kinds), bool), np.zeros(m, bool)
        for w in words:
            if (tag, w) in places:
                shared[places[tag, w]] += 1
        if tag in places:
            same = places[tag]
            alike[same] = 2 * shared[same] >= np.minimum(sizes[same], len(words))
        return packed(alike[kind_of], none), packed(none, kind_of == kinds.get((tag, words), -1))

    def after(row: int, i: int) -> int:
        for marks in letters(a[n - i].tag, a[n - i].words):
            met = row & marks
            row = (row + met | row ^ met) & full
        return row

    def length(row: int, j: int) -> int:
        return 2 * j - (row & ((1 << 2 * j) - 1)).bit_count()

    def growth(row: bytes, j: int) -> int:
        return 2 - (row[(j - 1) // 4] >> 2 * ((j - 1) % 4) & 3).bit_count()

    step = max(64, math.isqrt(n))
    kept, row = [full], full
    for i in range(1, (n - 1) // step * step + 1):
        row = after(row, i)
        if i % step == 0:
            kept.append(row)
    j, now = m, None
    while kept:
        rows = [kept.pop()]
        low = len(kept) * step
        for i in range(low + 1, min(low + step, n) + 1):
            rows.append(after(rows[-1], i))
        while len(rows) > 1:
            x, here, above = a[n - low - len(rows) + 1], rows.pop(), rows[-1]
            now, up = length(here, j) if now is None else now, length(above, j)
            here, above = (r.to_bytes(m // 4 + 1, "little") for r in (here, above))
            while j:
                y, grown = b[m - j], growth(above, j)
                score = likeness(x.tag, x.words, y.tag, y.words)
                if score and now == up - grown + score:
                    yield x, y
                    now, j = now - score, j - 1
                    break
                if now == up:
                    yield x, None
                    break
                yield None, y
                now, up, j = now - growth(here, j), up - grown, j - 1
            else:
                yield x, None
    yield from ((None, y) for y in b[m - j:])


def aligned(left: list[Node], right: list[Node]) -> Iterator[tuple[Node | None, Node | None]]:
    """Parts of two sequences side by side: equal parts at both ends, between them the alignment of most likeness."""
    def like(x, y):
        return likeness(x.tag, x.words, y.tag, y.words)

    head = 0
    while head < min(len(left), len(right)) and like(left[head], right[head]) == 2:
        yield left[head], right[head]
        head += 1
    tail = 0
    while tail < min(len(left), len(right)) - head and like(left[-1 - tail], right[-1 - tail]) == 2:
        tail += 1
    a, b = left[head:len(left) - tail], right[head:len(right) - tail]
    if a and b:
        yield from _most_alike(a, b)
    else:
        yield from ((x, None) for x in a)
        yield from ((None, y) for y in b)
    for k in range(tail, 0, -1):
        yield left[-k], right[-k]


def generalised(a: Node, b: Node, join: Callable) -> Node:
    """The expression that covers both: unmatched parts become optional, texts slots; ``join`` adds up what slots know."""
    if a.tag == "#":
        return Node("#", a.words, None, a.many or b.many, a.optional or b.optional, join(a.payload, b.payload))
    kids = []
    for x, y in aligned(a.kids, b.kids):
        if x is None or y is None:
            kid = x if y is None else y
            kid.optional = True
            kids.append(kid)
        else:
            kids.append(generalised(x, y, join))
    return Node(a.tag, a.words & b.words, kids, a.many or b.many, a.optional or b.optional)


def _square(a: Node, b: Node) -> bool:
    """Whether two neighbours are turns of one repetition: text-bearing elements always, containers with half of their parts in common."""
    if likeness(a.tag, a.words, b.tag, b.words) < 2:
        return False
    if a.tag in FLOW:
        return True
    x, y = Counter((k.tag, k.words) for k in a.kids), Counter((k.tag, k.words) for k in b.kids)
    return 2 * sum((x & y).values()) >= max(sum(x.values()), sum(y.values()))


def folded(node: Node, join: Callable = lambda x, y: x + y) -> Node | None:
    """The element with its repetitions found: equal neighbours, then runs of two to four parts that recur, become one repeated part. None without text."""
    if node.tag == "#":
        return node
    kids: list[Node] = []
    for kid in node.kids:
        kid = folded(kid, join)
        if kid is None:
            continue
        if kids and _square(kids[-1], kid):
            kids[-1] = generalised(kids[-1], kid, join)
            kids[-1].many = True
        else:
            kids.append(kid)
    for width in (2, 3, 4):
        kids = _grouped(kids, width, join)
    return Node(node.tag, node.words, kids) if kids else None


def _grouped(kids: list[Node], width: int, join: Callable) -> list[Node]:
    out, i = [], 0
    while i < len(kids):
        turns = 1
        while all(i + (turns + 1) * width <= len(kids) and _square(kids[i + k], kids[i + turns * width + k]) for k in range(width)):
            turns += 1
        if turns == 1:
            out.append(kids[i])
            i += 1
            continue
        group = Node("()", frozenset(), kids[i:i + width])
        for t in range(1, turns):
            group = generalised(group, Node("()", frozenset(), kids[i + t * width:i + (t + 1) * width]), join)
        group.many = True
        out.append(group)
        i += turns * width
    return out


#: What a slot knows: pages, texts, characters, characters in links, least and greatest hash of a page's texts in it.
def _added(x: list, y: list) -> list:
    return [x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] + y[3], min(x[4], y[4]), max(x[5], y[5])]


def unwanted(node: Node, holds_most: bool, in_article: bool) -> bool:
    """Whether an element is by name no part of an article."""
    if "unseen" in node.words or node.tag in DROPPED:
        return True
    if node.tag == "header":
        return not in_article
    if node.tag in ("html", "body", "main", "", "()", "#"):
        return False
    found = node.words & UNWANTED
    if node.words & CONTENT and found <= {"header"}:
        return False
    if in_article and found == {"header"} or (holds_most or node.tag == "article" and node.words & CONTENT) and found <= LAYOUT:
        return False
    return bool(found)


def kept_slots(wrapper: Node) -> list[Node]:
    """The slots of a wrapper that belong to the article.

    Elements named as menus, headers, footers, sidebars, notices, adverts, forms or comments go. The article is what lies in ``article``, else
    ``main``, else an element named so, else the innermost container that holds three fifths of the text that is no link, with the headings in
    front of it. In it go slots that are nearly all links, and texts that at least three pages have alike (headings aside) where others differ.
    """
    total = sum(leaf.payload[2] - leaf.payload[3] for leaf in wrapper.leaves()) or 1
    sums: dict[int, int] = {}

    def weigh(node: Node) -> int:
        sums[id(node)] = node.payload[2] - node.payload[3] if node.tag == "#" else sum(weigh(k) for k in node.kids)
        return sums[id(node)]

    weigh(wrapper)

    def clean(node: Node, in_article: bool = False, tags: tuple = ()) -> list[tuple[Node, tuple]]:
        if node.tag == "#":
            return [(node, tags)]
        if unwanted(node, sums[id(node)] * 5 >= total * 3, in_article):
            return []
        inside = in_article or node.tag in ("article", "main")
        return [x for k in node.kids for x in clean(k, inside, (*tags, node.tag))]

    def outermost(node: Node, test) -> list[Node]:
        if node.tag == "#" or unwanted(node, sums[id(node)] * 5 >= total * 3, node.tag == "main"):
            return []
        return [node] if test(node) else [x for k in node.kids for x in outermost(k, test)]

    def own(nodes: list[Node]) -> int:
        return sum(leaf.payload[2] - leaf.payload[3] for n in nodes for leaf, _ in clean(n, True))

    explicit, wanted = False, sum(leaf.payload[2] - leaf.payload[3] for leaf, _ in clean(wrapper))
    chosen: list[tuple[Node, tuple]] = []
    for test in (lambda n: n.tag == "article", lambda n: n.tag == "main" or "main" in n.words and n.tag not in ("html", "body"),
                 lambda n: bool(n.words & CONTENT) and n.tag not in FLOW and n.tag not in ("html", "body")):
        roots = outermost(wrapper, test)
        if roots and 4 * own(roots) >= wanted:
            explicit = True
            chosen = [x for r in roots for x in clean(r, True)]
            there = {id(leaf) for leaf, _ in chosen}
            mains = outermost(wrapper, lambda n: n.tag == "main")
            chosen += [(leaf, tags) for m in mains for leaf, tags in clean(m, True) if "h1" in tags and id(leaf) not in there]
            break
    if not explicit:
        at, titles = wrapper, []
        while True:
            weights = {id(k): sum(leaf.payload[2] - leaf.payload[3] for leaf, _ in clean(k)) for k in at.kids}
            heavy = next((k for k in at.kids if k.tag not in FLOW and k.tag != "()" and weights[id(k)] * 5 >= 3 * sum(weights.values()) > 0), None)
            if heavy is None:
                break
            for kid in at.kids[:at.kids.index(heavy)]:
                titles += [(leaf, tags) for leaf, tags in clean(kid) if {"h1", "h2"} & set(tags)]
            at = heavy
        chosen = titles + clean(at)

    def varies(leaf: Node) -> bool:
        return leaf.payload[0] < 3 or leaf.payload[4] != leaf.payload[5]

    differ = any(leaf.payload[0] >= 3 and varies(leaf) for leaf, _ in chosen)
    out = []
    for leaf, tags in chosen:
        pages, _, chars, linked, _, _ = leaf.payload
        listed = bool({"li", "td", "ul", "ol", "dd"} & set(tags))
        if linked > (0.8 if explicit else 0.5) * chars and (listed or not explicit):
            continue
        if differ and not varies(leaf) and not HEADINGS & set(tags):
            continue
        out.append(leaf)
    return out


def _slots(wrapper: Node, shape: Node) -> Iterator[tuple[Node | None, Node]]:
    """Each slot of a page's shape with the slot of the wrapper it falls in."""
    if shape.tag == "#":
        yield (wrapper if wrapper is not None and wrapper.tag == "#" else None), shape
        return
    for w, s in aligned(wrapper.kids if wrapper is not None else [], shape.kids):
        if s is not None:
            yield from _slots(w, s)


_PAGE = "struct<leaf:int,n:long,chars:long,links:long,hash:long>"


def _shapes(batches: Iterator[pa.RecordBatch], page: str, fields: list[pa.Field]) -> Iterator[pa.RecordBatch]:
    """Pages as shapes and texts; a shape itself is sent once by each task."""
    sent: set[tuple] = set()
    added = [pa.field("shape_id", pa.string()), pa.field("shape", pa.string()), pa.field("blocks", pa.list_(pa.struct([("leaf", pa.int32()), ("text", pa.string())]))),
             pa.field("slots", pa.list_(pa.struct([("leaf", pa.int32()), ("n", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()), ("hash", pa.int64())])))]
    for batch in batches:
        out = []
        for host, text in zip(batch.column("host").to_pylist(), batch.column(page).to_pylist()):
            root, texts, links = parse(text or "")
            shape = folded(root) or Node("")
            leaf_of, slots = {}, []
            for i, leaf in enumerate(shape.leaves()):
                inside = leaf.payload
                leaf.payload = None
                joined = hashlib.blake2b("\n".join(texts[b] for b in inside).encode("utf-8", "surrogatepass"), digest_size=8).digest()
                slots.append((i, len(inside), sum(len(texts[b]) for b in inside), sum(links[b] for b in inside), int.from_bytes(joined, "big", signed=True)))
                leaf_of.update(dict.fromkeys(inside, i))
            plain = json.dumps(shape.plain(), separators=(",", ":"))
            key = hashlib.sha256(plain.encode()).hexdigest()
            new = (host, key) not in sent
            if new and len(sent) < 100_000:
                sent.add((host, key))
            out.append((key, plain if new else None, [{"leaf": leaf_of[b], "text": t} for b, t in enumerate(texts)], [dict(zip(("leaf", "n", "chars", "links", "hash"), s)) for s in slots]))
        rest = [batch.column(f.name) for f in fields]
        made = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(rest + [pa.array(c, f.type) for c, f in zip(made, added)], schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(fields, rest)] + added))


def _wrap(rows: pd.DataFrame) -> pd.DataFrame:
    """One wrapper from those of a group, aligned one after the other in the order of their text."""
    wrapper = None
    for plain in sorted(rows["wrapper"]):
        node = Node.of(json.loads(plain))
        wrapper = node if wrapper is None else generalised(wrapper, node, _added)
    return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(wrapper.plain(), separators=(",", ":"))]})


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shapes with what their slots know: wrappers of one shape."""
    for batch in batches:
        out = []
        for plain, slots in zip(batch.column("shape").to_pylist(), batch.column("slots").to_pylist()):
            node = Node.of(json.loads(plain))
            for leaf, s in zip(node.leaves(), sorted(slots, key=lambda s: s["leaf"])):
                leaf.payload = [s[k] for k in ("pages", "n", "chars", "links", "lo", "hi")]
            out.append(json.dumps(node.plain(), separators=(",", ":")))
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(out, pa.string())], names=["host", "wrapper"])


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, tuple] = {}
    for batch in batches:
        keep = []
        for plain, text in zip(batch["shape"], batch["wrapper"]):
            if text not in known:
                known.clear()
                wrapper = Node.of(json.loads(text))
                known[text] = wrapper, {id(leaf) for leaf in kept_slots(wrapper)}
            wrapper, good = known[text]
            shape = Node.of(json.loads(plain))
            keep.append([i for i, (w, _) in enumerate(_slots(wrapper, shape)) if w is not None and id(w) in good])
        yield pd.DataFrame({"host": batch["host"], "shape_id": batch["shape_id"], "keep": keep})


def host_wrappers(shapes: DataFrame, fan: int = 64) -> DataFrame:
    """``host`` and ``wrapper`` from ``host``, ``wrapper`` of its shapes: about ``fan`` at a time are aligned, round by round, until one is left."""
    now = shapes
    while True:
        counts = now.groupBy("host").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return now
        parts = F.pmod(F.xxhash64("wrapper"), F.greatest(F.ceil(F.col("n") / fan), F.lit(1)))
        dealt = now.join(counts, "host").withColumn("part", F.when(F.col("n") <= fan, F.lit(0)).otherwise(parts))
        now = stored(dealt.groupBy("host", "part").applyInPandas(_wrap, "host string, wrapper string"), "wrappers")


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", page: str = "html", salts: int = 16, name: str = "text") -> DataFrame:
    """``id``, ``url`` and ``name``: the blocks of the article in page order, parted by two line breaks.

    Pages of a host are read as streams of elements and texts; repetitions in a page are folded, and the distinct shapes of the host are aligned
    one with the next into one wrapper of elements, optional and repeated parts and text slots. Slots gather over all pages how much text and how
    many links they hold and whether it is ever the same, and are judged once (``kept_slots``); each page gives the texts of the kept ones.

    Null and empty pages, and those without a text to keep, have an empty text; a null url belongs to the host ''. Equal rows have equal results;
    repeated ids are pages of their own. Character references are decoded, white space in a block becomes one blank, nothing is cut.

    Pages are parsed once, where they lie. Only shapes and slot sums are shuffled, summed per (host, shape, slot) before that; a host's shapes are
    aligned some at a time, so that no host is one task. The decisions come back by host and shape, salted, for hosts with many pages.
    """
    given = pages.select(F.col(f"`{id}`").alias("id"), F.col(f"`{url}`").alias("url"), host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{page}`").alias("page"))
    kept = [pa.field(c, pa.null()) for c in ("id", "url", "host")]
    types = {f.name: f.dataType.simpleString() for f in given.schema}
    schema = (f"id {types['id']}, url string, host string, shape_id string, shape string, blocks array<struct<leaf:int,text:string>>, slots array<{_PAGE}>")
    read = stored(in_arrow(given, lambda batches: _shapes(batches, "page", kept), schema), "shapes")
    sums = (read.select("host", "shape_id", F.explode("slots").alias("s")).groupBy("host", "shape_id", F.col("s.leaf").alias("leaf"))
            .agg(F.count("*").alias("pages"), F.sum("s.n").alias("n"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"),
                 F.min("s.hash").alias("lo"), F.max("s.hash").alias("hi"))
            .groupBy("host", "shape_id").agg(F.collect_list(F.struct("leaf", "pages", "n", "chars", "links", "lo", "hi")).alias("slots")))
    distinct = stored(read.groupBy("host", "shape_id").agg(F.min("shape").alias("shape")).join(sums, ["host", "shape_id"]), "distinct")
    wrappers = host_wrappers(stored(in_arrow(distinct.select("host", "shape", "slots"), _filled, "host string, wrapper string"), "wrappers"))
    met = distinct.select("host", "shape_id", "shape").join(wrappers, "host").sortWithinPartitions("host")
    decided = stored(met.mapInPandas(_decide, "host string, shape_id string, keep array<int>"), "decisions")
    salt = F.pmod(F.xxhash64("id", "url"), F.lit(salts))
    copies = decided.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    joined = read.select("id", "url", "host", "shape_id", "blocks", salt.alias("salt")).join(copies, ["host", "shape_id", "salt"], "left")
    text = F.array_join(F.transform(F.filter("blocks", lambda b: F.array_contains("keep", b["leaf"])), lambda b: b["text"]), "\n\n")
    return joined.select(F.col("id").alias(id), F.col("url").alias(url), F.coalesce(text, F.lit("")).alias(name))

