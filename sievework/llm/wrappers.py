"""Main text by wrappers: union-free regular expressions over tokens, inferred for each host.

A page is a stream of tokens: the opening and closing of blocks, and text.  The stream of one page is its first wrapper;
equal groups of neighbours fold into repeated groups.  Wrappers of a host are aligned token by token: where both agree
they go on; a text that differs becomes a text slot; at a tag that differs the nearer of the two next agreements ends
the mismatch, and what was passed over becomes optional; a group that stands again right after itself becomes repeated.
The stream inside a block is aligned with that of the block it agrees with, so groups stay well formed.

The wrapper of the host then says which slots are the article.  Menus are groups of mostly links; the template is text
that is the same on all pages of a host, of which eight different ones at least were seen, and that is the smaller part
of what they say; regions of navigation, notices, adverts, forms and comments go by their tags and names; and where the
host marks an article or main region only that is read.  Each page is aligned with the wrapper once more, and its
blocks share the verdict of the slot they fall into: siblings of one key in two slots are judged apart.

Aligning is associative up to the order of optional parts, so tasks merge what they read and salted groups merge the
partial wrappers of a host in three steps; a host with a third of all pages needs nothing else.  A block of more than
WIDTH different slots keeps one slot for each tag, in any order, so a wrapper does not grow with the pages.

Null html is empty: the text is '' then, as it is for a page without main text.  A null or odd URL has the host ''.
Repeated rows each get their own equal result.  Blocks below DEPTH levels count as blocks of that level; a tag without
its end is text.  Only the key, url and html columns are read.
"""
from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Hosts whose wrappers a task holds before it passes them on.
HELD_HOSTS = 2000
#: The groups of a host in each step of merging.
SALTS = (1024, 32, 1)
#: Wrappers of this size together are broadcast to the pages; larger ones are joined by host.
BROADCAST_BYTES = 8 << 20
#: A repeated group is of this many neighbours at most.
PERIOD = 3
DEPTH = 150
WIDTH = 400
#: Text is the template's where so many different pages of a host were seen and all have it.
PAGES = 8

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style", "textarea", "title", "xmp", "noscript", "template", "iframe")
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_DROPPED = frozenset("head nav footer aside form script style noscript template iframe button select input textarea svg canvas object dialog menu title xmp".split())
_NAMED = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription"
    r"|share|sharing|social|sidebar|widget|related|recommend(?:ed|ations)?|breadcrumbs?|menu|nav(?:bar|igation)?|comments?|disqus|replies|respond|footer|masthead|site-header|page-header|login|signup|search|pagination|pager|toolbar|skip|tags|byline-links|copyright|disclaimer)(?:$|[-_\s\d])",
    re.I)
_KNOWN = _VOID | _CLOSES_P | _DROPPED | frozenset(("html", "body", "label", "figcaption", "summary", "caption", "tbody", "thead", "tfoot", "legend", *_SIBLINGS))
#: Names that say what a text is about, not what the block is.
_TOPIC = re.compile(r"(?:tag|category)-", re.I)
#: Stands in the key of a block that goes by one of its names.
DROPS = "!"
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Node:
    """A block of a page: its key, its inner text runs and blocks in order."""

    __slots__ = ("key", "tag", "hidden", "parts")

    def __init__(self, key: str, tag: str, hidden: bool):
        self.key, self.tag, self.hidden, self.parts = key, tag, hidden, []


def _named(tag: str, raw: str) -> tuple[str, bool]:
    """The key of a tag, and whether it is out of sight.

    The key takes the first names of class, id and role without digits, so that it is alike on all pages of a host, then
    the mark DROPS where any of all its names is one of those that are dropped, and "main" where any name is that.
    """
    if not raw.strip():
        return tag, False
    found = {m[0].lower(): m[1] or m[2] or m[3] for m in _ATTRIBUTE.findall(raw)}
    every = [found.get(k, "").split() for k in ("class", "id", "role")]
    names = [n for some in every for n in some[:3] if not re.search(r"\d", n)]
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) is not None
    marks = [DROPS] * any(_NAMED.search(n) and not _TOPIC.match(n) for some in every for n in some) + ["main"] * any("main" in some for some in every)
    return " ".join([" ".join([tag, *(n for n in names if n not in (DROPS, "main"))])[:80].rstrip(), *marks]), hidden


def tokens(html: str) -> Iterator[tuple]:
    """("text", text), ("open", tag, attributes, inside) or ("close", tag) for a page, each place of it read once; inside
    says whether what follows is in the block."""
    at = text_from = 0
    n, unpaired = len(html), set()
    while (start := html.find("<", at)) >= 0:
        m = _NAME.match(html, start)
        if m:
            end = m.end()
            while (stop := _STOP.search(html, end)) and stop[0] != ">":
                close = -1 if stop[0] in unpaired else html.find(stop[0], stop.end())
                if close < 0:
                    unpaired.add(stop[0])
                end = stop.end() if close < 0 else close + 1
            if not stop:  # no tag ends after this place
                break
            end = stop.end()
        elif html.startswith("<!--", start):
            end = html.find("-->", start + 4) + 3
            end = end if end > 2 else n
        elif html.startswith(("<!", "<?"), start):
            end = html.find(">", start) + 1
            if not end:
                break
        else:
            at = start + 1
            continue
        if start > text_from:
            yield "text", unescape(html[text_from:start])
        if m:
            tag, raw = m[2].lower(), html[m.end() : end - 1]
            if m[1]:
                yield "close", tag
            else:
                yield "open", tag, raw, tag not in _VOID and tag not in _RAW and not raw.endswith("/")
                if tag in _RAW:
                    close = _raw_end(tag).search(html, end)
                    end = close.end() if close else n
        at = text_from = end
    if n > text_from:
        yield "text", unescape(html[text_from:])


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>", re.I)


def tree(html: str) -> Node:
    """The page as blocks.  A part is a (text, in a link) pair or a Node; inline tags leave no trace but for links."""
    root = Node("#", "#", False)
    stack, link, opened = [root], 0, Counter()  # stack: what takes the parts of each open block
    tags, buried = ["#"], [False]  # of the open blocks; whether one below DEPTH levels, without a place of its own, hides its text

    def pop(to: int) -> None:
        opened.subtract(tags[to:])
        del stack[to:], tags[to:], buried[to:]

    for token in tokens(html):
        if token[0] == "text":
            if not buried[-1]:
                stack[-1].parts.append((token[1], link > 0))
            continue
        tag = token[1]
        if tag in _INLINE:
            if tag == "a":
                link = max(0, link - 1) if token[0] == "close" else 1
            elif tag == "br":
                stack[-1].parts.append(("\n", False))
            continue
        link = 0
        if token[0] == "close":
            if opened[tag]:
                at = len(tags) - 1
                while tags[at] != tag:
                    at -= 1
                pop(at)
            continue
        if tag in _CLOSES_P and tags[-1] == "p":
            pop(len(tags) - 1)
        while tag in _SIBLINGS and tags[-1] in ("p", *_SIBLINGS[tag]):
            pop(len(tags) - 1)
        node = Node(*_with_tag(tag, token[2]))
        node.hidden = node.hidden or buried[-1]
        stack[-1].parts.append(node)
        if token[3]:
            deep = len(stack) >= DEPTH
            buried.append(buried[-1] or deep and (node.hidden or _goes(node.key, True)))
            stack.append(stack[DEPTH - 1] if deep else node)
            tags.append(tag)
            opened[tag] += 1
    return root


def _with_tag(tag: str, raw: str) -> tuple[str, str, bool]:
    key, hidden = _named(tag, raw)
    return key, tag, hidden


# A wrapper is a list: key, pages, repeated, characters, link characters, the text if it is always the same (as a hash,
# 0 for none yet, -1 where it differs), the slots below, and whether these stand in any order.
KEY, SEEN, AGAIN, CHARS, LINKS, SAID, BELOW, LOOSE = range(8)


def learned(node: Node) -> list:
    """A page's own wrapper."""
    chars = links = 0
    children, said = [], []
    for part in node.parts:
        if isinstance(part, Node):
            if not part.hidden:
                children.append(learned(part))
        else:
            solid = "".join(part[0].split())
            chars += len(solid)
            links += len(solid) * part[1]
            said.append(solid)
    text = "".join(said)
    return _bounded([node.key, 1, 0, chars, links, xxhash.xxh3_64_intdigest(text) >> 1 if text else 0, _folded(children), 0])


def _merged(a: list, b: list) -> list:
    return _one_page(aligned(a, b))


def _repeated(c: list) -> list:
    return [*c[:AGAIN], 1, *c[AGAIN + 1 :]]


def _folded(children: list, merged=_merged, repeated=_repeated) -> list:
    """Runs of equal groups of one to three neighbours become one repeated group each; a child's key comes first in it."""
    for period in range(1, PERIOD + 1):
        out: list = []
        at = 0
        while at < len(children):
            group = children[at : at + period]
            keys = [c[0] for c in group]
            end = at + period
            if len(group) == period and (period == 1 or len(set(keys)) > 1):
                while [c[0] for c in children[end : end + period]] == keys:
                    group = [merged(a, b) for a, b in zip(group, children[end : end + period], strict=True)]
                    end += period
            if end > at + period:
                out += [repeated(c) for c in group]
                at = end
            else:
                out.append(children[at])
                at += 1
        children = out
    return children


def _one_page(w: list) -> list:
    return [w[KEY], 1, *w[AGAIN:BELOW], [_one_page(c) for c in w[BELOW]], w[LOOSE]]


def _paired(ka: list, kb: list) -> Iterator[tuple[int | None, int | None]]:
    """Two streams aligned: (i, j) where they agree; at a mismatch the nearer next agreement of either side ends it, and
    what is passed over has None on the other side.  Every place is looked up in the positions of its key."""
    at_a, at_b = defaultdict(list), defaultdict(list)
    for keys, at in ((ka, at_a), (kb, at_b)):
        for i, k in enumerate(keys):
            at[k].append(i)
    i = j = 0
    while i < len(ka) and j < len(kb):
        if ka[i] == kb[j]:
            yield i, j
            i, j = i + 1, j + 1
            continue
        in_b, in_a = at_b.get(ka[i], ()), at_a.get(kb[j], ())
        x, y = bisect_left(in_b, j), bisect_left(in_a, i)
        to_b = in_b[x] if x < len(in_b) else None
        to_a = in_a[y] if y < len(in_a) else None
        if to_b is None and to_a is None:
            yield i, None
            yield None, j
            i, j = i + 1, j + 1
        elif to_a is None or to_b is not None and to_b - j <= to_a - i:
            for k in range(j, to_b):
                yield None, k
            j = to_b
        else:
            for k in range(i, to_a):
                yield k, None
            i = to_a
    for k in range(i, len(ka)):
        yield k, None
    for k in range(j, len(kb)):
        yield None, k


def _loose_key(key: str) -> str:
    tag, _, names = key.partition(" ")
    return " ".join([tag if tag in _KNOWN else "*", *(n for n in names.split(" ") if n in (DROPS, "main"))])


def _bounded(w: list) -> list:
    """A block of too many slots gets one for each tag, in any order."""
    if len(w[BELOW]) > WIDTH and not w[LOOSE]:
        w = _loosened(w)
    return w


def _loosened(w: list) -> list:
    by_key: dict[str, list] = {}
    for c in w[BELOW]:
        c = [_loose_key(c[KEY]), *c[SEEN:]]
        if c[KEY] in by_key:
            pages = max(by_key[c[KEY]][SEEN], c[SEEN])
            c = aligned(by_key[c[KEY]], c)
            c[SEEN], c[AGAIN] = pages, 1
        by_key[c[KEY]] = c
    return [*w[:BELOW], [by_key[k] for k in sorted(by_key)], 1]


def aligned(a: list, b: list) -> list:
    """The wrapper that covers both; parts of one side only have fewer pages than what holds them: they are optional."""
    loose = a[LOOSE] or b[LOOSE]
    if loose:
        a, b = (x if x[LOOSE] else _loosened(x) for x in (a, b))
    ka, kb = [c[KEY] for c in a[BELOW]], [c[KEY] for c in b[BELOW]]
    if loose:
        left, right = dict(zip(ka, a[BELOW], strict=True)), dict(zip(kb, b[BELOW], strict=True))
        children = [aligned(left[k], right[k]) if k in left and k in right else left.get(k) or right[k] for k in sorted({*ka, *kb})]
    else:
        children = [b[BELOW][j] if i is None else a[BELOW][i] if j is None else aligned(a[BELOW][i], b[BELOW][j]) for i, j in _paired(ka, kb)]
        if ka != kb:
            children = _folded_wrapper(children)
    said = a[SAID] if a[SAID] == b[SAID] else -1
    return _bounded([a[KEY], a[SEEN] + b[SEEN], a[AGAIN] | b[AGAIN], a[CHARS] + b[CHARS], a[LINKS] + b[LINKS], said, children, loose])


def _folded_wrapper(children: list) -> list:
    """A group that stands again right after itself becomes repeated."""
    out: list = []
    for c in children:
        if out and out[-1][KEY] == c[KEY]:
            pages = max(out[-1][SEEN], c[SEEN])
            out[-1] = aligned(out[-1], c)
            out[-1][SEEN], out[-1][AGAIN] = pages, 1
        else:
            out.append(c)
    return out


def expression(w: list) -> str:
    """The wrapper as a union-free regular expression: #TEXT for slots, ( )? for optional and ( )+ for repeated parts."""
    inner = ("#TEXT " if w[CHARS] else "") + " ".join(f"({expression(c)}){'+' if c[AGAIN] else ''}{'?' if c[SEEN] < w[SEEN] else ''}" if c[AGAIN] or c[SEEN] < w[SEEN] else expression(c) for c in w[BELOW])
    return f"<{w[KEY]}> {inner.strip()} </{w[KEY].split(' ')[0]}>"


def _goes(key: str, inside: bool) -> bool:
    """Whether tag and names alone drop a block."""
    tag, _, names = key.partition(" ")
    return tag in _DROPPED or tag == "header" and not inside or tag not in ("body", "html", "main") and DROPS in names.split(" ")


def _mass(w: list) -> tuple[int, int]:
    """The characters and link characters of a slot and all below."""
    chars, links = w[CHARS], w[LINKS]
    for c in w[BELOW]:
        x, y = _mass(c)
        chars, links = chars + x, links + y
    return chars, links


def _template(w: list, pages: int) -> bool:
    """Whether a slot says the same on every page."""
    return w[SEEN] == pages and w[SAID] > 0 and not w[BELOW] and w[KEY].split(" ")[0] in ("p", "div", "section", "span", "li", "td", "dd", "blockquote", "figcaption")


def _fixed(w: list, pages: int) -> int:
    return (w[CHARS] if _template(w, pages) else 0) + sum(_fixed(c, pages) for c in w[BELOW])


def slots(w: list, seen: int = 0) -> list:
    """The wrapper with its verdicts: [key, dropped with all below, an article or main region, slots below, in any order].
    ``seen``: the different pages of the host, up to PAGES."""
    known = seen >= PAGES and 2 * _fixed(w, w[SEEN]) < _mass(w)[0]
    return _slots(w, w[SEEN] if known else -1, False, True)


def _slots(w: list, pages: int, inside: bool, top: bool) -> list:
    tag, _, names = w[KEY].partition(" ")
    if not top:
        chars, links = _mass(w)
        menu = tag in ("ul", "ol", "div", "section", "table", "p") and links > 0.6 * chars and links > 0
        if _goes(w[KEY], inside) or menu or _template(w, pages):
            return [w[KEY], True, False, [], 0]
    region = not inside and (tag in ("article", "main") or "main" in names.split(" ") and tag != "body") and _mass(w)[0] > 0
    return [w[KEY], False, region, [_slots(c, pages, inside or region, False) for c in w[BELOW]], w[LOOSE]]


def placed(node: Node, slot: list, found: dict) -> dict:
    """The slot of each block of the page in sight and not dropped, by the block's id()."""
    found[id(node)] = slot
    if slot[1]:
        return found
    blocks = [[p.key, [p]] for p in node.parts if isinstance(p, Node) and not p.hidden]
    if slot[4]:
        by_key = {s[0]: s for s in slot[3]}
        for key, (block,) in blocks:
            placed(block, by_key[_loose_key(key)], found)
        return found
    groups = _folded(blocks, lambda a, b: [a[0], a[1] + b[1]], lambda c: c)
    for i, j in _paired([s[0] for s in slot[3]], [g[0] for g in groups]):
        for block in groups[j][1] if i is not None and j is not None else ():
            placed(block, slot[3][i], found)
    return found


def article(root: Node, wrapper: list) -> str:
    """The blocks of the regions (of the whole page where it has none of them), each with single spaces, one a line.  A
    block without a slot is judged by its tag and names."""
    verdicts = placed(root, wrapper, {})
    blocks: list[str] = []

    def walk(node: Node, inside: bool) -> None:
        _, dropped, region, *_ = verdicts.get(id(node)) or (node.key, _goes(node.key, inside), False)
        if node.hidden or dropped:
            return
        inside = inside or region
        run: list[str] = []

        def flush() -> None:
            said = " ".join("".join(run).split())
            if said:
                blocks.append(said)
            run.clear()

        for part in node.parts:
            if isinstance(part, Node):
                flush()
                walk(part, inside)
            elif inside:
                run.append(part[0])
        flush()

    walk(root, not any(s[2] for s in verdicts.values()))
    return "\n".join(blocks)


def host_of(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _joined(a: dict, b: dict) -> dict:
    """Wrappers of one host, each with the least hashes of its different pages, PAGES at most."""
    return {"wrapper": aligned(a["wrapper"], b["wrapper"]), "pages": sorted({*a["pages"], *b["pages"]})[:PAGES]}


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, wrapper (JSON) for every host."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def passed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])
            held.clear()
            return out

        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {"wrapper": learned(tree(page or "")), "pages": [xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass"))]}
                held[host] = _joined(held[host], own) if host in held else own
                if len(held) >= HELD_HOSTS:
                    yield passed()
        yield passed()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = None
        for w in sorted(group["wrapper"]):
            total = json.loads(w) if total is None else _joined(total, json.loads(w))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "wrapper": [json.dumps(total)]})

    parts = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html")).mapInArrow(collect, "host string, wrapper string")
    for salts in SALTS:
        parts = parts.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt").applyInPandas(lambda g: merge(g), "host string, wrapper string")
    return parts


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: the key, url, text and n_chars."""
    wrappers = materialise(infer(pages, url, html))
    size = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    own = pages.select(F.col(f"`{key}`").alias("key"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html"), host_of(F.col(f"`{url}`")).alias("host"))
    kind = own.schema["key"].dataType
    joined = own.join(F.broadcast(wrappers) if size <= BROADCAST_BYTES else wrappers, "host").select("key", "url", "html", "host", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        for batch in batches:
            texts = []
            for page, host, wrapper in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if host not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    found = json.loads(wrapper)
                    known[host] = slots(found["wrapper"], len(found["pages"]))
                texts.append(article(tree(page or ""), known[host]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["key", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"key {kind.simpleString()}, url string, text string, n_chars long").withColumnRenamed("key", key)
