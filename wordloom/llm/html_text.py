"""Operator 5: main text of web pages by consensus host paths.

Pass 1 parses every page, scores its containers (text outside boilerplate,
less the share inside links) and votes, a page once, for the path of the best
one: the tags and classes from the root, with digits generalised.  Spark counts
the votes of each host and keeps the winner.  Pass 2 parses every page again
and extracts from the elements on its host's winning path; a page that has
none there falls back on its own best container.

The best container is the deepest that holds nearly all such text, articles
and main elements before others; from there the choice goes up to the highest
container around it, inside the same article or main element if it is in one
and below the body if not, that has text of its own (a heading or a lead).
Scores are summed from children to parents once, so a page takes time linear
in its length however deep it is; a path is named by a digest of all of it.

Menus, headers and footers of pages, sidebars, notices, adverts, forms,
reader comments, scripts, styles and markup are left out: by element, role or
style, or by a class or id of which every word is one of boilerplate or of
structure (comment-list goes, share-price stays).  Words that an article may
use for its own parts (legal, tags, copyright) count outside of it only.
Character references are decoded, white space inside a block is one space,
blocks are joined by one newline; nothing is capped.

Null html is empty and gives an empty string; a page without a container
gives the text of its body; a null url counts as the host ''.  Repeated rows
vote and are returned apiece; of paths with as many votes the smallest digest
wins.  An empty table gives an empty table.  Only page_id, url and html are
read, whatever other columns are named.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import ASCII_LOWER, ASCII_UPPER, materialize

#: Winners are broadcast up to this many hosts (a path is 32 characters); beyond it they are joined.
BROADCAST_HOSTS = 20_000

_TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z))""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
_CONTAINER = frozenset("article main section div body td blockquote".split())
_CLOSES_P = _BLOCK - {"option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "head", "title", "legend"}
_DROP = frozenset("nav footer aside form script style noscript template svg math button select textarea iframe object canvas audio video dialog menu head title label input option noembed noframes xmp search fieldset".split())
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
#: Words of boilerplate in a class or id.
_BAD = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox adunit sponsor sponsored sponsors promo promos promoted banner banners comment comments commentlist respond disqus replies "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe signup subscription paywall menu menus nav navbar navigation navigator breadcrumb breadcrumbs sidebar sidebars sidenav aside "
    "footer footers masthead topbar toolbar share sharing social socials related recommended recommendations recommend widget widgets pagination pager paging searchbox searchform tagcloud".split()
)
#: Words of boilerplate around an article that may name parts of its text inside.
_OUTSIDE = frozenset("promotion reply discussion rail foot trending login search hidden skip copyright legal disclaimer tags".split())
#: Words that say nothing of what is inside.
_NEUTRAL = frozenset("all area article articles author bar body bottom box block button buttons card col column container content count desktop div el element follow form global google group header heading holder icon icons info inner item items js l latest left link links list main media message meta mobile module more new news outer page panel policy popular post posts recent region right row section settings site slot space sticky stories story text thread title top unit user video videos view wp wrap wrapper x zone".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
_DIGITS = re.compile(r"\d+")


class _Node:
    __slots__ = ("tag", "path", "drop", "container", "text", "link", "own", "parent", "level", "top", "holder")

    def __init__(self, tag: str, path: str, drop: bool, container: bool, parent: "_Node | None"):
        self.tag, self.path, self.drop, self.container, self.parent = tag, path, drop, container, parent
        #: Characters inside, inside links, and outside links but in no container further in.
        self.text = self.link = self.own = 0
        self.level = parent.level + 1 if parent else 0
        #: The innermost container around.
        self.holder = self if container else parent.holder if parent is not None else None
        #: The outermost article or main element around.
        self.top = parent.top if parent is not None and parent.top is not None else self if tag in ("article", "main") else None


def _boilerplate(value: str, inside: bool) -> bool:
    """Whether a class or id token names boilerplate: of its words one is bad and none says more."""
    words = [w.lower() for w in _WORDS.findall(value)]
    bad = [w in _BAD or not inside and w in _OUTSIDE for w in words]
    return any(bad) and all(b or w in _NEUTRAL for b, w in zip(bad, words))


def _marks(attrs: str, inside: bool) -> tuple[str, bool]:
    """(generalised first class, whether the element is boilerplate by its attributes)."""
    first, bad = "", False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")
        if name == "class" and value.split():
            first = _DIGITS.sub("#", value.split()[0])
        if name in ("class", "id"):
            bad = bad or any(_boilerplate(x, inside) for x in value.split())
        elif name == "role":
            bad = bad or value.strip().lower() in _ROLES
        elif name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            bad = True
        elif name == "style":
            bad = bad or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
    return first, bad


def _step(path: str, tag: str, first: str) -> str:
    return hashlib.blake2b(f"{path}/{tag}.{first}".encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def blocks(page: str) -> Iterator[tuple[_Node, str, bool]]:
    """(element, text, whether inside a link) of each stretch of text, and (element, '', False) at every border of a block."""
    root = _Node("", "", False, False, None)
    stack, at, n = [root], 0, len(page)
    raw_end: dict[str, re.Pattern] = {}
    open_tags: dict[str, int] = {}

    def close(i: int) -> None:
        for x in stack[i:]:
            open_tags[x.tag] -= 1
        del stack[i:]

    def inside_a() -> bool:
        return open_tags.get("a", 0) > 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield stack[-1], html.unescape(page[at:lt]), inside_a()
        if lt == n:
            break
        m = _TAG.match(page, lt)
        if m is None and lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
            loose = _LOOSE.match(page, lt)
            if loose:
                end, name, attrs, at = loose[1], loose[2], loose[3], loose.end()
            elif page[lt + 1] == "/":
                stop = page.find(">", lt)
                at = n if stop < 0 else stop + 1
                continue
            else:
                yield stack[-1], "<", inside_a()
                at = lt + 1
                continue
        elif m is None:
            yield stack[-1], "<", inside_a()
            at = lt + 1
            continue
        else:
            at = m.end()
            if m["name"] is None:
                if m["data"]:
                    yield stack[-1], m["data"], inside_a()
                continue
            end, name, attrs = m["end"], m["name"], m["attrs"]
        tag = name.lower()
        if tag == "br":
            yield stack[-1], " ", False
            continue
        if end:
            if not open_tags.get(tag):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in _BLOCK:
                        yield stack[-1], "", False
                    close(i)
                    break
                if stack[i].container and tag not in _CONTAINER and tag not in _DROP and tag not in ("body", "html", "ul", "ol", "table", "header"):
                    break  # a stray end tag of a small element doesn't close a container
            continue
        if tag in _CLOSES_P and open_tags.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    yield stack[-1], "", False
                    close(i)
                    break
                if stack[i].tag in _BLOCK:
                    break
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",)}.get(tag, (tag,))
            for i in range(len(stack) - 1, 0, -1) if any(map(open_tags.get, same)) else ():
                if stack[i].tag in same:
                    yield stack[-1], "", False
                    close(i)
                    break
                if stack[i].tag in ("ul", "ol", "dl", "table", "select", "menu") or stack[i].container and stack[i].tag not in ("td",):
                    break
        top = stack[-1]
        if tag == "body" and top.tag == "head":
            close(len(stack) - 1)
            top = stack[-1]
        if tag in _BLOCK:
            yield top, "", False
        if tag in _VOID:
            continue
        first, bad = _marks(attrs, top.top is not None) if attrs else ("", False)
        container = tag in _CONTAINER
        drop = top.drop or tag in _DROP or bad and tag not in ("html", "body") or tag == "header" and top.top is None
        node = _Node(tag, _step(top.path, tag, first) if container or tag in _BLOCK else top.path, drop, container, top)
        if tag in _RAW:
            ending = raw_end.get(tag) or raw_end.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I))
            stop = ending.search(page, at)
            at = stop.end() if stop else n
            continue
        if attrs.endswith("/") and tag in ("svg", "math", "path", "use"):
            continue
        open_tags[tag] = open_tags.get(tag, 0) + 1
        stack.append(node)


Event = tuple[_Node, str, bool]


def best_path(events: list[Event]) -> str | None:
    """The path of the container that holds the main text of a page, given by its ``blocks``; None where no text counts."""
    nodes: dict[int, _Node] = {}
    for node, text, link in events:
        size = len(text.strip()) if text and not node.drop else 0
        if not size:
            continue
        node.text += size
        node.link += size * link
        up, fresh = node, True
        while up is not None and fresh:  # a node whose parents are known ends the walk
            fresh = id(up) not in nodes
            nodes[id(up)] = up
            up = up.parent
        if not link and node.holder is not None:
            node.holder.own += size
    by_level: list[list[_Node]] = []
    for node in nodes.values():
        while len(by_level) <= node.level:
            by_level.append([])
        by_level[node.level].append(node)
    for level in reversed(by_level[1:]):
        for node in level:
            node.parent.text += node.text
            node.parent.link += node.link
    containers = [x for level in by_level for x in level if x.container]
    most = max((x.text - x.link for x in containers), default=0)
    if most <= 0:
        return None
    best, rank = None, None
    for x in containers:
        value = (x.text - x.link) * (1.3 if x.tag in ("article", "main") else 1.0)
        if value >= 0.85 * most and (rank is None or (x.tag in ("article", "main"), x.level) > rank):
            best, rank = x, (x.tag in ("article", "main"), x.level)
    chosen, up = best, best
    while up is not None and up.tag not in ("body", "html") and (best.top is None or up.level >= best.top.level):
        if up.container and up.own > 0 and not up.drop:
            chosen = up
        up = up.parent
    return chosen.path


def _text_on(events: list[Event], path: str | None) -> tuple[str, bool]:
    """Text of the elements on a path (None: of the whole page), and whether there is any."""
    out: list[str] = []
    part: list[str] = []
    found = False
    inside: dict[int, bool] = {}

    def on(node: _Node | None) -> bool:
        trail = []
        while node is not None and id(node) not in inside:
            trail.append(node)
            if node.container and node.path == path:
                break
            node = node.parent
        hit = node is not None and inside.get(id(node), True)
        for x in trail:
            inside[id(x)] = hit
        return hit

    for node, text, _ in events:
        if not text:
            block = " ".join("".join(part).split())
            if block:
                out.append(block)
            part = []
        elif not node.drop and (path is None or on(node)):
            found = True
            part.append(text)
    block = " ".join("".join(part).split())
    if block:
        out.append(block)
    return "\n".join(out), found


def extract(page: str, path: str | None) -> str:
    """Text of the elements on path; of the best container where the page has none there, or of the whole page."""
    events = list(blocks(page))
    if path is not None:
        text, found = _text_on(events, path)
        if found:
            return text
    return _text_on(events, best_path(events))[0]


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), ASCII_UPPER, ASCII_LOWER), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], int] = {}
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
            path = best_path(list(blocks(page.as_py())))
            if path is not None:
                votes[host, path] = votes.get((host, path), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["host", "path", "votes"])


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): the path with most votes of each host, the smallest on ties."""
    votes = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(_vote, "host string, path string, votes long")
    return votes.groupBy("host", "path").agg(F.sum("votes").alias("votes")).groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), "path")).alias("path"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            texts = [extract(page.as_py(), path) for page, path in zip(part.column(2), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame, broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""
    paths = materialize(host_paths(pages), "host-paths")
    few = paths.limit(broadcast_hosts + 1).count() <= broadcast_hosts
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    joined = own.join(F.broadcast(paths) if few else paths, "host", "left").select("page_id", "url", "html", "path")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
