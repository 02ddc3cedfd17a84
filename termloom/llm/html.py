"""Text of web pages without the parts that a site repeats.

A page is parsed into a tree of elements; each subtree with text gets a hash of its tag, attributes, text and children.
Spark counts, for each host, on how many different pages a hash occurs. Subtrees that occur on many are the site's
template; of each page the largest of them are deleted and the text of the rest is returned. A recurring subtree of
``KEEP_WORDS`` or more words outside links may be content that the site shows in several frames, such as an article under
different navigation: it stays, with all it holds, on one of its pages.

Parsing takes time linear in a page's size. Pages are parsed twice and never shuffled with their hashes: the templates of
a host, a small table, go to the pages. It is broadcast up to ``BROADCAST`` bytes; else pages are joined to it by host,
where AQE splits a host of many pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, cut, doc_id

#: Bytes of template hashes up to which they are broadcast.
BROADCAST = 64 << 20
#: Words outside links from which a recurring subtree stays on one page.
KEEP_WORDS = 10

_NAME = re.compile(r"(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
#: A tag without angle brackets in its quotes; what it reads ends at the next bracket, so that trying it everywhere takes linear time.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"<>]*+"|'[^'<>]*+')*+)>""")
_EDGE = re.compile("[>\"']")
_RAW = {n: re.compile(rf"</{n}\b", re.I) for n in ("script", "style", "textarea", "title")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
_HIDDEN = frozenset(["head", "script", "style", "template", "noscript", "title"])
_WHOLE = frozenset(["html", "body", "head"])
#: An opening tag closes an open element of these, if none of the barriers lies between.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BARRIER = frozenset("ul ol dl table html body div article section nav select td th".split())
_SPACE = re.compile(r"\s+")


class _Tags:
    """Tags of a source, found in time linear in its length."""

    def __init__(self, source: str):
        self.source = source
        self._none: set[str] = set()  # characters that don't come again
        self._lost: set[int] = set()  # places outside quotes from which no tag ends

    def find(self, what: str, at: int) -> int:
        if what in self._none:
            return -1
        k = self.source.find(what, at)
        if k < 0:
            self._none.add(what)
        return k

    def _end(self, at: int) -> int:
        """The next '>' outside quotes, or -1."""
        seen = []
        while at not in self._lost:
            seen.append(at)
            m = _EDGE.search(self.source, at) if "edge" not in self._none else None
            if m is None:
                self._none.add("edge")
                break
            if m[0] == ">":
                return m.start()
            at = self.find(m[0], m.end()) + 1
            if not at:
                break
        self._lost.update(seen)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str, bool] | None:
        """(begin, end, name, attributes, whether it closes) of the next tag; no name for a comment or declaration."""
        s = self.source
        while (begin := self.find("<", at)) >= 0:
            if m := _PLAIN.match(s, begin):
                return begin, m.end(), m[2].lower(), m[3], bool(m[1])
            if s.startswith("<!--", begin):
                stop = self.find("-->", begin + 4)
                return begin, len(s) if stop < 0 else stop + 3, "", "", False
            if s[begin + 1 : begin + 2] in ("!", "?"):
                stop = self.find(">", begin + 2)
                return begin, len(s) if stop < 0 else stop + 1, "", "", False
            if m := _NAME.match(s, begin + 1):
                stop = self._end(m.end())
                if stop < 0:  # a quote is never closed: the first '>' of any kind
                    stop = self.find(">", m.end())
                if stop >= 0:
                    return begin, stop + 1, m[2].lower(), s[m.end() : stop], bool(m[1])
            at = begin + 1
        return None


class Page:
    """``nodes``: (first event, end event, hash, tag, words outside links) of the subtrees that have text, in order of closing; ``events``: pieces of visible text, None for a line break."""

    def __init__(self, source: str):
        self.events: list[str | None] = []
        self.nodes: list[tuple[int, int, int, str, int]] = []
        self._open: list[list] = [["", 0, [], False, 0]]  # name, first event, parts to hash, whether there is text, words outside links
        self._places: dict[str, list[int]] = {}  # of the open elements of a name
        self._hidden = self._links = 0
        tags, at = _Tags(source), 0
        while tag := tags.next(at):
            begin, end, name, attrs, closes = tag
            if begin > at:
                self._text(source[at:begin])
            at = end
            if not name:
                continue
            if closes:
                self._end(name)
                continue
            self._start(name, attrs)
            if name in _RAW:
                stop = _RAW[name].search(source, at)
                edge = source.find(">", stop.end()) if stop else -1
                self._text(source[at : stop.start() if edge >= 0 else len(source)])
                at = edge + 1 if edge >= 0 else len(source)
                self._close()
            elif name in _VOID or attrs.endswith("/"):
                self._close()
        if at < len(source):
            self._text(source[at:])
        while len(self._open) > 1:
            self._close()
        self.root = _digest(self._open[0][2])

    def _text(self, text: str) -> None:
        plain = _SPACE.sub(" ", text)
        top = self._open[-1]
        if plain.strip():
            top[3] = True
        elif not top[2]:
            return
        top[2].append(plain.encode("utf-8", "surrogatepass"))
        if not self._hidden:
            self.events.append(plain)
            if not self._links:
                top[4] += len(plain.split())

    def _start(self, name: str, attrs: str) -> None:
        if name in _BLOCK:
            closes = _CLOSES.get(name, ("p",) if name != "br" else ())
            last = max((p[-1] for n in closes if (p := self._places.get(n))), default=0)
            if last and not any(p[-1] > last for n in _BARRIER if n not in closes and (p := self._places.get(n))):
                while len(self._open) > last:
                    self._close()
            self.events.append(None)
        self._places.setdefault(name, []).append(len(self._open))
        self._open.append([name, len(self.events), [name.encode(), _SPACE.sub(" ", attrs.strip(" \t\r\n/")).encode("utf-8", "surrogatepass")], False, 0])
        self._hidden += name in _HIDDEN
        self._links += name == "a"

    def _end(self, name: str) -> None:
        if places := self._places.get(name):
            last = places[-1]
            while len(self._open) > last:
                self._close()

    def _close(self) -> None:
        name, first, hashed, text, n = self._open.pop()
        self._places[name].pop()
        self._hidden -= name in _HIDDEN
        self._links -= name == "a"
        h = _digest(hashed)
        if text and name not in _WHOLE and name not in _HIDDEN and not self._hidden:
            self.nodes.append((first, len(self.events), int.from_bytes(h, "little", signed=True), name, n))
        if name in _BLOCK:
            self.events.append(None)
        top = self._open[-1]
        top[2].append(h)
        top[3] |= text
        top[4] += n

    def text(self, template: frozenset | set, kept: frozenset | set = frozenset()) -> tuple[str, int]:
        return rendered(self.events, self.nodes, template, kept)


def rendered(events: list, nodes: list, template: frozenset | set, kept: frozenset | set = frozenset()) -> tuple[str, int]:
    """Text without the subtrees whose hash is in ``template``, and how many of them, the largest only, were deleted. Those in ``kept`` stay with all they hold."""
    gone, keep = 0, events
    if template:
        spans = sorted((n[0], -n[1], n[2] not in kept) for n in nodes if n[2] in template)
        keep, at, whole = [], 0, 0
        for begin, end, goes in spans:
            if begin < max(at, whole) or -end == begin:  # inside the one before
                continue
            if not goes:
                whole = -end
                continue
            keep += [*events[at:begin], None]
            at = -end
            gone += 1
        keep += events[at:]
    lines = "".join("\n" if x is None else x for x in keep).split("\n")
    lines = [x for x in (_SPACE.sub(" ", entities.unescape(x)).strip() for x in lines) if x]
    return "\n".join(lines), gone


def _digest(hashed: list[bytes]) -> bytes:
    h = hashlib.blake2b(digest_size=8)
    for x in hashed:
        h.update(len(x).to_bytes(4, "little"))
        h.update(x)
    return h.digest()


def _subtrees(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for host, source in zip(f["_host"], f["_html"]):
            page = Page(source)
            out.append((host, int.from_bytes(page.root, "little", signed=True), list({n[2] for n in page.nodes}), list({n[2] for n in page.nodes if n[4] >= KEEP_WORDS})))
        yield pd.DataFrame(out, columns=["_host", "_root", "_hashes", "_long"])


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets: dict[str, tuple[frozenset, dict[int, set]]] = {}
    for f in frames:
        out = []
        for i, host, source, hashes, long, roots in zip(f["_i"], f["_host"], f["_html"], f["_hashes"], f["_long"], f["_roots"]):
            if hashes is None:
                template, stay = frozenset(), {}
            else:
                if host not in sets:
                    if len(sets) > 100:
                        sets.clear()
                    sets[host] = frozenset(hashes.tolist()), {}
                    for h, r in zip(long.tolist(), roots.tolist()):
                        sets[host][1].setdefault(r, set()).add(h)
                template, stay = sets[host]
            if source is None:
                text, gone = None, 0
            else:
                page = Page(source)
                text, gone = page.text(template, stay.get(int.from_bytes(page.root, "little", signed=True), frozenset()))
            out.append((i, host, text, gone))
        yield pd.DataFrame(out, columns=["_i", "host", "text", "n_removed"])


def extract(pages: DataFrame, min_pages: int = 3, min_share: float = 0.01, broadcast: int = BROADCAST) -> DataFrame:
    """(page_id, host, text, n_removed) for each row of ``pages`` (page_id, url, html).

    A subtree is template when it occurs on at least ``min_pages`` different pages of the host and on ``min_share`` of
    them. Pages of a host with the same elements and text are one page, so that copies don't make each other a
    template. A template of ``KEEP_WORDS`` or more words outside links stays on the page of least hash among those that have
    it, so no such text is lost to a host whole; shorter ones go everywhere. ``n_removed``: deleted subtrees, not counting those inside another. A page's lines are its blocks; what a
    browser doesn't show is left out. A page whose url is null or has no host is extracted whole, with a null host. A
    null html gives a null text, an empty one ''. A page of any length or nesting takes time in proportion to its length. A
    null page_id stays null; repeated rows are each extracted. An empty table gives no rows. Further columns are not read.
    ``broadcast``: see ``BROADCAST``; it changes no row.
    """
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    own = pages.select(F.coalesce(F.col("page_id").cast("bigint"), F.lit(NO_ID)).alias("_i"), F.when(host != "", host).alias("_host"), F.col("html").cast("string").alias("_html"))
    seen = own.filter("_host is not null and _html is not null").select("_host", "_html").mapInPandas(_subtrees, "_host string, _root bigint, _hashes array<bigint>, _long array<bigint>")
    seen = cut(seen.dropDuplicates(["_host", "_root"]))
    hosts = seen.groupBy("_host").agg(F.count("*").alias("_pages"))
    often = seen.select("_host", F.explode("_hashes").alias("_hash")).groupBy("_host", "_hash").count().filter(F.col("count") >= min_pages)
    often = often.join(hosts, "_host").filter(F.col("count") >= F.col("_pages") * min_share)
    often = cut(often.select("_host", "_hash"))
    long = seen.select("_host", "_root", F.explode("_long").alias("_hash")).join(often, ["_host", "_hash"]).groupBy("_host", "_hash").agg(F.min("_root").alias("_root"))
    often = often.join(long, ["_host", "_hash"], "left")
    kept = F.when(F.col("_root").isNotNull(), F.struct("_hash", "_root"))
    templates = often.groupBy("_host").agg(F.collect_list("_hash").alias("_hashes"), F.collect_list(kept).alias("_kept"))
    templates = cut(templates.select("_host", "_hashes", F.col("_kept._hash").alias("_long"), F.col("_kept._root").alias("_roots")))
    small = (templates.agg(F.sum(8 * F.size("_hashes") + 16 * F.size("_long") + 64)).first()[0] or 0) <= broadcast
    out = own.join(F.broadcast(templates) if small else templates, "_host", "left").select("_i", "_host", "_html", "_hashes", "_long", "_roots")
    out = out.mapInPandas(_extracted, "_i bigint, host string, text string, n_removed int")
    return out.select(doc_id("_i").alias("page_id"), "host", "text", "n_removed")
