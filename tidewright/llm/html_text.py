"""Main text of web pages: structure first, then a suffix array over the token streams of each host.

The markup is read once, without building a tree. Regions that are menus, headers, footers, sidebars, notices, adverts,
forms or reader comments by element, role, class or id are left out. Of a page with an article (or a main element) what is left
is the main text; any other page is undecided, and all its blocks stay. The token streams of all pages then go through suffix
arrays ordered to the depth of RUN tokens, which give the runs of that length and the distinct pages of each. Their counts are
summed over the whole host, and of an undecided page the tokens that a run on PAGES or more distinct pages covers are removed
as boilerplate. Pages of a host with equal blocks are one page.

An article keeps its lines, also those that other pages have (a story of two pages, a quotation, a licence): nothing in them
tells that they are no part of it.

Pages are dealt to groups of about GROUP_PAGES by a digest of host and blocks, so equal pages meet and a host of any size is
worked on by many tasks. Runs meet in ranges of their fingerprints, in two passes. The first one sends 32 bits of each run
beyond its range, with its pages, and learns which may be repeated; the second one sends 128 bits of those alone. The pages of
the runs that are then repeated go back to the groups that have them. A range holds RANGE_GROUPS groups' runs, whatever the
input, so the share of runs that the first pass takes for repeated by chance does not grow.

Copies of one page of which there are more than a group holds (by a digest of host and html) are dealt to several groups; the
copies of one of these groups count for the page (about GROUP_PAGES copies; none with probability e^-GROUP_PAGES).

Defined cases: a null or empty html gives an empty text; a null url has the empty host; repeated rows are pages of their
own; nothing is cut, whatever its length. White space is what Unicode calls so, no-break spaces included; a br is white
space inside its block.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm import kernels
from tidewright.llm.kernels import U64, mix
from tidewright.llm.url_filter import split_url

#: Tokens of a repeated run, distinct pages of a host that make it boilerplate, pages of a group, groups to a range of
#: fingerprints, and least ranges.
RUN, PAGES, GROUP_PAGES, RANGE_GROUPS, RANGES = 8, 2, 512, 16, 12
#: A page has copies in several groups from more than a group's pages on, and from this part of all pages: so at most as many
#: pages as its inverse have, and the table of them can be sent to every executor.
HOT_SHARE = 1e-4
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)>",
    re.S,
)
#: Elements whose content is no text of the page: scripts, styles, fields of forms, the page's title, markup not shown.
_RAW = {"script", "style", "title", "textarea", "template", "iframe", "select", "noembed"}
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl",
    "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head",
    "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_LEFT_OUT = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar"}
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "overlay", "popup", "promo", "promoted", "related", "respond", "share",
    "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: Parts that a class or id of a region to leave out may have besides its name (site-footer, post-share).
_NEUTRAL = {
    "area", "article", "bar", "block", "blog", "bottom", "box", "button", "buttons", "container", "entry", "global", "inner", "item",
    "items", "left", "link", "links", "list", "main", "outer", "page", "post", "primary", "right", "secondary", "section", "site",
    "slot", "story", "top", "unit", "wrap", "wrapper",
}
#: An article inside a region of such a name is a reader's comment, a teaser or an advert.
_NO_STORY = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "disqus", "promo", "promoted",
    "related", "respond", "sponsor", "sponsored",
}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An article that begins inside one of these shows that the region was never closed.
_CLOSED_BY_ARTICLE = {"nav", "header", "form", "menu", "button"}
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
MAIN, OPEN, WRAPPER = 1, 0, -2
#: Kinds of blocks in main text: of an article, of another main region, of one that a region to leave out wraps.
ARTICLE, OTHER, WRAPPED = 3, 2, 1


def _left_out(value: str) -> set[str]:
    """The names of regions to leave out that whole classes (or an id) give; has-sidebar or elementor-widget give none."""
    found = set()
    for token in value.lower().strip("\"'").split():
        words = set(_WORD.findall(token))
        if words & _NAMES and words <= _NAMES | _NEUTRAL:
            found |= words & _NAMES
    return found


def _region(name: str, attributes: str) -> int:
    """-1: left out, -2: left out, but for an article in it, 1: begins the main text, 0: neither."""
    if name in ("article", "main"):
        return MAIN
    kind = -1 if name in _LEFT_OUT else OPEN
    if attributes:
        for key, value in _ATTRIBUTE.findall(attributes):
            key, words = key.lower(), set(_WORD.findall(value.lower()))
            if key == "role":
                kind = -1 if words & _ROLES else MAIN if "main" in words else kind
            elif key in ("class", "id") and name not in ("body", "html") and (names := _left_out(value)):
                return WRAPPER if name not in _LEFT_OUT and not names & _NO_STORY else -1
            elif key == "itemprop" and "articlebody" in words:
                kind = MAIN
    return kind


def read_blocks(page: str) -> tuple[list[str], bool]:
    """The blocks of text in page order and whether they are the page's main text (else they are undecided).

    Main text is that of the articles, with the rest of the main regions if it is longer (an article may be a teaser); where
    these give no text, that of the articles in wrappers named like a region to leave out.
    """
    blocks: list[tuple[int, str]] = []
    piece: list[str] = []
    left_out, depth = "", 0  # the element of the region left out, and how many of its name are open in it
    wrapper, wrapped = False, ["", 0]  # whether that region may hold an article, and the open wrapper of one
    mains: list[list] = []  # [name, open elements of that name, kind] of each enclosing main region
    decided = False
    at = 0

    def close() -> None:
        if piece:
            text = " ".join(entities.unescape("".join(piece)).split())
            piece.clear()
            if text:
                blocks.append((max((m[2] for m in mains), default=OPEN), text))

    heading = False
    while True:
        tag = _TAG.search(page, at)
        if tag is None:
            break
        if tag.start() > at and (not left_out or heading):
            piece.append(page[at : tag.start()])
        at, name = tag.end(), tag[2]
        if name is None:
            continue
        name, closing = name.lower(), tag[1] == "/"
        if name in _RAW:
            if not closing and not tag[3].endswith("/"):
                end = _RAW_END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in _BLOCK:
            close()
        elif name == "br":
            piece.append(" ") if not left_out or heading else None
            continue
        if left_out:
            if left_out == "header" and mains and name in _HEADINGS:
                heading = not closing
            if (
                not closing
                and name in ("article", "main")
                and (left_out in _CLOSED_BY_ARTICLE and not mains or wrapper and all(m[2] != ARTICLE for m in mains))
            ):
                wrapped = [left_out, depth]
                left_out, heading = "", False
            elif name == left_out:
                depth += -1 if closing else name not in _VOID
                if depth <= 0:
                    close()
                    left_out, heading = "", False
                continue
            else:
                continue
        if name == wrapped[0]:
            wrapped[1] += -1 if closing else 1
            if wrapped[1] <= 0:
                wrapped = ["", 0]
        if closing:
            for k in range(len(mains) - 1, -1, -1):
                if mains[k][0] == name:
                    mains[k][1] -= 1
                    if mains[k][1] <= 0:
                        del mains[k:]
                    break
            continue
        if name in _VOID:
            continue
        kind = _region(name, tag[3])
        if kind < 0:
            close()
            left_out, depth, heading, wrapper = name, 1, False, kind == WRAPPER
        elif kind == MAIN and not any(m[0] == name for m in mains):
            within = max((m[2] for m in mains), default=WRAPPED)
            mains.append([name, 1, within if wrapped[0] else ARTICLE if name == "article" else OTHER])
            decided = True
        else:
            for m in mains:
                if m[0] == name:
                    m[1] += 1
    if at < len(page) and not left_out:
        piece.append(page[at:])
    close()
    if not decided:
        return [text for _, text in blocks], False
    length = [sum(len(text) for kind, text in blocks if kind == k) for k in range(ARTICLE + 1)]
    least = ARTICLE if length[ARTICLE] and length[ARTICLE] >= length[OTHER] else OTHER if length[OTHER] else WRAPPED
    return [text for kind, text in blocks if kind >= least], True


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Streams:
    """The token streams of some pages in a row: words and line ends (one after each block), and what runs begin at each.

    hosts: a number for each page; runs of different hosts are never equal, and no run reaches over two pages.
    """

    def __init__(self, texts: pa.Array, hosts: list[str]):
        seed = np.array([_hash(h) for h in hosts], U64)
        parts = []
        for lo, _, data, at in kernels.blocks(texts):
            words = kernels.Words(data, at, lower=False)
            lines = np.flatnonzero(data == 10)
            begin = np.concatenate([words.begin, lines])
            order = np.argsort(begin, kind="stable")
            begin = begin[order]
            page = np.searchsorted(at, begin, "right") - 1
            ends = np.concatenate([words.end, lines + 1])[order]
            hashes = np.concatenate([words.hash, np.full(len(lines), 10, U64)])[order]
            parts.append((begin - at[page], ends - at[page], hashes, page + lo))
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))
        self.begin, self.end, self.token, self.page = (np.concatenate(c) for c in zip(*parts)) if parts else none
        self.edges = np.searchsorted(self.page, np.arange(len(hosts) + 1))
        self.seed = seed[self.page] if len(self.page) else np.zeros(0, U64)

    def whole(self, run: int = RUN) -> np.ndarray:
        """Where a run begins that ends on the same page."""
        return np.flatnonzero(np.arange(len(self.page)) + run <= self.edges[self.page + 1])

    def ranks(self, run: int = RUN) -> np.ndarray:
        """The rank of the run at each position (shorter at the end of a page): the suffix array by prefix doubling, to that depth."""
        n, stop = len(self.page), self.edges[self.page + 1]
        rank, depth = np.unique(mix(self.token ^ self.seed), return_inverse=True)[1], 1
        while depth < run:
            step = min(depth, run - depth)
            at = np.arange(n) + step
            following = np.where(at < stop, rank[np.minimum(at, n - 1)], -1)
            rank = np.unique(rank * (n + 1) + following + 1, return_inverse=True)[1]
            depth += step
        return rank

    def prints(self, begin: np.ndarray, salt: int = 0) -> np.ndarray:
        """64 bits for each run that begins there: a hash of its tokens and of the host."""
        total = mix(self.seed[begin] + U64(salt))
        for k in range(RUN):
            total = mix(total * U64(0x9E3779B97F4A7C15) + self.token[begin + k])
        return total


def _pages_of(rank: np.ndarray, page: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """On how many of the pages that count each rank is."""
    order = np.lexsort((page, rank))
    first = np.ones(len(order), bool)
    first[1:] = (rank[order][1:] != rank[order][:-1]) | (page[order][1:] != page[order][:-1])
    return np.bincount(rank[order], weights=first & counts[page[order]]).astype(np.uint32)


def _cover(begins: np.ndarray, run: int) -> np.ndarray:
    """Which tokens the runs cover that begin where begins is true."""
    marks = np.zeros(len(begins) + run, np.int64)
    marks[: len(begins)] += begins
    marks[run:] -= begins
    return np.cumsum(marks)[: len(begins)] > 0


def covered(texts: list[str], run: int = RUN, pages: int = PAGES) -> list[np.ndarray]:
    """For the tokens of each page of one host, which a run of so many tokens covers that is on so many of these pages."""
    streams = Streams(pa.array(texts, pa.string()), [""] * len(texts))
    rank, begins = streams.ranks(run), np.zeros(len(streams.page), bool)
    whole = streams.whole(run)
    begins[whole] = (_pages_of(rank, streams.page, np.ones(len(texts), bool)) >= pages)[rank[whole]]
    return np.split(_cover(begins, run), streams.edges[1:-1])


def _ranges(prints: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each fingerprint: the upper half of its product with the number of ranges."""
    low = (prints & U64(0xFFFFFFFF)) * U64(ranges) >> U64(32)
    return ((prints >> U64(32)) * U64(ranges) + low >> U64(32)).astype(np.int64)


def _within(prints: np.ndarray, ranges: int) -> np.ndarray:
    """32 bits of a fingerprint beyond its range, ascending inside a range."""
    return (prints * U64(ranges) >> U64(32)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Numbers, their bytes gathered by place, compressed; small ones take little room."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return kernels.packed(raw)


def _numbers(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(kernels.unpacked(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _distinct(pages: pa.Table) -> tuple[Streams, np.ndarray]:
    """The streams of the distinct pages of a group, and which of them count here."""
    seen: dict[tuple[str, bytes], bool] = {}
    for host, text, counts in zip(*(pages[c].to_pylist() for c in ("host", "text", "counts"))):
        seen[host, text] = seen.get((host, text), False) or counts
    return Streams(pa.array([kernels.unpacked(t) for _, t in seen], pa.binary()), [h for h, _ in seen]), np.array(list(seen.values()), bool)


def _messages(spans: list[int], parts: list[int], runs: list[bytes], pages: list[bytes]) -> pa.Table:
    return pa.table({"span": pa.array(spans, pa.int64()), "part": pa.array(parts, pa.int64()), "runs": pa.array(runs, pa.binary()), "pages": pa.array(pages, pa.binary())})


_MESSAGE = "span long, part long, runs binary, pages binary"


def _cuts(found: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """The ranges that have some of these ascending fingerprints, and where."""
    span = _ranges(found, ranges)
    edges = np.flatnonzero(np.diff(span, prepend=-1, append=ranges))
    return [(int(span[a]), slice(a, b)) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]


def _group_runs(ranges: int):
    """To each range, 32 bits of every distinct run of the group and its pages here."""

    def group_runs(pages: pa.Table) -> pa.Table:
        streams, counts = _distinct(pages)
        rank, whole = streams.ranks(), streams.whole()
        on = _pages_of(rank, streams.page, counts)
        one = np.zeros(len(on), np.int64) - 1
        one[rank[whole]] = whole
        has = np.flatnonzero(one >= 0)
        found, where = np.unique(streams.prints(one[has]), return_inverse=True)
        on = np.bincount(where, weights=on[has], minlength=len(found)).astype(np.uint32)
        low, cuts, part = _within(found, ranges), _cuts(found, ranges), pages["part"][0].as_py()
        return _messages([k for k, _ in cuts], [part] * len(cuts), [_planes(np.diff(low[c], prepend=np.uint32(0))) for _, c in cuts], [_planes(on[c]) for _, c in cuts])

    return group_runs


def _may_repeat(rows: pa.Table) -> pa.Table:
    """To each group, which of its runs in this range may be on PAGES or more pages, as bits in its order."""
    each = [np.cumsum(_numbers(x.as_py(), "<u4"), dtype=np.uint32) for x in rows["runs"]]
    where = np.unique(np.concatenate(each), return_inverse=True)[1]
    often = np.bincount(where, weights=np.concatenate([_numbers(x.as_py(), "<u4") for x in rows["pages"]])) >= PAGES
    bits = np.split(often[where], np.cumsum([len(x) for x in each])[:-1])
    kept = [(s, p, kernels.packed(np.packbits(b).tobytes()), b"") for s, p, b in zip(rows["span"].to_pylist(), rows["part"].to_pylist(), bits) if b.any()]
    return _messages(*map(list, zip(*kept))) if kept else _messages([], [], [], [])


def _candidates(ranges: int):
    """To each range, 128 bits of the runs that may be repeated and their pages in this group."""

    def candidates(pages: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(replies) or not len(pages):
            return _messages([], [], [], [])
        streams, counts = _distinct(pages)
        whole = streams.whole()
        prints = streams.prints(whole)
        found, where = np.unique(prints, return_inverse=True)
        cuts, wanted = dict(_cuts(found, ranges)), np.zeros(len(found), bool)
        for span, bits in zip(replies["span"].to_pylist(), replies["runs"].to_pylist()):
            c = cuts[span]
            wanted[c] = np.unpackbits(np.frombuffer(kernels.unpacked(bits), np.uint8), count=c.stop - c.start)
        takes = wanted[where]
        begin, place = whole[takes], where[takes]
        both = np.stack([found[place], streams.prints(begin, 1)], axis=1)
        runs, where = np.unique(both, axis=0, return_inverse=True)
        on = _pages_of(where.ravel(), streams.page[begin], counts)
        part = pages["part"][0].as_py()
        out = _cuts(np.ascontiguousarray(runs[:, 0]), ranges)
        return _messages([k for k, _ in out], [part] * len(out), [runs[c].tobytes() for _, c in out], [_planes(on[c]) for _, c in out])

    return candidates


def _repeated(rows: pa.Table) -> pa.Table:
    """To each group, those of its runs in this range that are on PAGES or more pages of all groups."""
    each = [np.frombuffer(x.as_py(), U64).reshape(-1, 2) for x in rows["runs"]]
    every = np.concatenate(each)
    order = np.lexsort((every[:, 1], every[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (every[order][1:] != every[order][:-1]).any(axis=1)
    where = np.empty(len(order), np.int64)
    where[order] = np.cumsum(new) - 1
    totals = np.bincount(where, weights=np.concatenate([_numbers(x.as_py(), "<u4") for x in rows["pages"]])).astype(np.uint32)[where]
    kept, at = [], 0
    for span, part, own in zip(rows["span"].to_pylist(), rows["part"].to_pylist(), each):
        total = totals[at : at + len(own)]
        at += len(own)
        often = total >= PAGES
        if often.any():
            kept.append((span, part, own[often, 0].tobytes(), b""))
    return _messages(*map(list, zip(*kept))) if kept else _messages([], [], [], [])


def _without(raw: bytes, repeated: np.ndarray, begin: np.ndarray, end: np.ndarray) -> str:
    """The text of a page without the tokens of repeated runs, which begin at the marked tokens."""
    kept, block = [], []
    for gone, a, b in zip(_cover(repeated, RUN).tolist(), begin.tolist(), end.tolist()):
        if raw[a] == 10:
            if block:
                kept.append(b" ".join(block))
            block = []
        elif not gone:
            block.append(raw[a:b])
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


def _texts(pages: pa.Table, often: pa.Table) -> pa.Table:
    raw, decided = [kernels.unpacked(t) for t in pages["text"].to_pylist()], pages["decided"].to_pylist()
    streams = Streams(pa.array(raw, pa.binary()), pages["host"].to_pylist())
    on = np.zeros(len(streams.page), bool)
    if len(often):
        repeated, whole = np.unique(np.frombuffer(b"".join(often["runs"].to_pylist()), U64)), streams.whole()
        prints = streams.prints(whole)
        on[whole] = repeated[np.minimum(np.searchsorted(repeated, prints), len(repeated) - 1)] == prints
    texts = []
    for k, (a, b) in enumerate(zip(streams.edges[:-1].tolist(), streams.edges[1:].tolist())):
        if not decided[k] and on[a:b].any():
            texts.append(_without(raw[k], on[a:b], streams.begin[a:b], streams.end[a:b]))
        else:
            texts.append(raw[k][:-1].decode("utf-8", "surrogatepass"))
    return pa.table({"page_id": pages["page_id"], "url": pages["url"], "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def _parse(groups: int):
    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_PAGES):
                piece = batch.slice(at, GROUP_PAGES)
                rows = []
                for host, html, salt in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), piece.column(4).to_pylist()):
                    blocks, decided = read_blocks(html or "")
                    text = "".join(f"{b}\n" for b in blocks)
                    rows.append((host, kernels.packed(text.encode("utf-8", "surrogatepass")), decided, salt == 0, (_hash(f"{host}\n{text}") + salt) % groups))
                kinds = (pa.string(), pa.binary(), pa.bool_(), pa.bool_(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:2], *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=["page_id", "url", "host", "text", "decided", "counts", "part"]
                )

    return parse


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), split_url(F.col(url))[0].alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    n_pages = pages.count()
    groups = max(1, -(-n_pages // GROUP_PAGES))
    ranges = max(RANGES, -(-groups // RANGE_GROUPS))
    digest = F.xxhash64("host", "html")
    hot = rows.groupBy(digest.alias("_digest")).count().filter(F.col("count") > max(GROUP_PAGES, int(n_pages * HOT_SHARE)))
    hot = F.broadcast(hot.select("_digest", F.ceil(F.col("count") / GROUP_PAGES).alias("_groups")))
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_groups", F.lit(1)))
    dealt = rows.withColumn("_digest", digest).join(hot, "_digest", "left").select("page_id", "url", "host", "html", salt.cast("long").alias("salt"))
    parsed = dealt.mapInArrow(_parse(groups), "page_id long, url string, host string, text binary, decided boolean, counts boolean, part long")
    counted = parsed.groupBy("part").applyInArrow(_group_runs(ranges), _MESSAGE)
    maybe = counted.groupBy("span").applyInArrow(_may_repeat, _MESSAGE)
    asked = parsed.groupBy("part").cogroup(maybe.groupBy("part")).applyInArrow(_candidates(ranges), _MESSAGE)
    often = asked.groupBy("span").applyInArrow(_repeated, _MESSAGE)
    return parsed.groupBy("part").cogroup(often.groupBy("part")).applyInArrow(_texts, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
