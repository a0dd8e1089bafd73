"""Main text of web pages: a suffix array over each host's pages finds what repeats, markup tells where it stands."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import lean, release
from .common import written

#: Words of a repeat at least, and distinct pages of a host that must hold it.
LEAST_WORDS, LEAST_PAGES = 8, 3
#: Inside an article a block goes if it stands in over this share of the host's distinct articles, and in so many at least.
ARTICLE_SHARE, ARTICLE_PAGES = 0.5, 5
#: Bytes of html and pages of a host that one task takes, about; results don't depend on them. Rows that are broadcast at most.
GROUP_BYTES, GROUP_PAGES, BROADCAST_ROWS = 4 << 20, 256, 100_000

# Fixed values of HTML and of common page templates.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "noembed", "noframes", "textarea", "title", "xmp", "svg", "math"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "option", "datalist", "dialog", "menu", "object", "applet", "canvas", "audio", "video", "map", "fieldset"}
MAIN = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "select", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul", "video", "audio", "canvas", "button",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
NOISE = {
    "ad", "adbox", "ads", "adslot", "adunit", "advert", "advertorial", "alert", "aside", "adverts", "advertisement", "advertisements", "advertising", "adsense", "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pagination", "paywall", "popup", "promo",
    "promotion", "rail", "related", "recommended", "reply", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "teasers", "toolbar", "topbar", "widget", "widgets",
}

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Before one of these a name says that the page has or lacks a part, not that the element is it.
HAVING = {"has", "no", "with", "without"}
#: Names of reader comments, which never hold the article.
TALK = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
OPEN, IN_MAIN, OUT = 0, 1, 2


def noise(tag: str, attributes: str) -> set[str]:
    """What tells that an element is no part of an article, by its attributes: words of its class or id, or its state."""
    if not attributes or tag in ("html", "body"):
        return set()
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or found.get("role", "").lower() in ROLES:
        return {"hidden"}
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return {"hidden"}
    out = set()
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = [p.lower() for p in NAME_PARTS.findall(name)]
        out |= {p for p, before in zip(parts, ["", *parts], strict=False) if p in NOISE and before not in HAVING}
    return out


def blocks(page: str) -> list[tuple[str, int]]:
    """_blocks(); if those have no article and articles that stand in elements which are OUT hold more text than all that is
    open, such an element is a wrapper around the page or was left open, and they count."""
    found = _blocks(page)
    if found and all(s != IN_MAIN for _, s in found) and re.search(r"<(?:article|main)\b", page, re.IGNORECASE):
        again = _blocks(page, anywhere=True)
        size = lambda bs, state: sum(len(t) for t, s in bs if s == state)
        if size(again, IN_MAIN) > size(found, OPEN):
            return again
    return found


def _blocks(page: str, anywhere: bool = False) -> list[tuple[str, int]]:
    """(text, state) of the non-empty blocks of a page in their order: OPEN, IN_MAIN (in an article or main element) or
    OUT (in an element that is no part of an article). Character references are decoded and white space is one blank.
    Elements that are left open end with those around them; an article ends no earlier than its own tag says."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int, bool, bool]] = []  # tag, state, is it a header (whose headings an article keeps), is it of comments
    state, at = OPEN, 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, state))
            parts.clear()

    for m in iter(lambda: MARKUP.search(page, at), None):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            inner = place is not None and tag not in MAIN and tag not in ("body", "html") and any(t in MAIN for t, *_ in stack[place + 1 :])
            if tag in BLOCK:
                flush()
            if place is not None and not inner:
                if any(s != state for _, s, *_ in stack[place:]) or (stack[place - 1][1] if place else OPEN) != state:
                    flush()
                del stack[place:]
                state = stack[-1][1] if stack else OPEN
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "math"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if stack and tag in BLOCK and stack[-1][0] == "p" and tag != "p":
            stack.pop()
        if tag in ("p", "li", "dt", "dd", "td", "th", "tr", "option") and any(t == tag for t, *_ in stack[-3:]):
            place = max(i for i, x in enumerate(stack) if x[0] == tag)
            if not any(t in ("ul", "ol", "dl", "table") or t in MAIN for t, *_ in stack[place + 1 :]):
                del stack[place:]
                state = stack[-1][1] if stack else OPEN
        new, why = state, noise(tag, m[3])
        if tag == "body":
            new = OPEN
        elif anywhere and tag in MAIN and not why and not any(talk for *_, talk in stack):
            new = IN_MAIN
        elif state == OUT:
            new = IN_MAIN if tag in HEADINGS and any(s == IN_MAIN for _, s, *_ in stack) and all(h for _, s, h, _ in stack if s == OUT) else OUT
        elif tag in DROPPED or why:
            new = OUT
        elif tag in MAIN:
            new = IN_MAIN
        if new != state:
            flush()
        state = new
        stack.append((tag, state, tag == "header" and not why or why == {"header"}, bool(why & TALK)))
    parts.append(page[at:])
    flush()
    return out


# ---- repeats --------------------------------------------------------------------------------------------------------
def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """The rank of the suffix at each place among all suffixes by their first depth numbers (equal ones alike), by prefix
    doubling; text holds small numbers. What lies beyond the end is less than all numbers."""
    n = len(text)
    rank, done = text.astype(np.int64), 1
    while done < depth:
        step = min(done, depth - done)
        second = np.zeros(n, np.int64)
        second[: max(n - step, 0)] = rank[step:] + 1
        rank, done = np.unique(rank * (int(second.max(initial=0)) + 1) + second, return_inverse=True)[1].astype(np.int64), done + step
    return rank


def word_hashes(words: pa.Array) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words.to_pylist()), np.uint64, len(words))


class Host:
    """Pages of a host, or a group of them: the words outside of the articles, concatenated, with the suffix array's classes
    of equal windows of least_words; and the articles' blocks, each a word of its own.

    pages: per page its article's blocks, and (text, state) of what stands outside of it; single says which page is to be
    counted, pages of one key being one. Keys default to the article's blocks, or else to what stands outside of them."""

    def __init__(self, inside: list[list[str]], outside: list[list[tuple[str, int]]], least_words: int = LEAST_WORDS, keys: list | None = None, single: list[bool] | None = None):
        keys = [tuple(i) or tuple(o) for i, o in zip(inside, outside, strict=True)] if keys is None else keys
        self.inside, self.outside, self.least_words = inside, outside, least_words
        seen: set = set()
        self.counted = np.zeros(len(keys), bool)
        for i, (k, ok) in enumerate(zip(keys, single or [True] * len(keys), strict=True)):
            if ok and k not in seen:
                seen.add(k)
                self.counted[i] = True
        words = pc.split_pattern(pa.array([" ".join(t for t, _ in o) for o in outside], pa.string()), " ")
        coded = words.flatten().dictionary_encode()
        sizes = np.diff(words.offsets.to_numpy())
        self.ends = np.cumsum(sizes + 1) - 1  # each page is closed by a number of its own
        n = int(self.ends[-1]) + 1 if len(sizes) else 0
        text, self.page = np.empty(n, np.int64), np.repeat(np.arange(len(sizes)), sizes + 1)
        own = np.ones(n, bool)
        own[self.ends] = False
        text[own], text[~own] = coded.indices.to_numpy(), len(coded.dictionary) + np.arange(len(sizes))
        self.rank = suffix_ranks(text, least_words) if n else text
        left = self.ends[self.page] - np.arange(n)
        self.starts = np.flatnonzero(left >= least_words)  # a window with a page's end in it is that page's alone
        with np.errstate(over="ignore"):
            h = np.append(word_hashes(coded.dictionary), np.zeros(len(sizes), np.uint64))[text]
            window = np.zeros(max(n - least_words + 1, 0), np.uint64)
            for j in range(least_words):
                window = window * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(window)]
        kinds, first = np.unique(self.rank[self.starts], return_index=True)
        self.kinds, self.hashes = kinds, window[self.starts[first]].view(np.int64)
        self.blocks = pa.array([b for i in inside for b in i], pa.string()).dictionary_encode()
        self.block_page = np.repeat(np.arange(len(inside)), [len(i) for i in inside])
        long = pc.greater_equal(pc.add(pc.count_substring(self.blocks.dictionary, " "), 1), least_words).to_numpy(zero_copy_only=False)
        self.long, self.block_hashes = np.flatnonzero(long), word_hashes(self.blocks.dictionary.filter(pa.array(long))).view(np.int64)

    def counts(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Distinct counted pages of each window (as .hashes), of each long block (as .block_hashes), and of articles."""
        per = lambda what, page, n: np.bincount(np.unique(np.column_stack([what, page])[self.counted[page]], axis=0)[:, 0], minlength=n)
        windows = per(np.searchsorted(self.kinds, self.rank[self.starts]), self.page[self.starts], len(self.kinds)) if len(self.starts) else np.zeros(0, np.int64)
        every = per(self.blocks.indices.to_numpy().astype(np.int64), self.block_page, len(self.blocks.dictionary)) if len(self.blocks) else np.zeros(0, np.int64)
        return windows, every[self.long], int((self.counted & np.array([bool(i) for i in self.inside], bool)).sum())

    def texts(self, windows: np.ndarray, blocks: np.ndarray, articles: int, least_pages: int = LEAST_PAGES) -> list[tuple[str, int]]:
        """(main text, words that repeats cover) of each page by the counts that hold for the whole host.

        A page with an article has its blocks, but for those of least_words and more that stand in over ARTICLE_SHARE of the
        host's articles: what repeats more seldom is quoted or copied, not a template. Another page has the words of its open
        blocks that no window covers which stands in least_pages pages."""
        n = len(self.rank)
        edge = np.zeros(n + 1, np.int64)
        if len(self.starts):
            at = self.starts[windows[np.searchsorted(self.kinds, self.rank[self.starts])] >= least_pages]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + self.least_words, -1)
        covered = np.cumsum(edge[:-1]) > 0
        gone = set(self.long[(blocks >= ARTICLE_PAGES) & (blocks > ARTICLE_SHARE * articles)].tolist())
        code, at, out, start = self.blocks.indices.to_pylist(), 0, [], 0
        for inside, outside, end in zip(self.inside, self.outside, self.ends.tolist(), strict=True):
            hit = covered[start:end]
            if inside:
                kept = [b for b, c in zip(inside, code[at : at + len(inside)], strict=True) if c not in gone]
                out.append((" ".join(kept), int(hit.sum()) + sum(b.count(" ") + 1 for b, c in zip(inside, code[at : at + len(inside)], strict=True) if c in gone)))
            else:
                kept, place = [], 0
                for text, state in outside:
                    words = text.split(" ")
                    if state == OPEN:
                        kept += [w for w, h in zip(words, hit[place : place + len(words)], strict=True) if not h]
                    place += len(words)
                out.append((" ".join(kept), int(hit.sum())))
            at, start = at + len(inside), end + 1
        return out


def main_texts(pages: list[list[tuple[str, int]]], least_words: int = LEAST_WORDS, least_pages: int = LEAST_PAGES) -> list[tuple[str, int]]:
    """Host.texts() of all pages of a host, given their blocks()."""
    host = Host([[t for t, s in p if s == IN_MAIN] for p in pages], [_merged(p) for p in pages], least_words)
    return host.texts(*host.counts(), least_pages)


# ---- on Spark -------------------------------------------------------------------------------------------------------
def host(url: Column) -> Column:
    """The host of a URL in lower case, without www; empty for null or odd URLs."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))


PARSED = "host string, part int, parts int, id long, url string, first string, key long, inside array<string>, texts array<string>, states array<int>"


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_words: int = LEAST_WORDS, least_pages: int = LEAST_PAGES, group_pages: int = GROUP_PAGES, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(id_col, url_col, text, n_chars: code points, n_repeated: words that repeats of the host cover) of each row.

    A host's pages are dealt into groups of bounded bytes and rows by the hash of their ids, so no host needs to fit into a
    task. Each group's suffix array counts the distinct pages of its windows and blocks; for a host of several groups the
    counts are summed over them before they decide, and of pages with one article (or, without, one text) a single one is
    counted, wherever it lies. So the texts are those of the host's pages at once, whatever the sizes of groups. Texts are
    shuffled once; the hashes of what stands outside of articles, and of articles' blocks, once more for the large hosts.

    Null html is an empty page; null URLs are a host; repeated rows give a row each (as one page to the count); an empty
    table gives none; further columns are ignored."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("host", host(F.col("url")))
    parts = F.greatest(F.ceil(F.sum(F.octet_length("html")) / group_bytes), F.ceil(F.count("*") / group_pages)).cast("int")
    large = written(rows.groupBy("host").agg(parts.alias("parts")).where("parts > 1"), "hosts")
    n_large = large.count()
    large = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
    name = F.concat_ws(" ", F.coalesce(F.col("id").cast("string"), F.lit("")), "url")
    dealt = rows.join(large, "host", "left").select("host", F.pmod(F.xxhash64("id", "url"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.coalesce("parts", F.lit(1)).alias("parts"), "id", "url", F.lit(None).cast("string").alias("first"), "html")
    parsed = dealt.mapInArrow(lean(_parse), PARSED)
    if n_large:
        keys = dealt.where("parts > 1").mapInArrow(lean(_keys), "host string, id long, url string, key long")
        firsts = written(keys.groupBy("host", "key").agg(F.min(name).alias("first"), F.count("*").alias("n")).where("n > 1").select("host", "key", "first"), "page-keys")
        firsts = F.broadcast(firsts) if firsts.count() <= BROADCAST_ROWS else firsts
        parsed = parsed.drop("first").join(firsts, ["host", "key"], "left")
    groups = parsed.select("host", "part", "parts", "id", "url", F.col("first").isNull() | (F.col("first") == name), "key", "inside", "texts", "states").toDF("host", "part", "parts", "id", "url", "single", "key", "inside", "texts", "states").groupBy("host", "part")
    schema = pa.schema([(id_col, pa.int64()), (url_col, pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_repeated", pa.int64())])
    ddl = f"`{id_col}` long, `{url_col}` string, text string, n_chars long, n_repeated long"
    counts = pa.schema([("host", pa.string()), ("part", pa.int32()), ("kind", pa.int32()), ("h", pa.int64()), ("n", pa.int64())])

    def loaded(group: pa.Table) -> Host:
        outside = [list(zip(t, s, strict=True)) for t, s in zip(group.column("texts").to_pylist(), group.column("states").to_pylist(), strict=True)]
        return Host(group.column("inside").to_pylist(), outside, least_words, group.column("key").to_pylist(), group.column("single").to_pylist())

    def counted(key: tuple, group: pa.Table) -> pa.Table:
        if group.column("parts")[0].as_py() == 1:
            return counts.empty_table()
        own = loaded(group)
        windows, blocks, articles = own.counts()
        kind, h, n = np.repeat([0, 1, 2], [len(windows), len(blocks), 1]), np.concatenate([own.hashes, own.block_hashes, [0]]), np.concatenate([windows, blocks, [articles]])
        release()
        return pa.Table.from_arrays([pa.array([k.as_py()] * len(n), t) for k, t in zip(key, counts.types, strict=False)] + [pa.array(kind, pa.int32()), pa.array(h, pa.int64()), pa.array(n, pa.int64())], schema=counts)

    def finished(group: pa.Table, total: pa.Table | None) -> pa.Table:
        own = loaded(group)
        windows, blocks, articles = own.counts()
        if total is not None and len(total):
            kind, h, n = (total.column(c).to_numpy() for c in ("kind", "h", "n"))
            look = lambda k, mine: np.array(list(map(dict(zip(h[kind == k].tolist(), n[kind == k].tolist(), strict=True)).get, mine.tolist(), [0] * len(mine))), np.int64)
            windows, blocks, articles = look(0, own.hashes), look(1, own.block_hashes), int(n[kind == 2].sum())
        got = own.texts(windows, blocks, articles, least_pages)
        release()
        return pa.Table.from_arrays([group.column("id"), group.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([len(t) for t, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())], schema=schema)

    if not n_large:
        return groups.applyInArrow(lambda group: finished(group, None), ddl)
    found = groups.applyInArrow(counted, "host string, part int, kind int, h long, n long")
    # a window's rows are one a group at most
    total = found.withColumn("n", F.sum("n").over(Window.partitionBy("host", "kind", "h"))).where((F.col("kind") == 2) | (F.col("kind") == 0) & (F.col("n") >= least_pages) | (F.col("kind") == 1) & (F.col("n") >= ARTICLE_PAGES))
    return groups.cogroup(total.groupBy("host", "part")).applyInArrow(lambda group, total: finished(group, total) if len(group) else schema.empty_table(), ddl)


def _key(inside: list[str], outside: list[tuple[str, int]]) -> int:
    """A 64-bit hash of a page's article or, if it has none, of its other text."""
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest("\0".join(["a", *inside] if inside else ["b", *(f"{s}{t}" for t, s in outside)]))
    return h - (h >> 63 << 64)


def _read(page: str) -> tuple[list[str], list[tuple[str, int]]]:
    found = blocks(page)
    return [t for t, s in found if s == IN_MAIN], _merged(found)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), 256):
            piece = b.slice(at, 256)
            inside, outside = zip(*map(_read, piece.column(6).to_pylist()), strict=True)
            texts, states = ([[x[i] for x in o] for o in outside] for i in (0, 1))
            arrays = [*piece.columns[:6], pa.array(map(_key, inside, outside), pa.int64()), pa.array(inside, pa.list_(pa.string())), pa.array(texts, pa.list_(pa.string())), pa.array(states, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["host", "part", "parts", "id", "url", "first", "key", "inside", "texts", "states"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = [_key(*_read(x)) for x in b.column(6).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), pa.array(keys, pa.int64())], names=["host", "id", "url", "key"])


def _merged(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """What stands outside of the article, neighbouring blocks of one state joined by a blank."""
    out: list[tuple[list[str], int]] = []
    for text, state in found:
        if state == IN_MAIN:
            continue
        if out and out[-1][1] == state:
            out[-1][0].append(text)
        else:
            out.append(([text], state))
    return [(" ".join(t), s) for t, s in out]
