"""Main text of HTML pages: structure first, and where a page has none, a host's suffix array of repeated passages.

A page whose markup names its article (`article`, `main` or such a role) is read from there, since article text that
other pages repeat is still main text. On a page without one, the open blocks (those in no menu, header, footer and
so on) of all such pages of a host are laid end to end as token streams; a suffix array over them finds the passages
that stand on two or more pages, and tokens under such passages are boilerplate. What is left are a page's unique runs.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm._common import materialise

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_OUT = {"nav", "header", "footer", "aside", "form", "menu", "head", "button", "select", "dialog", "object", "applet", "canvas", "audio", "video", "map", "search"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog", "status", "toolbar"}
_OUT_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advert(?:isement|ising)|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|sidebar|side-bar|breadcrumbs?|footer|header|masthead|cookies?|consent|gdpr|notices?|notification|popup|modal|newsletter|subscribe|signup|share|sharing|social|comments?|commentlist|respond|replies|disqus|related|recommended|pagination|pager|skip-link|toolbar|widget)(?=$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: These close an open element of the same group, as browsers do; else unclosed blocks would nest without end.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

MIN_TOKENS, HOST_TOKENS = 8, 2_000_000


def _kind(tag: str, attributes: str, inside: bool) -> str:
    """`out`, `main` or `` for an element; a header within the article is part of it."""
    a = {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    role = a.get("role", "").lower()
    if "hidden" in a or a.get("aria-hidden") == "true" or _HIDDEN.search(a.get("style", "")):
        return "out"
    if tag in ("article", "main") or role in ("main", "article"):
        return "out" if _OUT_NAMES.search(f"{a.get('class', '')} {a.get('id', '')}") and inside else "main"
    if role in _OUT_ROLES or (tag in _OUT and not (tag == "header" and inside)):
        return "out"
    if tag not in ("html", "body", "h1", "h2", "h3", "h4", "h5", "h6") and _OUT_NAMES.search(f"{a.get('class', '')} {a.get('id', '')}"):
        return "out"
    return ""


def blocks(page: str | None) -> list[tuple[bool, str]]:
    """(in the article?, text) of each block that no excluded element holds, in page order.

    Character references are decoded, white space inside a block is one space. Any input gives a result: unclosed
    elements and comments end with the page.
    """
    out: list[tuple[bool, str]] = []
    stack: list[tuple[str, str]] = []
    count: dict[str, int] = {}  # open elements by tag, so that no search runs for what is not open
    parts: list[str] = []
    excluded = article = at = 0

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((article > 0, text))
            parts.clear()

    def pop() -> None:
        nonlocal excluded, article
        tag, kind = stack[-1]
        if tag in _BLOCK or kind:
            flush()
        stack.pop()
        count[tag] -= 1
        excluded -= kind == "out"
        article -= kind == "main"

    page = page or ""
    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text_end = m.start() if m else n
        if text_end > at and not excluded:
            parts.append(page[at:text_end])
        if not m:
            break
        at = m.end()
        if m[1] is not None and not excluded:
            parts.append(html.escape(m[1]))
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if tag in _BLOCK:
                flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None) if count.get(tag) else None
            # An end tag never reaches past an element that sets the zone, unless it is that element's own.
            if depth is not None and (tag in _OUT or tag in ("article", "main", "div", "section", "body", "html") or not any(k for _, k in stack[depth + 1 :])):
                while len(stack) > depth:
                    pop()
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else n
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID or m[4].rstrip().endswith("/") and tag not in _BLOCK:
            continue
        for i in range(len(stack) - 1, -1, -1) if any(count.get(t) for t in _CLOSES.get(tag, ())) else ():
            if stack[i][0] in _CLOSES[tag]:
                while len(stack) > i:
                    pop()
                break
            if stack[i][1] or stack[i][0] in ("div", "section", "ul", "ol", "dl", "table", "blockquote", "td", "li"):
                break
        kind = _kind(tag, m[4], article > 0)
        if kind:
            flush()
        stack.append((tag, kind))
        count[tag] = count.get(tag, 0) + 1
        excluded += kind == "out"
        article += kind == "main"
    flush()
    return out


def suffix_array(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, length of the common prefix of each with the one before it) by prefix doubling."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    order, k = np.argsort(rank, kind="stable"), 1
    while k < n and n > 1:
        second = np.full(n, -1, np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum((rank[order[1:]] != rank[order[:-1]]) | (second[order[1:]] != second[order[:-1]]))
        rank = new
        if rank[order[-1]] == n - 1:
            break
        k *= 2
    lcp, values, position, h = np.zeros(n, np.int64), tokens.tolist(), np.argsort(order).tolist(), 0
    o = order.tolist()
    for i in range(n):  # Kasai
        if position[i]:
            j = o[position[i] - 1]
            while i + h < n and j + h < n and values[i + h] == values[j + h]:
                h += 1
            lcp[position[i]] = h
            h = max(0, h - 1)
        else:
            h = 0
    return order, lcp


def covered(streams: list[list[str]], least: int = MIN_TOKENS) -> list[np.ndarray]:
    """For each page's tokens, which of them lie in a passage of ``least`` tokens or more that another page has too."""
    ids: dict[str, int] = {}
    flat = [i for k, s in enumerate(streams) for i in [*(ids.setdefault(t, len(ids)) for t in s), -1 - k]]
    tokens = np.array(flat, np.int64)
    page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
    marked = np.zeros(len(tokens) + 1, np.int64)
    if len(tokens):
        order, lcp = suffix_array(tokens)
        run = np.cumsum(lcp < least)  # suffixes that share their first ``least`` tokens stand side by side
        of = page[order]
        low, high = np.full(run[-1] + 1, len(streams)), np.full(run[-1] + 1, -1)
        np.minimum.at(low, run, of)
        np.maximum.at(high, run, of)
        starts = order[(low < high)[run]]
        np.add.at(marked, starts, 1)
        np.add.at(marked, starts + least, -1)
    flags = np.cumsum(marked)[:-1] > 0
    return np.split(flags, np.cumsum([len(s) + 1 for s in streams])[:-1]) if streams else []


_PARSED = "page_id long, url string, host string, whole boolean, text string, n_tokens long"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, whole (is the text final?), text, n_tokens of every row.

    With an article, text is its blocks joined by a space. Without, text is the open blocks, to be held against the
    host's other pages of that kind.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, texts = [], []
            for page in batch.column(3).to_pylist():
                found = blocks(page)
                main = [t for inside, t in found if inside]
                whole.append(bool(main))
                texts.append(" ".join(main or [t for _, t in found]))
            counts = pa.array([t.count(" ") + 1 if t else 0 for t in texts], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(whole), pa.array(texts, pa.string()), counts], ["page_id", "url", "host", "whole", "text", "n_tokens"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][-+.a-zA-Z0-9]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long"), "url", host.alias("host"), "html").mapInArrow(run, _PARSED)


def unique_runs(open_pages: DataFrame, least: int = MIN_TOKENS, host_tokens: int = HOST_TOKENS) -> DataFrame:
    """page_id, url, text: what stands on no other page of the host in a passage of ``least`` tokens.

    Hosts of up to ``host_tokens`` tokens get one suffix array each. On a larger host the same coverage is found from
    hashes of all passages of exactly ``least`` tokens, counted by key over the cluster: a token lies in a longer
    repeated passage if and only if it lies in a repeated passage of that length. No host is collected, none is cut.
    On both paths pages of a host with one text, repeated rows or mirrors, count as one page and keep the same text.
    """
    keyed = open_pages.select("page_id", "url", "host", "text", "n_tokens").withColumn("row", F.xxhash64("host", "text"))
    large = keyed.groupBy("host").agg(F.sum("n_tokens").alias("tokens")).where(F.col("tokens") > host_tokens).select("host")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        streams = {text: text.split(" ") if text else [] for text in rows.text}
        flags = covered(list(streams.values()), least)
        left = {text: " ".join(t for t, c in zip(s, f, strict=False) if not c) for (text, s), f in zip(streams.items(), flags, strict=True)}
        return rows[["page_id", "url"]].assign(text=[left[text] for text in rows.text])

    out = keyed.join(large, "host", "left_anti").groupBy("host").applyInPandas(run, "page_id long, url string, text string")
    big = keyed.join(large, "host", "left_semi").withColumn("tokens", F.split("text", " "))
    windows = big.select("host", "row", F.posexplode(F.expr(f"if(size(tokens) < {least}, array(), transform(sequence(1, size(tokens) - {least - 1}), i -> xxhash64(host, slice(tokens, i, {least}))))")).alias("at", "hash"))
    repeated = windows.groupBy("hash").agg(F.min("row").alias("a"), F.max("row").alias("b")).where("a <> b").select("hash")
    hits = windows.join(repeated, "hash", "left_semi").groupBy("row").agg(F.sort_array(F.collect_set("at")).alias("hits"))
    hits = hits.withColumn("hits", F.expr(f"aggregate(hits, cast(array() as array<struct<a:int,b:int>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).b >= x, concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', x + {least}))), concat(acc, array(named_struct('a', x, 'b', x + {least})))))"))
    left = big.join(hits, "row", "left")
    text = F.expr("if(hits is null, text, array_join(filter(tokens, (t, i) -> not exists(hits, h -> h.a <= i and i < h.b)), ' '))")
    return out.unionByName(left.select("page_id", "url", text.alias("text")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row.

    Null and empty html, and pages all of whose text is excluded, give an empty text. Null urls share the host ``""``.
    Repeated rows stay; pages of a host with the same text count once, so copies do not erase each other.
    An empty table gives an empty result.
    """
    read = materialise(parsed(pages), "page-text")
    final = read.where("whole or n_tokens = 0").select("page_id", "url", "text")
    out = final.unionByName(unique_runs(read.where("not whole and n_tokens > 0")))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
