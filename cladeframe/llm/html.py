"""Main text of web pages: page structure, and what the pages of a host repeat.

A page is cut into blocks. Menus, headers, footers, sidebars, notices, adverts,
forms, comments and everything that is no text are left out by element, role
and class; a class on an element that wraps the page leaves out only what it
names inside. Where a page marks articles or a main part, only the blocks in
them are read on. What is left of a page is boilerplate where its host repeats it:

* a block of any length that many pages of the host hold word for word;
* a block that is mostly covered by byte strings of other pages of the host.
  The blocks of a page are one stream, whose suffixes are merge-sorted (see
  ``suffix``, with the host as scope, so a host with a third of all pages is
  spread over all parts).

Pages with equal blocks count once, so copies do not vouch against each other.
A page that others hold nearly whole is a copy with changes: what is held by
more pages than its body goes, the body stays. From a marked article only goes
what half of the host's pages repeat around its own text. A block repeated
inside its own page counts once.

Null and empty pages give an empty text, and so does a page without text.
Repeated pages give equal rows. Pages may be of any length and markup may be
broken off anywhere; time grows with the length alone, as end tags without a
partner are passed over.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm import suffix
from cladeframe.llm.common import prepare
from cladeframe.llm.urls import split_url
from cladeframe.session import cut, discard, scratch, sweep

# Elements of HTML and the words that sites use to name parts of a page.
RAW = "script|style|noscript|template|textarea|title|iframe|object|svg|math|canvas|audio|video|select|datalist"
BOILER_ELEMENTS = frozenset("nav header footer aside form button dialog menu fieldset label".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
BOILER_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar ad ads advert adverts advertisement "
    "advertising sponsor sponsored promo banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe "
    "signup login share sharing social related recommended comment comments disqus widget toolbar pagination pager search "
    "form copyright".split())
READER_WORDS = frozenset("comment comments disqus".split())
NEGATIONS = frozenset("no not has with without".split())
# In lines of text these words name a part only where the whole class consists of such words.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote".split())
OPEN_WORDS = frozenset("related header form menu search promo notice copyright social sharing share login signup comment".split())
HEADS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr input".split())
SHELL = frozenset("html body article main".split())
HOLDERS = frozenset("div article main section td th table ul ol dl blockquote body html figure details".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>{RAW})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"""|<(?P<end>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^'">])*+)>"""
    r"|<[!?/][^>]*(?:>|\Z)"
    r"|<[a-zA-Z][^>]*(?:>|\Z)", re.S | re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[a-z0-9]+")


def _names_boilerplate(name: str, value: str) -> tuple[bool, bool]:
    """(a class or id names a part that is left out, it names reader comments)."""
    found = readers = False
    for one in value.split():
        words = WORD.findall(one)
        if not words or words[0] in NEGATIONS:
            continue
        hit = BOILER_WORDS.intersection(words)
        if name in LINES and not len(hit) == len(set(words)) and hit <= OPEN_WORDS:
            continue
        found = found or bool(hit)
        readers = readers or bool(hit & READER_WORDS)
    return found, readers


def _kind(name: str, rest: str) -> int:
    """-2 for a part that is left out, -1 for one left out by its class unless it wraps the page, 1 for an article or main part, else 0."""
    if name in BOILER_ELEMENTS:
        return -1 if name == "form" else -2
    kind = int(name in ("article", "main"))
    if not rest or rest.isspace():
        return kind
    for key, value in ATTRIBUTE.findall(rest):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "itemprop" and value == "articlebody":
            return 1
        if key == "role":
            if value in BOILER_ROLES:
                return -1 if value == "form" else -2
            kind = max(kind, int(value in ("article", "main")))
        elif key in ("class", "id") and name not in SHELL:
            found, readers = _names_boilerplate(name, value)
            if found:
                return -2 if readers else -1
    return kind


def _parse(html: str) -> tuple[list[tuple[str, bool, bool, int, int]], list[tuple[int, bool]]]:
    """(text, is a heading, is in an article, region, letters outside links) of each block, and (region around, holds an article) of each region.

    A region is an outermost or nested part that its class leaves out; parts
    that are left out whatever they hold are not read at all.
    """
    out, regions = [], [(-1, False)]  # of a region: the one around it, whether an article begins in it
    stack: list[tuple[str, int, int]] = []  # name, kind with that of the elements around, region
    opened: Counter = Counter()
    holders: list[int] = []  # places in the stack that end the search for an open paragraph or item
    piece: list[str] = []
    kind, region, letters = 0, 0, 0

    def close():
        nonlocal letters
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            if text:
                head = any(s[0] in HEADS for s in stack[-3:])
                out.append((text, head, kind > 0, region, letters))
            piece.clear()
        letters = 0

    def cut_stack(i: int):
        for s in stack[i:]:
            opened[s[0]] -= 1
        del stack[i:]
        while holders and holders[-1] >= i:
            holders.pop()

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at and kind >= 0:
            piece.append(html[at:m.start()])
            letters += 0 if opened["a"] else m.start() - at
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            close()
        if name in VOID:
            continue
        if m["end"]:
            # An end tag without a partner is passed over, so every step back takes elements off the stack.
            if opened[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if (stack[i - 1][1:] if i else (0, 0)) != (kind, region):
                    close()
                cut_stack(i)
        else:
            # A paragraph or list item ends where the next block begins.
            if name not in INLINE:
                for i in reversed(holders):
                    if stack[i][0] == "p" or stack[i][0] == name == "li":
                        cut_stack(i)
                        break
                    if stack[i][0] in HOLDERS:
                        break
            around, inside = stack[-1][1:] if stack else (0, 0)
            own = _kind(name, m["rest"])
            if own != 0:
                close()
            if own == -1 and around >= 0:
                regions.append((inside, False))
                inside = len(regions) - 1
            if own == 1 and around >= 0:
                r = inside
                while r and not regions[r][1]:
                    regions[r] = (regions[r][0], True)
                    r = regions[r][0]
            if name == "p" or name == "li" or name in HOLDERS:
                holders.append(len(stack))
            stack.append((name, -2 if around < 0 or own == -2 else max(around, own), inside))
            opened[name] += 1
        kind, region = stack[-1][1:] if stack else (0, 0)
    if kind >= 0:
        piece.append(html[at:])
        letters += len(html) - at
        close()
    return out, regions


def article(html: str) -> tuple[list[tuple[str, bool]], bool]:
    """(text of each block in page order and whether it is a heading, whether the page marks its article).

    What a class names is left out. But where no article stands outside such
    parts, a part that holds an article, or most of the letters outside links,
    wraps the page: only what is named inside it goes.
    """
    out, regions = _parse(html)
    shut = set(range(1, len(regions)))
    if shut and not any(inside and not r for _, _, inside, r, _ in out):
        held = [0] * len(regions)
        for _, _, _, r, letters in out:
            held[r] += letters
        for r in range(len(regions) - 1, 0, -1):
            held[regions[r][0]] += held[r]
        for r in range(1, len(regions)):
            around, holds = regions[r]
            if around not in shut and (holds or 2 * held[r] > held[0]):
                shut.discard(r)
    left = [b for b in out if b[3] not in shut]
    marked = any(b[2] for b in left)
    return [(b[0], b[1]) for b in left if b[2] or not marked], marked


def blocks(html: str) -> tuple[list[str], bool]:
    """(text of each block in page order, whether the page marks its article)."""
    found, marked = article(html)
    return [text for text, _ in found], marked


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, text, marked, heads, ends, keys) of every page; ``heads`` are the places of headings
    among its blocks, ``ends`` the byte ends of these, ``keys`` their hashes."""
    def run(batches):
        for batch in batches:
            texts, marks, heads, ends, keys = [], [], [], [], []
            for page in batch.column(3):
                found, marked = article(page.as_py() or "")
                octets = [t.encode() for t, _ in found]
                texts.append(" ".join(t for t, _ in found))
                marks.append(marked)
                heads.append([i for i, (_, head) in enumerate(found) if head] if marked else [])
                ends.append((np.cumsum([len(o) + 1 for o in octets], dtype=np.int64) - 1))
                keys.append([_key(o) for o in octets])
            yield pa.RecordBatch.from_arrays([
                *batch.columns[:3], pa.array(texts, pa.string()), pa.array(marks, pa.bool_()), pa.array(heads, pa.list_(pa.int32())),
                pa.array(ends, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["page_id", "url", "host", "text", "marked", "heads", "ends", "keys"])

    split = split_url(pages.select("page_id", "url", "html")).select("page_id", "url", "host", "html")
    kinds = dict(pages.dtypes)
    return split.mapInArrow(
        run, f"page_id {kinds['page_id']}, url string, host string, text string, marked boolean, heads array<int>, ends array<long>, keys array<long>")


def _key(octets: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(octets, digest_size=8).digest(), "big", signed=True)


def _bounds(ends) -> list[tuple[int, int]]:
    return list(zip([0, *(e + 1 for e in ends[:-1])], ends))


def _stream(text: pa.Array, ends: pa.Array, keys: pa.Array) -> pa.Array:
    """Texts in which blocks that the page has had before are void, and as long."""
    out = []
    for t, e, k in zip(text, ends, keys):
        k = k.as_py()
        if len(set(k)) == len(k):
            out.append(t.as_py())
            continue
        octets, seen = bytearray(t.as_py().encode()), set()
        for key, (low, high) in zip(k, _bounds(e.as_py())):
            if key in seen:
                octets[low:high] = bytes(high - low)
            seen.add(key)
        out.append(octets.decode())
    return pa.array(out, pa.string())


def _merged(spans: pa.Array) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in suffix.joined(s.as_py())] for s in spans], spans.type)


def _covered_keys(text: pa.Array, ends: pa.Array, spans: pa.Array) -> pa.Array:
    """For each block that is covered to a half or more, the hash of what is covered, else null."""
    out = []
    for t, e, s in zip(text, ends, spans):
        octets, runs = t.as_py().encode(), suffix.joined(s.as_py())
        own = []
        for low, high in _bounds(e.as_py()):
            parts = [octets[max(a, low):min(b, high)] for a, b in runs if a < high and b > low]
            own.append(_key(b"\0".join(parts)) if 2 * sum(map(len, parts)) >= high - low else None)
        out.append(own)
    return pa.array(out, pa.list_(pa.int64()))


def around_article(heads: set[int], sizes: list[int], times: list[int], pages: int) -> list[int]:
    """The blocks that go from a marked article.

    Half of the host's pages, and three at least, must hold a block, and it must
    stand before or after all that the page has of its own. A heading goes with
    all blocks under it. Where more than half of the text would go, the page is a
    copy with changes and nothing goes.
    """
    every = range(len(sizes))
    common = [n >= 3 and 2 * n >= pages for n in times]
    body = [i for i in every if i not in heads and not common[i]]
    if not body:
        return []
    gone = [i for i in every if common[i] and not body[0] <= i <= body[-1]]
    lines, under, stays = set(gone) - heads, False, set()
    for i in reversed(every):
        if i in heads:
            if not under:
                stays.add(i)
            under = False
        else:
            under = i in lines and (under or i + 1 == len(sizes) or i + 1 in heads)
    gone = [i for i in gone if i not in stays]
    return gone if 2 * sum(sizes[i] for i in gone) <= sum(sizes) else []


def boilerplate(sizes: list[int], times: list[int], covered: list[bool], pages: int) -> list[int]:
    """The blocks that go from a page without a marked article.

    ``times`` says how many of the ``pages`` different pages of the host hold a
    block, or what is covered of it.
    """
    def common(n: int) -> bool:
        return n >= 3 and 10 * n >= pages or n >= 2 and 2 * n >= pages

    every, total = range(len(sizes)), sum(sizes)
    gone = {i for i in every if common(times[i])}
    if 10 * sum(sizes[i] for i in every if i not in gone) < total:
        # The body of a copy is held by the fewest pages.
        level, body = 0, 0
        for i in sorted(every, key=lambda i: times[i]):
            level, body = times[i], body + sizes[i]
            if 10 * body >= total:
                break
        above = {i for i in gone if times[i] > level}
        most = {i for i in gone if pages >= 5 and 2 * times[i] >= pages}
        gone = above if len(above | most) == len(sizes) else above | most
    rest = [i for i in every if i not in gone]
    if 10 * sum(sizes[i] for i in rest if covered[i]) < 9 * sum(sizes[i] for i in rest):
        gone.update(i for i in rest if covered[i])
    return sorted(gone)


def _judged(marked: pa.Array, heads: pa.Array, ends: pa.Array, keys: pa.Array, covered: pa.Array, times: pa.Array, pages: pa.Array) -> pa.Array:
    out = []
    for m, h, e, k, c, held, n in zip(marked, heads, ends, keys, covered, times, pages):
        k, known = k.as_py(), {x["key"]: x["times"] for x in held.as_py() or []}
        c = c.as_py() or [None] * len(k)
        sizes = [high - low for low, high in _bounds(e.as_py())]
        own = [max(known.get(a, 1), known.get(b, 1)) for a, b in zip(k, c)]
        out.append(around_article(set(h.as_py()), sizes, own, n.as_py()) if m.as_py()
                   else boilerplate(sizes, own, [b is not None for b in c], n.as_py()))
    return pa.array(out, pa.list_(pa.int32()))


def _without(text: pa.Array, ends: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for t, e, g in zip(text, ends, gone):
        g = set(g.as_py() or ())
        if not g:
            out.append(t.as_py())
            continue
        octets = t.as_py().encode()
        out.append(" ".join(octets[low:high].decode() for i, (low, high) in enumerate(_bounds(e.as_py())) if i not in g))
    return pa.array(out, pa.string())


def repeated_blocks(read: DataFrame, spans: DataFrame) -> DataFrame:
    """(U1, U2, gone) of the different pages that lose blocks; takes one row a page with its stream as ``text``."""
    ids = [suffix.U1, suffix.U2]
    slim = read.select(*ids, "scope", "marked", "heads", "ends", "keys")
    covered = cut(read.select(*ids, "text", "ends").join(spans, ids).select(
        *ids, F.arrow_udf(_covered_keys, "array<long>")("text", "ends", suffix.SPANS).alias("covered")))
    facts = cut(slim.join(covered, ids, "left"))
    held = facts.select(*ids, "scope", F.explode(F.array_distinct(F.concat(
        "keys", F.filter(F.coalesce("covered", F.array().cast("array<long>")), lambda x: x.isNotNull())))).alias("key"))
    times = cut(held.groupBy("scope", "key").agg(F.count("*").alias("times")).where("times > 1"))
    known = cut(held.join(times, ["scope", "key"]).groupBy(*ids).agg(F.collect_list(F.struct("key", "times")).alias("times")))
    hosts = facts.groupBy("scope").agg(F.count("*").alias("pages"))
    judged = facts.join(known, ids, "left").join(hosts, "scope").select(
        *ids, F.arrow_udf(_judged, "array<int>")("marked", "heads", "ends", "keys", "covered", "times", "pages").alias("gone"))
    gone = cut(judged.where("size(gone) > 0"))
    discard(covered, facts, times, known)
    return gone


def main_text(pages: DataFrame, window: int = 200) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    prepare(pages.sparkSession)
    # The one table with all texts is most of what this query keeps on disk.
    read = cut(suffix.identified(parsed(pages), "host").withColumns(
        {"scope": F.xxhash64("host"), "serial": F.monotonically_increasing_id()}), compression="zstd")
    same = read.groupBy(suffix.U1, suffix.U2).agg(F.min("serial").alias("first"), F.count("*").alias("n")).where("n > 1")
    # Of equal pages only the first takes part.
    copies = cut(read.select(suffix.U1, suffix.U2, "serial").join(same, [suffix.U1, suffix.U2]).where("serial > first").select("serial"))
    once = read.where(F.col("text") != "").join(copies, "serial", "left_anti").withColumn("text", F.arrow_udf(_stream, "string")("text", "ends", "keys"))
    size = read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    with scratch("op2_html"):
        spans = suffix.repeated_spans(once, window, size)
        # Windows overlap; merged, what a page has covered is small enough to go to its text.
        spans = cut(spans.withColumn(suffix.SPANS, F.arrow_udf(_merged, spans.schema[suffix.SPANS].dataType)(suffix.SPANS)))
    sweep(pages.sparkSession, "op2_html", spans)
    gone = repeated_blocks(once, spans)
    discard(copies)
    text = F.arrow_udf(_without, "string")("text", "ends", "gone")
    return read.join(gone, [suffix.U1, suffix.U2], "left").select("page_id", "url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long"))
