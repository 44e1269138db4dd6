"""HTML extraction by site template removal.

Method. Every element's subtree (tag, texts, children) is hashed; Spark counts on how many pages of a host each hash stands,
and subtrees that recur on `min_pages` pages or more are that host's template: they are deleted from its pages. They must also stand on
a share of the host's pages: on `around` of them for subtrees outside of a page's main part, where hosts rotate what they show, and on
`share` inside it, or where a page has none, so that a phrase which several articles have stays. Pages of the same text count once (so copies of an article, or a row stored many times,
do not make a template), inline elements, items and cells only go with what holds them, and a subtree that holds more than half of a page's
text is never deleted, nor is a part of it.

A second rule takes what counts cannot know (a host of few pages, an advert that changes from page to page): elements that are no
article by their kind are deleted anywhere: scripts, styles, navigation, asides, forms, footers, and elements whose class, id or
role names an advert, notice, menu, share bar or comments. A whole name always counts; a word within a name (`site-footer`) only outside
the main part, and not for an element that holds the main part or more than half of the page's text. `html` and `body` are never
deleted. If a page has a main part (`article` or `main`, in no deleted element), only what stands inside it is text; else the whole body is.

Text. Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by one
space. Nothing else is dropped or cut. Unclosed and misnested elements are closed as browsers do in the common cases; elements
deeper than `DEPTH` levels belong to the one at that depth, as in browsers. A tag that no `>` ends is text. A page is read in one
pass, whose time is in proportion to its length, however broken it is.

Size. A page is scanned twice: to hash, whose hashes are written to the shared folder, and to extract. Only (host, hash) keys are shuffled for the counts, once a page and
summed before the shuffle; the flagged hashes of a page, bounded by its own elements, come back to it by a SHA-256 of its row.

Cases. Null or empty html gives empty text and no subtree. Pages with a null or odd url share the host ''. Repeated rows count
once and are extracted each. An empty table gives no rows. Other columns are not read."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import checkpointed, digest as row_digest, ship

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
QUOTED = re.compile(r"""\"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of HTML: elements without content, of raw text, that end a paragraph, and that are blocks of their own.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
INLINE_SAFE = BLOCKS - {"br", "option"}

# What is never article text, by kind and by the words of class, id and role.
DROPPED = frozenset("head script style noscript template iframe nav aside form footer button select textarea dialog svg canvas object audio video menu".split())
NAMED = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup"
    " sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination footer share sharing social related recommended comment comments commentlist disqus discussion replies respond login search toolbar"
    " complementary contentinfo search dialog alertdialog".split()
)
MAIN = frozenset(["article", "main"])
ROOTS = frozenset(["html", "body"])
DEPTH = 512  # as deep as browsers go
PAGE = -1  # stands for the page itself among the hashes, which are not negative


#: The words of compound names that count inside a main part, too.
INNER = frozenset("comment comments commentlist disqus replies respond advert advertisement adsense sponsor sponsored nav navbar navigation menu sidebar breadcrumb breadcrumbs pagination newsletter cookie cookies consent footer".split())

STRONG, WEAK, WITHIN, AROUND = range(1, 5)


def _named(attributes: str, inside: bool) -> int:
    """STRONG if the element is hidden; WEAK if its class, id or role is or has a name of no article, or a word of such a name."""
    said = 0
    for m in ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        if name == "hidden":
            return STRONG
        if m[2] and name in ("class", "id", "role"):
            value = m[2].strip("\"'").lower()
            if not NAMED.isdisjoint(value.split()) or not (INNER if inside else NAMED).isdisjoint(re.split(r"[^a-z0-9]+", value)):
                said = WEAK
    return said


def _tokens(page: str):
    """(start, end, name, closing, attributes) of each tag; name None for comments and declarations."""
    at, n = 0, len(page)
    last = page.rfind(">")
    dead: list[tuple[int, list[int], list[int]]] = []  # scans that found no end: where they began, and where their quotes open and close

    def hopeless(start):
        # outside of the quotes of a scan that found no end, another finds none
        return any(start >= s and ((k := bisect_right(opens, start) - 1) < 0 or start >= closes[k]) for s, opens, closes in dead)

    while True:
        start = page.find("<", at)
        if start < 0 or start > last and not page.startswith("<!--", start):
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            end = n if end < 0 else end + 3
            at = yield start, end, None, False, ""
        elif page.startswith(("<!", "<?"), start):
            at = yield start, page.index(">", start) + 1, None, False, ""
        elif m := NAME.match(page, start):
            rest = None if hopeless(m.end()) else REST.match(page, m.end())
            if not rest and not hopeless(m.end()):
                quotes = [q.span() for q in QUOTED.finditer(page, m.end())]
                dead.append((m.end(), [s for s, _ in quotes], [e for _, e in quotes]))
            # a quote that nothing closes: the tag ends at the next `>`
            end = rest.end() if rest else page.index(">", m.end()) + 1
            at = yield start, end, m[1].lower(), page[start + 1] == "/", page[m.end() : end - 1]
        else:
            at = start + 1


def scan(page: str, template=frozenset(), around=frozenset(), deleted: list | None = None) -> tuple[str, list[int], list[int]]:
    """The page's text without the template's subtrees, and the hashes of the subtrees that a template may hold: those in a main part (or of
    a page without one), and those around it. template, around: the hashes to delete in either place. deleted: gets (whether by the
    template, characters) of each deletion that takes text, in page order, the outer of nested ones."""
    # a frame: tag, whether inside a main part, how it is named, parts for the hash, where its text begins, the place of the nearest block or paragraph
    frames: list[list] = [["", False, 0, [], 0, 0]]
    open_: dict[str, int] = {}
    out: list[str] = []
    main: list[tuple[int, int]] = []
    cuts: list[tuple[int, int, int]] = []  # (start, end, STRONG, WEAK, or whose template: WITHIN, AROUND)
    hashes: tuple[list[int], list[int]] = [], []
    digest = xxhash.xxh64_intdigest

    def close():
        tag, inside, named, parts, start, _ = frames.pop()
        open_[tag] -= 1
        h = digest("\x1f".join([tag, *parts])) >> 1
        frames[-1][3].append(str(h))
        if tag not in MAIN and tag not in ROOTS and tag != "head" and tag not in INLINE and tag not in CLOSES:
            hashes[not inside].append(h)
        if len(out) > start:
            if named:
                cuts.append((start, len(out), named))
            if h in template:
                cuts.append((start, len(out), WITHIN))
            elif h in around and not inside:
                cuts.append((start, len(out), AROUND))
            if tag in MAIN and not inside:
                main.append((start, len(out)))
                out.append(" ")

    def opened(tag, inside, named):
        block = len(frames) if tag == "p" or tag in BLOCKS else frames[-1][5]
        frames.append([tag, inside, named, [], len(out), block])
        open_[tag] = open_.get(tag, 0) + 1

    at = 0
    tokens = _tokens(page)
    token = next(tokens, None)
    while token:
        start, end, tag, closing, attributes = token
        if start > at:
            text = page[at:start]
            frames[-1][3].append(" ".join(text.split()))
            out.append(entities.unescape(text) if "&" in text else text)
        at = end
        if tag is None:
            pass
        elif closing:
            if open_.get(tag):
                depth = next(i for i in range(len(frames) - 1, 0, -1) if frames[i][0] == tag)
                # an inline end tag does not close blocks around it
                if tag in BLOCKS or not any(f[0] in INLINE_SAFE for f in frames[depth + 1 :]):
                    while len(frames) > depth:
                        close()
            if tag in BLOCKS:
                out.append(" ")
        else:
            if tag in BLOCKS:
                out.append(" ")
                # a block ends an open paragraph, with what is open inside
                p = frames[-1][5]
                if tag != "br" and p and frames[p][0] == "p":
                    while len(frames) > p:
                        close()
            if tag in CLOSES and any(open_.get(t) for t in CLOSES[tag]):
                for i in range(len(frames) - 1, 0, -1):
                    if frames[i][0] in SCOPES[tag]:
                        break
                    if frames[i][0] in CLOSES[tag]:
                        while len(frames) > i:
                            close()
                        break
            if tag in VOID:
                frames[-1][3].append(tag)
            elif len(frames) <= DEPTH or tag in RAW:
                inside = frames[-1][1] or frames[-1][0] in MAIN
                kind = tag in DROPPED or tag == "header" and not inside
                named = STRONG if kind else 0 if attributes == "" or tag in ROOTS or tag in MAIN and not inside and "hidden" not in attributes else _named(attributes, inside)
                opened(tag, inside, named)
                if tag in RAW:
                    stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                    inner = page[at : stop.start() if stop else len(page)]
                    frames[-1][3].append(inner if tag not in ("script", "style") else "")
                    if tag in ("textarea", "title"):
                        out.append(entities.unescape(inner))
                    at = stop.end() if stop else len(page)
                    close()
        try:
            token = tokens.send(at)
        except StopIteration:
            token = None
    if at < len(page):
        frames[-1][3].append(page[at:])
        out.append(entities.unescape(page[at:]))
    while len(frames) > 1:
        close()
    if not main:
        return _kept(out, main, [c for c in cuts if c[2] != AROUND], deleted), hashes[0] + hashes[1], []
    return _kept(out, main, cuts, deleted), *hashes


def _kept(out: list[str], main: list[tuple[int, int]], cuts: list[tuple[int, int, int]], deleted: list | None) -> str:
    """The text that is left of the pieces. Cuts and main parts nest or lie apart, as elements do; inner ones come first."""
    gone = bytearray(len(out))

    def cut(start, end):
        # what is cut within is cut already: jumping over it would save little
        gone[start:end] = b"\1" * (end - start)

    strong = [(s, e) for s, e, how in cuts if how == STRONG]
    for s, e in _outer(strong):
        cut(s, e)
    length = [0]
    for piece, g in zip(out, gone, strict=True):
        length.append(length[-1] + (0 if g else len(piece.strip())))
    total = length[-1]
    # a main part inside what is cut for sure is none
    main = _outer([(s, e) for s, e in main if not gone[s]])
    # main parts within what is named (an article of a comment) are none where there are others
    named = _outer([(s, e) for s, e, how in cuts if how == WEAK])
    within = lambda s, e: (i := bisect_right(named, (s, float("inf")))) > 0 and e <= named[i - 1][1] and named[i - 1] != (s, e)
    own = [(s, e) for s, e in main if not within(s, e)]
    main = own if sum(length[e] - length[s] for s, e in own) > 0 else main
    held = sum(length[e] - length[s] for s, e in main)
    starts = [s for s, _ in main]
    holds_main = lambda s, e: (i := bisect_left(starts, s)) < len(starts) and main[i][1] <= e
    bulk = lambda s, e: 2 * (length[e] - length[s]) > total
    # what recurs with most of the page's text is content that recurs, with all its parts
    content = _outer([(s, e) for s, e, how in cuts if how in (WITHIN, AROUND) and bulk(s, e)])
    begins = [s for s, _ in content]
    in_content = lambda s, e: (i := bisect_right(begins, s)) > 0 and e <= content[i - 1][1]
    # a name never takes the bulk of a page, or of a main part that it stands in
    much = lambda s, e: (i := bisect_right(starts, s)) > 0 and e <= main[i - 1][1] and 2 * (length[e] - length[s]) > held
    chosen = [(s, e, how) for s, e, how in cuts if how == STRONG or not bulk(s, e) and not (holds_main(s, e) or much(s, e) if how == WEAK else in_content(s, e))]
    for s, e in _outer([(s, e) for s, e, _ in chosen]):
        cut(s, e)
    if deleted is not None:
        by_template = {(s, e) for s, e, how in chosen if how in (WITHIN, AROUND)}
        for s, e in _outer([(s, e) for s, e, _ in chosen]):
            if size := sum(len(p.strip()) for p in out[s:e]):
                deleted.append(((s, e) in by_template, size))
    pieces = ["".join(p for p, g in zip(out[s:e], gone[s:e], strict=True) if not g) for s, e in (main or [(0, len(out))])]
    return " ".join(" ".join(pieces).split())


def _outer(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those that lie in no other, in order."""
    found: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not found or s >= found[-1][1]:
            found.append((s, e))
    return found


def _keyed(pages: DataFrame, html_col: str, url_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(url_col, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    page = F.coalesce(F.col(html_col), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col(url_col).alias("url"), page.alias("html"), host.alias("host")).withColumn("uid", row_digest(F.col("page_id"), F.col("url"), F.col("html")))


def templates(pages: DataFrame, min_pages=5, share=0.25, around=0.02, html_col="html", url_col="url") -> DataFrame:
    """uid, template, around: the template's subtree hashes that each page has, in either place (pages that have some). uid: digest of the whole row."""

    def run(batches):
        for b in batches:
            scanned = [scan(p.as_py()) for p in b.column(2)]
            content = [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1 for text, _, _ in scanned]
            places = [[PAGE, *sorted(set(found[k]))] if k == 1 else sorted(set(found[k])) for found in scanned for k in (1, 2)]
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(content, pa.int64()), pa.array(places[::2], lists), pa.array(places[1::2], lists)], names=["uid", "host", "content", "within", "around"])

    rows = _keyed(pages, html_col, url_col).select("uid", "host", "html")
    # read three times below: pages are scanned once, and their hashes written
    hashed = ship(rows).mapInArrow(run, "uid binary, host string, content long, within array<long>, around array<long>")
    # a place is shorter than a digest, for the many rows below
    hashed = checkpointed(hashed.select("uid", F.monotonically_increasing_id().alias("place"), F.xxhash64("host").alias("host"), "content", "within", "around"))
    each = hashed.select("host", "content", F.explode(F.concat("within", "around")).alias("h"))
    counts = each.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= min_pages) | (F.col("h") == PAGE))
    hosts = counts.filter(F.col("h") == PAGE).select("host", F.col("n").alias("all"))
    common = counts.filter(F.col("h") != PAGE).join(hosts, "host").filter(F.col("n") >= around * F.col("all")).select("host", "h", (F.col("n") >= share * F.col("all")).alias("often"))
    part = lambda c, outside: F.transform(c, lambda h: F.struct(h.alias("h"), F.lit(outside).alias("outside")))
    found = hashed.select("place", "host", F.inline(F.concat(part("within", False), part("around", True)))).join(common, ["host", "h"]).filter("often OR outside")
    sets = found.groupBy("place").agg(F.collect_set(F.when(F.col("often"), F.col("h"))).alias("template"), F.collect_set(F.when(~F.col("often"), F.col("h"))).alias("around"))
    # rows that are stored twice have the same sets
    return hashed.select("place", "uid").join(sets, "place").groupBy("uid").agg(F.first("template").alias("template"), F.first("around").alias("around"))


def extract(pages: DataFrame, min_pages=5, share=0.25, around=0.02, html_col="html", url_col="url") -> DataFrame:
    """A row a page: page_id, url, text, n_chars."""

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            packed = pa.array([squeeze(p.as_py().encode()) for p in b.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), packed], names=["uid", "page_id", "url", "packed"])

    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = [scan(expand(p.as_py()).decode(), set(t.as_py() or ()), set(a.as_py() or ()))[0] for p, t, a in zip(b.column(2), b.column(3), b.column(4), strict=True)]
            columns = [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    rows = _keyed(pages, html_col, url_col).select("uid", "page_id", "url", "html")
    # pages cross the shuffle packed, at under half of their size
    rows = ship(rows).mapInArrow(pack, "uid binary, page_id long, url string, packed binary")
    flagged = templates(pages, min_pages, share, around, html_col, url_col)
    joined = rows.join(flagged, "uid", "left").select("page_id", "url", "packed", "template", "around")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
