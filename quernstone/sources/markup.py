"""Pages as trees of rows (S12, S10): nodes with intervals, selections of elements, their texts, grids of tables.

A node's descendants are those of its page with `pre` up to its `last`: what lies inside what is found as nodes stream by in page order."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

# Fixed values of the HTML standard: elements without an end, those whose content is text, and what a start tag ends within which scope.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title".split())
HIDDEN = ["script", "style"]
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr"), ("table",)),
    "option": (("option",), ("select",)),
}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = ("table", "td", "th", "caption", "button", "object")

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_GAP = re.compile(r"[\s/]*")

NODE = "pre long, last long, depth int, tag string, classes array<string>, attributes map<string,string>, text string"


def nodes(page: str) -> Iterator[tuple]:
    """(pre, last, depth, tag, attributes, text) of a page's elements and texts (tag `#text`; `#raw` in scripts and styles), each as it ends; in linear time.

    Never fails: an end tag without a start is left out, what is open at the end ends there, `<` before no name is text."""
    stack: list[tuple[int, str, dict]] = []
    held: dict[str, list[int]] = {}
    pre, at, size = 0, 0, len(page)
    none_after: dict[str, int] = {}
    endless: set[str] = set()

    def find(what: str, start: int) -> int:
        """str.find that scans what holds no match only once."""
        if none_after.get(what, size + 1) <= start:
            return -1
        if (i := page.find(what, start)) < 0:
            none_after[what] = start
        return i

    def close(height: int) -> Iterator[tuple]:
        while len(stack) > height:
            number, tag, attributes = stack.pop()
            held[tag].pop()
            yield number, pre, len(stack), tag, attributes, None

    def opened(names: tuple[str, ...]) -> int:
        return max((held[n][-1] for n in names if held.get(n)), default=-1)

    def text(start: int, stop: int) -> Iterator[tuple]:
        nonlocal pre
        if start < stop:
            pre += 1
            raw = stack and stack[-1][1] in HIDDEN
            yield pre, pre, len(stack), "#raw" if raw else "#text", {}, page[start:stop] if raw else html.unescape(page[start:stop])

    said = 0
    while (lt := find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            yield from text(said, lt)
            end = find("-->", lt + 4)
            at = said = size if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            yield from text(said, lt)
            end = find(">", lt)
            at = said = size if end < 0 else end + 1
        elif page.startswith("</", lt) and (m := _NAME.match(page, lt + 2)):
            yield from text(said, lt)
            if held.get(name := m[0].lower()):
                yield from close(held[name][-1])
            end = find(">", m.end())
            at = said = size if end < 0 else end + 1
        elif m := _NAME.match(page, lt + 1):
            yield from text(said, lt)
            name, at, attributes = m[0].lower(), m.end(), {}
            while a := _ATTRIBUTE.match(page, at):
                value = a[2] or ""
                attributes.setdefault(a[1].lower(), html.unescape(value[1:-1] if value[:1] in ('"', "'") and value[-1:] == value[:1] and len(value) > 1 else value))
                at = a.end()
            at = _GAP.match(page, at).end()
            at += at < size and page[at] == ">"
            said = at
            if name in ENDS:
                names, scope = ENDS[name]
                while (top := opened(names)) > opened(scope):
                    yield from close(top)
            elif name in BLOCKS and (top := opened(("p",))) > opened(SCOPES):
                yield from close(top)
            pre += 1
            if name in VOID:
                yield pre, pre, len(stack), name, attributes, None
                continue
            held.setdefault(name, []).append(len(stack))
            stack.append((pre, name, attributes))
            if name in RAW:
                # its content is text up to its own end
                end = None if name in endless else re.compile(f"</{name}", re.I).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.start() if end else size
                yield from text(said, at)
                said = at
        else:
            at = lt + 1
    yield from text(said, size)
    yield from close(0)


def page_tree(df: DataFrame, key: str, column: str, batch: int = 8192) -> DataFrame:
    """(key, pre, last, depth, tag, classes, attributes, text): a row a node of each page.

    Null and empty pages have none. A page streams through in batches of nodes: no page's tree is held whole."""
    schema = T.StructType([df.schema[key], *T._parse_datatype_string(NODE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.column(0).type
            keys, rows = [], []

            def made() -> pa.RecordBatch:
                pre, last, depth, tag, attributes, text = zip(*rows, strict=True)
                classes = [(a.get("class") or "").split() for a in attributes]
                return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(pre, pa.int64()), pa.array(last, pa.int64()), pa.array(depth, pa.int32()), pa.array(tag, pa.string()),  # noqa: B023
                    pa.array(classes, pa.list_(pa.string())), pa.array([list(a.items()) for a in attributes], pa.map_(pa.string(), pa.string())), pa.array(text, pa.string())], names=schema.names)

            for k, page in zip(b.column(0), b.column(1), strict=True):
                for row in nodes(page.as_py() or ""):
                    keys.append(k.as_py())
                    rows.append(row)
                    if len(rows) >= batch:
                        yield made()
                        keys, rows = [], []
            if rows:
                yield made()

    return df.select(key, F.col(column).cast("string")).mapInArrow(run, schema)


def chosen(tag: str | None = None, cls: str | None = None, **attributes: str) -> Column:
    """The condition that a node is such an element: by tag, one of its classes, attributes."""
    ok = ~F.startswith(F.col("tag"), F.lit("#"))
    if tag:
        ok = ok & (F.col("tag") == tag.lower())
    if cls:
        ok = ok & F.array_contains("classes", cls)
    for name, value in attributes.items():
        ok = ok & (F.col("attributes")[name] == value)
    return ok


def inside(outer: DataFrame, inner: DataFrame, key: str) -> DataFrame:
    """(key, outer: struct, inner: struct): every pair of nodes of a page of which the second lies in the first, at any depth, nested ones as well.

    Both go once through the shuffle, by page, and stream by in page order past the outer nodes that are open."""
    held = lambda df: F.struct(*[c for c in df.columns if c != key])
    a = outer.select(key, "pre", "last", F.lit(1).alias("kind"), held(outer).alias("outer"))
    b = inner.select(key, "pre", F.col("pre").alias("last"), F.lit(0).alias("kind"), held(inner).alias("inner"))
    schema = T.StructType([a.schema[key], T.StructField("outer", a.schema["outer"].dataType), T.StructField("inner", b.schema["inner"].dataType)])
    every = a.unionByName(b, allowMissingColumns=True).filter(F.col(key).isNotNull())
    # a node does not lie in itself: at equal places the inner one comes first
    return every.repartition(key).sortWithinPartitions(key, "pre", "kind").mapInArrow(_paired, schema)


def _paired(batches: Iterator[pa.RecordBatch], most: int = 65536) -> Iterator[pa.RecordBatch]:
    """Pairs of an open node and one inside it, from the nodes of both kinds in page order; open nodes alone are held from batch to batch."""
    page, ends, held = None, [], None
    for b in batches:
        outer = b.column("outer")
        pool = outer if held is None else pa.concat_arrays([held, outer])
        # places in the pool of the nodes that are open, beside their ends
        first, at, made = len(pool) - len(outer), list(range(len(ends))), ([], [])

        def pairs() -> pa.RecordBatch:
            of = pa.array(made[1], pa.int64())  # noqa: B023
            return pa.RecordBatch.from_arrays([b.column(0).take(of), pool.take(pa.array(made[0], pa.int64())), b.column("inner").take(of)], names=[b.schema.names[0], "outer", "inner"])  # noqa: B023

        for i, (k, pre, last, kind) in enumerate(zip(*(b.column(c).to_pylist() for c in (b.schema.names[0], "pre", "last", "kind")), strict=True)):
            if k != page:
                page, ends, at = k, [], []
            while ends and ends[-1] < pre:
                ends.pop()
                at.pop()
            if kind:
                ends.append(last)
                at.append(first + i)
                continue
            made[0].extend(at)
            made[1].extend([i] * len(at))
            if len(made[0]) >= most:
                yield pairs()
                made = ([], [])
        if made[0]:
            yield pairs()
        held = pool.take(pa.array(at, pa.int64()))


def _in_page_order(tree: DataFrame, key: str, *columns: str | Column) -> DataFrame:
    return tree.filter(F.col(key).isNotNull()).select(key, "pre", "last", *columns).repartition(key).sortWithinPartitions(key, "pre")


def texts(tree: DataFrame, key: str, wanted: Column, sep: str = "\n") -> DataFrame:
    """(key, pre, text): the text of each wanted element: its pieces, decoded and trimmed, empty ones and scripts left out, in order.

    An element without text has no row; one inside another wanted one is told with it and on its own. Pieces stream by in page order and
    go once through the shuffle; the texts of open elements are held."""
    piece = (F.col("tag") == "#text") & (F.regexp_replace("text", r"(?U)\s+", "") != "")
    nodes = tree.filter(wanted | piece).withColumn("text", F.when(piece, F.regexp_replace("text", r"(?U)^\s+|\s+$", "")))
    return _in_page_order(nodes, key, "text").mapInArrow(_said(sep), T.StructType([tree.schema[key], *T._parse_datatype_string("pre long, text string").fields]))


def _said(sep: str, batch: int = 8192):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, stack, rows, schema = None, [], [], None

        def close(before: int | None) -> None:
            while stack and (before is None or stack[-1][1] < before):
                pre, _, pieces = stack.pop()
                if pieces:
                    rows.append((page, pre, sep.join(pieces)))

        def told() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=names)
            rows.clear()
            return made

        for b in batches:
            names, schema = [b.schema.names[0], "pre", "text"], [b.schema.field(0).type, pa.int64(), pa.string()]
            for k, pre, last, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                close(None if k != page else pre)
                page = k
                if text is None:
                    stack.append((pre, last, []))
                for _, _, pieces in stack if text is not None else ():
                    pieces.append(text)
                if len(rows) >= batch:
                    yield told()
        close(None)
        if rows:
            yield told()

    return run


def table_cells(tree: DataFrame, key: str, least: int = 2) -> DataFrame:
    """(key, table_no, row_no, col_no, text, row_header, col_header) of the tables of pages, numbers from 0, tables from 1 in page order.

    Only tables of at least `least` rows and as many cells in the first row. A cell that spans columns fills only the first of them and moves
    those after it; one that spans rows moves those of later rows the same way. White space of a cell becomes single spaces.
    A cell inside a table inside a cell is of the inner table, and its text is of the outer cell as well.
    Nodes go once through the shuffle, by page, and cells once more; nothing is broadcast."""
    span = lambda name: F.greatest(F.lit(1), F.least(F.lit(1000), F.coalesce(F.expr(f"try_cast(attributes['{name}'] AS int)"), F.lit(1))))
    nodes = tree.filter(F.col("tag").isin("table", "tr", "td", "th", "#text"))
    schema = T.StructType([tree.schema[key], *T._parse_datatype_string("table long, row_no long, col_no long, text string").fields])
    placed = _in_page_order(nodes, key, "tag", span("colspan").alias("wide"), span("rowspan").alias("high"), "text").mapInArrow(_placed, schema)
    # by page, so that every window below finds its rows together
    placed = placed.repartition(key).withColumn("text", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    whole, down, along = Window.partitionBy(key, "table"), Window.partitionBy(key, "table", "col_no").orderBy("row_no"), Window.partitionBy(key, "table", "row_no").orderBy("col_no")
    head = F.when(F.first("row_no").over(down) == 0, F.first("text").over(down)).otherwise("")
    side = F.when(F.first("col_no").over(along) == 0, F.first("text").over(along)).otherwise("")
    told = placed.withColumns({"row_header": side, "col_header": head, "__rows": F.max("row_no").over(whole) + 1, "__wide": F.sum((F.col("row_no") == 0).cast("int")).over(whole)})
    kept = told.filter((F.col("__rows") >= least) & (F.col("__wide") >= least))
    nth = F.dense_rank().over(Window.partitionBy(key).orderBy("table")).cast("long")
    return kept.select(key, nth.alias("table_no"), "row_no", "col_no", "text", "row_header", "col_header")


def _placed(batches: Iterator[pa.RecordBatch], batch: int = 8192) -> Iterator[pa.RecordBatch]:
    """The cells of tables, each as it ends: its innermost table, its row there, the column that it comes to stand in, past those that reach
    down from rows above, and its text. Nodes come in page order; what is open is held."""
    page, tables, cells, rows = None, [], [], []

    def close(before: int | None) -> None:
        while cells and (before is None or cells[-1][0] < before):
            _, at, pieces = cells.pop()
            if at:
                rows.append((page, *at, " ".join(pieces)))
        while tables and (before is None or tables[-1]["last"] < before):
            tables.pop()

    def told() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [kind, pa.int64(), pa.int64(), pa.int64(), pa.string()], strict=True)], names=[name, "table", "row_no", "col_no", "text"])
        rows.clear()
        return made

    for b in batches:
        name, kind = b.schema.names[0], b.schema.field(0).type
        for k, pre, last, tag, wide, high, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            close(None if k != page else pre)
            page = k
            if tag == "#text":
                for _, _, pieces in cells:
                    pieces.append(text)
            elif tag == "table":
                tables.append({"pre": pre, "last": last, "row": -1, "col": 0, "until": {}})
            elif tag == "tr":
                if tables:
                    tables[-1]["row"] += 1
                    tables[-1]["col"] = 0
            else:
                at = None
                if tables and (t := tables[-1])["row"] >= 0:
                    col, row, until = t["col"], t["row"], t["until"]
                    while until.get(col, 0) > row:
                        col += 1
                    until.update(dict.fromkeys(range(col, col + wide), row + high))
                    t["col"] = col + wide
                    at = t["pre"], row, col
                cells.append((last, at, []))
            if len(rows) >= batch:
                yield told()
    close(None)
    if rows:
        yield told()


#: A tag that is as it should be: name, attributes. All attributes of a tag, as `_ATTRIBUTE` takes them one by one. White space, and numbers, as Spark knows them.
_TAG = re.compile(r"""<(/?[a-zA-Z][^\s/>"'=<]*+)((?>[\s/]*[^\s/>="'<]++(?:\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s>"'<]*+))?)*+[\s/]*)>""")
_ATTRIBUTES = re.compile(rf"(?>{_ATTRIBUTE.pattern})*+")
_BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACES = re.compile(f"[{_BLANKS}]+")
_NUMBER = re.compile(r"[\x00-\x20\x7f]*\+?0*([0-9]{1,10})[\x00-\x20\x7f]*")
_SCOPED = {n for names, scope in ENDS.values() for n in (*names, *scope)} | {"p", *SCOPES}


def _tags(page: str) -> tuple[list[str], list[str], list[str]]:
    """Names and attributes of the tags of a page, as `nodes` reads it, and the texts before, between and after them; a name may be empty, where
    only text ends."""
    parts = _TAG.split(page)
    if 3 * page.count("<") == len(parts) - 1 and RAW.isdisjoint(map(str.lower, parts[1::3])):
        return parts[1::3], parts[2::3], parts[::3]
    names, attributes, texts = zip(*_odd_tags(page), strict=True)
    return [*names[:-1]], [*attributes[:-1]], [*texts]


def _odd_tags(page: str) -> Iterator[tuple[str, str, str]]:
    """(name, attributes, the text before) of the tags of any page."""
    at = said = 0
    size = len(page)
    none_after: dict[str, int] = {}
    endless: set[str] = set()

    def find(what: str, start: int) -> int:
        if none_after.get(what, size + 1) <= start:
            return -1
        if (i := page.find(what, start)) < 0:
            none_after[what] = start
        return i

    while (lt := find("<", at)) >= 0:
        if page.startswith(("<!", "<?"), lt):
            yield "", "", page[said:lt]
            what = "-->" if page.startswith("<!--", lt) else ">"
            end = find(what, lt + 4 if what == "-->" else lt)
            at = said = size if end < 0 else end + len(what)
        elif page.startswith("</", lt) and (m := _NAME.match(page, lt + 2)):
            yield "/" + m[0], "", page[said:lt]
            end = find(">", m.end())
            at = said = size if end < 0 else end + 1
        elif m := _NAME.match(page, lt + 1):
            end = _ATTRIBUTES.match(page, m.end()).end()
            yield m[0], page[m.end() : end], page[said:lt]
            at = _GAP.match(page, end).end()
            at += at < size and page[at] == ">"
            said = at
            if (name := m[0].lower()) in RAW:
                # its content is text up to its own end
                end = None if name in endless else re.compile(f"</{name}", re.I).search(page, at)
                if end is None:
                    endless.add(name)
                at = end.start() if end else size
                if name in HIDDEN:
                    said = at
                else:
                    yield "", "", page[said:at]
                    said = at
        else:
            at = lt + 1
    yield "", "", page[said:]


def _spans(attributes: str) -> list[int]:
    """colspan and rowspan; what Spark casts to no int counts as 1."""
    found: dict[str, str] = {}
    at = 0
    while a := _ATTRIBUTE.match(attributes, at):
        value = a[2] or ""
        found.setdefault(a[1].lower(), html.unescape(value[1:-1] if value[:1] in ('"', "'") and value[-1:] == value[:1] and len(value) > 1 else value))
        at = a.end()
    numbers = [_NUMBER.fullmatch(found.get(n, "")) for n in ("colspan", "rowspan")]
    return [max(1, min(1000, n)) if m and (n := int(m[1])) < 2**31 else 1 for m in numbers]


def _placed_cells(names: Sequence[str], attributes: Sequence[str]) -> list[list[tuple[int, int, list[int]]]]:
    """(row, column, the numbers of its texts) of the cells of each table, tables in page order, by the tags alone: where `table_cells` puts `nodes`."""
    held: dict[str, list[int]] = {n: [-1] for n in _SCOPED}  # the places of open elements of each name
    td, th, tr, table, p = held["td"], held["th"], held["tr"], held["table"], held["p"]
    stack: list[tuple[list[int], int]] = []  # those of its name; 1: a table, 2: a cell
    made: list[list] = []
    tables: list[list] = []  # of open ones: row, next column, until which row columns are taken, cells
    cells: list[tuple] = []

    def close(height: int) -> None:
        while len(stack) > height:
            own, kind = stack.pop()
            own.pop()
            if kind == 2:
                to, *cell = cells.pop()
                if to is not None:
                    to.append(tuple(cell))
            elif kind:
                tables.pop()

    for i, (name, given) in enumerate(zip(names, attributes, strict=True)):
        for cell in cells:
            cell[3].append(i)
        if not name:
            continue
        name = name.lower()
        kind = 0
        if name == "td" or name == "th":
            while True:
                top, scope = td[-1] if td[-1] > th[-1] else th[-1], tr[-1] if tr[-1] > table[-1] else table[-1]
                if top <= scope:
                    break
                close(top)
            kind = 2
            to, row, col = None, 0, 0
            wide, high = _spans(given) if given else (1, 1)
            if tables and (t := tables[-1])[0] >= 0:
                row, col, until, to = t
                if until:
                    while until.get(col, 0) > row:
                        col += 1
                if wide > 1 or high > 1:
                    until.update(dict.fromkeys(range(col, col + wide), row + high))
                t[1] = col + wide
            cells.append((to, row, col, []))
        elif name[0] == "/":
            if (own := held.get(name[1:])) and own[-1] >= 0:
                close(own[-1])
            continue
        elif name == "tr":
            while tr[-1] > table[-1]:
                close(tr[-1])
            if tables:
                tables[-1][0] += 1
                tables[-1][1] = 0
        elif name in ENDS:
            ended, scope = ENDS[name]
            while (top := max([held[n][-1] for n in ended])) > max([held[n][-1] for n in scope]):
                close(top)
        else:
            if p[-1] >= 0 and name in BLOCKS and p[-1] > max([held[n][-1] for n in SCOPES]):
                close(p[-1])
            if name in VOID:
                continue
            if name == "table":
                kind = 1
                made.append([])
                tables.append([-1, 0, {}, made[-1]])
        own = held.get(name)
        if own is None:
            own = held[name] = [-1]
        own.append(len(stack))
        stack.append((own, kind))
    for cell in cells:
        cell[3].append(len(names))
    close(0)
    return made


class _Layout(NamedTuple):
    """Of the cells of a page's tables that are large enough: where they stand, their texts, and the cells that head their rows and columns (-1: none)."""

    table_no: list[int]
    row_no: list[int]
    col_no: list[int]
    pieces: list[list[int]]
    side: list[int]
    head: list[int]


def _laid_out(names: Sequence[str], attributes: Sequence[str], least: int) -> _Layout:
    made = _Layout([], [], [], [], [], [])
    no = 0
    for cells in _placed_cells(names, attributes):
        head = {col: i for i, (row, col, _) in enumerate(cells, len(made.row_no)) if not row}
        if len(head) < least or max(row for row, *_ in cells) + 1 < least:
            continue
        no += 1
        side = {row: i for i, (row, col, _) in enumerate(cells, len(made.row_no)) if not col}
        for row, col, pieces in cells:
            for column, value in zip(made, (no, row, col, pieces, side.get(row, -1), head.get(col, -1)), strict=True):
                column.append(value)
    return made


@lru_cache(maxsize=256)
def _known_layout(names: tuple[str, ...], attributes: tuple[str, ...], least: int) -> _Layout:
    """Pages of one template have the same tags: the layouts of some are kept."""
    return _laid_out(names, attributes, least)


def _told(texts: list[str], pieces: list[int]) -> str:
    said = (texts[pieces[0]] if len(pieces) == 1 else " ".join([texts[i] for i in pieces])).strip(_BLANKS)
    return said if said.isalnum() else _SPACES.sub(" ", said)


def page_cells(df: DataFrame, key: str, column: str, least: int = 2, batch: int = 16384) -> DataFrame:
    """The rows of `table_cells`, from pages of markup: a page's cells are made where the page is, and nothing is shuffled.

    Null keys and null pages have none; each row is a page of its own. The cells of one page are held at once."""
    schema = T.StructType([df.schema[key], *T._parse_datatype_string("table_no long, row_no long, col_no long, text string, row_header string, col_header string").fields])
    return df.filter(F.col(key).isNotNull()).select(key, F.col(column).cast("string")).mapInArrow(_cells_of(schema.names, least, batch), schema)


def _cells_of(names: list[str], least: int, batch: int):
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, made = [], [[] for _ in types]

            def told() -> pa.RecordBatch:
                rows = pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of, pa.int64())), *map(pa.array, made, types)], names=names)  # noqa: B023
                for x in (of, *made):  # noqa: B023
                    x.clear()
                return rows

            for i, page in enumerate(b.column(1).to_pylist()):
                if not page:
                    continue
                tags, attributes, texts = _tags(page)
                at = _known_layout(tuple(tags), tuple(attributes), least) if len(tags) <= 1024 else _laid_out(tags, attributes, least)
                if "&" in page:
                    texts = [html.unescape(t) if "&" in t else t for t in texts]
                said = [_told(texts, x) for x in at.pieces]
                ends = [*said, ""]
                for start in range(0, len(said), batch):
                    to = slice(start, start + batch)
                    for whole, more in zip(made, (at.table_no[to], at.row_no[to], at.col_no[to], said[to], [ends[x] for x in at.side[to]], [ends[x] for x in at.head[to]]), strict=True):
                        whole += more
                    of += [i] * len(said[to])
                    if len(of) >= batch:
                        yield told()
            if of:
                yield told()

    return run
