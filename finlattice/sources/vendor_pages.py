"""Holdings of funds from vendors' pages: HTML tables, alone or inside the string of a script."""

from __future__ import annotations

import functools
import json
import re
import sys
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# Words of the header cells, places without a header, classes of the table that is meant.
HEADERS = {"stock_code": "股票代码|证券代码", "stock_name": "股票名称|证券名称", "weight": "占净值比例|占基金资产净值比例|净值比例", "market_value": "持仓市值|持股.*市值", "shares": "持股数|持股数量", "rank": r"^\s*序号\s*$"}
PLACES = ("rank", "stock_code", "stock_name", "weight", "shares", "market_value")
CLASSES = ("w782 comm tzxq", "w782 comm", "tzxq")
UNITS = {"亿": 1e8, "万": 1e4}
#: Market values without a unit in their header are in this one.
USUAL_UNIT = 1e4
_STRING = re.compile(r'content\s*:\s*"([^"\\]*+(?:\\.[^"\\]*+)*+)"', re.S)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|.)", re.S)


def script_string(text: str | None) -> str | None:
    """The string `content` of a script's object with its escapes undone; None where it is missing or not closed.

    Escapes that JSON has stay for its decoder; of the others, quotes and tabulators are spelled in JSON and unknown ones go.
    """
    found = _STRING.search(text or "")
    if found is None:
        return None
    body = found[1]
    if body.count("\\") == body.count("\\/") + body.count('\\"'):  # every backslash stands before a slash or a quote
        return body.replace("\\/", "/").replace('\\"', '"')
    own = {"'": "'", "v": "\\u000b"}
    body = _ESCAPE.sub(lambda m: m[0] if len(m[1]) == 5 or m[1] in '"\\/nrtbf' else own.get(m[1], ""), body)
    return json.loads(f'"{body}"', strict=False)


class _Grids(HTMLParser):
    """Tables as grids: (class, rows of cells), a cell that spans rows or columns standing in all of them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables: list[tuple[str, list[dict[int, list]]]] = []
        self.open: list[int] = []  # tables that are open, by number
        self.cell: list | None = None

    def handle_starttag(self, tag, attrs):
        named = dict(attrs)
        if tag == "table":
            self.tables.append((" ".join((named.get("class") or "").split()), []))
            self.open.append(len(self.tables) - 1)
            self.cell = None
        elif not self.open:
            return
        elif tag == "tr":
            self._row()
        elif tag in ("td", "th"):
            self._cell(*(min(int(v), 1000) if (v := named.get(n) or "").isdigit() and int(v) else 1 for n in ("rowspan", "colspan")))

    def _row(self) -> None:
        rows, self.cell = self.tables[self.open[-1]][1], None
        above = rows[-1] if rows else {}
        rows.append({at: [text, left - 1] for at, (text, left) in above.items() if left > 1})

    def _cell(self, down: int, across: int) -> None:
        rows = self.tables[self.open[-1]][1]
        if not rows:
            self._row()
        at, self.cell = 0, []
        while at in rows[-1]:
            at += 1
        for k in range(at, at + across):
            if k not in rows[-1]:
                rows[-1][k] = [self.cell, down]

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def grids(self) -> list[tuple[str, list[list[str]]]]:
        text = lambda row: [" ".join("".join(row[k][0]).split()) if k in row else "" for k in range(max(row, default=-1) + 1)]
        return [(name, [text(row) for row in rows]) for name, rows in self.tables]


# Most tables are plain: no references or comments, tags written one way, no cell over rows, none inside another.  Other tags in them shape no table.
_INLINE = re.compile(r"""</?(?:a|b|i|p|br|em|div|font|span|strong|thead|tbody)(?: [a-z]+=(?:"[^"<>&]*+"|'[^'<>&]*+'))*+>""")
_TEXT = rf"[^<&]*+(?:{_INLINE.pattern}[^<&]*+)*+"
_PLAIN = re.compile(rf"""{_TEXT}(?:<table(?: class="[^"<>&]*+")?>{_TEXT}(?:<tr>{_TEXT}(?:<t[dh](?: colspan="[0-9]{{1,4}}")?>{_TEXT}</t[dh]>{_TEXT})*+</tr>{_TEXT})*+</table>{_TEXT})*+""")
_SPACE = re.compile(r"\s")


def _plain_grids(html: str) -> list[tuple[str, list[list[str]]]] | None:
    """What _Grids makes of a page of plain tables, by splitting; None for any other page."""
    if not _PLAIN.fullmatch(html):
        return None
    out = []
    for table in html.replace("<th>", "<td>").replace("</th>", "</td>").replace("<th ", "<td ").split("<table")[1:]:
        head, _, body = table.partition(">")
        rows = []
        for row in body.split("<tr>")[1:]:
            row = row.partition("</tr>")[0]
            cells = row[4:-5].split("</td><td>")
            if row.count("<td") != len(cells) or not row.startswith("<td>") or not row.endswith("</td>"):  # spans, or texts between cells
                cells = [cell for part in row.split("<td")[1:] for cell in _across(part)]
            if row.count("<") > 2 * len(cells):
                cells = [_INLINE.sub("", cell) if "<" in cell else cell for cell in cells]
            if _SPACE.search("".join(cells)):
                cells = [" ".join(cell.split()) for cell in cells]
            rows.append(cells)
        out.append((" ".join(head[8:-1].split()), rows))
    return out


def _across(part: str) -> list[str]:
    """The cells that one makes whose tag was cut before its span, if any: ` colspan="2">text</td>`."""
    span, _, rest = part.partition(">")
    return [rest.partition("</td>")[0]] * (min(int(span[10:-1]), 1000) if span else 1)


_NOT_NUMBER = re.compile(r"[^\d.\-]")


def _number(text: str) -> float | None:
    digits = text.replace(",", "").replace("%", "")
    if not digits.replace(".", "", 1).isdecimal():
        digits = _NOT_NUMBER.sub("", text)
        if digits in ("", "-"):
            return None
    try:
        return float(digits)
    except ValueError:
        return None


@functools.lru_cache(4096)
def _columns(header: tuple[str, ...]) -> tuple[dict[str, int], float]:
    """Places of the columns that a first row names, by their order where it names no codes, and the unit of market values."""
    places: dict[str, int] = {}
    for at, cell in enumerate(header):
        name = next((n for n, words in HEADERS.items() if re.search(words, cell)), None)
        if name and name not in places:
            places[name] = at
    unit = USUAL_UNIT
    if "stock_code" not in places:
        places = {name: at for at, name in enumerate(PLACES)}
    elif "market_value" in places:
        words = header[places["market_value"]]
        unit = next((u for sign, u in UNITS.items() if sign in words), 1.0 if "元" in words else USUAL_UNIT)
    return places, unit


@functools.lru_cache(4096)
def _has_codes(header: tuple[str, ...]) -> bool:
    return any(re.search(HEADERS["stock_code"], cell) for cell in header)


def rows_of(html: str | None) -> list[tuple]:
    """(rank, stock_code, stock_name, weight as a fraction, market value in units of one, shares) of the holding table of a page."""
    tables = _plain_grids(html or "")
    if tables is None:
        parser = _Grids()
        parser.feed(html or "")
        tables = parser.grids()
    grids = [g for g in tables if g[1]]
    by_class = [rows for wanted in CLASSES for name, rows in grids if wanted == name or (" " not in wanted and wanted in name.split())]
    rows = by_class[0] if by_class else next((rows for _, rows in grids if _has_codes(tuple(rows[0]))), None)
    if rows is None:
        return []
    places, unit = _columns(tuple(rows[0]))
    ranks = places.get("rank") != places["stock_code"]
    order = [places.get(name, sys.maxsize) for name in ("rank", "stock_code", "stock_name", "weight", "market_value", "shares")]
    out: list[tuple] = []
    for cells in rows[1:]:
        n = len(cells)
        rank, code, name, weight, value, shares = [cells[at] if at < n else "" for at in order]
        if n < 3 or not code:
            continue
        weight, value = _number(weight), _number(value)
        out.append((int(rank) if ranks and rank.isdigit() else len(out) + 1, code, name, None if weight is None else weight / 100, None if value is None else value * unit, _number(shares)))
    return out


_ROWS = pa.schema([("rank", pa.int64()), ("stock_code", pa.string()), ("stock_name", pa.string()), ("weight", pa.float64()), ("market_value", pa.float64()), ("shares", pa.float64())])


def holdings(pages: DataFrame, key: str, page: str, in_script: bool | Column = False) -> DataFrame:
    """key, rank, stock_code, stock_name, weight, market_value, shares of every page; a page without such a table gives no row.

    in_script, for all pages or told of each, means that the table is in the string of a script.
    """
    kind = dict(pages.dtypes)[key]

    def run(batches):
        for batch in batches:
            at, rows = [], []
            for k, (text, script) in enumerate(zip(batch.column("page").to_pylist(), batch.column("in_script").to_pylist(), strict=True)):
                found = rows_of(script_string(text) if script else text)
                at += [k] * len(found)
                rows += found
            if rows:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROWS, strict=True)]
                columns[0] = columns[0].cast(pa.int32(), safe=False)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), *columns], names=[key, *_ROWS.names])

    flag = in_script if isinstance(in_script, Column) else F.lit(in_script)
    slim = pages.select(F.col(key).alias("key"), F.col(page).cast("string").alias("page"), flag.alias("in_script"))
    rows = slim.mapInArrow(run, f"{key} {kind}, rank int, stock_code string, stock_name string, weight double, market_value double, shares double")
    code = F.col("stock_code")
    return rows.withColumn("stock_code", X.security_code(F.when(code.rlike(r"^\d{1,5}$"), F.lpad(code, 6, "0")).otherwise(code)))
