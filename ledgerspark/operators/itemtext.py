"""Line items of one invoice text at a time: the ways of `items`, over a list of the text's lines instead of windows.

A table of texts is worked off in one pass, without a shuffle: a text becomes a letter for the kind of each line, and the ways are patterns of
these letters. The patterns of lines are those of `items`, spelled for Python: digits and white space are ASCII, letters those of Unicode, and
a line may end in a character that ends lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LINE_TOLERANCE, VAT_RATES
from .items import ARTICLE_HEADS, FOOTER_WORDS, LOOK_AHEAD, PIECES, PRICE_HEADS

ITEM = T.ArrayType(T.StructType([T.StructField("orden", T.IntegerType()), T.StructField("codigo", T.StringType()), T.StructField("nombre", T.StringType()), T.StructField("importe_c", T.LongType()), T.StructField("origen", T.StringType())]))
BLOCK = T.ArrayType(T.StructType([T.StructField("orden", T.IntegerType()), T.StructField("codigo", T.StringType()), T.StructField("nombre", T.StringType()), T.StructField("importe_c", T.LongType()), T.StructField("iva_tipo", T.IntegerType())]))

_END = r"(?=[\n\r\x85\u2028\u2029]?\Z)"
_AMOUNT = r"-?(?:\d{1,3}(?:\.\d{3})+,\d{2}|\d{1,3}(?:,\d{3})+\.\d{2}|\d+[.,]\d{2})"
_SOME = re.compile(r"\d[.,]\d{2}", re.A)
_PRICE = re.compile(_AMOUNT, re.A)
_AMOUNTS = re.compile(rf"(?<![\d.,]){_AMOUNT}(?![\d.,])", re.A)
_BARE = re.compile(r"[-\d.,€]+|EUR", re.A)
_CODE = re.compile(rf"(?:\d{{1,2}}\.?\s+)?(\d{{7,8}})[.,:;]?{_END}", re.A)
_INDEX = re.compile(rf"(?:[1-9]|[1-3]\d|40){_END}", re.A)
_AMOUNT_LAST = re.compile(rf"\s+-?[\d.]*\d[.,]\d{{2}}\s*(?:€|EUR)?{_END}", re.A)
_INDEX_FIRST = re.compile(r"^\d{1,2}[.)]?\s+(?=\D{3})", re.A)
_LETTERS = re.compile(r"[A-Za-z][^A-Za-z]*[A-Za-z][^A-Za-z]*[A-Za-z]")
_FOOTER = frozenset(FOOTER_WORDS)
_RATES_C = frozenset(100 * r for r in VAT_RATES if r)
# the ways as patterns of kinds
_PAIR = re.compile(rf"[Nn][^NnC]{{0,{LOOK_AHEAD - 1}}}C")
_NUMBERED, _CODE_AFTER, _NAME, _RUN, _BLOCK_END = re.compile("I[Nn]"), re.compile("[^NnI]C"), re.compile("[Nn]"), re.compile("P+"), re.compile("[Ca-z]")
_TOO_LARGE = 10**16
#: Lines that a worker remembers, and the longest of them.
_KNOWN, _SHORT = 50_000, 64


def three_letters(s: str) -> bool:
    return _LETTERS.search(s) is not None or not s.isascii() and sum(map(str.isalpha, s)) >= 3


def _first_word(low: str) -> str:
    """The letters and digits (of ASCII) that a line begins with."""
    for i, c in enumerate(low):
        if not (c.isalpha() or "0" <= c <= "9"):
            return low[:i]
    return low


def _cents(spelled: str) -> int | None:
    n = int(spelled.replace(".", "").replace(",", ""))
    return n if -_TOO_LARGE < n < _TOO_LARGE else None


def _kind(line: str) -> tuple[str, object]:
    """A line's kind as a letter, and its value: P amount alone (cents), C code, I index (its number), A head of articles, H head of prices, F footer, N name
    (with its amount), O any other; a small letter where a block of prices ends. As in `items.kinds`."""
    some = _SOME.search(line) is not None
    amounts = [_cents(x) for x in _AMOUNTS.findall(line)] if some else []
    if len(amounts) == 1 and _BARE.sub("", line).strip(" ") == "":
        return "P", amounts[0]
    if code := _CODE.match(line):
        return "C", code[1]
    if _INDEX.match(line):
        return "I", int(line)
    low = line.lower()
    kind, value = "O", None
    if low.startswith(ARTICLE_HEADS):
        kind = "A"
    elif "total" not in low and any(w in low for w in PRICE_HEADS):
        kind = "H"
    elif _first_word(low) in _FOOTER:
        kind = "F"
    elif three_letters(line):
        name = _INDEX_FIRST.sub("", _AMOUNT_LAST.sub("", line) if some else line).strip(" ")
        if three_letters(name):
            kind, value = "N", (name, amounts[-1] if amounts else None)
    return kind.lower() if low.startswith(("total", "modos")) else kind, value


class _Kinds(dict):
    """Kinds of lines; those of short lines other than prices and codes are remembered, since they come again."""

    def __missing__(self, line: str) -> tuple[str, object]:
        if _PRICE.fullmatch(line):
            return "P", _cents(line)
        if 7 <= len(line) <= 8 and line.isascii() and line.isdigit():
            return "C", line
        got = _kind(line)
        if got[0] not in "PC" and len(line) <= _SHORT:
            if len(self) >= _KNOWN:
                self.clear()
            self[line] = got
        return got


_kinds = _Kinds()


class Lines(NamedTuple):
    """The lines of a text that aren't blank: their kinds, a letter each, their values, and where the region of articles begins."""

    kinds: str
    values: list
    region: int


def lines_of(t: str | None) -> Lines:
    got = [_kinds[x] for x in [raw.strip(" ") for raw in (t or "").split("\n")] if x]
    kinds = "".join([x[0] for x in got])
    return Lines(kinds, [x[1] for x in got], kinds.find("A") + 1)


def reference_pairs(x: Lines, start: int) -> list[tuple[int, str, str, int]]:
    """(orden, codigo, nombre, place of the code): a name takes the first code on one of the LOOK_AHEAD lines below it, a code the name nearest above."""
    return [(k, x.values[m.end() - 1], x.values[m.start()][0], m.end() - 1) for k, m in enumerate(_PAIR.finditer(x.kinds, start), 1)]


def numbered_lines(x: Lines) -> list[tuple[int, str | None, str, int]]:
    """(orden, codigo, nombre, -1) of names below an index of their own; the code may stand below the name."""
    out = []
    for m in _NUMBERED.finditer(x.kinds, x.region):
        at = m.end() if x.kinds.startswith("C", m.end()) else m.end() + 1 if _CODE_AFTER.match(x.kinds, m.end()) else None
        out.append((x.values[m.start()], None if at is None else x.values[at], x.values[m.end() - 1][0], -1))
    return out


def block(x: Lines, code: int) -> slice:
    """The lines of the block of prices below a code, up to the next code or the totals."""
    end = _BLOCK_END.search(x.kinds, code + 1)
    return slice(code + 1, end.start() if end else len(x.kinds))


def block_price(x: Lines, code: int) -> int | None:
    """The last amount of a code's block."""
    found = block(x, code)
    at = x.kinds.rfind("P", found.start, found.stop)
    return x.values[at] if at >= 0 else None


def _paired(x: int | None, y: int | None) -> bool:
    if x is None or y is None or x <= 0:
        return False
    ratio = float(y) / float(x)
    return 1 <= round(ratio) <= PIECES and abs(ratio - round(ratio)) <= 0.03


def _line_prices(prices: list[int | None]) -> list[int | None]:
    """A unit price followed by its multiple is one line's price: the second. Amounts too large to be read are left out."""
    out, opened = [], None
    for x in prices:
        if _paired(opened, x):
            out.append(x)
            opened = None
        else:
            if opened is not None:
                out.append(opened)
            opened = x
    return out if opened is None else [*out, opened]


def _sum(values: list[int | None]) -> int | None:
    """The sum of a list; none if a part is missing."""
    return None if None in values else sum(values)


def column_runs(x: Lines) -> list[tuple[int, list[int | None], bool]]:
    """(place, prices, whether the head of a column stands above) of the runs of lines that are prices alone."""
    runs = []
    for m in _RUN.finditer(x.kinds):
        prices, head = x.values[m.start():m.end()], x.kinds[m.start() - 1:m.start()] in ("H", "h")
        runs.append((m.start(), _line_prices(prices) if head else prices, head))
    return runs


def column_prices(lines: Lines, base: int | None, total: int | None, wanted: set[int]) -> list[int | None] | None:
    """The prices that stand in columns, as in `items.column_prices`."""
    runs = column_runs(lines)
    best: tuple | None = None

    def rank(s: int | None) -> int | None:
        if s is None:
            return None
        return 0 if total is not None and abs(s - total) <= LINE_TOLERANCE else 1 if base is not None and abs(s - base) <= LINE_TOLERANCE else None

    def offer(n: int, s: int | None, part: bool, at: int, prices) -> None:
        nonlocal best
        r = rank(s)
        if r is not None:
            merit = (n not in wanted, r, -n, part, at)
            if best is None or merit < best[0]:
                found = prices()
                if not (part and all(x is not None and (x in (base, total) or base is not None and total is not None and x == total - base) for x in found)):
                    best = (merit, found)

    headed = [x for _, x, head in runs if head]
    if headed:
        sums = [s for s in map(_sum, headed) if s is not None]
        joined = [y for x in headed for y in x]
        offer(len(joined), sum(sums) if sums else None, False, 0, lambda: joined)
    for at, x, _ in runs:
        offer(len(x), _sum(x), False, at, lambda: x)
        longer = [n for n in wanted if 1 < n < len(x)]
        if longer:
            up_to = list(accumulate((y or 0 for y in x), initial=0))
            for n in longer:
                for i in range(len(x) - n + 1):
                    if x[i] is not None:
                        offer(n, up_to[i + n] - up_to[i], True, at + i, lambda: x[i:i + n])
    return best[1] if best else None


def trailing_amounts(x: Lines) -> list[tuple[int, None, str, int]]:
    """(orden, codigo, nombre, importe) of names with an amount on their own line, or on the next one alone; equal names with equal amounts count once."""
    seen: dict[tuple[str, int], None] = {}
    for m in _NAME.finditer(x.kinds, x.region):
        name, amount = x.values[m.start()]
        if amount is None and x.kinds.startswith("P", m.end()):
            amount = x.values[m.end()]
        if amount is not None:
            seen.setdefault((name, amount))
    return [(i, None, name, amount) for i, (name, amount) in enumerate(seen, 1)]


def _ways(x: Lines, base: int | None, iva: int | None, total: int | None, codes: list, numbered: list) -> Iterator[tuple[str, list, list[int | None]]]:
    """(origen, items, their amounts) of the ways in their order; each is worked out when the ones before didn't settle it."""
    columns = None
    for k, found in enumerate((codes, numbered)):
        if found:
            if k == 0:
                yield "bloque", found, [block_price(x, at) for *_, at in found]
            if columns is None:
                columns = column_prices(x, base, total, {len(y) for y in (codes, numbered) if y}) or []
            if len(columns) == len(found):
                yield "columna", found, columns
    beside = trailing_amounts(x)
    if any(y[3] == 0 or y[3] not in (base, iva, total) for y in beside):
        yield "linea", beside, [y[3] for y in beside]


def find(t: str | None, base: int | None, iva: int | None, total: int | None) -> list[tuple[int, str | None, str, int | None, str]]:
    """(orden, codigo, nombre, importe, origen) of a text's items: the first way that adds up to the total, else the first that does to the base, else names without amounts; see `items.find_items`."""
    x = lines_of(t)
    codes, numbered = reference_pairs(x, x.region), numbered_lines(x)
    second = None
    for name, found, amounts in _ways(x, base, iva, total, codes, numbered):
        s = _sum(amounts)
        if s is not None:
            if total is not None and abs(s - total) <= LINE_TOLERANCE:
                break
            if second is None and base is not None and abs(s - base) <= LINE_TOLERANCE:
                second = name, found, amounts
    else:
        if second is None:
            return [(y[0], y[1], y[2], None, "nombre") for y in codes or numbered]
        name, found, amounts = second
    return [(y[0], y[1], y[2], a, name) for y, a in zip(found, amounts)]


def priced_codes(t: str | None) -> list[tuple[int, str, str, int | None, int | None]]:
    """(orden, codigo, nombre, importe, iva_tipo) of the names with a code whose block has a price: the block's last one, and the least legal rate among them. The whole text is looked at."""
    x, out = lines_of(t), []
    for order, code, name, at in reference_pairs(x, 0):
        found = block(x, at)
        if "P" in x.kinds[found]:
            prices = [v for k, v in zip(x.kinds[found], x.values[found]) if k == "P"]
            out.append((order, code, name, prices[-1], min((p // 100 for p in prices if p in _RATES_C), default=None)))
    return out


def _lists(of_row, kind: T.ArrayType, *columns: pa.Array) -> pa.Array:
    """The lists of tuples that a function gives for each row of the columns."""
    types = [pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in kind.elementType.fields]
    rows, ends = [], [0]
    for x in zip(*(c.to_pylist() for c in columns)):
        rows += of_row(*x)
        ends.append(len(rows))
    values = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(types), types)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, kind.elementType.names))


def found_items(t: Column, base: Column, iva: Column, total: Column) -> Column:
    """Array of a text's items."""
    def run(texts: pa.Array, bases: pa.Array, ivas: pa.Array, totals: pa.Array) -> pa.Array:
        return _lists(find, ITEM, texts, bases, ivas, totals)

    return F.arrow_udf(run, ITEM)(t, *[c.cast("bigint") for c in (base, iva, total)])


def block_items(t: Column) -> Column:
    """Array of a text's names with codes and the prices of their blocks."""
    def run(texts: pa.Array) -> pa.Array:
        return _lists(priced_codes, BLOCK, texts)

    return F.arrow_udf(run, BLOCK)(t)
