"""HTML extraction (H1-H4) as native column expressions.

Elements are found by one pass over the start and end tags, so elements inside
elements (a table within a cell) stay whole and are elements of their own, in
document order, as a tree parser lists them; the work is linear in the tags.
Comments, scripts and styles are no markup and go first.  An element that is
never closed runs to the end of its parent, and an end tag of nothing open is
ignored.  Character references are decoded
when they end in ``;``: all numeric ones and the names of HTML 4.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

from askbase.functions.text import strip_text


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


NO_MARKUP = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
REFERENCE = r"&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def _quoted(s: str) -> str:
    """A pattern as a Spark SQL literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


#: Names whose tags end each other's elements: an end tag closes what is open inside its element.
TABLE_NAMES = ("table", "tr", "td")
_CHUNK = 192


def _tokens_sql(html: str, names: tuple[str, ...], body: str) -> str:
    """``body`` over the tags of ``names`` in ``html``: ``tags``, ``texts`` (one more: before, between and
    behind them), ``kinds`` (k for a start tag of the k-th name, -k for its end tag) and
    ``ends``: for a start tag the tag at which its element ends, ``size(tags) + 1`` for the end of the input.

    One pass keeps the open elements as a string, innermost first: a start tag puts its
    name's letter in front; an end tag cuts the string behind its letter's first place, which
    ends all that is still open inside, and is ignored if the letter is not there.  An
    element then ends at the first later tag that is less deep, found by sorting starts and
    drops by (depth, place), packed into numbers.  Depths are collected in chunks,
    because growing one array tag by tag copies it each time.
    """
    pat = _quoted(r"(?is)</?(?:" + "|".join(re.escape(n) for n in names) + r")(?=[\s/>])[^>]*>")
    named = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    kinds = (f"transform(tags, t -> IF(startswith(t, '</'), -1, 1) * "
             f"CAST(array_position({named}, lower(regexp_extract(t, '^</?([A-Za-z0-9]+)', 1))) AS INT))")
    top = "element_at(s, -1)"
    letter = "element_at(array('a', 'b', 'c'), abs(k))"
    step = (f"array_append(s, IF(k > 0, concat({letter}, {top}), "
            f"IF(locate({letter}, {top}) > 0, substring({top}, locate({letter}, {top}) + 1), {top})))")
    chunk = f"aggregate(slice(kinds, c, {_CHUNK}), array(c0.open), (s, k) -> {step})"
    depths = (f"concat(array(0), flatten(aggregate(sequence(1, size(kinds), {_CHUNK}), named_struct('open', '', "
              f"'all', CAST(array() AS array<array<int>>)), (c0, c) -> "
              + _let(chunk, "r", "named_struct('open', element_at(r, -1), 'all', array_append(c0.all, "
                                 "transform(slice(r, 2, size(r) - 1), x -> length(x))))") + ").all))")
    wide = 1 << 32
    drops = ("flatten(transform(filter(sequence(1, size(tags)), i -> element_at(depths, i + 1) < element_at(depths, i)), i -> "
             f"transform(sequence(element_at(depths, i + 1) + 1, element_at(depths, i)), d -> d * {wide}L + i * 2L + 1L)))")
    starts = ("transform(filter(sequence(1, size(tags)), i -> element_at(kinds, i) > 0), "
              f"i -> element_at(depths, i + 1) * {wide}L + i * 2L)")
    here, after = "element_at(levels, p)", "coalesce(try_element_at(levels, p + 1), 0L)"
    place = f"shiftright({{}} & {wide - 1}L, 1)"
    ended = (f"transform(filter(sequence(1, greatest(1, size(levels))), p -> p <= size(levels) AND {here} % 2 = 0), p -> "
             f"{place.format(here)} * {wide}L + IF(shiftright({after}, 32) = shiftright({here}, 32), {place.format(after)}, size(tags) + 1L))")
    rest = f"transform(filter(sequence(1, size(tags)), i -> element_at(kinds, i) < 0), i -> i * {wide}L)"
    ends = _let(f"sort_array(concat({starts}, {drops}))", "levels",
                f"transform(sort_array(concat({ended}, {rest})), x -> CAST(x & {wide - 1}L AS INT))")
    inside = _let(f"split({html}, {pat})", "texts", _let(kinds, "kinds", _let(depths, "depths", _let(ends, "ends", body))))
    return _let(f"regexp_extract_all({html}, {pat}, 0)", "tags", f"IF(size(tags) = 0, NULL, {inside})")


def _names(*tags: str) -> tuple[str, ...]:
    return TABLE_NAMES if set(tags) <= set(TABLE_NAMES) else tuple(dict.fromkeys(tags))


def _clean_sql(html: str) -> str:
    return f"regexp_replace({html}, {_quoted(NO_MARKUP)}, '')"


def _first_sql(names: tuple[str, ...], tag: str, cls: str) -> str:
    """Place of the first start tag of ``tag`` whose class list holds ``cls``."""
    c = re.escape(cls)
    has = _quoted(r"(?is)\sclass\s*=\s*(?:\"(?:[^\"]*\s)?" + c + r"(?:\s[^\"]*)?\"|'(?:[^']*\s)?" + c
                  + r"(?:\s[^']*)?'|" + c + r"(?=[\s>]))")
    return (f"try_element_at(filter(sequence(1, size(tags)), i -> element_at(kinds, i) = {names.index(tag) + 1} AND "
            f"regexp_like(element_at(tags, i), {has})), 1)")


def _cells_sql(names: tuple[str, ...], row: str, cell: str, lo: str, hi: str) -> str:
    """Markup of the cells of every row that starts at a tag from ``lo`` to ``hi``."""
    # a cell's pieces lie between its own tag and the one it ends at
    cells = (f"transform(filter(sequence(i, element_at(ends, i) - 1), j -> j > i AND element_at(kinds, j) = {names.index(cell) + 1}), "
             "j -> array_join(slice(texts, j + 1, element_at(ends, j) - j), ''))")
    return (f"transform(filter(sequence({lo}, greatest({lo}, {hi})), i -> i <= {hi} AND element_at(kinds, i) = {names.index(row) + 1}), "
            f"i -> {cells})")


def _texts(rows: Column) -> Column:
    cells = F.transform(rows, lambda r: F.filter(F.transform(r, cell_text), lambda s: s != ""))
    return F.filter(cells, lambda r: F.size(r) > 0)


def html_container(html: str, tag: str, cls: str) -> Column:
    """H1: inner HTML of the first ``<tag>`` whose class list holds ``cls``, null
    when there is none.  ``html``: a column name."""
    names = _names(tag)
    inner = ("concat(element_at(texts, at + 1), array_join(transform(slice(tags, at + 1, element_at(ends, at) - at - 1), "
             "(t, j) -> concat(t, element_at(texts, at + j + 2))), ''))")
    found = _let(_clean_sql("page"), "h", _tokens_sql("h", names, _let(_first_sql(names, tag, cls), "at", f"IF(at IS NULL, NULL, {inner})")))
    # pages that do not hold the word at all are not taken apart
    return F.expr(_let(html, "page", f"IF(contains(page, {_quoted(cls)}), {found}, NULL)"))


def html_container_cells(html: str, tag: str, cls: str, row_tag: str = "tr", cell_tag: str = "td") -> Column:
    """H1 and H2 in one reading of the page; null without the container."""
    names = _names(tag, row_tag, cell_tag)
    rows = _cells_sql(names, row_tag, cell_tag, "at", "element_at(ends, at) - 1")
    found = _let(_clean_sql("page"), "h", _tokens_sql("h", names, _let(_first_sql(names, tag, cls), "at", f"IF(at IS NULL, NULL, {rows})")))
    return _texts(F.expr(_let(html, "page", f"IF(contains(page, {_quoted(cls)}), {found}, NULL)")))


def decode_entities(x) -> Column:
    """Character references as characters; unknown names stay as they are, numbers
    of no character become U+FFFD."""
    # one literal, folded into a map once: hundreds of them would be walked by every rule of the planner
    names = F.str_to_map(F.lit("\x01".join(f"{n}\x02{chr(cp)}" for n, cp in sorted(name2codepoint.items()))), F.lit("\x01"), F.lit("\x02"))

    def one(ref):
        hexed = F.lower(F.substring(ref, 2, 1)) == "x"
        n = F.when(hexed, F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8)).try_cast("bigint")
        valid = (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when(ref.startswith("#"), F.when(valid, char).otherwise("\ufffd")).otherwise(
            F.coalesce(F.try_element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";"))))

    c = _c(x)
    texts = F.split(c, REFERENCE)
    chars = F.transform(F.regexp_extract_all(c, F.lit(REFERENCE), 1), one)
    joined = F.array_join(F.flatten(F.transform(F.arrays_zip(texts.alias("t"), chars.alias("c")), lambda z: F.array(
        z["t"], F.coalesce(z["c"], F.lit(""))))), "")
    return F.when(F.contains(c, F.lit("&")), joined).otherwise(c)


def cell_text(x) -> Column:
    """Text of a fragment: tags removed, references decoded, Unicode-stripped."""
    return strip_text(decode_entities(F.regexp_replace(_c(x), r"<[^>]*>", "")))


def html_rows_cells(container: str, row_tag: str = "tr", cell_tag: str = "td") -> Column:
    """H2: array<array<string>>; blank cells and rows left empty are dropped.
    ``container``: a column name."""
    names = _names(row_tag, cell_tag)
    rows = _tokens_sql(container, names, _cells_sql(names, row_tag, cell_tag, "1", "size(tags)"))
    return _texts(F.expr(f"IF({container} IS NULL, NULL, coalesce({rows}, CAST(array() AS array<array<string>>)))"))


def trim_header_footer(rows) -> Column:
    """H3: drop the first and the last row; fewer than 3 rows -> empty."""
    r = _c(rows)
    return F.slice(r, 2, F.greatest(F.size(r) - 2, F.lit(0)))


def menu_text(rows) -> Column:
    """H4: 'cell0: cell1' per row, newline-joined; [] -> ''."""
    return F.array_join(
        F.transform(_c(rows), lambda r: F.concat(F.try_element_at(r, F.lit(1)), F.lit(": "),
                                                 F.try_element_at(r, F.lit(2)))), "\n")


def menu_error(rows) -> Column:
    """A row with a single cell cannot be formatted (the reference raises)."""
    return F.when(F.exists(_c(rows), lambda r: F.size(r) < 2), F.lit("row with one cell"))
