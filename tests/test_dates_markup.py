"""Date sentences against datetime; menu extraction against html.parser."""

import datetime as dt
import random
import time
from html.parser import HTMLParser

from pyspark.sql import functions as F

from askbase import constants as K
from askbase.functions import calendar as D
from askbase.functions import markup as H
from askbase.operators.menu import daily_menu


def py_sentence(prefix, d):
    return (f"{prefix} {d.strftime('%d')} {K.MONTH_NAMES_TR[d.month - 1]} {d.strftime('%Y')} "
            f"{K.DAY_NAMES_TR.get(d.strftime('%A'), d.strftime('%A'))}")


def test_date_answers_match_datetime(spark):
    stamps = [dt.datetime(2024, 2, 28, 23, 0, 1), dt.datetime(2024, 2, 29, 7, 5, 9), dt.datetime(2023, 12, 31, 12, 0),
              dt.datetime(2025, 6, 30, 0, 0), dt.datetime(2024, 1, 7, 18, 30, 45)]
    df = spark.createDataFrame([(s,) for s in stamps], "ts timestamp_ntz")
    rows = df.select("ts", D.today_sentence("ts").alias("a"), D.weekday_sentence("ts").alias("b"),
                     D.tomorrow_sentence("ts").alias("c"), D.time_string("ts").alias("d")).collect()
    for r in rows:
        assert r.a == py_sentence("Bugün", r.ts)
        assert r.b == py_sentence("Bugün", r.ts) + "."
        assert r.c == py_sentence("Yarın", r.ts + dt.timedelta(days=1))
        assert r.d == r.ts.strftime("%H:%M:%S")


def test_day_name_passthrough(spark):
    df = spark.createDataFrame([("Monday",), ("Funday",)], "d string")
    assert [r.x for r in df.select(D.day_name_tr("d").alias("x")).collect()] == ["Pazartesi", "Funday"]


class _Cells(HTMLParser):
    """Reference-style reading of a menu table with the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.in_table = 0
        self.rows, self.row, self.cell = [], None, None

    def handle_starttag(self, tag, attrs):
        cls = dict(attrs).get("class", "") or ""
        if tag == "table" and "has-background" in cls.split() and not self.in_table:
            self.in_table = 1
        elif self.in_table and tag == "tr":
            self.row = []
        elif self.in_table and tag == "td":
            self.cell = []

    def handle_endtag(self, tag):
        if tag == "table" and self.in_table:
            self.in_table = 0
        elif self.in_table and tag == "td" and self.cell is not None:
            self.row.append("".join(self.cell).strip())
            self.cell = None
        elif self.in_table and tag == "tr" and self.row is not None:
            cols = [c for c in self.row if c]
            if cols:
                self.rows.append(cols)
            self.row = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def py_menu(html):
    p = _Cells()
    p.feed(html)
    if not p.rows and "has-background" not in html:
        return K.MENU_UNAVAILABLE
    return "\n".join(f"{m[0]}: {m[1]}" for m in p.rows[1:-1])


MENU = """<html><body><table class="wp-table has-background"><tr><td>2 Aralık</td></tr>
<tr><td>Çorba</td><td> Mercimek &amp; nane </td></tr><tr><td></td><td>  </td></tr>
<tr><td><b>Ana yemek</b></td><td>Tavuk</td></tr><tr><td>Toplam</td><td>900 kcal</td></tr></table></body></html>"""
SHORT = """<table class="has-background"><tr><td>a</td></tr><tr><td>b</td><td>c</td></tr></table>"""
ONE_CELL = """<table class="has-background"><tr><td>h</td></tr><tr><td>only</td></tr><tr><td>f</td></tr></table>"""
NONE = """<table class="plain"><tr><td>x</td><td>y</td></tr></table>"""


def test_daily_menu_cases(spark):
    df = spark.createDataFrame([(1, MENU), (2, SHORT), (3, ONE_CELL), (4, NONE)], "page_id long, html string")
    out = {r.page_id: r for r in daily_menu(df).collect()}
    assert out[1].menu == py_menu(MENU) == "Çorba: Mercimek & nane\nAna yemek: Tavuk"
    assert out[2].menu == ""                      # fewer than three rows
    assert out[3].menu_error is not None         # one-cell row: reported, not raised
    assert out[4].menu == K.MENU_UNAVAILABLE


HARD = [
    ('<table class=has-background><tr><td>a</td></tr></table>', [["a"]]),
    ("<TABLE id=x CLASS='m has-background'\n><TR><TD>a</TD><TD> &Ccedil;orba: Mercimek &#252;&#x1F600;&nbsp;</TD></TR></TABLE>",
     [["a", "Çorba: Mercimek ü😀"]]),
    ('<!-- <table class="has-background"><tr><td>old</td></tr></table> --><table class="has-background"><tr><td>new</td></tr></table>',
     [["new"]]),
    ('<table class="has-background"><tr><td>o<table><tr><td>i</td><td>j</td></tr></table></td><td>p</td></tr><tr><td>q</td></tr></table>'
     '<table><tr><td>no</td></tr></table>', [["oij", "i", "j", "p"], ["i", "j"], ["q"]]),
    ('<table class="has-background-x"><tr><td>x</td></tr></table><table class="b has-background c"><tr><td>y</td></tr></table>',
     [["y"]]),
    ('<table class="has-background"><tr><td>&unknown; &amp;lt; &#0; a&b</td></tr>', [["&unknown; &lt; \ufffd a&b"]]),
    ('<script>var t = "<table class=has-background>";</script><p>has-background</p>', None),
    ('', None), (None, None), ('<table class="has-background"></table>', []),
]


def test_markup_that_plain_patterns_get_wrong(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(HARD)], "i int, html string")
    box = df.withColumn("box", H.html_container("html", *K.MENU_CONTAINER))
    got = {r.i: r.rows for r in box.select("i", H.html_rows_cells("box").alias("rows")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(HARD)}


class _Tree(HTMLParser):
    """Elements with their nesting, by the rule that an end tag closes everything back to its own start."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.found = [], []

    def handle_starttag(self, tag, attrs):
        if tag in H.TABLE_NAMES:
            e = {"tag": tag, "cls": (dict(attrs).get("class") or "").split(), "up": list(self.open), "text": []}
            self.found.append(e)
            self.open.append(e)

    def handle_endtag(self, tag):
        if any(e["tag"] == tag for e in self.open):
            while self.open.pop()["tag"] != tag:
                pass

    def handle_data(self, data):
        for e in self.open:
            e["text"].append(data)


def tree_cells(html):
    t = _Tree()
    t.feed(html)
    t.close()
    box = next((e for e in t.found if e["tag"] == "table" and "has-background" in e["cls"]), None)
    if box is None:
        return None
    inside = lambda e, up: any(u is up for u in e["up"])
    rows = [e for e in t.found if e["tag"] == "tr" and inside(e, box)]
    out = [[s for c in t.found if c["tag"] == "td" and inside(c, r) and (s := "".join(c["text"]).strip())] for r in rows]
    return [r for r in out if r]


def test_malformed_tables_equal_a_tree_parser(spark):
    rnd = random.Random(7)
    pieces = ["<table class=has-background>", "<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<td class='a'>", "x", "y ", "<b>z</b>",
              "</TD >", "<TR\n>"]
    pages = ["<table class=has-background>" + "".join(rnd.choices(pieces, k=rnd.randrange(2, 40))) for _ in range(400)]
    pages += ["<p>" + "".join(rnd.choices(pieces, k=20)) for _ in range(100)]
    pages += ["<table class=has-background><tr><td>a<td>b<tr><td>c</table>d<tr><td>e", "<td><table class='has-background'><tr><td>a</td></td><tr><td>b"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(4)
    box = df.withColumn("box", H.html_container("html", *K.MENU_CONTAINER))
    got = {r.i: r.rows for r in box.select("i", H.html_rows_cells("box").alias("rows")).collect()}
    assert got == {i: tree_cells(p) for i, p in enumerate(pages)}


def test_reader_is_linear_in_the_rows(spark):
    def page(n):
        return ("<table class=has-background>" + "<tr><td>a</td><td>b</td></tr>" * n + "</table>")

    def seconds(n):
        df = spark.createDataFrame([(n, page(n))], "n int, html string").withColumn("box", H.html_container("html", *K.MENU_CONTAINER))
        start = time.perf_counter()
        assert df.select(F.size(H.html_rows_cells("box")).alias("s")).first()["s"] == n
        return time.perf_counter() - start

    seconds(4000)
    few, many = min(seconds(4000) for _ in range(3)), min(seconds(32000) for _ in range(2))
    assert many < 8 * 3 * max(few, 0.2)      # the square would be 64 times
