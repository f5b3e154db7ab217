"""Text functions against str methods, routing golden cases."""

from pyspark.sql import functions as F

from askbase.functions import text as TX
from askbase.operators import routing as R


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"x {typ}").select(expr("x").alias("y")).first().y


def test_lower_matches_python(spark):
    for s in ["TARİH", "YARIN", "Bugün Hangi Gün", "ÇĞİÖŞÜ"]:
        assert one(spark, TX.casefold_lower, s) == s.lower()
    assert one(spark, lambda c: TX.casefold_lower(c, turkish=True), "TARİH YARIN") == "tarih yarın"


def test_strip_matches_python(spark):
    for s in ["  a b \t", " x ", "\x0bq\x1c", "", "   "]:
        assert one(spark, TX.strip_text, s) == s.strip()


def test_utf8_clean_drops_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray("şık".encode()),)], "b binary")
    got = [r.y for r in df.select(TX.utf8_clean(F.col("b").cast("string")).alias("y")).collect()]
    assert got == [b"a\xffb".decode("utf-8", errors="ignore"), "şık"]


def test_tokenize_clean(spark):
    assert one(spark, lambda c: F.array_join(TX.tokenize_clean(c), "|"), "Merhaba, dünya! Nasılsın?") == \
        "merhaba|dünya|nasılsın"


GOLDEN = [
    ("yarın saat kaç", "web", "time"),          # rule order: time before tomorrow
    ("tarihçe nedir", "web", "date"),           # raw substring, no word boundary
    ("TARİH", "web", None),                      # dotted capital I does not hit 'tarih'
    ("bugün yemekte ne var", "web", "meal"),
    ("yemek", "web", None),                      # bare word only in the local profile
    ("yemek", "local", "meal"),
    ("bugün günlerden ne", "web", "weekday"),
    ("bugün hangi gün", "web", "date"),
    ("yarın hangi gün", "web", "tomorrow"),
    ("small ring", "web", None),
]


def test_route_golden(spark):
    texts = spark.createDataFrame(sorted({(t,) for t, _, _ in GOLDEN}), "text string")
    rows = R.route_profiles(texts, (R.WEB, R.LOCAL)).collect()
    table = {(r.text, r.profile): r.route for r in rows}
    for t, p, want in GOLDEN:
        assert table[(t, p)] == want, (t, p)
