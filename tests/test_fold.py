from __future__ import annotations

import unicodedata

from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import funnel


def test_fold_is_identity_text_but_for_what_nfkc_makes_longer(spark):
    words = ["ＡＩ赋能", "ＣＮ", "cn", "①②", "ｶﾞ", "Ünï－Code", "a　b", "𝔘𝔫𝔦", "plain", "", None, "Ⅻ", "x²", "東京（都）"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", text.fold(F.col("t")).alias("a"), text.identity_text(F.col("t")).alias("b")).collect()
    longer = {w for w in words if w and any(len(unicodedata.normalize("NFKC", c)) > 1 for c in w) or w == "ｶﾞ"}
    assert longer == {"ｶﾞ", "Ⅻ"} and all(r.a == r.b for r in rows if r.t not in longer)
    assert {r.t: r.a for r in rows}["ＡＩ赋能"] == "ai赋能" and {r.t: r.a for r in rows}["①②"] == "12"


def test_full_width_spellings_decide_as_narrow_ones(spark):
    rows = spark.createDataFrame([(["ＣＮ", "Ａ－Ｂ"], ["cn", "a b", "c"]), (["ＣＮ"], ["us"])], "needed array<string>, owned array<string>")
    assert [r.f for r in rows.select(funnel.fit(F.col("needed"), F.col("owned")).alias("f")).collect()] == ["pass", "conflict"]
