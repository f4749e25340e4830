"""What queries must not do as their tables grow, and that the shorter ways find the same."""

import glob
import os
import tempfile

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import frames as FR
from folioforge.plans import catalog


def test_patterns_of_frames_stand_once_and_letters_of_odd_case_are_found(spark):
    texts = ["gİao hàng 5 uſd", "BÊN A phải thanh toán 7 VND khı nghıệm thu", "plain prose without any of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = FR.extract_frames(df, ["i"], {})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count(FR._DEADLINE) <= 8 and 0 < plan.count(FR._MONEY) <= 8
    slots = {r["i"]: r["slots"] for r in got.collect()}
    assert slots[0]["amount"]["value"] == "5" and slots[0]["unit"]["value"] == "money"
    assert slots[1]["action"]["value"] == "PAY" and slots[1]["actor"]["value"] == "A" and slots[1]["temporal_trigger"]["value"] == "ACCEPTANCE"
    assert slots[2]["action"]["value"] is None and FR.extract_frames(df, ["i"], {}).count() == 3


def test_line_quality_equals_its_parts(spark, sf):
    odd = ["", " ", "the of and x@y.z http://a/ien www.ien.vn", "hop dong tiền nguoi nhiem quyen nghiêng khoản điều bên", "gIen quien iet uon tien ℂa 𝐀b ǅa İi ıe ſo ñgh THE Of trường 中文", "a b tieng viet khong dau thi sao hop dong nay", "tiền hợp đồng quyền lợi nghĩa vụ trách nhiệm bên này phải"]
    texts = spark.createDataFrame([(x,) for x in odd] + [(None,)], "line string")
    lines = texts.unionByName(spark.read.parquet(f"{sf}/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line")))
    parts = T.line_issues(F.col("line")).alias("i"), T.diacritic_density(F.col("line")).alias("d"), F.char_length(F.regexp_replace("line", T._ALLOWED, "")).alias("bad")
    got = T.line_quality(lines, "line")
    both = got.select("*", *parts)
    bad = F.when(F.char_length("line") == 0, 0.0).otherwise(F.col("bad") / F.char_length("line"))
    assert both.where(~(F.col("i").eqNullSafe(F.col("issues")) & F.col("d").eqNullSafe(F.col("density")) & bad.eqNullSafe(F.col("garbage")))).count() == 0
    assert {x for r in got.select(F.explode("issues")).collect() for x in r} == {"FOREIGN_LETTERS", "LOW_DIACRITIC_DENSITY", "MISSING_VOWEL_MODIFIER", "INVALID_SYLLABLES"}
    # the line's words stand in the plan once, however often they are asked
    assert catalog.QUERIES["reading_issues"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().count(r"(\p{L}{2,})") <= 3


def test_written_tables_leave_no_shuffle_behind(spark):
    from folioforge.sources import shared

    def bytes_of_shuffles():
        return sum(os.path.getsize(os.path.join(d, f)) for top in glob.glob(os.path.join(tempfile.gettempdir(), "blockmgr-*")) for d, _, names in os.walk(top) for f in names if f.startswith("shuffle_"))

    before = spark.conf.get(shared.CLEANUP, None)
    held = bytes_of_shuffles()
    out = shared.written(spark.range(300_000).select(F.xxhash64("id").alias("k")).groupBy("k").count(), "shuffled")
    assert bytes_of_shuffles() - held < 1_000_000 and spark.conf.get(shared.CLEANUP, None) == before and out.count() == 300_000
