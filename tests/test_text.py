"""Text functions and the quality chain against Python's own semantics and hand-made cases."""

import functools
import re
import time
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiloom.functions import era, markdown, normalize, pytext
from lexiloom.operators import quality

TEXTS = ["", " ", "\n", "a\r\nb\rc", "a b c\x85d", "　x\t", "a\n\n", "\x1c\x1d", "x  \n y 　\n", "  "]


def column(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.x for r in rows.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("a \t\n\r\x0b\x0c\x1c\x1e\x85\xa0  　é"), max_size=12), min_size=30, max_size=30))
def test_python_semantics(spark, texts):
    texts = TEXTS + texts
    assert column(spark, texts, pytext.strip) == [t.strip() for t in texts]
    assert column(spark, texts, pytext.splitlines) == [t.splitlines() for t in texts]
    assert column(spark, texts, pytext.is_blank) == [not t or t.isspace() for t in texts]


def test_normalisation_steps(spark):
    got = lambda f, *t: column(spark, t, f)
    assert got(normalize.fractions, "⅒½") == ["1/101/2"]
    assert got(normalize.nfkc, "ﬁ①Ａ", "plain") == ["fi1A", "plain"]
    assert got(normalize.drop_invisible, "a​b﻿­c️⁦") == ["abc⁦"]
    assert got(normalize.drop_controls, "a\x00\x07\t\n\r\x7f\x9fb") == ["a\t\n\rb"]
    assert got(normalize.squeeze_spaces, "      a     b    c\n     ", "a      b") == ["      a    b    c\n     ", "a    b"]
    assert got(normalize.squeeze_newlines, "a\n\n\n\nb") == ["a\n\nb"]
    assert got(normalize.strip_line_ends, "a 　\nb\t\n") == ["a\nb"]
    assert got(normalize.drop_noise, "中é€Ж가𝒜🙂々〇文") == ["中文"]
    assert got(normalize.half_width, "ＡＢ！～") == ["AB!~"]
    assert got(normalize.punctuation, "a...b.c 3.14 5. x.5 (y)?‼") == ["a……b。c 3.14 5. x.5 （y）？！！"]
    assert got(normalize.quotes, "\"a\" 'b' \"c") == ["“a” ‘b’ “c"]
    assert got(lambda c: normalize.simplified(c, {"國": "国"}), "國家") == ["国家"]
    assert got(normalize.normalize, "  ⅒℃…​\n\n\n\n文\"x\"") == ["1/10°C……\n\n文“x”"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=40), min_size=20, max_size=20))
def test_clean_texts_hold_no_noise(spark, texts):
    noise = re.compile("[" + "".join(f"\\U{int(a, 16):08x}-\\U{int(b, 16):08x}" for r in normalize.NOISE.split() for a, b in [r.split("-")]) + "]")
    for t in column(spark, texts, lambda c: normalize.drop_noise(normalize.nfkc(c))):
        assert not noise.search(t)


@pytest.mark.parametrize(
    ("text", "code"),
    [
        ("中" * 19 + "文" + ("中国人" * 60), ""), ("中" * 21 + "文国" * 100, "repeated_chars"), ("短", "too_short"), ("中文人" * 40000, "too_long"), ("abcdef " * 40, "chinese_ratio"), ("中文\n" * 80, "duplicate_lines"),
        ("请关注我们" + "中国人" * 70, "block_pattern_matched"), ("中国人" * 70 + " Copyright © x", "block_pattern_matched"),
    ],
)
def test_first_failing_check(spark, text, code):
    row = quality.clean(spark.createDataFrame([(text,)], "text string")).first()
    assert row.fail_code == code and row.passed == (code == "") and (row.clean_text == "") == (code != "")


def test_bounds(spark):
    config = quality.CleanConfig(min_chars=3, max_chars=5, min_chinese_ratio=0.5, block_patterns=())
    rows = spark.createDataFrame([("中a文",), ("中文",), ("ab文",), ("中文人国大小",), (None,)], "text string")
    assert [r.fail_code for r in quality.clean(rows, config=config).collect()] == ["", "too_short", "chinese_ratio", "too_long", "too_short"]
    reasons = quality.clean(rows, config=config).select(quality.reason_text(F.when(F.col("fail_code") != "", F.struct(F.col("fail_code").alias("code"), F.col("fail_value").alias("value"))), config).alias("r")).collect()
    assert [r.r for r in reasons] == ["", "too_short: 2 < 3", "chinese_ratio: 0.333 < 0.5", "too_long: 6 > 5", "too_short: 0 < 3"]


def test_noise_ratio_is_exact(spark):
    texts = ["a" * 49 + "", "a" * 48 + "", "͸" + "a" * 10, "𞓐" * 10, "\n\t"]
    want = [sum(unicodedata.category(c) in ("Cc", "Cs", "Co", "Cn") and c not in "\n\t" for c in t) / len(t) for t in texts]
    assert column(spark, texts, lambda c: quality.noise_ratio(c, 0.02)) == pytest.approx(want)


def test_markdown_and_han(spark):
    text = "# T\n```x\ny```a `b` ![i](u) [l](u) **b** _e_\n---\n|c|"
    want = text
    for p, r, f in ((r"```[\s\S]*?```", " ", 0), (r"`[^`]+`", " ", 0), (r"^#{1,6}\s+", "", re.M), (r"!\[.*?\]\(.*?\)", " ", 0), (r"\[.*?\]\(.*?\)", " ", 0), (r"[*_]{1,3}", "", 0), (r"^[-*_]{3,}\s*$", " ", re.M), (r"\|", " ", 0)):
        want = re.sub(p, r, want, flags=f)
    assert column(spark, [text], markdown.strip_markdown) == [want]
    assert column(spark, ["一二三a四"], markdown.han_segments) == [["一二三", "四"]]
    assert column(spark, ["一二三", "四"], lambda c: markdown.char_ngrams(c, 2, 3)) == [["一二", "二三", "一二三"], []]
    assert column(spark, ["中", "a", "𠀀", "豈"], markdown.is_han) == [True, False, True, True]


def test_eras(spark):
    texts = ["天正10年6月2日（1582年6月21日）", "明治1年13月32日", "慶長５年９月15日", "112月", "明治100年", "2020年"]
    want = ["天正十年六月二日（1582年6月21日）", "明治元年13月32日", "慶長五年九月十五日", "112月", "明治100年", "2020年"]
    assert column(spark, texts, lambda c: era.normalize(c, ["天正", "明治", "慶長"])) == want
    assert column(spark, ["明治1年"], lambda c: era.normalize(c, ["明治"], False)) == ["明治一年"]
    assert [era.chinese(n) for n in (1, 10, 11, 20, 99)] == ["一", "十", "十一", "二十", "九十九"]
    with pytest.raises(ValueError):
        era.pattern([""])


def test_white_space_in_one_pass(spark):
    """Every character as Python sees it, and a run of blanks that ends in none of the places isn't tried from each of its characters."""
    texts = [chr(c) + "a" + chr(c) for c in range(0x3100)]
    assert column(spark, texts, pytext.strip) == [t.strip() for t in texts]
    assert column(spark, [t[0] for t in texts], pytext.is_blank) == [t[0].isspace() for t in texts]
    long = "a" + "\t" * 300_000 + "b"
    start = time.time()
    assert column(spark, [long], normalize.strip_line_ends) == [long] and column(spark, [long], pytext.strip) == [long]
    assert time.time() - start < 20


def test_fused_steps_are_the_steps(spark):
    texts = ["½ ，。．．a. ‼ ！x．5 𝟎.5", "　​\x00 a      b\r\n \n\n c 　\n ", "\x1fé­", ""]
    steps = (normalize.fractions, normalize.nfkc, normalize.drop_invisible, normalize.drop_controls, normalize.plain_spaces, normalize.squeeze_spaces, normalize.squeeze_newlines, normalize.strip_line_ends, pytext.strip, normalize.drop_noise, normalize.half_width, normalize.punctuation, normalize.quotes)
    assert column(spark, texts, normalize.normalize) == column(spark, texts, lambda c: functools.reduce(lambda t, f: f(t), steps, c))


def test_each_measure_is_computed_once(spark):
    plan = quality.clean(spark.createDataFrame([("x",)], "text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_distinct(") == 1 and plan.count("p{Cn}") == 1
