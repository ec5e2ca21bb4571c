import json

import pytest
from pyspark.sql import functions as F

from tempora.functions import canonical, text, timecode, urls


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "want"), [("  a\u3000b\n\tc\u00a0 ", "a b c"), ("", ""), ("\u0085", ""), ("x\x1cy", "x y")])
def test_whitespace(spark, raw, want):
    assert one(spark, raw, text.collapse_whitespace) == want


def test_safe_line(spark):
    assert one(spark, "a\x00b\x9f  c\n", text.safe_line) == "a b c"
    assert len(one(spark, "x" * 2000, text.safe_line)) == 1024


@pytest.mark.parametrize(("raw", "want"), [
    ('a<b>:c/d\\e|f?g*h"', "a_b__c_d_e_f_g_h_"), ("  ", "untitled"), ("con", "_con"), ("LPT9", "_LPT9"), ("name. . ", "name"), ("a\n\tb", "a__b"), ("x" * 130, "x" * 120), ("...", "untitled"),
])
def test_file_names(spark, raw, want):
    assert one(spark, raw, text.sanitize_filename) == want


@pytest.mark.parametrize(("raw", "name", "want"), [
    ("中文内容完全正确ab", "x_summary_zh.md", False), ("中文内容完全正确abc", "x_summary_zh.md", True), ("12 34", "x_summary_en.md", True),
    ("[中文](https://example.com/long/path) `code` 中文\n```python\nprint(1)\n```", "x_summary_zh.md", False), ("anything", "x.md", None),
])
def test_summary_language(spark, raw, name, want):
    assert one(spark, raw, lambda c: text.language_mismatch(c, F.lit(name))) is want


def test_summary_errors(spark):
    assert one(spark, "{{title}} <!-- x -->", text.summary_errors) == ["placeholder remains", "template comment remains"]
    assert one(spark, "fine", text.summary_errors) == []


def test_small_text_functions(spark):
    assert one(spark, "id.zh-CN.srt", text.subtitle_language) == "zh-CN"
    assert one(spark, "id.srt", text.subtitle_language) is None
    assert [one(spark, x, text.template_language) for x in ("ai-zh", "zh-Hans", "EN-us", None, "", "fr")] == ["zh", "zh", "en", "en", "en", "fr"]
    assert one(spark, "fr", lambda c: text.summary_template(c, ["zh", "en"])) == "en"
    assert one(spark, "ja", text.model_language) == "Japanese"
    assert one(spark, "xx", text.model_language) is None
    assert one(spark, " a, ,b,", text.listed) == ["a", "b"]
    assert one(spark, "1234", lambda c: text.chunk_key(c.cast("int"))) == "chunk_1234"
    assert one(spark, "HTTP Error 412: x", text.is_blocked_by_server) is True
    assert [one(spark, x, text.is_skippable) for x in (" ", "。", "\u3000", "a", "$")] == [True, True, True, False, False]


@pytest.mark.parametrize(("seconds", "want"), [("0.0004", "00:00:00,000"), ("1.9995", "00:00:02,000"), ("360061.9995", "100:01:02,000"), ("0.0005", "00:00:00,001")])
def test_srt_times_round_half_up(spark, seconds, want):
    assert one(spark, seconds, lambda c: timecode.srt_time(timecode.seconds_to_millis(c))) == want


def test_times(spark):
    assert one(spark, "01:02:03,456", timecode.parse_srt_millis) == 3723456
    assert one(spark, "100:01:02,000", timecode.parse_srt_millis) is None
    assert one(spark, "-5", lambda c: timecode.clock(c.cast("double"))) == "00:00:00"
    assert one(spark, "3661.9", lambda c: timecode.clock(c.cast("double"))) == "01:01:01"
    assert [one(spark, x, lambda c: timecode.format_duration(c.cast("long"))) for x in ("1234", "6504", "372345")] == ["12.34s", "1m 05.04s", "1h 2m 03.45s"]
    assert [one(spark, x, lambda c: timecode.format_elapsed(c.cast("double"))) for x in ("59.999", "61.5", "3723.25")] == ["60.00s", "1m 01.50s", "1h 2m 03.25s"]


@pytest.mark.parametrize(("raw", "want"), [
    ("https://www.bilibili.com/list/watchlater/?bvid=BV1abc&oid=1", "https://www.bilibili.com/video/BV1abc/"),
    ("https://www.bilibili.com/video/BV1abc?p=2&from=x#t", "https://www.bilibili.com/video/BV1abc/?p=2"),
    ("https://www.bilibili.com/video/BV1abc/?p=0", "https://www.bilibili.com/video/BV1abc/"),
    ("https://example.com/other?p=2", "https://example.com/other?p=2"),
])
def test_video_urls(spark, raw, want):
    assert one(spark, raw, urls.canonical_video_url) == want


def test_video_ids(spark):
    assert one(spark, "https://www.bilibili.com/video/BV1abc/?p=2", urls.video_id) == "BV1abc_p2"
    assert one(spark, "https://example.com/", urls.video_id) is None
    assert one(spark, "", lambda c: urls.result_id(c, F.lit("a/b"))) == "a_b"
    assert one(spark, "https://x/video/BV9?p=3", lambda c: urls.source_video_url(c, F.lit("BV9"), F.lit("BV9"))) == "https://www.bilibili.com/video/BV9/?p=3"


def test_canonical_json_ignores_key_order():
    assert canonical.canonical_text({"b": 1, "a": "é"}) == canonical.canonical_text({"a": "é", "b": 1}) == '{"a":"é","b":1}'
    with pytest.raises(ValueError):
        canonical.canonical_text(float("nan"))


@pytest.mark.parametrize(("raw", "ok"), [('{"a": 1}', True), ('{"a":1,"a":2}', False), ('{"a":NaN}', False), ('{"a":1} x', False), ("[1]", False), ('{"a":1e400}', False), (None, False)])
def test_strict_json(spark, raw, ok):
    got = one(spark, raw, canonical.strict_json)
    assert (got is not None) == ok and (not ok or json.loads(got) == {"a": 1})


@pytest.mark.parametrize(("path", "ok"), [("a/b.json", True), ("./a", True), ("../a", False), ("a/../../b", False), ("/a", False), ("C:\\a", False), ("", False), ("a/..", False)])
def test_contained_paths(spark, path, ok):
    assert one(spark, path, canonical.contained_path) is ok


def test_decimals_and_samples(spark):
    from decimal import Decimal

    assert canonical.parse_strict('{"a": 1.10}', decimals=True)["a"] == Decimal("1.10")
    assert spark.range(1).select(timecode.to_seconds(F.lit(24000)), timecode.to_samples(F.lit(1.5))).first()[:] == (1.5, 24000)
