import pytest
from pyspark.sql import functions as F

from tempora.operators import segments as S

SEG = "k int, id int, start double, end double, text string"


def merged(spark, rows):
    df = spark.createDataFrame([(1, i, s, e, t) for i, (s, e, t) in enumerate(rows)], SEG)
    array = F.transform(F.array_sort(F.collect_list(F.struct("id", "start", "end", "text"))), lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text")))
    folded = [(r.start, r.end, r.text) for r in df.groupBy("k").agg(array.alias("a")).select(F.inline(S.merge_paragraphs(F.col("a")))).collect()]
    grouped = [(r.start, r.end, r.text) for r in S.merge_paragraphs_of(df, ["k"], "id").orderBy("id").collect()]
    assert folded == grouped
    return folded


def test_paragraphs_break_at_pauses_endings_and_length(spark):
    assert merged(spark, [(0.0, 1.0, "a"), (6.0, 7.0, "b"), (12.1, 13.0, "c")]) == [(0.0, 7.0, "a b"), (12.1, 13.0, "c")]
    assert merged(spark, [(0.0, 1.0, "Yes."), (1.0, 2.0, "no"), (2.0, 3.0, "wait,"), (3.0, 4.0, "more！"), (4.0, 5.0, "x")]) == [(0.0, 1.0, "Yes."), (1.0, 4.0, "no wait,more！"), (4.0, 5.0, "x")]
    assert merged(spark, [(0.0, 1.0, "y" * 65), (1.0, 2.0, "z")]) == [(0.0, 1.0, "y" * 65), (1.0, 2.0, "z")]
    assert merged(spark, [(0.0, 1.0, "y" * 64), (1.0, 2.0, "z")]) == [(0.0, 2.0, "y" * 64 + " z")]


ITEMS = lambda *tokens: [(t, float(i), i + 0.5) for i, t in enumerate(tokens)]


@pytest.mark.parametrize(("text", "tokens", "want"), [
    ("Stop, thief.", ["Stop,", " thief."], ["Stop,", "thief."]),
    ("It is p.m. Go home.", ["It", "is", "pm", "Go", "home"], ["It is p.m.", "Go home."]),
    ("Who?! “Me.”", ["Who", "Me"], ["Who?!", "“Me.”"]),
    ("well-to-do", ["welltodo"], ["well-to-do"]),
    ("2.71", ["271"], ["2.71"]),
    ("!?", [], []),
])
def test_sentences_follow_tokens(text, tokens, want):
    assert [s["text"] for s in S.sentence_segments(text, ITEMS(*tokens))] == want


@pytest.mark.parametrize(("text", "tokens"), [("a b", ["a"]), ("a", ["a", "b"]), ("a b", ["b", "a"]), ("a", [""]), ("a", ["A"])])
def test_tokens_that_do_not_fit(text, tokens):
    with pytest.raises(S.AlignmentError):
        S.sentence_segments(text, ITEMS(*tokens))


def test_ends_are_clamped():
    assert S.sentence_segments("a", [("a", 0.0, 1.0006)], duration=1.0004)[0]["end"] == 1.0004


def test_alignment_udf_keeps_errors_as_rows(spark):
    kind = "text string, items array<struct<text:string,start:double,end:double>>"
    rows = [("Hi. You", [("Hi", 0.0, 1.0), ("You", 1.0, 2.0)]), ("x", [("y", 0.0, 1.0)])]
    got = spark.createDataFrame(rows, kind).select(S.align_sentences("text", "items").alias("r")).select("r.*").collect()
    assert [s.text for s in got[0].segments] == ["Hi.", "You"] and got[0].error is None
    assert got[1].segments is None and "token 0" in got[1].error


def test_words(spark):
    df = spark.createDataFrame([(1, 0, "a", 0.0, 1.0), (1, 1, "b", 1.0, 2.05), (2, 0, "c", 0.0, 3.0)], "k int, n int, text string, start double, end double")
    got = {(r.k, r.n): r.end for r in S.clip_last(df, ["k"], "n", F.lit(2.0)).collect()}
    assert got == {(1, 0): 1.0, (1, 1): 2.0, (2, 0): 3.0}
    assert [r.end for r in S.clamp_to(df, F.lit(1.5)).orderBy("k", "n").collect()] == [1.0, 1.5, 1.5]
    holes = spark.createDataFrame([(None, 0.12345, 1.0), ("x", None, 1.0)], "text string, start double, end double")
    assert [tuple(r) for r in S.valid_words(holes).collect()] == [("", 0.123, 1.0)]
    nested = spark.createDataFrame([(1, [([("a", 0.0)],), ([("b", 1.0), ("c", 2.0)],)])], "k int, segments array<struct<words:array<struct<text:string,start:double>>>>")
    assert [(r.segment_no, r.word_no, r.text) for r in S.flatten_words(nested).collect()] == [(0, 0, "a"), (1, 0, "b"), (1, 1, "c")]
    halves = spark.createDataFrame([(1.0005,), (2.675,), (None,)], "x double")
    assert [r[0] for r in halves.select(S.round_half_even_3("x")).collect()][:2] == [round(1.0005, 3), round(2.675, 3)]


def test_clean_segments_renumber(spark):
    df = spark.createDataFrame([(1, 5, " a  b "), (1, 6, "　"), (1, 9, "c")], "k int, n int, text string")
    assert [(r.id, r.text) for r in S.clean_segments(df, ["k"], ["n"]).orderBy("id").collect()] == [(0, "a b"), (1, "c")]
