"""Queries over conversations take whole turns, held against brute force on small fixtures."""

import re
import unicodedata

import pytest

from tempora.plans import catalog

TURNS = [
    (1, 0, "one two three four five six seven eight nine ten"),
    (1, 1, "this turn goes on, past sixty-four characters, before it comes to\tits  end"),
    (1, 2, "a full stop stands far behind the first words."),
    (1, 3, "so this opens a paragraph,"),
    (1, 7, "and a pause this one"),
    (2, 0, "  \x00 "),
    (2, 1, "word " * 300 + "last."),
    (2, 2, "tail"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("turns")
    spark.createDataFrame([(c, t, "user", x) for c, t, x in TURNS], "conv_id long, turn int, role string, text string").write.parquet(f"file://{path}/conversations.parquet")
    return f"file://{path}"


def brute_paragraphs():
    """(conv_id, id, start, end, text), by a plain loop."""
    out = []
    for conv in sorted({c for c, _, _ in TURNS}):
        merged, text, begin, end = [], "", 0.0, 0.0
        for c, turn, said in sorted(TURNS):
            line = " ".join(re.sub(r"[\x00-\x1f\x7f-\x9f]+", " ", said).split())[:1024]
            if c != conv or not line:
                continue
            if text and turn * 10.0 - end > 5:
                merged.append((begin, end, text))
                text = ""
            if text:
                text += ("" if unicodedata.category(text[-1]).startswith("P") else " ") + line
            else:
                begin, text = turn * 10.0, line
            end = turn * 10.0 + 4 + turn % 4
            if text[-1] in "。！？.!?" or len(text) > 64:
                merged.append((begin, end, text))
                text = ""
        if text:
            merged.append((begin, end, text))
        out += [(conv, i, *p) for i, p in enumerate(merged)]
    return out


def test_paragraphs_hold_whole_turns(spark, folder):
    got = [(r.conv_id, r.id, r.start, r.end, r.text) for r in catalog.paragraph_merge(spark, folder).collect()]
    assert sorted(got) == brute_paragraphs()


def test_markdown_holds_whole_turns(spark, folder):
    clock = lambda s: f"{int(s) // 3600:02d}:{int(s) // 60 % 60:02d}:{int(s) % 60:02d}"
    got = {r.conv_id: r.content for r in catalog.markdown_render(spark, folder).collect()}
    assert set(got) == {1, 2}
    for conv, content in got.items():
        lines = [f"[{clock(s)} - {clock(e)}] {t}" for c, _, s, e, t in brute_paragraphs() if c == conv]
        assert content == f"## metadata\n\ntitle: Conversation {conv}\nsource: conversations\n\n## transcript text\n\n" + "\n".join(lines) + "\n"


def test_concatenation_holds_whole_turns(spark, folder):
    got = {r.conv_id: r.text for r in catalog.concatenated_text(spark, folder).collect()}
    clean = lambda x: " ".join(re.sub(r"[\x00-\x1f\x7f-\x9f]+", " ", x).split())
    assert got == {conv: " ".join(clean(x) for c, _, x in sorted(TURNS) if c == conv) for conv in (1, 2)}
    assert len(got[2]) > 1505
