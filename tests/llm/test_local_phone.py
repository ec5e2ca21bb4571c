"""Phone numbers with other numbers beside them, against brute force."""

import random

import pytest

from tempora.llm import pii, registry

RNG = random.Random(7)


@pytest.mark.parametrize(("text", "said"), [
    ("call 555-123-4567 555-987-6543", ["555-123-4567", "555-987-6543"]), ("tel 2. 555-123-4567", ["555-123-4567"]), ("phone: 555-123-4567 24 hours", ["555-123-4567"]),
    ("móvil 555-123-4567", ["555-123-4567"]), ("MÓVIL (555) 123-4567", ["(555) 123-4567"]), ("movil 555-123-4567", ["555-123-4567"]),
    ("tel.555-123-4567", ["555-123-4567"]), ("call 555-123-4567-", ["555-123-4567"]), ("call ((555) 123-4567)", ["(555) 123-4567"]),
    ("call 1-555-123-4567", []), ("call 555-123-45678", []), ("call 555-123-4567-8", []), ("tel 2.555-123-4567", []), ("call 555-123-4567 é", ["555-123-4567"]),
])
def test_numbers_beside_others(text, said):
    assert [text[s:e] for s, e, kind, _ in pii.find_spans(text) if kind == "local_phone"] == said


def brute(text):
    """All places where the ten digits stand in one of the forms and no digit is joined to them."""
    out = []
    for s in range(len(text)):
        for shape in ("ddd-ddd-dddd", "(ddd)ddd-dddd", "(ddd) ddd-dddd"):
            said = text[s : s + len(shape)]
            if len(said) < len(shape) or any(not (c in "0123456789" if w == "d" else c in "-. " if w == "-" else c == w) for c, w in zip(said, shape, strict=True)):
                continue
            before, after = text[max(0, s - 2) : s], text[s + len(shape) : s + len(shape) + 2]
            joined = before[-1:] in set("0123456789+") or (len(before) == 2 and before[0] in "0123456789" and before[1] in ".-")
            joined |= after[:1] in set("0123456789") or (len(after) == 2 and after[0] == "-" and after[1] in "0123456789")
            if not joined:
                out.append((s, s + len(shape)))
    return out


def test_runs_of_numbers():
    parts = ["555-123-4567", "(555) 123-4567", "(555)123 4567", "555.123.4567", "24", "7", " ", "-", ".", ") ", "+", "x"]
    found = 0
    for _ in range(4000):
        text = "".join(RNG.choice(parts) for _ in range(RNG.randint(1, 6)))
        assert [m.span() for m in pii._LOCAL_PHONE.finditer(text)] == brute(text), text
        found += len(brute(text))
    assert found > 1000


def test_query_and_redaction(spark, documents, folder):
    docs = documents([(1, "call 555-123-4567 555-987-6543"), (2, "móvil 555-123-4567")])
    got = {r.doc_id: r.spans for r in registry.op7_personal_data(spark, folder(documents=docs)).collect()}
    assert got == {1: "local_phone:5:17,local_phone:18:30", 2: "local_phone:6:18"}
    assert {r.doc_id: r.text for r in pii.redact_documents(docs).collect()} == {1: "call [LOCAL_PHONE] [LOCAL_PHONE]", 2: "móvil [LOCAL_PHONE]"}
