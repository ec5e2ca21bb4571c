import gzip
import random

import pytest
from pyspark.sql import functions as F

from tempora.llm import registry, warc
from tempora.llm import sql as S
from tests.oracle import DATA, assert_same

PAGES = "page_id long, url string, html string"


def rows(seed=1, n=120):
    rng = random.Random(seed)
    bodies = ["", "same", "é ü\r\n\r\nWARC/1.1\r\n", *("x" * rng.randint(0, 3000) + str(i) for i in range(40))]
    urls = [f"http://www.h{rng.randint(0, 5)}.example.com/a?b={rng.randint(0, 3)}" for _ in range(30)]
    return [(i, rng.choice(urls), rng.choice(bodies)) for i in range(n)] + [(500, None, None), (501, "", ""), (502, "http://x.y/a b\té#f", "same"), (None, "http://x.y/", "same"), (7, "http://x.y/", "twice")]


def check(out, data):
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    assert len(out) == len(data)
    want = sorted(((i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if first.get(h or "") in (i, None) else "revisit") for i, _, h in data), key=repr)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in out), key=repr) == want
    digests = {warc.base32_sha1(k.encode()): v for k, v in first.items()}
    assert all(r.refers_to == (digests[r.payload_digest] if r.record_type == "revisit" else None) for r in out)
    order = sorted(out, key=lambda r: r.history_order)
    assert [(r.url_key.encode(), r.captured_at, str(r.page_id or "").encode()) for r in order] == sorted((r.url_key.encode(), r.captured_at, str(r.page_id or "").encode()) for r in out)


@pytest.mark.parametrize(("fan_in", "per_range", "parts"), [(128, 10_000, 4), (2, 10, 7), (3, 1, 5)])
def test_archives_come_back_in_order(spark, fan_in, per_range, parts):
    data = rows()
    df = spark.createDataFrame(data, PAGES).withColumn("payload", F.lit("clash")).repartition(parts)
    check(warc.archive_and_read(df, fan_in=fan_in, range_captures=per_range).collect(), data)


def test_one_url_is_dealt_over_ranges(spark):
    data = [(i, "http://one/", str(i)) for i in range(300)]
    out = warc.archive_and_read(spark.createDataFrame(data, PAGES).repartition(4), range_captures=20).collect()
    check(out, data)
    assert len({r.history_order >> 40 for r in out}) > 8


def test_empty_table(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).collect() == []


def test_small_payloads_stay_responses(spark):
    data = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")]
    out = warc.archive_and_read(spark.createDataFrame(data, PAGES), min_revisit_bytes=3).collect()
    assert {r.page_id: r.record_type for r in out} == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_files_are_archives(spark, tmp_path):
    warc.archive_and_read(spark.createDataFrame(rows(), PAGES), folder=f"file://{tmp_path}/w").collect()
    archives = list((tmp_path / "w").glob("*.warc.gz"))
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in archives)
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ") and whole.endswith(b"\r\n\r\n")
    assert whole.count(b"WARC-Record-ID: <urn:tempora:") == len(rows()) and whole.count(b"WARC-Record-ID: <urn:tempora:none>") == 1


def test_record_round_trip_and_damage():
    record = warc.Record("5", "http://a/", 86400, b"\r\n\r\nbody", warc.base32_sha1(b"\r\n\r\nbody"), 8, "response")
    assert warc.read_record(warc.write_record(record)) == record
    record.digest = warc.base32_sha1(b"other")
    with pytest.raises(ValueError, match="digest"):
        warc.read_record(warc.write_record(record))


def test_loser_tree():
    rng = random.Random(3)
    for k in range(9):
        runs = [sorted(rng.randint(0, 50) for _ in range(rng.randint(0, 30))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize(("url", "key"), [
    ("HTTP://User@WWW.Example.COM:80/A?b=C#d", "com,example)/a?b=c"), ("https://h:443", "h)"), (None, ")"), ("no scheme/p", "no%20scheme)/p"),
])
def test_url_keys(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").select(warc.url_key(F.col("u"))).first()[0] == key


def test_query_equals_sql(spark):
    assert_same(spark, registry.op6_warc, S.ORACLES["op6_warc"], DATA)


ODD = ["", "a\tb", "a\nb", "a", "a\x01b", "%41", "=", "é ü", None, "\x00", "a/b"]


@pytest.mark.parametrize("per_range", [10_000, 2])
def test_ids_and_urls_of_any_characters(spark, per_range):
    urls = ["http://x.y/a b\té", "http://x.y/%41é", "", None, "no scheme\n", "http://x.y/?q=<>"]
    data = [(i, urls[k % len(urls)], "same" if k % 2 else f"own {k}") for k, i in enumerate(ODD)]
    df = spark.createDataFrame(data, "page_id string, url string, html string").repartition(3)
    out = warc.archive_and_read(df, range_captures=per_range).collect()
    assert sorted(((r.page_id, r.url) for r in out), key=repr) == sorted(((i, u) for i, u, _ in data), key=repr)
    same = [r for r in out if r.payload_bytes == 4]
    first = min((i for i, _, h in data if h == "same" and i is not None), key=str.encode)
    assert {r.refers_to for r in same if r.record_type == "revisit"} == {first} and sum(r.record_type == "response" for r in same) == 1
    order = [(r.url_key, r.captured_at, r.page_id) for r in sorted(out, key=lambda r: r.history_order)]
    assert order == sorted(order, key=lambda k: (k[0].encode(), k[1], k[2] is not None, (k[2] or "").encode()))


def test_an_empty_id_is_a_response_like_any_other(spark):
    out = {r.page_id: r for r in warc.archive_and_read(spark.createDataFrame([("", "u", "twin"), ("b", "u", "twin")], "page_id string, url string, html string")).collect()}
    assert out[""].record_type == "response" and out["b"].refers_to == ""


def test_escapes_sort_as_their_texts():
    rng = random.Random(5)
    texts = ["".join(rng.choice("\x00\x01\t\n\x0b !a") for _ in range(rng.randint(0, 4))) for _ in range(400)]
    assert [warc._plain(x) for x in sorted(map(warc._escaped, texts))] == sorted(texts)
    assert not any(c in b"\t\n" for t in texts for c in warc._escaped(t))


def test_many_groups_and_a_hot_one_without_a_broadcast_of_all(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_SHARE", 4)
    data = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else f"pair {i // 4}") for i in range(240)]
    df = spark.createDataFrame(data, PAGES)
    real = warc.write_archives
    monkeypatch.setattr(warc, "write_archives", lambda *a, **k: real(*a, **k, broadcast_bytes=0))
    check(warc.archive_and_read(df).collect(), data)


def test_long_payloads_and_few_open_archives(spark, monkeypatch):
    data = [(i, f"http://h/{i % 3}", f"{i}" * (3_000_000 if i < 2 else 10)) for i in range(40)]
    check(warc.archive_and_read(spark.createDataFrame(data, PAGES).repartition(8), range_captures=7).collect(), data)
    archives = warc.Archives("file:///tmp")
    monkeypatch.setattr(warc, "OPEN_ARCHIVES", 2)

    class File:
        closed = False

        def read_at(self, n, at):
            return bytes(n)

        def close(self):
            self.closed = True

    made = []
    monkeypatch.setattr(warc, "_open", lambda uri: (type("Fs", (), {"open_input_file": lambda self, path: made.append(File()) or made[-1]})(), uri))
    for name in "abcabc":
        assert archives.member(name, 0, 5) == bytes(5)
    assert sum(not f.closed for f in made) == 2 and len(archives.ahead) == 2
