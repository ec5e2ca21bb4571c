"""WARC archives of web pages, with a capture index merged from sorted runs.

Each task sorts its captures by URL key and time, writes them to one archive
(one gzip member per record) and lists them in one sorted index run.  The runs
are then merged by a loser tree over k runs: in passes of ``FAN_IN`` while
there are more, and at last in key ranges, one task each, found by binary
search in the runs.  Ranges split on the whole key (URL, time, id), so even a
single URL with a third of all captures is dealt over many tasks.  A range's
records are read back from the archives in merged order: exactly their bytes,
or a small block ahead where an archive's records follow each other, with a
bounded number of open files.

Payloads stay where they are: records learn of their group by its digest, from
a broadcast where all groups are few or a group holds a thousandth of all rows
(at most a thousand such groups), and for the rest by a join on digests of which
none is frequent.

Of records with equal payloads of at least ``min_revisit_bytes`` the one with
the smallest id is a response, the others are revisits of it.

Files have names of their own for each task attempt, and only the files that a
finished task reports are read, so a lost or repeated task does no harm.

Defined cases: null html is an empty payload; payloads of any length are kept
whole; null URLs have an empty key and no target header, and any URL comes back
as it was; ids may hold any characters, and an empty id is not a null one; a null
id never names a response unless all ids of the group
are null, in which case all are responses; rows that repeat the smallest id
are responses too; ties of URL and time are ordered by id; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import time
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempora.llm.common import materialize, new_path, stored_bytes

FAN_IN = 128
RANGE_CAPTURES = 10_000
SAMPLES = 64
BROADCAST_BYTES = 2 << 20
#: A group with so small a part of the repeated rows is broadcast even where the groups are many.
HOT_SHARE = 1000
READ_AHEAD = 1 << 20
#: Bytes read at once from an archive whose records follow each other, and archives that a task holds open.
BLOCK_AHEAD, OPEN_ARCHIVES = 64 << 10, 256
EPOCH = 1_577_836_800
_URN = "urn:tempora:page:"
_NO_URN = "urn:tempora:none"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: Column) -> Column:
    """Sort-friendly URL: host labels reversed, then path and query, lower case, without scheme, user, port 80/443 or fragment."""
    clean = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[\x00-\x20\x7f]+", "%20"))
    bare = F.regexp_replace(F.regexp_replace(clean, r"#.*$", ""), r"^[a-z][a-z0-9+.\-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^.*@", ""), r":(80|443)$", "")
    path = F.regexp_replace(bare, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(F.regexp_replace(host, r"^www\.", ""), r"\.")), ","), F.lit(")"), path)


@dataclass
class Record:
    """One archive record; ``refers_to`` is the response's id for a revisit."""

    page: str | None
    url: str | None
    seconds: int
    payload: bytes
    digest: str
    payload_bytes: int
    kind: str
    refers_to: str | None = None


def _stamp(seconds: int, form: str) -> str:
    return time.strftime(form, time.gmtime(seconds))


def _urn(page: str | None) -> str:
    return f"<{_NO_URN}>" if page is None else f"<{_URN}{quote(page, safe='')}>"


def _page(urn: str) -> str | None:
    return None if urn[1:-1] == _NO_URN else unquote(urn[len(_URN) + 1 : -1])


def write_record(record: Record) -> bytes:
    """A WARC/1.1 record as one gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % record.payload_bytes
    block = http + record.payload if record.kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {record.kind}", f"WARC-Record-ID: {_urn(record.page)}", f"WARC-Date: {_stamp(record.seconds, '%Y-%m-%dT%H:%M:%SZ')}"]
    if record.url is not None:
        uri = quote(record.url, safe="!#$&()*+,/:;=?@[]~%" + chr(39))
        head.append(f"WARC-Target-URI: {uri}")
        if uri != record.url:
            head.append(f"X-Source-URL: {quote(record.url, safe='')}")
    head.append(f"WARC-Payload-Digest: sha1:{record.digest}")
    if record.kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(record.refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def read_record(member: bytes) -> Record:
    """The record of one gzip member; a response's payload is held against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    import calendar

    seconds = calendar.timegm(time.strptime(fields["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ"))
    url = unquote(fields["X-Source-URL"]) if "X-Source-URL" in fields else fields.get("WARC-Target-URI")
    return Record(_page(fields["WARC-Record-ID"]), url, seconds, payload, digest, size, kind, _page(fields["WARC-Refers-To"]) if kind == "revisit" else None)


class LoserTree:
    """Merges sorted iterators; each inner node keeps the loser of its match."""

    def __init__(self, runs: list[Iterator]) -> None:
        self.runs, self.k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.losers = [-1] * max(1, self.k)
        for i in range(self.k):
            self._replay(i, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return x is not None or (y is None and a < b)
        return (x, a) < (y, b)

    def _replay(self, i: int, building: bool = False) -> None:
        node = (i + self.k) >> 1
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = i
                return
            if self._beats(other, i):
                self.losers[node], i = i, other
            node >>= 1
        self.losers[0] = i

    def __iter__(self):
        while self.k and self.heads[self.losers[0]] is not None:
            i = self.losers[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._replay(i)


def _open(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _escaped(text: str) -> bytes:
    """Bytes without tab or newline that sort as the text does: bytes up to 10 become 1 and 32 more."""
    raw = text.encode()
    return _LOW.sub(lambda m: bytes([1, m[0][0] + 32]), raw)


def _plain(field: bytes) -> str:
    return _ESCAPED.sub(lambda m: bytes([m[0][1] - 32]), field).decode()


_LOW, _ESCAPED = re.compile(rb"[\x00-\x0a]"), re.compile(rb"\x01[\x20-\x2a]")


# An index line: url key, time, id ("=" before it, or nothing for null), archive, offset, length; the first three are its sort key.
def _line(key: str, seconds: int, page: str | None, archive: str, offset: int, length: int) -> bytes:
    ident = b"" if page is None else b"=" + _escaped(page)
    return b"\t".join([_escaped(key), _stamp(seconds, "%Y%m%d%H%M%S").encode(), ident, f"{archive}\t{offset}\t{length}".encode()]) + b"\n"


def _key(line: bytes) -> tuple[bytes, ...]:
    return tuple(line.split(b"\t", 3)[:3])


class Run:
    """A sorted index run: a file of lines."""

    def __init__(self, uri: str) -> None:
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        self.size = self.file.size()

    def line_at(self, offset: int) -> tuple[int, bytes]:
        """The first line that begins at or after ``offset``, and where it begins."""
        at = offset
        if offset:
            at = self._end_of_line(offset - 1)
        end = self._end_of_line(at) if at < self.size else at
        return at, self.file.read_at(end - at, at)

    def _end_of_line(self, at: int) -> int:
        while at < self.size:
            piece = self.file.read_at(min(4096, self.size - at), at)
            cut = piece.find(b"\n")
            if cut >= 0:
                return at + cut + 1
            at += len(piece)
        return self.size

    def first_from(self, key: tuple[bytes, ...] | None) -> int:
        """Where the first line with a key of at least ``key`` begins."""
        if key is None:
            return 0
        lo, hi = 0, self.size
        while lo < hi:
            mid = (lo + hi) // 2
            at, line = self.line_at(mid)
            if not line or _key(line) >= key:
                hi = mid
            else:
                lo = at + len(line)
        return self.line_at(lo)[0]

    def lines(self, begin: int = 0, end: int | None = None) -> Iterator[bytes]:
        end = self.size if end is None else end
        held = b""
        while begin < end:
            piece = self.file.read_at(min(READ_AHEAD, end - begin), begin)
            begin += len(piece)
            *whole, held = (held + piece).split(b"\n")
            yield from whole
        if held:
            yield held


def merged(runs: list[Iterator[bytes]]) -> Iterator[bytes]:
    """Lines of sorted runs in the order of their keys."""
    return (line for _, line in LoserTree([((_key(x), x) for x in r) for r in runs]))


class Archives:
    """Reads records from archives; the least recently used of more than ``OPEN_ARCHIVES`` is closed."""

    def __init__(self, folder: str) -> None:
        self.folder, self.files, self.ahead = folder, OrderedDict(), {}

    def member(self, name: str, offset: int, length: int) -> bytes:
        file = self.files.get(name)
        if file is None:
            if len(self.files) >= OPEN_ARCHIVES:
                old, oldest = self.files.popitem(last=False)
                oldest.close()
                self.ahead.pop(old, None)
            files, path = _open(f"{self.folder}/{name}")
            file = self.files[name] = files.open_input_file(path)
        self.files.move_to_end(name)
        begin, data, end = self.ahead.get(name, (0, b"", -1))
        if not begin <= offset <= offset + length <= begin + len(data):
            follows = offset == end  # only then is it worth reading more than the record
            begin, data = offset, file.read_at(max(length, BLOCK_AHEAD if follows else 0), offset)
        self.ahead[name] = begin, data, offset + length
        return data[offset - begin : offset - begin + length]

    def close(self) -> None:
        while self.files:
            self.files.popitem()[1].close()


def write_archives(pages: DataFrame, folder: str, *, id_col: str, url_col: str, html_col: str, seconds: Column, min_revisit_bytes: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Write one archive and one sorted run for each part; returns (run, captures)."""
    payload = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("page"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload"), seconds.cast("long").alias("seconds"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = materialize(groups.select("digest", "response", "n"), "payloads")
    if stored_bytes(groups) <= broadcast_bytes:
        rows = rows.join(F.broadcast(groups.drop("n")), "digest", "left")
    else:
        total = groups.agg(F.sum("n")).first()[0]
        hot = groups.where(F.col("n") * HOT_SHARE >= total).drop("n")  # at most HOT_SHARE rows
        rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti").join(groups.drop("n").join(F.broadcast(hot.select("digest")), "digest", "left_anti"), "digest", "left")
        rows = rows.join(F.broadcast(hot), "digest").unionByName(rest)
    revisit = F.col("response").isNotNull() & ~F.col("page").eqNullSafe(F.col("response"))
    rows = rows.select(
        url_key(F.col("url")).alias("key"), F.coalesce("seconds", F.lit(EPOCH)).alias("seconds"), F.col("page").cast("string").alias("page"), "url", "payload",
        F.when(revisit, F.col("response").cast("string")).alias("refers_to"), revisit.alias("revisit"),
    )
    rows = rows.sortWithinPartitions("key", "seconds", F.col("page").asc_nulls_first())

    def write(batches):
        import uuid

        files, base = _open(folder)
        files.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        archive = None
        index = io.BytesIO()
        offset = n = 0
        try:
            for batch in batches:
                for i in range(batch.num_rows):
                    key, seconds, page, url, payload, refers_to, revisit = (c[i].as_py() for c in batch.columns)
                    if archive is None:
                        archive = files.open_output_stream(f"{base}/{name}", compression=None)
                        run = files.open_output_stream(f"{base}/{name}.run", compression=None)
                    kind = "revisit" if revisit else "response"
                    member = write_record(Record(page, url, seconds, b"" if revisit else payload, base32_sha1(payload), len(payload), kind, refers_to))
                    archive.write(member)
                    index.write(_line(key, seconds, page, name, offset, len(member)))
                    offset += len(member)
                    n += 1
                    if index.tell() > READ_AHEAD:
                        run.write(index.getvalue())
                        index = io.BytesIO()
        finally:
            if archive is not None:
                run.write(index.getvalue())
                run.close()
                archive.close()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([f"{name}.run"]), pa.array([n], pa.int64())], names=["run", "captures"])

    return materialize(rows.mapInArrow(write, "run string, captures bigint"), "runs")


def _merge_pass(spark, folder: str, runs: list[str], fan_in: int) -> list[str]:
    """One merging pass: groups of ``fan_in`` runs become one run each."""
    groups = [(i, runs[i : i + fan_in]) for i in range(0, len(runs), fan_in)]
    df = spark.createDataFrame(groups, "i int, runs array<string>").repartition(len(groups), "i")

    def merge(batches):
        import uuid

        files, base = _open(folder)
        for batch in batches:
            for names in batch.column(1).to_pylist():
                out = f"{uuid.uuid4().hex}.run"
                with files.open_output_stream(f"{base}/{out}", compression=None) as target:
                    opened = [Run(f"{folder}/{r}") for r in names]
                    for line in merged([r.lines() for r in opened]):
                        target.write(line + b"\n")
                    for run in opened:
                        run.file.close()
                yield pa.RecordBatch.from_arrays([pa.array([out])], names=["run"])

    return [r["run"] for r in materialize(df.mapInArrow(merge, "run string"), "merged").collect()]


def split_keys(folder: str, runs: list[str], ranges: int) -> list[tuple[bytes, ...]]:
    """Keys that split the runs into about equal ranges, from ``SAMPLES`` lines of each run."""
    seen = []
    for name in runs:
        run = Run(f"{folder}/{name}")
        for i in range(SAMPLES):
            _, line = run.line_at(run.size * i // SAMPLES)
            if line:
                seen.append((_key(line), run.size))
        run.file.close()
    seen.sort()
    total = sum(w for _, w in seen)
    keys, upto = [], 0
    for key, weight in seen:
        upto += weight
        if upto >= total * (len(keys) + 1) / ranges and (not keys or key > keys[-1]):
            keys.append(key)
    return keys[: ranges - 1]


_READ = "page string, url string, url_key string, captured_at string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, history_order bigint"


def archive_and_read(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    seconds: Column | None = None,
    min_revisit_bytes: int = 0,
    folder: str | None = None,
    fan_in: int = FAN_IN,
    range_captures: int = RANGE_CAPTURES,
) -> DataFrame:
    """Write the pages to WARC archives in ``folder`` and read them back in index order.

    Returns one row per capture: the id (as it was), url, url_key,
    captured_at, payload_bytes, payload_digest, record_type, refers_to, and
    history_order, which sorts all captures by URL key, time and id.
    ``seconds`` is the capture time since 1970; without it, ids count seconds
    from ``EPOCH``.
    """
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    folder = folder or new_path(spark, "warc")
    if seconds is None:
        seconds = F.lit(EPOCH) + F.pmod(F.coalesce(F.col(f"`{id_col}`").try_cast("long"), F.lit(0)), F.lit(1_000_000_000))
    listed = write_archives(pages, folder, id_col=id_col, url_col=url_col, html_col=html_col, seconds=seconds, min_revisit_bytes=min_revisit_bytes)
    found = listed.orderBy("run").collect()  # one row for each archive
    runs, total = [r["run"] for r in found], sum(r["captures"] for r in found)
    while len(runs) > fan_in:
        runs = _merge_pass(spark, folder, runs, fan_in)
    n_ranges = max(1, -(-total // range_captures))
    keys = split_keys(folder, runs, n_ranges) if runs else []
    edges = [None, *([bytearray(k) for k in key] for key in keys), None]
    ranges = [(i, edges[i], edges[i + 1]) for i in range(len(edges) - 1)] if runs else []
    todo = spark.createDataFrame(ranges, "i int, lo array<binary>, hi array<binary>").repartition(max(1, len(ranges)), "i")

    def read(batches):
        archives = Archives(folder)
        for batch in batches:
            for number, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lo, hi = (None if k is None else tuple(k) for k in (lo, hi))
                opened = [Run(f"{folder}/{r}") for r in runs]
                parts = [r.lines(r.first_from(lo), r.size if hi is None else r.first_from(hi)) for r in opened]
                rows = []
                for place, line in enumerate(merged(parts)):
                    key, stamp, _, name, offset, length = line.split(b"\t")
                    r = read_record(archives.member(name.decode(), int(offset), int(length)))
                    rows.append((r.page, r.url, _plain(key), stamp.decode(), r.payload_bytes, r.digest, r.kind, r.refers_to, (number << 40) + place))
                    if len(rows) == 2000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
                for run in opened:
                    run.file.close()
        archives.close()

    out = todo.mapInArrow(read, _READ)
    typed = {"page": F.col("page").cast(kind).alias(id_col), "refers_to": F.col("refers_to").cast(kind).alias("refers_to")}
    return out.select(*[typed.get(c, F.col(c)) for c in out.columns])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in _READ.split(", ")]
    kinds = [pa.int64() if part.endswith("bigint") else pa.string() for part in _READ.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
