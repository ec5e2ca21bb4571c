"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints within the radius agree on all bits of some choice of
``blocks - radius`` out of ``blocks`` bit blocks, so every linked pair meets in
the bucket of one such choice; the number of blocks follows the number of
distinct fingerprints and keeps random buckets small.  Within a bucket 64
fingerprints are stored as vertical bit planes, one machine word for each bit;
a query updates 64 distances at once with carry-save counters (three count
planes and a sticky overflow), and a word is abandoned once all its distances
exceed the radius.

Equal fingerprints are merged before anything is shuffled.  A task gives out a
spanning forest of the links it finds, never all pairs.  A bucket of more than
``BUCKET_ROWS`` is dealt into blocks of that size; what its blocks leave
unconnected is then compared, the rows outside the bucket's largest component
against all its rows, in blocks too.  Components come from repeated contraction
along smallest neighbours, all in tables; nothing but counts reaches the driver.

Defined cases: null and blank texts have fingerprint zero, which links like any
other; texts with fewer words than a shingle are one shingle; repeated rows get
the same result each; rows without an id never name a component and keep a null
one if no row of theirs has an id; texts of any length are read whole; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempora.llm.common import field, fresh, map_text, materialize, stored_bytes

BITS = 64
SEED = 42
#: A bucket larger than this is dealt into blocks.
BUCKET_ROWS = 1024
#: Blocks of bits -> distinct fingerprints up to which they are used.
BLOCKS_UP_TO = ((5, 500_000), (6, 100_000_000), (7, 6_000_000_000))
MOST_BLOCKS = 8
#: Lists below this stored size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 2 << 20
_CELLS = 8192
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash over word shingles, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[min(shingle, len(words)) - 1 :], strict=False)]
    planes = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = planes.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """id and ``fp``, the fingerprint as a signed long."""

    def make():
        def run(texts):
            return [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

        return run

    return map_text(docs, text_col, make, [field("fp", T.LongType())], [id_col])


class BitPlanes:
    """Fingerprints of groups as vertical planes: 64 of one group to a word."""

    def __init__(self, fps: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        sizes = ends - begins
        self.words = -(-sizes // BITS)
        self.first_word = np.cumsum(self.words) - self.words
        owner = np.repeat(np.arange(len(sizes)), sizes)
        local = np.arange(len(fps)) - begins[owner]
        self.word = self.first_word[owner] + local // BITS
        self.lane = (local % BITS).astype(np.uint64)
        self.start = np.flatnonzero(local % BITS == 0)
        one = np.uint64(1)
        gather = lambda x: np.bitwise_or.reduceat(x, self.start) if len(x) else x
        self.planes = np.stack([gather(((fps >> np.uint64(b)) & one) << self.lane) for b in range(BITS)])
        self.valid = gather(one << self.lane)
        self.owner = owner


def compare(queries: np.ndarray, planes: BitPlanes, cell_query: np.ndarray, cell_word: np.ndarray, lanes: np.ndarray, radius: int):
    """Yields arrays (query, row of the planes) of pairs within the radius, for cells of a query and a word.

    ``lanes`` has the lanes of each cell that count.  radius is at most 4.
    """
    bits = [np.where((queries >> np.uint64(b)) & np.uint64(1), _ALL, np.uint64(0)) for b in range(BITS)]
    for at in range(0, len(cell_query), _CELLS):
        q, w = cell_query[at : at + _CELLS], cell_word[at : at + _CELLS]
        over = ~lanes[at : at + _CELLS]
        one, two, four = np.zeros_like(over), np.zeros_like(over), np.zeros_like(over)
        for b in range(BITS):
            carry = planes.planes[b][w] ^ bits[b][q]
            spill = one & carry
            one ^= carry
            carry = two & spill
            two ^= spill
            spill = four & carry
            four ^= carry
            over |= spill
            if b % 8 == 7:
                beyond = over | _exceeds(one, two, four, radius)
                alive = beyond != _ALL
                if not alive.all():
                    q, w, over, one, two, four = (x[alive] for x in (q, w, over, one, two, four))
                    if not len(q):
                        break
        if not len(q):
            continue
        near = ~(over | _exceeds(one, two, four, radius))
        hit = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cell, lane = np.nonzero(hit)
        yield q[cell], planes.start[w[cell]] + lane


def _exceeds(one: np.ndarray, two: np.ndarray, four: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose count (0 to 7) is above the radius."""
    if radius >= 4:
        return four & (one | two)
    return four | (two & one if radius == 2 else two if radius == 1 else one | two if radius == 0 else np.zeros_like(one))


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each row's component, from links between rows."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Forest:
    """Links between rows, reduced to the rows' components whenever they become many."""

    def __init__(self, n: int) -> None:
        self.n, self.parts, self.held = n, [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.parts.append((a, b))
        self.held += len(a)
        if self.held > 2_000_000:
            label = self.labels()
            self.parts, self.held = [(np.arange(self.n), label)], self.n

    def labels(self) -> np.ndarray:
        if not self.parts:
            return np.arange(self.n)
        return components(self.n, *(np.concatenate(x) for x in zip(*self.parts, strict=True)))


def links_within(fps: np.ndarray, begins: np.ndarray, ends: np.ndarray, radius: int) -> np.ndarray:
    """Labels of the rows (smallest row linked) over all pairs of each group."""
    planes = BitPlanes(fps, begins, ends)
    rest = planes.first_word[planes.owner] + planes.words[planes.owner] - planes.word
    query = np.repeat(np.arange(len(fps)), rest)
    word = planes.word[query] + np.arange(len(query)) - np.repeat(np.cumsum(rest) - rest, rest)
    later = ~((np.uint64(2) << planes.lane[query]) - np.uint64(1))
    lanes = planes.valid[word] & np.where(word == planes.word[query], later, _ALL)
    forest = Forest(len(fps))
    for a, b in compare(fps, planes, query, word, lanes, radius):
        forest.add(a, b)
    return forest.labels()


def links_across(queries: np.ndarray, rows: np.ndarray, radius: int) -> np.ndarray:
    """Labels over queries, then rows, from the links between the two."""
    planes = BitPlanes(rows, np.array([0]), np.array([len(rows)]))
    n_words = int(planes.words[0])
    query, word = np.repeat(np.arange(len(queries)), n_words), np.tile(np.arange(n_words), len(queries))
    forest = Forest(len(queries) + len(rows))
    for a, b in compare(queries, planes, query, word, planes.valid[word], radius):
        forest.add(a, b + len(queries))
    return forest.labels()


def block_masks(blocks: int, radius: int) -> list[int]:
    """Signed masks of all choices of ``blocks - radius`` bit blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    one = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(blocks)]
    masks = [sum(one[i] for i in pick) for pick in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _runs(batches, n_keys: int):
    """Whole groups of equal leading keys, as (columns, begins, ends), from sorted batches."""
    held = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        if held is not None:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns, strict=True)]
        n = len(columns[0])
        if not n:
            continue
        change = np.zeros(n, bool)
        change[0] = True
        for key in columns[:n_keys]:
            change[1:] |= key[1:] != key[:-1]
        begins = np.flatnonzero(change)
        cut = begins[-1]
        if len(begins) > 1:
            yield [c[:cut] for c in columns], begins[:-1], begins[1:]
        held = [c[cut:] for c in columns]
    if held is not None and len(held[0]):
        yield held, np.array([0]), np.array([len(held[0])])


_EDGE = "a long, b long"


def _edges(fps: np.ndarray, label: np.ndarray) -> pa.RecordBatch:
    other = np.flatnonzero(label != np.arange(len(label)))
    signed = fps.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(signed[label[other]]), pa.array(signed[other])], names=["a", "b"])


def _within(radius: int):
    def run(batches):
        for columns, begins, ends in _runs(batches, 3):
            many = ends - begins > 1
            if many.any():
                fps = np.ascontiguousarray(columns[3]).view(np.uint64)
                pick = np.concatenate([np.arange(b, e) for b, e in zip(begins[many], ends[many], strict=True)])
                sizes = (ends - begins)[many]
                stop = np.cumsum(sizes)
                yield _edges(fps[pick], links_within(fps[pick], stop - sizes, stop, radius))

    return run


def _across(radius: int):
    def run(batches):
        for columns, begins, ends in _runs(batches, 4):
            fps, outside = np.ascontiguousarray(columns[4]).view(np.uint64), columns[5].astype(bool)
            for b, e in zip(begins, ends, strict=True):
                f, o = fps[b:e], outside[b:e]
                queries, rows = f[o], f[~o]
                if len(queries) and len(rows):
                    yield _edges(np.concatenate([queries, rows]), links_across(queries, rows, radius))

    return run


def _listed(df: DataFrame) -> DataFrame:
    """A stored table with a broadcast hint if it is small; Spark joins it by a shuffle otherwise."""
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES else df


def connect(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, for all nodes with an edge.

    Each round points every node to its smallest neighbour, shortens the
    pointers to roots and contracts the edges; nodes halve at least.
    """
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("parent"))
        parents = materialize(parents, "parents")
        while True:
            up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            shorter = materialize(parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "parents")
            moved = shorter.where("moved").isEmpty()
            parents = shorter.select("node", "parent")
            if moved:
                break
        to = parents.select(F.col("node").alias("label"), F.col("parent").alias("root"))
        if labels is None:
            labels = parents.select("node", F.col("parent").alias("label"))
        else:
            labels = materialize(labels.join(to, "label", "left").select("node", F.coalesce("root", "label").alias("label")), "labels")
        a = parents.select(F.col("node").alias("a"), F.col("parent").alias("ra"))
        b = parents.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        moved = edges.join(a, "a").select("b", "ra").join(b, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
        edges = materialize(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def link_fingerprints(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """(node, label) over distinct fingerprints ``fp`` linked within the radius; nodes without a link are absent."""
    count = nodes.count()
    blocks = next((b for b, upto in BLOCKS_UP_TO if count <= upto), MOST_BLOCKS)
    masks = block_masks(blocks, radius)
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    keyed = nodes.select("fp", keys.alias("k")).select("k.choice", "k.key", "fp")
    large = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > BUCKET_ROWS)
    large = materialize(large, "large")
    salted = keyed.withColumn("salt", F.lit(0))
    any_large = not large.isEmpty()
    if any_large:
        n_salts = F.coalesce(F.ceil(F.col("rows") / BUCKET_ROWS).cast("int"), F.lit(1))
        salted = keyed.join(_listed(large), ["choice", "key"], "left").select("choice", "key", "fp", F.pmod(F.xxhash64("fp"), n_salts).cast("int").alias("salt"))
    salted = salted.select("choice", "key", "salt", "fp").repartition("choice", "key", "salt").sortWithinPartitions("choice", "key", "salt", "fp")
    edges = salted.mapInArrow(_within(radius), _EDGE)
    labels = connect(edges)
    if not any_large:
        return labels
    # The rows of large buckets with their components so far.
    inside = keyed.join(_listed(large), ["choice", "key"])
    inside = inside.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("choice", "key", "fp", F.coalesce("label", "fp").alias("label"))
    inside = materialize(inside, "inside")
    sizes = inside.groupBy("choice", "key", "label").agg(F.count(F.lit(1)).alias("n"))
    sums = sizes.groupBy("choice", "key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("rows"), (F.sum("n") - F.max("n")).alias("others"))
    open_keys = materialize(sums.where("others > 0"), "open")
    if open_keys.isEmpty():
        return labels
    rows = inside.join(_listed(open_keys), ["choice", "key"])
    n_rows, n_others = (F.ceil(F.col(c) / BUCKET_ROWS).cast("int") for c in ("rows", "others"))
    mine_row, mine_other = F.pmod(F.xxhash64("fp"), n_rows).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), n_others).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    as_rows = rows.withColumn("other_block", every(n_others)).select("choice", "key", mine_row.alias("row_block"), "other_block", "fp", F.lit(False).alias("outside"))
    as_others = rows.where("label <> main").withColumn("row_block", every(n_rows)).select("choice", "key", "row_block", mine_other.alias("other_block"), "fp", F.lit(True).alias("outside"))
    cells = ["choice", "key", "row_block", "other_block"]
    pairs = as_rows.union(as_others).repartition(*cells).sortWithinPartitions(*cells)
    more = pairs.mapInArrow(_across(radius), _EDGE)
    return connect(more.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: id, fp (signed long), label (a fingerprint that names the component), component_id (smallest id reachable over links)."""
    rows = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min(id_col).alias("first_id")), "nodes")
    labels = link_fingerprints(nodes.select("fp"), radius)
    rooted = materialize(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label")), "rooted")
    smallest = materialize(rooted.groupBy("label").agg(F.min("first_id").alias("component_id")), "smallest")
    named = materialize(rooted.join(smallest, "label").select("fp", "label", "component_id"), "named")
    return rows.join(named, "fp").select(id_col, "fp", "label", "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """One document of each component, the one with the smallest id, with all its columns.

    Of rows that repeat that id within the component one stays; rows without
    an id stay.
    """
    found = materialize(near_duplicates(docs, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius), "found")
    found = found.toDF("id", "fp", "label", "component_id")
    own_id, own_fp, group = fresh(docs, "__id"), fresh(docs, "__fp"), fresh(docs, "__component")
    ident = F.col(f"`{id_col}`")
    fate = found.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("id") == F.col("component_id")).alias("stays"))
    gone = materialize(fate.where("NOT stays").select(F.col("id").alias(own_id)), "gone")
    repeated = materialize(fate.where("stays AND n > 1").select(F.col("id").alias(own_id)), "repeated")
    kept = docs.join(_listed(gone), ident == F.col(own_id), "left_anti")
    if repeated.isEmpty():
        return kept
    once = kept.join(_listed(repeated), ident == F.col(own_id), "left_anti")
    many = kept.join(_listed(repeated), ident == F.col(own_id), "left_semi")

    def make():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64)]

    # Rows of one id may have different texts, so each is judged by its own fingerprint.
    many = map_text(many, text_col, make, [field(own_fp, T.LongType())], docs.columns)
    own = found.where("component_id = id").select(F.col("id").alias(own_id), F.col("fp").alias(f"{own_fp}_"), F.col("label").alias(group)).distinct()
    many = many.join(own, (ident == F.col(own_id)) & (F.col(own_fp) == F.col(f"{own_fp}_"))).dropDuplicates([id_col, group])
    return once.unionByName(many.select(*[F.col(f"`{c}`") for c in docs.columns]))
