"""All pairs of documents with similar word shingles, by banded MinHash with exact verification.

Texts with the same set of shingles are one representative. Bands of MinHash values are shuffled
by their hash; rows that meet in a band are joined to the band's least member (a star, not all
pairs), so candidate families are connected components. A family of more than one block may hang together by
chance meetings: its members are banded again among themselves with twice the rows to a band (and as many more bands as
keep the recall), which parts what is only loosely alike. Every pair inside a family is then
decided on the full sets: the members' sets are sent to blocks of a bounded number of rows and bytes, each
pair of blocks is one small task, and an inverted index inside it yields exact overlaps. Only
counts and a spanning forest of the links leave a block, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from wattline.llm.common import SHINGLE, SIMILAR, broadcast_rows, components, mixed, stored, text_key, utf8
from wattline.llm.shingles import PIECE, set_keys, sets, shingle_hashes

BLOCK = 512  # representatives compared in one task
BLOCK_SHINGLES = 1 << 21  # of one block on the average: 16 MB
STRICT = 12  # rows of a band within large families
FEW = 100_000  # keys of texts that are broadcast to find them; beyond that texts are joined by key


@dataclass(frozen=True)
class Bands:
    count: int
    rows: int

    @classmethod
    def for_recall(cls, similarity: float, recall: float, rows: int = 6) -> Bands:
        """As many bands of `rows` values as give a pair at `similarity` the chance `recall` to meet in one."""
        return cls(math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)), rows)


def _signatures(hashes: np.ndarray, bounds: np.ndarray, bands: Bands) -> np.ndarray:
    """Hashes of the bands of each non-empty row."""
    rng = np.random.default_rng(77)
    k = bands.count * bands.rows
    mul, add = rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, k, dtype=np.uint32)
    x, starts = (hashes >> np.uint64(32)).astype(np.uint32), bounds[:-1]
    out = np.empty((len(starts), k), np.uint32)
    step = 1 << 15  # shingles at a time: they stay in the processor's cache
    first = 0
    while first < len(starts):
        end = max(first + 1, int(np.searchsorted(bounds, bounds[first] + step)) - 1)
        part, at = x[bounds[first] : bounds[end]], starts[first:end] - starts[first]
        for j in range(k):
            out[first:end, j] = np.minimum.reduceat(part * mul[j] + add[j], at)
        first = end
    band = np.zeros((len(starts), bands.count), np.uint64)
    for j in range(bands.rows):
        band = mixed(band ^ out[:, j :: bands.rows].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return mixed(band + np.arange(bands.count, dtype=np.uint64))


def _keys(batches, words: int) -> Iterator[pa.RecordBatch]:
    """The batch's other columns with the key of its first column's set of shingles."""
    for batch in batches:
        s1, s2, n = [], [], []
        for _, _, h, b in shingle_hashes(batch.column(0), words):
            h, b = sets(h, b)
            x, y = set_keys(h, b)
            s1.append(x), s2.append(y), n.append(np.diff(b))
        cols = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (s1, s2, n)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *cols], names=[*batch.schema.names[1:], "s1", "s2", "size"])


def _bands(batches, words: int, bands: Bands) -> Iterator[pa.RecordBatch]:
    """(band, s1, s2): once for each set of a batch."""
    for batch in batches:
        seen: set[tuple[int, int]] = set()
        for _, _, h, b in shingle_hashes(batch.column(0), words):
            h, b = sets(h, b)
            s1, s2 = set_keys(h, b)
            new = []
            for i, key in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                if b[i + 1] > b[i] and key not in seen:
                    seen.add(key)
                    new.append(i)
            if not new:
                continue
            take = np.concatenate([h[b[i] : b[i + 1]] for i in new])
            own = np.concatenate([[0], np.cumsum([b[i + 1] - b[i] for i in new])])
            sig = _signatures(take, own, bands)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64).ravel()), pa.array(np.repeat(s1[new], bands.count)), pa.array(np.repeat(s2[new], bands.count))], names=["band", "s1", "s2"])


def _strict_bands(batches, bands: Bands) -> Iterator[pa.RecordBatch]:
    """(root, band, s1, s2) of stored sets, about PIECE shingles at a time."""
    for batch in batches:
        data, at = utf8(batch.column(3))
        at = at // 8
        first = 0
        while first < len(batch):
            end = max(first + 1, int(np.searchsorted(at, at[first] + PIECE)) - 1)
            h = data[at[first] * 8 : at[end] * 8].copy().view(np.uint64)
            sig = _signatures(h, at[first : end + 1] - at[first], bands)
            r, x, y = (np.repeat(np.asarray(batch.column(i))[first:end], bands.count) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(sig.view(np.int64).ravel()), pa.array(x), pa.array(y)], names=["root", "band", "s1", "s2"])
            first = end


def _arrays(batches, words: int) -> Iterator[pa.RecordBatch]:
    """Each set of a batch once, with its shingles."""
    for batch in batches:
        seen: set[tuple[int, int]] = set()
        for _, _, h, b in shingle_hashes(batch.column(0), words):
            h, b = sets(h, b)
            s1, s2 = set_keys(h, b)
            some = []
            for i, key in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                if b[i + 1] > b[i] and key not in seen:
                    seen.add(key)
                    some.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(s1[some]), pa.array(s2[some]), pa.array([h[b[i] : b[i + 1]].tobytes() for i in some], pa.binary())], names=["s1", "s2", "set"])


def _pairs(a: list[np.ndarray], b: list[np.ndarray] | None, similar: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with Jaccard similarity >= similar: within a (i < j), or between a and b. Exact, on an inverted index."""
    both = a if b is None else a + b
    size = np.fromiter(map(len, both), np.int64, len(both))
    values, row = np.concatenate(both), np.repeat(np.arange(len(both)), size)
    by = np.argsort(values, kind="stable")
    values, row = values[by], row[by]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    end = np.append(first[1:], len(values))
    overlap = np.zeros((len(both), len(both)), np.int32)
    post = np.diff(np.append(first, len(values)))
    many = post > max(16, len(both) // 8)
    if many.any():  # frequent shingles: a product of incidence matrices
        column = np.repeat(np.where(many, np.cumsum(many) - 1, -1), post)
        inside = np.zeros((len(both), int(many.sum())), np.float32)
        inside[row[column >= 0], column[column >= 0]] = 1
        overlap += (inside @ inside.T).astype(np.int32)
    s, n = first[~many & (post > 1)], post[~many & (post > 1)]
    for k in range(1, int(n.max(initial=1))):  # entries k apart in the same posting list; rows ascend in each
        ok = n > k
        idx = np.repeat(s[ok], n[ok] - k) + np.arange((n[ok] - k).sum()) - np.repeat(np.cumsum(n[ok] - k) - (n[ok] - k), n[ok] - k)
        np.add.at(overlap, (row[idx], row[idx + k]), 1)
    i, j = (np.triu_indices(len(a), 1) if b is None else (x.ravel() for x in np.meshgrid(np.arange(len(a)), np.arange(len(a), len(both)), indexing="ij")))
    o = overlap[i, j].astype(np.int64)
    ok = (o > 0) & (o >= similar * (size[i] + size[j] - o) - 1e-9)
    return i[ok], j[ok]


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Pairs that connect what all pairs connect, n - 1 at most."""
    up, out = list(range(n)), []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = a, b
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        if x != y:
            up[x] = y
            out.append((a, b))
    return out


LINKS = "a1 long, a2 long, b1 long, b2 long, links long"


def _decide(batches, similar: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (family, block pair, side). Per block pair: links of each row, and a forest as pairs (a, b)."""

    def answer(rows: list[tuple]) -> tuple | None:
        one = [r for r in rows if r[1] == 0]
        two = [r for r in rows if r[1] == 1]
        if not one or len(rows) < 2 or (rows[0][5] and not two):
            return None
        arrays = [[np.frombuffer(r[4], np.uint64) for r in side] for side in (one, two)]
        i, j = _pairs(arrays[0], arrays[1] if two else None, similar)
        if not len(i):
            return None
        every = one + two
        copies = np.array([r[6] for r in every], np.int64)
        links = np.bincount(i, copies[j], len(every)) + np.bincount(j, copies[i], len(every))
        out = [(r[2], r[3], None, None, int(n)) for r, n in zip(every, links, strict=True) if n]
        return out + [(every[a][2], every[a][3], every[b][2], every[b][3], 0) for a, b in _forest(i, j, len(every))]

    held: list[tuple] = []
    ready: list[tuple] = []

    def flush():
        cols = zip(*ready, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a1", "a2", "b1", "b2", "links"])

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("root", "x", "y", "side", "s1", "s2", "set", "mixed", "copies")]
        for row in zip(zip(*cols[:3], strict=True), *cols[3:], strict=True):
            if held and held[0][0] != row[0]:
                ready += answer(held) or []
                held = []
                if len(ready) > 20_000:
                    yield flush()
                    ready = []
            held.append(row)
    if held:
        ready += answer(held) or []
    if ready:
        yield flush()


def _stars(banded: DataFrame, keys: list[str]) -> DataFrame:
    """Each set with the least set of each of its bands, as pairs a, b."""
    least = banded.groupBy(*keys).agg(F.min(F.struct("s1", "s2")).alias("b"), F.max(F.struct("s1", "s2")).alias("top")).where("b <> top").select(*keys, "b")
    return stored(banded.join(least.hint("merge"), keys).select(F.struct("s1", "s2").alias("a"), "b").where("a <> b").distinct(), "stars")


def similar_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, similar: float = SIMILAR, recall: float = 1 - 1e-6, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(members, reps).

    members: doc_id, s1, s2 (the key of the text's set of shingles) for every row.
    reps: s1, s2, copies, first (least doc_id), root1, root2 (the class's key), links (rows with a similar
    but not the same set), of every set that occurs.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    k1, k2 = text_key(F.col(text))
    source = docs.select(F.col(text).alias("t"), F.col(doc_id).alias("doc_id"), k1.alias("k1"), k2.alias("k2"))
    members = stored(source.mapInArrow(lambda it: _keys(it, words), f"doc_id {kind}, k1 long, k2 long, s1 long, s2 long, size long"), "members")
    reps = stored(members.groupBy("s1", "s2").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"), F.first("size").alias("size")), "reps")
    bands = Bands.for_recall(similar, recall)
    banded = stored(source.select("t").mapInArrow(lambda it: _bands(it, words, bands), "band long, s1 long, s2 long"), "bands")

    def whole(some: DataFrame) -> DataFrame:
        """some (s1, s2 and more, once each) with the shingles of these sets."""
        holder = stored(members.join(some, ["s1", "s2"], "left_semi").groupBy("s1", "s2").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2"), "holder")
        full = source.join(broadcast_rows(holder, FEW), ["k1", "k2"], "left_semi").select("t").mapInArrow(lambda it: _arrays(it, words), "s1 long, s2 long, set binary")
        return full.join(some, ["s1", "s2"]).dropDuplicates(["s1", "s2"])

    size = reps.select("s1", "s2", "copies", "size")
    family = components(_stars(banded, ["band"]), "a", "b").select(F.col("root.s1").alias("root"), "node.s1", "node.s2")
    crowd = stored(family.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > block).select("root"), "crowd")
    if crowd.limit(1).count():
        strict = Bands.for_recall(similar, recall, STRICT)
        loose = whole(family.join(crowd, "root", "left_semi")).select("root", "s1", "s2", "set")
        again = stored(loose.mapInArrow(lambda it: _strict_bands(it, strict), "root long, band long, s1 long, s2 long"), "strict")
        parts = components(_stars(again, ["root", "band"]), "a", "b").select(F.col("root.s1").alias("root"), "node.s1", "node.s2")
        family = stored(family.join(crowd, "root", "left_anti").select("root", "s1", "s2").union(parts), "families")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)).cast("int")
    family = stored(family.join(size, ["s1", "s2"]), "sized")
    total = family.groupBy("root").agg(blocks.alias("blocks"))
    deal = F.pmod(F.xxhash64("s1", "s2"), F.col("blocks")).cast("int")
    family = stored(family.join(total, "root").select("root", "s1", "s2", "copies", deal.alias("blk"), "blocks"), "family")
    full = whole(family)
    sent = full.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("o")).select(
        "root", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), (F.col("blk") > F.col("o")).cast("int").alias("side"), "s1", "s2", "set", (F.col("blk") != F.col("o")).alias("mixed"), "copies"
    )
    found = stored(sent.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "side").mapInArrow(lambda it: _decide(it, similar), LINKS), "links")
    links = found.where("b1 is null").groupBy(F.col("a1").alias("s1"), F.col("a2").alias("s2")).agg(F.sum("links").alias("links"))
    edges = found.where("b1 is not null").select(F.struct(F.col("a1").alias("s1"), F.col("a2").alias("s2")).alias("a"), F.struct(F.col("b1").alias("s1"), F.col("b2").alias("s2")).alias("b"))
    roots = components(edges, "a", "b").select("node.s1", "node.s2", F.col("root.s1").alias("root1"), F.col("root.s2").alias("root2"))
    reps = reps.join(links, ["s1", "s2"], "left").join(roots, ["s1", "s2"], "left")
    reps = reps.withColumns({"links": F.coalesce("links", F.lit(0)), "root1": F.coalesce("root1", "s1"), "root2": F.coalesce("root2", "s2")})
    return members, stored(reps, "reps")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, similar: float = SIMILAR, recall: float = 1 - 1e-6, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), n_links, n_copies.

    A link joins two rows whose sets of `words`-word shingles have a Jaccard similarity >= similar;
    a class is what links connect. n_links counts the other rows linked with this one, n_copies
    those among them with the same set. Texts under `words` words are one shingle; null, empty and
    blank texts have no shingle: no links, each row its own class. Repeated rows are copies. A null
    doc_id loses its class id only if all of the class are null. Very long texts are compared whole; an empty
    table gives no rows; other columns are not looked at.
    """
    members, reps = similar_links(docs, doc_id, text, words, similar, recall, block)
    named = reps.groupBy("root1", "root2").agg(F.min("first").alias("class_id"))
    info = reps.where("size > 0 and (links > 0 or copies > 1)").join(named, ["root1", "root2"]).select("s1", "s2", "class_id", "links", "copies")
    joined = members.join(info, ["s1", "s2"], "left")
    return joined.select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.col("copies") - 1, F.lit(0)).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE, similar: float = SIMILAR, recall: float = 1 - 1e-6, block: int = BLOCK) -> DataFrame:
    """docs with one row of each class: that with the least doc_id (nulls last), then the least text key.

    Null, empty and blank texts all stay. Of rows equal in doc_id and text the one with the least other columns stays. Very long
    texts are compared whole; an empty table stays empty. Columns of any other name stay as they are.
    """
    members, reps = similar_links(docs, doc_id, text, words, similar, recall, block)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    grouped = members.join(reps.select("s1", "s2", "root1", "root2", "links"), ["s1", "s2"]).where("size > 0")
    best = grouped.groupBy("root1", "root2").agg(F.min(order).alias("best"), F.count("*").alias("n"), F.max("links").alias("links")).where("n > 1")
    stays = stored(best.select("best.doc_id", "best.k1", "best.k2"), "stays")
    crowd = grouped.join(best.select("root1", "root2"), ["root1", "root2"], "left_semi").select("doc_id", "k1", "k2")
    equal = crowd.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("rows"))
    first = stays.withColumn("stay", F.lit(True))
    fate = stored(equal.join(first, [equal.doc_id.eqNullSafe(first.doc_id), equal.k1 == first.k1, equal.k2 == first.k2], "left").select(equal.doc_id.alias("__wl_id"), equal.k1.alias("__wl_k1"), equal.k2.alias("__wl_k2"), "rows", F.coalesce("stay", F.lit(False)).alias("__wl_stay")), "fate")
    k1, k2 = text_key(docs[text])
    same = lambda f: [docs[doc_id].eqNullSafe(f["__wl_id"]), k1 == f["__wl_k1"], k2 == f["__wl_k2"]]
    goes = fate.where("not __wl_stay or rows > 1").select("__wl_id", "__wl_k1", "__wl_k2")
    kept = docs.join(goes, same(goes), "left_anti")
    twice = fate.where("__wl_stay and rows > 1").select("__wl_id", "__wl_k1", "__wl_k2")
    if twice.limit(1).count():  # rows equal in doc_id and text: one of them
        sorts = [c for c in docs.columns if docs.schema[c].dataType.typeName() not in ("map", "variant")]
        extra = docs.join(twice, same(twice)).groupBy("__wl_id", "__wl_k1", "__wl_k2").agg(F.min_by(F.struct(*docs.columns), F.struct(*sorts)).alias("__wl_row"))
        kept = kept.unionByName(extra.select("__wl_row.*"))
    return kept
