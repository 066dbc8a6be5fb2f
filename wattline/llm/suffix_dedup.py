"""Exact substring deduplication by a sparse suffix array with deep-shallow sorting.

Every string of `length` bytes that starts at two places is found, and all bytes it covers are removed.

1. Blocks. Texts are packed into blocks of about half a megabyte and stored once, bucketed by block, so that
   what later steps find for a block meets its texts again without another exchange of text.
2. Anchors. Of each `length`-byte window the k-gram with the least hash is its anchor (ties: the
   leftmost). Equal windows have the same anchor at the same offset, so it is enough to compare
   windows whose anchors are equal k-grams. About one position in 80 is an anchor. Blocks learn by
   joins of 64-bit hashes which of their anchors occur twice.
3. The surroundings of repeated anchors are shuffled by anchor and suffix-sorted twice: the
   suffixes from the anchor on, and the reversed prefixes before it. Deep-shallow sorting does
   both: a multikey quicksort on eight-byte keys to a shallow depth, for all buckets of a chunk
   at once, then blind tries for the groups whose common prefix is longer.
4. A window that reaches l bytes before the anchor is repeated if another row is in the same run
   of prefixes with a common part >= l and in the same run of suffixes with one >= length - l.

A group of more than `hot` surroundings is split by more of its bytes before it is sorted: windows that
reach at least a and at most b bytes before the anchor all hold the a bytes before it and the length - k - b
after it, so the two halves of the range of reaches are two groups with longer keys each. Splitting
goes on until groups are small or a range is one window, whose rows only have to be counted. All of
that are aggregations and joins of Spark; no task holds more than `hot` surroundings of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType

from wattline.llm.common import bucketed, byte_table, mixed, stored, utf8

GRAM = 32
SHALLOW = 6  # words of eight bytes
PIECE = 1 << 19  # bytes hashed at a time, and of a block; positions in a piece fit 20 bits
CHUNK = 20_000  # rows sorted at a time
HOT = 50_000  # surroundings of a group sorted in one task; larger groups are split first


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-byte strings of data, n a power of two: two halves are combined at each doubling."""
    h, width, p = byte_table(9)[data], 1, 0x9E3779B97F4A7C15
    while width < n:
        h = h[:-width] * np.uint64(p) + h[width:]
        p, width = p * p % 2**64, width * 2
    return mixed(h)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def pieces(data: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each window start or -1, its offset in the row) of runs of rows, or parts of a long row."""
    row, begin, size = [], [], 0
    spans: list[tuple[int, int, int]] = []

    def built():
        parts = np.concatenate([data[s:e] for _, s, e in spans])
        rows = np.concatenate([np.where(np.arange(e - s) <= e - s - length, r, -1) for r, s, e in spans])
        offs = np.concatenate([np.arange(s - at[r], e - at[r]) for r, s, e in spans])
        return parts, rows, offs

    for r in np.flatnonzero(np.diff(at) >= length):
        for s in range(int(at[r]), int(at[r + 1]) - length + 1, PIECE - length):
            e = min(int(at[r + 1]), s + PIECE - 1)
            if spans and size + e - s > PIECE:
                yield built()
                spans, size = [], 0
            spans.append((int(r), s, e))
            size += e - s
    if spans:
        yield built()


def anchors(piece, length: int):
    """Of each anchor: hash, row, offset in the row, place in the piece, first and last window start in the piece."""
    data, rows, offs = piece
    h = gram_hashes(data, GRAM)
    low = np.uint64(2**20 - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    starts = np.flatnonzero(rows[: len(least)] >= 0)
    if not len(starts):
        return None
    anchor = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (np.diff(starts) != 1)]))
    last = np.append(first[1:], len(starts)) - 1
    p = anchor[first]
    return h[p], rows[starts[first]], offs[p], p, starts[first], starts[last]


def _blocks(batches, text: str) -> Iterator[pa.RecordBatch]:
    """Rows packed into blocks of about PIECE bytes of text: block (a hash of its texts and their order), rows.

    The same input gives the same blocks, so that a task may run again. Two blocks with the same texts share
    their number, and everything that is found for it holds for both.
    """
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        size = np.diff(utf8(column)[1])
        cut = np.flatnonzero(np.diff(np.cumsum(size) // PIECE)) + 1
        edges = [0, *cut.tolist(), len(batch)]
        for first, end in zip(edges, edges[1:], strict=False):
            if first == end:
                continue
            part = batch.slice(first, end - first)
            name = xxhash.xxh3_64()
            data, at = utf8(part.column(part.schema.get_field_index(text)))
            name.update(at.tobytes())
            name.update(data.tobytes())
            rows = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
            rows = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), rows)
            yield pa.RecordBatch.from_arrays([pa.array([name.intdigest() - 2**63]), rows], names=["block", "rows"])


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row of the batch, bytes, bounds) of each block: column 1 holds its texts."""
    for i, texts in enumerate(batch.column(1)):
        yield i, *utf8(texts.values)


def _anchor_counts(batches, length: int) -> Iterator[pa.RecordBatch]:
    """(h, block, n): how often each anchor occurs in each block."""
    for batch in batches:
        for i, data, at in _texts(batch):
            found = [x[0] for piece in pieces(data, at, length) if (x := anchors(piece, length))]
            if found:
                h, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.full(len(h), batch.column(0)[i].as_py())), pa.array(n)], names=["h", "block", "n"])


#: g: group; least, most: the range of reaches it is about; off: bytes before the anchor; places: rows and starts in the block
FOUND = "g long, least int, most int, off int, n long, block long, places binary, ctx binary"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("g", pa.int64()), ("least", pa.int32()), ("most", pa.int32()), ("off", pa.int32()), ("n", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("ctx", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])


def _contexts(batches, length: int) -> Iterator[pa.RecordBatch]:
    """Surroundings of each block's repeated anchors (column 2); equal ones are one row with all their places."""
    for batch in batches:
        for i, data, at in _texts(batch):
            wanted = np.sort(np.asarray(batch.column(2)[i].values)).view(np.uint64)
            wanted.sort()
            block = batch.column(0)[i].as_py()
            seen: dict[tuple, list[int]] = {}
            for piece in pieces(data, at, length):
                if not (x := anchors(piece, length)):
                    continue
                h, row, off, p, lo, hi = x
                keep = wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
                raw = piece[0].tobytes()
                for hh, r, o, pp, a, z in zip(*(v[keep].tolist() for v in (h.view(np.int64), row, off, p, lo, hi)), strict=True):
                    seen.setdefault((hh, pp - a, raw[a : z + length]), []).append(r << 32 | o)
            out = [(h, 0, length - GRAM, d, len(where), block, np.array(where, np.int64).tobytes(), c) for (h, d, c), where in seen.items()]
            for k in range(0, len(out), CHUNK):
                yield _found(out[k : k + CHUNK])


def blind_trie(strings: list[bytes]) -> list[int]:
    """Indexes of strings in their order.

    Nodes keep only a depth and the byte after it; a string goes down blindly, is compared once
    with a leaf found there, and branches off where the two differ.
    """
    leaves = [[0]]
    root: list = [None, leaves[0]]  # [depth, children] or [None, indexes]

    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] is not None:
            c = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        t = strings[node[1][0]]
        short = min(len(s), len(t))
        x = int.from_bytes(s[:short], "big") ^ int.from_bytes(t[:short], "big")
        same = short - (x.bit_length() + 7) // 8
        if same == len(s) == len(t):
            node[1].append(i)
            continue
        node = root
        while node[0] is not None and node[0] < same:
            node = node[1][s[node[0]]]
        new, old = (u[same] if same < len(u) else -1 for u in (s, t))
        if node[0] == same:
            node[1][new] = [None, [i]]
        else:
            node[0], node[1] = same, {old: [node[0], node[1]], new: [None, [i]]}
    out, stack = [], [root]
    while stack:
        depth, below = stack.pop()
        if depth is None:
            out += below
        else:
            stack += [below[c] for c in sorted(below, reverse=True)]
    return out


def deep_shallow(group: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings by (group, string), and the common prefix of each with the one before (-1: another group)."""
    n = len(strings)
    size = np.fromiter(map(len, strings), np.int64, n)
    words = -(-int(size.max(initial=1)) // 8) or 1
    flat = np.frombuffer(b"".join(s.ljust(words * 8, b"\0") for s in strings), ">u8").reshape(n, words).astype(np.uint64)
    order = np.argsort(group, kind="stable")
    part = np.cumsum(np.concatenate([[0], group[order][1:] != group[order][:-1]]))
    for depth in range(min(SHALLOW, words)):  # multikey quicksort: split every part by its next key, all parts at once
        many = np.bincount(part)[part] > 1
        if not many.any():
            break
        at = np.flatnonzero(many)
        key = flat[order[at], depth]
        by = np.lexsort((key, part[at]))
        order[at] = order[at][by]
        key = flat[order, depth]
        part = np.cumsum(np.concatenate([[0], (part[1:] != part[:-1]) | many[1:] & (key[1:] != key[:-1])]))
    begin = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    for s, e in zip(begin.tolist(), np.append(begin[1:], n).tolist(), strict=True):
        if e - s > 1:
            own = order[s:e]
            order[s:e] = own[blind_trie([strings[i] for i in own.tolist()])]
    common = np.full(n, -1, np.int64)
    for s in range(1, n, 4096):
        a, b = order[s - 1 : s + 4095][: n - s], order[s : s + 4096]
        a = a[: len(b)]
        differ = flat[a] ^ flat[b]
        word = (differ != 0).argmax(1)
        first = differ[np.arange(len(a)), word]
        zeros = np.zeros(len(a), np.int64)
        for bits in (56, 48, 40, 32, 24, 16, 8):
            zeros += (first >> np.uint64(bits) == 0)
        lcp = np.where(first == 0, words * 8, word * 8 + zeros)
        common[s : s + 4096] = np.where(group[a] == group[b], np.minimum(lcp, np.minimum(size[a], size[b])), -1)
    return order, common


def _runs(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each row the number of its run: rows next to each other with a common part of at least `least`."""
    run = np.empty(len(order), np.int64)
    run[order] = np.cumsum(common < least)
    return run


def _spans(block, places, off, first, last, length: int) -> pa.RecordBatch:
    """Covered spans: of row i of the arguments all windows that reach first[i] to last[i] bytes before the anchor."""
    where = [np.frombuffer(x, np.int64) for x in places]
    times = np.fromiter(map(len, where), np.int64, len(where))
    place = np.concatenate(where) if where else np.zeros(0, np.int64)
    p, row = place & 0xFFFFFFFF, place >> 32
    s, e = p - np.repeat(last, times), p - np.repeat(first, times) + length
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(block, times)), pa.array(row), pa.array(s << 32 | e)], names=["block", "row", "span"])


SPANS = "block long, row long, span long"


def _judge(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Covered spans of every row of whole groups."""
    g, low, high, off, n, block = (np.asarray(rows.column(c)) for c in ("g", "least", "most", "off", "n", "block"))
    ctx, places = rows.column("ctx").to_pylist(), rows.column("places").to_pylist()
    index: dict[tuple, int] = {}
    mine = np.fromiter((index.setdefault(x, len(index)) for x in zip(g.tolist(), low.tolist(), high.tolist(), off.tolist(), ctx, strict=True)), np.int64, len(ctx))
    m = len(index)
    count = np.bincount(mine, weights=n, minlength=m) >= 2  # equal rows are sorted once
    group, before, text = np.array([x[0] for x in index]), np.array([x[3] for x in index]), [x[4] for x in index]
    least = np.maximum(np.array([length - len(t) for t in text]) + before, [x[1] for x in index])  # windows reach from `least` to `most` bytes before the anchor
    most = np.minimum(before, [x[2] for x in index])
    hit = np.zeros((m, length - GRAM + 2), bool)
    _, inverse, per = np.unique(group, return_inverse=True, return_counts=True)
    some = np.flatnonzero(per[inverse] > 1)
    if len(some):
        own = group[some]
        right = deep_shallow(own, [text[i][before[i] :] for i in some.tolist()])
        left = deep_shallow(own, [text[i][: before[i]][::-1] for i in some.tolist()])
        for reach in range(int(least[some].min()), int(most[some].max()) + 1):
            own = np.flatnonzero((least[some] <= reach) & (reach <= most[some]))
            both = _runs(*left, reach)[own] * np.int64(len(some) + 1) + _runs(*right, length - reach)[own]
            _, where, times = np.unique(both, return_inverse=True, return_counts=True)
            hit[some[own[times[where] > 1]], reach] = True
    reach = np.arange(hit.shape[1] - 1)
    hit[:, :-1] |= count[:, None] & (least[:, None] <= reach) & (reach <= most[:, None])
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    c, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    # each run of reaches of a context, for each row with that context
    by, start = np.argsort(c, kind="stable"), np.searchsorted(c, np.arange(m + 1))
    times = np.diff(start)[mine]
    row = np.repeat(np.arange(len(mine)), times)
    run = by[start[mine][row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)]
    return _spans(block[row], [places[i] for i in row.tolist()], off[row], first[run], last[run], length)


def _sorted_groups(batches, length: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by g. Whole groups are judged together, about CHUNK rows at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for i in range(0, len(batch), CHUNK):
            held.append(batch.slice(i, CHUNK))
            if sum(map(len, held)) >= CHUNK:
                rows = pa.Table.from_batches(held).combine_chunks()
                g = np.asarray(rows.column("g"))
                cut = int(np.searchsorted(g, g[-1]))
                held = rows.slice(cut).to_batches()
                if cut:
                    yield _judge(rows.slice(0, cut), length)
    if held:
        yield _judge(pa.Table.from_batches(held).combine_chunks(), length)


def _certain(batches, length: int) -> Iterator[pa.RecordBatch]:
    """Covered spans of rows all of whose windows are repeated."""
    for batch in batches:
        low, high, off, block = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("least", "most", "off", "block"))
        ctx = batch.column(batch.schema.get_field_index("size"))
        first, last = np.maximum(low, length - np.asarray(ctx) + off), np.minimum(high, off)
        ok = np.flatnonzero(first <= last)
        places = batch.column(batch.schema.get_field_index("places")).take(pa.array(ok)).to_pylist()
        yield _spans(block[ok], places, off[ok], first[ok], last[ok], length)


def split_hot(rows: DataFrame, length: int, hot: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows of groups of at most `hot`, frames of spans that are already certain).

    Equal surroundings of a larger group repeat each other and are counted; one of each goes on, without
    places. What is left of the group is halved by the range of its reaches, with a longer key.
    """
    small, sure = [], []
    while True:
        large = stored(rows.groupBy("g").agg(F.count("*").alias("rows")).where(F.col("rows") > hot).select("g"), "hot")
        if not large.limit(1).count():
            return reduce(DataFrame.unionByName, small, rows), sure
        small.append(rows.join(large, "g", "left_anti").select(rows.columns))
        big = rows.join(large, "g", "left_semi").select(*rows.columns, F.xxhash64("ctx").alias("x1"), F.xxhash64(F.lit("second"), "ctx").alias("x2"))
        big = stored(big, "large")
        same = ["g", "off", "x1", "x2"]
        times = stored(big.groupBy(*same).agg(F.sum("n").alias("total"), F.count("*").alias("copies"), F.min(F.struct("block", "places")).alias("one")), "equal")
        again = big.join(times.where("total > 1").select(*same), same, "left_semi")
        sure.append(again.select("least", "most", "off", "block", "places", F.octet_length("ctx").alias("size")).mapInArrow(lambda it: _certain(it, length), SPANS))
        distinct = big.join(times.select(*same, "total", "one"), same).where("block = one.block and places = one.places").dropDuplicates(same)
        distinct = distinct.select("g", "least", "most", "off", F.least("total", F.lit(2).cast("long")).alias("n"), "block", F.when(F.col("total") > 1, F.lit(b"")).otherwise(F.col("places")).alias("places"), "ctx")
        middle = F.floor((F.col("least") + F.col("most")) / 2).cast("int")
        halves = F.array(F.struct(F.col("least").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("most").alias("b")))
        parts = distinct.where("least < most").select("*", F.explode(halves).alias("r"))
        # windows of this range need r.a bytes before the anchor, and so many after it; where there are fewer, it has none
        after = length - F.col("r.b")
        parts = parts.where((F.col("off") >= F.col("r.a")) & (F.octet_length("ctx") - F.col("off") >= after))
        key = F.xxhash64("g", "r.a", F.substring(F.col("ctx"), F.col("off") - F.col("r.a") + 1, F.col("r.a") + after))
        parts = parts.select(key.alias("g"), F.col("r.a").alias("least"), F.col("r.b").alias("most"), "off", "n", "block", "places", "ctx")
        single = distinct.where("least = most")  # one window, which is the key: the rows of a group repeat each other
        sure.append(single.where("octet_length(places) > 0").select("least", "most", "off", "block", "places", F.octet_length("ctx").alias("size")).mapInArrow(lambda it: _certain(it, length), SPANS))
        rows = stored(parts, "halves")


def packed(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """(block, rows) of docs, stored in buckets of blocks, and the number of buckets."""
    schema = docs.limit(0).select(F.lit(0).cast("long").alias("block"), F.array(F.struct(*docs.columns)).alias("rows")).schema
    schema["rows"].dataType = ArrayType(docs.schema, True)
    total = docs.select(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return bucketed(docs.mapInArrow(lambda it: _blocks(it, text), schema), "block", total, "blocks")


def repeated_spans(blocks: DataFrame, buckets: int, text: str = "text", length: int = 200, hot: int = HOT) -> DataFrame:
    """(block, spans): for each block the byte spans covered by repeats, as (row, start << 32 | end); partitioned like the blocks."""
    texts = blocks.select("block", F.col("rows").getField(text).alias("texts"))
    counted = stored(texts.mapInArrow(lambda it: _anchor_counts(it, length), "h long, block long, n long"), "anchors")
    twice = counted.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    wanted = counted.join(twice, "h", "left_semi").select("block", "h").repartition(buckets, "block").groupBy("block").agg(F.collect_set("h").alias("hs"))
    found = texts.join(wanted.hint("merge"), "block").mapInArrow(lambda it: _contexts(it, length), FOUND)
    small, sure = split_hot(stored(found, "contexts"), length, hot)
    judged = small.repartition("g").sortWithinPartitions("g").mapInArrow(lambda it: _sorted_groups(it, length), SPANS)
    spans = reduce(DataFrame.unionByName, sure, judged)
    return spans.repartition(buckets, "block").groupBy("block").agg(F.collect_set(F.struct("row", "span")).alias("spans"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of packed spans."""
    out: list[list[int]] = []
    for x in np.sort(spans).tolist():
        s, e = x >> 32, x & 0xFFFFFFFF
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def whole_characters(raw: bytes, start: int, end: int) -> tuple[int, int]:
    """The span without the parts of characters at its edges."""
    while start < end and raw[start] & 0xC0 == 0x80:
        start += 1
    while start < end < len(raw) and raw[end] & 0xC0 == 0x80:
        end -= 1
    return start, end


def remove_repeats(docs: DataFrame, text: str = "text", length: int = 200, hot: int = HOT, characters: bool = False) -> DataFrame:
    """docs with `kept` (binary, the bytes that remain) and `removed` (array of byte spans), for every row.

    A byte goes if a string of `length` bytes that covers it starts anywhere else, in the same
    text or another; all copies go. With `characters`, a character of several bytes goes only if all of
    them do, so that what is kept stays UTF-8. Null and empty texts keep nothing and lose nothing; texts under
    `length` bytes stay whole, very long ones are hashed in overlapping pieces. Repeated rows count as copies
    of each other, so ties lose all copies alike. An empty table gives an empty one. Input columns named
    `kept` or `removed` are replaced; no other name can clash.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("kept", "removed")])
    blocks, buckets = packed(docs, text)
    joined = blocks.join(repeated_spans(blocks, buckets, text, length, hot).hint("merge"), "block", "left").select("rows", "spans")

    def cut(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for rows, found in zip(batch.column(0), batch.column(1), strict=True):
                rows = rows.values
                own: dict[int, list[int]] = {}
                for x in found.as_py() or []:
                    own.setdefault(x["row"], []).append(x["span"])
                kept, removed = [], []
                for i, t in enumerate(rows.field(text).cast(pa.binary())):
                    runs = merged(np.array(own[i])) if i in own else []
                    t = t.as_py() or b""
                    if characters:
                        runs = [r for a, b in runs if (r := whole_characters(t, a, b))[0] < r[1]]
                    edges = [0, *(x for r in runs for x in r), len(t)]
                    kept.append(b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else t)
                    removed.append([{"start": a, "end": b} for a, b in runs])
                names = [f.name for f in rows.type]
                yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(kept, pa.binary()), pa.array(removed, kind)], names=[*names, "kept", "removed"])

    schema = docs.withColumns({"kept": F.lit(b""), "removed": F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")}).schema
    return joined.mapInArrow(cut, schema)


def brute_force(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by counting every window; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        kept = bytes(b for b, g in zip(r, gone[1:-1].tolist(), strict=True) if not g)
        out.append((len(r), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), sha256(kept).hexdigest()))
    return out
