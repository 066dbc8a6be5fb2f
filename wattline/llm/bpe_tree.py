"""Byte-level BPE of whole texts as a tree reduction.

The encodings of text segments form a monoid: the value of a segment is its list of pieces (the
pattern's matches) with their ids, and two neighbours are joined by encoding a window around the
seam again, growing it until what lies outside is provably unchanged. Segments are halved until
they are a few lines long, so a text is a balanced tree of joins, and its value comes up to the root; a long
piece (an unbroken run of letters) is reduced in the same way, with tokens in place of pieces.

Why the windows suffice:
- The pattern scans left to right without memory: from a place where a match began, the scan is
  the same whatever came before. A match depends on at most two characters after its end
  (contractions), so matches that end three characters before the seam stand. From there the scan
  runs again, until it ends a match where the right segment's own scan ended one.
- A token sequence is the BPE encoding of its bytes if and only if each pair of neighbours is
  the encoding of its own bytes. If the window's first and last tokens come out as before, all
  pairs outside and across its edges are pairs that stood before.

Decoding concatenates the tokens' bytes, in halves up the same tree.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import pyarrow as pa
import regex
from pyspark import SparkContext
from pyspark.sql import DataFrame, functions as F

LEAF = 256  # characters of a segment that is not halved
PIECE = 32  # bytes of a piece that is not halved
CACHED = 1 << 18  # pieces remembered in a process


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


Segment = tuple[list[str], list[tuple[int, ...]]]


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern)
        self.tokens = {v: k for k, v in ranks.items()}
        self.seen: dict[str, tuple[int, ...]] = {}

    # -- bytes of one piece ------------------------------------------------------------------

    def merge(self, raw: bytes) -> list[int]:
        """Ids of a short run of bytes: the adjacent pair with the least rank is merged, again and again."""
        ranks = self.ranks
        if (one := ranks.get(raw)) is not None:
            return [one]
        parts = [raw[i : i + 1] for i in range(len(raw))]
        pairs = [ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < 1 << 60:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def run(self, raw: bytes) -> list[int]:
        if len(raw) <= PIECE:
            return self.merge(raw)
        half = len(raw) // 2
        return self.join_tokens(self.run(raw[:half]), self.run(raw[half:]))

    def join_tokens(self, a: list[int], b: list[int]) -> list[int]:
        """The encoding of the bytes of a and b together: growing windows around the seam."""
        width = 4
        while True:
            left, right = a[-width:], b[:width]
            whole = width >= len(a) and width >= len(b)
            raw = self.bytes_of([*left, *right])
            window = self.merge(raw)
            if whole or ((width >= len(a) or window[0] == left[0]) and (width >= len(b) or window[-1] == right[-1]) and len(window) > 1):
                return a[: max(0, len(a) - width)] + window + b[width:]
            width *= 2

    # -- segments of text --------------------------------------------------------------------

    def ids_of(self, piece: str) -> tuple[int, ...]:
        ids = self.seen.get(piece)
        if ids is None:
            ids = tuple(self.run(piece.encode()))
            if len(piece) <= 64:
                if len(self.seen) >= CACHED:
                    self.seen.clear()
                self.seen[piece] = ids
        return ids

    def segment(self, text: str) -> Segment:
        """The value of a text: its pieces, and the ids of each."""
        if len(text) <= LEAF:
            pieces = self.find.findall(text)
            return pieces, list(map(self.ids_of, pieces))
        half = len(text) // 2
        return self.joined(self.segment(text[:half]), self.segment(text[half:]))

    def joined(self, left: Segment, right: Segment) -> Segment:
        """The value of both texts together; only the pieces of the window are encoded again."""
        (a, a_ids), (b, b_ids) = left, right
        back = reach = 0
        while back < len(a) and reach < 3:  # matches that end three characters or more before the seam stand
            back += 1
            reach += len(a[-back])
        if back < len(a):
            back += 1
        head = "".join(a[len(a) - back :])
        width = 8
        while True:
            bounds, at = [], len(head)
            for p in b[:width]:
                at += len(p)
                bounds.append(at)
            seam, whole = head + "".join(b[:width]), width >= len(b)
            # matches near the end of the window may change with what follows, so a joint end must lie before it
            out, last, same = [], len(seam) if whole else len(seam) - 3, -1
            for m in self.find.finditer(seam):
                out.append(m.group())
                e = m.end()
                k = bisect_left(bounds, e)
                if len(head) < e <= last and k < len(bounds) and bounds[k] == e:
                    same = k
                    break
            if same >= 0 or whole:
                same = same if same >= 0 else len(b)
                del a[len(a) - back :], a_ids[len(a_ids) - back :]
                a += out
                a_ids += map(self.ids_of, out)
                a += b[same + 1 :]
                a_ids += b_ids[same + 1 :]
                return a, a_ids
            width *= 2

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.segment(text)[1]))

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF:
            return self.bytes_of(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    return Coder(load_ranks(path), pattern)


def _local(path: str, shipped: bool) -> str:
    from pyspark import SparkFiles

    return SparkFiles.get(path.rsplit("/", 1)[-1]) if shipped else path


def ship(sc: SparkContext, path: str) -> None:
    """The vocabulary file goes to every executor (it has a fixed, small size)."""
    if path not in getattr(sc, "_wattline_shipped", set()):
        sc.addFile(path)
        sc._wattline_shipped = getattr(sc, "_wattline_shipped", set()) | {path}


def encode_texts(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with `ids` (array of int): the encoding of each whole text, however long; null and empty texts have none.

    Repeated rows stay repeated, an empty table stays empty. A column named like `ids` is replaced, other names cannot clash.
    """
    ship(docs.sparkSession.sparkContext, path)
    names = [c for c in docs.columns if c != ids]
    docs = docs.select(*names)

    def coded(batches) -> Iterator[pa.RecordBatch]:
        own = coder(_local(path, True), pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                got = [own.encode(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.list_(pa.int32()))], names=[*names, ids])

    return docs.mapInArrow(coded, docs.withColumn(ids, F.expr("cast(array() as array<int>)")).schema)


def decode_ids(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with `out` (binary): the bytes of `ids`; null ids count as none."""
    ship(docs.sparkSession.sparkContext, path)
    names = [c for c in docs.columns if c != out]
    docs = docs.select(*names)

    def coded(batches) -> Iterator[pa.RecordBatch]:
        own = coder(_local(path, True), pattern)
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                got = [own.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.binary())], names=[*names, out])

    return docs.mapInArrow(coded, docs.withColumn(out, F.lit(b"")).schema)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs without the text, with n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass.

    The digests are made beside the ids, so that arrays of all ids need not travel between processes. Null and empty
    texts have no tokens and the digest of nothing; a very long text is a higher tree; repeated rows stay repeated, an empty table
    stays empty. Columns with the names of results are replaced.
    """
    ship(docs.sparkSession.sparkContext, path)
    added = ("n_tokens", "ids_sha256", "decoded_sha256")
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*names)

    def coded(batches) -> Iterator[pa.RecordBatch]:
        own = coder(_local(path, True), pattern)
        for batch in batches:
            at = batch.schema.get_field_index(text)
            n, ids, back = [], [], []
            for t in batch.column(at):
                got = own.encode(t.as_py() or "")
                n.append(len(got))
                ids.append(sha256(" ".join(map(str, got)).encode()).hexdigest())
                back.append(sha256(own.decode(got)).hexdigest())
            rest = [(c, batch.column(c)) for c in names if c != text]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=[*(c for c, _ in rest), *added])

    schema = docs.drop(text).withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema
    return docs.mapInArrow(coded, schema)
