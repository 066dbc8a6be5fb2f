"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts are cut into windows of twice a template class's size, half overlapping, so a template's
words lie whole in one window. A window and a template it holds, with at least m of its n
shingles, share at least the Jaccard similarity m / (window + n - m); bands of one MinHash value each are as many as give
that similarity the chance `recall`. Windows that share a band value with a template are
verified by counting the template's shingles in them.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from wattline.llm.common import SHINGLE, SIMILAR, mixed
from wattline.llm.licenses import TEMPLATES
from wattline.llm.shingles import shingle_hashes

_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _sets(words: list[str], n: int) -> np.ndarray:
    """Hashes of the shingles of a token list, in order."""
    out = [h for _, _, h, _ in shingle_hashes(pa.array([" ".join(words)]), n)]
    return out[0] if out else np.zeros(0, np.uint64)


class Index:
    """Templates by size class and shingle width (shorter than usual for shorter templates), with their band values.

    A template of one shingle needs no overlap: its windows are single shingles, one band finds all.
    """

    def __init__(self, templates: dict[str, str], contained: float, recall: float):
        self.groups: list[tuple[int, int, np.ndarray, dict[int, list[str]], dict[str, np.ndarray]]] = []
        by: dict[tuple[int, int], list[str]] = defaultdict(list)
        words = {k: tokens(t) for k, t in templates.items()}
        for k, w in words.items():
            if w:
                n = min(SHINGLE, len(w))
                by[n, (len(w) - n + 1 - 1).bit_length()].append(k)
        for (n, power), names in sorted(by.items()):
            sets = {k: np.unique(_sets(words[k], n)) for k in names}
            size = 1 << power  # shingles of the largest template here; windows hold twice as many
            window = 2 * size if size > 1 else 1
            need = min(math.ceil(contained * len(s) - 1e-9) / (len(s) + window - math.ceil(contained * len(s) - 1e-9)) for s in sets.values())
            j = min(1.0, need)
            count = 1 if j >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - j))
            salts = mixed(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(n * 64 + power + 1)) | np.uint64(1)
            band: dict[int, list[str]] = defaultdict(list)
            for k, s in sets.items():
                for i, salt in enumerate(salts):
                    band[int((s * salt).min() + np.uint64(i))].append(k)
            self.groups.append((n, size, salts, dict(band), sets))

    def find(self, found: list[list[str]], contained: float) -> dict[tuple[int, str], tuple[int, int, int]]:
        """(row, template) -> (first word, words, shingles found) of the best window, over a batch of token lists."""
        out: dict[tuple[int, str], tuple[int, int, int]] = {}
        widths = {n for n, *_ in self.groups}
        text = pa.array([" ".join(t) if t else "" for t in found])
        for n in widths:
            for first, _, h, bounds in shingle_hashes(text, n):
                for g, size, salts, band, sets in self.groups:
                    if g != n or not len(h):
                        continue
                    self._windows(first, h, bounds, size, n, salts, band, sets, contained, out)
        return out

    def _windows(self, first, h, bounds, size, n, salts, band, sets, contained, out) -> None:
        count = np.diff(bounds)
        wide = 2 * size if size > 1 else 1
        per = np.where(count > 0, np.maximum(1, -(-count // size) - (size > 1)), 0)  # windows of 2 * size, every size
        row = np.repeat(np.arange(len(count)), per)
        start = bounds[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * size
        end = np.minimum(start + wide, bounds[row + 1])
        edges = np.unique(np.concatenate([start, np.minimum(start + size, end), end]))
        edges = edges[edges < len(h)]
        block_of = np.searchsorted(edges, start)
        keys = np.array(list(band), np.uint64)
        keys.sort()
        hit: set[tuple[int, str]] = set()
        for i, salt in enumerate(salts):
            least = np.minimum.reduceat(h * salt, edges)  # least value of each half window, then of both halves
            second = np.minimum(block_of + 1, len(edges) - 1)
            both = np.where((second > block_of) & (edges[second] < end), np.minimum(least[block_of], least[second]), least[block_of])
            value = both + np.uint64(i)
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            for w in np.flatnonzero(keys[at] == value).tolist():
                hit.update((w, k) for k in band[int(value[w])])
        for w, k in hit:
            inside = np.isin(sets[k], h[start[w] : end[w]])
            if inside.sum() >= contained * len(sets[k]) - 1e-9:
                key = (first + int(row[w]), k)
                mine = np.flatnonzero(np.isin(h[start[w] : end[w]], sets[k]))
                own = (int(start[w] - bounds[row[w]] + mine[0]), int(mine[-1] - mine[0]) + n, int(inside.sum()))
                if key not in out or (own[2], -own[0]) > (out[key][2], -out[key][0]):
                    out[key] = own


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text: str = "text", contained: float = SIMILAR, recall: float = 1 - 1e-6) -> DataFrame:
    """docs without the text, with `licenses`: an array of (template, first_word, n_words, n_found, n_template), ordered by name.

    A template counts as present if at least `contained` of its word shingles (five words; all of its words for
    shorter ones) lie within one window; the place is that of its best window. Words are lower-case runs of letters
    and digits. Null, empty and wordless texts have none; very long texts are scanned whole; of windows that hold equally many
    shingles of a template the first is its place. Repeated rows stay repeated, an empty table stays empty. A column named
    licenses is replaced.
    """
    templates = TEMPLATES if templates is None else templates
    docs = docs.select(*[c for c in docs.columns if c != "licenses"])
    kind = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_found", pa.int64()), ("n_template", pa.int64())]))

    def run(batches) -> Iterator[pa.RecordBatch]:
        index = Index(templates, contained, recall)
        size = reduce(lambda a, g: a | {k: len(s) for k, s in g[4].items()}, index.groups, {})
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                found = index.find([tokens(t.as_py()) for t in column.slice(i, 512)], contained)
                got: list[list[dict]] = [[] for _ in range(len(part))]
                for (r, k), (at, n, hits) in sorted(found.items(), key=lambda x: x[0]):
                    got[r].append({"template": k, "first_word": at, "n_words": n, "n_found": hits, "n_template": size[k]})
                rest = [(c, part.column(c)) for c in part.schema.names if c != text]
                yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(got, kind)], names=[*(c for c, _ in rest), "licenses"])

    schema = docs.drop(text).withColumn("licenses", F.expr("cast(array() as array<struct<template:string,first_word:bigint,n_words:bigint,n_found:bigint,n_template:bigint>>)")).schema
    return docs.mapInArrow(run, schema)
