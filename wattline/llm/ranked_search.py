"""Ranked lexical search by MaxScore with bounds of term pairs.

Documents are indexed in blocks. A block's index has each term's documents with their impacts (a term's part of the
score, whole), and for each pair of neighbours in a query's order of terms, from the commonest to the rarest, the largest joint
impact of the documents in the intersection of their lists. A document with both terms of a pair has at most that, any
other at most the larger of the two, so a pair's bound is never over the sum of its terms' own. For each beginning of
the order the cheapest way to part it into pairs and single terms bounds what its terms add together. While that stays under the
score of the k-th best document found so far, these terms alone cannot bring up a document; they are looked up for candidates only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from wattline.llm.common import stored

#: Bytes of query texts (and of each query besides) that one pass over the documents serves; their terms are broadcast.
CHUNK, EACH = 1 << 23, 64
PIECE = 1 << 20
#: Terms are runs of these bytes; A to Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: The rows of an index that are no terms.
IDS, JOINT = -1, -2
INDEX = "block long, term int, at array<int>, value array<long>, most long"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, in lists of about a megabyte of text."""
    folded, start = text.translate(_FOLD), 0
    while start < len(folded):
        end = folded.find(b" ", start + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[start:end].split()
        start = end


def counts(text: bytes) -> Counter:
    out: Counter = Counter()
    for part in terms(text):
        out.update(part)
    return out


@dataclass(frozen=True)
class Query:
    terms: np.ndarray  # numbers in the vocabulary, the commonest first
    times: np.ndarray  # how often the query has each
    pairs: np.ndarray  # the number of the pair of each term but the first with the one before


@dataclass(frozen=True)
class Plan:
    """What the tasks need to know of a set of queries."""

    vocabulary: dict[bytes, int]
    weights: np.ndarray
    scale: tuple[int, int]  # documents with terms, and all their terms
    queries: list[Query]
    pairs: np.ndarray  # rows (term, its times, other term, its times)


def count_terms(docs: DataFrame, text: str, key: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, term, tf) of every document: n counts all its terms, term and tf are those of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = shared.value
        for batch in batches:
            n, term, tf, ends = [], [], [], [0]
            for t in batch.column(1):
                found = counts(t.as_py().encode() if t.is_valid else b"")
                n.append(found.total())
                for w in found.keys() & known.keys():
                    term.append(known[w])
                    tf.append(found[w])
                ends.append(len(term))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["id", "n", "term", "tf"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "id long, n long, term array<int>, tf array<int>")


def plan(counted: DataFrame, vocabulary: dict[bytes, int], texts: list[Counter]) -> Plan:
    """Weights of the terms, the queries' orders of terms, and the pairs of neighbours in them."""
    row = counted.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n, total = row.docs, row.terms or 0
    df = {r.t: r["count"] for r in counted.select(F.explode("term").alias("t")).groupBy("t").count().collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) if t in df else 0 for t in range(len(vocabulary))], np.int64)
    numbers: dict[tuple, int] = {}
    queries = []
    for text in texts:
        own = sorted((int(weights[t]), t, k) for w, k in text.items() if weights[t := vocabulary[w]] > 0)
        pairs = [numbers.setdefault((*x[1:], *y[1:]), len(numbers)) for x, y in zip(own, own[1:], strict=False)]
        queries.append(Query(*(np.array(x, np.int64) for x in ([t for _, t, _ in own], [k for *_, k in own], pairs))))
    return Plan(vocabulary, weights, (n, total), queries, np.array(list(numbers), np.int64).reshape(-1, 4))


def impacts(term: np.ndarray, tf: np.ndarray, n: np.ndarray, p: Plan) -> np.ndarray:
    """Each occurrence's part of the score: w * (10**9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L."""
    docs, total = p.scale
    m = 75 + 25 * n * docs // total
    return p.weights[term] * (10**9 * tf // (1000 * tf + 12 * m))


def joint_maxima(lists: dict[int, tuple[np.ndarray, np.ndarray]], pairs: np.ndarray, size: int) -> np.ndarray:
    """The largest joint impact in the intersection of each pair's lists; 0 where they have no document in common."""
    out, marks = np.zeros(len(pairs), np.int64), np.zeros(size, np.int64)
    last = None
    for i, (a, ka, b, kb) in enumerate(pairs.tolist()):
        if a not in lists or b not in lists:
            continue
        if last != (a, ka):
            if last:
                marks[lists[last[0]][0]] = 0
            at, value = lists[a]
            marks[at] = ka * value
            last = (a, ka)
        at, value = lists[b]
        other = marks[at]
        both = other > 0
        if both.any():
            out[i] = (other + kb * value)[both].max()
    return out


def index(counted: DataFrame, p: Plan) -> DataFrame:
    """The blocks' index (see INDEX), stored: a row for each term's list, one for the documents' ids, one for the pairs' joint maxima.

    A block is a batch of rows, so its size is bounded by Spark's own limit of batches.
    """
    shared = counted.sparkSession.sparkContext.broadcast(p)

    def run(batches):
        own, task = shared.value, TaskContext.get().partitionId()
        for number, batch in enumerate(batches):
            size, ids, n, term, tf = batch.num_rows, *batch.columns
            if not size:
                continue
            length = np.diff(np.asarray(term.offsets))
            at = np.repeat(np.arange(size, dtype=np.int32), length)
            t, k = np.asarray(term.flatten()).astype(np.int64), np.asarray(tf.flatten()).astype(np.int64)
            value = impacts(t, k, np.asarray(n)[at], own)
            use = np.flatnonzero(value)
            by = use[np.argsort(t[use], kind="stable")]
            t, at, value = t[by], at[by], value[by]
            names, first = np.unique(t, return_index=True)
            ends = np.append(first, len(t))
            lists = {x: (at[a:b], value[a:b]) for x, a, b in zip(names.tolist(), ends[:-1], ends[1:], strict=True)}
            joint = joint_maxima(lists, own.pairs, size)
            found = np.flatnonzero(joint)
            places = np.concatenate([at, np.arange(size), found]).astype(np.int32)
            values = pa.concat_arrays([pa.array(value, pa.int64()), ids, pa.array(joint[found], pa.int64())])
            offsets = pa.array(np.concatenate([ends, [len(t) + size, len(places)]]).astype(np.int32))
            most = [int(v.max()) for _, v in lists.values()]
            rows = len(names) + 2
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([(task << 32) + number] * rows, pa.int64()),
                    pa.array([*names.tolist(), IDS, JOINT], pa.int32()),
                    pa.ListArray.from_arrays(offsets, pa.array(places)),
                    pa.ListArray.from_arrays(offsets, values),
                    pa.array([*most, 0, 0], pa.int64()),
                ],
                names=["block", "term", "at", "value", "most"],
            )

    return stored(counted.where(F.size("term") > 0).mapInArrow(run, INDEX), "index")


def bounds(single: list[int], joint: list[int]) -> np.ndarray:
    """What the first i + 1 terms can add to a score together. single: the terms' own bounds; joint: maxima of neighbours."""
    out = [0]
    for i, own in enumerate(single):
        least = out[-1] + own
        if i and joint:
            least = min(least, out[-2] + max(single[i - 1], own, joint[i - 1]))
        out.append(least)
    return np.array(out[1:], np.int64)


def best_of(lists: dict[int, tuple[np.ndarray, np.ndarray]], q: Query, joint: np.ndarray, size: int, least: int, paired: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Documents of a block that may have a score of `least` and more, with their whole scores, and how many were looked at.

    All that reach `least` are among them. Without `paired`, the terms' own bounds are used alone.
    """
    single = [k * int(lists[t][1].max()) if t in lists else 0 for t, k in zip(q.terms.tolist(), q.times.tolist(), strict=True)]
    under = bounds(single, joint[q.pairs].tolist() if paired else [])
    if not len(under) or under[-1] < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    score = np.zeros(size, np.int64)
    split = int(np.searchsorted(under, least))  # the terms before it together stay under the least score
    own = [(lists[t], k) for t, k in zip(q.terms.tolist(), q.times.tolist(), strict=True) if t in lists]
    there = [i for i, s in enumerate(single) if s]
    for i, ((at, value), k) in zip(there, own, strict=True):
        if i >= split:
            score[at] += k * value
    left = np.flatnonzero(score)
    seen = len(left)
    for i, ((at, value), k) in zip(there[::-1], own[::-1], strict=True):
        if i < split:
            left = left[score[left] + under[i] >= least]
            place = np.minimum(np.searchsorted(at, left), len(at) - 1)
            hit = at[place] == left
            score[left[hit]] += k * value[place[hit]]
    left = left[score[left] >= max(least, 1)]
    return left, score[left], seen


def _order(ids: np.ndarray, score: np.ndarray, absent: np.ndarray) -> np.ndarray:
    return np.lexsort((ids, absent, -score))


def search(docs: DataFrame, items: DataFrame, top: int = 20, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The `top` best documents of each item: item, rank (from 1), doc_id, score; equal scores by ascending id, null ids last.

    Texts are read whole; null, empty and termless texts have no terms, so such items have no rows and such documents are in none.
    A repeated row of docs is a document of its own; each row of items is an item of its own. Ids of documents are
    longs. Only the named columns are read, so others of any name are safe; an empty table on either side gives no rows.
    Items are served in passes of about CHUNK bytes of text (a longer item has a pass of its own).
    """
    rows = items.select(F.col(item).alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text <> ''")
    size = rows.agg(F.sum(F.octet_length("text") + EACH)).first()[0] or 0
    passes = size // CHUNK + 1
    parts = [_pass(docs, rows.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == i), top, text, key) for i in range(passes)]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _pass(docs: DataFrame, items: DataFrame, top: int, text: str, key: str) -> DataFrame:
    spark = docs.sparkSession
    asked = items.collect()
    texts = [counts((r.text or "").encode()) for r in asked]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*texts)))}
    counted = stored(count_terms(docs, text, key, vocabulary), "counted")
    p = plan(counted, vocabulary, texts)
    found = index(counted, p).groupBy("block").applyInArrow(_searcher(spark, p, top), "item int, id long, score long")
    by = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(asked)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def _searcher(spark, p: Plan, top: int):
    """A function of a block's index that gives what enters the best lists; these are kept from block to block of a task."""
    shared = spark.sparkContext.broadcast((p.queries, len(p.pairs)))
    best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def run(group: pa.Table) -> pa.Table:
        queries, n_pairs = shared.value
        group = group.combine_chunks()
        lists, joint, ids, absent = {}, np.zeros(n_pairs, np.int64), None, None
        term, at, value = group["term"].to_pylist(), group["at"].chunk(0), group["value"].chunk(0)
        for i, t in enumerate(term):
            if t == IDS:
                own = value[i].values
                absent = np.asarray(own.is_null())
                ids = np.asarray(own.fill_null(0))
            elif t == JOINT:
                joint[np.asarray(at[i].values)] = np.asarray(value[i].values)
            else:
                lists[t] = (np.asarray(at[i].values), np.asarray(value[i].values))
        out = []
        nothing = np.zeros(0, np.int64)
        for number, q in enumerate(queries):
            had_ids, had_score, had_absent = best.get(number, (nothing, nothing, nothing.astype(bool)))
            least = int(had_score[-1]) if len(had_score) == top else 0
            left, score, _ = best_of(lists, q, joint, len(ids), least)
            if not len(left):
                continue
            if len(left) > top:
                keep = score >= np.partition(score, len(score) - top)[len(score) - top]
                left, score = left[keep], score[keep]
            all_ids, all_score, all_absent = np.concatenate([had_ids, ids[left]]), np.concatenate([had_score, score]), np.concatenate([had_absent, absent[left]])
            order = _order(all_ids, all_score, all_absent)[:top]
            best[number] = all_ids[order], all_score[order], all_absent[order]
            new = order[order >= len(had_ids)]
            out.append((np.full(len(new), number, np.int32), pa.array(all_ids[new], mask=all_absent[new]), all_score[new]))
        if not out:
            return pa.table({"item": pa.array([], pa.int32()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        return pa.table({"item": np.concatenate([x[0] for x in out]), "id": pa.concat_arrays([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    return run
