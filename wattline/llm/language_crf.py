"""Language identification of words and texts by a linear-chain conditional random field.

A word's features are its affixes, its byte n-grams and what a lexicon, counted by Spark over all texts that may be
learned from, says of it; transitions between the languages of neighbouring words are learned from passages of several
languages set next to each other. Forward-backward gives each word's probabilities given the whole text, so a
text that changes its language keeps its parts apart; the text's language is that of most of its words.

All texts of a batch are one chain, in which a text's first word forgets what came before. The chain is cut into equal
parts; the parts' transfer matrices are multiplied for all parts at once, so a long text takes no more steps than short ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from wattline.llm.common import broadcast_rows, byte_table, mixed, stored, utf8
from wattline.llm.shingles import _powers

#: Hashed features besides those of the lexicon; words in the lexicon at most; how sure it is of a word's language, in steps.
DIM, LEXICON, SURE = 1 << 17, 1 << 17, (0.7, 0.95)
#: Texts of a language that are fitted on, about; words of all that are, at most.
SAMPLE, MOST_WORDS = 400, 300_000
#: Bytes of text that are labelled at once.
PIECE = 1 << 21
#: Steps after which probabilities are set to a sum of 1 again.
OFTEN = 8
UNKNOWN = "und"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTES, _P = byte_table(11), 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Words:
    """The distinct words of some rows, and which of them stands where."""

    data: np.ndarray
    start: np.ndarray  # of each distinct word in data
    length: np.ndarray
    key: np.ndarray
    of: np.ndarray  # the distinct word of each word in text order
    row: np.ndarray  # and its row


def _keys(data: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and 64-bit key of each word of data; a word ends at the places `edge` in any case.

    A key is a sum of byte values times powers of their places, as a difference of running sums shifted back to place 0.
    """
    inner = _LETTER[data]
    on = inner[1:] & inner[:-1]
    on[edge - 1] = False
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~on
    ends[:-1] &= ~on
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(len(data), _P), out=total[1:])
    return start, end - start, mixed((total[end] - total[start]) * _powers(len(data) + 1, pow(_P, -1, 2**64))[start])


def words(data: np.ndarray, at: np.ndarray) -> Words:
    """Words are runs of ASCII letters and of bytes outside ASCII; rows are data[at[i]:at[i+1]].

    Text is looked at in slices that end where a word does, so what is needed beside it grows with its words only.
    """
    starts, lengths, keys = [], [], []
    a = 0
    while a < len(data):
        b = min(len(data), a + PIECE)
        while b < len(data) and _LETTER[data[b]]:
            b += 1
        edge = at[np.searchsorted(at, a, side="right") : np.searchsorted(at, b)] - a
        s, n, k = _keys(data[a:b], edge)
        starts.append(s + a)
        lengths.append(n)
        keys.append(k)
        a = b
    empty = np.zeros(0, np.int64)
    start, length = np.concatenate([empty, *starts]), np.concatenate([empty, *lengths])
    of, key = pd.factorize(np.concatenate([empty.astype(np.uint64), *keys]))
    first = np.zeros(len(key), np.int64)
    first[of[::-1]] = np.arange(len(of))[::-1]
    return Words(data, start[first], length[first], key, of, np.searchsorted(at, start, side="right") - 1)


def features(w: Words, lexicon: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the distinct words, and where each word's begin: at least one for each word.

    Pairs and triples of bytes with a blank at both ends, the first and last three and four bytes, and the lexicon's class.
    """
    size = w.length + 2
    ends = np.cumsum(size)
    begin = ends - size
    x = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint32)
    inner = np.arange(int(w.length.sum())) - np.repeat(np.cumsum(w.length) - w.length, w.length)
    x[np.repeat(begin + 1, w.length) + inner] = w.data[np.repeat(w.start, w.length) + inner]
    owner = np.repeat(np.arange(len(size)), size)
    ids, owners = [], []

    def add(value: np.ndarray, own: np.ndarray, salt: int) -> None:
        ids.append(((value * np.uint32(2654435761) + np.uint32(salt)) * np.uint32(2246822519)) >> np.uint32(15))
        owners.append(own)

    two = x[:-1] << np.uint32(8) | x[1:]
    same = owner[:-1] == owner[1:]
    add(two[same], owner[:-1][same], 17)
    three = two[:-1] << np.uint32(8) | x[2:]
    same = owner[:-2] == owner[2:]
    add(three[same], owner[:-2][same], 29)
    for n in (3, 4):
        own = np.flatnonzero(w.length >= n)
        for salt, at in ((101, begin[own] + 1), (211, begin[own] + 1 + w.length[own] - n)):
            value = np.zeros(len(own), np.uint32)
            for k in range(n):
                value = value * np.uint32(16777619) ^ x[at + k]
            add(value, own, salt + n)
    keys, kind = lexicon
    place = np.minimum(np.searchsorted(keys, w.key), max(len(keys) - 1, 0))
    known = keys[place] == w.key if len(keys) else np.zeros(len(w.key), bool)
    ids.append((DIM + np.where(known, kind[place] + 1 if len(keys) else 0, 0)).astype(np.uint32))
    owners.append(np.arange(len(size)))
    order = np.argsort(np.concatenate(owners), kind="stable")
    ids, owners = np.concatenate(ids).astype(np.int64)[order], np.concatenate(owners)[order]
    return ids, np.searchsorted(owners, np.arange(len(size)))


@dataclass(frozen=True)
class Chain:
    """Probabilities of the languages of each word, and of each pair of neighbours, summed."""

    words: np.ndarray
    steps: np.ndarray


def forward_backward(emit: np.ndarray, begins: np.ndarray, trans: np.ndarray, first: np.ndarray) -> Chain:
    """emit: a score of each language for each word; begins: words before which all is forgotten; trans, first: scores of steps and of first words.

    The chain is cut into about as many parts as a part has words; all parts take a step at once.
    """
    n, t = emit.shape
    if not n:
        return Chain(np.zeros((0, t)), np.zeros((t, t)))
    k = max(1, int(np.sqrt(n)))
    c = -(-n // k)
    e = np.ones((c * k, t))
    e[:n] = np.exp(emit - emit.max(1, keepdims=True))
    b = np.ones(c * k, bool)
    b[:n] = begins
    # step j of all parts is e[j]; a language's score falls by a bounded factor a step, so sums are set to 1 now and then
    e, b, step, start = np.ascontiguousarray(e.reshape(c, k, t).transpose(1, 0, 2)), b.reshape(c, k).T, np.exp(trans - trans.max()), np.exp(first - first.max())
    resets = [np.flatnonzero(x) for x in b]
    through = np.tile(np.eye(t), (c, 1, 1))
    for j in range(k):
        then = (through.reshape(-1, t) @ step).reshape(c, t, t)
        if len(r := resets[j]):
            then[r] = through[r].sum(2, keepdims=True) * start
        through = then * e[j][:, None, :]
        if j % OFTEN == 0 or j == k - 1:
            through /= through.sum((1, 2), keepdims=True)
    a, z = np.ones((c, t)) / t, np.ones((c, t)) / t  # before a part's first word, after its last
    for i in range(1, c):
        a[i] = a[i - 1] @ through[i - 1]
        a[i] /= a[i].sum()
    for i in range(c - 2, -1, -1):
        z[i] = through[i + 1] @ z[i + 1]
        z[i] /= z[i].sum()
    ahead, back = np.empty((k, c, t)), np.empty((k, c, t))
    for j in range(k):
        then = a @ step
        if len(r := resets[j]):
            then[r] = a[r].sum(1, keepdims=True) * start
        a = then * e[j]
        if j % OFTEN == 0:
            a /= a.sum(1, keepdims=True)
        ahead[j] = a
    for j in range(k - 1, -1, -1):
        back[j] = z
        v = e[j] * z
        z = v @ step.T
        if len(r := resets[j]):
            z[r] = (v[r] @ start)[:, None]
        if j % OFTEN == 0:
            z /= z.sum(1, keepdims=True)
    ahead, back, e = (x.transpose(1, 0, 2).reshape(-1, t)[:n] for x in (ahead, back, e))
    p = ahead * back
    p /= p.sum(1, keepdims=True)
    inner = np.flatnonzero(~begins[1:]) + 1
    before, after = ahead[inner - 1], e[inner] * back[inner]
    weight = before / ((before @ step) * after).sum(1, keepdims=True)
    return Chain(p, step * (weight.T @ after))


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # a row for each feature
    trans: np.ndarray
    first: np.ndarray
    lexicon: tuple[np.ndarray, np.ndarray]


def _scores(w: Words, m: Model) -> np.ndarray:
    """Emission scores of the distinct words."""
    ids, at = features(w, m.lexicon)
    return np.add.reduceat(m.weights[ids], at, axis=0).astype(np.float64) if len(at) else np.zeros((0, len(m.langs)))


def pieces(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) of runs of rows of about two megabytes; a longer text is one alone."""
    data, at = utf8(column)
    first = 0
    while first < len(at) - 1:
        end = max(first + 1, int(np.searchsorted(at, at[first] + PIECE)) - 1)
        yield first, end, words(data[at[first] : at[end]], at[first : end + 1] - at[first])
        first = end


def lexicon(labelled: DataFrame, langs: list[str], most: int = LEXICON) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the `most` commonest words, and the class of each: the language that has it oftenest for its size, and how sure that is.

    Every word of every row of labelled (low, lang) is counted; a batch's words are added up before they are shuffled.
    """
    number = {x: i for i, x in enumerate(langs)}

    def run(batches):
        for batch in batches:
            lang = np.array([number.get(x, -1) for x in batch.column(1).to_pylist()])
            for first, end, w in pieces(batch.column(0)):
                own = lang[first:end][w.row]
                pair, count = np.unique(w.of[own >= 0] * len(langs) + own[own >= 0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.key[pair // len(langs)].view(np.int64)), pa.array((pair % len(langs)).astype(np.int32)), pa.array(count)], names=["word", "lang", "n"])

    counts = [F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(langs))]
    counted = stored(labelled.select("low", "lang").mapInArrow(run, "word long, lang int, n long").groupBy("word").agg(F.sum("n").alias("n"), *counts), "words")
    total = counted.agg(*[F.sum(f"n{i}") for i in range(len(langs))]).first()
    head = counted.where("n >= 3").orderBy(F.desc("n"), "word").limit(most).toArrow()
    if not head.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    rate = np.stack([np.asarray(head[f"n{i}"]) / max(1, total[i] or 0) for i in range(len(langs))], 1)
    best = rate.argmax(1)
    sure = np.searchsorted(SURE, rate.max(1) / rate.sum(1), side="right")
    keys = np.asarray(head["word"]).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], (best * (len(SURE) + 1) + sure)[order]


def _mixture(sample: pa.Table, langs: list[str], rng: np.random.Generator) -> tuple[Words, np.ndarray, np.ndarray, np.ndarray]:
    """The sample's words, an order of them in which passages of different texts are neighbours, their languages, and where texts begin."""
    data, at = utf8(sample["low"].combine_chunks() if isinstance(sample["low"], pa.ChunkedArray) else sample["low"])
    w = words(data, at)
    label = np.array([langs.index(x) for x in sample["lang"].to_pylist()], np.int64)[w.row]
    edge = np.flatnonzero(np.append(True, w.row[1:] != w.row[:-1]))
    cuts = [edge]
    for a, b in zip(edge, np.append(edge[1:], len(w.row)), strict=True):
        cuts.append(a + np.cumsum(rng.integers(8, 60, (b - a) // 8 + 1)))
        cuts[-1] = cuts[-1][cuts[-1] < b]
    start = np.unique(np.concatenate(cuts))
    end = np.append(start[1:], len(w.row))
    turn = rng.permutation(len(start))
    order = np.concatenate([np.arange(start[i], end[i]) for i in turn]) if len(turn) else np.zeros(0, np.int64)
    size = (end - start)[turn]
    begins = np.zeros(len(order), bool)
    begins[(np.cumsum(size) - size)[:: 6]] = True  # six passages make a text
    return w, order, label[order], begins


def fit(sample: pa.Table, langs: list[str], known: tuple[np.ndarray, np.ndarray], rounds: int = 30, decay: float = 2e-6) -> Model:
    """Maximise the likelihood of the sample's labels by gradients of all its words (Adam)."""
    t, rng = len(langs), np.random.default_rng(3)
    w, order, label, begins = _mixture(sample, langs, rng)
    rows = DIM + 1 + t * (len(SURE) + 1)
    params = [np.zeros((rows, t)), np.eye(t) * 2.0, np.zeros(t)]
    if not len(order) or t < 2:
        return Model(langs, params[0].astype(np.float32), params[1], params[2], known)
    of = w.of[order]
    ids, at = features(w, known)
    used, ids = np.unique(ids, return_inverse=True)  # only features of the sample get weights
    owner = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(ids))))
    params[0] = np.zeros((len(used), t))
    moment, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    inner = np.flatnonzero(~begins[1:]) + 1
    steps = np.bincount(label[inner - 1] * t + label[inner], minlength=t * t).reshape(t, t)
    truth = np.bincount(of * t + label, minlength=len(at) * t).reshape(-1, t)
    starts = np.bincount(label[begins], minlength=t)
    weight = len(order) / (t * np.maximum(1, np.bincount(label, minlength=t)))  # languages count alike
    for r in range(1, rounds + 1):
        emit = np.add.reduceat(params[0][ids], at, axis=0)
        chain = forward_backward(emit[of], begins, params[1], params[2])
        miss = np.stack([np.bincount(of, chain.words[:, j], len(at)) for j in range(t)], 1) - truth
        grad = [np.stack([np.bincount(ids, miss[owner, j], len(used)) for j in range(t)], 1), chain.steps - steps, chain.words[begins].sum(0) - starts]
        for i, g in enumerate(grad):
            g = g / len(order) + decay * params[i]
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            params[i] -= 0.3 / (1 + 0.05 * r) * (moment[i] / (1 - 0.9**r)) / (np.sqrt(square[i] / (1 - 0.99**r)) + 1e-9)
    weights = np.zeros((rows, t), np.float32)
    weights[used] = params[0]
    return Model(langs, weights, params[1], params[2], known)


def _lowered(docs: DataFrame, text: str, *more) -> DataFrame:
    return docs.select(F.lower(F.col(text).cast("string")).alias("low"), *more)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Fit on about `sample` texts of each language, chosen by a hash of key and text; the lexicon counts all texts.

    Rows without text or language teach nothing. None if no row teaches.
    """
    rows = _lowered(labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()), text, F.col(lang).cast("string").alias("lang"), F.xxhash64(key, text).alias("k"))
    sizes = stored(rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.octet_length("low")).alias("bytes")), "languages")
    each = sizes.agg(F.count("*")).first()[0]
    if not each:
        return None
    # a language's share of the words allowed, at six bytes a word
    share = F.least(F.lit(sample) / F.col("rows"), F.lit(6.0 * MOST_WORDS / each) / F.greatest(F.col("bytes"), F.lit(1)))
    wanted = rows.join(broadcast_rows(sizes.select("lang", share.alias("share")), 10_000), "lang")
    picked = stored(wanted.where(F.pmod("k", F.lit(1 << 30)) < F.col("share") * (1 << 30)).select("low", "lang", "k"), "sample").toArrow().sort_by("k")
    langs = sorted(set(picked["lang"].to_pylist()))
    if not langs:
        return None
    return fit(picked, langs, lexicon(rows, langs))


def label_words(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (the share of its words' probability that it has) and runs: the text's words by language, in order.

    A run is (first, last, lang), words being numbered from 0. Null texts and texts without a letter are `und`, with score 0 and no runs, and so
    is everything without a model. Whole texts are read, however long; repeated rows are labelled alike; an empty table
    stays empty. Columns named as the three new ones are replaced; all others may have any name.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "runs")]
    packed = _lowered(docs, text, F.struct(*names).alias("row"), F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("any"))
    kind = "lang_pred string, score double, runs array<struct<first:int,last:int,lang:string>>"
    shared = docs.sparkSession.sparkContext.broadcast(model)
    run_type = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())])

    def run(batches):
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            pred, score = np.full(n, -1), np.zeros(n)
            ends, first, last, langs = np.zeros(n + 1, np.int64), [], [], []
            for begin, end, w in pieces(batch.column(0)) if m else ():
                if not len(w.of):
                    continue
                begins = np.append(True, w.row[1:] != w.row[:-1])
                edge = np.flatnonzero(begins)
                p = forward_backward(_scores(w, m)[w.of], begins, m.trans, m.first).words
                rows, count = w.row[edge] + begin, np.diff(np.append(edge, len(w.row)))
                total = np.add.reduceat(p, edge, axis=0)
                pred[rows], score[rows] = total.argmax(1), np.minimum(1.0, total.max(1) / count)
                own = p.argmax(1)
                cut = np.flatnonzero(begins | np.append(True, own[1:] != own[:-1]))
                off = np.repeat(edge, count)
                first.append(cut - off[cut])
                last.append(np.append(cut[1:], len(own)) - 1 - off[cut])
                langs.append(own[cut])
                ends[1:] += np.bincount(w.row[cut] + begin, minlength=n)
            ends = np.cumsum(ends)
            known = pa.array([*(m.langs if m else []), UNKNOWN])
            letters = np.asarray(batch.column(2)) & (pred >= 0)
            empty = [np.zeros(0, np.int64)]
            first, last, langs = (np.concatenate(x or empty) for x in (first, last, langs))
            inside = pa.StructArray.from_arrays([pa.array(first, pa.int32()), pa.array(last, pa.int32()), known.take(pa.array(langs))], fields=list(run_type))
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inside)
            if not letters.all():
                none = pa.ListArray.from_arrays(pa.array([0] * (n + 1), pa.int32()), inside.slice(0, 0))
                runs = pa.compute.if_else(pa.array(letters), runs, none)
            yield pa.RecordBatch.from_arrays([batch.column(1), known.take(pa.array(np.where(letters, pred, len(known) - 1))), pa.array(np.where(letters, score, 0.0)), runs], names=["row", "lang_pred", "score", "runs"])

    schema = packed.select("row").schema
    for field in docs.sparkSession.createDataFrame([], kind).schema:
        schema = schema.add(field)
    out = packed.select("low", "row", "any").mapInArrow(run, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in names], "lang_pred", "score", "runs")
