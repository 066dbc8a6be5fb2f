"""Quality rules: base counts of words, symbols and repeats, and perplexity bands of an n-gram model.

The model is a modified Kneser-Ney model of five-byte grams for each language, counted over all
documents by Spark: tasks count their own grams with numpy, Spark sums them and derives lower-order
continuation counts, discounts and backed-off probabilities with joins of count tables. The
probability of every gram that occurs is kept under its hash. The most frequent grams, of a bounded number, go to
all tasks as arrays sorted by hash; one pass over the texts sums what they say. Grams that a text has beyond those
are rare ones: they are counted for each distinct text in that pass, joined with the rest of the model by hash, and summed. A
language's texts outside its band (median minus or plus a multiple of the spread, both computed over all of its distinct texts) are rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wattline.llm.common import SPACE, mixed, stored, text_key, utf8

ORDER = 5
HEAD = 4_000_000  # entries of the model that are broadcast, the most frequent ones: 48 MB
MOST_LANGUAGES = 10_000  # whose discounts and bands are broadcast
START = 2  # a byte that stands for what comes before the text
MIN_WORDS, MOST_REPEATED = 10, 20  # words; percent
LEAST_SPREAD = 0.02  # of the logarithm of perplexity: near copies or a few texts alike make no band of one point
PIECE = 1 << 19
ROWS = 256  # texts scored at a time
SYMBOLS = "#*$%&|<>"

_LETTER = np.array([chr(b).isalnum() if b < 128 else b >= 192 for b in range(256)])  # bytes that begin a letter or digit

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    text = text or ""
    words = text.encode().split()
    chars = len(text) - sum(text.count(c) for c in SPACE)
    lines = Counter(line for line in text.split("\n") if line.strip(SPACE))
    repeated = 0
    if len(words) > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
        if len(set(windows)) < len(windows):
            often = Counter(windows)
            end = 0
            for i, w in enumerate(windows):
                if often[w] > 1:
                    repeated += i + 5 - max(end, i)
                    end = i + 5
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), sum(lines.values()) - len(lines), repeated


def grams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, 40-bit grams, bounds): each byte with the four before it, START before a text's first."""
    n, first = len(at) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(at, at[first] + PIECE)) - 1)
        own = at[first : end + 1] - at[first]
        length = np.diff(own)
        pad = np.full(int(own[-1]) + (ORDER - 1) * (end - first), START, np.uint8)
        shift = np.repeat((ORDER - 1) * (1 + np.arange(end - first)), length)
        place = np.arange(int(own[-1])) + shift
        pad[place] = data[at[first] : at[end]]
        gram = np.zeros(len(place), np.int64)
        for k in range(ORDER - 1, -1, -1):
            gram = gram << 8 | pad[place - k]
        yield first, end, gram, own
        first = end


def _count(batches) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a batch."""
    for batch in batches:
        langs = batch.column(1).to_pylist()
        parts: dict[str, list] = {}
        for first, end, gram, own in grams(*utf8(batch.column(0))):
            row_lang = np.array([langs[i] for i in range(first, end)], object)
            for lang in set(row_lang.tolist()):
                rows = np.flatnonzero(row_lang == lang)
                parts.setdefault(lang, []).append(np.unique(np.concatenate([gram[own[i] : own[i + 1]] for i in rows]), return_counts=True))
        for lang, found in parts.items():
            g, inverse = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
            n = np.bincount(inverse, np.concatenate([c for _, c in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])


def _hint(rows: DataFrame, lang: str):
    """A broadcast for frames of one row for each language, if there are few; a shuffle on a handful of keys would fill as few tasks."""
    few = rows.select(lang).distinct().limit(MOST_LANGUAGES + 1).count() <= MOST_LANGUAGES
    return F.broadcast if few else (lambda frame: frame)


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(lang, gram, n, logp) of counted five-byte grams: interpolated modified Kneser-Ney, natural logarithm."""
    level = {ORDER: counts.select("lang", "gram", "n")}
    small = _hint(counts, "lang")
    for k in range(ORDER - 1, 0, -1):  # how many bytes were seen before a gram of k bytes
        level[k] = level[k + 1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n"))
    lower = None
    for k in range(1, ORDER + 1):
        t = level[k]
        ones = [F.count_if(F.col("n") == i).alias(f"t{i}") for i in (1, 2, 3, 4)]
        y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
        share = t.groupBy("lang").agg(*ones).select(
            "lang", *[F.coalesce(F.greatest(F.lit(0.01), F.least(F.lit(i - 0.01), i - (i + 1) * y * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}")))), F.lit(0.5)).alias(f"d{i}") for i in (1, 2, 3)]
        )
        t = t.join(small(share), "lang").withColumn("d", F.expr("case n when 1 then d1 when 2 then d2 else d3 end"))
        context = F.shiftright("gram", 8).alias("ctx")
        whole = t.groupBy("lang", context).agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("left"))
        t = t.withColumn("ctx", F.shiftright("gram", 8)).join(whole, ["lang", "ctx"])
        own = (F.col("n") - F.col("d")) / F.col("total")
        if lower is None:
            p = own + F.col("left") / 256
        else:
            t = t.withColumn("rest", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(lower, ["lang", "rest"])
            p = own + F.col("left") * F.col("q")
        t = t.select("lang", "gram", "n", p.alias("q"))
        lower = t.select("lang", F.col("gram").alias("rest"), "q")
    return t.select("lang", "gram", "n", F.log("q").alias("logp"))


def _seed(lang: str) -> np.ndarray:
    return mixed(np.array([xxhash.xxh3_64_intdigest(lang.encode())], np.uint64))


def hashed(model: DataFrame) -> DataFrame:
    """h, n, logp of the model's grams, stored; h is a 64-bit hash of language and gram."""

    def run(batches):
        for batch in batches:
            langs, gram = batch.column(0).dictionary_encode(), np.asarray(batch.column(1)).view(np.uint64)
            seeds = np.concatenate([np.zeros(0, np.uint64), *(_seed(x) for x in langs.dictionary.to_pylist())])
            h = mixed(gram ^ seeds[np.asarray(langs.indices)]) if len(gram) else gram
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(2), batch.column(3).cast(pa.float32())], names=["h", "n", "logp"])

    return stored(model.mapInArrow(run, "h long, n long, logp float"), "model")


def head_and_tail(table: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """The (hashes, log probabilities) of the most frequent grams, `most` at most, sorted by hash, and the other rows of the table."""
    scale = {r.p: r.rows for r in table.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count("*").alias("rows")).collect()}  # at most 63 rows
    least = next(p for p in range(65) if sum(r for q, r in scale.items() if q >= p) <= most)
    rows = F.floor(F.log2("n")) >= least
    got = table.where(rows).select("h", "logp").toArrow()
    h, p = np.asarray(got.column("h")).view(np.uint64), np.asarray(got.column("logp"))
    by = np.argsort(h)
    return (h[by], p[by]), table.where(~rows) if any(q < least for q in scale) else None


def _sums(langs: list[str], column: pa.Array, arrays: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Of each text the sum of those log probabilities of its bytes that the arrays have; hashes and counts of its other grams."""
    hashes, logp = arrays
    out, missed, times = np.zeros(len(langs)), [np.zeros(0, np.int64)] * len(langs), [np.zeros(0, np.int64)] * len(langs)
    for first, end, gram, own in grams(*utf8(column)):
        if not len(gram):
            continue
        which = np.repeat(np.arange(end - first), np.diff(own))
        seeds = {x: _seed(x)[0] for x in set(langs[first:end])}
        h = mixed(gram.view(np.uint64) ^ np.array([seeds[x] for x in langs[first:end]], np.uint64)[which])
        h, inverse = np.unique(h, return_inverse=True)
        at = np.minimum(np.searchsorted(hashes, h), max(0, len(hashes) - 1))
        known = hashes[at] == h if len(hashes) else np.zeros(len(h), bool)
        if len(hashes):
            out[first:end] += np.bincount(which, np.where(known, logp[at], 0.0)[inverse], end - first)
        if not known.all():
            lost = np.flatnonzero(~known[inverse])
            pairs, n = np.unique(which[lost] * np.int64(len(h)) + inverse[lost], return_counts=True)
            edge = np.searchsorted(pairs, np.arange(end - first + 1) * np.int64(len(h)))
            for i in np.flatnonzero(np.diff(edge)).tolist():
                missed[first + i] = h[pairs[edge[i] : edge[i + 1]] - i * len(h)].view(np.int64)
                times[first + i] = n[edge[i] : edge[i + 1]]
    return out, missed, times


def scored(docs: DataFrame, model: DataFrame, text: str, lang: str, most: int = HEAD) -> DataFrame:
    """docs without the text, with `__wl_sum` (log probability of all bytes under the language's model), `__wl_letters` and the base counts.

    docs has the texts' keys as __wl_k1, __wl_k2. A gram that the model does not have counts as its least probable one.
    """
    table = hashed(model)
    head, tail = head_and_tail(table, most)
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                column = part.column(part.schema.get_field_index(text))
                total, missed, times = _sums(part.column(part.schema.get_field_index(lang)).to_pylist(), column, shared.value)
                cols = {c: part.column(c) for c in part.schema.names if c != text}
                cols |= {"__wl_sum": pa.array(total), "__wl_missed": pa.array(missed, pa.list_(pa.int64())), "__wl_times": pa.array(times, pa.list_(pa.int64()))}
                data, at = utf8(column)
                letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
                got = zip(*(base_counts(t.as_py()) for t in column), strict=True)
                cols |= {c: pa.array(x, pa.int64()) for c, x in zip(COUNTS, got, strict=True)} | {"__wl_letters": pa.array(letters[at[1:]] - letters[at[:-1]], pa.int64())}
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    numbers = F.expr("cast(array() as array<bigint>)")
    schema = docs.drop(text).withColumns({"__wl_sum": F.lit(0.0), "__wl_missed": numbers, "__wl_times": numbers} | {c: F.lit(0).cast("long") for c in (*COUNTS, "__wl_letters")}).schema
    out = stored(docs.mapInArrow(run, schema), "scored")
    done = out.drop("__wl_missed", "__wl_times")
    if tail is None and not out.where(F.size("__wl_missed") > 0).limit(1).count():
        return done
    key = [lang, "__wl_k1", "__wl_k2"]
    rare = out.select(*key, F.inline(F.arrays_zip(F.col("__wl_missed").alias("h"), F.col("__wl_times").alias("n")))).groupBy(*key, "h").agg(F.max("n").alias("n"))  # copies once
    floor = table.agg(F.min("logp")).first()[0] or 0.0
    rest = (table if tail is None else tail).select("h", "logp")
    sums = stored(rare.join(rest, "h", "left").groupBy(*key).agg(F.sum(F.col("n") * F.coalesce("logp", F.lit(floor))).alias("__wl_rare")), "rare")
    return done.join(sums, key, "left").withColumn("__wl_sum", F.col("__wl_sum") + F.coalesce("__wl_rare", F.lit(0.0))).drop("__wl_rare")


def _median(value: Column) -> Column:
    """The mean of the lower and the upper median, so that of two values neither is preferred."""
    return (F.percentile_approx(value, 0.5, 10_000) - F.percentile_approx(-value, 0.5, 10_000)) / 2


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", upper: float = 5.0, lower: float = 20.0, most: int = HEAD) -> DataFrame:
    """docs without the text, with the base counts, base_failed, perplexity, band_low, band_high and kept.

    Words are runs of other bytes than space and \\t to \\r. base_failed: under 10 words, or over 20 % of the words in
    repeated five-word windows. perplexity is per letter (other bytes count in the sum: what is padded with symbols costs more for each letter); null, and
    kept false, for a text without letters. kept is false if base_failed, else
    whether the perplexity lies in its language's band: the median minus `lower`, plus `upper` times the spread (median
    absolute deviation, times 1.4826; LEAST_SPREAD at least), of the logarithm. Copies of a text count once in the band. Null texts count as empty, a null language as a language of its own.
    Columns with the names of results are replaced.
    """
    added = [*COUNTS, "base_failed", "perplexity", "band_low", "band_high", "kept"]
    names = [c for c in docs.columns if c not in added]
    docs = docs.select(*names).withColumn("__wl_lang", F.coalesce(F.col(lang), F.lit("")))
    model = kneser_ney(stored(docs.select(text, "__wl_lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts"))
    k1, k2 = text_key(F.col(text))
    out = scored(docs.withColumns({"__wl_k1": k1, "__wl_k2": k2}), model, text, "__wl_lang", most)
    out = out.withColumn("__wl_log", F.when(F.col("__wl_letters") > 0, -F.col("__wl_sum") / F.col("__wl_letters")))
    small = _hint(out, "__wl_lang")
    distinct = stored(out.groupBy("__wl_lang", "__wl_k1", "__wl_k2").agg(F.max("__wl_log").alias("__wl_log")).select("__wl_lang", "__wl_log"), "texts")  # copies have equal sums
    mid = distinct.groupBy("__wl_lang").agg(_median(F.col("__wl_log")).alias("mid"))
    spread = F.greatest(_median(F.abs(F.col("__wl_log") - F.col("mid"))) * 1.4826, F.lit(LEAST_SPREAD))
    off = distinct.join(small(mid), "__wl_lang").groupBy("__wl_lang").agg(F.first("mid").alias("mid"), spread.alias("spread"))
    band = stored(off.select(F.col("__wl_lang"), (F.col("mid") - lower * F.col("spread")).alias("__wl_low"), (F.col("mid") + upper * F.col("spread")).alias("__wl_high")), "bands")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    inside = F.coalesce(F.col("__wl_log").between(F.col("__wl_low"), F.col("__wl_high")), F.lit(False))
    return out.join(small(band), "__wl_lang", "left").select(
        *[c for c in names if c != text], *COUNTS, failed.alias("base_failed"), F.exp("__wl_log").alias("perplexity"), F.exp("__wl_low").alias("band_low"), F.exp("__wl_high").alias("band_high"), (~failed & inside).alias("kept")
    )
