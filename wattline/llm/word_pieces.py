"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's trie gets failure links: where no longer match exists, the link leads to the node of
what remains after the longest pieces are taken off, and a count beside it says how many pieces those are
(computed once, for all nodes). A word is then counted in one pass over its bytes, each
byte read once, and no piece is ever built.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import normalize

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from wattline.llm.bpe_tree import _local, ship

END = 256  # a symbol after a word's last byte
CACHED = 1 << 18
#: Fixed value: how this vocabulary's own tokenizer splits lower-case text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_symbols() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary, by the public rule: printable
    Latin-1 bytes are themselves, the others follow from code point 256 on in their order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """goto[node] maps a symbol to a node; fail[node], pops[node]: where matching goes on, and pieces taken off on the way.

    fail is -1 where a node cannot be left by whole pieces. `free`: symbols that may stand alone and count nothing.
    """

    def __init__(self, pieces: list[tuple[int, ...]], free: tuple[int, ...] | None = None):
        self.goto: list[dict[int, int]] = [{}]
        ends = set()
        for piece in [*pieces, *([free] if free else [])]:
            node = 0
            for s in piece:
                nxt = self.goto[node].get(s)
                if nxt is None:
                    nxt = self.goto[node][s] = len(self.goto)
                    self.goto.append({})
                node = nxt
            ends.add(node)
        costless = node if free and free not in set(pieces) else -1
        self.fail, self.pops = [-1] * len(self.goto), [0] * len(self.goto)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for s, v in self.goto[u].items():
                queue.append(v)
                if v in ends:  # the whole of it is a piece: take it off, nothing remains
                    self.fail[v], self.pops[v] = 0, int(v != costless)
                    continue
                z, taken = self.fail[u], self.pops[u]
                while z >= 0 and s not in self.goto[z]:
                    taken += self.pops[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.pops[v] = self.goto[z][s], taken

    def count(self, symbols) -> int:
        """Pieces of a word, or -1 if greedy matching gets stuck."""
        goto, fail, pops = self.goto, self.fail, self.pops
        node = n = 0
        for s in symbols:
            while s not in goto[node]:
                if node == 0 or fail[node] < 0:
                    return -1
                n += pops[node]
                node = fail[node]
            node = goto[node][s]
        while node:
            if fail[node] < 0:
                return -1
            n += pops[node]
            node = fail[node]
        return n


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """Byte sequences of a tokenizer file's vocabulary; </w> becomes END. Special tokens are left out."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec["added_tokens"] if t["special"]}
    code = byte_symbols()
    out = []
    for piece in spec["model"]["vocab"]:
        if piece not in special:
            last = piece.endswith("</w>") and len(piece) > 4
            out.append(tuple(code[c] for c in (piece[:-4] if last else piece)) + ((END,) if last else ()))
    return out


@lru_cache(maxsize=1)
def automaton(path: str) -> Automaton:
    return Automaton(load_pieces(path), free=(END,))


def count_pieces(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """docs without the text, with n_words, n_tokens and n_unknown (long) of each whole text.

    Text is NFC-normalized, lower-cased and split into words as the vocabulary's tokenizer does. The end of
    a word is part of its last piece where the vocabulary has such a piece, else it counts nothing; a word
    that greedy matching cannot finish is one unknown token. Null and empty texts have none.
    Columns of these names are replaced.
    """
    ship(docs.sparkSession.sparkContext, path)
    added = ("n_words", "n_tokens", "n_unknown")
    docs = docs.select(*[c for c in docs.columns if c not in added])

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, find = automaton(_local(path, True)), regex.compile(WORD)
        seen: dict[str, int] = {}
        for batch in batches:
            words, tokens, unknown = [], [], []
            for t in batch.column(batch.schema.get_field_index(text)):
                found = find.findall(normalize("NFC", t.as_py() or "").lower())
                n = lost = 0
                for w in found:
                    c = seen.get(w)
                    if c is None:
                        c = own.count((*w.encode(), END))
                        if len(seen) >= CACHED:
                            seen.clear()
                        if len(w) <= 64:
                            seen[w] = c
                    if c < 0:
                        lost += 1
                        n += 1
                    else:
                        n += c
                words.append(len(found)), tokens.append(n), unknown.append(lost)
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != text]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))], names=[*(c for c, _ in rest), *added])

    return docs.mapInArrow(run, docs.drop(text).withColumns({c: F.lit(0).cast("long") for c in added}).schema)
