"""Token counts by rank-synchronous array merging.

The vocabulary file's own steps are followed: special strings are cut out of the
raw text, the rest is normalised (NFC, white space, lower case), split by the
file's pattern, turned into byte symbols and merged by rank.  White space never
joins anything, so counts are worked out once for each distinct white-space word
of a batch: all new pre-tokens are held as one ragged array of symbols, and each
round applies every sequence's lowest-rank pair at once.

Defined results: null counts as empty; an empty text has 0 tokens; texts of any
length are counted whole; ties do not arise, as ranks are distinct; other
columns of the input are not read.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .._ship import ship
from ._spark import table
from ._text import column, slices

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
CACHE = 400_000  # distinct words kept by a worker between batches
NONE = np.int64(2**62)
BITS = 18


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


class Merger:
    """Counts the symbols that a byte-level BPE with a word-end suffix leaves."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        vocab = model["vocab"]
        symbols = byte_symbols()
        # symbols that no merge knows get ids of their own: they count but never merge
        extra = len(vocab)
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for b, s in enumerate(symbols):
            self.inner[b] = vocab.get(s, extra + b)
            self.last[b] = vocab.get(s + suffix, extra + 256 + b)
        self.base = extra + 512
        keys, made = [], []
        for a, b in model["merges"]:
            keys.append(vocab[a] * self.base + vocab[b])
            made.append(vocab[a + b])
        keys, made = np.array(keys, np.int64), np.array(made, np.int64)
        ranks = np.arange(len(keys))
        # a round may merge all places of a pair if what it makes takes part in later merges only
        least = np.full(self.base, len(keys), np.int64)
        np.minimum.at(least, keys // self.base, ranks)
        np.minimum.at(least, keys % self.base, ranks)
        safe = least[made] > ranks
        self.ranks, self.made, self.safe = ranks, made, safe
        self.tables = self._tables(keys)
        self.cache: dict[str, int] = {}

    def _tables(self, keys: np.ndarray) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
        """Hash tables of the pairs; keys that fall on a taken slot go on to the next table."""
        left, out, factor = np.arange(len(keys)), [], 0x9E3779B97F4A7C15
        while len(left):
            f = np.uint64(factor)
            slot = self._slot(keys[left], f)
            _, first = np.unique(slot, return_index=True)
            held, ranks = np.full(1 << BITS, -1, np.int64), np.zeros(1 << BITS, np.int64)
            held[slot[first]], ranks[slot[first]] = keys[left[first]], left[first]
            out.append((f, held, ranks))
            left = np.delete(left, first)
            factor = (factor * 0xD1342543DE82EF95 + 2) % 2**64 | 1
        return out

    @staticmethod
    def _slot(keys: np.ndarray, factor: np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * factor >> np.uint64(64 - BITS)).astype(np.int64)

    def rank_of(self, pairs: np.ndarray) -> np.ndarray:
        out = np.full(len(pairs), NONE)
        for f, held, ranks in self.tables:
            slot = self._slot(pairs, f)
            np.copyto(out, ranks[slot], where=held[slot] == pairs)
        return out

    @staticmethod
    def plain(word: str) -> bool:
        """Whether lower case by whole words gives what lower case by characters gives."""
        return unicodedata.is_normalized("NFC", word) and "Σ" not in word and "İ" not in word

    def pretokens(self, word: str) -> list[str]:
        """Pre-tokens of one piece without special strings."""
        text = word if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def merge(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that remain of each piece (bytes, not empty)."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[raw[ends]]
        seq = np.repeat(np.arange(len(pieces)), lengths)
        counts = lengths.copy()
        # rank[i] is that of the pair (i, i + 1), NONE across a sequence's end
        rank = np.full(len(symbols), NONE)
        rank[:-1] = self.rank_of(symbols[:-1] * self.base + symbols[1:])
        rank[ends] = NONE
        while len(symbols):
            heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            low = np.minimum.reduceat(rank, heads)
            per = np.diff(np.append(heads, len(symbols)))
            hit = np.flatnonzero((rank == np.repeat(low, per)) & (rank < NONE))
            if not len(hit):
                break
            # of overlapping places (a a a), every second from the left; of unsafe pairs, the first only
            run = np.append(True, np.diff(hit) != 1)
            first = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            take = (np.arange(len(hit)) - first) % 2 == 0
            at = seq[hit]
            take &= self.safe[rank[hit]] | np.append(True, at[1:] != at[:-1])
            hit = hit[take]
            symbols[hit] = self.made[rank[hit]]
            counts -= np.bincount(seq[hit], minlength=len(counts))
            keep = np.repeat(low < NONE, per)
            keep[hit + 1] = False
            place = np.cumsum(keep) - 1
            ended = np.append(seq[1:] != seq[:-1], True)
            stop = ended[hit + 1]
            symbols, seq, rank = symbols[keep], seq[keep], rank[keep]
            new = place[hit]
            rank[new] = NONE
            right = new[~stop]
            rank[right] = self.rank_of(symbols[right] * self.base + symbols[right + 1])
            left = new[(new > 0)] - 1
            left = left[seq[left] == seq[left + 1]]
            rank[left] = self.rank_of(symbols[left] * self.base + symbols[left + 1])
        return counts

    def count_words(self, fresh: list[str]) -> list[int]:
        """Tokens of white-space words that are not in the cache."""
        totals, pieces, of = [0] * len(fresh), [], []
        for i, word in enumerate(fresh):
            parts = [word]
            if self.special_re and "<" in word:
                totals[i] += len(self.special_re.findall(word))
                parts = self.special_re.split(word)
            for part in parts:
                if part.isalpha() and (part.isascii() or self.plain(part)):
                    found = [part.lower()]
                elif part[:-1].isalpha() and part[-1] in ".," and (part.isascii() or self.plain(part)):
                    found = [part[:-1].lower(), part[-1]]
                else:
                    found = self.pretokens(part) if part else []
                pieces += [x.encode() for x in found]
                of += [i] * len(found)
        if pieces:
            for i, n in zip(of, self.merge(pieces).tolist(), strict=True):
                totals[i] += n
        return totals

    def count(self, texts: list[str]) -> list[int]:
        split = [t.split() if not re.search("[\x1c-\x1f]", t) else re.split(r"[^\S\x1c-\x1f]+", t) for t in texts]
        cache = self.cache
        fresh = list(set().union(*split).difference(cache)) if split else []
        if len(cache) + len(fresh) > CACHE:
            cache.clear()
            fresh = list(set().union(*split))
        cache.update(zip(fresh, self.count_words(fresh), strict=True))
        return [sum(map(cache.__getitem__, ws)) for ws in split]


@functools.lru_cache(2)
def merger(path: str) -> Merger:
    return Merger(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every text.

    ``path`` is where each worker finds the vocabulary; by default the installed
    package of public tokenizers tells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path or vocabulary_path())
        for batch in slices(batches):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            n = np.array(m.count(texts), np.int64)
            size = np.array([len(t.encode()) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
