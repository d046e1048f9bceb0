"""Token counts of a byte-pair vocabulary by merging batched pre-tokens in step with their ranks.

The distinct pre-tokens of a batch lie one after the other in a flat array of symbols. A round looks up the rank of every
neighbouring pair, finds each pre-token's lowest, and merges that pair wherever it stands in it, in all pre-tokens at once.
When no pair has a rank, the symbols left are the tokens. Of the library only the normaliser is used; splitting, merging and
counting are done here.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_mapper, small_batches, texts_of

#: Pre-tokens whose counts a task remembers.
REMEMBERED = 300_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class RankMerger:
    """Counts the tokens of pre-tokens. spec: the vocabulary's parsed JSON (a BPE model over bytes)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        signs = byte_alphabet()
        self.inner = np.array([vocab[signs[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[signs[b] + end] for b in range(256)], dtype=np.int64)
        self.n = max(vocab.values()) + 1
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        key = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)[order]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The number of tokens of each word: 0 for an empty one."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        word = np.repeat(np.arange(len(words)), sizes)
        symbol = self.inner[raw]
        last = np.cumsum(sizes)[sizes > 0] - 1
        symbol[last] = self.final[raw[last]]
        done = np.zeros(len(words), dtype=np.int64)
        while len(symbol) > 1:
            pair = symbol[:-1] * self.n + symbol[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            known = (self.key[at] == pair) & (word[:-1] == word[1:])
            rank = np.where(known, self.rank[at], len(self.rank))
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.minimum.reduceat(np.append(rank, len(self.rank)), first)
            size = np.diff(np.append(first, len(word)))
            live = least < len(self.rank)
            finished = np.repeat(~live, size)
            merge = known & (rank == np.repeat(least, size)[:-1])
            if merge.any():
                # of overlapping pairs (a run of one symbol) every second merges, from the left
                start = merge & ~np.concatenate(([False], merge[:-1]))
                place = np.arange(len(merge))
                from_start = place - np.maximum.accumulate(np.where(start, place, 0))
                merge &= from_start % 2 == 0
            done[word[first[~live]]] = size[~live]
            symbol[:-1][merge] = self.made[at[merge]]
            keep = ~finished
            keep[1:] &= ~merge
            symbol, word = symbol[keep], word[keep]
        if len(symbol):
            done[word[0]] = 1
        return done


class TokenCounter:
    """Counts the tokens of whole texts as the tokenizers library does without special tokens, for a vocabulary file with
    NFC, white space and lower-case normalisation, a splitting pattern, and byte-level BPE.

    Special strings inside a text are one token each, as is the library's default, and end a pre-token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.normalise = Tokenizer.from_file(path).normalizer.normalize_str
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(split["pattern"]["Regex"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.merger, self.known = RankMerger(spec), {}

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text; null counts as empty."""
        split, normalise = self.split.findall, self.normalise
        per_text, special = [], []
        for text in texts:
            found: Counter[str] = Counter()
            n = 0
            if text:
                parts = self.special.split(text) if self.special else [text]
                n = len(parts) - 1
                for part in parts:
                    found.update(split(normalise(part)))
            per_text.append(found)
            special.append(n)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for found in per_text for w in found if w not in self.known})
        self.known.update(zip(new, self.merger.counts([w.encode() for w in new]).tolist(), strict=True))
        known = self.known
        return [n + sum(known[w] * k for w, k in found.items()) for found, n in zip(per_text, special, strict=True)]


def token_counts(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes long, n_tokens long) for every row; null and empty texts have none of either.

    vocabulary: the path of the file on every machine; by default word_bpe_49k.json of the installed public tokenizers.
    Rows come back as often as they came. No shuffle.
    """
    small_batches(docs.sparkSession, 500)

    def make():
        path = vocabulary
        if path is None:
            import public_tokenizers

            path = str(public_tokenizers.path("word_bpe_49k.json"))
        counter = TokenCounter(path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.counts(texts_of(batch)), pa.int64())], names=["id", "n_bytes", "n_tokens"])

        return one

    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), n_bytes.alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(arrow_mapper(make), "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)
