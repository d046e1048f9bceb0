"""Language identification by compression: the language whose text helps zstandard most.

For each language a raw-content dictionary is cut from a bounded sample of texts of that language. A text's words, in lower
case and in pieces of a few kB, are compressed with every language's dictionary; the smallest total wins, and of equal totals
the language with the most texts. The margin to the second is the score; where it is narrow the result is marked as rejected.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_mapper, small_batches, texts_of

#: Bytes of a language's dictionary, and of one sampled text in it at most.
DICTIONARY_BYTES = 110 << 10
EXCERPT_BYTES = 1 << 10
#: Texts are compressed in pieces of so many bytes, so that the dictionary counts for each part of a long one.
PIECE_BYTES = 2 << 10
LEVEL = 6

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")


def _words(text: str) -> bytes:
    return f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")


def held_out(id_col: str) -> Column:
    """Whether the row isn't learned from: the CRC-32 of its id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionaries(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", size: int = DICTIONARY_BYTES, excerpt: int = EXCERPT_BYTES) -> dict[str, bytes]:
    """The dictionary of each language of docs, those with the most texts first: excerpts, size bytes in all, of texts that a
    hash of their id picks.

    Rows without id, language or letters are passed over. What comes to the driver is bounded by the number of languages
    times a few dictionaries' size.
    """
    rows = docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    # an excerpt begins anywhere in its text, as the hash says
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("long")).alias("h"), F.col(text_col).alias("text"))
    begin = F.pmod(F.col("h"), F.greatest(F.length("text") - excerpt // 2, F.lit(1))) + 1
    counts = rows.groupBy("lang").agg(F.sum(F.least(F.length("text"), F.lit(excerpt))).alias("n"), F.count("*").alias("texts"))
    counts = [tuple(r) for r in counts.orderBy(F.desc("texts"), "lang").collect()]
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n, _ in counts for x in (lang, min(1.0, 2.0 * size / n))])
    kept = rows.where(F.pmod(F.shiftright("h", 20), F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    out: dict[str, list[bytes]] = {lang: [] for lang, _, _ in counts}
    for lang, _, text in sorted(map(tuple, kept.select("lang", "h", F.substring("text", begin, F.lit(excerpt))).collect())):
        out[lang].append(_words(text))
    return {lang: b"".join(texts)[-size:] or b" " for lang, texts in out.items()}


class CompressionClassifier:
    """Chooses the language by compressed size. dictionaries: the raw content of each language, the likeliest first."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.languages = list(dictionaries)
        self.packers = []
        for lang in self.languages:
            raw = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            self.packers.append(zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False).compress)

    def sizes(self, text: str) -> np.ndarray:
        """The compressed bytes of the whole text with each language's dictionary."""
        raw = _words(text)
        pieces = [raw[k : k + PIECE_BYTES] for k in range(0, len(raw), PIECE_BYTES)]
        return np.array([sum(len(pack(p)) for p in pieces) for pack in self.packers], dtype=np.int64)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin in 0..1): und and 0 for null, for a text without letters, or where no language was learned."""
        if not self.languages or not text or not _LETTER.search(text):
            return "und", 0.0
        sizes = self.sizes(text)
        order = np.argsort(sizes, kind="stable")
        if len(order) == 1:
            return self.languages[0], 1.0
        return self.languages[order[0]], float(1 - sizes[order[0]] / sizes[order[1]])


def identify(docs: DataFrame, learned: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", narrow: float = 0.02) -> DataFrame:
    """(id_col, lang_pred, score, rejected) for every row, from its whole text alone. No shuffle.

    score: the share of the second smallest size that the smallest saves; rejected: that is under narrow, or no language fits.
    Of equal sizes the language with the most learned texts wins. Rows come back as often as they came.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def make():
        predict = CompressionClassifier(shared.value).predict

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [predict(t) for t in texts_of(batch)]
            scores = np.array([s for _, s in found])
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n for n, _ in found], pa.string()), pa.array(scores), pa.array(scores < narrow)],
                names=["id", "lang_pred", "score", "rejected"],
            )

        return one

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(arrow_mapper(make), "id long, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
