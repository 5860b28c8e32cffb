"""Language identification by rank-order n-gram profiles and the out-of-place distance.

Text is lower-cased; letters map to symbols (a-z to their own, every other letter to one of a fixed
number of hashed symbols), anything else to a word boundary. Profiles are the ``TOP`` most frequent
1- to 4-grams of all training texts of a language; a document's own ranking is compared to each by
the sum of rank differences, an absent n-gram costing ``TOP``.

Training counts cover every training document: each task counts its n-grams per language and the
counts are summed by key. Only the profiles, ``TOP`` rows for each language, reach the driver.

Defined cases: null text or text without a letter is ``und`` with score 0; with no profile at all
every document is ``und``; equal counts rank by n-gram code, equal distances by language name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import configure, crc_mod, map_arrow

TOP = 300
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Symbols: 0 boundary, 1-26 a-z, 27-63 other letters by hash.
_BITS = 6
#: No letter lies beyond; tags and private-use characters do.
LETTERS = 0x34000
_TABLE: list[np.ndarray] = []


def _symbols() -> np.ndarray:
    """Symbol of every code point; built once in each worker."""
    if not _TABLE:
        table = np.zeros(0x110000, dtype=np.uint8)
        for cp in range(LETTERS):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % 37
        _TABLE.append(table)
    return _TABLE[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text, and their counts. A code holds the order above 24 bits of symbols."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    s = _symbols()[np.minimum(points, 0x10FFFF)].astype(np.int32)
    s = s[np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])]  # one boundary between words
    codes, code = [], s
    for n in ORDERS:
        if n > 1:
            if len(s) < n:
                break
            code = (code[:-1] << _BITS) | s[n - 1 :]
            inner = inner[:-1] & (s[n - 2 : len(s) - 1] != 0) if n > 2 else np.ones(len(code), dtype=bool)
            codes.append(code[inner] | (n << 24))
        else:
            inner = None
            codes.append(code[code != 0] | (1 << 24))
    return np.unique(np.concatenate(codes), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, best first; equal counts by code."""
    if len(codes) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        few = counts >= least
        codes, counts = codes[few], counts[few]
    return codes[np.lexsort((codes, -counts))][:top]


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> dict[str, list[int]]:
    """Profile of each language: its ``top`` n-gram codes, best first."""
    configure(docs.sparkSession)
    room = 1_000_000

    def work(batches):
        total: dict[str, list] = {}

        def merged(parts):
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64)

        def flush(lang):
            codes, counts = merged(total.pop(lang))
            return {"lang": [lang] * len(codes), "gram": codes, "n": counts}

        for batch in batches:
            texts: dict[str, list] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                total.setdefault(lang, []).append(grams(" ".join(some)))
                if len(total[lang]) >= 8:
                    total[lang] = [merged(total[lang])]
                if len(total[lang][0][0]) > room:
                    yield flush(lang)
        for lang in list(total):
            yield flush(lang)

    known = docs.where(docs[lang_col].isNotNull() & docs[text_col].isNotNull()).select(docs[lang_col].cast("string").alias("lang"), docs[text_col].alias("text"))
    counted = map_arrow(known, work, "lang string, gram int, n long", pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())]))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).collect()
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class Profiles:
    """Ranks of all profile n-grams, for one search per document."""

    def __init__(self, profiles: dict[str, list[int]], top: int = TOP) -> None:
        self.langs, self.top = sorted(profiles), top
        self.codes = np.unique(np.concatenate([np.array(profiles[x], dtype=np.int64) for x in self.langs] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, dtype=np.int64)
        for i, x in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.codes, profiles[x])] = np.arange(len(profiles[x]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: one less the share of the greatest possible distance."""
        if not text or not self.langs:
            return UNKNOWN, 0.0
        codes, counts = grams(text)
        if not len(codes):
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.top)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where(self.codes[at] == own, self.ranks[:, at], -1)
        far = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))), self.top).sum(axis=1)
        best = int(np.argmin(far))
        return self.langs[best], float(1 - far[best] / (self.top * len(own)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    configure(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def work(batches):
        model = Profiles(sent.value, top)
        for batch in batches:
            said = [model.predict(x) for x in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("id"), "held_out": batch.column("held_out"), "lang_pred": [x for x, _ in said], "score": [x for _, x in said]}

    narrow = docs.select(docs[id_col].cast("long").alias("id"), (crc_mod(docs[id_col], 3) == 1).alias("held_out"), docs[text_col].alias("text"))
    return map_arrow(narrow, work, "doc_id long, held_out boolean, lang_pred string, score double", pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]))


def op_query(docs: DataFrame) -> DataFrame:
    """Predict every document's language; learn from those whose crc32 of the id mod 3 is not 1."""
    return predict(docs, train(docs.where(crc_mod("doc_id", 3) != 1)))
