"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into floor(n / max_len) pieces of ``max_len`` and one piece for
each set bit of the remainder, longest first. Every piece is a sequence of its own whose length is
a power of two: sequences of one length form a bucket, no sequence crosses a document and none is
padded. It is one narrow pass over the texts, without a shuffle.

Defined cases: a null or empty text is the end id alone (one piece of length 1); repeated rows are
packed each on its own; a null id stays null; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from basalt.llm.common import configure, map_arrow

MAX_LEN = 2048
END_ID = 1
#: The vocabulary's special token; fixed values of the public tokenizer file.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256

_BEFORE_WORD = re.compile(r" (?=\S)")
_ENCODERS: dict[str, _Encoder] = {}


class _Encoder(dict):
    """Token ids, little-endian uint32, of `` word``, memoised by word.

    The tokenizer's pattern always starts a piece at a space followed by a non-space, so a text can
    be cut there and each part encoded alone with the same result.
    """

    LIMIT = 200_000
    LONG = 48

    def __init__(self, ranks: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def fresh(self, text: str) -> bytes:
        ids = self.encoding.encode_ordinary(text)
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def __missing__(self, word: str) -> bytes:
        ids = self.fresh(" " + word)
        if len(word) <= self.LONG:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if SPECIAL in text:
            return SPECIAL_ID.to_bytes(4, "little").join(self.encode(x) for x in text.split(SPECIAL))
        words = _BEFORE_WORD.split(text)
        return self.fresh(words[0]) + b"".join(map(self.__getitem__, words[1:]))


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(ranks: str | None = None) -> _Encoder:
    ranks = ranks or ranks_path()
    if ranks not in _ENCODERS:
        _ENCODERS[ranks] = _Encoder(ranks)
    return _ENCODERS[ranks]


def decompose(n: int, max_len: int = MAX_LEN) -> Iterator[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n tokens, longest first."""
    start = 0
    while n - start >= max_len:
        yield start, max_len
        start += max_len
    bit = max_len >> 1
    while bit:
        if n - start >= bit:
            yield start, bit
            start += bit
        bit >>= 1


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32())])
_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end_id: int = END_ID, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``bucket`` is log2 of its length, ``ids`` (if asked for) its tokens.

    ``sequence_id`` numbers the pieces within their input partition, with the partition in the high
    bits: a retried task, which reads the same partition, gives the same numbers.
    ``max_len`` must be a power of two.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    configure(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def work(batches):
        enc, seq = encoder(ranks), TaskContext.get().partitionId() << 40
        for batch in batches:
            out = {f.name: [] for f in schema}
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = memoryview(enc.encode(text or "") + end)
                n = len(ids) // 4
                for start, length in decompose(n, max_len):
                    part = ids[4 * start : 4 * (start + length)]
                    out["doc_id"].append(doc_id)
                    out["start"].append(start)
                    out["length"].append(length)
                    out["ids_crc32"].append(zlib.crc32(part))
                    out["doc_tokens"].append(n)
                    out["sequence_id"].append(seq)
                    out["offset"].append(0)
                    out["bucket"].append(length.bit_length() - 1)
                    if with_ids:
                        out["ids"].append(list(part.cast("I")))
                    seq += 1
            yield out

    schema = _SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _SCHEMA
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return map_arrow(narrow, work, _DDL + ", ids array<int>" * with_ids, schema)


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write pieces (with ids) as one folder per power of two, so that a batch reads one length."""
    packed.write.partitionBy("bucket").mode("overwrite").parquet(path)


def op_query(docs: DataFrame) -> DataFrame:
    """Pieces of every document, at most 2048 tokens each."""
    return pack(docs)
