"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of one Arrow batch: a Python worker holds a few batches of texts at a time, however long texts are.
BATCH_BYTES = 4 << 20
#: Checkpoints after which the driver looks for shuffle files that nobody needs.
COLLECT = 6
_made = count(1)
_BATCH, _DEFAULT_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def configure(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes, unless the session has a bound of its own.

    Plans read the setting when they run, after an operator has returned, so it stays set.
    """
    if spark.conf.get(_BATCH) == _DEFAULT_BATCH:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    In local mode, as in tests, a temporary one is made where none is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if known is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="basalt-checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(known)
    return known


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder of ``spark.checkpoint.dir``."""
    shared_folder(df.sparkSession)
    out = df.checkpoint(eager=True)
    if next(_made) % COLLECT == 0:
        # shuffle files of plans that are cut off are deleted once the driver's JVM finds nobody refers to them
        df.sparkSession._jvm.System.gc()
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterable[dict[str, list]]], schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow whose function yields dicts of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of every text of a batch; null is empty."""
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def crc_mod(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def word_counts(docs: DataFrame, text_col: str = "text", room: int = 200_000) -> DataFrame:
    """(word, n) over all texts: A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``; counted in each task, then summed."""
    configure(docs.sparkSession)

    def work(batches):
        seen: Counter = Counter()

        def rows():
            return {"word": list(seen), "n": list(seen.values())}

        for batch in batches:
            for raw in text_bytes(batch):
                seen.update(raw.lower().split())
            if len(seen) > room:
                yield rows()
                seen.clear()
        yield rows()

    counted = map_arrow(docs.select(docs[text_col].alias("text")), work, "word binary, n long", pa.schema([("word", pa.binary()), ("n", pa.int64())]))
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def cut(counts: DataFrame, most: int) -> int:
    """The count (column n) above which there are at most ``most`` rows; 0 if there are no more at all.

    It comes from a histogram of counts by their logarithm, sixteen bins for a power of two, so that no task and
    no driver holds more than the chosen rows and about a thousand bins. Counts up to sixteen have bins of their own.
    """
    bins = counts.groupBy(F.floor(F.log2("n") * 16).alias("b")).agg(F.count("*").alias("rows"), F.max("n").alias("top")).collect()
    above = 0
    for b in sorted(bins, key=lambda x: -x["b"]):
        above += b["rows"]
        if above > most:
            return b["top"]
    return 0
