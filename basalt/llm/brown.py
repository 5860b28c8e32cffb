"""Perplexity under Brown class n-grams.

Exchange clustering assigns words to classes: the ``CORE`` most frequent words move one by one to the
class that most raises the mutual information of adjacent classes, until none moves or ``SWEEPS``
are done. Then all other words of the model take their best class at once, in distributed sweeps: every
pass over the corpus counts the classes beside each word, each word is exchanged on its own against the
class bigrams of the pass before, and a sweep whose mutual information is not higher is undone.
The corpus is numbered once, and the passes read the numbers.
Document ends are a class of their own. Words seen once, those beyond the ``NEAR`` most frequent, and
one place for unseen ones are another, whose members are told apart by their counts (plus one):
words seen once tell how likely, and after what, a new word is.

    P(w | v) = P(class w | class v) P(w | class w)

Class transitions are Witten-Bell smoothed with class frequencies. All counts cover every training
document. The class model is bounded by its parameters; word counts are not: those of the ``NEAR``
most frequent words are broadcast, the others stay a distributed table that the rest of the tokens
join, counted by document first.

Defined cases: null and empty texts are their end alone; without training documents every word is
unseen; repeated rows are scored each on its own.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import checkpoint, configure, crc_mod, cut, map_arrow, text_bytes, word_counts

CLASSES = 48
CORE = 1000
NEAR = 250_000
SWEEPS = 8
#: Passes over the corpus in which all words are exchanged.
PASSES = 2
#: Least count of a word that has a class of its neighbours.
CLUSTERED = 2
#: Tokens that are counted at a time, codes that a task adds up before it hands them on, and pairs of a word and
#: a class beside it that are weighed at a time: they bound a worker's memory and change no result.
PIECE, ROOM, WEIGHED = 1 << 17, 1_000_000, 1 << 12
#: A token that no text can hold, for a document's end.
END = b" "


class Ids(dict):
    """Number of a word; -1 for one that is not here."""

    def __missing__(self, word: bytes) -> int:
        return -1


def numbered(batch: pa.RecordBatch, ids: Ids) -> np.ndarray:
    """Word numbers of all texts of a batch, each followed by its end."""
    words = list(chain.from_iterable((*x.lower().split(), END) for x in text_bytes(batch)))
    return np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))


def _numbers(texts: DataFrame, ids_of: object) -> DataFrame:
    """(x): word numbers of the texts of one batch, 32 bits each, so that later passes neither split texts nor look up words."""

    def work(batches):
        ids = ids_of.value
        for batch in batches:
            yield {"x": [numbered(batch, ids).astype(np.int32).tobytes()]}

    return checkpoint(map_arrow(texts, work, "x binary", pa.schema([("x", pa.binary())])))


def tally(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(codes, return_counts=True)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending codes and their sums, from several such runs."""
    codes, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*runs, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.diff(codes, prepend=-1))
    return codes[first], np.add.reduceat(n, first) if len(n) else n


def _sparse(numbers: DataFrame, count) -> DataFrame:
    """(code, n): the sum of ``count(words before, words)``, codes from 0 and how often each is found, over all tokens.

    The end of a document stands before the next one's first word. A task holds one and a half ``ROOM`` codes at most, not counting a piece.
    """

    def work(batches):
        runs = []

        def rows(codes, n):
            for at in range(0, len(codes), PIECE):
                yield {"code": codes[at : at + PIECE], "n": n[at : at + PIECE]}

        for batch in batches:
            for raw in batch.column("x"):
                x = np.concatenate([[0], np.frombuffer(raw.as_buffer(), dtype=np.int32)])
                for at in range(0, len(x) - 1, PIECE):
                    piece = x[at : at + PIECE + 1]
                    runs.append(count(piece[:-1], piece[1:]))
                    if sum(len(codes) for codes, _ in runs[1:]) > ROOM // 2:
                        runs = [merged(runs)]
                    if len(runs[0][0]) > ROOM:
                        yield from rows(*merged(runs))
                        runs = []
        if runs:
            yield from rows(*merged(runs))

    counted = map_arrow(numbers, work, "code long, n long", pa.schema([("code", pa.int64()), ("n", pa.int64())]))
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def _table(counted: DataFrame, size: int) -> np.ndarray:
    """Counts of codes below a bounded size."""
    out = np.zeros(size)
    got = counted.toPandas()
    out[got["code"].to_numpy()] = got["n"].to_numpy()
    return out


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0.0)


def gains(n: np.ndarray, right: np.ndarray, left: np.ndarray, own: float) -> np.ndarray:
    """Change of the clustering objective for a word put into each class.

    n: class bigrams without the word; right, left: classes after and before it; own: it beside itself.
    """
    diagonal = np.arange(len(n))
    rows, columns = _f(n + right) - _f(n), _f(n + left[:, None]) - _f(n)
    rows[diagonal, diagonal] = columns[diagonal, diagonal] = 0
    d = n[diagonal, diagonal]
    both = rows.sum(axis=1) + columns.sum(axis=0) + _f(d + right + left + own) - _f(d)
    # a class before the word keeps its row's sum wherever the word goes, and one after it its column's
    after, before = n.sum(axis=1) + left, n.sum(axis=0) + right
    return both - (_f(after + right.sum() + own) - _f(after)) - (_f(before + left.sum() + own) - _f(before))


def exchange(b: np.ndarray, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of every word from the matrix of adjacent pairs, words in order of frequency."""
    words = len(b)
    of = np.arange(words) % classes
    n = np.zeros((classes, classes))
    np.add.at(n, (of[:, None].repeat(words, 1), of[None, :].repeat(words, 0)), b)
    for _ in range(sweeps):
        moved = 0
        for w in range(words):
            own, was = b[w, w], of[w]
            right, left = np.bincount(of, b[w], classes), np.bincount(of, b[:, w], classes)
            right[was] -= own
            left[was] -= own
            n[was] -= right
            n[:, was] -= left
            n[was, was] -= own
            to = int(np.argmax(gains(n, right, left, own)))
            of[w] = to
            n[to] += right
            n[:, to] += left
            n[to, to] += own
            moved += to != was
        if not moved:
            break
    return of


def objective(n: np.ndarray) -> float:
    """Mutual information of adjacent classes, but for a constant and the factor of the token count."""
    return float(_f(n).sum() - _f(n.sum(axis=0)).sum() - _f(n.sum(axis=1)).sum())


def best_classes(owner: np.ndarray, side: np.ndarray, beside: np.ndarray, x: np.ndarray, was: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """The class of each word that most raises the objective, given the class bigrams n.

    x times class ``beside`` stands after (side 0) or before (side 1) word ``owner``; owners ascend from 0.
    ``was`` is the class under which n holds each word now; its pairs are taken out of n first. Words are weighed apart,
    so a few at a time give the same.
    """
    starts, best, at = np.searchsorted(owner, np.arange(len(was) + 1)), [np.zeros(0, np.int64)], 0
    while at < len(was):
        to = min(max(int(np.searchsorted(starts, starts[at] + WEIGHED, "right")) - 1, at + 1), at + WEIGHED)
        some = slice(starts[at], starts[to])
        best.append(_best(owner[some] - at, side[some], beside[some], x[some], was[at:to], n, classes))
        at = to
    return np.concatenate(best)


def _best(owner: np.ndarray, side: np.ndarray, beside: np.ndarray, x: np.ndarray, was: np.ndarray, n: np.ndarray, classes: int) -> np.ndarray:
    """``best_classes`` at once: it takes about 1.6 kilobytes a pair."""
    words, k = len(was), len(n)
    dense = np.zeros((2, words, k))
    np.add.at(dense, (side, owner, beside), x)
    right, left = dense
    sides = side[:, None] == 0
    base = np.where(sides, n[:classes, beside].T, n[beside, :classes])
    base -= (was[owner][:, None] == np.arange(classes)) * x[:, None]
    base -= (was[owner] == beside)[:, None] * np.where(sides, left[owner, :classes], right[owner, :classes])
    gain = _f(base + x[:, None]) - _f(base)
    inner = np.flatnonzero(beside < classes)
    gain[inner, beside[inner]] = 0  # the diagonal comes below, both sides at once
    total = np.zeros((words, classes))
    np.add.at(total, owner, gain)
    loops, mine = (right + left)[:, :classes], was[:, None] == np.arange(classes)
    d = np.diag(n)[:classes] - mine * loops
    total += _f(d + loops) - _f(d)
    # a class before the word keeps its row's sum wherever the word goes
    for margin, some in ((n.sum(axis=1), right), (n.sum(axis=0), left)):
        size = some.sum(axis=1)[:, None]
        m = margin[:classes] - mine * size
        total -= _f(m + size) - _f(m)
    return np.argmax(total, axis=1)


class Model:
    """Everything a scorer needs, of bounded size, beside the numbers of words and the distributed word counts."""

    def __init__(self, counts: np.ndarray, of: np.ndarray, rare: tuple[int, int], trans: np.ndarray, total: int, distinct: int) -> None:
        self.counts, self.total, self.distinct = counts, total, distinct
        k = len(trans)
        self.rare_class, self.end_class = k - 1, k - 2
        self.of = np.append(of, self.rare_class)  # at -1: a word that is not here
        after = trans.sum(axis=1, keepdims=True)
        kinds = (trans > 0).sum(axis=1, keepdims=True)
        back = (trans.sum(axis=0) + 1) / (trans.sum() + k)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = (trans + np.maximum(kinds, 1) * back) / (after + np.maximum(kinds, 1))
        self.log_trans = np.log10(p)
        self.log_rare = math.log10(rare[0] + rare[1] + 1)
        size = np.bincount(of, counts, k).astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            emit = np.log10(counts) - np.log10(size[of])
        rare_word = of == self.rare_class
        emit[rare_word] = np.log10(counts[rare_word] + 1) - self.log_rare
        # a word that is not here: its log10(count + 1) is added from the distributed table
        self.emit = np.append(emit, -self.log_rare)
        self.log_count = np.append(np.log10(counts + 1), 0.0)


def _sweep(numbers: DataFrame, of: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(class bigrams, new classes) of one pass: every word from ``first`` to before ``last`` is exchanged against the classes beside it.

    ``of`` is the class of each word.
    """
    spark, k = numbers.sparkSession, CLASSES + 2
    sent = spark.sparkContext.broadcast(np.append(of, k - 1))
    words = len(of)

    def beside(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        now = sent.value
        right, left = (a >= first) & (a < last), (b >= first) & (b < last)
        near, n = tally(np.concatenate([(a[right] * 2) * k + now[b[right]], (b[left] * 2 + 1) * k + now[a[left]]]))
        ends, m = tally(now[a] * k + now[b])  # class bigrams, under words beyond the last
        return np.concatenate([near, words * 2 * k + ends]), np.concatenate([n, m])

    counted = checkpoint(_sparse(numbers, beside))
    bigrams = counted.where(F.col("code") >= words * 2 * k).select((F.col("code") - words * 2 * k).alias("code"), "n")
    n = _table(bigrams, k * k).reshape(k, k)
    law = spark.sparkContext.broadcast((n, of))

    def move(batches):
        n, was = law.value
        for batch in batches:
            w = batch.column("w").to_numpy(zero_copy_only=False)
            lists = batch.column("near")
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            code, x = flat.field("code").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False).astype(float)
            owner = np.repeat(np.arange(len(w)), size)
            yield {"w": w, "to": best_classes(owner, code // k, code % k, x, was[w], n, CLASSES)}

    near = counted.where(F.col("code") < words * 2 * k)
    near = near.groupBy(F.expr(f"code div {2 * k}").alias("w")).agg(F.collect_list(F.struct((F.col("code") % (2 * k)).alias("code"), "n")).alias("near"))
    moved = map_arrow(near, move, "w long, to long", pa.schema([("w", pa.int64()), ("to", pa.int64())])).toPandas()  # at most NEAR rows
    new = of.copy()
    new[moved["w"].to_numpy()] = moved["to"].to_numpy()
    return n, new


def train(docs: DataFrame, text_col: str = "text") -> tuple[Model, object, DataFrame]:
    """The bounded model, the numbers of its words (broadcast) and the table (word, n) of the words that it doesn't hold."""
    spark = configure(docs.sparkSession)
    texts = docs.select(docs[text_col].alias("text"))
    counts = checkpoint(word_counts(texts))
    words_total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = texts.count()
    least = cut(counts, NEAR)
    top = counts.where(F.col("n") > least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    names, n = [bytes(x) for x in top["word"]], top["n"].to_numpy(dtype=np.int64)
    del top
    ids = Ids(zip(names, range(1, len(names) + 1), strict=True))
    ids[END] = 0  # the end is word 0, then words by frequency
    n = np.concatenate([[ends], n]).astype(np.int64)
    clustered = 1 + int((n[1:] >= CLUSTERED).sum())
    core = min(CORE, clustered)
    sent = spark.sparkContext.broadcast(ids)

    numbers = _numbers(texts, sent)

    def pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = (a >= 0) & (b >= 0) & (a < core) & (b < core)
        return tally(a[both] * core + b[both])

    b = _table(_sparse(numbers, pairs), core * core).reshape(core, core)
    k = CLASSES + 2
    of = np.full(len(n), k - 1, dtype=np.int64)
    # the end takes no part in the exchange: it is a class of its own
    of[:core] = np.concatenate([[CLASSES], exchange(b[1:, 1:], CLASSES)])

    start = core  # first the others against the core, then all
    best: tuple[float, np.ndarray] = (-math.inf, of)
    for sweep in range(PASSES if clustered > core else 0):
        bigrams, new = _sweep(numbers, of, start, clustered)
        if sweep and objective(bigrams) > best[0]:
            best = (objective(bigrams), of)
        of, start = new, 1
    if clustered > core and PASSES:
        trans = _transitions(numbers, of, k)
        if objective(trans) <= best[0]:
            of = best[1]
            trans = _transitions(numbers, of, k)
    else:
        trans = _transitions(numbers, of, k)
    kept = n[1:clustered].sum()
    model = Model(n, of, (int(words_total - kept), int(distinct - (clustered - 1))), trans, int(words_total + ends), int(distinct + (ends > 0)))
    return model, sent, counts.where(F.col("n") <= least)


def _transitions(numbers: DataFrame, of: np.ndarray, k: int) -> np.ndarray:
    sent = numbers.sparkSession.sparkContext.broadcast(np.append(of, k - 1))

    def codes(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tally(sent.value[a] * k + sent.value[b])

    return _table(_sparse(numbers, codes), k * k).reshape(k, k)


def score(docs: DataFrame, model: Model, ids_of: object, rest: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = configure(docs.sparkSession)
    sent = spark.sparkContext.broadcast(model)

    def work(batches):
        m, ids = sent.value, ids_of.value
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, held, raw in zip(batch.column("id").to_pylist(), batch.column("held_out").to_pylist(), text_bytes(batch), strict=True):
                words = [*raw.lower().split(), END]
                x = np.fromiter(map(ids.__getitem__, words), dtype=np.int64, count=len(words))
                c = m.of[x]
                logp = m.log_trans[np.concatenate([[m.end_class], c[:-1]]), c].sum() + m.emit[x].sum()
                # one row for the document, under a word that no text can hold, and one for each word to look up
                rows = [(key, doc_id, held, len(words), int((x >= 0).sum()), float(m.log_count[x].sum()), float(logp), END + key.to_bytes(8, "big"), 0)]
                rows += [(key, None, None, 0, 0, 0.0, 0.0, w, k) for w, k in Counter(w for w, i in zip(words, x.tolist(), strict=True) if i < 0).items()]
                for name, values in zip(out, zip(*rows, strict=True), strict=True):
                    out[name] += values
                key += 1
                if len(out["key"]) > 50_000:
                    yield out
                    out = {f.name: [] for f in schema}
            yield out

    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("log_count", pa.float64()), ("logp", pa.float64()), ("word", pa.binary()), ("k", pa.int64())])
    narrow = docs.select(docs[id_col].cast("long").alias("id"), held_out.alias("held_out"), docs[text_col].alias("text"))
    sent_rows = map_arrow(narrow, work, "key long, doc_id long, held_out boolean, n_tokens long, known long, log_count double, logp double, word binary, k long", schema)
    joined = sent_rows.join(rest, "word", "left")
    found = F.col("n").isNotNull()
    late = F.sum(F.when(found, F.col("k") * F.log10(F.col("n") + 1)).otherwise(0.0))
    per = joined.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.sum("n_tokens").alias("n_tokens"), (F.sum("known") + F.sum(F.when(found, F.col("k")).otherwise(0))).alias("n_known"), (F.sum("log_count") + late).alias("counted"), (F.sum("logp") + late).alias("score"))
    base = F.col("counted") - F.col("n_tokens") * F.lit(math.log10(model.total + model.distinct + 1))
    return per.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op_query(docs: DataFrame) -> DataFrame:
    """Score every document; learn from those whose crc32 of the id mod 7 is not 2."""
    held_out = crc_mod("doc_id", 7) == 2
    return score(docs, *train(docs.where(~held_out)), held_out)
