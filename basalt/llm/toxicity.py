"""Toxicity after noisy-channel deobfuscation.

Writers hide words by look-alike symbols (``1d10t``), spacing (``i d i o t``, ``i.d.i.o.t``) and
repetition (``idiooot``). Every token that is not plain letters becomes a lattice: a character may
stand for itself, for a letter it looks like, or for nothing; a run of one letter may stand for one
or two. The Viterbi decoder finds the likeliest letters under channel costs and a character trigram
model counted over all texts, and a small lexicon competes with it as a word prior. A run of spaced
letters may hold several words: double separators among single ones are breaks, and within a part
the lattice may end a word after any letter, beside the reading as one word. Tokens of over ``LONGEST``
characters are read in the parts between separators, single letters in a row as a spaced run, and
long parts as words without a space. The search keeps every state and is linear in the letters, so neither
words nor runs have a greatest length. A logistic model over the restored words and their
beginnings (``stem^``, and with a number where that many words share one) then scores the text.

Bounds (documented parameters): the classifier is fitted on at most ``SAMPLE_ROWS`` labelled
documents, keeps ``FEATURES`` words and a lexicon of ``LEXICON`` words. Character counts cover all
texts. Decoding is memoised by token, so plain text costs one dictionary look-up a word.

Defined cases: null and empty texts get the score of a text without any known word; labels that are
null are ignored; without a toxic and a clean label every score is the share of toxic labels (0 if none);
repeated rows score alike; a row of ``labels`` may repeat, then each copy counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import checkpoint, configure, crc_mod, map_arrow

SAMPLE_ROWS = 20_000
FEATURES = 256
LEXICON = 4000
THRESHOLD = 0.7
#: Documents that a word must occur in to become a feature.
SUPPORT = 8
L2 = 0.03
#: Lengths of the word beginnings that are features beside the words, for compounds of one stem.
STEMS = (4, 5, 6, 7)
#: Numbers of distinct words of one beginning that are features of their own.
COUNTED = (2, 3)

#: Letters that a symbol can stand for.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
SEPARATORS = ".-_*~/,'· "
#: Log10 costs of the channel.
KEEP, LOOK, DROP, EDGE, SQUEEZE = 0.0, -0.6, -1.2, -0.05, -0.1
#: The cost of a word without a letter.
NOTHING = -4.0
#: Characters of a token beyond which it is read as several words.
LONGEST = 40

_SPACED = re.compile(r"(?:^|(?<=\s))[^\W_](?:[ .\-_*]{1,2}[^\W_]){2,}(?=[\s.,;:!?]|$)")
_DOUBLE = re.compile(r"[ .\-_*]{2}")
_SINGLE = re.compile(r"[ .\-_*]")
_BREAKS = re.compile(r"[^\w$@!|+(€£*]+|_+")
_EDGES = ".,;:!?\"'()[]{}<>«»…"
_JUNK = re.compile(r"([^\w\s])\1\1+")
_TRIPLE = re.compile(r"([^\W\d_])\1\1")


def bare(token: str) -> str:
    """A token without runs of one symbol and without punctuation at its edges."""
    return _JUNK.sub("", token).strip(_EDGES)


def is_plain(word: str) -> bool:
    return word.isalpha() and not _TRIPLE.search(word)


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "^" for n in STEMS if len(word) > n)]


def bag(words: set[str]) -> set[str]:
    """Features of a text's distinct words: words, beginnings, and ``stem^2``, ``stem^3`` of beginnings that so many words have."""
    many = Counter(x for w in words for x in features(w))
    return set(many) | {f"{x}{k}" for x, n in many.items() if x[-1] == "^" for k in COUNTED if n >= k}


class CharModel:
    """Interpolated character trigrams, log10, with ``^`` before and ``$`` after a word."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.three = counts
        self.two: dict[str, int] = defaultdict(int)
        self.ahead: dict[str, int] = defaultdict(int)
        self.one: dict[str, int] = defaultdict(int)
        for g, n in counts.items():
            self.two[g[1:]] += n
            self.ahead[g[:2]] += n
            self.one[g[2]] += n
        self.all = sum(self.one.values())
        self.mid: dict[str, int] = defaultdict(int)
        for g, n in self.two.items():
            self.mid[g[0]] += n
        self._memo: dict[str, float] = {}

    def log(self, gram: str) -> float:
        if gram not in self._memo:
            p1 = (self.one.get(gram[2], 0) + 0.5) / (self.all + 20)
            p2 = (self.two.get(gram[1:], 0) + 2 * p1) / (self.mid.get(gram[1], 0) + 2)
            p3 = (self.three.get(gram, 0) + 2 * p2) / (self.ahead.get(gram[:2], 0) + 2)
            self._memo[gram] = math.log10(p3)
        return self._memo[gram]

    def word(self, word: str) -> float:
        s = f"^^{word}$"
        return sum(self.log(s[i : i + 3]) for i in range(len(s) - 2))


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Choices (letters, log cost) at each step of a token; a run of one character is one step."""
    steps, i = [], 0
    while i < len(token):
        c, j = token[i], i
        while j < len(token) and token[j] == c:
            j += 1
        run, edge = j - i, i == 0 or j == len(token)
        letters = [(c, KEEP)] if c.isalpha() else [(x, LOOK) for x in LOOKALIKES.get(c, "")]
        choices = [(x, cost + SQUEEZE * (run > 1)) for x, cost in letters]
        if run > 1:
            choices += [(x + x, cost + SQUEEZE * (run > 2)) for x, cost in letters]
        if not c.isalpha():
            choices.append(("", EDGE if c in SEPARATORS or edge and c not in LOOKALIKES else DROP * run))
        steps.append(choices)
        i = j
    return steps


class Words:
    """The lexicon as a trie: a word prior for each word, and every beginning of one."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.prior = lexicon
        self.starts = {w[:n] for w in lexicon for n in range(len(w) + 1)}


#: A state's score and the way to it: (the way before, letters) or (the way before, None) at the end of a word.
Best = tuple[float, tuple | None]


def _better(states: dict[str, Best], key: str, score: float, way: tuple | None) -> None:
    if key not in states or score > states[key][0]:
        states[key] = (score, way)


def viterbi(steps: list[list[tuple[str, float]]], model: CharModel, words: Words, breaks: bool = False) -> list[str]:
    """The likeliest words of a lattice; with ``breaks`` a word may end after any step, else it is one word.

    A word is scored by the character model, with two letters of context as state, or by the lexicon, with a
    beginning of its words as state. All states are kept, so the result is the best of all readings.
    """
    spelt: dict[str, Best] = {"^^": (0.0, None)}
    known: dict[str, Best] = {"": (0.0, None)}
    end: Best = (-math.inf, None)
    for i, choices in enumerate(steps):
        after: dict[str, Best] = {}
        for context, (score, way) in spelt.items():
            for letters, cost in choices:
                gain, now = score + cost, context
                for x in letters:
                    gain += model.log(now + x)
                    now = now[1] + x
                _better(after, now, gain, (way, letters) if letters else way)
        grown: dict[str, Best] = {}
        for start, (score, way) in known.items():
            for letters, cost in choices:
                if start + letters in words.starts:
                    _better(grown, start + letters, score + cost, (way, letters) if letters else way)
        spelt, known, end = after, grown, (-math.inf, None)
        if breaks or i == len(steps) - 1:
            for context, (score, way) in spelt.items():
                done = score + (model.log(context + "$") if context != "^^" else NOTHING)
                if done > end[0]:
                    end = (done, (way, None))
            for word, (score, way) in known.items():
                if word in words.prior and score + words.prior[word] > end[0]:
                    end = (score + words.prior[word], (way, None))
            if breaks:
                _better(spelt, "^^", *end)
                _better(known, "", *end)
    out, letters, way = [], [], end[1]
    while way is not None:
        way, x = way
        if x is None:
            out.append("".join(reversed(letters)))
            letters = []
        else:
            letters.append(x)
    out.append("".join(reversed(letters)))
    return [w for w in reversed(out) if w]


def decode(token: str, model: CharModel, words: Words) -> str:
    """The likeliest letters of a token as one word; "" if there are none."""
    return "".join(viterbi(lattice(token), model, words))


def segment(steps: list[list[tuple[str, float]]], model: CharModel, words: Words) -> list[str]:
    """The likeliest words of a lattice that may break after any step."""
    return viterbi(steps, model, words, breaks=True)


def spaced_words(run: str, model: CharModel, words: Words) -> list[str]:
    """The words of a run of spaced characters."""
    parts = _DOUBLE.split(run)
    if not any(_SINGLE.search(x) for x in parts):  # double throughout: no break
        parts = [run]
    return [w for x in parts for w in segment([lattice(c)[0] for c in x if c.isalnum()], model, words)]


def tokens(text: str) -> set[str]:
    """Distinct tokens of a text, and its runs of spaced single letters as one token each."""
    text = text.lower()
    out = set(text.split())
    out.update(m[0] for m in _SPACED.finditer(text))
    return out


class Restorer(dict):
    """Restored word of every token seen, by memo."""

    LIMIT = 300_000

    def __init__(self, model: CharModel, lexicon: dict[str, float]) -> None:
        self.model, self.lexicon = model, Words(lexicon)

    def __missing__(self, token: str) -> tuple[str, ...]:
        words = tuple(dict.fromkeys(w for w in self.read(token) if w))
        if len(token) <= LONGEST:
            if len(self) >= self.LIMIT:
                self.clear()
            self[token] = words
        return words

    def read(self, token: str) -> list[str]:
        word = bare(token)
        if is_plain(word):
            return [word]
        if not any(x.isalpha() for x in word):
            return []
        out = spaced_words(word, self.model, self.lexicon) if _SPACED.fullmatch(word) else []
        if len(word) <= LONGEST:
            return [decode(token if len(token) <= LONGEST and not _JUNK.search(token) else word, self.model, self.lexicon), *out]
        return out or self.pieces(word)

    def pieces(self, token: str) -> list[str]:
        """The words of a long token, by its separators; a long part without any is segmented."""
        out, single = [], []
        for x in [*_BREAKS.split(token), ""]:
            if len(x) == 1 and x.isalnum():
                single.append(x)
                continue
            if single:
                out += self[".".join(single)] if len(single) > 2 else []
                single = []
            if len(x) > LONGEST and not is_plain(x):
                out += segment(lattice(x), self.model, self.lexicon) if any(c.isalpha() for c in x) else []
            elif x:
                out += self[x]
        return out

    def words(self, text: str) -> set[str]:
        """The restored words of a text."""
        return {w for x in tokens(text) for w in self[x]}


def char_counts(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Trigram counts of all plain words of all texts, Latin letters only (a bounded table)."""
    configure(docs.sparkSession)
    room = 300_000

    def grams(words: Counter) -> dict[str, list]:
        out: Counter = Counter()
        for raw, n in words.items():
            word = bare(raw.decode("utf-8", "replace"))
            if len(word) <= LONGEST and word.isalpha() and word < "ɐ":
                s = f"^^{word}$"
                for i in range(len(s) - 2):
                    out[s[i : i + 3]] += n
        return {"gram": list(out), "n": list(out.values())}

    def work(batches):
        words: Counter = Counter()
        for batch in batches:
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                words.update((raw or b"").lower().split())
            if len(words) > room:
                yield grams(words)
                words.clear()
        yield grams(words)

    counted = map_arrow(docs.select(docs[text_col].alias("text")), work, "gram string, n long", pa.schema([("gram", pa.string()), ("n", pa.int64())]))
    latin = F.col("gram").rlike(r"^[\^a-zß-ɏ]{2}[a-zß-ɏ$]$")
    return {r["gram"]: r["n"] for r in counted.where(latin).groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def fit_logistic(rows: list[list[int]], y: np.ndarray, width: int, l2: float = L2, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Newton's method for L2-regularised logistic regression on presence features."""
    x = np.zeros((len(rows), width + 1), dtype=np.float32)
    for i, at in enumerate(rows):
        x[i, at] = 1
    x[:, width] = 1
    w = np.zeros(width + 1)
    penalty = np.full(width + 1, l2)
    penalty[width] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x + np.diag(penalty)
        step = np.linalg.solve(h.astype(float), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w[:width], float(w[width])


class Model:
    def __init__(self, grams: dict[str, int], lexicon: dict[str, float], weights: dict[str, float], bias: float) -> None:
        self.grams, self.lexicon, self.weights, self.bias = grams, lexicon, weights, bias

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """Score of texts; by token, by memo, the restored words of which the model knows a feature."""

    def __init__(self, model: Model) -> None:
        self.model, self.restorer = model, Restorer(CharModel(model.grams), model.lexicon)
        self.known = {x.rstrip("23") if "^" in x else x for x in model.weights}

    def __missing__(self, token: str) -> tuple[str, ...]:
        known = tuple(w for w in self.restorer[token] if any(x in self.known for x in features(w)))
        if len(token) <= LONGEST:
            if len(self) >= Restorer.LIMIT:
                self.clear()
            self[token] = known
        return known

    def score(self, text: str | None) -> float:
        found = bag(set().union(*map(self.__getitem__, tokens(text)))) if text else set()
        z = self.model.bias + sum(self.model.weights.get(x, 0.0) for x in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on labelled documents whose crc32 of the id mod 3 is not 1, ``rows`` of them at most."""
    spark = configure(docs.sparkSession)
    grams = char_counts(docs, text_col)
    chosen = labels.where(labels["toxic"].isNotNull() & labels[id_col].isNotNull() & (crc_mod(labels[id_col], 3) != 1))
    chosen = chosen.select(labels[id_col].cast("long").alias("id"), labels["toxic"].cast("int").alias("y"))
    # a draw by hash leaves little more than the rows wanted, whatever the size of labels, for the one task that ranks them
    share = min(1.0, 1.2 * (rows + 1000) / max(1, chosen.count()))
    drawn = chosen.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = drawn.orderBy(F.xxhash64("id"), "id").limit(rows)
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    labelled = narrow.join(F.broadcast(chosen), "id").dropDuplicates(["text", "y"])
    sent = spark.sparkContext.broadcast(grams)

    def work(batches):
        restorer = Restorer(CharModel(sent.value), {})
        for batch in batches:
            yield {"id": batch.column("id"), "y": batch.column("y"), "words": [sorted(bag(restorer.words(x or ""))) for x in batch.column("text").to_pylist()]}


    bags = checkpoint(map_arrow(labelled, work, "id long, y int, words array<string>", pa.schema([("id", pa.int64()), ("y", pa.int32()), ("words", pa.list_(pa.string()))])))
    total, toxic = bags.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == total:
        share = toxic / total if total else 0.0
        return Model(grams, {}, {}, math.log((share + 1e-9) / (1 - share + 1e-9)))
    by_word = bags.select("y", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("y").alias("t")).where(F.col("n") >= SUPPORT)

    def part(k, m):  # k * ln(k / expected)
        return F.when(k > 0, k * F.log(k / m)).otherwise(0.0)

    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    share = toxic / total
    g2 = part(t, n * share) + part(n - t, n * (1 - share)) + part(toxic - t, (total - n) * share) + part((total - n) - (toxic - t), (total - n) * (1 - share))
    picked = [r["word"] for r in by_word.withColumn("g2", g2).where("g2 > 8").orderBy(F.desc("g2"), "word").limit(FEATURES).collect()]
    lexicon_rows = by_word.where((F.length("word") > 2) & ~F.contains("word", F.lit("^"))).orderBy(F.desc("n"), "word").limit(LEXICON).collect()
    every = sum(r["n"] for r in lexicon_rows) or 1
    lexicon = {r["word"]: math.log10(r["n"] / every / 2) for r in lexicon_rows}
    at = {w: i for i, w in enumerate(picked)}
    keep = F.array(*[F.lit(w) for w in picked]) if picked else F.array().cast("array<string>")
    fitted = bags.select("y", F.array_intersect("words", keep).alias("words")).collect()
    weights, bias = fit_logistic([[at[w] for w in r["words"]] for r in fitted], np.array([r["y"] for r in fitted], dtype=float), len(picked))
    return Model(grams, lexicon, dict(zip(picked, weights.tolist(), strict=True)), bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    configure(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        scorer = sent.value.scorer()
        for batch in batches:
            s = [scorer.score(x) for x in batch.column("text").to_pylist()]
            yield {"doc_id": batch.column("id"), "held_out": batch.column("held_out"), "score": s, "predicted": [int(x >= THRESHOLD) for x in s]}

    narrow = docs.select(docs[id_col].cast("long").alias("id"), (crc_mod(docs[id_col], 3) == 1).alias("held_out"), docs[text_col].alias("text"))
    return map_arrow(narrow, work, "doc_id long, held_out boolean, score double, predicted int", pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())]))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that score below the threshold."""
    configure(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = sent.value.scorer()
        for batch in batches:
            kept = [scorer.score(x) < THRESHOLD for x in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
