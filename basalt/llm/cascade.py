"""Quality rules as a short-circuit cascade.

Cost (seconds for a document) and selectivity (share of documents it rejects) of each rule are
estimated on a bounded sample; the rule of most rejection per cost comes first, the next one is that
of most rejection per cost among the documents that all before it let pass, and so on. A document
leaves at its first rejection. The order never changes the verdict, which is the conjunction of all
rules, only the work; so measured times may differ from run to run.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: null text has no words and, like every text of fewer
than 10 words, fails the base test; nulls in other columns don't matter; repeated rows are judged
each on its own.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import configure, map_arrow

#: Rows that cost and selectivity are estimated on.
SAMPLE_ROWS = 2000
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Fixed values.
SYMBOLS = b"#*$%&|<>"


class Text:
    """A text with the pieces that rules share, each made on first use."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self._made: dict[str, object] = {}

    def __getattr__(self, name: str):
        made = self._made
        if name not in made:
            made[name] = getattr(Text, f"make_{name}")(self)
        return made[name]

    def make_raw(self) -> bytes:
        return self.text.encode("utf-8", "replace")

    def make_words(self) -> list[bytes]:
        return self.raw.split()

    def make_n_words(self) -> int:
        return len(self.words)

    def make_word_chars(self) -> int:
        blank = len(self.raw) - len(self.raw.translate(None, b" \t\n\x0b\x0c\r"))
        return len(self.text) - blank

    def make_n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    def make_lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.split(None, 1)]

    def make_n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    def make_n_repeat_words(self) -> int:
        w = self.words
        windows = list(zip(*(islice(w, k, None) for k in range(WINDOW)), strict=False))
        if len(set(windows)) == len(windows):
            return 0
        seen, inside = Counter(windows), bytearray(len(w))
        for i, x in enumerate(windows):
            if seen[x] > 1:
                inside[i : i + WINDOW] = b"\x01" * WINDOW
        return sum(inside)


#: A rule is true for a text that it rejects. Integer comparisons, so that any engine agrees.
RULES: dict[str, Callable[[Text], bool]] = {
    "too_few_words": lambda t: t.n_words < MIN_WORDS,
    "repeated_windows": lambda t: 100 * t.n_repeat_words > MAX_REPEAT_PERCENT * t.n_words,
    "word_length": lambda t: t.word_chars < 2 * t.n_words or t.word_chars > 20 * t.n_words,
    "symbols": lambda t: 10 * t.n_symbols > 3 * t.n_words,
    "duplicate_lines": lambda t: 10 * t.n_dup_lines > 3 * len(t.lines),
}


def estimate(docs: DataFrame, text_col: str = "text", rules: dict[str, Callable[[Text], bool]] = RULES, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], dict[frozenset[str], int]]:
    """Seconds a document of each rule, and how many documents each set of rules rejects, on a random sample of about ``rows``.

    Rows are drawn where they are read, so nothing is sent anywhere but the sums: one row for every set of
    rules that rejects some document, at most 2 to the number of rules.
    """
    configure(docs.sparkSession)

    def work(batches):
        spent, sets, n = Counter(), Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += 1
                by = []
                for name, rule in rules.items():
                    t = Text(text)  # without what other rules have made
                    began = time.perf_counter()
                    if rule(t):
                        by.append(name)
                    spent[name] += time.perf_counter() - began
                sets[tuple(sorted(by))] += 1
        yield {"rules": [[x] for x in rules] + [list(x) for x in sets], "s": [spent[x] for x in rules] + [None] * len(sets), "n": [n] * len(rules) + list(sets.values())}

    sample = docs.select(docs[text_col].alias("text")).sample(fraction=min(1.0, rows / max(1, docs.count())), seed=7)
    measured = map_arrow(sample, work, "rules array<string>, s double, n long", pa.schema([("rules", pa.list_(pa.string())), ("s", pa.float64()), ("n", pa.int64())]))
    cost, rejected = {}, {}
    for r in measured.groupBy("rules", F.col("s").isNull().alias("set")).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect():
        if r["set"]:
            rejected[frozenset(r["rules"])] = r["n"]
        else:
            cost[r["rules"][0]] = r["s"] / max(r["n"], 1)
    return cost or dict.fromkeys(rules, 0.0), rejected


def order(cost: dict[str, float], rejected: dict[frozenset[str], int]) -> list[str]:
    """Rules by rejection per cost among the documents that the rules before let pass, best first; equal ones by cost, then name."""
    out: list[str] = []
    while len(out) < len(cost):
        left = {by: n for by, n in rejected.items() if not by & set(out)}

        def worth(x: str) -> float:
            return sum(n for by, n in left.items() if x in by) / max(cost[x], 1e-9)

        out.append(min((x for x in cost if x not in out), key=lambda x: (-worth(x), cost[x], x)))
    return out


def first_rejection(t: Text, rules: list[tuple[str, Callable[[Text], bool]]]) -> str | None:
    for name, rule in rules:
        if rule(t):
            return name
    return None


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, cascade: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", counts: bool = True) -> DataFrame:
    """``kept`` of every document; with ``counts`` also the base figures, made after the verdict.

    Without ``counts`` a rejected document costs only the rules up to its first rejection, which is
    then given as ``rejected_by``.
    """
    configure(docs.sparkSession)
    named = [(x, RULES[x]) for x in cascade or order(*estimate(docs, text_col))]

    def work(batches):
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            out["doc_id"] = batch.column("id")
            for text in batch.column("text").to_pylist():
                t = Text(text)
                why = first_rejection(t, named)
                out["kept"].append(why is None)
                if counts:
                    for c in COUNTS:
                        out[c].append(getattr(t, c))
                    out["base_failed"].append(RULES["too_few_words"](t) or RULES["repeated_windows"](t))
                else:
                    out["rejected_by"].append(why)
            yield out

    if counts:
        ddl = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean"
        schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
    else:
        ddl, schema = "doc_id long, kept boolean, rejected_by string", pa.schema([("doc_id", pa.int64()), ("kept", pa.bool_()), ("rejected_by", pa.string())])
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return map_arrow(narrow, work, ddl, schema)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i : i + 4] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
marked AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, range(0, 5) t(k) GROUP BY r),
s AS (SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines
  FROM w LEFT JOIN marked USING (r)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM f"""


def op_query(docs: DataFrame) -> DataFrame:
    """Base figures and verdict of every document."""
    return judge(docs)
