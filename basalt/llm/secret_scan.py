"""Secret scanning with a random forest that removes false positives.

Candidates come from format rules (known key prefixes, private key headers, tokens in URLs),
assignments to a telling name, and long mixed strings. Each becomes a vector of its length, character
classes and their transitions, likelihood of its character pairs in prose, coverage by dictionary
words, path-likeness and the words beside it. A forest trained from labelled findings gives the
probability of a true secret.

The dictionary and the character pairs are counted over all texts; the dictionary is the
``DICTIONARY`` most frequent words (a bounded model). The forest is fitted on at most ``FINDINGS``
labelled findings; without any at hand, ``labelled_findings`` makes them by rule from a seed.

All candidates are scored, also those that overlap, with what formats and assignments leave of a run
as candidates of their own. Then overlaps are settled: true secrets before others, formats before other
rules, the more probable before the less. So a rejected candidate never hides a secret.

Defined cases: null and empty texts have no finding; findings don't overlap; offsets count code points;
values have no greatest length; repeated rows are scanned each on its own.
"""

from __future__ import annotations

import math
import random
import re
import string
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import checkpoint, configure, cut, map_arrow, word_counts

DICTIONARY = 5000
FINDINGS = 4000
TREES, DEPTH, SEED = 40, 9, 11
THRESHOLD = 0.5
CONTEXT = 48

#: Published formats of credentials.
RULES = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?",
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github": r"\bgh[pousr]_[A-Za-z0-9]{30,}\b",
    "slack": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "google": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    "url_login": r"(?<=://)[^\s/:@]+:[^\s/:@]{3,}(?=@)",
}
_FORMATS = re.compile("|".join(f"(?P<{k}>{v})" for k, v in RULES.items()))
_FORMAT_SIGNS = ("-----BEGIN", "AKIA", "ASIA", "gh", "xox", "AIza", "k_live", "k_test", "eyJ", "://")
_ASSIGN = re.compile(r"(?:(?<=[A-Za-z0-9_\]\"' ])|(?<=^))\s?[:=]{1,2}>?\s?[\"'`]?(?=[^\s\"'`,;<>]{6})")
_VALUE = re.compile(r"[^\s\"'`,;<>]{6,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PART = re.compile(r"[^=]+(?:=+$)?")
_KEYWORD = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private[_-]?key|signing[_-]?key|client[_-]?key|apikey)", re.I)
_BENIGN = re.compile(r"(?:sha\d*|md5|checksum|digest|commit|revision|uuid|guid|etag|hash|order|isbn|invoice|example|sample|placeholder|dummy|version|build)", re.I)
_PLACEHOLDER = re.compile(r"(?:x{4,}|\*{3,}|\.{3}|<|>|\$\{|%\(|your|example|change|placeholder|dummy|redacted|none|null|true|false)", re.I)


def is_long(s: str) -> bool:
    return len(s) >= 20 and not s.isalpha() and sum(c.isdigit() for c in s) >= 3 and sum(c.isalpha() for c in s) >= 3


#: Start, end, rule, probability.
Finding = tuple[int, int, str, float]


def left(a: int, b: int, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """The parts of a span outside of the spans taken, which are in order and don't overlap."""
    out = []
    for i in range(bisect_right(taken, a, key=lambda x: x[1]), len(taken)):
        x, y, _ = taken[i]
        if x >= b:
            break
        if x > a:
            out.append((a, x))
        a = max(a, y)
    return out + [(a, b)] if a < b else out


def resolve(scored: list[Finding]) -> list[Finding]:
    """Findings without overlap, in order of their place."""
    kept: list[Finding] = []
    for f in sorted(scored, key=lambda f: (f[3] < THRESHOLD, f[2] not in RULES, -f[3], f[0], -f[1], f[2])):
        at = bisect_left(kept, f[1], key=lambda x: x[0])  # those before begin ahead of its end
        if not at or kept[at - 1][1] <= f[0]:
            kept.insert(at, f)
    return kept


def long_parts(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The long strings of a run: its parts between ``=`` (padding at an end stays), or all of it if none is long."""
    parts = [(a + m.start(), a + m.end()) for m in _PART.finditer(text[a:b])]
    return [x for x in parts if is_long(text[x[0] : x[1]])] or ([(a, b)] if is_long(text[a:b]) else [])


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of all candidates of a text, in order; they may overlap."""
    formats: list[tuple[int, int, str]] = []
    if any(x in text for x in _FORMAT_SIGNS):
        formats = [(m.start(), m.end(), m.lastgroup) for m in _FORMATS.finditer(text)]
    found, values = set(formats), []
    if "=" in text or ":" in text:
        last = 0
        for m in _ASSIGN.finditer(text):
            if m.start() < last:
                continue
            name = _name_before(text, m.start())
            if name and _KEYWORD.search(name):
                last = _VALUE.match(text, m.end()).end()
                values.append((m.end(), last, "assignment"))
                found.add(values[-1])
                found |= {(a, b, "assignment") for a, b in left(m.end(), last, formats) if b - a >= 6}
    taken = sorted(formats)
    taken = sorted(taken + [(a, b, rule) for x, y, rule in values for a, b in left(x, y, taken)])
    for m in _LONG.finditer(text):
        if is_long(m[0]):
            for a, b in [(m.start(), m.end()), *left(m.start(), m.end(), taken)]:
                found |= {(*x, "long_string") for x in long_parts(text, a, b)}
    return sorted(found)


def _name_before(text: str, end: int) -> str:
    """The name that ends at a place, with a closing quote or bracket and blanks after it; of any length."""
    at = end
    while at and text[at - 1].isspace():
        at -= 1
    if at and text[at - 1] in "\"']":
        at -= 1
    start = at
    while start and (text[start - 1].isascii() and text[start - 1].isalnum() or text[start - 1] in "_-"):
        start -= 1
    return text[start:at]


class Prose:
    """Dictionary and character pairs of the corpus."""

    def __init__(self, words: list[tuple[str, int]]) -> None:
        self.words = {w for w, _ in words if len(w) >= 4}
        pairs, first = Counter(), Counter()
        for w, n in words:
            s = f"^{w}$"
            for a, b in zip(s, s[1:], strict=False):
                pairs[a + b] += n
                first[a] += n
        self.pairs, self.first = pairs, first

    def likelihood(self, s: str) -> float:
        s = s.lower()
        return sum(math.log10((self.pairs.get(s[i : i + 2], 0) + 0.1) / (self.first.get(s[i], 0) + 10)) for i in range(len(s) - 1)) / max(1, len(s) - 1)

    def coverage(self, s: str) -> float:
        """Share of the letters that greedy dictionary words, longest first, cover."""
        s, i, covered = s.lower(), 0, 0
        while i < len(s):
            n = next((n for n in range(min(12, len(s) - i), 3, -1) if s[i : i + n] in self.words), 0)
            covered += n
            i += n or 1
        return covered / max(1, len(s))


def vector(value: str, before: str, after: str, rule: str, prose: Prose) -> list[float]:
    n = max(1, len(value))
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    kinds = ["u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "o" for c in value]
    moves = Counter(zip(kinds, kinds[1:], strict=False))
    near = before[-CONTEXT:]
    return [
        len(value), entropy, entropy / math.log2(max(2, len(counts))), len(counts) / n,
        kinds.count("u") / n, kinds.count("l") / n, kinds.count("d") / n, kinds.count("o") / n,
        sum(v for (a, b), v in moves.items() if a != b) / n, moves["d", "l"] / n, moves["l", "d"] / n, moves["l", "u"] / n,
        float(all(c in string.hexdigits for c in value)), prose.likelihood(value), prose.coverage(value),
        value.count("/") / n, value.count("-") / n, value.count("_") / n, value.count(".") / n, float(bool(re.search(r"\.\w{1,4}$", value))),
        float(bool(_KEYWORD.search(near))), float(bool(_BENIGN.search(near))), float(bool(_PLACEHOLDER.search(value))), float(near.rstrip().endswith(("=", ":", '"', "'"))),
        float(rule in RULES), float(rule == "assignment"), float(after[:1] in "\"'`" and after[:1] != ""), prose.likelihood(near[-16:]),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED, words: list[str] | None = None) -> list[tuple[str, str, str, str, int]]:
    """(value, before, after, rule, label) made by rule: keys of the usual shapes, and what scanners mistake for them."""
    r = random.Random(seed)
    words = words or ["the", "result", "value", "common", "letter", "system", "under", "house", "paper", "water"]
    hexa, b64, alnum = "0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits

    def of(alphabet: str, size: int) -> str:
        return "".join(r.choices(alphabet, k=size))

    def prose() -> str:
        return " ".join(r.choices(words, k=6))

    out = []
    for i in range(n):
        key = r.choice(["token", "secret", "api_key", "password", "API_KEY", "auth_token", "client_secret", "access_key", "apikey", "Bearer token"])
        quote = r.choice(['"', "'", ""])
        sign = r.choice([" = ", "=", ": ", ":"])
        if i % 2:
            kind = r.randrange(7)
            value = (of(hexa, r.choice([32, 40, 64])), of(alnum, r.randint(20, 48)), of(b64, r.choice([40, 44, 64])), "AKIA" + of(string.ascii_uppercase + string.digits, 16), "ghp_" + of(alnum, 36), of(alnum + "!@#%^&", r.randint(10, 18)), of(alnum + "-_", r.randint(24, 43)))[kind]
            rule = {3: "aws_key", 4: "github"}.get(kind, "assignment")
            named = kind not in (3, 4) or r.random() < 0.5
            if kind in (1, 2, 6) and r.random() < 0.15:  # of any length
                value = of((alnum, b64, alnum + "-_")[(1, 2, 6).index(kind)], int(64 * 40 ** r.random()))
            if kind in (1, 2, 6) and r.random() < 0.3:  # after a name or a word that no assignment rule takes
                lead = r.choice([f"{r.choice(['DB_PASS', 'ENCRYPTION_KEY', 'SESSION_KEY', 'SALT', 'export KEY'])}=", "Authorization: Bearer ", "Bearer ", f"--{key} ", f"{key} "])
                out.append((value, f"{prose()} {lead}", " " + prose(), "long_string", 1))
                continue
            out.append((value, f"{prose()} {key}{sign}{quote}" if named else prose() + " ", (quote if named else "") + " " + prose(), rule, 1))
        else:
            kind = r.randrange(11)
            if kind < 3:  # digests, commits, identifiers
                value = (of(hexa, 40), of(hexa, 64), f"{of(hexa, 8)}-{of(hexa, 4)}-4{of(hexa, 3)}-a{of(hexa, 3)}-{of(hexa, 12)}")[kind]
                before, rule = f"{prose()} {r.choice(['commit', 'sha256', 'md5', 'checksum', 'uuid', 'etag', 'order', 'build'])}{sign}", "long_string"
            elif kind == 3:  # placeholders
                value = r.choice(["your_token_here", "YOUR-API-KEY", "xxxxxxxxxxxxxxxx", "changeme123", "example_secret_value", "************", "${SECRET_KEY}", "<password>", "placeholder-value-01"])
                before, rule = f"{prose()} {key}{sign}{quote}", "assignment"
            elif kind == 4:  # paths
                value = "/".join(r.choices(words, k=4)) + f"/{r.randint(1000, 9999)}/img_{r.randint(100, 999)}.png"
                before, rule = prose() + " ", "long_string"
            elif kind == 5:  # words joined
                value = "".join(r.choices(words, k=5)) + str(r.randint(100, 99999))
                before, rule = f"{prose()} {r.choice(['', key + sign])}", r.choice(["long_string", "assignment"])
            elif kind == 6:  # numbers and dates
                value = f"2024-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}-{of(string.digits, 6)}"
                before, rule = f"{prose()} {r.choice(['version', 'build', ''])} ", "long_string"
            elif kind == 7:  # prose after a telling word
                value = r.choice(words) + r.choice(words)
                before, rule = f"{prose()} {key}{sign}", "assignment"
            elif kind > 8:  # code that fetches a secret, and names of settings
                name = "_".join(r.choices(words, k=r.randint(2, 4)))
                value = r.choice([f"{name}({r.choice(['', r.choice(words)])})", f"{r.choice(words)}.{name}", f"os.environ[{name.upper()}]", f"{name}_{r.randint(1, 9)}()", f"${{{name.upper()}}}", f"{{{{{name}}}}}"])
                before, rule = f"{prose()} {key}{sign}", "assignment"
            else:  # snake case names
                value = "_".join(r.choices(words, k=4)) + f"_{r.randint(100, 999)}"
                before, rule = f"{prose()} {r.choice(['', key + sign])}", r.choice(["long_string", "assignment"])
            out.append((value, before, " " + prose(), rule, 0))
    return out


class Forest:
    """Bootstrapped Gini trees on random feature subsets, as flat arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        few = max(1, int(math.sqrt(x.shape[1])) + 1)
        for _ in range(trees):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, few, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, few: int, rng: np.random.Generator, nodes: list[list[float]]) -> int:
        me, p = len(nodes), float(y.mean()) if len(y) else 0.0
        nodes.append([-1, 0, 0, 0, p])  # feature, threshold, left, right, share
        if not depth or len(y) < 6 or p in (0.0, 1.0):
            return me
        best = (p * (1 - p) * len(y) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], few, replace=False):
            for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 15))):
                left = x[:, f] <= t
                k = int(left.sum())
                if 2 <= k <= len(y) - 2:
                    a, b = y[left].mean(), y[~left].mean()
                    best = min(best, (a * (1 - a) * k + b * (1 - b) * (len(y) - k), int(f), float(t)))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            nodes[me][0], nodes[me][1] = best[1], best[2]
            nodes[me][2] = self._grow(x[left], y[left], depth - 1, few, rng, nodes)
            nodes[me][3] = self._grow(x[~left], y[~left], depth - 1, few, rng, nodes)
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH + 1):
                f = t[at, 0].astype(np.int64)
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1]
                at = np.where(inner, np.where(go, t[at, 2], t[at, 3]).astype(np.int64), at)
            out += t[at, 4]
        return out / len(self.trees)


class Scanner:
    def __init__(self, prose: Prose, forest: Forest) -> None:
        self.prose, self.forest = prose, forest

    def score(self, text: str | None) -> list[Finding]:
        """Every candidate with its probability."""
        found = candidates(text) if text else []
        if not found:
            return []
        x = np.array([vector(text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + 2], rule, self.prose) for a, b, rule in found])
        return [(a, b, rule, float(p)) for (a, b, rule), p in zip(found, self.forest.predict(x), strict=True)]

    def scan(self, text: str | None) -> list[Finding]:
        """The candidates of a text without overlap."""
        return resolve(self.score(text))


def train(docs: DataFrame, text_col: str = "text", findings: list[tuple[str, str, str, str, int]] | None = None) -> Scanner:
    """A scanner whose prose statistics cover all docs, trained from at most ``FINDINGS`` labelled findings."""
    is_word = F.col("text_word").rlike(r"^[\p{L}]{2,24}$")
    counted = checkpoint(word_counts(docs, text_col).select(F.decode("word", "UTF-8").alias("text_word"), "n").where(is_word))
    frequent = counted.where(F.col("n") > cut(counted, DICTIONARY)).collect()
    words = [(r[0].lower(), r[1]) for r in sorted(frequent, key=lambda r: (-r[1], r[0]))]
    prose = Prose(words)
    rows = (findings or labelled_findings(words=[w for w, _ in words if len(w) > 2] or None))[:FINDINGS]
    x = np.array([vector(value, before, after, rule, prose) for value, before, after, rule, _ in rows])
    return Scanner(prose, Forest(x, np.array([r[4] for r in rows], dtype=float)))


def scan(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate; ``is_secret`` is the forest's verdict."""
    configure(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    def work(batches):
        scanner = sent.value
        for batch in batches:
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for a, b, rule, p in scanner.scan(text):
                    for k, v in zip(schema.names, (doc_id, a, b, rule, zlib.crc32(text[a:b].encode("utf-8", "replace")), p, p >= THRESHOLD), strict=True):
                        out[k].append(v)
            yield out

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("rule", pa.string()), ("secret_crc32", pa.int64()), ("score", pa.float64()), ("is_secret", pa.bool_())])
    narrow = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return map_arrow(narrow, work, "doc_id long, start long, end long, rule string, secret_crc32 long, score double, is_secret boolean", schema)


def redact(docs: DataFrame, scanner: Scanner, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows of docs, all columns, with every true secret replaced; ``n_chars``, if there, follows."""
    configure(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    def clean(text: str | None, scanner: Scanner) -> str | None:
        for a, b, _, p in reversed(scanner.scan(text)):
            if p >= THRESHOLD:
                text = text[:a] + mark + text[b:]
        return text

    def run(batches):
        scanner = sent.value
        for batch in batches:
            old = batch.column(text_col).to_pylist()
            new = [clean(x, scanner) for x in old]
            batch = batch.set_column(batch.schema.get_field_index(text_col), batch.schema.field(text_col), pa.array(new, batch.schema.field(text_col).type))
            if (at := batch.schema.get_field_index("n_chars")) >= 0:
                kept = zip(batch.column(at).to_pylist(), old, new, strict=True)
                batch = batch.set_column(at, batch.schema.field(at), pa.array([n if a == b else len(b) for n, a, b in kept], batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def op_query(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))
