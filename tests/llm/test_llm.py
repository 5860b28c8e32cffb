"""Operators against brute force, round trips and edge cases on small tables."""

import math
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import brown, cascade, decontam, golay, langid, packing, secret_scan, sharding, sitetree, toxicity
from basalt.llm.components import components

EDGE = [(1, None, None, "en", "x"), (2, "", "y", None, None), (3, "the cat sat on the mat " * 3000, "y", "en", "x"), (4, "a b", "y", "fr", "x"), (4, "a b", "y", "fr", "x"), (None, "a b", "y", "fr", "x"), (7, "  \n\t ", "y", "de", "x")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, shard string, lang string, fp string").repartition(3)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_packing_round_trip(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {}
    for r in packing.pack(docs, with_ids=True).collect():
        assert r["length"] == 1 << r["bucket"] and r["offset"] == 0 and r["length"] <= 2048
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
    for i, text in texts.items():
        assert [x for _, ids in sorted(got[i]) for x in ids] == [*t.encode(text, add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("text", ["", "a", " a", "a  b", "a \n b", "x\n\ny z ", "it's <|endoftext|> b", "  two", "é  ü", "1 22 333"])
def test_tokenizer_cut_at_spaces(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.frombuffer(packing.encoder().encode(text), dtype="<u4").tolist()
    assert ids == t.encode(text, add_special_tokens=False).ids


def test_sharding_exact(docs, edge):
    rows = sharding.op_query(docs).collect()
    by = Counter(r["shard"] for r in rows)
    assert len(rows) == docs.count() and max(by.values()) - min(by.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in by.items())
    assert sharding.op_query(edge).count() == len(EDGE)
    assert sharding.op_query(docs.limit(0)).count() == 0
    small = sharding.shuffle_into_shards(docs.select("doc_id"), shards=3, block_rows=10).collect()
    assert all(sorted(r["slot"] for r in small if r["shard"] == s) == list(range(Counter(r["shard"] for r in small)[s])) for s in range(3))


def test_hypergeometric_margins():
    sizes, room = np.array([5, 0, 7, 20]), np.array([10, 11, 11])
    m = np.array([sharding.matrix_row(i, sizes, room, 1) for i in range(4)])
    assert (m.sum(axis=0) == room).all() and (m.sum(axis=1) == sizes).all()
    rng = np.random.default_rng(0)
    big = [sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(big) - 400_000) < 200


def test_golay_code():
    near, weight, far, _ = golay.tables()
    assert (weight[1:] > 0).all() and len(np.unique(near)) == 2048
    assert (golay._syndromes(far[weight == 3].ravel()).reshape(-1, 5) == np.flatnonzero(weight == 3)[:, None]).all()


@pytest.mark.parametrize("cap", [64, 1])
def test_links_equal_brute_force(spark, cap):
    rng = np.random.default_rng(3)
    v = rng.integers(0, 2**63, 120, dtype=np.int64)
    for _ in range(3):
        v = np.unique(np.concatenate([v, v[:60] ^ (np.int64(1) << rng.integers(0, 62, 60))]))
    u = v.view(np.uint64)
    want = golay_groups(u)
    edges = golay.links(spark.createDataFrame([(int(x),) for x in v], "fp long"), cap=cap)
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    groups = {}
    for x in v.tolist():
        groups.setdefault(got.get(x, x), set()).add(x)
    assert {frozenset(g) for g in groups.values()} == want


def golay_groups(u):
    parent = list(range(len(u)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 2):
            parent[find(i)] = find(int(j))
    out = {}
    for i, x in enumerate(u.view(np.int64).tolist()):
        out.setdefault(find(i), set()).add(x)
    return {frozenset(g) for g in out.values()}


def test_simhash_edges(edge, docs):
    rows = golay.op_query(edge).collect()
    zero = [r for r in rows if r["fingerprint"] == "0" * 16]
    assert len(rows) == len(EDGE) and {r["doc_id"] for r in zero} == {1, 2, 7} and {r["component_id"] for r in zero} == {1}
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, None)} == {4}
    assert golay.op_query(docs.limit(0)).count() == 0


def test_near_duplicates_in_one_large_bucket(spark):
    """Near to an original but hardly to each other: large buckets find the groups that all their pairs give."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words)]
    texts += [" ".join("zz" if j in (7 * i + 3, 7 * i + 6) else w for j, w in enumerate(words)) for i in range(16)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    few, all_pairs = (set(map(tuple, golay.near_duplicates(d, cap=cap).collect())) for cap in (2, 64))
    assert few == all_pairs and len(all_pairs) >= 0.8 * len(texts)


def test_near_duplicates_lose_no_link(spark):
    """Groups of brute force over all pairs: one added run of words, scattered changes, short and empty texts, repeats."""
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in draw.integers(0, 10**6, 150)]
    texts = ["", " ", "\n", "a b", "A  b", " ".join(base)]
    for i in range(40):
        some, at = list(base), int(draw.integers(0, 140))
        some[at:at] = [f"x{i}_{j}" for j in range(int(draw.integers(1, 60)))]
        texts.append(" ".join(some))
        texts.append(" ".join(f"y{i}" if draw.random() < 0.006 * (i % 8) else w for w in base))
    texts += [" ".join(f"z{i}_{j}" for j in range(30)) for i in range(20)] + texts[:8]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    keys = {r["k"]: r["text"].encode() for r in d.select("text", F.xxhash64("text").alias("k")).collect()}
    root = {k: k for k in keys}

    def top(k):
        return k if root[k] == k else top(root[k])

    for a, b in combinations(keys, 2):
        if golay.jaccard(keys[a], keys[b]) >= 0.8:
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r["doc_key"]: r["group"] for r in golay.near_duplicates(d, cap=4).collect()}
    assert {k: got.get(k, k) for k in keys} == {k: top(k) for k in keys}


def test_rare_shingles_meet():
    """Every two texts of the similarity have one of the rarest shingles in common, whatever the frequencies."""
    draw = np.random.default_rng(5)
    for _ in range(300):
        n = int(draw.integers(1, 60))
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[draw.random(len(a)) < 0.9], draw.integers(0, 2**63, int(draw.integers(0, 8))).astype(np.uint64)]))
        counts = draw.integers(0, 5, golay.SLOTS)
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert np.intersect1d(golay.prefix(a, counts, 0.8), golay.prefix(b, counts, 0.8)).size


def test_texts_of_one_template(spark):
    """Many texts share a passage below the similarity: groups are those of brute force, and few pairs are compared."""
    shared = " ".join(f"t{i}" for i in range(60))
    own = [" ".join(f"u{i // 2}_{j}" for j in range(25)) for i in range(80)]
    texts = [f"{shared} {x}" + (" tail" if i % 2 else "") for i, x in enumerate(own)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = golay.near_duplicates(d, cap=4).groupBy("group").count().collect()
    assert [r["count"] for r in got] == [2] * 40
    named = d.select(golay.text_key(F.col("text")).alias("k"), "text")
    hot = named.select(F.lit(1).cast("long").alias("key"), "k")
    met = golay._unconnected(hot, named, spark.createDataFrame([], "node long, root long"), 0.8, 5)
    assert 40 <= met.count() < 400 < 80 * 79 // 2


def test_clashing_keys_are_told_apart(spark, monkeypatch):
    words = [" ".join(f"w{i}_{j}" for j in range(30)) for i in range(6)]
    d = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(golay.F, "xxhash64", lambda *c: real(*c) % 3 if len(c) == 1 else real(*c))
    assert golay.drop_near_duplicates(d).count() == 6


def test_near_duplicates_keep_clashing_columns(spark):
    schema = "doc_id long, text string, k int, row string, id int, `__k` int, kept int"
    d = spark.createDataFrame([(2, "a b c", 1, "r", 2, 3, 4), (2, "a b c", 1, "r", 2, 3, 4), (1, "a b c", 5, None, 6, 7, 8), (None, None, 9, "x", 1, 1, 1), (7, "", 9, "y", 1, 1, 1)], schema)
    got = golay.drop_near_duplicates(d)
    assert got.schema == d.schema and sorted(got.collect()) == [(1, "a b c", 5, None, 6, 7, 8), (7, "", 9, "y", 1, 1, 1)]
    assert golay.drop_near_duplicates(d.limit(0)).collect() == []


def test_fingerprint_by_hand():
    import xxhash

    for text in ("", "one", "One two", "a b c d e", "the cat sat on the mat the cat sat on the mat", "é ü\x0bX Y"):
        words = [w for w in text.encode().lower().replace(b"\x0b", b" ").split(b" ") if w]
        parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64(x, seed=42).intdigest() for x in parts]
        assert golay.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_near_duplicates_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(300))
    near = base.replace("w7 ", "zz ")
    other = " ".join(f"v{i}" for i in range(300))
    d = spark.createDataFrame([(3, base, 1), (2, near, 2), (5, base, 3), (5, base, 3), (9, other, 4), (10, None, 5)], "doc_id long, text string, `__x` int")
    kept = golay.drop_near_duplicates(d.select("doc_id", "text"))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 9, 10]


def test_decontamination_finds_reparameterised(spark):
    item = "A train leaves Paris at 7 km per hour and meets another train from Lyon after 12 hours of steady travel through hills"
    moved = item.replace("Paris", "Rome").replace("Lyon", "Turin").replace("12", "31").replace(" 7 ", " 9 ")
    b = spark.createDataFrame([(1, item), (2, None), (3, "short one")], "item_id long, text string")
    d = spark.createDataFrame([(1, f"intro words here. {moved} and the end"), (2, "nothing of the kind is in this one text at all"), (3, None), (None, item)], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["verbatim"]) for r in decontam.contamination(d, b).collect()}
    assert got == {(1, 1, False), (None, 1, True)}
    assert sorted(str(r["doc_id"]) for r in decontam.drop_contaminated(d, b).collect()) == ["2", "3"]


def test_inconsistent_slots_are_no_hit(spark):
    item = "if Anna gives apples to Bella and then Anna takes apples back from Bella how many apples has Anna now"
    d = spark.createDataFrame([(1, item.replace("Anna takes", "Carla takes"))], "doc_id long, text string")
    assert decontam.contamination(d, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0


def test_decontamination_finds_other_case(spark):
    item = "A train leaves Paris at 7 km per hour and meets another train from the große Stadt Lyon after 12 hours of steady travel"
    d = spark.createDataFrame([(1, f"INTRO {item.upper()} END"), (2, item.lower()), (3, item), (4, "A TRAIN LEAVES PARIS AND NOTHING ELSE OF IT IS SAID IN THIS TEXT"), (5, item.title().replace("12", "31"))], "doc_id long, text string")
    got = {r["doc_id"]: (r["verbatim"], r["matched_windows"] == r["n_windows"]) for r in decontam.contamination(d, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (True, True), 5: (False, True)}
    loud = spark.createDataFrame([(1, item.upper())], "item_id long, text string")
    assert {r["doc_id"] for r in decontam.contamination(d, loud).collect()} == {1, 2, 3, 5}


def test_short_items_and_edges(spark, docs, sf):
    b = spark.createDataFrame([(1, "how far away is Rome?"), (2, "two words"), (2, "two words"), (None, "how far away is Rome?"), (4, "what is the mass of 3 kg gold"), (5, None)], "item_id long, text string")
    d = spark.createDataFrame([(1, "He asked: how far is Oslo? Nobody", "x"), (2, "How far is", "x"), (3, "what is the mass of 12 kg gold", "x"), (3, "what is the mass of 12 kg gold", "x"), (4, None, "x"), (5, "", None)], "doc_id long, text string, item_id string")
    got = sorted((r["doc_id"], r["item_id"] or 0, r["n_windows"], r["matched_windows"], r["verbatim"]) for r in decontam.contamination(d, b).collect())
    assert (3, 4, 1, 1, False) in got and not any(r[0] in (2, 4, 5) or r[1] == 2 for r in got)
    same = spark.createDataFrame([(1, "So, how far away is Oslo?", 7)], "doc_id long, text string, n_windows int")
    assert {r["item_id"] for r in decontam.contamination(same, b).collect()} == {1, None}
    assert decontam.drop_contaminated(same, b).count() == 0 and decontam.drop_contaminated(d, b).columns == d.columns
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontam.op_query(docs.limit(0), bench).collect() == [] == decontam.op_query(docs, bench.limit(0)).collect()


def test_decontamination_recall(spark, sf):
    """Of items re-parameterised at random (other numbers, other names) in a document, 0.95 or more are found."""
    import random
    import re

    r = random.Random(3)
    items = [(i, f"{a} has {n} apples and gives {m} kg of them to {b} before the {w} market opens again at {h} hours") for i, (a, b, n, m, w, h) in enumerate((r.choice(["Anna", "Ben", "Carla"]), r.choice(["Dora", "Emil"]), r.randint(2, 99), r.randint(2, 99), "".join(r.choices("abcdefgh", k=6)), r.randint(1, 23)) for _ in range(60))]
    names = {"Anna": "Greta", "Ben": "Hugo", "Carla": "Ines", "Dora": "Jana", "Emil": "Karl"}
    moved = [(i, "Some words before. " + re.sub(r"\d+", lambda m: str(int(m[0]) + 7), re.sub("|".join(names), lambda m: names[m[0]], x)) + " Then more.") for i, x in items]
    d, b = spark.createDataFrame(moved, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.contamination(d, b).collect()}
    assert sum((i, i) in got for i, _ in items) >= 57


def test_windows_equal_brute_force(spark, docs):
    """Two windows have one hash if and only if their tokens are the same; kind 2 is where both templates are."""
    odd = spark.createDataFrame([(-1, "İSTANBUL Straße ΣΊΣΥΦΟΣ at 5 km, 3,000 m and 7.5 Km"), (-2, None), (-3, ""), (-4, "one two"), (-5, "one two Three"), (None, "ONE TWO THREE")], "doc_id long, text string")
    views = decontam.views(docs.select("doc_id", "text").limit(20).union(odd).select("doc_id", decontam.normal(F.col("text")).alias("s")), "doc_id").localCheckpoint()
    want, of_hash, seen = [], {}, {}
    tokens = {r["doc_id"]: (r["named"], r["folded"]) for r in views.collect()}
    for i, (named, folded) in tokens.items():
        for w in (3, 8):
            for at in range(len(named) - w + 1):
                same = named[at : at + w] == folded[at : at + w]
                want += [(i, at, w, 2)] if same else [(i, at, w, 0), (i, at, w, 1)]
    got = decontam.windows(views, "doc_id", widths=(3, 8)).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str) and want
    for i, at, w, kind, h in got:
        window = tuple(tokens[i][kind == 1][at : at + w])
        assert of_hash.setdefault(h, window) == window and seen.setdefault(window, h) == h


def test_windows_cost_little_more_than_tokens(spark):
    """Windows of six widths take less than four times the time of the tokens they are made of."""
    import time

    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(4).localCheckpoint()
    views = decontam.views(rows.select("doc_id", decontam.normal(F.col("text")).alias("s")), "doc_id")

    def seconds(df):
        best = []
        for _ in range(3):
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best.append(time.perf_counter() - start)
        return min(best)

    assert seconds(decontam.windows(views, "doc_id", widths=range(3, 9))) < 4 * seconds(views.select(F.size("named"), F.size("folded")))


def test_sql_twins(spark, sf, docs):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for df, sql in ((cascade.op_query(docs), cascade.SQL), (decontam.op_query(docs, spark.read.parquet(f"{sf}/benchmark.parquet")), decontam.SQL)):
        o = c.sql(sql)
        ours = sorted(tuple(r[x] for x in o.columns) for r in df.collect())
        assert ours == sorted(tuple(r) for r in o.fetchall())


def test_language(docs, edge):
    p = langid.op_query(docs).alias("p").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in p) / len(p) > 0.95 and all(0 <= r["score"] <= 1 for r in p)
    assert {r["lang_pred"] for r in langid.op_query(edge).where("doc_id in (1, 2, 7)").collect()} == {"und"}
    assert langid.op_query(docs.limit(0)).count() == 0


def test_cascade_order_keeps_the_verdict(docs):
    a = cascade.judge(docs, list(cascade.RULES))
    b = cascade.judge(docs, list(reversed(cascade.RULES)))
    assert sorted(a.select("doc_id", "kept").collect()) == sorted(b.select("doc_id", "kept").collect())
    cost = {"x": 1.0, "y": 1.0, "z": 0.1}
    assert cascade.order(cost, {frozenset("x"): 10, frozenset("y"): 50, frozenset("z"): 10, frozenset(): 30}) == ["z", "y", "x"]
    # y rejects most, but nothing that z lets pass
    assert cascade.order(cost, {frozenset("yz"): 50, frozenset("x"): 5}) == ["z", "x", "y"]


def test_short_circuit(docs, monkeypatch):
    """Each document runs the rules up to its first rejection and no more; the verdict is that of all rules."""
    cost, rejected = cascade.estimate(docs)
    assert set(cost) == set(cascade.RULES) and sum(rejected.values()) == docs.count()
    named = [(x, cascade.RULES[x]) for x in cascade.order(cost, rejected)]
    texts = [r["text"] for r in docs.collect()]
    for text in texts:
        ran = []
        rules = [(x, lambda t, x=x, rule=rule: ran.append(x) or rule(t)) for x, rule in named]
        why = cascade.first_rejection(cascade.Text(text), rules)
        failed = [x for x, rule in named if rule(cascade.Text(text))]
        assert why == (failed[0] if failed else None)
        assert ran == [x for x, _ in named][: [x for x, _ in named].index(why) + 1 if why else None]
    short = {r["doc_id"]: r["kept"] for r in cascade.judge(docs, counts=False).collect()}
    assert short == {r["doc_id"]: r["kept"] for r in cascade.op_query(docs).collect()}


def test_cascade_edges(spark, edge, docs):
    rows = cascade.op_query(edge.withColumn("kept", F.lit("x")).withColumn("n_words", F.lit(1))).collect()
    assert len(rows) == len(EDGE)
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_repeat_words"], r["base_failed"], r["kept"]) for r in rows}
    assert got[1] == got[2] == got[7] == (0, 0, 0, True, False) and got[4] == got[None] == (2, 2, 0, True, False)
    assert got[3] == (18000, 51000, 18000, True, False)
    assert cascade.op_query(docs.limit(0)).collect() == [] == cascade.judge(docs.limit(0), counts=False).collect()


def test_toxicity_restores(spark, docs):
    words = " ".join(r["text"] for r in docs.collect())
    counts = Counter(w for w in words.lower().split() if w.isalpha()) + Counter({"idiot": 50, "scum": 50})
    grams = Counter()
    for w, n in counts.items():
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += n
    r = toxicity.Restorer(toxicity.CharModel(grams), {"idiot": -2.0, "scum": -2.0})
    for text in ("1d10t", "i d i o t", "i.d.i.o.t", "idiooot"):
        assert "idiot" in r.words(text)
    assert "scum" in r.words("$cum")


def test_toxicity_restores_several_spaced_words(docs):
    words = " ".join(r["text"] for r in docs.collect())
    counts = Counter(w for w in words.lower().split() if w.isalpha()) + Counter({"idiot": 50, "scum": 50, "stupid": 50, "you": 50, "are": 50, "a": 200})
    grams = Counter()
    for w, n in counts.items():
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += n
    r = toxicity.Restorer(toxicity.CharModel(grams), {"idiot": -2.0, "scum": -2.0, "stupid": -2.0, "you": -2.0, "are": -2.0})
    assert "stupid" in r.words("he is a s t u p i d man")
    assert {"you", "idiot"} <= r.words("y o u i d i o t")
    assert {"you", "idiot"} <= r.words("y 0 u  1 d 1 0 t")
    assert "idiot" in r.words("i  d  i  o  t")
    assert {"you", "are", "stupid", "idiot", "scum"} <= r.words("y o u  a r e  a  s t u p i d  i d i o t  s c u m")
    assert {"stupid", "idiot", "scum"} <= r.words("y o u a r e a s t u p i d i d i o t s c u m")
    assert {"stupid", "idiot", "scum"} <= r.words("you.are.a.$tupid/i.d.i.o.t/and/1d10t/and/always/scum")
    assert {"stupid", "idiot"} <= r.words("7you" * 9 + "stupid" + "idiot" * 3)


def readings(steps, breaks):
    """All ways through a lattice: (words, cost of the channel), a word ending after any step or only at the end."""
    ways = [([""], 0.0)]
    for n, choices in enumerate(steps):
        ways = [([*words[:-1], words[-1] + x], cost + c) for words, cost in ways for x, c in choices]
        if breaks and n < len(steps) - 1:
            ways += [([*words, ""], cost) for words, cost in ways]
    return ways


@pytest.mark.parametrize("breaks", [False, True])
@pytest.mark.parametrize("token", ["1d10t", "idiooot", "i.d1ot", "$cum", "b4d!", "a1bad", "no0b", "***", "yo1d"])
def test_viterbi_equals_all_readings(token, breaks):
    grams = Counter()
    for w, n in {"idiot": 5, "scum": 3, "bad": 9, "noob": 2, "you": 20, "a": 30, "die": 4, "nob": 3}.items():
        for i in range(len(w) + 1):
            grams[f"^^{w}$"[i : i + 3]] += n
    model, lexicon = toxicity.CharModel(grams), {"idiot": -1.5, "scum": -1.7, "bad": -1.2, "a": -0.5, "you": -0.8}

    def score(words, cost):
        parts = [max(model.word(w) if w else toxicity.NOTHING, lexicon.get(w, -math.inf)) for w in words]
        return cost + sum(parts)

    steps = toxicity.lattice(token)
    best = max(score(*way) for way in readings(steps, breaks))
    got = toxicity.viterbi(steps, model, toxicity.Words(lexicon), breaks)
    same = [way for way in readings(steps, breaks) if [w for w in way[0] if w] == got]
    assert math.isclose(max(score(*way) for way in same), best, abs_tol=1e-9)


def test_toxicity_has_no_length_limit():
    grams = Counter({"^^i": 9, "^id": 9, "idi": 9, "dio": 9, "iot": 9, "ot$": 9})
    r = toxicity.Restorer(toxicity.CharModel(grams), {"idiot": -1.0})
    assert "idiot" in r.words(" ".join("idiot" * 400)) and "idiot" in r.words("1d10t" * 400)


def test_toxicity_recall_and_tables(spark, sf):
    """Held-out recall at sf0.1 is 0.88 or more with a precision over 0.95; null, repeated and clashing rows are scored each on its own."""
    docs, labels = (spark.read.parquet(f"{sf[:-5]}0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.unionByName(labels.limit(5)).withColumn("text", F.lit("x")))
    rows = toxicity.score(docs, model).where("held_out").join(labels, "doc_id").collect()
    hit = sum(r["toxic"] and r["predicted"] for r in rows)
    assert hit >= 0.88 * sum(r["toxic"] for r in rows) and hit >= 0.95 * sum(r["predicted"] for r in rows)
    odd = spark.createDataFrame([(1, "x", 1), (1, "x", 1), (None, None, 2)], "doc_id long, text string, score int")
    assert toxicity.score(odd, model).count() == 3 and toxicity.drop_toxic(odd, model).collect() == odd.collect()
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.op_query(odd.limit(0), labels).count() == 0


def test_toxicity_edges(spark, edge, docs, sf):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["predicted"] for r in toxicity.op_query(edge, none).collect()} == {0}
    rows = toxicity.op_query(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_brown_base(docs, texts):
    rows = brown.op_query(docs).collect()
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in [*t.encode().lower().split(), b" "])
    n, v = sum(c.values()), len(c)
    for r in rows:
        words = [*texts[r["doc_id"]].encode().lower().split(), b" "]
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r["n_known"] == sum(c[w] > 0 for w in words) and r["train_tokens"] == n
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_brown_exchange_by_brute_force():
    """A word's best class is the one of the greatest objective over all ways to class it, whatever class it leaves."""
    draw = np.random.default_rng(4)
    classes, words = 3, 9
    for _ in range(60):
        pairs = draw.integers(0, 4, (words, words)).astype(float)
        np.fill_diagonal(pairs, 0)
        of = draw.integers(0, classes, words)
        of[-2:] = classes, classes + 1  # the end, and words without a class

        def bigrams(of, but=None):
            n = np.zeros((classes + 2, classes + 2))
            for a, b in zip(*np.nonzero(pairs), strict=True):
                if but not in (a, b):
                    n[of[a], of[b]] += pairs[a, b]
            return n

        some = draw.permutation(words - 2)[:3]
        of[some[0]] = classes + 1
        owner, side, beside, x = [], [], [], []
        for i, w in enumerate(some):
            for k, row in enumerate((pairs[w], pairs[:, w])):
                by_class = np.bincount(of, row, classes + 2)
                at = np.flatnonzero(by_class)
                owner, side, beside, x = owner + [i] * len(at), side + [k] * len(at), [*beside, *at], [*x, *by_class[at]]
        got = brown.best_classes(np.array(owner), np.array(side), np.array(beside), np.array(x), of[some], bigrams(of), classes)
        for w, to in zip(some, got, strict=True):
            value = []
            for k in range(classes):
                moved = of.copy()
                moved[w] = k
                value.append(brown.objective(bigrams(moved)))
            assert math.isclose(value[to], max(value))


def test_brown_core_exchange_by_brute_force():
    draw = np.random.default_rng(6)
    for _ in range(40):
        pairs = draw.integers(0, 5, (8, 8)).astype(float)
        of = draw.integers(0, 3, 8)

        def bigrams(of, but=None):
            n = np.zeros((3, 3))
            for a, b in zip(*np.nonzero(pairs), strict=True):
                if but not in (a, b):
                    n[of[a], of[b]] += pairs[a, b]
            return n

        w = int(draw.integers(0, 8))
        right, left = np.bincount(of, pairs[w], 3), np.bincount(of, pairs[:, w], 3)
        right[of[w]] -= pairs[w, w]
        left[of[w]] -= pairs[w, w]
        gain = brown.gains(bigrams(of, w), right, left, pairs[w, w])
        value = [brown.objective(bigrams(np.where(np.arange(8) == w, k, of))) for k in range(3)]
        assert np.allclose(gain - gain[0], np.array(value) - value[0])


def test_brown_exchange_needs_little_memory():
    """The 10,000 words of one batch, beside 25 classes each, used to take over 400 MB at once."""
    import tracemalloc

    draw = np.random.default_rng(1)
    words, near, k = 10_000, 25, brown.CLASSES + 2
    owner, side = np.repeat(np.arange(words), near), np.tile(np.arange(near) % 2, words)
    beside = np.concatenate([draw.permutation(k)[:near] for _ in range(words)])
    x, was = draw.integers(1, 9, words * near).astype(float), draw.integers(0, brown.CLASSES, words)
    n = draw.integers(100_000, 1_000_000, (k, k)).astype(float)
    tracemalloc.start()
    got = brown.best_classes(owner, side, beside, x, was, n, brown.CLASSES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6
    some = owner >= words - 40
    assert (got[-40:] == brown.best_classes(owner[some] - words + 40, side[some], beside[some], x[some], was[-40:], n, brown.CLASSES)).all()


def test_brown_counts_do_not_depend_on_batches(spark, docs):
    """The neighbours of a batch's, a row's or a piece's first word count like others."""
    import unittest.mock

    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = brown.train(docs)[0]
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
        with unittest.mock.patch.multiple(brown, PIECE=100, ROOM=1000, WEIGHED=200):
            cut = brown.train(docs)[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert (whole.of == cut.of).all() and (whole.log_trans == cut.log_trans).all()


def test_brown_scores_sum_to_one(spark, docs):
    """The chances of all words after a class, and one of no count, are one."""
    model, ids, rest = brown.train(docs)
    p = 10.0 ** model.log_trans
    assert np.allclose(p.sum(axis=1), 1)
    for c in range(len(p)):
        inside = model.of[:-1] == c
        if c != model.rare_class:
            assert not inside.any() or math.isclose((10.0 ** model.emit[:-1][inside]).sum(), 1, rel_tol=1e-6)
    far = [10.0 ** (math.log10(r["n"] + 1) - model.log_rare) for r in rest.collect()]
    assert math.isclose((10.0 ** model.emit[:-1][model.of[:-1] == model.rare_class]).sum() + sum(far) + 10.0**-model.log_rare, 1, rel_tol=1e-6)


def test_brown_score_by_hand(spark, docs, texts):
    """The score of a document is the product of class transitions and emissions, word by word; also with words beyond the broadcast ones."""
    import unittest.mock

    with unittest.mock.patch.object(brown, "NEAR", 3000):
        model, ids, rest = brown.train(docs)
    far = {bytes(r["word"]): r["n"] for r in rest.collect()}
    assert far and 0 < len(model.counts) - 1 <= 3000
    for r in brown.score(docs.where("doc_id < 40"), model, ids, rest, F.lit(False)).collect():
        total, was = 0.0, model.end_class
        for w in [*texts[r["doc_id"]].encode().lower().split(), brown.END]:
            i = ids.value[w]
            c = model.of[i]
            count = model.counts[i] if i >= 0 else far.get(w, 0)
            emit = math.log10(count + 1) - model.log_rare if c == model.rare_class else model.emit[i]
            total, was = total + model.log_trans[was, c] + emit, c
        assert math.isclose(total, r["score"], rel_tol=1e-9)


def test_cut(spark):
    from basalt.llm.common import cut

    d = spark.createDataFrame([(i, n) for i, n in enumerate([1] * 50 + [2] * 20 + [3] * 5 + [900, 901, 5000])], "i int, n long")
    for most in (0, 1, 3, 8, 28, 30, 78, 100):
        least = cut(d, most)
        kept = d.where(F.col("n") > least).count()
        assert kept <= most and (least > 0 or most >= 78) and (most not in (8, 28, 78) or kept == most)


def test_brown_edges(edge, docs):
    assert brown.op_query(edge).count() == len(EDGE)
    assert brown.op_query(docs.limit(0)).count() == 0


def test_pages(spark):
    page = "<html><body><nav><a>Menu</a></nav><article><h1>Ti&amp;tle</h1><p>one  <b>two<p>three</p><div class='comments'>no</div></article><footer>f</footer>"
    d = spark.createDataFrame([(1, "http://a.b/c", page), (2, None, None), (3, "x", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.op_query(d).collect()}
    assert got == {1: "Ti&tle\none two\nthree", 2: "", 3: ""}


def test_style_tree_drops_what_repeats(spark):
    rows = [(i, "http://h.example/x", f"<body><div class=top>Same words here</div><div class=text><p>Own words {i} of this page</p>{'<p>more</p>' * (i % 4)}</div></body>") for i in range(12)]
    got = sitetree.op_query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all("Same words" not in r["text"] and "Own words" in r["text"] for r in got)


def test_style_tree_drops_what_repeats_below_a_root(spark):
    rows = [(i, "http://h.example/x", f"<body><article><h1>Title {i}</h1><div>The same words everywhere</div><p>Own words {i} of this page</p></article></body>") for i in range(12)]
    rows += [(20 + i, "http://copies.example/x", f"<body><div>Visit {i}</div><article><h1>Title</h1><p>Copied words</p></article></body>") for i in range(12)]
    got = {r["page_id"]: r["text"] for r in sitetree.op_query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i}\nOwn words {i} of this page" and got[20 + i] == "Title\nCopied words" for i in range(12))


NEUTRAL = (("<nav>", "<div class=k1>"), ("</nav>", "</div>"), ("<article>", "<div class=k2>"), ("</article>", "</div>"), ("<footer>", "<div class=k3>"), ("</footer>", "</div>"), ('class="ad"', "class=k4"))


@pytest.mark.parametrize("wrapped", [False, True])
def test_importance_decides_without_names(spark, sf, wrapped):
    """Pages whose telling tags and classes are replaced by neutral ones have the same text, also inside one more wrapper."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = F.col("html")
    for a, b in NEUTRAL:
        html = F.replace(html, F.lit(a), F.lit(b))
    if wrapped:
        html = F.replace(F.replace(html, F.lit("<body>"), F.lit("<body><div class=k0>")), F.lit("</body>"), F.lit("</div></body>"))
    want = {r["page_id"]: r["text"] for r in sitetree.op_query(pages).collect()}
    got = {r["page_id"]: r["text"] for r in sitetree.op_query(pages.withColumn("html", html)).collect()}
    blind = {r["page_id"]: sitetree.main_text(r["html"]) for r in pages.withColumn("html", html).collect()}
    assert got == want and all(blind[i] != want[i] for i in want)


def test_articles_of_the_table(spark, sf):
    """By another way: the article's blocks by regular expressions that fit this table's markup."""
    import html
    import re

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        lines = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert sitetree.main_text(r["html"]) == "\n".join(x for x in lines if x)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><article><header class='entry-header'><h1>Title</h1></header><p>text</p></article></body>", "Title\ntext"),
        ("<body><div class='layout with-sidebar'><article><p>text</p></article><div class=sidebar>no</div></div></body>", "text"),
        ("<body><article><p>one</p><div class='social-history'>two</div><div class='post-comments'>no</div></article></body>", "one\ntwo"),
        ("<body><header>no</header><article><p>a <span class=share-links>no</span> b</p></article></body>", "a b"),
        ("<body><div><div><article><p>start</p>" + "<div>" * 250 + "deep" + "</div>" * 250 + "<p>after</p></article>", "start\ndeep\nafter"),
        ("<body><article><p>start" + "<div><b>" * 5000 + "deep</article><p>outside</p>", "start\ndeep"),
        ("<body><div>no root</div><p>here</p><nav>no</nav></body>", "no root\nhere"),
        ("<article>a &lt; b<!-- no --><script>no</script><p>x<table><tr><td>1<td>2</table>y", "a < b\nx\n1\n2\ny"),
        ("<body class='nav-open'><main>text</main>", "text"),
    ],
)
def test_names_are_priors(page, text):
    assert sitetree.main_text(page) == text


def test_importance_equals_brute_force(spark):
    pages = [(i, f"http://h{i % 2}.x/", f"<body><ul><li>{i % 3}</li></ul><div><p>{'word ' * (i % 5)}</p><p>{i}</p></div></body>") for i in range(40)]
    hosts, every = sitetree.style_trees(spark.createDataFrame(pages, "page_id long, url string, html string"))
    for name, some, rows in [("h0.x", pages[::2], hosts), ("h1.x", pages[1::2], hosts), (None, pages, every)]:
        seen = {}
        for _, _, html in some:
            for path, row in sitetree.page_features(html).items():
                seen.setdefault(path, []).append(row)
        got = {r["path"]: r for r in (rows.where(F.col("host") == name) if name else rows).collect()}
        assert set(got) == set(seen)
        for path, rows_of in seen.items():
            for column, at in (("presentation", 1), ("content", 2)):
                p = [n / len(rows_of) for n in Counter(r[at] for r in rows_of).values()]
                assert math.isclose(got[path][column], -sum(x * math.log(x) for x in p) / math.log(len(rows_of)), abs_tol=1e-9)
            inside = [sum(r[3] for r in of) for of in seen.values() if of[0][0] == path and any(r[4] for r in of)]
            words = sum(r[3] for r in rows_of)
            assert got[path]["pages"] == len(rows_of) and math.isclose(got[path]["wrapped"], max(inside, default=0) / words if words else 0)


def test_pages_edges(spark):
    schema = "page_id long, url string, html string, host string, tree string"
    rows = [(None, None, None, "x", "y"), (1, "http://a.b", "<article>x</article>", None, None), (1, "http://a.b", "<article>x</article>", None, None), (2, "HTTP://A.b/q", "plain", "z", "z")]
    got = sitetree.op_query(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [(0, "", 0), (1, "x", 1), (1, "x", 1), (2, "plain", 5)]
    assert sitetree.op_query(spark.createDataFrame([], schema)).collect() == []


def test_secrets(spark, docs, edge):
    key = "9c1185a5c5e9fc54612808977ee8f548b2258d31"
    s = secret_scan.train(docs)
    d = spark.createDataFrame([(1, f'see token = "{key}" end', 1), (2, f"at commit {key} we", 2), (3, 'password = "your_password_here"', 3)], "doc_id long, text string, n_chars long")
    hits = {r["doc_id"]: r["is_secret"] for r in secret_scan.scan(d, s).collect()}
    assert hits[1] and not hits.get(2) and not hits.get(3)
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(d, s).collect()}
    assert key not in clean[1] and key in clean[2]
    assert secret_scan.op_query(edge).count() == 0


def test_secrets_in_env_style(spark, docs):
    aws, git, plain = "AKIA" + "Q7RZ2MNB4KXW9TLD", "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8", "u7Gk2PqX9rT4vB8nM3zL6wY1"
    texts = [f"AWS_ACCESS_KEY_ID={aws}", f"token={git}", "STRIPE_KEY=" + "sk_live_" + "4eC39HqLyjWDarjtT1zdp7dc", f"DB_PASS={plain}", f"see https://host.org/a?page=12&api_key={plain} here", f"Authorization: Bearer {plain}"]
    got = [{(t[a:b], rule) for a, b, rule in secret_scan.candidates(t)} for t in texts]
    for want, has in zip([(aws, "aws_key"), (git, "github"), ("sk_live_" + "4eC39HqLyjWDarjtT1zdp7dc", "stripe"), (plain, "long_string"), (plain, "assignment"), (plain, "long_string")], got, strict=True):
        assert want in has
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = [r["text"] for r in secret_scan.redact(d, secret_scan.train(docs)).collect()]
    assert not any(x in t for t in clean for x in (aws, git, plain, "4eC39")) and "AWS_ACCESS_KEY_ID=[SECRET]" in clean


def test_long_secrets_go_whole(spark, docs):
    r = np.random.default_rng(3)
    signs = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    scanner = secret_scan.train(docs)
    for size in (100, 513, 900, 5000):
        key = "".join(r.choice(signs, size))
        for text in (f"api_key = {key} end", f"api_key={key}", f"at https://{key}:{key}@host.org/ end"):
            (a, b, _, p), *more = secret_scan.Scanner.scan(scanner, text)
            assert text[a:b] == (f"{key}:{key}" if "@" in text else key) and p >= secret_scan.THRESHOLD and not more
    # time must grow with the text, not with its square
    assert secret_scan.candidates("a:b" * 200_000) == [] and len(secret_scan.candidates("://" + "x" * 200_000)) <= 1


def test_secrets_keep_the_rest_of_a_run():
    tail = "x9Qm4Tz7Lb2Vn8Rk5Wc1Yd6"
    t = f"token=abc/eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJl/{tail}"
    got = [(t[a:b], rule) for a, b, rule in secret_scan.candidates(t)]
    assert [x for x in got if x[1] == "jwt"] and got[-1][0].endswith(tail)


def planted_secrets(n=300, seed=5):
    """(text, secret or None): true secrets and decoys in shapes and contexts that training doesn't copy."""
    import random
    import string

    r = random.Random(seed)
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"

    def of(signs, k):
        return "".join(r.choices(signs, k=k))

    out = []
    for i in range(n):
        lead, tail = " ".join(r.choices(["we", "saw", "the", "log", "of", "a", "job"], k=5)), " ".join(r.choices(["and", "then", "left", "it"], k=4))
        if i % 2:
            key = r.choice([of(alnum, 32), of(alnum + "_-", 40), of(hexa, 48), of(string.ascii_uppercase + "234567", 32), of(alnum + "+/", 44)])
            before = r.choice(["service_token: ", "export DB_PASSWORD=", '"apiKey": "', "smtp_secret = '", "x-api-key: ", "auth_key="])
            out.append((f"{lead} {before}{key}{chr(34) if chr(34) in before else chr(39) if chr(39) in before else ''} {tail}", key))
        else:
            decoy = r.choice([
                f"index {of(hexa, 7)}..{of(hexa, 40)} 100644", f"request_id={of(hexa, 8)}-{of(hexa, 4)}-{of(hexa, 4)}-{of(hexa, 4)}-{of(hexa, 12)}",
                f"sha256: {of(hexa, 64)}", f"src/main/java/org/module{r.randint(10, 99)}/parts/file_{r.randint(100, 999)}.java", "password = <your_password_here>",
                "token = get_token_from_environment_2()", f"build 2024-1{r.randint(0, 2)}-2{r.randint(0, 8)}T1{r.randint(0, 9)}-{r.randint(100000, 999999)}", "api_key: ${API_KEY_FROM_VAULT}",
            ])
            out.append((f"{lead} {decoy} {tail}", None))
    return out


def test_secrets_precision_and_recall(spark, sf):
    """On planted secrets and decoys precision and recall are over 0.9, and the forest rejects candidates."""
    scanner = secret_scan.train(spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet"))
    hit = false = missed = rejected = 0
    for text, key in planted_secrets():
        found = scanner.scan(text)
        said = [text[a:b] for a, b, _, p in found if p >= secret_scan.THRESHOLD]
        rejected += sum(p < secret_scan.THRESHOLD for *_, p in found)
        hit, missed = hit + (key in said), missed + (key is not None and key not in said)
        false += sum(x != key for x in said)
    assert rejected >= 50 and hit >= 0.9 * (hit + missed) and hit >= 0.9 * (hit + false), (hit, missed, false, rejected)


def test_overlaps_are_settled_after_scoring():
    findings = [(0, 30, "long_string", 0.4), (6, 30, "assignment", 0.7), (6, 12, "jwt", 0.6), (12, 30, "long_string", 0.9), (40, 50, "long_string", 0.1)]
    assert secret_scan.resolve(findings) == [(6, 12, "jwt", 0.6), (12, 30, "long_string", 0.9), (40, 50, "long_string", 0.1)]
    draw = np.random.default_rng(1)
    for _ in range(50):
        some = [(int(a), int(a + n), "long_string", float(p)) for a, n, p in zip(draw.integers(0, 60, 12), draw.integers(1, 20, 12), draw.random(12), strict=True)]
        kept = []
        for f in sorted(some, key=lambda f: (f[3] < secret_scan.THRESHOLD, -f[3])):
            if all(f[1] <= x[0] or x[1] <= f[0] for x in kept):
                kept.append(f)
        assert sorted(kept) == secret_scan.resolve(some)
    text = "token=AB12cd/34ef56gh78ij90kl"
    assert (6, len(text), "assignment") in secret_scan.candidates(text)


def test_forest_parts_and_predicts(spark):
    """Every tree's share at a row is that of a walk by hand; a separable target is learnt."""
    draw = np.random.default_rng(2)
    x = draw.random((300, 5))
    y = (x[:, 2] > 0.5).astype(float)
    forest = secret_scan.Forest(x, y, trees=9, depth=4)
    for row, p in zip(x[:50], forest.predict(x[:50]), strict=True):
        shares = []
        for t in forest.trees:
            at = 0
            while t[at][0] >= 0:
                at = int(t[at][2] if row[int(t[at][0])] <= t[at][1] else t[at][3])
            shares.append(t[at][4])
        assert math.isclose(p, sum(shares) / len(shares))
    assert ((forest.predict(x) >= 0.5) == (y == 1)).mean() > 0.95


def test_secret_edges(spark, docs):
    scanner = secret_scan.train(docs.limit(0))
    odd = spark.createDataFrame([(1, None, 3, "a"), (1, "", 3, "a"), (None, "api_key = 'k9X2m4Q7z1B8v3N6c5L0'", 3, None)], "doc_id long, text string, start int, rule string")
    assert secret_scan.scan(odd, scanner).count() == 1 and secret_scan.scan(odd.limit(0), scanner).count() == 0
    assert [r[0] for r in secret_scan.redact(odd, scanner).select("start").collect()] == [3, 3, 3]
    assert secret_scan.op_query(docs.limit(0)).collect() == []


def test_tokenizer_on_random_text():
    """The cut at spaces gives the ids of the tokenizer file for text of any script, blanks and controls."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    t, enc, r = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(), random.Random(9)
    ranges = [(32, 127), (9, 14), (160, 592), (0x370, 0x5FF), (0x900, 0xDFF), (0x2000, 0x2100), (0x3040, 0x3100), (0x4E00, 0x5000), (0x1F300, 0x1F650), (0xE000, 0xE010)]
    for _ in range(400):
        text = "".join(" " if r.random() < 0.2 else chr(r.randrange(*r.choice(ranges))) for _ in range(r.randint(0, 60)))
        assert np.frombuffer(enc.encode(text), dtype="<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_packing_edges(edge, docs):
    rows = packing.op_query(edge).collect()
    per = {}
    for r in rows:
        per.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["length"]))
    assert per[1, 1] == per[2, 1] == [(0, 1)] and len(rows) == len({r["sequence_id"] for r in rows}) and any(k[0] is None for k in per)
    assert all(sum(n for _, n in v) == k[1] * (2 if k[0] == 4 else 1) for k, v in per.items())
    assert packing.op_query(docs.limit(0)).collect() == []


def test_sharding_digest_and_uniformity(spark, docs, texts, edge):
    for r in sharding.op_query(docs).collect():
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw)
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in sharding.op_query(edge).collect() if r["doc_id"] in (1, 2)} == {(1, 8, 0), (2, 8, 0)}
    # over many seeds every row comes to every place about as often
    small = spark.range(12).repartition(3).withColumnRenamed("id", "doc_id")
    seen = Counter()
    for seed in range(60):
        seen.update((r["doc_id"], r["shard"]) for r in sharding.shuffle_into_shards(small, shards=3, seed=seed, block_rows=2).collect())
    chi = sum((seen[i, s] - 20) ** 2 / 20 for i in range(12) for s in range(3))
    assert chi < 60  # 24 degrees of freedom


def test_language_by_brute_force(spark, docs):
    """Held-out languages, and distances by dictionaries of n-grams made by hand."""
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]

    def symbol(c):
        low = ord(c.lower()[0])
        return low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % 37

    def counts(text):
        out = Counter()
        words = "".join(c if c.isalpha() else " " for c in text).split()
        for w in words:
            s = [0, *map(symbol, w), 0]
            for n in (1, 2, 3, 4):
                for i in range(len(s) - n + 1):
                    g = s[i : i + n]
                    if (n == 1 and g[0]) or n == 2 or (n > 2 and all(g[1:-1])):
                        code = n << 24
                        out[code | sum(x << 6 * (n - 1 - k) for k, x in enumerate(g))] += 1
        return out

    def rank(c):
        return [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: langid.TOP]]

    profiles = {x: rank(sum((counts(r["text"]) for r in train if r["lang"] == x), Counter())) for x in {r["lang"] for r in train}}
    held = {r["doc_id"]: r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    right = 0
    for r in langid.op_query(docs).where("held_out").collect():
        own = rank(counts(held[r["doc_id"]]["text"]))
        far = {x: sum(abs(p.index(g) - i) if g in p else langid.TOP for i, g in enumerate(own)) for x, p in profiles.items()}
        if own:
            assert r["lang_pred"] == min(far, key=lambda x: (far[x], x)) and math.isclose(r["score"], 1 - min(far.values()) / (langid.TOP * len(own)))
        right += r["lang_pred"] == held[r["doc_id"]]["lang"]
    assert right >= 0.95 * len(held)
    none = spark.createDataFrame([(1, "\U000e0041\U000e0042 \U0010ffff 12"), (2, "\U00030001")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(none, profiles).collect()}
    assert got[1] == "und" and got[2] != "und"


def test_pipeline_stages_on_odd_tables(spark, sf):
    """Nulls, repeats, blanks, ties and columns of clashing names pass every stage; an empty table gives an empty one."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, k string, row int, id int, item_id long, __bad int"
    plain = "the quiet river runs below the old stone bridge near our small town"
    rows = [(1, None, None, None, None, "a", 1, 1, 1, 1), (2, "", "en", "x", 0, "a", 1, 1, 1, 1), (3, plain, "en", "x", 3, None, 1, 1, 1, 1), (3, plain, "en", "x", 3, None, 1, 1, 1, 1), (None, plain + " today", "en", "x", 9, "b", 1, 1, 1, 1), (5, "word " * 5000, "en", "x", 9, "b", 1, 1, 1, 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        now = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns, name
        kept = now.collect()
        assert {r["doc_id"] for r in kept} == ({1, 3, 5} if docs.count() else set()) and len(kept) == len({r["doc_id"] for r in kept})
        assert corpus_pipeline.STAGES[-1][1](spark, now, sf).select("doc_id").distinct().count() == len(kept)


def test_pipeline(spark, sf):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, sf).select("doc_id", "length").agg(F.countDistinct("doc_id"), F.count("*")).first()
    assert 100 < rows[0] < 200 and rows[1] > rows[0]
