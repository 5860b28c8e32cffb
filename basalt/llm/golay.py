"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

The perfect (23, 12) Golay code decodes any 23 bits to the one codeword within 3 errors. Bits at
distance 3 from theirs also lie at distance 4 from five more; with those as further keys, two
segments that differ in at most one bit always share a key.

``links``: a 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. If two fingerprints differ
in at most two bits, then in some cyclic pair of segments the first is equal and the second has at
most one error (pigeonhole), so they share a key made of the first's bits and a codeword of the
second: 3 to 18 keys a fingerprint, each random pair meeting in one with probability about 5e-9.
Pairs that share a key are verified by their Hamming distance. In a bucket of more than ``CAP``
fingerprints, members instead emit themselves and their one-bit neighbours outside the equal
segment; two are within two bits just if they share one, so links are found without pairs.

``near_duplicates``: the same decoding finds texts of a similarity of 0.8 or more on five-word
shingles. One SimHash over a whole text can't: at 0.8 up to 15 of 100 of its bits differ, whatever its
length. So each of fourteen 46-bit segments is the SimHash of three shingles, those first in the
segment's own random order; its halves are decoded, every two segments give a key, and pairs that
share one are verified by sketches in the JVM and by the exact Jaccard similarity.

Equal texts share a fingerprint and are one node everywhere, however many there are.

Defined cases: text without a word has fingerprint zero and links like any other; null ids count as
rows but never as a component's least id unless alone; repeated rows give a row each.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import checkpoint, configure, map_arrow, text_bytes
from basalt.llm.components import components

SHINGLE, BITS, RADIUS = 3, 64, 2
SEED = 42
#: Fingerprints of one key up to which pairs are compared; beyond, one-bit neighbours meet.
CAP = 64

#: Near duplicates: words of a shingle, similarity, segments of the fingerprint, shingles drawn for one.
WORDS, SIMILARITY = 5, 0.8
SEGMENTS, DRAWN = 14, 3
#: Bits, and 64-bit words, of each of the two sketches that rule out pairs before texts are compared.
BINS = 512
LANES = BINS // 64
#: Texts of one key up to which near duplicates are compared in all pairs; beyond, first in a chain, then by rare shingles.
NEAR_CAP = 8

#: Keys that are broadcast to pick their texts; more are joined, each text under one of so many salts.
BROADCAST_KEYS, SALTS = 1_000_000, 32
#: Counters of the estimated frequency of shingles.
SLOTS = 1 << 16

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, the generator of the code.
GENERATOR = 0b110001110101


def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator."""
    r = v.astype(np.int64)
    for i in range(22, 10, -1):
        r = np.where(r >> i & 1, r ^ (GENERATOR << (i - 11)), r)
    return r


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Error of every syndrome; its weight; the five other errors of weight 4; syndrome of the top 12 bits."""
    near = np.zeros(2048, dtype=np.int64)
    weight = np.zeros(2048, dtype=np.int64)
    for w in (1, 2, 3):
        e = np.array([sum(1 << i for i in c) for c in combinations(range(23), w)])
        s = _syndromes(e)
        near[s], weight[s] = e, w
    e = np.array([sum(1 << i for i in c) for c in combinations(range(23), 4)])
    s = _syndromes(e)
    order = np.argsort(s, kind="stable")
    far = np.zeros((2048, 5), dtype=np.int64)
    for k, i in enumerate(order):
        far[s[i], k % 5] = e[i]
    return near, weight, far, _syndromes(np.arange(4096) << 11)


def nearest(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (top 12 bits) of the codeword nearest to 23-bit words, and their syndromes."""
    near, _, _, top = tables()
    s = top[v >> 11] ^ (v & 2047)
    return (v ^ near[s]) >> 11, s


def word_shingles(raw: bytes, size: int) -> tuple[list[bytes], list[bytes]]:
    words = raw.lower().split()
    if size == 1 or len(words) <= 1:
        return words, words
    return words, [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def majority(h: np.ndarray) -> np.ndarray:
    """1 for each of the bits (most significant first) set in over half of the hashes, along rows of uint64 words."""
    n = len(h)
    bits = np.unpackbits(np.ascontiguousarray(h.astype(">u8")).view(np.uint8).reshape(n, -1), axis=1)
    total = np.zeros(bits.shape[1], dtype=np.int64)
    for at in range(0, n, 255):
        total += np.add.reduce(bits[at : at + 255], axis=0, dtype=np.uint8)
    return (2 * total > n).astype(np.uint8)


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the words of a text, by XXH64 of space-joined shingles."""
    _, parts = word_shingles(raw, shingle)
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(x, seed) for x in parts), dtype=np.uint64, count=len(parts))
    return int.from_bytes(np.packbits(majority(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with fp as a signed long."""
    configure(docs.sparkSession)

    def work(batches):
        for batch in batches:
            fps = np.array([fingerprint(x, shingle) for x in text_bytes(batch)], dtype=np.uint64)
            yield {"doc_id": batch.column("id"), "fp": fps.view(np.int64)}

    return map_arrow(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), work, "doc_id long, fp long", pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())]))


#: Shift and width of the three segments of 64 bits.
CUTS = ((42, 22), (21, 21), (0, 21))


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) of all keys of uint64 fingerprints."""
    _, weight, far, _ = tables()
    segments = [((fps >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in CUTS]
    at = np.arange(len(fps))
    rows, keys = [], []
    for z in range(3):
        exact, fuzzy = segments[z], segments[(z + 1) % 3]
        base = (np.int64(z) << 36) | (exact << 12)
        code, s = nearest(fuzzy)
        rows.append(at)
        keys.append(base | code)
        edge = weight[s] == 3
        rows.append(np.repeat(at[edge], 5))
        keys.append((base[edge, None] | ((fuzzy[edge, None] ^ far[s[edge]]) >> 11)).ravel())
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(fps: DataFrame) -> DataFrame:
    def work(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy(zero_copy_only=False)
            at, keys = fuzzy_keys(own.view(np.uint64))
            yield {"fp": own[at], "key": keys}

    return map_arrow(fps, work, "fp long, key long", pa.schema([("fp", pa.int64()), ("key", pa.int64())]))


def _neighbours(hot: DataFrame) -> DataFrame:
    """(key, mid) of each fingerprint and its one-bit neighbours outside the key's equal segment."""

    def work(batches):
        for batch in batches:
            own, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "key"))
            for z, (shift, width) in enumerate(CUTS):
                mine = (keys >> 36) == z
                flips = np.array([0, *(1 << i for i in range(64) if not shift <= i < shift + width)], dtype=np.uint64)
                mids = (own[mine].view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
                yield {"fp": np.repeat(own[mine], len(flips)), "key": np.repeat(keys[mine], len(flips)), "mid": mids}

    return map_arrow(hot.select("fp", "key"), work, "fp long, key long, mid long", pa.schema([("fp", pa.int64()), ("key", pa.int64()), ("mid", pa.int64())]))


def links(fps: DataFrame, cap: int = CAP) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (column fp) of at most 2 differing bits, enough to connect all that are linked."""
    keyed = _keyed(fps)
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    many = checkpoint(keyed.join(shared, "key"))
    few = many.where(F.col("n") <= cap)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where("a > b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    hot = _neighbours(many.where(F.col("n") > cap))
    # at most 65 fingerprints are within one bit of another
    met = hot.groupBy("key", "mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    stars = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked by fingerprints of at most 2 differing bits."""
    rows = checkpoint(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = checkpoint(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = named.join(least, "root").select("fp", "component_id")
    return rows.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op_query(docs: DataFrame) -> DataFrame:
    return simhash_components(docs)


# Near duplicates of a similarity threshold


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash of each hash, by the splitmix finaliser."""
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority64(h: np.ndarray) -> np.uint64:
    """SimHash of at most DRAWN hashes: the bits set in over half of them."""
    if len(h) < DRAWN:
        return np.bitwise_and.reduce(h) if len(h) else np.uint64(0)
    return (h[0] & h[1]) | (h[0] & h[2]) | (h[1] & h[2])


def _lanes(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits).view(">u8").astype(np.uint64)


def shingle_hashes(raw: bytes, size: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 values of the word shingles of a text."""
    parts = set(word_shingles(raw, size)[1])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(x, SEED) for x in parts), dtype=np.uint64, count=len(parts)))


def signature(raw: bytes, size: int = WORDS) -> np.ndarray:
    """Count of distinct shingles, LANES of parities, LANES of least bits, and the fingerprint's SEGMENTS, as longs."""
    h = shingle_hashes(raw, size)
    out = np.zeros(1 + 2 * LANES + SEGMENTS, dtype=np.uint64)
    out[0] = len(h)
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    out[1 : 1 + LANES] = _lanes((np.bincount(bins, minlength=BINS) & 1).astype(np.uint8))
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    least = np.zeros(BINS, dtype=np.uint8)
    least[bins[first]] = h[first] & np.uint64(1)
    out[1 + LANES : 1 + 2 * LANES] = _lanes(least)
    with np.errstate(over="ignore"):
        for k in range(SEGMENTS):
            m = _mixed(h, k + 1)
            drawn = np.partition(m, DRAWN - 1)[:DRAWN] if len(m) > DRAWN else m
            out[1 + 2 * LANES + k] = _majority64(_mixed(drawn, SEGMENTS + 1))
    return out.view(np.int64)


def segment_codes(segments: np.ndarray) -> np.ndarray:
    """24 bits of each segment: the nearest codewords of its two 23-bit halves."""
    low, high = segments & 0x7FFFFF, segments >> 23 & 0x7FFFFF
    return (nearest(high)[0] << 12) | nearest(low)[0]


def jaccard(a: bytes, b: bytes, size: int = WORDS) -> float:
    """Similarity of two texts' sets of word shingles; texts without a word are equal."""
    x, y = set(word_shingles(a, size)[1]), set(word_shingles(b, size)[1])
    return len(x & y) / len(x | y) if x or y else 1.0


def _keys(sig: str = "sig"):
    """One key (numbers of two segments, their codes) for every two segments."""
    at = [F.col(sig)[1 + 2 * LANES + i] for i in range(SEGMENTS)]
    return F.array(*[F.shiftleft(at[i], 24).bitwiseOR(at[j]).bitwiseOR(F.lit((i << 4 | j) << 48).cast("long")) for i, j in combinations(range(SEGMENTS), 2)])


def _differing(x: str, y: str, start: int):
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(start, start + LANES)), F.lit(0))


def _likely(x: str, y: str, similarity: float):
    """Whether two signatures leave room for the similarity.

    The ratio of the counts and the parities (each shingle of only one text flips one of them) rule
    out nothing at or above it; the least bits, five standard deviations above their mean, next to nothing.
    """
    n, m = F.col(x)[0], F.col(y)[0]
    union = (n + m) / (1 + similarity)
    filled = BINS * (1 - F.exp(-union / BINS))
    sized = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9
    parities = _differing(x, y, 1) <= union * (1 - similarity) + 1e-9
    least = _differing(x, y, 1 + LANES) <= filled * (1 - similarity) / 2 + 1.5 * F.sqrt(filled) + 2
    return sized & parities & least


def _texts_of(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(k, text), once for each of ``keys``; copies of a text are never sent to one task before they are reduced."""
    wanted = checkpoint(keys.distinct())
    if wanted.count() <= BROADCAST_KEYS:
        some = texts.join(F.broadcast(wanted), "k", "left_semi")
    else:
        salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        some = texts.withColumn("salt", F.spark_partition_id() % SALTS).join(salted, ["k", "salt"], "left_semi").drop("salt")
    return some.dropDuplicates(["k"])


def _verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) of text keys whose texts reach the similarity: first by their signatures, then by Jaccard."""
    both = pairs.join(sigs.select(F.col("k").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("k").alias("b"), F.col("sig").alias("sb")), "b")
    likely = checkpoint(both.where(_likely("sa", "sb", similarity)).select("a", "b"))
    own = checkpoint(_texts_of(texts, likely.select(F.explode(F.array("a", "b")).alias("k"))))
    compared = likely.join(own.select(F.col("k").alias("a"), F.col("text").alias("ta")), "a").join(own.select(F.col("k").alias("b"), F.col("text").alias("tb")), "b")

    def verify(batches):
        for batch in batches:
            same = [jaccard(x, y, shingle) >= similarity for x, y in zip(text_bytes(batch, "ta"), text_bytes(batch, "tb"), strict=True)]
            some = batch.filter(pa.array(same, pa.bool_()))
            yield {"a": some.column("a"), "b": some.column("b")}

    return map_arrow(compared.select("a", "b", "ta", "tb"), verify, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _ordered(a: str, b: str) -> tuple:
    return F.greatest(a, b).alias("a"), F.least(a, b).alias("b")


def _chain(hot: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts that follow each other in a bucket, in the order of the segments after those of its key.

    Texts that agree in more segments come to stand together. Rows are ranged, so a bucket of any size spreads over tasks.
    """
    codes = F.slice("sig", 2 + 2 * LANES, SEGMENTS)
    after = (F.shiftright("key", 48).bitwiseAND(F.lit(15)) + 1).cast("int")
    turned = F.concat(F.slice(codes, after + 1, F.lit(SEGMENTS)), F.slice(codes, F.lit(1), after))
    ranged = hot.join(sigs, "k").select("key", "k", turned.alias("place")).repartitionByRange("key", "place", "k").sortWithinPartitions("key", "place", "k")

    def work(batches):
        key = k = np.zeros(0, dtype=np.int64)
        for batch in batches:
            key = np.concatenate([key[-1:], batch.column("key").to_numpy()])
            k = np.concatenate([k[-1:], batch.column("k").to_numpy()])
            same = key[1:] == key[:-1]
            yield {"a": k[1:][same], "b": k[:-1][same]}

    pairs = map_arrow(ranged.select("key", "k"), work, "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    return pairs.select(*_ordered("a", "b"))


def slots(h: np.ndarray) -> np.ndarray:
    """Slot of a shingle in the table of frequencies."""
    return (h >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


def prefix(h: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The rarest of a text's shingles: two texts of the similarity have one of theirs in common.

    Of n shingles a similar text holds similarity * n or more, so not all of n - ceil(similarity * n) + 1
    can be missing; with one order for all texts, the least shingle in common is in both prefixes.
    """
    if not len(h):
        return np.zeros(1, dtype=np.uint64)
    size = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    return h[np.lexsort((h, counts[slots(h)]))][:size]


def _prefixes(own: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(shingle, k, c, n, place) of the prefix of every text of ``own`` (k, c, text), by estimated frequency among these texts.

    n is the number of the text's shingles, place that of the shingle among them, the rarest being 0.
    """

    def count(batches):
        total = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for raw in text_bytes(batch):
                total += np.bincount(slots(shingle_hashes(raw, shingle)), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield {"slot": at, "n": total[at]}

    counted = map_arrow(own.select("text"), count, "slot long, n long", pa.schema([("slot", pa.int64()), ("n", pa.int64())]))
    counts = np.zeros(SLOTS, dtype=np.int64)
    for r in counted.groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        counts[r["slot"]] = r["n"]
    sent = own.sparkSession.sparkContext.broadcast(counts)

    def work(batches):
        for batch in batches:
            every = [shingle_hashes(raw, shingle) for raw in text_bytes(batch)]
            parts = [prefix(h, sent.value, similarity) for h in every]
            at = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
            out = {c: batch.column(c).to_numpy(zero_copy_only=False)[at] for c in ("k", "c")}
            out["n"] = np.array([len(h) for h in every], dtype=np.int64)[at]
            out["place"] = np.concatenate([*(np.arange(len(x)) for x in parts), np.zeros(0, np.int64)])
            yield {"shingle": np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)} | out

    return map_arrow(own.select("k", "c", "text"), work, "shingle long, k long, c long, n long, place long", pa.schema([(x, pa.int64()) for x in ("shingle", "k", "c", "n", "place")]))


def _unconnected(hot: DataFrame, texts: DataFrame, roots: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Pairs (a, b) of texts of the buckets of ``hot`` that lie in different components (node, root) and may be similar.

    A bucket is large because its texts share some passage. So they meet by what is rare among them: two
    texts of the similarity share a shingle of their prefixes, and a passage that many share comes late there,
    where too little is left for the similarity. Of two texts with a shingle in common one lies outside the shingle's largest component, so
    only those outside meet the others.
    """
    named = checkpoint(hot.join(roots, hot["k"] == roots["node"], "left").select("key", "k", F.coalesce("root", "k").alias("c")))
    parts = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    members = checkpoint(named.join(parts, "key", "left_semi").select("k", "c").distinct())
    own = checkpoint(_texts_of(texts, members.select("k")).join(members, "k"))
    emitted = checkpoint(_prefixes(own, similarity, shingle))
    sizes = emitted.groupBy("shingle", "c").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("shingle").agg(F.max_by("c", F.struct("m", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1").select("shingle", "top")
    known = emitted.join(largest, "shingle")
    outside = known.where("c <> top").select("shingle", *[F.col(c).alias(f"{c}_x") for c in ("k", "c", "n", "place")])
    sized = F.least("n", "n_x") >= similarity * F.greatest("n", "n_x") - 1e-9
    # at the first shingle in common, nothing before it and at most what follows it in either text is common
    room = F.least(F.col("n") - F.col("place"), F.col("n_x") - F.col("place_x")) >= similarity / (1 + similarity) * (F.col("n") + F.col("n_x")) - 1e-9
    # two outside meet once, by the order of their keys
    met = outside.join(known, "shingle").where("c_x <> c and (c = top or k_x > k)").where(sized & room)
    return met.select(*_ordered("k_x", "k")).distinct()


def text_key(text, clashes: tuple[int, ...] = ()):
    """64-bit key of a text; those that different texts turned out to share are hashed again."""
    text = F.coalesce(text, F.lit(""))
    k = F.xxhash64(text)
    return F.when(k.isin(*clashes), F.xxhash64(F.lit("again"), text)).otherwise(k) if clashes else k


def signatures(docs: DataFrame, text_col: str, shingle: int) -> tuple[DataFrame, tuple[int, ...]]:
    """(k, sig) of every distinct text, and the keys that clash (none, but for some in 10^10 texts).

    A second, independent hash tells whether a key stands for one text.
    """

    def work(batches):
        for batch in batches:
            sigs = np.stack([signature(x, shingle) for x in text_bytes(batch)]) if batch.num_rows else np.zeros((0, 1 + 2 * LANES + SEGMENTS), dtype=np.int64)
            sigs[:, 1 + 2 * LANES :] = segment_codes(sigs[:, 1 + 2 * LANES :])
            yield {"k": batch.column("k"), "other": batch.column("other"), "sig": list(sigs)}

    schema = pa.schema([("k", pa.int64()), ("other", pa.int64()), ("sig", pa.list_(pa.int64()))])
    clashes: tuple[int, ...] = ()
    while True:
        text = docs[text_col]
        texts = docs.select(text_key(text, clashes).alias("k"), F.xxhash64(F.lit("other"), F.coalesce(text, F.lit(""))).alias("other"), text.alias("text"))
        signed = map_arrow(texts, work, "k long, other long, sig array<long>", schema)
        sigs = checkpoint(signed.groupBy("k").agg(F.first("sig").alias("sig"), F.min("other").alias("low"), F.max("other").alias("high")))
        more = tuple(r[0] for r in sigs.where("low <> high").select("k").collect())
        if not more:
            return sigs.select("k", "sig"), clashes
        clashes += more


def _groups(docs: DataFrame, text_col: str, similarity: float, shingle: int, cap: int) -> tuple[DataFrame, tuple[int, ...]]:
    """(doc_key, group) of near duplicates, and the keys that ``text_key`` must hash again."""
    configure(docs.sparkSession)
    sigs, clashes = signatures(docs, text_col, shingle)
    texts = docs.select(text_key(docs[text_col], clashes).alias("k"), docs[text_col].alias("text"))
    keyed = sigs.select("k", F.explode(_keys()).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    many = checkpoint(keyed.join(shared, "key"))
    few, hot = many.where(F.col("n") <= cap), many.where(F.col("n") > cap).select("key", "k")
    pairs = few.select("key", F.col("k").alias("a")).join(few.select("key", F.col("k").alias("b")), "key").where("a > b").select("a", "b")
    found = checkpoint(pairs.union(_chain(hot, sigs)).distinct())
    roots = checkpoint(components(_verified(found, sigs, texts, similarity, shingle)))
    met = checkpoint(_unconnected(hot, texts, roots, similarity, shingle).join(found, ["a", "b"], "left_anti"))
    more = _verified(met, sigs, texts, similarity, shingle)
    stars = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(stars.union(more)).select(F.col("node").alias("doc_key"), F.col("root").alias("group")), clashes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = WORDS, cap: int = NEAR_CAP) -> DataFrame:
    """(doc_key, group) of every distinct text that has a near duplicate; group is the least key.

    ``doc_key`` is ``text_key`` of the text. A segment is the SimHash of the three shingles that come
    first in an order of its own, so texts of similarity s agree in it with a probability of about
    s^3 and share a key of two segments, at 0.8, in 0.999 of cases, however their changes lie.
    A bucket of up to ``cap`` texts compares all its pairs. In larger ones each text first meets the
    next one in the order of the other segments; texts of a bucket that these links leave in several
    groups then meet by their rarest shingles: no pair that shares a key is left out unless its texts
    are in one group already.
    """
    return _groups(docs, text_col, similarity, shingle, cap)[0]


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document, that of the least id, of every group of equal or near-equal texts; all columns stay as they are.

    Null ids come last; of rows that repeat an id and its text one stays.
    """
    groups, clashes = _groups(docs, text_col, SIMILARITY, WORDS, NEAR_CAP)
    groups = checkpoint(groups)
    rows = docs.select(text_key(docs[text_col], clashes).alias("k"), docs[id_col].alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    # the least id of each text, then of each group
    first = rows.groupBy("k").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id")).alias("m"))
    best = first.join(groups, first["k"] == groups["doc_key"], "left").groupBy(F.coalesce("group", "k").alias("g")).agg(F.min(F.struct("m", "k")).alias("b"))
    kept = best.select(F.col("b.k").alias("kept"), F.col("b.m.id").alias("own"))
    joined = rows.join(kept, (rows["k"] == kept["kept"]) & rows["id"].eqNullSafe(kept["own"]), "left_semi")
    return joined.dropDuplicates(["k"]).select("row.*")
