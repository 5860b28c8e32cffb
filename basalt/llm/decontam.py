"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Numbers, capitalised names and units become typed placeholders, so that a question with other
parameters has the same template. Windows of ``WIDTH`` template tokens are hashed and joined; the
matches of a document and an item on one alignment are kept if their slots are consistent (each
value of the item stands for one value in the document), and a document is contaminated by an item
if ``COVERAGE`` percent or more of the item's windows match.

The tokens are runs of letters and digits. Capitalised words count as names wherever they stand, so
a passage looks the same whatever stands before it. Windows need ``LITERALS`` tokens that are no
placeholder.

A passage in another case (capitals, a heading, all lower case) has other names and literals, so there
is a second set of windows over case-folded tokens, with numbers and units as the only placeholders.
Pairs that the name template covers are given with its counts; the others are covered by the places
that either set matches, out of the places that have a window in either. Only the name template is in
``SQL``, which therefore gives the first kind of rows and not the second.

The benchmark's windows are broadcast if they are ``BROADCAST_ROWS`` or fewer (counted), and joined
by a shuffle otherwise; so are the matched ids when their texts are read again.

An item of fewer than ``WIDTH`` tokens is one window of its own length, if it has ``LITERALS`` literals:
documents get windows of the lengths that such items have (at most ``WIDTH`` - 1 more), nothing else changes.

Defined cases: null and empty texts match nothing, nor do items of fewer than ``LITERALS`` literals; rows that repeat a document id are one document; repeated items each
match; a null id is an id like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import checkpoint

WIDTH = 8
LITERALS = 3
COVERAGE = 50
BROADCAST_ROWS = 1_000_000

#: Placeholders, which are letters or digits themselves, and units.
NAME, NUMBER, UNIT = "ｎ", "0", "ｕ"
UNITS = "km|cm|mm|m|miles|mile|feet|foot|ft|inches|inch|yards|yard|kg|g|mg|grams|gram|pounds|pound|lbs|lb|ounces|ounce|oz|tons|ton|l|ml|liters|liter|litres|litre|gallons|gallon|hours|hour|h|minutes|minute|min|seconds|second|sec|s|ms|days|day|weeks|week|months|month|years|year|dollars|dollar|euros|euro|cents|cent|percent|degrees|degree|mph|kmh|watts|watt|volts|volt|hz|kb|mb|gb|tb"
_SEPARATOR = r"[^\p{L}\p{N}]+"


def normal(text: Column) -> Column:
    """Decimal and thousands separators inside numbers go, so that a number is one token."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(\d)[.,](\d)", "$1$2")


def template(normalised: Column) -> Column:
    """Names, numbers and the units after numbers as placeholders; no token appears or goes."""
    t = F.regexp_replace(normalised, r"\p{Lu}\p{L}*", NAME)
    t = F.regexp_replace(t, r"\d+", NUMBER)
    return F.regexp_replace(t, rf"(0 ?)({UNITS})([^\p{{L}}\p{{N}}]|$)", f"$1{UNIT}$3")


def fold(normalised: Column) -> Column:
    """Text without case; no token appears or goes (lower case of a dotted capital I is two characters)."""
    lower = F.lower(F.replace(normalised, F.lit("İ"), F.lit("i")))
    return F.replace(F.replace(lower, F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def folded_template(folded: Column) -> Column:
    """Numbers and the units after them as placeholders."""
    return F.regexp_replace(F.regexp_replace(folded, r"\d+", NUMBER), rf"(0 ?)({UNITS})([^\p{{L}}\p{{N}}]|$)", f"$1{UNIT}$3")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, _SEPARATOR), lambda x: x != "")


def views(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, raw, named, plain, folded): tokens as they stand, of the name template, without case, and of the folded template."""
    plain = df.select(*keep, "s", fold(F.col("s")).alias("l"))
    return plain.select(*keep, *[tokens(c).alias(n) for c, n in ((F.col("s"), "raw"), (template(F.col("s")), "named"), (F.col("l"), "plain"), (folded_template(F.col("l")), "folded"))])


def windows(df: DataFrame, *keep: str, widths: Sequence[int] = (WIDTH,)) -> DataFrame:
    """(keep, at, width, kind, h): hashes of every window of each of ``widths`` tokens and its place from 0.

    kind is 0 for the name template, 1 for the folded one and 2 where both are the same. Every token is hashed
    once, and a window is the hash of the hashes of its tokens.
    """
    hashed = [F.transform(F.col(c), lambda x: F.xxhash64(x)).alias("h_" + c) for c in ("named", "folded")]
    n, least = F.size("h_named"), min(widths)
    df = df.select(*keep, *hashed)
    df = df.select(*keep, "h_named", "h_folded", F.explode(F.when(n >= least, F.sequence(F.lit(0), n - least))).alias("at"))
    df = df.select("*", F.explode(F.array(*[F.lit(w) for w in widths])).alias("width")).where(F.col("at") + F.col("width") <= n)
    a, b = (F.xxhash64(F.slice(F.col("h_" + c), F.col("at") + 1, F.col("width"))) for c in ("named", "folded"))
    df = df.select(*keep, "at", "width", a.alias("a"), b.alias("b"))

    def one(kind, h):
        return F.struct(F.lit(kind).alias("kind"), F.col(h).alias("h"))

    each = F.when(F.col("a") == F.col("b"), F.array(one(2, "a"))).otherwise(F.array(one(0, "a"), one(1, "b")))
    return df.select(*keep, "at", "width", F.inline(each))


def sized(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if its counted rows are few."""
    return F.broadcast(df) if rows <= limit else df


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, coverage: int = COVERAGE) -> DataFrame:
    """(doc_id, item_id, n_windows, matched_windows, verbatim) of every contaminated document and item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), normal(F.col("text")).alias("s"))
    items = views(items, "item_id").withColumn("own", F.least(F.lit(width), F.size("named"))).where(F.col("own") >= min(width, LITERALS))
    items = checkpoint(items.withColumn("item", F.monotonically_increasing_id()))
    widths = sorted(r[0] for r in items.select("own").distinct().collect()) or [width]  # at most ``width`` numbers

    def literals(words):
        return F.size(F.filter(F.slice(words, F.col("at") + 1, F.col("own")), lambda x: (x != NAME) & (x != NUMBER) & ~x.contains(UNIT)))

    wanted = windows(items, "item", "named", "folded", "own", widths=widths).where("width = own").where(F.when(F.col("kind") == 1, literals("folded")).otherwise(literals("named")) >= LITERALS)
    wanted = wanted.select("item", F.col("at").alias("j"), F.explode(F.when(F.col("kind") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array("kind"))).alias("kind"), "h")
    wanted = checkpoint(wanted)
    n_wanted = wanted.count()

    split = docs.select(docs[id_col].cast("long").alias("id"), normal(docs[text_col]).alias("s"))
    seen = windows(views(split, "id"), "id", widths=widths).withColumnRenamed("kind", "of")
    hits = seen.join(sized(wanted, n_wanted), "h").where((F.col("of") == 2) | (F.col("of") == F.col("kind")))
    hits = checkpoint(hits.select("id", "item", "kind", "j", (F.col("at") - F.col("j")).alias("shift")).distinct())

    aligned = hits.groupBy("id", "item", "kind", "shift").agg(F.collect_set("j").alias("js"))  # at most an item's windows
    hit_ids = checkpoint(hits.select("id").distinct())
    same = F.col("id").eqNullSafe(F.col("hit"))
    again = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    again = again.join(sized(hit_ids.withColumnRenamed("id", "hit"), hit_ids.count()), same, "left_semi")
    again = views(again.select("id", normal(F.col("text")).alias("s")), "id")
    again = again.select("id", *[F.col(c).alias("d_" + c) for c in ("raw", "named", "plain", "folded")])

    al = aligned.withColumnRenamed("id", "hit")
    pairs = again.join(al, same).join(items, "item")
    named = F.col("kind") == 0
    for short, of_name, of_fold in (("it", "named", "folded"), ("ir", "raw", "plain"), ("dt", "d_named", "d_folded"), ("dr", "d_raw", "d_plain")):
        pairs = pairs.withColumn(short, F.when(named, F.col(of_name)).otherwise(F.col(of_fold)))
    places = F.array_distinct(F.flatten(F.transform("js", lambda j: F.sequence(j + 1, j + F.col("own")))))
    # rows that repeat an id may hold another text: its tokens must have the item's template
    fits = F.forall("p", lambda q: F.try_element_at("dt", q + F.col("shift")).eqNullSafe(F.element_at("it", q)))
    found = pairs.withColumn("p", places).where(fits)
    slot_places = F.filter("p", lambda q: F.element_at("it", q) != F.element_at("ir", q))
    both = F.array_distinct(F.transform(slot_places, lambda q: F.struct(F.element_at("ir", q).alias("a"), F.element_at("dr", q + F.col("shift")).alias("b"))))
    found = found.withColumn("slots", both)
    consistent = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda x: x["a"])))
    as_it_stands = F.forall("p", lambda q: F.element_at("raw", q) == F.element_at("d_raw", q + F.col("shift")))
    found = found.where(consistent).withColumn("verbatim", as_it_stands)
    best = found.select("id", "item", "item_id", "kind", F.explode("js").alias("j"), "verbatim")
    of_name = F.col("kind") == 0
    total = wanted.groupBy("item").agg(F.countDistinct(F.when(of_name, F.col("j"))).alias("n_named"), F.countDistinct("j").alias("n_all"))
    per = best.groupBy("id", "item", "item_id").agg(
        F.countDistinct(F.when(of_name, F.col("j"))).alias("named"), F.countDistinct("j").alias("all"),
        F.max(F.when(of_name, F.col("verbatim"))).alias("named_verbatim"), F.coalesce(F.max(F.when(~of_name, F.col("verbatim"))), F.lit(False)).alias("all_verbatim"),
    )
    per = per.join(total, "item")
    by_name = (F.col("named") > 0) & (100 * F.col("named") >= coverage * F.col("n_named"))
    per = per.withColumn("by_name", by_name).where(F.col("by_name") | (100 * F.col("all") >= coverage * F.col("n_all")))
    chosen = [F.when(F.col("by_name"), F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("n_named", "n_all", "n_windows"), ("named", "all", "matched_windows"), ("named_verbatim", "all_verbatim", "verbatim"))]
    return per.select(F.col("id").alias("doc_id"), "item_id", *chosen)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose id is not contaminated."""
    bad = checkpoint(contamination(docs, benchmark, id_col, text_col).select(F.col("doc_id").alias("bad")).distinct())
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return rows.join(sized(bad, bad.count()), F.col("id").eqNullSafe(F.col("bad")), "left_anti").select("row.*")


SQL = rf"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '(\d)[.,](\d)', '\1\2', 'g') AS s FROM documents),
b AS (SELECT item_id, regexp_replace(coalesce(text, ''), '(\d)[.,](\d)', '\1\2', 'g') AS s FROM benchmark),
al AS (SELECT 0 AS kind, doc_id AS id, s FROM n UNION ALL SELECT 1, item_id, s FROM b),
tt AS (SELECT kind, id, s, regexp_replace(regexp_replace(regexp_replace(s, '\p{{Lu}}\p{{L}}*', '{NAME}', 'g'), '\d+', '{NUMBER}', 'g'), '(0 ?)({UNITS})([^\p{{L}}\p{{N}}]|$)', '\1{UNIT}\3', 'g') AS c FROM al),
tk AS (SELECT kind, id, list_filter(regexp_split_to_array(s, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS raw, list_filter(regexp_split_to_array(c, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS tpl FROM tt),
w AS (SELECT kind, id, raw, tpl, unnest(range(0, len(tpl) - {WIDTH - 1})) AS place FROM tk WHERE len(tpl) >= {WIDTH}),
wd AS (SELECT id AS doc_id, place, tpl[place + 1 : place + {WIDTH}] AS g FROM w WHERE kind = 0),
wb AS (SELECT id AS item_id, place AS j, tpl[place + 1 : place + {WIDTH}] AS g FROM w WHERE kind = 1
  AND len(list_filter(tpl[place + 1 : place + {WIDTH}], lambda x: x <> '{NAME}' AND x <> '{NUMBER}' AND NOT contains(x, '{UNIT}'))) >= {LITERALS}),
hit AS (SELECT DISTINCT doc_id, item_id, j, place - j AS shift FROM wd JOIN wb USING (g)),
pos AS (SELECT DISTINCT doc_id, item_id, shift, j + k AS q FROM hit, range(1, {WIDTH + 1}) r(k)),
val AS (SELECT p.doc_id, p.item_id, p.shift, bt.raw[p.q] AS a, dt.raw[p.q + p.shift] AS d FROM pos p
  JOIN tk bt ON bt.kind = 1 AND bt.id = p.item_id JOIN tk dt ON dt.kind = 0 AND dt.id = p.doc_id WHERE bt.raw[p.q] <> bt.tpl[p.q]),
bad AS (SELECT DISTINCT doc_id, item_id, shift FROM val GROUP BY doc_id, item_id, shift, a HAVING count(DISTINCT d) > 1),
moved AS (SELECT DISTINCT doc_id, item_id, shift FROM val WHERE a <> d),
ok AS (SELECT h.*, m.shift IS NULL AS same FROM hit h LEFT JOIN moved m ON m.doc_id = h.doc_id AND m.item_id = h.item_id AND m.shift = h.shift
  WHERE NOT EXISTS (SELECT 1 FROM bad x WHERE x.doc_id = h.doc_id AND x.item_id = h.item_id AND x.shift = h.shift)),
total AS (SELECT item_id, count(*) AS n_windows FROM wb GROUP BY item_id)
SELECT doc_id, item_id, n_windows, count(DISTINCT j) AS matched_windows, bool_or(same) AS verbatim
FROM ok JOIN total USING (item_id) GROUP BY doc_id, item_id, n_windows HAVING 100 * count(DISTINCT j) >= {COVERAGE} * n_windows"""


def op_query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark)
