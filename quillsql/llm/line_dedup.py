"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line goes if an earlier line has the same words, or words within one insertion, deletion or substitution
at a similarity (1 - 1 / words of the longer) of at least the threshold: at 0.8, lines of five words and more.
Earlier is by (doc_id, line number).

1. Equal lines meet by a 128-bit hash; only the first occurrence goes on.
2. Deletion at the grain of half lines: a pair within one edit shares the words before or after the edit,
   hence one half of the shorter one's length. Lines whose halves nobody shares are done.
3. For the rest, every variant with one word deleted from the other half is hashed, once. Lines that differ
   by a substitution share the variant and its place; a line with one word more shares its variant with the
   shorter line itself, cut at that place. Each group is reduced to its first lines, never to its pairs.
4. Every (line, earlier line) so found is verified word by word.

Every grouping is an aggregate of fixed-size values, or an equi-join that adaptive execution can split.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsql.llm.common import cut_lineage, drop_cut, free_prefix

#: Places of a row: an array of Spark holds fewer elements.
PLACES = 1 << 28
HASHES = 1 << 33
#: Words whose hashes are chained in one go, and lines whose variants are hashed in one task.
STRETCH = 256
TASK_LINES = 20_000
BLANKS = r"[ \t\x0B\f\r]+"


def _row(doc: Column, body: Column) -> Column:
    """A row's number, in order of doc_id and a multiple of PLACES; a line's place is this and its number.

    Below the id stand 33 bits of the text's hash, as ids may repeat. Null ids come first, by 64 more bits.
    """
    unknown = F.xxhash64(F.lit("none"), body).cast("decimal(21,0)") - F.lit(Decimal(3 << 63)).cast("decimal(21,0)")
    number = F.coalesce(doc.cast("long").cast("decimal(21,0)"), unknown)
    number = number * F.lit(HASHES).cast("decimal(10,0)") + F.pmod(F.xxhash64(body), F.lit(HASHES)).cast("decimal(10,0)")
    return (number * F.lit(PLACES).cast("decimal(9,0)")).cast("decimal(38,0)")


def _place(row: Column, pos: Column) -> Column:
    return (row + pos.cast("decimal(9,0)")).cast("decimal(38,0)")


def _placed(place: str) -> list[Column]:
    """(_row, pos) of a place."""
    pos = F.pmod(F.col(place), F.lit(PLACES).cast("decimal(9,0)"))
    return [(F.col(place) - pos).cast("decimal(38,0)").alias("_row"), pos.cast("int").alias("pos")]


def _plain(body: Column) -> Column:
    """The text with one space for each run of white space inside its lines."""
    return F.when(body.rlike(r"[\t\x0B\f\r]|  "), F.regexp_replace(body, BLANKS, " ")).otherwise(body)


def _half_keys(line: Column, n: Column) -> Column:
    """Keys of the halves, for a pair whose shorter line has n or n - 1 words."""
    keys = []
    for less in (0, 1):
        length = n - less
        front = F.shiftright(length, 1)
        for side, count in (("front", front), ("rest", front - length)):
            keys.append(F.xxhash64(F.call_function("substring_index", line, F.lit(" "), count), length, F.lit(side)))
    return F.array(*keys)


def _chain(seed: Column, hashes: Column) -> Column:
    """[seed, seed and the first hash, seed and the first two, ...]"""
    return F.aggregate(hashes, F.array(seed), lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), x))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _prefixes(words: Column) -> Column:
    """[hash of no word, of the first word, of the first two, ...], by stretches: a long line isn't copied for each word."""

    def by_stretch(hashes: Column) -> Column:
        last = F.floor((F.size(hashes) - 1) / STRETCH).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(hashes, i * STRETCH + 1, F.lit(STRETCH)))

    def ends(stretches: Column) -> Column:
        return F.transform(stretches, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: F.xxhash64(acc, x)))

    def chained(stretches: Column) -> Column:
        seeds = _let(ends(stretches), lambda e: _chain(F.lit(0).cast("long"), F.slice(e, F.lit(1), F.size(e) - 1)))
        return F.zip_with(seeds, stretches, _chain)

    def joined(chains: Column) -> Column:
        # a stretch's last value is also the next one's seed, under another chain: the seed stands for it
        starts = F.flatten(F.transform(chains, lambda c: F.slice(c, F.lit(1), F.size(c) - 1)))
        return F.concat(starts, F.slice(F.element_at(chains, -1), F.lit(-1), F.lit(1)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return _let(_let(_let(hashes, by_stretch), chained), joined)


def _variants(front: Column, rest: Column, n: Column, half: Column) -> Column:
    """[(key, whole)]: what a line emits for one shared half (0, 1: front, rest of n words; 2, 3: of n - 1).

    front[i] hashes the first i words, rest[i] the last i, so a variant is hashed in constant time from the
    words before and after its gap. Variants of n words serve substitutions; those of n - 1 serve the lines
    that have one word less, which emit themselves once for each place of the gap.
    """
    less = F.when(half >= 2, 1).otherwise(0)
    size = F.shiftright(n - less, 1)
    first = F.when(half % 2 == 0, size).otherwise(0)
    last = F.when(half % 2 == 0, n - 1).otherwise(size + less - 1)
    none = F.array().cast("array<int>")

    def gap(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(front, i), F.get(rest, n - 1 - i), F.when(less == 0, i).otherwise(-1 - i)).alias("key"), F.lit(False).alias("whole"))

    def itself(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(front, i), F.get(rest, n - i), -1 - i).alias("key"), F.lit(True).alias("whole"))

    gaps = F.transform(F.when(first <= last, F.sequence(first, last)).otherwise(none), gap)
    return F.when(less == 0, F.concat(gaps, F.transform(F.sequence(first, last + 1), itself))).otherwise(gaps)


def _shared(a: Column, b: Column) -> Column:
    """How many words two arrays share from the start."""
    run = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, same: F.struct((acc["n"] + (acc["on"] & same).cast("int")).alias("n"), (acc["on"] & same).alias("on")),
    )
    return F.least(run["n"], F.size(a), F.size(b))


def within_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are within one insertion, deletion or substitution."""
    longer = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (_shared(a, b) + _shared(F.reverse(a), F.reverse(b)) >= longer - 1)


def first_lines(docs: DataFrame, least_words: int) -> DataFrame:
    """One row for each distinct line with words: its place and its half keys, if it has least_words or one less."""
    lines = docs.select("_row", F.posexplode(F.split(_plain(F.col("_text")), "\n", -1)).alias("pos", "line"))
    lines = lines.select(_place(F.col("_row"), F.col("pos")).alias("place"), F.trim("line").alias("line")).where("line <> ''")
    counted = lines.withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    keys = F.when(F.col("n") >= least_words - 1, _half_keys(F.col("line"), F.col("n")))
    hashed = counted.select("place", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"), keys.alias("k"))
    hashed = hashed.select("place", "h1", "h2", *(F.get("k", F.lit(i)).alias(f"k{i}") for i in range(4)))
    return hashed.groupBy("h1", "h2").agg(F.min("place").alias("place"), *(F.min(f"k{i}").alias(f"k{i}") for i in range(4))).drop("h1", "h2")


def near_copies(docs: DataFrame, firsts: DataFrame, least_words: int) -> DataFrame:
    """The places of first lines that have an earlier line within one edit, the longer one of least_words."""
    spark = docs.sparkSession
    keyed = firsts.where("k0 IS NOT NULL").select("place", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("half", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    wanted = keyed.join(shared, "key").select(*_placed("place"), "half")
    by_row = wanted.groupBy("_row").agg(F.collect_list(F.struct("pos", "half")).alias("want"))
    # a repeated row has the same lines at the same places: one row is made of them
    found = docs.join(by_row, "_row").select("_row", F.split(_plain(F.col("_text")), "\n", -1).alias("lines"), F.explode("want").alias("x"))
    lines = found.select(_place(F.col("_row"), F.col("x.pos")).alias("place"), "x.half", F.trim(F.get("lines", F.col("x.pos"))).alias("line"))
    lines = cut_lineage(lines.groupBy("place", "line").agg(F.collect_set("half").alias("halves")))
    tasks = max(2 * spark.sparkContext.defaultParallelism, lines.count() // TASK_LINES + 1)
    words = F.split("line", " ", -1)
    chained = lines.repartition(tasks, "place").select("place", "halves", _prefixes(words).alias("front"), _prefixes(F.reverse(words)).alias("rest"))
    chained = chained.withColumn("n", F.size("front") - 1)
    each = chained.select("place", "front", "rest", "n", F.explode("halves").alias("half"))
    emitted = each.select("place", F.explode(_variants(F.col("front"), F.col("rest"), F.col("n"), F.col("half"))).alias("v")).select("place", "v.*")
    emitted = cut_lineage(emitted)
    groups = (
        emitted.groupBy("key")
        .agg(F.min("place").alias("least"), F.max("place").alias("most"), F.min(F.when(F.col("whole"), F.col("place"))).alias("itself"))
        .where("least < most")
    )
    met = emitted.join(groups, "key")
    # in a group of one substitution the first line serves all; else the shorter line serves the longer ones, and their first serves it
    earlier = F.when(F.col("itself").isNull() | F.col("whole"), F.col("least")).otherwise(F.col("itself"))
    pairs = met.select("place", earlier.alias("earlier")).where("earlier < place").distinct()
    one = lines.select("place", F.split("line", " ", -1).alias("w"))
    sides = pairs.join(one, "place").join(one.select(F.col("place").alias("earlier"), F.col("w").alias("v")), "earlier")
    near = within_one_edit(F.col("w"), F.col("v")) & (F.greatest(F.size("w"), F.size("v")) >= least_words)
    gone = cut_lineage(sides.where(near).select("place").distinct())
    drop_cut(emitted)
    drop_cut(lines)
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """docs with text_col cut to its kept lines, and n_lines, n_kept_lines (replacing columns of those names).

    Lines end at a line feed. Lines without words always stay. A null text counts as one empty line and
    becomes ''. A null doc_id counts as the smallest id; rows of one id with different texts go by a hash of
    the text (two of k such texts share their places by a chance of k * k / 2^34; null ids have 97 bits).
    Rows that repeat a doc_id and a text keep the same lines. An empty table stays empty.
    """
    docs = docs.drop("n_lines", "n_kept_lines")
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = _row(F.col(id_col), body)
    texts = docs.select(row.alias("_row"), body.alias("_text"))
    least_words = math.ceil(1 / (1 - similarity) - 1e-9)
    firsts = cut_lineage(first_lines(texts, least_words))
    gone = near_copies(texts, firsts, least_words)
    stay = firsts.select("place").join(gone, "place", "left_anti").select(*_placed("place"))
    p = free_prefix(docs)
    all_, kept_ = f"{p}lines", f"{p}kept"
    by_row = stay.groupBy(F.col("_row").alias(f"{p}row")).agg(F.collect_list("pos").alias(f"{p}stay"))
    joined = docs.withColumn(f"{p}row", row).join(by_row, f"{p}row", "left").withColumn(all_, F.split(body, "\n", -1))
    stays = F.coalesce(f"{p}stay", F.array().cast("array<int>"))
    blank = F.filter(F.transform(all_, lambda x, i: F.when(~x.rlike(r"[^ \t\x0B\f\r]"), i)), lambda i: i.isNotNull())
    # null: all lines stay
    kept = joined.withColumn(kept_, F.when(F.size(stays) < F.size(all_), F.array_sort(F.concat(stays, blank))))
    cut = F.when(F.col(kept_).isNull(), body).otherwise(F.array_join(F.transform(kept_, lambda i: F.get(all_, i)), "\n"))
    return kept.select(
        *(cut.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
        F.size(all_).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col(kept_)), F.size(all_)).cast("long").alias("n_kept_lines"),
    )
