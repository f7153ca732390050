"""Quality rules: counts of a document's surface, and a log-likelihood ratio of hashed n-grams.

Two multinomials over hashed n-grams are compared: one of the trusted target, taken from documents labelled good,
one of the raw corpus, counted over all documents. The n-grams are words, and pairs of neighbouring word shapes (a
word with its letters and digits folded) with whether the two words are equal. A document's ratio, averaged over its
n-grams, is held against one threshold; nothing is drawn at random. Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import BLANKS, prepare, stored

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Settings:
    """`buckets` per kind of n-gram.

    A document fails the rules with fewer than `words` words, or with more than `repeated` percent of its words in
    windows of `window` words that it holds twice. The threshold lies `margin` of the way from the score that all but
    `lost` of the good documents reach to the mean of the bad ones. A bitmap of `bits` bits (4 MB) keeps documents that
    cannot be labelled good from moving.
    """

    buckets: int = 4096
    words: int = 10
    window: int = 5
    repeated: int = 20
    smoothing: float = 1.0
    lost: float = 0.005
    margin: float = 0.1
    bits: int = 1 << 25


def split(text: Column) -> Column:
    """Words: the trimmed text cut at blanks, none of an empty one."""
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+", -1))


def shaped(text: Column) -> Column:
    """Letters folded to one letter a run, digits to one digit; blanks stay."""
    return F.regexp_replace(F.regexp_replace(text, r"\p{L}+", "a"), r"\p{N}+", "0")


def with_words(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep and every row's words (w) and their shapes (v)."""
    return docs.select(*keep, split(F.col("text")).alias("w"), split(shaped(F.col("text"))).alias("v"))


def grams(rows: DataFrame, s: Settings, *keep: str) -> DataFrame:
    """A row per word (none for a text without words, then one of nulls): the buckets of the word and of the pair of
    shapes it begins, with whether the two words are equal; the last word begins none.
    """
    behind = lambda c: F.slice(c, 2, F.greatest(F.size(c), F.lit(1)))
    pairs = F.arrays_zip(F.col("w").alias("a"), behind("w").alias("b"), F.col("v").alias("c"), behind("v").alias("d"))
    each = rows.select(*keep, F.explode_outer(pairs).alias("x")).select(*keep, "x.a", "x.b", "x.c", "x.d")
    pair = F.pmod(F.xxhash64("c", "d", F.col("a") == F.col("b")), F.lit(s.buckets)) + s.buckets
    return each.select(
        *keep,
        F.when(F.col("a").isNotNull(), F.pmod(F.xxhash64("a"), F.lit(s.buckets)).cast("int")).alias("word"),
        F.when(F.col("b").isNotNull(), pair.cast("int")).alias("pair"),
    )


def places(column: Column, behind: int) -> Column:
    """Places 0, 1, ... of an array, up to `behind` before its end; none if it is shorter."""
    n = F.size(column) - behind
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def counts(rows: DataFrame, s: Settings) -> DataFrame:
    """(bucket, n) over all n-grams of the rows; counted on the map side before it moves."""
    each = grams(rows, s).select(F.explode(F.array("word", "pair")).alias("bucket"))
    return each.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


#: Weights are whole millionths, so that their sums do not depend on an order; scores are compared in thousandths.
UNIT, STEP = 1_000_000, 1000


def ratios(target: dict[int, int], raw: dict[int, int], s: Settings) -> list[int]:
    """Log ratio of each bucket's smoothed probabilities in millionths, for each kind of n-gram; zeros without a target."""
    out = []
    for kind in range(2):
        own = range(kind * s.buckets, (kind + 1) * s.buckets)
        a, b = sum(target.get(i, 0) for i in own), sum(raw.get(i, 0) for i in own)
        for i in own:
            p = (target.get(i, 0) + s.smoothing) / (a + s.smoothing * s.buckets)
            q = (raw.get(i, 0) + s.smoothing) / (b + s.smoothing * s.buckets)
            out.append(round(math.log(p / q) * UNIT) if a else 0)
    return out


def constant(numbers: list[int]) -> Column:
    """An array of numbers as one constant of the plan; their number is bounded by the settings."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def scored(rows: DataFrame, weights: list[int], s: Settings, *keep: str) -> DataFrame:
    """The columns to keep and each row's mean log ratio over its n-grams, in whole thousandths; zero without words.

    Rows are told apart by a number of their own, so repeated rows stay. A row's words stand together in one task,
    where they are summed before one number per row moves.
    """
    table = constant(weights)
    each = grams(rows.withColumn("row", F.monotonically_increasing_id()), s, "row", *keep)
    both = F.coalesce(table[F.col("word")], F.lit(0)) + F.coalesce(table[F.col("pair")], F.lit(0))
    grouped = each.select("row", *keep, both.alias("x"), F.col("word").isNotNull().alias("is_word")).groupBy("row", *keep)
    made = grouped.agg(F.sum("x").alias("total"), F.count_if("is_word").alias("n"))
    grams_n = F.greatest(2 * F.col("n") - 1, F.lit(1)) * F.lit(UNIT // STEP)
    mean = (F.col("total") - F.pmod(F.col("total"), grams_n)) / grams_n
    return made.select(*keep, mean.cast("bigint").alias("points"))


@dataclass(frozen=True)
class Model:
    weights: list[int]
    threshold: float


def marks(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), one row per labelled document."""
    return labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def likely_among(rows: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """Rows whose doc_id is among the ids (a frame of one column), and few others; none of them moves.

    A bitmap over hashes, in pieces of 4 KB by bucket: with `bits` bits it has one size whatever the number of ids, so
    it may be broadcast. With very many ids it tells fewer apart.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    own = ids.select(F.bitmap_bucket_number(bit(ids.columns[0])).alias("at"), F.bitmap_bit_position(bit(ids.columns[0])).alias("bit"))
    # Ids move once, as two numbers, before any piece is made.
    pieces = own.repartition("at").groupBy("at").agg(F.bitmap_construct_agg("bit").alias("bits"))
    place = F.bitmap_bit_position(bit("doc_id"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    found = (F.bitmap_bucket_number(bit("doc_id")) == F.col("at")) & (F.getbit(byte, (place % 8).cast("int")) == 1)
    return rows.join(F.broadcast(pieces), found, "left_semi")


def learned(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> list[int]:
    """Weights of the buckets: the target is every document labelled good, the raw corpus every document.

    Only documents that the bitmap of good ids lets through move; the join behind it decides.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    good = marks(labels).where("quality = 1").select("doc_id")
    chosen = likely_among(texts, good, s.bits).join(good.hint("merge"), "doc_id")
    raw = {r.bucket: r.n for r in counts(with_words(texts), s).collect()}
    target = {r.bucket: r.n for r in counts(with_words(chosen), s).collect()}
    return ratios(target, raw, s)


def threshold(scores: DataFrame, labels: DataFrame, s: Settings = Settings()) -> float:
    """The points to reach, from the scores (doc_id, points) of every labelled document; no text moves.

    Whole points are counted, so the counts that reach the driver are as many as there are different points, a few
    thousand, and no order of summing shows. Where the bad documents do not score lower than the good ones, it is the
    good ones' own. Without good labels nothing is told apart and it keeps all.
    """
    marked = scores.select("doc_id", "points").join(marks(labels), "doc_id")
    found: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in marked.groupBy("quality", "points").agg(F.count("*").alias("n")).collect():
        found[r.quality][r.points] = r.n
    if not found[1]:
        return float("-inf")
    left = math.floor(sum(found[1].values()) * s.lost)
    for reached in sorted(found[1]):
        left -= found[1][reached]
        if left < 0:
            break
    n_bad = sum(found[0].values())
    bad = sum(p * n for p, n in found[0].items()) / n_bad if n_bad else reached
    return reached - s.margin * max(0.0, reached - bad)


def repeated_words(s: Settings) -> Column:
    """Words in windows that a row of `with_words` holds at least twice.

    Window hashes are sorted with their places only where some hash repeats.
    """
    k = s.window
    windows = F.transform(places(F.col("w"), k - 1), lambda i: F.xxhash64(*[F.col("w")[i + j] for j in range(k)]))

    def covered(w: Column) -> Column:
        by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def twice(a: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(a, i)["x"] == F.get(a, j)["x"], F.lit(False))
            return F.filter(a, lambda x, i: same(i, i - 1) | same(i, i + 1))

        at = F.sort_array(F.transform(F.element_at(F.transform(F.array(by_hash), twice), 1), lambda x: x["i"]))
        gaps = lambda p: F.aggregate(
            places(p, 1), F.lit(k), lambda t, i: t + F.least(F.lit(k), F.get(p, i + 1) - F.get(p, i))
        )
        return F.element_at(F.transform(F.array(at), gaps), 1)

    found = F.transform(F.array(windows), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(0))
    return F.element_at(found, 1).cast("bigint")


def measured(docs: DataFrame, weights: list[int], s: Settings = Settings()) -> DataFrame:
    """One row per document: its counts, whether it fails the rules, and its points. A null text is an empty one."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", text.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    surface = [
        F.length(F.translate("text", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda a: F.size(a) - F.size(F.array_distinct(a))), 1).cast("bigint").alias("n_dup_lines"),
    ]
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = with_words(texts.select("doc_id", "text", *surface), "doc_id", *base[2:5])
    rows = rows.select(*base[:1], F.size("w").cast("bigint").alias("n_words"), *base[2:5], repeated_words(s).alias("n_repeat_words"), "w", "v")
    counted = scored(rows, weights, s, *base)
    failed = (F.col("n_words") < s.words) | (100 * F.col("n_repeat_words") > s.repeated * F.col("n_words"))
    return counted.select(*base, failed.alias("base_failed"), "points")


def judged(found: DataFrame, least: float) -> DataFrame:
    """The rows of `measured` with whether the document is kept."""
    kept = ~F.col("base_failed") & (F.col("points") >= F.lit(least))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "points")


def assess(docs: DataFrame, model: Model, s: Settings = Settings()) -> DataFrame:
    """One row per document: its counts, whether it fails the rules, its ratio, and whether it is kept.

    A null text has no words, so it fails. Every row is judged by itself, whatever its doc_id.
    """
    return judged(measured(docs, model.weights, s), model.threshold)


def report(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Learn the weights, measure every document once, set the threshold by the labelled ones and judge all."""
    prepare(docs.sparkSession)
    found = stored(measured(docs, learned(docs, labels, s), s))
    return judged(found, threshold(found, labels, s))
