"""Toxic documents by a convolutional text classifier.

Words enter as the sum of hashed vectors of the word and of its beginnings, so that inflected forms of one stem
share weight. Filters of several widths run over the whole text, each keeps its greatest response, and a linear
layer turns these into a score. Every labelled row trains it: Spark tasks learn in numpy on shards of rows and Spark
averages their weights after each epoch; scoring runs in Spark tasks over every document. Thresholds are calibrated
for each language on rows the training left out.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import map_batches, prepare, stored
from costurero.llm.quality import likely_among

LETTERS = re.compile(r"[^\W\d_]+")
#: Weights are averaged as whole parts of this.
UNIT = 1 << 20
RESULT = "doc_id bigint, held_out boolean, score double, predicted int, lang_threshold double, rejected boolean"


@dataclass(frozen=True)
class Settings:
    """Bounds and sizes of the classifier.

    Every row is learned from in `epochs` passes, in up to `most` where these are not `steps` texts in all. `shard` is
    the number of labelled rows that one task learns from in an epoch, `bits` the size of the bitmap that keeps
    documents without a label from moving. `cut` is the score from which a text is toxic.
    """

    buckets: int = 1 << 15
    beginnings: tuple[int, ...] = (4, 5, 6)
    size: int = 16
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 8
    shard: int = 4096
    bits: int = 1 << 25
    epochs: int = 4
    most: int = 8
    steps: int = 16_000
    rate: float = 0.1
    cut: float = 0.7
    alarm: float = 5.0
    chunk: int = 50_000
    cached: int = 300_000


@dataclass
class Network:
    """Weights; `thresholds` has a cut for each language that had enough rows to calibrate one."""

    settings: Settings
    vectors: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)


def features(words: list[str], settings: Settings) -> np.ndarray:
    """Buckets of each word: one for the word, one for each of its beginnings, each under a seed of its own."""
    hashed = xxhash.xxh32_intdigest
    columns = [[hashed(w, 0) for w in words]]
    columns += [[hashed(w[:n], n) for w in words] for n in settings.beginnings]
    return np.array(columns, np.int64).T % settings.buckets


def kind_of(settings: Settings) -> np.dtype:
    """How a bucket's number is stored."""
    return np.dtype("<u2" if settings.buckets <= 1 << 16 else "<u4")


def blank(settings: Settings, bias: float = 0.0) -> Network:
    """A network before training: silent on every word."""
    rng = np.random.default_rng(11)
    scale = 1 / np.sqrt(settings.size)
    return Network(
        settings,
        np.zeros((settings.buckets, settings.size), np.float32),
        [rng.normal(0, scale, (w, settings.size, settings.filters)).astype(np.float32) for w in settings.widths],
        np.zeros(len(settings.widths) * settings.filters, np.float32),
        np.abs(rng.normal(0, 0.5, len(settings.widths) * settings.filters)).astype(np.float32),
        bias,
    )


def squash(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


class Learner:
    """One pass over a shard's rows, from common weights, by stochastic gradient steps, one text at a time.

    A text, an array (words, features) of buckets, is read in pieces, of which only what each filter answered most
    strongly is held.
    """

    def __init__(self, net: Network, spread: dict[str, np.ndarray]):
        self.settings = net.settings
        self.vectors, self.filters = net.vectors.copy(), [k.copy() for k in net.filters]
        self.shift, self.out, self.bias = net.shift.copy(), net.out.copy(), net.bias
        self.spread = {k: v.copy() for k, v in spread.items()}
        self.touched = np.zeros(len(self.vectors), np.int64)
        self.rows = 0

    def strongest(self, text: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each width the filters' greatest responses, and the buckets (tap, filter, bucket) they came from."""
        s = self.settings
        tops = [np.full(s.filters, -np.inf, np.float32) for _ in s.widths]
        taps = [np.zeros((w, s.filters, text.shape[1]), np.int64) for w in s.widths]
        for start in range(0, len(text), s.chunk):
            ids = text[start : start + s.chunk + max(s.widths) - 1]
            x = self.vectors[ids].sum(1)
            for k, (w, kernel) in enumerate(zip(s.widths, self.filters)):
                n = len(x) - w + 1
                if n <= 0:
                    continue
                seen = sum(x[i : i + n] @ kernel[i] for i in range(w))
                best = seen.argmax(0)
                value = seen[best, np.arange(s.filters)]
                better = value > tops[k]
                tops[k][better] = value[better]
                for i in range(w):
                    taps[k][i][better] = ids[best[better] + i]
        return tops, taps

    def learn(self, text: np.ndarray, y: int) -> None:
        s = self.settings
        tops, taps = self.strongest(text)
        top = np.concatenate(tops)
        there = np.isfinite(top)
        z = np.where(there, top + self.shift, 0.0)
        pooled = np.maximum(z, 0.0)
        error = squash(pooled @ self.out + self.bias) - y
        self.rows += 1
        if abs(error) < 1e-3:
            return
        # A silent filter still learns: the slope below zero is small, not nothing.
        back = np.where(there, error * self.out * np.where(z > -1e-6, 1.0, 0.1), 0.0)
        grad_out = error * pooled
        self.spread["o"] += grad_out**2
        self.out -= s.rate * grad_out / np.sqrt(self.spread["o"])
        self.bias -= s.rate * 0.1 * error
        self.shift -= s.rate * 0.05 * back
        steps, into = [], []
        for k, (w, kernel) in enumerate(zip(s.widths, self.filters)):
            own = back[k * s.filters : (k + 1) * s.filters]
            if not own.any():
                continue
            for i in range(w):
                steps.append(own[:, None] * kernel[i].T)
                into.append(taps[k][i])
                kernel[i] -= s.rate * 0.05 * (self.vectors[taps[k][i]].sum(1) * own[:, None]).T
        if steps:
            step, bucket = np.concatenate(steps), np.concatenate(into)
            # One sum a bucket: a bucket may be met by several filters, taps and features.
            order = np.argsort(bucket, axis=None, kind="stable")
            met, row = bucket.ravel()[order], order // bucket.shape[1]
            starts = np.flatnonzero(np.r_[True, met[1:] != met[:-1]])
            at = met[starts]
            self.spread["v"][at] += np.add.reduceat((step * step).sum(1)[row], starts)
            self.vectors[at] -= s.rate * np.add.reduceat(step[row], starts) / np.sqrt(self.spread["v"][at])[:, None]
            self.touched[at] += np.diff(starts, append=len(met))

    def dense(self) -> np.ndarray:
        """All weights but the words'."""
        return np.concatenate([*[k.ravel() for k in self.filters], self.shift, self.out, self.spread["o"], [self.bias]])

    def state(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, their weight in the mean, and weight times value, in whole millionths.

        A bucket that was touched is a slot, its weight the touches; behind the buckets all other weights follow in
        slots, weighted by the rows of the shard.
        """
        wide = self.settings.size + 1
        hit = np.flatnonzero(self.touched)
        dense = self.dense()
        dense = np.pad(dense, (0, -len(dense) % wide)).reshape(-1, wide)
        values = np.concatenate([np.column_stack([self.vectors[hit], self.spread["v"][hit]]), dense])
        n = np.concatenate([self.touched[hit], np.full(len(dense), self.rows, np.int64)])
        slots = np.concatenate([hit, len(self.vectors) + np.arange(len(dense))])
        return slots, n, np.rint(values.astype(np.float64) * UNIT).astype(np.int64) * n[:, None]


def merge(net: Network, spread: dict[str, np.ndarray], slots: np.ndarray, n: np.ndarray, sums: np.ndarray) -> Network:
    """The network, and its step sizes in place, with the shards' weighted means in the slots that any of them gives."""
    s = net.settings
    means = (sums / n[:, None] / UNIT).astype(np.float32)
    words = slots < s.buckets
    vectors = net.vectors.copy()
    vectors[slots[words]] = means[words, : s.size]
    spread["v"][slots[words]] = means[words, s.size]
    flat = means[~words][np.argsort(slots[~words])].ravel()
    filters, at = [], 0
    for kernel in net.filters:
        filters.append(flat[at : at + kernel.size].reshape(kernel.shape))
        at += kernel.size
    shift, out, spread["o"] = (flat[at + i * len(net.out) : at + (i + 1) * len(net.out)] for i in range(3))
    return Network(s, vectors, filters, shift, out, float(flat[at + 3 * len(net.out)]))


def hashed(rows: DataFrame, settings: Settings) -> DataFrame:
    """The rows with `ids`, the buckets of a text's words, in place of the texts that train; the others keep theirs."""
    kind = kind_of(settings)

    def make():
        def run(cols):
            ids = [
                None if apart else features(LETTERS.findall(text.lower()), settings).astype(kind).tobytes()
                for text, apart in zip(cols["text"], cols["_apart"])
            ]
            texts = [text if apart else None for text, apart in zip(cols["text"], cols["_apart"])]
            return {"doc_id": cols["doc_id"], "text": texts, "ids": ids} | {c: cols[c] for c in ("lang", "_toxic", "_apart")}

        return run

    return map_batches(rows, "doc_id bigint, text string, ids binary, lang string, _toxic int, _apart boolean", make)


def train(rows: DataFrame, count: int, settings: Settings) -> Network:
    """Fit to every row (doc_id, ids, _toxic): each epoch learns in shards, whose weights are averaged by Spark.

    Rows are dealt to shards by a hash and read in the order of another, new in each epoch; the shards' number grows
    with the rows. The sums are of whole numbers, so the result depends on no order or partition. What the driver gets
    has the size of the network.
    """
    net = blank(settings)
    spread = {"v": np.full(settings.buckets, 1e-3, np.float32), "o": np.full(len(net.out), 1e-3, np.float32)}
    shards = min(-(-count // settings.shard), 32_000)
    names = [f"v{i}" for i in range(settings.size + 1)]
    schema = ", ".join(["slot bigint", "n bigint", *[f"{v} bigint" for v in names]])
    kind, width = kind_of(settings), 1 + len(settings.beginnings)
    for epoch in range(max(settings.epochs, min(settings.most, -(-settings.steps // count)))):
        turn = F.xxhash64(F.lit(epoch), "doc_id", "ids")
        shard = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)).cast("int")
        dealt = rows.repartitionById(shards, shard).sortWithinPartitions(turn, "doc_id", "_toxic")

        def run(batches, net=net, spread=spread):
            learner = Learner(net, spread)
            for batch in batches:
                for ids, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    learner.learn(np.frombuffer(ids, kind).reshape(-1, width), y)
            if learner.rows:
                slots, n, values = learner.state()
                columns = [pa.array(slots, pa.int64()), pa.array(n), *[pa.array(v) for v in values.T.copy()]]
                for batch in pa.table(columns, ["slot", "n", *names]).to_batches(2000):
                    yield batch

        states = dealt.select("doc_id", "ids", "_toxic").mapInArrow(run, schema)
        summed = states.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ["n", *names]]).toArrow()
        slots, n, *values = (c.to_numpy() for c in summed.columns)
        net = merge(net, spread, slots, n, np.column_stack(values))
    return net


class Scorer:
    """Scores whole texts. Each word's products with all filter taps are computed once and kept, up to a bound."""

    def __init__(self, net: Network):
        self.net, s = net, net.settings
        self.settings = s
        self.taps = np.concatenate([k[i] for k in net.filters for i in range(len(k))], axis=1)
        self.table = np.zeros((1024, self.taps.shape[1]), np.float32)
        self.known: dict[str, int] = {}

    def rows(self, found: list[str]) -> np.ndarray:
        known = self.known
        new = [*{*found}.difference(known)]
        if new and len(known) + len(new) > self.settings.cached:
            self.known = known = {}
            new = [*{*found}]
        if new:
            start = len(known)
            known.update(zip(new, range(start, start + len(new))))
            while len(self.table) < len(known):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            ids = features(new, self.settings)
            self.table[start : start + len(new)] = self.net.vectors[ids].sum(1) @ self.taps
        return np.array([known[w] for w in found])

    def score(self, text: str | None) -> float:
        s, net = self.settings, self.net
        found = LETTERS.findall(text.lower()) if text else []
        top = np.full(len(net.shift), -np.inf, np.float32)
        reach = max(s.widths) - 1
        for start in range(0, max(len(found), 1), s.chunk):
            piece = found[start : start + s.chunk + reach]
            if not piece:
                break
            rows = self.rows(piece)
            seen = self.table[rows]
            at = 0
            for k, w in enumerate(s.widths):
                n = len(piece) - w + 1
                if n > 0:
                    total = seen[:n, at : at + s.filters]
                    for i in range(1, w):
                        total = total + seen[i : i + n, at + i * s.filters : at + (i + 1) * s.filters]
                    part = slice(k * s.filters, (k + 1) * s.filters)
                    top[part] = np.maximum(top[part], total.max(0))
                at += w * s.filters
        pooled = np.maximum(np.where(np.isfinite(top), top + net.shift, 0.0), 0.0)
        return squash(pooled @ net.out + net.bias)


def best_cut(rows: list[tuple[int, int, int]], settings: Settings) -> float | None:
    """The cut with the least cost of errors, from (score in thousandths, clean rows, toxic rows); none without both classes.

    A clean text called toxic costs `alarm` misses. Cuts stay between 0.5 and 0.95; of equally good ones that
    nearest to the common cut is taken.
    """
    rows = sorted(rows)
    positives, negatives = sum(p for _, _, p in rows), sum(n for _, n, _ in rows)
    if positives < 5 or negatives < 5:
        return None
    best = None
    below, above = 0, negatives  # positives under the cut, negatives over it
    edges = [0.0, *(s / 1000 for s, _, _ in rows), 1.0]
    for i in range(len(rows) + 1):
        if i:
            below += rows[i - 1][2]
            above -= rows[i - 1][1]
        if edges[i] == edges[i + 1]:
            continue
        low, high = max(0.5, edges[i]), min(0.95, edges[i + 1])
        if low > high:
            continue
        cut = settings.cut if low < settings.cut <= high else (low + high) / 2
        key = (below + settings.alarm * above, abs(cut - settings.cut))
        if best is None or key < best[0]:
            best = (key, cut)
    return float(best[1]) if best else None


def calibrate(rows: DataFrame, net: Network) -> dict[str, float]:
    """`best_cut` of each language, over every row (text, lang, _toxic).

    A language's rows are counted by score, in thousandths, before they meet; one row a language reaches the driver.
    """
    settings = net.settings

    def make():
        scorer = Scorer(net)
        return lambda cols: {
            "lang": cols["lang"],
            "at": [round(scorer.score(t) * 1000) for t in cols["text"]],
            "toxic": cols["_toxic"],
        }

    scored = map_batches(rows.where("lang IS NOT NULL").select("text", "lang", "_toxic"), "lang string, at int, toxic int", make)
    counted = scored.groupBy("lang", "at").agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))

    def cut(group: pa.Table) -> pa.Table:
        found = best_cut([*zip(*(group.column(c).to_pylist() for c in ("at", "clean", "toxic")))], settings)
        return pa.table({"lang": group.column("lang").slice(0, 1), "cut": pa.array([found], pa.float64())})

    cuts = counted.groupBy("lang").applyInArrow(cut, "lang string, cut double").where("cut IS NOT NULL")
    return {r.lang: r.cut for r in cuts.collect()}


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """Train and calibrate on every labelled row whose crc32(doc_id) mod 3 is not 1, whatever its length.

    A fifth of them, by a hash of doc_id, calibrates the thresholds, the rest trains; they are written once, as hashed
    words where they train, and never reach the driver. Labels that contradict each other count as toxic. Without both classes the network
    stays silent and every score is the share of toxic rows (one half without any row).
    """
    prepare(docs.sparkSession)
    seen = (
        labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        .where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang")
    chosen = likely_among(texts, seen.select("_id"), settings.bits).join(seen, F.col("doc_id") == F.col("_id")).drop("_id")
    apart = F.pmod(F.crc32(F.concat(F.lit("c"), F.col("doc_id").cast("string"))), F.lit(5)) == 0
    rows = stored(hashed(chosen.withColumn("_apart", apart), settings))
    count = {(r._apart, r._toxic): r.n for r in rows.groupBy("_apart", "_toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    positives = sum(n for (_, y), n in count.items() if y)
    if not 0 < positives < total:
        share = np.clip(positives / total if total else 0.5, 1e-6, 1 - 1e-6)
        return blank(settings, float(np.log(share / (1 - share))))
    learned = sum(n for (kept, _), n in count.items() if not kept)
    net = train(rows.where("NOT _apart"), learned, settings) if learned else blank(settings)
    net.thresholds = calibrate(rows.where("_apart"), net)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """One row per document: its score, its class at the common cut, and at its language's cut (`rejected`).

    A null or empty text scores like a text without words; a null doc_id is not held out; a null or unknown
    language has the common cut.
    """
    prepare(docs.sparkSession)
    cut = net.settings.cut

    def make():
        scorer = Scorer(net)

        def run(cols):
            scores = [scorer.score(t) for t in cols["text"]]
            cuts = [net.thresholds.get(k, cut) for k in cols["lang"]]
            return {
                "doc_id": cols["doc_id"],
                "held_out": [d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d in cols["doc_id"]],
                "score": scores,
                "predicted": [int(s >= cut) for s in scores],
                "lang_threshold": cuts,
                "rejected": [s >= c for s, c in zip(scores, cuts)],
            }

        return run

    return map_batches(docs.select("doc_id", "text", "lang"), RESULT, make)


def detect(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit on the labelled rows, then score every document."""
    prepare(docs.sparkSession)
    return score(docs, fit(docs, labels, settings))


def keep(docs: DataFrame, net: Network) -> DataFrame:
    """The rows, with all their columns, that the classifier does not reject."""
    prepare(docs.sparkSession)
    cut = net.settings.cut
    place = {c: i for i, c in enumerate(docs.columns)}

    def run(batches):
        scorer = Scorer(net)
        for batch in batches:
            texts, langs = (batch.column(place[c]).to_pylist() for c in ("text", "lang"))
            good = [scorer.score(t) < net.thresholds.get(k, cut) for t, k in zip(texts, langs)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
