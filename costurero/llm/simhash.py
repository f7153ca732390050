"""Near-duplicates by SimHash fingerprints, joined over a hierarchical index in Gray order.

Fingerprints that differ in few bits agree on whole blocks of bits. Each distinct fingerprint is therefore dealt to
one group per masked pattern of its blocks; a group of many fingerprints is dealt anew by longer patterns, so that
its size has a bound that does not depend on the data. Within a group the fingerprints stand in Gray order, where
neighbours share most bits. Upper nodes hold the bits that all fingerprints below agree on; two nodes whose shared
bits already differ too often are dropped with everything below them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import map_batches, prepare, stored
from costurero.llm.components import components

SEED = 42
FAN = 8
LANES = np.uint64(0x0101010101010101)
ALL = (1 << 64) - 1


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, width: int) -> list[int]:
    """XXH64 of every run of `width` words; of the whole sequence if it is shorter; none without words."""
    words = text.encode("utf-8").lower().split() if text else []
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= width:
        return [xxhash.xxh64_intdigest(line, SEED)]
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())]


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each run of hashes (sizes say how many), the bits set in over half of them; zero for an empty run."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    n = sizes[some]
    # Eight counters share a word; 255 additions cannot overflow one, so runs are cut there.
    pieces = -(-n // 255)
    first = np.cumsum(pieces) - pieces
    at = np.arange(pieces.sum()) - np.repeat(first, pieces)
    cuts = np.repeat(np.cumsum(n) - n, pieces) + at * 255
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & LANES, cuts)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        set_ = 2 * counts > n[:, None]
        for byte in range(8):
            out[some] |= set_[:, byte].astype(np.uint64) << np.uint64(8 * byte + k)
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, same, fp) of every row; fp is the fingerprint's 64 bits as a bigint, `same` a digest that tells the texts
    of rows that share a doc_id apart. Null and wordless texts have fingerprint zero.
    """

    def make():
        def run(cols):
            found = [shingle_hashes(t, width) for t in cols["text"]]
            sizes = np.array([len(x) for x in found], np.int64)
            hashes = np.array([h for x in found for h in x], np.uint64)
            return {"doc_id": cols["doc_id"], "same": cols["same"], "fp": majority(hashes, sizes).view(np.int64)}

        return run

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("same"))
    return map_batches(rows, "doc_id bigint, same bigint, fp bigint", make)


# ---------------------------------------------------------------- groups by masked pattern


def first_masks(differ: int) -> list[int]:
    """Masks of two blocks of bits, so many that fingerprints with at most `differ` different bits agree on one."""
    blocks = differ + 2
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(x) for x in combinations(parts, 2)]


def longer_masks(mask: int, differ: int) -> list[int]:
    """The mask with each of `differ` + 1 pieces of its free bits added: on one of them such fingerprints agree."""
    free = [i for i in range(64) if not mask >> i & 1]
    edges = [len(free) * i // (differ + 1) for i in range(differ + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]


def gray_rank(fp: Column) -> Column:
    """Place of a code in the Gray sequence: each bit is the parity of the bits from it upwards."""
    for n in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, n))
    return fp


def dealt(fps: DataFrame, differ: int, most: int, levels: int = 2) -> DataFrame:
    """(mask, key, fp): each fingerprint once per group. Groups of over `most` are dealt by longer masks, twice at most.

    After that a group's fingerprints differ in 14 free bits only (for two differing bits), so it has at most
    2 ** 14 of them.
    """
    masks = first_masks(differ)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    for _ in range(levels):
        longer = {m: longer_masks(m, differ) for m in masks}
        table = F.create_map(
            *[x for m, ms in longer.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(y)) for y in ms]))]
        )
        large = rows.groupBy("mask", "key").count().where(F.col("count") > most).select("mask", "key", F.lit(True).alias("large"))
        rows = rows.join(large, ["mask", "key"], "left").select(
            "fp", F.explode(F.when(F.col("large"), table[F.col("mask")]).otherwise(F.array("mask"))).alias("mask")
        )
        rows = rows.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        masks = masks + sorted({y for ms in longer.values() for y in ms})
    return rows


# ---------------------------------------------------------------- the index of one group


def unite(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of the pairs; a class is labelled by its least member."""
    while True:
        a, b = label[i], label[j]
        if (a == b).all():
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


class GrayIndex:
    """Index of distinct fingerprints in Gray order: levels of nodes, each over FAN nodes below it.

    A node has the mask of the bits that all its fingerprints share and their pattern under it.
    """

    def __init__(self, codes: np.ndarray):
        self.levels = [(np.full(len(codes), ALL, np.uint64), codes)]
        low = high = codes
        while len(low) > 1:
            cuts = np.arange(0, len(low), FAN)
            low, high = np.bitwise_and.reduceat(low, cuts), np.bitwise_or.reduceat(high, cuts)
            mask = ~(low ^ high)
            self.levels.append((mask, low & mask))

    def apart(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bits in which everything below two nodes differs for certain."""
        mask, pattern = self.levels[level]
        return np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b])

    def classes(self, differ: int, at_once: int = 1 << 16) -> np.ndarray:
        """Label of each fingerprint's class under links of at most `differ` differing bits.

        Pairs of nodes are followed depth first in pieces of bounded size, so memory stays small even if all link.
        Nodes whose fingerprints all stand in one class already are not opened.
        """
        label = np.arange(len(self.levels[0][0]))
        top = len(self.levels) - 1
        todo = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            near = self.apart(level, a, b) <= differ
            a, b = a[near], b[near]
            if level == 0:
                unite(label, a, b)
                continue
            if level == 1 and len(a):
                cuts = np.arange(0, len(label), FAN)
                low, high = np.minimum.reduceat(label, cuts), np.maximum.reduceat(label, cuts)
                open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
                a, b = a[open_], b[open_]
            n = len(self.levels[level - 1][0])
            for start in range(0, len(a), max(1, at_once // FAN**2)):
                part = slice(start, start + max(1, at_once // FAN**2))
                i = (a[part, None] * FAN + np.arange(FAN))[:, :, None]
                j = (b[part, None] * FAN + np.arange(FAN))[:, None, :]
                i, j = (x.reshape(-1) for x in np.broadcast_arrays(i, j))
                good = (j < n) & ((i < j) if level == 1 else (i <= j))
                todo.append((level - 1, i[good], j[good]))
        return label


def group_edges(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the classes within each group; rows of a group stand together, in Gray order."""
    start = np.flatnonzero(np.concatenate([[True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])]))
    size = np.diff(np.concatenate([start, [len(fp)]]))
    codes = fp.view(np.uint64)
    v, u = [], []
    # A group that fits one node is compared directly, all such groups together.
    own = np.repeat(np.where(size <= FAN, start + size, -1), size)
    for d in range(1, FAN):
        i = np.flatnonzero(np.arange(len(fp)) + d < own)
        i = i[np.bitwise_count(codes[i] ^ codes[i + d]) <= differ]
        v.append(fp[i + d])
        u.append(fp[i])
    for a, n in zip(start[size > FAN].tolist(), size[size > FAN].tolist()):
        label = GrayIndex(codes[a : a + n]).classes(differ)
        linked = np.flatnonzero(label != np.arange(n))
        v.append(fp[a + linked])
        u.append(fp[a + label[linked]])
    return np.concatenate(v), np.concatenate(u)


def links(fps: DataFrame, differ: int, most: int = 4096) -> DataFrame:
    """(v, u): edges that span the classes of fingerprints with at most `differ` differing bits (not all pairs)."""
    rows = dealt(fps, differ, most)
    rows = rows.withColumn("rank", gray_rank(F.col("fp")))
    rows = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "rank").select("mask", "key", "fp")
    schema = pa.schema([("v", pa.int64()), ("u", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns)]
            n = len(now[0])
            if not n:
                continue
            # The last group may go on in the next batch.
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [x[cut:] for x in now]
            if cut:
                v, u = group_edges(*[x[:cut] for x in now], differ)
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], schema=schema)
        if len(rest[0]):
            v, u = group_edges(*rest, differ)
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(u)], schema=schema)

    return rows.mapInArrow(run, "v bigint, u bigint")


# ---------------------------------------------------------------- results


def grouped(docs: DataFrame, width: int, differ: int) -> DataFrame:
    """(doc_id, same, fp, component_id) of every row.

    Nodes and their roots are written before they meet: a root of very many nodes, and a fingerprint of very many rows,
    then come by a shuffle that can be split.
    """
    prepare(docs.sparkSession)
    prints = stored(fingerprints(docs, width))
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    tree = components(links(firsts.select("fp"), differ)).withColumnRenamed("node", "fp")
    members = stored(firsts.join(tree, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = stored(members.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = stored(members.join(least, "root").select("fp", "component_id"))
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame, width: int = 3, differ: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest doc_id reachable over links. Equal texts share a fingerprint and are one node,
    however many they are. Null and wordless texts have fingerprint zero and link like any other. Rows that repeat
    a doc_id each get their own row; a null doc_id takes part but is never a component's id unless all are null.
    """
    fingerprint = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return grouped(docs, width, differ).select("doc_id", fingerprint, "component_id")


def one_of_each(docs: DataFrame, width: int = 3, differ: int = 2) -> DataFrame:
    """The rows of the document with the smallest doc_id of each component, with all their columns.

    Rows without doc_id stay. Of rows that share a doc_id only those go whose own text is in another's component.
    """
    losers = grouped(docs, width, differ).where("doc_id <> component_id").select("doc_id", "same").distinct()
    lost = losers.select(F.col("doc_id").alias("lost_id"), "same")
    found = (docs["doc_id"] == lost["lost_id"]) & (F.xxhash64(docs["text"]) == lost["same"])
    return docs.join(lost, found, "left_anti")
