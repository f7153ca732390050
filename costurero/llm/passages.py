"""Repeated passages of words, by fixed-block anchors.

Every document is cut into non-overlapping reference blocks of half a window; all of them are indexed. Each rolling
run of a block's length probes that index. A window that repeats holds a whole reference block of one document and
the equal run of the other, so hits of probes bound the places where windows can repeat. There the hits are extended:
whole windows are compared by 128-bit digests, and a word goes if a window over it also starts in a document with a
smaller doc_id.

Probes and digests travel as packed arrays, many to a row, dealt by their hash to buckets of bounded size. What a
task can decide among its own documents it decides at once and forwards one representative, so a passage that most
documents share does not fill its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import byte_words, deal, map_batches, numbered, prepare, stored

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
PACKED = "key int, docs binary, ids binary, counts binary, places binary, low binary, high binary"
MARKS = "row bigint, places binary"


@dataclass(frozen=True)
class Settings:
    """Windows of `window` words; a bucket holds the probes of about `bucket` characters; `batch` words at a time."""

    window: int = 50
    bucket: int = 16_000_000
    batch: int = 1_000_000

    @property
    def block(self) -> int:
        """The longest block of which every window holds a whole one, wherever it starts."""
        return (self.window + 1) // 2


class Rolling:
    """Hashes of all runs of a length over an array of word codes, by prefix sums modulo 2 ** 64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, codes: np.ndarray, length: int) -> np.ndarray:
        n = len(codes)
        if n < length:
            return np.zeros(0, np.uint64)
        self.grow(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(codes * self.down[:n])])
        x = (sums[length:] - sums[:-length]) * self.up[: n - length + 1]
        x = (x ^ x >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
        return x ^ x >> np.uint64(29)


def codes_of(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.array([digest(w) for w in words], np.uint64)


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane: the upper planes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<i4").reshape(-1).astype(np.int64)


def runs(sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values starts, and how long it is."""
    start = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate([start, [len(sorted_)]]))


def packed_rows(key, doc, place, low, high, schema, ids=None) -> pa.RecordBatch:
    """Entries sorted by key and doc (a row's number), packed to one row per key; with `ids` also each doc's own id."""
    cells = {f.name: [] for f in schema}
    starts, sizes = runs(key)
    for a, n in zip(starts.tolist(), sizes.tolist()):
        part = slice(a, a + n)
        first, counts = runs(doc[part])
        cells["key"].append(int(key[a]))
        cells["docs"].append(doc[part][first].astype("<i8").tobytes())
        cells["ids"].append(None if ids is None else ids[part][first].astype("<i8").tobytes())
        cells["counts"].append(planes(counts))
        cells["places"].append(planes(place[part]))
        cells["low"].append(low[part].tobytes())
        cells["high"].append(None if high is None else high[part].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(cells[f.name], f.type) for f in schema], schema=schema)


def schema_of(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def settled_rows(doc: np.ndarray, place: np.ndarray, n_keys: int, schema: pa.Schema) -> pa.RecordBatch:
    """Marks that need no bucket: they travel under keys of their own, dealt by document."""
    key = -1 - doc % n_keys
    order = np.lexsort((place, doc, key))
    return packed_rows(key[order], doc[order], place[order], np.zeros(len(doc), np.uint8)[:0], None, schema)


def collected(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple]]:
    """Rows of the batches in pieces of about `size` words; a row is (number, words, further columns)."""
    held, n = [], 0
    for batch in batches:
        for doc, text, *more in zip(*[c.to_pylist() for c in batch.columns]):
            words = byte_words(text)
            held.append((doc, words, *more))
            n += len(words)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


class Joined:
    """Word codes of several documents laid end to end, with the runs that stay within one document."""

    def __init__(self, rows: list[tuple]):
        self.size = np.array([len(r[1]) for r in rows], np.int64)
        self.doc = np.array([r[0] for r in rows], np.int64)
        self.codes = np.concatenate([codes_of(r[1]) for r in rows]) if rows else np.zeros(0, np.uint64)
        self.start = np.cumsum(self.size) - self.size

    def within(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of every run of that length."""
        n = np.maximum(self.size - length + 1, 0)
        row = np.repeat(np.arange(len(n)), n)
        return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def probes(docs: DataFrame, n_keys: int, settings: Settings) -> DataFrame:
    """Packed probes of every document of at least one window, and the marks already settled in their task."""
    block, schema = settings.block, schema_of(PACKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(BASES[0])
        for rows in collected(batches, settings.batch):
            rows = [r for r in rows if len(r[1]) >= settings.window]
            if not rows:
                continue
            text = Joined(rows)
            row, place = text.within(block)
            h = roll(text.codes, block)[text.start[row] + place]
            doc = text.doc[row]
            # Equal probes of this task's documents: with a reference block among them they are hits already.
            order = np.argsort(h, kind="stable")
            start, size = runs(h[order])
            aligned = np.zeros(len(h), bool)
            aligned[order] = np.repeat(np.logical_or.reduceat((place % block == 0)[order], start), size)
            many = np.zeros(len(h), np.int64)
            many[order] = np.repeat(size, size)
            settled = aligned & (many > 1)
            # One reference block stands for each settled hash.
            send = ~settled
            chosen = order[settled[order] & (place % block == 0)[order]]
            send[chosen[runs(h[chosen])[0]]] = True
            if settled.any():
                yield settled_rows(doc[settled], place[settled], n_keys, schema)
            at = np.flatnonzero(send)
            key = (h[at] >> np.uint64(32)).astype(np.int64) % n_keys
            order = np.argsort(key.astype(np.uint16) if n_keys <= 1 << 16 else key, kind="stable")
            at, key = at[order], key[order]
            yield packed_rows(key, doc[at], place[at], (h[at] & np.uint64(0xFFFFFFFF)).astype("<u4"), None, schema)

    return docs.select("row", "text").mapInArrow(run, PACKED)


def unpacked(rows: list[dict], name: str = "docs") -> tuple[np.ndarray, np.ndarray]:
    """Documents (their rows' numbers, or their ids) and places of packed rows."""
    docs = [np.repeat(np.frombuffer(r[name], "<i8"), from_planes(r["counts"])) for r in rows]
    return np.concatenate(docs), np.concatenate([from_planes(r["places"]) for r in rows])


def grouped(packed: DataFrame, n_keys: int, out: str, settle) -> DataFrame:
    """Packed rows brought together by key; `settle(key, rows)` makes a batch of each key's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["key"] != row["key"]:
                    yield settle(held[0]["key"], held)
                    held = []
                held.append(row)
        if held:
            yield settle(held[0]["key"], held)

    dealt = packed.repartition(deal(packed.sparkSession, n_keys), "key")
    return dealt.sortWithinPartitions("key").mapInArrow(run, out)


def by_key(packed: DataFrame, n_keys: int, decide) -> DataFrame:
    """(row, places), one line per row, of the packed entries that `decide(doc, place, low, high)` marks; where entries
    carry their documents' ids, these are what `decide` sees.

    Marks leave their bucket packed by a key of their document, so that their rows do not multiply with the buckets.
    """
    between, schema = schema_of(PACKED), schema_of(MARKS)

    def in_bucket(key: int, rows: list[dict]) -> pa.RecordBatch:
        doc, place = unpacked(rows)
        if key >= 0:
            low = np.concatenate([np.frombuffer(r["low"], "<u8" if r["high"] is not None else "<u4") for r in rows])
            high = np.concatenate([np.frombuffer(r["high"], "<u8") for r in rows]) if rows[0]["high"] is not None else None
            hit = decide(unpacked(rows, "ids")[0] if rows[0]["ids"] is not None else doc, place, low, high)
            doc, place = doc[hit], place[hit]
        return settled_rows(doc, place, n_keys, between)

    def of_document(key: int, rows: list[dict]) -> pa.RecordBatch:
        doc, place = unpacked(rows)
        order = np.lexsort((place, doc))
        doc, place = doc[order], place[order]
        start, size = runs(doc)
        cells = [doc[start], [planes(place[a : a + n]) for a, n in zip(start.tolist(), size.tolist())]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

    return grouped(grouped(packed, n_keys, PACKED, in_bucket), n_keys, MARKS, of_document)


def hits(docs: DataFrame, n_keys: int, settings: Settings) -> DataFrame:
    """(row, places): places of probes equal to a reference block elsewhere, and of such blocks."""
    block = settings.block

    def decide(doc, place, low, high):
        order = np.argsort(low, kind="stable")
        start, size = runs(low[order])
        good = np.logical_or.reduceat((place % block == 0)[order], start) & (size > 1)
        hit = np.zeros(len(low), bool)
        hit[order] = np.repeat(good, size)
        return hit

    return by_key(probes(docs, n_keys, settings), n_keys, decide)


def repeated(docs: DataFrame, found: DataFrame, n_keys: int, settings: Settings) -> DataFrame:
    """(row, places): starts of windows that also start in a document with a smaller doc_id.

    Only windows over a hit are compared.
    """
    window, block, schema = settings.window, settings.block, schema_of(PACKED)
    joined = docs.join(found, "row").select("row", "text", "places", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = [Rolling(b) for b in BASES]
        for rows in collected(batches, settings.batch):
            rows = [r for r in rows if len(r[1]) >= window]
            if not rows:
                continue
            text = Joined(rows)
            row, place = text.within(window)
            cover = np.zeros(len(text.codes) + 1, np.int64)
            for start, (_, _, marked, _) in zip(text.start.tolist(), rows):
                p = from_planes(marked)
                np.add.at(cover, start + np.maximum(p - (window - block), 0), 1)
                np.add.at(cover, start + p + 1, -1)
            near = np.cumsum(cover)[text.start[row] + place] > 0
            row, place = row[near], place[near]
            if not len(row):
                continue
            at, doc, own = text.start[row] + place, text.doc[row], np.array([r[3] for r in rows], np.int64)[row]
            low, high = (roll(text.codes, window)[at] for roll in rolls)
            order = np.lexsort((own, high, low))
            new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
            first = np.zeros(len(low), np.int64)
            first[order] = own[order][np.flatnonzero(new)][np.cumsum(new) - 1]
            settled = own > first
            if settled.any():
                yield settled_rows(doc[settled], place[settled], n_keys, schema)
            at = np.flatnonzero(~settled)
            key = (low[at] >> np.uint64(32)).astype(np.int64) % n_keys
            order = np.lexsort((place[at], doc[at], key))
            at, key = at[order], key[order]
            yield packed_rows(key, doc[at], place[at], low[at].astype("<u8"), high[at].astype("<u8"), schema, own[at])

    def decide(doc, place, low, high):
        order = np.lexsort((doc, high, low))
        new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
        first = doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
        hit = np.zeros(len(low), bool)
        hit[order] = doc[order] > first
        return hit

    return by_key(joined.mapInArrow(run, PACKED), n_keys, decide)


def removed_words(n: int, starts: bytes, window: int) -> np.ndarray:
    """Whether each of n words is covered by one of the windows."""
    cover = np.zeros(n + window + 1, np.int64)
    at = from_planes(starts)
    at = at[at <= n - window]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.cumsum(cover)[:n] > 0


def repeats(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, starts): for each of the `numbered` rows, packed starts of its windows that a smaller doc_id has too."""
    prepare(rows.sparkSession)
    known = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    chars = known.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n_keys = chars // settings.bucket + 1
    found = stored(hits(known, n_keys, settings))
    gone = stored(repeated(known, found, n_keys, settings))
    return gone.withColumnRenamed("places", "starts")


def without_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, text, n_words, n_removed): kept words joined by one blank."""
    rows = numbered(docs)
    joined = rows.join(repeats(rows, settings), "row", "left").select("doc_id", "text", "starts")

    def make():
        def run(cols):
            out = {"doc_id": cols["doc_id"], "text": [], "n_words": [], "n_removed": []}
            for text, starts in zip(cols["text"], cols["starts"]):
                words = byte_words(text)
                kept = words
                if starts:
                    gone = removed_words(len(words), starts, settings.window)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out["text"].append(b" ".join(kept).decode("utf-8"))
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(kept))
            return out

        return run

    return map_batches(joined, "doc_id bigint, text string, n_words bigint, n_removed bigint", make)


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    Null and wordless texts have no words and the empty text's digest. A null doc_id is neither smaller nor greater than
    another, so its row removes and loses nothing. Rows that share a doc_id, with equal or other texts, remove nothing from
    each other; each loses what a smaller doc_id has.
    """
    kept = without_repeats(docs, settings)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
