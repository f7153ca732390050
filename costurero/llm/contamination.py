"""Benchmark passages in documents, by a positional inverted index.

Documents are indexed in segments. A segment row stores, for the terms of the benchmark, the sorted list of
(term, position) postings and the documents' boundaries; it is written to the shared folder and read for every
block of benchmark items. A window is looked up from its rarest term, by document frequency over all segments:
its postings give the candidate starts, and the offset-adjusted lists of the next terms thin them out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import prepare, stored

#: Everything but ASCII digits, lower-case letters and characters beyond ASCII ends a word (after lower-casing).
#: The same on UTF-8 bytes: every byte beyond ASCII belongs to a word.
TO_BLANK = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)

INDEX = (
    "docs array<bigint>, ends array<bigint>, terms binary, frequencies binary, postings binary"
)


@dataclass(frozen=True)
class Settings:
    """A window has `width` words. Near matches have all but `missing` of them, each up to `slop` places off.

    A block of items has at most `block` characters: that bounds what every task gets of the benchmark. A segment
    closes at `segment` words, or after a longer document.
    """

    width: int = 10
    missing: int = 1
    slop: int = 2
    block: int = 8_000_000
    segment: int = 1_000_000


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(TO_BLANK).split() if text else []


class Benchmark:
    """Windows of a block of items over numbered terms."""

    def __init__(self, items: list[tuple[int, str]], width: int):
        self.terms: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set[int]] = {}
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                windows.setdefault(tuple(ids[i : i + width]), set()).add(item)
        self.windows = list(windows)
        self.items = [sorted(x) for x in windows.values()]


def segments(docs: DataFrame, terms: dict[bytes, int], settings: Settings) -> DataFrame:
    """The index: one row per segment, postings as sorted numbers term * 2**32 + position in the segment.

    Positions count all words; `ends` has each document's end, so a position tells its document. A segment of
    more than 2**32 words cannot occur: it would be one document of that many words.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(INDEX))

    def close(ids: list[int | None], ends: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        term = np.concatenate(found)
        place = np.flatnonzero(term >= 0)
        postings = np.sort(term[place] << 32 | place)
        used, counts = np.unique(postings >> 32, return_counts=True)
        cells = [[ids], [ends], [used.astype("<i8").tobytes()], [counts.astype("<i8").tobytes()], [postings.astype("<i8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ends, found, n = [], [], [], 0
        get = terms.get
        for batch in batches:
            for doc, text in zip(*[c.to_pylist() for c in batch.columns]):
                tokens = words(text)
                ids.append(doc)
                n += len(tokens)
                ends.append(n)
                found.append(np.array([get(w, -1) for w in tokens], np.int64))
                if n >= settings.segment:
                    yield close(ids, ends, found)
                    ids, ends, found, n = [], [], [], 0
        if ids:
            yield close(ids, ends, found)

    return docs.select("doc_id", "text").mapInArrow(run, INDEX)


def frequencies(index: DataFrame, n_terms: int) -> np.ndarray:
    """Postings of each term over all segments: one row per term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for t, c in zip(*[c.to_pylist() for c in batch.columns]):
                total[np.frombuffer(t, "<i8")] += np.frombuffer(c, "<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some, "n": total[some]})

    out = np.zeros(n_terms, np.int64)
    parts = index.select("terms", "frequencies").mapInArrow(run, "term bigint, n bigint")
    for row in parts.groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


class Search:
    """Looks up all windows of a block in a segment, each from its rarest term on."""

    def __init__(self, windows: list[tuple[int, ...]], rarity: np.ndarray, settings: Settings):
        self.settings = settings
        n, width = len(windows), settings.width
        self.size = np.array([len(w) for w in windows], np.int64)
        term = np.zeros((n, width), np.int64)
        offset = np.zeros((n, width), np.int64)
        for i, w in enumerate(windows):
            order = sorted(range(len(w)), key=lambda j: (rarity[w[j]], j))
            term[i, : len(w)] = [w[j] for j in order]
            offset[i, : len(w)] = order
        self.term, self.offset = term, offset
        # Without a posting of its rarest term a window occurs nowhere.
        self.alive = rarity[term[:, 0]] > 0 if n else np.zeros(0, bool)

    def from_postings(self, postings: np.ndarray, rank: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) that the postings of each chosen window's term of this rank propose."""
        term = self.term[chosen, rank]
        low = np.searchsorted(postings, term << 32)
        n = np.searchsorted(postings, (term + 1) << 32) - low
        window = np.repeat(chosen, n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        return window, (postings[at] & 0xFFFFFFFF) - self.offset[window, rank]

    def at(self, postings: np.ndarray, window: np.ndarray, start: np.ndarray, rank: int, slop: int) -> np.ndarray:
        """Whether the term of this rank is where it belongs, up to `slop` places off."""
        want = (self.term[window, rank] << 32) + start + self.offset[window, rank]
        low = np.searchsorted(postings, np.maximum(want - slop, self.term[window, rank] << 32))
        found = postings[np.minimum(low, len(postings) - 1)]
        return (low < len(postings)) & (found <= want + slop) & (found >> 32 == self.term[window, rank])

    def exact(self, postings: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, document) of every occurrence."""
        window, start = self.from_postings(postings, 0, np.flatnonzero(self.alive))
        window, start, doc = self.inside(window, start, ends)
        for rank in range(1, self.settings.width):
            if not len(window):
                break
            good = (rank >= self.size[window]) | self.at(postings, window, start, rank, 0)
            window, start, doc = window[good], start[good], doc[good]
        return window, start, doc

    def near(self, postings: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, start, document) where all but `missing` terms of a full window stand within `slop` of their place.

        One of the `missing` + 1 rarest terms must be there, so only their postings propose starts.
        """
        s = self.settings
        chosen = np.flatnonzero(self.size == s.width)
        parts = [self.from_postings(postings, rank, chosen) for rank in range(s.missing + 1)]
        window, start = (np.concatenate(x) for x in zip(*parts))
        pairs = np.unique(window << 32 | (start + s.width)) if len(window) else np.zeros(0, np.int64)
        window, start = pairs >> 32, (pairs & 0xFFFFFFFF) - s.width
        window, start, doc = self.inside(window, start, ends)
        lost = np.zeros(len(window), np.int64)
        for rank in range(s.width):
            if not len(window):
                break
            lost += ~self.at(postings, window, start, rank, s.slop)
            good = lost <= s.missing
            window, start, doc, lost = window[good], start[good], doc[good], lost[good]
        return window, start, doc

    def inside(self, window: np.ndarray, start: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Only candidates that lie in one document, with it."""
        good = start >= 0
        window, start = window[good], start[good]
        doc = np.searchsorted(ends, start, side="right")
        good = doc < len(ends)
        window, start, doc = window[good], start[good], doc[good]
        good = start + self.size[window] <= ends[doc] if len(doc) else np.zeros(0, bool)
        return window[good], start[good], doc[good]


def found_in(row: dict, search: Search, items: list[list[int]], proximity: bool) -> dict[str, list]:
    """One row per document of a segment: its words, the hit ones, the items that occur exactly and nearly."""
    ends = np.array(row["ends"], np.int64)
    postings = np.frombuffer(row["postings"], "<i8")
    n, total = len(ends), int(ends[-1]) if len(ends) else 0
    size = np.diff(np.concatenate([[0], ends]))
    hit = np.zeros(total + 1, np.int64)
    exact: list[set[int]] = [set() for _ in range(n)]
    near: list[set[int]] = [set() for _ in range(n)]
    if len(postings):
        window, start, doc = search.exact(postings, ends)
        np.add.at(hit, start, 1)
        np.add.at(hit, start + search.size[window], -1)
        for w, d in set(zip(window.tolist(), doc.tolist())):
            exact[d].update(items[w])
        if proximity:
            window, start, doc = search.near(postings, ends)
            for w, d in set(zip(window.tolist(), doc.tolist())):
                near[d].update(items[w])
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit[:total]) > 0)])
    return {
        "doc_id": row["docs"],
        "n_words": size.tolist(),
        "hits": [np.packbits(np.cumsum(hit)[e - k : e] > 0).tobytes() if h else b"" for e, k, h in zip(ends.tolist(), size.tolist(), (covered[ends] - covered[ends - size]).tolist())],
        "n_hit": (covered[ends] - covered[ends - size]).tolist(),
        "items": [sorted(x) for x in exact],
        "near_items": [sorted(x - y) for x, y in zip(near, exact)],
    }


FOUND = "doc_id bigint, n_words bigint, hits binary, n_hit bigint, items array<bigint>, near_items array<bigint>"


def block_matches(docs: DataFrame, items: list[tuple[int, str]], settings: Settings, proximity: bool) -> DataFrame:
    """One row per document for one block of items."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    bench = Benchmark(items, settings.width)
    index = stored(segments(docs, bench.terms, settings))
    rarity = frequencies(index, len(bench.terms))
    search, names = Search(bench.windows, rarity, settings), bench.items
    schema = to_arrow_schema(StructType.fromDDL(FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = found_in(row, search, names, proximity)
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return index.select("docs", "ends", "postings").mapInArrow(run, FOUND)


def blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most `most` characters (an item alone may have more), one after the other."""
    held, size = [], 0
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    for row in items.toLocalIterator():
        if held and size + len(row.text) > most:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text)
    if held:
        yield held


def _total(masks: pd.Series) -> pd.Series:
    """Bits set in any of a row's masks."""
    out = []
    for group in masks:
        bits = [np.frombuffer(m, np.uint8) for m in group if len(m)]
        both = np.zeros(max(map(len, bits), default=0), np.uint8)
        for b in bits:
            both[: len(b)] |= b
        out.append(int(np.bitwise_count(both).sum()))
    return pd.Series(out)


def matches(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), proximity: bool = True) -> DataFrame:
    """(doc_id, n_words, n_hit, items, near_items) of every row of `docs`.

    n_hit counts the words inside occurrences of any window, `items` has the item_ids with an occurring window,
    `near_items` those that only come near. Null texts have no words. Null items have no windows; items that share
    an id count as one. Rows that repeat a doc_id, or have none, each get their own row: where several blocks hold the
    benchmark, their results meet by a stored number of each row.
    """
    prepare(docs.sparkSession)
    every = blocks(benchmark, settings.block)
    first, second = next(every, []), next(every, None)
    if second is None:
        return block_matches(docs, first, settings, proximity).select("doc_id", "n_words", "n_hit", "items", "near_items")
    numbered = stored(docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    rows = numbered.select(F.col("row").alias("doc_id"), "text")
    found = None
    for block in chain([first, second], every):
        part = block_matches(rows, block, settings, proximity)
        found = part if found is None else found.unionAll(part)
    merged = found.withColumnRenamed("doc_id", "row").groupBy("row").agg(
        F.max("n_words").alias("n_words"),
        F.collect_list("hits").alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    counted = merged.select("row", "n_words", F.pandas_udf(_total, "bigint")("hits").alias("n_hit"), "items", "near_items")
    return numbered.select("row", "doc_id").join(counted, "row").select("doc_id", "n_words", "n_hit", "items", "near_items")


def report(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Matches of every row with the digest of its items."""
    found = matches(docs, benchmark, settings)
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "near_items",
    )


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows, with all their columns, without a window of the benchmark; rows without doc_id stay."""
    hit = matches(docs, benchmark, settings, proximity=False).where("n_hit > 0").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
