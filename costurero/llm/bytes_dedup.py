"""Long byte strings that occur more than once, by suffix arrays over shards.

Shards are made so that all occurrences of a repeated string meet in one. The least hash of the short strings inside
a window is its anchor, and equal windows have equal anchors; consecutive windows of one anchor form a segment, and
segments are dealt by anchor. Anchors seen once need no shard. In a shard the distinct segments are laid end to end
and sorted by induced sorting; permuted common prefixes of neighbours tell which windows occur twice. Segments that
share their anchor and little around it are left out of the sorting: windows with their anchors at much the same place
have most of their bytes in common (their core), and where no other segment has that core none has such a window.

Equal segments are one in the shard, however many they are. An anchor of very many occurrences has no shard: its
windows are told apart one by one by 128-bit digests, counted where they are made before they move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import deal, map_batches, numbered, prepare, stored
from costurero.llm.passages import BASES, PACKED, Rolling, by_key, from_planes, packed_rows, runs, schema_of, settled_rows
from costurero.llm.suffix import common_prefixes, suffix_array

#: A code per byte value, from a fixed seed.
CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Not a byte of UTF-8.
BORDER = b"\xff"

#: Ranges of anchor places that have a core each.
CORES = 4

ANCHORS = "anchor bigint, row bigint, start bigint, n int, at int"
PIECES = "row bigint, start bigint, n int, at int, anchor bigint, digest_a bigint, digest_b bigint, body binary, copies int, " + PACKED
SPANS = "digest_a bigint, digest_b bigint, spans binary"


@dataclass(frozen=True)
class Settings:
    """Strings of `length` bytes; anchors are hashes of `gram` bytes, so a segment has length - gram windows or one more.

    A shard has about `shard` bytes. Anchors of over `hot` segments are told apart by digests. A task holds about
    `batch` bytes of text at a time, and seeks anchors in about `piece` bytes, which the processor's cache holds;
    digests go to buckets of the windows of about `bucket` bytes.
    """

    length: int = 400
    gram: int = 32
    shard: int = 3_000_000
    hot: int = 2000
    batch: int = 1_500_000
    piece: int = 100_000
    bucket: int = 16_000_000


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of every `width` consecutive numbers by their upper halves, the leftmost if several are least.

    The place takes the lower half, so one minimum gives both; runs of 1, 2, 4, ... numbers are joined to longer ones.
    """
    upper = np.uint64(0xFFFFFFFF00000000)
    least, run = x & upper | np.arange(len(x), dtype=np.uint64), 1
    while run < width:
        step = min(run, width - run)
        least = np.minimum(least[:-step], least[step:])
        run += step
    return (least & ~upper).astype(np.int64)


class Texts:
    """Texts of several documents laid end to end."""

    def __init__(self, docs: list[int], texts: list[bytes]):
        self.docs = np.array(docs, np.int64)
        self.data = b"".join(texts)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size

    @cached_property
    def codes(self) -> np.ndarray:
        return CODES[np.frombuffer(self.data, np.uint8)]

    def segments(self, roll: Rolling, s: Settings) -> tuple[np.ndarray, ...]:
        """(row, place, n, at, anchor): n consecutive windows from `place` on in a row's text with one place as anchor,
        `at` bytes behind `place`.

        Equal windows have their anchors at equal places, so two of them never share a segment.
        """
        hashes = roll(self.codes, s.gram)
        least = sliding_least(hashes, s.length - s.gram + 1)
        n = self.size - s.length + 1
        row = np.repeat(np.arange(len(n)), np.maximum(n, 0))
        place = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0), np.maximum(n, 0))
        anchor = least[self.start[row] + place]
        cut = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]))
        n, at = np.diff(np.concatenate([cut, [len(row)]])), anchor[cut] - self.start[row[cut]] - place[cut]
        return row[cut], place[cut], n, at, hashes[anchor[cut]].view(np.int64)


def lists_of(column: pa.ListArray) -> list[tuple[list, ...]]:
    """Each row's list of structs as a list per field."""
    fields = [f.to_numpy(zero_copy_only=False).tolist() for f in column.values.flatten()]
    ends = column.offsets.to_numpy().tolist()
    return [tuple(f[a:b] for f in fields) for a, b in zip(ends, ends[1:])]


def texts_in(batches: Iterator[pa.RecordBatch], s: Settings, size: int) -> Iterator[tuple[Texts, list]]:
    """Texts of at least one window, in pieces of about `size` bytes, with their further columns of lists."""
    docs, texts, more, n = [], [], [], 0
    for batch in batches:
        first, second, *lists = batch.columns
        for doc, text, *rest in zip(first.to_pylist(), second.to_pylist(), *map(lists_of, lists)):
            data = text.encode("utf-8")
            if len(data) < s.length:
                continue
            docs.append(doc)
            texts.append(data)
            more.append(rest)
            n += len(data)
            if n >= size:
                yield Texts(docs, texts), more
                docs, texts, more, n = [], [], [], 0
    if docs:
        yield Texts(docs, texts), more


def anchors(docs: DataFrame, s: Settings) -> DataFrame:
    """Every segment's anchor and place."""
    schema = schema_of(ANCHORS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Rolling(BASES[0])
        for texts, _ in texts_in(batches, s, s.piece):
            row, place, n, at, anchor = texts.segments(roll, s)
            cells = [anchor, texts.docs[row], place, n.astype(np.int32), at.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, schema)], schema=schema)

    return docs.select("row", "text").mapInArrow(run, ANCHORS)


def pieces(docs: DataFrame, wanted: DataFrame, n_keys: int, s: Settings) -> DataFrame:
    """For `wanted` (row, start, n, at, anchor, hot): occurrences with the digest of their segment, a segment's bytes
    once per task and digest, and for hot anchors packed digests of single windows.
    """
    per_row = wanted.groupBy("row").agg(F.collect_list(F.struct("start", "n", "at", "anchor", "hot")).alias("wanted"))
    joined = docs.select("row", "text").join(per_row, "row")
    schema, packed = schema_of(PIECES), schema_of(PACKED)

    def with_all(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def from_packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        return with_all({f.name: batch.column(f.name) for f in packed}, batch.num_rows)

    def digests(texts: Texts, rolls: list[Rolling], hot: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        """Windows of hot segments (row, start, n); those that repeat within the task are settled here."""
        row = np.repeat([h[0] for h in hot], [h[2] for h in hot])
        place = np.concatenate([np.arange(h[1], h[1] + h[2]) for h in hot])
        at, doc = texts.start[row] + place, texts.docs[row]
        low, high = (r(texts.codes, s.length)[at] for r in rolls)
        order = np.lexsort((high, low))
        new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
        start = np.flatnonzero(new)
        size = np.diff(np.concatenate([start, [len(order)]]))
        many = np.zeros(len(order), np.int64)
        many[order] = np.repeat(size, size)
        settled = many > 1
        if settled.any():
            yield settled_rows(doc[settled], place[settled], n_keys, packed)
        sent = order[start]
        key = (low[sent] >> np.uint64(32)).astype(np.int64) % n_keys
        by = np.lexsort((place[sent], doc[sent], key))
        sent, key = sent[by], key[by]
        yield packed_rows(key, doc[sent], place[sent], low[sent].astype("<u8"), high[sent].astype("<u8"), packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolls = [Rolling(b) for b in BASES]
        for texts, more in texts_in(batches, s, s.batch):
            out = {k: [] for k in ("row", "start", "n", "at", "anchor", "body", "copies")}
            numbers: list[bytes] = []
            bodies: dict[bytes, int] = {}
            hot: list[tuple[int, int, int]] = []
            for row, (doc, base, (found,)) in enumerate(zip(texts.docs.tolist(), texts.start.tolist(), more)):
                for start, n, at, anchor, many in zip(*found):
                    if many:
                        hot.append((row, start, n))
                        continue
                    body = texts.data[base + start : base + start + n - 1 + s.length]
                    digest = xxhash.xxh3_128_digest(body)
                    if digest in bodies:
                        out["copies"][bodies[digest]] += 1
                        body = None
                    else:
                        bodies[digest] = len(numbers)
                    numbers.append(digest)
                    for k, v in zip(out, (doc, start, n, at, anchor, body, 1)):
                        out[k].append(v)
            if numbers:
                out["digest_a"], out["digest_b"] = np.frombuffer(b"".join(numbers), "<i8").reshape(-1, 2).T.copy()
                yield with_all(out, len(numbers))
            if hot:
                for batch in digests(texts, rolls, hot):
                    yield from_packed(batch)

    return joined.mapInArrow(run, PIECES)


def repeated_runs(bodies: list[bytes], length: int) -> dict[int, np.ndarray]:
    """Of several distinct byte strings by number, the runs (first, past the last) of windows that occur elsewhere in
    them, where there are any.
    """
    data = BORDER.join(bodies)
    size = np.array([len(b) for b in bodies], np.int64)
    start = np.cumsum(size + 1) - size - 1
    room = np.repeat(start + size, size + 1)[:-1] - np.arange(len(data))  # none at a border
    order = suffix_array(data)
    shared = common_prefixes(data, order, room)[order] >= length
    flag = np.zeros(len(data) + 2, bool)
    flag[order[shared] + 1] = True
    flag[order[np.flatnonzero(shared) - 1] + 1] = True
    found = np.flatnonzero(flag[1:] != flag[:-1]).reshape(-1, 2)
    body = np.searchsorted(start, found[:, 0], "right") - 1
    found = (found - start[body][:, None]).astype("<i4")
    first, count = runs(body)
    return {k: found[a : a + n] for k, a, n in zip(body[first].tolist(), first.tolist(), count.tolist())}


def shared_parts(segments: list[tuple[bytes, int, int]], s: Settings) -> dict[int, tuple[int, int]]:
    """Of one anchor's distinct segments (body, n, at) those that have a core in common with another, by their number,
    with the first and the last of the windows that hold such a core.

    Anchors of equal windows lie equally far behind their starts. Each range of these distances has its core, the bytes
    that all windows of the range cover; equal windows are of one range and have equal cores.
    """
    places = s.length - s.gram + 1
    edges = [places * q // CORES for q in range(CORES + 1)]
    holders: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for k, (body, n, at) in enumerate(segments):
        for q, (low, high) in enumerate(zip(edges, edges[1:])):
            first, last = max(at - high + 1, 0), min(at - low, n - 1)
            if first <= last:
                core = xxhash.xxh3_64_intdigest(body[at - low : at - high + 1 + s.length])
                holders.setdefault((q, core), []).append((k, first, last))
    found: dict[int, tuple[int, int]] = {}
    for held in holders.values():
        for k, first, last in held if len(held) > 1 else ():
            a, b = found.get(k, (first, last))
            found[k] = min(a, first), max(b, last)
    return found


def repeated_windows(groups: list[dict], s: Settings) -> dict[tuple[int, int], np.ndarray]:
    """Runs (first, past the last) of repeated windows by segment, of `groups`: of each anchor the distinct segments
    {digest: [body, n, at, copies]}.
    """
    found = {d: np.array([[0, n]], "<i4") for g in groups for d, (_, n, _, copies) in g.items() if copies > 1}
    several = []
    for g in groups:
        if len(g) > 1:
            digests = list(g)
            parts = shared_parts([(body, n, at) for body, n, at, _ in g.values()], s)
            several += [(digests[k], first, g[digests[k]][0][first : last + s.length]) for k, (first, last) in parts.items()]
    if several:
        for k, windows in repeated_runs([body for _, _, body in several], s.length).items():
            digest, first, _ = several[k]
            if digest not in found:
                found[digest] = windows + np.int32(first)
    return found


def shards(made: DataFrame, n_keys: int, s: Settings) -> DataFrame:
    """(digest_a, digest_b, spans): runs of repeated windows of each segment that has any, as packed pairs."""
    schema = schema_of(SPANS)
    rows = made.where("body IS NOT NULL").select("anchor", "digest_a", "digest_b", "body", "n", "at", "copies")
    dealt = rows.repartition(deal(made.sparkSession, n_keys), "anchor").sortWithinPartitions("anchor", "digest_a", "digest_b")

    def solved(groups: list[dict]) -> pa.RecordBatch:
        out = {"digest_a": [], "digest_b": [], "spans": []}
        for (low, high), windows in repeated_windows(groups, s).items():
            out["digest_a"].append(low)
            out["digest_b"].append(high)
            out["spans"].append(windows.tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, now = [], 0, None
        for batch in batches:
            for anchor, low, high, body, n, at, copies in zip(*[c.to_pylist() for c in batch.columns]):
                if anchor != now:
                    if held >= s.shard:
                        yield solved(groups)
                        groups, held = [], 0
                    groups.append({})
                    now = anchor
                if (low, high) in groups[-1]:
                    groups[-1][low, high][3] += copies
                else:
                    groups[-1][low, high] = [body, n, at, copies]
                    held += len(body)
        if groups:
            yield solved(groups)

    return dealt.mapInArrow(run, SPANS)


def repeats(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(row, spans): for each of the `numbered` rows its repeated windows, as packed runs from an offset on (start, spans)
    or as single packed places.
    """
    prepare(rows.sparkSession)
    known = rows.where("text IS NOT NULL")
    chars = known.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n_keys = chars // s.bucket + 1
    seen = stored(anchors(known, s))
    # Written before they are joined: both sides then come by a shuffle of their own, which can be split at a hot anchor.
    counts = stored(seen.groupBy("anchor").count().where("count > 1"))
    wanted = seen.join(counts, "anchor").select("row", "start", "n", "at", "anchor", (F.col("count") > s.hot).alias("hot"))
    made = stored(pieces(known, wanted, n_keys, s))
    spans = stored(shards(made, n_keys, s))
    placed = made.where("anchor IS NOT NULL").select("row", "start", "digest_a", "digest_b")
    plain = placed.join(spans, ["digest_a", "digest_b"]).select("row", "start", "spans")
    hot = by_key(made.where("key IS NOT NULL").select(*schema_of(PACKED).names), n_keys, more_than_one)
    both = plain.unionByName(hot, allowMissingColumns=True)
    return both.groupBy("row").agg(F.collect_list(F.struct("start", "spans", "places")).alias("spans"))


def more_than_one(doc: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Entries whose digest occurs again."""
    order = np.lexsort((high, low))
    new = np.concatenate([[True], (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1])])
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([start, [len(order)]]))
    hit = np.zeros(len(low), bool)
    hit[order] = np.repeat(size > 1, size)
    return hit


def removed_bytes(n: int, spans: list[dict], length: int) -> np.ndarray:
    """Whether each of n bytes is covered by a repeated window."""
    packed = [x for x in spans if x["spans"] is not None]
    pairs = np.frombuffer(b"".join(x["spans"] for x in packed), "<i4").reshape(-1, 2)
    windows = pairs + np.repeat([x["start"] for x in packed], [len(x["spans"]) // 8 for x in packed]).astype(np.int64)[:, None]
    places = [from_planes(x["places"]) for x in spans if x["places"] is not None]
    cover = np.zeros(n + 1, np.int64)
    for first, last in [(windows[:, 0], windows[:, 1] - 1), *((p, p) for p in places)]:
        np.add.at(cover, first, 1)
        np.add.at(cover, last + length, -1)
    return np.cumsum(cover)[:n] > 0


def without_repeats(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): the bytes left of every row, and what went.

    A string that repeats inside its own document counts. Null texts are empty. Every row is a document of its own,
    whether it shares its doc_id with others or has none.
    """
    rows = numbered(docs)
    joined = rows.join(repeats(rows, s), "row", "left").select("doc_id", "text", "spans")

    def make():
        def run(cols):
            out = {"doc_id": cols["doc_id"], "kept": [], "n_bytes": [], "n_removed": [], "n_spans": []}
            for text, spans in zip(cols["text"], cols["spans"]):
                data, n_spans = (text or "").encode("utf-8"), 0
                kept = data
                if spans:
                    gone = removed_bytes(len(data), spans, s.length)
                    kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                    n_spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(gone) else 0
                for k, v in zip(("kept", "n_bytes", "n_removed", "n_spans"), (kept, len(data), len(data) - len(kept), n_spans)):
                    out[k].append(v)
            return out

        return run

    return map_batches(joined, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint", make)


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    kept = without_repeats(docs, s)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
