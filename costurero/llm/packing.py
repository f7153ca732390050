"""Token sequences of fixed length by bounded-space online packing.

Each task keeps a fixed number of open windows. A document's full windows go out at once; its rest is placed where
it fits best. If it fits nowhere, the fullest window is topped up with the rest's first tokens and emitted, and what
remains opens a window. What is still open at the end of a task is merged in a second job, over groups of tasks;
only there sequences shorter than the window arise, cut to powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import prepare, stored

END = 1
#: White space, for Arrow's expressions, whose own \s is ASCII's.
BLANK = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"
CUT = re.compile(r" (?=\S)")
LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORD = f"^ ?[{LATIN}]+$"
#: ASCII's punctuation but the apostrophe, which the tokenizer keeps with some letters behind it.
PARTS = rf"^(?P<word>[{LATIN}]+)(?P<stops>[!-&(-/:-@\[-`{{-~]*)$"
#: Byte-level vocabularies show each byte as a letter: printable ones as themselves, the others from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SHOWN = {b: chr(256 + n) for n, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
SIGNS = [SHOWN.get(b, chr(b)).encode("utf-8") for b in range(256)]
SIGN_BYTES = np.frombuffer(b"".join(SIGNS), np.uint8)
SIGN_SIZES = np.array([len(s) for s in SIGNS])
#: The tag of a task's leftover windows in the table of pieces.
OPEN = -1

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary, task int"
RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@dataclass(frozen=True)
class Settings:
    """`windows` open at a time in a task; `tasks` of the first job whose leftovers one task of the second merges.

    A merging task holds at most windows * tasks windows. `cached` bounds the strings whose tokens a task remembers
    from batch to batch.
    """

    size: int = 2048
    windows: int = 32
    tasks: int = 256
    cached: int = 600_000
    tokenizer: str = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def chosen(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries numbered `which` end to end, and their sizes; in `ids` entries of `sizes` lie end to end."""
    size = sizes[which]
    at = np.repeat((np.cumsum(sizes) - sizes)[which] - (np.cumsum(size) - size), size)
    at += np.arange(len(at))
    return ids[at], size


def as_shown(words: list[str]) -> list[str]:
    """Words without a line end as the vocabulary shows their bytes."""
    data = np.frombuffer("\n".join(words).encode("utf-8"), np.uint8)
    return chosen(SIGN_BYTES, SIGN_SIZES, data)[0].tobytes().decode("utf-8").split(SHOWN[10]) if words else []


class Encoder:
    """Token ids of texts as little-endian 32-bit numbers.

    Byte-level BPE tokenises each run between a blank and the next by itself, and a line end apart from what is on
    both sides, as long as no three characters of white space meet and no two are before a special token or the end.
    So the texts of a batch are cut at blanks and before line ends, each run that occurs is one row of a table however
    often it does, and only the table's strings are tokenised: a Latin word apart from the stops behind it, any other
    run whole. Strings are remembered over batches, up to a bound. The other texts are cut at each blank before a run,
    or not at all if they have special tokens.
    """

    def __init__(self, name: str, cached: int):
        # A task has one core: the library's own threads would only wait for each other.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ends = "|".join(["$", *map(re.escape, self.special)])
        self.odd = f"{BLANK}{{3}}|{BLANK}{{2}}({ends})"
        self.cached = cached
        self.known: dict[str, bytes] = {}

    def learned(self, strings: list[str]) -> list[bytes]:
        """Ids of strings not met before; a Latin word has no need to be cut by the tokenizer first."""
        latin = pc.match_substring_regex(pa.array(strings, pa.string()), WORD).to_pylist()
        words = as_shown([s for s, is_word in zip(strings, latin) if is_word])
        others = [s for s, is_word in zip(strings, latin) if not is_word]
        by_model = iter([packed([t.id for t in self.model.tokenize(w)]) for w in words])
        whole = iter([packed(e.ids) for e in self.tokenizer.encode_batch_fast(others, add_special_tokens=False)])
        return [next(by_model if is_word else whole) for is_word in latin]

    def ids_of(self, strings: list[str]) -> list[bytes]:
        """Ids of each string, tokenised by itself; new ones are learned together."""
        if len(self.known) > self.cached:
            self.known.clear()
        found = list(map(self.known.get, strings))
        new = [s for s, ids in zip(strings, found) if ids is None]
        if not new:
            return found
        learned = self.learned(new)
        self.known.update(zip(new, learned))
        rest = iter(learned)
        return [next(rest) if ids is None else ids for ids in found]

    def encode_odd(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *rest = CUT.split(text)
        runs = [first, *[" " + r for r in rest]]
        different = list(dict.fromkeys(runs))
        ids = dict(zip(different, self.ids_of(different)))
        return b"".join([ids[r] for r in runs])

    def encode_plain(self, texts: pa.Array) -> list[bytes]:
        # The line end set before each text, so that its first run has no blank, is taken off its ids again.
        cut = pc.split_pattern(pc.binary_join_element_wise("\n", pc.replace_substring(texts, "\n", " \n"), ""), " ")
        runs = cut.values.dictionary_encode()
        ends_line = pc.starts_with(runs.dictionary, "\n")
        rest = pc.replace_substring(runs.dictionary, "\n", "")
        parts = pc.extract_regex(rest, PARTS)
        is_word = parts.is_valid()
        word = pc.if_else(is_word, pc.struct_field(parts, "word"), rest)
        word = pc.binary_join_element_wise(pc.if_else(ends_line, "", " "), word, "").dictionary_encode()
        stops = pc.if_else(is_word, pc.struct_field(parts, "stops"), "").dictionary_encode()

        strings = ["", "\n", *word.dictionary.to_pylist(), *stops.dictionary.to_pylist()]
        found = self.ids_of(strings)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        # A run is a line end or nothing, a word, and stops or nothing.
        units = np.empty((len(runs.dictionary), 3), np.int64)
        units[:, 0] = ends_line.to_numpy(zero_copy_only=False)
        units[:, 1] = word.indices.to_numpy() + 2
        units[:, 2] = stops.indices.to_numpy() + 2 + len(word.dictionary)
        ids, sizes = chosen(np.frombuffer(b"".join(found), "<u4"), sizes, units.reshape(-1))
        ids, sizes = chosen(ids, sizes.reshape(-1, 3).sum(axis=1), runs.indices.to_numpy())

        ends = 4 * np.concatenate([[0], np.cumsum(sizes)])[cut.offsets.to_numpy()]
        data = ids.tobytes()
        return [data[a + 4 : b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a column; a null has none."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd)
        plain = iter(self.encode_plain(texts.filter(pc.invert(odd))))
        others = iter(texts.filter(odd).to_pylist())
        return [self.encode_odd(next(others)) if is_odd else next(plain) for is_odd in odd.to_pylist()]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0]


class Bins:
    """Open windows of one task. A window is a list of pieces (doc_id, start, ids, doc_tokens)."""

    def __init__(self, settings: Settings):
        self.settings = settings
        self.free: list[tuple[int, int]] = []  # (free places, window), ascending
        self.open: dict[int, list] = {}
        self.next = 0
        self.full: list[list] = []

    def put(self, piece: tuple[int | None, int, bytes, int]) -> None:
        """Place a piece shorter than a window: best fit, else top up and emit the fullest."""
        size = self.settings.size
        while True:
            n = len(piece[2]) // 4
            at = bisect_right(self.free, (n, -1))
            if at < len(self.free):
                room, window = self.free.pop(at)
                self.open[window].append(piece)
                self.close(window, room - n)
                return
            if len(self.free) < self.settings.windows:
                self.open[self.next] = [piece]
                self.close(self.next, size - n)
                self.next += 1
                return
            room, window = self.free.pop(0)
            doc, start, ids, total = piece
            self.open[window].append((doc, start, ids[: 4 * room], total))
            self.close(window, 0)
            piece = (doc, start + room, ids[4 * room :], total)

    def close(self, window: int, room: int) -> None:
        if room:
            insort(self.free, (room, window))
        else:
            self.full.append(self.open.pop(window))


def rows(window: list, sequence: int, offset: int = 0) -> Iterator[tuple]:
    for doc, start, ids, total in window:
        yield doc, start, len(ids) // 4, zlib.crc32(ids), total, sequence, offset, None, OPEN
        offset += len(ids) // 4


def as_batch(made: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*made)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def first_job(docs: DataFrame, settings: Settings) -> DataFrame:
    """Pieces of emitted sequences, and the pieces still open with their ids and task."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PIECES))
    end = END.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, bins, sequence = Encoder(settings.tokenizer, settings.cached), Bins(settings), task << 32
        step = 4 * settings.size
        for batch in batches:
            made = []
            docs_of, texts = batch.columns
            for doc, ids in zip(docs_of.to_pylist(), encoder.encode_all(texts)):
                ids += end
                total = len(ids) // 4
                whole = len(ids) // step * step
                for at in range(0, whole, step):
                    made.extend(rows([(doc, at // 4, ids[at : at + step], total)], sequence))
                    sequence += 1
                if whole < len(ids):
                    bins.put((doc, whole // 4, ids[whole:], total))
            for window in bins.full:
                made.extend(rows(window, sequence))
                sequence += 1
            bins.full = []
            yield as_batch(made, schema)
        left = [(d, s, len(i) // 4, zlib.crc32(i), n, OPEN, 0, i, task) for w in bins.open.values() for d, s, i, n in w]
        yield as_batch(left, schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def merged(left: DataFrame, settings: Settings) -> DataFrame:
    """Leftover pieces in the order of their tasks, laid end to end and cut to full windows, then powers of two."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PIECES))
    group = (F.col("task") / settings.tasks).cast("int")

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)).sort_by([("task", "ascending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        total = sum(held["length"].to_pylist())
        # Lengths of the sequences: full windows, then the powers of two of what is over.
        sizes = [settings.size] * (total // settings.size)
        sizes += [1 << b for b in reversed(range(settings.size.bit_length())) if total % settings.size >> b & 1]
        sequence, room, offset, made = (1 << 62) + (key[0].as_py() << 32), 0, 0, []
        todo = iter(sizes)
        room = next(todo, 0)
        for doc, start, ids, count in zip(*[held[c].to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]):
            while ids:
                part = ids[: 4 * room]
                made.extend(rows([(doc, start, part, count)], sequence, offset))
                n = len(part) // 4
                start, ids, room, offset = start + n, ids[4 * n :], room - n, offset + n
                if not room:
                    sequence, room, offset = sequence + 1, next(todo, 0), 0
        yield as_batch(made, schema)

    return left.withColumn("merge_group", group).groupBy("merge_group").applyInArrow(merge_columns(merge), PIECES)


def merge_columns(merge):
    """applyInArrow hands over tables; the key is its first argument."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(merge(key, table.to_batches())))

    return run


def pack(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, and the checksum of its ids.

    Every row of `docs` is a document, also if doc_id repeats or is null; a null or empty text has the end id alone.
    No column but doc_id and text is read. An empty table gives no piece.
    """
    prepare(docs.sparkSession)
    # Written once: the leftovers and the emitted pieces must come from the same run of each task.
    pieces = stored(first_job(docs, settings))
    done = pieces.where(F.col("task") == OPEN)
    return done.select(RESULT).unionAll(merged(pieces.where(F.col("task") != OPEN), settings).select(RESULT))
