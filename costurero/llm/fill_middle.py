"""Fill-in-the-middle: documents cut into prefix, middle and suffix and put together in another order.

One fullmatch of `(unit)*` by the regex library keeps every repetition of its group, so `ends(1)` holds the end of every
unit: its length is the number of units, and two of its items are the cuts. Nothing steps through a text. Where to cut
and which form to take follow from a hash of the document's id, so a rerun after a lost executor gives the same rows.

Defined cases: a null text is an empty one and stays plain; so does a text that holds a mark or that units cannot tile
(then it counts no unit); a null id hashes as an empty one; every row is treated by itself, so repeated rows stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import map_batches, prepare

#: The marks of the contract, in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Settings:
    """`unit` is what is cut between (a pattern without groups; a code point by default).

    Of a hundred documents `transformed` change their form, and of a hundred of these `suffix_first` have the suffix first.
    `seed` stands in front of the id that is hashed.
    """

    unit: str = r"(?s:.)"
    transformed: int = 90
    suffix_first: int = 20
    seed: str = "1:"


def draws(doc_id: object, seed: str) -> list[int]:
    """The four numbers a document's choices rest on: 8-digit groups of the hash of its id."""
    import hashlib

    digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def cutter(s: Settings):
    """A function from (doc_id, text) to (units, form, prefix's and middle's code points, output)."""
    import regex

    whole = regex.compile(f"({s.unit})*")
    marked = regex.compile("|".join(map(regex.escape, (PREFIX, SUFFIX, MIDDLE))))

    def cut(doc_id: object, text: str):
        found = whole.fullmatch(text)
        ends = found.ends(1) if found else []
        n = len(ends)
        h1, h2, h3, h4 = draws(doc_id, s.seed)
        if not n or marked.search(text) or h3 % 100 >= s.transformed:
            return n, "plain", None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[k - 1] if k else 0 for k in (first, second))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if h4 % 100 < s.suffix_first:
            return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"

    return cut


def transform(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per document: `doc_id, n, form, prefix_chars, middle_chars, output`, the last the text to train on."""
    prepare(docs.sparkSession)
    columns = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def make():
        cut = cutter(s)

        def run(rows: dict[str, list]) -> dict[str, list]:
            out = [cut(d, t) for d, t in zip(rows["doc_id"], rows["text"])]
            return {"doc_id": rows["doc_id"]} | {c: [r[i] for r in out] for i, c in enumerate(columns)}

        return run

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return map_batches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), schema, make)


def restored(output: Column, form: Column) -> Column:
    """The text a document had, from what became of it: no text that was cut holds a mark."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )


def report(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of `transform` with digests of the output and of the text rebuilt from it."""
    output = F.col("output")
    return transform(docs, s).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(output, 256).alias("output_sha256"),
        F.sha2(restored(output, F.col("form")), 256).alias("restored_sha256"),
    )
