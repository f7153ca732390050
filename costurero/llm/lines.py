"""Recurring lines by a log-template tree of fixed depth.

A line goes down the tree by its number of tokens and its leading tokens; tokens that hold a digit count as a
variable field. Below that a leaf branches by the tokens its lines share most, relative to each other, so the result
does not depend on how many documents there are; a template has the tokens most of its branch has, and the other places are
variable. Templates that recur across documents are dropped from all but the first of them.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import map_batches, prepare, stored

DIGIT = re.compile(rb"[0-9]")
FIELD = b"<*>"


@dataclass(frozen=True)
class Settings:
    """`leading` tokens below the token count make a leaf; a template recurs from `documents` documents on.

    Lines below five documents are as a rule copied text, which the operators for copies judge as a whole. A line has
    a template only with `alike` times its tokens in common with it. A line goes down `branches` branches of one place each.
    """

    leading: int = 3
    documents: int = 5
    alike: float = 0.5
    branches: int = 3


def masked(line: bytes) -> list[bytes]:
    """Tokens of a line, variable fields masked."""
    tokens = line.split()
    if DIGIT.search(line):
        tokens = [FIELD if DIGIT.search(t) else t for t in tokens]
    return tokens


def _hash(parts: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(parts), len(parts)) - (1 << 63)


def line_hash(tokens: list[bytes]) -> int:
    return _hash(tokens)


def leaf_hash(tokens: list[bytes], leading: int) -> int:
    return xxhash.xxh64_intdigest(b" ".join(tokens[:leading]), len(tokens)) - (1 << 63)


def parsed(docs: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, leaf, line) of each distinct masked line of each row; lines without a token have none."""

    def make():
        def run(cols):
            out = {"doc_id": [], "leaf": [], "line": [], "new_leaf": []}
            for doc, text in zip(cols["doc_id"], cols["text"]):
                seen, leaves = set(), set()
                for line in text.encode("utf-8").split(b"\n"):
                    tokens = masked(line)
                    if not tokens or (h := line_hash(tokens)) in seen:
                        continue
                    seen.add(h)
                    leaf = leaf_hash(tokens, settings.leading)
                    out["doc_id"].append(doc)
                    out["line"].append(h)
                    out["leaf"].append(leaf)
                    out["new_leaf"].append(leaf not in leaves)
                    leaves.add(leaf)
            return out

        return run

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return map_batches(rows, "doc_id bigint, leaf bigint, line bigint, new_leaf boolean", make)


def tokens_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(leaf, line, n, tokens) for `wanted` (doc_id, leaf, line, n), read from those documents; tokens are hashes."""
    per_doc = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("leaf", "line", "n")).alias("wanted"))
    joined = docs.where("text IS NOT NULL").select("doc_id", "text").join(per_doc, "doc_id")

    def make():
        def run(cols):
            out = {"leaf": [], "line": [], "n": [], "tokens": []}
            for text, wanted_ in zip(cols["text"], cols["wanted"]):
                need = {w["line"]: w for w in wanted_}
                for line in text.encode("utf-8").split(b"\n"):
                    tokens = masked(line)
                    if tokens and (w := need.pop(line_hash(tokens), None)):
                        out["leaf"].append(w["leaf"])
                        out["line"].append(w["line"])
                        out["n"].append(w["n"])
                        out["tokens"].append([_hash([t]) for t in tokens])
            return out

        return run

    return map_batches(joined, "leaf bigint, line bigint, n bigint, tokens array<bigint>", make)


def shared_places(lines: DataFrame, settings: Settings) -> DataFrame:
    """(leaf, line, n, need, places) of the lines that may be in a recurring template.

    `places` are the (weight, place, token) behind the leading tokens that as many documents of the leaf share as make a
    template recur, heaviest first; `need` is how many of them a template needs.
    """
    lead, at = settings.leading, ["leaf", "place", "token"]
    whole = F.size("tokens")
    need = (F.ceil(whole * settings.alike - 1e-9) - F.least(F.lit(lead), whole)).cast("int")
    lines = lines.withColumn("need", F.greatest(F.lit(0), need))
    spread = lines.where("need > 0").select("leaf", "line", "n", "need", F.posexplode("tokens").alias("place", "token")).where(F.col("place") >= lead)
    # Written before it meets the places: both then come by a shuffle of their own, which can be split at a hot place.
    weights = stored(spread.groupBy(*at).agg(F.sum("n").alias("weight")).where(F.col("weight") >= settings.documents))
    ranked = (
        spread.join(weights, at)
        .groupBy("leaf", "line", "n", "need")
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("weight"), "place", "token"))).alias("places"))
        .where(F.size("places") >= F.col("need"))
    )
    short = lines.where("need = 0").select("leaf", "line", "n", "need", F.lit(None).cast(ranked.schema["places"].dataType).alias("places"))
    return ranked.unionByName(short)


def matched(lines: DataFrame, settings: Settings) -> DataFrame:
    """(leaf, line, template): the templates each line of `shared_places` has.

    A leaf branches by what its lines share most: a line goes down the branches of its `branches` heaviest places, and
    the branch of as many of its heaviest places as a template needs. A branch's template has in each place the token
    of most documents, the smaller hash of equals; a line has it if enough places agree. A line so short that
    its leading tokens are enough has the leaf's.
    """
    rest = F.slice("places", 1, F.col("need"))
    single = F.transform(F.slice("places", 1, settings.branches), lambda x: F.xxhash64("leaf", x["place"], x["token"]))
    branches = F.concat(single, F.array(F.xxhash64("leaf", F.transform(rest, lambda x: F.struct(x["place"], x["token"])))))
    members = lines.where("need > 0").select("leaf", "line", "n", "need", "places", F.explode(F.array_distinct(branches)).alias("template"))
    spread = members.select("leaf", "line", "n", "need", "template", F.explode("places").alias("x")).select(
        "leaf", "line", "n", "need", "template", "x.place", "x.token"
    )
    counted = spread.groupBy("template", "place", "token").agg(F.sum("n").alias("n"))
    modes = stored(
        counted.groupBy("template", "place").agg(F.max_by("token", F.struct("n", (-F.col("token")).alias("t"))).alias("token"))
    )
    agree = spread.join(modes, ["template", "place", "token"]).groupBy("leaf", "line", "need", "template").agg(F.count("*").alias("same"))
    own = lines.where("need = 0").select("leaf", "line", F.col("leaf").alias("template"))
    return agree.where("same >= need").select("leaf", "line", "template").unionByName(own)


def recurring(occurrences: DataFrame, found: DataFrame, settings: Settings) -> DataFrame:
    """(template, first) of the templates that enough documents have; `first` is the smallest doc_id."""
    per_document = occurrences.select("doc_id", "line").join(found.select("line", "template"), "line")
    return (
        per_document.select("template", "doc_id")
        .distinct()
        .groupBy("template")
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
        .where(F.col("n") >= settings.documents)
        .select("template", "first")
    )


def templates(docs: DataFrame, rows: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """(doc_id, leaf, line) of the leaves that recur, and (leaf, line, template, first) of the recurring templates.

    What a round finds is taken out of its leaf, and the rest of the leaf branches anew, until a round finds nothing:
    small templates come to light behind large ones with which they share places. Weights are counts over documents and
    nothing depends on the order or the number of lines a task sees, so the result is one whatever the size of a leaf. A
    leaf is never in one task: equal lines are one row, and the rest are sums by place and token.
    """
    leaves = stored(
        rows.groupBy("leaf")
        .agg(F.sum(F.col("new_leaf").cast("bigint")).alias("n"))
        .where(F.col("n") >= settings.documents)
        .select("leaf")
    )
    occurrences = stored(rows.join(leaves, "leaf", "left_semi").select("doc_id", "leaf", "line"))
    wanted = occurrences.groupBy("leaf", "line").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rest = stored(tokens_of(docs, wanted).dropDuplicates(["line"]))
    known = None
    while True:
        shared = stored(shared_places(rest, settings))
        found = stored(matched(shared, settings))
        heads = stored(recurring(occurrences, found, settings))
        new = stored(found.join(heads, "template"))
        known = new if known is None else known.unionByName(new)
        if new.isEmpty():
            return occurrences, known
        # Leaves without a find would branch as before.
        rest = rest.join(new.select("leaf").distinct(), "leaf", "left_semi").join(new.select("line").distinct(), "line", "left_anti")
        rest = stored(rest)


def dropped(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, lines): for each document that loses lines, their hashes.

    A line goes if an earlier document has one of the same recurring template; the first document of all keeps its line.
    """
    prepare(docs.sparkSession)
    occurrences, known = templates(docs, stored(parsed(docs, settings)), settings)
    hits = occurrences.select("doc_id", "line").join(known.select("line", "first"), "line").where("doc_id <> first")
    return hits.groupBy("doc_id").agg(F.collect_set("line").alias("lines"))


def without(text: str | None, lines: list[int] | None) -> tuple[str | None, int, int]:
    """The text without the lines of these hashes, its number of lines and how many went."""
    if not text:
        return text, 0, 0
    parts = text.split("\n")
    if not lines:
        return text, len(parts), 0
    gone = set(lines)
    kept = [p for p in parts if not (tokens := masked(p.encode("utf-8"))) or line_hash(tokens) not in gone]
    return "\n".join(kept), len(parts), len(parts) - len(kept)


def cleaned(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents, with all their columns, without recurring lines; `n_chars`, if there, follows the text.

    The document with the smallest doc_id keeps a template's lines, all others lose them; a document may end up
    empty and still stays. Null texts stay null. Rows without doc_id stay unchanged and are not counted. Rows that
    share a doc_id are one document.
    """
    gone = dropped(docs, settings).select(F.col("doc_id").alias("_doc"), F.col("lines").alias("_lines"))
    joined = docs.join(gone, docs["doc_id"] == gone["_doc"], "left").drop("_doc")
    places = {c: i for i, c in enumerate(docs.columns)}

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            made = [without(t, k)[0] for t, k in zip(columns[places["text"]].to_pylist(), batch.columns[-1].to_pylist())]
            columns[places["text"]] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def report(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row; a null text has no line and the empty text's digest."""
    gone = dropped(docs, settings)
    joined = docs.select("doc_id", "text").join(gone, "doc_id", "left")

    def make():
        def run(cols):
            made = [without(t, k) for t, k in zip(cols["text"], cols["lines"])]
            return {
                "doc_id": cols["doc_id"],
                "n_lines": [m[1] for m in made],
                "n_dropped": [m[2] for m in made],
                "kept_sha256": [hashlib.sha256((m[0] or "").encode("utf-8")).hexdigest() for m in made],
            }

        return run

    return map_batches(joined, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string", make)
