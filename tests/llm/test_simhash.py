from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from costurero.llm import simhash
from costurero.llm.components import components


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    counts = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(runs))


def brute_roots(codes, differ):
    root = list(range(len(codes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if bin(codes[i] ^ codes[j]).count("1") <= differ:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(codes))]


def near_codes(n, seed):
    rng = random.Random(seed)
    codes = [rng.getrandbits(64) for _ in range(max(1, n // 4))]
    while len(codes) < n:
        codes.append(rng.choice(codes) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) << rng.randrange(64))
    return sorted(set(codes))


def rank(code):
    for n in (1, 2, 4, 8, 16, 32):
        code ^= code >> n
    return code


@pytest.mark.parametrize("n", [2, 9, 70, 400])
def test_index_finds_the_classes_of_brute_force(n):
    codes = sorted(near_codes(n, n), key=rank)
    want = brute_roots(codes, 2)
    got = simhash.GrayIndex(np.array(codes, np.uint64)).classes(2, at_once=256)
    assert len(set(zip(want, got.tolist()))) == len(set(want)) == len(set(got.tolist()))


def test_groups_of_long_masks_lose_no_link(spark):
    codes = near_codes(300, 5) + [1 << i | 1 << j for i in range(20) for j in range(i)]
    codes = sorted(set(codes))
    rows = spark.createDataFrame([(simhash.signed(c),) for c in codes], "fp bigint")
    want = brute_roots(codes, 2)
    for most in (4096, 3):
        edges = simhash.links(rows, 2, most)
        found = {r.node % (1 << 64): r.root % (1 << 64) for r in components(edges).collect()}
        got = [found.get(c, c) for c in codes]
        assert len(set(zip(want, got))) == len(set(want)) == len(set(got))


def test_masks_have_bounded_groups():
    masks = simhash.first_masks(2)
    for _ in range(2):
        masks = [y for m in masks for y in simhash.longer_masks(m, 2)]
    assert max(64 - bin(m).count("1") for m in masks) <= 15


def test_rows_and_fingerprints(documents, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    for r in found:
        texts = {t.text for t in odd.collect() if t.doc_id == r.doc_id}
        assert int(r.fingerprint, 16) in {brute_fingerprint(t) for t in texts}
    by_id = {r.doc_id: r.component_id for r in found}
    assert by_id[1] == by_id[2] == by_id[3] == 1  # wordless texts link like any other
    assert by_id[6] == 5 and by_id[4] == 4
    assert simhash.near_duplicates(odd.where("false")).count() == 0


def test_one_of_each_keeps_columns_and_rows_without_id(documents, odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 4, 5, 7] and ids.count(None) == 2


def test_rows_that_share_an_id_go_by_their_own_text(documents):
    like, unlike = "one two three four five six seven", "other words stand here and nothing of it is above"
    docs = documents([(1, like), (2, like), (2, unlike), (3, unlike), (None, like), (4, None), (5, None)])
    kept = simhash.one_of_each(docs).collect()
    assert sorted(str((r.doc_id, r.text)) for r in kept) == sorted(map(str, [(1, like), (2, unlike), (None, like), (4, None)]))


@pytest.mark.parametrize("seed", [1, 2])
def test_stage_keeps_the_smallest_of_each_component_of_brute_force(spark, documents, seed):
    rng = random.Random(seed)
    texts = []
    while len(texts) < 150:
        words = rng.choice(texts).split() if texts and rng.random() < 0.6 else [f"w{rng.randrange(900)}" for _ in range(rng.randrange(0, 400))]
        if words and rng.random() < 0.7:
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    roots = brute_roots([brute_fingerprint(t) for t in texts], 2)
    kept = corpus_pipeline.one_of_each_group(spark, documents(list(enumerate(texts))), "").collect()
    assert {r.doc_id for r in kept} == set(roots) and len(set(roots)) < 140


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3)], "v bigint, u bigint")
    found = {r.node: r.root for r in components(edges).collect()}
    assert found == {i: 0 for i in range(1, 61)} | {101: 100}
