from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest

from costurero.llm import bytes_dedup, lines, passages, suffix


def soup(seed, n=60):
    """Documents over few words, with copied passages of all lengths and places."""
    rng = random.Random(seed)
    vocabulary = ["ab", "cé", "d", "efg", "h1", "ij"]
    docs = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 60))]
        if docs and rng.random() < 0.6:
            other = rng.choice(docs)[1].split()
            a = rng.randrange(0, max(1, len(other)))
            words[len(words) // 2 : len(words) // 2] = other[a : a + rng.randrange(1, 40)]
        if rng.random() < 0.1:
            words = words[:3] * 12
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return docs


@pytest.mark.parametrize("window", [6, 11])
def test_passages_match_brute_force(documents, window):
    docs = soup(window)
    first, words = {}, {}
    for i, t in docs:
        w = words[i] = re.findall(r"[^\x20\x09-\x0D]+", t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    s = passages.Settings(window=window, bucket=500, batch=100)
    got = {r.doc_id: r for r in passages.report(documents(docs), s).collect()}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        assert (got[i].n_words, got[i].n_removed) == (len(w), sum(gone))
        assert got[i].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()


def test_passages_of_odd_rows(documents, odd):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in passages.report(odd).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0), (2, 0, 0), (3, 0, 0), (None, 4, 0), (4, 4, 0), (4, 4, 0), (5, 60000, 0), (6, 60000, 60000), (None, 0, 0), (7, 2, 0)], key=str)
    assert passages.report(odd.where("false")).count() == 0


def shared_ids(seed):
    """Texts of `soup` under few ids, some of them null: rows share an id with texts of other lengths."""
    rng = random.Random(seed)
    ids = [None, 1, 1, 2, 2, 2, 3, 5, 8]
    rows = [(rng.choice(ids), t) for _, t in soup(seed, 40)]
    a, b, c = ("w " * 200).strip(), " ".join(f"v{i}" for i in range(200)), " ".join(f"u{i}" for i in range(60))
    return rows + [(1, a), (2, c), (2, a), (2, c + " " + a), (9, a), (9, b), (4, a), (4, None), (None, a), (None, b)]


@pytest.mark.parametrize("window", [6, 50])
def test_passages_of_rows_that_share_an_id(documents, window):
    docs = shared_ids(window)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words):
        for k in range(len(w) - window + 1) if i is not None else ():
            first[tuple(w[k : k + window])] = min(first.get(tuple(w[k : k + window]), i), i)
    want = []
    for (i, _), w in zip(docs, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(a for a, g in zip(w, gone) if not g)
        want.append(str((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())))
    got = passages.report(documents(docs), passages.Settings(window=window, bucket=500, batch=100)).collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(want)
    assert window != 50 or any("200, 0" in w for w in want)


@pytest.mark.parametrize("hot", [2000, 2])
def test_bytes_of_rows_that_share_an_id(documents, hot):
    docs, length = shared_ids(8), 24
    counts = collections.Counter(b[k : k + length] for _, t in docs for b in [(t or "").encode()] for k in range(len(b) - length + 1))
    want = []
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want.append(str((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())))
    s = bytes_dedup.Settings(length=length, gram=6, shard=400, hot=hot, batch=600, bucket=700)
    assert sorted(str(tuple(r)) for r in bytes_dedup.report(documents(docs), s).collect()) == sorted(want)


def test_suffix_array_and_prefixes():
    rng = random.Random(4)
    for t in range(250):
        data = bytes(rng.choice(b"abcdef"[: rng.choice([1, 2, 6])]) for _ in range(rng.randrange(1, 70)))
        data = data[: rng.randrange(1, 9)] * rng.randrange(1, 9) if t % 3 == 0 else data
        n = len(data)
        want = sorted(range(n), key=lambda i: data[i:])
        order = suffix.suffix_array(data)
        assert order.tolist() == want
        cut = rng.randrange(1, n + 1)
        room = np.array([cut - i if i < cut else n - i for i in range(n)])
        got = suffix.common_prefixes(data, order, room)
        for a, b in zip(want, want[1:]):
            k = 0
            while a + k < n and b + k < n and k < room[b] and data[a + k] == data[b + k]:
                k += 1
            assert got[b] == k


def test_suffix_array_of_names(monkeypatch):
    data = b"abracadabra" * 7
    monkeypatch.setattr(suffix, "FEW", 2)
    assert suffix.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_suffix_array_of_many_symbols():
    rng = np.random.default_rng(6)
    for part in (rng.integers(1, 4000, 3000), rng.integers(1500, 1503, 3000), np.full(2500, 7)):
        text = np.concatenate([part, part[:900], [0]])
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix.sort_suffixes(text, 4000).tolist() == want


def test_only_segments_with_a_shared_core_are_sorted(monkeypatch):
    rng, s = random.Random(9), bytes_dedup.Settings()
    sorted_ = []
    inner = bytes_dedup.repeated_runs
    monkeypatch.setattr(bytes_dedup, "repeated_runs", lambda bodies, n: sorted_.extend(bodies) or inner(bodies, n))

    def noise(n):
        return bytes(rng.choices(b"abcdefgh ", k=n))

    anchor, long = noise(s.gram), noise(500)
    group = {}
    for k in range(40):  # these share their anchor alone
        group[k, 0] = [noise(200) + anchor + noise(300), 133, 200, 1]
    for k, (before, after) in enumerate([(30, 20), (10, 60), (0, 0)]):  # these 532 bytes in the middle
        body = noise(before) + long[:250] + anchor + long[250:] + noise(after)
        group[k, 1] = [body, len(body) - 399, before + 250, 1]
    for size in (399, 400):  # these one byte less than a window, or one window
        shared = anchor + noise(size - len(anchor))
        for edge in (b"A", b"B"):
            group[size, edge[0]] = [(edge + shared + edge)[:401], 2, 1, 1]
    found = bytes_dedup.repeated_windows([group], s)
    counts = collections.Counter(b[i : i + 400] for b, *_ in group.values() for i in range(len(b) - 399))
    want = {d: [i for i in range(x[1]) if counts[x[0][i : i + 400]] > 1] for d, x in group.items()}
    got = {d: [i for a, b in found.get(d, []) for i in range(a, b)] for d in group}
    assert got == want and want[399, 65] == [] and want[400, 65] == [1] and sum(map(len, want.values())) > 300
    assert len(sorted_) == 7


@pytest.mark.parametrize("hot", [2000, 2])
def test_bytes_match_brute_force(documents, hot):
    docs, length = soup(8), 24
    s = bytes_dedup.Settings(length=length, gram=6, shard=400, hot=hot, batch=600, bucket=700)
    counts = collections.Counter(b[k : k + length] for _, t in docs for b in [t.encode()] for k in range(len(b) - length + 1))
    got = {r.doc_id: r for r in bytes_dedup.report(documents(docs), s).collect()}
    for i, t in docs:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if counts[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_bytes_of_odd_rows(documents, odd):
    got = {(r.doc_id, r.n_bytes > 400): r.n_removed for r in bytes_dedup.report(odd).collect()}
    assert got[5, True] == got[6, True] > 0 and got[1, False] == got[None, False] == 0
    assert bytes_dedup.report(documents([(None, "x" * 300 + "y" * 200), (1, "x" * 300 + "y" * 200)])).where("n_removed = 500").count() == 2
    assert bytes_dedup.report(odd.where("false")).count() == 0


def test_lines_drop_templates_but_for_the_first(documents):
    docs = [(i, f"Only here {chr(97 + i) * 3} one thing\nOrder {i} was shipped to you\nThank you for reading") for i in range(8)]
    docs.append((20, "Order x9 was shipped to you\n\nrest of it"))
    got = {r.doc_id: r.text for r in lines.cleaned(documents(docs)).collect()}
    assert got[0] == docs[0][1]
    assert all(got[i] == docs[i][1].split("\n")[0] for i in range(1, 8))
    assert got[20] == "\nrest of it"
    wide = lines.cleaned(documents(docs))
    assert all(r.n_chars == len(r.text) for r in wide.collect()) and wide.columns == documents(docs).columns


def test_variable_words_are_generalised(documents):
    names = ["ann", "bob", "cid", "dan", "eve", "fay"]
    docs = [(i, f"User logged in as {n} from home\nsomething else entirely {n} {n}") for i, n in enumerate(names)]
    got = {r.doc_id: r.text for r in lines.cleaned(documents(docs)).collect()}
    assert got[0] == docs[0][1] and all("logged" not in got[i] for i in range(1, 6))


def test_rare_lines_and_odd_rows_stay(documents, odd):
    few = documents([(i, f"the same line here\nown {i * 'x'} text") for i in range(4)])
    assert {r.n_dropped for r in lines.report(few).collect()} == {0}
    got = [(r.doc_id, r.n_dropped) for r in lines.report(odd).collect()]
    assert len(got) == 10 and all(n == 0 for _, n in got)
    kept = sorted(str(r.text) for r in lines.cleaned(odd).collect())
    assert kept == sorted(str(r.text) for r in odd.collect())
    assert lines.cleaned(odd.where("false")).count() == 0


@pytest.mark.parametrize("n", [200, 5000])
def test_templates_do_not_depend_on_the_number_of_documents(documents, n):
    rng = random.Random(1)
    word = lambda kind, k: kind + chr(97 + k // 10) + chr(97 + k % 10)
    docs = [
        (i, f"This story was written by {word('n', rng.randrange(100))} for {word('c', rng.randrange(100))} readers\n"
            f"This story was first shown in {word('t', rng.randrange(100))} last year\n"
            f"own {word('x', i % 100)} {word('y', i // 100)} text of this document alone")
        for i in range(n)
    ]
    got = {r.doc_id: r.text for r in lines.cleaned(documents(docs)).collect()}
    assert got[0] == docs[0][1]
    assert all(got[i] == docs[i][1].split("\n")[2] for i in range(1, n))


def brute_force_of_templates(docs, leading=3, documents=5, alike=0.5, branches=3):
    """Lines each document loses: leaves, weights, branches and modes by dictionaries."""
    per_doc = {d: {tuple(k) for x in text.split("\n") if (k := lines.masked(x.encode()))} for d, text in docs}
    number = collections.Counter(k for own in per_doc.values() for k in own)
    rest, first_of = set(number), collections.defaultdict(set)
    while rest:
        weight = collections.Counter()
        for k in rest:
            for p in range(leading, len(k)):
                weight[len(k), k[:leading], p, k[p]] += number[k]
        branch = collections.defaultdict(dict)
        for k in rest:
            leaf, need = (len(k), k[:leading]), max(0, -(-len(k) // 2) - leading)
            ranked = sorted((-weight[*leaf, p, k[p]], p, lines._hash([k[p]])) for p in range(leading, len(k)) if weight[*leaf, p, k[p]] >= documents)
            if not need:
                branch[leaf][k] = [], 0
            elif len(ranked) >= need:
                places = [x[1:] for x in ranked]
                for key in {*((leaf, x) for x in places[:branches]), (leaf, tuple(places[:need]))}:
                    branch[key][k] = places, need
        gone = set()
        for members in branch.values():
            seen = collections.Counter(x for k, (places, _) in members.items() for x in places for _ in range(number[k]))
            mode = {p: min((-n, t) for (q, t), n in seen.items() if q == p)[1] for p in {p for p, _ in seen}}
            hit = {k for k, (places, need) in members.items() if sum(mode[p] == t for p, t in places) >= need}
            having = [d for d, own in per_doc.items() if own & hit]
            if len(having) >= documents:
                gone |= hit
                for k in hit:
                    first_of[k].add(min(having))
        if not gone:
            break
        rest -= gone
    return {d: sum(any(f != d for f in first_of[k]) for x in text.split("\n") if (k := tuple(lines.masked(x.encode())))) for d, text in docs}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_are_those_of_brute_force(documents, seed):
    rng = random.Random(seed)
    pick = lambda k: chr(97 + rng.randrange(k)) * 2
    docs = []
    for i in range(120):
        own = [" ".join(["a", "b", "c", *(pick(3 + 5 * (seed > 1)) for _ in range(rng.choice([3, 6, 9])))]) for _ in range(6)]
        own.append(f"a b c one two three {pick(20)} {pick(20)} four five {pick(4)} end")
        docs.append((i, "\n".join(own)))
    expected = brute_force_of_templates(docs)
    assert {r.doc_id: r.n_dropped for r in lines.report(documents(docs)).collect()} == expected
    assert sum(expected.values()) > 100


def test_templates_do_not_depend_on_partitions_or_order(spark, documents):
    rng = random.Random(4)
    docs = [(i, "\n".join(" ".join(["x", "y", "z", *(chr(97 + rng.randrange(12)) for _ in range(5))]) for _ in range(5))) for i in range(400)]
    found = set()
    for n in (1, 7, 61):
        rng.shuffle(docs)
        found.add(tuple(sorted((r.doc_id, r.n_dropped, r.kept_sha256) for r in lines.report(documents(docs).repartition(n)).collect())))
    assert len(found) == 1


def test_edited_copies_of_a_line_share_a_template(documents):
    words = [f"{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    docs = [(i, " ".join(w if p < 3 or p != 3 + i % 60 else "qq" + chr(97 + i % 26) for p, w in enumerate(words))) for i in range(100)]
    got = {r.doc_id: r.n_dropped for r in lines.report(documents(docs)).collect()}
    assert got == {i: int(i > 0) for i in range(100)}


def test_small_templates_stand_beside_large_ones(documents):
    docs = [(i, f"the new shop was open at noon and {'n' + chr(97 + i % 26)} came in") for i in range(60)]
    docs += [(60 + i, f"the new shop was shut by storms that hit {'n' + chr(97 + i)} hard today"[:999]) for i in range(8)]
    docs += [(70 + i, f"the new shop was sold for gold to {'n' + chr(97 + i)} last year") for i in range(8)]
    got = {r.doc_id: r.n_dropped for r in lines.report(documents(docs)).collect()}
    assert [d for d, n in sorted(got.items()) if not n] == [0, 60, 70]
