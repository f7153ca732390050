"""Fill-in-the-middle against plain slicing."""

from __future__ import annotations

import hashlib

import pytest

from costurero.llm import fill_middle as fim


def by_hand(doc_id, text):
    """The contract with slices of code points."""
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    text = text or ""
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
    return n, "psm", a, b - a, "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_cuts_equal_slices(documents, odd):
    texts = ["a", "\n", "<", "<P", "x<S>y", "<M>", "é\u0301\U0001f600\r\nz", "<<P<S>", "a<P", ">", "P>", "\x00b", "ab" * 40_000]
    rows = [(i * 100 + j, t) for i in range(40) for j, t in enumerate(texts)] + [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((str((d, *by_hand(d, t)[:4])), sha(by_hand(d, t)[4]), sha(t or "")) for d, t in rows)
    got = sorted((str(tuple(r)[:5]), r.output_sha256, r.restored_sha256) for r in fim.report(documents(rows)).collect())
    assert got == want
    assert {by_hand(d, t)[1] for d, t in rows} == {"plain", "psm", "spm"}


def test_other_units_are_never_cut(documents):
    docs = [(i, "One two  three, four.\nFive " * (i % 7)) for i in range(60)]
    found = fim.transform(documents(docs), fim.Settings(unit=r"\S*\s+|\S+"))
    texts = dict(docs)
    for r in found.collect():
        if r.form != "plain":
            for at in (r.prefix_chars, r.prefix_chars + r.middle_chars):
                assert at in (0, len(texts[r.doc_id])) or texts[r.doc_id][at - 1].isspace()
    untiled = fim.transform(documents([(1, "ab1"), (2, "ab")]), fim.Settings(unit="[a-z]", transformed=100)).collect()
    assert [(r.doc_id, r.n, r.form) for r in sorted(untiled)] == [(1, 0, "plain"), (2, 2, "psm" if untiled[1].form == "psm" else "spm")]


@pytest.mark.parametrize("name", ["report", "transform"])
def test_empty_table(documents, name):
    assert getattr(fim, name)(documents([(1, "a")]).where("false")).collect() == []
