from __future__ import annotations

import collections
import re

import pytest

from costurero.llm import pii


def test_given_names_stay_distinct(documents):
    men = [*pii.GIVEN["latin"]["m"], "Anna", "Mary", "Emma"]
    docs = documents([(i, f"Mr {name} Smith spoke") for i, name in enumerate(men)] + [(50 + i, f"{n} Smith") for i, n in enumerate(pii.GIVEN["latin"]["f"])])
    seen = pii.mentions(docs)
    for key in (b"k", b"l"):
        new = [r.text for r in pii.surrogates(docs, key).collect()]
        people = [" ".join(t.removeprefix("Mr ").split()[:2]) for t in new]
        assert len(set(people)) == len(men) + len(pii.GIVEN["latin"]["f"])
        assert all(pii.surrogate(r.kind, r.normal, key) != r.normal for r in seen.collect())


@pytest.mark.parametrize("name", ["Dvořák", "Dvor\u030ca\u0301k", "Żak", "McDonald", "O'Neil", "Smith-Jones", "Ђорђевић", "Παπαδόπουλος"])
def test_names_of_any_letters_are_replaced_whole(name):
    text = f"then Mr {name} spoke"
    new, found = pii.replaced(text, b"k", lambda k, n: 0)
    assert [e.text for e in found] == [name] and new.startswith("then Mr ") and new.endswith(" spoke")
    assert [e.text for e in pii.entities(f"Mr Łukasz {name}'s house")] == ["Łukasz", name]


@pytest.mark.parametrize("secret", ["ASIAQWERTYUIOPASDF", "pk_abcdefghijklmnopqrst", "ghp_abcdefghijklmnopqrst", "xoxb-abcdefghijklmnopqrst", "sk_abcdefghijklmnopqrst", "abcdef" * 6])
def test_secrets_without_digits_are_found(secret):
    assert [(e.kind, e.text) for e in pii.entities(f"here {secret} it is")] == [("secret", secret)]


def test_bare_mentions_of_a_found_name_are_replaced():
    text = "Mrs Lee is Anna Lee. Later Anna spoke to Lee. Lee's house, Lee-Ann, Leeds, Dr. Alice Jones and Prof. Bob Stone; Jones left. Mr Long ran, Long ago it was a long way."
    new, found = pii.replaced(text, b"k", lambda k, n: 0)
    assert collections.Counter(e.text for e in found) == {"Lee": 4, "Anna": 2, "Alice": 1, "Jones": 2, "Bob": 1, "Stone": 1, "Long": 1}
    for name in ("Lee", "Anna", "Alice", "Jones", "Bob", "Stone"):
        assert not re.search(rf"\b{name}\b(?!-)", new)
        assert len({pii.surrogate(e.kind, e.normal, b"k") for e in found if e.text == name}) == 1
    assert "Lee-Ann, Leeds" in new and ", Long ago" in new
    assert [e.kind for e in pii.entities("доктор Иванов, доктор Анна Иванова")] == ["family_n", "given_f", "family_f"]


def test_rows_without_id_get_the_draws_of_their_text(spark, documents):
    texts = [f"Mr Xo{chr(97 + i // 26)}{chr(97 + i % 26)} spoke" for i in range(600)]
    docs = documents([(None if i % 2 else 7, t) for i, t in enumerate(texts)] + [(None, texts[3]), (None, None), (1, "")])
    made = [r.text for r in pii.surrogates(docs, b"k").collect()]
    assert len(made) == 603 and made.count(None) == 1 and made.count("") == 1
    assert len(set(made) - {None, ""}) == 600 and not set(made) & set(texts)


def test_a_full_format_grows():
    """All 1,000 texts of three digits may be entities: after enough draws none needs to fit in three digits."""
    new = [pii.surrogate("phone", f"{i:03d}", b"k", pii.PATIENCE) for i in range(1000)]
    assert len(set(new)) == 1000 and {len(x) for x in new} == {4}
    assert pii.filled("1-2", "4567") == "456-7" and pii.filled("+1 22", "34") == "+1 34"
