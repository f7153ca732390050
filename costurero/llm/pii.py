"""Personal data replaced by surrogates.

Addresses, numbers, secrets and names are found by patterns and given replacements of their own kind: an address
becomes an address, a card number keeps its length, first digit and checksum, a name keeps its script and gender. Where
a name was found, the document's other mentions of the same words are mentions of it too. A
replacement follows from a secret key and the normal form of what it replaces, so every mention of one entity, in any
document and spelling, gets the same. Numbers and identifiers go through keyed permutations of their own format, names
through keyed word lists and syllables. A check over all entities finds replacements that two entities share or that
are themselves entities of the corpus; all but the first such entity draw again, until none is left. Entities that find
no free place in their format for long draw from a wider one.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import itertools
import re
import sys
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costurero.llm.common import map_batches, prepare, stored

# Forms of address by gender, and given names by script and gender.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа"],
    "n": ["Dr", "Prof", "Professor", "доктор", "профессор"],
}
GIVEN = {
    "latin": {
        "m": ["James", "John", "Robert", "Michael", "David", "Thomas", "Peter", "Paul", "Hans", "Karl", "Pierre", "Jean", "Louis", "Carlos", "Juan", "Pedro"],
        "f": ["Mary", "Anna", "Linda", "Susan", "Sarah", "Laura", "Julia", "Emma", "Greta", "Ursula", "Marie", "Claire", "Sophie", "Carmen", "Lucia", "Elena"],
    },
    "cyrillic": {
        "m": ["Иван", "Пётр", "Сергей", "Алексей", "Дмитрий", "Николай", "Андрей", "Михаил"],
        "f": ["Анна", "Мария", "Елена", "Ольга", "Наталья", "Татьяна", "Ирина", "Светлана"],
    },
}
SYLLABLES = {"latin": "ba be bo da de do fa ga ha ka ke la le lo ma me mo na ne no pa ra re ro sa se ta te va vo".split(), "cyrillic": "ба бе во га да де за ка ко ла ле ма ме на но па ра ре са се та те".split()}
CYRILLIC_END = {"m": "ов", "f": "ова", "n": "енко"}
# End of the fixed values.

GENDER = {name: (script, sex) for script, by in GIVEN.items() for sex, names in by.items() for name in names}
TITLE_SEX = {t: sex for sex, ts in TITLES.items() for t in ts}


def letters(*categories: str) -> str:
    """The ranges of a character class of all characters of these Unicode categories."""
    out, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i)) in categories
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(out)


UPPER, LOWER, OTHER_LETTERS = letters("Lu", "Lt"), letters("Ll"), letters("Lm", "Lo", "Mn", "Mc")
#: A capital and at least one small letter, capitals inside as in McDonald, a prefix as in O'Neil, parts joined by
#: hyphens; a word ends where no letter, mark or digit follows.
PART = f"[{UPPER}][{UPPER}{OTHER_LETTERS}]*[{LOWER}][{UPPER}{LOWER}{OTHER_LETTERS}]*"
WORD = rf"(?:[{UPPER}]['’])?{PART}(?:-{PART})*(?![\w{OTHER_LETTERS}])"
TRIGGER = re.compile("[0-9@=:]|AKIA|ASIA|(?:sk|pk|ghp|xoxb)[-_]|[a-f]{32}")
EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9](?:[\w.%+-]*\w)?@[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}", re.ASCII)
SECRET = re.compile(
    r"(?i:(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)([A-Za-z0-9_\-+/]{6,})"
    r"|(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{12,20}|(?:sk|pk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,})(?![A-Za-z0-9])"
    r"|(?<![A-Za-z0-9])([0-9a-f]{32,})(?![A-Za-z0-9])"
)
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)", re.ASCII)
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", re.ASCII)
CARD = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])", re.ASCII)
TAX = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.ASCII)
PHONE = re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w-])|(?<!\w)\+\d{8,15}(?!\d)", re.ASCII)
CAPITALISED = re.compile(rf"(?<![\w{OTHER_LETTERS}'’-]){WORD}")
SMALL = re.compile(rf"(?<![\w{OTHER_LETTERS}])[{LOWER}][{LOWER}{OTHER_LETTERS}'’-]*")
#: Tasks among which copies of one text are dealt.
SALTS = 32
#: Draws after which an entity whose format is full or nearly so gets a longer surrogate, once more after as many again.
PATIENCE = 24
NAME = re.compile(rf"\b(?:({'|'.join(sorted(TITLE_SEX, key=len, reverse=True))})\.? ({WORD}(?: {WORD})?)|((?:{'|'.join(GENDER)}) {WORD}))")


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    text: str
    normal: str


# ---------------------------------------------------------------- detection


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def normal_phone(text: str) -> str:
    """Digits; a leading country code 1 of ten further digits does not count."""
    d = digits(text)
    return d[1:] if len(d) == 11 and d[0] == "1" else d


def entities(text: str | None) -> list[Entity]:
    """Entities from left to right without overlaps; of overlapping ones the first kind of this list wins.

    A word found as a name is one wherever the text has it, as it was first found, unless the text also has it in small
    letters: then it is an ordinary word too, and only the mentions with a title or given name count.
    """
    if not text:
        return []
    found: list[Entity] = []

    def add(kind: str, start: int, end: int, normal: str) -> None:
        at = bisect.bisect_left(found, start, key=lambda e: e.start)
        if (at == 0 or found[at - 1].end <= start) and (at == len(found) or end <= found[at].start):
            found.insert(at, Entity(kind, start, end, text[start:end], normal))

    if TRIGGER.search(text):
        if "@" in text:
            for m in EMAIL.finditer(text):
                add("email", m.start(), m.end(), m.group().lower())
        for m in SECRET.finditer(text):
            group = m.lastindex
            add("secret", m.start(group), m.end(group), m.group(group))
        for m in IP.finditer(text):
            add("ip", m.start(), m.end(), ".".join(str(int(x)) for x in m.group().split(".")))
        for m in IBAN.finditer(text):
            add("iban", m.start(), m.end(), m.group().replace(" ", ""))
        for m in CARD.finditer(text):
            # A bare run counts by its length; in groups it must have the checksum.
            d = digits(m.group())
            if len(d) == len(m.group()) or check_digit(d[:-1]) == int(d[-1]):
                add("card", m.start(), m.end(), d)
        for m in TAX.finditer(text):
            add("tax", m.start(), m.end(), digits(m.group()))
        for m in PHONE.finditer(text):
            if len(digits(m.group())) >= 9 or m.group()[0] in "+(" and len(digits(m.group())) >= 8:
                add("phone", m.start(), m.end(), normal_phone(m.group()))
    words: dict[str, str] = {}
    for m in NAME.finditer(text):
        group = 2 if m.group(2) else 3
        full = m.group(group).split(" ")
        sex = TITLE_SEX.get(m.group(1) or "", "n")
        if sex == "n" and full[0] in GENDER:
            sex = GENDER[full[0]][1]
        at = m.start(group)
        for i, part in enumerate(full):
            kind = "given" if part in GENDER and (len(full) > 1 and i == 0) else "family"
            # Latin family names are the same for all, Cyrillic ones follow the gender.
            neutral = kind == "family" and not "\u0400" <= part[0] <= "\u04ff"
            kind = f"{kind}_{'n' if neutral else sex}"
            add(kind, at, at + len(part), part)
            words.setdefault(part, kind)
            at += len(part) + 1
    if words:
        ordinary = set(SMALL.findall(text))
        for m in CAPITALISED.finditer(text):
            kind = words.get(m.group())
            if kind and m.group().lower() not in ordinary:
                add(kind, m.start(), m.end(), m.group())
    return found


# ---------------------------------------------------------------- surrogates


def number(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(parts).encode("utf-8"), hashlib.sha256).digest(), "big")


def permuted(value: int, size: int, key: bytes, label: str) -> int:
    """A keyed permutation of 0 .. size-1: a balanced Feistel network, walked until it lands inside again."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in range(6):
            left, right = right, left ^ (number(key, label, str(turn), str(right)) & mask)
        value = left << half | right
        if value < size:
            return value


def alphabets(text: str) -> list[str]:
    """For each character the characters that may stand in its place."""
    lower, upper, ten = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    if len(text) >= 8 and re.fullmatch("[0-9a-f]+", text) and re.search("[a-f]", text):
        return ["0123456789abcdef"] * len(text)
    return [next((a for a in (lower, upper, ten) if c in a), c) for c in text]


def same_format(text: str, key: bytes, label: str) -> str:
    """Another text with the same classes of characters; different texts of one format stay different."""
    sets = alphabets(text)
    value, size = 0, 1
    for c, a in zip(text, sets):
        value, size = value * len(a) + a.index(c), size * len(a)
    value = permuted(value, size, key, label + "|" + "".join(a[0] for a in sets))
    out = []
    for a in reversed(sets):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def check_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def filled(pattern: str, new: str) -> str:
    """The pattern with its digits and letters, from the right, taken from `new`; what either has more of leads."""
    out, rest = [], list(new)
    for c in reversed(pattern):
        out.append(rest.pop() if rest and c.isalnum() else c)
    return "".join(rest) + "".join(reversed(out))


def iban_check(country: str, account: str) -> str:
    moved = "".join(str(int(c, 36)) for c in account + country + "00")
    return f"{98 - int(moved) % 97:02d}"


def surrogate(kind: str, normal: str, key: bytes, attempt: int = 0) -> str:
    """Replacement of a normal form. From PATIENCE draws on texts and numbers without a checksum grow."""
    label = f"{kind}|{attempt}"
    more = attempt // PATIENCE
    if kind == "email":
        local, host = normal.split("@")
        *labels, top = host.split(".")
        return same_format(local + "a" * more, key, label) + "@" + ".".join([*(same_format(x, key, label + "h") for x in labels), top])
    if kind == "ip":
        value = int.from_bytes(bytes(map(int, normal.split("."))), "big")
        return ".".join(map(str, permuted(value, 1 << 32, key, label).to_bytes(4, "big")))
    if kind == "card":
        first, payload, last = normal[0], normal[1:-1], int(normal[-1])
        off = (last - check_digit(normal[:-1])) % 10
        payload = same_format(payload, key, label + first)
        return first + payload + str((check_digit(first + payload) + off) % 10)
    if kind == "iban":
        account = same_format(normal[4:], key, label + normal[:2])
        return normal[:2] + iban_check(normal[:2], account) + account
    if kind == "secret":
        fixed = re.match(r"AKIA|ASIA|(?:sk|pk|ghp|xoxb)[-_]", normal)
        n = fixed.end() if fixed else 0
        return normal[:n] + same_format(normal[n:] + "0" * more, key, label)
    if kind.startswith(("given", "family")):
        part, sex = kind.split("_")
        script = "cyrillic" if "\u0400" <= normal[0] <= "\u04ff" else "latin"
        x = number(key, label, normal)
        if part == "given" and not attempt and normal in GIVEN[script][sex]:
            # Each name becomes the next one in a keyed order of the list, so all stay distinct.
            names = sorted(GIVEN[script][sex], key=lambda name: number(key, part, sex, name))
            return names[(names.index(normal) + 1) % len(names)]
        made = ""
        for _ in range(3 + attempt // 4):
            x, i = divmod(x, len(SYLLABLES[script]))
            made += SYLLABLES[script][i]
        return made.capitalize() + (CYRILLIC_END[sex] if script == "cyrillic" and part == "family" else "")
    return same_format(normal + "0" * more, key, label)


def shown(entity: Entity, new: str) -> str:
    """The replacement in the spelling of the mention."""
    if entity.kind in ("phone", "card", "tax", "iban"):
        return filled(entity.text, new)
    if entity.kind == "email" and entity.text != entity.normal and entity.text.isupper():
        return new.upper()
    return new


def replaced(text: str | None, key: bytes, attempts: Callable[[str, str], int]) -> tuple[str | None, list[Entity]]:
    """The text with surrogates, and what was found in it."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for e in found:
        out += [text[at : e.start], shown(e, surrogate(e.kind, e.normal, key, attempts(e.kind, e.normal)))]
        at = e.end
    return "".join(out) + text[at:], found


# ---------------------------------------------------------------- over all documents


def mentions(docs: DataFrame) -> DataFrame:
    """(digest, kind, normal) of each distinct entity of each text, which its digest names: ids may repeat or be null."""

    def make():
        def run(cols):
            out = {"digest": [], "kind": [], "normal": []}
            for text in cols["text"]:
                if pairs := sorted({(e.kind, e.normal) for e in entities(text)}):
                    out["digest"] += [digest(text)] * len(pairs)
                    out["kind"] += [k for k, _ in pairs]
                    out["normal"] += [n for _, n in pairs]
            return out

        return run

    return map_batches(docs.select("text"), "digest string, kind string, normal string", make)


def digest(text: str) -> str:
    return hashlib.md5(text.encode("utf-8")).hexdigest()


def drawn_again(seen: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, attempt) of the entities whose first replacement is taken, when none shares or takes another's.

    Rounds end by themselves: each leaves one holder of every shared surrogate, and formats that are full grow. Card and
    account numbers and network addresses cannot grow; should a corpus hold so many of one that none is free, 1,000
    draws end in an error instead of a surrogate that is someone's.

    Kinds that differ by gender only are checked together. The listed given names change places among themselves, so
    that one of them is an entity too does not count; it does for one that drew again.
    """

    def make():
        def run(cols):
            made = [surrogate(k, n, key, a) for k, n, a in zip(cols["kind"], cols["normal"], cols["attempt"])]
            return {**cols, "new": made}

        return run

    known = stored(seen.select("kind", "normal").distinct())
    table = known.withColumn("attempt", F.lit(0))
    group = F.substring_index("kind", "_", 1).alias("group")
    for draw in itertools.count():
        if draw > 1000:
            raise ValueError("a format of the corpus has no free surrogates left")
        table = stored(map_batches(table, "kind string, normal string, attempt int, new string", make)).select("*", group)
        shared = table.groupBy("group", "new").agg(F.min(F.struct("attempt", "kind", "normal")).alias("first"), F.count("*").alias("n"))
        clash = shared.where("n > 1").select("group", "new", F.struct("first.kind", "first.normal").alias("holder"))
        taken = known.select(group, F.col("normal").alias("new"), F.lit(True).alias("taken")).distinct()
        marked = table.join(clash, ["group", "new"], "left").join(taken, ["group", "new"], "left")
        swapped = (F.col("group") == "given") & (F.col("attempt") == 0)
        again = (F.coalesce("taken", F.lit(False)) & ~swapped) | (F.col("holder") != F.struct("kind", "normal"))
        checked = stored(marked.select("kind", "normal", "attempt", F.coalesce(again, F.lit(False)).alias("again")))
        if checked.where("again").isEmpty():
            break
        table = checked.select("kind", "normal", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))
    return table.where("attempt > 0").select("kind", "normal", "attempt")


def surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities, kinds) of every row: the text with all entities replaced.

    A text without entities is returned as it is; null stays null. Draws are joined to texts by their digests, so rows
    may share a doc_id or have none. Other columns are not read.
    """
    prepare(docs.sparkSession)
    seen = stored(mentions(docs))
    again = stored(drawn_again(seen, key))
    rows = docs.select("doc_id", "text")
    if again.isEmpty():
        rows = rows.withColumn("again", F.lit(None).cast("array<struct<kind:string,normal:string,attempt:int>>"))
    else:
        own = seen.distinct().join(again, ["kind", "normal"]).groupBy("digest").agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("again"))
        # Copies of one text are dealt over SALTS tasks, which all have its draws; null texts and texts without any stay alone.
        dealt = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("digest", F.md5("text")).withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        rows = salted.join(dealt, ["digest", "_salt"], "left").select("doc_id", "text", "again")

    def make():
        def run(cols):
            out = {"doc_id": cols["doc_id"], "text": [], "n_entities": [], "kinds": []}
            for text, more in zip(cols["text"], cols["again"]):
                attempts = {(x["kind"], x["normal"]): x["attempt"] for x in more or []}
                new, found = replaced(text, key, lambda k, n: attempts.get((k, n), 0))
                out["text"].append(new)
                out["n_entities"].append(len(found))
                out["kinds"].append(sorted({e.kind.split("_")[0] for e in found}))
            return out

        return run

    return map_batches(rows, "doc_id bigint, text string, n_entities bigint, kinds array<string>", make)
