"""Surrogates for personal data.

Detected entities are replaced by others of the same type and format: the digits of a phone number, the
letters of a mail address, the given name by one of the same gender and script. An entity is first brought
to one form (a number without its spacing, a mail address in small letters), that form gets its surrogate,
and the surrogate is written in the format that was found, so an entity has the same surrogate in all its
spellings (coreference). Each surrogate comes from a keyed permutation of all strings of that form without
fixed points: two entities never share one (distinctness) and none keeps its own. A keyed permutation P of
M strings gives x the surrogate P^-1(P(x) + 1 mod M), walked on until further conditions (check digits,
private address ranges) hold as they do for x. `checked_surrogates` counts collisions over the whole corpus
and takes another key if there are any.

Found are mail addresses; IPv4 addresses; phone numbers written internationally, as 3-3-4 digits, or with
a leading 0 in groups; card numbers; IBANs, grouped or not; persons after a title or with a listed given name.

Null texts stay null, with no entities; empty texts stay empty. Of findings that overlap the kind listed
first stays, of the same kind the longer one. Very long texts are taken whole, in one task. Repeated rows
give repeated results. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "iban", "phone", "card", "person")

#: Given names by script and gender.
GIVEN = {
    ("latin", "f"): "Anna Maria Laura Julia Sophie Emma Claire Camille Ingrid Heike Lucia Carmen Isabel Elena Sarah Emily Olivia Charlotte Hannah Alice Mary Jane Susan Linda Jennifer Elizabeth Karen Nancy Lisa Margaret Barbara Marie Monika Petra Sabine Ana Marta Paula Nathalie Chloé Ruth Helen".split(),
    ("latin", "m"): "Peter Thomas Michael David Daniel James Robert William Pierre Luc Antoine Hans Jürgen Klaus Carlos Miguel Javier Pablo George Henry John Paul Mark Richard Charles Joseph Steven Andrew Kevin Brian Stefan Wolfgang Andreas Martin José Juan Luis Jean François Louis Frank Walter".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Андрей Николай Дмитрий Алексей Михаил".split(),
}
_GROUP = {name: (group, i) for group, names in GIVEN.items() for i, name in enumerate(names)}
#: Titles before names.
TITLES = "Mr Mrs Ms Miss Sir Lady Dr Prof Professor Doctor Herr Frau Fräulein Monsieur Madame Mme Mlle Señor Señora Señorita Don Doña Sr Sra Г-н Г-жа".split()
#: Calling codes of two digits; those that start with 1 or 7 have one, others three.
TWO = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: Letters that stand for each other: vowels, consonants, and those with marks, by script.
_CLASSES = [
    *("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çčćďđğłńňñřśşšťźżž"),
    *("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ"),
]
_CLASS = {c: x for x in _CLASSES for c in x} | {c.upper(): x.upper() for x in _CLASSES for c in x}
_WHOLE = "abcdefghijklmnopqrstuvwxyz"
_PLAIN = {c: x for x in (_WHOLE, _WHOLE.upper(), "0123456789") for c in x}

EMAIL = re.compile(r"(?<![\w.+-])([A-Za-z0-9._%+-]+)@((?:[A-Za-z0-9-]+\.)+)([A-Za-z]{2,})(?![\w-])")
IP = re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)")
PHONE = re.compile(
    r"""(?<![\w+(./-])(?:
      \+1[\x20.-]?(?:\(\d{3}\)|\d{3})[\x20.-]?\d{3}[\x20.-]?\d{4}
    | \+[2-9]\d{0,2}[\x20.-]?(?:\(\d{1,5}\)[\x20-]?)?\d{1,12}(?:[\x20.-]\d{2,8}){0,5}
    | (?:\(\d{3}\)\x20?|\d{3}[.-])\d{3}[\x20.-]\d{4}
    | \d{3}\x20\d{3}\x20\d{4}(?!\x20?\d)
    | 0\d(?:\x20\d{2}){4}(?!\x20?\d) | 0\d(?:\.\d{2}){4}(?!\.?\d)
    | 0\d{2,4}[\x20/-]\d{4,8}(?![\x20-]?\d)
    )(?!\w)(?!\.\d)""",
    re.X,
)
CARD = re.compile(r"(?<![\w.])\d{4}(?:[\x20-]?\d{4}){2}[\x20-]?\d{1,7}(?!\w)|(?<![\w.])\d{13,19}(?!\w)")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,4})?)(?!\w)")
_SCRIPTS = [chr(c) for c in (*range(0x41, 0x250), *range(0x370, 0x530))]
_UP, _ANY = "".join(c for c in _SCRIPTS if c.isupper()), "".join(c for c in _SCRIPTS if c.isalpha())
_WORD = rf"(?:[{_UP}][{_ANY}]+|[{_UP}](?=['’][{_UP}]))(?:['’-][{_UP}][{_ANY}]+)*"
TITLED = re.compile(rf"(?<!\w)(?:{'|'.join(TITLES)})\.?\x20({_WORD})(?:\x20({_WORD}))?(?!\w)")
PAIR = re.compile(rf"(?<!\w)({_WORD})(?=\x20({_WORD})(?!\w))")


class Keyed:
    """Permutations under a secret key."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _mix(self, tweak: bytes, r: int, value: int, bits: int) -> int:
        size = (value.bit_length() + 7) // 8
        h = hashlib.blake2b(tweak + bytes([r]) + value.to_bytes(size, "big"), key=self.key, digest_size=max(1, min(64, (bits + 7) // 8)))
        return int.from_bytes(h.digest(), "big") & ((1 << bits) - 1)

    def permute(self, x: int, m: int, tweak: bytes, back: bool = False) -> int:
        """A permutation of range(m), or its inverse: a balanced Feistel network, walked until inside."""
        half = max(1, ((m - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            if back:
                for r in reversed(range(self.rounds)):
                    a, b = b ^ self._mix(tweak, r, a, half), a
            else:
                for r in range(self.rounds):
                    a, b = b, a ^ self._mix(tweak, r, b, half)
            x = a << half | b
            if x < m:
                return x

    def other(self, x: int, m: int, tweak: bytes, fits: Callable[[int], bool] | None = None) -> int:
        """The surrogate of x: a permutation of the fitting part of range(m) that moves every element, if there are two."""
        y = x
        while True:
            y = self.permute((self.permute(y, m, tweak) + 1) % m, m, tweak, back=True) if m > 1 else y
            if fits is None or y == x or fits(y):
                return y

    def respell(self, text: str, tweak: bytes, classes: dict[str, str] = _PLAIN, fits: Callable[[str], bool] | None = None) -> str:
        """Another string whose characters are each of the same class as in text; those without a class stay."""
        kinds = [(classes.get(c), c) for c in text]
        shape = "\0".join(a or c for a, c in kinds).encode()
        x, m = 0, 1
        for alphabet, c in kinds:
            if alphabet:
                x, m = x * len(alphabet) + alphabet.index(c), m * len(alphabet)

        def spell(v: int) -> str:
            out = []
            for alphabet, c in reversed(kinds):
                if alphabet:
                    v, r = divmod(v, len(alphabet))
                    c = alphabet[r]
                out.append(c)
            return "".join(reversed(out))

        return spell(self.other(x, m, tweak + hashlib.blake2b(shape, digest_size=16).digest(), (lambda v: fits(spell(v))) if fits else None))


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c in "0123456789"]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def _private(v: int) -> int:
    a, b = v >> 24, v >> 16 & 255
    return 1 if a == 10 else 2 if a == 172 and 16 <= b < 32 else 3 if (a, b) == (192, 168) else 4 if a == 127 else 0


def _placed(text: str, old: str, new: str) -> str:
    """text with the characters of old, which it has in this order among others, replaced by those of new."""
    out, k = [], 0
    for c in text:
        if k < len(old) and c == old[k]:
            out.append(new[k])
            k += 1
        else:
            out.append(c)
    return "".join(out)


def phone_parts(text: str) -> tuple[str, str]:
    """Calling code (empty for numbers with a leading 0) and the digits after it."""
    digits = "".join(c for c in text.replace("(0)", "") if c in "0123456789")
    if text[0] != "+":
        return ("", digits) if digits[0] == "0" and len(digits) != 10 or text[0] == "0" and len(text) > 3 and text[3] not in ".-" else ("1", digits)
    n = 1 if digits[0] in "17" else 2 if digits[:2] in TWO else 3
    return digits[:n], digits[n:]


def iban_valid(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Surrogates:
    """The surrogate of each entity under a key: of its one form, and written as it was found."""

    def __init__(self, key: bytes):
        self.keyed = Keyed(key)

    def email(self, text: str) -> tuple[str, str, str]:
        same = text.lower()
        local, domain = same.rsplit("@", 1)
        domain, tld = domain[: domain.rindex(".") + 1], domain[domain.rindex(".") + 1 :]
        other = f"{self.keyed.respell(local, b'local')}@{self.keyed.respell(domain, b'domain')}{tld}"
        return same, other, "".join(b.upper() if a.isupper() else b for a, b in zip(text, other, strict=True))

    def ip(self, text: str) -> tuple[str, str, str]:
        v = int.from_bytes(bytes(map(int, text.split("."))), "big")
        kind = _private(v)
        base, size = {0: (0, 1 << 32), 1: (10 << 24, 1 << 24), 2: (172 << 24 | 16 << 16, 1 << 20), 3: (192 << 24 | 168 << 16, 1 << 16), 4: (127 << 24, 1 << 24)}[kind]
        out = base + self.keyed.other(v - base, size, b"ip%d" % kind, lambda y: _private(base + y) == kind)
        other = ".".join(map(str, out.to_bytes(4, "big")))
        return text, other, other

    def phone(self, text: str) -> tuple[str, str, str]:
        code, digits = phone_parts(text)
        head = digits[: code == ""]  # the leading 0 stays
        new = head + self.keyed.respell(digits[len(head) :], b"phone" + code.encode())
        if text[0] != "+":
            return code + digits, code + new, _placed(text, digits, new)
        at, left = 1, len(code)
        while left:  # the code may be followed by signs
            left -= text[at] in "0123456789"
            at += 1
        rest = text[at:].split("(0)")
        written = _placed("\0".join(rest), digits, new).replace("\0", "(0)")
        return code + digits, code + new, text[:at] + written

    def card(self, text: str) -> tuple[str, str, str]:
        same = "".join(c for c in text if c in "0123456789")
        valid, first = luhn(same), same[0]
        other = first + self.keyed.respell(same[1:], b"card" + first.encode(), fits=lambda s: luhn(first + s) == valid)
        return same, other, _placed(text, same, other)

    def iban(self, text: str) -> tuple[str, str, str]:
        same = text.replace(" ", "")
        country, check, rest = same[:2], same[2:4], same[4:]
        valid = iban_valid(same)
        out = self.keyed.respell(rest, b"iban" + country.encode() + (b"" if valid else check.encode()))
        if valid:
            check = f"{98 - int(''.join(str(int(c, 36)) for c in out + country + '00')) % 97:02d}"
        other = country + check + out
        return same, other, _placed(text, same, other)

    def name(self, name: str) -> str:
        if name in _GROUP:
            group, i = _GROUP[name]
            return GIVEN[group][self.keyed.other(i, len(GIVEN[group]), "-".join(group).encode())]
        # vowels stay vowels and the last letter stays: it often tells the gender
        keep = name[-1] if sum(map(str.isalpha, name)) > 2 else ""
        head = name[: len(name) - len(keep)]
        return self.keyed.respell(head, b"name" + keep.encode(), _CLASS, fits=lambda s: s + keep not in _GROUP) + keep

    def person(self, text: str, words: list[tuple[int, int]]) -> tuple[str, str, str]:
        same, other, out, last = [], [], [], 0
        for a, b in words:
            word = text[a:b]
            shout = word.isupper() and len(word) > 2
            same.append(word.title() if shout else word)
            other.append(self.name(same[-1]))
            out += [text[last:a], other[-1].upper() if shout else other[-1]]
            last = b
        return " ".join(same), " ".join(other), "".join([*out, text[last:]])


def _phones(text: str):
    for m in PHONE.finditer(text):
        end = m.end()
        while sum(c in "0123456789" for c in text[m.start() : end]) > 15:  # groups that follow by chance
            end = m.start() + max(text.rfind(c, m.start(), end) - m.start() for c in " .-")
        if sum(c in "0123456789" for c in text[m.start() : end]) >= 8:
            yield m.start(), end


def _ibans(text: str):
    for m in IBAN.finditer(text):
        if " " not in m.group():
            yield m.span()
            continue
        end = m.end()
        while end - m.start() >= 15:  # words in capitals may follow
            if iban_valid(text[m.start() : end].replace(" ", "")):
                yield m.start(), end
                break
            end = text.rindex(" ", m.start(), end)


def find(text: str) -> list[tuple[int, int, str, list[tuple[int, int]]]]:
    """(start, end, kind, spans of the names in it) of all entities, leftmost first; of overlapping ones the kind listed first in KINDS stays."""
    found = []
    if "@" in text:
        found += [(m.start(), m.end(), "email", []) for m in EMAIL.finditer(text)]
    if _DIGITS.search(text):
        found += [(m.start(), m.end(), "ip", []) for m in IP.finditer(text)]
        found += [(a, b, "phone", []) for a, b in _phones(text)]
        found += [(m.start(), m.end(), "card", []) for m in CARD.finditer(text)]
        found += [(a, b, "iban", []) for a, b in _ibans(text)]
    found += [(m.start(), m.end(), "person", [m.span(k) for k in (1, 2) if m.group(k)]) for m in TITLED.finditer(text)]
    found += [(m.start(), m.end(2), "person", [m.span(1), m.span(2)]) for m in PAIR.finditer(text) if _given(m.group(1))]
    taken: list[tuple[int, int, str, list[tuple[int, int]]]] = []
    starts: list[int] = []
    for x in sorted(found, key=lambda x: (KINDS.index(x[2]), x[0], -x[1])):
        at = bisect_right(starts, x[0])
        if (at == 0 or taken[at - 1][1] <= x[0]) and (at == len(taken) or x[1] <= taken[at][0]):
            starts.insert(at, x[0])
            taken.insert(at, x)
    return taken


def _given(word: str) -> bool:
    return word in _GROUP or word.isupper() and word.title() in _GROUP


_DIGITS = re.compile(r"\d\D?\d\D?\d|\.\d")


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate, the entity's one form, that of the surrogate) of each entity."""
    found = find(text)
    if not found:
        return text, []
    make, out, entities, last = Surrogates(key), [], [], 0
    for start, end, kind, names in found:
        entity = text[start:end]
        same, other, new = make.person(entity, [(a - start, b - start) for a, b in names]) if kind == "person" else getattr(make, kind)(entity)
        out += [text[last:start], new]
        entities.append((kind, entity, new, same, other))
        last = end
    return "".join([*out, text[last:]]), entities


_FIELDS = ("kind", "entity", "surrogate", "same", "other")


def surrogate_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """One row for each row of docs (doc_id, text): text with surrogates, and its entities: kind, as found, surrogate, and the one forms of both."""
    kind = pa.list_(pa.struct([(f, pa.string()) for f in _FIELDS]))

    def run(batches):
        for batch in batches:
            rows = [(None, []) if t is None else replace(t, key) for t in batch.column(1).to_pylist()]
            lists = pa.array([[dict(zip(_FIELDS, e, strict=True)) for e in es] for _, es in rows], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in rows], pa.string()), lists], ["doc_id", "text", "entities"])

    schema = f"doc_id long, text string, entities array<struct<{', '.join(f'{f}: string' for f in _FIELDS)}>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(common.released(run), schema)


def collisions(replaced: DataFrame) -> DataFrame:
    """Surrogates that stand for several entities of a kind, entities with several surrogates, and entities that kept their own: none, if all is well."""
    e = replaced.select(F.explode("entities").alias("e")).select("e.kind", "e.same", "e.other").distinct()
    twice = e.groupBy("kind", "other").agg(F.count_distinct("same").alias("n")).where("n > 1").select("kind", F.col("other").alias("value"))
    split = e.groupBy("kind", "same").agg(F.count_distinct("other").alias("n")).where("n > 1").select("kind", F.col("same").alias("value"))
    return twice.union(split).union(e.where("same = other").select("kind", F.col("same").alias("value")))


def checked_surrogates(docs: DataFrame, key: bytes, tries: int = 3) -> DataFrame:
    """surrogate_documents, written and checked for collisions over all of docs; with any, another key is derived."""
    for k in range(tries):
        out = common.staged(docs.sparkSession, surrogate_documents(docs, key if k == 0 else hashlib.blake2b(key, salt=bytes([k])).digest()), "surrogates")
        if collisions(out).isEmpty():
            return out
    raise ValueError("surrogates collide under all keys that were tried")


def configured_key(spark: SparkSession) -> bytes:
    """The secret in spark.cellgrove.pii.key; where that is unset, a random one, good for this call only."""
    value = spark.sparkContext.getConf().get("spark.cellgrove.pii.key") or spark.conf.get("spark.cellgrove.pii.key", None)
    return value.encode() if value else secrets.token_bytes(32)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities stay out of the result: it holds their number by kind and the text with surrogates."""
    out = checked_surrogates(common.table(spark, sf_dir, "documents"), configured_key(spark))
    counts = [F.coalesce(F.expr(f"size(filter(entities, e -> e.kind = '{k}'))"), F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", F.coalesce(F.size("entities"), F.lit(0)).cast("long").alias("n_entities"), *counts, "text")
