"""Personal data replaced by keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, text_or_empty

NAMES = {
    ("latin", "f"): "Alice Anna Clara Emma Julia Laura Lucia Maria Marie Martha Nina Olivia Paula Sarah Sofia Teresa".split(),
    ("latin", "m"): "Adam Andreas Carlos Daniel David Hans Jean John Karl Luis Marco Michael Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга Татьяна".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Иван Николай Олег Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος".split(),
}
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Señor": "m", "Señora": "f", "Dr": "", "Prof": ""}
CAPITALS = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]{2,}"
CAPITAL = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^\W\d_]+"

EMAIL = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
IPV4 = re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d)")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(
    r"(?<![\w.+])\+\d{8,15}(?![\w.]*\d)|(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{5,8}(?!\d)"
    r"|(?<![\w.])(?:\+\d{1,3}[ .-]?|0)\d{1,4}[ .-]\d{5,8}(?![\w.]*\d)"
    r"|(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?![\w.]*\d)"
    r"|(?i:\b(?:tel|phone|mobile|cell|fax)\b\.?:? ?)(?P<cued>\d{7,15})(?!\d)")
BARE = re.compile(r"(?<![\w.+-])\d{7,15}(?![\w-])")
SECRET = re.compile(
    r"(?i)\b(?:token|secret|api[_-]?key|access[_-]?key|secret[_-]?key|private[_-]?key|password|passwd|pwd)\b[\"']?\s*[=:]\s*[\"']?(?P<value>[^\s\"',;]{6,})"
    r"|\b(?P<known>(?-i:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,}))")
#: What comes before a name that no list has.
CUE = r"(?i:\b(?:my name is|name:|sincerely,|regards,|yours,))\s+"

CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Letters that stand for one another in a made-up name: vowels and consonants of a script, plain and accented.
LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "àáâäèéêëìíîïòóôöùúûü", "çñćčďđłńňřśšťźž", "аеиоуыэюяё", "бвгдзклмнпрст", "жйфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ")


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def _prf(key: bytes, label: str, values: list[int], count: int) -> list[int]:
    seed = f"{label}|{','.join(map(str, values))}".encode()
    out: list[int] = []
    block = 0
    while len(out) < count:
        digest = hashlib.blake2b(seed + block.to_bytes(4, "big"), key=key, digest_size=64).digest()
        out.extend(int.from_bytes(digest[i : i + 8], "big") for i in range(0, 64, 8))
        block += 1
    return out[:count]


def permute(values: list[int], sizes: list[int], key: bytes, label: str) -> list[int]:
    """A keyed permutation of the vectors with ``values[i] < sizes[i]``: a Feistel network in which the halves,
    taken by turns, are shifted by a function of the other. One format's entities never share a surrogate."""
    out = list(values)
    label = f"{label}|{len(out)}"
    halves = (range(0, len(out), 2), range(1, len(out), 2))
    for step in range(8):
        mine, other = halves[step % 2], halves[1 - step % 2]
        shift = _prf(key, f"{label}|{step}", [out[i] for i in other], len(mine))
        for i, s in zip(mine, shift, strict=True):
            out[i] = (out[i] + s) % sizes[i]
    return out


def unpermute(values: list[int], sizes: list[int], key: bytes, label: str) -> list[int]:
    """What permute() maps to ``values``."""
    out = list(values)
    label = f"{label}|{len(out)}"
    halves = (range(0, len(out), 2), range(1, len(out), 2))
    for step in reversed(range(8)):
        mine, other = halves[step % 2], halves[1 - step % 2]
        shift = _prf(key, f"{label}|{step}", [out[i] for i in other], len(mine))
        for i, s in zip(mine, shift, strict=True):
            out[i] = (out[i] - s) % sizes[i]
    return out


def _next(value: int, size: int, key: bytes, label: str) -> int:
    order = sorted(range(size), key=lambda k: _prf(key, label, [k], 1))
    return order[(order.index(value) + 1) % size]


def derange(values: list[int], sizes: list[int], key: bytes, label: str) -> list[int]:
    """A keyed permutation that leaves no vector where it is, if there are two: permuted, counted up by one, and
    permuted back."""
    if len(values) == 1:  # nothing to mix it with: the next in a keyed order of the few there are
        return [_next(values[0], sizes[0], key, label)]
    out = permute(values, sizes, key, label)
    for i, size in enumerate(sizes):
        out[i] = (out[i] + 1) % size
        if out[i]:
            break
    return unpermute(out, sizes, key, label)


def _shaped(text: str, key: bytes, label: str, classes=CLASSES) -> str:
    """Characters deranged within their class; all others stay, as do their places."""
    where, values, sizes = [], [], []
    for i, c in enumerate(text):
        for group in classes:
            if c in group:
                where.append((i, group))
                values.append(group.index(c))
                sizes.append(len(group))
                break
    shape = "".join(str(next((k for k, g in enumerate(classes) if c in g), c)) for c in text)
    out = list(text)
    for (i, group), v in zip(where, derange(values, sizes, key, f"{label}|{shape}"), strict=True):
        out[i] = group[v]
    return "".join(out)


def _refill(text: str, characters: str, fits=str.isalnum) -> str:
    """``text`` with its characters that fit replaced in turn, all others as they stand."""
    it = iter(characters)
    return "".join(next(it) if fits(c) else c for c in text)


def _recased(like: str, text: str) -> str:
    """``text`` in the case of ``like``, place by place; capitals or capitalised where the lengths differ."""
    if len(like) == len(text):
        return "".join(t.upper() if c.isupper() else t for c, t in zip(like, text, strict=True))
    return text.upper() if like.isupper() else text.capitalize() if like[:1].isupper() else text


# Each type has a canonical form, which all spellings of an entity share, a surrogate for it, and a way back into the
# spelling at hand.


def _email(entity: str, key: bytes, label: str) -> str:
    local, _, domain = entity.rpartition("@")
    name, dot, top = domain.rpartition(".")
    return f"{_shaped(local, key, label + '|' + domain)}@{_shaped(name, key, label + '-domain')}{dot}{top}"


def _ipv4(entity: str, key: bytes, label: str) -> str:
    return ".".join(map(str, derange([int(p) for p in entity.split(".")], [256] * 4, key, label)))


def _groups(text: str) -> list[int]:
    packed = ipaddress.IPv6Address(text).packed
    return [int.from_bytes(packed[i : i + 2], "big") for i in range(0, 16, 2)]


def _ipv6(entity: str, key: bytes, label: str) -> str:
    """Groups that are zero stay zero, so that a short form stays one."""
    groups = _groups(entity)
    used = [i for i, g in enumerate(groups) if g]
    for i, v in zip(used, derange([groups[i] - 1 for i in used], [65_535] * len(used), key, f"{label}|{used}"), strict=True):
        groups[i] = v + 1
    return str(ipaddress.IPv6Address(b"".join(g.to_bytes(2, "big") for g in groups)))


def _ipv6_as(text: str, new: str) -> str:
    """Each group in the place of the old one; leading zeros and capitals as there."""
    parts, groups = text.split(":"), _groups(new)
    before = text.split("::")[0].split(":") if "::" in text else parts
    behind = len([p for p in text.split("::")[1].split(":") if p]) if "::" in text else 0
    places = [*range(len([p for p in before if p])), *range(8 - behind, 8)]
    at = iter(places)
    out = ":".join(f"{groups[next(at)]:x}".zfill(len(p) if p[0] == "0" else 1) if p else "" for p in parts)
    return out.upper() if text.upper() == text and any(c.isalpha() for c in text) else out


def _card(entity: str, key: bytes, label: str) -> str:
    new = "".join(map(str, derange([int(c) for c in entity[:-1]], [10] * (len(entity) - 1), key, label)))
    return new + next(d for d in "0123456789" if luhn(new + d))


def _iban(entity: str, key: bytes, label: str) -> str:
    country, body = entity[:2], _shaped(entity[4:], key, label + entity[:2])
    return f"{country}{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}{body}"


def national(text: str) -> tuple[str, str]:
    """Country code, if it is written, and national number without leading zeros of a phone number."""
    digits = "".join(c for c in text if c.isdigit())
    if text.startswith("+"):
        lead = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
        code = lead.group(1) if lead else digits[: 1 if digits[0] in "17" else 2]
    else:
        code = "1" if len(digits) == 11 and digits[0] == "1" else ""
    return code, digits[len(code) :].lstrip("0")


def _phone(entity: str, key: bytes, label: str) -> str:
    first, *rest = derange([int(entity[0]) - 1, *map(int, entity[1:])], [9] + [10] * (len(entity) - 1), key, label)
    return str(first + 1) + "".join(map(str, rest))


def _phone_as(text: str, new: str) -> str:
    """The national number in its place; country code and leading zeros stay."""
    digits = "".join(c for c in text if c.isdigit())
    return _refill(text, digits[: len(digits) - len(new)] + new, str.isdigit)


def _secret(entity: str, key: bytes, label: str) -> str:
    """Hexadecimal stays hexadecimal of its case; anything else keeps its character classes, and a known prefix stays."""
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        if all(c in digits for c in entity):
            return _shaped(entity, key, label, (digits,))
    head = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ", entity)
    head = head.group(0) if head else ""
    return head + _shaped(entity[len(head) :], key, label + head)


def script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽ]", word) else "latin"


class Names:
    """Given names by script and gender, and the pattern that finds persons: a title or one of the words before a name
    with one or two capitalised words, or a listed given name with a capitalised word, both also in capitals."""

    def __init__(self, lists: dict[tuple[str, str], list[str]]):
        self.lists = {group: [n.lower() for n in names] for group, names in lists.items()}
        self.of = {n: (group, i) for group, names in self.lists.items() for i, n in enumerate(names)}
        titles = "|".join(sorted(TITLES, key=len, reverse=True))
        listed = [n for names in lists.values() for n in names]
        self.pattern = re.compile(
            rf"\b(?:(?P<title>{titles})\.? )(?P<after>{CAPITAL}(?: {CAPITAL})?)|\b(?P<given>(?:{'|'.join(listed)}) {CAPITAL})"
            rf"|\b(?P<upper>(?:{'|'.join(n.upper() for n in listed)}) {CAPITALS})\b|{CUE}(?P<cued>{CAPITAL} {CAPITAL})" if listed else rf"\b(?:(?P<title>{titles})\.? )(?P<after>{CAPITAL}(?: {CAPITAL})?)|{CUE}(?P<cued>{CAPITAL} {CAPITAL})(?P<given>(?!))?(?P<upper>(?!))?")

    def surrogate(self, part: str, gender: str, key: bytes, label: str) -> str:
        """Of a part in lower case: a listed given name becomes another of its script and gender, that of the title
        where it says another; any other part a made-up word of the same length, script and vowels' places, never a
        listed one. No two parts of one gender share a surrogate."""
        if part in self.of:
            group, place = self.of[part]
            names = self.lists[group]
            if gender and gender != group[1] and self.lists.get((group[0], gender)):
                other = self.lists[group[0], gender]
                return other[_prf(key, f"{label}|{group}|{gender}", [place], 1)[0] % len(other)]
            return names[_next(place, len(names), key, f"{label}|{group}")]
        made = _shaped(part, key, label, LETTERS)
        while made in self.of:  # walks on along the permutation's cycle, so what is left is a permutation still
            made = _shaped(made, key, label, LETTERS)
        return made


LISTED = Names(NAMES)
MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "card": _card, "ssn": _shaped, "ipv6": _ipv6, "ipv4": _ipv4, "phone": _phone}
AS_WRITTEN = {"email": _recased, "iban": _refill, "card": lambda text, new: _refill(text, new, str.isdigit), "ipv6": _ipv6_as, "phone": _phone_as}


def canonical(kind: str, text: str) -> str:
    """What all spellings of an entity share."""
    if kind in ("email", "person"):
        low = text.lower()
        return low if len(low) == len(text) else text
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "card":
        return "".join(c for c in text if c.isdigit())
    if kind == "phone":
        return national(text)[1]
    return str(ipaddress.IPv6Address(text)) if kind == "ipv6" else text


def _valid(kind: str, text: str) -> bool:
    if kind == "ipv4":
        return all(int(p) < 256 and str(int(p)) == p for p in text.split("."))
    if kind == "ipv6":
        try:
            groups = _groups(text)
        except ValueError:
            return False
        return sum(map(bool, groups)) >= 2 and any(c.isdigit() for c in text)  # not a loopback or a scope operator
    digits = "".join(c for c in text if c.isdigit())
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "iban":
        plain = text.replace(" ", "")
        return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    if kind == "phone":
        dated = re.fullmatch(r"\d{4}[-. ]\d{2}[-. ]\d{2}|\d{2}[-. ]\d{2}[-. ]\d{4}", text)
        return not dated and 7 <= len(digits) <= 15 and len(national(text)[1]) >= 6 and (text[0] in "+(" or text.isdigit() or re.fullmatch(r"0\d{1,4}[ .-]\d{5,8}", text) is not None or text.count(" ") + text.count("-") + text.count(".") >= 2)
    return True


class Taken:
    """Spans that do not overlap, kept in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str]] = []

    def add(self, a: int, b: int, kind: str) -> bool:
        at = bisect.bisect_left(self.starts, a)
        if at and self.spans[at - 1][1] > a or at < len(self.spans) and self.spans[at][0] < b:
            return False
        self.starts.insert(at, a)
        self.spans.insert(at, (a, b, kind))
        return True


def entities(text: str, names: Names = LISTED) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of ``text``, without overlap; of two that overlap the earlier type in
    the order of MAKERS stays, a card number before a phone number."""
    return _found(text, names)[0]


def _found(text: str, names: Names) -> tuple[list[tuple[int, int, str]], dict[str, str]]:
    """The entities, and the gender that a title gives a listed name."""
    taken = Taken()
    genders: dict[str, str] = {}
    tests = []
    if "@" in text:
        tests.append(("email", EMAIL))
    if "=" in text or ":" in text or "-" in text or "_" in text:
        tests.append(("secret", SECRET))
    if digits := any(c in text for c in "0123456789"):
        tests += [("iban", IBAN), ("card", CARD), ("ssn", SSN)]
    if ":" in text:
        tests.append(("ipv6", IPV6))
    if digits:
        tests += [("ipv4", IPV4), ("phone", PHONE)]
    for kind, pattern in tests:
        for m in pattern.finditer(text):
            if kind == "secret":
                taken.add(*(m.span("value") if m.group("value") else m.span("known")), kind)
                continue
            span = m.span("cued") if kind == "phone" and m.group("cued") else m.span()
            if kind == "card" and not _valid(kind, m.group(0)):
                # digits of several numbers side by side: take each run of 13 to 19 digits that holds
                parts = [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"\d{13,19}", m.group(0))]
            else:
                parts = [span]
            for a, b in parts:
                if _valid(kind, text[a:b]):
                    taken.add(a, b, kind)
    # a number that stands elsewhere without separators
    phones = {national(text[a:b])[1] for a, b, kind in taken.spans if kind == "phone"}
    if phones:
        for m in BARE.finditer(text):
            if national(m.group())[1] in phones:
                taken.add(*m.span(), "phone")
    parts: set[str] = set()
    for m in names.pattern.finditer(text):
        a, b = next(m.span(g) for g in ("after", "given", "upper", "cued") if m.group(g))
        gender = TITLES.get(m.group("title") or "", "")
        for p in re.finditer(r"\S+", text[a:b]):
            low = canonical("person", p.group())
            if taken.add(a + p.start(), a + p.end(), "person"):
                parts.add(low)
                if gender and low in names.of and p.start() == 0:
                    genders[low] = gender
    # the parts of a name that stand alone later, or came before
    if parts:
        alone = "|".join(re.escape(p) for p in sorted(parts, key=lambda p: (-len(p), p)))
        for m in re.finditer(rf"(?<!\w)(?:{alone})(?!\w)", text, re.IGNORECASE):
            if m.group()[0].isupper():
                taken.add(*m.span(), "person")
    return taken.spans, genders


@dataclass
class Replaced:
    text: str
    entities: int
    distinct: int
    collisions: int


def surrogate(text: str, key: bytes, names: Names = LISTED) -> Replaced:
    """``text`` with each entity replaced.

    An entity is judged by its canonical form: an address whatever its case, a number whatever its separators or
    country code, each part of a name whatever its case and place. Equal entities get equal surrogates, in every document
    under one key, written as the original is; unequal ones of a type get unequal surrogates, none its own, as each
    maker is a permutation without fixed points. What remains is checked by document: where a title and a list
    disagree on a gender, or two types meet, a surrogate that another entity has is drawn anew, and if fifty draws do
    not help, the text is refused."""
    found, genders = _found(text, names)
    if not found:
        return Replaced(text, 0, 0, 0)
    given: dict[tuple[str, str], str] = {}
    used: set[str] = set()
    collisions = 0
    for kind, entity in sorted({(k, canonical(k, text[a:b])) for a, b, k in found}):
        for turn in range(51):
            label = f"{kind}+{turn}" if turn else kind
            new = names.surrogate(entity, genders.get(entity, ""), key, label) if kind == "person" else MAKERS[kind](entity, key, label)
            if new not in used:
                break
            collisions += 1
        else:
            raise ValueError(f"no surrogate of type {kind} that differs from all others of its text")
        given[kind, entity] = new
        used.add(new)
    out, last = [], 0
    for a, b, kind in found:
        old = text[a:b]
        new = given[kind, canonical(kind, old)]
        out += [text[last:a], AS_WRITTEN[kind](old, new) if kind in AS_WRITTEN else _recased(old, new) if kind == "person" else new]
        last = b
    return Replaced("".join([*out, text[last:]]), len(found), len(given), collisions)


def pseudonymize(docs: DataFrame, key: bytes, id_column: str = "doc_id", text_column: str = "text", lists: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
    """One row (id, n_entities, n_distinct, n_collisions, text) per row of ``docs``; one pass, no shuffle.

    A null text counts as empty and comes back empty; a text without entities comes back unchanged; long texts are
    read whole; repeated rows come back alike; an empty table gives an empty one; other columns are not read, whatever
    their names. ``lists`` are given names by (script, gender), in place of the few that stand here. ``key`` (16 to 64 bytes) must be kept secret: with it surrogates can be reversed."""
    if not 16 <= len(key) <= 64:
        raise ValueError("key must have 16 to 64 bytes")
    rows = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("t"))
    lists = lists or NAMES

    def run(batches):
        names = Names(lists)
        for batch in batches:
            made = [surrogate(t, key, names) for t in batch.column(1).to_pylist()]
            numbers = [pa.array([getattr(m, n) for m in made], pa.int32()) for n in ("entities", "distinct", "collisions")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array([m.text for m in made], pa.string())], names=["id", "n_entities", "n_distinct", "n_collisions", "text"])

    return rows.transform(in_arrow, run, f"id {rows.schema['id'].dataType.simpleString()}, n_entities int, n_distinct int, n_collisions int, text string")
