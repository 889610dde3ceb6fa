"""PII surrogates: detected entities are replaced by keyed stand-ins of the same type, script and format.

A stand-in is the image of the entity under a keyed permutation of all entities of its format: digits stay digits, letters
stay letters of their script and kind (vowel, consonant), and punctuation, case and length stay as they are; check digits
are made anew. Each permutation is one cycle through all entities of the format, so none is its own image, and images that
belong to another format are walked past. The same entity gives the same stand-in everywhere, however it is written, and different entities give
different ones. Given names map to names of the same gender and script, other names keep their last letter, which is where
many languages mark gender.

All distinct entities of the corpus are checked before any text is rewritten: no two may share a stand-in and none may be
its own. A kind of entity that fails gets another permutation.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.llm.common import texts
from lexlake.session import written

KEY = b"lexlake-surrogates"
ATTEMPTS = 8

# given names by script and gender; fixed values, a name's stand-in is another name of its list
GIVEN_NAMES = {
    "latin female": "Alice Amelia Anna Barbara Clara Elena Emily Emma Eva Isabel Julia Laura Lucia Maria Martha Sarah Sofia",
    "latin male": "Adam Albert Carlos David Felix Hans James John Jose Klaus Louis Lucas Martin Michael Paul Peter Robert",
    "cyrillic female": "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна",
    "cyrillic male": "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей",
    "greek female": "Άννα Ελένη Ζωή Κατερίνα Μαρία Σοφία",
    "greek male": "Αλέξανδρος Γιώργος Δημήτρης Κώστας Νίκος Πέτρος",
}
_NAMES = {group: names.split() for group, names in GIVEN_NAMES.items()}
_GROUP = {name: group for group, names in _NAMES.items() for name in names}

# letters that may stand for each other; fixed values
ALPHABETS = (
    "0123456789",
    "aeiou",
    "bcdfghjklmnpqrstvwxyz",
    "áéíóúàèìòùâêîôûäëïöüãõ",
    "çñß",
    "аеёиоуыэюя",
    "бвгджзйклмнпрстфхцчшщ",
    "αεηιουω",
    "βγδζθκλμνξπρστφχψ",
    "άέήίόύώ",
)
_HEX = "0123456789abcdef"
_CODE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_CLASS = {letter: (alphabet, i) for alphabet in ALPHABETS for i, letter in enumerate(alphabet)}
# letters and numbers that are looked through at a time for an alphabet of a script
_SCRIPT_BLOCK = 4096


def _up(low: str) -> str:
    return "ẞ" if low == "ß" else low.upper()


@cache
def _scripts(block: int) -> dict[str, tuple[str, int]]:
    """Alphabets of the letters and numbers of a block of code points that `ALPHABETS` lack, by script and category.

    Letters that come back from upper case are apart from others. What is alone of its kind shares an alphabet with others
    that are, or joins the largest one, so that no alphabet has a single letter.
    """
    groups: dict[tuple, list[str]] = {}
    for letter in map(chr, range(block * _SCRIPT_BLOCK, (block + 1) * _SCRIPT_BLOCK)):
        cased = _up(letter) != letter and _up(letter).lower() == letter
        # a capital that comes back from its small letter is written by the small letter's alphabet
        if not letter.isalnum() or letter in _CLASS or (letter.lower() != letter and _up(letter.lower()) == letter):
            continue
        kind = (cased, letter.lower() == letter)
        script = unicodedata.name(letter, "").partition(" ")[0].partition("-")[0]
        groups.setdefault((*kind, script, unicodedata.category(letter)), []).append(letter)
    for kind in {key[:2] for key in groups}:
        own = [key for key in groups if key[:2] == kind]
        alone = [letter for key in own if len(groups[key]) == 1 for letter in groups.pop(key)]
        rest = [groups[key] for key in own if key in groups]
        if len(alone) > 1:
            groups[(*kind, "", "")] = alone
        elif alone and rest:
            max(rest, key=len).extend(alone)
        elif alone:
            groups[(*kind, "", "")] = alone
    alphabets = ["".join(sorted(letters)) for letters in groups.values()]
    return {letter: (alphabet, i) for alphabet in alphabets for i, letter in enumerate(alphabet)}


def _place(letter: str) -> tuple[tuple[str, int] | None, bool]:
    """(alphabet and number of a letter in it, whether it is the capital of that letter); no alphabet for punctuation."""
    low = letter.lower()
    if low != letter and (len(low) > 1 or _up(low) != letter):
        low = letter
    found = _CLASS.get(low)
    if found is None and low.isalnum():
        found = _scripts(ord(low) // _SCRIPT_BLOCK).get(low)
    return found, low != letter


class Permutations:
    """Keyed permutations of the numbers below a size, each a single cycle.

    Feistel rounds over two digits, walked until back in range, put the numbers in order; a number's image is the next.
    """

    def __init__(self, key: bytes, attempts: dict[str, int] | None = None):
        self._key, self._attempts = key, attempts or {}

    def _draw(self, kind: str, turn: int, size: int, value: int) -> int:
        told = f"{kind}|{self._attempts.get(kind, 0)}|{turn}|{size}|{value}".encode()
        return int.from_bytes(blake2b(told, key=self._key, digest_size=16).digest(), "big")

    def number(self, kind: str, value: int, size: int) -> int:
        if size < 2:
            return value
        a = int(size**0.5) if size < 1 << 52 else 1 << (size.bit_length() // 2)
        a = max(a, 2)
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for turn in range(0, 8, 2):
                left = (left + self._draw(kind, turn, size, right)) % a
                right = (right + self._draw(kind, turn + 1, size, left)) % b
            value = left * b + right
            if value < size:
                break
        value = (value + 1) % size
        while True:
            left, right = divmod(value, b)
            for turn in range(6, -2, -2):
                right = (right - self._draw(kind, turn + 1, size, left)) % b
                left = (left - self._draw(kind, turn, size, right)) % a
            value = left * b + right
            if value < size:
                return value

    def spelled(self, kind: str, text: str, alphabet: str | None = None, keep: int = 0) -> str:
        """The letters of a text permuted together, each within its alphabet, in the text's case; others stay.

        The last ``keep`` letters stay too.
        """
        places, value, size = [], 0, 1
        for at, letter in enumerate(text[: len(text) - keep] if keep else text):
            if alphabet:
                found, upper = ((alphabet, alphabet.index(letter)) if letter in alphabet else None), False
            else:
                found, upper = _place(letter)
            if found is None:
                continue
            places.append((at, found[0], upper))
            value, size = value * len(found[0]) + found[1], size * len(found[0])
        value = self.number(kind, value, size)
        out = list(text)
        for at, letters, upper in reversed(places):
            value, digit = divmod(value, len(letters))
            out[at] = _up(letters[digit]) if upper else letters[digit]
        return "".join(out)

    def listed(self, kind: str, names: list[str], name: str) -> str:
        """The next name in a keyed order of the list, so none is its own."""
        order = sorted(names, key=lambda n: self._draw(kind, 0, len(names), names.index(n)))
        return order[(order.index(name) + 1) % len(order)]


def _luhn_digit(body: str) -> str:
    total = 0
    for i, digit in enumerate(reversed(body)):
        n = int(digit) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def _iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _refill(written_as: str, digits: str, wanted: str | None = None) -> str:
    """``digits`` in the places of the digits (the letters of ``wanted``), in order and script; all else as it was."""
    rest = iter(digits)
    if wanted:
        return "".join(next(rest) if c in wanted else c for c in written_as)
    return "".join(
        chr(ord(c) - unicodedata.decimal(c) + int(next(rest))) if c.isdecimal() else c for c in written_as
    )


def _only(text: str) -> str:
    """The digits of a text, of any script, as 0 to 9."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


# what is looked for: kind, what a text must hold for a match to be possible, and the pattern
_DIGIT = re.compile(r"\d")
_SECRET = re.compile(r"(?i)token|passw|passwd|secret|api[_-]?key|access[_-]?key|bearer")
_TITLE = (
    r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra|г-н|г-жа|господин|госпожа|κύριος|κυρία"
    r"|Г-н|Г-жа|Господин|Госпожа|Κύριος|Κυρία)"
)
_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+"
_ANY_NAME = "|".join(sorted(_GROUP, key=len, reverse=True))
_NAME_HINT = re.compile(rf"\b(?:{_TITLE}\b|(?:{_ANY_NAME})\b)")
_PATTERNS = {
    "email": re.compile(r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}"),
    "secret": re.compile(
        r"(?i)(?:token|passw(?:or)?d|passwd|pwd|secret|api[_-]?key|access[_-]?key|bearer)[\"']?\s*(?:[:=]|\s)\s*"
        r"[\"']?(?P<value>(?=[\w+/.=-]*\d)[\w+/.=-]{8,})"
    ),
    "key": re.compile(r"(?<!\w)(?:AKIA|ASIA)(?P<value>[A-Z0-9]{16})(?!\w)"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    "card": re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?![\w])"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "ip": re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    "mac": re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\w:])"),
    "phone": re.compile(
        r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)"
        r"|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,5}){2,5}(?!\w)"
    ),
    "name": re.compile(
        rf"\b(?:{_TITLE}\.?\s+(?P<titled>{_CAPITAL}(?:[ -]{_CAPITAL}){{0,2}})"
        rf"|(?P<given>(?:{_ANY_NAME})(?:[ -]{_CAPITAL}){{1,2}}))"
    ),
}

Entity = tuple[int, int, str]


def find(text: str) -> list[Entity]:
    """(begin, end, kind) of the entities in a text, in order and without overlaps; earlier kinds win."""
    found: list[Entity] = []
    kinds = []
    if "@" in text:
        kinds.append("email")
    if _DIGIT.search(text):
        if _SECRET.search(text):
            kinds.append("secret")
        kinds += ["key", "iban", "card", "ssn", "ip", "mac", "phone"]
    elif ":" in text or "-" in text:
        kinds.append("mac")
    if _NAME_HINT.search(text):
        kinds.append("name")
    for kind in kinds:
        for match in _PATTERNS[kind].finditer(text):
            group = {"secret": "value", "key": "value", "name": match.lastgroup}.get(kind)
            begin, end = match.span(group) if group else match.span()
            if _valid(kind, text[begin:end]) and all(end <= b or begin >= e for b, e, _ in found):
                found.append((begin, end, kind))
    return sorted(found)


def _valid(kind: str, value: str) -> bool:
    if kind == "card":
        digits = _only(value)
        return len(set(digits)) > 1 and _luhn_digit(digits[:-1]) == digits[-1]
    if kind == "iban":
        plain = value.replace(" ", "")
        return 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]
    if kind == "phone":
        return 7 <= len(_only(value)) <= 15
    return True


def canonical(kind: str, value: str) -> str:
    """What entities written differently have in common."""
    if kind in ("card", "ssn"):
        return _only(value)
    if kind == "phone":
        digits = _only(value)
        return digits[1:] if len(digits) == 11 and digits[0] == "1" else digits
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(part)) for part in value.split("."))
    if kind in ("email", "mac"):
        return value.lower()
    return value


def surrogate(perm: Permutations, kind: str, value: str) -> str:
    """The stand-in of an entity, written as the entity is."""
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.rsplit(".", 1)
        if not any(c.isalnum() for c in local + labels[0]):  # nothing but the last label can change
            return f"{local}@{labels[0]}.{perm.spelled('domain', labels[1])}"
        return f"{perm.spelled('email', local)}@{perm.spelled('domain', labels[0])}.{labels[1]}"
    if kind == "card":
        digits = _only(value)
        body = digits[0] + perm.spelled("card", digits[1:-1])
        return _refill(value, body + _luhn_digit(body))
    if kind == "phone":
        digits = _only(value)
        kept = digits[: len(digits) - len(canonical(kind, value))]
        own = digits[len(kept) :]
        head = 0 if kept or len(own) == 10 else min(2, len(own) - 6)
        return _refill(value, kept + own[:head] + perm.spelled("phone", own[head:]))
    if kind == "ssn":
        return _refill(value, perm.spelled("ssn", _only(value)))
    if kind == "iban":
        plain = value.replace(" ", "")
        account = perm.spelled("iban", plain[4:])
        return _refill(value, plain[:2] + _iban_check(plain[:2], account) + account, _CODE)
    if kind == "ip":
        number = 0
        for part in value.split("."):
            number = number << 8 | int(part)
        number = perm.number("ip", number, 1 << 32)
        plain = ".".join(str(number >> shift & 255) for shift in (24, 16, 8, 0))
        zero = ord(value[0]) - unicodedata.decimal(value[0])
        return "".join(chr(zero + int(c)) if c != "." else c for c in plain)
    if kind == "mac":
        out = perm.spelled("mac", value.lower(), _HEX)
        return out.upper() if value.upper() == value else out
    if kind == "key":
        return perm.spelled("key", value, _CODE)
    if kind == "secret":
        return _secret(perm, value)
    return "".join(_name(perm, part) if part.strip(" -") else part for part in re.split(r"([ -])", value))


def _secret(perm: Permutations, value: str) -> str:
    def form(text: str) -> tuple[bool, bool]:
        """Whether a text is a number in hexadecimal digits, and whether these are capitals."""
        return all(c in _HEX for c in text.lower()) and text in (text.lower(), text.upper()), text != text.lower()

    is_hex, capitals = form(value)
    out = value
    while True:  # walk on past the other forms
        if not is_hex:
            out = perm.spelled("secret", out)
        else:
            out = perm.spelled("secret", out.lower(), _HEX)
            out = out.upper() if capitals else out
        if form(out) == (is_hex, capitals):
            return out


def _name(perm: Permutations, name: str) -> str:
    group = _GROUP.get(name)
    if group:
        return perm.listed(group, _NAMES[group], name)
    out = name
    while True:  # walk on past the listed names, which only stand for one another
        out = perm.spelled("name", out, keep=1 if len(out) > 2 else 0)
        if out not in _GROUP:
            return out


def replace(text: str, perm: Permutations) -> tuple[str, list[Entity]]:
    found = find(text)
    if not found:
        return text, found
    out, at = [], 0
    for begin, end, kind in found:
        out += [text[at:begin], surrogate(perm, kind, text[begin:end])]
        at = end
    return "".join([*out, text[at:]]), found


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, value) of all texts, values in canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in texts(batch):
                found.update((kind, canonical(kind, text[b:e])) for b, e, kind in find(text or ""))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in found], pa.string()), pa.array([v for _, v in found], pa.string())],
                names=["kind", "value"],
            )

    return docs.select("text").mapInArrow(run, "kind string, value string").distinct()


def checked_attempts(found: DataFrame, key: bytes = KEY) -> dict[str, int]:
    """The permutation to use for each kind: the first in which no two entities share a stand-in and none is its own."""
    attempts: dict[str, int] = {}
    for _ in range(ATTEMPTS):
        now = dict(attempts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            perm = Permutations(key, now)  # noqa: B023
            for batch in batches:
                kinds, values = batch.column("kind").to_pylist(), batch.column("value").to_pylist()
                images = [canonical(k, surrogate(perm, k, v)) for k, v in zip(kinds, values, strict=True)]
                own = np.array([a == b for a, b in zip(values, images, strict=True)], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind"), pa.array(images, pa.string()), pa.array(own)], names=["kind", "image", "own"]
                )

        images = found.mapInArrow(run, "kind string, image string, own boolean")
        shared = images.groupBy("kind", "image").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
        failed = shared.where((F.col("n") > 1) | F.col("own")).select("kind").distinct().collect()
        if not failed:
            return attempts
        for row in failed:
            # emails and phones use the parts' permutations too
            for name in {"email": ("email", "domain")}.get(row["kind"], (row["kind"],)):
                attempts[name] = attempts.get(name, 0) + 1
    raise RuntimeError("entities and stand-ins keep colliding; use another key")


def pseudonymised(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with stand-ins in ``text`` and a column n_entities behind all others; no shuffle of texts.

    NULL and empty texts stay as they are and hold no entity; texts without an entity stay byte for byte. Repeated rows
    stay repeated. A column of that name in ``docs`` gives way.
    """
    found = written(entities(docs), "surrogate-entities")
    attempts = checked_attempts(found, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        perm = Permutations(key, attempts)
        for batch in batches:
            out, counts = [], []
            for text in texts(batch):
                new, own = replace(text, perm) if text else (text, [])
                out.append(new)
                counts.append(len(own))
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(counts, pa.int64())], names=[*batch.schema.names, "n_entities"]
            )

    docs = docs.drop("n_entities")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, n_entities long")
