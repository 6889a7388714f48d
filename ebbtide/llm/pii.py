"""Personal data: detection, and surrogates that keep type, format, script, gender and identity.

Every detected entity gets a replacement that depends on a secret key and the entity alone, so one entity has
one surrogate everywhere (coreference) and no table of replacements is needed to apply it:

* Formatted values (mail addresses, telephone and card numbers, network addresses, account numbers) go through
  a keyed permutation of all values of the same format: letters become letters of the same alphabet and case,
  digits become digits, separators stay, check digits are computed anew. A permutation without fixed points
  gives different values different surrogates, none its own.
* Names become names made of syllables in the same script, with the ending of the same gender; initials become
  initials, and particles (``von der``) stay. The length is fixed, so a name keeps its surrogate when documents
  are added. Two names can meet by chance, so a collision check over all names of the corpus finds those whose
  surrogates agree with another's or with a real name; they get longer names of their own, checked again until
  none is left. These exceptions travel with the tasks while they are few, and are joined to the texts otherwise.

A person is found after a title, and then at every other mention of one of their names in the same text, before or
after, alone or in a longer word. Names that no title introduces stay. In scripts without capitals at most two words
after a title are the name. A name has one slot (given or family, gender, script) in a text, so one surrogate:
given goes before family, a known gender before none, and then the first titled mention decides.

Defined results: null stays null and empty stays empty; texts without entities come back unchanged; repeated
rows get equal texts; overlapping detections keep the first, and of those that start together the longest.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.session import materialize

RESULT = "text string, n_entities int, found array<struct<kind: string, start: int, end: int>>"
NAMES = "array<struct<slot: string, name: string>>"
EXCEPTIONS = 10_000
LENGTH = 4

# Titles that announce a person, by gender.
TITLES = {
    "male": "Mr Mister Sir Herr Herrn Monsieur Señor Sr Signor Господин Κύριος السيد מר",
    "female": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra Srta Signora Госпожа Κυρία السيدة الدكتورة גברת",
    "any": "Dr Prof Professor Doktor Docteur Doctor الدكتور",
}
GENDER = {title: gender for gender, titles in TITLES.items() for title in titles.split()}

# Lower-case words inside a name that are no names themselves.
PARTICLES = frozenset("de la las los del della der den des di da do dos du van von vom zu zum zur ter ten te le el al bin ibn bint y e af av".split())

# Consonants and vowels that name syllables are made of, and endings by gender, by script.
SYLLABLES = {
    "latin": ("b d f g h k l m n p r s t v z br dr kl st tr", "a e i o u", {"male": "n r s k", "female": "a ia ina ela", "any": "e el en"}),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х", "а е и о у", {"male": "н р в к", "female": "а ия ина ела", "any": "о ен"}),
    "greek": ("β γ δ ζ κ λ μ ν π ρ σ τ φ χ", "α ε ι ο υ", {"male": "ος ης ας", "female": "α ια η ινα", "any": "ι ου"}),
    "arabic": ("ب ت ج ح د ر ز س ش ص ط ع ف ق ك ل م ن ه", "ا و ي", {"male": "د ر م ن", "female": "ة اء", "any": "ب ل"}),
    "hebrew": ("ב ג ד ה ז ח ט כ ל מ נ ס פ צ ק ר ש ת", "א ו י", {"male": "ל ב ר", "female": "ה ית", "any": "ד ש"}),
}

_TITLE = "|".join(sorted((re.escape(t) for t in GENDER), key=len, reverse=True))
_LETTER = r"[^\W\d_]"
_WORD = re.compile(rf"{_LETTER}+(?:['’-](?!s(?!\w)){_LETTER}+)*")
_TITLED = re.compile(rf"(?:{_TITLE})(?=\.?[ ])")
_NEXT = re.compile(rf"\.?[ ]({_WORD.pattern})")
UNCASED_WORDS = 2
_LOCAL = re.compile(r"[\w.%+-]")
_HOST = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_NUMBERS = re.compile(r"[0-9][0-9 ().+-]{5,}")
NUMBERS = {
    "ipv4": re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)"),
    "ssn": re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    "phone": re.compile(
        r"(?<![\w+.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}"
        r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-])"
    ),
}
_IBAN = re.compile(r"[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        doubled = int(d) * (2 if i % 2 == 0 else 1)
        total += doubled - 9 * (doubled > 9)
    return -total % 10


def iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _valid(kind: str, value: str) -> bool:
    plain = re.sub(r"[ -]", "", value)
    if kind == "card":
        return luhn(plain[:-1]) == int(plain[-1]) and len(set(plain)) > 1
    if kind == "ipv4":
        return all(int(o) < 256 and (o == "0" or o[0] != "0") for o in value.split("."))
    if kind == "iban":
        return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]
    if kind == "phone":
        return 7 <= sum(c.isdigit() for c in value) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("@")
    while at >= 0:
        start = at
        while start and _LOCAL.match(text[start - 1]):
            start -= 1
        while start < at and text[start] in ".-":
            start += 1
        host = _HOST.match(text, at + 1)
        if start < at and text[at - 1] != "." and host:
            yield start, host.end()
        at = text.find("@", at + 1)


def _candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, negative length and kind of everything that may be an entity; each pattern looks only near its mark."""
    for start, end in _emails(text):
        yield start, start - end, "email"
    for run in _NUMBERS.finditer(text):
        before = text[max(0, run.start() - 2) : run.start()]
        start = run.start() - len(before) + len(before.rstrip("+("))
        for kind, pattern in NUMBERS.items():
            at = start
            while m := pattern.search(text, at, run.end() + 2):
                valid = _valid(kind, m.group())
                if valid:
                    yield m.start(), m.start() - m.end(), kind
                at = m.end() if valid else _past(text, m)
    for m in _IBAN.finditer(text):
        if not text[m.start() - 1 : m.start()].isalnum() and _valid("iban", m.group()):
            yield m.start(), m.start() - m.end(), "iban"
    if text.count(":") >= 7:
        for m in _IPV6.finditer(text):
            yield m.start(), m.start() - m.end(), "ipv6"


def _is_name(word: str) -> bool:
    """A capital anywhere, or no letter that sentences write as a capital; one letter alone is an initial."""
    return len(word) > 1 and (any(c.isupper() for c in word) or all(c.title() == c for c in word))


def _is_initial(word: str) -> bool:
    return len(word) == 1 and word.isupper()


def _titled(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every title with the name after it: names and initials, particles between them."""
    for title in _TITLED.finditer(text):
        if text[title.start() - 1 : title.start()].isalnum():
            continue
        at, end, uncased, named, dotted = title.end(), 0, 0, False, True
        while m := _NEXT.match(text, at):
            word = m.group(1)
            if m.group()[0] == "." and not dotted:
                break  # a dot behind a whole name ends it
            dotted = False
            if word in GENDER:
                if end:
                    break
                dotted = True
            elif _is_initial(word):
                end, dotted = m.end() + (text[m.end() : m.end() + 1] == "."), True
            elif word not in PARTICLES:
                uncased += not any(c.isupper() for c in word)
                if not _is_name(word) or uncased > UNCASED_WORDS:
                    break
                end, named = m.end(), True
            at = m.end()
        if named:
            yield title.start(), end


def _slots(persons: Iterable[str]) -> dict[str, str]:
    """The one slot of every name, in lower case, of the titled persons of a text."""
    best: dict[str, tuple[bool, bool, str]] = {}
    for person in persons:
        for slot, name, _, _ in name_slots(person):
            kind, gender, _ = slot.split(":")
            choice = (kind == "given", gender != "any", slot)
            if name.lower() not in best or choice[:2] > best[name.lower()][:2]:
                best[name.lower()] = choice
    return {name: slot for name, (_, _, slot) in best.items()}


def _mentions(text: str, names: dict[str, str]) -> Iterator[tuple[int, int]]:
    """Start and end of the runs of words that are ``names``; a word of several parts may be one or hold some."""
    start = end = -1
    for word in _WORD.finditer(text):
        parts = [word] if word.group().lower() in names else re.finditer(rf"{_LETTER}+", word.group())
        base = 0 if parts == [word] else word.start()
        for m in parts:
            if m.group().lower() not in names or not _is_name(m.group()):
                continue
            if text[end : base + m.start()] != " " or end < 0:
                if end >= 0:
                    yield start, end
                start = base + m.start()
            end = base + m.end()
    if end >= 0:
        yield start, end


def analyse(text: str) -> tuple[list[tuple[str, int, int]], dict[str, str]]:
    """``kind, start, end`` of the entities of a whole text, from left to right, and the slot of every name."""
    found = list(_candidates(text))
    titled = list(_titled(text))
    names = _slots(text[start:end] for start, end in titled)
    if names:
        found += [(start, start - end, "person") for start, end in [*titled, *_mentions(text, names)]]
    kept, at = [], 0
    for start, length, kind in sorted(set(found)):
        if start >= at:
            at = start - length
            kept.append((kind, start, at))
    return kept, names


def detect(text: str) -> list[tuple[str, int, int]]:
    """``kind, start, end`` of the entities of a whole text, from left to right."""
    return analyse(text)[0]


def _past(text: str, m: re.Match) -> int:
    """After a match that is no entity: behind its first word, so that what follows is still looked at."""
    end = m.start() + 1
    while end < m.end() and text[end].isalnum():
        end += 1
    return end


# ---- keyed permutations of a format --------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def alphabet(char: str) -> str:
    """Characters of the same kind: digits, or the letters of the same case in the same block of 128."""
    if char.isascii():
        return "0123456789" if char.isdigit() else "abcdefghijklmnopqrstuvwxyz"
    block = ord(char) // 128 * 128
    same = [c for c in map(chr, range(block, block + 128)) if c.isalpha() and c.lower() == c and len(c.lower()) == 1]
    return "".join(same) if char in same else char


@dataclass(frozen=True)
class Keyed:
    """Deterministic choices under a secret key."""

    key: bytes

    def number(self, *parts: object) -> int:
        message = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=16).digest(), "big")

    def _permute(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """A permutation of ``range(size)``: a balanced Feistel network, walked until it lands inside."""
        half = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in reversed(range(8)) if back else range(8):
                if back:
                    left, right = right ^ (self.number(tweak, r, left) & mask), left
                else:
                    left, right = right, left ^ (self.number(tweak, r, right) & mask)
            value = left << half | right
            if value < size:
                return value

    def derange(self, value: int, size: int, tweak: str) -> int:
        """A permutation of ``range(size)`` that moves every value (for two values or more)."""
        if size < 2:
            return value
        step = 1 + self.number(tweak, "step") % (size - 1)
        return self._permute((self._permute(value, size, tweak) + step) % size, size, tweak, back=True)

    def reformat(self, value: str, tweak: str) -> str:
        """Another value of the same format: letters and digits move inside their alphabets, the rest stays."""
        lowered = [c.lower() if len(c.lower()) == 1 else c for c in value]
        sets = [alphabet(c) if c.isalnum() and (c.isalpha() or c.isascii()) else c for c in lowered]
        number = size = 0
        size = 1
        for c, letters in zip(lowered, sets, strict=True):
            number, size = number * len(letters) + letters.index(c), size * len(letters)
        shape = "".join(letters[0] for letters in sets)
        number = self.derange(number, size, f"{tweak}:{shape}")
        out = []
        for c, letters in zip(reversed(value), reversed(sets), strict=True):
            number, place = divmod(number, len(letters))
            out.append(letters[place].upper() if c != c.lower() and len(letters[place].upper()) == 1 else letters[place])
        return "".join(reversed(out))

    def digits(self, value: str, tweak: str) -> str:
        """``value`` with its digits moved as one number of their count; separators stay in place."""
        plain = "".join(c for c in value if c.isdigit())
        moved = iter(str(self.derange(int(plain), 10 ** len(plain), f"{tweak}:{len(plain)}")).zfill(len(plain)))
        return "".join(next(moved) if c.isdigit() else c for c in value)

    # ---- by kind ----

    def email(self, value: str) -> str:
        local, _, host = value.rpartition("@")
        labels, _, top = host.rpartition(".")
        return f"{self.reformat(local, 'local')}@{self.reformat(labels, 'host')}.{top}"

    def phone(self, value: str) -> str:
        m = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        country = m.group() if m else ""
        return country + self.digits(value[len(country) :], "phone")

    def card(self, value: str) -> str:
        body = self.digits(value[:-1], "card")
        return body + str(luhn("".join(c for c in body if c.isdigit())))

    def ipv4(self, value: str) -> str:
        """Another address; the reserved ranges (private, loopback, multicast and so on) keep to themselves."""
        number, reserved = int(ipaddress.IPv4Address(value)), _reserved(value)
        while True:
            number = self.derange(number, 1 << 32, "ipv4")
            if _reserved(out := str(ipaddress.IPv4Address(number))) == reserved:
                return out

    def ipv6(self, value: str) -> str:
        return self.reformat_hex(value)

    def reformat_hex(self, value: str) -> str:
        plain = "".join(c for c in value if c != ":")
        moved = iter(f"{self.derange(int(plain, 16), 16 ** len(plain), f'hex:{len(plain)}'):0{len(plain)}x}")
        return "".join(":" if c == ":" else next(moved).upper() if c.isupper() else next(moved) for c in value)

    def iban(self, value: str) -> str:
        account = self.reformat(value[4:], "iban")
        return value[:2] + iban_check(value[:2], re.sub(" ", "", account)) + account

    def ssn(self, value: str) -> str:
        return self.digits(value, "ssn")

    # ---- names ----

    def name(self, slot: str, name: str, syllables: int, retry: int = 0) -> str:
        """A made-up name; ``slot`` is ``given:gender:script`` or ``family:any:script``.

        Every ``retry`` is another draw from longer names: a syllable more, or a letter in scripts without syllables.
        """
        _, gender, script = slot.split(":")
        if script not in SYLLABLES:
            return self.reformat(name + name[-1] * retry, f"{slot}:{retry}" if retry else slot)
        starts, vowels, endings = SYLLABLES[script]
        starts, vowels, ends = starts.split(), vowels.split(), endings[gender].split()
        n, out = self.number(slot, name.lower(), *([retry] if retry else [])), ""
        for _ in range(syllables + retry):
            n, i = divmod(n, len(starts))
            n, j = divmod(n, len(vowels))
            out += starts[i] + vowels[j]
        out = out.rstrip("".join(vowels)) + ends[n % len(ends)] if ends[n % len(ends)][0] in vowels else out + ends[n % len(ends)]
        return _cased(out, name)


def _cased(made: str, like: str) -> str:
    return made.upper() if len(like) > 1 and like.isupper() else made.capitalize()


def _reserved(address: str) -> bool:
    a = ipaddress.IPv4Address(address)
    return a.is_private or a.is_loopback or a.is_multicast or a.is_reserved or a.is_link_local or a.is_unspecified


def script_of(name: str) -> str:
    c = ord(name[0])
    if c < 0x250 or 0x1E00 <= c < 0x1F00:
        return "latin"
    ranges = {"greek": (0x370, 0x400), "cyrillic": (0x400, 0x530), "hebrew": (0x590, 0x600), "arabic": (0x600, 0x700)}
    return next((script for script, (low, high) in ranges.items() if low <= c < high), "other")


def _name_words(value: str) -> Iterator[re.Match]:
    """The words of a person that are names or initials: titles before them and particles are left out."""
    named = False
    for m in _WORD.finditer(value):
        if m.group() not in PARTICLES and (named or m.group() not in GENDER):
            named = True
            yield m


def name_slots(value: str) -> Iterator[tuple[str, str, int, int]]:
    """``slot, name, start, end`` of the names of a titled person; the last one is the family's."""
    gender = "any"
    names = [m for m in _name_words(value) if not _is_initial(m.group())]
    for m in _WORD.finditer(value):
        if m.group() not in GENDER:
            break
        gender = GENDER[m.group()] if GENDER[m.group()] != "any" else gender
    for i, m in enumerate(names):
        kind, sex = ("family", "any") if i == len(names) - 1 else ("given", gender)
        yield f"{kind}:{sex}:{script_of(m.group())}", m.group(), m.start(), m.end()


# ---- the operator --------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Surrogates:
    """All that replacing needs: the key, the length of names and the names with a name of their own.

    ``more`` is the table ``slot, name, surrogate`` of the latter where they are too many to travel with the tasks.
    """

    key: bytes
    syllables: int = LENGTH
    exceptions: dict[tuple[str, str], str] = field(default_factory=dict)
    more: DataFrame | None = None

    def person(self, keyed: Keyed, value: str, slots: dict[str, str], own: dict[tuple[str, str], str]) -> str:
        out, at = [], 0
        for m in _name_words(value):
            word = m.group()
            if _is_initial(word):
                made = keyed.reformat(word, "initial")
            else:
                slot = slots[word.lower()]
                made = own.get((slot, word.lower()))
                made = _cased(made, word) if made else keyed.name(slot, word, self.syllables)
            out += [value[at : m.start()], made]
            at = m.end()
        return "".join(out) + value[at:]

    def replace(
        self, text: str, keyed: Keyed | None = None, own: dict[tuple[str, str], str] | None = None
    ) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with surrogates, and the entities' spans in the original; ``own`` replaces ``exceptions``."""
        keyed, own = keyed or Keyed(self.key), self.exceptions if own is None else own
        (found, slots), out, at = analyse(text), [], 0
        if not found:
            return text, found
        for kind, start, end in found:
            value = text[start:end]
            out += [text[at:start], self.person(keyed, value, slots, own) if kind == "person" else getattr(keyed, kind)(value)]
            at = end
        return "".join(out) + text[at:], found


def names_in(text: Column) -> Column:
    """The different names of a text column, as ``slot, name`` in lower case."""
    kind = pa.list_(pa.struct([("slot", pa.string()), ("name", pa.string())]))

    @F.arrow_udf(NAMES)
    def names(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            slots = (_slots(t[start:end] for start, end in _titled(t)) for t in (item.as_py() or "" for item in texts))
            yield pa.array([[{"slot": slot, "name": name} for name, slot in found.items()] for found in slots], kind)

    return names(text)


def _made(key: bytes):
    """Column function of ``slot, name, syllables, retry``: the surrogate in lower case."""

    @F.arrow_udf("string")
    def made(slots: pa.Array, names: pa.Array, syllables: pa.Array, retries: pa.Array) -> pa.Array:
        keyed = Keyed(key)
        rows = zip(slots.to_pylist(), names.to_pylist(), syllables.to_pylist(), retries.to_pylist(), strict=True)
        return pa.array([keyed.name(slot, name, k, retry).lower() for slot, name, k, retry in rows], pa.string())

    return made


def fit(docs: DataFrame, key: bytes) -> Surrogates:
    """The collision check: all different names of all documents, and longer surrogates where two would meet.

    Of names that meet, the one of the fewest retries (then the least) keeps its surrogate, and the others draw
    again until no two names of a kind share one and none is a real name. The table stays in Spark.
    """
    found = docs.select(F.explode(names_in(F.col("text"))).alias("n")).select("n.slot", "n.name").distinct()
    names = materialize(found)
    if names.isEmpty():
        return Surrogates(key)
    made, length = _made(key), F.lit(LENGTH)
    real = names.select(F.col("name").alias("surrogate")).distinct().withColumn("taken", F.lit(True))
    table = names.withColumn("retry", F.lit(0))
    table = materialize(table.withColumn("surrogate", made("slot", "name", length, "retry")))
    while not (clash := materialize(_clashes(table, real))).isEmpty():
        again = clash.withColumn("retry", F.col("retry") + 1).withColumn("surrogate", made("slot", "name", length, "retry"))
        table = materialize(table.join(clash, ["slot", "name"], "left_anti").unionByName(again))
    own = table.where("retry > 0").select("slot", "name", "surrogate")
    if own.limit(EXCEPTIONS + 1).count() > EXCEPTIONS:
        return Surrogates(key, LENGTH, more=own)
    return Surrogates(key, LENGTH, {(r.slot, r.name): r.surrogate for r in own.collect()})


def _clashes(table: DataFrame, real: DataFrame) -> DataFrame:
    """Rows ``slot, name, retry`` whose surrogate is a real name, or that of another name of the same kind before them."""
    kind = F.substring_index("slot", ":", 1)
    order = F.struct("retry", "slot", "name")
    owners = table.groupBy(kind.alias("kind"), "surrogate").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    shared = table.withColumn("kind", kind).join(owners.where("n > 1"), ["kind", "surrogate"])
    shared = shared.where(order != F.col("first")).select("slot", "name", "retry")
    taken = table.join(real, "surrogate", "left_semi").select("slot", "name", "retry")
    return shared.union(taken).distinct()


def _replacer(model: Surrogates):
    """Column function of a text and its own exceptions ``slot, name, surrogate`` (null: those of the model)."""
    key, spans = model.key, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    model = Surrogates(key, model.syllables, model.exceptions)

    @F.arrow_udf(RESULT)
    def replace(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        keyed = Keyed(key)
        for texts, owns in batches:
            new, found = [], []
            for item, own in zip(texts, owns, strict=True):
                t, rows = item.as_py(), own.as_py()
                names = None if rows is None else {(r["slot"], r["name"]): r["surrogate"] for r in rows}
                made, entities = model.replace(t, keyed, names) if t else (t, [])
                new.append(made)
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in entities])
            arrays = [pa.array(new, pa.string()), pa.array(map(len, found), pa.int32()), pa.array(found, spans)]
            yield pa.StructArray.from_arrays(arrays, names=["text", "n_entities", "found"])

    return replace


OWN = "array<struct<slot: string, name: string, surrogate: string>>"


def replaced(docs: DataFrame, model: Surrogates, text: str = "text", out: str = "replaced") -> DataFrame:
    """``docs`` and a struct ``out`` of ``text, n_entities, found``; spans are code points of the original.

    Exceptions too many to travel are joined to the texts that hold their names, by a hash of the text: a text's own
    names are a bounded list, and copies share one row of it.
    """
    replace = _replacer(model)
    if model.more is None:
        return docs.withColumn(out, replace(F.col(text), F.lit(None).cast(OWN)))
    digest, key = F.sha2(F.col(text), 256), f"__digest_{out}"
    held = docs.select(digest.alias(key), F.explode(names_in(F.col(text))).alias("n")).select(key, "n.slot", "n.name").distinct()
    own = held.join(model.more, ["slot", "name"]).groupBy(key).agg(F.collect_list(F.struct("slot", "name", "surrogate")).alias(f"__own_{out}"))
    joined = docs.withColumn(key, digest).join(own, key, "left")
    return joined.withColumn(out, replace(F.col(text), F.col(f"__own_{out}"))).drop(key, f"__own_{out}")


def replace_entities(model: Surrogates, text: Column) -> Column:
    """Struct ``text, n_entities, found`` of a text column, for a model whose exceptions travel with the tasks."""
    if model.more is not None:
        raise ValueError("the exceptions of this model are a table; use replaced()")
    return _replacer(model)(text, F.lit(None).cast(OWN))
