from __future__ import annotations

import ipaddress
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.llm import pii
from ebbtide.llm.queries import op6_pii

KEYED = pii.Keyed(b"test key")
PLAIN = pii.Surrogates(b"test key")
SAMPLE = (
    "Mr. John Smith and Frau Dr. Anna Müller-Lüd wrote el.01@mail8.example.com, A.B@x.org; tel +1 (168) 555-5254 or "
    "168-555-5254, ip 10.1.2.3 and 85.134.245.158, card 4845168114407329, IBAN DE89 3704 0044 0532 0130 00, "
    "2001:0db8:0000:0000:0000:ff00:0042:8329, 123-45-6789, Госпожа Анна Иванова. Mr Smith left."
)
CLEAN = "On 2024-01-31 at 12:30 the 9807915762804490 items cost 1,234.50; v1.2.3, 300.1.2.3, a@b, @name, 50% of x. Order 12345678 Mr"


def values(text):
    return [(k, text[s:e]) for k, s, e in pii.detect(text)]


def test_detection():
    assert values(SAMPLE) == [
        ("person", "Mr. John Smith"),
        ("person", "Frau Dr. Anna Müller-Lüd"),
        ("email", "el.01@mail8.example.com"),
        ("email", "A.B@x.org"),
        ("phone", "+1 (168) 555-5254"),
        ("phone", "168-555-5254"),
        ("ipv4", "10.1.2.3"),
        ("ipv4", "85.134.245.158"),
        ("card", "4845168114407329"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("ipv6", "2001:0db8:0000:0000:0000:ff00:0042:8329"),
        ("ssn", "123-45-6789"),
        ("person", "Госпожа Анна Иванова"),
        ("person", "Mr Smith"),
    ]
    assert values(CLEAN) == [] and PLAIN.replace(CLEAN) == (CLEAN, [])


def test_format_and_coreference():
    text, found = PLAIN.replace(SAMPLE)
    for _, start, end in found:
        assert SAMPLE[start:end] not in text
    new = values(text)
    assert [k for k, _ in new] == [k for k, _ in values(SAMPLE)]
    for (kind, old), (_, made) in zip(values(SAMPLE), new, strict=True):
        if kind not in ("person", "iban", "ipv4"):
            assert re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", made))) == re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", old))) or kind in ("email", "ipv6")
    assert new[0][1].split()[-1] == new[-1][1].split()[-1]
    assert new[4][1][-12:].replace(") ", "-") == new[5][1].replace(" ", "-")[-12:] or new[4][1][-8:] == new[5][1][-8:]
    assert ipaddress.ip_address(new[6][1]).is_private == ipaddress.ip_address("10.1.2.3").is_private
    assert re.fullmatch("Госпожа [а-яА-Я]+ [а-яА-Я]+", new[12][1])
    assert PLAIN.replace(SAMPLE)[0] == text != pii.Surrogates(b"other key").replace(SAMPLE)[0]


def test_gender_endings():
    given_names = {g: {KEYED.name(f"given:{g}:latin", f"n{i}", 3) for i in range(50)} for g in ("male", "female")}
    assert all(n[-1] == "a" for n in given_names["female"]) and all(n[-1] in "nrsk" for n in given_names["male"])


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 3000), st.text(max_size=3))
def test_permutations_move_everything(size, tweak):
    moved = [KEYED.derange(i, size, tweak) for i in range(size)]
    assert sorted(moved) == list(range(size)) and all(i != m for i, m in enumerate(moved))


def test_formatted_surrogates_are_distinct():
    rng = random.Random(1)
    emails = {f"{a}{b:02d}@mail{c}.example.com" for a in ("ab", "é", "x.y") for b in range(60) for c in range(5)}
    made = {KEYED.email(e) for e in emails}
    assert len(made) == len(emails) and not any(KEYED.email(e) == e for e in emails)
    cards = set()
    while len(cards) < 300:
        body = "".join(rng.choices("0123456789", k=15))
        cards.add(body + str(pii.luhn(body)))
    new = {KEYED.card(c) for c in cards}
    assert len(new) == 300 and all(pii._valid("card", c) for c in new)
    addresses = {str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)}
    assert len({KEYED.ipv4(a) for a in addresses}) == len(addresses)
    assert pii._valid("iban", KEYED.iban("DE89370400440532013000"))


def test_collisions_are_found_and_resolved(spark, monkeypatch):
    """One syllable of one choice: nearly all names collide, and all must end up distinct and new."""
    names = [f"Mr {a}{b}an Q{b}{a}oster" for a in "BDGKLMNPRT" for b in ("ae", "io", "uu", "ie")]
    docs = spark.createDataFrame([(i, f"Here is {n}. {names[0]} too.") for i, n in enumerate(names)], "doc_id long, text string")
    monkeypatch.setattr(pii, "LENGTH", 1)
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("b d f", "a", {"male": "n", "female": "a", "any": "e"}))
    model = pii.fit(docs, b"k")
    assert len(model.exceptions) > 20
    slots = {(slot, name.lower()) for n in names for slot, name, _, _ in pii.name_slots(n)}
    keyed = pii.Keyed(b"k")
    made = {s: model.exceptions.get(s) or keyed.name(*s, model.syllables).lower() for s in slots}
    for kind in ("given", "family"):
        own = [v for (slot, _), v in made.items() if slot.startswith(kind)]
        assert len(set(own)) == len(own)
    assert not set(made.values()) & {n for _, n in slots}


def test_too_many_exceptions_are_joined(spark, monkeypatch):
    """The same texts whether the exceptions travel with the tasks or are joined, null and repeated rows included."""
    names = [f"Mr {a}{b}an Q{b}{a}oster" for a in "BDGKLMNPRT" for b in ("ae", "io")]
    texts = [*(f"Here is {n}. {names[0]} too, {n.split()[1]} said." for n in names), f"{names[3]} again", None, "", "no one"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(pii, "LENGTH", 1)
    monkeypatch.setitem(pii.SYLLABLES, "latin", ("b d f", "a", {"male": "n", "female": "a", "any": "e"}))
    few = pii.fit(docs, b"k")
    monkeypatch.setattr(pii, "EXCEPTIONS", 3)
    many = pii.fit(docs, b"k")
    assert few.more is None and many.more is not None and not many.exceptions

    def result(model):
        return sorted((r.doc_id, r.replaced.text, r.replaced.n_entities) for r in pii.replaced(docs, model).collect() if r.replaced.text is not None)

    assert result(few) == result(many) and len(result(few)) == len(texts) - 2
    assert pii.replaced(docs, many).columns == ["doc_id", "text", "replaced"]


def test_names_without_syllables_end_distinct(spark):
    """Scripts without syllables: surrogates that are real names draw again, from longer names."""
    letters = [chr(0x10D0 + i) + chr(0x10D0 + j) for i in range(33) for j in range(33)]
    docs = spark.createDataFrame([(i, f"Mr {n}") for i, n in enumerate(letters)], "doc_id long, text string")
    model = pii.fit(docs, b"k")
    assert model.exceptions
    made = {model.exceptions.get(("family:any:other", n)) or KEYED.__class__(b"k").name("family:any:other", n, pii.LENGTH) for n in letters}
    assert len(made) == len(letters) and not made & set(letters)


PROBES = {
    "Mr. John Smith came. John Smith left; Smith said.": ["Mr. John Smith", "John Smith", "Smith"],
    "Dr. Anna Maria von der Leyen spoke.": ["Dr. Anna Maria von der Leyen"],
    "Mrs. de la Cruz met Mr. O'Brien.": ["Mrs. de la Cruz", "Mr. O'Brien"],
    "Smith's hat. Mr J. R. Smith. SMITH, smith and Smithson.": ["Smith", "Mr J. R. Smith", "SMITH"],
    "\u0627\u0644\u0633\u064a\u062f \u0645\u062d\u0645\u062f. \u0645\u062d\u0645\u062f": ["\u0627\u0644\u0633\u064a\u062f \u0645\u062d\u0645\u062f", "\u0645\u062d\u0645\u062f"],
    "Monsieur d'Artagnan, Mr. McDonald-Jones. Jones": ["Monsieur d'Artagnan", "Mr. McDonald-Jones"],
    "Mr. said nothing, Dr. 5, Mr. T.": [],
}


def test_names_of_every_form():
    for text, persons in PROBES.items():
        assert values(text) == [("person", p) for p in persons], text


def test_untitled_mentions_keep_identity():
    text, _ = PLAIN.replace("John said: Mr. John Smith came. John Smith left; Smith said. Dr. Smith, JOHN and John's.")
    w = re.findall(r"\w+", text)
    john, smith = w[0], w[4]
    assert "John" not in text and "Smith" not in text and john != smith
    assert text == f"{john} said: Mr. {john} {smith} came. {john} {smith} left; {smith} said. Dr. {smith}, {john.upper()} and {john}'s."
    kept = PLAIN.replace("Dr. Anna Maria von der Leyen spoke.")[0]
    assert re.fullmatch(r"Dr\. \w+ \w+ von der \w+ spoke\.", kept) and not re.search("Anna|Maria|Leyen", kept)
    assert re.fullmatch(r"Mrs\. de la \w+ met Mr\. \w+\.", PLAIN.replace("Mrs. de la Cruz met Mr. O'Brien.")[0])
    anna = PLAIN.replace("Dr. Anna Berg, Mrs. Anna Berg")[0]
    assert anna[4:].split(",")[0] == anna.split("Mrs. ")[1] and anna[4:].split()[0].endswith("a")
    arabic = PLAIN.replace("\u0627\u0644\u0633\u064a\u062f \u0645\u062d\u0645\u062f")[0].split()
    assert arabic[0] == "\u0627\u0644\u0633\u064a\u062f" and all("\u0600" <= c < "\u0700" for c in arabic[1])


def test_names_against_brute_force():
    """Random texts with known names: what is not a name stays, and every name has one surrogate in all texts."""
    rng = random.Random(7)
    known = {"Otto": "given", "Ulla": "given", "Kern": "family", "O'Hara": "family", "Weiss": "family", "Ng": "family"}
    plain = ["went home,", "(see 5)", "and", "Berlin", "the", "x.", "Kernel", "otto", "-"]
    made: dict[str, set[str]] = {}
    for _ in range(300):
        pieces, told = [], set()
        for given_name in rng.sample(["Otto", "Ulla"], rng.randint(0, 2)):
            family = rng.choice([n for n, k in known.items() if k == "family"])
            pieces.append(["Dr. ", given_name, " ", family, ";"])
            told |= {given_name, family}
        pieces += [[rng.choice(plain)] for _ in range(6)] + [[n] for n in rng.choices(list(known), k=5) if n in told]
        rng.shuffle(pieces)
        flat = [x for piece in pieces for x in [*piece, " | "]]
        text, _ = PLAIN.replace("".join(flat))
        pattern = "".join(r"([^\W\d_]+)" if x in told else re.escape(x) for x in flat)
        found = re.fullmatch(pattern, text)
        assert found, ("".join(flat), text)
        for name, new in zip([x for x in flat if x in told], found.groups(), strict=True):
            made.setdefault(name, set()).add(new)
    assert all(len(v) == 1 for v in made.values()) and len(set.union(*made.values())) == len(made) == len(known)
    assert not set.union(*made.values()) & set(known)


def test_surrogates_stay_when_documents_are_added(spark):
    first = [(i, f"Mr. Carl Name{chr(97 + i)}x wrote") for i in range(20)]
    more = [(100 + i, f"Frau Eva Other{chr(97 + i)}y wrote") for i in range(26)]
    one, two = (spark.createDataFrame(rows, "doc_id long, text string") for rows in (first, first + more))
    old = {r.doc_id: r.replaced.text for r in pii.replaced(one, pii.fit(one, b"k")).collect()}
    new = {r.doc_id: r.replaced.text for r in pii.replaced(two, pii.fit(two, b"k")).collect()}
    assert all(new[i] == t for i, t in old.items()) and len(set(new.values())) == 46


def test_awkward_rows(spark, awkward, nothing):
    model = pii.fit(awkward, b"k")
    rows = awkward.select("text", pii.replace_entities(model, F.col("text")).alias("n")).collect()
    assert all(r.n.text == r.text and r.n.n_entities == 0 for r in rows)
    assert nothing.select(pii.replace_entities(pii.fit(nothing, b"k"), F.col("text"))).count() == 0
    frame = spark.createDataFrame([("x " * 200_000 + SAMPLE,)], "text string")
    text = frame.select(pii.replace_entities(model, F.col("text"))["text"].alias("t")).first().t
    assert text.startswith("x " * 200_000) and len(values(text)) == 14


def test_query_replaces_all_that_is_planted(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    planted = re.compile(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])")
    seen = 0
    for r in op6_pii(spark, folder).collect():
        old = texts[r.doc_id]
        found = planted.findall(old)
        seen += len(found)
        assert not any(f in r.text for f in found)
        assert (r.n_entities > 0) == (r.text != old) and (r.n_entities or r.text == old)
    assert seen > 20
