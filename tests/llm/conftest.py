from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, term string, key_id string, words string"
ENGLISH = "the quick brown fox jumps over the lazy dog and then it runs through the green field near the river with joy"
FRENCH = "le renard brun saute par dessus le chien paresseux et puis il court dans le champ vert au bord de la rivière"
GERMAN = "der schnelle braune Fuchs springt über den faulen Hund und dann läuft er durch das grüne Feld neben dem Fluss"
SPANISH = "el zorro marrón salta sobre el perro perezoso y luego corre por el campo verde cerca del río con mucha alegría"


def doc(i, text, lang=None, source="src1"):
    return (i, text, lang, source, None if text is None else len(text), "f", "r", "t", "k", "w")


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, clashing extra columns."""
    rows = [
        doc(1, None),
        doc(2, ""),
        doc(3, " \t\n\x0b "),
        doc(4, ENGLISH, "en"),
        doc(4, ENGLISH, "en"),
        doc(4, FRENCH, "fr"),
        doc(None, GERMAN, "de", None),
        (None,) * 10,
        doc(7, "12345 67890 !!", "en"),
        doc(8, f"{ENGLISH} " * 3000, "en", "src2"),
        doc(9, "É", "fr", "odd"),
        doc(10, SPANISH, "es"),
        doc(11, "a\u0000b <|im_end|> \U0001f600 ẞ", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
