import pytest

# Texts with every awkward case: null, empty, blanks only, ties, repeats,
# multi-byte characters, one very long text.
LONG = " ".join(f"word{i % 977} x{i % 13}." for i in range(30_000))
TEXTS = [None, "", " \t\n\x0b\x0c\r", "one", "One two", "a b c", "A  b\tc", "same words here again and again and again",
         "same words here again and again and again", "Éa ñü 日本語 𝒳 ß", "the\nthe\n\nthe", "x" * 3000, LONG, LONG,
         "#*$%&|<> ### the | of", "it's we'll  12 345\n\n  end ", "\u00a0 nbsp\u2003em"]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def awkward(spark):
    """Rows with null ids, repeated rows and clashing extra columns."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id text of some words"), (None, None), (3, "one")]
    names = ("score run rank kind spans at hits copy fp rep component_id fingerprint predicted lang template words "
             "n_words ids page_id host path seg _spans _spans_of first last").split()
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(*r, *["clash"] * len(names)) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
