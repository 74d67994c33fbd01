import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source)."""

    def build(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or ""), *r[4:]) for r in rows]
        return spark.createDataFrame(full, DOCS + extra)

    return build


@pytest.fixture(scope="session")
def odd(make):
    """NULLs, empty and long texts, repeated rows and ids, clashing columns."""
    text = "the quick brown fox jumps over the lazy dog and runs away from it all"
    rows = [(1, text), (1, text), (1, "another text under the same id"), (None, text), (2, None), (3, ""), (4, "  "), (5, "\n\t 12 !!"), (6, "word " * 60_000), (7, "x" * 300_000), (8, text, None, None), (9, "é漢😀\x00▁ ok", "fr", "t")]
    # long runs that a search could go through again and again
    rows += [(10, "ACGT" * 250_000 + "1"), (11, "1" * 300_000 + "." + "2" * 300_000 + "." + "3." * 150_000), (12, "a at b dot " * 90_000)]
    clash = (0.5, "c", 1, 2, "k", "w")
    return make([(*(r if len(r) > 2 else (*r, "en", "s")), *clash) for r in rows], ", score double, contamination string, copies int, copy int, toxicity_score string, w string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
