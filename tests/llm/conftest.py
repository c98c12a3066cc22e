"""Small tables with the awkward cases that every operator has to stand."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, _words string, runs string, host string, _source string, doc string, row string, n_words string"


def rows_of(texts, start=0):
    return [(start + k, t, "en", f"s{k % 3}", len(t or ""), "k", 1, "w", "r", "h", "s", "d", "o", "n") for k, t in enumerate(texts)]


PASSAGE = " ".join(f"word{k} of the passage" for k in range(40))
#: Null and empty texts, ties, copies, white space, long lines and texts.
TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "two words",
    "A line that comes again\nshort\n  a LINE that comes again \nnot this one, though",
    "A line that comes again\nshort\n  a LINE that comes again \nnot this one, though",
    "begins " + PASSAGE + " ends",
    "otherwise " + PASSAGE + "\nand more",
    "spam " * 300,
    "naïve café 日本語 \U0001f642 <|endoftext|> 's 12345 ###$$$\n\n\n",
    "x" * 5000,
    "\n".join(f"line number {k} of a long text" for k in range(3000)),
    "a\x85b\xa0c d",
]


@pytest.fixture(scope="session")
def awkward(spark):
    """Texts with columns whose names clash with those that operators use; nulls in every column; repeated rows."""
    rows = rows_of(TEXTS)
    rows += [rows[5], rows[7], rows[9]]  # repeated rows
    rows += [(None, "A line that comes again\nwithout an id", *[None] * 12)]
    rows += [(None, PASSAGE, "en", "", 3, "", 0, *[""] * 7)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
