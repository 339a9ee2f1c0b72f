import random

import pytest

#: Columns that operators use inside or return; tables may have them already.
CLASHING = ["key", "ranges", "kept", "cid", "n", "token", "score", "lang_pred", "n_words", "hit_spans", "own_id", "kinds"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd_texts() -> list[str | None]:
    """Nulls, empty and blank texts, one word, repeats, all sorts of white space and letters, and a long text."""
    rng = random.Random(11)
    words = ["der", "und", "the", "of", "été", "naïve", "日本", "a", "b", "no.", "Token", "x=1", "…"]
    prose = [" ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(120)) for _ in range(3)]
    return [
        None, "", " ", "\n\n", "word", "one two three four", "tab\tand\x0bmore\r\nlines   here", "12 345 !!",
        prose[0], prose[0], prose[0].upper(), prose[1] + "\n" + prose[2], prose[2] + "\n" + prose[1], "same " * 300,
        "\n".join(prose) * 60, "é" * 900, "é \U0001f600 done",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd texts with clashing columns, null ids and languages, and a row that repeats as a whole."""
    texts = odd_texts()
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[8], rows[0], (None, "a text without an id, of some words", "de", "s", 1), (None, None, None, None, None)]
    made = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        made = made.selectExpr("*", f"'mine' AS {name}")
    return made


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
