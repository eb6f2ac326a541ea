import random
import re

import pytest

#: Columns of documents, and extra ones whose names the operators use within themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, size int, a long, part int, _text string, `group` string"


def words(text):
    """Words as the operators see them: runs of ASCII letters and digits and of characters beyond ASCII, in lower case."""
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def prose(seed, n, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) + str(rng.randrange(vocabulary) % 7) for _ in range(n))


def make(spark, rows):
    """Documents of (doc_id, text[, lang[, source]])."""
    full = [(*r, *("en", "s")[len(r) - 2 :])[:4] for r in rows]
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1, 2, 3, 4, "x", "g") for i, t, lang, s in full], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and wordless texts, repeated rows, ties, one word, and a very long text."""
    long = prose(1, 60_000)
    rows = [
        (1, None, "en", "s"), (2, "", "en", "s"), (3, "  \n\t ", None, "s"), (4, "?!. ,;", "xx", None), (None, prose(2, 300), "de", "s"), (None, None, None, None),
        (5, prose(3, 200), None, None), (5, prose(3, 200), None, None), (6, prose(3, 200), "fr", "t"), (7, "word", "en", "t"), (8, "word", "en", "u"), (9, long, "en", "u"), (10, "naïve café 杭州 😀 ", "es", "t"), (None, prose(3, 200), "en", "s"),
    ]
    df = make(spark, rows).unionAll(spark.createDataFrame([(None,) * 11], SCHEMA))
    return df


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
