import random
import re

import pytest

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def odd_texts():
    """Texts with everything that tends to break: null, empty, blank, short, long, repeated."""
    rng = random.Random(4)
    words = [a + b for a in "bcdfgklm" for b in ("a", "e", "ier", "ung", "été", "ño")]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, shared = prose(120), prose(40)
    near = base.split()
    near[60] = "changed"
    texts = [None, "", " \n\t ", "one", "One", "two words", "!!! 123 ---", "漢字 かな", "\x00 \x00a", base, base, " ".join(near)]
    texts += [prose(30) + " " + shared + "\n" + prose(30) for _ in range(6)]
    texts += [prose(20_000), "same " * 400, "line one here\n" * 30, shared, base.upper(), "x" * 50_000]
    texts += [prose(rng.randrange(1, 90)) for _ in range(30)]
    return texts


@pytest.fixture(scope="session")
def texts():
    return odd_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [
        (i, t, [None, "en", "fr"][i % 3], [None, "src0", "src0", "src1"][i % 4], len(t or ""))
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same documents with further columns named like those of the operators."""
    names = ["id", "n", "v", "phrase", "words", "score", "bucket", "pattern", "kept", "bit", "s", "at"]
    out = docs
    for name in names:
        out = out.selectExpr("*", f"'extra' AS {name}")
    return out
