import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, registers string, score string, row string, mix_copies int, whole int, hit_items string, lang_pred string, h int, `block` int, digest string, data string"


def prose(rng, n, words="the of river stone cloud paper green under seven light table winter garden".split()):
    made = [rng.choice(words) + rng.choice(["", "s", "ed", "ing", "er", "ly"]) + str(rng.randrange(60)) for _ in range(n)]
    return " ".join(made)


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang, source): nulls, empty texts, equal and near copies, repeated rows and
    doc_ids, one very long text, one hot source."""
    rng = random.Random(3)
    base = [prose(rng, 150) for _ in range(25)]
    near = [b.replace(b.split()[7], "changed", 1) for b in base[:8]]
    far = [" ".join(b.split()[:75] + prose(rng, 75).split()) for b in base[8:16]]
    rows = [(i, t) for i, t in enumerate(base + near + far + base[:4])]
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "ONE"), (105, "a b"), (106, "A\tb"), (107, prose(rng, 20000)), (108, "läuft ça où été 12.5, ok.\n\n  x"), (108, "läuft ça où été 12.5, ok.\n\n  x"), (109, base[0]), (109, prose(rng, 100)), (None, base[1]), (None, None), (110, base[2] * 2), (111, "\x00 a\x0bb  <|endoftext|> tail"), (112, "aaaa" * 60), (113, "12 !? 34"), (114, "日本語 текст 😀 a")]
    langs = ["en", "fr", None]
    return [(i, t, langs[k % 3], "hot" if k % 3 else (None if k % 5 == 0 else f"s{k % 4}")) for k, (i, t) in enumerate(rows)]


def frame(spark, texts):
    rows = [(i, t, la, s, len(t or ""), "r", "s", "x", 9, 9, "h", "zz", 1, 2, "d", "e") for i, t, la, s in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with more columns, whose names the operators use inside."""
    return frame(spark, texts).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
