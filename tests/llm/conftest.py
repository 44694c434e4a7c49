import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, n string, key string, row string, shard string, slot string, bucket string, score string, y string, component string, shingle string, count string, _id string"


def frame(spark, rows):
    """Documents of (doc_id, text), with columns whose names operators use inside."""
    more = [None if i % 2 else f"x{i}" for i in range(13)]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), *more) for i, t in rows], DOCS)


def prose(rng, n, words=800):
    return " ".join(f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('bcdfglmnprst')}{rng.randrange(words)}" for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def odd_rows(rng):
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = prose(rng, 60_000)
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "One two"), (6, long), (7, long), (8, "same text here again and again"), (8, "same text here again and again"), (9, "same text here again and again"), (None, "no id but words all the same"), (10, "é" * 400 + " ß 𝔘𝔫𝔦"), (11, "x" * 300_000), (12, "<|im_end|> <\\|im_start|> \\ |")]
