import random

import pytest

COLUMNS = (
    "doc_id long, text string, lang string, source string, n_chars long, key long, n int, hub long, version string, lines string, block int, component string, "
    "line int, word string, size int, copy boolean, diagonal long, fingerprint string, train string, tune string"
)


def prose(seed: int, n: int) -> str:
    """Words of invented syllables, a sentence end now and then."""
    r = random.Random(seed)
    words = ["".join(r.choice(("ka", "to", "mi", "ren", "sol", "dra", "ve", "lun")) for _ in range(r.randint(1, 3))) for _ in range(n)]
    return " ".join(w + ("." if r.random() < 0.1 else "") for w in words)


@pytest.fixture(scope="session")
def make(spark):
    """Documents with columns whose names the operators use themselves."""

    def build(rows):
        extra = [7, 8, 9, "v", "l", 3, "c", 4, "w", 5, True, 6, "f", "t", "u"]
        full = [(i, t, "en", "s", None if t is None else len(t), *extra) for i, t in rows]
        return spark.createDataFrame(full, COLUMNS)

    return build


LONG = prose(1, 60_000)
PASSAGE = prose(2, 70)
EDGES = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, LONG), (6, PASSAGE), (6, PASSAGE), (7, PASSAGE), (8, prose(3, 50)), (8, prose(4, 50)),
    (9, prose(3, 50)), (None, PASSAGE), (10, "!!! ??? 123"), (11, "x" * 100_000), (12, "Ünïcödé 日本語 🙂 text"), (13, "Ünïcödé 日本語 🙂 text"),
]
