import random

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use themselves.
CLASHES = "score double, size bigint, key string, cell string, component string, rep string, n int, rank int, __text string, target double, words string, row int, shard int"


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n))


def rows(seed=1, n=40):
    """Ordinary texts, near copies, exact copies, repeated rows, nulls, empty, short and very long texts, odd characters."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randrange(30, 200)) for _ in range(n)]
    near = [" ".join(w if i != 5 else "changed" for i, w in enumerate(t.split())) for t in texts[:5]]
    odd = [None, "", "   \n\t ", "one", "one two", "Ünïcödé Straße \U0001f600 İ ǅ", "a\x00b \x1c\x85 c", "| ### </turn> \\ <|endoftext|> <p>", sentence(rng, 30_000), "x" * 300_000, texts[0], texts[0].upper(), "THE!! LOUD!! WORDS!! " * 20]
    out = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts + near + odd)]
    out += [out[3], out[3], (None, texts[7], None, None, None), (None, None, "en", "s0", 0), (7, "another text of id seven", "en", "", 1)]
    return out


@pytest.fixture(scope="session")
def documents(spark):
    return spark.createDataFrame(rows(), DOCUMENTS).cache()


@pytest.fixture(scope="session")
def clashing(spark):
    extra = (0.5, 1, "k", "c", "x", "r", 1, 2, "t", 0.1, "w", 3, 4)
    return spark.createDataFrame([(*r, *extra) for r in rows()], f"{DOCUMENTS}, {CLASHES}").cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], f"{DOCUMENTS}, {CLASHES}")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i < 45), 0) for i in range(58)] + [(None, 1, 0), (3, None, 0), (4, 0, 1)], "doc_id bigint, quality int, toxic int")
