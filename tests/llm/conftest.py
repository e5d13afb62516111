from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, token string, key string, shard int, cls string"
WORDS = [f"w{k}" for k in range(400)]


def words(rng: random.Random, n: int) -> list[str]:
    return [rng.choice(WORDS) for _ in range(n)]


def odd_texts() -> list[str | None]:
    """Copies, near copies, shared passages, personal data, blanks, nulls and a long text."""
    rng = random.Random(11)
    base = words(rng, 120)
    passage = words(rng, 45)
    texts: list[str | None] = [None, "", "  \n\t ", "one", "one two three", "One TWO three", "é漢😀 ß", "\x1c separators stay words \x1f"]
    texts += [" ".join(base)] * 4
    for k in range(12):
        near = list(base)
        for at in rng.sample(range(len(near)), 1 + k % 4):
            near[at] = f"edit{k}x{at}"
        texts.append(" ".join(near))
    texts += [" ".join(words(rng, 30 + k) + passage + words(rng, 20)) for k in range(10)]
    texts += [" ".join(words(rng, rng.randint(1, 90))) + ("\n" if k % 3 else "\n\n  x") + " ".join(words(rng, 25)) for k in range(25)]
    texts += ["mail me a.b@mail.example.com or +1 (415) 555-2671 now", "host 10.0.0.1 card 4111 1111 1111 1111 end", "bad 256.1.1.1 and 4111111111111112"]
    texts.append(" ".join(words(rng, 9000)))
    texts.append("same line here\nsame line here\n" + "again and again it goes " * 9)
    return texts


@pytest.fixture(scope="session")
def odd_rows():
    """Document rows, out of order, with clashing extra columns and two repeated rows."""
    texts = odd_texts()
    rows = [(3 * k + 1, t, ("en", "de", None, "??")[k % 4], "s", None, "t", "k", 9, "c") for k, t in enumerate(texts)]
    rows += [rows[9], rows[40]]
    random.Random(2).shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
