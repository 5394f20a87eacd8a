import pytest

WORDS = [f"word{i}" for i in range(60)]


def prose(seed: int, n: int) -> str:
    import random

    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randint(0, 99)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash."""
    rows = [(i, prose(i, 60 + i), "x") for i in range(12)]
    rows += [(12, rows[3][1], "x"), (12, rows[3][1], "x"), (13, "", None), (14, None, "x"), (None, rows[5][1], None), (15, prose(99, 30_000), "x")]
    rows += [(16, "x" * 100_000, "x"), (17, rows[4][1].replace("word", "WORD"), "x"), (18, " \n\t\n ", "x"), (19, "\n".join(prose(k, 12) for k in range(6)), "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").selectExpr(
        "doc_id", "text", "n_tokens", "doc_id AS _id", "text AS _text", "'s' AS shard", "1 AS n_words", "2 AS score", "3 AS fp", "4 AS size", "5 AS row"
    )


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(12)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
