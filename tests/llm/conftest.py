import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, block int, node long, part int, component_id long"


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text), with columns whose names the operators use themselves."""

    def made(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 1, 2, 3, 4) for i, t in rows], DOCS)

    return made


def words(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


BASE = words(1, 120)
AWKWARD = [(5, None), (6, ""), (7, " \n\t "), (1, BASE), (2, BASE), (3, BASE + " one more word"), (4, words(2, 40)), (4, words(3, 30)), (None, BASE), (8, "é" * 3000), (9, words(4, 5000)), (10, "tie"), (11, "tie"), (-3, words(5, 60) + "\n" + BASE)]
