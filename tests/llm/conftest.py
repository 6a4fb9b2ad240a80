import random

import pytest

from lonja.llm.store import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, minimizer string, fp string, copies string, size string, hash string"
VOCABULARY = "the of and in to a is was tree river stone house light water north wind small great under over run walk".split()


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text[, lang, source]) as documents with extra columns whose names clash with internal ones."""

    def make(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), "x", "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions) if full else spark.createDataFrame([], SCHEMA)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Documents with exact and near copies, shared passages, ties, repeated words, blanks, nulls and one long text."""
    rng = random.Random(7)
    passage, base = words(rng, 60), words(rng, 200)
    rows = [(i, words(rng, rng.randint(1, 120))) for i in range(30)]
    rows += [(30 + i, base) for i in range(4)]
    changed = base.split()
    for i in range(6):
        near = list(changed)
        near[17 * i + 3] = f"changed{i}"
        rows.append((40 + i, " ".join(near)))
    rows += [(50 + i, words(rng, 30) + " " + passage + "\n" + words(rng, 30)) for i in range(5)]
    rows += [(60, "the " * 70), (61, "the the " * 50), (62, passage + "\t" + passage), (63, ""), (64, None), (65, " \n\t "), (66, "één café ñandú 日本語 " * 8), (67, "word"), (68, "two words")]
    rows += [(70, words(rng, 20_000)), (71, "A. B C " * 30), (72, "x" * 5000)]
    return rows
