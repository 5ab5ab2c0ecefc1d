import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `_block` int, `_id` int, n_lines int, fp int, `_size` int"


@pytest.fixture(scope="session")
def table(spark):
    """Makes a documents table; further columns bear names that operators use inside."""

    def make(rows):
        full = []
        for row in rows:
            doc, text, source = (*row, "src0")[:3]
            full.append((doc, text, "en", source, len(text or ""), 1, 2, 3, 4, 5))
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


def words(rng, n, size=60):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Copies, near copies, shared lines, edge cases."""
    rng = random.Random(5)
    shared = " ".join(words(rng, 14)) + " shared line of many documents"
    rows = []
    for i in range(60):
        lines = [" ".join(words(rng, rng.randint(3, 15))) for _ in range(rng.randint(1, 9))]
        if i % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), shared if i % 2 else "  " + shared.upper() + "\t")
        rows.append((i, "\n".join(lines), f"src{i % 4}"))
    rows += [(100 + k, rows[7][1], "src1") for k in range(8)]
    rows += [(200 + k, rows[9][1] + f" tail{k}", "src2") for k in range(6)]
    rows += [(300, None, "src1"), (301, "", None), (302, " \n\t \n", None), (303, "one", "é"), (304, "Ünï cödé 中文 😀 <|endoftext|> it's.", "é")]
    rows += [(305, "ab " * 4000 + "end", "src3"), (306, "x" * 9000, "src3")]
    rows += [(7, rows[7][1], "src3"), (8, rows[8][1], "src0"), (None, "no id here but some words follow on", "src0")]
    return rows
