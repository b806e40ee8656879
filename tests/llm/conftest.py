import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard int, size string, component_id string, _text string, row_number long"


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(2 + rng.randrange(size) % 7)) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Documents with copies, near copies, shared passages and lines, a very long text, and rows without text or id."""
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randrange(60, 200))) for _ in range(30)]
    passage = " ".join(words(rng, 70))
    line = "a line that many of the documents hold, in these same words"
    rows: list[tuple] = []
    for i, t in enumerate(base):
        rows.append((i, t))
    rows += [(100, base[0]), (101, base[0].replace(" ", "\t ")), (102, base[0].upper())]
    near = base[1].split()
    near[5] = "changed"
    rows.append((103, " ".join(near)))
    near = base[2].split()
    near[10], near[40] = "other", "again"
    rows.append((104, " ".join(near)))
    for i in range(4):
        rows.append((110 + i, " ".join(words(rng, 50)) + "\n" + line + ("!" if i == 3 else "") + "\n" + passage + " " + " ".join(words(rng, 30))))
    rows.append((120, " ".join(words(rng, 40_000))))
    rows += [(130, None), (131, ""), (132, " \n\t "), (133, "one two"), (134, "One two"), (135, "..."), (None, base[3]), (None, None), (136, "é " * 30), (30, base[4]), (30, base[4])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The same as a table, with other columns whose names the operators use themselves."""
    rng = random.Random(1)
    langs, sources = ["en", "fr", None], ["s1", "s2", "s3", None]
    rows = [(i, t, rng.choice(langs), rng.choice(sources), len(t or ""), 5, "x", "y", "z", 9) for i, t in texts]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
