import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, spans int, host string, n int, h int, c int, row int"


def texts() -> list[str | None]:
    r = random.Random(5)
    words = ["".join(r.choice(["an", "th", "er", "ea", "st", "ou", "é", "ñ"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    plain = [" ".join(r.choice(words) for _ in range(r.randint(1, 250))) for _ in range(60)]
    near = []
    for base in plain[:12]:
        for _ in range(5):
            w = base.split()
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(words)
            near.append(" ".join(w))
    odd = [None, "", " \t\n\v\f\r ", "\x1c\x85\u00a0", "A", "a", "one two", "One  TWO", "x" * 50_000, "long word " * 8_000, "the the the the", plain[0], plain[0], plain[0].upper()]
    found = [
        "write a.b@mail.example.com or +1 (269) 555-3296 4524132264652876 from 10.0.0.300 and 10.2.3.4.",
        "under the MIT License. Apache License, Version 2.0; cc-by-nc under the mit license",
        "GNU General Public License, version 3. All rights reserved",
        "you are an idiot and a looser, said “idiot” nobody",
    ]
    return plain + near + odd + found


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    """Documents with nulls anywhere, a hot source, repeated ids and rows, and columns whose names operators use."""
    out = [(i, t, "en", ["src0", "src0", "src1", "src2", None][i % 5], len(t or ""), "x", 1, "h", 1, 2, 3, 4) for i, t in enumerate(texts())]
    return [*out, out[3], out[3], (7, "another text under an id that is taken", *out[7][2:]), (None, "no id here", None, None, None, None, None, None, None, None, None, None), (None,) * 12]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
