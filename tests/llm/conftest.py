from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gone string, row string, block int"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    data = [(d, t, "en", s, len(t or ""), "g", "r", 1) for d, t, s in rows]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def docs() -> list[tuple]:
    """(doc_id, text, source): prose, exact and near copies, shared passages and lines, odd texts, null and repeated ids."""
    rnd = random.Random(5)
    parts = "th er on an re he in ed nd ha at en é ü ing tion".split()
    vocab = ["".join(rnd.choices(parts, k=rnd.randint(1, 4))) for _ in range(600)]
    prose = lambda n: "\n".join(" ".join(rnd.choices(vocab, k=12)).capitalize() + "." for _ in range(n // 12))
    rows = [(i, prose(rnd.choice([24, 60, 120, 240])), f"s{i % 3}") for i in range(40)]
    passage = prose(60)
    rows += [(50 + i, prose(60) + "\n" + passage + "\n" + prose(36), "s0") for i in range(6)]
    rows += [(60 + i, rows[3][1], "s1") for i in range(5)]
    for i in range(12):
        w = rows[7][1].split(" ")
        w[rnd.randrange(len(w))] = "changed"
        rows.append((80 + i, " ".join(w), "s2"))
    odd = ["", None, " \n\t ", "one", "a b c", "A  B c", "x " * 300, "y" * 5000, "ab" * 200, "b" + "ab" * 40, "l1\nl1\nl1\nl1\nl1", "é" * 60, "don't  you'll\n\n 's"]
    rows += [(100 + i, t, None if i % 5 == 0 else "s0") for i, t in enumerate(odd)]
    rows += [(None, rows[3][1], "s1"), (None, "alone with no id " * 20, "s1"), (5, rows[5][1], "s2"), (5, rows[5][1], "s2")]
    rnd.shuffle(rows)
    return rows
