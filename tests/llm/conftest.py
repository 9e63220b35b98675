import pytest

from .plain import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept string, uid string, n int, label string, verdict string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 7, "z", "w") for i, t, s in rows], COLUMNS)


@pytest.fixture(scope="session")
def corpus_rows():
    """Copies, near copies, shared passages, nulls, blanks, a long text, a hot source, junk; repeated rows."""
    base = [prose(k, 160) for k in range(12)]
    rows = [(k, t, "hot" if k % 3 == 0 else f"s{k % 2}") for k, t in enumerate(base)]
    rows += [(20 + k, base[0], "hot") for k in range(6)]
    words = base[1].split(" ")
    for k in range(6):
        near = list(words)
        near[10 * k + 5] = f"changed{k}"
        rows.append((30 + k, " ".join(near), "s1"))
    passage = prose(99, 90)
    rows += [(40 + k, prose(200 + k, 60) + "\n" + passage + "\n" + prose(300 + k, 60), None) for k in range(4)]
    rows += [
        (50, None, "hot"), (51, "", "s0"), (52, " \t\n ", "s0"), (53, "three short words", "s0"), (54, "three short words", "s0"), (55, "Three SHORT words", None),
        (56, " ".join(prose(k, 400) for k in range(400, 420)), "s1"), (57, "Again " * 500, "s1"), (58, "Again " * 480, "s1"), (59, "é" * 900, "s0"),
        (None, base[2], "s0"), (60, base[3], "s0"), (60, base[3], "s0"),
        (65, prose(600, 120), "s1"), (65, prose(600, 120), "s1"),  # a document that is listed twice
        (61, base[4] + "\nReleased under the MIT License.\nAll rights reserved.", "s0"),
        (62, "Licensed under CC BY-NC 4.0. cc by cc by\n" + base[5], "s0"),
        (63, " ".join(w + "###" for w in prose(500, 120).split()), "s0"), (64, (prose(501, 12) + "\n") * 9, "s0"),
    ]
    return rows


@pytest.fixture(scope="session")
def corpus(spark, corpus_rows):
    return frame(spark, corpus_rows).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def blank(spark):
    return frame(spark, [(1, None, None), (None, None, None), (2, "", "s")])
