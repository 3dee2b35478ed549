import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, part long, size string, set int"


@pytest.fixture(scope="session")
def sample_texts():
    """Invented texts: near and exact copies, shared lines, short, long, empty, null."""
    random = np.random.default_rng(5)
    words = ["w%d" % k for k in range(400)] + ["The", "of", "and", "Éa", "x,", "y."]

    def text(n):
        return " ".join(random.choice(words, n)).replace(" x,", ",\n", 1)
    base = [text(int(n)) for n in random.integers(5, 200, 40)]
    out = list(base)
    for k in range(0, 30, 3):
        changed = base[k].split(" ")
        changed[len(changed) // 2] = "changed"
        out += [" ".join(changed), base[k]]
    chain = text(120).split(" ")
    for k in range(8):                                   # each close to the next, the ends apart
        out.append(" ".join(["c%d_%d" % (j, 1) if j < 2 * k else w for j, w in enumerate(chain)]))
    out += ["", None, "   \n\t", "one", "one two", "One TWO", text(6000), "123 456 !!", "All rights reserved 2021", "All rights reserved 2022",
            "All rights reserved 2023\nown text here", "All rights reserved 2021"]
    return out


@pytest.fixture(scope="session")
def documents(spark, sample_texts):
    """Rows with clashing extra columns, a null source, a repeated row and a null id."""
    rows = [(k, t, ["en", "fr", None][k % 3], [None, "a", "b", "hot", "hot", "hot"][k % 6], None if t is None else len(t), 7, "x", k)
            for k, t in enumerate(sample_texts)]
    rows += [rows[0], rows[3], (None, "no id here at all", "en", "b", 17, 1, "y", 0)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


CLASHING = "n long, total long, size long, _size long, k int, _k int, doc int, _doc int, source_ int, _source int, name int, hash int, _hash int, drops int, _drops int, gone int, _gone int, set_ int, n_lines int, n_dropped int, of int, copy int, line int"


@pytest.fixture(scope="session")
def clashing(spark, sample_texts):
    """Documents whose other columns have the names that operators would like to use."""
    names = [c.split()[0] for c in CLASHING.split(", ")]
    rows = [(k, t, "a" if k % 3 else "b", *(100 * k + j for j in range(len(names)))) for k, t in enumerate(sample_texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, source string, {CLASHING}")
