import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, row string, hash string, bytes string, carried string, "
    "n int, size int, part int, ids string, ord string, kept string, fp string, name string, score string, fold string, html string"
)
EXTRA = ("x",) * 5 + (1, 2, 3) + ("x",) * 8


def words(n: int, seed: int, vocabulary: int = 200) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdeéß中", k=rng.randint(1, 6))) + str(rng.randrange(vocabulary)) for _ in range(n)]


def hard_texts() -> list[tuple[int | None, str | None]]:
    """Nulls, empty and blank texts, ties, repeated rows, runs, periods, a long text, shared passages, odd characters."""
    shared = " ".join(words(60, 1))
    long = words(30_000, 2, 10**6)
    base = words(80, 3)
    return [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "A b  c"),
        (4, "A b  c"),
        (5, "a B\nc"),
        (6, "a b c d"),
        (None, "no id at all " + shared),
        (7, "before " + shared + " after"),
        (8, shared),
        (9, shared),
        (10, " ".join(long)),
        (11, " ".join(long[:15_000] + ["edit"] + long[15_000:])),
        (12, "ha " * 100),
        (13, "ha " * 57 + "end"),
        (14, "x y " * 50),
        (15, "y x " * 40),
        (16, " ".join(base)),
        (17, " ".join(base[:40] + ["other"] + base[41:])),
        (18, " ".join(base) + "\x85\xa0tail\x1fsep"),
        (19, "  two   spaces  and\r\nlines\x0b\x0c <|endoftext|> it's 😀"),
        (20, "one"),
    ]


def frame(spark, rows):
    data = [(i, t, "en", f"s{k % 3}" if k % 4 else None, None if t is None else len(t), *EXTRA) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="session")
def hard():
    return hard_texts()


@pytest.fixture(scope="session")
def stored_docs(spark, tmp_path_factory):
    """Write rows (id, text) as a table with extra columns of clashing names."""

    def make(rows):
        path = str(tmp_path_factory.mktemp("docs") / "t")
        frame(spark, rows).repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def hard_docs(stored_docs, hard):
    return stored_docs(hard)


@pytest.fixture(scope="session")
def no_docs(stored_docs):
    return stored_docs([])
