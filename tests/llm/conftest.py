import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string, kept string, size string"

PASSAGE = " ".join(f"shared{i}" for i in range(60))
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def sentence(seed: int, n: int) -> str:
    """Seeded words, far from one another for different seeds."""
    out, x = [], seed * 2654435761 + 1
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(WORDS[(x >> 33) % len(WORDS)] + str((x >> 40) % 50))
    return " ".join(out)


def edge_rows():
    """Nulls in every column, empty, blank, long, tied and repeated texts, and columns named like results."""
    texts = [(1, sentence(1, 80)), (2, sentence(1, 80)), (3, sentence(3, 40) + " " + PASSAGE + " " + sentence(4, 40)),
             (4, PASSAGE + "\n" + sentence(5, 30)), (5, None), (6, ""), (7, " \t\n "), (8, "1234 5678 !!"), (9, "a"),
             (10, sentence(10, 9000)), (11, "x" * 20000), (12, "word " * 300), (12, "word " * 300), (13, "café <s> ﬀ   \x1c 𝄞"),
             (None, sentence(1, 80)), (None, None), (16, PASSAGE.upper()), (17, "one\ntwo\none\n\none")]
    rows = [(i, t, "en" if k % 3 else None, f"s{k % 3}" if k % 4 else None, None if t is None else len(t), "x", None, "y", "z")
            for k, (i, t) in enumerate(texts)]
    return rows + [rows[2]]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark):
    """The given documents and labels at the smallest size."""
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
