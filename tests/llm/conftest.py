import pytest

#: Texts of every awkward kind.
TEXTS = [
    "", None, " ", "\n\n", "a", "A", "one two", "naïve café\nété", "x" * 5000, "word " * 800, "a\tb\nc\rd\x0be\x0cf", "ünï cödé 中文 字 😀", "same line\nsame line\nsame line", "…non breaking spaces…",
    "<|endoftext|> x", "a\x1cb\x1dc", "### Assistant: </turn>", "don't stop,'quoted'", "tab\t\tand  double  spaces ", "1234567890 3.14 0xdeadbeef",
]


@pytest.fixture
def awkward(spark):
    """Awkward texts, some rows repeated, a null id, and columns with clashing names."""
    rows = [(i, t, "src", i, 1.5) for i, t in enumerate(TEXTS)]
    rows += [rows[5], rows[7], (None, "no id here", None, None, None), (3, "same id, other text", "y", 0, 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, bin string, size long, score double")


@pytest.fixture
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")
