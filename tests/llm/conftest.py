import pytest


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def documents(spark, rows, extra=True):
    """A documents frame from (doc_id, text) rows, with columns whose names an operator may use itself."""
    names = ["n_tokens", "copy", "part", "length", "rank", "score", "kept", "block", "component_id"] if extra else []
    ddl = "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", {n} string" for n in names)
    return spark.createDataFrame([(i, t, "en", None, len(t or ""), *["x"] * len(names)) for i, t in rows], ddl)


ODD_ROWS = [
    (1, None),
    (2, ""),
    (None, "a text without a number, of which there are two"),
    (None, "a text without a number, of which there are two"),
    (5, "same same same\nsame same same\n \t\n"),
    (5, "same same same\nsame same same\n \t\n"),
    (6, "one"),
    (7, "It's the café's ñandú —  \n\n tabs\tand\x0bfeeds\r\n"),
    (8, "word " * 9000),
    (9, "".join(chr(0x4E00 + i % 977) for i in range(5000))),
]
