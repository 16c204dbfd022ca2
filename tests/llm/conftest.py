import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Make a documents table from (doc_id, text) or (doc_id, text, lang) rows."""
    from wattline.llm.common import prepare

    prepare(spark)

    def make(rows, schema=SCHEMA):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, schema)

    return make


#: Rows that operators must bear: null text, empty, blanks, repeats, a null id, odd characters, long words and texts.
NASTY = [
    (1, None), (2, ""), (3, "  \n\t "), (4, "a"), (4, "a"), (None, "null id and text"), (None, None), (5, "a b c d e"),
    (6, "\x00 \x1c nul ▁ \U0001f642 é é 你好"), (7, "x" * 30_000), (8, "ab " * 12_000),
    (9, "the same line\n" * 40), (10, "the same line\n" * 40), (9223372036854775807, "largest id"), (-5, "negative"),
]
