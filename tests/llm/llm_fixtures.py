"""Tables with every odd case, shared by the tests here."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _rid long, size long, name string, fp long, words string"


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty, white-space and long texts, ties, repeated rows, copies, near copies and columns with clashing names."""
    prose = "The quick brown fox jumps over the lazy dog near the old river bank while seven grey geese fly home before the rain starts again"
    texts = [None, "", " \n\t", "one", "two words", prose, prose, prose.replace(" ", "\n"), prose + " today", prose.upper(),
             "spam spam spam spam spam " * 40, "héllo wörld ñandú " * 5, "x" * 5000, (prose + ". ") * 400, "a" + " b c d e f g" * 3000,
             "Call +44 20 7946 0958 or mail jo.doe@mail.example.com from 10.0.0.1, card 4111 1111 1111 1111.",
             "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "word*** word### " * 30]
    rows = [(i, t, "en", [None, "a", "b", "c"][i % 4], None, True, i % 2, 7, "n", None, "w") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, prose, None, None, None, None, None, None, None, None, None), (None, None, None, "a", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3, "doc_id").cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
