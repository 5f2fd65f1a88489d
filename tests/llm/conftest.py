import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, h long, y long, _id long, _bad long, _gone long, row long, component long, k1 long, item_id long, `range` long, rest long, part long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns, of names that the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None, *[7] * 13) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
