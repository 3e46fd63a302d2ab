import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, held_out string, nid string, tid string, kept string, runs string, ids string, word string, band string, gone_id string, twice_id string, hit_items string, hit_ranges string"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names operators use themselves."""

    def make(*rows, lang="en"):
        full = [(i, t, lang if not isinstance(lang, dict) else lang.get(i), "s", None if t is None else len(t), *["x"] * 13) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Cases that every operator has to take: null and empty texts, null ids, repeated rows, blanks, a long text.
ODD = [(1, None), (2, ""), (None, "no id here"), (3, "same"), (3, "same"), (4, " \n\t "), (5, "word " * 20000), (6, "é漢字😀 \U0001f600 ▁"), (None, None)]


@pytest.fixture
def odd(docs):
    return docs(*ODD)
