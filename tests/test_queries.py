import pytest
from oracle import DATA, connect, same_rows

from lattisym.queries import ORACLE, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLE:
        same_rows(spark, connect(), QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, str(DATA)).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_search_stemmed_reads_all_documents(spark):
    import regex

    from lattisym.functions.porter import stem

    def found(text):
        words = {stem(x) for x in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())}
        return {stem("the"), stem("ing")} <= words

    want = sorted(x.doc_id for x in spark.read.parquet(f"{DATA}/documents.parquet").collect() if found(x.text))
    got = QUERIES["search_stemmed"](spark, str(DATA))
    assert want and got.columns == ["doc_id"] and sorted(x.doc_id for x in got.collect()) == want
