import pytest
from compare import same

from tidewheel import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same(catalogue.QUERIES[name](spark, SF), catalogue.ORACLE_SQL[name], SF) == "same"


def test_largest_first_flush_equals_a_plain_list(spark):
    flushed = sorted(tuple(r) for r in catalogue.largest_first_flush(spark, SF).collect())
    want = []
    docs = sorted((r["doc_id"], len(r["text"].encode())) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    for m in range(8):
        held, most, gone = {}, 0, []

        def flush():
            p = min(held, key=lambda k: (-held[k], k))  # noqa: B023
            gone.append((p, held.pop(p)))  # noqa: B023
            return max(held.values(), default=0)  # noqa: B023

        for d, n in docs:
            if d % 8 == m:
                held[d % 5] = held.get(d % 5, 0) + n
                if held[d % 5] > most:
                    most = held[d % 5]
                elif sum(held.values()) > 30_000:
                    most = flush()
        while held:
            flush()
        want += [(m, i, p, n) for i, (p, n) in enumerate(gone)]
    assert flushed == sorted(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
