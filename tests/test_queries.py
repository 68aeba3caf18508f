from __future__ import annotations

import pytest
from oracle import canonical, connect

from lexispark.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
#: Queries without SQL: tokenizer training, generation and training; other tests check them.
NO_SQL = {
    "pretoken_counts", "pretoken_words", "bpe_merges", "bpe_token_counts", "synthetic_documents", "synthetic_chats", "arithmetic_bank", "sampled_groups", "transformer_loss",
}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_or_a_reason():
    assert QUERIES.keys() - ORACLE.keys() == NO_SQL
    assert ORACLE.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, sf_dir, con, name):
    got, want = QUERIES[name](spark, sf_dir).toPandas(), con.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_point_registers_all(spark):
    import __spark_entry__ as entry

    assert QUERIES.keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0
