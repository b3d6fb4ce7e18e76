"""Operators that SQL can express, against that SQL on the smallest tables."""

import os

import pytest

from paperloom.llm import queries

from ..oracle import connect, same

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_equals_its_sql(spark, name):
    same(spark, connect(DATA), DATA, queries.queries()[name], queries.oracle_sql()[name])
