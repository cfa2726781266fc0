"""The corpus queries run over the smallest tables and agree with their SQL."""

import zlib

import pytest

import __spark_entry__ as entry
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
NAMES = [f"op{n}_" for n in range(1, 14)] + ["pipeline"]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("prefix", NAMES)
def test_query(spark, con, prefix):
    (name,) = [n for n in entry.queries() if n.startswith(prefix)]
    _, rows, error = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF)
    assert error is None, error
    assert rows > 0


def held_out(spark, name, folds, fold, truth, column):
    rows = entry.queries()[name](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == fold) for r in rows)
    pairs = [(truth[r.doc_id], r[column]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_language_on_held_out_documents(spark, con):
    truth = dict(con.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    assert held_out(spark, "op1_language_id", 3, 1, truth, "lang_pred") > 0.97


def test_quality_on_held_out_documents(spark, con):
    truth = dict(con.execute("SELECT doc_id, quality FROM labels").fetchall())
    assert held_out(spark, "op5_quality", 4, 2, truth, "predicted") > 0.9
