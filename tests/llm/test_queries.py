import pytest

from dialoom.llm import queries
from tests.oracle import DATA, same

COLUMNS = {
    "p1_found": ["conv_id", "turn", "defect"],
    "p2_found": ["tab", "key_a", "key_b"],
    "p3_found": ["train_row_id", "val_row_id"],
    "p4_found": ["item_a", "item_b"],
    "p5_found": ["tab", "keep_id", "copy_id"],
    "p7_found": ["item_id", "doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        rows = df.collect()
        assert rows and len(rows) == len(set(rows))
    else:
        assert df.count() > 0
