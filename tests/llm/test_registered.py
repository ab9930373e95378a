import pytest

from veritrace.llm import queries as llm

COLUMNS = {
    "p1_found": ["audit_id"], "p2_found": ["item_id_a", "item_id_b"], "p4_found": ["rl_id"], "p5_found": ["item_id_a", "item_id_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs(spark, sf, name):
    df = llm.queries()[name](spark, sf)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert rows and (name not in COLUMNS or name == "p6_ids" or len({tuple(r) for r in rows}) == len(rows))
