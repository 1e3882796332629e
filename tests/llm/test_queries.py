"""Every query runs over whole tables and equals its SQL, where there is one."""

import pytest

from chashma.llm import oracles, queries
from tests.conftest import rows_of, run_sql

TEXTS = (("routing_signal_audit", "sample_id", "sentence_text"), ("validation_documents", "document_sample_id", "normalized_text"), ("seen_texts", "text_id", "text_value"))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, smallest, name):
    got = queries.QUERIES[name](spark, smallest).toPandas()
    assert len(set(got.columns)) == len(got.columns)
    if name in oracles.SQL:
        want = run_sql(smallest, oracles.SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)


def test_forms_of_all_tables(spark, smallest):
    got = queries.p7_forms(spark, smallest)
    rows = " UNION ALL ".join(f"(SELECT DISTINCT '{name}' AS table_name, {key}::VARCHAR AS key, {text} AS text FROM {name})" for name, key, text in TEXTS)
    counts = got.groupBy("table_name").count().toPandas()
    assert rows_of(counts) == rows_of(run_sql(smallest, f'SELECT table_name, count(*) AS "count" FROM ({rows}) GROUP BY 1'))
    forms = got.toPandas()
    assert rows_of(forms[["table_name", "key"]]) == rows_of(run_sql(smallest, f"SELECT table_name, key FROM ({rows})"))
    stored = forms[forms.table_name == "validation_documents"]
    assert stored.stored_sha256.notna().all() and ((stored.form_sha256 == stored.stored_sha256) == ~stored.changed.astype(bool)).all()
    looks = {(r.table_name, r.key): r.look_sha256 for r in forms.itertuples()}
    pairs = queries.p7_found(spark, smallest).collect()
    assert pairs and all(looks[r.table_name, r.key_a] == looks[r.table_name, r.key_b] for r in pairs)
