import duckdb

from pointloom import plans


def test_zero_signs_nulls_and_negative_values(spark, tmp_path):
    """By text, for -0.0 equals 0.0 as a number."""
    value = "case when range % 10 = 0 then null when range % 10 < 3 then -range / 100.0 else range / 100.0 end::DOUBLE"
    con = duckdb.connect()
    con.sql(f"copy (select range as event_id, timestamp '2024-01-01' as ts, range % 7 as user_id, 'a' as event_type, {value} as value, '{{}}' as props from range(20000)) to '{tmp_path}/events.parquet'")
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    plans.QUERIES["contact_scores"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    rows = "select event_id, columns(* exclude (event_id))::VARCHAR from {} order by event_id"
    told = con.sql(rows.format(f"({plans.SQL['contact_scores']})")).fetchall()
    assert con.sql(rows.format(f"'{tmp_path}/out/*.parquet'")).fetchall() == told
    assert any("-0.0" in r for r in told)
