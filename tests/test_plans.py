"""What plans read: only the columns that a rule names, also where it has an order."""

import re

import pytest

from tideql.queries.base import engine

FOLDER = "/root/testdata/sf0.001"
RULES = {
    "SELECT event_id, lag(value) AS l FROM events": {"event_id", "ts", "value"},
    "SELECT count(*) AS c, max(event_id) AS m FROM events GROUP BY COUNTWINDOW(7)": {"event_id", "ts"},
    "SELECT window_end() AS e, count(*) AS c FROM events GROUP BY SLIDINGWINDOW(mi, 20)": {"ts"},
    "SELECT event_id FROM events WHERE value > 10": {"event_id", "value"},
}


@pytest.mark.parametrize("text", sorted(RULES))
def test_only_named_columns_are_read(spark, text):
    plan = engine(spark, FOLDER).explain(text)
    read = {c.split(":")[0] for schema in re.findall(r"ReadSchema: struct<(.*)>", plan) for c in re.findall(r"\w+:\w+", schema)} - {"_tmp_metadata_row_index"}  # the row's number, which no file holds
    assert read == RULES[text]
    if "WHERE" in text:
        assert "GreaterThan(value,10.0)" in plan and "_metadata" not in plan
