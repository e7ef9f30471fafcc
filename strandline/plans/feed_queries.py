"""The queries p1 to p3 over the change feed, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators.history import attribute_history
from strandline.operators.lsm import current_state
from strandline.operators.skew import key_medians, key_modes
from strandline.sources.tables import table

QUERIES = {
    "p1_found": lambda spark, d: attribute_history(table(spark, d, "triple_changes")),
    "p2_found": lambda spark, d: key_medians(table(spark, d, "triple_changes")),
    "p2_modes": lambda spark, d: key_modes(table(spark, d, "triple_changes"), "property_id", "new_value"),
    "p3_found": lambda spark, d: current_state(table(spark, d, "triple_changes")),
    "p3_kinds": lambda spark, d: table(spark, d, "triple_changes").groupBy(F.lower(F.trim("change_type")).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows")),
}

_CHANGES = """
WITH c AS (
  SELECT entity_id, property_id, revid, epoch_us(CAST(change_timestamp AS TIMESTAMPTZ)) AS ts, old_value, new_value,
         lower(trim(change_type)) AS kind
  FROM triple_changes
  QUALIFY row_number() OVER (PARTITION BY entity_id, property_id, revid ORDER BY feed_pos) = 1)
"""
_ISO = "strftime(make_timestamp({}), '%Y-%m-%dT%H:%M:%SZ')"
_SENTINELS = "('NEW_CREATED', 'NO_VALUE', 'SOME_VALUE')"

SQL = {
    "p1_found": _CHANGES + f""", s AS (
  SELECT *, lag(new_value) OVER w AS left_value, lead(old_value) OVER w AS next_old, lead(ts) OVER w AS next_at
  FROM c WINDOW w AS (PARTITION BY entity_id, property_id ORDER BY ts, revid))
SELECT entity_id, property_id, new_value AS version_value, {_ISO.format('ts')} AS valid_from,
       CASE WHEN next_at IS NULL THEN 'open' WHEN next_old = new_value THEN {_ISO.format('next_at')} ELSE 'unknown' END AS valid_to
FROM s WHERE new_value NOT IN {_SENTINELS}
UNION
SELECT entity_id, property_id, old_value, 'unknown', {_ISO.format('ts')}
FROM s WHERE old_value NOT IN {_SENTINELS} AND left_value IS DISTINCT FROM old_value
""",
    "p2_found": _CHANGES + """, k AS (
  SELECT 'entity_id' AS key_field, entity_id AS key_id, ts, revid FROM c
  UNION ALL SELECT 'property_id', property_id, ts, revid FROM c)
SELECT key_field, key_id, n AS n_changes, revid AS mid_revid FROM (
  SELECT *, count(*) OVER (PARTITION BY key_field, key_id) AS n,
         row_number() OVER (PARTITION BY key_field, key_id ORDER BY ts, revid) AS place FROM k)
WHERE place = (n + 1) // 2
""",
    "p2_modes": """
SELECT key_id, CAST(sum(w) AS BIGINT) AS n_rows, count(*) AS n_distinct, arg_max(value, (w, -pos)) AS mode_value, max(w) AS mode_rows FROM (
  SELECT *, row_number() OVER (PARTITION BY key_id ORDER BY value) AS pos FROM (
    SELECT property_id AS key_id, new_value AS value, count(*) AS w FROM triple_changes GROUP BY 1, 2))
GROUP BY key_id
""",
    "p3_found": _CHANGES + """
SELECT entity_id, property_id, new_value AS current_value FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_id, property_id ORDER BY ts DESC, revid DESC) AS r FROM c)
WHERE r = 1 AND kind <> 'deleted'
""",
    "p3_kinds": "SELECT lower(trim(change_type)) AS kind, count(*) AS n_rows FROM triple_changes GROUP BY 1",
}
