"""DuckDB SQL of the sample model over the driver's tables, for the counterparts of registered queries."""

EVENTS = """ev AS (
  SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS n, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts,
    CASE WHEN user_id % 10 = 0 THEN 'self' ELSE 'user.' || (user_id % 10) END AS context,
    CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 's1' ELSE 's2' END AS source
  FROM events)"""


def _branch(path: str, kind: str, num: str, text: str, lat: str, lon: str, k: int, where: str = "true", table: str = "ev") -> str:
    return (
        f"SELECT ts, context, {path} AS path, source, '{kind}' AS value_kind, CAST({num} AS DOUBLE) AS value_num, CAST({text} AS VARCHAR) AS value_str, "
        f"CAST({lat} AS DOUBLE) AS value_lat, CAST({lon} AS DOUBLE) AS value_lon, event_id * 10 + {k} AS rowid FROM {table} WHERE {where}"
    )


SAMPLES = (
    EVENTS
    + ", sample AS ("
    + "\nUNION ALL ".join(
        [
            _branch("'events.' || event_type", "number", "value", "NULL", "NULL", "NULL", 0),
            _branch("'state.type'", "string", "NULL", "event_type", "NULL", "NULL", 1),
            _branch("'state.large'", "boolean", "NULL", "CASE WHEN value > 100 THEN 'true' ELSE 'false' END", "NULL", "NULL", 2),
            _branch("'navigation.position'", "position", "NULL", "NULL", "CAST(60.0 AS DOUBLE) + value / CAST(1000.0 AS DOUBLE)", "24 + event_id % 1000", 3),
            _branch("'attrs.' || event_type || '#/k'", "number", "n", "NULL", "NULL", "NULL", 4),
            _branch("'attrs.' || event_type || '#/a~1b'", "number", "value", "NULL", "NULL", "NULL", 5),
            _branch("'attrs.' || event_type || '#/tag'", "string", "NULL", "event_type", "NULL", "NULL", 6),
            _branch("'mixed.path'", "number", "value", "NULL", "NULL", "NULL", 7, "event_id % 2 = 0"),
            _branch("'mixed.path'", "string", "NULL", "event_type", "NULL", "NULL", 7, "event_id % 2 <> 0"),
            _branch("'shadow.path'", "number", "value", "NULL", "NULL", "NULL", 8, "event_id % 5 = 0"),
            _branch("'shadow.path#/c'", "number", "value", "NULL", "NULL", "NULL", 8, "event_id % 5 <> 0"),
            _branch("'name'", "identity", "NULL", "'crew-' || user_id", "NULL", "NULL", 9, "event_id IN (SELECT min(event_id) FROM ev GROUP BY user_id)"),
        ]
    )
    + ")"
)

ORDER = "ts, source NULLS FIRST, rowid"
ALL = "ts, context, path, source, value_kind, value_num, value_str, value_lat, value_lon"


def query(body: str, *tables: str) -> str:
    """A statement over ``sample`` and further named tables ("name AS (...)")."""
    return "WITH " + ", ".join([SAMPLES, *tables]) + "\n" + body
