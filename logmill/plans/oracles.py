"""The registered queries as DuckDB SQL over the same tables."""

# Fixed value: the line layout in RE2 syntax (event lines are plain ASCII).
_LAYOUT = (
    r'(\S+) (\S+) (\S+) \[(.*?)\] "(.*?)" (\d+) (\d+) "([^"]*)" "([^"]*)" (\d+)'
)

_LINES = """
lines AS (
  SELECT event_id, ts, concat(
    '10.0.', CAST(user_id // 256 AS VARCHAR), '.', CAST(user_id % 256 AS VARCHAR), ' - - [',
    strftime(ts, '%d/%b/%Y:%H:%M:%S'), ' +0000] "',
    CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST'
      WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'POST' ELSE 'DELETE' END,
    ' /', event_type, ' HTTP/1.0" ',
    CASE event_type WHEN 'error' THEN '500' WHEN 'signup' THEN '303'
      WHEN 'purchase' THEN '404' ELSE '200' END,
    ' ', CASE WHEN event_id % 97 = 0 THEN '-'
      ELSE CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) END,
    ' "-" "agent/', CAST(user_id % 10 AS VARCHAR), '" ',
    CAST(event_id % 5000 + 1 AS VARCHAR)) AS line
  FROM events)"""

_PARSED = f"""
parsed AS (
  SELECT event_id, ts, f.ip_address, f.remote_log_name, f.user_id, f.log_timestamp, f.request,
    CAST(f.response_code AS INTEGER) AS response_code,
    CAST(f.response_bytes AS BIGINT) AS response_bytes,
    f.referrer, f.user_agent,
    CAST(f.response_time AS INTEGER) AS response_time
  FROM (
    SELECT event_id, ts, regexp_extract(line, '{_LAYOUT}',
      ['ip_address', 'remote_log_name', 'user_id', 'log_timestamp', 'request', 'response_code',
       'response_bytes', 'referrer', 'user_agent', 'response_time']) AS f
    FROM lines WHERE regexp_matches(line, '{_LAYOUT}')))"""

_LOG_TIME_UTC = """
strptime(substr(log_timestamp, 1, 20), '%d/%b/%Y:%H:%M:%S')
  - to_minutes(CAST(substr(log_timestamp, 22, 1) || '1' AS BIGINT)
      * (CAST(substr(log_timestamp, 23, 2) AS BIGINT) * 60
         + CAST(substr(log_timestamp, 25, 2) AS BIGINT)))"""

_ENRICHED = f"""
facts AS (
  SELECT event_id, ip_address, remote_log_name, user_id, {_LOG_TIME_UTC} AS log_timestamp,
    response_code, response_bytes, referrer, user_agent, response_time,
    strftime(ts, '%Y-%m-%d %H:%M') AS process_timestamp,
    string_split(request, ' ')[1] AS request_type,
    string_split(request, ' ')[2] AS api,
    string_split(request, ' ')[3] AS protocol,
    strftime(ts, '%Y-%m-%d') AS process_date
  FROM parsed)"""

_DAY = "'2024-01-05'"

_OF_LINES = f"WITH {_LINES}"
_OF_PARSED = f"WITH {_LINES}, {_PARSED}"
_OF_FACTS = f"WITH {_LINES}, {_PARSED}, {_ENRICHED}"

_CODES_BY_MINUTE = f"""
  SELECT process_timestamp, response_code, count(*) AS total_count
  FROM facts WHERE process_date = {_DAY}
  GROUP BY process_timestamp, response_code
  ORDER BY process_timestamp DESC, response_code DESC LIMIT 10"""

_REQUESTS_BY_MINUTE = f"""
  SELECT process_timestamp, count(*) AS total_requests
  FROM facts WHERE process_date = {_DAY}
  GROUP BY process_timestamp ORDER BY process_timestamp DESC LIMIT 10"""


def oracle_sql() -> dict[str, str]:
    enriched_log = f"{_OF_FACTS} SELECT * FROM facts"
    totals = f"""{_OF_PARSED}
            SELECT count(DISTINCT response_code) AS distinct_codes, count(*) AS total_requests
            FROM parsed"""
    per_agent = f"""{_OF_PARSED}
            SELECT user_agent, count(*) AS total_requests FROM parsed GROUP BY user_agent"""
    per_ip = f"""{_OF_PARSED}
            SELECT ip_address, count(*) AS total_requests FROM parsed GROUP BY ip_address
            ORDER BY total_requests, ip_address"""
    return {
        "parse_log_lines": f"{_OF_PARSED} SELECT * EXCLUDE (ts) FROM parsed",
        "malformed_lines": f"""{_OF_LINES}
            SELECT event_id, line AS raw, 'no_match' AS reason
            FROM lines WHERE NOT regexp_matches(line, '{_LAYOUT}')""",
        "preview_parsed": f"""{_OF_PARSED}
            SELECT event_id, ip_address, response_code FROM parsed ORDER BY event_id LIMIT 5""",
        "kafka_record_decode": f"""{_OF_LINES}
            SELECT ts AS process_timestamp, line || chr(10) AS value FROM lines""",
        "json_scalar_encode": f"""{_OF_LINES}
            SELECT event_id, CAST(to_json(line || chr(10)) AS VARCHAR) AS payload FROM lines""",
        "json_scalar_decode": f"""{_OF_LINES}
            SELECT event_id, json_extract_string(to_json(line || chr(10)), '$') AS line FROM lines""",
        "log_timestamp_parse": f"""{_OF_PARSED}
            SELECT event_id, {_LOG_TIME_UTC} AS log_ts_utc FROM parsed""",
        "request_split": f"""{_OF_FACTS}
            SELECT event_id, request_type, api, protocol FROM facts""",
        "minute_bucket": """
            SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS process_timestamp,
              strftime(ts, '%Y-%m-%d') AS process_date FROM events""",
        "enriched_log": enriched_log,
        "content_size_stats": f"""{_OF_PARSED}
            SELECT CAST(sum(response_bytes) // count(response_bytes) AS BIGINT) AS avg_bytes,
              min(response_bytes) AS min_bytes, max(response_bytes) AS max_bytes FROM parsed""",
        "response_code_counts": f"""{_OF_PARSED}
            SELECT response_code, count(*) AS total_count FROM parsed GROUP BY response_code""",
        "top_response_codes": f"""{_OF_PARSED}
            SELECT response_code, count(*) AS total_count FROM parsed GROUP BY response_code
            ORDER BY total_count DESC, response_code LIMIT 10""",
        "response_code_totals": totals,
        "top_user_agents": f"""{_OF_PARSED}
            SELECT user_agent, count(*) AS total_requests FROM parsed GROUP BY user_agent
            ORDER BY total_requests DESC, user_agent LIMIT 5""",
        "requests_per_user_agent": per_agent,
        "requests_per_timestamp": f"""{_OF_PARSED}
            SELECT log_timestamp, count(*) AS total_requests FROM parsed GROUP BY log_timestamp
            ORDER BY total_requests, log_timestamp""",
        "requests_per_ip": per_ip,
        "days_response_code_totals": totals,
        "days_requests_per_user_agent": per_agent,
        "days_requests_per_ip": per_ip,
        "partition_day_scan": f"""{_OF_FACTS}
            SELECT event_id, process_date, response_code FROM facts WHERE process_date = {_DAY}""",
        "day_has_data": f"""{_OF_FACTS}
            SELECT {_DAY} AS day, count(*) > 0 AS has_data FROM facts WHERE process_date = {_DAY}""",
        "response_codes_by_minute": f"{_OF_FACTS} {_CODES_BY_MINUTE}",
        "output_bytes_by_minute": f"""{_OF_FACTS}
            SELECT process_timestamp, CAST(sum(response_bytes) AS BIGINT) AS output_bytes
            FROM facts WHERE process_date = {_DAY}
            GROUP BY process_timestamp ORDER BY process_timestamp DESC LIMIT 10""",
        "total_requests_by_minute": f"{_OF_FACTS} {_REQUESTS_BY_MINUTE}",
        "response_code_distribution": f"""{_OF_FACTS}
            SELECT response_code, CAST(sum(total_count) AS BIGINT) AS total_count
            FROM ({_CODES_BY_MINUTE}) GROUP BY response_code""",
        "serving_rows_json": f"""{_OF_FACTS}
            SELECT CAST(to_json({{'process_timestamp': process_timestamp,
                'total_requests': total_requests}}) AS VARCHAR) AS row_json
            FROM ({_REQUESTS_BY_MINUTE})""",
        "stream_parse_append": enriched_log,
        "stream_foreach_batch": f"""{_OF_LINES}
            SELECT event_id, NOT regexp_matches(line, '{_LAYOUT}') AS is_malformed FROM lines""",
        "stream_minute_rollup": f"""{_OF_PARSED}
            SELECT date_trunc('minute', ts) AS minute, response_code, count(*) AS total_count,
              CAST(sum(response_bytes) AS BIGINT) AS output_bytes
            FROM parsed GROUP BY 1, 2""",
    }
