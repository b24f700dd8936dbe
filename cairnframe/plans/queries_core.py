"""Queries of the general data problems, and their SQL."""

from __future__ import annotations

from cairnframe.functions.exec import table
from cairnframe.operators import badrows, drift, reconcile, skew, snapshots
from cairnframe.sources.reports import report_rows


def p1_found(spark, d):
    return drift.schema_changes(table(spark, d, "report_records")).select("file_id", "field", "change").distinct()


def p1_rows(spark, d):
    return drift.unified_records(table(spark, d, "report_records"))


def p1_schema(spark, d):
    return drift.union_schema(table(spark, d, "report_records"))


def p2_found(spark, d):
    return badrows.failed_lines(table(spark, d, "raw_report_lines"))


def p2_rows(spark, d):
    return report_rows(badrows.read_lines(table(spark, d, "raw_report_lines")), keep=["report_id", "line_no"])


def p4_found(spark, d):
    return snapshots.snapshot_changes(table(spark, d, "entries"), table(spark, d, "scans"))


def p5_found(spark, d):
    return reconcile.copy_differences(table(spark, d, "entries"), table(spark, d, "copy_pairs"))


def p6_found(spark, d):
    return skew.crowded_contents(table(spark, d, "entries"))


def p6_places(spark, d):
    return skew.places_per_content(table(spark, d, "entries"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_rows, p1_schema, p2_found, p2_rows, p4_found, p5_found, p6_found, p6_places)
}

_ENTRIES = "SELECT DISTINCT scan_id, rel_path, size, mtime_ns, COALESCE(LOWER(sha256), '') AS sha FROM entries"

_MEANING = """CASE WHEN p IN ('statuscode', 'status') THEN 'http_status_code'
        WHEN p IN ('bucket', 'bucketname') THEN 'bucket' WHEN p IN ('key', 'objectkey') THEN 'object_key'
        WHEN p IN ('versionid', 'version') THEN 'version_id' WHEN contains(p, 'http') THEN 'http_status_code'
        WHEN regexp_matches(p, 'err|fehler|fail|fault') THEN 'error_code'
        WHEN regexp_matches(p, 'result|message|msg|text|ergebnis|meldung|nachricht') THEN 'result_message'
        WHEN regexp_matches(p, 'taskstatus|taskstate') THEN 'task_status' WHEN contains(p, 'status') THEN 'http_status_code'
        ELSE p END"""

_FIELD = '(?s),[ \\t]*("(?:[^"]|"")*"|[^",]*)'
_LINES = f"""r AS (SELECT DISTINCT report_id, line_no, regexp_replace(coalesce(raw, ''), '[\\r\\n]+$', '') AS raw FROM raw_report_lines),
    q AS (SELECT *, regexp_full_match(',' || raw, '(?:{_FIELD.replace("(?s)", "")})+', 's') AS quoted,
          list_transform(regexp_extract_all(',' || raw, '{_FIELD}', 1), lambda x: CASE WHEN starts_with(x, '"')
              THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) AS f FROM r),
    k AS (SELECT *, regexp_replace(f[7], '"(?:[^"\\\\]|\\\\.)*"', '""', 'g') AS bare FROM q),
    j AS (SELECT report_id, line_no, f, CASE WHEN NOT quoted THEN 'quoting' WHEN len(f) <> 7 THEN 'column_count'
          WHEN lower(f[1]) = 'bucket' AND lower(f[2]) = 'key' AND lower(f[7]) = 'resultmessage' THEN 'header'
          WHEN lower(f[4]) NOT IN ('succeeded', 'failed') THEN 'task_status'
          WHEN lower(f[4]) = 'succeeded' AND NOT (json_valid(f[7]) AND coalesce(json_type(TRY_CAST(f[7] AS JSON)), '') = 'OBJECT'
               AND NOT regexp_matches(bare, ',\\s*[}}\\]]|NaN|Inf')) THEN 'result_message' END AS reason FROM k)"""

_VALUES = f"""d AS (SELECT DISTINCT feed_id, file_id, rec_no, record FROM report_records),
    f AS (SELECT *, unnest(json_keys(record)) AS field FROM d WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
    x AS (SELECT *, json_extract(record, '$."' || field || '"') AS x, lower(regexp_replace(field, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS p FROM f),
    v AS (SELECT feed_id, file_id, rec_no, record, field, x, {_MEANING} AS m, CASE json_type(x) WHEN 'VARCHAR' THEN 'string'
          WHEN 'DOUBLE' THEN 'decimal number' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object'
          WHEN 'NULL' THEN NULL ELSE 'integer' END AS kind FROM x),
    u AS (SELECT m, min(field) AS field, count(DISTINCT (feed_id, file_id)) AS files, count(DISTINCT field) AS spellings,
          CASE WHEN count(DISTINCT kind) < 2 THEN max(kind) WHEN count(DISTINCT kind) = 2 AND bool_and(kind IN ('integer', 'decimal number'))
          THEN 'decimal number' ELSE 'string' END AS kind FROM v GROUP BY 1)"""
_ROW_FIELDS = ("bucket", "object_key", "version_id", "task_status", "error_code", "http_status_code", "result_message")
_LIST = ", ".join(f"'{x}'" for x in _ROW_FIELDS)

SQL = {
    "p1_schema": f"WITH {_VALUES} SELECT m AS meaning, field, kind, files, spellings FROM u",
    "p1_rows": f"""
        WITH {_VALUES},
        c AS (SELECT *, CASE WHEN m IN ({_LIST}) THEN
                  row_number() OVER (PARTITION BY feed_id, file_id, rec_no, record, m ORDER BY field) END AS nth,
              CASE WHEN v.kind = 'array' AND json_array_length(x) = 1 THEN x->0 ELSE x END AS one
              FROM v JOIN (SELECT m, kind AS union_kind FROM u) USING (m) WHERE kind IS NOT NULL),
        i AS (SELECT *, CASE WHEN json_type(one) = 'OBJECT' AND json_exists(one, '$.code') THEN one->'code' ELSE one END AS inner_,
              json_type(one) = 'OBJECT' AND json_exists(one, '$.code') AND len(json_keys(one)) > 1 AS more FROM c),
        t AS (SELECT *, m = 'result_message' AND kind = 'object' AS keep, CASE WHEN m = 'result_message' AND kind = 'object' THEN x::VARCHAR
              WHEN json_type(inner_) = 'VARCHAR' THEN inner_->>'$' WHEN json_type(inner_) <> 'NULL' THEN
              CASE WHEN json_type(inner_) = 'DOUBLE' THEN regexp_replace(inner_::VARCHAR, '[.]0$', '') ELSE inner_::VARCHAR END END AS text FROM i),
        h AS (SELECT *, nth = 1 AND (keep OR NOT more AND text IS NOT NULL AND (m <> 'http_status_code' OR TRY_CAST(trim(text) AS BIGINT) IS NOT NULL)) AS held FROM t),
        e AS (SELECT feed_id, file_id, rec_no, record, {", ".join(f"max(text) FILTER (nth = 1 AND m = '{x}') AS {x}" for x in _ROW_FIELDS)},
              string_agg('"' || field || '":' || CASE WHEN m NOT IN ({_LIST}) AND union_kind = 'string' AND kind <> 'string' THEN to_json(x::VARCHAR)::VARCHAR
                         WHEN kind = 'object' THEN '{{' || list_aggregate(list_sort(list_transform(json_keys(x), lambda k: '"' || k || '":' || json_extract(x, '$."' || k || '"')::VARCHAR)), 'string_agg', ',') || '}}'
                         WHEN kind = 'decimal number' THEN regexp_replace(x::VARCHAR, '[.]0$', '') ELSE x::VARCHAR END, ',' ORDER BY field) FILTER (NOT coalesce(held, false)) AS extra FROM h GROUP BY 1, 2, 3, 4)
        SELECT feed_id, file_id, rec_no, {", ".join(x for x in _ROW_FIELDS if x != "http_status_code")},
            TRY_CAST(trim(http_status_code) AS BIGINT) AS http_status_code, '{{' || coalesce(extra, '') || '}}' AS extra,
            CASE WHEN NOT (json_valid(record) AND json_type(record) = 'OBJECT') THEN 'not a JSON object' END AS err
        FROM d LEFT JOIN e USING (feed_id, file_id, rec_no, record)""",
    "p1_found": f"""
        WITH a AS (SELECT feed_id, file_id, written_at, record, unnest(json_keys(record)) AS field FROM report_records
                   WHERE json_valid(record) AND json_type(record) = 'OBJECT'),
        k AS (SELECT feed_id, file_id, field, list_sort(list(DISTINCT CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN
                  'decimal' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'integer' END)
                  FILTER (t <> 'NULL')) AS kinds, lower(regexp_replace(field, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS p
              FROM (SELECT *, json_type(record, '$."' || field || '"') AS t FROM a) GROUP BY ALL),
        n AS (SELECT feed_id, file_id, field, kinds, {_MEANING} AS m FROM k),
        o AS (SELECT feed_id, file_id, lag(file_id) OVER (PARTITION BY feed_id ORDER BY w, file_id) AS before
              FROM (SELECT feed_id, file_id, max(written_at) AS w FROM a GROUP BY ALL)),
        cur AS (SELECT o.file_id AS f, n.* FROM o JOIN n USING (feed_id, file_id) WHERE before IS NOT NULL),
        old AS (SELECT o.file_id AS f, n.field, n.kinds, n.m FROM o JOIN n ON n.feed_id = o.feed_id AND n.file_id = o.before),
        came AS (SELECT *, row_number() OVER (PARTITION BY f, m ORDER BY field) AS i FROM cur ANTI JOIN old USING (f, field)),
        gone AS (SELECT *, row_number() OVER (PARTITION BY f, m ORDER BY field) AS i FROM old ANTI JOIN cur USING (f, field)),
        ren AS (SELECT f, m, i, c.field, c.kinds AS new_kinds, g.kinds AS old_kinds FROM came c JOIN gone g USING (f, m, i)),
        pairs AS (SELECT f, field, new_kinds, old_kinds FROM ren
                 UNION ALL SELECT f, field, cur.kinds, old.kinds FROM cur JOIN old USING (f, field))
        SELECT f AS file_id, field, 'renamed' AS change FROM ren
        UNION ALL SELECT f, field, 'added' FROM came ANTI JOIN ren USING (f, m, i)
        UNION ALL SELECT f, field, 'removed' FROM gone ANTI JOIN ren USING (f, m, i)
        UNION ALL SELECT f, field, 'retyped' FROM pairs WHERE new_kinds <> old_kinds""",
    "p2_found": f"WITH {_LINES} SELECT report_id, line_no, reason FROM j WHERE reason <> 'header'",
    "p2_rows": f"""
        WITH {_LINES}, w AS (SELECT *, lower(f[4]) = 'succeeded' AS ok, TRY_CAST(f[5] AS BIGINT) IS NOT NULL AS swapped,
            CASE WHEN lower(f[4]) = 'succeeded' THEN f[7]::JSON END AS v FROM j WHERE reason IS NULL),
        x AS (SELECT *, CASE WHEN swapped THEN f[6] ELSE f[5] END AS e, CASE WHEN swapped THEN f[5] ELSE f[6] END AS h,
            CASE WHEN json_type(v, '$.checksum_hex') = 'VARCHAR' THEN nullif(lower(trim(v->>'$.checksum_hex')), '') END AS hex,
            CASE WHEN json_type(v, '$.checksum_base64') = 'VARCHAR' THEN nullif(trim(v->>'$.checksum_base64'), '') END AS b64,
            CASE WHEN json_type(v, '$.etag') = 'VARCHAR' THEN nullif(trim(v->>'$.etag'), '') END AS etag,
            CASE WHEN json_type(v, '$.checksumAlgorithm') = 'VARCHAR' THEN nullif(upper(trim(v->>'$.checksumAlgorithm')), '') END AS alg,
            CASE WHEN json_type(v, '$.checksumType') = 'VARCHAR' THEN nullif(upper(trim(v->>'$.checksumType')), '') END AS typ FROM w),
        y AS (SELECT *, CASE WHEN NOT ok THEN 'task did not succeed' WHEN coalesce(upper(alg), '') <> 'SHA256'
              THEN 'unsupported checksum algorithm' WHEN coalesce(upper(typ), '') <> 'FULL_OBJECT' THEN 'unsupported checksum type'
              WHEN NOT regexp_full_match(coalesce(hex, lower(hex(from_base64(b64))), ''), '[0-9a-f]{{64}}') THEN 'no SHA-256 checksum' END AS err
              FROM x)
        SELECT report_id, line_no, trim(f[1]) AS bucket, url_decode(replace(f[2], '+', '%20')) AS object_key,
            CASE WHEN lower(trim(f[3])) NOT IN ('', 'null') THEN trim(f[3]) END AS version_id, trim(f[4]) AS task_status,
            CASE WHEN lower(trim(e)) NOT IN ('', 'null') THEN trim(e) END AS error_code, TRY_CAST(trim(h) AS BIGINT) AS http_status_code,
            CASE WHEN lower(trim(f[7])) NOT IN ('', 'null') THEN trim(f[7]) END AS result_message, etag, b64 AS checksum_base64,
            alg AS checksum_algorithm, typ AS checksum_type, coalesce(hex, lower(hex(from_base64(b64)))) AS checksum_hex,
            err, CAST(err IS NULL AS INT) AS usable FROM y""",
    "p4_found": f"""
        WITH e AS ({_ENTRIES}),
        o AS (SELECT scan_id, LAG(scan_id) OVER (PARTITION BY machine_id, root ORDER BY started_at, scan_id) AS p
              FROM (SELECT DISTINCT * FROM scans) WHERE status = 'complete'),
        n AS (SELECT o.scan_id AS s, e.* FROM o JOIN e ON e.scan_id = o.scan_id WHERE p IS NOT NULL),
        b AS (SELECT o.scan_id AS s, e.* FROM o JOIN e ON e.scan_id = o.p)
        SELECT COALESCE(n.s, b.s) AS scan_id, COALESCE(n.rel_path, b.rel_path) AS rel_path,
               CASE WHEN b.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM n FULL JOIN b ON n.s = b.s AND n.rel_path = b.rel_path
        WHERE b.s IS NULL OR n.s IS NULL OR n.mtime_ns IS DISTINCT FROM b.mtime_ns OR n.sha <> b.sha""",
    "p5_found": f"""
        WITH e AS ({_ENTRIES}), p AS (SELECT DISTINCT * FROM copy_pairs),
        l AS (SELECT pair_id, e.* FROM p JOIN e ON e.scan_id = left_scan_id),
        r AS (SELECT pair_id, e.* FROM p JOIN e ON e.scan_id = right_scan_id),
        j AS (SELECT COALESCE(l.pair_id, r.pair_id) AS pair_id, COALESCE(l.rel_path, r.rel_path) AS rel_path,
                     l.pair_id AS lp, r.pair_id AS rp, l.size AS ls, r.size AS rs, l.sha AS lh, r.sha AS rh
              FROM l FULL JOIN r ON l.pair_id = r.pair_id AND l.rel_path = r.rel_path)
        SELECT pair_id, rel_path, 'only_left' AS difference FROM j WHERE rp IS NULL
        UNION ALL SELECT pair_id, rel_path, 'only_right' FROM j WHERE lp IS NULL
        UNION ALL SELECT pair_id, rel_path, 'size' FROM j
                  WHERE lp IS NOT NULL AND rp IS NOT NULL AND ls IS DISTINCT FROM rs
        UNION ALL SELECT pair_id, rel_path, 'sha256' FROM j WHERE lp IS NOT NULL AND rp IS NOT NULL AND lh <> rh""",
    "p6_found": """
        SELECT size, LOWER(sha256) AS sha256 FROM entries WHERE sha256 <> ''
        GROUP BY 1, 2 HAVING COUNT(DISTINCT (scan_id, rel_path)) >= 25""",
    "p6_places": """
        SELECT size, LOWER(sha256) AS sha256, COUNT(DISTINCT (scan_id, rel_path)) AS places
        FROM entries WHERE sha256 <> '' GROUP BY 1, 2""",
}
