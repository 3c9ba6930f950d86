"""Views of the given tables as biosignal tables, for Spark and, as SQL, for the oracle.

The SQL text is shared: `{K}` is the JSON access of either engine, `D(x)` a double
literal. Every view is a plain projection or one window over its recording.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_SQL = {
    "fx_scores": """
SELECT rec, rec DIV 2 AS subject, CAST(win_idx AS BIGINT) AS win_idx, D(1.0) + D(0.5)*win_idx AS time,
       least(value/D(150.0), D(1.0)) AS prob, value + k AS delta,
       k/(value+D(1.0)) AS ratio, k*D(0.3) AS centroid, event_type, value, k
FROM (SELECT event_id DIV 2500 AS rec, event_type, value, CAST({K} AS INT) AS k,
             row_number() OVER (PARTITION BY event_id DIV 2500 ORDER BY ts, event_id) - 1 AS win_idx
      FROM events)""",
    # All events as one recording; the position is the event's, with gaps if ids have them.
    "fx_long": """
SELECT CAST(0 AS BIGINT) AS rec, CAST(0 AS BIGINT) AS subject, CAST(event_id AS BIGINT) AS win_idx, D(1.0) + D(0.5)*event_id AS time,
       least(value/D(150.0), D(1.0)) AS prob, value + CAST({K} AS INT) AS delta,
       CAST({K} AS INT)/(value+D(1.0)) AS ratio, CAST({K} AS INT)*D(0.3) AS centroid FROM events""",
    "fx_seizures": """
SELECT rec, subject, time AS onset_s, D(20.0) + k AS duration_s, time + D(20.0) + k AS end_s
FROM fx_scores WHERE event_type = 'error' AND value >= 220""",
    "fx_annot": """
SELECT o_orderkey AS ann_id, concat('sub-', lpad(CAST(o_custkey % 20 AS STRING),3,'0')) AS subject,
       (o_orderkey DIV 400) AS run, CAST((o_orderkey*37) % 40000 AS DOUBLE) AS onset_s,
       D(20.0) + o_orderkey % 150 AS duration_s,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'front_temp' WHEN '2-HIGH' THEN 'temp'
            WHEN '3-MEDIUM' THEN 'cen_par' WHEN '5-LOW' THEN 'n/a' ELSE 'un' END AS localization,
       o_orderstatus AS lateralization
FROM orders""",
    "fx_features": """
SELECT vec_id, concat('sub-', CAST(vec_id % 5 AS STRING)) AS subject,
       vec_id % 5 * 1000 + CAST(floor(vec_id/5/4) AS BIGINT) AS segment_id,
       CAST(floor(vec_id/5/4) AS BIGINT) % 6 AS run,
       CAST(floor(vec_id/5/4) AS BIGINT)*D(60.0) AS t_start_s,
       CASE WHEN CAST(floor(vec_id/5/4) AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END AS label,
       embedding AS features
FROM embeddings""",
    "fx_remote": """
SELECT concat(p_brand,'/',CAST(p_partkey AS STRING)) AS key, CAST(p_size AS BIGINT)*1000 AS size,
       p_brand AS subject, p_type AS modality FROM part""",
    "fx_local": """
SELECT concat(p_brand,'/',CAST(p_partkey AS STRING)) AS key,
       CAST(p_size AS BIGINT)*1000 + CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END AS size
FROM part WHERE p_partkey % 3 <> 0""",
    "fx_lines": """
SELECT o_custkey % 10 AS doc, o_orderkey*3 + j AS line_no,
       CASE j WHEN 0 THEN concat('File Name: rec_', CAST(o_orderkey AS STRING), '.edf')
              WHEN 1 THEN concat('Seizure Start Time: ', CAST(o_orderkey % 3000 AS STRING), ' seconds')
              ELSE concat('Seizure End Time: ', CAST(o_orderkey % 3000 + 40 AS STRING), ' seconds') END AS line
FROM orders CROSS JOIN (SELECT 0 AS j UNION ALL SELECT 1 UNION ALL SELECT 2)
WHERE NOT (j > 0 AND o_orderkey % 4 <> 0)""",
}
_BASE = {
    "fx_scores": "events", "fx_long": "events", "fx_annot": "orders", "fx_features": "embeddings", "fx_remote": "part", "fx_local": "part", "fx_lines": "orders",
}


def _literals(sql: str, spark: bool) -> str:
    json = "get_json_object(props,'$.k')" if spark else "json_extract_string(props,'$.k')"
    sql = sql if spark else re.sub(r"\bDIV\b", "//", sql)
    return re.sub(r"D\(([0-9.]+)\)", r"\1D" if spark else r"CAST(\1 AS DOUBLE)", sql.replace("{K}", json))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame, over the table under `sf_dir`."""
    if name == "fx_seizures":
        return spark.sql(_literals(_SQL[name], True).replace("fx_scores", "{scores}"), scores=view(spark, sf_dir, "fx_scores"))
    base = _BASE[name]
    source = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    return spark.sql(re.sub(rf"\bFROM {base}\b", "FROM {source}", _literals(_SQL[name], True)), source=source)


def oracle(body: str, *names: str) -> str:
    """`WITH` the views by name, then `body`."""
    wanted = list(names)
    if "fx_seizures" in wanted and "fx_scores" not in wanted:
        wanted.insert(0, "fx_scores")
    ctes = [f"{n} AS ({_literals(_SQL[n], False)})" for n in sorted(set(wanted), key=list(_SQL).index)]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {', '.join(ctes)}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {', '.join(ctes)}, {body[5:]}"
    return f"WITH {', '.join(ctes)} {body}"
