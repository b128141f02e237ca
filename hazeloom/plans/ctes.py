"""SQL forms of the adapters in ``sources.adapters``; a query's SQL names the ones it needs."""

from __future__ import annotations

import re

CTES = {
    "readings": "SELECT event_id, user_id AS sensor_id, ts, value AS pm25, event_type FROM events",
    "station_daily": """SELECT user_id AS sensor_id, CAST(ts AS DATE) AS date, avg(value) FILTER (event_type <> 'error') AS pm25, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "sparse_daily": """SELECT user_id AS sensor_id, CAST(ts AS DATE) + CAST((day(ts) + user_id)//4 * (user_id % 4) AS INTEGER) AS date,
        avg(value) FILTER (event_type <> 'error') AS pm25, count(*) AS n FROM events GROUP BY 1, 2""",
    "stations": """SELECT u.sensor_id, 23.3::DOUBLE + (u.sensor_id*37 % 141)*0.1::DOUBLE AS lat,
        60.5::DOUBLE + (u.sensor_id*53 % 175)*0.1::DOUBLE AS lon, r.r_name AS province,
        CASE WHEN u.sensor_id % 4 = 0 THEN 'regulatory' ELSE 'lowcost' END AS provider
        FROM (SELECT DISTINCT user_id AS sensor_id FROM events) u
        LEFT JOIN region r ON r.r_regionkey = u.sensor_id % 5""",
    "gas_pixels": """SELECT DATE '2024-01-01' + l_linenumber AS date, l_returnflag AS product, l_orderkey % 40 AS prow,
        (l_orderkey*7 + l_linenumber*13 + l_partkey) % 40 AS pcol,
        avg(CASE WHEN l_quantity = 1 THEN NULL ELSE l_extendedprice END) AS value, round(avg(1 - 3*l_discount), 9) AS qa
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "pixel_points": """SELECT DISTINCT user_id AS sensor_id, user_id*11 % 40 AS prow, user_id*17 % 40 AS pcol
        FROM events""",
    "met_readings": """SELECT event_id, user_id AS sensor_id, ts,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE value/10 END AS WS10,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE (100 + event_id*37 % 900)::DOUBLE END AS blh,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id*13 % 101)::DOUBLE END AS RH,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE (event_id*29 % 360)::DOUBLE END AS WD10,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE (90000 + event_id % 10000)::DOUBLE END AS sp,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE 273.15::DOUBLE + event_id % 40 END AS t2m,
        CASE WHEN event_id % 17 = 0 THEN NULL ELSE 273.15::DOUBLE + event_id % 40 - event_id % 15 END AS d2m
        FROM events""",
    "met_daily": """SELECT sensor_id, CAST(ts AS DATE) AS date, avg(WS10) AS WS10, avg(blh) AS blh, avg(RH) AS RH,
        avg(WD10) AS WD10, avg(sp) AS sp, avg(t2m) AS t2m, avg(d2m) AS d2m, avg(t2m) - avg(d2m) AS dT,
        avg(WS10) * avg(blh) AS VC, avg(RH) / 20 AS VPD, avg(WS10) / 4 AS dWS, avg(WD10) / 3 - 60 AS dWD,
        avg(blh) / 24 AS BLH_tend, avg(sp) / 240 AS SP_tend, avg(sp) / 300 AS MSLP_tend
        FROM met_readings GROUP BY 1, 2""",
    "predictions": """SELECT event_id, user_id AS sensor_id, CAST(ts AS DATE) AS date, value AS y_true,
        value*0.8 + 10 + (event_id % 7)*3 AS y_pred,
        CAST((event_id % 12 + month(ts) - 1) % 12 + 1 AS INTEGER) AS month, event_id % 11 AS iy, event_id % 13 AS ix
        FROM events""",
    "met_cube": """SELECT CAST(ts AS DATE) AS date, event_id % 11 AS iy, event_id % 13 AS ix, avg(value) AS value
        FROM events GROUP BY 1, 2, 3""",
    "polygon_edges": """SELECT r_regionkey AS poly_id, r_name AS name, e.edge,
        CASE e.edge WHEN 0 THEN 60.5::DOUBLE + 3.48::DOUBLE*r_regionkey WHEN 1 THEN 60.5::DOUBLE + 3.48::DOUBLE*(r_regionkey+1)
          WHEN 2 THEN 60.8::DOUBLE + 3.48::DOUBLE*(r_regionkey+1) ELSE 60.8::DOUBLE + 3.48::DOUBLE*r_regionkey END AS x1,
        CASE WHEN e.edge < 2 THEN 23.3::DOUBLE ELSE 37.3::DOUBLE END AS y1,
        CASE e.edge WHEN 3 THEN 60.5::DOUBLE + 3.48::DOUBLE*r_regionkey WHEN 0 THEN 60.5::DOUBLE + 3.48::DOUBLE*(r_regionkey+1)
          WHEN 1 THEN 60.8::DOUBLE + 3.48::DOUBLE*(r_regionkey+1) ELSE 60.8::DOUBLE + 3.48::DOUBLE*r_regionkey END AS x2,
        CASE WHEN e.edge IN (0, 3) THEN 23.3::DOUBLE ELSE 37.3::DOUBLE END AS y2
        FROM region CROSS JOIN (VALUES (0), (1), (2), (3)) e(edge)""",
    "yearly": """SELECT o_custkey AS sensor_id, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice/1000) AS pm25
        FROM orders GROUP BY 1, 2""",
    "skill_daily": """SELECT user_id AS sensor_id, CAST(ts AS DATE) + CAST(30*(user_id % 12) AS INTEGER) AS date,
        avg(value) FILTER (event_type <> 'error') AS pm25, CAST(ts AS DATE) <= DATE '2024-01-20' AS is_train
        FROM events GROUP BY 1, 2, 4""",
}

_NAMES = re.compile(r"\b(" + "|".join(CTES) + r")\b")


def expand(sql: str) -> str:
    """WITH clause holding exactly the adapters the text mentions, dependencies first."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in _NAMES.findall(text):
            if name not in wanted:
                visit(CTES[name])
                wanted.append(name)

    visit(sql)
    if not wanted:
        return ""
    return "WITH " + ", ".join(f"{n} AS ({CTES[n]})" for n in wanted)
