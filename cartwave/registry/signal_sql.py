"""Check SQL for the positioning queries, written from the definitions."""

from __future__ import annotations

SLOTS = range(1, 8)


def hav(lat1, lon1, lat2, lon2) -> str:
    return (
        f"(2 * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) "
        f"+ cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))) * 6371 * 1000)"
    )


def _lat(key) -> str:
    return f"(31.2818::DOUBLE + (({key} * 104729) % 1000) * 1.15e-5::DOUBLE)"


def _lon(key) -> str:
    return f"(121.2013::DOUBLE + (({key} * 7919) % 1000) * 1.69e-5::DOUBLE)"


def _slot(i) -> str:
    key = f"((event_id * 31 + {(i - 1) * 17}) % n)"
    return key if i == 1 else f"CASE WHEN event_id % {i + 5} = 0 THEN NULL ELSE {key} END"


STATIONS = f"""stations AS (
  SELECT CAST(s_nationkey AS BIGINT) AS RNCID, s_suppkey AS CellID,
         {_lon('s_suppkey')} AS Longitude, {_lat('s_suppkey')} AS Latitude FROM supplier)"""

REPORTS = STATIONS + ", " + f"""keyed AS (
  SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS IMSI,
         {', '.join(f'{_slot(i)} AS CellID_{i}' for i in SLOTS)}
  FROM events, (SELECT count(*) AS n FROM supplier)),
placed AS (
  SELECT *, {_lat('CellID_1')} + (((row_id * 37) % 201) - 100) * 2e-6::DOUBLE AS Latitude,
         {_lon('CellID_1')} + (((row_id * 53) % 201) - 100) * 2e-6::DOUBLE AS Longitude,
         {' + '.join(f'(CellID_{i} IS NOT NULL)::BIGINT' for i in SLOTS)} AS Num_connected
  FROM keyed),
signals AS (
  SELECT p.*, {', '.join(f's{i}.RNCID AS RNCID_{i}' for i in SLOTS)},
         {', '.join(f"-50 - floor({hav('p.Latitude', 'p.Longitude', _lat(f'p.CellID_{i}'), _lon(f'p.CellID_{i}'))} / 20) AS RSSI_{i}" for i in SLOTS)}
  FROM placed p {' '.join(f'LEFT JOIN stations s{i} ON s{i}.CellID = p.CellID_{i}' for i in SLOTS)}),
reports AS (
  SELECT *, {', '.join(f'(RSSI_{i} + 113) / 2 AS AsuLevel_{i}' for i in SLOTS)},
         {', '.join(f'CASE WHEN CellID_{i} IS NOT NULL THEN ((row_id + {i}) % 5)::DOUBLE END AS SignalLevel_{i}' for i in SLOTS)}
  FROM signals)"""

GRID = REPORTS + ", " + f"""box AS (
  SELECT min(Latitude) AS la0, max(Latitude) AS la1, min(Longitude) AS lo0, max(Longitude) AS lo1
  FROM reports),
grid AS (
  SELECT *, CAST(ceil({hav('la0', 'lo0', 'la1', 'lo0')} / 20) AS BIGINT) AS rws,
         CAST(ceil({hav('la0', 'lo0', 'la0', 'lo1')} / 20) AS BIGINT) AS cls FROM box)"""


def cell(lat, lon) -> str:
    row = f"least(floor({hav('la0', 'lo0', lat, 'lo0')} / 20), rws - 1)"
    col = f"least(floor({hav('la0', 'lo0', 'la0', lon)} / 20), cls - 1)"
    return f"CAST({row} * cls + {col} AS BIGINT)"


def centre(idx, drift=False) -> tuple[str, str]:
    row = f"{idx}::DOUBLE / cls" if drift else f"floor({idx}::DOUBLE / cls)"
    return (
        f"(({row} + 0.5) / rws * (la1 - la0) + la0)",
        f"((({idx} % cls) + 0.5) / cls * (lo1 - lo0) + lo0)",
    )


JOINED = GRID + ", " + f"""labelled AS (
  SELECT r.* EXCLUDE (Latitude, Longitude), r.Latitude AS Latitude_m, r.Longitude AS Longitude_m,
         {cell('r.Latitude', 'r.Longitude')} AS Target FROM reports r, grid),
joined AS (
  SELECT l.*, {', '.join(f't{i}.Longitude AS Longitude_{i}, t{i}.Latitude AS Latitude_{i}' for i in SLOTS)}
  FROM labelled l {' '.join(f'LEFT JOIN stations t{i} ON t{i}.RNCID = l.RNCID_{i} AND t{i}.CellID = l.CellID_{i}' for i in SLOTS)})"""

OFFSETS = JOINED + """, offs AS (
  SELECT row_id, RNCID_1, CellID_1, Latitude_m, Longitude_m, Latitude_1, Longitude_1, Target,
         Latitude_m - Latitude_1 AS dlat, Longitude_m - Longitude_1 AS dlon
  FROM joined WHERE Latitude_1 IS NOT NULL)"""


def is_test(seed, key) -> str:
    return f"(substr(md5({seed} || '|' || {key}), 1, 8) >= 'cccccccc')"


def splits(n) -> str:
    values = ", ".join(f"({i})" for i in range(n))
    return OFFSETS + f""", parts AS (
  SELECT o.*, split, {is_test('split', 'row_id')} AS is_test
  FROM offs o, (VALUES {values}) v(split))"""


def scored(models, tag="") -> str:
    """Errors of the test records; ``models`` selects split, station, dlat and dlon."""
    return f""", models{tag} AS ({models}),
fallback{tag} AS (SELECT split, avg(dlat) AS dlat, avg(dlon) AS dlon FROM parts WHERE NOT is_test GROUP BY split),
scored{tag} AS (
  SELECT p.split, p.row_id, p.RNCID_1, p.CellID_1,
         {hav('p.Latitude_1 + coalesce(m.dlat, f.dlat)', 'p.Longitude_1 + coalesce(m.dlon, f.dlon)', 'p.Latitude_m', 'p.Longitude_m')} AS dist
  FROM parts p JOIN fallback{tag} f ON f.split = p.split
  LEFT JOIN models{tag} m ON m.split = p.split AND m.RNCID_1 = p.RNCID_1 AND m.CellID_1 = p.CellID_1
  WHERE p.is_test)"""


OWN_MEAN = (
    "SELECT split, RNCID_1, CellID_1, avg(dlat) AS dlat, avg(dlon) AS dlon "
    "FROM parts WHERE NOT is_test GROUP BY split, RNCID_1, CellID_1"
)


def mean_errors(n) -> str:
    return splits(n) + scored(OWN_MEAN) + error_rows()


def medians(errors="errors", name="medians") -> str:
    return f""", {name} AS (
  SELECT RNCID_1, CellID_1, dist AS median_error FROM (
    SELECT *, row_number() OVER (PARTITION BY RNCID_1, CellID_1 ORDER BY dist) AS rn,
           count(*) OVER (PARTITION BY RNCID_1, CellID_1) AS cnt FROM {errors})
  WHERE rn = cnt // 2 + 1)"""


def ranked_stations(medians_name="medians") -> str:
    return f""", sized AS (SELECT CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS k FROM {medians_name}),
best AS (SELECT RNCID_1, CellID_1, median_error FROM (
  SELECT *, row_number() OVER (ORDER BY median_error, RNCID_1, CellID_1) AS r FROM {medians_name}), sized WHERE r <= k),
worst AS (SELECT RNCID_1, CellID_1, median_error FROM (
  SELECT *, row_number() OVER (ORDER BY median_error DESC, RNCID_1, CellID_1) AS r FROM {medians_name}), sized WHERE r <= k)"""


def error_rows(tag="") -> str:
    return f""", errors{tag} AS (
  SELECT row_id, RNCID_1, CellID_1, avg(dist) AS dist FROM scored{tag} GROUP BY ALL)"""


def lent(kind) -> str:
    """A borrower's training set, materialised row by row, as CTE ``lent_<kind>``."""
    if kind == "best":
        source = "worst w, best b JOIN parts p ON p.RNCID_1 = b.RNCID_1 AND p.CellID_1 = b.CellID_1"
    else:
        source = "worst w JOIN parts p ON p.RNCID_1 = w.RNCID_1"
    return f""", lent_{kind} AS (
  SELECT p.split, w.RNCID_1, w.CellID_1, p.dlat, p.dlon FROM {source} WHERE NOT p.is_test)"""


def lent_models(kind) -> str:
    return f"""SELECT split, RNCID_1, CellID_1, avg(dlat) AS dlat, avg(dlon) AS dlon FROM (
  SELECT split, RNCID_1, CellID_1, dlat, dlon FROM parts WHERE NOT is_test
  UNION ALL
  SELECT l.split, l.RNCID_1, l.CellID_1, l.dlat, l.dlon FROM lent_{kind} l
  WHERE EXISTS (SELECT 1 FROM parts q WHERE NOT q.is_test AND q.split = l.split
                AND q.RNCID_1 = l.RNCID_1 AND q.CellID_1 = l.CellID_1))
  GROUP BY split, RNCID_1, CellID_1"""


def lent_scored(kind) -> str:
    return lent(kind) + scored(lent_models(kind), f"_{kind}")
