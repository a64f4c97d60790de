"""SQL building blocks for the check queries (DuckDB dialect)."""

from __future__ import annotations

from tidemeter.functions.calendar import EASTER_HOLIDAYS, FIXED_HOLIDAYS, MONDAY_HOLIDAYS

TAPS = """taps AS (
  SELECT event_id, ts, user_id AS card, event_type AS station,
         '(' || lpad(CAST(ascii(event_type) * 100 + length(event_type) AS VARCHAR), 5, '0') || ') ' || event_type AS station_field,
         value AS exits
  FROM events)"""

HHMM = "hour(ts) * 100 + minute(ts)"
OPEN = f"{HHMM} BETWEEN 400 AND 2300"


def stamp(c: str, micros: bool = False) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S{'.%f' if micros else ''}')"


def day(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d')"


def bucket(minutes: int, c: str = "ts") -> str:
    return f"time_bucket(INTERVAL '{minutes} minutes', {c})"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


def holidays(source: str = "events", ts: str = "ts") -> str:
    """CTEs ending in holidays(d, holiday) for the years of a table."""
    return f"""years AS (SELECT DISTINCT CAST(year({ts}) AS INT) AS y FROM {source}),
eas1 AS (SELECT y, y % 19 AS g, y // 100 AS c FROM years),
eas2 AS (SELECT y, g, c, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS e FROM eas1),
eas3 AS (SELECT y, c, e - (e // 28) * (1 - (e // 28) * (29 // (e + 1)) * ((21 - g) // 11)) AS m FROM eas2),
easter AS (SELECT make_date(y, 3, 28) + CAST(m - (y + y // 4 + m + 2 - c + c // 4) % 7 AS INT) AS d FROM eas3),
fixedh(m, k, name) AS (VALUES {_values(FIXED_HOLIDAYS)}),
mondayh(m, k, name) AS (VALUES {_values(MONDAY_HOLIDAYS)}),
easterh(n, name) AS (VALUES {_values(EASTER_HOLIDAYS)}),
hol AS (
  SELECT make_date(y, m, k) AS d, name FROM years, fixedh
  UNION ALL SELECT make_date(y, m, k) + CAST((8 - isodow(make_date(y, m, k))) % 7 AS INT), name FROM years, mondayh
  UNION ALL SELECT easter.d + CAST(n AS INT), name FROM easter, easterh),
holidays AS (SELECT d, string_agg(name, '; ' ORDER BY name) AS holiday FROM hol GROUP BY d)"""


def day_type(d: str) -> str:
    return (
        f"CASE WHEN {d} IN (SELECT d FROM holidays) THEN 'HO' WHEN isodow({d}) = 6 THEN 'SA' "
        f"WHEN isodow({d}) = 7 THEN 'SU' ELSE 'WD' END"
    )


def calendar(w: str) -> str:
    return (
        f"CAST(year({w}) AS INT) AS year, CAST(month({w}) AS INT) AS month, CAST(day({w}) AS INT) AS day, "
        f"CAST(isodow({w}) - 1 AS INT) AS day_of_week, CAST(hour({w}) * 100 + minute({w}) AS INT) AS time, "
        f"{day_type(f'CAST({w} AS DATE)')} AS date_type"
    )


def count_facts(minutes: int) -> str:
    """CTEs ending in facts(station, w, calendar fields, count_in, count_out, variance_in_1min)."""
    return f"""{TAPS},
{holidays()},
c1 AS (SELECT station, date_trunc('minute', ts) AS m, count(*) AS n FROM taps GROUP BY ALL),
fin AS (SELECT station, {bucket(minutes, 'm')} AS w, CAST(sum(n) AS BIGINT) AS count_in,
               coalesce(var_samp(n), 0) AS variance_in_1min FROM c1 GROUP BY ALL),
fout AS (SELECT station, {bucket(minutes)} AS w, CAST(trunc(round(sum(exits), 6)) AS INT) AS count_out FROM taps GROUP BY ALL),
facts AS (SELECT station, w, {calendar('w')}, count_in, count_out, variance_in_1min
          FROM fin FULL JOIN fout USING (station, w))"""


def rate_facts(minutes: int) -> str:
    """CTEs ending in rates(station, w, calendar fields, lambda_in, lambda_out)."""
    return f"""{TAPS},
{holidays()},
c5 AS (SELECT station, {bucket(5)} AS w5, count(*) AS n FROM taps GROUP BY ALL),
rin AS (SELECT station, {bucket(minutes, 'w5')} AS w, avg(n) AS lambda_in FROM c5 GROUP BY ALL),
rout AS (SELECT station, {bucket(minutes)} AS w, sum(exits) / {minutes / 5.0}e0 AS lambda_out FROM taps GROUP BY ALL),
rates AS (SELECT station, w, {calendar('w')}, lambda_in, lambda_out FROM rin FULL JOIN rout USING (station, w))"""


def dense(minutes: int, where: str = "time BETWEEN 400 AND 2300") -> str:
    """CTEs ending in dense(station, date_type, date, time, count_in, count_out, variance_in_1min)."""
    return f"""{count_facts(minutes)},
fx AS (SELECT station, date_type, make_date(year, month, day) AS date, time, coalesce(count_in, 0) AS count_in,
              coalesce(count_out, 0) AS count_out, coalesce(variance_in_1min, 0) AS variance_in_1min FROM facts WHERE {where}),
dense AS (SELECT g.station, g.date_type, g.date, s.time, coalesce(f.count_in, 0) AS count_in,
                 coalesce(f.count_out, 0) AS count_out, coalesce(f.variance_in_1min, 0) AS variance_in_1min
          FROM (SELECT DISTINCT station, date_type, date FROM fx) g
          JOIN (SELECT DISTINCT station, date_type, time FROM fx) s ON g.station = s.station AND g.date_type = s.date_type
          LEFT JOIN fx f ON f.station = g.station AND f.date_type = g.date_type AND f.date = g.date AND f.time = s.time)"""


def curves(
    minutes: int, min_points: int, target: int, unit_sum: bool = True, start: int = 400, end: int = 2300, measure: str = "lambda_in"
) -> str:
    """CTEs ending in cp(station, year, month, day, day_of_week, date_type, pos, v): resampled daily curves."""
    share = f"{measure} / sum({measure}) OVER (PARTITION BY station, year, month, day)" if unit_sum else measure
    keys = "station, year, month, day, day_of_week, date_type"
    return f"""{rate_facts(minutes)},
rk AS (SELECT {keys}, {share} AS x, row_number() OVER (PARTITION BY station, year, month, day ORDER BY time) - 1 AS i,
              count(*) OVER (PARTITION BY station, year, month, day) AS n
       FROM rates WHERE time BETWEEN {start} AND {end}),
kept AS (SELECT * FROM rk WHERE n >= {min_points}),
pos AS (SELECT DISTINCT {keys}, n, p.pos, p.pos * (n - 1) / {target - 1}e0 AS u
        FROM kept, (SELECT unnest(range(0, {target})) AS pos) p),
br AS (SELECT *, least(CAST(floor(u) AS BIGINT), n - 1) AS lo FROM pos),
cp AS (SELECT b.station, b.year, b.month, b.day, b.day_of_week, b.date_type, b.pos,
              a.x + (c.x - a.x) * (b.u - b.lo) AS v
       FROM br b
       JOIN kept a ON a.station = b.station AND a.year = b.year AND a.month = b.month AND a.day = b.day AND a.i = b.lo
       JOIN kept c ON c.station = b.station AND c.year = b.year AND c.month = b.month AND c.day = b.day
                  AND c.i = least(b.lo + 1, b.n - 1))"""


def minute_grid(bandwidth: float = 5.0) -> str:
    """CTEs ending in grid(station, d, minute, n, lam): dense minutes with kernel intensity."""
    return f"""{TAPS},
mc AS (SELECT station, CAST(ts AS DATE) AS d, hour(ts) * 60 + minute(ts) AS minute, count(*) AS n
       FROM taps WHERE {OPEN} GROUP BY ALL),
mgrid AS (SELECT s.station, s.d, g.minute FROM (SELECT DISTINCT station, d FROM mc) s,
          (SELECT unnest(range(240, 1381)) AS minute) g),
lam AS (SELECT g.station, g.d, g.minute,
               sum(mc.n * exp(-0.5e0 * pow((g.minute - mc.minute) / {bandwidth}e0, 2))) / ({bandwidth}e0 * sqrt(2 * pi())) AS lam
        FROM mgrid g JOIN mc ON mc.station = g.station AND mc.d = g.d GROUP BY ALL),
grid AS (SELECT station, d, minute, CAST(coalesce(n, 0) AS BIGINT) AS n, lam FROM lam LEFT JOIN mc USING (station, d, minute))"""


def minute_series() -> str:
    """CTEs ending in series(station, d, minute, n): dense minutes."""
    return f"""{TAPS},
mc AS (SELECT station, CAST(ts AS DATE) AS d, hour(ts) * 60 + minute(ts) AS minute, count(*) AS n
       FROM taps WHERE {OPEN} GROUP BY ALL),
series AS (SELECT s.station, s.d, g.minute, CAST(coalesce(mc.n, 0) AS BIGINT) AS n
           FROM (SELECT DISTINCT station, d FROM mc) s CROSS JOIN (SELECT unnest(range(240, 1381)) AS minute) g
           LEFT JOIN mc ON mc.station = s.station AND mc.d = s.d AND mc.minute = g.minute)"""


def trips() -> str:
    """CTEs ending in trips(card, origin, destination, t1, t2)."""
    return f"""{TAPS},
pr AS (SELECT card, ts, station, lag(ts) OVER w AS t1, lag(station) OVER w AS s1
       FROM taps WINDOW w AS (PARTITION BY card ORDER BY ts, event_id)),
trips AS (SELECT card, s1 AS origin, station AS destination, t1, ts AS t2 FROM pr WHERE s1 <> station)"""


def rolling() -> str:
    """CTEs ending in est(station, date, w, n, estimate)."""
    return f"""{TAPS},
c5 AS (SELECT station, {bucket(5)} AS w, count(*) AS n FROM taps GROUP BY ALL),
est AS (SELECT station, CAST(w AS DATE) AS date, w, n,
               avg(n) OVER (PARTITION BY station, CAST(w AS DATE) ORDER BY w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS estimate
        FROM c5)"""


def ticks(minutes: int) -> str:
    """CTEs ending in sampled(station, date, tick, estimate): the latest estimate at every tick."""
    return f"""{rolling()},
ends AS (SELECT date, max(w) + INTERVAL 5 MINUTE AS closing FROM est GROUP BY date),
grid AS (SELECT e.date, unnest(generate_series(CAST(e.date AS TIMESTAMP), e.closing - INTERVAL 1 SECOND, INTERVAL {minutes} MINUTE)) AS tick FROM ends e),
sampled AS (SELECT s.station, g.date, g.tick, arg_max(s.estimate, s.w) AS estimate
            FROM grid g JOIN est s ON s.date = g.date AND s.w <= g.tick GROUP BY ALL)"""


def horner(coefficients: list[float], x: str) -> str:
    acc = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        acc = f"({acc} * {x} + {c!r}::DOUBLE)"
    return acc


def erfc(x: str) -> str:
    from tidemeter.functions import special as S

    a, sq = f"abs({x})", f"(({x}) * ({x}))"
    inner = f"1e0 - ({x}) * {horner(S.ERF_SMALL[0], sq)} / {horner(S.ERF_SMALL[1], sq)}"
    middle = f"exp(-{sq}) * {horner(S.ERFC_MIDDLE[0], a)} / {horner(S.ERFC_MIDDLE[1], a)}"
    inv = f"(1e0 / {sq})"
    large = (
        f"exp(-{sq}) * (1e0 / sqrt(pi()) - {inv} * {horner(S.ERFC_LARGE[0], inv)} / {horner(S.ERFC_LARGE[1], inv)}) / {a}"
    )
    upper = f"(CASE WHEN {a} <= 4e0 THEN {middle} ELSE {large} END)"
    return f"(CASE WHEN {a} <= 0.46875e0 THEN {inner} WHEN ({x}) > 0 THEN {upper} ELSE 2e0 - {upper} END)"


def normal_cdf(z: str) -> str:
    return f"(0.5e0 * {erfc(f'(-({z}) * sqrt(0.5e0))')})"


def normal_ppf(p: str) -> str:
    from tidemeter.functions import special as S

    q = f"(({p}) - 0.5e0)"
    mid = f"(0.180625e0 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1e0 - ({p}))))"
    tail = (
        f"(CASE WHEN {r} <= 5e0 THEN {horner(S.PPF_TAIL[0], f'({r} - 1.6e0)')} / {horner(S.PPF_TAIL[1], f'({r} - 1.6e0)')} "
        f"ELSE {horner(S.PPF_FAR[0], f'({r} - 5e0)')} / {horner(S.PPF_FAR[1], f'({r} - 5e0)')} END)"
    )
    centre = f"{q} * {horner(S.PPF_CENTRE[0], mid)} / {horner(S.PPF_CENTRE[1], mid)}"
    return f"(CASE WHEN abs({q}) <= 0.425e0 THEN {centre} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def unit_hash(seed: int, *parts: str) -> str:
    text = " || '|' || ".join([*(f"CAST({p} AS VARCHAR)" for p in parts), f"'{seed}'"])
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / 281474976710656e0)"
