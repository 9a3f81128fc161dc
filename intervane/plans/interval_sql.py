"""DuckDB SQL of the interval queries, over the same whole tables."""

from __future__ import annotations

from intervane.functions import lengths as L


def _component(x: str, mode: float, sd: float) -> str:
    z = f"((ln(CAST({x} AS DOUBLE)) - (ln({mode}e0) + {sd}e0 * {sd}e0)) / {sd}e0)"
    return f"(CASE WHEN {x} >= 1 THEN exp(-0.5e0 * {z} * {z}) / ({x} * {sd}e0 * sqrt(2 * pi())) ELSE 0e0 END)"


_ONE = """
one AS (SELECT barcode, seqname, start_, end_, arg_min(length, fragment_id) AS length
        FROM fragments WHERE seqname IS NOT NULL GROUP BY ALL),
ev AS (SELECT seqname, unnest([start_, end_]) AS location, CASE WHEN abs(length) > 120 THEN 'c2' ELSE 'c1' END AS track FROM one),
"""
_NEAR = """
{name} AS (SELECT {keys}(location // 10 + j) * 10 AS g,
                  sum(n * exp(-0.5e0 * (((location // 10 + j) * 10 - location) / 200e0) ** 2)) * 100 / (200e0 * sqrt(2 * pi())) AS density
           FROM (SELECT {keys}location, count(*) AS n FROM ev WHERE location IS NOT NULL GROUP BY ALL), range(-101, 102) AS r(j)
           WHERE abs((location // 10 + j) * 10 - location) <= 1000 GROUP BY ALL)"""
_KDE = "WITH" + _ONE + _NEAR.format(name="dens", keys="seqname, ")
_TRACKS = (
    "WITH"
    + _ONE
    + _NEAR.format(name="dens", keys="track, seqname, ")
    + """,
cells AS (SELECT seqname, g AS location, sum(CASE WHEN track = 'c1' THEN density ELSE 0 END) AS c1,
                 sum(CASE WHEN track = 'c2' THEN density ELSE 0 END) AS c2 FROM dens GROUP BY ALL),
hits AS (SELECT seqname, location // 10 * 10 AS location, count(*) FILTER (track = 'c1') AS n_c1, count(*) FILTER (track = 'c2') AS n_c2
         FROM ev WHERE location IS NOT NULL GROUP BY ALL),
stretch AS (SELECT seqname, location, c1, c2, sum(jump) OVER (PARTITION BY seqname ORDER BY location ROWS UNBOUNDED PRECEDING) AS piece
            FROM (SELECT *, CASE WHEN location - lag(location) OVER (PARTITION BY seqname ORDER BY location) <= 10 THEN 0 ELSE 1 END AS jump FROM cells)),
tracks2 AS (SELECT s.seqname, s.location, c1, c2, coalesce(n_c1, 0) AS n_c1, coalesce(n_c2, 0) AS n_c2,
                   min(s.location) OVER w AS interval_start, max(s.location) OVER w AS interval_end
            FROM stretch s LEFT JOIN hits h ON s.seqname = h.seqname AND s.location = h.location
            WINDOW w AS (PARTITION BY s.seqname, piece))"""
)
_SMOOTH = (
    _TRACKS
    + """,
numbered AS (SELECT *, (location - interval_start) // 10 AS i, (interval_end - interval_start) // 10 + 1 AS m FROM tracks2),
taps AS (SELECT o, exp(-0.5e0 * (o / 20e0) ** 2) / (SELECT sum(exp(-0.5e0 * (p / 20e0) ** 2)) FROM range(-80, 81) q(p)) AS weight FROM range(-80, 81) r(o)),
spread AS (SELECT seqname, location, interval_start, m, ((i + o) % (2 * m) + 2 * m) % (2 * m) AS j, weight FROM numbered, taps),
smooth AS (SELECT a.seqname, a.location, sum(b.c2 * weight) AS c2_smooth FROM spread a JOIN numbered b
           ON a.seqname = b.seqname AND a.interval_start = b.interval_start AND b.i = CASE WHEN j < a.m THEN j ELSE 2 * a.m - 1 - j END GROUP BY ALL)"""
)
_CUT_SIGNAL = "SELECT unnest(generate_series(1, n_c1 + n_c2)) AS one, c1, c2 FROM tracks2 WHERE n_c1 + n_c2 > 0"


def _bound(track: str, total: str) -> str:
    rank = f"(n - 1) * (1 - ({total} + t / 2e0) / (2e0 * t) * 0.5e0)"
    return f"""r_{track} AS (SELECT {track} AS v, row_number() OVER (ORDER BY {track}) - 1 AS rn, {rank.replace('n - 1', 'count(*) OVER () - 1')} AS r FROM sig, fractions),
q_{track} AS (SELECT max(v) FILTER (rn = floor(r)) + (max(r) - floor(max(r))) * (max(v) FILTER (rn = ceil(r)) - max(v) FILTER (rn = floor(r))) AS q FROM r_{track})"""


_MARKED = (
    _SMOOTH
    + f""",
fractions AS (SELECT sum(n_c1) AS a, sum(n_c2) AS b, sum(n_c1) + sum(n_c2) AS t FROM tracks2),
sig AS ({_CUT_SIGNAL}),
{_bound('c1', 'a')},
{_bound('c2', 'b')},
bounds AS (SELECT x.q AS b1, y.q AS b2 FROM q_c1 x, q_c2 y),
marked AS (SELECT t.*, c1 > b1 AS c1_peak, (c2 + c2_smooth) / 2 > b2 OR c2_smooth > b2 AS c2_peak
           FROM tracks2 t JOIN smooth s ON t.seqname = s.seqname AND t.location = s.location, bounds)"""
)
_PEAKS = (
    _MARKED
    + """,
flagged AS (SELECT 'c1' AS track, seqname, location, c1 AS v FROM marked WHERE c1_peak
            UNION ALL SELECT 'c2', seqname, location, c2 FROM marked WHERE c2_peak),
runs AS (SELECT *, sum(jump) OVER (PARTITION BY track, seqname ORDER BY location ROWS UNBOUNDED PRECEDING) AS run
         FROM (SELECT *, CASE WHEN location - lag(location) OVER (PARTITION BY track, seqname ORDER BY location) <= 10 THEN 0 ELSE 1 END AS jump FROM flagged)),
found AS (SELECT track, seqname, min(location) - 5 AS start_, max(location) + 5 AS end_, avg(v) AS mean,
                 min(location) FILTER (v = top) AS summit, max(location) - min(location) + 10 AS length
          FROM (SELECT *, max(v) OVER (PARTITION BY track, seqname, run) AS top FROM runs) GROUP BY track, seqname, run),
called AS (SELECT *, track || '_' || seqname || '_' || start_ AS name, mean * length AS auc FROM found
           WHERE length > CASE track WHEN 'c1' THEN 100 ELSE 400 END)"""
)
_MERGE = """
good AS (SELECT DISTINCT peak_id, sample, seqname, start_, end_, auc FROM peaks WHERE sample IS NOT NULL AND seqname IS NOT NULL AND start_ < end_),
"""
_BINNED = """
WITH pts AS (SELECT sample, seqname, location // 100 * 100 + 37 AS location, CAST(count(DISTINCT cut_id) AS DOUBLE) AS value
             FROM cuts WHERE seqname IS NOT NULL AND location IS NOT NULL GROUP BY ALL),
nxt AS (SELECT *, lead(location) OVER w AS la, lead(value) OVER w AS lv FROM pts WINDOW w AS (PARTITION BY sample, seqname ORDER BY location)),
span AS (SELECT *, CAST(ceil(location / 50e0) * 50 AS BIGINT) AS a,
                CASE WHEN la - location <= 2000 THEN CAST(floor((la - 1) / 50e0) * 50 AS BIGINT) ELSE CAST(floor(location / 50e0) * 50 AS BIGINT) END AS b FROM nxt),
grid AS (SELECT sample, seqname, g AS location, CASE WHEN la - location <= 2000 THEN value + (lv - value) * (g - location) / (la - location) ELSE value END AS value
         FROM (SELECT *, unnest(range(a, b + 1, 50)) AS g FROM span WHERE b >= a))
"""
_TARGETED = """
targeted AS (SELECT DISTINCT cut_id, c.sample, c.seqname, location, abs(length) AS length, track AS comp FROM cuts c JOIN peaks p
             ON c.sample = p.sample AND c.seqname = p.seqname AND location >= start_ AND location <= end_ - 1),
hist AS (SELECT sample AS workchunk, comp, length, count(*) AS n FROM targeted WHERE length >= 1 GROUP BY ALL),
parts AS (SELECT *, {parts} FROM hist),
""".format(parts=", ".join(f"{_component('length', m, s)} AS p{k}" for k, (m, s) in enumerate(zip(L.MODES, L.MODEL_SDS))))


def _alpha(k: int) -> str:
    return f"CASE comp WHEN 'c1' THEN {L.PRIORS['c1'][k]}e0 ELSE {L.PRIORS['c2'][k]}e0 END"


def _step(i: int) -> str:
    total = " + ".join(f"w{k} * p{k}" for k in range(4))
    sums = ", ".join(f"greatest(sum(CASE WHEN {total} > 0 THEN n * w{k} * p{k} / ({total}) ELSE 0 END) + {_alpha(k)} - 1, 0) AS u{k}" for k in range(4))
    return f"""em{i} AS (SELECT workchunk, comp, {', '.join(f'u{k} / (u0 + u1 + u2 + u3) AS w{k}' for k in range(4))}
  FROM (SELECT p.workchunk, p.comp, {sums} FROM parts p JOIN em{i - 1} w ON p.workchunk = w.workchunk AND p.comp = w.comp GROUP BY p.workchunk, p.comp))"""


_SUM_ALPHA = " + ".join(_alpha(k) for k in range(4)).replace("CASE", "(CASE").replace("END", "END)")
_FIT = (
    _TARGETED
    + f"em0 AS (SELECT DISTINCT workchunk, comp, {', '.join(f'({_alpha(k)}) / ({_SUM_ALPHA}) AS w{k}' for k in range(4))} FROM hist),\n"
    + ",\n".join(_step(i).replace("CASE comp", "CASE p.comp") for i in range(1, 9))
    + ",\nfit AS (SELECT workchunk, comp, CAST(k AS INTEGER) AS k, CASE k WHEN 0 THEN w0 WHEN 1 THEN w1 WHEN 2 THEN w2 ELSE w3 END AS w FROM em8, range(0, 4) r(k))"
)


def _density_of(sds: tuple, x: str) -> str:
    return "CASE k " + " ".join(f"WHEN {k} THEN {_component(x, m, s)}" for k, (m, s) in enumerate(zip(L.MODES, sds))) + " END"


def _grid(sds: tuple) -> str:
    return f"""grid AS (SELECT workchunk, comp, CAST(i AS INTEGER) AS i, x AS length, sum(w * {_density_of(sds, 'x')}) AS density
  FROM (SELECT *, 1 + i * (799e0 / 499) AS x FROM fit, range(0, 500) r(i)) GROUP BY ALL)"""


def _mix(c: str) -> str:
    return "(" + " + ".join(f"{c}.w{k} * {_component('abs(c.length)', m, s)}" for k, (m, s) in enumerate(zip(L.MODES, L.MODEL_SDS))) + ")"


_PREP = """WITH RECURSIVE
once AS (SELECT DISTINCT barcode, seqname, start_, end_ FROM fragments
         WHERE seqname NOT IN ('chrM', 'chrUn', 'chrEBV') AND start_ IS NOT NULL AND end_ IS NOT NULL),
ev AS (SELECT seqname, location FROM (SELECT seqname, unnest([start_, end_]) AS location FROM once) c WHERE NOT EXISTS (
  SELECT 1 FROM blacklist b WHERE b.seqname = c.seqname AND b.start_ <= c.location AND c.location <= b.end_)),
"""

def _dense(padding: int) -> str:
    return (
        _NEAR.format(name="dens", keys="seqname, ")
        + f""",
pos AS (SELECT seqname, g, CASE WHEN g - lag(g) OVER (PARTITION BY seqname ORDER BY g) <= {2 * padding} THEN 0 ELSE 1 END AS jump FROM dens WHERE density > 2e0),
runs AS (SELECT *, sum(jump) OVER (PARTITION BY seqname ORDER BY g ROWS UNBOUNDED PRECEDING) AS run FROM pos),
ends AS (SELECT seqname, min(location) - 1 AS low, max(location) + 1 AS high FROM ev GROUP BY seqname),
chosen AS (SELECT r.seqname, greatest(min(low), min(g) - {padding}) AS start_, least(min(high), max(g) + {padding} - 1) AS end_
           FROM runs r JOIN ends e ON r.seqname = e.seqname GROUP BY r.seqname, run),
"""
    )


_SELECTED = "chosen AS (SELECT seqname, start_, end_ FROM peaks WHERE track = 'c1' AND seqname IS NOT NULL AND start_ IS NOT NULL AND end_ IS NOT NULL),\n"
def _windows(overlap: int, cuts: int, locs: int, padding: int) -> str:
    return f"""
wide AS (SELECT seqname, greatest(start_ - {padding}, 0) AS s, end_ + {padding} AS e FROM chosen WHERE greatest(start_ - {padding}, 0) < end_ + {padding}),
merge AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY seqname ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS label
          FROM (SELECT *, max(e) OVER (PARTITION BY seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide)),
regions AS (SELECT seqname, min(s) AS s, max(e) AS e FROM merge GROUP BY seqname, label),
bounds AS (SELECT seqname, s AS interval, e, CASE WHEN s = min(s) OVER w THEN s - {overlap * 3 // 2} ELSE s END AS low, CASE WHEN e = max(e) OVER w THEN e + {overlap * 3 // 2} ELSE e END AS high
           FROM regions WINDOW w AS (PARTITION BY seqname)),
placed AS (SELECT b.seqname, b.interval, low, high, location, count(*) AS n FROM ev JOIN bounds b ON ev.seqname = b.seqname AND location >= b.interval AND location <= e GROUP BY ALL),
spots AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS upto, count(*) OVER w AS place,
                 min(location) OVER (PARTITION BY seqname, interval ORDER BY location RANGE BETWEEN {overlap} PRECEDING AND CURRENT ROW) AS stop
          FROM placed WINDOW w AS (PARTITION BY seqname, interval ORDER BY location ROWS UNBOUNDED PRECEDING)),
jumps AS (SELECT a.*, b.stop AS following, c.upto - c.n AS following_cuts, c.place - 1 AS following_locs FROM spots a
          JOIN spots b ON a.seqname = b.seqname AND a.interval = b.interval AND a.stop = b.location
          JOIN spots c ON a.seqname = c.seqname AND a.interval = c.interval AND b.stop = c.location),
sizes AS (SELECT seqname, interval, low, high, min(location) AS a, max(location) AS z, CAST(sum(n) AS BIGINT) AS ncuts, count(*) AS nlocs,
                 min(location) FILTER (location >= low + {overlap}) AS inner_ FROM spots GROUP BY ALL),
steps AS (
  SELECT seqname, interval, 0 AS k, a AS first, CASE WHEN large THEN inner_ ELSE low + {overlap} END AS from_, CAST(0 AS BIGINT) AS cuts, CAST(0 AS BIGINT) AS locs,
         a - 1 AS last, large FROM (SELECT *, (2 * ncuts >= {cuts} OR nlocs >= {locs}) AND z >= low + {2 * overlap} AS large FROM sizes)
  UNION ALL
  SELECT seqname, interval, k + 1, x.following, x.stop, x.cuts, x.locs, x.location, true
  FROM (SELECT s.seqname, s.interval, s.k,
               min(struct_pack(location := j.location, stop := j.stop, following := j.following, cuts := j.following_cuts, locs := j.following_locs)) AS x
        FROM steps s JOIN jumps j ON s.seqname = j.seqname AND s.interval = j.interval
        WHERE s.large AND j.location > s.last AND (2 * (j.upto - s.cuts) >= {cuts} OR j.place - s.locs >= {locs}) AND j.stop >= s.from_ + {overlap}
        GROUP BY s.seqname, s.interval, s.k)),
windows AS (SELECT s.seqname, s.interval, s.k, s.first AS start_, coalesce(t.last, z.z) AS end_, s.from_ AS stitch_start,
                   coalesce(t.from_, greatest(z.high - {overlap}, s.from_)) AS stitch_end, max(s.k) OVER (PARTITION BY s.seqname, s.interval) > 0 AS is_subdivide
            FROM steps s JOIN sizes z ON s.seqname = z.seqname AND s.interval = z.interval
            LEFT JOIN steps t ON s.seqname = t.seqname AND s.interval = t.interval AND t.k = s.k + 1),
held AS (SELECT w.seqname, w.interval, k, location, n FROM windows w JOIN spots s ON w.seqname = s.seqname AND w.interval = s.interval AND location BETWEEN start_ AND end_),
counted AS (SELECT seqname, interval, k, CAST(sum(n) AS BIGINT) AS ncuts, count(*) AS nlocs FROM held GROUP BY ALL),
pairs AS (SELECT a.seqname, a.interval, a.k, count(*) FILTER (abs(a.location - b.location) < 6217) AS nnz1, count(*) FILTER (abs(a.location - b.location) < 24868) AS nnz2
          FROM held a JOIN held b ON a.seqname = b.seqname AND a.interval = b.interval AND a.k = b.k GROUP BY ALL),
made AS (SELECT w.*, ncuts, nlocs, nnz1, nnz2, round(ncuts * 1e-6 + nlocs * 2.5e-5 + (nnz1 + nnz2) * 8e-9 + 1.2e-2, 9) AS memory
         FROM windows w JOIN counted c ON w.seqname = c.seqname AND w.interval = c.interval AND w.k = c.k
         JOIN pairs p ON w.seqname = p.seqname AND w.interval = p.interval AND w.k = p.k)
"""


_DIVIDED = _PREP + _dense(1000) + _windows(200, 40, 30, 500)
#: One row per sequence, from the windows alone.
_RICHEST = """SELECT w.seqname, w.interval, w.k, nlocs, ncuts FROM windows w JOIN counted c ON w.seqname = c.seqname AND w.interval = c.interval AND w.k = c.k
QUALIFY row_number() OVER (PARTITION BY w.seqname ORDER BY nlocs DESC, w.interval, w.k) = 1"""

SQL = {
    "fragments_dedup": """SELECT fragment_id, sample, seqname, start_, end_, name, barcode, length FROM fragments
QUALIFY row_number() OVER (PARTITION BY barcode, seqname, start_, end_ ORDER BY fragment_id, loaded_at) = 1""",
    "dup_stats": """
SELECT sample, n_fragments, n_distinct, n_fragments - n_distinct AS n_removed, round((n_fragments - n_distinct) / CAST(n_fragments AS DOUBLE), 6) AS share_removed
FROM (SELECT sample, CAST(sum(n) AS BIGINT) AS n_fragments, count(*) AS n_distinct
      FROM (SELECT sample, barcode, seqname, start_, end_, count(DISTINCT fragment_id) AS n FROM fragments GROUP BY ALL) GROUP BY sample)""",
    "events_melt": """
SELECT fragment_id, sample, seqname, barcode, length, 'start' AS variable, start_ AS location FROM fragments
UNION ALL SELECT fragment_id, sample, seqname, barcode, length, 'end', end_ FROM fragments""",
    "read_type_counts": """
SELECT sample, CASE WHEN len > 120 THEN '>120' ELSE '≤120' END AS read_type,
       CASE WHEN len > 240 THEN '>240' WHEN len > 120 THEN '>120' ELSE '≤120' END AS long_type, count(*) AS n, CAST(sum(len) AS BIGINT) AS bases
FROM (SELECT sample, abs(end_ - start_) AS len FROM fragments) GROUP BY ALL""",
    "barcode_replace": "SELECT regexp_replace(barcode, '^([A-Z]{8})[A-Z]*$', '\\1') AS cell, count(*) AS n FROM fragments GROUP BY ALL",
    "seq_postfix": "SELECT regexp_replace(seqname, '_.*', '') AS sequence, count(*) AS n FROM fragments GROUP BY ALL",
    "seq_blacklist": "SELECT sample, seqname, count(*) AS n FROM fragments WHERE seqname NOT IN ('chrM', 'chrUn', 'chrEBV') GROUP BY ALL",
    "frequent_barcodes": """
SELECT DISTINCT fragment_id, sample, barcode FROM (SELECT *, count(*) OVER (PARTITION BY sample, barcode) AS size_ FROM fragments) WHERE size_ >= 100""",
    "blacklist_antijoin": """
SELECT DISTINCT cut_id, seqname, location FROM cuts c WHERE NOT EXISTS (
  SELECT 1 FROM blacklist b WHERE b.seqname = c.seqname AND b.start_ <= c.location AND c.location <= b.end_)""",
    "peaks_off_blacklist": """
SELECT DISTINCT peak_id AS interval_id, seqname, start_, end_ FROM peaks p WHERE start_ < end_ AND NOT EXISTS (
  SELECT 1 FROM blacklist b WHERE b.seqname = p.seqname AND b.start_ < p.end_ AND p.start_ <= b.end_)""",
    "cuts_in_intervals": """
SELECT peak_id, count(DISTINCT cut_id) AS n_cuts FROM peaks p JOIN cuts c
ON p.sample = c.sample AND p.seqname = c.seqname AND p.start_ <= c.location AND c.location <= p.end_ GROUP BY peak_id""",
    "interval_overlap_join": """
WITH p AS (SELECT DISTINCT peak_id, sample, track, seqname, start_, end_ FROM peaks WHERE start_ < end_)
SELECT a.peak_id, b.peak_id AS other_id, least(a.end_, b.end_) - greatest(a.start_, b.start_) AS shared
FROM p a JOIN p b ON a.sample = b.sample AND a.seqname = b.seqname AND b.start_ < a.end_ AND a.start_ <= b.end_
WHERE a.track = 'c1' AND b.track = 'c2'""",
    "region_parse": r"""
SELECT DISTINCT peak_id, CASE WHEN ok THEN split_part(t, ':', 1) END AS seqname,
       CASE WHEN ok THEN CAST(replace(regexp_extract(t, ':([0-9,_]+)-', 1), ',', '') AS BIGINT) END AS start_,
       CASE WHEN ok THEN CAST(regexp_extract(t, '-([0-9,_]+)', 1) AS BIGINT) END AS end_
FROM (SELECT *, regexp_matches(t, '^[^:]+:[0-9,_]+-[0-9,_]+') AS ok
      FROM (SELECT peak_id, CASE WHEN seqname IS NOT NULL AND start_ IS NOT NULL AND end_ IS NOT NULL
                            THEN seqname || ':' || format('{:,}', start_) || '-' || end_ END AS t FROM peaks))""",
    "region_fragments": """
WITH hit AS (SELECT DISTINCT fragment_id, sample, seqname, start_, end_ FROM fragments WHERE seqname = 'chr1' AND end_ >= 20000000 AND start_ <= 60000000)
SELECT fragment_id, sample, seqname, 'start' AS variable, start_ AS location FROM hit UNION ALL SELECT fragment_id, sample, seqname, 'end', end_ FROM hit""",
    "feature_lookup": """
WITH p AS (SELECT DISTINCT peak_id, sample, seqname, start_, end_ FROM peaks WHERE seqname IS NOT NULL AND start_ IS NOT NULL AND end_ IS NOT NULL),
b AS (SELECT seqname, min(start_) - 1000 AS low, max(end_) + 1000 AS high FROM p WHERE sample = 'S00000' GROUP BY seqname ORDER BY seqname LIMIT 1)
SELECT peak_id, p.seqname, start_, end_, count(*) OVER () AS n_features FROM p JOIN b ON p.seqname = b.seqname WHERE end_ > low AND start_ < high""",
    "length_hist": """
WITH f AS (SELECT sample, abs(length) AS length FROM fragments WHERE abs(length) > 0.5 AND sample IS NOT NULL),
b AS (SELECT sample, CAST(ceil((length - 0.5e0) / 10 - 1) AS BIGINT) AS bin, count(*) AS n FROM f GROUP BY ALL),
a AS (SELECT sample, bin FROM (SELECT DISTINCT sample FROM b), range(0, (SELECT max(bin) + 1 FROM b)) r(bin))
SELECT a.sample, a.bin * 10 + 5.5e0 AS length, coalesce(n, 0) + 1e0 AS count,
       round((coalesce(n, 0) + 1e0) / sum(coalesce(n, 0) + 1e0) OVER (PARTITION BY a.sample), 6) AS density
FROM a LEFT JOIN b ON a.sample = b.sample AND a.bin = b.bin""",
    "quadrature_widths": """
WITH s AS (SELECT sample, seqname, location, count(*) AS n FROM (SELECT DISTINCT cut_id, sample, seqname, location FROM cuts)
           WHERE sample IS NOT NULL AND seqname IS NOT NULL AND location IS NOT NULL GROUP BY ALL),
w AS (SELECT *, row_number() OVER o - 1 AS rank, location - lag(location) OVER o AS l, lead(location) OVER o - location AS r FROM s
      WINDOW o AS (PARTITION BY sample, seqname ORDER BY location)),
v AS (SELECT *, coalesce((l + r) / 2e0, CAST(l AS DOUBLE), CAST(r AS DOUBLE), 1e0) AS width FROM w)
SELECT sample, seqname, location, n, CAST(rank AS BIGINT) AS rank, round(width, 6) AS width, round(ln(width), 6) AS log_width FROM v""",
    "event_weights": """
WITH s AS (SELECT sample, seqname, location, count(*) AS n FROM (SELECT DISTINCT cut_id, sample, seqname, location FROM cuts)
           WHERE sample IS NOT NULL AND seqname IS NOT NULL AND location IS NOT NULL GROUP BY ALL),
w AS (SELECT *, lag(location) OVER o AS a, lead(location) OVER o AS b FROM s WINDOW o AS (PARTITION BY sample, seqname ORDER BY location))
SELECT sample, seqname, location, n,
       round(CASE WHEN a IS NULL AND b IS NULL THEN 1e0 ELSE (coalesce(b, location) - coalesce(a, location)) / 2e0 END / n, 6) AS weight FROM w""",
    "event_names": """
WITH s AS (SELECT DISTINCT cut_id, sample, seqname, location FROM cuts WHERE sample IS NOT NULL AND seqname IS NOT NULL AND location IS NOT NULL),
r AS (SELECT cut_id, row_number() OVER (ORDER BY sample, seqname, location, cut_id) - 1 AS number, count(*) OVER () AS n FROM s)
SELECT cut_id, number, 'event_' || lpad(CAST(number AS VARCHAR), length(CAST(n - 1 AS VARCHAR))::INT, '0') AS name FROM r""",
    "peaks_centred": """
SELECT DISTINCT peak_id, sample, track, seqname, start_, end_ FROM peaks
WHERE seqname = 'chr1' AND start_ + end_ > 40000000 AND start_ + end_ < 120000000""",
    "location_shift": """
SELECT sample, seqname, CAST(trunc(quantile_cont(location, 0.5)) AS BIGINT) AS median_location, count(*) AS n_locations
FROM (SELECT DISTINCT sample, seqname, location FROM cuts WHERE sample IS NOT NULL AND seqname IS NOT NULL AND location IS NOT NULL) GROUP BY ALL""",
    "spine_counts": """
SELECT sample, seqname, location, count(*) OVER (o RANGE BETWEEN 6216 PRECEDING AND CURRENT ROW) - 1 AS n_left,
       count(*) OVER (o RANGE BETWEEN CURRENT ROW AND 6216 FOLLOWING) - 1 AS n_right
FROM (SELECT DISTINCT sample, seqname, location FROM cuts WHERE sample IS NOT NULL AND seqname IS NOT NULL AND location IS NOT NULL)
WINDOW o AS (PARTITION BY sample, seqname ORDER BY location)""",
    "coverage_depth": """
WITH f AS (SELECT DISTINCT fragment_id, sample, seqname, start_, end_ FROM fragments WHERE sample IS NOT NULL AND seqname IS NOT NULL AND start_ IS NOT NULL AND end_ IS NOT NULL),
d AS (SELECT sample, seqname, location, CAST(sum(delta) AS BIGINT) AS delta
      FROM (SELECT sample, seqname, start_ AS location, 1 AS delta FROM f UNION ALL SELECT sample, seqname, end_, -1 FROM f) GROUP BY ALL)
SELECT *, CAST(sum(delta) OVER (PARTITION BY sample, seqname ORDER BY location) AS BIGINT) AS depth FROM d""",
    "coverage_ribbon": """
WITH f AS (SELECT DISTINCT peak_id, sample, seqname, start_, end_ FROM peaks WHERE sample IS NOT NULL AND seqname IS NOT NULL AND start_ < end_),
d AS (SELECT sample, seqname, location, sum(delta) AS delta
      FROM (SELECT sample, seqname, start_ AS location, 1 AS delta FROM f UNION ALL SELECT sample, seqname, end_, -1 FROM f) GROUP BY ALL),
c AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY sample, seqname ORDER BY location) AS BIGINT) AS depth FROM d)
SELECT sample, seqname, location, 0 AS side, CAST(coalesce(lag(depth) OVER (PARTITION BY sample, seqname ORDER BY location), 0) AS BIGINT) AS depth FROM c
UNION ALL SELECT sample, seqname, location, 1, depth FROM c""",
    "peak_depth": """
WITH f AS (SELECT DISTINCT peak_id, sample, seqname, start_, end_ FROM peaks WHERE sample IS NOT NULL AND seqname IS NOT NULL AND start_ < end_),
d AS (SELECT sample, seqname, location, sum(delta) AS delta
      FROM (SELECT sample, seqname, start_ AS location, 1 AS delta FROM f UNION ALL SELECT sample, seqname, end_, -1 FROM f) GROUP BY ALL),
c AS (SELECT sample, seqname, location, CAST(sum(delta) OVER w AS BIGINT) AS depth, lead(location) OVER w AS following FROM d
      WINDOW w AS (PARTITION BY sample, seqname ORDER BY location))
SELECT sample, seqname, location AS start_, following AS end_, depth FROM c WHERE depth > 0""",
    "extend_intervals": "WITH"
    + _MERGE
    + """
wide AS (SELECT sample, seqname, greatest(start_ - 500, 0) AS s, end_ + 500 AS e FROM (SELECT DISTINCT peak_id, sample, seqname, start_, end_ FROM peaks
         WHERE sample IS NOT NULL AND seqname IS NOT NULL AND start_ IS NOT NULL AND end_ IS NOT NULL) WHERE greatest(start_ - 500, 0) < end_ + 500),
l AS (SELECT *, sum(CASE WHEN s < reach THEN 0 ELSE 1 END) OVER (PARTITION BY sample, seqname ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS label
      FROM (SELECT *, max(e) OVER (PARTITION BY sample, seqname ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM wide))
SELECT sample, seqname, min(s) AS start_, max(e) AS end_, count(*) AS n_merged FROM l GROUP BY sample, seqname, label""",
    "merge_intervals": "WITH"
    + _MERGE
    + """
l AS (SELECT *, sum(CASE WHEN start_ < reach THEN 0 ELSE 1 END) OVER (PARTITION BY sample, seqname ORDER BY start_, end_, peak_id ROWS UNBOUNDED PRECEDING) AS label
      FROM (SELECT *, max(end_) OVER (PARTITION BY sample, seqname ORDER BY start_, end_, peak_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM good))
SELECT sample, seqname, min(start_) AS start_, max(end_) AS end_, count(*) AS n_merged, round(avg(auc), 6) AS mean FROM l GROUP BY sample, seqname, label""",
    "coverage_fraction": """
WITH l AS (SELECT *, sum(CASE WHEN start_ <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY seqname ORDER BY start_, end_ ROWS UNBOUNDED PRECEDING) AS label
      FROM (SELECT *, max(end_) OVER (PARTITION BY seqname ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
            FROM (SELECT DISTINCT seqname, start_, end_ FROM peaks WHERE seqname IS NOT NULL AND start_ < end_))),
m AS (SELECT seqname, min(start_) AS s, max(end_) AS e FROM l GROUP BY seqname, label),
q AS (SELECT seqname, sum(e - s) AS covered, max(e) AS reach FROM m GROUP BY seqname)
SELECT CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(reach) AS BIGINT) AS reach, round(CAST(sum(covered) AS DOUBLE) / CAST(sum(reach) AS DOUBLE), 6) AS fraction FROM q""",
    "sequence_ranges": """
WITH d AS (SELECT DISTINCT sample, CAST(nullif(regexp_extract(seqname, '^chr([0-9]+)$', 1), '') AS INTEGER) AS number FROM tracks),
r AS (SELECT sample, number, number - row_number() OVER (PARTITION BY sample ORDER BY number) AS run FROM d WHERE number IS NOT NULL),
g AS (SELECT sample, min(number) AS a, max(number) AS b FROM r GROUP BY sample, run)
SELECT sample, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM g GROUP BY sample""",
    "kde_density": _KDE + "SELECT seqname, g AS location, round(density, 6) AS density FROM dens",
    "kde_intervals": _KDE
    + """,
pos AS (SELECT seqname, g, CASE WHEN g - lag(g) OVER (PARTITION BY seqname ORDER BY g) <= 2000 THEN 0 ELSE 1 END AS jump FROM dens WHERE density > 2e0),
runs AS (SELECT *, sum(jump) OVER (PARTITION BY seqname ORDER BY g ROWS UNBOUNDED PRECEDING) AS run FROM pos),
ends AS (SELECT seqname, min(location) - 1 AS low, max(location) + 1 AS high FROM ev WHERE location IS NOT NULL GROUP BY seqname)
SELECT r.seqname, greatest(min(low), min(g) - 1000) AS start_, least(min(high), max(g) + 1000 - 1) AS end_, count(*) AS n_positions
FROM runs r JOIN ends e ON r.seqname = e.seqname GROUP BY r.seqname, run""",
    "target_fractions": "WITH"
    + _ONE
    + """
t AS (SELECT track, count(*) AS n_cuts FROM ev GROUP BY track)
SELECT track, n_cuts, round(n_cuts / CAST(sum(n_cuts) OVER () AS DOUBLE), 6) AS raw_share,
       round((n_cuts + sum(n_cuts) OVER () / 2e0) / (2e0 * CAST(sum(n_cuts) OVER () AS DOUBLE)) * 0.5e0, 6) AS fraction FROM t""",
    "two_tracks": _TRACKS + "SELECT seqname, location, interval_start, interval_end, round(c1, 6) AS c1, round(c2, 6) AS c2, n_c1, n_c2 FROM tracks2",
    "quantile_bounds": _TRACKS
    + f""",
s AS ({_CUT_SIGNAL})
SELECT 'c1' AS track, round(quantile_cont(c1, 0.75), 6) AS quantile FROM s UNION ALL SELECT 'c2', round(quantile_cont(c2, 0.75), 6) FROM s""",
    "gaussian_smooth": _SMOOTH + "SELECT seqname, location, round(c2_smooth, 6) AS c2_smooth FROM smooth",
    "peak_flags": _MARKED + "SELECT seqname, location, c1_peak, c2_peak FROM marked",
    "peak_islands": _PEAKS + "SELECT track, seqname, start_, end_, round(mean, 6) AS mean, summit, length, name, round(auc, 6) AS auc FROM called",
    "peak_summits": _PEAKS + "SELECT seqname, summit AS start_, summit + 1 AS end_, name, round(mean, 6) AS signal FROM called",
    "overlap_report": _PEAKS
    + """,
pairs AS (SELECT a.seqname, a.name AS c1_name, b.name AS c2_name, greatest(a.start_, b.start_) AS s, least(a.end_, b.end_) AS e,
                 a.end_ - a.start_ AS la, b.end_ - b.start_ AS lb
          FROM called a JOIN called b ON a.seqname = b.seqname AND a.track = 'c1' AND b.track = 'c2' AND b.start_ < a.end_ AND a.start_ <= b.end_),
stats AS (SELECT p.seqname, c1_name, c2_name, s, e, CAST(e - s AS DOUBLE) / la AS f1, CAST(e - s AS DOUBLE) / lb AS f2, avg(c1) AS m1, avg(c2) AS m2,
                 CASE WHEN count(*) > 1 AND stddev_pop(c1) > 1e-12 AND stddev_pop(c2) > 1e-12 THEN 1 - corr(c1, c2) END AS d
          FROM pairs p JOIN tracks2 t ON p.seqname = t.seqname AND t.location >= s AND t.location < e WHERE s < e GROUP BY ALL)
SELECT seqname, c1_name, c2_name, s AS start_, e AS end_, round(f1, 6) AS c1_fraction, round(f2, 6) AS c2_fraction, round(m1, 6) AS mean_c1, round(m2, 6) AS mean_c2,
       round(d, 6) AS distance, round(ln(m1 / m2), 6) AS log_ratio, round(ln(m1 / m2), 6) AS log_ratio_corrected, round(abs(ln(m1 / m2)), 6) AS callability,
       abs(ln(m1 / m2)) < 1 AS ambiguous FROM stats""",
    "filter_overlaps": _PEAKS
    + """,
shared AS (SELECT a.name, sum(CAST(least(a.end_, b.end_) - greatest(a.start_, b.start_) AS DOUBLE) / (a.end_ - a.start_)) AS share
           FROM called a JOIN called b ON a.seqname = b.seqname AND a.track <> b.track AND b.start_ < a.end_ AND a.start_ <= b.end_ GROUP BY a.name),
bad AS (SELECT c.* FROM called c JOIN shared s ON c.name = s.name WHERE share > 0.5),
lab AS (SELECT *, sum(CASE WHEN start_ < reach THEN 0 ELSE 1 END) OVER (PARTITION BY seqname ORDER BY start_, end_, name ROWS UNBOUNDED PRECEDING) AS label
        FROM (SELECT *, max(end_) OVER (PARTITION BY seqname ORDER BY start_, end_, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM bad))
SELECT track AS kind, seqname, start_, end_, round(mean, 6) AS mean FROM called WHERE name NOT IN (SELECT name FROM bad)
UNION ALL SELECT 'overlap', seqname, min(start_), max(end_), round(avg(mean), 6) FROM lab GROUP BY seqname, label""",
    "interp_track": _BINNED + "SELECT sample, seqname, location, round(value, 6) AS value FROM grid",
    "binned_track": _BINNED + "SELECT sample, seqname, location // 500 * 500 AS start_, location // 500 * 500 + 500 AS end_, round(avg(value) * 100, 6) AS value FROM grid GROUP BY ALL",
    "thinned_track": _BINNED
    + """,
r AS (SELECT *, row_number() OVER (PARTITION BY sample, seqname ORDER BY location) - 1 AS rn, count(*) OVER (PARTITION BY sample, seqname) AS m FROM pts)
SELECT sample, seqname, location, greatest(value, 2e0) AS value FROM r
WHERE m <= 20 OR rn IN (SELECT (j * (r.m - 1)) // 19 FROM range(0, 20) q(j))""",
    "sample_order": """
WITH m AS (SELECT sample, quantile_cont(CAST(length AS DOUBLE), 0.5) AS median FROM (SELECT DISTINCT fragment_id, sample, length FROM fragments) GROUP BY sample)
SELECT sample, median, CAST(dense_rank() OVER (ORDER BY median) AS INTEGER) AS place FROM m""",
    "shared_barcodes": "SELECT barcode, count(DISTINCT sample) AS n_labels FROM fragments WHERE barcode IS NOT NULL GROUP BY barcode HAVING count(DISTINCT sample) > 1",
    "fit_weights": "WITH" + _FIT + "SELECT workchunk, comp, k, round(w, 6) AS w FROM fit",
    "mode_weights": "WITH"
    + _FIT
    + """SELECT f.comp, k, round(sum(w * n_cuts), 4) AS cuts FROM fit f JOIN (SELECT workchunk, comp, sum(n) AS n_cuts FROM hist GROUP BY ALL) h
ON f.workchunk = h.workchunk AND f.comp = h.comp GROUP BY f.comp, k""",
    "length_posterior_grid": "WITH" + _FIT + ",\n" + _grid(L.MODEL_SDS) + "SELECT workchunk, comp, i, round(length, 6) AS length, round(density, 6) AS density FROM grid",
    "flip_check": "WITH"
    + _FIT
    + ",\n"
    + _grid(L.CHECK_SDS)
    + """,
diff AS (SELECT workchunk, i, sum(CASE comp WHEN 'c1' THEN density ELSE -density END) AS d FROM grid GROUP BY ALL HAVING count(*) = 2),
med AS (SELECT i, quantile_cont(d, 0.5) AS m FROM diff GROUP BY i)
SELECT workchunk, round(corr(d, m), 6) AS correlation, corr(d, m) < 0.9 AS flipped FROM diff JOIN med USING (i) GROUP BY workchunk""",
    "missing_chunks": "WITH"
    + _FIT
    + """SELECT DISTINCT sample AS workchunk FROM cuts WHERE sample NOT IN (SELECT workchunk FROM fit GROUP BY workchunk HAVING count(DISTINCT comp) = 2)""",
    "length_mixture_logpdf": "SELECT DISTINCT fragment_id, round(CASE WHEN p > 0 THEN ln(p) END, 6) AS logpdf FROM (SELECT fragment_id, "
    + " + ".join(f"{a / sum(L.PRIORS['c1'])!r}e0 * {_component('abs(length)', m, s)}" for a, m, s in zip(L.PRIORS["c1"], L.MODES, L.MODEL_SDS))
    + " AS p FROM fragments)",
    "cut_likelihoods": _TRACKS
    + ",\n"
    + _FIT
    + f""",
c AS (SELECT DISTINCT cut_id, sample, seqname, location, length FROM cuts),
j AS (SELECT cut_id, {_mix('a')} * t.c1 AS l1, {_mix('b')} * t.c2 AS l2
      FROM c LEFT JOIN em8 a ON c.sample = a.workchunk AND a.comp = 'c1' LEFT JOIN em8 b ON c.sample = b.workchunk AND b.comp = 'c2'
      LEFT JOIN tracks2 t ON c.seqname = t.seqname AND c.location // 10 * 10 = t.location),
n AS (SELECT cut_id, CASE WHEN l1 > 0 THEN l1 END AS l1, CASE WHEN l2 > 0 THEN l2 END AS l2 FROM j)
SELECT cut_id, round(ln(l1), 6) AS log_c1, round(ln(l2), 6) AS log_c2, round(l1 / (l1 + l2), 6) AS marginal_c1, round(l2 / (l1 + l2), 6) AS marginal_c2,
       round(ln(l1 + l2), 6) AS log_total FROM n""",
    "divided_packages": _DIVIDED + "SELECT *, seqname || '_' || interval || '.' || k AS name FROM made",
    "divided_richest": _DIVIDED
    + "SELECT seqname, interval, k, nlocs, ncuts FROM made QUALIFY row_number() OVER (PARTITION BY seqname ORDER BY nlocs DESC, interval, k) = 1",
    "divided_chunks": _DIVIDED + "SELECT count(*) AS n_packages, CAST(sum(ncuts) AS BIGINT) AS ncuts, CAST(sum(nlocs) AS BIGINT) AS nlocs, CAST(0 AS BIGINT) AS n_over FROM made",
    "package_coverage": _DIVIDED
    + """, q AS (SELECT seqname, sum(stitch_end - stitch_start) AS covered, max(stitch_end) AS reach FROM made GROUP BY seqname)
SELECT CAST(sum(covered) AS BIGINT) AS covered, CAST(sum(reach) AS BIGINT) AS reach, round(CAST(sum(covered) AS DOUBLE) / CAST(sum(reach) AS DOUBLE), 6) AS fraction FROM q""",
    "stitched_spines": _DIVIDED
    + """, inside AS (SELECT seqname, interval, min(stitch_start) AS a, max(stitch_end) AS z FROM made GROUP BY ALL),
near AS (SELECT seqname, interval, location, count(*) OVER (o RANGE BETWEEN 199 PRECEDING AND CURRENT ROW) - 1 AS n_left,
                count(*) OVER (o RANGE BETWEEN CURRENT ROW AND 199 FOLLOWING) - 1 AS n_right FROM spots WINDOW o AS (PARTITION BY seqname, interval ORDER BY location))
SELECT n.* FROM near n JOIN inside i ON n.seqname = i.seqname AND n.interval = i.interval WHERE location >= a AND location < z""",
    "selected_packages": _PREP + _SELECTED + _windows(200, 40, 30, 500) + "SELECT * FROM made",
    "peak_shares": _MARKED
    + """, f AS (SELECT 'c1' AS track, c1_peak AS flag FROM marked UNION ALL SELECT 'c2', c2_peak FROM marked)
SELECT track, count(*) AS n_positions, count(*) FILTER (flag) AS n_selected, round(count(*) FILTER (flag) / CAST(count(*) AS DOUBLE), 6) AS share FROM f GROUP BY track""",
    "sized_track": """
SELECT b.* FROM (SELECT seqname, location // 1000 * 1000 AS start_, location // 1000 * 1000 + 1000 AS end_, count(DISTINCT cut_id) AS n_cuts
                 FROM cuts WHERE seqname IS NOT NULL AND location IS NOT NULL GROUP BY ALL) b JOIN chrom_sizes c ON b.seqname = c.seqname
WHERE end_ <= size_ AND b.seqname = 'chr1' AND end_ >= 20000000 AND start_ <= 60000000""",
    "exon_depth": """
WITH f AS (SELECT DISTINCT peak_id, sample AS gene_name, seqname, start_, end_ FROM peaks WHERE sample IS NOT NULL AND seqname IS NOT NULL AND start_ < end_),
d AS (SELECT gene_name, seqname, location, sum(delta) AS delta
      FROM (SELECT gene_name, seqname, start_ AS location, 1 AS delta FROM f UNION ALL SELECT gene_name, seqname, end_, -1 FROM f) GROUP BY ALL),
c AS (SELECT gene_name, seqname, location, CAST(sum(delta) OVER w AS BIGINT) AS depth, lead(location) OVER w AS following FROM d
      WINDOW w AS (PARTITION BY gene_name, seqname ORDER BY location))
SELECT seqname, gene_name, location AS start_, following AS end_, depth, round(0.8e0 * depth / max(depth) OVER (PARTITION BY gene_name), 6) AS scaled FROM c WHERE depth > 0""",
    "facet_counts": """
SELECT concat_ws(' ', sample, CASE WHEN abs(end_ - start_) > 120 THEN '>120' ELSE '≤120' END) AS facet, count(*) AS n FROM fragments GROUP BY facet""",
    "peak_lanes": """
WITH RECURSIVE p AS (SELECT DISTINCT sample, seqname, start_, end_, peak_id AS interval_id FROM peaks
                     WHERE sample IS NOT NULL AND seqname IS NOT NULL AND start_ < end_ AND peak_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY sample, seqname ORDER BY start_, end_, interval_id) AS i FROM p),
walk AS (
  SELECT sample, seqname, i, start_, end_, interval_id, 1 AS place, [end_] AS ends FROM o WHERE i = 1
  UNION ALL
  SELECT sample, seqname, i, start_, end_, interval_id, place, list_concat(ends[1:place - 1], [end_], ends[place + 1:]) FROM (
    SELECT o.*, w.ends, coalesce(list_position(list_transform(w.ends, lambda x: x + 100 < o.start_), true), len(w.ends) + 1) AS place
    FROM walk w JOIN o ON w.sample = o.sample AND w.seqname = o.seqname AND o.i = w.i + 1))
SELECT sample, seqname, start_, end_, interval_id, CAST(-2 * (place - 1) AS INTEGER) AS lane FROM walk""",
    "flip_check_planted": "WITH"
    + _FIT
    + ",\n"
    + _grid(L.CHECK_SDS)
    + """,
diff AS (SELECT workchunk, i, sum(CASE WHEN (comp = 'c1') = (workchunk <> (SELECT max(workchunk) FROM fit)) THEN density ELSE -density END) AS d FROM grid GROUP BY ALL HAVING count(*) = 2),
med AS (SELECT i, quantile_cont(d, 0.5) AS m FROM diff GROUP BY i)
SELECT workchunk, round(corr(d, m), 6) AS correlation, corr(d, m) < 0.9 AS flipped FROM diff JOIN med USING (i) GROUP BY workchunk""",
    "missing_chunks_planted": "WITH"
    + _FIT
    + """SELECT DISTINCT sample AS workchunk FROM cuts WHERE sample NOT IN (
  SELECT workchunk FROM fit WHERE NOT (comp = 'c2' AND workchunk = (SELECT min(workchunk) FROM fit)) GROUP BY workchunk HAVING count(DISTINCT comp) = 2)""",
    "unflipped_cuts": "WITH"
    + _FIT
    + ",\n"
    + _grid(L.CHECK_SDS)
    + """,
diff AS (SELECT workchunk, i, sum(CASE WHEN (comp = 'c1') = (workchunk <> (SELECT max(workchunk) FROM fit)) THEN density ELSE -density END) AS d FROM grid GROUP BY ALL HAVING count(*) = 2),
med AS (SELECT i, quantile_cont(d, 0.5) AS m FROM diff GROUP BY i),
bad AS (SELECT workchunk FROM diff JOIN med USING (i) GROUP BY workchunk HAVING corr(d, m) < 0.9)
SELECT sample, count(*) AS n_cuts FROM (SELECT DISTINCT cut_id, sample FROM cuts) c WHERE NOT EXISTS (SELECT 1 FROM bad WHERE workchunk = sample) GROUP BY sample""",
    "suggested_priors": "WITH"
    + _FIT
    + ",\n"
    + _grid(L.CHECK_SDS)
    + """,
diff AS (SELECT workchunk, i, sum(CASE WHEN (comp = 'c1') = (workchunk <> (SELECT max(workchunk) FROM fit)) THEN density ELSE -density END) AS d FROM grid GROUP BY ALL HAVING count(*) = 2),
med AS (SELECT i, quantile_cont(d, 0.5) AS m FROM diff GROUP BY i),
bad AS (SELECT workchunk FROM diff JOIN med USING (i) GROUP BY workchunk HAVING corr(d, m) < 0.9),
modes AS (SELECT f.comp, k, CAST(floor(sum(w * n_cuts)) AS BIGINT) AS prior FROM fit f JOIN (SELECT workchunk, comp, sum(n) AS n_cuts FROM hist GROUP BY ALL) h
          ON f.workchunk = h.workchunk AND f.comp = h.comp GROUP BY f.comp, k)
SELECT workchunk, comp, k, prior FROM bad, modes""",
}

#: SQL of queries with the usual settings whose narrow form has another.
USUAL = {
    "kde_intervals": SQL["kde_intervals"].replace("<= 2000 THEN", "<= 20000 THEN").replace("min(g) - 1000", "min(g) - 10000").replace("max(g) + 1000 - 1", "max(g) + 10000 - 1"),
    "richest_packages": _PREP + _dense(10_000) + _windows(10_000, 15_000_000, 10_000_000, 5000) + _RICHEST,
    "richest_packages_narrow": _PREP + _dense(1000) + _windows(1000, 8000, 2000, 500) + _RICHEST,
    "interp_track": SQL["interp_track"].replace("la - location <= 2000", "la IS NOT NULL"),
    "binned_track": SQL["binned_track"].replace("la - location <= 2000", "la IS NOT NULL"),
}
