"""DuckDB twins of the catalogue's queries, written from the operators' definitions with lists and windows."""

from __future__ import annotations

from ..functions.symbols import gaussian_cuts

CUTS = gaussian_cuts(4)
MAX = "1.7976931348623157e308::DOUBLE"


def r6(x: str) -> str:
    return f"(round({x}, 6) + 0::DOUBLE)"


S = """s AS (SELECT vec_id AS series_id, label, CASE vec_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validate' ELSE 'train' END AS split,
  list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"""


def sq(x: str) -> str:
    return f"list_avg(list_transform({x}, lambda v: v * v))"


def sd_pop(x: str) -> str:
    return f"sqrt(greatest({sq(x)} - list_avg({x}) * list_avg({x}), 0))"


def sd_samp(x: str) -> str:
    n = f"len({x})"
    return f"sqrt(greatest(({n} * list_sum(list_transform({x}, lambda v: v * v)) - list_sum({x}) * list_sum({x})) / ({n} * ({n} - 1)), 0))"


def win(width: int, source: str = "s", step: str = "") -> str:
    """w: all windows of a width."""
    return f"""w AS (SELECT series_id, label, split, o AS "offset", x[o + 1 : o + {width}] AS w
  FROM (SELECT *, unnest(range(len(x) - {width - 1})) AS o FROM {source}) {step})"""


def blocks(width: int, source: str = "s") -> str:
    return f"b AS (SELECT series_id, label, split, o AS block, x[o * {width} + 1 : (o + 1) * {width}] AS w FROM (SELECT *, unnest(range(len(x) // {width})) AS o FROM {source}))"


Z = f"""z AS (SELECT * EXCLUDE (w), CASE WHEN sd < 0.001 THEN list_transform(w, lambda v: 0::DOUBLE) ELSE list_transform(w, lambda v: (v - mu) / sd) END AS z
  FROM (SELECT *, list_avg(w) AS mu, {sd_samp("w")} AS sd FROM w))"""


def overlap(width: int, parts: int) -> str:
    size = f"({width} / {parts}::DOUBLE)"
    return f"""list_transform(range({parts}), lambda i: list_sum(list_transform(range({width}), lambda j:
    z[j + 1] * greatest(0, least(j + 1, (i + 1) * {size}) - greatest(j, i * {size})))) / {size})"""


def letters(values: str, cuts: str) -> str:
    return f"list_aggregate(list_transform({values}, lambda v: chr((97 + {cuts})::INTEGER)), 'string_agg', '')"


GAUSS = " + ".join(f"(v >= {c!r}::DOUBLE)::INTEGER" for c in CUTS)
SAX = f"""{win(16)}, {Z},
words AS (SELECT series_id, label, split, "offset", {letters("list_transform(range(8), lambda i: (z[2 * i + 1] + z[2 * i + 2]) / 2)", GAUSS)} AS word FROM z)"""


# Models of word bags by class, their predictions and correct answers.
ENSEMBLE = f"""ww AS (SELECT width, series_id, label, split, x[o + 1 : o + width] AS w FROM (SELECT *, unnest(range(len(x) - width + 1)) AS o FROM s, unnest([8, 16, 24, 32, 40, 48]) t(width))),
wz AS (SELECT * EXCLUDE (w), CASE WHEN sd < 0.001 THEN list_transform(w, lambda v: 0::DOUBLE) ELSE list_transform(w, lambda v: (v - mu) / sd) END AS z FROM (SELECT *, list_avg(w) AS mu, {sd_samp("w")} AS sd FROM ww)),
words AS (SELECT (width // 8 - 1)::INTEGER AS param_id, series_id, label, split, {letters("list_transform(range(8), lambda i: list_avg(z[i * width // 8 + 1 : (i + 1) * width // 8]))", GAUSS)} AS word FROM wz),
tf AS (SELECT param_id, label, word, count(*) AS tf FROM words WHERE split = 'train' GROUP BY ALL),
cw AS (SELECT *, (1 + ln(tf)) * ln(1 + (SELECT count(DISTINCT label) FROM tf) / (count(*) OVER (PARTITION BY param_id, word))::DOUBLE) AS weight FROM tf),
cv AS (SELECT param_id, label, word, weight / sqrt(sum(weight * weight) OVER (PARTITION BY param_id, label)) AS weight FROM cw),
sc AS (SELECT param_id, w.series_id, w.split, w.label AS truth, v.label, round(sum(weight), 9) AS score FROM words w JOIN cv v USING (param_id, word) WHERE split <> 'train' GROUP BY ALL),
pr AS (SELECT param_id, series_id, split, truth, max(struct_pack(score := score, label := label)).label AS predicted FROM sc GROUP BY ALL),
models AS (SELECT param_id, count(*) FILTER (predicted = truth) AS correct FROM pr WHERE split = 'validate' GROUP BY 1),
best AS (SELECT * FROM models WHERE correct >= (SELECT max(correct) FROM models) * 0.92)"""


def lags(n: int, most: int, source: str = "s") -> str:
    """acf(series_id, label, split, lag, r)."""
    a, b = f"x[1 : {n} - lag]", f"x[lag + 1 : {n}]"
    return f"""l AS (SELECT *, unnest(range(1, {most + 1})) AS lag FROM {source}),
m AS (SELECT series_id, label, split, lag, list_avg(list_transform(range(1, {n} - lag + 1), lambda i: x[i] * x[i + lag])) - list_avg({a}) * list_avg({b}) AS c,
   {sq(a)} - list_avg({a}) * list_avg({a}) AS va, {sq(b)} - list_avg({b}) * list_avg({b}) AS vb FROM l),
acf AS (SELECT series_id, label, split, lag, CASE WHEN va > 1e-12 AND vb > 1e-12 AND abs(c / sqrt(va * vb)) <= 1 THEN c / sqrt(va * vb) ELSE 0 END AS r FROM m)"""


def coef(width: int) -> str:
    """A packed Fourier value of a row's w at k, divided by sqrt(width) and sd, every second one negated."""
    dot = lambda f: f"list_sum(list_transform(range({width}), lambda j: w[j + 1] * {f}(2 * pi() * (k // 2) * j / {width})))"
    return f"(CASE WHEN k = 1 THEN 0 WHEN k % 2 = 0 THEN {dot('cos')} ELSE {dot('sin')} END) / sqrt({width}) / CASE WHEN sd = 0 THEN 1 ELSE sd END"


def fourier(source: str, width: int, keys: str) -> str:
    return f"SELECT {keys}, k, {coef(width)} AS v FROM (SELECT *, {sd_pop('w')} AS sd, unnest(range(8)) AS k FROM {source})"


def depth_bins(width: int) -> str:
    return f"""tr AS (SELECT * FROM s WHERE split = 'train'), {blocks(width, "tr")},
hist AS (SELECT k AS coef, round(v, 2) + 0 AS value, count(*) AS n FROM ({fourier("b", width, "series_id")}) GROUP BY 1, 2),
runs AS (SELECT *, sum(n) OVER (PARTITION BY coef ORDER BY value) AS upto, sum(n) OVER (PARTITION BY coef) AS total FROM hist),
c1 AS (SELECT coef, coalesce(min(value) FILTER (upto > ceil(total / 4)), {MAX}) AS b1 FROM runs GROUP BY coef),
c2 AS (SELECT coef, b1, coalesce(min(value) FILTER (upto > ceil(total / 4 * 2) AND value > b1), {MAX}) AS b2 FROM runs JOIN c1 USING (coef) GROUP BY coef, b1),
c3 AS (SELECT coef, b1, b2, coalesce(min(value) FILTER (upto > ceil(total / 4 * 3) AND value > b2), {MAX}) AS b3 FROM runs JOIN c2 USING (coef) GROUP BY coef, b1, b2)"""


def gain_level(level: int) -> str:
    """One more cut of every part of every coefficient: k<level>(coef, part, cut) and the rows of the parts after it."""
    t = lambda c: f"CASE WHEN {c} > 0 THEN {c} * log2({c}) ELSE 0 END"
    here = f"h{level}"
    return f"""g{level} AS (SELECT a.coef, a.part, a.value, sum(b.n) FILTER (b.value <= a.value) AS l, sum(b.n) AS w, b.label
  FROM (SELECT DISTINCT coef, part, value FROM {here}) a JOIN {here} b ON a.coef = b.coef AND a.part = b.part GROUP BY a.coef, a.part, a.value, b.label),
e{level} AS (SELECT coef, part, value, sum(coalesce(l, 0)) AS nl, sum(w) AS total, sum({t("coalesce(l, 0)")}) AS sl, sum({t("(w - coalesce(l, 0))")}) AS sr, sum({t("w")}) AS sw
  FROM g{level} GROUP BY coef, part, value),
f{level} AS (SELECT *, lead(value) OVER (PARTITION BY coef, part ORDER BY value) AS cut,
  round(({t("total")} - sw - ({t("nl")} - sl) - ({t("(total - nl)")} - sr)) / total, 9) AS gain FROM e{level}),
k{level} AS (SELECT coef, part, cut FROM (SELECT *, row_number() OVER (PARTITION BY coef, part ORDER BY gain DESC, cut DESC) AS nth FROM f{level}
  WHERE cut IS NOT NULL AND nl >= 3 AND total - nl >= 3 AND gain > 0) WHERE nth = 1),
h{level + 1} AS (SELECT h.coef, h.part * 2 + CASE WHEN k.cut IS NOT NULL AND h.value >= k.cut THEN 1 ELSE 0 END AS part, h.value, h.label, h.n
  FROM {here} h LEFT JOIN k{level} k ON h.coef = k.coef AND h.part = k.part)"""


def sfa(width: int) -> str:
    return f"""{depth_bins(width)}, {win(width)},
f AS ({fourier("w", width, 'series_id, label, split, "offset"')}),
sy AS (SELECT series_id, label, split, "offset", k, (v >= b1)::INTEGER + (v >= b2)::INTEGER + (v >= b3)::INTEGER AS c FROM f JOIN c3 ON k = coef),
swords AS (SELECT series_id, label, split, "offset", string_agg(chr(97 + c), '' ORDER BY k) AS word, sum(c::BIGINT << (2 * k))::BIGINT AS code FROM sy GROUP BY ALL)"""


def entropy(p: str, n: str) -> str:
    part = lambda c: f"CASE WHEN {c} > 0 AND {n} > 0 THEN -(({c}) / ({n})::DOUBLE) * ln(({c}) / ({n})::DOUBLE) ELSE 0 END"
    return f"({part(p)} + {part(f'({n} - {p})')})"


def gain(pf: str, nf: str, p: str, n: str) -> str:
    return f"({entropy(p, n)} - {nf} / {n}::DOUBLE * {entropy(pf, nf)} - ({n} - {nf}) / {n}::DOUBLE * {entropy(f'({p} - {pf})', f'({n} - {nf})')})"


WEIGHT = "list_sum(list_transform(x, lambda v: round(abs(v), 4)))"
EXEMPLARS = """ex AS (SELECT label, series_id FROM (SELECT label, series_id, row_number() OVER (PARTITION BY label
  ORDER BY (series_id * 1103515245 + 7) % 2147483648, series_id) AS k FROM s WHERE split = 'train') WHERE k = 1)"""
L1 = " + ".join(f"abs(ascii(substr(q.word, {i}, 1)) - ascii(substr(t.word, {i}, 1)))" for i in range(1, 9))
QUERY = f"""{S}, {SAX}, {EXEMPLARS},
q AS (SELECT w.label, w.word, min(w."offset") AS "offset" FROM words w JOIN ex USING (series_id) GROUP BY ALL),
d AS (SELECT q.label, q.word, q."offset", t.series_id, t.label AS of, min({L1}) AS value
  FROM q, (SELECT DISTINCT series_id, label, word FROM words WHERE split = 'train') t GROUP BY ALL)"""
SCORED = f"""{QUERY},
v AS (SELECT label, word, "offset", value, count(*) AS here, count(*) FILTER (of = label) AS own FROM d GROUP BY ALL),
far AS (SELECT *, sum(here) OVER f AS nf, sum(own) OVER f AS pf, sum(here) OVER a AS n, sum(own) OVER a AS p FROM v
  WINDOW f AS (PARTITION BY label, word ORDER BY value DESC), a AS (PARTITION BY label, word)),
g AS (SELECT *, round({gain("pf", "nf", "p", "n")}, 9) AS gain FROM far),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label, word ORDER BY gain DESC, value) AS k FROM g) WHERE k = 1),
scored AS (SELECT label, word, "offset", CASE WHEN gain > 0 THEN gain ELSE 0 END AS gain, CASE WHEN gain > 0 THEN value ELSE 0 END AS threshold,
  gain > 0 AND 2 * pf <= p AS valid FROM b),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gain DESC, "offset", word) AS k FROM scored WHERE valid))"""

ATTRS = {"all": "ats AS (SELECT series_id, label, attribute, round(x[attribute + 1], 6) AS value FROM (SELECT *, unnest(range(len(x))) AS attribute FROM s WHERE split = 'train'))"}
GINI = """cnt AS (SELECT attribute, value, label, count(*) AS c FROM ats GROUP BY ALL),
pts AS (SELECT attribute, value, lead(value) OVER (PARTITION BY attribute ORDER BY value) AS next FROM (SELECT DISTINCT attribute, value FROM cnt)),
cls AS (SELECT attribute, label, sum(c) AS al FROM cnt GROUP BY ALL),
grid AS (SELECT p.attribute, p.value, p.next, k.label, k.al, sum(coalesce(c.c, 0)) OVER (PARTITION BY p.attribute, k.label ORDER BY p.value) AS l
  FROM pts p JOIN cls k USING (attribute) LEFT JOIN cnt c ON c.attribute = p.attribute AND c.value = p.value AND c.label = k.label),
sides AS (SELECT attribute, value, next, sum(l) AS nl, sum(al - l) AS nr, sum(l * l) AS ql, sum((al - l) * (al - l)) AS qr FROM grid WHERE next IS NOT NULL GROUP BY ALL),
splits AS (SELECT attribute, (value + next) / 2 AS threshold,
  round((nl * (1 - ql::DOUBLE / (nl * nl)) + nr * (1 - qr::DOUBLE / (nr * nr))) / (nl + nr), 9) AS wgini FROM sides),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY wgini, threshold) AS k FROM splits) WHERE k = 1)"""


def acf_values(alias: str = "rv") -> str:
    """(series_id, label, split, attribute, value) of the [8, 56) interval's autocorrelations, lags 1..24."""
    return f"""si AS (SELECT series_id, label, split, x[9:56] AS x FROM s), {lags(48, 24, "si")},
{alias} AS (SELECT series_id, label, split, lag - 1 AS attribute, {r6("r")} AS value FROM acf)"""


RISE = f"""{acf_values()}, ats AS (SELECT series_id, label, attribute, value FROM rv WHERE split = 'train'), {GINI},
fx AS (SELECT a.attribute, b.threshold, a.label, count(*) FILTER (a.value >= b.threshold) AS far, count(*) AS p FROM ats a JOIN bs b USING (attribute) GROUP BY ALL),
fg AS (SELECT *, sum(far) OVER (PARTITION BY attribute) AS nf, sum(p) OVER (PARTITION BY attribute) AS n FROM fx),
rg AS (SELECT attribute, threshold, label, far, p - far AS near, round({gain("far", "nf", "p", "n")}, 9) AS gain FROM fg),
rise AS (SELECT attribute, threshold, label, gain, (far >= near)::INTEGER AS sign FROM
  (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY gain DESC, label DESC) AS k FROM rg) WHERE k = 1)"""

# Candidates of one node: three SAX words per class, and the interval's attributes.
FEATURES = f"""{SCORED}, {RISE.replace("b AS (", "b_ AS (")},
few AS (SELECT 'RISE' AS type, label, gain AS infogain, threshold, sign, attribute, -1 AS start, '' AS word FROM rise WHERE gain > 0
  UNION ALL SELECT 'SAX', label, gain, threshold::DOUBLE, 0, -1, "offset", word FROM best WHERE k <= 3),
features AS (SELECT *, row_number() OVER (ORDER BY type, label, attribute, start, word) - 1 AS fid FROM
  (SELECT *, CASE type WHEN 'RISE' THEN 0 ELSE 1 END AS o FROM few)),
ranked AS (SELECT *, row_number() OVER (ORDER BY infogain DESC, fid) AS rank FROM features)"""
VALUES = f"""{FEATURES},
fv AS (SELECT r.rank, t.split, t.series_id, t.label AS truth, min({L1.replace("q.word", "r.word")})::DOUBLE AS value
    FROM ranked r, (SELECT DISTINCT split, series_id, label, word FROM words) t WHERE r.type = 'SAX' GROUP BY ALL
  UNION ALL SELECT r.rank, v.split, v.series_id, v.label, v.value FROM ranked r JOIN rv v USING (attribute) WHERE r.type = 'RISE'),
ballots AS (SELECT f.rank, f.split, f.series_id, f.truth, r.label,
    CASE WHEN (CASE WHEN r.type = 'RISE' AND r.sign = 1 THEN f.value >= r.threshold ELSE f.value < r.threshold END) THEN r.infogain ELSE -r.infogain END AS vote
  FROM fv f JOIN ranked r USING (rank))"""
PREFIX = f"""{VALUES},
total AS (SELECT count(*) AS total FROM ranked),
ns AS (SELECT 5 * (i + 1) AS n FROM total, range(1000) t(i) WHERE 5 * (i + 1) < total),
cell AS (SELECT n, series_id, truth, l.label, coalesce(sum(vote) FILTER (b.rank <= n AND b.label = l.label), 0) AS score
  FROM ns, (SELECT DISTINCT label FROM ranked) l, ballots b WHERE b.split = 'validate' GROUP BY ALL),
dec AS (SELECT n, series_id, truth, arg_max(label, score) AS guess, round(max(score), 9) AS top, list(round(score, 9)) AS all_scores FROM cell GROUP BY ALL),
acc AS (SELECT n, avg((guess = truth AND len(list_filter(all_scores, lambda v: v = top)) = 1)::INTEGER) AS accuracy FROM dec GROUP BY n),
tops AS (SELECT n FROM acc WHERE round(accuracy, 9) = (SELECT max(round(accuracy, 9)) FROM acc)),
pick AS (SELECT coalesce(max(n) FILTER (n <= 0.2 * (SELECT total FROM total)), min(n)) AS n FROM tops)"""

# Durbin's recursion: a row per order, phi the coefficients of that order.
LEVINSON = f"""{lags(64, 12)}, rl AS (SELECT series_id, list(r ORDER BY lag) AS r FROM acf GROUP BY series_id),
dl AS (SELECT series_id, r, 1 AS k, [r[1]] AS phi FROM rl UNION ALL
  SELECT series_id, r, k + 1, list_concat(list_transform(range(1, k + 1), lambda i: phi[i] - last * phi[k + 1 - i]), [last]) FROM
    (SELECT *, (r[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[k + 1 - i]))) / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * r[i]))) AS last FROM dl WHERE k < 12))"""

SQL = {
    "pacf": f"WITH RECURSIVE {S}, {LEVINSON} SELECT series_id, k::INTEGER AS lag, {r6('phi[k]')} AS v FROM dl",
    "ar_coefs": f"WITH RECURSIVE {S}, {LEVINSON} SELECT series_id, lag::INTEGER AS lag, {r6('phi[lag]')} AS v FROM (SELECT *, unnest(range(1, 13)) AS lag FROM dl WHERE k = 12)",
    "ar_order": f"""WITH RECURSIVE {S}, {LEVINSON}, sc AS (SELECT series_id, k, 64 * sum(ln(1 - phi[k] * phi[k])) OVER (PARTITION BY series_id ORDER BY k) + 2 * k AS score FROM dl),
up AS (SELECT series_id, k, lead(score) OVER (PARTITION BY series_id ORDER BY k) > score AS rises FROM sc)
SELECT series_id, coalesce(min(k) FILTER (rises), 12)::INTEGER AS p FROM up GROUP BY series_id""",
    "series_load_stats": f"WITH {S} SELECT label, count(*) AS n, max(len(x))::INTEGER AS length, {r6('avg(list_avg(x))')} AS mean, {r6(f'avg({sd_pop("x")})')} AS sd_pop FROM s GROUP BY label",
    "znorm_pop": f"WITH {S}, m AS (SELECT *, list_avg(x) AS mu, {sd_pop('x')} AS sd, unnest(range(len(x))) AS pos FROM s) SELECT series_id, pos::INTEGER AS pos, {r6('(x[pos + 1] - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS z FROM m",
    "znorm_sample": f"WITH {S}, m AS (SELECT *, list_avg(x) AS mu, {sd_samp('x')} AS sd, unnest(range(len(x))) AS pos FROM s) SELECT series_id, pos::INTEGER AS pos, {r6('CASE WHEN sd < 0.001 THEN 0 ELSE (x[pos + 1] - mu) / sd END')} AS z FROM m",
    "sliding_window_moments": f'WITH {S}, {win(16)} SELECT series_id, "offset"::INTEGER AS "offset", {r6("list_avg(w)")} AS mean, {r6(sd_pop("w"))} AS sd FROM w',
    "disjoint_windows": f"WITH {S}, {blocks(10)}, m AS (SELECT *, list_avg(w) AS mu, {sd_pop('w')} AS sd, unnest(range(10)) AS pos FROM b) SELECT series_id, block::INTEGER AS block, pos::INTEGER AS pos, {r6('(w[pos + 1] - mu) / CASE WHEN sd = 0 THEN 1 ELSE sd END')} AS z FROM m",
    "paa": f'WITH {S}, {win(16)}, {Z} SELECT series_id, "offset"::INTEGER AS "offset", seg::INTEGER AS seg, {r6("(z[2 * seg + 1] + z[2 * seg + 2]) / 2")} AS v FROM (SELECT *, unnest(range(8)) AS seg FROM z)',
    "paa_fractional": f'WITH {S}, {win(16)}, {Z}, p AS (SELECT series_id, "offset", {overlap(16, 6)} AS p FROM z) SELECT series_id, "offset"::INTEGER AS "offset", seg::INTEGER AS seg, {r6("p[seg + 1]")} AS v FROM (SELECT *, unnest(range(6)) AS seg FROM p)',
    "sax_words": f'WITH {S}, {SAX} SELECT series_id, "offset"::INTEGER AS "offset", word FROM words',
    "sax_bag": f"WITH {S}, {SAX} SELECT series_id, word, count(*) AS n FROM words GROUP BY ALL",
    "sax_first_position": f'WITH {S}, {SAX} SELECT series_id, word, min("offset")::INTEGER AS "offset" FROM words GROUP BY ALL',
    "sax_tfidf": f"WITH {S}, {SAX}, tf AS (SELECT label, word, count(*) AS tf FROM words GROUP BY ALL) SELECT label, word, {r6('ln(1 + tf) * ln((SELECT count(DISTINCT label) FROM tf) / (count(*) OVER (PARTITION BY word))::DOUBLE)')} AS tfidf FROM tf",
    "sax_mindist": f"""WITH {S}, {SAX}, e AS (SELECT series_id, min_by(word, "offset") AS a, max_by(word, "offset") AS b FROM words GROUP BY 1),
g AS (SELECT series_id, ascii(substr(a, i + 1, 1)) - 97 AS p, ascii(substr(b, i + 1, 1)) - 97 AS q FROM (SELECT *, unnest(range(8)) AS i FROM e))
SELECT series_id, {r6('sqrt(sum(CASE WHEN abs(p - q) <= 1 THEN 0 ELSE pow(' + str(CUTS) + '[greatest(p, q)] - ' + str(CUTS) + '[least(p, q) + 1], 2) END) * 2)')} AS d FROM g GROUP BY 1""",
    "ensemble_models": f"WITH {S}, {ENSEMBLE} SELECT param_id, correct FROM best",
    "ensemble_vote": f"""WITH {S}, {ENSEMBLE}, v AS (SELECT series_id, predicted AS label, sum(correct) AS weight, count(*) AS n FROM pr JOIN best USING (param_id) WHERE split = 'test' GROUP BY ALL),
m AS (SELECT series_id, max(struct_pack(weight := weight, label := label)) AS b, sum(n) AS n FROM v GROUP BY 1)
SELECT series_id, b.label AS predicted, b.weight::BIGINT AS weight, n::BIGINT AS n_models FROM m""",
    "acf": f"WITH {S}, {lags(64, 16)} SELECT series_id, lag::INTEGER AS lag, {r6('r')} AS r FROM acf",
    "acf_interval": f"WITH {S}, si AS (SELECT * REPLACE (x[9:40] AS x) FROM s), {lags(32, 8, 'si')} SELECT series_id, lag::INTEGER AS lag, {r6('r')} AS r FROM acf",
    "acf_normalized": f"""WITH {S}, z AS (SELECT series_id, list_transform(x, lambda v: (v - list_avg(x)) / {sd_pop('x')}) AS x FROM s), l AS (SELECT *, unnest(range(1, 17)) AS lag FROM z),
p AS (SELECT series_id, lag, list_sum(list_transform(range(1, 65 - lag), lambda i: x[i] * x[i + lag])) / 64 AS r FROM l)
SELECT series_id, lag::INTEGER AS lag, {r6('CASE WHEN abs(r) <= 1 THEN r ELSE 0 END')} AS r FROM p""",
    "series_scalars": f"WITH {S} SELECT series_id, {r6('list_sum(x)')} AS total, {r6('list_avg(x)')} AS mean, {r6(sd_pop('x'))} AS sd_pop, {r6('list_median(x)')} AS median FROM s",
    "sfa_series_words": f"WITH {S}, {sfa(64)} SELECT series_id, word FROM swords",
    "stratified_sample": f"WITH {S} SELECT series_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY (series_id * 1103515245 + 7) % 2147483648, series_id) AS k FROM s) WHERE k <= 20",
    "power_spectrum": f"""WITH {S}, k AS (SELECT *, unnest(range(33)) AS k FROM s) SELECT series_id, k::INTEGER AS k, {r6('''
  pow(list_sum(list_transform(range(64), lambda j: x[j + 1] * cos(2 * pi() * k * j / 64))), 2) + pow(list_sum(list_transform(range(64), lambda j: x[j + 1] * sin(2 * pi() * k * j / 64))), 2)''')} AS p FROM k""",
    "power_spectrum_packed": f"""WITH {S}, k AS (SELECT *, unnest(range(64)) AS k FROM s) SELECT series_id, k::INTEGER AS k, {r6('''
  pow(list_sum(list_transform(range(32), lambda j: x[2 * j + 1] * cos(2 * pi() * k * j / 64) + x[2 * j + 2] * sin(2 * pi() * k * j / 64))), 2) +
  pow(list_sum(list_transform(range(32), lambda j: x[2 * j + 2] * cos(2 * pi() * k * j / 64) - x[2 * j + 1] * sin(2 * pi() * k * j / 64))), 2)''')} AS p FROM k""",
    "dft_window_coeffs": f'WITH {S}, {win(16)}, f AS ({fourier("w", 16, "series_id, " + chr(34) + "offset" + chr(34))}) SELECT series_id, "offset"::INTEGER AS "offset", k::INTEGER AS coef, {r6("v")} AS v FROM f',
    "tsf_interval_stats": f"""WITH {S}, {blocks(16)}, t AS (SELECT series_id, block, list_avg(w) AS mu, {sq('w')} - list_avg(w) * list_avg(w) AS var,
  list_sum(list_transform(range(16), lambda i: w[i + 1] * (i - 7.5))) / 340 AS slope FROM b)
SELECT series_id, (block * 16)::INTEGER AS start, {r6('mu')} AS mean, {r6('CASE WHEN abs(slope) < 1e-12 THEN 0 ELSE greatest(var, 0) END')} AS var, {r6('CASE WHEN abs(slope) < 1e-12 THEN 0 ELSE slope END')} AS slope FROM t""",
    "sfa_bins_equi_depth": f"WITH {S}, {depth_bins(16)} SELECT coef::INTEGER AS coef, bin, cut FROM (SELECT coef, unnest([0, 1, 2]) AS bin, unnest([b1, b2, b3]) AS cut FROM c3)",
    "sfa_bins_equi_width": f"WITH {S}, {depth_bins(16)}, e AS (SELECT coef, min(value) AS lo, max(value) AS hi, unnest([0, 1, 2]) AS bin FROM hist GROUP BY coef) SELECT coef::INTEGER AS coef, bin, {r6('(hi - lo) / 4 * (bin + 1) + lo')} AS cut FROM e",
    "sax_parameters": f"""WITH {S}, c AS (SELECT series_id, x, len(x) AS n, list_concat([0::DOUBLE], list_transform(range(1, len(x) + 1), lambda i: list_sum(x[1:i]))) AS c,
  list_concat([0::DOUBLE], list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(x[1:i], lambda v: v * v)))) AS q FROM s),
o AS (SELECT *, unnest(range(n - w + 1)) AS o FROM c, range(10, 64) t(w) WHERE w < n),
m AS (SELECT w, o, x, c, (c[o + w + 1] - c[o + 1]) / w AS mu, sqrt(greatest((w * (q[o + w + 1] - q[o + 1]) - pow(c[o + w + 1] - c[o + 1], 2)) / (w * (w - 1)), 0)) AS sd FROM o),
e AS (SELECT w, p, mu, sd, CASE WHEN w <= p THEN x[o + 1 : o + w] ELSE list_transform(range(p + 1), lambda k: c[o + k * w // p + 1] + (k * w % p) / p::DOUBLE * coalesce(x[o + k * w // p + 1], 0)) END AS e
  FROM m, range(6, 20, 2) u(p)),
z AS (SELECT w, p, mu, sd, CASE WHEN w <= p THEN e ELSE list_transform(range(1, p + 1), lambda k: (e[k + 1] - e[k]) * p / w) END AS z FROM e),
words AS (SELECT w, p, {letters("list_transform(z, lambda v: CASE WHEN sd < 0.001 THEN 0 ELSE (v - mu) / sd END)", GAUSS)} AS word FROM z)
SELECT w::INTEGER AS width, p::INTEGER AS length, count(*) AS n_words, count(DISTINCT word) AS n_distinct, min(word) AS first_word, max(word) AS last_word FROM words GROUP BY ALL""",
    "sfa_bins_gain": f"""WITH {S}, tr AS (SELECT * FROM s WHERE split = 'train'), {blocks(16, "tr")},
h0 AS (SELECT k AS coef, 0 AS part, round(v, 2) + 0 AS value, label, count(*) AS n FROM ({fourier("b", 16, "series_id, label")}) GROUP BY ALL),
{gain_level(0)}, {gain_level(1)},
cuts AS (SELECT coef, list_sort(list(cut)) AS c FROM (SELECT coef, cut FROM k0 UNION ALL SELECT coef, cut FROM k1) GROUP BY coef)
SELECT coef::INTEGER AS coef, bin::INTEGER AS bin, coalesce(c[bin + 1], {MAX}) AS cut FROM (SELECT DISTINCT h0.coef, c FROM h0 LEFT JOIN cuts ON h0.coef = cuts.coef), range(3) r(bin)""",
    "sfa_words": f'WITH {S}, {sfa(16)} SELECT series_id, "offset"::INTEGER AS "offset", word FROM swords',
    "sfa_packed": f'WITH {S}, {sfa(16)} SELECT series_id, "offset"::INTEGER AS "offset", code FROM swords',
    "param_grid": f"WITH {S}, z AS (SELECT len(x) AS l, count(*) AS n FROM s GROUP BY 1) SELECT w::INTEGER AS window_len, p::INTEGER AS word_len, sum(n * (l - w + 1))::BIGINT AS n_words FROM z, range(10, 10000) t(w), range(6, 20, 2) u(p) WHERE w < l GROUP BY ALL",
    "class_histogram": f"WITH {S} SELECT split, label, count(*) AS n FROM s GROUP BY ALL",
    "gini": f"WITH {S}, c AS (SELECT split, label, count(*) AS c FROM s GROUP BY ALL) SELECT split, sum(c)::BIGINT AS n, {r6('1 - sum(c * c) / pow(sum(c), 2)')} AS gini FROM c GROUP BY split",
    "weighted_gini": f"WITH {S}, c AS (SELECT split, label, sum(abs(round(x[1], 4)) + 1) AS c FROM s GROUP BY ALL) SELECT split, {r6('sum(c)')} AS n, {r6('1 - sum(c * c) / pow(sum(c), 2)')} AS gini FROM c GROUP BY split",
    "weighted_gini_split": f"WITH {S}, c AS (SELECT split, x[1] >= 0 AS branch, label, count(*) AS c FROM s GROUP BY ALL), g AS (SELECT split, branch, sum(c) AS n, 1 - sum(c * c) / pow(sum(c), 2) AS g FROM c GROUP BY ALL) SELECT split, sum(n)::BIGINT AS n, count(*) AS branches, {r6('sum(n * g) / sum(n)')} AS wgini FROM g GROUP BY split",
    "entropy_ovr": f"WITH {S}, c AS (SELECT label, count(*) AS p, sum(count(*)) OVER () AS n FROM s WHERE split = 'train' GROUP BY label) SELECT label, {r6(entropy('p', 'n'))} AS h FROM c",
    "fixed_threshold_gain": f"""WITH {S}, a AS (SELECT label, attribute, x[attribute + 1] AS v FROM (SELECT *, unnest(range(len(x))) AS attribute FROM s WHERE split = 'train')),
c AS (SELECT attribute, label, count(*) FILTER (v >= 0) AS pf, count(*) AS p FROM a GROUP BY ALL), t AS (SELECT *, sum(pf) OVER w AS nf, sum(p) OVER w AS n FROM c WINDOW w AS (PARTITION BY attribute))
SELECT attribute::INTEGER AS attribute, label, {r6(gain('pf', 'nf', 'p', 'n'))} AS gain, pf AS far, p - pf AS near FROM t""",
    "word_min_distance": f"WITH {QUERY} SELECT label, word, series_id, value::BIGINT AS d FROM d",
    "best_threshold": f"WITH {SCORED} SELECT label, word, {r6('gain')} AS gain, threshold::BIGINT AS threshold FROM scored",
    "side_validity": f"WITH {SCORED} SELECT label, word, valid FROM scored",
    "best_word_per_class": f'WITH {SCORED} SELECT label, word, "offset"::INTEGER AS "offset", {r6("gain")} AS gain, threshold::BIGINT AS threshold FROM best WHERE k = 1',
    "nary_route": f"""WITH {SCORED}, o AS (SELECT d.series_id, best.label, d.value < best.threshold AS inside, best.gain, d.value - best.threshold AS over
  FROM d JOIN best ON best.k = 1 AND d.label = best.label AND d.word = best.word)
SELECT series_id, label AS branch FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY inside DESC, CASE WHEN inside THEN -gain ELSE over END, label) AS k FROM o) WHERE k = 1""",
    "gini_binary_split": f"WITH {S}, {ATTRS['all']}, {GINI} SELECT attribute::INTEGER AS attribute, {r6('threshold')} AS threshold, {r6('wgini')} AS wgini FROM bs",
    "best_candidate": f"WITH {S}, {ATTRS['all']}, {GINI} SELECT 0 AS node_id, attribute::INTEGER AS attribute, {r6('threshold')} AS threshold, {r6('wgini')} AS wgini FROM bs ORDER BY bs.wgini, attribute LIMIT 1",
    "rise_candidate": f"WITH {S}, {RISE} SELECT attribute::INTEGER AS attribute, round(threshold, 7) + 0 AS threshold, label, {r6('gain')} AS gain, sign FROM rise",
    "majority_class": f"WITH {S}, c AS (SELECT split, label, count(*) AS c FROM s GROUP BY ALL) SELECT split, label FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY c DESC, label) AS k FROM c) WHERE k = 1",
    "stratified_folds": f"WITH {S} SELECT series_id, label, ((row_number() OVER (PARTITION BY label ORDER BY (series_id * 1103515245 + 7) % 2147483648, series_id) - 1) % 5)::INTEGER AS fold FROM s",
    "bootstrap": f"""WITH {S}, k AS (SELECT series_id, label, row_number() OVER (PARTITION BY label ORDER BY series_id) - 1 AS k, count(*) OVER (PARTITION BY label) AS n FROM s),
t AS (SELECT label, ((k * 1103515245 + 7) % 2147483648) % n AS k, count(*) AS times FROM k GROUP BY ALL) SELECT series_id, label, times FROM k JOIN t USING (label, k)""",
    "uniform_sample": f"WITH {S} SELECT series_id, label FROM s ORDER BY (series_id * 1103515245 + 7) % 2147483648, series_id LIMIT 100",
    "shuffled_series": f"WITH {S} SELECT series_id, row_number() OVER (ORDER BY (series_id * 1103515245 + 7) % 2147483648, series_id) - 1 AS position FROM s",
    "weighted_bootstrap": f"""WITH {S}, w AS (SELECT series_id, round({WEIGHT} * 1000000)::BIGINT AS w FROM s),
l AS (SELECT series_id, w, (sum(w) OVER (ORDER BY series_id) - w)::BIGINT AS at FROM w WHERE w > 0),
d AS (SELECT floor((k * 1103515245 + 7) % 2147483648 / 2147483648.0::DOUBLE * (SELECT sum(w) FROM l)::DOUBLE)::BIGINT AS at FROM range((SELECT count(*) FROM s)) r(k))
SELECT l.series_id, count(*) AS times FROM d JOIN l ON d.at >= l.at AND d.at < l.at + l.w GROUP BY 1""",
    "boost_round": f"""WITH {S}, {ATTRS['all']}, {GINI}, stump AS (SELECT attribute, threshold FROM bs ORDER BY wgini, attribute LIMIT 1),
two AS (SELECT series_id, label, round(x[attribute + 1], 6) >= threshold AS far, {WEIGHT} AS weight FROM s, stump WHERE split = 'train'),
major AS (SELECT far, label AS predicted FROM (SELECT far, label, row_number() OVER (PARTITION BY far ORDER BY count(*) DESC, label) AS k FROM two GROUP BY far, label) WHERE k = 1),
said AS (SELECT *, predicted <> label AS wrong FROM two JOIN major USING (far)),
e AS (SELECT sum(weight) FILTER (wrong) / sum(weight) AS error, sum(weight) AS total, count(DISTINCT label) AS k, count(*) AS n FROM said),
v AS (SELECT *, CASE WHEN error >= 1 - 1 / k THEN 0 ELSE ln((1 - error) / error) + ln(k - 1) END AS vote FROM e)
SELECT series_id, predicted, {r6('error')} AS error, {r6('vote')} AS vote, {r6('weight * CASE WHEN wrong THEN exp(vote) ELSE 1 END * n / (total * (1 + error * (exp(vote) - 1)))')} AS weight FROM said, v""",
    "sampled_split": f"""WITH {S}, few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY (series_id * 1103515245 + 7) % 2147483648, series_id) AS k FROM s) WHERE k <= 25),
""" + ", ".join(
        f"""b{i} AS (WITH ats AS (SELECT series_id, label, attribute, round(x[attribute + 1], 6) AS value FROM (SELECT *, unnest(range(len(x))) AS attribute FROM few WHERE split = '{name}')), {GINI}
  SELECT '{name}' AS split, attribute, threshold, wgini FROM bs ORDER BY wgini, attribute LIMIT 1)""" for i, name in enumerate(("train", "validate", "test"))
    ) + f""", best AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2),
c AS (SELECT split, attribute, threshold, wgini, round(x[attribute + 1], 6) >= threshold AS far, label, count(*) AS c FROM s JOIN best USING (split) GROUP BY ALL),
q AS (SELECT split, attribute, threshold, wgini, far, sum(c) AS n, sum(c * c) / sum(c)::DOUBLE AS q FROM c GROUP BY ALL)
SELECT split, attribute::INTEGER AS attribute, {r6('threshold')} AS threshold, {r6('wgini')} AS sample_wgini, {r6('sum(n - q) / sum(n)')} AS wgini FROM q GROUP BY split, attribute, threshold, q.wgini""",
    "bag_distance": f"""WITH {S}, {SAX}, bag AS (SELECT series_id, word, count(*) AS n FROM words GROUP BY ALL),
q AS (SELECT * FROM bag WHERE series_id % 20 = 0),
pairs AS (SELECT q.series_id AS query_id, e.series_id AS example_id FROM (SELECT DISTINCT series_id FROM q) q, (SELECT DISTINCT series_id FROM bag) e)
SELECT query_id, example_id, sum(pow(q.n - coalesce(e.n, 0), 2))::BIGINT AS d FROM pairs p JOIN q ON q.series_id = query_id LEFT JOIN bag e ON e.series_id = example_id AND e.word = q.word GROUP BY ALL""",
    "topn_rank": f"WITH {FEATURES} SELECT rank, type, label, {r6('infogain')} AS infogain FROM ranked",
    "vote_scores": f"WITH {VALUES} SELECT series_id, label, {r6('sum(vote)')} AS score FROM ballots WHERE split = 'validate' GROUP BY ALL",
    "prefix_accuracy": f"WITH {PREFIX} SELECT n, {r6('accuracy')} AS accuracy FROM acc",
    "choose_topn": f"WITH {PREFIX} SELECT n, {r6('accuracy')} AS accuracy FROM acc JOIN pick USING (n)",
    "topn_semi_join": f"WITH {PREFIX} SELECT split, rank, series_id, {r6('value')} AS value FROM fv, pick WHERE rank <= n AND split <> 'train'",
    "feature_distance_sax": f"""WITH {S}, {EXEMPLARS}, a AS (WITH {win(16)} SELECT w.* FROM w JOIN ex USING (series_id)), b AS (WITH {win(12)} SELECT w.* FROM w JOIN ex USING (series_id))
SELECT a.label, a."offset"::INTEGER AS f1, b."offset"::INTEGER AS f2, {r6('''sqrt(list_min(list_transform(range(5), lambda o: list_sum(list_transform(range(1, 13), lambda i: pow(b.w[i] - a.w[o + i], 2))))) / 12)''')} AS d
FROM a JOIN b ON a.label = b.label""",
    "feature_distance_sfa": f"""WITH {S}, {EXEMPLARS},
a AS (WITH {sfa(16)} SELECT w.label, w."offset", w.word FROM swords w JOIN ex USING (series_id)),
b AS (WITH {sfa(24)} SELECT w.label, w."offset", w.word FROM swords w JOIN ex USING (series_id))
SELECT q.label, q."offset"::INTEGER AS f1, t."offset"::INTEGER AS f2, {r6(f'({L1}) * ln(1.5)')} AS d FROM a q JOIN b t ON q.label = t.label""",
    "feature_distance_rise": f"WITH {FEATURES} SELECT a.attribute::INTEGER AS f1, b.attribute::INTEGER AS f2, 'ACF_' || a.label AS group_id, abs(a.attribute - b.attribute)::BIGINT AS d FROM features a JOIN features b ON a.label = b.label AND a.fid < b.fid WHERE a.type = 'RISE' AND b.type = 'RISE'",
    "daily_event_series": f"""WITH r AS (SELECT min(ts)::DATE AS lo, datediff('day', min(ts)::DATE, max(ts)::DATE) AS n FROM events), u AS (SELECT DISTINCT user_id FROM events),
e AS (SELECT user_id, datediff('day', lo, ts::DATE) AS day, sum(coalesce(value, 0)) AS v FROM events, r GROUP BY ALL),
d AS (SELECT unnest(range(n + 1)) AS d FROM r)
SELECT u.user_id, d::INTEGER AS day, {r6('coalesce(v, 0)')} AS v FROM u CROSS JOIN d LEFT JOIN e ON e.user_id = u.user_id AND e.day = d""",
    "monthly_revenue_series": """WITH i AS (SELECT l_suppkey, year(l_shipdate) * 12 + month(l_shipdate) AS m, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY ALL),
r AS (SELECT min(m) AS lo, max(m) AS hi FROM i), u AS (SELECT DISTINCT l_suppkey FROM i), t AS (SELECT unnest(range(hi - lo + 1)) AS m, lo FROM r)
SELECT u.l_suppkey, t.m::INTEGER AS month, round(coalesce(v, 0), 4) AS v FROM u CROSS JOIN t LEFT JOIN i ON i.l_suppkey = u.l_suppkey AND i.m = t.m + lo""",
    "streamed_daily_sums": "SELECT user_id, (ts::DATE)::VARCHAR AS day, round(sum(coalesce(value, 0)), 4) AS v, count(*) AS n FROM events GROUP BY ALL",
    "wide_value_rows": f"WITH {VALUES} SELECT fid AS feature_id, count(*)::INTEGER AS n_values, round(sum(value), 4) AS sum FROM fv JOIN ranked USING (rank) WHERE split = 'validate' GROUP BY fid",
}
