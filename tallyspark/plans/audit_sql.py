"""The audit chain as SQL: datasets of both sheets, rules, candidates, pair scores, classes, price items."""

from __future__ import annotations

from .names import _norm, _tokens

_MONEY = "CAST(p_retailprice AS DECIMAL(18,2))"
_FACTOR = "CASE WHEN k % 10 = 0 THEN 1.10::DECIMAL(3,2) WHEN k % 14 = 0 THEN 0.95::DECIMAL(3,2) WHEN k % 202 = 0 THEN 2.20::DECIMAL(3,2) ELSE 1.00::DECIMAL(3,2) END"
_GRADE = "CASE WHEN n = 3 AND j = 1 THEN 0.90::DECIMAL(3,2) WHEN n = 3 AND j = 2 THEN 0.80::DECIMAL(3,2) ELSE 1.00::DECIMAL(3,2) END"

DATA = f"""pt AS (SELECT *, p_partkey AS k, CAST(p_size AS VARCHAR) AS size FROM part),
vraw AS (SELECT *, unnest(CASE WHEN k % 14 = 2 THEN ['W', 'K'] ELSE [''] END) AS part, unnest(CASE WHEN k % 14 = 2 THEN [0, 1] ELSE [0] END) AS j FROM pt WHERE k % 2 = 0 AND k % 50 <> 8),
vnam AS (SELECT *, CASE WHEN k % 14 = 2 THEN p_name || ' ' || p_brand || ' ' || size || 'MM ' || part WHEN k % 22 = 4 THEN replace(p_name, ' ', '/LOOSE ') || ' ' || p_brand || ' ' || size || 'MM'
  WHEN k % 3 = 0 THEN p_name || '-' || p_brand || '-' || size || ' mm' ELSE p_brand || '  ' || p_name || '  ' || size || 'MM' END AS name FROM vraw),
vds AS (SELECT k * 1048576 + j AS row_id, name, {_norm('name')} AS norm, CASE WHEN k % 5 = 0 THEN 'P' || k END AS code, CASE WHEN k % 4 = 0 THEN p_type END AS variant, p_brand AS brand, CASE WHEN k % 6 = 2 THEN p_type || ' ' || p_name END AS descr, CAST(CAST({_MONEY} * {_FACTOR} AS DECIMAL(18,2)) AS DOUBLE) AS price, CAST(k % 60 AS DOUBLE) AS qty FROM vnam),
nv AS MATERIALIZED (SELECT *, {_tokens('norm')} AS tokens FROM vds),
irow AS (SELECT *, unnest(range(n)) AS j FROM (SELECT *, CASE WHEN k % 14 = 2 THEN 2 WHEN k % 10 = 0 THEN 3 ELSE 1 END AS n FROM pt)),
inam AS (SELECT *, upper(p_name || ' ' || p_brand || ' ' || size || 'MM' || CASE WHEN n = 2 AND j = 0 THEN ' W' WHEN n = 2 THEN ' K' ELSE '' END) AS name FROM irow),
ids AS (SELECT (k * 4 + j) * 1048576 AS row_id, name, {_norm('name')} AS norm, CASE WHEN k % 7 <> 0 THEN 'P-' || k END AS code, CASE WHEN k % 3 <> 0 THEN p_type END AS variant, p_brand AS brand, CASE WHEN k % 6 IN (2, 4) THEN p_name || ' ' || p_type END AS descr, CAST(CAST({_MONEY} * {_GRADE} AS DECIMAL(18,2)) AS DOUBLE) AS price,
  CASE WHEN n = 3 AND j = 1 THEN 10.0::DOUBLE WHEN n = 3 AND j = 2 THEN 30.0::DOUBLE END AS qty_min, CASE WHEN n = 3 AND j = 0 THEN 9.0::DOUBLE WHEN n = 3 AND j = 1 THEN 29.0::DOUBLE END AS qty_max, CASE WHEN n = 3 THEN ['<= 9', '10 - 29', '>= 30'][j + 1] END AS qty_label FROM inam),
ni AS MATERIALIZED (SELECT *, {_tokens('norm')} AS tokens FROM ids)"""

IDF = "tk AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM (SELECT tokens FROM nv UNION ALL SELECT tokens FROM ni)) GROUP BY 1), wt0 AS (SELECT token, ln(1 + ((SELECT count(*) FROM nv) + (SELECT count(*) FROM ni)) / CAST(df AS DOUBLE)) AS raw FROM tk), wt AS MATERIALIZED (SELECT token, CAST(round(raw / avg(raw) OVER (), 6) AS DECIMAL(14,6)) AS w FROM wt0)"


def _clean(c: str) -> str:
    return f"regexp_replace(upper({c}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


_KEY = "upper(replace(p_brand || ' ' || p_name || ' ' || size || 'MM', '#', ' '))"
_OURS = "upper(replace(p_name || ' ' || p_brand || ' ' || size || 'MM', '#', ' '))"
RULES = f"""ru AS (SELECT k, {_KEY} AS key, {_OURS} AS ours, 'P' || k AS code FROM pt WHERE k % 2 = 0 AND k % 3 <> 0 AND k % 14 <> 2 AND k % 22 <> 4 AND k % 50 <> 8),
mr AS (SELECT 1 AS general, key AS vk, NULL AS code, 'NO SUCH PRODUCT' AS ik FROM ru WHERE k % 40 = 0 UNION ALL SELECT 0, key, NULL, ours FROM ru WHERE k % 80 = 0
  UNION ALL SELECT 1, 'OLD ' || key, code, ours FROM ru WHERE k % 25 = 0 UNION ALL SELECT 0, 'OLDER ' || key, code, 'NO SUCH PRODUCT' FROM ru WHERE k % 50 = 0),
rk AS (SELECT 'n' || vk AS key, general AS rank, vk, ik FROM mr UNION ALL SELECT 'c' || code, 2 + general, vk, ik FROM mr WHERE code IS NOT NULL),
ask AS (SELECT row_id AS v, 'n' || norm AS key FROM nv UNION ALL SELECT row_id, 'c' || {_clean('code')} FROM nv WHERE code IS NOT NULL),
hit AS MATERIALIZED (SELECT b.v, x.i FROM (SELECT v, ik FROM ask JOIN rk USING (key) QUALIFY row_number() OVER (PARTITION BY v ORDER BY rank, vk, ik) = 1) b JOIN (SELECT norm, max(row_id) AS i FROM ni GROUP BY 1) x ON x.norm = b.ik)"""

READ = f"""rn AS (SELECT *, unnest(CASE WHEN contains(name, '/LOOSE ') THEN [name, replace(name, '/LOOSE ', ' '), regexp_replace(name, '^[a-z]+/LOOSE', 'LOOSE')] ELSE [name] END) AS read, unnest(CASE WHEN contains(name, '/LOOSE ') THEN [0, 1, 2] ELSE [0] END) AS reading FROM nv WHERE row_id NOT IN (SELECT v FROM hit)),
rd AS MATERIALIZED (SELECT * EXCLUDE (norm, tokens), {_norm('read')} AS norm, {_tokens(_norm('read'))} AS tokens FROM rn),
cp AS (SELECT v, i, sum(w) AS weight FROM (SELECT row_id AS v, unnest(list_distinct(tokens)) AS token FROM rd) JOIN (SELECT row_id AS i, unnest(list_distinct(tokens)) AS token FROM ni) USING (token) JOIN wt USING (token) GROUP BY 1, 2),
cd AS MATERIALIZED (SELECT v, i, place FROM (SELECT v, i, CAST(row_number() OVER (PARTITION BY v ORDER BY weight DESC, i) AS INTEGER) AS place FROM cp) WHERE place <= 60)"""


def _grams(n: str) -> str:
    return f"list_transform(range(1, length({n})), lambda i: substr({n}, i, 2) || CAST(len(list_filter(range(1, i + 1), lambda j: substr({n}, j, 2) = substr({n}, i, 2))) AS VARCHAR))"


def _class(t: str) -> str:
    return f"CASE WHEN regexp_matches({t}, '^\\d+([.,]\\d+)?$') THEN 'numeric' WHEN regexp_matches({t}, '^\\d+([.,]\\d+)?[\\p{{L}}%]+$') THEN 'measure' WHEN regexp_matches({t}, '\\d') AND regexp_matches({t}, '\\p{{L}}') THEN 'code' ELSE 'word' END"


def _dice(n: str) -> str:
    a, b = f"a.{n}", f"b.{n}"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN len({a}_g) = 0 OR len({b}_g) = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}_g, {b}_g)) / (len({a}_g) + len({b}_g)) END"


def _lev(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def _fold(tokens: str, weighed: str, other: str) -> str:
    """The greedy token match as a fold over the first list; the state carries what is still free."""
    best = f"list_max(list_transform(list_filter(range(1, len(s.free) + 1), lambda k: length(x.t) >= 4 AND abs(length(s.free[k]) - length(x.t)) <= 2), lambda k: {{'r': {_lev('x.t', 's.free[k]')}, 'k': -k}}))"
    step = f"list_transform([{best}], lambda m: CASE WHEN list_contains(s.free, x.t) THEN {{'t': x.t, 'w': 0.0::DOUBLE, 'got': s.got + x.w, 'free': list_filter(s.free, lambda u: u <> x.t)}} WHEN m.r >= 0.8 THEN {{'t': x.t, 'w': 0.0::DOUBLE, 'got': s.got + x.w * m.r * 0.9::DOUBLE, 'free': list_filter(s.free, lambda u: u <> s.free[-m.k])}} ELSE s END)[1]"
    items = f"list_transform(range(1, len({tokens}) + 1), lambda i: {{'t': {tokens}[i], 'w': {weighed}[i], 'got': 0.0::DOUBLE, 'free': []::VARCHAR[]}})"
    return f"list_reduce({items}, lambda s, x: {step}, {{'t': '', 'w': 0.0::DOUBLE, 'got': 0.0::DOUBLE, 'free': list_filter({other}, lambda u, n: list_position({other}, u) = n)}}).got"


def _sum(c: str) -> str:
    return f"list_reduce({c}, lambda p, q: p + q)"


def _token_score(t: str, w: str) -> str:
    a, b, p, q = f"a.{t}", f"b.{t}", f"a.{w}", f"b.{w}"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {_fold(a, p, b)} / (({_sum(p)} + {_sum(q)}) / 2)) END"


def _features(name: str, source: str) -> str:
    """Per row and reading what scores need."""
    words = _tokens(f"upper(trim(regexp_replace(regexp_replace(descr, '[^\\p{{L}}\\p{{N}}\\s.,+%]', ' ', 'g'), '\\s{{2,}}', ' ', 'g')))")
    weigh = "list(coalesce(CAST(w AS DOUBLE), 1.0::DOUBLE) * (1 + least(length(t), 10)::DOUBLE / 10) ORDER BY p)"
    listed = lambda c: f"(SELECT row_id, reading, {weigh} AS ws FROM (SELECT row_id, reading, unnest({c}) AS t, unnest(range(len({c}))) AS p FROM {name}0) LEFT JOIN wt ON token = t GROUP BY 1, 2)"
    return f"""{name}0 AS MATERIALIZED (SELECT *, regexp_replace(norm, '\\s+', '', 'g') AS squeezed, CASE WHEN descr IS NOT NULL THEN {words} END AS words, list_filter(tokens, lambda t: {_class('t')} <> 'word' OR length(t) <= 3) AS telling, {_clean('code')} AS ccode, list_filter(list_transform(tokens, lambda t: {_clean('t')}), lambda t: t <> '') AS cwords, len(list_filter(tokens, lambda t: {_class('t')} <> 'word')) AS n_marks, list_filter(tokens, lambda t: {_class('t')} IN ('code', 'measure')) AS marks, upper(trim(variant)) AS uvariant, upper(trim(brand)) AS ubrand FROM {source}),
{name} AS MATERIALIZED (SELECT f.*, {_grams('norm')} AS norm_g, {_grams('uvariant')} AS uvariant_g, {_grams('ubrand')} AS ubrand_g, x.ws AS weighed, y.ws AS words_weighed FROM {name}0 f LEFT JOIN {listed('tokens')} x USING (row_id, reading) LEFT JOIN {listed('words')} y USING (row_id, reading))"""


_OTHER, _OWN = "CASE WHEN a.ccode IS NOT NULL THEN b.cwords ELSE a.cwords END", "coalesce(a.ccode, b.ccode)"
_FOUND = f"CASE WHEN {_OWN} <> '' AND contains(array_to_string({_OTHER}, ''), {_OWN}) THEN 1.0::DOUBLE ELSE coalesce(list_max(list_transform({_OTHER}, lambda x: {_lev('x', _OWN)})), 0.0::DOUBLE) END"
_BOTH = "a.ccode IS NOT NULL AND b.ccode IS NOT NULL"
SCORES = f"""{_features('fa', 'rd')}, {_features('fb', '(SELECT *, 0 AS reading FROM ni)')},
sg AS (SELECT v, i, place, a.reading, {_dice('norm')} * 0.5 + {_lev('a.norm', 'b.norm')} * 0.5 AS s_name, CASE WHEN a.squeezed <> '' AND b.squeezed <> '' THEN {_lev('a.squeezed', 'b.squeezed')} END AS s_compact, {_token_score('tokens', 'weighed')} AS s_tokens,
  {_BOTH} AS both_codes, a.ccode = b.ccode AND a.ccode <> '' AS same_code, CASE WHEN {_BOTH} THEN {_lev('a.ccode', 'b.ccode')} END AS code_lev, CASE WHEN {_OWN} IS NOT NULL AND NOT ({_BOTH}) THEN {_FOUND} END AS found, a.n_marks > 0 AND b.n_marks > 0 AS marked, len(list_filter(b.tokens, lambda t: list_contains(a.marks, t)))::DOUBLE / greatest(least(a.n_marks, b.n_marks), 1) AS mark_share,
  CASE WHEN a.uvariant IS NOT NULL AND b.uvariant IS NOT NULL THEN {_dice('uvariant')} END AS s_variant, CASE WHEN a.ubrand IS NOT NULL AND b.ubrand IS NOT NULL THEN {_dice('ubrand')} END AS s_brand,
  CASE WHEN a.words IS NOT NULL AND b.words IS NOT NULL THEN {_token_score('words', 'words_weighed')} * 0.8 END AS s_description,
  CASE WHEN len(a.telling) > 0 AND len(b.telling) > 0 THEN (1 - len(list_filter(a.telling, lambda t: list_contains(b.telling, t)))::DOUBLE / greatest(least(len(a.telling), len(b.telling)), 1)) * 0.35 ELSE 0.0 END AS penalty
  FROM cd JOIN fa a ON a.row_id = v JOIN fb b ON b.row_id = i),
sc AS (SELECT *, CASE WHEN both_codes THEN CASE WHEN same_code THEN 1.0 WHEN code_lev >= 0.85 THEN 0.7 ELSE 0.0 END WHEN found >= 0.85 THEN found WHEN marked THEN mark_share ELSE 0.0 END::DOUBLE AS c_score,
  CASE WHEN both_codes THEN CASE WHEN same_code THEN 4.0 WHEN code_lev >= 0.85 THEN 2.0 ELSE 0.0 END WHEN found >= 0.999 THEN 3.5 WHEN found >= 0.85 THEN 1.8 WHEN marked THEN 1.5 ELSE 0.0 END::DOUBLE AS c_weight FROM sg),
ss AS (SELECT *, CASE WHEN c_weight > 0 THEN c_score END AS s_code,
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, (s_name * 1.5::DOUBLE + coalesce(s_compact, 0) + s_tokens * 2.5::DOUBLE + CASE WHEN c_weight > 0 THEN c_score * c_weight ELSE 0.0 END + coalesce(s_variant, 0) + coalesce(s_brand * 0.75::DOUBLE, 0) + coalesce(s_description * 0.5::DOUBLE, 0))
  / (1.5::DOUBLE + CASE WHEN s_compact IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END + 2.5::DOUBLE + c_weight + CASE WHEN s_variant IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END + CASE WHEN s_brand IS NULL THEN 0.0::DOUBLE ELSE 0.75::DOUBLE END + CASE WHEN s_description IS NULL THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) - penalty)) AS score FROM sc),
pr AS MATERIALIZED (SELECT * FROM ss QUALIFY row_number() OVER (PARTITION BY v, i ORDER BY score DESC, reading) = 1)"""


def _otsu(counts: str, fallback: str) -> str:
    """Threshold of (bin, n)."""
    c = f"SELECT bin, CAST(sum(n) OVER w AS DOUBLE) AS wb, CAST(sum(bin * n) OVER w AS DOUBLE) AS sb, CAST(sum(n) OVER () AS DOUBLE) AS al, CAST(sum(bin * n) OVER () AS DOUBLE) AS su FROM {counts} WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    best = f"(SELECT (bin + 1)::DOUBLE / 40 FROM ({c}) WHERE al > wb ORDER BY wb * (al - wb) * (sb / wb - (su - sb) / (al - wb)) * (sb / wb - (su - sb) / (al - wb)) DESC, bin LIMIT 1)"
    return f"CASE WHEN coalesce((SELECT sum(n) FROM {counts}), 0) < 4 THEN {fallback} ELSE coalesce({best}, ({fallback} * 40 + 1) / 40) END"


RESULTS = f"""bs AS (SELECT v, i, score, row_number() OVER (PARTITION BY v ORDER BY score DESC, place) AS rn, row_number() OVER (PARTITION BY v ORDER BY round(score, 4) DESC, place) AS sn, s_name, s_code FROM pr),
bt AS (SELECT v, max(i) FILTER (rn = 1) AS i, max(score) FILTER (rn = 1) AS score, max(score) FILTER (rn = 1) - coalesce(max(score) FILTER (rn = 2), 0) AS margin, list({{'i': i, 'score': round(score, 4)}} ORDER BY sn) FILTER (sn <= 5) AS candidates FROM bs GROUP BY 1),
be AS MATERIALIZED (SELECT r.row_id AS v, bt.i, coalesce(bt.score, 0.0) AS score, coalesce(bt.margin, 0.0) AS margin, coalesce(bt.candidates, []) AS candidates FROM rd r LEFT JOIN bt ON bt.v = r.row_id WHERE reading = 0),
hs AS (SELECT greatest(0, least(39, CAST(floor(score * 40) AS INTEGER))) AS bin, count(*) AS n FROM be GROUP BY 1),
hi AS (SELECT greatest({_otsu('hs', '0.65::DOUBLE')}, 0.4::DOUBLE) AS high),
lo AS (SELECT * FROM hs WHERE bin < (SELECT round(high * 40) FROM hi)),
li AS MATERIALIZED (SELECT high, least(greatest({_otsu('lo', 'high * 0.5::DOUBLE')}, 0.15::DOUBLE), high * 0.85::DOUBLE) AS low, (SELECT coalesce(CAST(sum(CAST(round(margin, 12) AS DECIMAL(20,12))) AS DOUBLE) / count(*), 0.1::DOUBLE) FROM be WHERE margin > 0) AS mean FROM hi),
cl AS (SELECT be.*, CASE WHEN score >= high AND margin >= mean * 0.5::DOUBLE THEN 'MATCHED' WHEN score >= high THEN 'NEED_REVIEW' WHEN score >= low AND margin < mean * 0.35::DOUBLE THEN 'NEED_REVIEW' WHEN score >= low THEN 'PARTIAL' ELSE 'UNMATCHED' END AS status,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, score * (0.6::DOUBLE + 0.4::DOUBLE * least(1.0::DOUBLE, margin / greatest(mean, 0.001::DOUBLE))))), 4) AS confidence, 'ENGINE' AS source FROM be, li),
rs AS MATERIALIZED (SELECT v, CASE WHEN status <> 'UNMATCHED' THEN i END AS i, score, margin, candidates, status, confidence, source FROM cl UNION ALL SELECT v, i, 1.0, 1.0, [{{'i': i, 'score': 1.0::DOUBLE}}], 'MATCHED', 1.0, 'MASTER' FROM hit)"""

RUN = ", ".join((DATA, IDF, RULES, READ, SCORES, RESULTS))

ITEMS = f"""{RUN}, ac AS (SELECT v, i FROM rs WHERE status IN ('MATCHED', 'PARTIAL', 'MANUAL') AND i IS NOT NULL),
sib AS (SELECT nv.row_id AS v, g.price, g.qty_label FROM nv JOIN ac ON ac.v = nv.row_id JOIN ni ON ni.row_id = ac.i JOIN ni g ON g.norm = ni.norm AND (g.qty_min IS NOT NULL OR g.qty_max IS NOT NULL) AND (g.qty_min IS NULL OR nv.qty >= g.qty_min) AND (g.qty_max IS NULL OR nv.qty <= g.qty_max) QUALIFY row_number() OVER (PARTITION BY nv.row_id ORDER BY g.row_id) = 1),
le AS (SELECT nv.row_id AS v, ac.i, nv.name AS vendor_label, nv.price AS vp, CASE WHEN sib.v IS NOT NULL THEN sib.price ELSE ni.price END AS ip, ni.norm, CASE WHEN ac.i IS NULL THEN '' ELSE ni.name || coalesce(' (' || CASE WHEN sib.v IS NOT NULL THEN sib.qty_label ELSE ni.qty_label END || ')', '') END AS internal_label FROM nv LEFT JOIN ac ON ac.v = nv.row_id LEFT JOIN ni ON ni.row_id = ac.i LEFT JOIN sib ON sib.v = nv.row_id),
it AS MATERIALIZED (SELECT v, i, vendor_label, internal_label, vp AS vendor_price, ip AS internal_price, round(vp - ip, 2) AS diff, round((vp - ip) / nullif(ip, 0) * 100, 2) AS diff_pct, CASE WHEN i IS NULL THEN 'NOT_IN_INTERNAL' WHEN vp IS NULL OR ip IS NULL THEN 'MISSING' WHEN vp = ip THEN 'SAME' WHEN vp > ip THEN 'HIGHER' ELSE 'LOWER' END AS status FROM le
  UNION ALL SELECT NULL, row_id, '', name || coalesce(' (' || qty_label || ')', ''), NULL, price, NULL, NULL, 'NOT_IN_VENDOR' FROM ni WHERE norm NOT IN (SELECT norm FROM le WHERE norm IS NOT NULL))"""
