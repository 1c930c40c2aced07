"""SQL of queries whose statement is long: regressions, model scores, clause packing, whole-Unicode cleaning."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from ledgerlark.plans.base import FILINGS, PANEL

WS = "[ \\t\\n\\r\\f\\v]+"


def p_value(t: str, nu: str) -> str:
    """Two-sided p of Student's t for whole degrees of freedom, as the finite series in the angle atan(t / sqrt(nu))."""
    th, c2 = f"atan(abs({t}) / sqrt({nu}))", f"({nu} / ({nu} + ({t}) * ({t})))"
    even = f"sin({th}) * list_sum(list_transform(range(0, {nu} // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow({c2}, j)))"
    odd = f"2 / pi() * ({th} + sin({th}) * cos({th}) * coalesce(list_sum(list_transform(range(0, ({nu} - 1) // 2), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow({c2}, j))), 0))"
    return f"greatest(0.0, 1 - CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END)"


#: 0.975 quantile of Student's t by its expansion around the normal quantile; good to ten digits for 100 degrees and more.
_Z = 1.959963984540054
_T975 = f"({_Z} + ({_Z**3 + _Z}) / (4.0 * nu) + ({5 * _Z**5 + 16 * _Z**3 + 3 * _Z}) / (96.0 * nu * nu) + ({3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z}) / (384.0 * nu * nu * nu) + ({79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z}) / (92160.0 * nu * nu * nu * nu))"
_STARS = "CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.1 THEN '*' ELSE '' END"
_INVERSE = """aa * (bb * cc - bc * bc) - ab * (ab * cc - bc * ac) + ac * (ab * bc - bb * ac) AS det"""
_G = "(bb * cc - bc * bc) / det AS g11, (ac * bc - ab * cc) / det AS g12, (ab * bc - ac * bb) / det AS g13, (aa * cc - ac * ac) / det AS g22, (ab * ac - aa * bc) / det AS g23, (aa * bb - ab * ab) / det AS g33"
_SUMS = "sum(a * a) AS aa, sum(a * b) AS ab, sum(a * c) AS ac, sum(b * b) AS bb, sum(b * c) AS bc, sum(c * c) AS cc, sum(a * y) AS ay, sum(b * y) AS by_, sum(c * y) AS cy"
_BETA = "g11 * ay + g12 * by_ + g13 * cy AS b1, g12 * ay + g22 * by_ + g23 * cy AS b2, g13 * ay + g23 * by_ + g33 * cy AS b3"


def ols(outcome: str, x: tuple[str, str, str], lags: int = 5) -> str:
    """Least squares with quarter dummies by deviations from the quarters' means; every coefficient is a weighted sum of y,
    whose weights times residuals give its HAC error."""
    a, b, c = x
    lag = ", ".join(f"lag(e, {k}) OVER (PARTITION BY term ORDER BY i) AS e{k}" for k in range(1, lags + 1))
    hac = " + ".join(f"2.0 * (1 - {k} / {lags + 1}.0) * coalesce(sum(e * e{k}), 0)" for k in range(1, lags + 1))
    return f"""WITH {PANEL}, c0 AS (SELECT {outcome} AS y, {a} AS a, {b} AS b, {c} AS c, filing_quarter AS q,
  row_number() OVER (ORDER BY ticker ASC NULLS LAST, filing_type ASC NULLS LAST, filing_date ASC NULLS LAST, panel_id ASC NULLS LAST) AS i
  FROM v WHERE {outcome} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL),
m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, stddev_samp(a) + 1e-12 AS sa, stddev_samp(b) + 1e-12 AS sb, stddev_samp(c) + 1e-12 AS sc, min(q) AS q0 FROM c0),
z AS (SELECT i, y, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c, CASE WHEN q IS NULL OR q = q0 THEN '' ELSE 'q_' || q END AS g FROM c0, m),
gm AS (SELECT g, count(*) AS ng, avg(y) AS my, avg(a) AS xa, avg(b) AS xb, avg(c) AS xc FROM z GROUP BY g), g0 AS (SELECT * FROM gm WHERE g = ''),
d AS (SELECT i, g, y - my AS y, a - xa AS a, b - xb AS b, c - xc AS c FROM z JOIN gm USING (g)),
s AS (SELECT *, {_INVERSE} FROM (SELECT {_SUMS} FROM d)), h AS (SELECT *, {_G} FROM s), k AS (SELECT *, {_BETA} FROM h),
u AS (SELECT i, g, g11 * a + g12 * b + g13 * c AS w1, g12 * a + g22 * b + g23 * c AS w2, g13 * a + g23 * b + g33 * c AS w3, y - b1 * a - b2 * b - b3 * c AS u FROM d, k),
u0 AS (SELECT u.*, CASE WHEN u.g = '' THEN 1.0 / ng ELSE 0.0 END - (xa * w1 + xb * w2 + xc * w3) AS w0 FROM u, g0),
w AS (SELECT i, '{a}' AS term, w1 * u AS e FROM u UNION ALL SELECT i, '{b}', w2 * u FROM u UNION ALL SELECT i, '{c}', w3 * u FROM u UNION ALL SELECT i, 'const', w0 * u FROM u0
  UNION ALL SELECT i, gm.g, (CASE WHEN u0.g = gm.g THEN 1.0 / gm.ng ELSE 0.0 END - (gm.xa * w1 + gm.xb * w2 + gm.xc * w3) - w0) * u FROM u0, gm WHERE gm.g <> ''),
l AS (SELECT term, e, {lag} FROM w), se AS (SELECT term, sqrt(sum(e * e) + {hac}) AS se FROM l GROUP BY term),
co AS (SELECT '{a}' AS term, b1 AS coef FROM k UNION ALL SELECT '{b}', b2 FROM k UNION ALL SELECT '{c}', b3 FROM k
  UNION ALL SELECT 'const', my - b1 * xa - b2 * xb - b3 * xc FROM g0, k
  UNION ALL SELECT gm.g, gm.my - b1 * gm.xa - b2 * gm.xb - b3 * gm.xc - (g0.my - b1 * g0.xa - b2 * g0.xb - b3 * g0.xc) FROM gm, g0, k WHERE gm.g <> ''),
r AS (SELECT term, coef, se, coef / se AS t, (SELECT count(*) FROM z) - 3 - (SELECT count(*) FROM gm) AS nu FROM co JOIN se USING (term)),
f AS (SELECT term, coef, se, t, {p_value('t', 'nu')} AS p, {_T975} * se AS half FROM r)
SELECT term, round(coef + 0.0, 6) AS coef, round(se, 6) AS std_err, round(t + 0.0, 6) AS t, round(p, 6) AS p, round(coef - half + 0.0, 6) AS ci_low, round(coef + half + 0.0, 6) AS ci_high"""


def ols_all(outcome: str, x: tuple[str, str, str]) -> str:
    return ols(outcome, x) + " FROM f"


def ols_top(outcome: str, x: tuple[str, str, str], n: int = 15) -> str:
    return ols(outcome, x) + f", {_STARS} AS stars FROM f WHERE term <> 'const' AND term NOT LIKE 'q!_%' ESCAPE '!' ORDER BY abs(coef) DESC, term LIMIT {n}"


def fama_macbeth(outcome: str, x: tuple[str, str, str], lags: int = 5, least: int = 10) -> str:
    a, b, c = x
    sd = lambda v: f"CASE WHEN stddev_pop({v}) < 1e-12 THEN 1.0 ELSE stddev_pop({v}) END"
    lag = ", ".join(f"lag(u, {k}) OVER (PARTITION BY variable ORDER BY period) AS u{k}" for k in range(1, lags + 1))
    hac = " + ".join(f"2.0 * (1 - {k} / {lags + 1}.0) * coalesce(sum(u * u{k}), 0)" for k in range(1, lags + 1))
    return f"""WITH {PANEL}, c0 AS (SELECT {outcome} AS y, {a} AS a, {b} AS b, {c} AS c, filing_quarter AS period FROM v
  WHERE {outcome} IS NOT NULL AND {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL AND filing_quarter IS NOT NULL),
m AS (SELECT period, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, {sd('a')} AS sa, {sd('b')} AS sb, {sd('c')} AS sc FROM c0 GROUP BY period HAVING count(*) >= {least}),
z AS (SELECT period, y - my AS y, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c FROM c0 JOIN m USING (period)),
s AS (SELECT *, {_INVERSE} FROM (SELECT period, {_SUMS} FROM z GROUP BY period)), h AS (SELECT *, {_G} FROM s), k AS (SELECT period, {_BETA} FROM h),
sl AS (SELECT period, '{a}' AS variable, b1 AS s FROM k UNION ALL SELECT period, '{b}', b2 FROM k UNION ALL SELECT period, '{c}', b3 FROM k),
u AS (SELECT *, s - avg(s) OVER (PARTITION BY variable) AS u FROM sl), l AS (SELECT *, {lag} FROM u),
nw AS (SELECT variable, count(*) AS n, avg(s) AS mean, stddev_samp(s) AS sd, avg(s) / (sqrt(sum(u * u) + {hac}) / count(*)) AS t, count(*) - 1 AS nu FROM l GROUP BY variable)
SELECT variable, round(mean, 6) AS mean_coef, round(sd, 6) AS std_coef, round(t, 4) AS t_stat, round({p_value('t', 'nu')}, 4) AS p_value, n AS n_periods FROM nw"""


def event_table(c: str, spread: str, newey_west: str) -> str:
    """Means by tercile in per cent, with the stars of the spread's test; c, spread, newey_west: CTEs of the panel's queries."""
    return f"""WITH {PANEL}, {spread}, {newey_west}, e0 AS (SELECT quantile_cont(s, 1/3.0) AS e1, quantile_cont(s, 2/3.0) AS e2 FROM c),
g AS (SELECT CASE WHEN s <= e1 THEN 'Q1 (low)' WHEN s <= e2 THEN 'Q2' ELSE 'Q3 (high)' END AS label, r FROM c, e0), t AS (SELECT mean / se AS t, n - 1 AS nu FROM nw), p AS (SELECT {p_value('t', 'nu')} AS p FROM t)
SELECT label, round(avg(r) * 100 + 0.0, 6) AS mean_pct, count(*) AS n, (SELECT {_STARS} FROM p) AS stars FROM g GROUP BY label"""


def _scored(key: str, sentences: str, positive: str, negative: str) -> str:
    """CTE <key>: the aggregates of a text column's sentences of three words at least, labelled by two word lists."""
    hits = lambda words: f"len(list_filter(w, lambda x: list_contains({words}, x)))"
    return f"""{key}_s AS (SELECT filing_id, unnest({sentences}) AS s FROM f),
{key}_w AS (SELECT filing_id, list_transform(list_filter(regexp_split_to_array(lower(s), '[\\s\\v\\x1c-\\x1f\\x85\\p{{Z}}]+'), lambda x: x <> ''), lambda x: trim(x, '.,;:!?')) AS w FROM {key}_s
  WHERE len(list_filter(regexp_split_to_array(s, '{WS}'), lambda x: x <> '')) >= 3),
{key}_k AS (SELECT {positive} AS kp, {negative} AS kn), {key}_n AS (SELECT filing_id, {hits('kp')} AS p, {hits('kn')} AS n FROM {key}_w, {key}_k),
{key}_l AS (SELECT filing_id, (p > n)::INT AS up, (n > p)::INT AS down, round(0.5 + 0.5 * abs(p - n) / greatest(1, p + n), 6) AS score FROM {key}_n),
{key} AS (SELECT filing_id, avg(up) AS positive_pct, avg(down) AS negative_pct, 1.0 - avg(up) - avg(down) AS neutral_pct, round(avg((up - down) * score), 6) AS avg_score, avg(up) - avg(down) AS net_sentiment, count(*) AS n_sentences FROM {key}_l GROUP BY filing_id)"""


def model_score(sentences: str) -> str:
    words = lambda k: f"(SELECT list(DISTINCT lower(word)) FROM lexicon WHERE lower(category) = '{k}' AND word IS NOT NULL)"
    cols = ", ".join(f"round(coalesce(a.{c}, 0) + 0.0, 6) AS {c}" for c in ("positive_pct", "negative_pct", "neutral_pct", "avg_score", "net_sentiment"))
    return f"WITH {FILINGS}, {_scored('a', sentences, words('positive'), words('negative'))} SELECT f.filing_id, {cols}, coalesce(n_sentences, 0) AS n_sentences FROM f LEFT JOIN a USING (filing_id)"


def panel_model(sentences_1a: str, sentences_mda: str, positive: tuple[str, ...], negative: tuple[str, ...]) -> str:
    up, down = (str(list(x)) for x in (positive, negative))
    return f"""WITH {FILINGS}, {_scored('a', sentences_1a, up, down)}, {_scored('m', sentences_mda, up, down)},
j AS (SELECT filing_id, ticker, filing_type, filing_date, coalesce(a.net_sentiment, 0) AS x, coalesce(m.net_sentiment, 0) AS y, coalesce(m.n_sentences, 0) AS n
  FROM f LEFT JOIN a USING (filing_id) LEFT JOIN m USING (filing_id) WHERE length(coalesce(item_1a_text, '')) > 50 OR length(coalesce(mda_text, '')) > 50)
SELECT filing_id, round(x + 0.0, 8) AS fb_1a_finbert_net_sentiment, round(y + 0.0, 8) AS fb_mda_finbert_net_sentiment, n AS fb_mda_finbert_n_sentences,
  round(y - lag(y) OVER (PARTITION BY ticker, filing_type ORDER BY filing_date ASC NULLS LAST, filing_id) + 0.0, 8) AS delta_fb_mda_finbert_net_sentiment FROM j"""


def pack_clauses(sentences: str, most: int) -> str:
    """Clauses of a long sentence joined one after the other while they fit, by recursion over their numbers."""
    n = lambda x: f"len(list_filter(regexp_split_to_array({x}, '{WS}'), lambda y: y <> ''))"
    strip = lambda x: f"regexp_replace({x}, '^{WS}|{WS}$', '', 'g')"
    return f"""WITH RECURSIVE {FILINGS}, s0 AS (SELECT filing_id, {sentences} AS l FROM f), s1 AS (SELECT filing_id, unnest(range(1, len(l) + 1)) AS si, l FROM s0),
s AS (SELECT filing_id, si, {strip('l[si]')} AS s FROM s1 WHERE {n('l[si]')} >= 3),
cl AS (SELECT filing_id, si, list_filter(list_transform(regexp_split_to_array(s, '[;,][ \\t\\n\\r\\f\\v]*'), lambda x: {strip('x')}), lambda x: x <> '') AS c FROM s WHERE {n('s')} > {most}),
r AS (SELECT filing_id, si, c, 1 AS ci, c[1] AS cur, 0 AS grp FROM cl WHERE len(c) > 0 UNION ALL
  SELECT filing_id, si, c, ci + 1, CASE WHEN {n('cur')} + {n('c[ci + 1]')} <= {most} THEN cur || ' ' || c[ci + 1] ELSE c[ci + 1] END, CASE WHEN {n('cur')} + {n('c[ci + 1]')} <= {most} THEN grp ELSE grp + 1 END FROM r WHERE ci < len(c)),
o AS (SELECT filing_id, si, 0 AS grp, s AS part FROM s WHERE {n('s')} <= {most} UNION ALL SELECT filing_id, si, grp, arg_max(cur, ci) FROM r GROUP BY filing_id, si, grp
  UNION ALL SELECT s.filing_id, s.si, 0, substring(s.s, 1, 512) FROM s JOIN cl ON s.filing_id = cl.filing_id AND s.si = cl.si WHERE len(c) = 0)
SELECT filing_id, (row_number() OVER (PARTITION BY filing_id ORDER BY si, grp) - 1)::INT AS pos, part FROM o"""


@lru_cache(1)
def _ascii_rows() -> str:
    """('character', 'its ASCII letters after full decomposition') of every character that leaves any."""
    rows = []
    for i in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        a = unicodedata.normalize("NFKD", chr(i)).encode("ascii", "ignore").decode()
        if a:
            rows.append("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in (chr(i), a))))
    return ", ".join(rows)


def clean_text_exact(column: str) -> str:
    return f"""WITH {FILINGS}, t AS (SELECT filing_id, regexp_replace(coalesce({column}, ''), '<[^>]+>', ' ', 'g') AS t FROM f), k(c, a) AS (VALUES {_ascii_rows()}),
x AS (SELECT filing_id, i, substring(t, i, 1) AS c FROM (SELECT filing_id, t, unnest(range(1, length(t) + 1)) AS i FROM t)),
y AS (SELECT filing_id, string_agg(CASE WHEN ascii(c) < 128 THEN c ELSE coalesce(a, '') END, '' ORDER BY i) AS t FROM x LEFT JOIN k USING (c) GROUP BY filing_id),
z AS (SELECT filing_id, trim(regexp_replace(regexp_replace(lower(coalesce(y.t, '')), '[^a-z \\t\\n\\r\\f\\v.,]', ' ', 'g'), '{WS}', ' ', 'g')) AS c FROM f LEFT JOIN y USING (filing_id))
SELECT filing_id, length(c)::BIGINT AS chars, md5(c) AS digest FROM z"""


#: Lines of a text as the parser's output is cut: at any line break, without any blanks around, empty ones left out.
LINES = "list_filter(list_transform(regexp_split_to_array({c}, '\\r\\n|[\\n\\r\\v\\f\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]'), lambda x: regexp_replace(x, '^[\\s\\v\\x1c-\\x1f\\x85\\p{{Z}}]+|[\\s\\v\\x1c-\\x1f\\x85\\p{{Z}}]+$', '', 'g')), lambda x: x <> '')"


def html_text(column: str, before: list[str], after: list[str]) -> str:
    lines = LINES.format(c=f"coalesce({column}, '')")
    return f"""WITH {FILINGS}, t AS (SELECT filing_id, array_to_string({before} || {lines} || {after}, chr(10)) AS t FROM f)
SELECT filing_id, length(t)::BIGINT AS chars, md5(t) AS digest FROM t"""


def parse_filings(is_table: str) -> str:
    """Both sections of each document again: lines of the text parts, without table lines, and their counts."""
    keep = lambda x: f"array_to_string(list_filter({x}, lambda x: NOT {is_table}), chr(10))"
    return f"""WITH {FILINGS},
a AS (SELECT *, {LINES.format(c="coalesce(item_1a_text, '')")} AS la, {LINES.format(c="coalesce(mda_text, '')")} AS lm FROM f WHERE filing_type IN ('10-K', '10-Q')),
b AS (SELECT *, length(array_to_string(la, chr(10))) AS na, length(array_to_string(lm, chr(10))) AS nm, la || ['ITEM 1B. UNRESOLVED', 'none'] AS la2 FROM a),
c AS (SELECT *,
  CASE WHEN na >= 200 THEN la WHEN filing_type = '10-Q' THEN la || ['Item 2. Unregistered Sales', 'none'] WHEN length(array_to_string(la2, chr(10))) >= 200 THEN la2
    ELSE la2 || ['Item 7. Management''s Discussion'] || lm || ['Item 8. Financial Statements', '1 2 3'] END AS xa,
  CASE WHEN nm >= 200 THEN lm WHEN filing_type = '10-K' THEN lm || ['Item 8. Financial Statements', '1 2 3'] ELSE lm || ['Item 3. Quantitative', 'Part II Item 1A. Risk Factors'] || la || ['Item 2. Unregistered Sales', 'none'] END AS xm FROM b),
d AS (SELECT *, {keep('xa')} AS ta, {keep('xm')} AS tm FROM c),
e AS (SELECT *, CASE WHEN length(ta) >= 200 THEN ta ELSE '' END AS ua, CASE WHEN length(tm) >= 200 THEN tm ELSE '' END AS um FROM d)
SELECT upper(coalesce(ticker, 'filings')) AS ticker, filing_type, filing_date, (len(list_filter(regexp_split_to_array(ua, '{WS}'), lambda x: x <> '')) + len(list_filter(regexp_split_to_array(um, '{WS}'), lambda x: x <> '')))::BIGINT AS word_count,
  length(ua)::BIGINT AS item_1a_len, length(um)::BIGINT AS mda_len FROM e"""
