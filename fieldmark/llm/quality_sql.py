"""SQL twin of the quality rules query, for DuckDB."""

from __future__ import annotations

from .quality_rules import RULES, RiskControl


def quality_sql(risk: RiskControl = RiskControl()) -> str:
    p = risk.alpha / len(RULES)
    word = r"[^\x20\x09-\x0D]+"
    grid = ", ".join(f"('{r}', {i}, {c!r}::DOUBLE)" for r, cuts in RULES.items() for i, c in enumerate(cuts, 1))
    long = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r}' AS rule, {r} AS v FROM f" for r in RULES)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def per(a: str, b: str, name: str) -> str:
        return f"CASE WHEN {b}>0 THEN {a}/{b} ELSE 0.0::DOUBLE END AS {name}"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang,'') AS stratum, coalesce(text,'') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '{word}')) AS word, generate_subscripts(regexp_extract_all(t, '{word}'), 1) AS i FROM d),
g AS (SELECT rid, i, [word, lead(word,1) OVER k, lead(word,2) OVER k, lead(word,3) OVER k, lead(word,4) OVER k] AS gram, lead(word,4) OVER k AS last FROM w WINDOW k AS (PARTITION BY rid ORDER BY i)),
r AS (SELECT rid, i FROM g WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i+5)) AS j FROM r) GROUP BY rid),
nw AS (SELECT rid, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars FROM w GROUP BY rid),
ln AS (SELECT rid, count(*) AS n, count(DISTINCT line) AS u FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{word}') GROUP BY rid),
b AS (SELECT d.doc_id, d.stratum, coalesce(n_words,0) AS n_words, coalesce(word_chars,0) AS word_chars, length(t)-length(translate(t,'#*$%&|<>','')) AS n_symbols,
  coalesce(ln.n-ln.u,0) AS n_dup_lines, coalesce(rep.n,0) AS n_repeat_words, coalesce(ln.n,0) AS n_lines, length(t)-length(translate(t,'{upper}','')) AS n_upper, length(t)-length(replace(t,'!','')) AS n_shout
  FROM d LEFT JOIN nw USING (rid) LEFT JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
f AS (SELECT doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words<10 OR 100*n_repeat_words>20*n_words AS base_failed,
  {per("n_symbols", "word_chars", "symbol_ratio")}, {per("n_upper", "word_chars", "upper_ratio")}, {per("n_shout", "n_words", "shout_ratio")},
  {per("n_dup_lines", "n_lines", "dup_line_ratio")}, {per("n_repeat_words", "n_words", "repeat_ratio")} FROM b),
l AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
x AS (SELECT stratum, rule, v, quality FROM ({long}) JOIN l USING (doc_id)),
s AS (SELECT stratum, count(*) FILTER (quality>0) AS n_good FROM f JOIN l USING (doc_id) GROUP BY stratum),
grid(rule, level, cutoff) AS (VALUES {grid}),
a AS (SELECT s.stratum, s.n_good, grid.rule, level, cutoff, count(*) FILTER (v>cutoff AND quality>0) AS k_good, count(*) FILTER (v>cutoff AND quality<=0) AS k_bad
  FROM s CROSS JOIN grid JOIN x ON x.stratum=s.stratum AND x.rule=grid.rule GROUP BY ALL),
tail AS (SELECT n_good, k_good, least(1.0, sum(exp(lgamma(n_good+1)-lgamma(j+1)-lgamma(n_good-j+1)+j*ln({p!r})+(n_good-j)*ln(1-{p!r})))) AS p
  FROM (SELECT n_good, k_good, unnest(range(0, k_good+1)) AS j FROM (SELECT DISTINCT n_good, k_good FROM a)) GROUP BY ALL),
o AS (SELECT a.*, n_good>0 AND p <= {risk.delta!r}/(SELECT greatest(1, count(*)*{len(RULES)}) FROM s) AS ok FROM a JOIN tail USING (n_good, k_good)),
c AS (SELECT *, bool_and(ok) OVER (PARTITION BY stratum, rule ORDER BY level) AS all_ok FROM o),
cut AS (SELECT stratum, rule, cutoff FROM c WHERE all_ok AND k_bad>k_good QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY k_bad-k_good DESC, level)=1)
SELECT f.*, NOT (base_failed OR EXISTS (SELECT 1 FROM cut WHERE cut.stratum=f.stratum AND (""" + " OR ".join(
        f"(cut.rule='{r}' AND f.{r}>cut.cutoff)" for r in RULES
    ) + "))) AS kept FROM f"
