"""Pieces of DuckDB SQL that several oracles share."""

SEED = "millrace"


def h(expr: str, digits: int, n: int | None = None) -> str:
    """The first hex digits of sha256(expr) as a number, modulo n."""
    x = f"('0x'||substr(sha256({expr}),1,{digits}))::bigint"
    return f"({x} % {n})" if n else x


def digest_sql(table: str, columns: list[str]) -> str:
    """value and rows of a table's digest: four sums of parts of its rows' hashes."""
    cells = ", ".join(f"coalesce(length({c}::varchar)||':'||{c}::varchar, '-')" for c in columns)
    sums = "||".join(f"printf('%08x', (coalesce(sum(('0x'||substr(h, {8 * k + 1}, 8))::hugeint), 0) % 4294967296)::bigint)" for k in range(4))
    return f"{sums} AS value, count(*) AS rows FROM (SELECT sha256(concat_ws('|', {cells})) AS h FROM {table})"


NORM = "trim(regexp_replace(lower(text), '\\s+', ' ', 'g'))"
ROWS = f"""rows AS (SELECT doc_id, text, source, lang, {NORM} AS norm, sha256({NORM}) AS grp FROM documents)"""
SPLIT = f"CASE WHEN {h(chr(39) + SEED + ':' + chr(39) + '||grp', 12, 100)} < 65 THEN 'train' WHEN {h(chr(39) + SEED + ':' + chr(39) + '||grp', 12, 100)} < 80 THEN 'development' WHEN {h(chr(39) + SEED + ':' + chr(39) + '||grp', 12, 100)} < 90 THEN 'calibration' ELSE 'final' END"
SPLIT_ROWS = f"""{ROWS}, split_rows AS (SELECT *, {SPLIT} AS split FROM rows)"""
LOGITS = f"""
base AS (SELECT doc_id, lang AS family, source, {h("doc_id||':target'", 8, 4)}::int AS target FROM documents),
z AS (SELECT b.*, s.system, i.i::int AS i, ({h("b.doc_id||':'||i.i||':'||s.system", 8, 40)})::double / 10 + CASE WHEN s.system = 'b' AND i.i = target THEN 1.5 ELSE 0 END AS z
      FROM base b, (VALUES ('a'),('b')) s(system), range(4) i(i)
      WHERE {h("b.doc_id||':miss:'||s.system", 8, 50)} <> 0),
lp AS (SELECT *, z - max(z) OVER w - ln(sum(exp(z - mz)) OVER w) AS logp FROM (SELECT *, max(z) OVER (PARTITION BY doc_id, system) AS mz FROM z) WINDOW w AS (PARTITION BY doc_id, system)),
got AS (SELECT doc_id, system, avg(CASE WHEN z = mz THEN (i = target)::int::double END) AS credit, -sum(CASE WHEN i = target THEN logp ELSE 0 END) AS nll,
      sum((exp(logp) - (i = target)::int) * (exp(logp) - (i = target)::int)) AS brier, sum(i * exp(logp)) AS expected,
      min(CASE WHEN z = mz THEN i END) AS best, max(exp(logp)) - (sum(exp(logp)) - max(exp(logp))) / 3 AS confidence
      FROM lp GROUP BY ALL),
scored AS (SELECT b.doc_id, b.family, b.source, b.target, s.system, coalesce(g.credit, 0) AS credit, g.nll, g.brier, g.expected, g.best, g.confidence
      FROM base b CROSS JOIN (VALUES ('a'),('b')) s(system) LEFT JOIN got g ON g.doc_id = b.doc_id AND g.system = s.system)"""
METRICS = """metrics AS (SELECT system, family, count(*) AS cases, avg(credit) AS accuracy, avg((nll IS NOT NULL)::int::double) AS coverage, avg(nll) AS nll, avg(brier) AS brier FROM scored GROUP BY ALL)"""
MACRO = """macro AS (SELECT system, count(*) AS families, avg(accuracy) AS macro_accuracy, avg(coverage) AS macro_coverage, avg(nll) AS macro_nll FROM metrics GROUP BY ALL)"""
