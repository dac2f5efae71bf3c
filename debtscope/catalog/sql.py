"""Pieces of check SQL."""

from __future__ import annotations

from debtscope.functions.text import BLANKS

BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
BLANK_LITERAL = "'" + BLANKS.replace("\x1c", "").replace("\x1d", "").replace("\x1e", "").replace("\x1f", "") + "'"


def rnd(x: str, places: int) -> str:
    """Rounding with the package's tie rule."""
    return (
        f"(CASE WHEN ({x}) * 65536 = floor(({x}) * 65536) THEN round_even({x}, {places}) "
        f"ELSE round(CAST(({x}) AS DECIMAL(28, 10)), {places})::DOUBLE END)"
    )


def lines(text: str) -> str:
    return (
        f"(CASE WHEN {text} = '' THEN []::VARCHAR[] "
        f"ELSE string_split_regex(regexp_replace({text}, '({BREAK})$', ''), '{BREAK}') END)"
    )


def strip(text: str) -> str:
    return f"trim({text}, {BLANK_LITERAL})"


def clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0), 1.0)"


def severity_file(x: str) -> str:
    return f"CASE WHEN {x} < 0.3 THEN 'low' WHEN {x} < 0.6 THEN 'medium' ELSE 'high' END"


def severity_repo(x: str) -> str:
    return f"CASE WHEN {x} < 0.4 THEN 'LOW' WHEN {x} < 0.7 THEN 'MEDIUM' ELSE 'HIGH' END"


def severity_dataset(x: str) -> str:
    return f"CASE WHEN {x} >= 0.6 THEN 'HIGH' WHEN {x} >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END"


def upper_tail(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    series = f"{t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"
    return f"(exp(-({z}) * ({z}) / 2) / 2.5066282746310002 * {series})"


def p_two_sided(z: str) -> str:
    return f"(CASE WHEN {z} IS NOT NULL THEN least(1.0, 2 * {upper_tail(z)}) END)"


# Files of the documents table with their repeated lines, found by listing
# every covered line.
DOCUMENT_LINES = f"""
doc_lines AS (
  SELECT doc_id, source, lang, n_chars, text, {lines("text")} AS ls FROM documents
),
line_rows AS (
  SELECT doc_id, unnest(ls) AS raw, unnest(range(len(ls))) AS pos FROM doc_lines
),
windows AS (
  SELECT doc_id, pos,
    list({strip("raw")}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS w,
    list(raw) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS rw
  FROM line_rows
),
good AS (
  SELECT doc_id, pos, rw, md5(array_to_string(w, chr(10))) AS hash FROM windows
  WHERE len(w) = 6 AND len(list_filter(w, lambda x: x <> '' AND NOT regexp_matches(x, '^(#|//|import |from )'))) >= 2
),
repeats AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, hash) AS c FROM good) WHERE c > 1
),
covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS d FROM repeats, range(6) AS t(k) GROUP BY doc_id
),
dup AS (
  SELECT l.doc_id, l.source, l.lang, l.n_chars, l.text, len(l.ls)::BIGINT AS n, coalesce(c.d, 0)::BIGINT AS d, l.ls,
    CASE WHEN len(l.ls) > 0 THEN {rnd("coalesce(c.d, 0) / len(l.ls) * 100", 2)} ELSE 0.0 END AS pct
  FROM doc_lines l LEFT JOIN covered c USING (doc_id)
)
"""

_COMPLEXITY = rnd("least(0.8, n / 1000)", 4)
_COVERAGE = rnd("CASE WHEN n > 0 THEN comments / n ELSE 0.0 END", 4)

# The same with the scores of plans.bindings.scored_documents and its labels.
SCORED = f"""{DOCUMENT_LINES},
measured AS (
  SELECT *, {_COMPLEXITY} AS complexity_score,
    CASE WHEN n = 0 THEN 0.0 ELSE {rnd(clamp("(pct - 3) / 22"), 4)} END AS duplication_score,
    len(list_filter(ls, lambda x: contains(x, '#') OR contains(x, '//'))) AS comments
  FROM dup
),
documented AS (
  SELECT *, {rnd(clamp(f"(1 - {_COVERAGE} - 0.2) / 0.7"), 4)} AS documentation_score, 0.5::DOUBLE AS error_handling_score
  FROM measured
),
scored AS (
  SELECT m.doc_id, m.source, m.lang, m.n_chars, m.n, m.d, m.pct, m.complexity_score, m.duplication_score,
    m.documentation_score, m.error_handling_score, y.debt_score,
    {severity_dataset("y.debt_score")} AS severity,
    CASE WHEN l.doc_id IS NULL THEN 'None' WHEN l.quality = 0 THEN 'Low' WHEN l.toxic = 1 OR l.doc_id % 3 = 0 THEN 'High' ELSE 'Medium' END AS ai_confidence
  FROM documented m
  CROSS JOIN LATERAL (SELECT {rnd(clamp(
      "0.30 * m.complexity_score + 0.25 * m.duplication_score + 0.20 * m.documentation_score"
      " + 0.25 * (1 - m.error_handling_score)"), 4)} AS debt_score) y
  LEFT JOIN labels l ON l.doc_id = m.doc_id
)
"""

IS_AI = "ai_confidence <> 'None'"
COHORT2 = "CASE WHEN ai_confidence = 'None' THEN 'human' ELSE 'ai' END"
COHORT1 = "CASE WHEN ai_confidence IN ('High', 'Medium') THEN 'ai' ELSE 'human' END"
