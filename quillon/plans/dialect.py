"""Plans written once in the SQL that Spark and DuckDB share, with a few forms that each engine spells its own way."""

from __future__ import annotations

import re

#: form: (Spark, DuckDB). Arguments are those of the form, split at top-level commas.
FORMS = {
    "PCTL": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "MONTHNO": ("CAST(floor({0} / 100) * 12 + {0} % 100 AS INT)", "CAST(floor({0} / 100) * 12 + {0} % 100 AS INTEGER)"),
    "YEARNO": ("CAST(floor({0} / 100) AS INT)", "CAST(floor({0} / 100) AS INTEGER)"),
    "QUARTERNO": ("CAST(floor({0} / 100) * 4 + ceil(({0} % 100) / 3.0) AS INT)", "CAST(floor({0} / 100) * 4 + ceil(({0} % 100) / 3.0) AS INTEGER)"),
    "WEEKEND": ("date_add(date_trunc('week', {0}), 6)", "CAST(date_trunc('week', {0}) + INTERVAL 6 DAY AS DATE)"),
    "DAYS": ("datediff({0}, {1})", "date_diff('day', CAST({1} AS DATE), CAST({0} AS DATE))"),
    "PLUSDAYS": ("date_add({0}, {1})", "CAST({0} + INTERVAL ({1}) DAY AS DATE)"),
    "MONTHEND": ("last_day(make_date(CAST(floor({0} / 100) AS INT), {0} % 100, 1))", "last_day(make_date(CAST(floor({0} / 100) AS BIGINT), CAST({0} % 100 AS BIGINT), 1))"),
    "DOW": ("(dayofweek({0}) - 1)", "dayofweek({0})"),
    "MODE": ("mode({0}, true)", "mode({0} ORDER BY {0})"),
    "ARGMAX": ("max_by({0}, {1})", "arg_max({0}, {1})"),
    "ARGMIN": ("min_by({0}, {1})", "arg_min({0}, {1})"),
    "MATCHES": ("({0} RLIKE {1})", "regexp_matches({0}, {1})"),
    "SUBRE": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "GETRE": ("regexp_extract({0}, {1}, {2})", "regexp_extract({0}, {1}, {2})"),
    "TEXT": ("CAST({0} AS STRING)", "CAST({0} AS VARCHAR)"),
    "LASTSEEN": ("last({0}, true) OVER ({1} ROWS UNBOUNDED PRECEDING)", "last_value({0} IGNORE NULLS) OVER ({1} ROWS UNBOUNDED PRECEDING)"),
    "LONG": ("CAST({0} AS BIGINT)", "CAST({0} AS BIGINT)"),
    "INTS": ("explode(sequence({0}, {1}))", "unnest(generate_series({0}, {1}))"),
    "DATES": ("explode(sequence({0}, {1}, interval 1 day))", "CAST(unnest(generate_series({0}, {1}, INTERVAL 1 DAY)) AS DATE)"),
    "SAFECORR": (
        "round(covar_pop(CASE WHEN {1} IS NOT NULL THEN {0} END, CASE WHEN {0} IS NOT NULL THEN {1} END) / nullif(stddev_pop(CASE WHEN {1} IS NOT NULL THEN {0} END) * stddev_pop(CASE WHEN {0} IS NOT NULL THEN {1} END), 0), 4)",
    )
    * 2,
}


def _split(text: str) -> list[str]:
    depth, out, start = 0, [], 0
    quoted = False
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and depth == 0:
                out.append(text[start:i].strip())
                start = i + 1
    return [*out, text[start:].strip()]


def render(sql: str, engine: int) -> str:
    """``sql`` for Spark (0) or DuckDB (1): forms are replaced from the innermost out."""
    pattern = re.compile(r"\b(" + "|".join(FORMS) + r")\(")
    while found := list(pattern.finditer(sql)):
        m = found[-1]  # the last one holds no other form after its own start
        depth, quoted = 1, False
        for end in range(m.end(), len(sql)):
            c = sql[end]
            quoted ^= c == "'"
            if not quoted:
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
        sql = sql[: m.start()] + FORMS[m[1]][engine].format(*_split(sql[m.end() : end])) + sql[end + 1 :]
    return sql
