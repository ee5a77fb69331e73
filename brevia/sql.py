"""The text functions in SQL: temporary functions whose bodies are expressions, which the optimiser puts in place of each call.

Names begin with ``brevia_``. Scalars are null for null arguments. ``brevia_lines`` and ``brevia_kept_lines`` give tables, for use with ``LATERAL``.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from brevia.functions import text as T


def _quoted(pattern: str) -> str:
    """A raw SQL literal."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def _lines(text: str) -> str:
    return f"if({text} = '', cast(array() as array<string>), split(regexp_replace({text}, {_quoted(r'\r?\n\z')}, ''), {_quoted(r'\r?\n')}, -1))"


def _redacted(text: str) -> str:
    text = f"regexp_replace({text}, {_quoted(T.USER_PATH)}, '$1user')"
    for pattern in T.SECRETS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, '[REDACTED]')"
    return text


#: (name, parameters, type, body)
FUNCTIONS: tuple[tuple[str, str, str, str], ...] = (
    ("brevia_count_tokens", "t STRING", "BIGINT", f"cast(regexp_count(t, {_quoted(r'(?U)\S+')}) as bigint)"),
    ("brevia_strip_ansi", "t STRING", "STRING", f"regexp_replace(t, {_quoted(chr(92) + 'x1b' + T.ANSI[1:])}, '')"),
    ("brevia_n_lines", "t STRING", "INT", f"size({_lines('t')})"),
    ("brevia_head_tail", "t STRING, head INT, tail INT", "STRING", f"if(brevia_n_lines(t) > head + tail, concat_ws('\\n', slice({_lines('t')}, 1, head), concat('... (', brevia_n_lines(t) - head - tail, ' lines omitted) ...'), slice({_lines('t')}, brevia_n_lines(t) - tail + 1, tail)), array_join({_lines('t')}, '\\n'))"),
    ("brevia_hard_cap", "t STRING, most INT", "STRING", "if(char_length(t) > most, concat(left(t, greatest(most - 16, 0)), '... (truncated)'), t)"),
    ("brevia_sanitize", "t STRING", "STRING", _redacted("t")),
    ("brevia_content_hash", "t STRING", "STRING", "left(sha2(t, 256), 32)"),
    ("brevia_saved", "i BIGINT, o BIGINT", "BIGINT", "greatest(i - o, 0)"),
    ("brevia_savings_pct", "i BIGINT, o BIGINT", "DOUBLE", "if(i = 0, 0.0D, 100.0D * greatest(i - o, 0) / i)"),
    ("brevia_is_builtin", "w STRING", "BOOLEAN", f"w in ({', '.join(_quoted(b) for b in T.BUILTINS)})"),
    ("brevia_needs_terminal", "w STRING", "BOOLEAN", f"w in ({', '.join(_quoted(b) for b in T.INTERACTIVE + T.PRIVILEGED)})"),
)
TABLES: tuple[tuple[str, str, str, str], ...] = (
    ("brevia_lines", "t STRING", "pos INT, line STRING", f"SELECT pos + 1, col FROM (SELECT posexplode({_lines('t')}))"),
    ("brevia_kept_lines", "t STRING, strip STRING", "pos INT, line STRING", f"SELECT pos + 1, col FROM (SELECT posexplode({_lines('t')})) WHERE NOT regexp_like(col, strip)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; gives their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, parameters, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
    return [f[0] for f in FUNCTIONS + TABLES]
