"""DuckDB SQL of the structure repair: the damage, the faults, and the dynamic
program as a recursive walk over a conversation's rows.  Per state an entry
``{e, t}`` holds the cost in six digits before the edit initials, so the least
entry is the cheapest with the least initials, and the repaired lines."""

from __future__ import annotations

_ENTRY = "STRUCT(e VARCHAR, t VARCHAR)"
_U, _A = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
_KEY_BYTES = "list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(substr(key, i, 1)) AS BIGINT))"
_CRC32 = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_KEY_BYTES}), lambda c, b: list_reduce(
             list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
             lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _more(entry: str, cost: str, initials: str, lines: str, only: str = "true") -> str:
    """``entry`` after further edits; null where there is none."""
    return (f"CASE WHEN {entry} IS NOT NULL AND {only} THEN {{'e': lpad(CAST(CAST(left({entry}.e, 6) AS INTEGER) + {cost} AS VARCHAR), 6, '0') "
            f"|| substr({entry}.e, 7) || '{initials}', 't': {entry}.t || {lines}}} END")


def _least(*entries: str) -> str:
    return "least(" + ",\n                     ".join(entries) + ")"


def _row(to: str, before: list[str], name: str) -> list[str]:
    """The row becomes a ``name`` row: kept, or given that role."""
    return [_more(b, "cut", "K", "kept", f"(NOT must AND initial = '{name[0]}')") for b in before] + [
        _more(b, "2 + cut", "R", f"chr(10) || '{name}:' || text", "NOT must") for b in before]


_INSERTED_U = _least("e2", *(_more(e, "2", "I", _U) for e in ("e0", "e1", "e3")))
_INSERTED_A = _least("e3", _more("e2", "2", "I", _A), *(_more(e, "4", "II", f"{_U} || {_A}") for e in ("e0", "e1")))
_DELETED = [_more(f"f{i}", "3", "D", "''") for i in range(4)]
_AFTER_S = _least(_DELETED[1], _more("f0", "cut", "K", "kept", "(NOT must AND initial = 's')"))
_AFTER_U = _least(_DELETED[2], *_row("f2", ["f0", "f1", "f3"], "user"))
_AFTER_A = _least(_DELETED[3], *_row("f3", ["f2"], "assistant"))
_WHOLE = _least("e0", "e3", _more("e2", "2", "I", _A), _more("e1", "4", "II", f"{_U} || {_A}"))

REPAIR = f"""
        WITH RECURSIVE keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
        hit AS (SELECT *, {_CRC32} % 20 AS kind FROM keyed),
        damaged AS (
            SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM hit, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) c(copy)),
        placed AS (
            SELECT *, row_number() OVER w AS k, left(role, 1) AS initial, lag(left(role, 1)) OVER w || left(role, 1) AS pair,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        marked AS (
            SELECT *, CASE WHEN shown = '' THEN 'blank'
                           WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
                           WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault
            FROM placed),
        rows AS (SELECT *, fault IN ('blank', 'duplicate') AS must, CAST(fault = 'truncated' AS INTEGER) AS cut,
                        chr(10) || role || ':' || text AS kept FROM marked),
        walk AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, CAST({{'e': '000000', 't': ''}} AS {_ENTRY}) AS e0, CAST(NULL AS {_ENTRY}) AS e1,
                   CAST(NULL AS {_ENTRY}) AS e2, CAST(NULL AS {_ENTRY}) AS e3 FROM rows
            UNION ALL
            SELECT conv_id, k, {_DELETED[0]}, {_AFTER_S}, {_AFTER_U}, {_AFTER_A}
            FROM (SELECT w.conv_id, r.k, r.text, initial, must, cut, kept, e0 AS f0, e1 AS f1, {_INSERTED_U} AS f2, {_INSERTED_A} AS f3
                  FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1)),
        best AS (
            SELECT conv_id, {_WHOLE} AS best FROM walk
            WHERE (conv_id IS NULL, coalesce(conv_id, 0), k) IN (SELECT (conv_id IS NULL, coalesce(conv_id, 0), max(k)) FROM rows GROUP BY conv_id)),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM marked GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
               coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(CAST(left(best.e, 6) AS BIGINT), 0) AS cost, coalesce(substr(best.e, 7), '') AS audit,
               sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
        LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id"""
