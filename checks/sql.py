"""SQL fragments shared by the twins (DuckDB dialect)."""

from __future__ import annotations

from collections.abc import Sequence

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def items(values: Sequence[str]) -> str:
    return ", ".join(quote(v) for v in values)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def squeeze(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g'))"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '\S+')"


def wc(x: str) -> str:
    return f"coalesce(len({words(x)}), 0)"


def norm(x: str) -> str:
    return f"lower({strip(x)})"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '<[A-Za-z]+\d*>|{W}+(?:[-'']{W}+)*|[^\s\p{{L}}\p{{N}}_]')"


def upper_words(x: str, members: Sequence[str]) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '{W}+|{NW}+'), "
            f"lambda w: CASE WHEN lower(w) IN ({items(members)}) THEN upper(w) ELSE w END), '')")


def upper_spans(x: str, pattern: str) -> str:
    """Upper-case the matches of a pattern whose word starts and ends are written as \\x01 and \\x02."""
    fenced = rf"regexp_replace({x}, '({W}+)', chr(1) || '\1' || chr(2), 'g')"
    marked = rf"regexp_replace({fenced}, {quote('(' + pattern + ')')}, chr(3) || '\1' || chr(4), 'g')"
    return (f"replace(replace(array_to_string(list_transform(string_split({marked}, chr(3)), lambda p: "
            f"CASE WHEN contains(p, chr(4)) THEN upper(string_split(p, chr(4))[1]) || string_split(p, chr(4))[2] "
            f"ELSE p END), ''), chr(1), ''), chr(2), '')")


def fenced_phrase(p: str) -> str:
    return r"\s+".join(rf"\x01{w}\x02" for w in p.split())


QA = """qa AS (
  SELECT u.conv_id * 1000000 + u.turn AS row_id, u.conv_id, u.turn, u.text AS question, a.text AS answer,
         r.text AS remarks, i.text AS improvements
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN conversations r ON r.conv_id = u.conv_id AND r.turn = u.turn + 2 AND r.role = 'user'
  LEFT JOIN conversations i ON i.conv_id = u.conv_id AND i.turn = u.turn + 3 AND i.role = 'assistant'
  WHERE u.role = 'user')"""

DOCPAIRS = f"""dp AS (
  SELECT doc_id AS row_id, array_to_string(({words('text')})[1:(doc_id % 8) + 1], ' ') AS question, text AS answer,
         CASE WHEN doc_id % 3 = 0 THEN source END AS remarks,
         CASE WHEN doc_id % 5 = 0 THEN lang || ': ' || source || ' again' END AS improvements
  FROM documents)"""

FEEDBACK = QA + f""", fb AS (
  SELECT q.row_id AS id, q.question, substr(md5({norm('q.question')}), 1, 8) AS question_hash,
         q.answer AS base_answer, coalesce(q.improvements, q.answer) AS improvement,
         coalesce(q.remarks, '') AS reflection,
         CASE WHEN e.event_type = 'purchase' THEN 'user-correction' ELSE 'auto-reflection' END AS source,
         least(round(e.value / 25, 2), 1.0) AS confidence_score, e.ts AS created_at
  FROM qa q JOIN events e ON e.event_id = q.conv_id * 8 + q.turn)"""

AT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
