"""The hierarchy of chunks as SQL, level by level, to compare the column expressions with."""

from __future__ import annotations

from lexloom.config import GENERIC_PATTERNS, KEYWORDS, LAW_KEYWORDS, LAW_PATTERNS, MAX_CHUNK, MIN_CHUNK, MIN_SEGMENT

MARK = "chr(57344)"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(quoted, values)) + "]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _ref(x: str) -> str:
    return rf"left(regexp_replace({_strip(f'string_split({x}, chr(10))[1]')}, '\s+', ' ', 'g'), 80)"


def _segments(name: str, source: str, keys: str, pattern: tuple[str, str, bool]) -> str:
    """CTEs that end in `name` (keys, i, t, start): the segments of source (keys, body) that are long enough."""
    flags = "(?mi)" if pattern[2] else "(?m)"
    marked = f"string_split(regexp_replace(body, {quoted(f'{flags}({pattern[1]})')}, {MARK} || '\\1', 'g'), {MARK})"
    return (
        f"{name}_a AS (SELECT {keys}, {marked} AS arr FROM {source}), {name}_p AS (SELECT {keys}, unnest(arr) AS t, generate_subscripts(arr, 1) AS i FROM {name}_a), "
        f"{name}_o AS (SELECT *, sum(length(t)) OVER (PARTITION BY {keys} ORDER BY i) - length(t) AS start FROM {name}_p), "
        f"{name} AS (SELECT {keys}, i, t, start FROM {name}_o WHERE i > 1 AND length({_strip('t')}) >= {MIN_SEGMENT})"
    )


def pieces_sql(source: str, keys: str, separator: str, joint: str, most: int = MAX_CHUNK) -> str:
    """CTEs that end in `pieces` (keys, d, text, start): paragraphs of source (keys, body) put together as long as they fit."""
    on = " AND ".join(f"r.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    flush = f"length(r.cur) + length(s.arr[r.k + 1]) > {most} AND r.cur <> ''"
    return (
        f"paras AS (SELECT {keys}, string_split_regex(body, '{separator}') AS arr FROM {source}), "
        f"r AS (SELECT {keys}, CAST(0 AS BIGINT) AS k, '' AS cur, CAST(0 AS BIGINT) AS off, CAST(NULL AS VARCHAR) AS done, CAST(0 AS BIGINT) AS done_at FROM paras UNION ALL "
        f"SELECT {own}, r.k + 1, CASE WHEN {flush} THEN s.arr[r.k + 1] WHEN r.cur <> '' THEN r.cur || {joint} || s.arr[r.k + 1] ELSE s.arr[r.k + 1] END, CASE WHEN {flush} THEN r.off + length(r.cur) ELSE r.off END, CASE WHEN {flush} THEN r.cur END, r.off "
        f"FROM r JOIN paras s ON {on} WHERE r.k < len(s.arr)), "
        f"pieces AS (SELECT {keys}, k AS d, done AS text, done_at AS start FROM r WHERE done IS NOT NULL UNION ALL SELECT {own}, r.k + 1, r.cur, r.off FROM r JOIN paras s ON {on} WHERE r.k = len(s.arr) AND {_strip('r.cur')} <> '')"
    )


def chunk_sql(law: str, text: str) -> str:
    """(law, chunk_id, article_ref, parent_ref, level, concept_tags, text, char_offset, seq) of one law's text."""
    body = " || chr(10) || ".join(map(quoted, text.split("\n")))
    return chunks_sql(law, f"SELECT 0 AS z, {body} AS body")


def chunks_sql(law: str, docs: str, named: str | None = None, columns: str = "") -> str:
    """The same of docs (z, body), a query for a row a text, by the patterns of one law; named: how a text's law is made of z."""
    patterns = LAW_PATTERNS.get(law, GENERIC_PATTERNS)
    top, inner = patterns[0], patterns[1]
    own = named or quoted(law)
    parts = [
        f"doc AS ({docs})",
        _segments("s1", "doc", "z", top),
        f"one AS (SELECT z, i AS a, {quoted(top[0])} AS level, {_ref('t')} AS ref, '' AS parent, {_strip('t')} AS body, left(t, 64) AS head, start FROM s1 "
        f"UNION ALL SELECT z, 0, 'document', {own}, '', {_strip('body')}, left(body, 64), 0 FROM doc WHERE z NOT IN (SELECT z FROM s1))",
        _segments("s2", "one", "z, a", inner),
        f"two AS (SELECT s2.z, s2.a, s2.i AS b, {quoted(inner[0])} AS level, {_ref('s2.t')} AS ref, one.ref AS parent, {_strip('s2.t')} AS body, left(s2.t, 64) AS head, one.start + s2.start AS start FROM s2 JOIN one USING (z, a))",
        "alone AS (SELECT z, a, 0 AS b, 0 AS c, level, ref, parent, body, head, start FROM one WHERE NOT EXISTS (SELECT 1 FROM two WHERE two.z = one.z AND two.a = one.a))",
    ]
    rows = "SELECT * FROM alone UNION ALL SELECT z, a, b, 0, level, ref, parent, body, head, start FROM two"
    if len(patterns) > 2:
        parts.append(_segments("s3", "two", "z, a, b", patterns[2]))
        rows += f" UNION ALL SELECT s3.z, s3.a, s3.b, s3.i, {quoted(patterns[2][0])}, {_ref('s3.t')}, two.ref, {_strip('s3.t')}, left(s3.t, 64), two.start + s3.start FROM s3 JOIN two USING (z, a, b) WHERE length({_strip('s3.t')}) >= {MIN_CHUNK}"
    tags = ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(x.text), {quoted(w)})' for w in words)} THEN {quoted(c)} END" for c, words in LAW_KEYWORDS.get(law, KEYWORDS).items())
    parts += [
        f"every AS ({rows})",
        f"long AS (SELECT z, a, b, c, body FROM every WHERE length(body) > {MAX_CHUNK})",
        pieces_sql("long", "z, a, b, c", "\n{2,}", "chr(10) || chr(10)"),
        f"x AS (SELECT e.z, e.a, e.b, e.c, coalesce(p.d, 0) AS d, e.level, e.ref, e.parent, {_strip('coalesce(p.text, e.body)')} AS text, coalesce(left(p.text, 64), e.head) AS head, e.start + coalesce(p.start, 0) AS off FROM every e LEFT JOIN pieces p ON p.z = e.z AND p.a = e.a AND p.b = e.b AND p.c = e.c)",
    ]
    return (
        f"WITH RECURSIVE {', '.join(parts)} SELECT {columns}{own} AS law, left(sha1({own} || '|' || ref || '|' || head), 16) AS chunk_id, ref AS article_ref, parent AS parent_ref, level, "
        f"array_to_string(list_filter([{tags}], lambda t: t IS NOT NULL), ',') AS concept_tags, text, CAST(off AS BIGINT) AS char_offset, CAST(row_number() OVER (PARTITION BY z ORDER BY a, b, c, d) - 1 AS BIGINT) AS seq FROM x"
    )
