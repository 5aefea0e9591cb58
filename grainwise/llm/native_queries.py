"""Line templates, licences and WARC derivatives over their whole tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainwise.llm import license_digests, line_templates, warc_derivatives
from grainwise.llm.registry import query, table

FETCHED = "2025-01-01T00:00:00Z"


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _open_runs() -> str:
    """Templates of a line of 8 tokens on: any two of eight runs open."""
    cut = lambda j: f"toks[3 + ((n - 2) * {j} // 8) : 2 + ((n - 2) * {j + 1} // 8)]"
    gaps = [(i, j) for i in range(8) for j in range(i + 1, 8)]
    return ", ".join(f"['runs {i} {j}'] || leaf || " + " || ".join("['<gap>']" if k in (i, j) else cut(k) for k in range(8)) for i, j in gaps)


def _open_places(n: int, most: int) -> str:
    """Templates of a line of ``n`` tokens, 4 to 7: one or two places open behind the first two tokens."""
    gaps = [(i, j) for i in range(3, n + 1) for j in range(i, n + 1) if (j > i) == (most == 2)]
    return ", ".join(f"['places'] || leaf || [{', '.join(chr(39) + '<gap>' + chr(39) if k in gap else f'toks[{k}]' for k in range(3, n + 1))}]" for gap in gaps)


LINES_SQL = rf"""
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, [x FOR x IN regexp_split_to_array(regexp_replace(ls[i], '[^ \t\r]*[0-9][^ \t\r]*', '<*>', 'g'), '[ \t\r]+') IF x <> ''] AS toks
          FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs)),
counted AS (SELECT *, len(toks) AS n, [len(toks)::VARCHAR] || toks[1:2] AS leaf FROM lines WHERE len(toks) > 0),
leaves AS (SELECT leaf, count(*) AS leaf_lines FROM counted GROUP BY leaf),
keys AS (SELECT doc_id, i, leaf, unnest([['whole'] || toks] || CASE WHEN n >= 8 THEN [{_open_runs()}] WHEN n = 7 THEN [{_open_places(7, 2)}]
           WHEN n = 6 THEN [{_open_places(6, 2)}] WHEN n = 5 THEN [{_open_places(5, 2)}] WHEN n = 4 THEN [{_open_places(4, 1)}] ELSE [] END) AS k FROM counted),
firsts AS (SELECT k, min(doc_id) AS f FROM keys JOIN leaves USING (leaf) GROUP BY k
           HAVING k[1] <> 'places' OR (count(*) >= 3 AND count(*) >= 0.5 * max(leaf_lines))),
gone AS (SELECT doc_id, list(DISTINCT i) AS lost FROM keys JOIN firsts USING (k) WHERE doc_id > f GROUP BY doc_id),
kept AS (SELECT doc_id, CASE WHEN lost IS NULL THEN text ELSE coalesce(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(lost, i)], chr(10)), '') END AS text,
                coalesce(len(lost), 0) AS n_dropped_lines, lost FROM docs LEFT JOIN gone USING (doc_id))
SELECT d.doc_id, k.text, d.lang, d.source, CASE WHEN k.lost IS NULL THEN d.n_chars ELSE length(k.text) END AS n_chars, k.n_dropped_lines
FROM documents d JOIN kept k USING (doc_id)
"""


@query("op2_line_templates", LINES_SQL)
def line_templates_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring(table(spark, sf_dir, "documents"), wide=True)


def _canonical_sql(text: str) -> str:
    words = f"string_split(trim(regexp_replace(lower(regexp_replace({text}, {_literal(license_digests.COPYRIGHT_LINE)}, ' ', 'g')), {_literal(license_digests.LEVELLED)}, ' ', 'g')), ' ')"
    form = f"'  ' || array_to_string({words}, '  ') || '  '"
    for a, b in license_digests.SPELLINGS:
        form = f"replace({form}, ' {a.replace(' ', '  ')} ', ' {b.replace(' ', '  ')} ')"
    return f"nullif(trim(replace({form}, '  ', ' ')), '')"


LICENSE_SQL = f"""
WITH texts(license_id, text) AS (VALUES {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in license_digests.KNOWN_TEXTS)}),
known AS (SELECT sha256({_canonical_sql("text")}) AS digest, min(license_id) AS license_id FROM texts GROUP BY 1),
lines AS (SELECT doc_id, ls[i] AS line, i FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
hits AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT license_id)), ',') AS notices, count(*) AS n
         FROM lines JOIN known ON sha256({_canonical_sql("line")}) = digest GROUP BY doc_id)
SELECT doc_id, d.digest, license_id, notices, coalesce(n, 0) AS n_notice_lines
FROM (SELECT doc_id, sha256({_canonical_sql("text")}) AS digest FROM documents) d LEFT JOIN known USING (digest) LEFT JOIN hits USING (doc_id)
"""


@query("op3_license_digests", LICENSE_SQL)
def license_digests_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digests.scan(table(spark, sf_dir, "documents"), license_digests.known_licenses(spark), telling=license_digests.TELLING)


_TABLE_SQL = "MAP {" + ", ".join(f"{_literal(k)}: {_literal(c)}" for k, c in warc_derivatives.REFERENCES.items()) + "}"


def _decoded_sql(text: str, bare: bool = True) -> str:
    """``text`` cut at ampersands; each part is a structure of its own steps in nested comprehensions."""
    old = f"regexp_extract(x, {_literal(warc_derivatives.BARE_REFERENCE)}, 1)" if bare else "''"
    parts = f"[{{'x': x, 'ref': regexp_extract(x, {_literal(warc_derivatives.REFERENCE)}, 1), 'old': {old}}} FOR x IN string_split({text}, '&')[2:]]"
    code = "CASE WHEN lower(p.ref[1:2]) = '#x' THEN ('0x' || p.ref[3:])::BIGINT WHEN p.ref[1] = '#' THEN p.ref[2:]::BIGINT END"
    parts = f"[{{'x': p.x, 'ref': p.ref, 'old': CASE WHEN p.ref[1] = '#' THEN '' ELSE p.old END, 'code': {code}}} FOR p IN {parts}]"
    own = "CASE WHEN q.code > 1114111 OR q.code BETWEEN 55296 AND 57343 THEN chr(65533) WHEN q.code > 0 THEN chr(q.code::INTEGER) END"
    found = f"coalesce({_TABLE_SQL}[CASE WHEN q.code IS NULL THEN q.ref ELSE '#' || q.code END], {own})"
    shown = f"coalesce({found} || substr(q.x, length(q.ref) + 2), {_TABLE_SQL}[q.old] || substr(q.x, length(q.old) + 1), '&' || q.x)"
    return f"(string_split({text}, '&')[1] || array_to_string([{shown} FOR q IN {parts}], ''))"


def _stripped_sql(html: str) -> str:
    html = f"regexp_replace({html}, {_literal(warc_derivatives.HIDDEN)}, ' ', 'g')"
    return f"regexp_replace(regexp_replace({html}, {_literal(warc_derivatives.BLOCK_TAG)}, chr(10), 'g'), {_literal(warc_derivatives.TAG)}, '', 'g')"


def _plain_sql(stripped: str) -> str:
    html = rf"regexp_replace(regexp_replace({_decoded_sql(stripped)}, '[ \t\r\f]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({html}, '^[ \n]+|[ \n]+$', '', 'g')"


def _line_sql(text: str, bare: bool = True) -> str:
    return rf"trim(regexp_replace({_decoded_sql(text, bare)}, '[ \t\r\n]+', ' ', 'g'))"


def _uuid_sql(*parts: str) -> str:
    h = f"sha256({' || chr(10) || '.join(parts)})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


_CRLF = "chr(13) || chr(10)"
WARC_SQL = rf"""
WITH r AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
s AS (SELECT *, {_uuid_sql("'response'", "page_id::VARCHAR", "target_uri", "payload")} AS refers_to, 'sha256:' || sha256(payload) AS source_digest,
  'HTTP/1.1 200 OK' || {_CRLF} || 'Content-Type: text/html; charset=utf-8' || {_CRLF} || 'Content-Length: ' || strlen(payload)::VARCHAR || {_CRLF} AS source_headers,
  regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title', 1) AS raw_title, {_stripped_sql("payload")} AS stripped,
  regexp_extract(payload, '(?i)<html[^>]* lang="([^"]*)"', 1) AS lang,
  regexp_extract_all(payload, '(?i)<a [^>]*href="([^"]*)"', 1) AS links FROM r),
t AS (SELECT *, {_line_sql("raw_title")} AS title FROM s),
b AS (SELECT *, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
  CASE WHEN title <> '' THEN 'title: ' || title || {_CRLF} ELSE '' END || CASE WHEN lang <> '' THEN 'language: ' || lang || {_CRLF} ELSE '' END
  || coalesce(array_to_string([('outlink: ' || {_line_sql("y", bare=False)} || {_CRLF}) FOR y IN links], ''), '') AS block FROM t
  UNION ALL SELECT *, 'conversion', 'text/plain', {_plain_sql("stripped")} FROM t)
SELECT page_id, {_uuid_sql("record_type", "refers_to")} AS record_id, record_type, refers_to, target_uri, '{FETCHED}' AS date, content_type, source_headers, source_digest,
  'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length, block FROM b
"""


@query("op5_warc_derivatives", WARC_SQL)
def warc_derivatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_derivatives.derive(warc_derivatives.responses(table(spark, sf_dir, "pages"), FETCHED))
