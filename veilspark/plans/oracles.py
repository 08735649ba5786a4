"""Building blocks of the DuckDB statements that queries are held against."""

from __future__ import annotations

# What the detectors match, in DuckDB's dialect.
_S = r"[\s\x{85}\p{Z}]"
_SEP, _DASH = r"(?:[-.]|" + _S + ")", r"(?:-|" + _S + ")"
STREET = "St(?:reet)?|Ave(?:nue)?|Blvd|Boulevard|Dr(?:ive)?|Ln|Lane|Rd|Road|Ct|Court|Pl(?:ace)?|Way|Cir(?:cle)?|Ter(?:race)?|Pkwy|Parkway"
EMAIL = r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"
PHONE = rf"(?:\+1{_SEP}?\(?\p{{Nd}}{{3}}\)?{_SEP}?\p{{Nd}}{{3}}{_SEP}?\p{{Nd}}{{4}}|(?:1{_DASH})?\(\p{{Nd}}{{3}}\){_S}?\p{{Nd}}{{3}}{_SEP}?\p{{Nd}}{{4}}|(?:1{_DASH})?\p{{Nd}}{{3}}{_DASH}\p{{Nd}}{{3}}{_DASH}\p{{Nd}}{{4}})"
ADDRESS = rf"\p{{Nd}}{{1,5}}{_S}+[A-Z][a-zA-Z]+(?:{_S}+[A-Z][a-zA-Z]+)*{_S}+(?:{STREET})\.?"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def spans(pattern: str, label: str, source: str = "SELECT doc_id, text FROM documents", unit: str = "strlen") -> str:
    """(doc_id, start, end, label, secret); offsets in bytes, or with unit="length" in characters."""
    p = quote(pattern)
    return f"""SELECT doc_id, coalesce(list_sum([{unit}(x) FOR x IN g[1:i + 1]]), 0)::BIGINT + coalesce(list_sum([{unit}(x) FOR x IN m[1:i]]), 0)::BIGINT AS "start",
 coalesce(list_sum([{unit}(x) FOR x IN g[1:i + 1]]), 0)::BIGINT + coalesce(list_sum([{unit}(x) FOR x IN m[1:i + 1]]), 0)::BIGINT AS "end", {quote(label)} AS label, m[i + 1] AS secret
FROM (SELECT doc_id, m, g, unnest(range(len(m))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, string_split_regex(text, {p}) AS g FROM ({source})) WHERE len(m) > 0)"""


def merged(parts: list[str], source: str = "documents") -> str:
    """(doc_id, start, end, label) of overlapping or touching spans joined, offsets in characters."""
    return f"""SELECT doc_id, min("start") AS "start", max("end") AS "end", min_by(label, rn) AS label FROM (
 SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY rn) AS island FROM (
  SELECT *, row_number() OVER w AS rn, CASE WHEN "start" <= max("end") OVER (PARTITION BY doc_id ORDER BY "start", "end" DESC, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new
  FROM ({" UNION ALL ".join(parts)}) WINDOW w AS (PARTITION BY doc_id ORDER BY "start", "end" DESC, label))) GROUP BY doc_id, island"""


def redacted(parts: list[str], source: str = "SELECT doc_id, text FROM documents", token: str = "'[REDACTED-' || id || ']'") -> str:
    """(doc_id, redacted): numbered redaction by the spans of parts (in characters). token may use id, label and secret."""
    return f"""WITH s AS (SELECT x.doc_id, "start", "end", label, substr(text, "start" + 1, "end" - "start") AS secret, row_number() OVER (PARTITION BY x.doc_id ORDER BY "start") AS rn, coalesce(lag("end") OVER (PARTITION BY x.doc_id ORDER BY "start"), 0) AS prev FROM ({merged(parts)}) x JOIN ({source}) d USING (doc_id)),
ids AS (SELECT doc_id, secret, row_number() OVER (PARTITION BY doc_id ORDER BY min(rn)) AS id FROM s GROUP BY doc_id, secret),
head AS (SELECT s.doc_id, string_agg(substr(text, prev + 1, "start" - prev) || ({token}), '' ORDER BY rn) AS h, max("end") AS last FROM s JOIN ids USING (doc_id, secret) JOIN ({source}) d USING (doc_id) GROUP BY s.doc_id)
SELECT doc_id, CASE WHEN h IS NULL THEN text ELSE h || substr(text, last + 1) END AS redacted FROM ({source}) d LEFT JOIN head USING (doc_id)"""


def entropy(token: str) -> str:
    return f"round(list_aggregate(string_split({token}, ''), 'entropy'), 6)"
