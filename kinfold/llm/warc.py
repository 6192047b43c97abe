"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Native: only Spark's own functions. Identifiers of derivatives are urn:uuid made
from the response's identifier and the kind of record, so they repeat.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Both records of a response say when they were derived.
DERIVED_AT = "2024-01-01T00:00:00Z"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<noscript\b.*?</noscript\s*>"
BREAKS = r"(?i)</?(p|div|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|br|hr|section|article|nav|header|footer|main|aside|blockquote|pre|form)\b[^>]*>"
TAGS = r"<[^>]*>"
#: HTML's names with what they stand for, by their first letter; a no-break space becomes a space. The few that need no semicolon, longest first.
NAMES = {a: {n: v.replace("\xa0", " ") for n, v in html5.items() if n[0] == a} for a in sorted({n[0] for n in html5})}
LONGEST_NAME = max(map(len, html5))
BARE_NAMES = "^(" + "|".join(sorted((n for n in html5 if n[-1] != ";"), key=lambda n: (-len(n), n))) + ")"


def uuid_of(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    cut = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), cut(1, 8), F.lit("-"), cut(9, 4), F.lit("-"), cut(13, 4), F.lit("-"), cut(17, 4), F.lit("-"), cut(21, 12))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def decoded(text: Column) -> Column:
    """Numeric entities and all of HTML's named ones decoded, each once; numbers outside Unicode and unknown names stay as they are.

    As in HTML, a name that needs no semicolon may go on with other letters: the longest such name counts.
    """
    # patterns see the first characters of a part only: no number or name is longer
    head = lambda p: F.substring(p, 1, LONGEST_NAME)
    number = lambda p: F.coalesce(
        F.regexp_extract(head(p), "^#([0-9]{1,7});", 1).try_cast("int"), F.conv(F.nullif(F.regexp_extract(head(p), "^#[xX]([0-9A-Fa-f]{1,6});", 1), F.lit("")), 16, 10).try_cast("int")
    )
    valid = lambda n: (n > 0) & (n < 0x110000) & ~n.between(0xD800, 0xDFFF)
    char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0")), "UTF-32")
    names = F.from_json(F.lit(json.dumps(NAMES)), "map<string,map<string,string>>")
    meant = lambda name: F.try_element_at(F.try_element_at(names, F.substring(name, 1, 1)), name)
    closed = lambda p: F.regexp_extract(head(p), "^[A-Za-z][A-Za-z0-9]*;", 0)
    bare = lambda p: F.regexp_extract(head(p), BARE_NAMES, 1)
    after = lambda p, name: F.substr(p, F.length(name) + 1)
    literal = lambda p: F.concat(F.lit("&"), p)
    numeric = lambda p: F.when(valid(number(p)), F.concat(char(number(p)), F.substr(p, F.instr(p, ";") + 1))).otherwise(literal(p))
    named = lambda p: F.coalesce(F.concat(meant(closed(p)), after(p, closed(p))), F.concat(meant(bare(p)), after(p, bare(p))), literal(p))
    part = lambda p, i: F.when(i == 0, p).when(F.startswith(p, F.lit("#")), numeric(p)).otherwise(named(p))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(F.split(text, "&"), part), "")).otherwise(text)


def plain_text(html: Column) -> Column:
    """Visible text: scripts, styles, head and comments go, block tags break lines, other tags vanish, entities are decoded."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), BREAKS, "\n"), TAGS, "")
    text = F.regexp_replace(F.regexp_replace(decoded(text), "[ \t\r\f ]+", " "), " ?\n[ \n]*", "\n")
    return F.trim(text, F.lit(" \n"))


def responses_of(pages: DataFrame, date: str = DERIVED_AT) -> DataFrame:
    """Response records (record_id, target_uri, date, headers, payload) of (page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(html), F.lit(CRLF))
    return pages.select(
        F.col("page_id"), uuid_of(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit("")), F.sha2(html, 256)).alias("record_id"),
        F.coalesce("url", F.lit("")).alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), html.alias("payload"),
    )


def derivatives(responses: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two records for each response: its metadata, then its conversion to plain text.

    ``responses`` has (record_id, target_uri, date, headers, payload); nulls count as
    empty. ``keep`` names columns of the input that the result carries. Columns of the
    result: record_type, record_id, refers_to, target_uri, date, content_type,
    content_length, block_digest, source_digest, block. The metadata block holds the
    source's date, digest, length and HTTP headers, the page's title and its number of links. Equal responses have
    equal derivatives, each its own rows; an empty page has an empty conversion; an empty table gives no rows.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = responses.select(
        *keep, c("record_id").alias("refers_to"), c("target_uri").alias("target_uri"), c("date").alias("source_date"),
        c("headers").alias("headers"), c("payload").alias("payload"), digest(c("payload")).alias("source_digest"),
    )
    title = F.trim(F.regexp_replace(decoded(F.regexp_extract("payload", r"(?is)<title[^>]*>(.*?)</title\s*>", 1)), r"[ \t\r\n\f]+", " "))
    links = F.size(F.split("payload", r"(?i)<a\s[^>]*href\s*=", -1)) - 1
    lines = F.filter(F.split("headers", "\r?\n"), lambda x: x != "")
    source = F.array_join(F.transform(lines, lambda x, i: F.when(i == 0, F.concat(F.lit("source-status: "), x)).otherwise(F.concat(F.lit("source-header-"), x))), CRLF)
    fields = F.array(
        F.concat(F.lit("source-date: "), "source_date"), F.concat(F.lit("source-payload-digest: "), "source_digest"),
        F.concat(F.lit("source-payload-length: "), F.octet_length("payload").cast("string")), F.when(F.col("headers") != "", source),
        F.concat(F.lit("title: "), title), F.concat(F.lit("outlinks: "), links.cast("string")),
    )
    metadata = F.concat(F.array_join(fields, CRLF), F.lit(CRLF))
    kind = lambda name, content, block: F.struct(F.lit(name).alias("record_type"), F.lit(content).alias("content_type"), block.alias("block"))
    both = F.array(kind("metadata", "application/warc-fields", metadata), kind("conversion", "text/plain; charset=utf-8", plain_text(F.col("payload"))))
    made = rows.select(*keep, "refers_to", "target_uri", "source_digest", F.inline(both))
    return made.select(
        *keep, "record_type", uuid_of(F.col("refers_to"), F.col("record_type")).alias("record_id"), "refers_to", "target_uri", F.lit(DERIVED_AT).alias("date"),
        "content_type", F.octet_length("block").cast("bigint").alias("content_length"), digest(F.col("block")).alias("block_digest"), "source_digest", "block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """(value): each record as WARC/1.1 text, without the two line ends that follow it."""
    head = [
        ("WARC-Type", F.col("record_type")), ("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))), ("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))),
        ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")), ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    ]
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in head]
    return records.select(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, F.lit(""), F.col("block")).alias("value"))


def write_warc(records: DataFrame, path: str) -> None:
    """Gzipped WARC files at ``path``, one for each task; records end with two line ends."""
    serialised(records).write.mode("overwrite").option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def derivatives_sql() -> str:
    """DuckDB SQL for the rows of the query, from the same table of names."""
    esc = lambda s: s.replace("'", "''")
    uuid = lambda h: "'urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    head = f"substr(p, 1, {LONGEST_NAME})"
    number = f"coalesce(TRY_CAST(regexp_extract({head}, '^#([0-9]{{1,7}});', 1) AS INT), TRY_CAST('0x' || nullif(regexp_extract({head}, '^#[xX]([0-9A-Fa-f]{{1,6}});', 1), '') AS INT))"
    valid = f"coalesce({number} > 0 AND {number} < 1114112 AND NOT {number} BETWEEN 55296 AND 57343, false)"
    numeric = f"CASE WHEN {valid} THEN chr({number}) || substr(p, instr(p, ';') + 1) ELSE '&' || p END"
    named = lambda pattern: f"m[regexp_extract({head}, '{pattern}', 0)] || substr(p, length(regexp_extract({head}, '{pattern}', 0)) + 1)"
    closed, bare = named("^[A-Za-z][A-Za-z0-9]*;"), named(BARE_NAMES)
    part = f"CASE WHEN i = 1 THEN p WHEN starts_with(p, '#') THEN {numeric} ELSE coalesce({closed}, {bare}, '&' || p) END"
    decode = lambda t: f"CASE WHEN contains({t}, '&') THEN array_to_string(list_transform(string_split({t}, '&'), lambda p, i: {part}), '') ELSE {t} END"
    names = ", ".join(f"'{n}': '{esc(v)}'" for of in NAMES.values() for n, v in of.items())
    crlf = "chr(13) || chr(10)"
    stripped = f"regexp_replace(regexp_replace(regexp_replace(payload, '{HIDDEN}', ' ', 'g'), '{BREAKS}', chr(10), 'g'), '{TAGS}', '', 'g')"
    return f"""
WITH names AS (SELECT MAP {{{names}}} AS m), s AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
r AS (SELECT *, md5(coalesce(page_id::VARCHAR, '') || '|' || target_uri || '|' || sha256(payload)) AS h, {stripped} AS bare,
  trim(regexp_replace({decode("regexp_extract(payload, '(?is)<title[^>]*>(.*?)</title\\s*>', 1)")}, '[ \\t\\r\\n\\f]+', ' ', 'g')) AS title, m FROM s, names),
i AS (SELECT *, {uuid('h')} AS refers_to, 'sha256:' || sha256(payload) AS source_digest FROM r),
b AS (SELECT page_id, refers_to, target_uri, source_digest, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
  'source-date: {DERIVED_AT}' || {crlf} || 'source-payload-digest: ' || source_digest || {crlf} || 'source-payload-length: ' || strlen(payload) || {crlf}
  || 'source-status: HTTP/1.1 200 OK' || {crlf} || 'source-header-Content-Type: text/html; charset=utf-8' || {crlf} || 'source-header-Content-Length: ' || strlen(payload) || {crlf}
  || 'title: ' || title || {crlf} || 'outlinks: ' || (len(regexp_split_to_array(payload, '(?i)<a\\s[^>]*href\\s*=')) - 1) || {crlf} AS block FROM i
  UNION ALL SELECT page_id, refers_to, target_uri, source_digest, 'conversion', 'text/plain; charset=utf-8',
  trim(regexp_replace(regexp_replace({decode('bare')}, '[ \\t\\r\\f\\x{{A0}}]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) FROM i),
d AS (SELECT *, md5(refers_to || '|' || record_type) AS h FROM b)
SELECT page_id, record_type, {uuid('h')} AS record_id, refers_to, target_uri, '{DERIVED_AT}' AS date, content_type, strlen(block)::BIGINT AS content_length,
  'sha256:' || sha256(block) AS block_digest, source_digest, block FROM d
"""
