"""The same results as ``veil_queries`` in DuckDB SQL.

DuckDB's regular expressions know no look-around and count ``\\b \\d \\w`` as
ASCII, so a few rules are stated differently here: an alternation instead of a
look-ahead, or a condition on the text beside the match.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# --- tables ------------------------------------------------------------------

LETTERS = """letters AS (
  SELECT c.c_custkey AS doc_id, c.c_name, n.n_name,
  'Op ' || lpad(CAST(1 + c.c_custkey % 28 AS VARCHAR), 2, '0') || '-'
        || lpad(CAST(1 + c.c_custkey % 12 AS VARCHAR), 2, '0') || '-'
        || CAST(1990 + c.c_custkey % 30 AS VARCHAR)
  || ' schreef ' || c.c_name || ' uit ' || n.n_name
  || ' (BSN: ' || lpad(CAST((c.c_custkey * 7919 + 123456782) % 1000000000 AS VARCHAR), 9, '0')
  || '). Mail: klant' || CAST(c.c_custkey AS VARCHAR) || '@voorbeeld.nl, tel 06'
  || lpad(CAST((c.c_custkey * 104729) % 100000000 AS VARCHAR), 8, '0')
  || '. IBAN: NL91ABNA' || lpad(CAST((c.c_custkey * 1299709 + 417164300) % 10000000000 AS VARCHAR), 10, '0')
  || '. KvK: ' || lpad(CAST((c.c_custkey * 15485863 + 12345678) % 100000000 AS VARCHAR), 8, '0')
  || ', btw NL' || lpad(CAST((c.c_custkey * 32452843 + 123456789) % 1000000000 AS VARCHAR), 9, '0') || 'B01'
  || ', zaak Z-2023-' || lpad(CAST(c.c_custkey % 100000 AS VARCHAR), 5, '0')
  || ', kenteken AB-' || lpad(CAST(c.c_custkey % 100 AS VARCHAR), 2, '0') || '-CD'
  || ', paspoort ZX' || lpad(CAST(1000000 + c.c_custkey AS VARCHAR), 7, '0')
  || ', postcode ' || CAST(1000 + c.c_custkey % 9000 AS VARCHAR) || ' AB'
  || ', IP 192.168.' || CAST(c.c_custkey % 256 AS VARCHAR) || '.1'
  || ', MAC AA:BB:CC:DD:EE:' || lpad(CAST(c.c_custkey % 100 AS VARCHAR), 2, '0') || '.' AS text
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey)"""

DOSSIERS = """dossiers AS (
  SELECT o_orderkey AS doc_id,
  'Dossier WOO-2023-' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')
  || ' en C/13/' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0')
  || ', AWB 21/' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')
  || ', HR 22/' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')
  || ', hof 200.' || lpad(CAST(o_orderkey % 100000 AS VARCHAR), 5, '0')
  || ', parket 08/' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '-23'
  || ', RBAMS 20/' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0')
  || ', zaak ' || lpad(CAST(o_orderkey % 100000000 AS VARCHAR), 8, '0') || '-12ab-34cd-56ef-0123456789ab'
  || ', BAG 0363' || lpad(CAST(o_orderkey % 1000000000000 AS VARCHAR), 12, '0')
  || '. Rekening DE' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') || ' 3704 0044 0532 '
  || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') || ' 00'
  || '; document XY' || CAST(111111 + o_custkey % 8 AS VARCHAR) || '7'
  || '; gezien 2021-0' || CAST(1 + o_orderkey % 9 AS VARCHAR) || '-1' || CAST(o_orderkey % 10 AS VARCHAR)
  || ', 1' || CAST(o_orderkey % 10 AS VARCHAR) || ' 0' || CAST(1 + o_orderkey % 9 AS VARCHAR) || ' 24'
  || ' en ' || CAST(1 + o_orderkey % 28 AS VARCHAR) || ' september 2020'
  || '; apparaat A0-B1-C2-D3-E4-' || lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')
  || ' en 00AA.11BB.' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || ' klaar.' AS text
  FROM orders)"""

# --- patterns: name -> (type, score, expression, condition) -------------------

_DAY = "(?:0?[1-9]|[12][0-9]|3[01])"
_MONTH = "(?:0?[1-9]|1[0-2])"
_YEAR = "(?:19|20)[0-9]{2}"
_HEX = "[0-9A-Fa-f]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PLATES = (
    "XX-99-99", "99-99-XX", "99-XX-99", "XX-99-XX", "XX-XX-99", "99-XX-XX", "99-XXX-9",
    "9-XXX-99", "XX-999-X", "X-999-XX", "XXX-99-X", "X-99-XXX", "9-XX-999", "999-XX-9",
)
_PLATE = "|".join(p.replace("X", "[A-Z]").replace("9", r"\d") for p in _PLATES)

PATTERNS = {
    "DUTCH_PHONE": ("PHONE_NUMBER", 0.6, r"(?:\b0|\B\+31|\b0031)[- ]?(?:[0-9][- ]?){9}\b", None),
    "DUTCH_IBAN": ("IBAN", 0.6, r"\bNL[0-9]{2}\s?[A-Z]{4}\s?(?:[0-9]{10}|[0-9]{4}\s?[0-9]{4}\s?[0-9]{2})\b", None),
    "INTL_IBAN": ("IBAN", 0.55, r"\b(?:[A-MO-Z][A-Z]|N[A-KM-Z])[0-9]{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b", None),
    "EMAIL_ADDRESS": ("EMAIL", 0.6, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b", None),
    "NL_BSN": ("BSN", 0.6, r"\b[0-9]{3}[- ]?[0-9]{3}[- ]?[0-9]{3}\b", None),
    "NL_POSTCODE": ("POSTCODE", 0.55, r"\b[1-9][0-9]{3}\s?(?:[A-HJ-NP-RT-Z][A-HJ-NP-Z]|S[BCE-HJ-NP-RT-Z])\b",
                    r"NOT regexp_matches(before, '[0-9][-/.]$')"),
    "NL_VAT": ("VAT_NUMBER", 0.6, r"\bNL[0-9]{9}B[0-9]{2}\b", None),
    "KVK_8_DIGIT": ("KVK_NUMBER", 0.45, r"\b[0-9]{8}\b", r"NOT regexp_matches(before, '[0-9][/ ]$')"),
    "NL_PLATE": ("LICENSE_PLATE", 0.5, rf"\b(?:{_PLATE})\b", None),
    "IPV4": ("IP_ADDRESS", 0.5, rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b", None),
    "DATE_DD_MM_YYYY": ("DATE_TIME", 0.5, rf"\b{_DAY}[-/.]{_MONTH}[-/.]{_YEAR}\b", None),
    "DATE_MM_DD_YYYY": ("DATE_TIME", 0.5, rf"\b{_MONTH}[-/.]{_DAY}[-/.]{_YEAR}\b", None),
    "DATE_YYYY_MM_DD": ("DATE_TIME", 0.5, rf"\b{_YEAR}[-/.]{_MONTH}[-/.]{_DAY}\b", None),
    "DATE_DD_MM_YY": ("DATE_TIME", 0.45, rf"\b{_DAY}[\s/.-]{_MONTH}[\s/.-][0-9]{{2}}\b",
                      r"NOT regexp_matches(after, '^\.[0-9]')"),
    "DATE_DD_MONTH_YYYY": (
        "DATE_TIME", 0.5,
        rf"(?i)\b{_DAY}\s+(?:januari|februari|maart|april|mei|juni|juli|augustus|september|oktober|november|december)\s+{_YEAR}\b",
        None),
    "NL_DOC_OLD": ("ID_NO", 0.55, r"\b[A-NP-Z]{2}[A-NP-Z0-9]{6}[0-9]\b", None),
    "NL_DOC_NEW": ("ID_NO", 0.6, r"\b[A-NP-Z]{2}[A-NP-Z1-9]{6}[1-9]\b", None),
    "CASE_Z": ("CASE_NO", 0.55, r"\bZ[-/]?[0-9]{4}[-/]?[0-9]{4,6}\b", None),
    "CASE_PREFIXED": ("CASE_NO", 0.6, r"\b(?:WOO|BEZWAAR|INT|VTH|WP)[-/]?[0-9]{4}[-/]?[0-9]{3,6}\b", None),
    "CASE_YEAR_NUMBER": ("CASE_NO", 0.45, r"\b[0-9]{4}[-/][0-9]{4,6}\b", None),
    "CASE_BAG_ID": ("CASE_NO", 0.4, r"\b[0-9]{16}\b", None),
    "CASE_UUID": ("CASE_NO", 0.35, rf"\b{_HEX}{{8}}-(?:{_HEX}{{4}}-){{3}}{_HEX}{{12}}\b", None),
    "CASE_C_CIVIL": ("CASE_NO", 0.55, r"\bC/[0-9]{2}/[0-9]{5,8}\b", None),
    "CASE_AWB": ("CASE_NO", 0.6, r"\bAWB\s?[0-9]{2}/[0-9]{3,6}\b", None),
    "CASE_HR": ("CASE_NO", 0.6, r"\bHR\s?[0-9]{2}/[0-9]{5}\b", None),
    "CASE_GERECHTSHOF": ("CASE_NO", 0.55, r"\b200\.[0-9]{5}\b", None),
    "CASE_OM": ("CASE_NO", 0.6, r"\b[0-9]{2}/[0-9]{6}-[0-9]{2}\b", None),
    "CASE_COURT_GENERIC": ("CASE_NO", 0.55, r"\b[A-Z]{4,5}\s?[0-9]{2}/[0-9]{3,6}\b", None),
    "MAC_COLON": ("MAC_ADDRESS", 0.9, rf"\b(?:{_HEX}{{2}}:){{5}}{_HEX}{{2}}\b", None),
    "MAC_DASH": ("MAC_ADDRESS", 0.9, rf"\b(?:{_HEX}{{2}}-){{5}}{_HEX}{{2}}\b", None),
    "MAC_CISCO_DOT": ("MAC_ADDRESS", 0.85, rf"\b(?:{_HEX}{{4}}\.){{2}}{_HEX}{{4}}\b", None),
    "NL_DRIVERS_LICENSE": ("DRIVERS_LICENSE", 0.45, r"\b[0-9]{10}\b", None),
}
DEFAULTS = ("PHONE_NUMBER", "EMAIL", "IBAN", "BSN", "DATE_TIME")
CLASSIC = tuple(p for p in PATTERNS if p != "NL_POSTCODE")


def _chars(pieces: str) -> str:
    return f"coalesce(CAST(list_sum([length(x) for x in {pieces}]) AS INTEGER), 0)"


def hits(name: str, source: str, ids: str = "doc_id", insensitive: bool = False) -> str:
    """Every match of one pattern with offsets, type and score."""
    kind, score, rx, cond = PATTERNS[name]
    rx = rx.replace("'", "''")
    if insensitive and not rx.startswith("(?i)"):
        rx = "(?i)" + rx
    start = f"{_chars('gaps[1:i]')} + {_chars('found[1:i - 1]')}"
    where = f" WHERE {cond}" if cond else ""
    checks = f" {'AND' if cond else 'WHERE'} {bsn('text')}" if kind == "BSN" else ""
    return f"""SELECT {ids}, '{kind}' AS entity_type, start, start + CAST(length(text) AS INTEGER) AS "end",
      CAST({score} AS DOUBLE) AS score, text, '{name}' AS pattern FROM (
      SELECT {ids}, found[i] AS text, gaps[i] AS before, gaps[i + 1] AS after, {start} AS start FROM (
        SELECT {ids}, gaps, found, unnest(range(1, len(found) + 1)) AS i FROM (
          SELECT {ids}, string_split_regex(text, '{rx}') AS gaps, regexp_extract_all(text, '{rx}') AS found
          FROM {source} WHERE regexp_matches(text, '{rx}')))){where}{checks}"""


def bsn(value: str) -> str:
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    digit = lambda i: f"CAST(substr({d}, {i}, 1) AS INTEGER)"
    total = " + ".join(f"{10 - i} * {digit(i)}" for i in range(1, 9))
    return f"(length({d}) = 9 AND {digit(9)} = ({total}) % 11)"


def names_of(kinds=None, patterns=tuple(PATTERNS)):
    return [p for p in patterns if kinds is None or PATTERNS[p][0] in kinds]


def found_cte(source: str, kinds=None, patterns=tuple(PATTERNS), ids: str = "doc_id", name: str = "found",
              insensitive: bool = False) -> str:
    """CTE ``found``: matches of the chosen types without same-type duplicates."""
    raw = "\nUNION ALL ".join(hits(p, source, ids, insensitive) for p in names_of(kinds, patterns))
    same = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in ids.split(","))
    return f"""{name}_raw AS ({raw}),
    {name}_one AS (SELECT * FROM {name}_raw QUALIFY row_number() OVER (
      PARTITION BY {ids}, entity_type, start, "end" ORDER BY score DESC, pattern) = 1),
    {name} AS (SELECT a.* FROM {name}_one a WHERE NOT EXISTS (SELECT 1 FROM {name}_one b WHERE {same}
      AND a.entity_type = b.entity_type AND b.start <= a.start AND b."end" >= a."end" AND b.score >= a.score
      AND (b.start <> a.start OR b."end" <> a."end")))"""


# Texts without surrounding white space; only ASCII space occurs in the data.
DOCS = "docs AS (SELECT doc_id, trim(text, E' \\t\\n\\r\\f') AS text FROM documents WHERE trim(text, E' \\t\\n\\r\\f') <> '')"
SPAN = 'entity_type, start, "end", score, text'

# --- the scan ------------------------------------------------------------------

ORACLE["scan_documents"] = f"WITH {DOCS}, {found_cte('docs')} SELECT doc_id, {SPAN}, pattern FROM found"
ORACLE["scan_letters"] = f"WITH {LETTERS}, {found_cte('letters')} SELECT doc_id, {SPAN}, pattern FROM found"
ORACLE["scan_dossiers"] = f"WITH {DOSSIERS}, {found_cte('dossiers')} SELECT doc_id, {SPAN}, pattern FROM found"
ORACLE["scan_letters_insensitive"] = (
    f"WITH {LETTERS}, {found_cte('letters', insensitive=True)} SELECT doc_id, {SPAN}, pattern FROM found")
for _kind in dict.fromkeys(k for k, *_ in PATTERNS.values()):
    ORACLE[f"find_{_kind.lower()}"] = (
        f"WITH {LETTERS}, {found_cte('letters', [_kind])} SELECT doc_id, {SPAN}, pattern FROM found")

IN_DOSSIERS = (
    "INTL_IBAN", "NL_DOC_NEW", "DATE_YYYY_MM_DD", "DATE_DD_MM_YY", "DATE_DD_MONTH_YYYY", "CASE_PREFIXED",
    "CASE_BAG_ID", "CASE_UUID", "CASE_C_CIVIL", "CASE_AWB", "CASE_HR", "CASE_GERECHTSHOF", "CASE_OM",
    "CASE_COURT_GENERIC", "MAC_DASH", "MAC_CISCO_DOT",
)
for _name in PATTERNS:
    _cte, _table = (DOSSIERS, "dossiers") if _name in IN_DOSSIERS else (LETTERS, "letters")
    _sql = hits(_name, "texts").replace(" WHERE " + bsn("text"), "")  # the bare pattern, without its check
    ORACLE[f"pattern_{_name.lower()}"] = (
        f"WITH {_cte}, texts AS (SELECT doc_id, text FROM {_table} UNION ALL SELECT -doc_id - 1, text FROM documents) "
        f'SELECT doc_id, start, "end", text FROM ({_sql})')

ORACLE["valid_bsn"] = f"""
  SELECT c_custkey, bsn, {bsn('bsn')} AS ok, {bsn('name')} AS ok_name FROM (
    SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 123456782) % 1000000000 AS VARCHAR), 9, '0') AS bsn,
           lpad(CAST(c_custkey * 31 AS VARCHAR), 9, '0') AS name FROM customer)"""
ORACLE["scan_conversations"] = f"""WITH turns AS (SELECT conv_id, turn, trim(text, E' \\t\\n\\r\\f') AS text FROM conversations),
  {found_cte('turns', patterns=CLASSIC, ids='conv_id, turn')} SELECT conv_id, turn, {SPAN} FROM found"""
ORACLE["scan_pages"] = f"""WITH p AS (SELECT page_id, trim(html, E' \\t\\n\\r\\f') AS text FROM pages),
  {found_cte('p', DEFAULTS, ids='page_id')} SELECT page_id, {SPAN} FROM found"""
ORACLE["scan_benchmark"] = f"""WITH b AS (SELECT item_id, trim(text, E' \\t\\n\\r\\f') AS text FROM benchmark),
  {found_cte('b', patterns=CLASSIC, ids='item_id')}
  SELECT b.item_id, CAST(length(b.text) AS INTEGER) AS text_length, 'nl' AS language,
    CAST((SELECT count(*) FROM found f WHERE f.item_id = b.item_id) AS INTEGER) AS n FROM b WHERE b.text <> ''"""

# --- responses, validation, filters ---------------------------------------------

_ORDER = 'score DESC, start, "end" DESC, entity_type'
_LETTER_DEFAULTS = f"WITH {LETTERS}, {found_cte('letters', DEFAULTS)}"
ORACLE["analyze_letters"] = f"""{_LETTER_DEFAULTS}
  SELECT l.doc_id, CAST(length(l.text) AS INTEGER) AS text_length, 'nl' AS language,
    CAST(count(f.start) AS INTEGER) AS n,
    coalesce(string_agg(f.entity_type || ':' || f.start || ':' || f."end", '|' ORDER BY {_ORDER.replace('score', 'f.score').replace('start', 'f.start')
      .replace('"end"', 'f."end"').replace('entity_type', 'f.entity_type')}), '') AS entities
  FROM letters l LEFT JOIN found f ON l.doc_id = f.doc_id GROUP BY l.doc_id, l.text"""
_PADDED = f"""WITH {LETTERS}, padded AS (SELECT doc_id,
    CASE WHEN doc_id % 10 = 0 THEN E' \\t\\n ' WHEN doc_id % 10 = 1 THEN NULL WHEN doc_id % 10 = 2 THEN ''
      ELSE E'\\t ' || text || E' \\n\\n' END AS raw, text,
    CASE doc_id % 7 WHEN 0 THEN 'fr' WHEN 1 THEN 'en' WHEN 2 THEN NULL ELSE 'nl' END AS language,
    CASE doc_id % 11 WHEN 0 THEN 'shred' WHEN 1 THEN 'mask' END AS strategy FROM letters)"""
ORACLE["valid_rows"] = f"""{_PADDED} SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length,
  coalesce(language, 'nl') AS language FROM padded
  WHERE doc_id % 10 > 2 AND coalesce(language, 'nl') <> 'fr' AND coalesce(strategy, 'replace') <> 'shred'"""
ORACLE["rejected"] = f"""{_PADDED} SELECT doc_id, CASE WHEN doc_id % 10 <= 2 THEN 'text cannot be empty'
    WHEN language = 'fr' THEN 'unsupported language' ELSE 'unsupported strategy' END AS reason FROM padded
  WHERE doc_id % 10 <= 2 OR coalesce(language, 'nl') = 'fr' OR coalesce(strategy, 'replace') = 'shred'"""
ORACLE["checked_write"] = f"""{_PADDED}, r AS (SELECT CASE WHEN doc_id % 10 <= 2 THEN 'text cannot be empty'
    WHEN coalesce(language, 'nl') = 'fr' THEN 'unsupported language'
    WHEN coalesce(strategy, 'replace') = 'shred' THEN 'unsupported strategy' ELSE 'valid' END AS reason, text FROM padded)
  SELECT CASE reason WHEN 'valid' THEN 'valid' ELSE 'rejected' END AS outcome, reason, count(*) AS n, count(*) AS seen,
    CAST(sum(CASE reason WHEN 'valid' THEN length(text) ELSE 0 END) AS BIGINT) AS chars FROM r GROUP BY ALL"""
ORACLE["stripped_texts"] = (
    "SELECT doc_id, CAST(length(trim(text, E' \\t\\n\\r\\f')) AS INTEGER) AS text_length FROM documents")
ORACLE["default_entities"] = f"{_LETTER_DEFAULTS} SELECT entity_type, count(*) AS n FROM found GROUP BY ALL"
ORACLE["entity_filter"] = f"""WITH {LETTERS}, {found_cte('letters', ['IBAN', 'EMAIL', 'KVK_NUMBER'])}
  SELECT entity_type, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start FROM found GROUP BY entity_type"""
_LETTER_CLASSIC = f"WITH {LETTERS}, {found_cte('letters', patterns=CLASSIC)}"
_LETTER_ALL = f"WITH {LETTERS}, {found_cte('letters')}"
ORACLE["score_threshold"] = (
    f"{_LETTER_CLASSIC} SELECT entity_type, score, count(*) AS n FROM found WHERE score >= 0.5 GROUP BY ALL")
ORACLE["profile_gpu"] = f"WITH {LETTERS}, {found_cte('letters', ['MAC_ADDRESS'])} SELECT doc_id, {SPAN} FROM found"
ORACLE["trimmed_spans"] = f"""WITH {LETTERS}, {found_cte('letters', ['PHONE_NUMBER'])}
  SELECT doc_id, entity_type, start, CAST(start + length(rtrim(text, ' -')) AS INTEGER) AS "end", score,
    rtrim(text, ' -') AS text FROM found"""
ORACLE["score_sanity"] = (
    f'{_LETTER_ALL} SELECT count(*) AS bad FROM found WHERE NOT (score > 0 AND score <= 1 AND start >= 0 AND "end" > start)')
_CATALOGUE = ", ".join(f"('{k}', '{p}', CAST({s} AS DOUBLE))" for p, (k, s, *_r) in PATTERNS.items())
ORACLE["catalogue_coverage"] = f"""{_LETTER_ALL}, c(entity_type, pattern, score) AS (VALUES {_CATALOGUE})
  SELECT c.entity_type, c.pattern, c.score, count(f.doc_id) AS n FROM c LEFT JOIN found f ON c.pattern = f.pattern
  GROUP BY ALL"""

# --- span sets -------------------------------------------------------------------

_DATES = f"WITH {LETTERS}, {found_cte('letters', ['DATE_TIME'])}"
ORACLE["dedup_rows"] = f'{_DATES} SELECT doc_id, entity_type, start, "end", score FROM found'

_SYNTH = """WITH synth AS (SELECT DISTINCT l_orderkey AS doc_id,
    CASE l_linenumber % 4 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PERSON' WHEN 2 THEN 'IBAN' ELSE 'LOCATION' END AS entity_type,
    CAST(l_partkey % 60 AS INTEGER) AS start, CAST(l_partkey % 60 + 1 + l_suppkey % 13 AS INTEGER) AS "end",
    CAST(CASE l_suppkey % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.5 ELSE 0.6 END AS DOUBLE) AS score FROM lineitem)"""
_KEPT = """FROM {t} s WHERE NOT (s.entity_type IN ('PERSON', 'LOCATION', 'ORGANIZATION') AND EXISTS (
    SELECT 1 FROM {t} p WHERE p.doc_id = s.doc_id AND p.entity_type IN ('EMAIL', 'IBAN')
    AND s.start < p."end" AND s."end" > p.start))"""
ORACLE["ner_overlap_rows"] = (
    _SYNTH.replace("SELECT DISTINCT", "SELECT") + " SELECT entity_type, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start "
    + _KEPT.format(t="synth") + " GROUP BY entity_type")
ORACLE["ner_overlap_arrays"] = _SYNTH + ' SELECT doc_id, entity_type, start, "end", score ' + _KEPT.format(t="synth")
ORACLE["dedup_arrays"] = _SYNTH + """, one AS (SELECT doc_id, entity_type, start, "end", max(score) AS score
    FROM synth GROUP BY ALL) SELECT a.* FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE a.doc_id = b.doc_id
    AND a.entity_type = b.entity_type AND b.start <= a.start AND b."end" >= a."end" AND b.score >= a.score
    AND (b.start <> a.start OR b."end" <> a."end"))"""
_MERGED = _SYNTH + """, edges AS (SELECT *, coalesce(start >= max("end") OVER (PARTITION BY doc_id, entity_type
      ORDER BY start, "end" DESC, score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS opens FROM synth),
  numbered AS (SELECT *, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id, entity_type
      ORDER BY start, "end" DESC, score DESC ROWS UNBOUNDED PRECEDING) AS island FROM edges),
  merged AS (SELECT doc_id, entity_type, min(start) AS start, max("end") AS "end", max(score) AS score
      FROM numbered GROUP BY doc_id, entity_type, island)"""
ORACLE["merge_rows"] = ORACLE["merge_arrays"] = _MERGED + " SELECT * FROM merged"
_RESOLVE = """, outer_spans AS (SELECT a.* FROM merged a WHERE NOT EXISTS (SELECT 1 FROM merged b WHERE b.doc_id = a.doc_id
    AND ((b.start = a.start AND b."end" = a."end" AND (b.score > a.score OR (b.score = a.score AND b.entity_type < a.entity_type)))
      OR (b.start <= a.start AND b."end" >= a."end" AND (b.start <> a.start OR b."end" <> a."end"))))),
  resolved AS (SELECT doc_id, entity_type, start, CAST(least("end", coalesce(lead(start) OVER (
    PARTITION BY doc_id ORDER BY start), "end")) AS INTEGER) AS "end", score FROM outer_spans)"""
ORACLE["resolve_rows"] = ORACLE["resolve_arrays"] = _MERGED + _RESOLVE + " SELECT * FROM resolved"
ORACLE["result_order"] = f"""{_LETTER_CLASSIC} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id
  ORDER BY {_ORDER}) - 1 AS INTEGER) AS pred_idx, entity_type, start, "end" FROM found"""
ORACLE["overlapping_pairs"] = f"""{_LETTER_ALL} SELECT a.entity_type, b.entity_type AS other_type, count(*) AS n
  FROM found a JOIN found b ON a.doc_id = b.doc_id AND a.entity_type < b.entity_type AND a.start < b."end" AND a."end" > b.start
  GROUP BY ALL"""

# --- anonymization ----------------------------------------------------------------

WANTED = ("EMAIL", "IBAN", "IP_ADDRESS", "MAC_ADDRESS")
_MASK = "repeat('*', CAST(least(6, length({v})) AS INTEGER)) || substr({v}, 7)"


def rewritten(source: str, merged: str, value_sql: str, ids: str = "doc_id") -> str:
    """Text of ``source`` with the disjoint spans of ``merged`` replaced."""
    return f"""cuts AS (SELECT s.{ids}, s.start, s."end", s.entity_type, substr(t.text, s.start + 1, s."end" - s.start) AS v,
      t.text AS whole, coalesce(lag(s."end") OVER (PARTITION BY s.{ids} ORDER BY s.start), 0) AS before
      FROM {merged} s JOIN {source} t ON s.{ids} = t.{ids}),
    joined AS (SELECT {ids}, string_agg(substr(whole, before + 1, start - before) || {value_sql}, '' ORDER BY start)
      || substr(any_value(whole), max("end") + 1) AS anonymized_text FROM cuts GROUP BY {ids})"""


def _anonymized(value_sql: str, kinds=WANTED, cte: str = LETTERS, source: str = "letters") -> str:
    return f"""WITH {cte}, {found_cte(source, kinds)}, {rewritten(source, 'found', value_sql)}
      SELECT t.doc_id, coalesce(j.anonymized_text, t.text) AS anonymized_text
      FROM {source} t LEFT JOIN joined j ON t.doc_id = j.doc_id"""


ORACLE["anonymize_replace"] = _anonymized("('<' || entity_type || '>')")
ORACLE["anonymize_redact"] = _anonymized("''")
ORACLE["anonymize_hash"] = _anonymized("sha256(v)")
ORACLE["anonymize_mask"] = _anonymized(f"({_MASK.format(v='v')})")
ORACLE["anonymize_hash_salted"] = _anonymized("sha256('zout' || v)")
ORACLE["anonymize_per_type"] = _anonymized(
    "(CASE entity_type WHEN 'EMAIL' THEN sha256(v) WHEN 'IBAN' THEN " + _MASK.format(v="v")
    + " WHEN 'MAC_ADDRESS' THEN '' ELSE '<' || entity_type || '>' END)")
ORACLE["anonymize_documents_email"] = _anonymized("('<' || entity_type || '>')", ["EMAIL"], DOCS, "docs")


def _resolved_from(found: str) -> str:
    body = (_MERGED + _RESOLVE)[len("WITH synth AS ("):]
    rest = body[body.index(", edges AS ("):]
    return f"synth AS (SELECT DISTINCT doc_id, entity_type, start, \"end\", score FROM {found}){rest}"


def _anonymized_all(cte: str, source: str, patterns) -> str:
    replaced = rewritten(source, "resolved", "('<' || entity_type || '>')")
    return f"WITH {cte}, {found_cte(source, patterns=patterns)}, {_resolved_from('found')}, {replaced}"


ORACLE["anonymize_all"] = _anonymized_all(LETTERS, "letters", CLASSIC) + """
  SELECT t.doc_id, coalesce(j.anonymized_text, t.text) AS anonymized_text
  FROM letters t LEFT JOIN joined j ON t.doc_id = j.doc_id"""
ORACLE["anonymize_documents"] = _anonymized_all(DOCS, "docs", tuple(PATTERNS)) + """
  SELECT t.doc_id, coalesce(j.anonymized_text, t.text) AS anonymized_text, CAST(length(t.text) AS INTEGER) AS text_length,
    'replace' AS anonymization_strategy, CAST((SELECT count(*) FROM found f WHERE f.doc_id = t.doc_id) AS INTEGER) AS n
  FROM docs t LEFT JOIN joined j ON t.doc_id = j.doc_id"""
ORACLE["entities_found"] = f"WITH {LETTERS}, {found_cte('letters', WANTED)} SELECT doc_id, {SPAN} FROM found"

# --- names -------------------------------------------------------------------------

# A customer name holds '#', so as words it is 'Customer 000000123'.
_PLACE = """SELECT doc_id, 'LOCATION' AS entity_type, CAST(instr(text, n_name) - 1 AS INTEGER) AS start,
  CAST(instr(text, n_name) - 1 + length(n_name) AS INTEGER) AS "end", CAST(0.85 AS DOUBLE) AS score, n_name AS text FROM letters"""
_PERSON = """SELECT doc_id, 'PERSON' AS entity_type, CAST(instr(text, c_name) - 1 AS INTEGER) AS start,
  CAST(instr(text, c_name) - 1 + length(c_name) AS INTEGER) AS "end", CAST(0.85 AS DOUBLE) AS score, c_name AS text FROM letters"""
ORACLE["union_spans"] = f"""WITH {LETTERS}, {found_cte('letters', ['EMAIL', 'IP_ADDRESS'])}
  SELECT doc_id, entity_type, start, "end", score FROM found UNION ALL
  SELECT doc_id, entity_type, start, "end", score FROM ({_PLACE})"""
ORACLE["dictionary_names"] = f"""WITH {LETTERS} SELECT doc_id, entity_type, start, "end", score FROM ({_PLACE}) UNION ALL
  SELECT doc_id, entity_type, start, "end", score FROM ({_PERSON})"""
ORACLE["dictionary_large"] = ORACLE["dictionary_names"]
ORACLE["dictionary_own_types"] = f"""WITH {LETTERS}, {found_cte('letters', ['EMAIL'])}
  SELECT doc_id, {SPAN} FROM found UNION ALL
  SELECT doc_id, 'DEVICE', CAST(instr(text, 'MAC AA') - 1 AS INTEGER), CAST(instr(text, 'MAC AA') + 20 AS INTEGER),
    CAST(0.85 AS DOUBLE), substr(text, instr(text, 'MAC AA'), 21) FROM letters
  WHERE doc_id % 100 IN (SELECT c_custkey % 50 FROM customer)"""
_TAIL = "13 + length(c_name) + length(n_name)"
ORACLE["dictionary_long_names"] = f"""WITH {LETTERS}, p AS (SELECT doc_id, CAST(instr(text, 'schreef') - 1 AS INTEGER) AS start,
    CASE doc_id % 6 WHEN 0 THEN 7 WHEN 1 THEN 8 + length(c_name) WHEN 2 THEN 12 + length(c_name)
      WHEN 3 THEN {_TAIL} WHEN 4 THEN {_TAIL} + 16 ELSE {_TAIL} + 23 END AS size FROM letters)
  SELECT doc_id, 'PERSON' AS entity_type, start, CAST(start + size AS INTEGER) AS "end", CAST(0.85 AS DOUBLE) AS score FROM p"""
ORACLE["custom_recognizer"] = f"""WITH {LETTERS}, p AS (SELECT doc_id, instr(text, 'paspoort') AS place, text FROM letters)
  SELECT doc_id, 'PASS_NOTE' AS entity_type, CAST(place - 1 AS INTEGER) AS start, CAST(place + 17 AS INTEGER) AS "end",
    CAST(0.7 AS DOUBLE) AS score, substr(text, place, 18) AS text FROM p"""
ORACLE["analyze_with_dictionary"] = f"""{_LETTER_DEFAULTS}, spans AS (SELECT doc_id, {SPAN} FROM found
    UNION ALL {_PLACE} UNION ALL {_PERSON})
  SELECT doc_id, {SPAN} FROM spans s WHERE NOT (entity_type IN ('PERSON', 'LOCATION') AND EXISTS (
    SELECT 1 FROM found p WHERE p.doc_id = s.doc_id AND s.start < p."end" AND s."end" > p.start))"""
ORACLE["stream_names"] = ORACLE["analyze_with_dictionary"]
ORACLE["external_spans"] = f"""WITH {LETTERS}, {found_cte('letters', ['EMAIL'])}
  SELECT doc_id, {SPAN}, 'EmailRecognizer' AS recognizer FROM found UNION ALL
  SELECT doc_id, {SPAN}, 'external' FROM ({_PLACE})"""
ORACLE["label_map"] = """SELECT label, CASE WHEN label IN ('PER', 'PERSON') THEN 'PERSON' WHEN label IN ('LOC', 'GPE') THEN 'LOCATION'
    WHEN label = 'ORG' THEN 'ORGANIZATION' ELSE label END AS entity_type, count(*) AS n
  FROM (SELECT ['PER', 'GPE', 'LOC', 'ORG', 'NORP', 'PERSON', 'DATE'][o_orderkey % 7 + 1] AS label FROM orders) GROUP BY ALL"""
ORACLE["zero_shot_label_map"] = """SELECT label, CASE label WHEN 'persoon' THEN 'PERSON' WHEN 'wijk' THEN 'LOCATION'
    WHEN 'adres' THEN 'STREET_ADDRESS' WHEN 'religie' THEN 'NORP' WHEN 'werkgever' THEN 'ORGANIZATION'
    WHEN 'salaris' THEN 'INCOME' WHEN 'opleiding' THEN 'EDUCATION_LEVEL' ELSE label END AS entity_type, count(*) AS n
  FROM (SELECT ['persoon', 'wijk', 'adres', 'religie', 'werkgever', 'salaris', 'opleiding', 'x'][o_orderkey % 8 + 1] AS label
        FROM orders) GROUP BY ALL"""
ORACLE["model_detector"] = f"""WITH {LETTERS}, {found_cte('letters', ['IBAN'])}
  SELECT doc_id, {SPAN}, 'DutchIBANRecognizer' AS recognizer FROM found UNION ALL
  SELECT doc_id, {SPAN}, 'spacy' FROM ({_PERSON})"""
_ZERO_SHOT = (
    ("PERSON", "persoon naam"), ("LOCATION", "locatie woonplaats gpe gemeente stad wijk buurt"),
    ("STREET_ADDRESS", "straatnaam adres"), ("NORP", "nationaliteit religie politieke_groep"), ("POLITICAL_PARTY", "politieke_partij"),
    ("ORGANIZATION", "organisatie werkgever bedrijf"), ("INCOME", "inkomen salaris"), ("EDUCATION_LEVEL", "opleidingsniveau opleiding"))
_ZERO_LABELS = ", ".join(f"'{label}'" for _, labels in _ZERO_SHOT for label in labels.split())
ORACLE["zero_shot_labels"] = f"""SELECT label, CASE {' '.join(
    f"WHEN label IN ({', '.join(chr(39) + x + chr(39) for x in labels.split())}) THEN '{kind}'" for kind, labels in _ZERO_SHOT)}
    ELSE label END AS entity_type, count(*) AS n
  FROM (SELECT [{_ZERO_LABELS}, 'x'][o_orderkey % 23 + 1] AS label FROM orders) GROUP BY ALL"""
ORACLE["two_detectors"] = f"""WITH {LETTERS}, {found_cte('letters', ['IBAN'])}
  SELECT doc_id, {SPAN}, 'DutchIBANRecognizer' AS recognizer FROM found UNION ALL
  SELECT doc_id, {SPAN}, 'spacy' FROM ({_PERSON}) UNION ALL SELECT doc_id, {SPAN}, 'places' FROM ({_PLACE})"""
ORACLE["context_boost"] = f"""WITH {LETTERS}, {found_cte('letters', ['KVK_NUMBER', 'VAT_NUMBER'])}
  SELECT doc_id, entity_type, start, "end", round(CASE entity_type WHEN 'KVK_NUMBER' THEN 0.8 ELSE
    0.6 END, 6)::DOUBLE AS score FROM found"""
ORACLE["context_boost_some"] = f"""WITH {LETTERS}, {found_cte('letters', ['BSN', 'DATE_TIME', 'EMAIL'])}
  SELECT f.doc_id, f.entity_type, f.start, f."end", round(CASE WHEN f.entity_type = 'BSN' AND lower(l.n_name) IN ('germany', 'france', 'china')
    THEN 0.95 ELSE f.score END, 6)::DOUBLE AS score FROM found f JOIN letters l ON l.doc_id = f.doc_id"""
ORACLE["verified_spans"] = f"""WITH {LETTERS}, {found_cte('letters', ['ID_NO', 'BSN'])}
  SELECT doc_id, {SPAN} FROM found WHERE entity_type <> 'ID_NO' OR regexp_matches(text, '[02468]$')"""

ORACLE["verified_by_model"] = ORACLE["verified_spans"]
ORACLE["config_profile"] = f"""WITH {LETTERS}, {found_cte('letters', ['EMAIL', 'MAC_ADDRESS'])}
  SELECT doc_id, {SPAN} FROM found UNION ALL
  SELECT doc_id, 'PASS_NOTE', CAST(instr(text, 'paspoort') - 1 AS INTEGER), CAST(instr(text, 'paspoort') + 17 AS INTEGER),
    CAST(0.7 AS DOUBLE), substr(text, instr(text, 'paspoort'), 18) FROM letters"""
ORACLE["sql_spans_table"] = f"""WITH {LETTERS}, {found_cte('letters', ['EMAIL', 'IBAN'])}
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}) - 1 AS INTEGER) AS position,
    entity_type, start, "end", text FROM found"""
ORACLE["sql_anonymize"] = ORACLE["anonymize_replace"]
ORACLE["adjacent_merge"] = "SELECT c_custkey AS doc_id, c_name || ': <EMAIL> en <EMAIL>' AS anonymized_text FROM customer"

# --- evaluation ----------------------------------------------------------------------

_LABELS = (
    ("EMAIL", r"\S+@voorbeeld\.nl"), ("IBAN", r"NL91ABNA[0-9]{10}"), ("VAT_NUMBER", r"NL[0-9]{9}B01"),
    ("LICENSE_PLATE", r"AB-[0-9]{2}-CD"), ("IP_ADDRESS", r"192\.168\.[0-9]+\.1"),
)
_EVAL_TYPES = ("EMAIL", "IBAN", "VAT_NUMBER", "LICENSE_PLATE", "IP_ADDRESS", "KVK_NUMBER")


def _labels() -> str:
    parts = []
    for i, (kind, rx) in enumerate(_LABELS):
        v = f"regexp_extract(text, '{rx}')"
        move = f"CASE WHEN (doc_id + {i}) % 5 = 0 THEN {4 if i % 2 else 30} ELSE 0 END"
        name = f"CASE WHEN (doc_id + {i}) % 7 = 0 THEN 'KVK_NUMBER' ELSE '{kind}' END"
        parts.append(
            f"SELECT doc_id AS sample_id, {name} AS entity_type, CAST(instr(text, {v}) - 1 + {move} AS INTEGER) AS start, "
            f'CAST(instr(text, {v}) - 1 + {move} + length({v}) AS INTEGER) AS "end", {v} AS stated, text AS whole FROM letters')
    return "labels AS (" + " UNION ALL ".join(parts) + ")"


def _iou(a: str, b: str) -> str:
    inter = f'(least({a}."end", {b}."end") - greatest({a}.start, {b}.start))'
    return (f'CASE WHEN {inter} <= 0 THEN 0.0 ELSE {inter}::DOUBLE / (({a}."end" - {a}.start) + ({b}."end" - {b}.start) - {inter}) END')


def evaluation(score: float = 0.3, threshold: float = 0.5) -> str:
    """CTEs up to ``outcomes(sample_id, entity_type, start, end, kind, n, wrong_*, low_*)``."""
    return f"""WITH {LETTERS}, {found_cte('letters', None, CLASSIC)}, {_labels()},
  truth AS (SELECT sample_id, entity_type, start, "end", count(*) AS n, any_value(whole) AS whole FROM labels
    GROUP BY sample_id, entity_type, start, "end"),
  preds AS (SELECT doc_id AS sample_id, entity_type, start, "end", score, text FROM found WHERE score >= {score}),
  pairs AS (SELECT t.sample_id, t.entity_type, t.start, t."end", p.entity_type AS p_type, p.start AS p_start,
      p."end" AS p_end, p.score, p.text AS p_text, {_iou('t', 'p')} AS q
    FROM truth t JOIN preds p ON t.sample_id = p.sample_id),
  hit AS (SELECT * FROM pairs WHERE q >= {threshold} AND p_type = entity_type QUALIFY row_number() OVER (
    PARTITION BY sample_id, entity_type, start, "end" ORDER BY score DESC, p_start, p_end DESC, p_type) = 1),
  missed AS (SELECT t.* FROM truth t ANTI JOIN hit h USING (sample_id, entity_type, start, "end")),
  wrong AS (SELECT p.* FROM pairs p SEMI JOIN missed m USING (sample_id, entity_type, start, "end")
    WHERE q >= {threshold} AND p_type <> entity_type QUALIFY row_number() OVER (
    PARTITION BY sample_id, entity_type, start, "end" ORDER BY q DESC, score DESC, p_start, p_end DESC, p_type) = 1),
  low AS (SELECT p.* FROM pairs p SEMI JOIN missed m USING (sample_id, entity_type, start, "end")
    ANTI JOIN wrong w USING (sample_id, entity_type, start, "end") WHERE q < {threshold} AND q > 0 AND p_type = entity_type
    QUALIFY row_number() OVER (PARTITION BY sample_id, entity_type, start, "end"
      ORDER BY q DESC, score DESC, p_start, p_end DESC) = 1),
  used AS (SELECT DISTINCT sample_id, p_type, p_start, p_end FROM (SELECT * FROM hit UNION ALL SELECT * FROM wrong)),
  spurious AS (SELECT p.* FROM preds p WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.sample_id = p.sample_id
    AND u.p_type = p.entity_type AND u.p_start = p.start AND u.p_end = p."end")),
  outcomes AS (
    SELECT t.sample_id, t.entity_type, t.start, t."end", 'tp' AS kind, t.n, NULL AS wrong_type FROM truth t
      SEMI JOIN hit h USING (sample_id, entity_type, start, "end")
    UNION ALL SELECT m.sample_id, m.entity_type, m.start, m."end", 'fn', m.n, w.p_type FROM missed m
      LEFT JOIN wrong w USING (sample_id, entity_type, start, "end")
    UNION ALL SELECT sample_id, entity_type, start, "end", 'fp', 1, NULL FROM spurious)"""


_COUNTS = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE kind = '{k}'), 0) AS BIGINT) AS {k}" for k in ("tp", "fp", "fn"))


def _scores(digits: int = 6) -> str:
    p = "CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END"
    r = "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END"
    f = "CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END"
    return (f"round(CAST({p} AS DOUBLE), {digits}) AS precision, round(CAST({r} AS DOUBLE), {digits}) AS recall, "
            f"round(CAST({f} AS DOUBLE), {digits}) AS f1")


def metrics(where: str = "", group: str = "GROUP BY entity_type", head: str = "entity_type, ", base: str | None = None) -> str:
    return f"{base or evaluation()}, counts AS (SELECT {head}{_COUNTS} FROM outcomes {where} {group})"


ORACLE["eval_metrics"] = f"{metrics()} SELECT entity_type, tp, fp, fn, {_scores()} FROM counts"
ORACLE["eval_repeated_predictions"] = ORACLE["eval_metrics"]
ORACLE["eval_overall"] = f"{metrics(group='', head='')} SELECT tp, fp, fn, {_scores()} FROM counts"
ORACLE["eval_rollup"] = f"{metrics(group='GROUP BY ROLLUP (entity_type)')} SELECT entity_type, tp, fp, fn, {_scores()} FROM counts"
ORACLE["evaluation_report"] = ORACLE["eval_rollup"]
ORACLE["eval_metrics_table"] = f"{metrics()} SELECT entity_type, tp, fp, fn, {_scores(3)} FROM counts"
_TWO = "WHERE entity_type IN ('EMAIL', 'IBAN')"
ORACLE["eval_entity_filter"] = f"{metrics(_TWO)} SELECT entity_type, tp, fp, fn, {_scores()} FROM counts"
ORACLE["eval_score_threshold"] = (
    f"{metrics(base=evaluation(0.55, 0.9))} SELECT entity_type, tp, fp, fn, {_scores()} FROM counts")
_CONFUSION = f"""{metrics()}, labels_seen AS (SELECT entity_type AS l FROM counts UNION ALL SELECT 'O'),
  cells AS (SELECT entity_type AS row_label, entity_type AS col_label, n FROM outcomes WHERE kind = 'tp'
    UNION ALL SELECT 'O', entity_type, n FROM outcomes WHERE kind = 'fn'
    UNION ALL SELECT entity_type, 'O', n FROM outcomes WHERE kind = 'fp'
    UNION ALL SELECT entity_type, wrong_type, n FROM outcomes WHERE wrong_type IS NOT NULL),
  confusion AS (SELECT row_label, col_label, CAST(sum(n) AS BIGINT) AS n FROM cells
    WHERE row_label IN (SELECT l FROM labels_seen) AND col_label IN (SELECT l FROM labels_seen) GROUP BY ALL)"""
ORACLE["confusion_long"] = f"{_CONFUSION} SELECT row_label, col_label, n FROM confusion"
ORACLE["confusion_share"] = (
    f"{_CONFUSION} SELECT row_label, col_label, n, round(n / sum(n) OVER (PARTITION BY row_label), 6)::DOUBLE AS share FROM confusion")
_SQUARE = ("EMAIL", "IBAN", "IP_ADDRESS", "KVK_NUMBER", "LICENSE_PLATE", "VAT_NUMBER", "O")
_CELLS = ", ".join(f"CAST(coalesce(sum(n) FILTER (WHERE col_label = '{c}'), 0) AS BIGINT) AS \"{c}\"" for c in _SQUARE)
_ROWS = ", ".join(f"('{c}')" for c in _SQUARE)
ORACLE["confusion_square"] = f"""{_CONFUSION}, r(row_label) AS (VALUES {_ROWS})
  SELECT r.row_label, {_CELLS} FROM r LEFT JOIN confusion c ON r.row_label = c.row_label GROUP BY r.row_label"""
_CONTEXT = 'substr(whole, greatest(0, e.start - 20) + 1, least(length(whole), e."end" + 20) - greatest(0, e.start - 20))'
_ERRORS = f"""{evaluation()}, errs AS (
    SELECT 'false_positive' AS kind, sample_id, entity_type, start, "end", NULL AS predicted, false AS truth_text,
      NULL::DOUBLE AS iou, 1 AS n FROM spurious
    UNION ALL SELECT 'false_negative', sample_id, entity_type, start, "end", NULL, false, NULL, n FROM missed
    UNION ALL SELECT 'partial', sample_id, entity_type, start, "end", p_text, true, q,
      (SELECT n FROM missed m WHERE (m.sample_id, m.entity_type, m.start, m."end") = (w.sample_id, w.entity_type, w.start, w."end")) FROM wrong w
    UNION ALL SELECT 'low_iou', sample_id, entity_type, start, "end", p_text, true, q,
      (SELECT n FROM missed m WHERE (m.sample_id, m.entity_type, m.start, m."end") = (w.sample_id, w.entity_type, w.start, w."end")) FROM low w),
  errors AS (SELECT e.sample_id, e.kind, e.entity_type, e.start, e."end",
    substr(l.text, e.start + 1, e."end" - e.start) AS text,
    {_CONTEXT.replace('whole', 'l.text')} AS context, e.predicted,
    CASE WHEN truth_text THEN substr(l.text, e.start + 1, e."end" - e.start) END AS ground_truth,
    round(e.iou, 6) AS iou, CAST(e.n AS BIGINT) AS n FROM errs e JOIN letters l ON e.sample_id = l.doc_id)"""
ORACLE["eval_errors"] = f"{_ERRORS} SELECT * FROM errors"
ORACLE["eval_error_samples"] = f"""{_ERRORS}, totals AS (SELECT kind, entity_type, CAST(sum(n) AS BIGINT) AS total FROM errors GROUP BY ALL),
  listed AS (SELECT * FROM errors WHERE kind IN ('false_positive', 'false_negative') QUALIFY row_number() OVER (
    PARTITION BY kind, entity_type ORDER BY sample_id, start, "end") <= 3),
  partials AS (SELECT * FROM errors WHERE kind = 'partial' ORDER BY sample_id, start, "end", entity_type LIMIT 5)
  SELECT kind, entity_type, sample_id, start, "end", total FROM (SELECT * FROM listed UNION ALL SELECT * FROM partials)
  JOIN totals USING (kind, entity_type)"""
ORACLE["eval_error_distribution"] = f"{metrics()} SELECT entity_type, fp AS false_positives, fn AS false_negatives FROM counts"
ORACLE["eval_error_summary"] = f"{_ERRORS} SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM errors GROUP BY kind"


def _gate(minimums: str, join: str) -> str:
    return f"""{metrics()}, m AS (SELECT entity_type, tp, fp, fn, {_scores()} FROM counts),
  t(entity_type, min_precision, min_recall) AS (VALUES {minimums}),
  gated AS (SELECT coalesce(m.entity_type, t.entity_type) AS entity_type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp,
    coalesce(fn, 0) AS fn, coalesce(precision, 0.0) AS precision,
    coalesce(recall, 0.0) AS recall, coalesce(f1, 0.0) AS f1, CAST(coalesce(min_precision, 0.0) AS DOUBLE) AS min_precision,
    CAST(coalesce(min_recall, 0.0) AS DOUBLE) AS min_recall,
    coalesce(precision, 0.0) >= coalesce(min_precision, 0.0) AND coalesce(recall, 0.0) >= coalesce(min_recall, 0.0) AS passed
    FROM m {join} JOIN t ON m.entity_type = t.entity_type)"""


ORACLE["threshold_gate"] = _gate("('EMAIL', 0.5, 0.5), ('KVK_NUMBER', 0.0, 0.5), ('PERSON', 0.1, 0.0)", "FULL") + " SELECT * FROM gated"
_FLOOR = ", ".join(f"('{e}', 0.0, 1.0)" for e in (
    "EMAIL", "PHONE_NUMBER", "IBAN", "DATE_TIME", "BSN", "LICENSE_PLATE", "KVK_NUMBER", "CASE_NO", "IP_ADDRESS"))
ORACLE["gate_verdict"] = _gate(_FLOOR, "") + " SELECT coalesce(bool_and(passed), true) AS passed FROM gated"
ORACLE["recall_bands"] = _gate(
    "('PERSON', 0.0, 0.75), ('LOCATION', 0.0, 0.75), ('ORGANIZATION', 0.0, 0.5), ('EMAIL', 0.0, 0.75)", "") + " SELECT * FROM gated"
ORACLE["label_check"] = f"""WITH {LETTERS}, {_labels()} SELECT sample_id, entity_type, start, "end", stated,
  substr(whole, start + 1, "end" - start) AS found FROM labels WHERE substr(whole, start + 1, "end" - start) IS DISTINCT FROM stated"""
ORACLE["pattern_only_types"] = f"{metrics()} SELECT entity_type, tp, fp, fn FROM counts"
ORACLE["iou_pairs"] = f"""WITH p AS (SELECT l_partkey % 50 AS s1, l_partkey % 50 + 1 + l_suppkey % 20 AS e1,
    l_suppkey % 50 AS s2, l_suppkey % 50 + 1 + l_partkey % 20 AS e2 FROM lineitem),
  i AS (SELECT *, least(e1, e2) - greatest(s1, s2) AS inter FROM p)
  SELECT round(CASE WHEN inter <= 0 THEN 0.0 ELSE inter::DOUBLE / ((e1 - s1) + (e2 - s2) - inter) END, 6)::DOUBLE AS iou,
    count(*) AS n FROM i GROUP BY 1"""


def _golden(patterns, kinds=None) -> str:
    return f"""{found_cte("letters", kinds, patterns)}, {_labels()},
    e AS (SELECT DISTINCT sample_id AS id, entity_type, start, "end", 1 AS e FROM labels),
    d AS (SELECT DISTINCT doc_id AS id, entity_type, start, "end", 1 AS d FROM found),
    sides AS (SELECT * FROM e FULL JOIN d USING (id, entity_type, start, "end")),
    report AS (SELECT entity_type, count(e) AS expected, count(d) AS detected, count(e + d) AS correct FROM sides GROUP BY entity_type)"""


_GOLDEN_SCORES = """round(CAST(CASE WHEN detected > 0 THEN correct / detected ELSE 0.0 END AS DOUBLE), 6) AS precision,
  round(CAST(CASE WHEN expected > 0 THEN correct / expected ELSE 0.0 END AS DOUBLE), 6) AS recall,
  round(CAST(CASE WHEN correct > 0 THEN 2.0 * correct / (expected + detected) ELSE 0.0 END AS DOUBLE), 6) AS f1"""
ORACLE["golden_report"] = (
    f"WITH {LETTERS}, {_golden(CLASSIC)} SELECT entity_type, expected, detected, correct, {_GOLDEN_SCORES} FROM report")
ORACLE["golden_missing"] = f"""WITH {LETTERS}, {_golden(CLASSIC)}
  SELECT id || ':' || entity_type || '@' || start AS missing FROM sides WHERE d IS NULL"""
ORACLE["golden_extra"] = f'WITH {LETTERS}, {_golden(CLASSIC)} SELECT id, entity_type, start, "end" FROM sides WHERE e IS NULL'
ORACLE["golden_extra_shown"] = ORACLE["golden_extra"] + ' ORDER BY id, start, "end", entity_type LIMIT 10'
ORACLE["golden_default_types"] = (
    f"WITH {LETTERS}, {_golden(CLASSIC, DEFAULTS)} "
    f"SELECT entity_type, expected, detected, correct, {_GOLDEN_SCORES} FROM report")
ORACLE["golden_profiles"] = f"""WITH {LETTERS}, {_golden(CLASSIC)}
  SELECT entity_type, recall AS classic, CAST(CASE WHEN expected > 0 OR entity_type = 'MAC_ADDRESS' THEN 0.0 END AS DOUBLE) AS gpu
  FROM (SELECT *, {_GOLDEN_SCORES} FROM report)"""
ORACLE["gate_from_files"] = ORACLE["threshold_gate"]
ORACLE["golden_from_files"] = f"""WITH {LETTERS}, {_golden(CLASSIC)}
  SELECT entity_type, expected, detected, correct, expected - correct AS missing FROM report"""
ORACLE["golden_floors"] = f"""WITH {LETTERS}, {_golden(CLASSIC)}
  SELECT entity_type, correct AS tp, detected - correct AS fp, expected - correct AS fn, recall, CAST(1 AS DOUBLE) AS min_recall,
    recall >= 1 AS passed FROM (SELECT *, {_GOLDEN_SCORES} FROM report)
  WHERE expected > 0 AND entity_type IN ('EMAIL', 'PHONE_NUMBER', 'IBAN', 'DATE_TIME', 'BSN', 'LICENSE_PLATE', 'KVK_NUMBER',
    'CASE_NO', 'IP_ADDRESS')"""
