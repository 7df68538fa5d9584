"""The pseudonyms once more, as DuckDB SQL: distinct candidates as rows, rounds as recursions.

RE2 has no look-around, so boundaries are ``\\b``; both agree where a format begins or ends in a word character.
"""

from __future__ import annotations

from factgraph.llm import pii

_FORMS = {
    "email": pii.EMAIL.replace(r"(?<![A-Za-z0-9._%+-])", ""),
    "ipv4": pii.IPV4,
    "date": pii.DATE,
    "ssn": pii.SSN,
    "iban": pii.IBANS,
    "card": pii.CARD,
    "phone": pii.PHONE.replace(r"(?<!\w)\+", r"\B\+").replace(r"(?<!\w)\(", r"\B\("),
}


def _re2(pattern: str) -> str:
    return pattern.replace("{B}", r"\b").replace("{E}", r"\b").replace("'", "''")


PATTERN = "|".join(_re2(p) for p in _FORMS.values())


def _each(n: str, var: str, body: str) -> str:
    """A text of n characters, each by an expression of its place from 1."""
    return f"array_to_string(list_transform(range(1, ({n}) + 1), lambda {var}: {body}), '')"


def _luhn(digits: str, doubled: int) -> str:
    d = f"substr({digits}, (length({digits}) - z)::INT, 1)::INT"
    return f"list_sum(list_transform(range(0, length({digits})), lambda z: CASE WHEN z % 2 = {doubled} THEN 2 * {d} - CASE WHEN {d} > 4 THEN 9 ELSE 0 END ELSE {d} END))"


def _mod97(text: str) -> str:
    spelled = _each(f"length({text})", "z", f"CASE WHEN substr({text}, z, 1) BETWEEN 'A' AND 'Z' THEN (ascii(substr({text}, z, 1)) - 55)::VARCHAR ELSE substr({text}, z, 1) END")
    return f"list_reduce(list_transform(string_split({spelled}, ''), lambda c: c::INT), lambda x, y: (x * 10 + y) % 97)"


def _fill(form: str, digits: str) -> str:
    return _each(f"length({form})", "z", f"CASE WHEN regexp_matches(substr({form}, z, 1), '[0-9]') THEN substr({digits}, length(regexp_replace(substr({form}, 1, z), '[^0-9]', '', 'g')), 1) ELSE substr({form}, z, 1) END")


def _number(value: str) -> str:
    """As pii._hash: digits' hashes also name their length."""
    return f"('0x' || substr(sha256('{pii.DEMONSTRATION_KEY}|' || kind || '|' || i || '|' || CASE WHEN n > 0 THEN n || ':' ELSE '' END || {value}), 1, 14))::BIGINT"


def _moved(part: str, stream: str) -> str:
    c, by = f"substr({part}, z, 1)", f"('0x' || substr({stream}, ((z * 2 - 2) % 128 + 1)::INT, 2))::INT"
    cases = " ".join(f"WHEN contains('{a}', {c}) THEN substr('{a}', (instr('{a}', {c}) - 1 + {by}) % {len(a)} + 1, 1)" for a in pii.ALPHABETS)
    return _each(f"length({part})", "z", f"CASE {cases} ELSE {c} END")


def _stream(other: str) -> str:
    return " || ".join(f"sha256('{pii.DEMONSTRATION_KEY}|email|' || i || '|' || n || '|' || {other} || '|{k}')" for k in (0, 1))


def sql() -> str:
    kinds = " ".join(f"WHEN regexp_full_match(m, '{_re2(_FORMS[k])}') THEN '{k}'" for k in ("ipv4", "date", "ssn", "iban", "card"))
    d, mo = (f"CASE WHEN bare THEN {part}(day)::VARCHAR ELSE lpad({part}(day)::VARCHAR, 2, '0') END" for part in ("day", "month"))
    year_first = "regexp_matches(m, '^[0-9]{4}')"
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[0-9@]') THEN regexp_extract_all(text, '{PATTERN}') ELSE [] END AS ms FROM documents),
c AS (SELECT DISTINCT m, CASE WHEN contains(m, '@') THEN 'email' {kinds} ELSE 'phone' END AS kind, regexp_replace(m, '[^0-9]', '', 'g') AS d, string_split(m, '.') AS octets, replace(m, ' ', '') AS plain FROM (SELECT unnest(ms) AS m FROM t)),
q AS (SELECT *, CASE WHEN kind = 'date' AND NOT {year_first} AND NOT contains(m, '.') THEN try_cast(string_split(m, '/')[3] || '-' || lpad(string_split(m, '/')[1], 2, '0') || '-' || lpad(string_split(m, '/')[2], 2, '0') AS DATE) END AS month_day FROM c WHERE kind <> 'email'),
p AS (SELECT *, CASE WHEN kind = 'date' THEN coalesce(month_day, try_cast(CASE WHEN {year_first} THEN replace(m, '/', '-') WHEN contains(m, '.') THEN octets[3] || '-' || lpad(octets[2], 2, '0') || '-' || lpad(octets[1], 2, '0')
    ELSE string_split(m, '/')[3] || '-' || lpad(string_split(m, '/')[2], 2, '0') || '-' || lpad(string_split(m, '/')[1], 2, '0') END AS DATE)) END AS day,
    month_day IS NULL AS day_first, regexp_matches(m, '(^|[/.])[0-9][/.]') AS bare FROM q),
w AS (SELECT *, CASE kind WHEN 'card' THEN substr(d, 1, length(d) - 1) WHEN 'phone' THEN substr(d, CASE WHEN starts_with(m, '+1') THEN 2 WHEN starts_with(m, '+') THEN 3 WHEN starts_with(m, '0') THEN 2 ELSE 1 END)
    WHEN 'iban' THEN regexp_replace(substr(plain, 5), '[^0-9]', '', 'g') END AS moved FROM p WHERE CASE kind
    WHEN 'card' THEN length(d) BETWEEN 13 AND 19 AND regexp_matches(d, '[1-9]') AND {_luhn('d', 1)} % 10 = 0
    WHEN 'ipv4' THEN list_max(list_transform(octets, lambda z: z::INT)) <= 255
    WHEN 'ssn' THEN substr(d, 1, 3)::INT BETWEEN 1 AND 899 AND substr(d, 1, 3) <> '666' AND substr(d, 4, 2) <> '00' AND substr(d, 6, 4) <> '0000'
    WHEN 'date' THEN coalesce(year(day) BETWEEN 1900 AND 2099, false)
    WHEN 'iban' THEN length(plain) BETWEEN 15 AND 34 AND {_mod97('(substr(plain, 5) || substr(plain, 1, 4))')} = 1
    ELSE length(d) BETWEEN 8 AND 15 END),
f AS (SELECT m, kind, d, plain, moved, day_first, bare, 0 AS i, coalesce(length(moved), 0) AS n,
    (CASE kind WHEN 'ipv4' THEN octets[1]::BIGINT * 256 + octets[2]::BIGINT WHEN 'ssn' THEN substr(d, 1, 3)::BIGINT - 1 - CASE WHEN substr(d, 1, 3)::INT > 666 THEN 1 ELSE 0 END
      WHEN 'date' THEN date_diff('day', DATE '{pii.FIRST_DAY}', day) // 229 ELSE substr(moved, 1, (length(moved) // 2)::INT)::BIGINT END)::BIGINT AS l,
    (CASE kind WHEN 'ipv4' THEN octets[3]::BIGINT * 256 + octets[4]::BIGINT WHEN 'ssn' THEN (substr(d, 4, 2)::BIGINT - 1) * 9999 + substr(d, 6, 4)::BIGINT - 1
      WHEN 'date' THEN date_diff('day', DATE '{pii.FIRST_DAY}', day) % 229 ELSE substr(moved, (length(moved) // 2 + 1)::INT)::BIGINT END)::BIGINT AS r,
    (CASE kind WHEN 'ipv4' THEN 65536 WHEN 'ssn' THEN 898 WHEN 'date' THEN 319 ELSE pow(10, length(moved) // 2) END)::BIGINT AS a,
    (CASE kind WHEN 'ipv4' THEN 65536 WHEN 'ssn' THEN 989901 WHEN 'date' THEN 229 ELSE pow(10, length(moved) - length(moved) // 2) END)::BIGINT AS b FROM w
  UNION ALL
  SELECT m, kind, d, plain, moved, day_first, bare, i, n, CASE WHEN i % 2 = 1 THEN (l + {_number('l_other')}) % a ELSE l END, CASE WHEN i % 2 = 0 THEN (r + {_number('l_other')}) % b ELSE r END, a, b
  FROM (SELECT * REPLACE (i + 1 AS i), CASE WHEN i % 2 = 0 THEN r ELSE l END AS l_other FROM f WHERE i < {pii.ROUNDS})),
o AS (SELECT *, CASE WHEN n = 1 THEN moved ELSE lpad(l::VARCHAR, (n // 2)::INT, '0') || lpad(r::VARCHAR, (n - n // 2)::INT, '0') END AS q, CASE WHEN kind = 'date' THEN DATE '{pii.FIRST_DAY}' + (l * 229 + r)::INT END AS day FROM f WHERE i = {pii.ROUNDS}),
s AS (SELECT *, CASE kind WHEN 'iban' THEN {_fill('substr(plain, 5)', 'q')} END AS account FROM o),
x AS (SELECT m, plain, kind, CASE kind
    WHEN 'card' THEN {_fill('m', f"(q || ((10 - {_luhn('q', 0)} % 10) % 10)::INT::VARCHAR)")}
    WHEN 'phone' THEN {_fill('m', '(substr(d, 1, (length(d) - n)::INT) || q)')}
    WHEN 'ipv4' THEN (l // 256) || '.' || (l % 256) || '.' || (r // 256) || '.' || (r % 256)
    WHEN 'ssn' THEN lpad((l + 1 + CASE WHEN l + 1 >= 666 THEN 1 ELSE 0 END)::VARCHAR, 3, '0') || '-' || lpad((r // 9999 + 1)::VARCHAR, 2, '0') || '-' || lpad((r % 9999 + 1)::VARCHAR, 4, '0')
    WHEN 'date' THEN CASE WHEN {year_first} THEN strftime(day, '%Y') || substr(m, 5, 1) || strftime(day, '%m') || substr(m, 5, 1) || strftime(day, '%d') WHEN contains(m, '.') THEN {d} || '.' || {mo} || '.' || year(day) WHEN day_first THEN {d} || '/' || {mo} || '/' || year(day) ELSE {mo} || '/' || {d} || '/' || year(day) END
    WHEN 'iban' THEN substr(plain, 1, 2) || lpad((98 - {_mod97("(account || substr(plain, 1, 2) || '00')")})::VARCHAR, 2, '0') || account END AS new FROM s),
h AS (SELECT m, 0 AS i, length(split_part(m, '@', 1)) AS n, substr(split_part(m, '@', 1), 1, (length(split_part(m, '@', 1)) // 2)::INT) AS l, substr(split_part(m, '@', 1), (length(split_part(m, '@', 1)) // 2 + 1)::INT) AS r FROM c WHERE kind = 'email'
  UNION ALL
  SELECT m, i, n, CASE WHEN i % 2 = 1 THEN {_moved('l', 'stream')} ELSE l END, CASE WHEN i % 2 = 0 THEN {_moved('r', 'stream')} ELSE r END
  FROM (SELECT *, {_stream('CASE WHEN i % 2 = 1 THEN r ELSE l END')} AS stream FROM (SELECT * REPLACE (i + 1 AS i) FROM h WHERE i < {pii.ROUNDS}))),
y AS (SELECT m, CASE WHEN kind = 'iban' THEN {_each('length(m)', 'z', "CASE WHEN substr(m, z, 1) = ' ' THEN ' ' ELSE substr(new, length(replace(substr(m, 1, z), ' ', '')), 1) END")} ELSE new END AS new FROM x
  UNION ALL SELECT m, l || r || '@' || split_part(m, '@', 2) FROM h WHERE i = {pii.ROUNDS}),
e AS (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS ord FROM t),
g AS (SELECT doc_id, list(coalesce(new, e.m) ORDER BY ord) AS news, count(new) AS n_found FROM e LEFT JOIN y ON e.m = y.m GROUP BY doc_id)
SELECT t.doc_id, CASE WHEN len(ms) = 0 THEN text ELSE array_to_string(list_transform(string_split_regex(text, '{PATTERN}'), lambda part, z: part || coalesce(news[z], '')), '') END AS text, coalesce(n_found, 0) AS n_found
FROM t LEFT JOIN g ON g.doc_id = t.doc_id"""
