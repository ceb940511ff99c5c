"""The rules of billoom.functions as DuckDB SQL text, for the queries' oracle. Each function takes and gives SQL expressions."""

from __future__ import annotations

from billoom.functions.scalars import DATE_LABELS, PLACEHOLDERS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def choice(values: list, key: str) -> str:
    """One of the values by key modulo their number."""
    return f"([{', '.join('NULL' if v is None else quoted(v) if isinstance(v, str) else str(v) for v in values)}])[({key}) % {len(values)} + 1]"


def trim(t: str) -> str:
    return rf"regexp_replace(regexp_replace({t}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


def placeholder(t: str) -> str:
    t = f"lower({trim(f'coalesce({t}, {quoted(str())})')})"
    return rf"({t} = '' OR regexp_matches({t}, '^[-–—?.]+$') OR regexp_matches({t}, '^({'|'.join(PLACEHOLDERS)})($|[ (])'))"


def cleaned(t: str) -> str:
    return f"CASE WHEN {placeholder(t)} THEN '' ELSE {trim(t)} END"


def amount_steps(name: str, source: str, keep: str, t: str = "t") -> str:
    """CTEs that end in ``name``: the columns ``keep`` of source and amount, the amount that its text column t holds."""
    return rf"""{name}_a AS (SELECT {keep}, {t} AS t, regexp_replace({t}, '[^\p{{Nd}}.,\-]', '', 'g') AS raw FROM {source}),
{name}_b AS (SELECT {keep}, t, CASE WHEN raw LIKE '-%' THEN '-' || replace(substr(raw, 2), '-', '') ELSE replace(raw, '-', '') END AS k FROM {name}_a),
{name}_c AS (SELECT {keep}, t, k, contains(k, ',') AS c, contains(k, '.') AS d,
  length(k) - instr(reverse(k), ',') AS lc, length(k) - instr(reverse(k), '.') AS ld FROM {name}_b),
{name}_d AS (SELECT {keep}, t, CASE
  WHEN c AND d THEN CASE WHEN lc > ld THEN replace(replace(k, '.', ''), ',', '.') ELSE replace(k, ',', '') END
  WHEN c THEN CASE WHEN regexp_matches(k, ',[^,]{{1,2}}$') THEN replace(k, ',', '.') ELSE replace(k, ',', '') END
  WHEN d THEN CASE WHEN length(k) - length(replace(k, '.', '')) > 1 THEN replace(k, '.', '')
    WHEN regexp_matches(k, '^[^.]{{1,3}}\.[^.]{{3}}$') AND NOT k LIKE '0.%' THEN replace(k, '.', '') ELSE k END
  ELSE k END AS ready FROM {name}_c),
{name} AS (SELECT {keep}, CASE WHEN NOT {placeholder('t')} AND ready NOT IN ('', '-') THEN TRY_CAST(ready AS DOUBLE) END AS amount FROM {name}_d)"""


def _date(y: str, m: str, d: str) -> str:
    y, m, d = (f"TRY_CAST({x} AS INT)" for x in (y, m, d))
    return f"CASE WHEN {m} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 THEN printf('%04d-%02d-%02d', CASE WHEN {y} < 100 THEN {y} + 2000 ELSE {y} END, {m}, {d}) ELSE '' END"


def first_date(t: str) -> str:
    iso, german, run = r"(\d{4})-(\d{1,2})-(\d{1,2})", r"(\d{1,2})[./](\d{1,2})[./](\d{2,4})", r"\b(\d{4})(\d{2})(\d{2})\b"
    part = lambda p, k: f"regexp_extract({t}, '{p}', {k})"
    return f"""CASE WHEN regexp_matches({t}, '{iso}') THEN {_date(part(iso, 1), part(iso, 2), part(iso, 3))}
  WHEN regexp_matches({t}, '{german}') THEN {_date(part(german, 3), part(german, 2), part(german, 1))}
  WHEN regexp_matches({t}, '{run}') THEN {_date(part(run, 1), part(run, 2), part(run, 3))} ELSE '' END"""


def date(t: str) -> str:
    return f"CASE WHEN {placeholder(t)} THEN '' ELSE {first_date(t)} END"


def labelled_date(t: str) -> str:
    lines = f"list_filter(string_split(coalesce({t}, ''), chr(10)), lambda l: regexp_matches(lower(l), '{'|'.join(DATE_LABELS)}'))"
    return f"coalesce(list_filter(list_transform({lines}, lambda l: {first_date('l')}), lambda d: d <> '')[1], '')"


def currency(t: str) -> str:
    up = f"upper(coalesce({t}, ''))"
    has = lambda *s: " OR ".join(f"contains({up}, '{x}')" for x in s)
    return rf"CASE WHEN {placeholder(t)} THEN '' WHEN {has('€', 'EUR')} THEN 'EUR' WHEN {has('£', 'GBP')} THEN 'GBP' WHEN {has('CHF')} THEN 'CHF' WHEN {has('$', 'USD')} THEN 'USD' ELSE regexp_extract({up}, '\b([A-Z]{{3}})\b', 1) END"


def bare_money(x: str) -> str:
    return f"replace(printf('%.2f', {x}), '.', ',')"


def money(x: str, code: str) -> str:
    return f"{bare_money(x)} || CASE WHEN coalesce({code}, '') = '' THEN '' ELSE ' ' || {code} END"


def bills_text(n: str) -> str:
    return f"{n} || CASE WHEN {n} = 1 THEN ' bill' ELSE ' bills' END"


COVERED = f"""CASE WHEN complete THEN {bills_text('counted')} ELSE counted || ' of ' || {bills_text('expected')} || CASE WHEN failed > 0 THEN ', ' || failed || ' unread' ELSE '' END
  || CASE WHEN unamounted > 0 THEN ', ' || unamounted || ' without an amount' ELSE '' END END"""


def file_sums(source: str, by: str = "path", order: str = "page") -> str:
    """CTEs sums: by file what file_sums() tells, the money joined to one text."""
    return f"""parts AS (SELECT {by}, lower({trim("coalesce(currency, '')")}) AS key, arg_min({trim("coalesce(currency, '')")}, {order}) AS label, min({order}) AS first, sum(gross_cents)::BIGINT AS cents, count(*) AS n
  FROM {source} WHERE status = 'ok' AND gross_cents IS NOT NULL GROUP BY 1, 2),
money AS (SELECT {by}, string_agg({money('cents / 100.0::DOUBLE', 'label')}, ' + ' ORDER BY first) AS money, count(*) AS n_parts FROM parts GROUP BY 1),
covers AS (SELECT {by}, count(*) AS present, count(*) FILTER (status = 'ok' AND gross_cents IS NOT NULL) AS counted, count(*) FILTER (status IS DISTINCT FROM 'ok') AS failed, greatest(max(page_count), count(*)) AS expected FROM {source} GROUP BY 1),
sums AS (SELECT covers.*, greatest(0, present - failed - counted) AS unamounted, counted > 0 AND failed = 0 AND counted >= expected AS complete, coalesce(money, '') AS money, coalesce(n_parts, 0) AS n_parts FROM covers LEFT JOIN money USING ({by}))"""
