"""The profile as DuckDB SQL, to check the Spark profile against.

Not used by any query; it only writes the SQL that the results must equal.
"""

from __future__ import annotations

from ..functions import patterns as P
from .q_columns import duck_fold, duck_strip

ORDERS_COLUMNS = {"order_id": "number", "order_date": "text", "total": "text",
                  "phone": "text", "priority": "text", "active": "text", "qty_text": "text"}
EVENTS_COLUMNS = {"event_id": "number", "ts": "text", "user_id": "number",
                  "event_type": "text", "value": "number", "note": "text"}
CUSTOMERS_COLUMNS = {"customer_id": "number", "full_name": "text", "email": "text",
                     "phone": "text", "segment": "text", "balance": "number"}


def hit(c: str, pattern: str) -> str:
    return f"regexp_matches({c}, '{pattern}')"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def number(c: str) -> str:
    return f"try_cast(replace(trim({c}), ',', '') as double)"


def blank(c: str, kind: str) -> str:
    return f"{c} is null" if kind != "text" else f"trim(coalesce({c}, '')) = ''"


def null_pct(n: str, filled: str) -> str:
    return f"coalesce(round(100.0::double * (1 - {filled} / nullif({n}, 0)::double), 2), 0)"


def row(col, signal, value, detail=None, where="true", source="") -> str:
    name = "cast(null as varchar)" if col is None else lit(col)
    what = "cast(null as varchar)" if detail is None else lit(detail)
    return (f"select {name} as col, {lit(signal)} as signal, {what} as detail, "
            f"cast({value} as double) as value from {source} where {where}")


def table_rows(source: str, columns: dict[str, str]) -> list[str]:
    all_blank = " and ".join(f"({blank(c, k)})" for c, k in columns.items())
    out = [row(None, "n_rows", "n", source=f"(select count(*) as n from {source})"),
           row(None, "n_cols", str(len(columns)), source="(select 1)"),
           row(None, "blank_rows", "n",
               source=f"(select count(*) as n from {source} where {all_blank})")]
    for c, k in columns.items():
        counts = f"(select count(*) as n, count({c}) as f from {source})"
        out.append(row(c, "n_filled", "f", source=counts))
        out.append(row(c, "null_pct", null_pct("n", "f"), source=counts))
        out.append(row(c, "blank_column", "case when n > 0 and b = 0 then 1 else 0 end",
                       source=f"(select count(*) as n, count(*) filter "
                              f"(where not ({blank(c, k)})) as b from {source})"))
    return out


def text_rows(source: str, columns: dict[str, str]) -> list[str]:
    out = []
    for c in [c for c, k in columns.items() if k == "text"]:
        dates = " or ".join(hit("x", p) for p in P.DATE_FORMATS.values())
        phones = " or ".join(hit("x", p) for p in P.PHONE_FORMATS.values())
        parts = [f"count(*) as n, coalesce(bool_or({dates}), false) as dated",
                 f"coalesce(bool_or({phones}), false) as phoned",
                 f"count(*) filter (where {hit('trim(x)', P.CURRENCY_CELL)}) as currency",
                 f"count(*) filter (where {hit('trim(x)', P.NUMERIC_CELL)}) as numeric_",
                 f"count(*) filter (where lower(trim(x)) in "
                 f"({', '.join(lit(w) for w in P.BOOL_WORDS)})) as bools",
                 f"count(*) filter (where x <> {duck_strip('x')}) "
                 r"+ count(*) filter (where regexp_matches(x, '\s{2,}')) as spaces",
                 f"count({number('x')}) as numbers"]
        formats = {("date_format", d): p for d, p in P.DATE_FORMATS.items()}
        formats |= {("phone_format", d): p for d, p in P.PHONE_FORMATS.items()}
        parts += [f"count(*) filter (where {hit('x', p)}) as p{i}"
                  for i, p in enumerate(formats.values())]
        counts = (f"(select {', '.join(parts)} from "
                  f"(select {c} as x from {source} where {c} is not null))")
        out += [row(c, s, f"p{i}", d, f"p{i} > 0", counts)
                for i, (s, d) in enumerate(formats)]
        out += [
            row(c, "currency_like", "currency", None, "currency > 0", counts),
            row(c, "numeric_as_string", "numeric_", None, "not dated and numeric_ > 0", counts),
            row(c, "bool_as_string", "n", None, "n > 0 and bools = n", counts),
            row(c, "whitespace", "spaces", None, "spaces > 0", counts),
            row(c, "number_like", "numbers", None,
                "not dated and not phoned and numbers > 0.9 * n and n > 10", counts),
        ]
    return out


def number_rows(source: str, columns: dict[str, str]) -> list[str]:
    out = []
    for c in [c for c, k in columns.items() if k == "number"]:
        for signal, e in (("min", f"min({c})"), ("max", f"max({c})"),
                          ("mean", f"round(avg({c}), 4)"),
                          ("std", f"round(stddev_samp({c}), 4)")):
            out.append(row(c, signal, "v", None, "v is not null",
                           f"(select {e} as v from {source})"))
    return out


def outlier_rows(source: str, columns: dict[str, str]) -> list[str]:
    out = []
    for c, k in [(c, k) for c, k in columns.items() if k in ("number", "text")]:
        x = f"cast({c} as double)" if k == "number" else number(c)
        wanted = "true"
        if k == "text":
            formats = " or ".join(hit("x", p) for p in
                                  [*P.DATE_FORMATS.values(), *P.PHONE_FORMATS.values()])
            wanted = f"not bool_or({formats}) and count(v) > 0.9 * count(*) and count(*) > 10"
        cells = f"(select {c} as x, {x} as v from {source} where {c} is not null)"
        fences = (f"(select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 "
                  f"from {cells} having {wanted})")
        out.append(row(c, "iqr_outliers", "n", None, "n > 0", (
            f"(select count(*) as n from {cells}, {fences} where q3 > q1 and "
            f"(v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)))")))
    return out


def distinct_rows(source: str, columns: dict[str, str]) -> list[str]:
    out = []
    for c, k in columns.items():
        counts = f"(select count(*) as n_rows, count(distinct {c}) as n from {source})"
        out.append(row(c, "n_unique", "n", source=counts))
        if k == "text":
            folded = (f"(select count(*) as n_rows, count(distinct {c}) as n, "
                      f"count(distinct {duck_fold(c)}) as f from {source})")
            low = "f < n and n <= greatest(20, n_rows // 20)"
            out.append(row(c, "casing_raw", "n", None, low, folded))
            out.append(row(c, "casing_folded", "f", None, low, folded))
    return out


def duplicate_key_rows(source: str, columns: dict[str, str]) -> list[str]:
    return [row(c, "duplicate_keys", "n_rows - u - has_null", None,
                "u >= 0.9 * n_rows and n_rows - u - has_null > 0",
                f"(select count(*) as n_rows, count(distinct {c}) as u, "
                f"cast(count(*) > count({c}) as integer) as has_null from {source})")
            for c in columns if any(w in c.lower() for w in ("id", "key", "code"))]


def duplicate_row_rows(source: str) -> list[str]:
    return [row(None, "duplicate_rows", "n", None, "n > 0",
                f"(select (select count(*) from {source}) - "
                f"(select count(*) from (select distinct * from {source})) as n)")]


def profile_cte(name: str, source: str, columns: dict[str, str]) -> str:
    """CTE ``name`` with the profile rows that issues and steps come from."""
    rows = (table_rows(source, columns) + text_rows(source, columns)
            + number_rows(source, columns) + outlier_rows(source, columns)
            + distinct_rows(source, columns) + duplicate_row_rows(source))
    for i, c in enumerate(columns):
        rows.append(row(c, "place", str(i), source="(select 1)"))
    return f"{name} as materialized ({' union all '.join(rows)})"


def _value(signal: str) -> str:
    return f"coalesce(max(value) filter (where signal = {lit(signal)}), 0)"


def by_column_cte(name: str, profile: str) -> str:
    values = ["currency_like", "numeric_as_string", "bool_as_string", "whitespace",
              "casing_raw", "casing_folded", "null_pct", "iqr_outliers", "blank_column",
              "place"]
    formats = []
    for s, fine in (("date_format", P.ISO_DATE), ("phone_format", P.INTL_PHONE)):
        formats.append(f"count(*) filter (where signal = '{s}') as {s}s")
        formats.append(f"count(*) filter (where signal = '{s}' and detail <> {lit(fine)}) "
                       f"as {s}s_odd")
        formats.append(f"coalesce(string_agg(detail, ', ' order by detail) filter "
                       f"(where signal = '{s}'), '') as {s}s_list")
    columns = ", ".join([f"{_value(v)} as {v}" for v in values] + formats)
    return (f"{name} as (select col, {columns} from {profile} "
            f"where col is not null group by col)")


def by_table_cte(name: str, profile: str) -> str:
    return (f"{name} as (select {_value('blank_rows')} as blank_rows, "
            f"{_value('duplicate_rows')} as duplicate_rows from {profile} where col is null)")


def whole(c: str) -> str:
    return f"cast(cast({c} as bigint) as varchar)"


def issues_sql(c: str, t: str) -> str:
    found = {
        "empty column": ("blank_column > 0", "'all rows'"),
        "mixed date formats": ("date_formats_odd > 0", whole("date_formats")),
        "phone format chaos": ("phone_formats_odd > 0", whole("phone_formats")),
        "currency strings": ("currency_like > 0", whole("currency_like")),
        "bools as strings": ("currency_like = 0 and bool_as_string > 0",
                             whole("bool_as_string")),
        "numbers as strings": ("currency_like = 0 and bool_as_string = 0 "
                               "and numeric_as_string > 0", whole("numeric_as_string")),
        "category casing variants": ("casing_raw > 0",
                                     f"{whole('casing_raw')} || ' -> ' || "
                                     f"{whole('casing_folded')}"),
        "whitespace / unicode": ("whitespace > 0", whole("whitespace")),
        "missing values": ("null_pct > 0", "cast(null_pct as varchar) || '%'"),
        "statistical outliers": ("iqr_outliers > 0", whole("iqr_outliers")),
    }
    parts = [f"select '{label}' as issue, cast(null as varchar) as col, {whole(s)} as count "
             f"from {t} where {s} > 0"
             for label, s in (("duplicate rows", "duplicate_rows"),
                              ("blank rows", "blank_rows"))]
    parts += [f"select {lit(i)} as issue, col, {v} as count from {c} where {cond}"
              for i, (cond, v) in found.items()]
    return " union all ".join(parts)


def steps_sql(c: str, t: str) -> str:
    """``(place, rank, tool, col, params, reason)`` without column renaming."""
    base = "currency_like = 0 and"
    rows = [
        ("trim_whitespace", "{}", f"{whole('whitespace')} || ' white space, 0 unicode issues'",
         "whitespace > 0"),
        ("normalize_dates", "{}", "'date formats: ' || date_formats_list",
         "date_formats_odd > 0"),
        ("normalize_phone", "{}", "'phone formats: ' || phone_formats_list",
         "phone_formats_odd > 0"),
        ("normalize_currency", "{}", f"{whole('currency_like')} || ' currency cells'",
         "currency_like > 0"),
        ("fix_dtypes", '{"target": "bool"}', "'booleans stored as text'",
         f"{base} bool_as_string > 0"),
        ("fix_dtypes", '{"target": "numeric"}',
         f"{whole('numeric_as_string')} || ' numbers stored as text'",
         f"{base} bool_as_string = 0 and numeric_as_string > 0 and phone_formats = 0 "
         "and casing_raw = 0"),
        ("standardize_categories", "{}",
         f"{whole('casing_raw')} || ' spellings of ' || {whole('casing_folded')} "
         "|| ' categories'", "casing_raw > 0"),
        ("impute_missing", '{"strategy": "flag_only"}',
         "cast(null_pct as varchar) || '% missing, flagged only'",
         "null_pct > 0 and null_pct < 50"),
        ("flag_outliers", '{"method": "iqr"}',
         f"{whole('iqr_outliers')} || ' outliers, flagged only'", "iqr_outliers > 0"),
    ]
    parts = [
        f"select -1.0::double as place, 1 as rank, 'drop_blank_rows' as tool, "
        f"cast(null as varchar) as col, '{{}}' as params, {whole('blank_rows')} || ' blank rows' "
        f"as reason from {t} where blank_rows > 0",
        f"select -1.0, 2, 'drop_blank_columns', null, '{{}}', 'blank columns: ' || "
        f"string_agg(col, ', ' order by col) from {c} where blank_column > 0 "
        "having count(*) > 0",
        f"select -1.0, 3, 'drop_duplicates', null, '{{}}', {whole('duplicate_rows')} || "
        f"' repeated rows' from {t} where duplicate_rows > 0",
    ]
    parts += [f"select place, {10 + i}, {lit(tool)}, col, {lit(params)}, {reason} from {c} "
              f"where {cond}" for i, (tool, params, reason, cond) in enumerate(rows)]
    return " union all ".join(parts)


def sizes_cte(name: str, c: str, t: str) -> str:
    """CTE ``(col, issue, size)``, as the verdicts measure issues."""
    sizes = {
        "mixed_date_formats": "case when date_formats_odd > 0 then date_formats else 0 end",
        "phone_format_chaos": "case when phone_formats_odd > 0 then phone_formats else 0 end",
        "currency_strings": "currency_like", "numeric_as_string": "numeric_as_string",
        "bool_as_string": "bool_as_string", "whitespace": "whitespace",
        "casing_variants": "casing_raw - casing_folded", "nulls": "null_pct",
        "outliers": "iqr_outliers",
    }
    parts = [f"select col, {lit(i)} as issue, cast({e} as double) as size from {c}"
             for i, e in sizes.items()]
    parts += [f"select null, '{i}', cast({s} as double) from {t}"
              for i, s in (("duplicates", "duplicate_rows"), ("blank_rows", "blank_rows"))]
    return f"{name} as (select * from ({' union all '.join(parts)}) where size > 0)"


