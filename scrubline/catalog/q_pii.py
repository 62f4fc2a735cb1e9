"""Queries that find and mask personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masks
from ..plans import pii
from .q_columns import duck_rewrite
from .registry import query
from .views import table, view

CUSTOMERS = ("dirty_customers",)
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
PHONE = r"(?:\+?63|0)[\s.-]?9\d{2}[\s.-]?\d{3}[\s.-]?\d{4}"
NAME = r"\b([A-Z][a-z]+)(\s+(?:[A-Z][a-z]+|[A-Z]\.)){1,3}\b"
# DuckDB's \w is ASCII only; this is the Unicode class.
WORD = r"\p{L}\p{N}_"
EMAIL_U = EMAIL.replace(r"\w", WORD)
# Presence of a name with Unicode word boundaries, which RE2 has no sign for.
NAME_U = (rf"(?:^|[^{WORD}])[A-Z][a-z]+(?:\s+(?:[A-Z][a-z]+|[A-Z]\.)){{0,2}}"
          rf"\s+(?:[A-Z][a-z]+(?:$|[^{WORD}])|[A-Z]\.[{WORD}])")
TEXTS = ["full_name", "email", "phone", "segment"]
ALL = ["customer_id", *TEXTS, "balance"]


def _hits(pattern: str, c: str) -> str:
    return f"count(*) filter (where regexp_matches(cast({c} as varchar), '{pattern}'))"


_COUNTS = " union all ".join(
    f"select '{c}' as col, count({c}) as n_cells, {_hits(EMAIL_U, c)} as email, "
    f"{_hits(PHONE, c)} as ph_phone, {_hits(NAME, c)} as person_name from dirty_customers"
    for c in ALL)
_SCAN = f"""
select * from (select *, sensitive_name as s, case
  when email + ph_phone > 0 and greatest(email, ph_phone, person_name) > 0.5 * n_cells
    then 'high'
  when sensitive_name and email + ph_phone + person_name > 0 then 'high'
  when email + ph_phone + person_name > 0 then 'medium'
  when sensitive_name then 'low' end as risk
from (select *, regexp_matches(col, '(?i)(name|email|phone|mobile|contact|address|street|birth'
  || '|dob|ssn|tin|passport|id_?number)') as sensitive_name from ({_COUNTS})))
where risk is not null"""


@query("pii_scan", uses=CUSTOMERS, sql=f"select * exclude (s, risk) from ({_SCAN})")
def _(spark, sf):
    return pii.pii_scan(view(spark, sf, "dirty_customers")).drop("risk")


@query("pii_scan_documents", sql=f"""
select 'text' as col, count(*) as n_cells, {_hits(EMAIL_U, 'text')} as email,
  {_hits(PHONE, 'text')} as ph_phone, {_hits(NAME_U, 'text')} as person_name from documents""")
def _(spark, sf):
    return pii.pii_counts(table(spark, sf, "documents").select("text"))


@query("pii_risk", uses=CUSTOMERS, sql=f"select col, risk from ({_SCAN})")
def _(spark, sf):
    return pii.pii_scan(view(spark, sf, "dirty_customers")).select("col", "risk")


@query("pii_summary", uses=CUSTOMERS, sql=f"""
select cast(6 as bigint) as n_columns_scanned, count(*) as n_columns_with_pii,
  case when bool_or(risk = 'high') then 'high' when bool_or(risk = 'medium') then 'medium'
    when bool_or(risk = 'low') then 'low' else 'none' end as highest_risk from ({_SCAN})""")
def _(spark, sf):
    df = view(spark, sf, "dirty_customers")
    return pii.pii_summary(pii.pii_scan(df), len(df.columns))


@query("mask_email", uses=CUSTOMERS, sql=r"""
select customer_id, regexp_replace(email,
  '([\w.+-])[\w.+-]*@([\w-])[\w-]*(?:\.[\w-]+)*\.([\w-]+)', '\1***@\2***.\3', 'g') as email
from dirty_customers""")
def _(spark, sf):
    df = view(spark, sf, "dirty_customers")
    return df.select("customer_id", masks.mask_email(F.col("email")).alias("email"))


@query("mask_phone", uses=CUSTOMERS, sql=r"""
select customer_id, regexp_replace(regexp_replace(phone,
  '\+?63[\s.-]?9\d{2}[\s.-]?\d{3}[\s.-]?(\d{4})', '63**-***-\1', 'g'),
  '0[\s.-]?9\d{2}[\s.-]?\d{3}[\s.-]?(\d{4})', '09**-***-\1', 'g') as phone
from dirty_customers""")
def _(spark, sf):
    df = view(spark, sf, "dirty_customers")
    return df.select("customer_id", masks.mask_phone(F.col("phone")).alias("phone"))


@query("mask_long_digits", sql=f"""
select doc_id, {duck_rewrite('text', '[0-9]{7,}', "rpad(m[1:2], length(m)::integer, '*')")}
  as text from documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", masks.mask_long_digits(F.col("text")).alias("text"))


_INITIALS = (r"array_to_string(list_transform(string_split_regex(m, '\s+'), "
             "lambda w: rpad(w[1], length(w)::integer, '*')), ' ')")


@query("mask_names", uses=CUSTOMERS, sql=f"""
select customer_id, {duck_rewrite('full_name', NAME, _INITIALS)} as full_name
from dirty_customers""")
def _(spark, sf):
    df = view(spark, sf, "dirty_customers")
    return df.select("customer_id", masks.mask_names(F.col("full_name")).alias("full_name"))


@query("mask_all")
def _(spark, sf):
    """Whole documents; the order of the masks is checked by a test."""
    return table(spark, sf, "documents").select(
        "doc_id", masks.mask_all(F.col("text")).alias("text"))


def _whole(c: str) -> str:
    return (f"case when length({c}) <= 2 then repeat('*', length({c})) else left({c}, 1) || "
            f"repeat('*', least(length({c}) - 2, 8)) || right({c}, 1) end")


@query("mask_sensitive_columns", uses=CUSTOMERS, sql=f"""
select * replace ({', '.join(f'{_whole(c)} as {c}' for c in TEXTS if c != 'segment')})
from dirty_customers""")
def _(spark, sf):
    return pii.mask_table(view(spark, sf, "dirty_customers"), ["full_name", "email", "phone"])


@query("pii_rows", sql=f"""
select doc_id, array_to_string(list_filter([case when regexp_matches(text, '{EMAIL_U}') then 'email' end,
  case when regexp_matches(text, '{PHONE}') then 'ph_phone' end,
  case when regexp_matches(text, '{NAME_U}') then 'person_name' end], lambda x: x is not null), ',')
  as pii_kinds from documents where regexp_matches(text, '{EMAIL_U}|{PHONE}|{NAME_U}')""")
def _(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    return pii.pii_rows(df, ["text"]).select(
        "doc_id", F.array_join("pii_kinds", ",").alias("pii_kinds"))
