"""Secret scans by a trigram index.

Each rule's regular expression yields a Boolean query over trigrams: an OR of
ANDs that every match must satisfy (lower-cased, so that a rule which allows
either case has one spelling).  Every batch of texts gets an inverted index of
the trigrams that some rule asks for: trigram -> rows that hold it.  A rule's
query is worked out by intersecting and uniting postings, and only candidates
are searched with the expression itself.  A rule without a mandatory trigram
scans every text.  The index covers all rows and whole texts; it is made batch
by batch, so it never outgrows a task.

Null counts as an empty text.  Repeated rows come back as often as they stand;
other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import re._parser as parser
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

MOST_SPELLINGS = 32
Query = frozenset  # of frozensets of trigrams: an OR of ANDs


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` that pass ``keep`` are findings of this kind."""

    kind: str
    pattern: str
    keep: Callable[[re.Match], bool] = field(default=lambda m: True)


# The three base rules.
_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")),
                   either_case("api") + "_?" + either_case("key")])
BASE = [
    Rule("assign", rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         lambda m: m.end(2) - m.start(2) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]+", lambda m: m.end() - m.start() >= 16),
]
# A private key from its BEGIN to its END line.  Where no END follows, its body is
# the lines that hold base64 alone, or long base64 words if the line breaks were
# lost, with the shorter word that closes those.  Line breaks may be written as \\n.
_BREAK = r"(?:\s|\\[rn])"
_HEADERS = rf"(?:{_BREAK}*+(?:[A-Z][A-Za-z]*+-[A-Z][A-Za-z]*+|Version|Comment):[^\r\n\\]*+)*+"
_BLANK = r"(?:[\t\x20]*+\r?\n(?=[\t\x20]*+\r?\n))*+"
_LINE = r"[\t\x20]*+\r?\n[\t\x20]*+[A-Za-z0-9+/]++={0,2}+(?=[\t\x20]*+(?:[\r\n]|\Z))"
_WORD = rf"{_BREAK}++[A-Za-z0-9+/]{{32,}}+={{0,2}}+"
_LAST = rf"(?<=[A-Za-z0-9+/]{{32}}){_BREAK}++(?=[A-Za-z+/]*+[0-9=])[A-Za-z0-9+/]++={{0,2}}+"
_PEM = (rf"-----BEGIN [A-Z ]{{0,30}}PRIVATE KEY-----{_HEADERS}"
        rf"(?:[\sA-Za-z0-9+/=\\\"',>#|*]*+-----END [A-Z ]{{0,30}}PRIVATE KEY-----"
        rf"|(?:{_BLANK}(?={_LINE}|{_WORD}))?(?:{_LINE}|{_WORD})*+(?:{_LAST})?)")
#: Further kinds that the scan adds.
MORE = [
    Rule("pem", _PEM),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{30,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"[Bb]earer\x20[A-Za-z0-9._~+/-]{20,}"),
]


def _classes(node) -> set[str] | None:
    """The lower-cased characters of a small class, or None."""
    op, value = node
    if op is parser.LITERAL:
        return {chr(value).lower()} if value < 128 else None
    if op is parser.IN and all(x[0] is parser.LITERAL and x[1] < 128 for x in value):
        return {chr(x[1]).lower() for x in value}
    return None


def _trigrams(texts: set[str]) -> Query | None:
    """The query that holds where one of ``texts`` stands; None: always."""
    if any(len(t) < 3 for t in texts):
        return None
    return frozenset(frozenset(t[i:i + 3] for i in range(len(t) - 2)) for t in texts)


def _both(a: Query | None, b: Query | None) -> Query | None:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > MOST_SPELLINGS:
        return min(a, b, key=len)
    return frozenset(x | y for x, y in product(a, b))


def _walk(nodes) -> tuple[set[str] | None, Query | None]:
    """All spellings of a sequence if they are few, and its query."""
    exact: set[str] | None = {""}
    run: set[str] = {""}  # spellings since the last part that has too many
    query: Query | None = None
    for op, value in nodes:
        part: set[str] | None = None
        inner: Query | None = None
        chars = _classes((op, value))
        if chars is not None:
            part = chars
        elif op is parser.SUBPATTERN:
            part, inner = _walk(value[3])
        elif op is parser.BRANCH:
            found = [_walk(b) for b in value[1]]
            if all(f[0] is not None for f in found):
                part = set().union(*(f[0] for f in found))
            if all(f[1] is not None for f in found):
                inner = frozenset().union(*(f[1] for f in found))
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            least, most, body = value
            one, asked = _walk(body)
            if one is not None and most <= 4 and len(one) ** most <= MOST_SPELLINGS:
                part = {"".join(x) for k in range(least, most + 1) for x in product(one, repeat=k)}
            elif least:
                inner = asked
        elif op is parser.AT:
            part = {""}
        if part is not None and len(run) * len(part) <= MOST_SPELLINGS:
            run = {a + b for a in run for b in part}
            exact = run if exact is not None else None
        else:
            query = _both(_both(query, _trigrams(run)), inner if inner else
                          _trigrams(part) if part else None)
            run, exact = {""}, None
    return exact, _both(query, _trigrams(run))


def trigram_query(pattern: str) -> Query | None:
    """What every match of ``pattern`` must hold; None if nothing is mandatory."""
    return _walk(parser.parse(pattern))[1]


class Scanner:
    """Finds the spans of all rules in a batch of texts."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.found = [re.compile(r.pattern).finditer for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.wanted = sorted({t for q in self.queries if q for all_of in q for t in all_of})

    def index(self, texts: list[str]) -> dict[str, set[int]]:
        """The postings of each wanted trigram."""
        postings: dict[str, set[int]] = {t: set() for t in self.wanted}
        for row, text in enumerate(texts):
            folded = text.lower()
            for trigram in self.wanted:
                if trigram in folded:
                    postings[trigram].add(row)
        return postings

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of every finding of every text, sorted."""
        texts = [t or "" for t in texts]
        postings = self.index(texts)
        spans: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, finditer) in enumerate(
                zip(self.rules, self.queries, self.found, strict=True)):
            rows = range(len(texts)) if query is None else sorted(set().union(
                *(reduce(set.intersection, (postings[t] for t in all_of)) for all_of in query)))
            for row in rows:
                spans[row] += [(m.start(), k, m.end()) for m in finditer(texts[row])
                               if rule.keep(m)]
        return [sorted(s) for s in spans]


def secret_scan(df: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """id and ``spans`` array<struct<kind, start, end>> (code points) of every
    row, by start, then rule."""
    rules = BASE + MORE if rules is None else rules
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        scan = Scanner(rules)

        def find(ids, texts):
            return ids, [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in row]
                         for row in scan(texts)]
        return find

    return map_rows(df.select(id_col, text_col), make,
                    f"`{id_col}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redact(df: DataFrame, rules: list[Rule] | None = None, text_col: str = "text",
           mark: str = "[SECRET]") -> DataFrame:
    """All columns and rows, with every finding in ``text_col`` replaced by
    ``mark``; overlapping findings become one mark.  Null stays null."""
    rules = BASE + MORE if rules is None else rules

    def run(batches):
        import pyarrow as pa

        scan = Scanner(rules)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = batch.column(at).to_pylist()
            clean = []
            for text, spans in zip(texts, scan(texts), strict=True):
                out, done = [], 0
                for start, _, end in spans:
                    if start >= done:
                        out += [text[done:start], mark]
                    done = max(done, end)
                clean.append("".join([*out, text[done:]]) if spans else text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, base),
        F.sha2(text(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"))
