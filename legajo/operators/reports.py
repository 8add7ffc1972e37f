"""Approved SQL templates: retrieval by words, parameters, a guard that lets only one SELECT pass, bound execution."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from legajo.functions.text import words_py

#: Rows a report shows; one more is read to tell whether it was cut.
ROWS = 500
_FORBIDDEN = re.compile(r"(?i)\b(insert|update|delete|merge|drop|alter|create|truncate|grant|revoke|call|set|use|refresh|cache|load|analyze)\b")
# Month names.
MONTHS = "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split()


@dataclass(frozen=True)
class Template:
    id: str
    title: str
    sql: str
    examples: tuple[str, ...] = ()
    parameters: dict[str, Any] = field(default_factory=dict)  # name → default

    def corpus(self) -> set[str]:
        return {w[:6] for w in words_py(" ".join((self.title, *self.examples))) if len(w) > 2}


def choose(question: str, templates: list[Template]) -> tuple[Template, float]:
    """The template that holds the largest share of the question's roots; the first one wins a tie, none is an error."""
    q = {w[:6] for w in words_py(question) if len(w) > 2}
    best, score = None, 0.0
    for t in templates:
        s = len(q & t.corpus()) / len(q) if q else 0.0
        if s > score:
            best, score = t, s
    if best is None:
        raise ValueError("no template fits")
    return best, score


def resolve(question: str, calendar: bool = False) -> dict[str, str]:
    """Dates and periods named in a question: desde, hasta, periodo. `calendar` ends months at their last day, else at 31."""
    from calendar import monthrange

    f = " ".join(words_py(question.replace("-", " ")))
    last = lambda y, m: monthrange(y, m)[1] if calendar else 31
    days = re.findall(r"\b(\d{4}) (\d{2}) (\d{2})\b", f)
    if days:
        return {"desde": "-".join(days[0]), "hasta": "-".join(days[-1])}
    if m := re.search(rf"\b({'|'.join(MONTHS)})(?: (?:de|del))? (\d{{4}})\b", f):
        y, k = int(m[2]), MONTHS.index(m[1]) + 1
        return {"periodo": f"{y}-{k:02}", "desde": f"{y}-{k:02}-01", "hasta": f"{y}-{k:02}-{last(y, k):02}"}
    if m := re.search(r"\b(?:19|20)\d{2}\b", f):
        return {"desde": f"{m[0]}-01-01", "hasta": f"{m[0]}-12-31"}
    return {}


def guard(spark: SparkSession, sql: str) -> None:
    """Raise unless sql is one query: no second statement, no command, nothing that writes. Spark's own parser decides."""
    bare = re.sub(r"'(?:[^']|'')*'", "''", re.sub(r"--[^\n]*|/\*.*?\*/", " ", sql, flags=re.S))
    if ";" in bare.rstrip().rstrip(";") or _FORBIDDEN.search(bare):
        raise ValueError("only one SELECT is allowed")
    if not re.match(r"(?is)\s*(?:select|with)\b", bare):
        raise ValueError("only SELECT is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    if "Command" in plan.getClass().getSimpleName() or "Insert" in plan.getClass().getSimpleName():
        raise ValueError("only SELECT is allowed")


def bound(template: Template, given: dict[str, Any]) -> dict[str, Any]:
    """Defaults filled in; names the template does not declare are dropped."""
    return {k: given.get(k, default) for k, default in template.parameters.items()}


def run_report(spark: SparkSession, sql: str, tables: dict[str, DataFrame], args: dict[str, Any]) -> DataFrame:
    """Guarded and bound; the tables are passed as values of the query, not as session-wide views."""
    guard(spark, sql)
    for name in sorted(tables, key=len, reverse=True):
        sql = re.sub(rf"(?i)\b(from|join)\s+{name}\b", rf"\1 {{{name}}}", sql)
    return spark.sql(sql, args=args, **tables)


def capped(df: DataFrame, rows: int = ROWS) -> tuple[list, bool]:
    """The first rows of a report, and whether there are more."""
    got = df.limit(rows + 1).collect()
    return got[:rows], len(got) > rows
