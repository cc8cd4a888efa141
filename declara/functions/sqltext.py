"""Names, templates and messages as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def substituted(text: Column, variables: dict[str, str]) -> Column:
    """``{{name}}`` replaced for each variable in turn; unknown ones stay."""
    return reduce(lambda c, kv: F.replace(c, F.lit("{{" + kv[0] + "}}"), F.lit(str(kv[1]))), variables.items(), text)


def name_parts(name: Column) -> Column:
    return F.transform(F.split(name, r"\."), lambda p: F.upper(F.regexp_replace(F.trim(p), r'^"+|"+$', "")))


def resolved(name: Column, schema: Column) -> Column:
    """Upper-cased name without quotes; one of one part gets the schema in use, if any."""
    parts = name_parts(name)
    return F.when((F.size(parts) == 1) & (F.coalesce(schema, F.lit("")) != ""), F.concat_ws(".", F.upper(schema), parts[0])).otherwise(F.array_join(parts, "."))


def error_code(message: Column) -> Column:
    """The six digits an error message starts with, alone or before a state in parentheses."""
    return F.nullif(F.regexp_extract(message, r"^(\d{6})(?:\s*\([^)]*\))?:", 1), F.lit(""))


def web_address(text: Column) -> Column:
    """The first https address of a text; null without one."""
    return F.nullif(F.regexp_extract(text, r"https://[^\s]+", 0), F.lit(""))


def path_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def underlined(line: Column, part: Column) -> Column:
    """A line of carets below the first place of ``part``; empty where it does not occur."""
    at = F.instr(line, part)
    return F.when(at > 0, F.concat(F.repeat(F.lit(" "), at - 1), F.repeat(F.lit("^"), F.length(part)))).otherwise("")
