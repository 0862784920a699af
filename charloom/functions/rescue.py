"""JSON out of a model's prose."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str) -> str | None:
    """The first balanced {...}; braces in quotes don't count, nor what a backslash protects. Quotes before the object count
    too, and a stray closing brace hides what follows until it is made up for."""
    depth, start = 0, -1
    quoted = False
    for m in re.finditer(r'\\.|["{}]', text, re.DOTALL):
        sign = m[0]
        if len(sign) == 2:
            continue
        if sign == '"':
            quoted = not quoted
        elif not quoted:
            if sign == "{":
                start = m.start() if depth == 0 else start
                depth += 1
            else:
                depth -= 1
                if depth == 0 and start >= 0:
                    return text[start : m.end()]
    return None


def fenced_json(text: str) -> str | None:
    """What a code fence holds, if it begins with a brace; else from the first { to the last }."""
    m = re.search(r"```(?:json)?\s*\n?(.*?)\n?```", text, re.DOTALL)
    if m and m[1].strip().startswith("{"):
        return m[1].strip()
    a, b = text.find("{"), text.rfind("}")
    return text[a : b + 1] if 0 <= a < b else None


def fenced_json_column(text: Column) -> Column:
    """fenced_json as a Column."""
    inner = F.regexp_replace(F.regexp_extract(text, r"(?Us)```(?:json)?\s*\n?(.*?)\n?```", 1), r"(?U)^\s+|\s+\z", "")
    first, last = F.instr(text, "{"), F.length(text) - F.instr(F.reverse(text), "}") + 1
    bare = F.when((first > 0) & (F.instr(text, "}") > 0) & (first < last), F.substr(text, first, last - first + 1))
    return F.when(F.startswith(inner, F.lit("{")), inner).otherwise(bare)


def evidence_of(item: Column) -> Column:
    """Evidence from a VARIANT item: a string, or an object's evidence or text; null where there is none."""
    strip = lambda c: F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+\z", ""), F.lit(""))
    kind = F.schema_of_variant(item)
    own = F.when(kind == "STRING", strip(F.try_variant_get(item, "$", "string")))
    part = lambda path: F.when(F.schema_of_variant(F.try_variant_get(item, path, "variant")) == "STRING", strip(F.try_variant_get(item, path, "string")))
    return F.when(kind == "STRING", own).when(F.startswith(kind, F.lit("OBJECT")), F.coalesce(part("$.evidence"), part("$.text")))
