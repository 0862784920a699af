"""String operators as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The patterns that count as prompt injection; all but the last in either case.
INJECTION = (
    r"ignore\s+(all\s+)?previous\s+instructions?",
    r"忽略(之前|上面|前面)的?(指令|说明|内容)",
    r"output\s+mentions\s*=\s*[\[\{]",
    r"输出(空|空\s*的)?\s*mentions\s*=",
    r"respond\s+(only\s+)?with",
)
INJECTION_EXACT = (r"(只|仅)\s*输出\s*[:：]?\s*[\{\[]",)
CJK = r"\x{4e00}-\x{9fa5}"


#: What (?U)\s matches.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = r"[\t-\r \x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(c: Column) -> Column:
    """Without Unicode white space on both sides."""
    return F.btrim(c, F.lit(SPACE))


def blank(c: Column) -> Column:
    return ~c.rlike(r"(?U)\S")


#: Literals that each of the patterns needs, in letters that have no other lower-case form than the ASCII one.
NEEDED = ("gnore", "忽略", "utput", "输出", "pond", "输出")


def injected(c: Column) -> Column:
    """Whether a text tries to steer a model; null counts as not. A pattern is looked for only where its literal is found."""
    small = F.lower(c)
    patterns = [*("(?iU)" + p for p in INJECTION), *("(?U)" + p for p in INJECTION_EXACT)]
    found = [F.contains(small, F.lit(n)) & c.rlike(p) for n, p in zip(NEEDED, patterns)]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))


def evidence_valid(evidence: Column, text: Column) -> Column:
    """Non-empty, and its stripped form is in the text; white space alone passes."""
    return F.coalesce((evidence != "") & F.contains(text, strip(evidence)), F.lit(False))


def _more_than_64(c: Column, kept: str) -> Column:
    """Whether a text has more than 64 of the kept characters; a long one is read no further than that."""
    return c.rlike(f"^(?:[^{kept}]*+[{kept}]){{65}}")


def slugify(name: Column, fallback: str = "persona") -> Column:
    small = F.lower(strip(name))
    n = F.regexp_replace(small, f"(?:{SPACES}|_)+", "-")
    n = F.regexp_replace(n, f"[^{CJK}a-z0-9-]+", "-")
    n = F.regexp_replace(F.regexp_replace(n, "-+", "-"), "^-|-$", "")
    # what is kept only gets longer by dashes, so most long texts need no slug to be made
    return F.when(_more_than_64(small, f"{CJK}a-z0-9"), F.lit(fallback)).when(n.rlike(f"^[a-z0-9{CJK}][a-z0-9{CJK}-]{{0,63}}$"), n).otherwise(F.lit(fallback))


def slugify_persona_id(name: Column) -> Column:
    n = F.regexp_replace(F.lower(strip(name)), f"{SPACES}+", "_")
    return F.regexp_replace(F.regexp_replace(n, f"[^{CJK}a-z0-9_]+", ""), "^_+|_+$", "")


def sanitize_skill_name(name: Column, fallback: Column | str = "skill") -> Column:
    small = F.lower(strip(name))
    n = F.regexp_replace(small, "[^a-z0-9-]+", "-")
    n = F.regexp_replace(F.regexp_replace(n, "-+", "-"), "^-|-$", "")
    fallback = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(_more_than_64(small, "a-z0-9"), fallback).when(n.rlike("^[a-z0-9][a-z0-9-]{0,63}$"), n).otherwise(fallback)


def list_split(text: Column) -> Column:
    """Items between the list signs, stripped, without empty ones and repeats."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"[、，,；;|｜\n]+"), strip)
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def keywords(text: Column) -> Column:
    """CJK runs of two characters or more, then Latin words of three letters or more."""
    return F.concat(F.regexp_extract_all(text, F.lit(f"[{CJK}]{{2,}}"), F.lit(0)), F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), F.lit(0)))


def split_probe(text: Column) -> Column:
    """Segments that start at each `Q:`; fewer than two marks leave the text whole, an empty text gives none."""
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)q:.*?(?=q:|\z)"), F.lit(0)), strip), lambda p: p != "")
    whole = strip(text)
    none = F.array().cast("array<string>")
    return F.when(F.regexp_count(text, F.lit("(?i)q:")) >= 2, parts).when(text == "", none).otherwise(F.array(whole))


def fuzzy_match(guess: Column, display_name: Column, persona_id: Column) -> Column:
    """Whether the guess and one of the names hold each other, in small letters."""
    g = F.lower(strip(guess))
    one = lambda n: (n != "") & (F.contains(F.lower(n), g) | F.contains(g, F.lower(n)))
    return F.coalesce(g != "", F.lit(False)) & (F.coalesce(one(display_name), F.lit(False)) | F.coalesce(one(persona_id), F.lit(False)))


def ensure_unique(name: str, taken) -> str:
    """The name, or with the first free suffix from -2 on. Only for the handful of names of one output."""
    if name not in taken:
        return name
    i = 2
    while f"{name}-{i}" in taken:
        i += 1
    return f"{name}-{i}"
