"""Text columns: names, lists, URLs, markup, facts. Built-in expressions unless said otherwise."""

from __future__ import annotations

import base64
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tidy(x: Column | str) -> Column:
    """Single spaces, none around."""
    return F.trim(F.regexp_replace(_c(x), r"\s+", " "))


def entity_key(x: Column | str) -> Column:
    """Name for comparison: lower case, qualifiers between slashes dropped, punctuation to spaces."""
    return tidy(F.regexp_replace(F.regexp_replace(F.lower(_c(x)), r"/[a-z]{2,3}/?", " "), r"[^\p{L}\p{N}]+", " "))


#: Endings that name the legal form (fixed values).
LEGAL_FORMS = ("inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "llc", "plc", "sa", "ag", "nv", "group", "holdings")


def alias_keys(x: Column | str) -> Column:
    """The key and, where it ends in a legal form, the key without it."""
    k = entity_key(x)
    short = tidy(F.regexp_replace(k, rf"( (?:{'|'.join(LEGAL_FORMS)}))+$", ""))
    return F.array_distinct(F.array(k, short))


def delimited(x: Column | str, sep: str = ";", most: int | None = None) -> Column:
    """Parts of a delimited list without empty ones; at most ``most`` where given."""
    parts = F.filter(F.transform(F.split(_c(x), re.escape(sep)), lambda p: F.trim(p)), lambda p: p != "")
    return F.slice(parts, 1, most) if most else parts


def organisations(x: Column | str) -> Column:
    """Names of a list ``name,offset;...`` in order, duplicates kept."""
    return F.transform(delimited(x), lambda p: F.regexp_replace(p, r",[0-9]+$", ""))


def themes(x: Column | str) -> Column:
    """Sorted distinct upper-case themes of a list ``THEME,offset;...`` that look like themes."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(delimited(x), lambda p: F.upper(F.substring_index(p, ",", 1))), lambda p: p.rlike("^[A-Z][A-Z0-9_]*$"))))


def first_marker(x: Column | str, rules: list[tuple[str, str]], other: str) -> Column:
    """Label of the first rule whose pattern occurs in the text."""
    out = F.lit(other)
    for pattern, label in reversed(rules):
        out = F.when(_c(x).rlike(pattern), label).otherwise(out)
    return out


def normal_url(x: Column | str) -> Column:
    """Scheme and host in lower case, no query, fragment or default port; null with user information or without a host."""
    u = F.trim(_c(x))
    scheme, host, path = (F.regexp_extract(u, r"^(?i)(https?)://([^/?#@]+)([^?#]*)", i) for i in (1, 2, 3))
    clean = F.concat(F.lower(scheme), F.lit("://"), F.regexp_replace(F.lower(host), r":(80|443)$", ""), F.when(path == "", "/").otherwise(path))
    return F.when((host != "") & ~u.rlike(r"^[^/]*//[^/]*@"), clean)


def redact(x: Column | str) -> Column:
    """Credentials replaced: key=value pairs of secret names and bearer tokens."""
    y = F.regexp_replace(_c(x), r"(?i)\b(api[_-]?key|token|secret|password)\s*[=:]\s*[^\s&,;]+", "$1=[REDACTED]")
    return F.regexp_replace(y, r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [REDACTED]")


def option_symbol(x: Column | str) -> Column:
    """Parts of a 21-character option symbol: root, expiry, right, strike in thousandths; null if it isn't one."""
    v = _c(x)
    ok = v.rlike(r"^[A-Z]{1,6} {0,5}[0-9]{6}[CP][0-9]{8}$") & (F.length(v) == 21)
    return F.when(ok, F.struct(F.trim(F.substring(v, 1, 6)).alias("root"), F.try_to_date(F.concat(F.lit("20"), F.substring(v, 7, 6)), "yyyyMMdd").alias("expiry"), F.substring(v, 13, 1).alias("right"), F.substring(v, 14, 8).cast("long").alias("strike_milli")))


def is_symbol(x: Column | str) -> Column:
    return _c(x).rlike(r"^[A-Z][A-Z0-9.]{0,9}$")


#: Frequent small words by language (fixed values).
MARKERS = {
    "en": ("the", "and", "of", "to", "in", "for", "with", "is", "at", "on"),
    "es": ("el", "la", "de", "los", "en", "por", "con", "una", "del", "que"),
    "fr": ("le", "la", "les", "des", "du", "et", "en", "une", "pour", "est"),
}


def _any_of(values: tuple[str, ...]):
    return lambda w: w.isin(*values)


def language(x: Column | str, least: int = 3) -> Column:
    """Language whose marker words are most frequent, ``und`` below ``least`` or on a tie."""
    ws = F.split(F.lower(F.coalesce(_c(x), F.lit(""))), r"[^\p{L}]+")
    n = {k: F.size(F.filter(ws, _any_of(v))) for k, v in MARKERS.items()}
    best = F.greatest(*n.values())
    out = F.lit("und")
    for k, v in n.items():
        others = [o for j, o in n.items() if j != k]
        out = F.when((v >= least) & (v > F.greatest(*others)), k).otherwise(out)
    return F.when(best >= least, out).otherwise("und")


def sentences(x: Column | str) -> Column:
    return F.filter(F.split(F.coalesce(_c(x), F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


#: Phrases that try to instruct a reader that follows instructions (fixed values).
INSTRUCTION_PATTERNS = (
    r"\bignore\s+(all\s+)?(previous\s+|prior\s+)?(system\s+)?instructions?\b",
    r"\b(system|developer|assistant)\s*prompt\b",
    r"\b(reveal|print|return|exfiltrate)\b.{0,48}\b(secret|credential|token|prompt)\b",
    r"\b(call|invoke|use)\b.{0,32}\b(tool|function|shell|terminal)\b",
    r"\bchange\b.{0,32}\b(configuration|policy|instructions?)\b",
    r"\bdo\s+not\s+follow\b.{0,32}\b(policy|instructions?)\b",
    r"\b(begin|end)\s+(system|developer|assistant)\s+message\b",
    r"\b(javascript|data\s*:\s*text/html)\s*:",
)
INSTRUCTIONS = "(?i)" + "|".join(INSTRUCTION_PATTERNS)


def suspicious(x: Column | str) -> Column:
    """Whether a sentence instructs its reader."""
    return F.exists(sentences(x), lambda s: s.rlike(INSTRUCTIONS))


@F.pandas_udf(StringType())
def decoded_suspicious(texts: pd.Series) -> pd.Series:
    """The first base64 part of a text that decodes to such a phrase, else null (Python: there is no built-in that tries)."""
    word, phrase = re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(INSTRUCTIONS)

    def look(t: str | None) -> str | None:
        for m in word.finditer(t or ""):
            try:
                s = base64.b64decode(m.group() + "=" * (-len(m.group()) % 4), validate=True).decode("utf-8")
            except ValueError:
                continue
            if phrase.search(s):
                return m.group()
        return None

    return texts.map(look)


class _Visible(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in ("script", "style", "template")
        self.parts.append(" " if tag not in ("b", "i", "em", "strong", "span", "a", "u", "sub", "sup", "small") else "")

    def handle_endtag(self, tag: str) -> None:
        self.hidden -= tag in ("script", "style", "template") and self.hidden > 0
        self.parts.append(" " if tag not in ("b", "i", "em", "strong", "span", "a", "u", "sub", "sup", "small") else "")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(data)


@F.pandas_udf(StringType())
def visible_text(texts: pd.Series) -> pd.Series:
    """Text that a reader of the page sees, single-spaced (Python: needs a parser). Null stays null."""

    def strip(t: str | None) -> str | None:
        if t is None or "<" not in t and "&" not in t:
            return None if t is None else " ".join(t.split())
        p = _Visible()
        p.feed(t)
        p.close()
        return " ".join("".join(p.parts).split())

    return texts.map(strip, na_action="ignore")


def facts(x: Column | str, pattern: str) -> Column:
    """All matches of a pattern's first group, in order."""
    return F.regexp_extract_all(F.coalesce(_c(x), F.lit("")), F.lit(pattern), F.lit(1))
