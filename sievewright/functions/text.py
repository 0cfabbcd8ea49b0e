"""Column expressions for text: folding, tokens, normalisation, ids, line numbers, URLs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token patterns of the retrieval index (identifiers with joins, numbers, CJK runs; parts of camel case).
RAW_TOKEN = r"[A-Za-z_][A-Za-z0-9_]*(?:[.:/\\-][A-Za-z0-9_]+)*|[0-9]+(?:\.[0-9]+)*|[㐀-䶿一-鿿]+"
CAMEL_PART = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z]|$)|[0-9]+"
CJK_RUN = r"^[㐀-䶿一-鿿]+$"


def casefold(x: Column) -> Column:
    """Lower case with sharp s as ss, which is full case folding for the scripts at hand."""
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def raw_tokens(text: Column) -> Column:
    """The identifiers, numbers and CJK runs of a text, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RAW_TOKEN), F.lit(0))


def expanded(raw: Column) -> Column:
    """The index tokens of one raw token.

    An identifier gives itself, its components and the camel-case parts of each
    component that has several; a CJK run gives itself and its bigrams.
    """

    def parts(c: Column) -> Column:
        camel = F.regexp_extract_all(c, F.lit(CAMEL_PART), F.lit(0))
        own = F.when(casefold(c) != casefold(raw), F.array(casefold(c))).otherwise(F.array().cast("array<string>"))
        return F.concat(own, F.when(F.size(camel) > 1, F.transform(camel, casefold)).otherwise(F.array().cast("array<string>")))

    n = F.length(raw)
    bigrams = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(raw, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    components = F.filter(F.split(raw, r"[.:/\\-]+"), lambda c: c != "")
    plain = F.concat(F.array(casefold(raw)), F.flatten(F.transform(components, parts)))
    # most words have neither joins nor inner capitals, digits or underscores: they are one token
    return F.when(~raw.rlike(r".[A-Z0-9_.:/\\-]|[^\x00-\x7F]"), F.array(F.lower(raw))).when(raw.rlike(CJK_RUN), F.concat(F.array(raw), bigrams)).otherwise(plain)


def tokens(text: Column) -> Column:
    """Index tokens of a text in order, repeats included."""
    return F.flatten(F.transform(raw_tokens(text), expanded))


_RAW, _CAMEL, _CJK, _JOINED = (re.compile(p) for p in (RAW_TOKEN, CAMEL_PART, CJK_RUN, r"[.:/\\-]+"))
_PARTED = re.compile(r".[A-Z0-9_.:/\\-]|[^\x00-\x7F]")
#: Different raw tokens whose index tokens a worker keeps.
KNOWN_TOKENS = 200_000


def token_list(raw: str) -> list[str]:
    """``expanded`` in Python: raw tokens have no letters but ASCII ones and CJK, which both fold alike."""
    if not _PARTED.search(raw):
        return [raw.lower()]
    if _CJK.match(raw):
        return [raw, *(raw[i : i + 2] for i in range(len(raw) - 1))]
    low = raw.lower()
    out = [low]
    for c in filter(None, _JOINED.split(raw)):
        camel = _CAMEL.findall(c)
        out += [c.lower()] if c.lower() != low else []
        out += [x.lower() for x in camel] if len(camel) > 1 else []
    return out


class Known(dict):
    """What a function gives for the values met so far, ``most`` of them at once."""

    def __init__(self, of: Callable, most: int):
        self.of, self.most = of, most

    def __missing__(self, value):
        if len(self) >= self.most:
            self.clear()
        self[value] = out = self.of(value)
        return out


def token_counts(text: str, known: Known) -> dict[str, int]:
    """How often a text has each of its index tokens (``tokens``); known: ``token_list`` of the raw tokens met so far."""
    out: dict[str, int] = {}
    get = out.get
    for raw, n in Counter(_RAW.findall(text)).items():
        for term in known[raw]:
            out[term] = get(term, 0) + n
    return out


def tidy(text: Column) -> Column:
    """Line ends as \\n, runs of blanks as one, no blanks around line ends, at most one empty line, trimmed."""
    x = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t\f\x0b ]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, " ?\n ?", "\n"), "\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^[ \n]+|[ \n]+$", "")


def hashed_id(prefix: str, size: int, *parts: Column) -> Column:
    """prefix + the first ``size`` hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, size))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a code-point offset."""
    before = F.substring(text, F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without credentials, end dots, the default port and the fragment; the path is / at least."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    host = F.regexp_replace(host, r"\.+(?=:[0-9]+$|$)", "")
    rest = F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    path = F.when((rest == "") | rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(scheme != "", F.concat(scheme, F.lit("://"), host, path))


def redacted(text: Column, limit: int | None = 400) -> Column:
    """Diagnostics without keys, bearer tokens and home folders, cut to ``limit`` characters if it is not None."""
    x = F.regexp_replace(text, r"(?i)\b(api[_-]?key|token|secret|password|authorization)(\s*[=:]\s*)(?:bearer\s+)?[\"']?[^\s\"',;]+[\"']?", "$1$2[redacted]")
    x = F.regexp_replace(x, r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
    x = F.regexp_replace(x, r"\b(?:sk-[A-Za-z0-9_-]{8,}|gh[opsur]_[A-Za-z0-9]{8,})", "[redacted]")
    x = F.regexp_replace(x, r"(?:/home/|/Users/|[A-Za-z]:\\\\Users\\\\)[^\s/\\\\]+", "[home]")
    return x if limit is None else F.substring(x, 1, limit)
