"""Personal data: fixed kinds, and identifiers found by bootstrapped contexts.

Fixed kinds (email, ip, card, phone) are regular expressions with their checks. Their
matches, and long hexadecimal strings, are seed entities. The words to the left of an
entity are a lexical pattern: a key with its separator (``token = "``), or else the two
words before. Patterns and instances make a bipartite graph, scored for a few rounds in
Spark: a pattern by the mean score of its instances, an instance by the patterns it
stands in. Patterns of high confidence, seen with enough different seeds, then discover
identifiers of any shape (kind ``id``) wherever they stand.

Only DataFrame functions are used. Positions are found row by row, and only (pattern,
instance) counts are shuffled. Up to LITERALS accepted patterns are sent back as
literals; if there are more, the patterns of each row are joined with their table.

Null texts are empty ones (and stay null where text is replaced); repeated rows, and rows
with a null doc_id, are searched each; an empty table gives no rows. Very long texts are
searched whole, their matches in blocks. Spans of one start are listed in the order of
KINDS. ``replaced`` carries other columns along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.common import few
from .common import dealt_join, written

KINDS = ("email", "ip", "card", "phone", "id")
# The contract's expressions. Possessive quantifiers and the look-behind only save
# retries that cannot succeed: a run of these characters matches from its start or not at all.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-shaped: 8 characters or more with a digit.
CANDIDATE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{7,}+"
SEED = "^(?=.*[a-f])(?=.*[0-9])[0-9a-f]{32,64}$"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
ROUNDS = 3
CONFIDENCE = 0.9
#: Different seeds that a pattern needs.
SEEDS = 5
#: Accepted patterns that are sent as literals; more of them stay a table.
LITERALS = 1000
#: Parts of a pattern's rows if the table of accepted ones is too large for a broadcast.
SALTS = 16

#: Matches that are walked together, and characters of a part of a text.
BLOCK = 64
PART = 4096

PREFIX = "pii: "
_BASE, _LISTED, _PARTS = (f"{PREFIX}{x}" for x in ("base", "listed", "parts"))
_SPAN = "array<struct<s:int,e:int,m:string,left:string>>"


def matched(text: Column, regex: str, gate: Column) -> Column:
    """Matches of ``regex`` in order, each with the length of the gap before it and the 48 characters before it."""
    matches = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(matches))
    pairs = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m"), F.right(g, F.lit(48)).alias("left")))
    return F.when(gate, pairs).otherwise(F.array().cast("array<struct<g:int,m:string,left:string>>"))


def _numbers(xs: Column) -> Column:
    """Numbers of the blocks of an array, from 0."""
    return F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))


def _block(xs: Column, k: Column) -> Column:
    return F.slice(xs, k * BLOCK + 1, F.lit(BLOCK))


def located(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns of matches as spans with start, end (code points), the match and what stands before it.

    Matches are walked in blocks, whose lengths are summed in a step before, so a text with very many matches
    costs little more for each than one with few. A step reads the one before twice, which keeps them apart.
    """
    length = lambda xs: F.aggregate(xs, F.lit(0), lambda n, x: n + x["g"] + F.length(x["m"]))
    rest = [F.col(f"`{c}`") for c in rows.columns]
    lengths = lambda c: F.transform(_numbers(F.col(c)), lambda k: length(_block(F.col(c), k)))
    kept = [c for c in rows.columns if c not in names]
    rows = rows.select(*rest, *(lengths(c).alias(f"{c} sums") for c in names))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), x["m"].alias("m"), x["left"].alias("left")))).alias("out"))

    def spans_of(c: str) -> Column:
        sums = F.col(f"{c} sums")
        before = lambda k: F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda n, x: n + x)
        first = lambda k: F.struct(before(k).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.flatten(F.transform(sums, lambda _, k: F.aggregate(_block(F.col(c), k), first(k), step, lambda acc: acc["out"])))

    return rows.select(*(F.col(f"`{c}`") for c in kept), *(spans_of(c).alias(c) for c in names))


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(number)

    def add(acc: Column, i: Column) -> Column:
        digit = F.substring(number, n - i + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def searches(text: Column) -> list[Column]:
    """For each kind, all matches of its expression."""
    digits = text.rlike("[0-9]")
    return [matched(text, EMAIL, F.contains(text, F.lit("@"))), matched(text, IP, digits), matched(text, CARD, digits), matched(text, PHONE, F.contains(text, F.lit("+"))), matched(text, CANDIDATE, digits)]


def passing(kind: str) -> Column:
    """Of a fixed kind's spans those that pass its check."""
    plain = lambda m: F.regexp_replace(m, "[^0-9]", "")
    long_enough = lambda x, lo, hi: F.length(plain(x["m"])).between(lo, hi)
    checks = {
        "ip": lambda x: x["m"].rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$"),
        "card": lambda x: F.when(long_enough(x, 12, 19), luhn(plain(x["m"]))).otherwise(False),
        "phone": lambda x: long_enough(x, 9, 15),
    }
    column = F.col(f"`{PREFIX}{kind}`")
    return F.filter(column, checks[kind]) if kind in checks else column


def pattern(left: Column) -> Column:
    """The lexical pattern of what stands before an entity: key and separator, or the two words before."""
    low = F.lower(F.regexp_replace(left, r"\s+", " "))
    key = F.regexp_extract(low, r"([\p{L}_.-]{2,24} ?[=:#] ?[\"'(\[]?)$", 1)
    return F.when(key != "", key).otherwise(F.regexp_extract(low, r"(?<!\S)([\p{L},.;]{1,20} [\p{L},.;]{1,20} )$", 1))


def _matched(rows: DataFrame, good: DataFrame) -> DataFrame:
    """``rows`` with, prefixed, the accepted patterns that stand in each row, as an array or null."""
    key, found = f"{PREFIX}row", f"{PREFIX}good"
    rows = written(rows.withColumn(key, F.monotonically_increasing_id()), "pii-rows")  # the numbers are fixed once written
    text = F.coalesce(F.col("text"), F.lit(""))
    each = F.array_distinct(F.transform(matched(text, CANDIDATE, text.rlike("[0-9]")), lambda x: pattern(x["left"])))
    asked = rows.select(key, F.explode(each).alias("pattern"))
    if few(good):
        met = asked.join(F.broadcast(good), "pattern")
    else:  # a pattern that very many rows have is dealt out
        salted = good.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        met = asked.withColumn("salt", F.pmod(F.col(key), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"])
    met = met.groupBy(key).agg(F.collect_set("pattern").alias(found))
    return rows.join(met, key, "left").drop(key)


def _with_kinds(rows: DataFrame, good: DataFrame | None, keep: list[str]) -> DataFrame:
    """The columns to keep and, prefixed, the matches of each kind; of kind id those in good patterns (a table), or all if good is None.

    Candidates that overlap a fixed kind's match are left out, but for shorter matches inside them.
    """
    names = [f"{PREFIX}{k}" for k in KINDS]
    accepted = None
    if good is not None:
        first = [r.pattern for r in good.limit(LITERALS + 1).collect()]
        accepted = F.array(*map(F.lit, sorted(first))).cast("array<string>")
        if len(first) > LITERALS:
            rows, accepted = _matched(rows, good), F.coalesce(F.col(f"{PREFIX}good"), F.array().cast("array<string>"))
    text = F.coalesce(F.col("text"), F.lit(""))
    good_col = [] if accepted is None else [accepted.alias(f"{PREFIX}good")]
    found = located(rows.select(*(F.col(f"`{c}`") for c in keep), *good_col, *(x.alias(name) for x, name in zip(searches(text), names, strict=True))), names)
    kept = [F.col(f"`{c}`") for c in keep]
    ids = F.col(f"`{names[4]}`")
    if good is not None:
        ids = F.filter(ids, lambda x: F.array_contains(F.col(f"`{PREFIX}good`"), pattern(x["left"])))
    found = found.select(*kept, *(passing(k).alias(name) for k, name in zip(KINDS[:4], names, strict=False)), ids.alias(names[4]))
    # spans of the fixed kinds by start, in blocks with their range: a candidate is compared with those of blocks that it touches
    bare = lambda name: F.transform(F.col(f"`{name}`"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
    found = found.withColumn(_BASE, F.when(F.size(f"`{names[4]}`") > 0, F.array_sort(F.concat(*map(bare, names[:4])))).otherwise(F.array().cast("array<struct<s:int,e:int>>")))
    base = F.col(f"`{_BASE}`")
    block = lambda xs: F.struct(F.array_min(F.transform(xs, lambda x: x["s"])).alias("s"), F.array_max(F.transform(xs, lambda x: x["e"])).alias("e"), xs.alias("xs"))
    found = found.withColumn(_BASE, F.transform(_numbers(base), lambda k: block(_block(base, k))))
    blocks = F.col(f"`{_BASE}`")
    meets = lambda b, c: (b["s"] < c["e"]) & (c["s"] < b["e"])
    inside = lambda b, c: (b["s"] >= c["s"]) & (b["e"] <= c["e"]) & (b["e"] - b["s"] < c["e"] - c["s"])
    clash = lambda c: F.exists(blocks, lambda k: meets(k, c) & F.exists(k["xs"], lambda b: meets(b, c) & ~inside(b, c)))
    free = F.when(F.size(blocks) > 0, F.filter(F.col(f"`{names[4]}`"), lambda c: ~clash(c))).otherwise(F.col(f"`{names[4]}`"))
    return found.select(*kept, *(F.col(f"`{n}`") for n in names[:4]), free.alias(names[4]))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def accepted_patterns(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern): the patterns of high confidence."""
    rows = _with_kinds(_rows(docs), None, []).toDF(*KINDS)
    instance = lambda x, kind, seed: F.struct(pattern(x["left"]).alias("pattern"), F.concat(F.lit(f"{kind}:"), F.lower(x["m"])).alias("instance"), seed.alias("seed"))
    seeded = lambda kind: F.transform(kind, lambda x: instance(x, kind, F.lit(1.0)))  # noqa: E731  one parameter: a second would be the index
    seeds = [seeded(kind) for kind in KINDS[:4]]
    others = F.transform("id", lambda x: instance(x, "id", F.when(F.lower(x["m"]).rlike(SEED), 1.0).otherwise(0.0)))
    edges = rows.select(F.explode(F.concat(*seeds, others)).alias("x")).select("x.*").where("pattern <> ''")
    edges = written(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pattern-instances")
    if edges.where("seed = 1").isEmpty():
        return edges.select("pattern").where("false")
    scores = edges.groupBy("instance").agg(F.max("seed").alias("score"))
    for r in range(rounds):
        confidence = dealt_join(edges, scores, "instance").groupBy("pattern").agg(
            (F.sum("score") / (F.count(F.lit(1)) + 0.2)).alias("confidence"), F.sum("seed").alias("seeds")
        )
        confidence = written(confidence, f"confidence-{r}")
        told = 1 - F.exp(F.sum(F.ln(1 - 0.99 * F.least(F.col("confidence"), F.lit(1.0)))))
        scores = dealt_join(edges, confidence.where(F.col("seeds") >= SEEDS), "pattern", "left").groupBy("instance").agg(F.greatest(F.max("seed"), F.coalesce(told, F.lit(0.0))).alias("score"))
    return confidence.where((F.col("confidence") >= CONFIDENCE) & (F.col("seeds") >= SEEDS)).select("pattern")


def patterns(docs: DataFrame, rounds: int = ROUNDS) -> list[str]:
    """The accepted patterns in order, on the driver."""
    return sorted(r.pattern for r in accepted_patterns(docs, rounds).collect())


def searched(docs: DataFrame) -> DataFrame:
    """(doc_id, email, ip, card, phone, id): matches of each kind, those of kind id found by the learned patterns."""
    found = _with_kinds(_rows(docs), accepted_patterns(docs), ["doc_id"])
    return found.select("doc_id", *(F.col(f"{PREFIX}{k}").alias(k) for k in KINDS))


def spans(kinds: list[str] | tuple[str, ...]) -> Column:
    """All matches of these kinds as (start, kind number, end), by start."""

    def numbered(n: int, kind: str) -> Column:
        return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), F.lit(n).alias("k"), x["e"].alias("e")))

    return F.array_sort(F.concat(*(numbered(n, kind) for n, kind in enumerate(kinds))))


def joined(listed: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(listed, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(rows: DataFrame) -> DataFrame:
    """``text`` with each span of ``_LISTED``, or run of overlapping ones, replaced by its first kind in brackets.

    The text is cut into parts of PART characters first, so that what stands between two spans is taken from the
    parts that it lies in, and not from the start of the text.
    """
    rest = [F.col(f"`{c}`") for c in rows.columns]
    text, listed, parts = F.col("text"), F.col(f"`{_LISTED}`"), F.col(f"`{_PARTS}`")
    numbers = F.sequence(F.lit(0), F.floor(F.length(text) / PART).cast("int"))
    cut = F.transform(numbers, lambda k: F.substring(text, k * PART + 1, F.lit(PART)))
    rows = rows.select(*rest, F.when(F.size(listed) > 0, cut).otherwise(F.array().cast("array<string>")).alias(_PARTS))
    names = F.array(*map(F.lit, KINDS))
    part_of = lambda at: F.floor(at / PART).cast("int")

    def between(lo: Column, hi: Column) -> Column:
        own = F.array_join(F.slice(parts, part_of(lo) + 1, part_of(hi) - part_of(lo) + 1), "")
        return F.when(hi > lo, F.substring(own, lo - part_of(lo) * PART + 1, hi - lo)).otherwise("")

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.array(between(acc["at"], x["s"]), F.concat(F.lit("["), F.upper(F.get(names, x["k"])), F.lit("]")))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    whole = F.aggregate(listed, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), between(acc["at"], F.length(text))))
    out = F.when(F.size(parts) > 0, whole).otherwise(text)
    return rows.select(*(F.col(f"`{c}`") if c != "text" else out.alias("text") for c in rows.columns if c not in (_LISTED, _PARTS)))


def replaced(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``, and ``n_chars`` to match; null texts and other columns stay."""
    names = docs.columns
    found = _with_kinds(docs.withColumn("text", F.col("text").cast("string")), accepted_patterns(docs), names)
    listed = found.withColumn(_LISTED, spans([f"`{PREFIX}{k}`" for k in KINDS]))
    out = redacted(listed.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{_LISTED}`")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*(F.col(f"`{c}`") for c in names))


def op4_pii(docs: DataFrame) -> DataFrame:
    rows = searched(docs).select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), joined(spans(KINDS[:4])).alias("base"), joined(spans(KINDS)).alias("spans")
    )
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_id")
