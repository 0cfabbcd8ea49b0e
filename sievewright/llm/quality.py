"""Quality rules as a ledger of failure bits, and policies over it.

Every rule is evaluated once for each text; the ledger keeps its measurements and one
bit for each rule that fails. A policy is a named version: a mask of the rules that
count. Applying one is a bitwise AND with the stored bits, and ablations (what a
policy would keep without one of its rules) are bitwise aggregations over the ledger,
so neither reads the texts again.

Null and empty texts have no words and fail ``few_words``; repeated rows, and rows with a
null doc_id, are judged each; a measurement at a rule's limit passes; an empty table
gives no rows. A very long text is measured whole, in one row. Only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, prepare, written

SYMBOLS = "#*$%&|<>"
BREAKS = " \t\n\x0b\x0c\r"
#: Rules by bit: (name, what fails, as an expression over the measurements).
RULES = [
    ("few_words", "n_words < 10"),
    ("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "100 * n_symbols > 3 * word_chars"),
    ("repeated_neighbours", "100 * n_neighbour_words > 30 * n_words"),
    ("repeated_lines", "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("one_long_word", "longest_word > 1000"),
]
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_windows"]
#: Policies by version: the rules that count.
POLICIES = {
    "base-1": BASE,
    "web-1": BASE | BITS["symbols"] | BITS["repeated_lines"],
    "web-2": sum(BITS.values()) & ~BITS["one_long_word"],
}
POLICY = "web-2"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_neighbour_words", "n_lines", "longest_word")


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words in windows of ``width`` that the text has twice or more, the first one included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    grams = lambda: zip(*(words[k:] for k in range(width)), strict=False)
    hashes = np.fromiter(map(hash, grams()), np.int64, n)
    order = np.sort(hashes)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(hashes, twice))  # then the windows themselves are compared
    windows = [tuple(words[k : k + width]) for k in at.tolist()]
    seen = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    for k, window in zip(at.tolist(), windows, strict=True):
        if seen[window] > 1:
            marks[k] += 1
            marks[k + width] -= 1 if k + width <= len(words) else 0
    return int((np.cumsum(marks[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, as MEASURES names them."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.strip(BREAKS):
            lines += 1
            dup += line in seen
            seen.add(line)
    neighbours = sum(map(bytes.__eq__, words[1:], words)) if words else 0
    return (
        len(words), len(text) - sum(map(text.count, BREAKS)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), neighbours, lines, max(map(len, words), default=0),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, the measurements, failed_bits): all rules evaluated once."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t.decode("utf-8", "replace") if t is not None else None) for t in batch.column(1).to_pylist()]
            columns = np.array(rows, np.int64).reshape(-1, len(MEASURES)).T
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns)], ["doc_id", *MEASURES])

    measured = id_and_text(docs).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = " + ".join(f"if({fails}, {1 << k}L, 0L)" for k, (_, fails) in enumerate(RULES))
    return measured.withColumn("failed_bits", F.expr(bits))


def apply(table: DataFrame, policy: str = POLICY) -> DataFrame:
    """``kept`` under a policy, from the stored bits."""
    return table.withColumn("policy", F.lit(policy)).withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablations(table: DataFrame, policy: str = POLICY) -> DataFrame:
    """(rule, n_failed, n_only, n_kept, n_kept_without): for each rule of a policy, from one aggregation of the bits."""
    mask = POLICIES[policy]
    rules = [(name, bit) for name, bit in BITS.items() if mask & bit]
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask))
    sums = [F.count_if(bits == 0).alias("kept")]
    for name, bit in rules:
        sums += [F.count_if(bits.bitwiseAND(F.lit(bit)) != 0).alias(f"f_{name}"), F.count_if(bits == bit).alias(f"o_{name}")]
    rows = [f"'{name}', f_{name}, o_{name}, kept, kept + o_{name}" for name, _ in rules]
    return table.agg(*sums).selectExpr(f"stack({len(rules)}, {', '.join(rows)}) as (rule, n_failed, n_only, n_kept, n_kept_without)")


def op3_quality(docs: DataFrame) -> DataFrame:
    """The contract's columns, all measurements and bits of the stored ledger, what each policy version keeps, and the rule that alone speaks against a text."""
    stored = written(ledger(docs), "quality-ledger")
    judged = apply(stored)
    versions = [(F.col("failed_bits").bitwiseAND(F.lit(mask)) == 0).alias(f"kept_{name.replace('-', '_')}") for name, mask in POLICIES.items()]
    only = F.coalesce(*(F.when(F.col("failed_bits").bitwiseAND(F.lit(POLICIES[POLICY])) == bit, F.lit(name)) for name, bit in BITS.items())).alias("only_rule")
    return judged.select("doc_id", *MEASURES, (F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept", "failed_bits", "policy", *versions, only)
