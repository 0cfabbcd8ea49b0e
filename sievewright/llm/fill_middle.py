"""Fill-in-middle transformation over a run-length encoding of character classes.

A text is cut into units: a run of A-Z and a-z is one unit, any other code point is one
of its own. The text is stored as its maximal runs of one class (letters, or anything
else), with the code points and the units that come before each run. A cut after u units
is found by binary search for the run that holds it; inside a run of letters only its
start can be a cut, inside another run each unit is one code point, so the offset is
``start + u - units before``. No list of units is made, and the runs serve any number of
draws: each costs two searches.

Prefix, middle and suffix are put together as PSM or SPM with sentinels, or the text stays
plain, by a hash of the draw's name and doc_id.

Null and empty texts are plain, with no units; a text that holds a sentinel is plain, so
every output can be taken apart again exactly. A null doc_id is hashed as an empty one.
Repeated rows give equal rows each; an empty table gives none. A very long text takes
about 6 bytes a code point, in the task that reads it, besides 16 bytes a run. Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, prepare

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, those from PLAIN_FROM stay as they are; of 100 others, those below SPM_BELOW are SPM.
PLAIN_FROM, SPM_BELOW = 90, 20
#: Names of the draws: a text gives one row for each.
DRAWS = ("1",)
_SCHEMA = "doc_id long, draw string, n long, form string, prefix_chars long, middle_chars long, output string"


class Runs(NamedTuple):
    """Maximal runs of one class, in order: start and units hold a total at the end."""

    start: np.ndarray  #: code points before each run
    units: np.ndarray  #: units before each run
    letters: bool  #: whether the first run is one of letters; the classes take turns


def encode(text: str) -> Runs:
    """The run-length encoding of a text."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return Runs(np.zeros(1, np.int64), np.zeros(1, np.int64), False)
    # setting bit 5 takes A-Z to a-z, and nothing else there
    letter = ((points | 32) - np.uint32(97)) < 26
    start = np.concatenate([[0], np.flatnonzero(letter[1:] != letter[:-1]) + 1, [len(points)]])
    units = np.diff(start)
    units[0 if letter[0] else 1 :: 2] = 1
    return Runs(start, np.concatenate([[0], np.cumsum(units)]), bool(letter[0]))


def offset(runs: Runs, unit: int) -> int:
    """Code points before the cut after ``unit`` units."""
    k = int(np.searchsorted(runs.units, unit, "right")) - 1
    # a cut in a run of letters stands at its start, where ``unit`` is the units before it
    return int(runs.start[k]) + unit - int(runs.units[k])


def numbers(draw: str, doc_id: int | None) -> tuple[int, int, int, int]:
    """h1 to h4 of a text in a draw."""
    digits = hashlib.sha256(f"{draw}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[k : k + 8], 16) for k in range(0, 32, 8))


def transform(text: str, runs: Runs, draw: str, doc_id: int | None) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text in one draw."""
    n = int(runs.units[-1])
    h1, h2, h3, h4 = numbers(draw, doc_id)
    if not text or h3 % 100 >= PLAIN_FROM or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    low, high = sorted((offset(runs, h1 % (n + 1)), offset(runs, h2 % (n + 1))))
    before, middle, after = text[:low], text[low:high], text[high:]
    if h4 % 100 < SPM_BELOW:
        return n, "spm", low, high - low, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{middle}"


def transformed(docs: DataFrame, draws: tuple[str, ...] = DRAWS) -> DataFrame:
    """(doc_id, draw, n, form, prefix_chars, middle_chars, output): a row a text and draw; a text is encoded once for all draws."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        names = ["doc_id", "draw", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            rows = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (raw or b"").decode("utf-8", "replace")
                runs = encode(text)
                rows += [(doc, draw, *transform(text, runs, draw, doc)) for draw in draws]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)

    return id_and_text(docs).mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text again, from output and form alone.

    No part of a text holds a sentinel, and no sentinel overlaps itself or another, so
    the first place where each is found is its own.
    """
    size = len(PREFIX)
    body = F.substr(output, F.lit(size + 1))  # behind the first sentinel

    def parts(first: str) -> tuple[Column, Column, Column]:
        one = F.substring_index(body, first, 1)
        rest = F.substr(body, F.length(one) + size + 1)
        two = F.substring_index(rest, MIDDLE, 1)
        return one, two, F.substr(rest, F.length(two) + size + 1)

    before, after, middle = parts(SUFFIX)
    after_s, before_s, middle_s = parts(PREFIX)
    return F.when(form == "psm", F.concat(before, middle, after)).when(form == "spm", F.concat(before_s, middle_s, after_s)).otherwise(output)


def op11_fill_middle(docs: DataFrame) -> DataFrame:
    """The contract's columns: digests of the outputs, and of the texts rebuilt from them."""
    rows = transformed(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
