"""Fill-in-the-middle: whole texts cut at two unit ranks and put in prefix-suffix-middle order.

The units of a text (code points by default, or the matches of a pattern) are held in an
indexable skip list: every lane's link carries how many units and how many code points it
passes. Going down from the top lane by accumulated unit widths reaches a rank exactly, and the
code-point widths passed on the way are the place to cut at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_rows

CODE_POINTS = r"(?s)."
MARKS = ("<P>", "<S>", "<M>")
FIM_PERCENT, SPM_PERCENT = 90, 20
PROMOTED = 16
"""A unit of a lane stands in the next lane too with a chance of one in so many."""

_TOWERS: list[list[np.ndarray]] = [[]]


def _lane_ranks(n: int) -> list[np.ndarray]:
    """For each express lane the ranks (from 0) of the units below ``n`` whose towers reach it.

    Towers are drawn by rank from a fixed seed, so every text shares them and no result hangs on them.
    """

    if not _TOWERS[0] or _TOWERS[0][0][-1] < n:
        draws = np.random.default_rng(2024).random(max(1 << 16, 1 << int(n).bit_length()))  # the same beginning at every length
        lanes, chance = [], 1.0 / PROMOTED
        while (found := np.flatnonzero(draws < chance)).size:
            lanes.append(found)
            chance /= PROMOTED
        lanes[0] = np.append(lanes[0], len(draws))  # tells how far towers were drawn
        _TOWERS[0] = lanes
    cut = [lane[: np.searchsorted(lane, n)] for lane in _TOWERS[0]]
    return [lane for lane in cut if lane.size]


class SkipList:
    """An indexable skip list over units, given the code points that each unit is wide.

    Node 0 of every lane is the head, before the first unit; a unit's node stands at the unit's
    end. ``units[k][i]`` and ``points[k][i]`` are the widths of the link from node i of lane k to
    the next one, ``down[k][i]`` is the place of node i in the lane below. Lane 0 has all units.
    """

    def __init__(self, widths: np.ndarray) -> None:
        self.n = len(widths)
        ends = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        self.units, self.points, self.down = [np.ones(self.n, np.int8)], [widths], [np.arange(0)]
        below = None
        for ranks in _lane_ranks(self.n):
            here = np.concatenate([[0], ranks + 1])
            self.units.append(np.diff(here))
            self.points.append(np.diff(ends[here]))
            self.down.append(here if below is None else np.searchsorted(below, here))
            below = here

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` units."""

        if not 0 <= rank <= self.n:
            raise IndexError(rank)
        at = passed = points = 0
        for lane in range(len(self.units) - 1, -1, -1):
            units, wide = self.units[lane], self.points[lane]
            while at < len(units) and (step := int(units[at])) <= rank - passed:
                passed += step
                points += int(wide[at])
                at += 1
            at = int(self.down[lane][at]) if lane else at
        return points


def unit_widths(text: str, unit: str) -> np.ndarray:
    """Code points of each unit. A unit is one match of ``unit`` with what lies unmatched before it; a rest joins the last unit.

    Empty matches are no units. A text without any match, if not empty, is one unit.
    """

    if unit == CODE_POINTS:
        return np.ones(len(text), np.int8)
    ends = [m.end() for m in re.finditer(unit, text) if m.end() > m.start()] or [len(text)]
    ends[-1] = len(text)
    return np.diff(np.array([0, *ends], np.int64)) if text else np.zeros(0, np.int64)


def draws(key: object, seed: int) -> list[int]:
    """Four numbers below 2**32 from a row's key: the first four groups of eight hex digits of sha256 of ``seed:key``."""

    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def _checked(marks: tuple[str, str, str]) -> tuple[str, str, str]:
    """Marks can be found again only if none lies in another and none begins as another ends."""

    pairs = [*permutations(marks, 2), *((m, m) for m in marks)]
    for k, (a, b) in enumerate(pairs):
        if not a or (a in b and k < 6) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)))):
            raise ValueError(f"marks {marks} can run into each other")
    return marks


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = CODE_POINTS, marks: tuple[str, str, str] = MARKS,
    fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, seed: int = 1,
) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) per row of ``docs``, without a shuffle.

    ``n`` counts units. Two ranks drawn from the key end prefix and middle; the suffix is the rest.
    psm is prefix mark, prefix, suffix mark, suffix, middle mark, middle; spm has the suffix first.
    A text stays plain, output as it is and both lengths null, if it is empty, holds a mark, or by
    its draw. Null texts are empty. Rows that repeat a key get the same draws, each for its own
    text; a null key draws as an empty one. Other columns aren't read.
    """

    prefix_mark, suffix_mark, middle_mark = _checked(marks)

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            out = []
            for name, value in part:
                value = value or ""
                units = SkipList(unit_widths(value, unit))
                h1, h2, h3, h4 = draws(name, seed)
                if not value or h3 % 100 >= fim_percent or any(mark in value for mark in marks):
                    out.append((name, units.n, "plain", None, None, value))
                    continue
                ranks = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
                first, last = map(units.points_before, ranks)
                prefix, middle, suffix = value[:first], value[first:last], value[last:]
                if h4 % 100 < spm_percent:
                    form, output = "spm", f"{suffix_mark}{suffix}{prefix_mark}{prefix}{middle_mark}{middle}"
                else:
                    form, output = "psm", f"{prefix_mark}{prefix}{suffix_mark}{suffix}{middle_mark}{middle}"
                out.append((name, units.n, form, first, last - first, output))
            yield out

    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    fields = f"key {dict(docs.dtypes)[key]}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return arrow_rows(source, ["key", "text"], fields, rows).withColumnRenamed("key", key)


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made of. A plain output is the text; others hold each mark once."""

    parts = F.split(output, "|".join(map(re.escape, _checked(marks))), -1)
    part = lambda k: F.get(parts, F.lit(k))
    return (
        F.when(form == "psm", F.concat(part(1), part(3), part(2)))
        .when(form == "spm", F.concat(part(2), part(3), part(1)))
        .otherwise(output)
    )


def fim_digests(docs: DataFrame) -> DataFrame:
    """Outputs and restored texts by their digests, for whole ``documents``."""

    made = fill_in_middle(docs)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


ORACLE = """
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
    SELECT doc_id, text, n,
           ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::UBIGINT::BIGINT % (n + 1) AS c2,
           ('0x' || substr(h, 17, 8))::UBIGINT % 100 AS d3, ('0x' || substr(h, 25, 8))::UBIGINT % 100 AS d4
    FROM texts
), cut AS (
    SELECT doc_id, text, n, substr(text, 1, least(c1, c2)) AS prefix, substr(text, least(c1, c2) + 1, abs(c1 - c2)) AS middle,
           substr(text, greatest(c1, c2) + 1) AS suffix, least(c1, c2) AS prefix_chars, abs(c1 - c2) AS middle_chars,
           CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d3 >= 90 THEN 'plain'
                WHEN d4 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN prefix_chars END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN middle_chars END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""
