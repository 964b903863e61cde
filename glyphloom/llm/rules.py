"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphloom.llm.common import arrow_rows, bounded_part, ship_package

# White space and symbols of the word rules, as bytes.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

SAMPLE_ROWS = 2_000
"""Documents, about, on which costs and rejections are measured; only the order follows from them."""


class Stats:
    """Statistics of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - len(self.raw) + len(self.raw.translate(None, SPACE))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, UPPER))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside a window of three words that the text holds twice or more."""

        w = self.words
        windows = list(zip(w, w[1:], w[2:]))
        if len(set(windows)) == len(windows):
            return 0
        seen = Counter(windows)
        covered, end = 0, 0
        for at, window in enumerate(windows):
            if seen[window] > 1:
                covered += at + 3 - max(at, end)
                end = at + 3
        return covered


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text that has to go."""

    name: str
    rejects: Callable[[Stats], bool]


BASE_RULES = (
    Rule("too_short", lambda s: s.n_words < 50),
    Rule("repeated_windows", lambda s: 100 * s.n_repeat_words > 50 * s.n_words),
)
FURTHER_RULES = (
    Rule("symbols", lambda s: 10 * s.n_symbols > s.n_words),
    Rule("upper_case", lambda s: 100 * s.n_upper > 30 * s.word_chars),
    Rule("duplicate_lines", lambda s: 100 * s.n_dup_lines > 40 * len(s.lines)),
    Rule("word_length", lambda s: not 2 * s.n_words <= s.word_chars <= 14 * s.n_words),
)


def rule_costs(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, int, int, int]]:
    """(rule, sampled texts, rejected, nanoseconds), measured on executors over a bounded part of the rows.

    Only the sums of each partition leave it. Each rule starts from fresh statistics, so its
    cost is that of running it first.
    """

    def measure(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        sums = {r.name: [0, 0, 0] for r in rules}
        for rows in slices:
            for (value,) in rows:
                for rule in rules:
                    start = time.perf_counter_ns()
                    rejected = rule.rejects(Stats(value))
                    total = sums[rule.name]
                    total[0] += 1
                    total[1] += rejected
                    total[2] += time.perf_counter_ns() - start
        yield [(name, *total) for name, total in sums.items() if total[0]]

    # Chosen by row and not by text, so that a text which a third of all rows share doesn't fill the sample.
    part = bounded_part(docs.select(F.col(text).alias("text")), sample_rows, F.monotonically_increasing_id())
    measured = arrow_rows(part, ["text"], "rule string, n bigint, rejected bigint, nanos bigint", measure)
    return [tuple(r) for r in measured.groupBy("rule").agg(F.sum("n"), F.sum("rejected"), F.sum("nanos")).collect()]


def cascade(rules: tuple[Rule, ...], costs: list[tuple[str, int, int, int]]) -> tuple[Rule, ...]:
    """``rules`` by rejected texts per nanosecond, most first; unmeasured rules last, in the given order."""

    rate = {name: rejected / max(nanos, 1) for name, n, rejected, nanos in costs if n}
    return tuple(sorted(rules, key=lambda r: -rate.get(r.name, -1.0)))


def with_verdict(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + FURTHER_RULES, text: str = "text") -> DataFrame:
    """All of ``docs`` and all its columns with ``kept``: no rule of the cascade rejects the text.

    A document runs through the rules until one rejects it. The verdict is the same in any
    order. Null counts as the empty text. Rows keep their partition: nothing is shuffled.
    """

    ship_package(docs.sparkSession)
    order = cascade(rules, rule_costs(docs, rules, text))
    verdict = F.udf(lambda value: _passes(Stats(value), order), "boolean", useArrow=True)
    return docs.withColumn("kept", verdict(F.col(text)))


def statistics(docs: DataFrame, further: tuple[Rule, ...] = FURTHER_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, base statistics, ``base_failed`` and ``kept``.

    Base statistics are reported for every text, so the base rules cost nothing more; the
    cascade runs over ``further``, for texts that the base rules keep. Null text is empty:
    no words, base_failed. Repeated rows give repeated rows; an empty table gives none.
    """

    order = cascade(further, rule_costs(docs, further, text))

    def rows(slices: Iterator[list[tuple]]) -> Iterator[list[tuple]]:
        for part in slices:
            out = []
            for doc_id, value in part:
                s = Stats(value)
                failed = not _passes(s, BASE_RULES)
                out.append((doc_id, s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, not failed and _passes(s, order)))
            yield out

    kind = dict(docs.dtypes)[key]
    fields = f"`{key}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"
    return arrow_rows(docs, [key, text], fields, rows)


def _passes(stats: Stats, rules: tuple[Rule, ...]) -> bool:
    return not any(rule.rejects(stats) for rule in rules)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3),
tri2 AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM tri),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM tri2) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
ls AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM ls
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
s AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, length(regexp_replace(w.text, '[^A-Z]+', '', 'g')) AS upper,
    coalesce(dup.lines, 0) AS lines
  FROM w LEFT JOIN covered USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT 10 * n_symbols > n_words AND NOT 100 * upper > 30 * word_chars AND NOT 100 * n_dup_lines > 40 * lines
  AND word_chars BETWEEN 2 * n_words AND 14 * n_words AS kept
FROM f
"""
