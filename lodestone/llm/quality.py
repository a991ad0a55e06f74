"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are measured on a sample of documents; the rules are then ordered by rejections
per second, and a document leaves the cascade at the first rule that rejects it. The order changes the time spent,
never the verdict: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, functions as F

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
# From the start of a word to its first letter.
HAS_LETTER = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*?[^\W\d_]")

# Scripts that are written without spaces between words, and their punctuation: Thai to Tibetan, Myanmar, Khmer, and
# Chinese and Japanese.
UNSPACED = re.compile(
    "[\u0e00-\u109f\u1780-\u17ff\u19e0-\u19ff\u2e80-\u312f\u31a0-\u4dbf\u4e00-\ua4cf\ua9e0-\ua9ff\uaa60-\uaa7f"
    "\uf900-\ufaff\ufe30-\ufe4f\uff00-\uff9f\uffe0-\uffee\U0001aff0-\U0001b16f\U00020000-\U0003ffff]+"
)


class Measures:
    """What the rules look at in one text; each measure is computed when first asked for. A null text counts as empty."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "replace")

    @cached_property
    def words(self) -> list[bytes]:
        return self.data.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        """Code points in words: all but the white space between them."""
        return len(self.text) - (len(self.data) - len(self.data.translate(None, SPACES)))

    @cached_property
    def n_unspaced(self) -> int:
        return sum(map(len, UNSPACED.findall(self.text)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.data) - len(self.data.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [line for line in self.data.split(b"\n") if line.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by 3-word windows that occur at least twice in the text."""
        windows = list(zip(self.words, self.words[1:], self.words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        counts, covered, end = Counter(windows), 0, 0
        for start, window in enumerate(windows):
            if counts[window] > 1:
                covered += start + 3 - max(start, end)
                end = start + 3
        return covered

    @cached_property
    def n_lettered(self) -> int:
        return len(HAS_LETTER.findall(self.text))

    @cached_property
    def n_upper(self) -> int:
        return sum(map(str.isupper, self.text))


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether the document fails."""

    name: str
    rejects: Callable[[Measures], bool]


BASE_RULES = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)


def word_length(m: Measures) -> bool:
    """The upper limit is on scripts with spaces; in the others, what stands between spaces is no word."""
    if 2 * m.n_words > m.word_chars:
        return True
    return m.word_chars > 15 * m.n_words and m.word_chars - m.n_unspaced > 15 * m.n_words


# Limits lie far outside what prose in any of the alphabets reaches, so that clean documents stay.
RULES = BASE_RULES + (
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: 10 * m.n_dup_lines > 4 * len(m.lines)),
    Rule("word_length", word_length),
    Rule("unlettered_words", lambda m: 10 * m.n_lettered < 6 * m.n_words),
    Rule("capitals", lambda m: 2 * m.n_upper > m.word_chars),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        return self.rejected / self.seconds


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 1000) -> list[Estimate]:
    """Cost and selectivity of each rule on about ``sample_rows`` documents, best gain first.

    The sample decides nothing but the order of the rules. Tasks measure it where the documents are; the driver gets
    one row for each rule. An empty table gives estimates of nothing rejected.
    """

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            spent, hits = Counter(), Counter()
            for value in batch["text"]:
                for rule in rules:
                    began = time.perf_counter()
                    hits[rule.name] += rule.rejects(Measures(value))
                    spent[rule.name] += time.perf_counter() - began
            yield pd.DataFrame([(r.name, spent[r.name], hits[r.name], len(batch)) for r in rules], columns=["name", "s", "hits", "n"])

    sample = docs.select(F.col(text).alias("text")).sample(min(1.0, sample_rows / max(1, docs.count())), seed=0)
    rows = (
        sample.mapInPandas(measure, "name string, s double, hits long, n long")
        .groupBy("name").agg(F.sum("s").alias("s"), F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect()
    )
    found = {r["name"]: Estimate(r["name"], max(r["s"], 1e-9) / max(r["n"], 1), r["hits"] / max(r["n"], 1)) for r in rows}
    return sorted((found.get(r.name, Estimate(r.name, 1.0, 0.0)) for r in rules), key=lambda e: -e.gain)


def in_order(rules: tuple[Rule, ...], estimates: list[Estimate]) -> tuple[Rule, ...]:
    """Most rejections per second first; rules without an estimate come last, in the order given."""
    place = {e.name: i for i, e in enumerate(estimates)}
    return tuple(sorted(rules, key=lambda r: place.get(r.name, len(place))))


def first_rejection(rules: tuple[Rule, ...], measures: Measures) -> str | None:
    return next((r.name for r in rules if r.rejects(measures)), None)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The documents that no rule rejects, with their columns and in full. Null and empty texts have no words and go.

    Repeated rows are judged one by one. One pass without a shuffle; columns other than the text may have any name.
    """
    ordered = in_order(rules, estimate(docs, rules, text, sample_rows))

    @F.pandas_udf("boolean")
    def passes(texts: pd.Series) -> pd.Series:
        return pd.Series([first_rejection(ordered, Measures(t)) is None for t in texts], dtype=bool)

    return docs.where(passes(F.col(text)))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id: str = "doc_id", text: str = "text", sample_rows: int = 1000) -> DataFrame:
    """Base measures and verdict of every row: the id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept. ``rules`` must hold the base rules; those already answered by base_failed are not asked again.
    """
    base = {r.name for r in BASE_RULES}
    ordered = tuple(r for r in in_order(rules, estimate(docs, rules, text, sample_rows)) if r.name not in base)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["text"]:
                m = Measures(value)
                failed = any(r.rejects(m) for r in BASE_RULES)
                rows.append((*(getattr(m, c) for c in counts), failed, not failed and first_rejection(ordered, m) is None))
            out = pd.DataFrame(rows, columns=[*counts, "base_failed", "kept"])
            out.insert(0, "id", batch["id"].to_numpy(dtype=object, na_value=None))
            yield out

    kind = dict(docs.dtypes)[id]
    schema = f"id {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInPandas(run, schema).withColumnRenamed("id", id)
