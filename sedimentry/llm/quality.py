"""Quality rules as a short-circuit cascade.

A rule is a predicate over lazily computed features of one text. On a bounded sample (``sample_rows`` documents, 400 by
default: those whose texts have the smallest hashes, so from all over the table) each rule's cost and rejection rate are
measured; rules then run in order of rejections per unit of cost, and a document's evaluation stops at the first rule that
rejects it. Rules are independent of each other, so the order changes the time and never the verdict. ``report`` takes its
verdict from the cascade too, but then fills in the counts that it has to return of every document; the time that the short
circuit saves is saved in ``keep``.

Edge cases: null and empty texts have no words and fail the base rule; very long texts are handled whole; repeated rows
are judged alike; an empty table gives an empty result; other columns pass through ``keep`` untouched.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
SAMPLE_ROWS = 400


class Features:
    """Counts of one text, each computed on first use. bytes.split() cuts at exactly [\\x20\\x09-\\x0D]."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode("utf-8", "surrogatepass")
        self._known: dict[str, int] = {}
        self._words: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    def _once(self, name: str, make: Callable[[], int]) -> int:
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    @property
    def n_words(self) -> int:
        return len(self.words)

    @property
    def word_chars(self) -> int:
        return self._once("word_chars", lambda: len(self.text) - len(self.raw) + len(self.raw.translate(None, SPACE)))

    @property
    def n_symbols(self) -> int:
        return self._once("n_symbols", lambda: len(self.raw) - len(self.raw.translate(None, SYMBOLS)))

    @property
    def n_lines(self) -> int:
        return self._once("n_lines", lambda: sum(1 for x in self.raw.split(b"\n") if x.strip()))

    @property
    def n_dup_lines(self) -> int:
        def count() -> int:
            lines = [x for x in self.raw.split(b"\n") if x.strip()]
            return len(lines) - len(set(lines))

        return self._once("n_dup_lines", count)

    @property
    def n_repeat_words(self) -> int:
        def count() -> int:
            w = self.words
            triples = list(zip(w, w[1:], w[2:]))
            if len(set(triples)) == len(triples):
                return 0
            seen, covered, upto = Counter(triples), 0, 0
            for i, x in enumerate(triples):
                if seen[x] > 1:
                    covered += i + 3 - max(i, upto)
                    upto = i + 3
            return covered

        return self._once("n_repeat_words", count)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


def _short(f: Features) -> bool:
    return f.n_words < 50


def _repetitive(f: Features) -> bool:
    return 100 * f.n_repeat_words > 50 * f.n_words


def _symbols(f: Features) -> bool:
    return f.n_symbols > f.n_words


def _lines(f: Features) -> bool:
    return 100 * f.n_dup_lines > 50 * f.n_lines


def _word_length(f: Features) -> bool:
    return not 2 * f.n_words <= f.word_chars <= 20 * f.n_words


#: Two base rules, then the method's own, set so that prose of any language, lists and tables pass: only texts with more
#: symbols than words, mostly repeated lines, or words of unlikely length are junk.
BASE = (Rule("too_short", _short), Rule("repeated_trigrams", _repetitive))
RULES = (*BASE, Rule("symbol_ratio", _symbols), Rule("duplicate_lines", _lines), Rule("word_length", _word_length))


def order_rules(texts: list[str], rules=RULES, clock=time.perf_counter) -> list[Rule]:
    """Rules by rejections per cost on the sample; each is timed on fresh features, for its cost includes theirs."""
    scored = []
    for k, rule in enumerate(rules):
        began, hits = clock(), 0
        for text in texts:
            hits += rule.rejects(Features(text))
        scored.append((-(hits + 0.5) / max(clock() - began, 1e-9), k, rule))
    return [x[2] for x in sorted(scored, key=lambda x: x[:2])]


def sample_texts(docs: DataFrame, text: str, rows: int = SAMPLE_ROWS) -> list[str]:
    return [r[0] or "" for r in docs.select(text).orderBy(F.xxhash64(text)).limit(rows).collect()]


def rejected(features: Features, cascade: list[Rule]) -> bool:
    return any(rule.rejects(features) for rule in cascade)


REPORT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per document: its counts, the base verdict and the cascade's verdict. The base rules are always among the rules."""
    cascade = order_rules(sample_texts(docs, text, sample_rows), (*BASE, *(r for r in rules if r not in BASE)))

    def run(batches):
        for batch in batches:
            rows = []
            for x in storage.texts_of(batch, 1):
                f = Features(x)
                gone = rejected(f, cascade)
                bad = gone and any(r.rejects(f) for r in BASE)
                rows.append((f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, bad, not gone))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(storage.longs(c) for c in cols[:5]), pa.array(cols[5], pa.bool_()), pa.array(cols[6], pa.bool_())], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    return storage.map_batches(storage.text_column(docs, key, text), run, REPORT)


def keep(docs: DataFrame, text: str = "text", rules=RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs without the documents that a rule rejects; here the cascade stops at the first rejection."""
    cascade = order_rules(sample_texts(docs, text, sample_rows), rules)
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([not rejected(Features(x), cascade) for x in storage.texts_of(batch, at)], pa.bool_()))

    return storage.map_batches(docs, run, docs.schema)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
with w as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS} as words from documents
), spots as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as tri
  from (select r, words, unnest(range(1, greatest(len(words) - 1, 1))) as i from w)
), again as (
  select r, i from (select r, i, count(*) over (partition by r, tri) as n from spots) where n > 1
), covered as (
  select r, count(distinct i + k) as n_repeat_words from again, (select unnest([0, 1, 2]) as k) group by r
), counts as (
  select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join covered using (r)
), judged as (
  select *, len(lines) as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols > n_words
    or 100 * n_dup_lines > 50 * n_lines or not (word_chars between 2 * n_words and 20 * n_words)) as kept
from judged
"""
