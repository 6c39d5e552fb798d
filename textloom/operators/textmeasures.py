"""Measures of texts that plain expressions can give: lexical variety, length-normalised counts, chunks, edits.

Parsers and taggers of a language model are not part of this: their counts come in as tables.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import scalars as S


def words(text: Column) -> Column:
    """Runs of ASCII letters, lower-cased."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def lexical(df: DataFrame, text: str = "text") -> DataFrame:
    """df's ids with word count, distinct words, type-token ratios (plain, corrected, root, logarithmic) and the distinct
    words among the first 50."""
    w = df.withColumn("w", words(F.col(text)))
    n, t = F.size("w").cast("double"), F.size(F.array_distinct("w")).cast("double")
    some = F.when(n > 0, n)
    return w.select(
        "doc_id", n.cast("long").alias("nwords"), t.cast("long").alias("types"), (t / some).alias("ttr"), (t / F.sqrt(2 * some)).alias("cttr"), (t / F.sqrt(some)).alias("rttr"),
        F.when(n > 1, F.log(F.when(t > 0, t)) / F.log(F.when(n > 1, n))).alias("logttr"), F.size(F.array_distinct(F.slice("w", 1, 50))).cast("long").alias("ndwz"),
    )


#: Constructs that a regular expression can find in lower-cased words, as a stand-in for a parser's.
CONSTRUCTS = {
    "articles": r"\b(?:the|a|an)\b", "of_phrases": r"\bof [a-z]+", "coordination": r"\b(?:and|or|but)\b", "passive_like": r"\b(?:is|are|was|were) [a-z]+ed\b",
    "progressive_like": r"\b(?:am|is|are|was|were) [a-z]+ing\b", "perfect_like": r"\b(?:has|have|had) [a-z]+ed\b", "modals": r"\b(?:can|could|may|might|must|shall|should|will|would)\b", "comparatives": r"\b(?:more|less) [a-z]+ than\b",
    "to_infinitives": r"\bto [a-z]+", "relatives": r"\b(?:who|which|that)\b", "negations": r"\b(?:not|never|no)\b", "adverbs": r"\b[a-z]+ly\b",
}


def construct_rates(df: DataFrame, constructs: dict[str, str] = CONSTRUCTS, text: str = "text") -> DataFrame:
    """(doc_id, word_count, total_annotations, unique_constructs, a rate for each 100 words of each construct): any number of
    patterns in one pass over a text's words, joined by one space."""
    w = df.select("doc_id", words(F.col(text)).alias("w")).select("doc_id", F.size("w").alias("word_count"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t"))
    n = w.select("doc_id", "word_count", *[F.regexp_count("t", F.lit(p)).alias(k) for k, p in constructs.items()])
    total = sum((F.col(k) for k in constructs), F.lit(0))
    kinds = sum(((F.col(k) > 0).cast("int") for k in constructs), F.lit(0))
    return n.select("doc_id", "word_count", total.alias("total_annotations"), kinds.alias("unique_constructs"), *[S.per_hundred(F.col(k), F.col("word_count")).alias(k) for k in constructs])


def per_ten_thousand(df: DataFrame, counts: list[str], words: str = "nwords") -> DataFrame:
    """df with its counts for each 10,000 words; null for a text without words."""
    return df.withColumns({c: S.ratio(F.col(c) * 10_000, F.col(words)) for c in counts})


def ratios(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """df with a column "a_per_b" for each pair of counts, 0 where b is 0."""
    return df.withColumns({f"{a}_per_{b}": F.when(F.col(b) != 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0)) for a, b in pairs})


def clean(text: Column) -> Column:
    """Bracketed notes and line numbers out, white space of each line collapsed, empty lines gone."""
    t = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]|\([^)]*\)", " "), r"\n[0-9]+:", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


def chunks(df: DataFrame, text: str = "text", most: int = 45) -> DataFrame:
    """(doc_id, sentence, chunk, words): sentences (list markers and ends of lines separate too) cut to ``most`` words."""
    t = F.regexp_replace(F.col(text), r"(?m)^\s*([-*•]|[0-9]+[.)])\s+", "\n")
    parts = F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    rows = df.select("doc_id", F.posexplode(parts).alias("sentence", "s"))
    w = F.filter(F.split("s", r"\s+"), lambda x: x != "")
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / F.lit(float(most))).cast("int")), lambda k: F.slice("w", k * most + 1, most))
    return rows.withColumn("w", w).select("doc_id", "sentence", F.posexplode(cut).alias("chunk", "c")).select("doc_id", "sentence", "chunk", F.size("c").alias("words"))


#: Texts that a task has as Python objects at a time.
ALIGNED = 64


class _Matcher(difflib.SequenceMatcher):
    """difflib's alignment, without junk, where words that occur often don't make its steps quadratic."""

    #: Steps of difflib's search for each word of both sides, beyond which the linear search takes its place.
    STEPS = 32

    def find_longest_match(self, alo: int = 0, ahi: int | None = None, blo: int = 0, bhi: int | None = None) -> difflib.Match:
        ahi, bhi = len(self.a) if ahi is None else ahi, len(self.b) if bhi is None else bhi
        if sum(len(self.b2j.get(w, ())) for w in self.a[alo:ahi]) <= self.STEPS * (ahi - alo + bhi - blo):
            return super().find_longest_match(alo, ahi, blo, bhi)
        # a suffix automaton of b: states' lengths, links, moves and first ends
        size, link, moves, end, last = [0], [-1], [{}], [-1], 0
        for j in range(blo, bhi):
            w, now, p = self.b[j], len(size), last
            size.append(size[last] + 1), link.append(0), moves.append({}), end.append(j)
            while p >= 0 and w not in moves[p]:
                moves[p][w] = now
                p = link[p]
            if p >= 0:
                q = moves[p][w]
                if size[q] == size[p] + 1:
                    link[now] = q
                else:
                    twin = len(size)
                    size.append(size[p] + 1), link.append(link[q]), moves.append(dict(moves[q])), end.append(end[q])
                    while p >= 0 and moves[p].get(w) == q:
                        moves[p][w] = twin
                        p = link[p]
                    link[q] = link[now] = twin
            last = now
        # the longest run that ends at each word of a; of equal ones the first in a, then in b, as in difflib
        best, state, length = (alo, blo, 0), 0, 0
        for i in range(alo, ahi):
            w = self.a[i]
            while state and w not in moves[state]:
                state = link[state]
                length = size[state]
            if w in moves[state]:
                state, length = moves[state][w], length + 1
            if length > best[2]:
                best = (i + 1 - length, end[state] + 1 - length, length)
        return difflib.Match(*best)


def align(pairs: DataFrame) -> DataFrame:
    """(text_id, edits): untyped edits (M, U, R with spans of words) of original to corrected; equal texts have none.
    Whole texts of any length; opcodes are difflib's.

    The alignment is Python in Arrow batches; the roll-up of edits is plain expressions (describe.text_rollup)."""
    schema = "text_id long, edits array<struct<operation string, start long, stop long, corrected_start long, corrected_stop long, original string, corrected string>>"
    names = {"insert": "M", "delete": "U", "replace": "R"}
    fields = ["operation", "start", "stop", "corrected_start", "corrected_stop", "original", "corrected"]
    kind = pa.list_(pa.struct([(f, pa.int64() if "st" in f else pa.string()) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ALIGNED):
                part, out = batch.slice(lo, ALIGNED).to_pydict(), []
                for a, b in zip(part["original"], part["corrected"], strict=True):
                    x, y = (a or "").split(), (b or "").split()
                    ops = _Matcher(None, x, y, autojunk=False).get_opcodes() if a != b else []
                    line = (op for op in ops if op[0] != "equal")
                    out.append([(names[op], i, j, k, m, " ".join(x[i:j]), " ".join(y[k:m])) for op, i, j, k, m in line])
                edits = [[dict(zip(fields, e, strict=True)) for e in own] for own in out]
                yield pa.RecordBatch.from_arrays([pa.array(part["text_id"], pa.int64()), pa.array(edits, kind)], ["text_id", "edits"])

    return pairs.select("text_id", "original", "corrected").mapInArrow(run, schema)
