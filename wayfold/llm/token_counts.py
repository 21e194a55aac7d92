"""Token counts by a map-side two-tier lookup.

Tier one is a compact table ``chunk -> number of tokens`` of the most frequent
white-space-delimited chunks, of a fixed largest size, broadcast to all workers.
Tier two encodes what the table misses with the tokenizer itself and keeps the
lengths in a bounded cache of the worker. No chunk of a document is shuffled:
the first pass moves only bounded summaries of frequent chunks, the second none.

Why chunks may be counted alone: the tokenizer's pre-tokens never hold white
space, its normalizer turns runs of white space into one space and composes no
character with a space, and its special strings hold none. So the tokens of a
text are those of its chunks. ``str.split`` parts at U+001C..U+001F, which the
tokenizer does not hold for white space; texts with those go to the tokenizer whole.

Defined results: null or empty text has 0 tokens; rows with equal ids are counted
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

TABLE_ENTRIES = 65_536
"""Largest number of chunks in the broadcast table."""
SUMMARY_ENTRIES = 8_192
"""Frequent chunks that one task reports at most."""
SUMMARY_HOLDS = 262_144
"""Chunks that a task counts at once; beyond it, the rarer half is forgotten."""
CACHE_ENTRIES = 600_000
"""Lengths that a worker keeps; beyond it, its cache starts anew."""
LONGEST_KEPT = 64
"""Chunks with more characters are encoded each time, not kept."""

#: Letters, then ASCII marks other than the apostrophe: two pre-tokens, always. No letter here is lower-cased to one with a mark of its own.
_WORD_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([!-&(-/:-@[-`{-~]+)")
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def load(tokenizer_json: str):
    """The tokenizer of a tokenizers-library JSON text, without truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    tok.no_truncation()
    tok.no_padding()
    return tok


def lengths(tok, chunks: list[str]) -> list[int]:
    return [len(e.ids) for e in tok.encode_batch_fast(chunks, add_special_tokens=False)]


def parts(chunk: str) -> tuple[str, ...]:
    """A chunk, or the word and the marks after it, whose tokens are those of the chunk; far fewer words differ than chunks."""
    m = _WORD_MARKS.fullmatch(chunk) if "<|" not in chunk else None
    return m.groups() if m else (chunk,)


class Lengths:
    """Token counts of chunks: the broadcast table, and what it lacks, kept while there is room. All new ones of a slice are encoded at once."""

    def __init__(self, tok, frequent: dict[str, int]) -> None:
        self.tok, self.frequent, self.kept = tok, frequent, dict(frequent)

    def counts(self, split: list[list[str]]) -> list[int]:
        seen = set().union(*split)
        new = seen.difference(self.kept)
        if len(self.kept) + len(new) > CACHE_ENTRIES:
            self.kept = dict(self.frequent)
            new = seen.difference(self.kept)
        found = {c: parts(c) for c in new}
        todo = [p for p in {p for ps in found.values() for p in ps} if p not in self.kept]
        fresh = dict(zip(todo, lengths(self.tok, todo), strict=True))
        get = self.kept.get
        more = {c: sum(fresh[p] if p in fresh else get(p) for p in ps) for c, ps in found.items()}
        self.kept.update((k, n) for k, n in fresh.items() if len(k) <= LONGEST_KEPT)
        self.kept.update((k, n) for k, n in more.items() if len(k) <= LONGEST_KEPT)
        get = self.kept.get
        return [sum(n if (n := get(w)) is not None else more[w] for w in words) for words in split]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for batch in batches:
        for part in slices(batch, 0):
            for text in part.column(0).to_pylist():
                seen.update(text.split())
            if len(seen) > SUMMARY_HOLDS:
                seen = Counter(dict(seen.most_common(SUMMARY_HOLDS // 2)))
    top = [(c, n) for c, n in seen.most_common(SUMMARY_ENTRIES) if len(c) <= LONGEST_KEPT and n > 1]
    if top:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["chunk", "n"])


def frequent_chunks(docs: DataFrame, entries: int = TABLE_ENTRIES) -> list[str]:
    """The chunks with the highest counts over all documents, ``entries`` at most."""
    top = docs.select("text").mapInArrow(_summaries, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))
    return [r.chunk for r in top.orderBy(F.desc("n"), "chunk").limit(entries).collect()]


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 2048, entries: int = TABLE_ENTRIES) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs`` (``doc_id``, ``text``)."""
    spark, docs = docs.sparkSession, texts(docs)
    tok = load(tokenizer_json)
    chunks = frequent_chunks(docs, entries)
    first = spark.sparkContext.broadcast((tokenizer_json, dict(zip(chunks, lengths(tok, chunks), strict=True))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of, frequent = first.value
        tok = load(text_of)
        known = Lengths(tok, frequent)
        for batch in batches:
            for part in slices(batch):
                rows = part.column(1).to_pylist()
                counts = known.counts([[] if _ODD_SPACE.search(t) else t.split() for t in rows])
                for i, t in enumerate(rows):
                    if _ODD_SPACE.search(t):
                        counts[i] = lengths(tok, [t])[0]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in rows], pa.int64()), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return docs.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def tokenizer_file(name: str) -> str:
    """The text of a public vocabulary file."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()
