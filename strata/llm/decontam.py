"""Benchmark decontamination: BM25 over an inverted index of test items, block-max WAND, question and answer overlap.

Every text is cut into overlapping passages, whole: `stride` words apart and twice as long, with the stride at least the
longest item's, so an item that stands in a text stands whole in one passage. A passage's distinct words are the query. A
posting's weight is its BM25 share of its item's own score, so a score runs from 0 to 1 and one threshold fits all items.
Block-max WAND skips what can't reach the threshold: first passages, by the sum of the largest weight of each word (no pivot), then
blocks of items, by the sum of each word's largest weight in the block. A cursor per word moves from pivot block to pivot block, and no
posting between them is read. All items of pivot blocks are scored, and all that reach the threshold are retrieved. The blocks of many
passages are walked side by side, as array operations: a walk passage by passage gives the same and takes eight times as long.
A retrieved item is reported if enough of its question's and of its answer's word n-grams stand in the passage.

The index holds test items, whose number doesn't grow with the corpus. It is built in blocks of at most `index_bytes` of
item text; a larger benchmark takes several passes over the texts. Term counts, the number of items and their lengths are
those of all items, so scores and passages don't depend on the blocks.

An item's answer is its last sentence; an item of one sentence is cut at two thirds of its words.

Defined results: null and empty texts or items match nothing. Rows that repeat a doc_id count as one document. Items with
equal text are each reported. Rows without doc_id aren't reported, but those in which an item stands are dropped: rows are
dropped by doc_id and text hash. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.wordhash import ALNUM, WordHasher, Words, grams, runs
from strata.runtime import lean, scratch, ship, written


@dataclass(frozen=True)
class DecontamParams:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.55
    question: float = 0.6
    answer: float = 0.5
    n: int = 5
    block: int = 8
    least_stride: int = 64
    index_bytes: int = 16 << 20


def parts(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    ends = [m.end() for m in re.finditer(r"[.!?\n]+\s*", text) if m.end() < len(text.rstrip())]
    if ends:
        return text[: ends[-1]], text[ends[-1] :]
    words = text.split()
    cut = -(-2 * len(words) // 3)
    return " ".join(words[:cut]), " ".join(words[cut:])


@dataclass(frozen=True)
class Totals:
    """What an index in blocks needs of all items: their number, mean and greatest length, and in how many each term stands."""

    items: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Postings in rows by term: items ascending, so each block of items is a run; `most` and `blocks` hold block maxima."""

    def __init__(self, items: list[tuple[int, str]], p: DecontamParams, totals: Totals | None = None):
        hasher = WordHasher(ALNUM)
        words = [hasher.batch([t.encode()]).hash for _, t in items]
        kept = sorted((i for i in range(len(items)) if len(words[i])), key=lambda i: (len(words[i]), items[i][0]))
        self.ids = [items[i][0] for i in kept]
        words = [words[i] for i in kept]
        self.longest = max(map(len, words), default=0)
        size = np.array([len(w) for w in words], float)
        rows = [np.unique(w, return_counts=True) for w in words]
        term = np.concatenate([r[0] for r in rows]) if rows else np.empty(0, np.uint64)
        tf = np.concatenate([r[1] for r in rows]).astype(float) if rows else np.empty(0)
        item = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        self.terms, at, df = np.unique(term, return_inverse=True, return_counts=True)
        count, mean = len(rows), size.mean() if rows else 0.0
        if totals:
            count, mean, self.longest, df = totals.items, totals.mean, totals.longest, totals.df[np.searchsorted(totals.terms, self.terms)]
        idf = np.log(1 + (count - df + 0.5) / (df + 0.5))
        norm = p.k1 * (1 - p.b + p.b * size[item] / mean) if rows else np.empty(0)
        w = idf[at] * tf * (p.k1 + 1) / (tf + norm) if rows else np.empty(0)
        w = w / np.bincount(item, w, len(rows))[item] if rows else w
        order = np.lexsort((item, at))
        self.item, self.weight = item[order].astype(np.int64), w[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(self.terms)))]).astype(np.int64)
        rowterm = at[order]
        self.most = np.zeros(len(self.terms))
        np.maximum.at(self.most, rowterm, self.weight)
        key = rowterm * (len(rows) // p.block + 1) + self.item // p.block
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, int)
        self.block_key, self.block_most = key[heads], np.maximum.reduceat(self.weight, heads) if len(heads) else np.empty(0)
        self.n_blocks = len(rows) // p.block + 1
        self.block_first = np.searchsorted(self.block_key, np.arange(len(self.terms) + 1) * self.n_blocks)
        self.block_start = np.append(heads, len(self.item)).astype(np.int64)
        self.sides = []
        for i in kept:
            q, a = (self._grams(hasher, s, p.n) for s in parts(items[i][1]))
            whole = self._grams(hasher, items[i][1], p.n)
            self.sides.append((q if len(q) else whole, a if len(a) else whole))

    @staticmethod
    def _grams(hasher: WordHasher, text: str, n: int) -> _Side:
        """Runs of n words, or all words as one run."""
        w = hasher.batch([text.encode()])
        k = min(n, len(w.hash))
        return _Side(k, np.unique(grams(w, k)[1]) if k else np.empty(0, np.uint64))


@dataclass
class _Side:
    k: int
    hashes: np.ndarray

    def __len__(self) -> int:
        return len(self.hashes)


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges first .. last laid end to end: (number of the range, place)."""
    n = last - first
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def retrieve(passage: np.ndarray, term: np.ndarray, ix: Index, p: DecontamParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage, item, score) of all that reach the threshold. (passage, term) distinct, passages ascending."""
    least, none = p.threshold - 1e-9, np.empty(0, np.int64)
    if not len(passage):
        return none, none, np.empty(0)
    # passages that have a pivot at all
    ok = (np.bincount(passage, ix.most[term]) >= least)[passage]
    passage, term = passage[ok], term[ok]
    # pivot blocks: those whose largest weights can reach the threshold. Cursors skip all others
    who, at = _expand(ix.block_first[term], ix.block_first[term + 1])
    key, own = np.unique(passage[who] * ix.n_blocks + ix.block_key[at] % ix.n_blocks, return_inverse=True)
    pivot = (np.bincount(own, ix.block_most[at], len(key)) >= least)[own] if len(own) else np.empty(0, bool)
    who, at = who[pivot], at[pivot]
    # the postings in those blocks
    which, posting = _expand(ix.block_start[at], ix.block_start[at + 1])
    pair, own = np.unique(passage[who[which]] * len(ix.ids) + ix.item[posting], return_inverse=True)
    score = np.bincount(own, ix.weight[posting], len(pair)) if len(pair) else np.empty(0)
    ok = score >= least
    return pair[ok] // len(ix.ids), pair[ok] % len(ix.ids), score[ok]


def scan(texts: list[bytes], hasher: WordHasher, ix: Index, p: DecontamParams):
    """(text, item, score, question overlap, answer overlap, first word) of verified passages."""
    stride = max(p.least_stride, ix.longest)
    for lo, hi in runs(texts):
        w = hasher.batch(texts[lo:hi])
        if not len(w.hash) or not len(ix.terms):
            continue
        begin = np.cumsum(w.counts) - w.counts
        steps = -(-w.counts // stride)  # passage j of a text: words [j*stride, (j+2)*stride)
        base = np.cumsum(steps) - steps
        at = np.minimum(np.searchsorted(ix.terms, w.hash), len(ix.terms) - 1)
        hit = np.flatnonzero(ix.terms[at] == w.hash)
        term, doc = at[hit], w.doc[hit]
        step = (hit - begin[doc]) // stride
        own = base[doc] + step
        before = step > 0
        key = np.unique(np.concatenate([own, own[before] - 1]) * len(ix.terms) + np.concatenate([term, term[before]]))
        for q, i, score in zip(*retrieve(key // len(ix.terms), key % len(ix.terms), ix, p), strict=True):
            d = int(np.searchsorted(base, q, side="right") - 1)
            while steps[d] == 0:
                d -= 1
            a = int(begin[d] + (q - base[d]) * stride)
            b = min(a + 2 * stride, int(begin[d] + w.counts[d]))
            over = []
            for side in ix.sides[i]:
                have = _runs_of(w.hash[a:b], side.k)
                over.append(float(np.isin(side.hashes, have).mean()))
            if over[0] >= p.question and over[1] >= p.answer:
                yield lo + d, int(i), float(score), over[0], over[1], a - int(begin[d])


def _runs_of(h: np.ndarray, k: int) -> np.ndarray:
    n = len(h)
    return grams(Words(np.zeros(n, np.int64), h, np.array([n]), h, h, b""), k)[1] if n >= k else np.empty(0, np.uint64)


def _item_terms(items: DataFrame) -> DataFrame:
    """(part, term, size): a row for each distinct term of each item, and one without term that holds the item's number of words."""

    def run(batches):
        hasher = WordHasher(ALNUM)
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = hasher.batch([text.as_py()]).hash
                if len(words):
                    terms = np.unique(words).view(np.int64)
                    size = pa.array([None] * len(terms) + [len(words)], pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(size), pa.int32()), pa.array(terms.tolist() + [None], pa.int64()), size], names=["part", "term", "size"])

    return items.select("part", F.col("text").cast("binary").alias("text")).mapInArrow(lean(run), "part int, term long, size long")


def _totals(items: DataFrame):
    """The Totals of items (part, text), with the terms of one part, as a function of the part."""
    rows = written(_item_terms(items), "item-terms")
    count, words, longest = rows.agg(F.count("size"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    df = written(rows.where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df")), "item-counts")

    def of(part: int) -> Totals:
        own = df.join(rows.where((F.col("part") == part) & F.col("term").isNotNull()), "term", "left_semi").collect()
        term, num = np.array([r[0] for r in own], np.int64).view(np.uint64), np.array([r[1] for r in own], np.int64)
        order = np.argsort(term)
        return Totals(count, words / count if count else 0.0, longest, term[order], num[order])

    return of


HITS = "doc_id long, tkey long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"


def _found(docs: DataFrame, benchmark: DataFrame, p: DecontamParams) -> DataFrame:
    """A row for each passage of docs in which an item stands, with the doc_id, if any, and the hash of the text."""
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(size / p.index_bytes))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    totals = _totals(dealt) if n > 1 else lambda part: None
    found = None
    for k in range(n):
        own = [(r[0], r[1]) for r in dealt.where(F.col("part") == k).select("item_id", "text").orderBy("item_id", "text").collect()]
        shared = spark.sparkContext.broadcast(Index(own, p, totals(k)))

        def run(batches, shared=shared):
            hasher, ix = WordHasher(ALNUM), shared.value
            for batch in batches:
                texts = [t.as_py() for t in batch.column(2)]
                ids, keys = batch.column(0), batch.column(1)
                out = [(ids[d].as_py(), keys[d].as_py(), ix.ids[i], *(round(x, 6) for x in rest[:3]), rest[3]) for d, i, *rest in scan(texts, hasher, ix, p)]
                cols = list(zip(*out, strict=True)) or [()] * 7
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

        hits = rows.mapInArrow(lean(run), HITS)
        if n > 1:  # one block's index at a time
            hits = written(hits, "benchmark-hits")
            shared.destroy()
        found = hits if found is None else found.union(hits)
    return found


@scratch
def benchmark_hits(docs: DataFrame, benchmark: DataFrame, params: DecontamParams | None = None) -> DataFrame:
    """One row per document and item found in it: its best passage."""
    found = _found(docs.where("doc_id IS NOT NULL"), benchmark, params or DecontamParams())
    best = F.struct(F.col("score"), F.col("question_overlap"), F.col("answer_overlap"), (-F.col("first_word")).alias("w"))
    return found.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select("doc_id", "item_id", "b.score", "b.question_overlap", "b.answer_overlap", (-F.col("b.w")).alias("first_word"))


@scratch
def drop_contaminated(docs: DataFrame, benchmark: DataFrame, params: DecontamParams | None = None) -> DataFrame:
    """docs without the rows in which an item is found, with or without doc_id."""
    hit = _found(docs, benchmark, params or DecontamParams()).select(F.col("doc_id").alias("_hit_id"), F.col("tkey").alias("_hit_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_text"))
    return docs.join(hit, same, "left_anti")
