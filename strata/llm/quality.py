"""Quality classifier by hierarchical empirical Bayes.

Document evidence. Two heads, junk and toxic, are logistic models over words, word beginnings and a few style measures. The
words are chosen by the shrunken log odds of their document counts in a bounded sample of labelled rows, counted by grouped
aggregation; the weights are fitted on the driver on one short row per sampled document (`fit_rows` at most).

Sites. A document's site is its host and its path (here source and language). Each head's expected count of bad documents
is summed per path and per host over all documents. A host's rate is drawn to the global rate, a path's to its host's, by
a pseudo-count estimated from the spread between hosts, or between paths (beta-binomial moments); sparse sites stay near
their parents. The path's posterior takes the place of the prior in the document's log odds.

A document is kept if neither head's posterior reaches `reject`.

Defined results: a null or empty text has no words; it is judged by its style measures and its site. Null hosts and paths
are sites of their own. Without any labelled row of both kinds a head is silent (probability 0). Repeated rows get equal results
and count in their sites. Labels without a document, or null, are left out. Extra columns stay in filter_quality() and
are ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.wordhash import ALNUM, WordHasher, mix, runs
from strata.runtime import lean, scratch, ship, written

HEADS = ("junk", "toxic")
STYLE = ("letters", "upper", "digits", "punctuation", "marks", "bars", "lines", "repeats")


@dataclass(frozen=True)
class QualityParams:
    fit_rows: int = 20_000
    features: int = 400  # words per head
    least_docs: int = 5
    beginning: int = 5  # bytes of a word's beginning
    reject: float = 0.5
    seed: int = 5
    l2: float = 1e-3
    rounds: int = 300


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weight: np.ndarray  # (heads, keys + style)
    bias: np.ndarray
    prior: np.ndarray  # log odds in the sample
    params: QualityParams


def _features(texts: list[bytes], hasher: WordHasher, p: QualityParams):
    """(text index, distinct feature hash) sorted, and style measures, for a run of texts."""
    w = hasher.batch(texts)
    data = np.frombuffer(w.buffer, np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(hasher.value[data] * hasher._pow[: len(data)], out=sums[1:])
    to = np.minimum(w.start + p.beginning, w.end)
    begin = mix((sums[to] - sums[w.start]) * hasher._inv[w.start] + np.uint64(0x5851F42D4C957F2D))
    doc = np.concatenate([w.doc, w.doc])
    h = np.concatenate([w.hash, begin])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, bool)
    doc, h = doc[first], h[first]
    ends = np.cumsum([len(t) + 1 for t in texts])
    size = np.maximum(np.diff(np.concatenate([[0], ends])) - 1, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return np.diff(c[np.concatenate([[0], ends])]) / size

    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122) | (data >= 128)
    digit = (data >= 48) & (data <= 57)
    mark = np.isin(data, np.frombuffer(b"!$%&*#@^~", np.uint8))
    distinct = np.bincount(doc, minlength=len(texts)) / 2
    style = np.stack([share(upper | lower), share(upper), share(digit), share(~(upper | lower | digit) & (data > 32)), share(mark), share(data == 124), share(data == 10), 1 - np.minimum(1, distinct / np.maximum(w.counts, 1))], axis=1)
    return doc, h, style * np.array([1, 2, 4, 4, 8, 20, 10, 1])


def _rows(docs: DataFrame, *more: Column | str) -> DataFrame:
    return docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more)


def _logit(p):
    return np.log(p) - np.log1p(-p)


def labelled_sample(docs: DataFrame, labels: DataFrame, p: QualityParams) -> DataFrame:
    """text, junk, toxic of at most about fit_rows labelled documents, drawn by the hash of doc_id."""
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg((1 - F.min("quality")).alias("junk"), F.max("toxic").alias("toxic"))
    n = lab.count()
    if n > p.fit_rows:
        lab = lab.where(F.pmod(F.xxhash64("id", F.lit(p.seed)), F.lit(1 << 30)) < int((1 << 30) * (p.fit_rows / n)))
    own = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), "text")
    return _rows(own.join(lab, "id"), F.col("junk").cast("int").alias("junk"), F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> Model:
    ship(docs.sparkSession)
    p = params or QualityParams()
    sample = written(labelled_sample(docs, labels, p), "labelled")

    def hashes(batches):
        hasher = WordHasher(ALNUM)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            for lo, hi in runs(texts):
                doc, h, _ = _features(texts[lo:hi], hasher, p)
                for_doc = lambda c: pa.array(batch.column(c).to_numpy()[lo + doc])  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), for_doc(1), for_doc(2)], names=["h", "junk", "toxic"])

    n, junk, toxic = (int(x or 0) for x in sample.agg(F.count("*"), F.sum("junk"), F.sum("toxic")).first())
    bad = {"junk": junk, "toxic": toxic}
    counts = sample.mapInArrow(lean(hashes), "h long, junk int, toxic int").groupBy("h").agg(F.count("*").alias("n"), F.sum("junk").alias("junk"), F.sum("toxic").alias("toxic")).where(F.col("n") >= p.least_docs)
    chosen: set[int] = set()
    for head in HEADS:
        b = bad[head]
        if not 0 < b < n:
            continue
        # log odds of a word's document rate, bad against good, with half a document added; by its standard error
        x, y = F.col(head) + 0.5, F.col("n") - F.col(head) + 0.5
        z = (F.log(x / (b - F.col(head) + 0.5)) - F.log(y / (n - b - F.col("n") + F.col(head) + 0.5))) / F.sqrt(1 / x + 1 / y)
        chosen |= {r[0] for r in counts.orderBy(F.abs(z).desc(), "h").limit(p.features).select("h").collect()}
    keys = np.sort(np.array(sorted(chosen), np.int64).view(np.uint64)) if chosen else np.empty(0, np.uint64)

    def design(batches):
        hasher = WordHasher(ALNUM)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            rows = [_packed(x, len(keys)) for lo, hi in runs(texts) for x in _design(texts[lo:hi], hasher, keys, p)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1), batch.column(2)], names=["x", "junk", "toxic"])

    got = sample.mapInArrow(lean(design), "x binary, junk int, toxic int").collect()
    x = np.ones((len(got), len(keys) + len(STYLE) + 1), np.float32)  # the last column is the bias
    for i, r in enumerate(got):
        x[i, : len(keys)] = np.unpackbits(np.frombuffer(r[0], np.uint8, offset=4 * len(STYLE)), count=len(keys))
        x[i, len(keys) : -1] = np.frombuffer(r[0], np.float32, len(STYLE))
    y = np.array([[r[1], r[2]] for r in got], np.float32).reshape(-1, 2)
    del got
    model = Model(keys, np.zeros((2, x.shape[1] - 1), np.float32), np.full(2, -np.inf), np.zeros(2), p)
    for i, head in enumerate(HEADS):
        if 0 < bad[head] < n:
            model.weight[i], model.bias[i] = _fit(x, y[:, i], p)
            model.prior[i] = _logit(bad[head] / n)
    return model


def _packed(x: np.ndarray, features: int) -> bytes:
    """A row of the design for the driver: the style measures, and a bit for each feature."""
    return x[features:].tobytes() + np.packbits(x[:features] > 0).tobytes()


def _fit(x1: np.ndarray, y: np.ndarray, p: QualityParams) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on all rows at once, both kinds of label weighing as they occur. x1: a last column of ones."""
    w = np.zeros(x1.shape[1], np.float32)
    w[-1] = _logit(min(max(float(y.mean()), 1e-3), 1 - 1e-3))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, p.rounds + 1):
        g = x1.T @ (1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30))) - y) / len(y)
        g[:-1] += p.l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-1], float(w[-1])


def _design(texts: list[bytes], hasher: WordHasher, keys: np.ndarray, p: QualityParams) -> np.ndarray:
    doc, h, style = _features(texts, hasher, p)
    x = np.zeros((len(texts), len(keys) + len(STYLE)), np.float32)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        ok = keys[at] == h
        x[doc[ok], at[ok]] = 1
    x[:, len(keys) :] = style
    return x


def evidence(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """The columns `keep` and each head's log odds: llr_junk, llr_toxic. One pass, no shuffle."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = _rows(docs, *keep)

    def run(batches):
        m = shared.value
        hasher = WordHasher(ALNUM)
        for batch in batches:
            texts = [t.as_py() for t in batch.column(0)]
            out = [np.empty((0, 2))]
            for lo, hi in runs(texts):
                x = _design(texts[lo:hi], hasher, m.keys, m.params)
                out.append(x.astype(np.float64) @ m.weight.T.astype(np.float64) + m.bias)
            z = np.clip(np.concatenate(out), -30, 30)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(z[:, 0]), pa.array(z[:, 1])], names=[*batch.schema.names[1:], "llr_junk", "llr_toxic"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(lean(run), f"{kept}, llr_junk double, llr_toxic double")


def _strength(rate: Column, n: Column, mean: Column) -> Column:
    """The pseudo-count of a beta prior over sites: from the sites' spread beyond what their sizes explain."""
    total = F.sum(n)
    between = F.sum(n * (rate - mean) * (rate - mean)) / total
    chance = F.sum(mean * (1 - mean)) / total  # each site's binomial variance times its size
    top = F.max(mean * (1 - mean))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), top / F.greatest(between - chance, F.lit(1e-9)) - 1))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """host, path, n and, for each head, the path's posterior rate: path drawn to host, host to all."""
    p_of = lambda z: 1 / (1 + F.exp(-F.col(z)))
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), *[F.sum(p_of(f"llr_{h}")).alias(f"s_{h}") for h in HEADS])
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), *[F.sum(f"s_{h}").alias(f"h_{h}") for h in HEADS])
    everything = hosts.agg(F.sum("hn").alias("gn"), *[((F.sum(f"h_{h}") + 0.5) / (F.sum("hn") + 1)).alias(f"mu_{h}") for h in HEADS])
    hosts = hosts.join(F.broadcast(everything))  # one row
    k_host = hosts.agg(*[_strength(F.col(f"h_{h}") / F.col("hn"), F.col("hn"), F.col(f"mu_{h}")).alias(f"kh_{h}") for h in HEADS])
    hosts = hosts.join(F.broadcast(k_host))
    hosts = hosts.select(F.col("host").alias("_host"), *[((F.col(f"h_{h}") + F.col(f"kh_{h}") * F.col(f"mu_{h}")) / (F.col("hn") + F.col(f"kh_{h}"))).alias(f"m_{h}") for h in HEADS])
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    k_path = paths.agg(*[_strength(F.col(f"s_{h}") / F.col("n"), F.col("n"), F.col(f"m_{h}")).alias(f"kp_{h}") for h in HEADS])
    paths = paths.join(F.broadcast(k_path))
    return paths.select("host", "path", "n", *[((F.col(f"s_{h}") + F.col(f"kp_{h}") * F.col(f"m_{h}")) / (F.col("n") + F.col(f"kp_{h}"))).alias(f"rate_{h}") for h in HEADS])


def posterior(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None, host: str = "source", path: str = "lang", model: Model | None = None) -> DataFrame:
    """doc_id, tkey (hash of the text), host, path, site_n, for each head evidence, site rate and posterior, and kept, for each row of docs."""
    p = params or QualityParams()
    model = model or fit(docs, labels, p)
    scored = evidence(docs, model, F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))
    scored = written(scored, "scored", batch=1000)
    sites = site_posteriors(scored).select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("n").alias("site_n"), *[f"rate_{h}" for h in HEADS])
    sites = written(sites, "sites")
    out = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))).drop("_host", "_path")
    for i, h in enumerate(HEADS):
        rate = F.least(F.greatest(F.col(f"rate_{h}"), F.lit(1e-6)), F.lit(1 - 1e-6))
        odds = F.col(f"llr_{h}") - float(model.prior[i]) + F.log(rate) - F.log(1 - rate)
        out = out.withColumn(f"p_{h}", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", (F.col("p_junk") < p.reject) & (F.col("p_toxic") < p.reject))


@scratch
def quality_digest(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    rounded = lambda c: F.round(c, 6).alias(c)
    return posterior(docs, labels, params).select("doc_id", "host", "path", "site_n", rounded("rate_junk"), rounded("rate_toxic"), rounded("p_junk"), rounded("p_toxic"), "kept")


@scratch
def filter_quality(docs: DataFrame, labels: DataFrame, params: QualityParams | None = None) -> DataFrame:
    """docs without the rejected rows, all columns kept. A text is judged with its source and language: its copy at another site may stay."""
    gone = posterior(docs, labels, params).where("NOT kept").select(*[F.col(c).alias(f"_gone_{c}") for c in ("doc_id", "tkey", "host", "path")]).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_doc_id")) & (F.xxhash64(F.col("text")) == F.col("_gone_tkey"))
    same = same & F.col("source").cast("string").eqNullSafe(F.col("_gone_host")) & F.col("lang").cast("string").eqNullSafe(F.col("_gone_path"))
    return docs.join(gone, same, "left_anti")
