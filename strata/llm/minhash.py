"""Near-duplicate classes: many universal hash minima, banding, signature check, exact check, connected components.

1. One pass over the texts gives each document its shingle set's size, a 128-bit sum over the set, and `hashes` minima of
   random linear hash functions. Documents with equal sets form a class, a node, represented by its row of least doc_id and text hash; all later
   steps work on nodes, so a group of copies costs one row however large it is.
2. A band is `rows` consecutive minima; representatives that agree on a band share its bucket. In each bucket every
   member is paired with its hub, the member that meets most others over all its bands: as many pairs as members. Members
   whose signature is fairly like the hub's are joined to the hub's group; groups are connected components of these pairs.
   Pairs whose signatures are alike enough for a link (the bound lies five standard deviations below the limit) are confirmed exactly.
3. What these links join needs no more. In a group that they leave in several pieces another hub is taken from the largest piece
   but the main one and compared with all that it isn't joined to, if the group is large, `rounds` times. Members outside the main piece
   are then compared with all others in blocks, one pair of blocks a task, by set size, signature and whole sets. So a
   group of near copies that are linked to their hub costs a row a member, and only the rest is met in blocks. Only links leave a task.
4. Members unlike their bucket's hub are compared with all of that bucket by signature, again in blocks, and what passes is
   confirmed on whole sets. Two members of a bucket are either both in the hub's group or met here: no link is lost.
5. Components by large-star and small-star; each document gets its class's.

Two steps may miss a link. Banding, with 30 bands of 5 rows: one of similarity 0.85 with probability 2e-8, one of 0.8 with
7e-6. The bound on signatures, `agree` of `hashes` minima: one of 0.85 with probability 9e-7, one of 0.8 with 7e-7.

Defined results: a null text is an empty one; a text without words has an empty set and is linked with nothing. A row
without doc_id is in no group: component null, kept. Rows that repeat a doc_id with different texts are nodes of their
own, and the doc_id joins their components: it has the links of all. Where rows are dropped each is judged by its own
text, with or without doc_id, and a doc_id doesn't join anything. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.components import connected_components
from strata.llm.wordhash import SPACE, WordHasher, grams, mix, runs
from strata.runtime import lean, scratch, ship
from strata.runtime import written as _written

#: Texts, signatures and sets go to Python a thousand rows at once: ten thousand texts are held four times over, in both processes.
written = partial(_written, batch=1000)


@dataclass(frozen=True)
class MinHashParams:
    words: int = 5
    percent: int = 80  # a link: 100 * intersection >= percent * union
    bands: int = 30
    rows: int = 5
    seed: int = 11
    block: int = 128
    large: int = 1024  # members of a group that gets more hubs before blocks
    rounds: int = 1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def agree(self) -> int:
        """The least number of equal minima that a candidate needs."""
        s = self.percent / 100
        return int(max(0, self.hashes * s - 5 * (self.hashes * s * (1 - s)) ** 0.5))

    @property
    def fair(self) -> int:
        """The number of equal minima of members that go into one group: it decides where they are compared, not whether."""
        return self.hashes // 2

    def functions(self) -> tuple[np.ndarray, np.ndarray]:
        g = np.random.default_rng(self.seed)
        return g.integers(1, 2**63, self.hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), g.integers(0, 2**63, self.hashes, dtype=np.uint64)


def _sets(texts: list[bytes], hasher: WordHasher, k: int):
    """The sorted distinct shingle hashes of each text."""
    for lo, hi in runs(texts):
        doc, h = grams(hasher.batch(texts[lo:hi]), k)
        ends = np.searchsorted(doc, np.arange(hi - lo), side="right")
        a = 0
        for b in ends:
            s = np.sort(h[a:b])
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s
            a = b


def _minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(len(a), 2**32 - 1, np.uint32)
    for i in range(0, len(s), 2048):
        v = s[i : i + 2048, None] * a
        v += b
        np.minimum(out, (v.view(np.uint32)[:, 1::2]).min(axis=0), out=out)
    return out


SKETCH = "doc_id long, tkey long, n long, f1 long, f2 long, sig binary"


def sketches(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """Text hash, set size, set fingerprint and signature of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)

    def run(batches):
        hasher, (a, b) = WordHasher(SPACE), p.functions()
        for batch in batches:
            texts = [t.as_py() for t in batch.column(2)]
            n, f1, f2, sig = [], [], [], []
            for s in _sets(texts, hasher, p.words):
                n.append(len(s))
                f1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(_minima(s, a, b).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "tkey", "n", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tkey"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")).mapInArrow(lean(run), SKETCH)


def _band_keys(sig: np.ndarray, p: MinHashParams) -> np.ndarray:
    """(signatures, bands): a key of each band."""
    w = np.random.default_rng(p.seed + 1).integers(1, 2**63, (p.bands, p.rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mix((sig.reshape(-1, p.bands, p.rows).astype(np.uint64) * w).sum(axis=2, dtype=np.uint64) + np.arange(p.bands, dtype=np.uint64)).view(np.int64)


def _banded(nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """(band, node): one row for each band of each signature."""

    def run(batches):
        for batch in batches:
            keys = _band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32), p)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(batch.column(0).to_numpy(), p.bands))], names=["band", "node"])

    return nodes.select("node", "sig").mapInArrow(lean(run), "band long, node long")


def _like(pairs: DataFrame, nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (u, v) whose signatures are fairly alike; near: alike enough for a link."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, p.hashes) for c in (2, 3))
            same = (x == y).sum(axis=1)
            ok = np.flatnonzero(same >= p.fair)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), batch.column(1).take(pa.array(ok)), pa.array(same[ok] >= p.agree)], names=["u", "v", "near"])

    side = lambda c: nodes.select(F.col("node").alias(c), F.col("sig").alias(f"sig_{c}"))
    return pairs.join(side("v"), "v").join(side("u"), "u").select("u", "v", "sig_u", "sig_v").mapInArrow(lean(run), "u long, v long, near boolean")


def _linked(x: np.ndarray, y: np.ndarray, p: MinHashParams) -> bool:
    """Whether two sorted sets are a link."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small) or 100 * len(small) < p.percent * len(large):
        return False
    i = np.searchsorted(large, small)
    both = int((large[np.minimum(i, len(large) - 1)] == small).sum())
    return 100 * both >= p.percent * (len(x) + len(y) - both)


def _shingles(docs: DataFrame, need: DataFrame, classes: DataFrame, p: MinHashParams) -> DataFrame:
    """(u, s): the sorted shingle set of each node named in need (u)."""
    named = classes.join(need, F.col("node") == F.col("u"), "left_semi").select(F.col("node").alias("u"), F.col("least.doc_id").alias("_id"), F.col("least.tkey").alias("_tkey"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tkey"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    texts = own.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tkey") == F.col("_tkey"))).select("u", "text")

    def make(batches):
        hasher = WordHasher(SPACE)
        for batch in batches:
            held, at, size = [], 0, 0
            sets = list(_sets([t.as_py() for t in batch.column(1)], hasher, p.words))
            for i, s in enumerate(sets):
                held.append(s.tobytes())
                size += s.nbytes
                if size > 16_000_000 or i == len(sets) - 1:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), pa.array(held, pa.binary())], names=["u", "s"])
                    held, at, size = [], i + 1, 0

    return written(texts.mapInArrow(lean(make), "u long, s binary").dropDuplicates(["u"]), "shingles")


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, p: MinHashParams) -> DataFrame:
    """The pairs (u, v) that are links by their whole shingle sets."""
    sets = _shingles(docs, pairs.select("u").union(pairs.select("v")).distinct(), classes, p)

    def run(batches):
        for batch in batches:
            ok = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), p) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("u").alias("v"), F.col("s").alias("y")), "v").join(sets.withColumnRenamed("s", "x"), "u")
    return both.select("u", "v", "x", "y").mapInArrow(lean(run), "u long, v long")


def _in_blocks(members: DataFrame, key: str, p: MinHashParams) -> DataFrame:
    """key, block_l, block_r and the members of both blocks, for every pair of blocks of a key's members of which one has x = 1.

    Members are dealt to blocks of about p.block, those with x = 0 and x = 1 apart.
    """
    per = members.groupBy(key, "x").agg(F.count("*").alias("_k"))
    sized = members.join(per, [key, "x"]).withColumn("block", (F.pmod(F.xxhash64("node"), F.ceil(F.col("_k") / p.block)) * 2 + F.col("x")).cast("int")).drop("_k")
    sized = written(sized, "blocks")
    blocks = sized.groupBy(key, "block").agg(F.max("x").alias("x"))
    left, right = (blocks.select(key, F.col("block").alias(f"block_{s}"), F.col("x").alias(f"x_{s}")) for s in ("l", "r"))
    work = left.join(right, key).where("block_l <= block_r AND (x_l = 1 OR x_r = 1)").select(key, "block_l", "block_r")
    return work.withColumn("block", F.explode(F.array_distinct(F.array("block_l", "block_r")))).join(sized, [key, "block"]).drop("x")


def _pieces(groups: DataFrame, links: DataFrame) -> DataFrame:
    """node, component, label, n_label, k, x: members of the groups (node, component) that links leave in several pieces.

    label: the piece; k: the group's members; x: 0 in the group's largest piece, else 1.
    """
    joined = groups.join(connected_components(links).select("node", F.col("component").alias("label")), "node", "left").withColumn("label", F.coalesce("label", "node"))
    joined = written(joined, "pieces")
    per = joined.groupBy("component", "label").agg(F.count("*").alias("n_label"))
    main = per.groupBy("component").agg(F.max(F.struct("n_label", "label")).alias("main"), F.sum("n_label").alias("k"), F.count("*").alias("n")).where("n > 1").select("component", "main.label", "k")
    torn = per.join(main.withColumnRenamed("label", "_main"), "component").withColumn("x", (F.col("label") != F.col("_main")).cast("int")).drop("_main")
    return written(joined.join(torn, ["component", "label"]), "members")


def _group_links(groups: DataFrame, direct: DataFrame, nodes: DataFrame, docs: DataFrame, classes: DataFrame, p: MinHashParams) -> DataFrame:
    """Links within groups (node, component), exact: the direct ones and those that join all that is linked."""
    links = direct
    members = _pieces(groups, links)
    for _ in range(p.rounds):
        large = members.where(F.col("k") > p.large)
        if large.isEmpty():
            break
        hub = large.where("x = 1").groupBy("component").agg(F.max(F.struct("n_label", "node", "label")).alias("hub"))
        hub = written(hub.select("component", F.col("hub.node").alias("u"), F.col("hub.label").alias("_label")), "hubs")
        pairs = large.join(hub, "component").where("label <> _label").select("u", F.col("node").alias("v"))
        more = written(_confirmed(_like(pairs, nodes, p).where("near").select("u", "v"), docs, classes, p), "links")
        if more.isEmpty():
            break
        links = written(links.union(more), "links")
        members = _pieces(groups, links)
    if members.isEmpty():
        return links
    sets = _shingles(docs, members.select(F.col("node").alias("u")), classes, p).select(F.col("u").alias("node"), "s")
    rows = _in_blocks(members.select("component", "node", "label", "x"), "component", p).join(nodes.select("node", "sig"), "node").join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        node, block = table["node"].to_numpy(), table["block"].to_numpy()
        left, right = table["block_l"][0].as_py(), table["block_r"][0].as_py()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, p.hashes)
        sets = [np.frombuffer(x, np.uint64) for x in table["s"].to_pylist()]
        n = np.array([len(x) for x in sets])
        root = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
        u, v = [], []
        for i in np.argsort(node):
            if block[i] != left:
                continue
            js = np.flatnonzero((block == right) & (root != root[i]) & ((node > node[i]) | (left != right)) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * p.percent))
            for j in js[(sig[js] == sig[i]).sum(axis=1) >= p.agree]:
                if root[j] != root[i] and _linked(sets[i], sets[j], p):
                    root[root == root[j]] = root[i]
                    u.append(node[i])
                    v.append(node[j])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return links.union(rows.groupBy("component", "block_l", "block_r").applyInArrow(compare, "u long, v long"))


def _apart(members: DataFrame, nodes: DataFrame, p: MinHashParams) -> DataFrame:
    """Candidate pairs by signature of members (band, node, x) of which one is unlike the hub (x = 1), from the first band they share."""
    rows = _in_blocks(members, "band", p).join(members.where("x = 1").select("band", "node", F.lit(True).alias("unlike")), ["band", "node"], "left").join(nodes.select("node", "n", "sig"), "node")

    def compare(table: pa.Table) -> pa.Table:
        out_u, out_v = [], []
        band = table["band"][0].as_py()
        node, n = table["node"].to_numpy(), table["n"].to_numpy()
        unlike = np.array([x is True for x in table["unlike"].to_pylist()])
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint32).reshape(-1, p.hashes)
        keys = _band_keys(sig, p)
        for i in range(len(node)):
            js = np.flatnonzero((node > node[i]) & (unlike | unlike[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * p.percent))
            js = js[(sig[js] == sig[i]).sum(axis=1) >= p.agree] if len(js) else js
            if len(js):
                shared = keys[js] == keys[i]
                js = js[shared.any(axis=1) & (keys[i][shared.argmax(axis=1)] == band)]
            out_u += [node[i]] * len(js)
            out_v += node[js].tolist()
        return pa.table({"u": pa.array(out_u, pa.int64()), "v": pa.array(out_v, pa.int64())})

    return rows.groupBy("band", "block_l", "block_r").applyInArrow(compare, "u long, v long").distinct()


def _linked_classes(docs: DataFrame, p: MinHashParams, unnamed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of docs, and of its rows with doc_id, or of all, the classes of equal sets (n, f1, f2, least, node) and links (u, v) of nodes that join all that are alike."""
    sk = written(sketches(docs, p), "sketches")
    # `least` names the class's representative, as doc_ids may repeat; a node's number holds once the table is written
    least = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tkey")  # a row without doc_id comes last
    classes = sk.where("n > 0" if unnamed else "n > 0 AND doc_id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min(least).alias("least"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    own = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("tkey") == F.col("least.tkey"))
    nodes = written(sk.join(classes, ["n", "f1", "f2"]).where(own).select("node", "n", "sig").dropDuplicates(["node"]), "nodes")
    banded = _banded(nodes, p)
    sizes = written(banded.groupBy("band").agg(F.count("*").alias("k")).where("k > 1"), "bucket-counts")  # by itself, so that Spark can split a hot bucket in the join
    shared = written(banded.join(sizes, "band").select("band", "node", "k"), "buckets")
    met = shared.groupBy("node").agg(F.sum("k").alias("met"))
    hubs = shared.join(met, "node").groupBy("band").agg(F.max(F.struct("met", (-F.col("node")).alias("least"))).alias("hub"))
    to_hub = written(shared.join(hubs, "band").select("band", "node", (-F.col("hub.least")).alias("hub")), "hubs")
    pairs = to_hub.where("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    like = written(_like(pairs, nodes, p), "pairs")
    direct = written(_confirmed(like.where("near").select("u", "v"), docs, classes, p), "links")
    links = written(_group_links(connected_components(like.select("u", "v")), direct, nodes, docs, classes, p), "links")
    marked = to_hub.join(like.select(F.col("u").alias("hub"), F.col("v").alias("node"), F.lit(1).alias("_like")), ["hub", "node"], "left")
    marked = marked.select("band", "node", F.when((F.col("hub") == F.col("node")) | F.col("_like").isNotNull(), 0).otherwise(1).alias("x"))
    torn = marked.groupBy("band").agg(F.max("x").alias("t")).where("t = 1").select("band")
    more = written(_apart(written(marked.join(torn, "band", "left_semi"), "apart"), nodes, p), "pairs")
    if not more.isEmpty():
        links = links.union(_confirmed(more, docs, classes, p))
    return sk, classes, links


def _named(classes: DataFrame, links: DataFrame) -> DataFrame:
    """(n, f1, f2, first): the least row of the group of each class."""
    comps = written(classes.join(connected_components(links), "node", "left").select("n", "f1", "f2", "least", F.coalesce("component", "node").alias("component")), "groups")
    return comps.join(comps.groupBy("component").agg(F.min("least").alias("first")), "component").select("n", "f1", "f2", "first")


@scratch
def near_duplicates(docs: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs (doc_id, text)."""
    p = params or MinHashParams()
    sk, classes, links = _linked_classes(docs, p)
    # a doc_id of several texts joins their classes
    sets = F.struct("n", "f1", "f2")
    torn = sk.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(sets).alias("a"), F.max(sets).alias("b")).where("a <> b").select("doc_id")
    torn = written(torn, "torn")
    if not torn.isEmpty():
        met = sk.join(torn, "doc_id").join(classes.select("n", "f1", "f2", "node"), ["n", "f1", "f2"]).select("doc_id", "node").distinct()
        links = links.union(met.join(met.groupBy("doc_id").agg(F.min("node").alias("u")), "doc_id").where("u <> node").select("u", F.col("node").alias("v")))
    named = _named(classes, links).withColumn("component", F.col("first.doc_id")).drop("first")
    # a group of copies is one class: without salt its rows would meet in one task
    out = sk.select("doc_id", "n", "f1", "f2").join(named, ["n", "f1", "f2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@scratch
def drop_near_duplicates(docs: DataFrame, params: MinHashParams | None = None) -> DataFrame:
    """docs with one row of each group of texts alike, that of the least doc_id; of rows without words one of each doc_id and text.

    Rows without doc_id are judged too; of their group they stay only if no row with doc_id is in it.
    """
    sk, classes, links = _linked_classes(docs, params or MinHashParams(), unnamed=True)
    rows = sk.where("n > 0").join(_named(classes, links), ["n", "f1", "f2"])
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("tkey") == F.col("first.tkey"))
    gone = rows.where(~own).select(F.col("doc_id").alias("_gone_id"), F.col("tkey").alias("_gone_text")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64("text") == F.col("_gone_text"))
    return _one_of_each(docs.join(gone, same, "left_anti"))


def _one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of those that repeat a doc_id and text. Only rows whose doc_id and text hash repeat are moved."""
    key = [F.col("doc_id").cast("long").alias("_again_id"), F.xxhash64("text").alias("_again_text")]
    again = written(docs.select(*key).groupBy("_again_id", "_again_text").agg(F.count("*").alias("_k")).where("_k > 1").drop("_k"), "repeats")
    if again.isEmpty():
        return docs
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_again_id")) & (F.xxhash64("text") == F.col("_again_text"))
    return docs.join(again, same, "left_anti").union(docs.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
