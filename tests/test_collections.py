import pytest
from pyspark.sql import functions as F

from strata.errors import StrataError
from strata.functions import hashing, text
from strata.operators import align, collections, diff, merge, rows, search
from strata.operators.ordinal import renumbered, with_ordinal
from tests.conftest import rows as got


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def strs(*xs):
    return F.array(*[F.lit(x) for x in xs])


def test_list_edits(spark):
    a = strs("e1", "e22", "e55555")
    assert one(spark, collections.list_get(a, 1)) == "e22"
    assert one(spark, collections.list_get(a, 5)) is None
    b = collections.list_splice(a, 1, 1, strs("e333", "e4444"))
    assert one(spark, b) == ["e1", "e333", "e4444", "e55555"]
    assert one(spark, collections.list_splice(b, 3, 2, strs("e22"))) == ["e1", "e333", "e4444", "e22"]
    assert one(spark, collections.list_delete(a, 0, 9)) == []
    assert one(spark, collections.list_splice(a, 9, 1, strs("z"))) == ["e1", "e22", "e55555", "z"]


def test_blob_edits(spark):
    trace = lambda b: one(spark, b.cast("string"))
    b = F.lit("Hello, world!").cast("binary")
    b = collections.blob_splice(b, 7, 10, F.lit("girl~").cast("binary"))
    assert trace(b) == "Hello, girl~"
    b = collections.blob_splice(b, 6, 0, F.lit(" pretty").cast("binary"))
    assert trace(b) == "Hello, pretty girl~"
    assert trace(collections.blob_splice(b, 2, 3, F.lit("").cast("binary"))) == "He, pretty girl~"
    assert bytes(one(spark, collections.blob_read(b, 100, 5))) == b""


def test_map_and_set_edits(spark):
    m = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(spark, collections.map_set(m, F.lit("b"), F.lit("two"))) == {"a": "1", "b": "two"}
    assert one(spark, collections.map_remove(m, F.lit("zz"))) == {"a": "1", "b": "2"}
    assert one(spark, collections.set_insert(strs("b", "a"), F.lit("b"))) == ["a", "b"]


def test_long_list_edits(spark):
    df = spark.createDataFrame([(i, f"e{i}") for i in range(6)], "_rid long, v string")
    ins = spark.createDataFrame([(0, "x"), (1, "y")], "_rid long, v string")
    assert got(collections.rows_list_splice(df, 1, 3, ins)) == [(0, "e0"), (1, "x"), (2, "y"), (3, "e4"), (4, "e5")]
    assert [r[1] for r in got(collections.rows_list_append(df, ins))][-2:] == ["x", "y"]
    none = df.limit(0)
    assert got(collections.rows_list_splice(none, 3, 3, ins)) == [(0, "x"), (1, "y")]


def test_positional_diff_after_insert(spark):
    base = list("abcdefghijklmnop")
    a = spark.createDataFrame(list(enumerate(base)), "_rid long, v string")
    b = spark.createDataFrame(list(enumerate(base[:10] + list("XYZ") + base[10:])), "_rid long, v string")
    assert [r[0] for r in got(diff.list_intersect(a, b, "v"))] == sorted(range(10), key=lambda i: repr((i,)))
    assert diff.ranges(diff.dual_diff(a, b, ["_rid"], ["v"])).first().asDict() == {"first": 10, "n": 9}


def test_diff_tells_null_from_missing(spark):
    a = spark.createDataFrame([("x", None), ("y", "1")], "k string, v string")
    b = spark.createDataFrame([("y", "1")], "k string, v string")
    assert got(diff.dual_diff(a, b, ["k"], ["v"])) == [("x", None, None, True, False)]
    assert got(diff.dual_diff(a.limit(0), b.limit(0), ["k"], ["v"])) == []


MAP_BASE = {f"k{i}": f"v{i}" for i in (0, 1, 2, 3, 5, 7)}
MAP_1 = {"k11": "v1", **{f"k{i}": f"v{i}" for i in (2, 3, 4, 5, 6, 7)}}
MAP_2 = {**{f"k{i}": f"v{i}" for i in (0, 1, 2, 5, 6, 7, 8)}, "k3": "v33"}


def frame(spark, m):
    return spark.createDataFrame(sorted(m.items()), "k string, v string")


def test_map_merge(spark):
    b, x, y = frame(spark, {**MAP_BASE}), frame(spark, MAP_1), frame(spark, {**MAP_2})
    out = dict(got(merge.merge3(b, x, y, ["k"], ["v"])))
    assert out == {"k11": "v1", "k2": "v2", "k3": "v33", "k4": "v4", "k5": "v5", "k6": "v6", "k7": "v7", "k8": "v8"}
    assert got(merge.conflicts(b, x, y, ["k"], ["v"])) == []


def test_map_merge_conflict_modes(spark):
    b = frame(spark, {"k0": "v0", "k1": "v1", "k2": "v2"})
    x = frame(spark, {"k0": "v00", "k11": "v1", "k2": "v2"})
    y = frame(spark, {"k0": "v0", "k11": "v1", "k2": "v22"})
    assert dict(got(merge.merge3(b, x, y, ["k"], ["v"]))) == {"k0": "v00", "k11": "v1", "k2": "v22"}
    assert len(got(merge.region_conflicts(b, x, y, "k", ["v"]))) == 1


def test_big_map_merge(spark):
    n = 4096
    base = {f"{i:04d}": i for i in range(n)}
    e1 = {k: v + 100 if 100 <= v < 200 or 900 <= v < 1000 else v for k, v in base.items()}
    e2 = {k: v + 100 if 500 <= v < 600 or 900 <= v < 1000 else v for k, v in base.items()}
    f = lambda m: spark.createDataFrame(list(m.items()), "k string, v long")
    out = dict(got(merge.merge3(f(base), f(e1), f(e2), ["k"], ["v"])))
    assert out == {k: v + 100 if 100 <= v < 200 or 500 <= v < 600 or 900 <= v < 1000 else v for k, v in base.items()}


def test_set_merge(spark):
    f = lambda s: spark.createDataFrame([(x,) for x in s.split()], "k string")
    out = merge.set_merge3(f("k0 k1 k2 k3 k5 k7"), f("k11 k2 k3 k4 k5 k6 k7"), f("k0 k1 k2 k33 k5 k6 k7 k8"), ["k"])
    assert {r[0] for r in got(out)} == set("k11 k2 k33 k4 k5 k6 k7 k8".split())


def test_list_merge():
    assert align.merge_lists(list("abcdefgh"), list("aCdefGgh"), list("bcdEfghH")) == list("CdEfGghH")
    with pytest.raises(StrataError):
        align.merge_lists(list("abcde"), list("aCde"), list("Bcde"))
    assert align.merge_lists([], ["a"], []) == ["a"]


def test_alignment(spark):
    f = lambda s: spark.createDataFrame([("o", i, c) for i, c in enumerate(s)], "key string, _rid long, value string")
    ops = [r["op"] for r in align.align(f("abcdef"), f("abXdef"), "key").orderBy("lhs_first").collect()]
    assert ops == ["equal", "replace", "equal"]


def test_rows(spark):
    df = spark.createDataFrame([(i, v, i * 10) for i, v in enumerate("abbbab")], "_rid long, c string, n long")
    assert [r["n"] for r in rows.update_first_run(df, "c", "b", {"n": -1}).orderBy("_rid").collect()] == [0, -1, -1, -1, 40, 50]
    assert [r["n"] for r in rows.update_first_run(df, "c", "zz", {"n": -1}).orderBy("_rid").collect()] == [0, 10, 20, 30, 40, 50]
    assert got(rows.delete_rows(df, "c", "b").select("_rid", "n")) == [(0, 0), (1, 40)]
    assert rows.insert_row(df.limit(0), {"c": "x", "n": 1}).first()["_rid"] == 0
    with pytest.raises(StrataError):
        rows.insert_row(df, {"c": "x"})
    with pytest.raises(StrataError):
        rows.update_row(df, 99, {"c": "x"})
    with pytest.raises(StrataError):
        rows.update_rows(df, "c", "nope", {"n": 1})
    short = spark.createDataFrame([(0, "p")], "_rid long, s string")
    assert rows.put_column(df, "s", short).where("s IS NULL").count() == 5


def test_ordinals_in_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"))
    out = with_ordinal(df, ["k"], rows_per_part=100)
    assert out.where("k <> _rid").isEmpty() and out.count() == 1000
    assert renumbered(out.where("k % 2 = 0")).where("_rid * 2 <> k").isEmpty()


def test_text(spark):
    assert one(spark, text.split_fields(F.lit("a,b,,"), ",")) == ["a", "b", ""]
    assert one(spark, text.split_fields(F.lit(""), ",")) == []
    assert one(spark, text.tokenize(F.lit(" [a, b]\tc,"))) == ["a", "b", "c"]
    assert one(spark, text.regularize_csv(F.lit("  KID, CA,CB , C  C "))) == "KID,CA,CB,C  C"
    assert one(spark, text.regularize_integers(F.lit("007,10.500"))) == "7,10.500"
    assert one(spark, text.regularize_floats(F.lit("1.250 3.000"))) == "1.25 3"
    assert one(spark, text.parse_row(F.lit("{c1:v1,c2:v2}"))) == {"c1": "v1", "c2": "v2"}
    assert one(spark, text.extract_elements(strs("a", "b"), [1, 5])) == ["b", None]
    assert text.tokenize_args('a "b c"') == ["a", "b c"] and text.tokenize_args('a "b') is None
    with pytest.raises(Exception, match="illegal attribute"):
        one(spark, text.entry_name(F.lit("a^b"), F.lit("c")))


def test_hashes(spark):
    fox = "The quick brown fox jumps over the lazy dog"
    assert hashing.version_of(fox.encode()) == "26UPXMYH26AJI2OKTK6LACBOJ6GVMUPE"
    assert one(spark, hashing.base32(F.substring(F.sha2(F.lit(fox), 256), 1, 40))) == "26UPXMYH26AJI2OKTK6LACBOJ6GVMUPE"
    assert hashing.to_base32(hashing.from_base32(hashing.NULL_VERSION)) == hashing.NULL_VERSION
    with pytest.raises(StrataError):
        hashing.from_base32("1")
    data = bytes(range(256)) * 400
    shifted = b"xx" + data
    a = {data[i:j] for i, j in hashing.chunk_bounds(data)}
    b = {shifted[i:j] for i, j in hashing.chunk_bounds(shifted)}
    assert b"".join(data[i:j] for i, j in hashing.chunk_bounds(data)) == data and (len(b - a) <= 2 or len(a) <= 4)


def test_content_hash_ignores_history(spark):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(100)], "_rid long, v string")
    edited = rows.update_where(rows.update_where(df, F.col("_rid") == 3, {"v": "x"}), F.col("_rid") == 3, {"v": "v3"})
    h = lambda d: got(hashing.segment_hashes(d, "_rid", ["v"], 16))
    assert h(df) == h(edited.repartition(3)) and h(df) != h(df.withColumn("v", F.lit("")))


def test_query_parser():
    assert search.parse("aa") == search.Term(search.ALL, "aa")
    assert search.parse("bb OR cc").kind == "or" and search.parse("aa AND ac").kind == "and"
    assert search.parse("C_C : aa") == search.Term("C_C", "aa")
    for bad in ("", "AND", "(a", "a OR"):
        with pytest.raises(StrataError):
            search.parse(bad)


def _copied(n, period):
    """A list that repeats a stretch of few values, and the same without a tenth of its elements."""
    import random

    r = random.Random(period)
    base = [r.choice("abcdef") for _ in range(period)]
    keep = [r.random() > 0.1 for _ in range(period)]
    return [base[i % period] for i in range(n)], [base[i % period] for i in range(n) if keep[i % period]]


def test_alignment_is_that_of_difflib():
    from difflib import SequenceMatcher

    for n, period in ((900, 900), (900, 70), (1200, 1), (1000, 400)):
        a, b = _copied(n, period)
        for x, y in ((a, b), (["s", *a], ["t", *b[400:], *b[:200], None]), (b, a[::-1])):
            assert align._steps(x, y) == SequenceMatcher(None, x, y, autojunk=False).get_opcodes()


def test_alignment_of_long_lists_takes_no_square():
    import time

    for period in (800, 40000):
        a, b = _copied(40000, period)
        began = time.process_time()
        ops = align.opcodes(a, b)
        assert time.process_time() - began < 20
        assert sum(j - i for _, i, j, _, _ in ops) == len(a) and sum(m - k for _, _, _, k, m in ops) == len(b)
        assert all(a[i:j] == b[k:m] for t, i, j, k, m in ops if t == "equal")
