"""Segmented storage, ordinals in ranges, long histories, and the edits and verbs built on them."""

import pytest
from pyspark.sql import functions as F

from strata.errors import Code
from strata.operators import collections, commits, dataset, rows
from strata.operators.ordinal import with_ordinal
from strata.plans.objects import BlobObject, ListObject, MapObject
from strata.plans.repository import Repository, VersionedDataset
from strata.plans.script import Script
from tests.conftest import rows as got
from tests.test_repository import code


@pytest.fixture
def repo(spark, tmp_path):
    return Repository(spark, f"file://{tmp_path}/repo")


def test_ordinals_above_one_range(spark):
    """Three million rows in scattered order: numbers distinct, without gaps, in the order of the key."""
    n = 3_000_000
    df = spark.range(n).select(F.xxhash64("id").alias("k"), "id")
    out = with_ordinal(df, ["k", "id"])
    one = out.agg(F.count_distinct("_rid").alias("d"), F.min("_rid").alias("a"), F.max("_rid").alias("b"), F.count("*").alias("n")).first()
    assert (one["d"], one["a"], one["b"], one["n"]) == (n, 0, n - 1, n)
    steps = out.select("_rid", "k").join(out.select((F.col("_rid") - 1).alias("_rid"), F.col("k").alias("next")), "_rid")
    assert steps.where("next < k").isEmpty()


def test_ordinals_of_hot_keys(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), "id")
    out = with_ordinal(df, ["k", "id"], rows_per_part=1000).orderBy("_rid").collect()
    assert [(r["k"], r["id"]) for r in out] == sorted((i % 3, i) for i in range(20_000)) and [r["_rid"] for r in out] == list(range(20_000))


def test_ancestry_is_whole(spark):
    """A chain of 300, merges, and a depth; rounds grow with its logarithm."""
    edges = [("a", i, i - 1 if i else None, i - 7 if i % 10 == 0 and i > 7 else None) for i in range(301)]
    c = spark.createDataFrame(edges, "key string, version long, parent1 long, parent2 long")
    start = spark.createDataFrame([("a", 300)], "key string, version long")
    want = {300: 0}
    todo = [300]
    while todo:
        v = todo.pop(0)
        for p in edges[v][2:]:
            if p is not None and p not in want:
                want[p] = want[v] + 1
                todo.append(p)
    assert {r["version"]: r["distance"] for r in commits.ancestry(c, start).collect()} == want
    assert {r["version"]: r["distance"] for r in commits.ancestry(c, start, depth=5).collect()} == {v: d for v, d in want.items() if d <= 5}
    loop = spark.createDataFrame([("a", 1, 2, None), ("a", 2, 1, None)], "key string, version long, parent1 long, parent2 long")
    assert code(commits.ancestry, loop, spark.createDataFrame([("a", 1)], "key string, version long")) is Code.INVALID_PARAMETER


def test_puts_write_and_diffs_read_changed_segments_alone(repo, spark):
    df = spark.range(4000).select(F.col("id").alias("_rid"), F.concat(F.lit("v"), "id").alias("v"))
    repo.put("t", df, keys=["_rid"])
    repo.branch("t", "dev", old="master")
    repo.put("t", df.withColumn("v", F.when(F.col("_rid") == 17, "x").otherwise(F.col("v"))), "dev", keys=["_rid"])
    a, b = (repo.manifest(repo.commit("t", repo.head("t", x))["data"]) for x in ("master", "dev"))
    assert len(a.segments) == 16 and sum(a.segments[k]["path"] != b.segments[k]["path"] for k in a.segments) == 1
    out = repo.diff("t", "master", "dev")
    assert [(r["_rid"], r["lhs_v"], r["rhs_v"]) for r in out.collect()] == [(17, "v17", "x")]
    assert len({f.rsplit("/", 1)[0] for f in out.inputFiles()}) == 2  # a segment of either side
    assert repo.get("t", "dev").count() == 4000
    info = {r["kind"]: (r["n_objects"], r["n_segments"]) for r in repo.storage_info().collect()}
    assert info == {"frame": (2, 17)} and repo.storage_info().first()["n_bytes"] > 0
    few = repo.lookup(repo.commit("t", repo.head("t", "dev"))["data"], spark.createDataFrame([(17,)], "_rid long"))
    assert got(few, "v") == [("x",)] and len({f.rsplit("/", 1)[0] for f in few.inputFiles()}) == 1
    data = repo.put_unkeyed(df)
    assert repo.put_unkeyed(df.repartition(5)) == data and repo.get_unkeyed(data).count() == 4000
    assert code(repo.get_unkeyed, "none") is Code.CHUNK_NOT_EXISTS and code(repo.get_segment, data, 99) is Code.CHUNK_NOT_EXISTS
    assert repo.get_segment(data, 3).count() == repo.manifest(data).segments[3]["n"]


def test_other_columns_make_new_segments(repo, spark):
    df = spark.range(50).select(F.col("id").alias("_rid"), F.lit("a").alias("v"))
    repo.put("t", df, keys=["_rid"])
    repo.put("t", df.withColumn("w", F.lit(None).cast("string")), keys=["_rid"])
    repo.put("t", df.limit(0).withColumn("w", F.lit("x")), keys=["_rid"])
    assert repo.get("t").columns == ["_rid", "v", "w"] and repo.get("t").count() == 0


def test_catalog_is_compacted(spark, tmp_path):
    repo = Repository(spark, f"file://{tmp_path}/repo", most_files=4)
    for i in range(5):
        repo.put("k", f"v{i}")
    files = [p for p in (tmp_path / "repo/heads").iterdir() if p.name.startswith("part")]
    assert len(files) < 5 and repo.get("k") == "v4" and repo.commits().count() == 5
    (tmp_path / "repo/heads").rename(tmp_path / "repo/heads.old")  # cut off between two renames
    assert repo.get("k") == "v4"


def test_repeated_names_in_one_batch(spark):
    ds = spark.createDataFrame([("a", "1")], "entry string, payload string")
    new = spark.createDataFrame([("a", "2"), ("a", "3"), ("b", "4"), ("b", "4")], "entry string, payload string")
    assert got(dataset.put_entries(ds, new)) == [("a", "3"), ("b", "4")]
    assert got(collections.rows_map_set(ds, new, "entry")) == [("a", "3"), ("b", "4")]


def test_delete_row_out_of_range(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "_rid long, v string")
    assert code(rows.delete_row, df, 2) is Code.INDEX_OUT_OF_RANGE and code(rows.delete_row, df, -1) is Code.INDEX_OUT_OF_RANGE
    assert got(rows.delete_row(df, 0)) == [(0, "b")]


def test_splices_at_once(repo):
    x = ListObject(repo, "l")
    x.create([str(i) for i in range(10)])
    x.edit().delete(2, 3).insert(7, ["p", "q"]).splice(0, 1, ["z"]).insert(7, ["r"]).splice(100, 5, ["end"]).commit()
    assert [r["value"] for r in x.read().orderBy("_rid").collect()] == ["z", "1", "5", "6", "p", "q", "r", "7", "8", "9", "end"]
    head = repo.head("l", "master")
    assert x.edit().commit() == head
    assert code(x.edit().splice(1, 3).splice(2, 1).commit) is Code.INVALID_PARAMETER and code(x.edit().splice, -1, 0) is Code.INDEX_OUT_OF_RANGE


def test_list_merge(repo):
    x = ListObject(repo, "l")
    x.create(list("abcdefgh"))
    repo.branch("l", "dev", old="master")
    y = ListObject(repo, "l", "dev")
    x.splice(0, 1, ["A"])
    y.append(["end"])
    v = x.merge("dev")
    assert "".join(r["value"] for r in x.read().orderBy("_rid").collect()) == "Abcdefghend" and repo.commit("l", v)["parent2"] == repo.head("l", "dev")
    x.splice(3, 1, ["1"])
    y.splice(3, 1, ["2"])
    assert code(x.merge, "dev") is Code.MERGE_CONFLICT


def test_map_edit(repo):
    m = MapObject(repo, "m")
    m.create({"a": "1", "b": "2"})
    before = len(repo.history("m", repo.head("m", "master")).collect())
    m.edit().set({"c": "3", "a": "0"}).delete("b").set({"a": "9"}).commit()
    assert got(m.read(), "k", "v") == [("a", "9"), ("c", "3")] and len(repo.history("m", repo.head("m", "master")).collect()) == before + 1
    assert m.get("a") == "9" and m.get("b") is None


def test_blob_in_parts(repo, tmp_path):
    b = BlobObject(repo, "b")
    want = bytearray(range(200))
    b.create(bytes(want), part_bytes=16)
    for pos, dels, data in ((0, 0, b"head"), (50, 40, b""), (7, 1000, b"tail")):
        pos = min(pos, len(want))
        b.splice(pos, dels, data, part_bytes=16)
        want[pos : pos + dels] = data
        assert b.get() == bytes(want) and b.size() == len(want)
    b.append(b"more")
    want += b"more"
    assert b.get() == bytes(want) and b.read_range(2, 5) == bytes(want[2:7]) and b.read_range(1000, 5) == b""
    assert code(b.splice, 1000, 0, b"x") is Code.INDEX_OUT_OF_RANGE
    (tmp_path / "f.bin").write_bytes(bytes(range(256)) * 10)
    b.put_file(f"file://{tmp_path}/f.bin", part_bytes=100)
    assert b.get() == bytes(range(256)) * 10 and b.save(f"file://{tmp_path}/out.bin") == 2560 and (tmp_path / "out.bin").read_bytes() == b.get()
    a = repo.manifest(repo.commit("b", repo.head("b", "master"))["data"])
    b.splice(1000, 1, b"!", part_bytes=100)
    c = repo.manifest(repo.commit("b", repo.head("b", "master"))["data"])
    assert len(set(s["path"] for s in c.segments.values()) - set(s["path"] for s in a.segments.values())) <= 2  # the parts cut, no others
    b.splice(1000, 1, bytes(range(256))[1000 % 256 :][:1], part_bytes=100)
    for _ in range(2):  # numbers between the neighbours run out
        b.splice(50, 0, b"-", part_bytes=100)
    assert b.get() == (bytes(range(50)) + b"-" * 2 + bytes(range(50, 256)) + bytes(range(256)) * 9)


def test_blob_numbers_run_out(repo, monkeypatch):
    from strata.plans import objects

    monkeypatch.setattr(objects, "STEP", 4)
    b = BlobObject(repo, "n")
    b.create(bytes(range(40)), part_bytes=10)
    want = bytes(range(40))
    for i in (5, 6, 7):
        b.splice(i, 0, b"abcdefgh", part_bytes=3)
        want = want[:i] + b"abcdefgh" + want[i:]
    assert b.get() == want


def test_blob_from_a_stream(repo):
    b = BlobObject(repo, "s")
    b.create(b"old")
    first = repo.head("s", "master")
    seen = []

    def parts():
        for x in (b"one ", b"two ", b"three"):
            seen.append(repo.head("s", "master"))  # the branch stays until the last part is there
            yield x

    v = b.put_stream(parts())
    assert b.get() == b"one two three" and set(seen) == {first} and repo.head("s", "master") == v
    chain = {r["version"]: r["distance"] for r in repo.history("s", v).collect()}
    assert chain[first] == 3 and len(chain) == 4


def test_tables_and_their_branches(repo, spark):
    t = repo.table("t")
    t.create(spark.createDataFrame([(0, "a")], "_rid long, v string"))
    dev = t.fork("dev")
    dev.put_column("w", spark.createDataFrame([(0, "x")], "_rid long, w string"))
    assert t.branches() == ["dev", "master"] and t.column_branches("w") == ["dev"] and t.exists_column("w") and not t.exists_column("w", "master")
    dev.drop()
    assert t.branches() == ["master"] and t.exists("master") and not t.exists("dev") and code(dev.drop) is Code.BRANCH_NOT_EXISTS
    assert t.drop_all() == 1 and not t.exists() and repo.exists("t") and t.drop_all() == 0


def test_datasets_and_entries(repo, spark):
    f = lambda *r: spark.createDataFrame(list(r), "entry string, payload string")
    ds = repo.dataset("ds")
    ds.create(), repo.dataset("Other").create()
    ds.put(f(("a", "1"), ("b", "2")))
    first = ds.get_entry("a")
    dev = ds.fork("dev")
    dev.put(f(("a", "3")))
    assert dev.get_entry("a")["parent"] == first["version"] and first["parent"] is None and ds.get_entry("a")["payload"] == "1"
    dev.delete("b", "nope")
    assert ds.entry_branches("b") == ["master"] and ds.exists_entry("b") and not ds.exists_entry("b", "dev") and not ds.exists_entry("zz")
    assert [r["payload"] for r in ds.select(["b", "a", "b"]).collect()] == ["2", "1", "2"]
    assert code(ds.select, ["b", "zz"]) is Code.ENTRY_NOT_EXISTS and code(ds.get_entry, "zz") is Code.ENTRY_NOT_EXISTS
    assert got(ds.list_entries(), "entry") == [("a",), ("b",)]
    assert VersionedDataset.names(repo) == ["Other", "ds"]
    dev.drop()
    assert VersionedDataset.names(repo) == ["Other", "ds"] and not ds.exists("dev")
    ds.drop()
    assert VersionedDataset.names(repo) == ["Other"] and not ds.exists() and code(ds.drop) is Code.BRANCH_NOT_EXISTS


def test_stored_index(repo, spark, tmp_path):
    (tmp_path / "a.csv").write_text("KEY,NAME,NOTE\nk1,Grün blau,x\nk2,rot,GRÜN\nk3,дом,x y\n")
    ds = repo.dataset("ds")
    ds.create()
    ds.load_csv(f"file://{tmp_path}/a.csv", [0], indexed=True)
    find = lambda q: [r[0] for r in got(ds.search(q), "entry")]
    assert find("grün") == ["k1", "k2"] and find("дом") == ["k3"] and ds.name_indices() == [0]
    at = repo.head("ds::index", "master")
    assert find("x") == ["k1", "k3"] and repo.head("ds::index", "master") == at  # not built again
    ds.put(spark.createDataFrame([("k2", "k2,rot,nichts"), ("k4", "k4,grün,x")], "entry string, payload string"))
    ds.delete("k3")
    assert find("grün") == ["k1", "k4"] and find("дом") == [] and repo.head("ds::index", "master") != at
    best = [r["entry"] for r in ds.search_scored("grün OR blau").collect()]
    assert best == ["k1", "k4"] and got(ds.select_by_query("blau"), "entry") == [("k1",)]


def test_object_meta(repo):
    repo.set_meta("o", "master", {"a": "1", "b": "2"})
    repo.branch_meta("o", "master", "dev")
    assert repo.meta("o", "dev") == {"a": "1", "b": "2"} and code(repo.branch_meta, "o", "master", "dev") is Code.BRANCH_EXISTS
    repo.delete_meta("o", "dev", "a", "nope")
    assert repo.meta("o", "dev") == {"b": "2"}
    repo.delete_meta("o", "dev")
    assert not repo.exists_meta("o", "dev") and repo.exists_meta("o", "master")


def test_script_of_tables_and_datasets(repo, tmp_path):
    (tmp_path / "t.csv").write_text("id|name\n1|a\n2|b\n")
    s = Script(repo)
    out = s.run(f"""
load-csv t file://{tmp_path}/t.csv
branch-table t dev
update-row t id 2 name=B -b dev
-F get-row t id 9
exists-column t name
list-table-branch t
create-dataset d
put-entry d e1 hello
get-entry d e1
-F get-entry d e2
list-dataset
delete-dataset d
list-dataset
put inner::x 1
is-latest t @1
""")
    assert out[4:6] == [True, ["dev", "master"]] and out[8] == "hello" and out[10] == ["d"] and out[12] == []
    log = [(r["op"], r["key"], r["branch"]) for r in repo.access_log().collect()]
    assert ("update-row", "t", "dev") in log and all("::" not in r[1] for r in log) and ("get-entry", "d", "master") in log
