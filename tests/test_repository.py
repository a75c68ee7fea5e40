import pytest
from pyspark.sql import functions as F

from strata.errors import Code, StrataError
from strata.plans.repository import Repository
from strata.sources import csv, files, generate
from strata.streaming.commits import commit_stream
from tests.conftest import rows as got


@pytest.fixture
def repo(spark, tmp_path):
    return Repository(spark, f"file://{tmp_path}/repo")


def code(f, *a, **k):
    with pytest.raises(StrataError) as e:
        f(*a, **k)
    return e.value.code


def test_branches_and_versions(repo):
    v0 = repo.put("k", "v0")
    v1 = repo.put("k", "v1")
    v2 = repo.put("k", "v2", "First")
    assert repo.list_branches("k") == ["First", "master"] and repo.head("k", "First") == v2
    assert repo.is_head("k", "master", v1) and not repo.is_head("k", "master", v0)
    repo.branch("k", "Second", old="master")
    assert repo.head("k", "Second") == v1 and repo.latest("k") == sorted([v1, v2])
    repo.rename_branch("k", "master", "Third")
    assert not repo.exists("k", "master") and repo.head("k", "Third") == v1
    v3 = repo.merge("k", "Third", "v3", ref="First")
    assert repo.head("k", "Third") == v3 and repo.head("k", "First") == v2 and repo.latest("k") == [v3]
    v4 = repo.merge("k", "First", "v4", ref_version=v1)
    assert repo.latest("k") == sorted([v3, v4])
    repo.delete_branch("k", "Third")
    assert repo.exists("k") and repo.get("k", version=v3) == "v3"
    assert {r["version"] for r in repo.history("k", v3).collect()} == {v0, v1, v2, v3}
    assert code(repo.branch, "k", "Second", old="First") is Code.BRANCH_EXISTS
    assert code(repo.get, "k", "nope") is Code.BRANCH_NOT_EXISTS and code(repo.get, "nope") is Code.KEY_NOT_EXISTS
    repo.put("other", "x")
    assert code(repo.get, "other", version=v0) is Code.INCONSISTENT_KEY
    assert code(repo.put, "k", "x", parent="A" * 31 + "B") is Code.REFERRING_VERSION_NOT_EXISTS
    assert repo.list_keys() == ["k", "other"]


def test_unnamed_branches(repo):
    v5 = repo.put("u", "5", parent="A" * 32)
    v6 = repo.put("u", "6", parent=v5)
    v7 = repo.put("u", "7", parent=v5)
    v8 = repo.put("u", "8", parent=v7)
    assert repo.latest("u") == sorted([v6, v8]) and repo.list_branches("u") == []


def test_table(repo, spark, tmp_path):
    (tmp_path / "t.csv").write_text("id|name\n1|a\n2|b\n\n3|b\n4\n")
    t = repo.table("t")
    t.load_csv(f"file://{tmp_path}/t.csv")
    assert t.schema() == {"id", "name"} and t.size() == 4 and got(t.read().where("id = '4'"), "name") == [("",)]
    assert code(t.load_csv, f"file://{tmp_path}/t.csv") is Code.NOT_EMPTY_TABLE
    dev = t.fork("dev")
    dev.update({"name": "B"}, where=("name", "b"))
    assert [r[1] for r in got(t.diff("dev"), "_rid", "rhs_name")] == ["B", "B"]
    assert got(t.diff("master")) == []
    dev.put_column("n", spark.createDataFrame([(0, "x")], "_rid long, n string"))
    v = t.merge_column("dev", "n")
    assert repo.commit("t", v)["parent2"] == repo.head("t", "dev") and "n" in t.schema()
    assert got(t.read().where("_rid = 1"), "name") == [("b",)]
    dev.insert({"id": "9", "name": "z", "n": "q"})
    assert code(dev.insert, {"id": "9", "name": "z", "n": "q"}, distinct="id") is Code.ROW_EXISTS
    dev.delete(rid=0)
    assert dev.rows("id", "9").first()["_rid"] == 3
    t.dump_csv(f"file://{tmp_path}/out")
    assert spark.read.text(f"file://{tmp_path}/out").count() == 2  # the header and one row: n has one cell
    t.view("seen")
    assert spark.sql("SELECT count(*) FROM seen").first()[0] == 4


def test_equal_contents_are_stored_once(repo, spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(20)], "_rid long, v string")
    a = repo.commit("a", repo.put("a", df, keys=["_rid"]))
    b = repo.commit("b", repo.put("b", df.repartition(3), keys=["_rid"]))
    assert a["data"] == b["data"] and a["version"] != b["version"]


def test_automatic_merge(repo, spark):
    f = lambda *r: spark.createDataFrame(list(r), "k string, v string")
    repo.put("m", f(("a", "1"), ("b", "2")), keys=["k"])
    repo.branch("m", "dev", old="master")
    repo.put("m", f(("a", "1"), ("b", "3")), "dev", keys=["k"])
    repo.put("m", f(("a", "9"), ("b", "2")), keys=["k"])
    repo.merge("m", "master", ref="dev", keys=["k"])
    assert got(repo.get("m")) == [("a", "9"), ("b", "3")]
    repo.put("m", f(("a", "7"), ("b", "3")), "dev", keys=["k"])
    assert code(repo.merge, "m", "master", ref="dev", keys=["k"]) is Code.MERGE_CONFLICT


INIT = "KID,CA,CB,C C\nk1,aa,ab,ac\nk2,ba,bb,aa\nk3,ca,cb,cc\n"
DELTA = "KID, CA,CB, C  C\nk4,aa,ab,ac\nk5,ba,bb,bc\nk6,ca,cb,ba\n"
JOIN = "KID, JA, JB, J C\nk1,aa,ja,j1\nk2,ba,jb,j2\nk3,ca,jc,j3\nk4,aa,jd,j4\nk5,ba,je,j5\nk6,ca,jf,j6\n"


def test_search_and_join(repo, tmp_path):
    for n, s in (("init", INIT), ("delta", DELTA), ("join", JOIN)):
        (tmp_path / f"{n}.csv").write_text(s)
    ds, other = repo.dataset("ds"), repo.dataset("join")
    ds.create(), other.create()
    for n in ("init", "delta"):
        assert ds.load_csv(f"file://{tmp_path}/{n}.csv", [0], indexed=True) == 3
    other.load_csv(f"file://{tmp_path}/join.csv", [0], indexed=True)
    assert ds.schema() == "KID,CA,CB,C_C"
    find = lambda q: [r[0] for r in got(ds.search(q))]
    assert find("aa") == ["k1", "k2", "k4"] and find("aa AND ac") == ["k1", "k4"]
    assert find("bb OR cc") == ["k2", "k3", "k5"] and find("C_C : aa") == ["k2"] and find("zz") == []
    assert [sorted(r["entry"] for r in d.collect()) for d in ds.query_join("aa", ds, other)] == [["k1", "k2", "k4"]] * 2
    dev = ds.fork("dev")
    dev.put(repo.spark.createDataFrame([("k1", "changed"), ("k9", "new")], "entry string, payload string"))
    dev.delete("k2", "nope")
    assert [r[0] for r in got(ds.diff(dev))] == ["k1", "k2", "k9"]
    assert ds.export(f"file://{tmp_path}/x") == {"n_entries": 6, "n_bytes": 6 * 12}


def test_header_of_one_column():
    assert csv.infer_header("id") == (["id"], ",") and csv.infer_header("a\tb") == (["a", "b"], "\t")


def test_directory(spark, tmp_path):
    (tmp_path / "d/sub").mkdir(parents=True)
    (tmp_path / "d/a.bin").write_bytes(b"\x00\x01")
    (tmp_path / "d/sub/b.txt").write_bytes(b"")
    ds = files.read_directory(spark, f"file://{tmp_path}/d")
    assert [r[0] for r in got(ds, "entry")] == ["a.bin", "sub/b.txt"]
    files.write_directory(ds, f"file://{tmp_path}/e")
    assert (tmp_path / "e/a.bin").read_bytes() == b"\x00\x01" and (tmp_path / "e/sub/b.txt").exists()
    assert [bytes(r["chunk"]) for r in files.chunk_scan(ds.where("entry = 'a.bin'"), "payload", 1, "entry").orderBy("chunk_no").collect()] == [b"\x00", b"\x01"]


def test_generators(spark):
    t = generate.update_table(spark, 100, 5)
    assert t.count() == 100 and t.select("UpdateBy").distinct().count() == 5
    assert t.where("length(ID) <> 12 OR length(UpdateOn) <> 128 OR int(AggregateBy) NOT BETWEEN 1 AND 20").isEmpty()
    assert got(generate.analytics_table(spark, 2, 1)) == [(0, "K_0", "0_0"), (1, "K_1", "0_1")]
    keys = t.select(F.col("_rid").alias("pos"), F.col("UpdateBy").alias("key"))
    assert generate.sample_keys(keys, 7).count() == 7


def test_stream(repo, spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("a", 1), ("b", 2)], "k string, n long").write.parquet(src)
    run = lambda: commit_stream(spark.readStream.schema("k string, n long").parquet(src), repo, "s", f"{tmp_path}/cp", keys=["k"]).awaitTermination()
    run()
    spark.createDataFrame([("a", 5)], "k string, n long").write.mode("append").parquet(src)
    run()
    assert got(repo.get("s")) == [("a", 5), ("b", 2)] and len(repo.history("s", repo.head("s", "master")).collect()) == 2
