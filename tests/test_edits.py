"""Entries edited bucket by bucket: the contents are those of joins over the whole dataset, and the dataset isn't dealt anew."""

import pytest

from strata.errors import StrataError
from strata.plans.repository import Repository


def _stages(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30000)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    none = gateway.jvm.java.util.ArrayList()
    found = store.stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
    return {found.apply(i).stageId(): found.apply(i).shuffleWriteBytes() for i in range(found.size())}


def _shuffled(spark, run):
    last = max(_stages(spark), default=-1)
    run()
    return sum(b for k, b in _stages(spark).items() if k > last)


def _entries(spark, start, end, text="p"):
    return spark.range(start, end).selectExpr("concat('e', id) AS entry", f"concat('{text}', sha2(cast(id AS string), 512)) AS payload")


@pytest.fixture(scope="module")
def repo(spark, tmp_path_factory):
    r = Repository(spark, str(tmp_path_factory.mktemp("edits")))
    ds = r.dataset("d")
    ds.create()
    ds.put(_entries(spark, 0, 20000))
    return r


def test_select_reads_the_segments_of_its_names(spark, repo):
    ds = repo.dataset("d")
    found = ds.select(["e7", "e12345", "e7"])
    assert [(r["pos"], r["entry"]) for r in found.collect()] == [(0, "e7"), (1, "e12345"), (2, "e7")]
    assert 0 < len(found.inputFiles()) < len(ds.read().inputFiles())
    assert ds.select([]).count() == 0 and ds.select(["zz"], check=False).count() == 0
    with pytest.raises(StrataError):
        ds.select(["zz"])


def test_put_shuffles_its_entries_alone(spark, repo):
    ds = repo.dataset("d").fork("few")
    size = sum(s["bytes"] for s in repo.manifest(repo.commit("d", repo.head("d", "few"))["data"]).segments.values())
    assert _shuffled(spark, lambda: ds.put(_entries(spark, 0, 100, "q"))) < size // 10
    assert ds.read().count() == 20000 and ds.read().where("parent IS NOT NULL").count() == 100


def test_remove_shuffles_its_names_alone(spark, repo):
    ds = repo.dataset("d").fork("less")
    size = sum(s["bytes"] for s in repo.manifest(repo.commit("d", repo.head("d", "less"))["data"]).segments.values())
    assert _shuffled(spark, lambda: ds.remove(_entries(spark, 0, 100).select("entry"))) < size // 10
    assert sorted(r["lhs_payload"] for r in repo.diff("d", "master", "less").collect()) == sorted(r["payload"] for r in _entries(spark, 0, 100).collect())


def test_edits_are_those_of_joins(spark, tmp_path, monkeypatch):
    def build(name, joins):
        with monkeypatch.context() as m:
            if joins:
                m.setattr(Repository, "_edit_entries", lambda *a, **b: None)
            r = Repository(spark, str(tmp_path / name))
            ds, data = r.dataset("d"), []
            ds.create()
            odd = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", None), (None, "n"), ("", ""), ("é", "x" * 5000)], "entry string, payload string")
            put = lambda rows: ds.put(rows)
            for step in (
                lambda: put(odd),
                lambda: put(odd),
                lambda: put(_entries(spark, 0, 1500).union(_entries(spark, 700, 800, "q"))),
                lambda: ds.delete("a", "nope", "a"),
                lambda: put(_entries(spark, 100, 400, "r")),
                lambda: ds.remove(_entries(spark, 0, 1600).select("entry")),
                lambda: ds.delete("b", "", "é"),
            ):
                step()
                data.append(r.commit("d", r.head("d", "master"))["data"])
            return data, sorted((tuple(x) for x in ds.read().select("entry", "payload", "hash", "version", "parent").collect()), key=repr)

    assert build("buckets", False) == build("joins", True)


def test_branches_of_an_entry_after_edits(spark, repo):
    ds = repo.dataset("d").fork("other")
    size = sum(s["bytes"] for s in repo.manifest(repo.commit("d", repo.head("d", "other"))["data"]).segments.values())
    assert _shuffled(spark, lambda: ds.delete("e5")) < size // 10
    assert "other" not in ds.entry_branches("e5") and {"master", "other"} <= set(ds.entry_branches("e6"))
