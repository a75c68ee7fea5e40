import pytest

from strata.errors import Code, StrataError
from strata.plans.objects import BlobObject, ListObject, MapObject, SetObject
from strata.plans.repository import Repository
from strata.plans.script import Script


@pytest.fixture
def repo(spark, tmp_path):
    return Repository(spark, f"file://{tmp_path}/repo")


def fails(code, f, *a, **k):
    with pytest.raises(StrataError) as e:
        f(*a, **k)
    assert e.value.code is code


def values(x):
    return [r["value"] for r in x.read().orderBy("_rid").collect()]


def test_list_trace(repo):
    x = ListObject(repo, "l")
    x.create("1 2 3 4 5".split())
    x.append(["5", "6"])
    x.update(2, "three")
    x.insert(1, ["two", "two", "3"])
    x.delete(2)
    x.delete(2, 2)
    assert values(x) == "1 two three 4 5 5 6".split() and x.get(1) == "two" and x.get(99) is None
    fails(Code.ELEMENT_EXISTS, x.append, ["7", "7"], distinct=True)
    fails(Code.ELEMENT_EXISTS, x.insert, 0, ["4"], distinct=True)
    fails(Code.INDEX_OUT_OF_RANGE, x.delete, 7)


def test_map_trace(repo):
    x = MapObject(repo, "m")
    x.create(dict(a="1", b="2", c="3", d="4", e="5"))
    x.update({"b": "two"})
    x.insert({"f": "6"})
    x.delete("d")
    assert {r["k"]: r["v"] for r in x.read().collect()} == dict(a="1", b="two", c="3", e="5", f="6")
    fails(Code.MAP_KEY_NOT_EXISTS, x.update, {"z": "1"})
    fails(Code.MAP_KEY_EXISTS, x.insert, {"f": "6"})
    fails(Code.MAP_KEY_NOT_EXISTS, x.delete, "G")


def test_set_and_blob_traces(repo):
    x = SetObject(repo, "s")
    x.create(["b1", "aaa", "aaa"])
    x.insert("insert example")
    x.delete("aaa")
    assert sorted(r["elem"] for r in x.read().collect()) == ["b1", "insert example"]
    fails(Code.MAP_KEY_EXISTS, x.insert, "b1")
    fails(Code.MAP_KEY_NOT_EXISTS, x.delete, "ccc")
    b = BlobObject(repo, "b")
    b.create(b"Hello")
    b.append(b", world!")
    b.splice(7, 10, b"girl~")
    assert b.get() == b"Hello, girl~" and b.read_range(7, 4) == b"girl"


def test_script(repo):
    s = Script(repo)
    out = s.run("""
        put k "first value"   # a comment
        branch k master dev
        -F branch k nope x
        -F branch k master dev
        put k second -b dev
        get k @2
        merge k master dev merged
        list-branches k
        exit
        nonsense
    """)
    assert out[5] == "first value" and out[2] is Code.BRANCH_NOT_EXISTS and out[-1] == ["dev", "master"]
    fails(Code.KEY_NOT_EXISTS, s.run, "get none")
