"""Tables under several writers, step by step."""

import json
import threading

import pytest

from clauselake.sources import store

SCHEMA = "doc string, n int"


@pytest.fixture
def table(spark, tmp_path):
    return lambda: store.Table(spark, f"file://{tmp_path}/t", SCHEMA, buckets=8)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def frame(spark, *data):
    return spark.createDataFrame(list(data), SCHEMA)


@pytest.mark.parametrize("step", ["version", "_placed", "_written", "_commit"])
@pytest.mark.parametrize("doc", ["same", "other"])
def test_a_writer_between_any_two_steps_loses_nothing(spark, table, monkeypatch, step, doc):
    """Another writer comes just before each step of a replacement, on the same document or another."""
    table().replace(frame(spark, ("a", 1), ("same", 1), ("other", 1)), "doc")
    ours, done = table(), []
    plain = getattr(ours, step)

    def interrupted(*args):
        if not done:
            done.append(1)
            table().replace(frame(spark, (doc, 2), ("theirs", 2)), "doc")
        return plain(*args)

    monkeypatch.setattr(ours, step, interrupted)
    ours.replace(frame(spark, ("same", 3), ("ours", 3)), "doc")
    assert done and rows(table().read()) == sorted([("a", 1), ("same", 3), ("other", 2 if doc == "other" else 1), ("theirs", 2), ("ours", 3)])


def test_writers_at_once(spark, table):
    """Each adds its own document and all change one."""

    def work(k):
        table().replace(frame(spark, (f"d{k}", k), ("all", k)), "doc")

    threads = [threading.Thread(target=work, args=(k,)) for k in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    found = rows(table().read())
    assert [r for r in found if r[0] != "all"] == [(f"d{k}", k) for k in range(5)]
    assert len([r for r in found if r[0] == "all"]) == 1 and table().version() == 5


def test_a_document_rewrites_its_bucket_only(spark, table, tmp_path):
    table().replace(frame(spark, *((f"d{k}", k) for k in range(100))), "doc")
    before = table()._placed(table().version())
    table().replace(frame(spark, ("d7", 700)), "doc")
    after = table()._placed(table().version())
    assert len([k for k in after if after[k] != before[k]]) == 1
    assert rows(table().read()) == sorted((f"d{k}", 700 if k == 7 else k) for k in range(100))
    assert rows(table().read(1)) == sorted((f"d{k}", k) for k in range(100))


def test_whole_tables_and_conflicts(spark, table):
    one = table()
    one.write(frame(spark, ("a", 1)))
    seen = one.version()
    table().replace(frame(spark, ("b", 2)), "doc")
    with pytest.raises(store.Conflict):
        one.write(frame(spark, ("c", 3)), seen)
    assert rows(one.read()) == [("a", 1), ("b", 2)]
    one.write(frame(spark, ("c", 3)), one.version())
    assert rows(one.read()) == [("c", 3)]
    with pytest.raises(ValueError):
        one.replace(frame(spark), "n")


def test_first_writers_of_an_empty_table(spark, table):
    """A version made from an empty table is no less checked."""
    one = table()
    table().write(frame(spark, ("b", 2)))
    with pytest.raises(store.Conflict):
        one.write(frame(spark, ("a", 1)), 0)


def test_nulls_empty_changes_and_a_dead_writer(spark, table, monkeypatch):
    t = table()
    t.replace(frame(spark), "doc")
    assert t.version() == 0 and t.read().count() == 0
    t.replace(frame(spark, (None, 1), ("a", 1)), "doc")
    t.replace(frame(spark, (None, 2)), "doc")  # rows without a key are nobody's
    assert rows(t.read().where("doc is null")) == [(None, 1), (None, 2)]
    t._fs.create(t._path(f"{t.folder}/log/{t.version() + 1:020d}.claim"), False).close()
    monkeypatch.setattr(store, "PATIENCE", 2)
    t.replace(frame(spark, ("a", 5)), "doc")
    assert rows(t.read().where("doc is not null")) == [("a", 5)]


def test_clean_keeps_what_versions_name(spark, table, tmp_path):
    t = table()
    for k in range(6):
        t.replace(frame(spark, ("a", k), (f"d{k}", k)), "doc")
    t._written(frame(spark, ("lost", 1)))  # a writer that failed before its version
    assert t.clean(keep=2) > 0
    assert rows(t.read()) == sorted([("a", 5), *((f"d{k}", k) for k in range(6))]) and rows(t.read(t.version() - 1))[0] == ("a", 4)
    names = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert names == {p.split("/")[1] for v in (5, 6) for found in t._placed(v).values() for p in found}
    assert json.dumps(t._placed(6))


def test_append_and_compact(spark, table):
    t = table()
    for k in range(12):
        t.append(frame(spark, (f"d{k % 3}", k)))
    t.append(frame(spark))
    want = sorted((f"d{k % 3}", k) for k in range(12))
    assert rows(t.read()) == want and max(map(len, t._placed(t.version()).values())) >= 4
    t.compact(most=3)
    assert rows(t.read()) == want and max(map(len, t._placed(t.version()).values())) == 1
    t.replace(frame(spark, ("d1", 100)), "doc")
    assert rows(t.read()) == sorted([r for r in want if r[0] != "d1"] + [("d1", 100)])
