"""The commit log, and what builds, catalogs and versions do when two write at once or one dies."""

import threading

import pytest
from pyspark.sql import functions as F

from lodestone.operators import catalog
from lodestone.operators import index as ix
from lodestone.plans import search as plans
from lodestone.sources import writers
from lodestone.sources.commit_log import CommitLog, Taken, claimed, next_number


def at_once(n, run):
    """run(k) in n threads that start together; what they gave, or raised."""
    gate, out = threading.Barrier(n), [None] * n

    def one(k):
        gate.wait()
        try:
            out[k] = run(k)
        except Exception as e:
            out[k] = e

    threads = [threading.Thread(target=one, args=(k,)) for k in range(n)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return out


def docs_of(spark, *texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_a_file_is_claimed_once(spark, tmp_path):
    got = at_once(8, lambda k: claimed(spark, f"{tmp_path}/a/one", str(k)))
    assert sorted(got) == [False] * 7 + [True]
    assert (tmp_path / "a" / "one").read_text() == str(got.index(True))
    assert [p.name for p in (tmp_path / "a").iterdir()] == ["one"]
    assert sorted(at_once(8, lambda k: next_number(spark, f"{tmp_path}/n"))) == list(range(1, 9))


def test_commits_of_many_writers_all_count(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.state() is None and log.versions() == []

    def one(k):
        return CommitLog(spark, str(tmp_path)).commit(lambda s: {**s, "tables": {**s["tables"], f"t{k}": f"f/{k}"}, "batches": [*s["batches"], str(k)]})

    assert sorted(at_once(6, one)) == [1, 2, 3, 4, 5, 6]
    assert sorted(log.state()["batches"]) == [str(k) for k in range(6)] and len(log.state()["tables"]) == 6
    assert len(log.state(2)["batches"]) == 2 and log.restore(1) == 7 and len(log.state()["tables"]) == 1
    with pytest.raises(ValueError, match="version"):
        log.state(99)
    with pytest.raises(ValueError, match="table"):
        log.table("none")


def test_two_writers_get_different_snapshots_and_versions(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path / "c"))
    assert sorted(at_once(3, lambda k: c.create_snapshot(float(k)))) == [1, 2, 3]
    assert c.table("snapshots").select("snapshot_id").distinct().count() == 3 and c.create_snapshot(9.0) == 4
    v = catalog.Versions(spark, str(tmp_path / "v"))
    made = at_once(3, lambda k: v.create(docs=spark.range(k + 1).withColumnRenamed("id", "doc_id")))
    assert sorted(made) == [1, 2, 3] == v.list()
    assert [v.read("docs", n).count() for n in made] == [1, 2, 3]
    assert v._manifest().select("seq").distinct().count() == 3


def test_a_transaction_ends_once(spark, tmp_path):
    c = catalog.Catalog(spark, str(tmp_path))
    slow = c.begin("b", 1.0)
    assert c.recover(2.0, idle=60.0) == [] and not c.pending().isEmpty()  # it may still be at work
    assert c.recover(100.0, idle=60.0) == [] and c.pending().isEmpty()
    with pytest.raises(Taken):
        c.commit(slow, "b", 1, [("f", 1)], 101.0)
    assert c.should_write("b") and c.table("files").isEmpty()
    done = c.begin("b", 2.0)
    c.commit(done, "b", 1, [("f", 1)], 3.0)
    with pytest.raises(Taken):
        c.rollback(done, "b", 4.0)
    left = catalog.deactivate(c.table("files"), 1, "f")
    assert catalog.active_files(left).isEmpty() and catalog.active_files(c.table("files")).count() == 1


def test_a_killed_build_leaves_the_index_readable(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "index")
    assert writers.build_index(spark, docs_of(spark, "red fish", "blue whale"), root, now=1.0, batch_id="a", dim=8)
    before = plans.Index.load(spark, root)

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ix, "doc_lengths", dies)
        with pytest.raises(RuntimeError):
            writers.build_index(spark, docs_of(spark, "green bird"), root, now=2.0, batch_id="b", dim=8)
    for index in (before, plans.Index.load(spark, root)):
        assert ids(index.documents) == ["0_0", "1_0"] and index.stats.first().total_docs == 2
        assert ids(plans.search(index, "whale", 3)) == ["1_0"]
    assert CommitLog(spark, root).versions() == [1]
    assert writers.build_index(spark, docs_of(spark, "green bird"), root, now=3.0, batch_id="b", dim=8)
    assert ids(plans.Index.load(spark, root).documents) == ["0_0"] and ids(before.documents) == ["0_0", "1_0"]
    assert ids(plans.Index.load(spark, root, version=1).documents) == ["0_0", "1_0"]
    log = CommitLog(spark, root)
    assert len(log.vacuum("builds", keep=1, older_than=-10.0, now=4e9)) == 2  # the first build, and the one that died
    assert ids(plans.Index.load(spark, root).documents) == ["0_0"]


def test_two_builds_of_one_batch(spark, tmp_path):
    root = str(tmp_path / "index")
    got = at_once(2, lambda k: writers.build_index(spark, docs_of(spark, f"text {k}"), root, now=1.0, batch_id="same", dim=4))
    assert sorted(got) == [False, True]
    assert CommitLog(spark, root).versions() == [1] and catalog.Catalog(spark, f"{root}/catalog").pending().isEmpty()
    assert not writers.build_index(spark, docs_of(spark, "again"), root, now=2.0, batch_id="same", dim=4)


def test_codes_alone_are_built_and_searched(spark, tmp_path):
    from lodestone.operators.vector_store import StoredIvfPq

    root = str(tmp_path / "index")
    texts = [f"word{k} word{k % 5} common text" for k in range(40)]
    assert writers.build_index(spark, docs_of(spark, *texts), root, now=1.0, dim=16, pq_only=True)
    tables = CommitLog(spark, root).state()["tables"]
    assert "embeddings" not in tables and "ivf_pq" in tables
    index = StoredIvfPq.load(spark, CommitLog(spark, root).table("ivf_pq"))
    assert index.decoded(index.table().where("cell = home")).count() == 40
    query = index.decoded(index.table().where("cell = home and doc_id = '7_0'")).select(F.lit(0).alias("qid"), "embedding")
    assert "7_0" in ids(index.search(query, 5, nprobe=16))


def test_compact_makes_one_table_of_few_parts(spark, tmp_path):
    paths = []
    for k in range(8):
        paths.append(f"{tmp_path}/f{k}")
        spark.range(k * 10, k * 10 + 10).write.parquet(paths[-1])
    catalog.compact(spark, paths, f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r.id for r in out.collect()) == list(range(80)) and len(out.inputFiles()) <= 2
