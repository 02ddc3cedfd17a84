import bz2
import json
import threading

import pytest

from termloom import metrics as M
from termloom.config import Config, parameter
from termloom.index.store import Conflict, Index, IndexError_
from termloom.index.tables import Files
from termloom.operators.search import Searcher
from termloom.plans.clauses import And, Or, Term
from termloom.sources.files import text_files, wiki_dump
from termloom.streaming.ingest import ingest

CLAUSE = And(Term("the"), Or(Term("of"), Term("lytion")))


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang").cache()


def test_stored_is_in_memory_at_every_step(spark, docs, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"))
    assert index.search(CLAUSE).count() == 0 and index.statistics()["docs"] == 0
    index.add(docs.filter("doc_id < 120"))
    old = Index.open(spark, str(tmp_path / "i"), read_only=True)
    index.add(docs.filter("doc_id >= 120"))
    want = Searcher.of(docs).search(CLAUSE).collect()
    assert len(want) == 10 and index.search(CLAUSE).collect() == want
    assert old.search(CLAUSE).collect() == Searcher.of(docs.filter("doc_id < 120")).search(CLAUSE).collect()  # its own state
    gone = docs.filter("lang = 'de'").select("doc_id")
    assert index.remove(gone) == gone.count() and index.remove(gone) == 0
    rest = Searcher.of(docs.filter("lang <> 'de'"))
    assert index.search(CLAUSE).collect() == rest.search(CLAUSE).collect()
    index.compact()
    assert index.search(CLAUSE).collect() == rest.search(CLAUSE).collect()
    assert index.statistics()["generations"] == 1 and index.statistics()["deleted"] == 0 and index.tombstones() is None
    assert index.blocks(64).filter("deleted > 0").count() == 0
    assert old.search(CLAUSE).count() > 0
    assert index.vacuum() and Index.open(spark, str(tmp_path / "i")).search(CLAUSE).collect() == rest.search(CLAUSE).collect()


def test_documents(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"), analyzer="english", measure="bm_like", stop_words=["foo"])
    index.add(spark.createDataFrame([("x", "Foo dogs dog"), ("y", ""), ("z", None)], "ext_id string, text string"))
    ids = {r.ext_id: r.doc_id for r in index.documents().collect()}
    assert len(set(ids.values())) == 3 and min(ids.values()) >= 1
    again = Index.open(spark, str(tmp_path / "i"))
    row = again.get_document(ids["x"]).first()
    assert (row.ext_id, row.doc_len, [(t.term, t.tf, t.doc_len) for t in row.terms]) == ("x", 2, [("dog", 2, 2)])
    assert again.get_document(ids["y"]).first().terms == []
    index.add(spark.createDataFrame([("w", "dogs")], "ext_id string, text string"))
    assert len({r.doc_id for r in index.documents().collect()}) == 4
    index.remove([ids["x"]])
    assert index.get_document(ids["x"]).count() == 0 and index.get_document(ids["x"], include_deleted=True).count() == 1
    with pytest.raises(IndexError_):
        index.remove([10**15], strict=True)
    assert index.remove([10**15]) == 0


def test_modes(spark, tmp_path):
    root = str(tmp_path / "i")
    with pytest.raises(IndexError_):
        Index.open(spark, root)
    Index.open(spark, root, create=True)
    with pytest.raises(IndexError_):
        Index.create(spark, root)
    for how in ({"analyzer": "english"}, {"measure": "bm_like"}):
        with pytest.raises(IndexError_):
            Index.open(spark, root, **how)
    one, two = Index.open(spark, root, analyzer="simple"), Index.open(spark, root)
    rows = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    one.add(rows)
    with pytest.raises(Conflict):
        two.add(rows)
    reader = Index.open(spark, root, read_only=True)
    for act in (lambda: reader.add(rows), lambda: reader.remove([1]), reader.compact, reader.vacuum):
        with pytest.raises(IndexError_):
            act()
    assert Index.create(spark, root, overwrite=True).statistics()["docs"] == 0


def test_a_term_is_pushed_into_the_scan(spark, docs, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"))
    index.add(docs)
    plan = index.postings().filter("term = 'the'").select("doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,the)" in plan and "ReadSchema: struct<term:string,doc_id:bigint>" in plan


def test_streamed_is_bulk(spark, docs, tmp_path):
    source = str(tmp_path / "in")
    docs.repartition(3).write.parquet(source)
    how = {"maxFilesPerTrigger": 1}
    for _ in range(2):  # the second run has nothing to do
        stream = spark.readStream.options(**how).schema(docs.schema).parquet(source)
        ingest(stream, str(tmp_path / "i"), str(tmp_path / "c"), interval=None).awaitTermination()
    index = Index.open(spark, str(tmp_path / "i"))
    assert index.statistics()["docs"] == docs.count() and index.statistics()["generations"] == 3
    assert index.search(CLAUSE).collect() == Searcher.of(docs).search(CLAUSE).collect()
    (stream,) = index.manifest.streams
    assert index.manifest.streams == {stream: 2} and index.add(docs, batch=(stream, 1)) is False


def test_text_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes("naïve café".encode("windows-1252"))
    (tmp_path / "sub" / "b.txt").write_bytes(b"plain")
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "bad").write_bytes(b"\x81\x8d")
    assert {r.ext_id: r.text for r in text_files(spark, str(tmp_path)).collect()} == {"a.txt": "naïve café", "b.txt": "plain"}


def test_wiki_dump(spark, tmp_path):
    page = lambda t, x: f'<page><title>{t}</title><revision><text xml:space="preserve">{x}</text></revision></page>'
    xml = "<mediawiki>" + page("A", "long " * 30) + page("B", "short") + page("C", "#REDIRECT [[" + "x" * 200 + "]]") + "</mediawiki>"
    (tmp_path / "dump.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert [r.ext_id for r in wiki_dump(spark, str(tmp_path / "dump.xml.bz2")).collect()] == ["A"]


def ids(index, word):
    return [r.doc_id for r in index.search(Term(word), 100).orderBy("doc_id").collect()]


def rows(spark, *own):
    return spark.createDataFrame(list(own), "doc_id bigint, text string")


def test_ids(spark, tmp_path):
    """An id is replaced, removed, and comes back; one that is null or comes twice is refused whole."""
    index = Index.create(spark, str(tmp_path / "i"))
    index.add(rows(spark, (1, "old words"), (2, "other words")))
    index.add(rows(spark, (1, "new words"), (3, "third")))
    assert (ids(index, "words"), ids(index, "old"), ids(index, "new")) == ([1, 2], [], [1])
    assert index.statistics()["docs"] == 3 and index.get_document(1).count() == 1 and index.get_document(1, include_deleted=True).count() == 2
    want = Searcher.of(rows(spark, (1, "new words"), (2, "other words"), (3, "third"))).search(Or(Term("words"), Term("new"))).collect()
    assert index.search(Or(Term("words"), Term("new"))).collect() == want
    assert index.remove([1, 3]) == 2 and index.remove([1]) == 0 and ids(index, "new") == []
    index.add(rows(spark, (1, "again words")))
    assert ids(index, "words") == [1, 2] and ids(index, "new") == [] and index.remove([1]) == 1 and ids(index, "again") == []
    index.add(rows(spark, (1, "last")))
    before = index.manifest
    for bad in (rows(spark, (7, "x"), (None, "y")), rows(spark, (8, "x"), (8, "y"))):
        with pytest.raises(IndexError_):
            index.add(bad)
    assert index.manifest == before and ids(index, "x") == []
    assert index.add(rows(spark)) and index.manifest == before
    index.compact()
    assert (ids(index, "last"), ids(index, "words"), index.statistics()) == ([1], [2], {"docs": 2, "deleted": 0, "postings": 3, "generations": 1, "next_id": 4})


def test_a_reader_sees_the_version_that_was_replaced(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"))
    index.add(rows(spark, (1, "old")))
    old = Index.open(spark, str(tmp_path / "i"), read_only=True)
    index.add(rows(spark, (1, "new")))
    assert ids(old, "old") == [1] and ids(old, "new") == []


def test_streams_of_one_index(spark, tmp_path):
    for k in range(2):
        spark.createDataFrame([(k, f"stream {k}")], "doc_id bigint, text string").write.parquet(str(tmp_path / f"in{k}"))
    for _ in range(2):  # again from the same checkpoints
        for k in range(2):
            stream = spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / f"in{k}"))
            ingest(stream, str(tmp_path / "i"), str(tmp_path / f"c{k}"), interval=None).awaitTermination()
    index = Index.open(spark, str(tmp_path / "i"))
    assert ids(index, "stream") == [0, 1] and len(index.manifest.generations) == 2 == len(index.manifest.streams)


def test_streams_that_commit_at_once(spark, tmp_path):
    queries = []
    Index.create(spark, str(tmp_path / "i"))
    for k in range(3):
        spark.createDataFrame([(k, f"stream {k}")], "doc_id bigint, text string").write.parquet(str(tmp_path / f"in{k}"))
    for k in range(3):
        queries.append(ingest(spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / f"in{k}")), str(tmp_path / "i"), str(tmp_path / f"c{k}"), interval=None))
    for q in queries:
        q.awaitTermination()
    assert ids(Index.open(spark, str(tmp_path / "i")), "stream") == [0, 1, 2]


def test_one_of_many_writers_creates_a_manifest(spark, tmp_path):
    made = []
    own = [threading.Thread(target=lambda k=k: made.append(Files(spark, str(tmp_path / "f")).create("m", str(k)))) for k in range(8)]
    for t in own:
        t.start()
    for t in own:
        t.join()
    assert sorted(made) == [False] * 7 + [True]
    f = Files(spark, str(tmp_path / "f"))
    assert f.names() == [n for n in f.names() if n == "m" or n.startswith(".")] and f.text("m") in "01234567"


def test_candidates(spark, tmp_path):
    index = Index.create(spark, str(tmp_path / "i"), config=Config(merge_small=3, merge_count=3, merge_most=100))
    assert index.candidates() == [] and not index.worth_compacting()
    for k in range(2):
        index.add(rows(spark, *[(10 * k + i, f"a b c{i} dd ee{k}") for i in range(4)]))
    assert index.candidates() == []
    index.remove([0, 1])  # half of the first is left
    assert index.candidates() == []
    index.remove([2])
    first, second = (g["id"] for g in index.manifest.generations)
    assert index.candidates() == [first] and index.worth_compacting()
    index.remove([10])
    index.compact(index.candidates())
    assert [g["id"] for g in index.manifest.generations][0] == second and index.statistics()["docs"] == 4 and index.statistics()["deleted"] == 1
    assert ids(index, "dd") == [3, 11, 12, 13] and len(index.manifest.tombstones) > 0
    for k in range(3):
        index.add(rows(spark, (100 + k, "small one")))
    assert len(index.candidates()) == 3
    index.compact(index.candidates())
    assert ids(index, "small") == [100, 101, 102] and index.candidates() == []
    tight = Index.open(spark, str(tmp_path / "i"), config=Config(merge_small=1000, merge_count=2, merge_most=10))
    assert len(tight.candidates()) == 2  # 3 and 6 postings
    index = Index.open(spark, str(tmp_path / "i"))
    index.remove([3, 11, 12, 13, 100, 101, 102])
    index.compact()
    assert index.statistics()["docs"] == 0 and index.manifest.generations == () and ids(index, "dd") == []
    index.add(rows(spark, (3, "dd")))
    assert ids(index, "dd") == [3]


def test_readers_are_waited_for(spark, tmp_path):
    root = str(tmp_path / "i")
    index = Index.create(spark, root, config=Config(wait_on_close=0.2))
    index.add(rows(spark, (1, "word")))
    reader = Index.open(spark, root, read_only=True, config=Config(wait_on_close=0.2))
    with reader.reading():
        index.add(rows(spark, (1, "other")))
        index.compact()
        index.vacuum()
        assert ids(reader, "word") == [1]  # its files are there
        assert reader.close() is False
    again = Index.open(spark, root)
    assert again.vacuum() and again.close() is True
    for act in (lambda: again.search(Term("word")), lambda: again.add(rows(spark)), again.compact):
        with pytest.raises(IndexError_):
            act()
    old = Index.open(spark, root, config=Config(keep_old=3600))
    old.add(rows(spark, (2, "word")))
    assert old.vacuum() == [] and old.execute(Term("word")) == old.search(Term("word")).collect()


def test_config(spark, tmp_path):
    assert parameter({"a": "3"}, "a", 1, int) == 3 and parameter({"a": "x"}, "a", 1, int) == 1 and parameter({}, "a", 1, int) == 1
    path = tmp_path / "p"
    path.write_text("# comment\nk1 = 2.0\ntermloom.auto_flush=no\nblock = many # not a number\nunknown=1\n")
    own = Config.from_file(spark, str(path))
    assert (own.k1, own.auto_flush, own.block) == (2.0, False, Config().block)
    spark.conf.set("termloom.merge_count", "3")
    try:
        assert Config.from_session(spark).merge_count == 3
    finally:
        spark.conf.unset("termloom.merge_count")
    index = Index.create(spark, str(tmp_path / "i"), config=own)
    index.add(rows(spark, (1, "word word"), (2, "other")))
    score = Index.open(spark, str(tmp_path / "i")).search(Term("word")).first().score  # k1 is the index's own
    tf = 2 * 3.0 / (2 + 2.0 * (0.25 + 0.75 * 2 / 1000))
    assert abs(score - round(tf * 0.6931471805599453, 6)) < 2e-6


def test_another_format(spark, tmp_path):
    index = Index.create(spark, Files(spark, str(tmp_path / "i"), "orc"))
    index.add(rows(spark, (1, "word"), (2, "word other")))
    assert ids(Index.open(spark, Files(spark, str(tmp_path / "i"), "orc")), "word") == [1, 2]
    assert list((tmp_path / "i").glob("gen-*/postings/*.orc"))


def test_metrics(spark, tmp_path, caplog):
    index = Index.create(spark, str(tmp_path / "i"))
    index.add(rows(spark, (1, "one word word"), (2, "other")))
    index.add(rows(spark, (1, "one")))
    index.remove([2])
    index.execute(Term("one"))
    index.compact()
    got = index.metrics.snapshot()
    assert got["counts"] == {"added_docs": 3, "added_postings": 4, "added_tokens": 5, "replaced_docs": 1, "removed_docs": 1, "queries": 1, "compacted_generations": 2, "dropped_docs": 2}
    assert got["timers"]["add"]["calls"] == 2 and got["timers"]["add"]["max_s"] >= got["timers"]["add"]["mean_s"] > 0
    assert index.metrics.snapshot(per_second=False)["timers"]["add"]["rate"] > 30 * got["timers"]["add"]["rate"]

    def broken(_):
        raise ValueError

    with caplog.at_level("INFO", "termloom"):
        M.Reporting(index.metrics, [M.log, broken, M.table(spark, str(tmp_path / "m"))], interval=60).stop()
    assert any('"added_docs": 3' in r.message for r in caplog.records) and any("reporter" in r.message for r in caplog.records)
    index.reporting(M.table(spark, str(tmp_path / "n"))).stop()
    assert list((tmp_path / "n").glob("*.json")) and index.segments().count() == 1 and index.tombstone_segments() is None
    lines = [json.loads(x) for f in (tmp_path / "m").glob("*.json") for x in f.read_text().splitlines()]
    assert {"name": "added_docs", "value": 3.0} in lines


def test_any_sizes_are_merged_by_the_stream_of_the_query(spark, tmp_path):
    """Its generations are one whatever their number of postings."""
    from dataclasses import replace

    from termloom.queries import EVERY

    index = Index.create(spark, str(tmp_path / "i"), config=EVERY)
    index.manifest = replace(index.manifest, generations=tuple({"id": f"g{k}", "gen": k, "docs": 10**7, "postings": 10**9 * k, "low": 0, "high": 1} for k in (5, 1)))
    assert index.candidates() == ["g1", "g5"]


@pytest.mark.parametrize("most", [0, 10**6])
def test_merged_from_postings_is_built_anew(spark, docs, tmp_path, monkeypatch, most):
    """With hidden documents and without, with few of them and with more than are broadcast."""
    from termloom.index import store

    monkeypatch.setattr(store, "BROADCAST", most)
    index = Index.create(spark, str(tmp_path / "i"))
    index.add(docs.filter("doc_id % 3 = 0"))
    index.add(docs.filter("doc_id % 3 = 1"))
    read = []
    monkeypatch.setattr(store, "inverted", lambda df, own=store.inverted: read.append(1) or own(df))
    index.compact()
    assert not read
    index.add(docs.filter("doc_id % 3 = 2 or doc_id % 9 = 0"))
    read.clear()
    index.remove(docs.filter("doc_id % 5 = 0"))
    index.compact()
    assert bool(read) == (most == 0)
    want = Searcher.of(docs.filter("doc_id % 5 <> 0")).postings
    got = index.postings().select("term", "doc_id", "tf", "doc_len")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    assert index.statistics()["deleted"] == 0 and index.statistics()["generations"] == 1
