import math

import pytest
from pyspark.sql import functions as F

from termloom.functions import analysis, scoring
from termloom.functions.porter import stem


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'int'}" for k, v in row.items())).select(column.alias("v")).first().v


def test_scores_by_hand(spark):
    tf, n = F.col("tf"), F.col("n")
    assert math.isclose(value(spark, scoring.okapi(tf, n), tf=1, n=100), 1.58273381295, rel_tol=1e-9)
    assert value(spark, scoring.okapi(tf, n), tf=1, n=2) > value(spark, scoring.okapi(tf, n), tf=1, n=3)
    assert math.isclose(value(spark, scoring.bm_like(tf, n), tf=3, n=400), 3 * 2.2 / (3 + 0.2))
    assert math.isclose(value(spark, scoring.idf(tf, n), tf=100_000, n=625), 5.07438413501, rel_tol=1e-9)
    assert math.isclose(value(spark, scoring.idf(tf, n), tf=10, n=10), math.log(1 + 0.5 / 10.5))
    assert value(spark, scoring.okapi(tf, n), tf=40_000, n=40_000) > 0  # beyond 16 bits


def test_sixteen_bits(spark):
    values = [0.0, 0.1, 0.49, 0.5, 0.51, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", scoring.quantise(F.col("v")).alias("q"))
    rows = df.select("v", "q", scoring.dequantise(F.col("q")).alias("w")).collect()
    assert all(abs(r.v - r.w) <= 1 / 131070 for r in rows)
    assert [r.q for r in rows] == sorted(r.q for r in rows)
    assert spark.createDataFrame([(None,)], "v double").select(scoring.quantise(F.col("v"))).first()[0] is None
    with pytest.raises(Exception, match="within"):
        spark.createDataFrame([(1.5,)], "v double").select(scoring.quantise(F.col("v"))).collect()


@pytest.mark.parametrize(
    "word, root",
    [
        *[("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("caress", "caress"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("bled", "bled"), ("motoring", "motor"), ("sing", "sing")],
        *[("conflated", "conflat"), ("troubled", "troubl"), ("sized", "size"), ("hopping", "hop"), ("tanned", "tan"), ("falling", "fall"), ("hissing", "hiss"), ("fizzed", "fizz"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky")],
        *[("relational", "relat"), ("conditional", "condit"), ("rational", "ration"), ("valenci", "valenc"), ("digitizer", "digit"), ("conformabli", "conform"), ("radicalli", "radic"), ("vietnamization", "vietnam"), ("operator", "oper"), ("feudalism", "feudal"), ("decisiveness", "decis"), ("hopefulness", "hope"), ("sensibiliti", "sensibl")],
        *[("triplicate", "triplic"), ("formative", "form"), ("formalize", "formal"), ("electriciti", "electr"), ("electrical", "electr"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("allowance", "allow"), ("inference", "infer"), ("airliner", "airlin"), ("adjustable", "adjust"), ("replacement", "replac"), ("adoption", "adopt")],
        *[("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("été", "été"), ("a1s", "a1s")],
    ],
)
def test_stems(word, root):
    assert stem(word) == root


def test_forms_of_the_english_query():
    from termloom.queries import FORMS

    assert all(stem(w) == w == stem(w + x) for w, forms in FORMS.items() for x in forms.split())


def tiny(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_counts(spark):
    long = "x" * 127
    docs = tiny(spark, [(0, f"The cat, THE dog! a {long} {long}y"), (1, ""), (2, None), (2**40, "Été été b")])
    got = {(r.term, r.doc_id): (r.tf, r.doc_len) for r in analysis.term_counts(docs, analysis.simple()).collect()}
    assert got == {("the", 0): (2, 7), ("cat", 0): (1, 7), ("dog", 0): (1, 7), (long, 0): (1, 7), ("été", 2**40): (2, 3)}
    assert {r.doc_id: r.doc_len for r in analysis.doc_lengths(docs, analysis.simple()).collect()} == {0: 7, 1: 0, 2: 0, 2**40: 3}
    assert analysis.term_counts(tiny(spark, []), analysis.simple()).count() == 0


def test_english(spark):
    docs = tiny(spark, [(1, "The runner's dogs were running; it isn't John’s run"), (2, None)])
    got = {r.term: (r.tf, r.doc_len) for r in analysis.term_counts(docs, analysis.english()).collect()}
    assert got == {"runner": (1, 7), "dog": (1, 7), "were": (1, 7), "run": (2, 7), "john": (1, 7), "isn't": (1, 7)}


def test_stop_words(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("Cat\n\n  dog \n")
    words = analysis.stop_words(spark, str(tmp_path / "stop.txt"))
    assert words == ("cat", "dog")
    got = analysis.term_counts(tiny(spark, [(1, "CAT dog bird bird")]), analysis.simple(words)).collect()
    assert [(r.term, r.tf, r.doc_len) for r in got] == [("bird", 2, 2)]
    assert analysis.stop_words(spark, str(tmp_path / "none")) == analysis.STOP_WORDS == analysis.stop_words(spark, None)


def test_stop_words_that_change(spark, tmp_path):
    path = tmp_path / "stop.txt"
    watched = analysis.WatchedStopWords(spark, str(path))
    assert watched.words() == analysis.STOP_WORDS
    path.write_text("cat")
    assert watched.words() == ("cat",) == watched.words()
    path.write_text("cat\ndog")
    assert watched.words() == ("cat", "dog")
    path.unlink()
    assert watched.words() == analysis.STOP_WORDS


def test_shingles_by_hand(spark):
    docs = tiny(spark, [(1, "red fox red fox. fox blue red. blue"), (2, None)])
    got = {r.shingle: (r.tf, r.importance) for r in analysis.shingles(docs, analysis.simple()).collect()}
    # red-fox: 1 + 1/3 + 1 + 1 in the first sentence, 1/2 in the second
    near = {"fox%red": 1 + 1 / 3 + 1 + 1 + 1 / 2, "blue%fox": 1.0, "blue%red": 1.0}
    f = {"fox": 3, "red": 3, "blue": 2}
    for k, c in near.items():
        a, b = k.split("%")
        assert got[k][0] == round(math.sqrt(f[a] * f[b])) and math.isclose(got[k][1], c**10 * math.sqrt(f[a] * f[b]), rel_tol=1e-9)
    assert set(got) == set(near)
    assert analysis.shingles(docs, analysis.simple(), ratio=0.34).count() == 1


def test_pieces_of_a_batch_don_t_matter(spark):
    """Many documents, long and empty ones, in batches and pieces of any size."""
    import random

    import pyarrow as pa

    rng = random.Random(1)
    lists = pa.array([["w%d" % rng.randrange(30) for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(200)], pa.list_(pa.string()))
    for own in (lists, lists.slice(13, 90)):
        for most in (1, 7, 100, 10**6):
            out = [x for begin, n, v in analysis._pieces(own, most) for x in _split(v.to_pylist(), n)]
            assert out == own.to_pylist()


def _split(values, lengths):
    at = 0
    for n in lengths:
        yield values[at : at + n]
        at += n


def test_some_terms_alone(spark, data):
    """Few terms, many, stems and none: the rows that filtering all postings gives; long batches in small pieces too."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "The of't THE’s thing's o")], docs.schema))
    many = ["the", "of", "und", "o", "x" * 128] + [f"w{i}" for i in range(30)]
    for analyzer, terms in ((analysis.simple(), ["the", "of", "lytion"]), (analysis.simple(), many), (analysis.simple(["of"]), ["the", "of"]), (analysis.english(), ["thing", "lytion", "the"]), (analysis.simple(), [])):
        got = analysis.term_counts(docs, analyzer, terms)
        want = analysis.term_counts(docs, analyzer).filter(F.col("term").isin(terms))
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_few_terms_need_no_python(spark):
    plan = analysis.term_counts(tiny(spark, [(1, "red fox")]), analysis.simple(), ["fox"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("regexp_extract_all") == 1


def test_a_batch_is_not_held_while_the_next_is_read(spark):
    """Else a worker keeps two batches."""
    import gc
    import weakref

    import pyarrow as pa

    held, most = [], 0

    def batches():
        nonlocal most
        for k in range(4):
            gc.collect()
            most = max(most, sum(r() is not None for r in held))
            b = pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([["aa", "bb", "aa"]])], names=["doc_id", "tokens"])
            held.append(weakref.ref(b))
            yield b
            del b

    assert sum(x.num_rows for x in analysis._counting(analysis.simple())(batches())) == 4 and most == 0


def test_document_frequencies(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for analyzer in (analysis.simple(), analysis.english()):
        want = analysis.term_counts(docs, analyzer).groupBy("term").agg(F.count("*").alias("df"))
        got = analysis.doc_frequencies(docs, analyzer)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()
