"""Classifiers, pages, conversations, vectors and the pipeline."""

import numpy as np
import pandas as pd
import pytest

from tessera.llm import chat, html, labelled, neighbours, quality, queries, toxicity
from tests.oracle import differs, expected

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    assert not differs(queries.QUERIES[name](spark, SF).toPandas(), expected(SF, queries.ORACLE_SQL[name]))


@pytest.mark.parametrize("name, label, least", [("op2_quality", "quality", 0.97), ("op7_toxicity", "toxic", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, BIG).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{BIG}/labels.parquet"), on="doc_id")
    assert (held.predicted == held[label]).mean() >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifier_without_labels(spark, module):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "word " * 50_000, "z")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(1, None, None), (9, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.scores(docs, labels).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1
    assert module.scores(docs.limit(0), labels.limit(0)).collect() == []


def test_machine_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)) < 0.5
    label = (x[:, 0] & x[:, 1]).astype(int)
    rows, inputs = np.nonzero(x)
    model = toxicity._train(toxicity.Machine(np.arange(3), 0.0, np.zeros(3), np.zeros((3, toxicity.FACTORS))), label, inputs, x.sum(1))
    assert (((model.score(rows, inputs, 4000)) >= 0.5) == label).mean() > 0.99


def test_rules_compile_to_columns(spark):
    assert labelled.ROWS_PER_CLASS == 10_000
    rule = quality.Rule(((0, 0.5, np.inf), (1, -np.inf, 2.0)))
    df = spark.createDataFrame([([0.6, 1.0],), ([0.6, 3.0],), ([0.5, 1.0],)], "stats array<double>")
    assert [r[0] for r in df.select(rule.column(df["stats"])).collect()] == [True, False, False]


PAGE = (
    "<html><head><title>t</title><style>x</style></head><body><header>Site</header><div class='navBar'><a>Home</a></div><{tag}><h1>T &eacute;x</h1><p>A  b<br>c</p><aside>side</aside>"
    "<p>D <b>e</b>f<p>G</{tag}><div id=comments><p>nice</p></div><form><p>q</p></form><script>var a='</p>'</script><footer>&copy;</footer></body>"
)


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text(tag):
    assert html.texts_of([PAGE.replace("{tag}", tag)], False)[0] == "T éx\nA b c\nD ef\nG"


def test_template_text_goes(spark):
    page = lambda k: f"<body><div><p>Welcome to our shop</p><p>Story {k} " + "tale " * k + "</p><p>All rights kept</p></div></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(8)] + [(90, "http://b.example/", page(3)), (91, None, page(4)), (92, "http://a.example/", None), (93, "x", ""), (0, "http://a.example/0", page(0))]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, token string")
    got = sorted((r.page_id, r.text) for r in html.extract(df).collect())
    story = lambda k: f"Story {k}" + " tale" * k
    whole = lambda k: f"Welcome to our shop\n{story(k)}\nAll rights kept"
    assert got == sorted([(k, story(k)) for k in range(8)] + [(0, story(0)), (90, whole(3)), (91, whole(4)), (92, ""), (93, "")])
    assert html.extract(df.limit(0)).collect() == []


def test_reply_tree_branches(spark):
    rows = [(1, 1, None, "user", "a"), (1, 2, 1, "assistant", "b <|im_end|> <\\| x"), (1, 3, 1, "assistant", "c"), (1, 4, 3, "us\ner", None), (2, 1, 7, None, "root"), (None, 1, None, "user", "n")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "tree long, id long, parent long, role string, text string, part string")
    got = {(r.tree, r.rank): r.formatted for r in chat.conversations(df, best=None).collect()}
    assert {k: [t[:2] for t in chat.parse(v)] for k, v in got.items()} == {
        (1, 1): [("user", "a"), ("assistant", "c"), ("us\ner", "")], (1, 2): [("user", "a"), ("assistant", "b <|im_end|> <\\| x")], (2, 1): [("", "root")], (None, 1): [("user", "n")],
    }
    assert len(chat.conversations(df).collect()) == 3
    assert chat.conversations(df.limit(0)).collect() == []


def test_long_conversation(spark):
    n = chat.STRETCH + 77
    turns = spark.createDataFrame([(5, k, "user", str(k)) for k in range(n)], "conv_id long, turn long, role string, text string")
    assert [t[1] for t in chat.parse(chat.conversations(chat.chained(turns)).first().formatted)] == [str(k) for k in range(n)]


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 24))
    x[1:1200] = x[0]
    rows = [(k, v.tolist(), 0) for k, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 24, 0), (5002, [float("nan")] * 24, 0), (5003, [1.0] * 3, 0), (5004, [None] + [1.0] * 23, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bucket int")
    before, neighbours.PART = neighbours.PART, 200
    try:
        got = neighbours.search(df, df.filter("vec_id % 100 = 0")).toPandas()
    finally:
        neighbours.PART = before
    hits = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        g = g.sort_values("rank")
        assert np.array_equal(g.score.to_numpy(), d[g.vec_id]) and list(g["rank"]) == list(range(1, 11))
        best = np.lexsort((np.arange(3000), d))[:10]
        hits += len(set(best) & set(g.vec_id))
        assert q >= 1200 or list(g.vec_id) == list(best)
    assert got.query_id.nunique() == 30 and hits / 300 >= 0.9
    assert neighbours.search(df.limit(0), df.limit(0)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = p.Scratch(spark).cut(stage(spark, before, SF))
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    kept = {r.doc_id: r.text for r in before.collect()}
    got = {r.doc_id: r.n_tokens for r in p.run(spark, SF).collect()}
    from tessera.llm import bpe

    t = bpe.load(bpe.VOCABULARY)
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in kept.items()}
