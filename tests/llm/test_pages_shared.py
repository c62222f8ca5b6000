"""Text that many pages of a host share."""

from tessera.llm import html


def texts(spark, pages):
    df = spark.createDataFrame([(k, f"http://a.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(html.extract(df).collect())]


def test_copies_of_one_article_keep_it(spark):
    for tag in ("article", "div"):
        pages = [f"<body><!-- ad {k} --><script>track({k})</script><{tag} data-n='{k}'><p>One story</p><p>Its end</p></{tag}></body>" for k in range(8)]
        assert texts(spark, pages) == ["One story\nIts end"] * 8


def test_passages_shared_by_articles_stay(spark):
    pages = [f"<body><p>Welcome</p><article><p>Part of a series</p><p>Story {k}</p></article><p>Rights</p></body>" for k in range(8)]
    assert texts(spark, pages) == [f"Part of a series\nStory {k}" for k in range(8)]
