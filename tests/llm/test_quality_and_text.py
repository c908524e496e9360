"""Clean documents stay, whatever their language; toxic ones are found; articles come before comments."""

import random
import time

import pytest
from pyspark.sql import functions as F

from fiscalarc.llm import divergence, nnpu, tagpaths
from fiscalarc.llm.queries import remainder
from fiscalarc.llm.shared import table

POST = "The council met on Monday, and it agreed to build the bridge. Work begins in May, said the mayor; " * 2
TALK = "I think this is wrong, and so does everyone I know. Why would they do it? " * 14


@pytest.mark.parametrize("page", [
    f"<body><div><h1>T</h1><p>{POST[:160]}</p></div><section id=comments><p>{TALK}</p></section></body>",
    f"<body><div class=content><h1>T</h1><p>{POST}</p></div><div class=sidebar><p>{TALK}</p></div></body>",
    f"<body><div class=content><h1>T</h1><p>{POST}</p></div><div class=related><p>{TALK}</p></div></body>",
    f"<article><h1>T</h1><p>{POST}</p><div class=user-reviews><p>{TALK}</p></div></article>",
    f"<body><div><h1>T</h1><p>{POST}</p></div><div class=cookie-banner-text><p>{TALK}</p></div></body>",
])
def test_the_article_comes_before_what_is_beside_it(page):
    got = tagpaths.main_text(page)
    assert "council" in got and "everyone" not in got and got.startswith("T")


def test_a_misnamed_part_with_everything_is_kept():
    page = f"<body><div class=sidebar><h1>T</h1><p>{POST}</p></div><div>All rights reserved</div></body>"
    assert "council" in tagpaths.main_text(page)


@pytest.mark.parametrize("page", ["<div>some text here, ok." * 50_000, "<div class=menu>a, b." * 20_000,
                                  "<p>some text, ok.</b></i>" * 20_000, "<b><li>x, y.</div></span>" * 20_000])
def test_deep_and_broken_pages_take_linear_time(page):
    start = time.perf_counter()
    tagpaths.main_text(page)
    assert time.perf_counter() - start < 5


def test_no_text_is_lost_in_the_depth():
    assert tagpaths.main_text("<div>some text here, ok." * 300).count("some text here, ok.") == 300


def test_a_language_without_a_list_of_words_is_kept(spark):
    rng = random.Random(3)
    syllables = ["ва", "но", "ро", "ста", "при", "ка", "ль", "до", "ми", "ще"]

    def text(n):
        words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
        return " ".join(words).capitalize() + "."

    english = ["the", "of", "and", "to", "in", "river", "stone", "bridge", "people", "light"]
    rows = [(i, text(rng.randrange(12, 400)), "uk", i) for i in range(80)]
    rows += [(100 + i, " ".join(rng.choices(english, k=rng.randrange(12, 400))), rng.choice(["en", None]), i)
             for i in range(80)]
    rows += [(300, "1234 %%% " + " ".join(str(rng.random()) for _ in range(200)), "uk", 0), (301, None, "xx", 0)]
    got = {r["doc_id"]: r for r in divergence.quality(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, language long")).collect()}
    assert sum(got[i]["kept"] for i in range(80)) >= 78 and not got[300]["kept"] and not got[301]["kept"]
    assert sum(got[100 + i]["kept"] for i in range(80)) >= 78
    assert got[3]["language"] == "uk" and got[3]["word_distance"] == 0


@pytest.mark.parametrize("sf, least", [("sf0.001", 0.5), ("sf0.01", 0.6), ("sf0.1", 0.8)])
def test_toxic_documents_are_found(spark, sf, least):
    """Recall on documents of good quality the fit did not see; clean ones are left alone."""
    docs, labels = (table(spark, f"/root/testdata/{sf}", n) for n in ("documents", "labels"))
    model = nnpu.train(docs, labels, remainder(5) != 0)
    assert len(model.keys) > 0
    scored = nnpu.score(docs.filter(remainder(5) == 0), model, F.col("doc_id"))
    rows = scored.join(labels, "doc_id").filter("quality = 1").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in rows}
    found, missed = n.get((1, 1), 0), n.get((1, 0), 0)
    assert found >= least * (found + missed)
    assert n.get((0, 1), 0) <= 0.02 * (n.get((0, 0), 0) + n.get((0, 1), 0))


def test_copies_weigh_no_more_than_one(spark):
    """A thousand copies of a toxic and of a clean text change nothing that is learnt."""
    rng = random.Random(4)
    def text(bad):
        return " ".join([f"w{rng.randrange(200)}" for _ in range(30)] + [f"bad{rng.randrange(3)}"] * bad)

    rows = [(i, text(i % 8 == 0)) for i in range(400)]
    more = rows + [(1000 + i, rows[0][1]) for i in range(1000)] + [(3000 + i, rows[1][1]) for i in range(1000)]
    def fit(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, int("bad" in t)) for i, t in rows if i % 2 == 0 or i > 900],
                                       "doc_id long, toxic int")
        return nnpu.train(docs, labels, F.lit(True))

    few, many = fit(rows), fit(more)
    assert few.keys.tolist() == many.keys.tolist() and len(few.keys)
    assert abs(few.weights - many.weights).max() < 0.3
