import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality import COMMON, FUNCTIONS, KINDS, STATS, learn_types, statistics, text_statistics, text_types, votes_of

PROSE = "The company said that it would restate net debt for last year, and that this is in line with what was said in the spring. We will come back to it later."
TEXTS = {
    "prose": [PROSE, PROSE.lower().replace(".", ""), "Der Umsatz ist in den ersten Monaten des Jahres um zwei Prozent gestiegen, und die Kosten sind im Vergleich mit dem Vorjahr nicht höher.", "増収の主な要因は、輸出の数量増と価格の見直しです。通期の業績予想については、変更はありません。"],
    "list": ["- Net debt\n- Direct channel: $5 million\n- Exhibit 4.1\n- Order backlog", "Working capital\nExhibit 70.1\nTax rate\nUnit volume up 3%\nInventory", "AAA1, BBB2, Exhibit 4.2, Net debt, CCC3, Order backlog, DDD9"],
    "table": [",Q1,Q2\nNet revenue,5.1,-\nTax rate,(4.2),7%\nInventory,1.0,2.0", "| a | Q1 |\n|---|---|\n| Net debt | 3.1 |\n| Tax rate | 4% |", "Net debt ........... 5.1  7.2\nTax rate ........... 4.0  -"],
    "junk": ["a9F/" * 40, "Ã©Ã¼â€œÃ¤" * 30, "Home | Login | Search | Sitemap | Share | Print", "undefined " * 20, "0000  fe cf f0 52 a5 50 6b 9a f2 eb\n0010  2a 1d c4 32 55 c4 8f 7c b3 80"],
}


@pytest.fixture(scope="module")
def corpus():
    rows = [(k, t) for k, ts in TEXTS.items() for t in ts * (12 if k == "prose" else 4)]
    return [(i, k, t) for i, (k, t) in enumerate(rows)]


def test_types(spark, corpus):
    df = spark.createDataFrame([(i, t, k) for i, k, t in corpus], "doc_id long, text string, kind string").withColumn("votes", F.lit("clash"))
    got = {r.doc_id: r.kind for r in text_types(text_statistics(df)).collect()}
    assert got == {i: k for i, k, _ in corpus}


def test_blank_texts_have_no_type(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n\t\xa0"), (4, PROSE), (4, PROSE), (5, "x" * 200_000)], "doc_id long, text string")
    measured = text_statistics(df)
    rows = {r.doc_id: r for r in measured.collect()}
    assert measured.count() == 6
    assert all(rows[i].votes is None and rows[i].words is None for i in (1, 2, 3))
    assert sorted(r.doc_id for r in text_types(measured).collect()) == [4, 4, 5]
    assert text_types(text_statistics(df.limit(0))).collect() == []


def test_statistics():
    s = dict(zip(STATS, statistics("One two three.\n\nFour, five\n")))
    assert (s["words"], s["lines"], s["ending_share"], s["words_per_line"]) == (5, 2, 0.5, 2.5)
    assert s["word_length"] == pytest.approx((3 + 3 + 6 + 5 + 4) / 5)
    assert s["symbol_ratio"] == pytest.approx(2 / 21)
    assert all(np.isfinite(list(dict(zip(STATS, statistics(t))).values())).all() for t in ("a", "%", "1", "日", "​", "- "))


def test_accuracies_are_learned_from_agreements():
    rng = np.random.default_rng(11)
    target = np.array([KINDS.index(k) for _, k, _ in FUNCTIONS])
    truth = rng.choice(4, 4000, p=[0.7, 0.1, 0.1, 0.1])
    right = rng.uniform(0.6, 0.95, len(FUNCTIONS))
    fires = np.where(target[None, :] == truth[:, None], rng.random((4000, len(FUNCTIONS))) < right, rng.random((4000, len(FUNCTIONS))) < 0.06)
    masks = (fires.astype("int64") << np.arange(len(FUNCTIONS))).sum(axis=1)
    patterns, at, counts = np.unique(masks, return_inverse=True, return_counts=True)
    assert (learn_types(patterns, counts.astype(float)).argmax(axis=1)[at] == truth).mean() > 0.97


def test_votes_are_one_bit_each():
    stats = np.array([statistics(PROSE)])
    named = [n for i, (n, _, _) in enumerate(FUNCTIONS) if votes_of(stats)[0] >> i & 1]
    assert "common_words" in named and "dump" not in named


def test_function_words_of_another_language(spark):
    """Italian prose is prose where its function words are given; without them it isn't known as such."""
    text = "Il consiglio ha detto che il debito della società non è cambiato nel corso dell'anno, e che per il prossimo anno non si aspetta una crescita del mercato. I costi sono in linea con quelli dell'anno prima."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    share = lambda **o: text_statistics(df, **o).first().common_share
    assert share(common={"it": "il la i le di che e per non si in una con del della nel è ha sono"}) > 0.4 > share(common={"en": COMMON["en"]})
    assert share() == share(common=COMMON)
