import pytest
from pyspark.sql import functions as F

from textharbor.config import PLAIN, Analysis, Config, ConfigError, FieldAnalysis, Ranking
from textharbor.functions.analysis import analyze, analyzed, tokenize
from textharbor.functions.stemmer import porter


def test_tokens_are_runs_of_letters_and_digits():
    assert tokenize("Späte Boote; tide_3 (low-water)?") == ["Späte", "Boote", "tide", "3", "low", "water"]


def test_positions_keep_gaps_of_stop_words():
    assert analyze("a boat of the old harbour", FieldAnalysis(stemmer="none")) == [("boat", 1), ("old", 4), ("harbour", 5)]


def test_length_counts_after_stemming():
    assert [t for t, _ in analyze("we row to far quays", FieldAnalysis(False, "none", 4))] == ["quays"]


# The examples of the published description of the algorithm, where later steps do not change them, and words it leaves alone.
STEMS = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl,
sized size, hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration,
valenci valenc, hesitanci hesit, digitizer digit, conformabli conform, radicalli radic, differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic,
operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal, sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form,
formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust,
defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, communism commun, activate activ, angulariti angular, homologous homolog,
effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, at at, be be, café café, naïve naïve"""


@pytest.mark.parametrize("word, expected", [tuple(x.split()) for x in STEMS.split(",")])
def test_porter(word, expected):
    assert porter(word) == expected


@pytest.mark.parametrize("how", [FieldAnalysis(), FieldAnalysis(stemmer="none"), FieldAnalysis(False, "none", 4)])
def test_column_analysis_agrees_with_queries(spark, how):
    texts = ["The ferries of an outer island", "", None, "Ünïted Straßen 2024, x_y", "a the of"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", analyzed(F.col("t"), how).alias("x")).collect()
    for r in rows:
        assert [(x.term, x.position) for x in r.x] == analyze(texts[r.i] or "", how)


def test_configuration_rejects_what_it_does_not_know():
    c = Config.from_toml('[analysis]\nstemmer="none"\n[analysis.title]\nstemmer="porter"\n[ranking]\nscoring="tf-idf"\n')
    assert c.analysis.of(0).stemmer == "porter" and c.analysis.of(2).stemmer == "none" and c.ranking.scoring == "tfidf"
    for bad in ("[nowhere]\n", "[ranking]\nwhat=1\n", "[ranking]\nbm25_b=2.0\n", "[analysis.tail]\nstemmer='none'\n", "[query]\ntop_k=0\n", "x"):
        with pytest.raises(ConfigError):
            Config.from_toml(bad)
    assert Ranking().weights == (4.0, 2.0, 1.0, 1.5) and PLAIN.of(1).stop_words is False and Analysis().of(3).stemmer == "porter"
