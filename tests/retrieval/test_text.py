import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tesselar.functions import plain
from tesselar.functions import text as T
from tesselar.functions.stem import measure, stem

CASES = ["vector_store.search HNSW-index a.b", "Ünïcödé naïve ﬁne ½ Ⅷ ①", "straße", "éte", "a b", "", "...", "x-1_y.z", "İstanbul", "①②", "ＡＢＣ１"]


def one(spark, column, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column(F.col("t"))).collect()]


def test_tokens_equal_python(spark):
    r = random.Random(4)
    letters = [chr(c) for c in [*range(32, 0x250), *range(0x300, 0x310), *range(0x2150, 0x2190), *range(0xFB00, 0xFB07)]]
    texts = CASES + ["".join(r.choice(letters) for _ in range(40)) for _ in range(300)]
    assert one(spark, T.tokens, texts) == [plain.tokens(t) for t in texts]


def test_tokens_known(spark):
    got = one(spark, T.tokens, CASES)
    assert got[0] == ["vector_store.search", "vector", "store", "search", "hnsw-index", "hnsw", "index", "a.b"]
    assert got[2] == ["stra", "e"]
    assert got[5] == [] == got[6]
    assert one(spark, lambda c: T.tokens(c, drop_stopwords=True), ["the cat and-then_it"])[0] == ["cat", "and-then_it"]
    assert one(spark, T.content_words, ["the big ox was on the mat"])[0] == ["big", "mat"]


def test_sentences(spark):
    text = "One two three four five six seven eight. Short one. nine ten\n\nEleven  words are in this sentence and so it will stay."
    assert one(spark, T.sentences, [text])[0] == ["One two three four five six seven eight.", "Eleven words are in this sentence and so it will stay."]


def test_prose_and_cleaning(spark):
    assert one(spark, T.looks_like_prose, ["plain words only here", "const x = {a: 1};", "", "12 34 56 78"]) == [True, False, False, False]
    assert one(spark, T.clean_query, ["- **Bold** `code` [[link]] *it*  x"]) == ["Bold code link it x"]


def test_snippet(spark):
    text = "start " * 100 + "needle haystack " + "end " * 100
    got = one(spark, lambda c: T.snippet(c, F.array(F.lit("needle"), F.lit("haystack"))), [text, "short needle", None])
    assert "needle haystack" in got[0] and got[0].startswith("…") and got[0].endswith("…") and len(got[0]) == 262
    assert got[1] == "short needle" and got[2] == ""


#: Words from Porter's paper, by step.
GOLDEN = (
    "caresses caress|ponies poni|ties ti|caress caress|cats cat|feed feed|agreed agre|plastered plaster|bled bled|motoring motor|sing sing|conflated conflat|troubled troubl|sized size|"
    "hopping hop|tanned tan|falling fall|hissing hiss|fizzed fizz|failing fail|filing file|happy happi|sky sky|relational relat|conditional condit|rational ration|digitizer digit|"
    "vietnamization vietnam|operator oper|feudalism feudal|decisiveness decis|callousness callous|sensibiliti sensibl|triplicate triplic|formalize formal|electrical electr|goodness good|"
    "revival reviv|airliner airlin|replacement replac|adoption adopt|communism commun|homologous homolog|bowdlerize bowdler|probate probat|rate rate|cease ceas|controll control|roll roll|by by"
)


@pytest.mark.parametrize("pair", GOLDEN.split("|"))
def test_stem(pair):
    word, expected = pair.split()
    assert stem(word) == expected


def test_measure():
    assert [measure(w) for w in ("tr", "tree", "trouble", "oats", "troubles", "private", "oaten")] == [0, 0, 1, 1, 2, 2, 2]


def test_fold_drops_marks():
    assert plain.fold("Ångström") == "angstrom" and unicodedata.normalize("NFKD", "ﬁ") == "fi"
