import random

import pytest

from roadloom.llm import spam as module
from roadloom.llm.spam import autocorrelation, count_words, judge, learned, mended, model_of, recurrences, regularity, spam, spam_scores


def cues(lines):
    return "\n".join(f"{i}\n00:00:{i % 60:02},000 --> 00:00:{i % 60:02},900\n{t}\n" for i, t in enumerate(lines, 1))


RNG = random.Random(1)
TALK = ["The ferryman forgot the red notebook under the stairs.", "Who gave you this?", "[door creaks]", "You're late, as always, Mika.", "She will find the keys to the mill!"]
KEYS = ["yoga mat", "yoga mat best price", "leather wallet", "used tyres", "used tyres near me", "folding chair coupon"]
LINKS = [f"{p}{w}.example/{k}" for k, (p, w) in enumerate([("www.", "lopel"), ("https://www.", "mika"), ("", "tujor"), ("http://", "zanlo"), ("www.", "gorlan"), ("", "quimi")])]


#: A small corpus: dialogue in four languages, and a few pages of keywords among it.
OTHER = {
    "ja": ["もう行こう。", "あの子は橋の近くで赤いノートを壊した。", "船長は嵐の前に手紙を隠した。", "あの人は橋の前で手紙を売った。"],
    "ru": ["Садовник забыл письмо под лестницей.", "Это не смешно.", "Кто там и что ты искал?", "Он не украл мёд, а она забыла ключи."],
    "de": ["Das ist nicht lustig.", "Die Schwester suchte die Schlüssel der Mühle.", "Er hat den Brief auf dem Boden vergessen.", "Wer ist das und was will er?"],
}
KEYS_OF = {"en": KEYS, "ja": ["香水 激安", "中古タイヤ 送料無料", "財布"], "ru": ["духи скидка", "шины дёшево", "духи скидка купить"], "de": ["Handyhülle in der Nähe", "Laufschuhe in der Nähe"]}
TALKS = {"en": TALK + ["two wet dogs, a bag of walnuts, a letter without a stamp, the red notebook.", "He forgot the keys under the stairs of the mill.", "Did you hide a letter for my aunt?"], **OTHER}


def corpus():
    for lang, talk in TALKS.items():
        for k in range(100):
            yield lang, cues(RNG.sample(talk, 3) if k % 20 else [RNG.choice(KEYS_OF[lang]) for _ in range(9)] + KEYS_OF[lang])


CORPUS = list(corpus())
MODEL = model_of((*k, *v) for k, v in count_words([t for _, t in CORPUS], [lang for lang, _ in CORPUS]).items())


@pytest.mark.parametrize(
    "lines",
    [
        [RNG.choice(KEYS) for _ in range(30)], [" | ".join(RNG.choices(KEYS, k=5)) for _ in range(8)], [", ".join(RNG.choices(LINKS, k=3)) for _ in range(8)], ["www[.]lopel[.]test, http://mika dot example, tujor . example, gorlan[.]invalid"] * 6,
        ["#beard_oil, #cheapbeardoil, beard-oil"] * 8, [f"{k} >> {u}" for k in KEYS for u in LINKS], TALK[:2] + [" ".join(RNG.choices(KEYS, k=9)) for _ in range(6)], ["香水 激安", "中古タイヤ 送料無料", "財布"] * 8, ["духи скидка; шины дёшево; духи скидка купить"] * 6,
        ["#Handyhülle-in-der-Nähe, Laufschuhe_in_der_Nähe"] * 6, KEYS * 2 + ["a" * 5000],
        ["g​old watch | GOLD WATCH | g​old watch 2024"] * 6,
    ],
)
def test_spam(lines):
    assert judge(cues(lines), MODEL).share > 0.5


@pytest.mark.parametrize(
    "lines",
    [
        TALK * 6, ["♪ La la la, the summer's gone ♪", "♪ Come home, come home, the lamps are lit ♪"] * 10, ["[wind howling]", "(laughter)", "*thunder*"] * 10, ["Subtitles by Mika77, www.lopel.example"] + TALK, ["www.lopel.example"] * 12, ["Camera: Lopel Mika", "Sound: Tujor Zanlo"] * 8,
        TALK * 3 + ["yoga mat cheap"] * 2, ["two wet dogs, a bag of walnuts, a letter without a stamp, the red notebook."] * 6, ["もう行こう。", "あの子は橋の近くで赤いノートを壊した。"] * 6, ["a" * 500] * 3 + TALK, ["O0:00:20,1O0 --> 00:O0:21,000"] * 9 + TALK,
    ],
)
def test_no_spam(lines):
    assert judge(cues(lines), MODEL).share <= 0.5


def test_corners(spark):
    assert judge(None).share == judge("").share == judge(" \n\n").share == judge("1\n00:00:01,000 --> 00:00:02,000\n").share == 0
    rows = [(1, cues(KEYS * 5), "x"), (2, cues(TALK), "x"), (3, None, "x"), (4, "", None), (1, cues(KEYS * 5), "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, spam_share string")
    assert sorted(r.doc_id for r in spam(df).collect()) == [1, 1]
    assert spam_scores(df).count() == 5 and spam(df.limit(0)).count() == 0


def test_recurrence_and_regularity():
    assert recurrences(["a", "b", "a", "c"]).tolist() == [2, 5, 2, 5]
    assert autocorrelation(["gold", "watch"] * 20) >= 0.5 and autocorrelation([str(i) for i in range(50)]) == 0.0 and autocorrelation([]) == 0.0


def test_mended():
    for text in ("perché è già", "Знаешь, это не смешно", "♪ été ♪"):
        wrong = text.encode().decode("cp1252", "replace")
        assert "�" in wrong or mended(wrong) == text
        assert mended(text) == text


POLISH = """Gdzie byłeś wczoraj wieczorem
Czekałam na ciebie do północy
Nie mogłem przyjść bo zepsuł mi się samochód
Zawsze masz jakąś wymówkę
Przysięgam że mówię prawdę
Matka dzwoniła trzy razy
Co jej powiedziałaś
Że pojechałeś do brata
Dobrze zrobiłaś dziękuję
Następnym razem sam się tłumacz
Chcesz kawy czy herbaty
Poproszę herbatę z cytryną
W kuchni nie ma już cukru
Pójdę do sklepu jak przestanie padać
Weź parasol z przedpokoju
Ten niebieski jest złamany
To kup nowy po drodze
A pies musi wyjść przed nocą
Twoja kolej mój drogi
Wrócę za pół godziny""".splitlines()


def test_strange_languages_full_stops_and_long_periods():
    """A language the corpus lacks: dialogue without full stops and a refrain are no spam, keywords are."""
    for model in (None, MODEL):
        assert judge(cues(POLISH), model).share <= 0.5
        assert judge(cues(["Wlazł kotek na płotek i mruga", "Ładna to piosenka niedługa"] * 20), model).share <= 0.5
        strange = ["tanie buty", "tanie buty sklep", "buty damskie", "buty damskie tanie", "tanie torebki", "torebki sklep", "torebki damskie", "torebki damskie tanie", "sklep buty damskie"]
        assert judge(cues([" | ".join(RNG.sample(strange, 4)) for _ in range(12)]), model).share > 0.5
    assert judge(cues([f"{RNG.choice(KEYS)}." for _ in range(40)]), MODEL).share > 0.5  # lines that end like sentences
    assert judge(cues(LINKS[:3] * 60)).share > 0.5  # three links in turn
    assert judge(cues(LINKS[:1] * 200)).share <= 0.5  # one advert, however often repeated
    words = [f"w{a}{b}" for a in "abcdefghij" for b in "abcdefghij"]
    assert autocorrelation(words * 3) > 0.6  # a period of 100


def test_each_part_of_the_method_decides(monkeypatch):
    strange = cues([" | ".join(RNG.sample(["tanie buty", "tanie buty sklep", "buty damskie", "torebki sklep", "torebki damskie"], 3)) for _ in range(12)])
    nouns = cues(["香水 激安", "中古タイヤ 送料無料", "財布"] * 8)
    assert judge(strange, MODEL).share > 0.5 and judge(nouns, MODEL).share > 0.5
    monkeypatch.setattr(module, "regularity", lambda lines: 0.0)
    assert judge(strange, MODEL).share == 0 and judge(nouns, MODEL).share > 0.5  # known nouns without function words
    assert judge(nouns).share == 0


def test_regularity_counts_a_refrain_once():
    line = "come home the lamps are lit".split()
    assert regularity([line] * 30) < 0.35 and regularity([["yoga", "mat"], ["yoga", "mat", "price"], ["cheap", "yoga", "mat"], ["yoga", "mat", "sale"]]) > 0.35 and regularity([]) == 0.0


def test_words_are_learned_over_the_whole_corpus(spark):
    df = spark.createDataFrame([(lang.upper() + "-x", t) for lang, t in CORPUS] + [(None, "unlabelled"), ("en", None), ("??", "x")], "lang string, text string").repartition(5)
    got = learned(df)
    assert got.common == MODEL.common and got.known == MODEL.known and got.usual == pytest.approx(MODEL.usual)
    assert {"the", "you"} <= got.common["en"] and "не" in got.common["ru"] and "yoga" not in got.common["en"] and "yoga" in got.known
    assert learned(df.limit(0)).common == {} and learned(df.drop("lang"), lang=None).common.keys() == {"all"}
