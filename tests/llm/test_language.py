import numpy as np
import pytest

from cartomill.llm import language as lg

DATA = "/root/testdata/sf0.01"
EN = "The council has not yet said when the night market will be moved. You can reach the old harbour on foot within ten minutes."
DE = "Der Gemeinderat hat noch nicht gesagt, wann die Schule verlegt wird. Zu Fuß sind es ungefähr zehn Minuten bis dorthin."
RU = "Совет ещё не сказал, когда библиотека переедет ближе к городу. Пешком туда можно дойти за десять минут."


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet(f"{DATA}/lang_sample.parquet")


@pytest.fixture(scope="module")
def rows(samples):
    return [(r.lang, r.sample_text) for r in samples.orderBy("sample_id").collect()]


def test_held_out_accuracy(rows):
    right = total = 0
    for fold in range(4):
        model = lg.Model.fit([r for i, r in enumerate(rows) if i % 4 != fold])
        held = rows[fold::4]
        p = model.score([t for _, t in held])
        assert np.allclose(p.sum(axis=1), 1)
        right += sum(model.langs[q.argmax()] == lang for (lang, _), q in zip(held, p))
        total += len(held)
    assert right / total > 0.93


def test_spoilt_text_keeps_its_language(rows):
    model = lg.Model.fit(rows)
    texts = [RU.encode("cp1251").decode("latin-1"), RU.encode("utf-8").decode("cp1251", "replace"), DE.encode("utf-8").decode("latin-1"), DE.encode("latin-1").decode("utf-8", "replace")]
    assert [model.langs[q.argmax()] for q in model.score(texts)] == ["ru", "ru", "de", "de"]


def test_sentences_and_letters():
    assert lg.sentences("One. Two! «Three?» 四。五！") == ["One.", "Two!", "«Three?»", "四。", "五！"]
    assert lg.sentences("") == [] and lg.letters("東京") == 5 and lg.letters("a1 b") == 2


def test_pages(spark, samples):
    shared = "All rights reserved."
    docs = [
        (1, f"Home News\n{DE}\n{shared}", "de"), (2, f"Home News\n{DE}\n{shared}", "en"), (3, f"Home\n{EN} {RU}\n{shared}", "en"), (4, f"{EN}\n{shared}", None),
        (5, f"{EN}\n{shared}", " und "), (6, "", None), (7, None, "en"), (8, "123 456\n---", "en"), (9, f"{EN}\n{shared}", "EN_us"), (10, f"{EN} " * 400 + f"\n{shared}", "x-y"), (4, f"{EN}\n{shared}", None),
    ]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], "doc_id bigint, text string, lang string, label string, page_langs string")
    got = sorted(tuple(r) for r in lg.found(df, samples).collect())
    assert got == [(2, "de"), (3, "en"), (3, "ru"), (4, "en"), (4, "en"), (5, "en"), (10, "en")]
    segs = {(r.doc_id, r.segment_no): r for r in lg.segments(df, samples, whole=False).collect()}
    assert segs[(3, 1)].lang == "ru" and segs[(3, 1)].segment_text == RU and segs[(3, 0)].confidence > 0.9
    assert not any(k[0] in (6, 7, 8) for k in segs)
    assert lg.found(df.limit(0), samples).collect() == [] and lg.found(df, samples.limit(0)).collect() == []


#: Sentences of one page each, which share a menu, a footer and nothing else.
PAGES = [
    "The old mill by the river was sold to a young baker.", "Nobody knows who painted the large map in the station.", "Two ferries leave the northern pier every morning in summer.",
    "The library keeps letters that sailors wrote to their families.", "A narrow path leads from the church down to the lake.", "Most shops in the centre close early on market days.",
    "The bridge was closed after the storm damaged one pillar.", "Her grandfather built clocks in a workshop behind the school.",
]
MENU, FOOTER = "Home News Weather Contact", "Tous droits réservés à la rédaction de ce journal."


def corpus(spark, copies):
    pages = [*(f"{MENU}\n{PAGES[i]} {PAGES[i - 3]}\n{PAGES[i - 1]} {PAGES[i - 4]}\n{FOOTER}" for i in range(len(PAGES))), *copies]
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(pages)], "doc_id bigint, text string, lang string")


def test_copies_of_a_page_keep_their_lines(spark, samples):
    """A third of all pages are one page; equal, or with another line in each, short or the longest."""
    long = "It was last seen by the harbour master at noon on the day that the ships came in from the sea, it was said on day {}."
    for changed in ("", "Read {} times.", long):
        copied = [f"{MENU}\n{EN}\n{RU}\n{changed.format(i)}\n{FOOTER}" for i in range(5)]
        df = corpus(spark, copied)
        assert len(lg.shared_lines(lg.sketch(df, "text", None, []))) == 2
        assert sorted(map(tuple, lg.found(df, samples).collect())) == [(k, lang) for k in range(8, 13) for lang in ("en", "ru")]


def test_copies():
    many, size = np.array([9, 4, 2]), np.array([10, 30, 20])
    assert lg.copies(many, size, 40) == 4 and lg.copies(many, size, 1000) == 1 and lg.copies(many, size, 100) == 4 and lg.copies(many[2:], size[2:], 0) == 2
    assert lg.copies(many[:0], size[:0], 7) == 1


def test_one_certain_sentence_is_enough(spark, samples):
    df = spark.createDataFrame([(1, f"{EN} Sous la pluie tout change.", "en")], "doc_id bigint, text string, lang string")
    assert sorted(map(tuple, lg.found(df, samples).collect())) == [(1, "en"), (1, "fr")]


def test_no_line_with_letters_is_lost(spark, samples):
    """Whether a line ends as a sentence does or is a menu decides what is main content, not whether it has a segment."""
    lines = ["Der lange deutsche Text ohne Punkt in dieser Zeile", "Sous la pluie tout change.", "Ещё строка без точки о старом городе", "12 345", "Home"]
    df = spark.createDataFrame([(1, "\n".join(lines), "fr"), (2, "Home", None)], "doc_id bigint, text string, lang string")
    rows = sorted((r for r in lg.segments(df, samples).collect()), key=lambda r: (r.doc_id, r.segment_no))
    assert " ".join(r.segment_text for r in rows if r.doc_id == 1) == " ".join([*lines[:3], "Home"])
    assert [(r.lang, r.is_main) for r in rows if r.doc_id == 1][:3] == [("de", False), ("fr", True), ("ru", False)]
    assert {tuple(r.page_langs) for r in rows if r.doc_id == 1} == {("fr",)} and all(0 <= r.confidence <= 1 for r in rows)
    assert [r.is_main for r in rows if r.doc_id == 2] == [True]
    # as many pages as make every line shared: all lines still come out
    many = spark.createDataFrame([(i, "\n".join(lines), "fr") for i in range(1200)], "doc_id bigint, text string, lang string")
    got = lg.segments(many, samples).groupBy("doc_id").agg({"segment_text": "count"}).collect()
    assert len(got) == 1200


def test_languages_of_a_page_are_the_same_with_and_without_asides(spark, samples):
    df = corpus(spark, [f"{MENU}\n{EN}\n{RU}\n{FOOTER}", f"{MENU}\n{DE}"])
    of = lambda whole: {(r.doc_id, tuple(r.page_langs)) for r in lg.segments(df, samples, whole=whole).collect()}
    assert of(True) == of(False)
