import pytest

from cartomill.llm import plain_text as pt

PLAIN = ["São Paulo", "Καλαμάτα", "Москва", "東京", "ギドクノヴォ市", "Nefiko村", "Villa 米恩穆 K9", "O'Brien-Ñandú", "", "łódź"]
CASES = {
    "Ｄａｐｅｋｏｇá": "Dapekogá", "Kárand": "Kárand", "Kumu⁣ko‎ov": "Kumukoov", "Old\xa0Kike": "Old Kike", "a　b c": "a b c",
    "Zefоmha": "Zefomha", "Рипaкас": "Рипакас", "Κοkvakhe": "Kokvakhe", "ﾚｿﾌｧ": "レソファ", "フィデ": "フィデ", "Λιε​́": "Λιέ",
    "Port Ζamámеfiνal": "Port Zamámefival", "ﬁn": "fin", "Nếs": "Nếs", "泽福": "泽福", "a\tb": "a b", "﻿": "", "Χεμγoγύλoς": "Χεμγογύλος",
}


@pytest.fixture(scope="module")
def rewriter():
    counts = {}
    for t in [*PLAIN, *CASES, *CASES.values()]:
        for u in pt.units(t):
            counts[u] = counts.get(u, 0) + 1
    return pt.Rewriter(pt.build(counts), {"LATIN": 9, "CYRILLIC": 3, "GREEK": 2})


def test_plain_text_stays(rewriter):
    for t in PLAIN:
        assert rewriter.plain(t) == t and not rewriter.is_case(t, t)
    assert rewriter.plain(None) is None and not rewriter.is_case(None, None) and rewriter.look(None) is None and rewriter.look("") == ""


def test_cases(rewriter):
    for t, plain in CASES.items():
        assert rewriter.plain(t) == plain, ascii(t)
        assert rewriter.is_case(t, rewriter.plain(t)) and not rewriter.is_case(plain, rewriter.plain(plain))


def test_unseen_characters_and_long_texts(rewriter):
    assert rewriter.plain("x\U000e0101y⁡") == "xy"
    assert rewriter.plain("ẹ́̂́" * 1000) == rewriter.plain("ẹ́̂́") * 1000
    assert rewriter.plain(("Ｗｏｒｄ​ " * 20_000)) == "Word " * 20_000


def test_classes_are_transitive():
    t = pt.build({"ё": 1, "ë": 1, "ｅ": 1})
    group = next(v for v in t.classes.values() if "ё" in v)
    assert "ë" in group and t.letters[("ё", "LATIN")] == "ë"
    assert "ｅ" in next(v for v in t.classes.values() if "е" in v)


def test_frequency_chooses_the_representative():
    # two Cyrillic letters have the shape of Y: the corpus says which one a Latin Y in a Cyrillic word was
    for often, seldom in (("У", "Ү"), ("Ү", "У")):
        t = pt.build({often: 9, seldom: 1, "Y": 3})
        assert t.letters[("Y", "CYRILLIC")] == often and t.looks["Y"] == often
        assert pt.Rewriter(t, {"CYRILLIC": 9, "LATIN": 1}).plain("ДомYют") == f"Дом{often}ют"
    # the representative of all scripts follows the counts, too
    assert pt.build({"a": 9, "а": 1}).looks == {**pt.build({"a": 9, "а": 1}).looks, "а": "a"}
    assert pt.build({"a": 1, "а": 9}).looks["a"] == "а"


def test_rewrites_come_from_the_classes():
    t = pt.build({u: 1 for text in [*PLAIN, *CASES] for u in pt.units(text)})
    where = {m: k for k, v in t.classes.items() for m in v}
    assert t.rewrites and all(where[a] == where[b] for a, b in t.rewrites.items())
    assert all(where[a] == where[b] for (a, _), b in t.letters.items()) and all(where[a] == where[b] for a, b in t.looks.items())


def test_names_of_one_script_each_that_look_alike_share_a_look(spark):
    df = spark.createDataFrame([("1", "Сора"), ("2", "Copa"), ("3", "ＣＯＰＡ"), ("4", "Copan"), ("5", None)], "k string, t string")
    rows = {r.k: r for r in pt.rewrite(df, ["k"], "t").collect()}
    assert rows["1"].look == rows["2"].look == rows["3"].look != rows["4"].look and rows["5"].look is None
    assert rows["1"].plain == "Сора" and not rows["1"].is_case and not rows["2"].is_case and rows["3"].is_case


def test_frames(spark):
    c = spark.createDataFrame([(1, ["a", "Ａ", None], "東​京", "x"), (1, ["a", "Ａ", None], "東​京", "x"), (2, None, None, "x"), (3, [], "", "x")], "id bigint, aliases array<string>, zhName string, text string")
    a = spark.createDataFrame([("A", "Stаdt"), ("B", None), ("C", "Stadt")], "areaId string, nameLocal string")
    assert sorted(tuple(r) for r in pt.found(c, a).collect()) == [("area", "A", "nameLocal"), ("city", "1", "aliases"), ("city", "1", "zhName")]
    assert pt.found(c.limit(0), a.limit(0)).collect() == []
    rows = {(r.record_key, r.text): r.plain for r in pt.rewrite(pt.fields(c, a), ["record_key"], "text").collect()}
    assert rows[("1", "Ａ")] == "A" and rows[("A", "Stаdt")] == "Stadt" and rows[("2", None)] is None and rows[("3", "")] == ""
