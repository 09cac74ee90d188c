import random

import numpy as np

from cartomill.llm import entity_match as em

GEOM = "array<array<array<struct<x:double,y:double>>>>"


def test_close_pairs_against_brute_force():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(3, 9))) for _ in range(250)]
    words += [w[:2] + "x" + w[3:] for w in words[:100]] + ["", "a"]
    v = [em.vector(w) for w in words]
    lo, hi = (np.array([x[i] for x in v], dtype=np.uint64) for i in (0, 1))
    bits = [x[0] | x[1] << 64 for x in v]
    for chunks in (em.FAR_CHUNKS, em.NEAR_CHUNKS):
        a, b = em.close_pairs(lo, hi, lo, hi, chunks)
        got = set(zip(a.tolist(), b.tolist()))
        exp = {(i, j) for i in range(len(v)) for j in range(len(v)) if (bits[i] ^ bits[j]).bit_count() <= 2 * chunks - 1}
        assert got == exp
        # under tags: those of a row's own tag, or of one it also looks under
        filed, looked = np.array([i % 5 for i in range(len(v))]), np.array([i % 7 for i in range(len(v))])
        a, b = em.close_pairs(lo, hi, lo, hi, chunks, [looked, looked + 1], filed)
        assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in exp if filed[j] in (looked[i], looked[i] + 1)}


def test_fold():
    f = em.fold
    assert f("Landkreis Mohäszömbürg") == f("Mohaszomburg (Stadt)") == "mohaszomburg"
    assert f("город Сепакурноск") == "sepakurnosk" and f("ヴィラクサ市") == "virakusa" and f("格沃福区") == "格沃福"
    assert f("Ft. Palóku") == f("Fort Paloku") and f("Comune di Dáktégisval") == "daktegisval" and f(None) == f("") == ""
    known = {"hafolgorora", "XA"}
    assert em.display_name("Hafolgorora, Region X, Greater Y", known) == "Greater Y"
    assert em.display_name("77107 PEDI, X, XA", known) == "PEDI" and em.display_name("Name (Region), XA", known) == "Name"
    assert em.display_name(" ,; ", known) is None


def one_by_one(a, b):
    """Edits of two names by the plain recurrence."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_edits_against_the_recurrence():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcé東") for _ in range(rng.randrange(9)))
    pairs = [(word(), word()) for _ in range(400)] + [("", ""), ("", "abc"), ("ab", "ba"), ("a" * 40, "a" * 39 + "b"), ("x", "x")]
    assert em.edits(*map(list, zip(*pairs))).tolist() == [one_by_one(a, b) for a, b in pairs]
    assert em.edits([], []).tolist() == []


def similar(a, b):
    x, y = em.vector(a.lstrip(em.READ + em.SOUND)), em.vector(b.lstrip(em.READ + em.SOUND))
    common, size = sum((p & q).bit_count() for p, q in zip(x, y)), sum(v.bit_count() for v in (*x, *y))
    return float(em.similarities(np.array([a], object), np.array([b], object), np.array([2 * common / size if size else 0.0]))[0])


def test_similarity():
    assert similar("keturze", "ketuzre") > 0.6 and similar("alto mira", "basso mira") < 0.5 and similar("mira", "port mira") > 0.9 and similar("mira", "mira") == 1
    assert similar("virakusa", em.SOUND + "vilakusa") == 1 and similar("tikpa", em.READ + "tikpa") == 1 and similar("", "") == 1
    assert similar("a" * 300, "a" * 299 + "b") < 1  # very long names: by their bits


def test_score_is_a_weighted_mean_of_fields(spark):
    rows = [(1.0, 1.0, 0.0, 1), (1.0, 1.0, 4.0, 1), (1.0, 1.0, 0.0, 0), (0.5, 1.0, 0.0, 1), (1.0, 1.0, None, -1), (0.0, 1.0, 4.0, 0)]
    df = spark.createDataFrame(rows, "dice double, weight double, km double, same_country int")
    got = [r.s for r in df.select(em.score_column().alias("s")).collect()]
    w = em.FIELDS
    total = sum(w.values())
    exp = [total, total - w["place"], total - w["country"], total - 0.5 * w["name"], total - w["country"] * (1 - em.NO_COUNTRY) - w["place"] * (1 - em.NO_PLACE), 0.0]
    assert np.allclose(got, [x / total for x in exp])


def square(x, y, s=0.01):
    return [[[{"x": a, "y": b} for a, b in ((x - s, y - s), (x + s, y - s), (x + s, y + s), (x - s, y + s), (x - s, y - s))]]]


def tables(spark, cities, candidates, areas):
    c = "id bigint, name string, asciiName string, aliases array<string>, zhName string, countryCode string, lat double, lon double, key string, side int"
    k = f"id string, name string, displayName string, countryCode string, geometry {GEOM}, form string"
    a = f"areaId string, nameLocal string, aliases array<string>, nameZh string, sourceId string, countryCode string, centroid struct<x:double,y:double>, geometry {GEOM}"
    return (
        spark.createDataFrame([(*r, "clash", 7) for r in cities], c), spark.createDataFrame([(*r, "clash") for r in candidates], k),
        spark.createDataFrame(areas, a), spark.createDataFrame([("AA", "Aland"), ("BB", "Bland"), (None, None)], "countryCode string, countryName string"),
    )


CITIES = [
    (1, "Tikpänafeld", "Tikpanafeld", ["Тикпанафелд"], "蒂克帕", "AA", 10.0, 20.0), (2, "Tikpänafeld", "Tikpanafeld", None, None, "AA", 50.0, 20.0),
    (3, "Alto Rafam", "Alto Rafam", None, None, "AA", 10.01, 20.01), (4, "Gekmeto", "Gekmeto", [], None, "BB", 0.0, 179.999), (5, "Solo", "Solo", None, None, "BB", None, None),
    (6, None, None, None, None, None, 1.0, 1.0), (7, "Vermontal", "Vermontal", None, None, "BB", 5.0, 5.0), (1, "Tikpänafeld", "Tikpanafeld", ["Тикпанафелд"], "蒂克帕", "AA", 10.0, 20.0),
]


def test_found(spark):
    candidates = [
        ("same", "Tikpanafeld", "Tikpanafeld, X, Aland", "aa", square(20.0, 10.0)), ("typo", None, "Tikpnaafeld, X, Aland", None, square(20.0, 50.0)),
        ("cyr", None, "12345 Тикпанафелд, X, AA", "AA", square(20.0, 10.01)), ("basso", "Basso Rafam", "Basso Rafam, AA", "AA", square(20.01, 10.01)),
        ("line", "Gekmeto", None, "BB", square(-179.999, 0.0)), ("lost", "Vermontal", None, "BB", None), ("unclear", "Tikpanafeld", None, "AA", None),
        ("solo", "Solo", None, "bb", square(60.0, 60.0)), ("none", None, None, None, None), ("elsewhere", "Gekmeto", None, "AA", square(70.0, 0.0)), ("same", "Tikpanafeld", "Tikpanafeld, X, Aland", "aa", square(20.0, 10.0)),
    ]
    areas = [
        ("AA:o:1", "Landkreis Tikpänafeld", None, None, "1", "AA", {"x": 20.0, "y": 50.01}, None), ("AA:o:tikpanafeld-x1", "蒂克帕县", None, None, "tikpanafeld-x1", "AA", None, square(20.0, 10.0)),
        ("BB:o:2", None, None, None, "2", "BB", None, None),
    ]
    got = {tuple(r) for r in em.found(*tables(spark, CITIES, candidates, areas)).collect()}
    assert got == {
        (1, "candidate", "same"), (2, "candidate", "typo"), (1, "candidate", "cyr"), (4, "candidate", "line"), (7, "candidate", "lost"), (5, "candidate", "solo"),
        (2, "area", "AA:o:1"), (1, "area", "AA:o:tikpanafeld-x1"),
    }


def test_empty_tables(spark):
    t = tables(spark, CITIES, [], [])
    assert em.found(*t).collect() == []
    assert em.found(t[0].limit(0), t[1], t[2], t[3].limit(0)).collect() == []


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(em.nearby, "BLOCK", 3)
    monkeypatch.setattr(em.nearby, "CELL_ROWS", 4)
    cities = [(i, f"Place{chr(97 + i % 26)}{chr(97 + i // 26)}mark", f"Place{chr(97 + i % 26)}{chr(97 + i // 26)}mark", None, None, "AA", 1.0 + i, 2.0) for i in range(60)]
    candidates = [(str(i), c[1], None, "AA" if i % 2 else None, None if i % 3 == 0 else square(2.0, 1.0 + i)) for i, c in enumerate(cities)]
    got = {(r.city_id, r.other_id) for r in em.found(*tables(spark, cities, candidates, [])).collect()}
    assert got == {(i, str(i)) for i in range(60)}


def test_hot_country_is_parted_on_both_sides(spark, monkeypatch):
    """All records of one country, none located: both sides are cut into blocks, and every pair still meets."""
    monkeypatch.setattr(em.nearby, "BLOCK", 10)
    name = lambda i: f"Ge{chr(97 + i % 26)}{chr(97 + i // 26)}mork{chr(122 - i % 26)}"
    cities = [(i, name(i), name(i), None, None, "AA", None, None) for i in range(50)]
    candidates = [(str(i), name(i), None, "AA" if i % 2 else "", None) for i in range(50)]
    t = tables(spark, cities, candidates, [])
    rows = em.forms(*t).dropDuplicates(["side", "key", "form"])
    pairs = em._by_country(rows.where("side = 1").drop("located"), rows.where("side = 0").drop("located"))
    assert {(r.city, r.other) for r in pairs.collect()} >= {(str(i), str(i)) for i in range(50)}
    assert pairs.count() == pairs.dropDuplicates(["side", "city", "other"]).count()


def test_confidence_is_calibrated(spark):
    """Noisy copies of known places: matches of each range of confidence are right at least as often as it says, less a margin."""
    rng = random.Random(12)
    part = ["ka", "ri", "mo", "tel", "vas", "nu", "gor", "le", "pi", "dan", "sur", "bo"]
    cities, candidates, truth = [], [], {}
    for i in range(400):
        n = "".join(rng.choice(part) for _ in range(rng.choice([3, 4]))).title()
        y, x = rng.uniform(-50, 50), rng.uniform(-150, 150)
        cities.append((i, n, n, None, None, "AA", y, x))
        m = list(n)
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            m[rng.randrange(len(m))] = rng.choice("aeioukrt")
        there = i if rng.random() < 0.8 else None
        where = (x + rng.gauss(0, 0.01), y + rng.gauss(0, 0.01))
        if there is None:  # another place near by
            m = list("".join(rng.choice(part) for _ in range(3)).title())
        candidates.append((str(i), "".join(m), None, rng.choice(["AA", None]), None if rng.random() < 0.1 else square(*where)))
        truth[str(i)] = there
    rows = em.match(*tables(spark, cities, candidates, [])).collect()
    bins = {}
    for r in rows:
        bins.setdefault(min(int(r.confidence * 4), 3), []).append((r.confidence, truth[r.other_id] == r.city_id))
    for values in bins.values():
        said, right = np.mean([c for c, _ in values]), np.mean([ok for _, ok in values])
        assert len(values) < 8 or right >= said - 0.15, (said, right, len(values))
    sure = [ok for c, ok in bins[3]]
    assert len(sure) > 80 and np.mean(sure) > 0.95


def test_filed_vectors_against_brute_force():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 13))) for _ in range(300)]
    words += [w[:2] + "x" + w[3:] for w in words[:100]] + ["", "a", "ab cd", "东京", "东北", "京", "东京 ab"]
    v = [em.vector(w) for w in words]
    lo, hi = em.vectors_of(words)
    assert list(zip(lo.tolist(), hi.tolist())) == v
    bits = [x[0] | x[1] << 64 for x in v]
    a, b = em.Filed(lo, hi).pairs(lo, hi)
    exp = {(i, j) for i in range(len(v)) for j in range(len(v)) if (bits[i] ^ bits[j]).bit_count() <= em.FAR_BITS}
    assert set(zip(a.tolist(), b.tolist())) == exp and len(a) == len(exp)
    assert len(em.Filed(lo[:0], hi[:0]).pairs(lo, hi)[0]) == len(em.Filed(lo, hi).pairs(lo[:0], hi[:0])[0]) == 0


def test_a_common_name_without_a_place_sends_two_cities(spark):
    """Sixty cities and forty records of one name: each record gets the two cities of least id, not all sixty."""
    cities = [(i, "Gemork", "Gemork", None, None, "AA", None, None) for i in range(60)] + [(60 + i, f"Gemor{chr(97 + i)}", f"Gemor{chr(97 + i)}", None, None, "AA", None, None) for i in range(9)]
    candidates = [(str(i), "Gemork", None, "AA", None) for i in range(40)]
    rows = em.forms(*tables(spark, cities, candidates, [])).dropDuplicates(["side", "key", "form"])
    pairs = em._by_country(rows.where("side = 1").drop("located"), rows.where("side = 0").drop("located")).collect()
    assert sorted((r.other, r.city) for r in pairs) == sorted((str(i), c) for i in range(40) for c in "01")


def test_near_pairs_are_the_same_by_place_and_by_name(spark, monkeypatch):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice(["ka", "ri", "mo", "tel"]) for _ in range(3)).title()
    cities = [(i, n := name(), n, None, None, "AA", rng.uniform(0, 0.2), rng.choice([-1, 1]) * rng.uniform(179.9, 180)) for i in range(60)]
    candidates = [(str(i), name(), None, "AA", square(c[7], c[6], 0.0)) for i, c in enumerate(cities)]
    rows = em.forms(*tables(spark, cities, candidates, [])).toPandas()
    few = em._near(rows).sort_values(["other", "city"]).reset_index(drop=True)
    monkeypatch.setattr(em, "CROWD", -1)
    crowded = em._near(rows).sort_values(["other", "city"]).reset_index(drop=True)
    assert len(few) > 30 and few.equals(crowded)
