import random
from datetime import datetime

from pyspark.sql import functions as F

from cartomill.operators import snapshot_changes as sc

SCHEMA = "k string, r string, t timestamp, v string, w int, _key string, release string"


def run(spark, rows, **options):
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], SCHEMA)
    out = sc.changes(df, "k", "r", "t", [F.col("v"), F.col("w")], **options)
    return sorted((x.release, x.key, x.change_kind) for x in out.collect())


def brute(rows):
    releases = sorted({x[1] for x in rows if x[1] is not None}, key=lambda r: (r.split(".")[0], int(r.split(".")[1])))
    state = {r: {} for r in releases}
    for k, r, t, v, w in rows:
        if k is not None and r is not None and (k not in state[r] or t > state[r][k][0]):
            state[r][k] = (t, v, w)
    out = []
    for a, b in zip(releases, releases[1:]):
        for k in state[a].keys() | state[b].keys():
            if k not in state[a]:
                out.append((b, k, "added"))
            elif k not in state[b]:
                out.append((b, k, "removed"))
            elif state[a][k][1:] != state[b][k][1:]:
                out.append((b, k, "changed"))
    return sorted(out)


def test_random_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for release in ("2026-01-01.2", "2026-01-01.10", "2026-02-01.0"):  # .10 follows .2
        for i in range(900):
            if rng.random() < 0.95:
                value = rng.choice(["x", None]) if rng.random() < 0.1 else f"v{i}"
                rows.append((f"K{i:04}", release, datetime(2026, 1, 1, rng.randrange(23)), value, rng.choice([1, 1, 1, None])))
    rows += rows[:50]  # repeated rows
    rows += [(None, "2026-02-01.0", datetime(2026, 1, 1), "x", 1), ("K0001", None, datetime(2026, 1, 1), "x", 1)]
    assert run(spark, rows, chunk_rows=8) == brute(rows)
    assert run(spark, rows, chunk_rows=8, chunks=5, span=1) == brute(rows)
    assert run(spark, rows) == brute(rows)


def test_many_boundaries_in_several_lists(spark, monkeypatch):
    monkeypatch.setattr(sc, "INNER", 4)
    rows = [(f"K{i:04}", r, datetime(2026, 1, 1), f"{i}{r if i % 37 == 0 else ''}", 1) for i in range(600) for r in ("2026-01-01.0", "2026-01-02.0")]
    assert run(spark, rows, chunk_rows=2) == brute(rows)
    keys = sorted({x[0] for x in rows})
    df = spark.createDataFrame([(k,) for k in keys], "_key string")
    bounds = keys[3::7]
    got = {r._key: r._chunk for r in sc._with_chunk(df, bounds).collect()}
    assert got == {k: sum(b <= k for b in bounds) for k in keys}


def test_only_chunks_that_differ_are_joined(spark):
    """Of two equal deliveries nothing is left; one changed row leaves its own chunk, a repeated key its chunk too."""
    def masks(rows):
        df = sc._rows(spark.createDataFrame([(*x, "c", "c") for x in rows], SCHEMA), "k", "r", "t", [F.col("v"), F.col("w")])
        placed = sc._with_chunk(df.withColumn("_pos", F.when(F.col("_release") == "2026-01-01.0", 0).otherwise(1)), [f"K{i:04}" for i in range(0, 1000, 20)])
        return sorted((r._chunk, r._mask) for r in sc.unmatched_chunks(placed, 2).collect())

    t = datetime(2026, 1, 1)
    same = [(f"K{i:04}", r, t, f"v{i}", 1) for i in range(1000) for r in ("2026-01-01.0", "2026-01-01.1")]
    assert masks(same) == []
    changed = [(k, r, t, "other" if (k, r) == ("K0500", "2026-01-01.1") else v, w) for k, r, t, v, w in same]
    assert masks(changed) == [(26, 2)]
    assert masks(same + [("K0020", "2026-01-01.1", t, "v20", 1)]) == [(2, 2)]
    added = [*same, ("K0020x", "2026-01-01.1", t, "v", 1)]
    assert masks(added) == [(2, 2)]


def test_a_key_that_repeats_without_end(spark):
    rows = [("a", r, datetime(2026, 1, 1, 0, i // 60, i % 60), f"v{i}", i) for i in range(500) for r in ("2026-01-01.0", "2026-01-01.1")] + [("b", "2026-01-01.1", datetime(2026, 1, 1), "x", 1)]
    assert run(spark, rows) == brute(rows) == [("2026-01-01.1", "b", "added")]


def test_latest_row_counts_however_late(spark):
    rows = [
        ("a", "2026-01-01.0", datetime(2026, 1, 1), "x", 1),
        ("a", "2026-01-01.1", datetime(2026, 5, 1), "y", 1),
        ("a", "2026-01-01.1", datetime(2026, 1, 2), "x", 1),
    ]
    assert run(spark, rows) == [("2026-01-01.1", "a", "changed")]


def test_first_release_and_empty_table_give_nothing(spark):
    assert run(spark, [("a", "2026-01-01.0", datetime(2026, 1, 1), "x", 1)]) == []
    assert run(spark, []) == []


def test_null_values_equal_and_swapped_values_differ(spark):
    t = datetime(2026, 1, 1)
    rows = [("a", "2026-01-01.0", t, None, None), ("a", "2026-01-01.1", t, None, None)]
    assert run(spark, rows) == []
    out = sc.changes(
        spark.createDataFrame([("a", "2026-01-01.0", t, None, "1"), ("a", "2026-01-01.1", t, "1", None)], "k string, r string, t timestamp, v string, w string"),
        "k", "r", "t", [F.col("v"), F.col("w")],
    )
    assert [x.change_kind for x in out.collect()] == ["changed"]
