import random

import pytest

from cartomill.llm import streaming_bpe as sb

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def tables():
    return sb.read_tables()


@pytest.fixture(scope="module")
def reference(tables):
    ranks = {t: i for i, t in enumerate(tables.token_bytes) if t}
    return tiktoken.Encoding("own", pat_str=sb.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(5)
    kinds = ["abcdefghij", "ａのスト東京はがa", "      \n\t ab'lls", "=-_*#/.", "0123456789", "the in ing er on es", "äöüéñ", "αβγδжзий", "🙂👍‍", "́​\xa0"]
    for _ in range(1500):
        a = rng.choice(kinds) + rng.choice(kinds)
        n = rng.choice([0, 1, 3, 10, 50, 300, 2000])
        yield rng.choice(a) * n if rng.random() < 0.2 else "".join(rng.choice(a) for _ in range(n))
    yield "<|endoftext|> it's we've"
    yield "a" * 200_000 + " b"
    yield "東" * 70_000


def test_ids_equal_the_public_encoder(tables, reference):
    enc = sb.Encoder(tables)
    for t in texts():
        assert enc.encode(t) == reference.encode_ordinary(t), t[:80]


def test_small_blocks_windows_and_memo_change_nothing(tables, reference, monkeypatch):
    monkeypatch.setattr(sb, "BLOCK", 50)
    monkeypatch.setattr(sb, "MEMO", 5)
    enc = sb.Encoder(tables, window=1)
    for t in list(texts())[:400]:
        assert enc.encode(t) == reference.encode_ordinary(t), t[:80]


def test_stream_emits_what_whole_merging_gives(tables):
    enc = sb.Encoder(tables)
    rng = random.Random(6)
    for _ in range(40):
        data = "".join(rng.choice("aeinrst nthe東京ング") for _ in range(900)).encode()
        assert list(enc.stream(data)) == enc.merged(data)
    assert 10 < tables.lookahead < 1000


def test_decoder_joins_split_characters(tables):
    enc, dec = sb.Encoder(tables), sb.Decoder(tables)
    for t in list(texts())[:300]:
        assert "".join(dec.feed([i]) for i in enc.encode(t)) + dec.finish() == t


def test_frames(spark):
    rows = [(1, "ab", "x"), (2, "", "x"), (3, None, "x"), (1, "ab", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in sb.encode(df, "doc_id", "text").collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] and got[2][1] == [] and got[3][1] == []
    back = sb.decode(sb.encode(df, "doc_id", "text"), "doc_id", "ids")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "ab"), (1, "ab"), (2, ""), (3, "")]
    assert sb.encode(df.limit(0), "doc_id", "text").collect() == []
    assert sorted(r.n_tokens for r in sb.count_tokens(df, "doc_id", "text").collect()) == [0, 0, 1, 1]


def test_ids_are_sent_on_in_bounded_pieces(tables, reference, spark):
    rows = [(i, "one two three " * 30_000 if i % 3 == 0 else "four" if i % 3 == 1 else None) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id int, text string").coalesce(1)
    got = {r.doc_id: r.ids for r in sb.encode(df, "doc_id", "text").collect()}
    assert len(got) == 12 and all(got[i] == (reference.encode_ordinary(t) if t else []) for i, t in rows)
