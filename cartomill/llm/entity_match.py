"""Matching records of several sources that describe one place and share no key.

Every spelling of a record's name, folded to plain Latin or Han text, becomes a fixed
vector of ``BITS`` bits, one per hashed q-gram. Records with a place meet in cubes of
``REACH_KM``, and all pairs up to 15 bits apart are found; where a place is crowded, by
multi-index hashing: two vectors at most 2 * chunks - 1 bits apart agree in some chunk
but for one bit, and share that chunk or the chunk with one set bit removed. Where a
place is unknown, vectors up to 7 bits apart are found exactly by the subsets of bits
that they must have in common (``Filed``). Pairs are scored by the weighted mean of the
Dice scores of three fields (``FIELDS``): the name, by its bits and the letters
unchanged; the country code; the place, which is 1 at no distance and 0 at ``REACH_KM``.
Scores become confidences by a logistic curve fitted on this run's own best and
second-best pairs.

Scale: located records meet in k-d cells with a halo of ``REACH_KM``, one shuffle of
narrow rows. Without a place a score depends on spellings alone: each distinct spelling
of a country asks once, in blocks of both sides, and is answered with its two best
cities, as no other can count. Names are compared letter by letter only while they can
still be among those. The work there still grows with the product of distinct spellings,
at a small rate. The driver sees a sample for the splits, counts of heavy cells, the
country codes and a histogram of scores.
"""

from __future__ import annotations

import gc
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartomill import runtime
from cartomill.functions.kdtree import assign, fit_cells
from cartomill.operators import nearby

BITS, REACH_KM = 128, 4.0
#: Chunks of the index where places agree (15 bits apart at most), and where no place is known (7).
NEAR_CHUNKS, FAR_CHUNKS = 8, 4
FAR_BITS, FEW = 2 * FAR_CHUNKS - 1, 7
#: Names of both scripts that readings are learnt from at most; marks of a form that is a
#: reading of Han, and of one that was written in kana.
READ_ROWS, READ, SOUND = 3_000, "~", "="
#: Least confidence of a match.
CONFIDENT = 0.5
#: Weights of the fields' Dice scores; scores of a country and a place that one side lacks.
FIELDS = {"name": 1.0, "country": 0.25, "place": 0.2}
NO_COUNTRY, NO_PLACE = 0.92, 0.1
#: Where the curve's middle and slope are drawn to while pairs are few, and how strongly.
PRIOR_SLOPE, PRIOR_MIDDLE = 29.0, 0.738
#: Letters beyond which names are compared by their bits alone.
LONG = 256

#: Pairs compared at once. Meetings a row of neighbouring cubes above which names are looked up in an index.
MEETINGS, CROWD = 2_000_000, 2_000
#: Spellings without a place that are compared at once.
ASK_ROWS = 10_000
#: Blocks of ``nearby`` that make one where places are unknown, as rows are narrow there.
FAR_BLOCKS = 4

#: Letters of other scripts in Latin.
LATIN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяѕіјԁԛԝ", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch . y . e iu ia s i j d q w".split()))
LATIN |= dict(zip("αβγδεζηθικλμνξοπρσςτυφχψω", "a v g d e z i th i k l m n x o p r s s t y f ch ps o".split()))
LATIN |= {"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "a", "œ": "o", "ð": "d", "þ": "th", "ı": "i", "ο": "o"}
LATIN = {k: "" if v == "." else v for k, v in LATIN.items()}
#: Katakana rows in the order of the vowels a i u e o, by consonant.
KANA_ROWS = {
    "": "アイウエオ", "k": "カキクケコ", "s": "サシスセソ", "t": "タチツテト", "n": "ナニヌネノ", "h": "ハヒフヘホ", "m": "マミムメモ",
    "r": "ラリルレロ", "g": "ガギグゲゴ", "z": "ザジズゼゾ", "d": "ダヂヅデド", "b": "バビブベボ", "p": "パピプペポ",
}
KANA = {ch: c + v for c, row in KANA_ROWS.items() for ch, v in zip(row, "aiueo")} | {"フ": "fu", "ヤ": "ya", "ユ": "yu", "ヨ": "yo", "ワ": "va", "ヲ": "o", "ン": "n", "ヴ": "vu", "ッ": "", "ー": ""}
SMALL = dict(zip("ァィゥェォ", "aiueo"))
#: Words for a kind of place, which are no part of its name.
KINDS = set(
    "stadt landkreis gemeinde kreis municipio comune obec gmina miasto dimos koinotita gorod okrug raion kommun kommune concelho cidade xa thanh pho "
    "town city greater region republic county province district municipality village okres powiat".split()
)
#: Short forms.
SHORT = {"ft": "fort", "st": "saint", "mt": "mount", "sta": "santa", "sto": "santo", "pt": "port"}
JOINERS = set("of de di da do del della".split())
HAN_KINDS = "市区县町村省州镇乡"
_NUMBER = re.compile(r"\d+")
_KANA, _KANA_LETTER = re.compile("[ァ-ヿ]"), re.compile("[ァ-ヺ]")
_CODE, _BRACKETS = re.compile(r" [a-z]\d$"), re.compile(r"\(.*?\)")
_WORD = re.compile(r"[a-z0-9]+|[⺀-鿿]+")


@lru_cache(65_536)
def _plain(c: str) -> str:
    """A decomposed character in Latin or as it is; marks and invisible ones are nothing."""
    return "" if unicodedata.combining(c) or unicodedata.category(c) == "Cf" else LATIN.get(c, c)


def latin_kana(text: str) -> str:
    out: list[str] = []
    for ch in text:
        if ch in SMALL and out and out[-1]:
            out[-1] = (out[-1][:-1] or "v") + SMALL[ch]
        else:
            out.append(KANA.get(ch, SMALL.get(ch, ch)))
    return "".join(out)


def fold(text: str | None) -> str:
    """Plain words of a name: no marks, no case, Latin letters or Han, no kinds of place."""
    if not text:
        return ""
    if text.isascii():
        text = text.lower()
    else:
        text = unicodedata.normalize("NFKC", text)
        if _KANA.search(text):
            text = latin_kana(text)
        text = unicodedata.normalize("NFKD", text).lower()
        text = "".join([_plain(c) for c in text])
    words = _WORD.findall(text)
    kept = []
    for i, w in enumerate(words):
        if w in KINDS or (w in JOINERS and i and words[i - 1] in KINDS):
            continue
        if w[0] > "⺀":
            if len(words) > 1 and not w.strip(HAN_KINDS):
                continue
            w = w.rstrip(HAN_KINDS) or w
        elif not w.isdigit():
            w = SHORT.get(w, w) if len(words) > 1 else w
            w = w.replace("ae", "a").replace("oe", "o").replace("ue", "u")
        kept.append(w)
    return " ".join(kept or words)


def _is_han(text: str) -> bool:
    return bool(text) and all("⺀" < c <= "鿿" for c in text)


def learn_readings(pairs: list[tuple[str, str]], rounds: int = 3) -> dict[str, str]:
    """Latin reading of each Han character from (Latin name, Han name) of the same places.

    Characters are read in order, each as one to three letters; letters between may be
    skipped, and the end of the Latin name may be left out. Counts start from all
    letters near a character's place and are sharpened by best alignments.
    """
    pairs = [(a.replace(" ", ""), h) for a, h in pairs if a and len(h) >= 2]
    counts: dict[str, dict[str, float]] = {}
    for a, h in pairs:
        for i, c in enumerate(h):
            own = counts.setdefault(c, {})
            middle = min(2.0 * i, len(a) - 2)
            for start in range(max(0, int(middle) - 1 - i // 2), min(len(a), int(middle) + 2 + i // 2)):
                for n in (1, 2, 3):
                    if start + n <= len(a):
                        seg = a[start : start + n]
                        # consonant and vowel make a syllable
                        own[seg] = own.get(seg, 0.0) + (1.0 if n == 2 else 0.3) / (1 + abs(start - middle))
    for _ in range(rounds):
        log = {c: (own, np.log(sum(own.values()) + 1.0)) for c, own in counts.items()}
        fresh: dict[str, dict[str, float]] = {}
        for a, h in pairs:
            # best[j]: score of the characters so far ending at letter j, with the way there
            best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
            for c in h:
                own, total = log[c]
                step: dict[int, tuple[float, tuple]] = {}
                for j, (score, way) in best.items():
                    for skip in (0, 1):
                        for n in (1, 2, 3):
                            k = j + skip + n
                            if k > len(a):
                                break
                            seg = a[j + skip : k]
                            got = score - 2.5 * skip + np.log(own.get(seg, 0.0) + 0.05) - total + 1.2 * n
                            if k not in step or got > step[k][0]:
                                step[k] = (got, (*way, (c, seg)))
                best = step
                if not best:
                    break
            if best:
                for c, seg in max(best.values())[1]:
                    own = fresh.setdefault(c, {})
                    own[seg] = own.get(seg, 0.0) + 1.0
        counts = fresh
    return {c: max(own, key=lambda x: (own[x], x)) for c, own in counts.items() if sum(own.values()) >= 3}


def without_code(name: str) -> str:
    """A folded name without a trailing letter-and-digit code."""
    return _CODE.sub("", name)


def display_name(text: str | None, countries: set[str]) -> str | None:
    """The place's part of an address line: first, or last where the country comes first; no post code."""
    if not text:
        return None
    text = unicodedata.normalize("NFKC", text)
    parts = [p.strip() for p in re.split(r"[,;、|/]", text) if p.strip()]
    if not parts:
        return None
    is_country = lambda p: fold(p) in countries or fold(p).upper() in countries
    pick = parts[-1] if len(parts) > 1 and is_country(parts[0]) else parts[0]
    pick = re.sub(r"\(.*?\)", " ", pick)
    pick = re.sub(r"^\s*\d{4,6}\s+|\s+\d{4,6}\s*$", " ", pick)
    return pick.strip() or parts[0]


@lru_cache(65_536)
def _bit(gram: str) -> int:
    return 1 << (zlib.crc32(gram.encode()) * 2654435761 % (1 << 32) >> 25)


def vector(name: str) -> tuple[int, int]:
    """Bits of the q-grams: pairs of letters, and single characters of Han."""
    bits = 0
    for word in name.split():
        if word[0] > "⺀":
            items = list(word) + [word[i : i + 2] for i in range(len(word) - 1)]
        else:
            w = f"^{word}$"
            items = [w[i : i + 2] for i in range(len(w) - 1)]
        for g in items:
            bits |= _bit(g)
    return bits & (2**64 - 1), bits >> 64


def vectors_of(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``vector`` of many names, as arrays of the low and the high word."""
    out = np.zeros((2, len(names)), np.uint64)
    plain = [i for i, name in enumerate(names) if name.isascii() and name.strip()]
    for i in set(range(len(names))).difference(plain):
        out[:, i] = vector(names[i])
    # pairs of letters of all names at once; each word stands between its marks
    marked = ["^" + "$^".join(names[i].split()) + "$" for i in plain]
    if marked:
        letters = np.frombuffer("".join(marked).encode("ascii"), np.uint8).astype(np.int64)
        grams = letters[:-1] << 8 | letters[1:]
        ends = np.cumsum([len(m) for m in marked])
        of = np.repeat(np.arange(len(marked)), np.diff(ends, prepend=0))[:-1]
        kept = letters[:-1] != ord("$")
        grams, of = grams[kept], of[kept]
        table = np.zeros((2, 1 << 16), np.uint64)
        for g in np.unique(grams):
            bit = _bit(chr(g >> 8) + chr(g & 255))
            table[:, g] = bit & (2**64 - 1), bit >> 64
        first = np.flatnonzero(np.diff(of, prepend=-1))
        for word in (0, 1):
            out[word, plain] = np.bitwise_or.reduceat(table[word][grams], first)
    return out[0], out[1]


def chunk_keys(hi: np.ndarray, lo: np.ndarray, chunks: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every chunk as it is and with one set bit removed; keys differ by chunk."""
    width = BITS // chunks
    rows, keys = [], []
    idx = np.arange(len(lo))
    for c in range(chunks):
        at = c * width
        source, shift = (lo, at) if at < 64 else (hi, at - 64)
        value = (source >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tag = np.uint64(c << 40)
        rows.append(idx), keys.append(value | tag)
        for b in range(width):
            has = (value >> np.uint64(b)) & np.uint64(1) == 1
            rows.append(idx[has]), keys.append((value[has] ^ np.uint64(1 << b)) | tag)
    return np.concatenate(rows), np.concatenate(keys)


def _distinct(keys: np.ndarray) -> np.ndarray:
    """In order, without repeats."""
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=-1) != 0]


def _apart(a_lo, a_hi, b_lo, b_hi, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a_lo[a] ^ b_lo[b]) + np.bitwise_count(a_hi[a] ^ b_hi[b])


def close_pairs(a_lo, a_hi, b_lo, b_hi, chunks: int, a_tag=None, b_tag=None) -> tuple[np.ndarray, np.ndarray]:
    """All (a, b) at most 2 * chunks - 1 bits apart (of equal tags): multi-index Hamming hashing.

    a_tag: list of tag arrays a row is looked up under; b_tag: the one it is filed under.
    """
    reach = 2 * chunks - 1
    none = np.empty(0, np.int64)
    if not len(a_lo) or not len(b_lo):
        return none, none
    br, bk = chunk_keys(b_hi, b_lo, chunks)
    mix = lambda key, tag: (key ^ (tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    if b_tag is not None:
        bk = mix(bk, b_tag[br])
    order = np.argsort(bk, kind="stable")
    br, bk = br[order], bk[order]
    ar0, ak0 = chunk_keys(a_hi, a_lo, chunks)
    found = []
    filed = None if b_tag is None else np.unique(b_tag)
    for tag in a_tag if a_tag is not None else [None]:
        ar, ak = ar0, ak0
        if tag is not None:
            # rows that look where nothing is filed are left out before their keys are made
            at = np.minimum(np.searchsorted(filed, tag), len(filed) - 1)
            own = (filed[at] == tag)[ar0]
            ar = ar0[own]
            ak = mix(ak0[own], tag[ar])
        first, last = np.searchsorted(bk, ak, "left"), np.searchsorted(bk, ak, "right")
        n = last - first
        hit = np.nonzero(n)[0]
        at = 0
        ends = np.cumsum(n[hit])
        while at < len(hit):  # pieces of bounded size; nothing is left out
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 3_000_000, "right")))
            h = hit[at:stop]
            reps = n[h]
            off = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            a, b = np.repeat(ar[h], reps), br[np.repeat(first[h], reps) + off]
            near = _apart(a_lo, a_hi, b_lo, b_hi, a, b) <= reach
            found.append(_distinct(a[near].astype(np.int64) * len(b_lo) + b[near]))
            at = stop
    pairs = _distinct(np.concatenate(found)) if found else none
    return pairs // len(b_lo), pairs % len(b_lo)


#: A number for each bit; the key of a set of bits is theirs under exclusive or.
_NUMBERS = np.random.default_rng(7).integers(1, 1 << 63, BITS, dtype=np.uint64)


class Filed:
    """Vectors filed by their subsets of bits: all pairs at most FAR_BITS apart are found, few others are compared.

    Sets of x and y bits at most t apart have r = x - (t + x - y) // 2 bits in common, and
    so a subset of r bits. Vectors of up to FEW bits are filed whole, with t = FAR_BITS;
    of two others one half of the vector is at most FAR_BITS // 2 apart, with t so.
    """

    def __init__(self, lo: np.ndarray, hi: np.ndarray):
        self.lo, self.hi = lo, hi
        bits = np.unpackbits(np.ascontiguousarray(np.stack([lo, hi], axis=1)).view(np.uint8), axis=1, bitorder="little") if len(lo) else np.zeros((0, BITS), np.uint8)
        few = bits.sum(axis=1) <= FEW
        self.parts = {}
        for part, (rows, at, to) in {
            "short": (few, 0, BITS), "low": (~few, 0, 64), "high": (~few, 64, BITS), "short low": (few, 0, 64), "short high": (few, 64, BITS),
        }.items():
            rows = np.flatnonzero(rows)
            own = bits[rows, at:to]
            size = own.sum(axis=1)
            by_size = {}
            for n in np.unique(size):
                of = rows[size == n]
                places = np.nonzero(own[size == n])[1].reshape(len(of), n) + at
                by_size[int(n)] = (of, _NUMBERS[places])
            self.parts[part] = by_size
        self.sorted: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, part: str, n: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, keys) of all subsets of r bits of the sets of n bits."""
        rows, numbers = self.parts[part][n]
        whole = np.bitwise_xor.reduce(numbers, axis=1)
        short = r <= n - r
        found = []
        for kept in combinations(range(n), min(r, n - r)):
            key = np.zeros_like(whole) if short else whole.copy()
            for c in kept:
                key ^= numbers[:, c]
            found.append(key)
        return np.tile(rows, len(found)), np.concatenate(found)

    def in_order(self, part: str, n: int, r: int) -> tuple[np.ndarray, np.ndarray]:
        if (part, n, r) not in self.sorted:
            rows, keys = self.keys(part, n, r)
            order = np.argsort(keys)
            self.sorted[part, n, r] = rows[order], keys[order]
        return self.sorted[part, n, r]

    def pairs(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (asking row, filed row) at most FAR_BITS apart."""
        asking, found = Filed(lo, hi), []
        half = FAR_BITS // 2
        for mine, theirs, t in (
            ("short", "short", FAR_BITS), *((a + part, b + part, half) for part in ("low", "high") for a, b in (("", ""), ("short ", ""), ("", "short "))),
        ):
            for x in asking.parts[mine]:
                made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
                for y in self.parts[theirs]:
                    if abs(x - y) > t:
                        continue
                    r = max(0, x - (t + x - y) // 2)
                    if r not in made:
                        made[r] = asking.keys(mine, x, r)
                    (ar, ak), (br, bk) = made[r], self.in_order(theirs, y, r)
                    first = np.searchsorted(bk, ak, "left")
                    n = np.searchsorted(bk, ak, "right") - first
                    for a, b in _ranges(n, first):
                        a, b = ar[a], br[b]
                        near = _apart(lo, hi, self.lo, self.hi, a, b) <= FAR_BITS
                        found.append(_distinct(a[near].astype(np.int64) * len(self.lo) + b[near]))
        pairs = _distinct(np.concatenate(found)) if found else np.empty(0, np.int64)
        return pairs // max(1, len(self.lo)), pairs % max(1, len(self.lo))


def _ranges(n: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, first[i] + 0 to n[i] - 1) of all i, in pieces of about MEETINGS."""
    hit = np.flatnonzero(n)
    ends = np.cumsum(n[hit])
    at = 0
    while at < len(hit):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + MEETINGS, "right")))
        h = hit[at:stop]
        reps = n[h]
        off = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        yield np.repeat(h, reps), np.repeat(first[h], reps) + off
        at = stop


#: Words and word parts that tell neighbours of one name apart.
TELLING = "alto basso ober unter upper lower nord sud norte sur north south east west ost este oeste novo nova nueva new old stary staro stara alt neu gross klein grand petit".split()
#: Words that a short name leaves out.
DROPPED = "bad port fort san santa santo saint sankt mount monte villa".split()
_TELL_PREFIX = re.compile(r"^(ober|unter|novo|staro|nova|stara|neu|alt)(?=[a-z]{4})")


def telling(name: str) -> frozenset[str]:
    words = name.split()
    out = {w for w in words if w in TELLING}
    for w in words:
        if w not in TELLING and (m := _TELL_PREFIX.match(w)):
            out.add(m.group(1))
    return frozenset(out)


def _cut(df: DataFrame) -> DataFrame:
    """``runtime.cut``; the shuffle files that led to it go at once, not when the driver happens to collect its garbage."""
    made = runtime.cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return made


FORMS = "side int, key string, form string, weight double, lo bigint, hi bigint, country string, lat double, lon double"


def forms(cities: DataFrame, candidates: DataFrame, areas: DataFrame, countries: DataFrame) -> DataFrame:
    """One row per record and distinct spelling: side 0 the gazetteer, 1 candidates, 2 areas.

    The place of a candidate is the middle of its geometry's box, of an area its
    centroid or else the middle of its box. Names: weight 1 for the record's own name,
    less for aliases. Records without any name have no row.
    """
    names = {r[0] for r in countries.select("countryCode").collect() if r[0]} | {
        fold(r[0]) for r in countries.select("countryName").collect() if r[0]
    }
    x = F.transform(F.flatten(F.flatten("geometry")), lambda p: p["x"])
    y = F.transform(F.flatten(F.flatten("geometry")), lambda p: p["y"])
    spread = F.array_max(x) - F.array_min(x)
    # a box wider than half the globe crosses the antimeridian
    x = F.when(spread > 180, F.transform(x, lambda v: F.when(v < 0, v + 360).otherwise(v))).otherwise(x)
    mid_x, mid_y = (F.array_max(x) + F.array_min(x)) / 2, (F.array_max(y) + F.array_min(y)) / 2
    mid_x = F.when(mid_x > 180, mid_x - 360).otherwise(mid_x)
    null = F.lit(None).cast("string")
    one = cities.where("id IS NOT NULL").select(
        F.lit(0).alias("side"), F.col("id").cast("string").alias("key"), F.array("name", "asciiName").alias("own"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("zhName")).alias("other"),
        null.alias("line"), F.nullif(F.upper("countryCode"), F.lit("")).alias("country"), "lat", "lon",
    )
    two = candidates.where("id IS NOT NULL").select(
        F.lit(1).alias("side"), F.col("id").alias("key"), F.array("name").alias("own"), F.array().cast("array<string>").alias("other"),
        F.col("displayName").alias("line"), F.nullif(F.upper("countryCode"), F.lit("")).alias("country"), mid_y.alias("lat"), mid_x.alias("lon"),
    )
    slug = F.regexp_extract(F.coalesce("sourceId", F.lit("")), r"\A([a-z]{4,})-[0-9a-z]{1,6}\z", 1)
    three = areas.where("areaId IS NOT NULL").select(
        F.lit(2).alias("side"), F.col("areaId").alias("key"), F.array("nameLocal").alias("own"),
        F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array(F.col("nameZh"), F.nullif(slug, F.lit("")))).alias("other"),
        null.alias("line"), F.nullif(F.upper("countryCode"), F.lit("")).alias("country"),
        F.coalesce(F.col("centroid.y"), mid_y).alias("lat"), F.coalesce(F.col("centroid.x"), mid_x).alias("lon"),
    )
    both = cities.where("zhName IS NOT NULL AND asciiName IS NOT NULL").select("asciiName", "zhName")
    # the names of least hash: a bounded sample that is the same in every run
    chosen = both.groupBy("asciiName", "zhName").agg(F.first(F.xxhash64("asciiName", "zhName", F.lit(11))).alias("u")).orderBy("u", "asciiName", "zhName").limit(READ_ROWS)
    learnt = [(core(fold(a)), fold(z)) for a, z in sorted((r["asciiName"], r["zhName"]) for r in chosen.collect())]
    readings = learn_readings([(a, z) for a, z in learnt if _is_han(z) and not _is_han(a)])
    every = one.unionByName(two).unionByName(three)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            spelt: list[str] = []
            weights: list[float] = []
            for i, (side, own, other, line) in enumerate(zip(*(b.column(c).to_pylist() for c in ("side", "own", "other", "line")))):
                seen: dict[str, float] = {}
                raw = [n for n in own if n] or ([display_name(line, names)] if line else [])
                for n in raw:
                    f = without_code(fold((_BRACKETS.sub(" ", n) if "(" in n else n) or n))
                    if f:
                        seen[f] = 1.0
                        if side and not n.isascii() and _KANA_LETTER.search(unicodedata.normalize("NFKC", n)):
                            seen[SOUND + f] = 1.0
                for n in other:
                    f = without_code(fold(n)) if n else ""
                    if f:
                        seen.setdefault(f, 0.9)
                        if not f.isascii():
                            for part in f.split():
                                if part[0] > "⺀":
                                    seen.setdefault(part, 0.9)
                if side:
                    # what a Han name says in Latin letters, for places without a Han name
                    for f in [x for x, w in seen.items() if w == 1.0 and _is_han(x)]:
                        if all(c in readings for c in f):
                            seen[READ + "".join(readings[c] for c in f)] = 0.8
                at.extend([i] * len(seen)), spelt.extend(seen), weights.extend(seen.values())
            if at:
                lo, hi = vectors_of([f.removeprefix(READ).removeprefix(SOUND) for f in spelt])
                of = b.select(["side", "key", "country", "lat", "lon"]).take(pa.array(at))
                made = {"form": pa.array(spelt), "weight": pa.array(weights), "lo": pa.array(lo.view(np.int64)), "hi": pa.array(hi.view(np.int64))}
                named = [c.split()[0] for c in FORMS.split(", ")]
                yield pa.RecordBatch.from_arrays([made[c] if c in made else of.column(c) for c in named], names=named)

    return every.mapInArrow(run, FORMS).withColumn(
        "located", nearby.usable(F.col("lat"), F.col("lon"))
    )


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Insertions, deletions, changes and swaps of neighbours between a[i] and b[i], for all i at once."""
    code, names = pd.factorize(np.array([*a, *b], object))
    return _edits(names, code[: len(a)], code[len(a) :])


def _lengths(names: np.ndarray) -> np.ndarray:
    return np.fromiter(map(len, names), np.int64, len(names))


def _edits(names: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``edits`` between names[a[i]] and names[b[i]]."""
    size = _lengths(names)
    la, lb = size[a], size[b]
    out = np.maximum(la, lb)
    order = np.argsort(out, kind="stable")
    order = order[(la[order] > 0) & (lb[order] > 0)]
    at = 0
    while at < len(order):
        stop = min(len(order), at + 16_384)
        i = order[at:stop]
        at = stop
        wide = [max(1, int(x[i].max())) for x in (la, lb)]
        letters = []
        for x, w in zip((a, b), wide):
            own, back = np.unique(x[i], return_inverse=True)
            letters.append(names[own].astype(f"U{w}").view(np.uint32).reshape(len(own), w).T[:, back])
        ca, cb = letters
        na, nb, cols = la[i], lb[i], np.arange(len(i))
        before = last = np.repeat(np.arange(wide[1] + 1, dtype=np.int16)[:, None], len(i), axis=1)
        for row in range(1, wide[0] + 1):
            now = np.empty_like(last)
            now[0] = row
            same = ca[row - 1] == cb
            # changes and deletions of a row at once, insertions run along it
            now[1:] = np.minimum(last[1:] + 1, last[:-1] + ~same)
            if row > 1 and wide[1] > 1:
                swap = (ca[row - 1] == cb[:-1]) & (ca[row - 2] == cb[1:])
                now[2:] = np.where(swap, np.minimum(now[2:], before[:-2] + 1), now[2:])
            for j in range(1, wide[1] + 1):
                np.minimum(now[j], now[j - 1] + 1, out=now[j])
            ended = cols[na == row]
            out[i[ended]] = now[nb[ended], ended]
            before, last = last, now
    return out


def core(name: str) -> str:
    """A name without the words that its short form leaves out."""
    kept = [w for w in name.split() if w not in DROPPED]
    return " ".join(kept) or name


def sound(name: str) -> str:
    """What kana can tell apart: l and r are one, vowels that only carry a consonant are gone."""
    t = name.replace(" ", "").replace("r", "l")
    return re.sub(r"(?<=[bcdfghklmnpstvz])(?:u|(?<=[td])o)(?![aeiou])", "", t)


def _share(a: list[str], b: list[str]) -> np.ndarray:
    """Share of letters unchanged between a[i] and b[i]."""
    longest = np.fromiter((max(len(x), len(y), 1) for x, y in zip(a, b)), float, len(a))
    return 1 - edits(a, b) / longest


def _reading_scores(names: list[str], readings: list[str]) -> np.ndarray:
    """How much of the reading of a Han name begins a Latin one; l and r are one sound there."""
    flat = lambda t: t.replace("r", "l")
    out = np.zeros(len(names))
    rows, starts, wanted = [], [], []
    for i, (name, reading) in enumerate(zip(names, readings)):
        r, n = flat(reading), flat(core(name).replace(" ", ""))
        if len(r) < 4 or _is_han(n):
            continue
        for k in range(max(1, len(r) - 1), len(r) + 3):
            rows.append(i), starts.append(n[:k]), wanted.append(r)
    if rows:
        score = 1 - edits(wanted, starts) / np.fromiter(map(len, wanted), float, len(wanted))
        best = np.full(len(names), -np.inf)
        np.maximum.at(best, rows, score)
        out = np.where(np.isfinite(best), best, out)
    return out


def similarities(forms_a: np.ndarray, forms_b: np.ndarray, dice: np.ndarray) -> np.ndarray:
    """Dice of the name field for pairs of spellings: of the bits, met half way by the share of letters unchanged.

    Names that differ in a telling word are not alike; one of two that leaves out words
    such as port or saint is nearly the same. A reading of Han or kana is compared by
    sound. Names far apart by their bits, or longer than LONG, have the bits' Dice.
    """
    code, names = pd.factorize(np.concatenate([forms_a, forms_b]))
    return _similar(names, code[: len(forms_a)], code[len(forms_a) :], dice)


def _similar(names: np.ndarray, a: np.ndarray, b: np.ndarray, dice: np.ndarray) -> np.ndarray:
    """``similarities`` of names[a[i]] and names[b[i]]; what holds of a name is found once."""
    out = dice.astype(float).copy()
    lead = np.array([f[:1] for f in names], dtype=object)
    reading, sounded, equal = (lead == READ)[b], (lead == SOUND)[b], a == b
    out[equal] = 1.0
    at = np.flatnonzero(reading)
    out[at] = _reading_scores(list(names[a[at]]), [f[1:] for f in names[b[at]]])
    at = np.flatnonzero(sounded)
    out[at] = _share([sound(f) for f in names[a[at]]], [sound(f[1:]) for f in names[b[at]]])
    short = _lengths(names) <= LONG
    at = np.flatnonzero(~reading & ~sounded & ~equal & short[a] & short[b] & (dice >= 0.3))
    if not len(at):
        return out
    used, back = np.unique(np.concatenate([a[at], b[at]]), return_inverse=True)
    names, a, b = names[used], back[: len(at)], back[len(at) :]
    tell, _ = pd.factorize(np.array([" ".join(sorted(telling(f))) for f in names], object))
    short_form, cores = pd.factorize(np.array([core(f) for f in names], object))
    lost, _ = pd.factorize(np.array([" ".join(sorted(set(f.split()) & set(DROPPED))) for f in names], object))
    cut = cores[short_form] != names
    longest = np.maximum(_lengths(names), 1)
    same = (out[at] + (1 - _edits(names, a, b) / np.maximum(longest[a], longest[b]))) / 2
    apart = tell[a] != tell[b]
    left_out = (cut[a] != cut[b]) & ~apart
    other = cut[a] & (lost[a] != lost[b]) & ~apart & ~left_out
    k = np.flatnonzero(left_out)
    if len(k):
        longest = np.maximum(_lengths(cores), 1)
        x, y = short_form[a[k]], short_form[b[k]]
        same[k] = np.maximum(same[k], 0.95 * (1 - _edits(cores, x, y) / np.maximum(longest[x], longest[y])))
    out[at] = np.where(apart | other, same * 0.6, same)
    return out


PAIRS = "side int, city string, other string, dice double, weight double, km double, same_country int"


def _bit_dice(a: pd.DataFrame, b: pd.DataFrame, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    alo, ahi, blo, bhi = _words(a["lo"])[ia], _words(a["hi"])[ia], _words(b["lo"])[ib], _words(b["hi"])[ib]
    common = np.bitwise_count(alo & blo).astype(int) + np.bitwise_count(ahi & bhi)
    both = np.bitwise_count(alo).astype(int) + np.bitwise_count(ahi) + np.bitwise_count(blo) + np.bitwise_count(bhi)
    return np.where(both > 0, 2 * common / np.maximum(both, 1), 0.0)


def _alike(a: pd.DataFrame, b: pd.DataFrame, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Dice of the name field of pairs of spellings; of all pairs with the same two, one is compared."""
    code, names = pd.factorize(np.concatenate([a["form"].to_numpy(), b["form"].to_numpy()]))
    ka, kb = code[: len(a)][ia], code[len(a) :][ib]
    _, one, back = np.unique(ka.astype(np.int64) * len(names) + kb, return_index=True, return_inverse=True)
    return _similar(names, ka[one], kb[one], _bit_dice(a, b, ia[one], ib[one]))[back]


def _words(column: pd.Series) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _same_country(a: pd.Series, b: pd.Series, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """1 the same, 0 another, -1 where one is not known."""
    code, _ = pd.factorize(np.concatenate([a.to_numpy(), b.to_numpy()]).astype(object))
    blank = np.array([not isinstance(c, str) or not c for c in (*a, *b)], bool)
    code[blank] = -1
    x, y = code[: len(a)][ia], code[len(a) :][ib]
    return np.where((x < 0) | (y < 0), -1, (x == y).astype(int)).astype("int32")


def scores(dice: np.ndarray, weight: np.ndarray, km: np.ndarray, same_country: np.ndarray) -> np.ndarray:
    """``score_column`` of arrays, to the last bit: the same sums in the same order."""
    name = dice * (0.8 + 0.2 * weight)
    country = np.where(same_country == -1, NO_COUNTRY, same_country.astype(float))
    place = np.where(np.isnan(km), NO_PLACE, 1 - (0.1 * km + 0.2 * np.maximum(0.0, km - 1)))
    parts = {"name": name, "country": country, "place": place}
    return sum((w * parts[f] for f, w in FIELDS.items()), 0.0) / sum(FIELDS.values())


def best_two(of: np.ndarray, city: np.ndarray, score: np.ndarray, km: np.ndarray) -> np.ndarray:
    """Places of the two best cities of each record: greatest score, then nearer, then smaller id.

    No other city can be among a record's two best of all tasks, and a match reads no more.
    """
    order = np.lexsort((-score, city, of))
    o, c = of[order], city[order]
    order = order[np.concatenate([[True], (o[1:] != o[:-1]) | (c[1:] != c[:-1])])[: len(o)]]
    order = order[np.lexsort((city[order], np.nan_to_num(km[order], nan=np.inf), -score[order], of[order]))]
    o = of[order]
    return order[np.concatenate([[True, True], o[2:] != o[:-2]])[: len(o)]]


def _no_pairs() -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: [] for c in PAIRS.split(", ")}).astype({"side": "int32", "same_country": "int32", "city": object, "other": object})


def _near_pairs(a: pd.DataFrame, b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, km) at most REACH_KM apart whose names are close, in pieces of bounded size.

    Rows are filed by cubes of REACH_KM. Where few meet, those of neighbouring cubes are
    compared one by one; where a place is crowded, by the index of their names.
    """
    va, vb = (nearby.vectors(d["lat"].to_numpy(float), d["lon"].to_numpy(float)) for d in (a, b))
    side = REACH_KM / 111.0 * np.pi / 180
    # positions of cubes are 1 to 4,094 on each axis, so that neighbours have keys of their own
    ca, cb = (np.floor(v / side).astype(np.int64) + 2_048 for v in (va, vb))
    at = lambda c: (c[:, 0] << 24) + (c[:, 1] << 12) + c[:, 2]
    ka, kb = at(ca), at(cb)
    order = np.argsort(ka, kind="stable")
    filed = ka[order]
    al, ah, bl, bh = _words(a["lo"]), _words(a["hi"]), _words(b["lo"]), _words(b["hi"])

    def close(ia: np.ndarray, ib: np.ndarray):
        km = 2 * nearby.RADIUS_KM * np.arcsin(np.minimum(1.0, np.sqrt(((va[ia] - vb[ib]) ** 2).sum(axis=1)) / 2))
        kept = km <= REACH_KM
        return ia[kept], ib[kept], km[kept]

    # cubes in a line along the last axis stand side by side
    steps = [(i << 24) + (j << 12) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    first = np.concatenate([np.searchsorted(filed, kb + s - 1, "left") for s in steps])
    n = np.concatenate([np.searchsorted(filed, kb + s + 1, "right") for s in steps]) - first
    if n.sum() > CROWD * len(b):
        around = [kb + s + k for s in steps for k in (-1, 0, 1)]
        ib, ia = close_pairs(bl, bh, al, ah, NEAR_CHUNKS, around, ka)
        for start in range(0, len(ia), MEETINGS):
            yield close(ia[start : start + MEETINGS], ib[start : start + MEETINGS])
        return
    for k, off in _ranges(n, first):
        ia, ib = order[off], k % len(b)
        alike = _apart(al, ah, bl, bh, ia, ib) <= 2 * NEAR_CHUNKS - 1
        yield close(ia[alike], ib[alike])


def _near(pdf: pd.DataFrame) -> pd.DataFrame:
    """The two best cities near each other record of one task. side 0: gazetteer."""
    a, b = pdf[pdf.side == 0], pdf[pdf.side != 0]
    if not len(a) or not len(b):
        return _no_pairs()
    of, _ = pd.factorize(pd.MultiIndex.from_arrays([b["side"], b["key"]]))
    city, wa, wb = a["key"].to_numpy().astype(np.int64), a["weight"].to_numpy(), b["weight"].to_numpy()
    kept = None
    for ia, ib, km in _near_pairs(a, b):
        dice, weight, same = _alike(a, b, ia, ib), wa[ia] * wb[ib], _same_country(a["country"], b["country"], ia, ib)
        piece = [ia, ib, km, dice, weight, same]
        if kept is not None:
            piece = [np.concatenate(x) for x in zip(kept, piece)]
        ia, ib, km, dice, weight, same = piece
        two = best_two(of[ib], city[ia], scores(dice, weight, km, same), km)
        kept = [x[two] for x in piece]
    if kept is None:
        return _no_pairs()
    ia, ib, km, dice, weight, same = kept
    return pd.DataFrame({
        "side": b["side"].to_numpy()[ib].astype("int32"), "city": a["key"].to_numpy()[ia], "other": b["key"].to_numpy()[ib],
        "dice": dice, "weight": weight, "km": km, "same_country": same,
    })


def candidate_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of records whose names are close: near each other, or where a place is unknown, in one country.

    Of each record's cities, tasks send on the best two they have.
    """
    here = rows.where("located")
    total = here.count()
    sample = nearby.sample_rows(here, total, "lat", "lon")
    nodes = fit_cells(nearby.vectors(sample[:, 0], sample[:, 1]) if len(sample) else np.zeros((0, 3)), nearby.cells_for(total))
    pad = nearby.chord(REACH_KM) * (1 + 1e-9)
    fields = "side int, key string, form string, weight double, lo bigint, hi bigint, country string, lat double, lon double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            side, lat, lon = (b.column(c).to_numpy(zero_copy_only=False) for c in ("side", "lat", "lon"))
            xyz = nearby.vectors(lat, lon)
            reach = np.where(side == 0, pad, 0.0)[:, None]
            at, cell = assign(nodes, xyz - reach, xyz + reach)
            yield b.take(pa.array(at)).append_column("cell", pa.array(cell.astype("int32")))

    names = [c.split()[0] for c in fields.split(", ")]
    roles = lambda df: df.withColumn("asks", F.col("side") == 0).withColumn("answers", F.col("side") != 0)
    counted = here.select("side", "lat", "lon").mapInArrow(place, "side int, lat double, lon double, cell int")
    # a crowded cell is joined in blocks of both sides; placing twice costs less than keeping placed rows
    placed = nearby.spread(roles(here.select(*names).mapInArrow(place, fields + ", cell int")), counted=roles(counted))
    pairs_near = placed.groupBy("task").applyInPandas(_near, PAIRS)
    # one side has no place: others without one ask all cities, others that have one the cities without
    others = _by_country(rows.where("NOT located AND side <> 0").select(*names), rows.where("side = 0").select(*names))
    lost = _by_country(rows.where("side <> 0 AND located").select(*names), rows.where("NOT located AND side = 0").select(*names))
    return pairs_near.unionByName(others).unionByName(lost)


#: What a spelling without a place is asked for and answers with: its two cities of least id stand for all.
ASKED = "country string, form string, weight double, city bigint, dice double, with double, same_country int"


def _most_alike(answer: pd.DataFrame, ask: pd.DataFrame, j: np.ndarray, i: np.ndarray) -> np.ndarray:
    """What ``_alike`` can be at most, by bits and lengths alone."""
    bits = _bit_dice(answer, ask, j, i)
    code, names = pd.factorize(np.concatenate([answer["form"].to_numpy(), ask["form"].to_numpy()]))
    x, y = code[: len(answer)][j], code[len(answer) :][i]
    size, cut = _lengths(names), np.array([core(f) != f for f in names], bool)
    heard = np.array([f[:1] in (READ, SOUND) for f in names], bool)
    most = (bits + 1 - np.abs(size[x] - size[y]) / np.maximum(1, np.maximum(size[x], size[y]))) / 2
    most = np.where(cut[x] | cut[y], np.maximum(most, 0.95), most)
    most = np.where(bits < 0.3, bits, np.maximum(most, bits))
    return np.where((x == y) | heard[y], 1.0, most)


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """The two best cities of each asking spelling of one task.

    Names are compared letter by letter only while they can still be among the two best.
    """
    ask, answer = pdf[pdf["asks"]], pdf[pdf["answers"]]
    columns = [c.split()[0] for c in ASKED.split(", ")]
    if not len(ask) or not len(answer):
        return pd.DataFrame({c: [] for c in columns}).astype({"country": object, "form": object, "city": "int64", "same_country": "int32"})
    filed = Filed(_words(answer["lo"]), _words(answer["hi"]))
    low, high, own = answer["low"].to_numpy(np.int64), answer["high"].to_numpy(np.int64), answer["weight"].to_numpy()
    out = []
    for start in range(0, len(ask), ASK_ROWS):
        some = ask.iloc[start : start + ASK_ROWS]
        i, j = filed.pairs(_words(some["lo"]), _words(some["hi"]))
        nowhere = lambda n: np.full(n, np.nan)
        same, weight = _same_country(answer["country"], some["country"], j, i), some["weight"].to_numpy()[i] * own[j]
        most = scores(_most_alike(answer, some, j, i), weight, nowhere(len(i)), same)
        order = np.lexsort((-most, i))
        i, j, same, weight, most = (v[order] for v in (i, j, same, weight, most))
        # (ask, city, score, place among the pairs, dice) of the best so far; the second's score of each ask
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64), np.empty(0)]
        second = np.full(len(some), -np.inf)
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        for first, last in ((0, 4), (4, 40), (40, max(len(i), 41))):
            k = np.flatnonzero((rank >= first) & (rank < last) & (most >= second[i]))
            if not len(k):
                continue
            dice = _alike(answer, some, j[k], i[k])
            score = scores(dice, weight[k], nowhere(len(k)), same[k])
            # the second city of a spelling, where there is one
            more = np.flatnonzero(low[j[k]] != high[j[k]])
            at = np.concatenate([np.arange(len(k)), more])
            made = [i[k][at], np.concatenate([low[j[k]], high[j[k][more]]]), score[at], k[at], dice[at]]
            best = [np.concatenate(v) for v in zip(best, made)]
            two = best_two(best[0], best[1], best[2], nowhere(len(best[0])))
            best = [v[two] for v in best]
            full = np.flatnonzero(best[0][1:] == best[0][:-1]) + 1
            second[best[0][full]] = best[2][full]
        of, city, _, k, dice = best
        out.append(pd.DataFrame({
            "country": some["country"].to_numpy()[of], "form": some["form"].to_numpy()[of], "weight": some["weight"].to_numpy()[of], "city": city,
            "dice": dice, "with": weight[k], "same_country": same[k],
        }))
    return pd.concat(out)


def _by_country(others: DataFrame, cities: DataFrame) -> DataFrame:
    """Records against all cities of their country and of none, in blocks of both sides; of no country, against all.

    Without places a score depends on the two spellings, their weights and countries
    alone. So each distinct spelling of a country asks once, however many records bear
    it, and is answered with its best two cities; of the cities that bear one spelling
    alike, the two of least id are compared.
    """
    own = F.coalesce("country", F.lit(""))
    spelling = ["country", "form", "weight"]
    cities = cities.select(own.alias("country"), "form", "weight", "lo", "hi", F.col("key").cast("bigint").alias("id"))
    least = Window.partitionBy(*spelling).orderBy("id")
    filed = cities.withColumn("_n", F.row_number().over(least)).where("_n <= 2").groupBy(*spelling).agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min("id").alias("low"), F.max("id").alias("high")
    )
    codes = sorted(r[0] for r in cities.where("country <> ''").select("country").distinct().collect())  # country codes
    asking = others.select(own.alias("country"), "form", "weight", "lo", "hi").dropDuplicates(spelling)
    every = F.array(F.lit(""), *[F.lit(c) for c in codes])
    mine = F.when(F.col("country") == "", every).otherwise(F.array(F.lit(""), F.col("country")))
    none = F.lit(None).cast("bigint")
    side = lambda df, asks: df.withColumn("asks", F.lit(asks)).withColumn("answers", F.lit(not asks))
    sent = lambda df: side(df.withColumn("cell", F.explode(mine)).where(F.col("cell").isin("", *codes)), True)
    kept = lambda df: side(df.withColumn("cell", F.col("country")), False)
    narrow = lambda df: df.select("cell", "asks", "answers")
    # blocks are counted by records, which are at least as many as spellings
    counted = narrow(sent(others.select(own.alias("country")))).unionByName(narrow(kept(cities.select("country"))))
    both = sent(asking.select("*", none.alias("low"), none.alias("high"))).unionByName(kept(filed)).withColumn("key", F.col("form"))
    met = nearby.spread(both, block=FAR_BLOCKS * nearby.BLOCK, counted=counted)
    best = met.groupBy("task").applyInPandas(_meet, ASKED)
    bearers = others.select(F.col("side").cast("int").alias("side"), F.col("key").alias("other"), own.alias("country"), "form", "weight")
    return bearers.join(best, spelling).select("side", F.col("city").cast("string").alias("city"), "other", "dice", F.col("with").alias("weight"), F.lit(None).cast("double").alias("km"), "same_country")


def score_column():
    """Weighted mean of the fields' Dice scores, 0 to 1; a spelling that is no own name of its record counts for less."""
    name = F.col("dice") * (0.8 + 0.2 * F.col("weight"))
    country = F.when(F.col("same_country") == -1, NO_COUNTRY).otherwise(F.col("same_country").cast("double"))
    # closeness falls slowly within a kilometre, then faster, to nothing at REACH_KM
    place = F.when(F.col("km").isNull() | F.isnan("km"), NO_PLACE).otherwise(1 - (0.1 * F.col("km") + 0.2 * F.greatest(F.lit(0.0), F.col("km") - 1)))
    parts = {"name": name, "country": country, "place": place}
    return sum((w * parts[f] for f, w in FIELDS.items()), F.lit(0.0)) / sum(FIELDS.values())


def calibrate(scored: DataFrame) -> tuple[float, float]:
    """Slope and middle of the logistic curve from best (1) and second-best (0) pairs, by 100 bins of the score.

    The fit is by weighted likelihood with a weak normal prior, so that few pairs leave
    the prior and many overrule it.
    """
    bins = scored.where("_rank <= 2").groupBy(F.floor(F.col("score") * 100).alias("b")).agg(
        F.count_if(F.col("_rank") == 1).alias("best"), F.count_if(F.col("_rank") == 2).alias("second")
    ).collect()
    x = np.array([(r["b"] + 0.5) / 100 for r in bins])
    pos, neg = np.array([r["best"] for r in bins], float), np.array([r["second"] for r in bins], float)
    if not len(x) or not neg.sum():
        return PRIOR_SLOPE, PRIOR_MIDDLE
    # balanced: second-best pairs stand for all pairs of different places
    neg *= pos.sum() / neg.sum()
    slope, middle = PRIOR_SLOPE, PRIOR_MIDDLE
    firm = pos.sum() * np.array([0.02 / 841, 20 / 4.75])
    for _ in range(200):
        p = 1 / (1 + np.exp(-slope * (x - middle)))
        g, w = (pos + neg) * p - pos, (pos + neg) * p * (1 - p) + 1e-9
        grad = np.array([(g * (x - middle)).sum(), -(g * slope).sum()]) + firm * np.array([slope - PRIOR_SLOPE, middle - PRIOR_MIDDLE])
        hess = np.array([(w * (x - middle) ** 2).sum(), (w * slope**2).sum()]) + firm
        step = np.clip(grad / hess, [-0.7, -0.007], [0.7, 0.007])
        slope, middle = slope - step[0], middle - step[1]
    return float(slope), float(middle)


def match(cities: DataFrame, candidates: DataFrame, areas: DataFrame, countries: DataFrame) -> DataFrame:
    """(city_id, other_kind, other_id, score, confidence): the best city of every other record that has a close one.

    Records repeat as they may: a pair of ids has one row. Null names, countries and
    places lower what is known, not fail; records without a name match nothing. Ties go
    to the nearer, then the smaller id.
    """
    runtime.ship_package(cities.sparkSession)
    rows = _cut(forms(cities, candidates, areas, countries).dropDuplicates(["side", "key", "form"]))
    pairs = candidate_pairs(rows).withColumn("score", score_column())
    order = Window.partitionBy("side", "other").orderBy(F.desc("score"), F.col("km").asc_nulls_last(), F.col("city").cast("bigint"))
    best_of_city = pairs.groupBy("side", "other", "city").agg(F.max_by(F.struct("score", "km"), "score").alias("s")).select("side", "other", "city", "s.score", "s.km")
    ranked = _cut(best_of_city.withColumn("_rank", F.row_number().over(order)).where("_rank <= 2"))
    slope, middle = calibrate(ranked)
    second = Window.partitionBy("side", "other")
    return ranked.withColumn("_next", F.max(F.when(F.col("_rank") == 2, F.col("score"))).over(second)).where("_rank = 1").select(
        F.col("city").cast("bigint").alias("city_id"),
        F.when(F.col("side") == 1, "candidate").otherwise("area").alias("other_kind"),
        F.col("other").alias("other_id"),
        F.round("score", 6).alias("score"),
        F.col("km"),
        # without a place, another city of the same name makes the choice a guess
        F.round(
            F.when((F.col("km").isNull() | F.isnan("km")) & (F.col("_next") > F.col("score") - 0.05 / sum(FIELDS.values())), 0.5)
            .otherwise(1.0) / (1 + F.exp(-slope * (F.col("score") - middle))), 6
        ).alias("confidence"),
    )


def found(cities: DataFrame, candidates: DataFrame, areas: DataFrame, countries: DataFrame) -> DataFrame:
    return match(cities, candidates, areas, countries).where(F.col("confidence") >= CONFIDENT).select("city_id", "other_kind", "other_id")
