"""Language of documents and of their segments, with a confidence.

Multinomial naive Bayes over hashed character n-grams, trained here on the labelled
samples. Beside each language's clean class stands one for its text spoilt by a false
charset; a language's probability is the sum of both. The matrix of log-probabilities
is broadcast (``BINS`` rows of two columns a language) and sentences are scored in
batches: the n-grams of many sentences at once gather rows of the matrix, which are
summed by sentence.

Menus, notices and footers are lines that many different pages share: lines are counted
over the whole corpus (hashes, map-side combined); of those on more than ``SHARED`` of
all pages (at most lines-per-page / SHARED, a bounded set) the pages are counted again
with all copies of a page as one, and lines that still are on so many are left out unless
a page has nothing else. The languages of a page come from its main content; ``segments``
can also give every other line with letters, as a segment that is no main one.

Scale: documents are read twice. The first pass writes the hashes and sizes of each
page's lines and the text of a bounded sample for the fit; one shuffle of line hashes
and all further counts read that. The second pass scores texts in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartomill import runtime

BINS, ORDERS, SMOOTHING = 1 << 15, (2, 3, 4), 0.05
SHARED = 0.002
#: Least share of a page's characters, in lines on the same number of pages, that makes these copies of it.
COPIED = 0.25
#: Most labelled samples, and most labelled pages with their most characters, the classifier is fitted on.
FIT_ROWS, FIT_PAGES, FIT_CHARS = 200_000, 3_000, 3_000
#: Least letters and confidence of a sentence that takes another language than its
#: page's, and least letters of all such sentences for the language to count.
SURE_LETTERS, SURE, LEAST_LETTERS = 12, 0.98, 40
#: Confidence at which one sentence is enough whatever its letters (SURE_LETTERS at least).
CERTAIN = 0.99999
#: Below this confidence of a page's language its label stands.
UNSURE = 0.7
#: Charsets pages are sent in, and charsets they are wrongly read in.
SENT = "utf-8 cp1250 iso8859-2 cp1251 koi8-r iso8859-5 iso8859-7 cp1253 latin-1 shift_jis euc_jp gb18030 big5".split()
READ = "latin-1 cp1252 utf-8 ascii cp1251 cp1250 koi8-r iso8859-7 gb18030 shift_jis euc_jp".split()

_SENTENCE = re.compile(r"[^.!?…。！？｡]*(?:[.!?…。！？｡]+[\"'»”’)\]」』]*(?=\s|$|[^\x00-˿])|$|[.!?…]+)")
_END = re.compile(r"[.!?…。！？｡][\"'»”’)\]」』\s]*\Z")
#: Signs of a false charset.
_ODD = re.compile("[\x80-\x9f�ÃÂ]|[^\\W\\d_]\\?[^\\W\\d_]")
PAD = "   "


def codes(text: str) -> np.ndarray:
    """Lower-case code points; digits are one character."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    a[(a >= 48) & (a <= 57)] = 48
    return a


def grams(a: np.ndarray, order: int) -> np.ndarray:
    """Bin of the n-gram that starts at each position (zeros stand after the end)."""
    h = np.full(len(a), (order * 0x9E3779B1) & 0xFFFFFFFF, dtype=np.uint64)
    for k in range(order):
        x = np.zeros(len(a), dtype=np.uint64)
        x[: len(a) - k] = a[k:]
        h = ((h ^ x) * np.uint64(0x100000001B3)) & np.uint64(0xFFFFFFFFFFFF)
    h ^= h >> np.uint64(29)
    return (h & np.uint64(BINS - 1)).astype(np.int32)


def spoilt(text: str) -> set[str]:
    """The text as it looks after one wrong charset."""
    out = set()
    for sent in SENT:
        for read in READ:
            try:
                raw = text.encode(sent)
            except UnicodeEncodeError:
                continue
            out.add(raw.decode(read, "replace"))
    asked = "".join(c if ord(c) < 256 else "?" for c in text)
    out |= {asked, "".join(c if ord(c) < 128 else "?" for c in text), "".join(c if ord(c) < 128 else "�" for c in text)}
    out.discard(text)
    return out


class Model:
    """Log-probabilities [BINS, 2 * languages] and the languages' names."""

    def __init__(self, langs: list[str], table: np.ndarray):
        self.langs, self.table = langs, table

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], pages: list[tuple[str, str]] = ()) -> Model:
        """samples: (language, text), whose spoilt forms are learnt too; pages: (language, text) as found."""
        langs = sorted({lang for lang, _ in samples})
        columns: list[list[np.ndarray]] = [[] for _ in range(2 * len(langs))]
        for lang, text in samples:
            at = 2 * langs.index(lang)
            columns[at].append(codes(text + PAD))
            columns[at + 1].extend(codes(t + PAD) for t in sorted(spoilt(text)))
        for lang, text in pages:
            if lang in langs:
                columns[2 * langs.index(lang) + bool(_ODD.search(text))].append(codes(text + PAD))
        counts = np.zeros((BINS, len(columns)))
        for k, texts in enumerate(columns):
            a = np.concatenate(texts)
            for order in ORDERS:
                counts[:, k] += np.bincount(grams(a, order), minlength=BINS)
        # samples repeat a few sentences; damped counts let rarer words speak
        counts = np.log1p(counts) + SMOOTHING
        return cls(langs, np.log(counts / counts.sum(axis=0)).astype(np.float32))

    def score(self, sentences: list[str]) -> np.ndarray:
        """Probabilities [sentences, languages]."""
        if not sentences:
            return np.zeros((0, len(self.langs)))
        out = np.zeros((len(sentences), self.table.shape[1]))
        start = 0
        while start < len(sentences):
            stop, size = start, 0
            while stop < len(sentences) and (size < 60_000 or stop == start):
                size += len(sentences[stop])
                stop += 1
            parts = [codes(s + PAD) for s in sentences[start:stop]]
            first = np.cumsum([0] + [len(p) for p in parts[:-1]])
            a = np.concatenate(parts)
            for order in ORDERS:
                bins = grams(a, order)
                for lo in range(0, len(parts), 4096):
                    hi = min(lo + 4096, len(parts))
                    end = first[hi] if hi < len(parts) else len(a)
                    rows = self.table[bins[first[lo] : end]]
                    out[start + lo : start + hi] += np.add.reduceat(rows, first[lo:hi] - first[lo], axis=0)
            start = stop
        # evidence of overlapping n-grams counts once per character
        out /= len(ORDERS)
        out -= out.max(axis=1, keepdims=True)
        p = np.exp(out)
        p = p[:, 0::2] + p[:, 1::2]
        return p / p.sum(axis=1, keepdims=True)


def sentences(line: str) -> list[str]:
    return [s for m in _SENTENCE.finditer(line) if (s := m.group().strip())]


_EAST = re.compile("[⺀-鿿豈-﫿ｦ-ﾟ]")


def letters(text: str) -> int:
    """Letters, an East Asian one for two and a half."""
    n = sum(map(str.isalpha, text))
    return n if text.isascii() else int(n + 1.5 * len(_EAST.findall(text)))


def main_lines(lines: list[str], rate: list[float]) -> list[int]:
    """Lines of main content: sentences that few pages share, else the least shared ones."""
    ended = [i for i, x in enumerate(lines) if _END.search(x) and letters(x) >= 4]
    own = [i for i in ended if rate[i] <= SHARED]
    if own:
        return own
    pool = ended or [i for i, x in enumerate(lines) if letters(x) >= 2]
    if not pool:
        return []
    # a page of shared sentences only (an error page): those shared least
    low = min(rate[i] for i in pool)
    return [i for i in pool if rate[i] <= 1.5 * low]


def page(weight: np.ndarray, p: np.ndarray, odd: np.ndarray | None = None) -> tuple[int, list[tuple[int, float, int, int]]]:
    """Language of a page and its segments (language, confidence, first, last sentence).

    weight: letters of the page's sentences; p: their probabilities. The page's language
    has the greatest sum of letters times probability. A sentence takes another language
    only if it is long and sure enough, and the language only if it has enough of them
    or one that is all but certain;
    neighbours of one language form a segment. On a page that a false charset spoilt for
    the most part, only plain sentences bring in a further language.
    """
    weight = weight.astype(float)
    main = int((p * weight[:, None]).sum(axis=0).argmax())
    label = np.full(len(weight), main)
    best = p.argmax(axis=1)
    if (best != main).any():
        sure = (best != main) & (p[np.arange(len(weight)), best] >= SURE) & (weight >= SURE_LETTERS)
        if odd is not None and odd.mean() > 0.5:
            sure &= ~odd
        for lang in np.unique(best[sure]):
            own = sure & (best == lang)
            # one sentence that is all but certain is enough
            if weight[own].sum() >= LEAST_LETTERS or (p[own, lang] >= CERTAIN).any():
                label[own] = lang
    starts = np.concatenate([[0], np.nonzero(np.diff(label))[0] + 1, [len(label)]])
    out = []
    for i, j in zip(starts[:-1], starts[1:]):
        w = np.maximum(weight[i:j], 1e-9)
        out.append((int(label[i]), float((p[i:j, label[i]] * w).sum() / w.sum()), int(i), int(j) - 1))
    return main, out


def copies(count: np.ndarray, size: np.ndarray, own: int) -> int:
    """Pages that are copies of a page: the most pages that each of its lines with a share of COPIED of its characters is on.

    count, size: pages and characters of its often seen lines; own: characters of its other lines.
    """
    at = np.argsort(-count, kind="stable")
    reached = np.cumsum(size[at]) >= COPIED * (size.sum() + own)
    return int(count[at][reached.argmax()]) if reached.any() else 1


def sketch(docs: DataFrame, text: str, label: str | None, langs: list[str]) -> DataFrame:
    """(h, n, u, x) of every page with text, cut: hashes and sizes of its distinct lines, and what the fit may sample.

    u: a hash of the text where the label is one of langs and the text is short enough,
    else null. x: the text where u is below twice the share of FIT_PAGES in all rows.
    """
    share = F.lit(_share(docs.count() / 2))
    own = F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.trim(x)))
    named = F.col(label).isin(langs) if label is not None else F.lit(False)
    pages = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(text).alias("text"), F.coalesce(named, F.lit(False)).alias("named"), *([F.col(label).alias("l")] if label else [F.lit(None).cast("string").alias("l")]))
    u = F.when(F.col("named") & (F.length("text") <= FIT_CHARS), F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)))
    return runtime.cut(
        pages.withColumn("own", own).withColumn("u", u).select(
            F.transform("own", lambda x: F.xxhash64(x)).alias("h"), F.transform("own", lambda x: F.length(x)).alias("n"), "u",
            F.when(F.col("u") <= share, F.struct("l", "text")).alias("x"),
        )
    )


def _share(rows: float) -> int:
    """The hash up to which rows are sampled, so that about FIT_PAGES are."""
    return int(min(1.0, FIT_PAGES / max(rows, 1)) * (1 << 30))


def shared_lines(pages: DataFrame) -> dict[int, float]:
    """Hashes of lines that different pages share, on more than SHARED of all pages with text, and their share.

    pages: (h, n), hashes and sizes of each page's distinct lines. A page counts for one
    part in its copies, so that all copies together count once even where they differ
    in some lines. Lines found to be shared say nothing about copies: pages are counted
    again without them until no line is added.
    """
    total = pages.count()
    if not total:
        return {}
    lines = pages.select(F.explode(F.arrays_zip("h", "n")).alias("e")).select("e.h", "e.n")
    # few pages say little: a line must be on three at least
    least = max(SHARED * total, 2.0)
    rows = lines.groupBy("h").agg(F.count("*").alias("count"), F.max("n").alias("n")).where(F.col("count") > F.lit(least)).collect()
    if not rows:
        return {}
    # bounded: lines a page / SHARED
    ids = {r["h"]: i for i, r in enumerate(rows)}
    count, size = np.array([r["count"] for r in rows]), np.array([r["n"] for r in rows])
    runtime.ship_package(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast((ids, count, size))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = sent.value[0]
        for b in batches:
            out = []
            for hashes, sizes in zip(b["h"], b["n"]):
                at = [ids.get(h) for h in hashes.tolist()]
                often = [i for i in at if i is not None]
                if often:
                    out.append((often, int(sum(n for i, n in zip(at, sizes.tolist()) if i is None))))
            if out:
                yield pd.DataFrame(out, columns=["often", "own"])

    kept = runtime.cut(pages.select("h", "n").mapInPandas(seen, "often array<int>, own bigint"))
    shared = np.zeros(len(rows), dtype=bool)
    while True:

        def counted(batches: Iterator[pd.DataFrame], shared: np.ndarray = shared) -> Iterator[pd.DataFrame]:
            _, count, size = sent.value
            texts = np.zeros(len(count))
            for b in batches:
                for often, own in zip(b["often"], b["own"]):
                    left = often[~shared[often]]
                    texts[often] += 1 / copies(count[left], size[left], own)
            i = np.nonzero(texts)[0]
            yield pd.DataFrame({"i": i.astype(np.int32), "texts": texts[i]})

        texts = np.zeros(len(rows))
        for r in kept.mapInPandas(counted, "i int, texts double").groupBy("i").agg(F.sum("texts").alias("texts")).collect():
            texts[r["i"]] = r["texts"]
        # sums of parts fall short of whole numbers by their rounding
        found = shared | (texts > least + 1e-6)
        if (found == shared).all():
            return {h: float(texts[i] / total) for h, i in ids.items() if shared[i]}
        shared = found


def fit(samples: list[tuple[str, str]], pages: DataFrame | None, often: dict[int, float]) -> Model:
    """The classifier: from the samples, then again with a bounded sample of labelled pages.

    pages: the sketch, or None. Pages teach the words the few samples lack. Their labels
    may be wrong: a page whose language the first fit is sure to be another is left out.
    """
    model = Model.fit(samples)
    if pages is None:
        return model
    share = _share(pages.where("u IS NOT NULL").count())
    lines = F.split("x.text", "\n")
    rows = (
        pages.where((F.col("u") <= share) & F.col("x").isNotNull())
        .select(F.col("x.l").alias("l"), lines.alias("x"), F.transform(lines, lambda x: F.xxhash64(F.trim(x))).alias("h"))
        .limit(2 * FIT_PAGES).collect()
    )
    taught: set[tuple[str, str]] = set()
    for lang, x, h in rows:
        own = [s for i in main_lines(x, [often.get(v, 0.0) for v in h]) for s in sentences(x[i]) if letters(s)]
        if own:
            p = model.score(own)
            main, _ = page(np.array([letters(s) for s in own]), p)
            sure = p[:, main].min() >= SURE
            taught |= {(lang, s) for s, q in zip(own, p) if model.langs[main] == lang and (q[main] >= 0.5 or q.max() < SURE) or not sure and q.max() < SURE}
    return Model.fit(samples, sorted(taught))


SEGMENTS = (
    "doc_id bigint, label string, segment_no int, lang string, confidence double, segment_text string, "
    "is_main boolean, page_lang string, page_confidence double, page_langs array<string>"
)


def runs(weight: np.ndarray, p: np.ndarray, odd: np.ndarray, is_main: np.ndarray) -> tuple[int, list[tuple[int, float, int, int, bool]]]:
    """Language of a page and its segments (language, confidence, first, last sentence, whether of main content).

    Sentences that are not main take the page's language unless each is long and sure
    enough by itself; they bring in no language of the page.
    """
    if not is_main.any():
        is_main = np.ones(len(weight), dtype=bool)
    at = np.flatnonzero(is_main)
    main, segs = page(weight[at], p[at], odd[at])
    if is_main.all():
        return main, [(*s, True) for s in segs]
    label = np.full(len(weight), main)
    for lang, _, i, j in segs:
        label[at[i : j + 1]] = lang
    best = p.argmax(axis=1)
    own = ~is_main & (best != main) & (p.max(axis=1) >= SURE) & (weight >= SURE_LETTERS)
    label[own] = best[own]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(label) | np.diff(is_main)) + 1, [len(label)]])
    out = []
    for i, j in zip(starts[:-1], starts[1:]):
        w = np.maximum(weight[i:j], 1e-9)
        out.append((int(label[i]), float((p[i:j, label[i]] * w).sum() / w.sum()), int(i), int(j) - 1, bool(is_main[i])))
    return main, out


def segments(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text", label: str | None = None, whole: bool = True) -> DataFrame:
    """Segments of every page with text: language, confidence, and those of the page.

    With whole, every line with a letter is in a segment, those that are not main
    content too (``is_main`` tells); without, main content only. The languages of the
    page are those of its main content either way.
    samples: (lang, sample_text); rows with a null in either are not used. Null, empty
    and blank texts, and texts without a letter, have no row. Repeated pages are pages
    of their own. ``label`` is carried along. Other columns are not read.
    """
    spark = docs.sparkSession
    runtime.ship_package(spark)
    rows = samples.where("lang IS NOT NULL AND sample_text IS NOT NULL").select("lang", "sample_text").orderBy("lang", "sample_text").limit(FIT_ROWS).collect()
    if not rows:
        return spark.createDataFrame([], SEGMENTS)
    pages = sketch(docs, text, label, sorted({r[0] for r in rows}))
    often = shared_lines(pages)
    model = fit([(r[0], r[1]) for r in rows], pages if label else None, often)
    shared = spark.sparkContext.broadcast((model.langs, model.table, often))
    prepared = docs.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(
        F.col(key).alias("doc_id"),
        (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
        F.split(text, "\n").alias("lines"),
    ).withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(F.trim(x))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        langs, table, often = shared.value
        m = Model(langs, table)
        columns = [c.split()[0] for c in SEGMENTS.split(", ")]
        for b in batches:
            pages, flat, weights, mains = [], [], [], []
            for k, own_label, lines, hashes in zip(b["doc_id"], b["label"], b["lines"], b["hashes"]):
                n, chosen = 0, main_lines(lines, [often.get(h, 0.0) for h in hashes.tolist()])
                own = set(chosen)
                for i in range(len(lines)) if whole else chosen:
                    for s in sentences(lines[i]):
                        if w := letters(s):
                            flat.append(s), weights.append(w), mains.append(i in own)
                            n += 1
                if n:
                    pages.append((k, own_label, n))
            p, weight, main_part = m.score(flat), np.array(weights), np.array(mains, dtype=bool)
            odd = np.array([not s.isascii() and _ODD.search(s) is not None for s in flat], dtype=bool)
            out, start = [], 0
            for k, own_label, n in pages:
                at = slice(start, start + n)
                start += n
                main, segs = runs(weight[at], p[at], odd[at], main_part[at])
                of_main = [(c, weight[at][i : j + 1].sum()) for lang, c, i, j, is_main in segs if lang == main and is_main]
                sure = float(sum(c * w for c, w in of_main) / sum(w for _, w in of_main)) if of_main else 0.0
                all_langs = sorted({langs[s[0]] for s in segs if s[4]})
                for no, (lang, c, i, j, is_main) in enumerate(segs):
                    out.append((k, own_label, no, langs[lang], c, " ".join(flat[at][i : j + 1]), is_main, langs[main], sure, all_langs))
            if out:
                yield pd.DataFrame(out, columns=columns)

    return prepared.mapInPandas(run, SEGMENTS)


def named_language(lang: Column) -> Column:
    """First subtag of a label without case; null where it names no language."""
    tag = F.trim(F.lower(F.regexp_extract(F.trim(lang), r"\A([^-_]*)", 1)))
    return F.when((tag == "") | (tag == "und"), F.lit(None).cast("string")).otherwise(tag)


def found(docs: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, found_lang): languages of pages whose label is missing or wrong, or that mix languages.

    A label of a known language stands where the page's language is not sure (UNSURE).
    A page comes out of one call with all its languages, so no shuffle follows.
    """
    keyed = docs.select("doc_id", "text", named_language(F.col("lang")).alias("label"))
    known = [r[0] for r in samples.select("lang").where("lang IS NOT NULL").distinct().collect()]
    first = segments(keyed, samples, label="label", whole=False).where("segment_no = 0")
    return first.where(
        (F.size("page_langs") > 1)
        | F.col("label").isNull()
        | ((F.col("label") != F.col("page_lang")) & ((F.col("page_confidence") >= UNSURE) | ~F.col("label").isin(known)))
    ).select("doc_id", F.explode("page_langs").alias("found_lang"))
