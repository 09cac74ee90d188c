"""One plain form for texts that look the same but differ in their characters.

Nodes are code points and short strings that the corpus holds; edges join forms that
look alike: compatibility forms, letters with their marks apart, invisible characters
and nothing, spaces, letters of the same shape in several scripts. Union-find makes the
classes transitive. Every rewrite is a class's: a member that is not plain becomes the
most frequent plain member of its class in its own script, a letter of another script
inside a word the most frequent one in the script of that word. Texts are rewritten
greedily, leftmost and longest first, by one multi-pattern automaton. ``look`` is the
text with every letter replaced by the most frequent member of its class whatever its
script, without case: texts that look alike have one look, also where each is written
in a single script and plain, so that only the look can compare them.

Scale: one pass counts characters and combining sequences with a counter per batch and
a shuffle of distinct units; the driver holds distinct units only (code points, and
sequences of at most ``SEQUENCE`` code points: bounded by the character repertoire, not
by rows). A second pass rewrites without a shuffle. Longer sequences are composed
directly, so none is left out.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cartomill import runtime

#: Most code points of a sequence (letter and marks) that becomes a node.
SEQUENCE = 3
#: Letters of one shape, by Latin, Cyrillic, Greek and Armenian.
SHAPES = """
AАΑ BВΒ CСϹ EЕΕ FϜ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟՕ PРΡ QԚ SЅՏ TТΤ VѴ WԜ XХΧ YУΥҮ ZΖ ГΓ ПΠ ФΦ ΛЛ
aаα bЬ cсϲ dԁ eе fք gց hһհ iіι jјϳ kкκ lӏ mм nпη oоοօ pрρ qԛզ rгᴦ sѕ tтτ uυս vνѵ wԝω xхχ yуγү zᴢ βв фφ εє
""".split()
#: Letters and marks that show nothing, beside format and control characters.
BLANKS = "͏ᅟᅠ឴឵ㅤﾠ"
EAST = {"CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "IDEOGRAPHIC", "BOPOMOFO", "HANGUL"}

_script_memo: dict[str, str] = {}


def is_invisible(ch: str) -> bool:
    kind = unicodedata.category(ch)
    if kind == "Cc":
        return not ch.isspace()
    return kind == "Cf" or ch in BLANKS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF or 0x180B <= ord(ch) <= 0x180F


def is_odd_space(ch: str) -> bool:
    return ch != " " and ch.isspace()


def script(ch: str) -> str:
    """Script of a letter, empty for others; the East Asian scripts that stand together are one."""
    s = _script_memo.get(ch)
    if s is None:
        s = ""
        if unicodedata.category(ch)[0] == "L":
            s = unicodedata.name(ch, "?").split()[0]
            s = "EAST" if s in EAST else s
            s = "" if s in ("MODIFIER", "FEMININE", "MASCULINE", "MICRO") else s
        _script_memo[ch] = s
    return s


def units(text: str) -> Iterator[str]:
    """Code points, and letters with the marks that follow once invisible characters are gone."""
    yield from text
    seen = "".join(c for c in text if not is_invisible(c))
    i = 0
    while i < len(seen):
        j = i + 1
        while j < len(seen) and (unicodedata.combining(seen[j]) or seen[j] in "ﾞﾟ"):
            j += 1
        if 1 < j - i <= SEQUENCE:
            yield seen[i:j]
        i = j


class Classes:
    """Union-find over code points and strings."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        root = x
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[x] != root:
            self.parent[x], x = root, self.parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def composed(text: str) -> str:
    """Without compatibility forms, marks composed."""
    return unicodedata.normalize("NFKC", text)


def is_plain(unit: str) -> bool:
    return unit == composed(unit) and not any(is_invisible(c) or is_odd_space(c) for c in unit)


def unit_script(unit: str) -> str:
    """Script of the letters of a unit, or empty where they have none or several."""
    seen = {script(c) for c in unit} - {""}
    return seen.pop() if len(seen) == 1 else ""


class Tables:
    """What the classes of a corpus say: rewrites, letters by (letter, script), looks, and the classes of two or more."""

    def __init__(self, rewrites: dict[str, str], letters: dict[tuple[str, str], str], looks: dict[str, str], classes: dict[str, list[str]]):
        self.rewrites, self.letters, self.looks, self.classes = rewrites, letters, looks, classes


def build(counts: dict[str, int]) -> Tables:
    """The tables for the units of a corpus.

    rewrites: a member that is plain in no script -> the representative in its own
    script, the plain form's; letters: (letter, script) -> the representative in that
    script; looks: a plain letter -> the representative over all scripts. A
    representative is the most frequent plain member; ties go to the least code point.
    """
    classes = Classes()
    nodes = set(counts)
    twins: dict[str, list[str]] = {}
    for group in SHAPES:
        for a in group:
            twins.setdefault(a, []).extend(b for b in group if b != a)
            nodes.add(a)
    for x in sorted(nodes):
        if len(x) == 1 and is_invisible(x):
            classes.union(x, "")
            continue
        if len(x) == 1 and is_odd_space(x):
            classes.union(x, " ")
            continue
        classes.find(x)
        plain = composed(x)
        if plain != x:
            classes.union(x, plain)
        apart = unicodedata.normalize("NFD", plain)
        for b in twins.get(apart[:1], ()):
            twin = unicodedata.normalize("NFC", b + apart[1:])
            if len(apart) == 1 or len(twin) == 1:
                classes.union(plain, twin)
    groups = classes.groups()
    rewrites: dict[str, str] = {}
    letters: dict[tuple[str, str], str] = {}
    looks: dict[str, str] = {}
    rank = lambda m: (-counts.get(m, 0), m)
    for members in groups.values():
        plain = sorted((m for m in members if is_plain(m)), key=rank)
        # of one script and as many code points: a class may hold a letter and a string that shows as it
        best: dict[tuple[str, int], str] = {}
        for m in plain:
            best.setdefault((unit_script(m), len(m)), m)
        for m in members:
            if not is_plain(m):
                # a class with nothing or a space in it has no other plain member
                form = composed(m) if not any(x in ("", " ") for x in plain) else plain[0]
                rewrites[m] = best.get((unit_script(form), len(form)), form)
            elif len(m) == 1 and script(m):
                for (s, n), rep in best.items():
                    if n == 1 and s not in ("", script(m)):
                        letters[(m, s)] = rep
                looks[m] = next(x for x in plain if len(x) == 1 and script(x))
    return Tables(rewrites, letters, {a: b for a, b in looks.items() if a != b}, {k: v for k, v in groups.items() if len(v) > 1})


class Rewriter:
    """Greedy rewriting with an automaton of all patterns, then letters by the word's script."""

    def __init__(self, tables: Tables, common: dict[str, int]):
        import ahocorasick

        rewrites = tables.rewrites
        self.letters, self.looks, self.common = tables.letters, str.maketrans(tables.looks), common
        self.automaton = ahocorasick.Automaton()
        for pattern, rep in rewrites.items():
            self.automaton.add_word(pattern, (len(pattern), rep))
        if rewrites:
            self.automaton.make_automaton()
        self.any = bool(rewrites)

    def once(self, text: str) -> str:
        out, last = [], 0
        for end, (n, rep) in self.automaton.iter_long(text):
            start = end - n + 1
            out.append(text[last:start])
            out.append(rep)
            last = end + 1
        out.append(text[last:])
        return "".join(out)

    def mixed(self, text: str) -> bool:
        return any(len({script(c) for c in w if script(c)}) > 1 for w in words(text))

    def one_script(self, word: str) -> str:
        seen = Counter(script(c) for c in word if script(c))
        if len(seen) < 2:
            return word
        sure = Counter(s for c in word if (s := script(c)) and not any((c, o) in self.letters for o in seen if o != s))
        to = max(seen, key=lambda s: (sure[s], seen[s], self.common.get(s, 0), s))
        return "".join(self.letters.get((c, to), c) if script(c) not in ("", to) else c for c in word)

    def plain(self, text: str | None) -> str | None:
        """The plain form; null stays null, empty stays empty."""
        if text is None or (text.isascii() and text.isprintable()):
            return text
        if self.any:
            while (new := self.once(text)) != text:
                text = new
        # sequences longer than the table's and characters it has not seen
        if any(is_invisible(c) or is_odd_space(c) for c in text):
            text = "".join(" " if is_odd_space(c) else c for c in text if not is_invisible(c))
        text = composed(text)
        if self.mixed(text):
            out, last = [], 0
            for start, stop in spans(text):
                out.append(text[last:start])
                out.append(self.one_script(text[start:stop]))
                last = stop
            text = "".join(out) + text[last:]
        return text

    def is_case(self, text: str | None, plain: str | None) -> bool:
        """Some character is not the plain one, or scripts still mix within a word."""
        return plain != text or (text is not None and not text.isascii() and self.mixed(plain))

    def look(self, plain: str | None) -> str | None:
        """What a plain text looks like: one for all texts that look alike, without case; null stays null."""
        return None if plain is None else plain.translate(self.looks).lower().translate(self.looks)


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Words: runs of letters and marks; East Asian letters stand on their own."""
    start = None
    for i, c in enumerate(text):
        inside = (script(c) != "EAST") and unicodedata.category(c)[0] in "LM"
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            yield start, i
            start = None
    if start is not None:
        yield start, len(text)


def words(text: str) -> list[str]:
    return [text[a:b] for a, b in spans(text)]


def fit(texts: DataFrame, col: str) -> tuple[Tables, dict[str, int]]:
    """The tables and the letters of each script, from all texts of a column."""
    runtime.ship_package(texts.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for t in b["text"]:
                if t:
                    seen.update(units(t))
            if seen:
                yield pd.DataFrame({"unit": list(seen), "n": list(seen.values())})

    rows = (
        texts.select(F.col(col).alias("text")).where(F.col("text").isNotNull())
        .mapInPandas(count, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")).collect()
    )  # distinct characters and short sequences
    counts = {r["unit"]: r["n"] for r in rows}
    scripts: Counter = Counter()
    for u, n in counts.items():
        if len(u) == 1 and script(u):
            scripts[script(u)] += n
    return build(counts), dict(scripts)


def rewrite(df: DataFrame, key_cols: list[str], col: str) -> DataFrame:
    """key_cols, text, plain, look, is_case of every row; null and empty texts are their own plain form and look.

    Rows are kept as they are, repeated ones included; columns beside those named are
    not read, whatever their names.
    """
    spark = df.sparkSession
    tables, scripts = fit(df, col)
    # bounded by the character repertoire
    shared = spark.sparkContext.broadcast((tables, scripts))
    named = df.select(*[F.col(k) for k in key_cols], F.col(col).alias("text"))
    schema = StructType(list(named.schema.fields)).add("plain", "string").add("look", "string").add("is_case", "boolean")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Rewriter(*shared.value)
        for b in batches:
            texts = [None if t is None or t != t else t for t in b["text"]]
            plain = [r.plain(t) for t in texts]
            b["text"] = pd.Series(texts, index=b.index, dtype=object)
            b["plain"] = pd.Series(plain, index=b.index, dtype=object)
            b["look"] = pd.Series([r.look(p) for p in plain], index=b.index, dtype=object)
            b["is_case"] = [r.is_case(t, p) for t, p in zip(texts, plain)]
            yield b

    return named.mapInPandas(run, schema)


def fields(cities: DataFrame, areas: DataFrame) -> DataFrame:
    """record_kind, record_key, field_name, text of the name fields; one row per alias."""
    part = lambda df, kind, key, field, text: df.select(
        F.lit(kind).alias("record_kind"), F.col(key).cast("string").alias("record_key"), F.lit(field).alias("field_name"), text.alias("text")
    )
    return (
        part(cities, "city", "id", "aliases", F.explode("aliases"))
        .unionByName(part(cities, "city", "id", "zhName", F.col("zhName")))
        .unionByName(part(areas, "area", "areaId", "nameLocal", F.col("nameLocal")))
    )


def found(cities: DataFrame, areas: DataFrame) -> DataFrame:
    """Fields in which some character is not the plain one."""
    return (
        rewrite(fields(cities, areas), ["record_kind", "record_key", "field_name"], "text")
        .where("is_case").select("record_kind", "record_key", "field_name").distinct()
    )
