"""One consistent form of visually identical text.

A transducer is compiled once: the rules are written out for every code point, and for
letters with their marks, and checked for conflicts. It walks a text in one pass by
grapheme clusters (an emoji sequence, a base with all its marks and invisible characters, a
line end, a single character), takes the longest known unit at each place and writes its
consistent form. Width, kind of blank, order and composition of accents,
invisible characters, ligatures and look-alike letters are levelled; case, accents,
raised digits, number of blanks, punctuation and emoji stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tonewright.session import cut

#: Fixed values, of the public Unicode confusables: letters that look like the Latin letter named first.
LOOK_ALIKES = {
    "a": "аɑα", "b": "Ьƅ", "c": "сϲᴄ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "іιɩ", "j": "јϳյ",
    "l": "ӏ", "n": "ո", "o": "оοօᴏσ", "p": "рρ", "q": "ԛզ", "r": "г", "s": "ѕꜱ", "u": "սυᴜ", "v": "νѵᴠ",
    "w": "ԝѡᴡ", "x": "хχ", "y": "уүγ", "z": "ᴢ", "ß": "β",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ",
    "L": "Լ", "M": "МΜ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "Ѵ",
    "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}

#: Kinds of compatibility decompositions that don't change the look of a letter or digit.
SAME_LOOK = ("<wide>", "<narrow>", "<font>")
ZWJ = "‍"


#: Past these planes only variation selectors matter; scanning less keeps the compilation short.
_SCANNED = (*range(0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200))


def _ranges(points: list[int]) -> str:
    """A character class of ascending code points."""
    out, start, last = [], None, None
    for cp in [*points, 1 << 30]:
        if last is None or cp != last + 1:
            if start is not None:
                out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = cp
        last = cp
    return "".join(out)


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" and ch != "­" and not 0x600 <= ord(ch) <= 0x8FF or ch in "­͏ᅟᅠ឴឵᠋᠌᠍᠎ㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


def _pictograph(ch: str) -> bool:
    cp = ord(ch)
    return 0x1F000 <= cp <= 0x1FAFF and not 0x1F3FB <= cp <= 0x1F3FF or 0x2600 <= cp <= 0x27BF or 0x2B00 <= cp <= 0x2BFF


class Conflict(ValueError):
    """Two rules give one unit two forms, or a form has a form of its own."""


def compile_mapping(look_alikes: dict[str, str]) -> dict[int, str]:
    """The mapping of look-alike characters, closed under itself; raises :class:`Conflict`."""
    table: dict[int, str] = {}
    for target, sources in look_alikes.items():
        for s in sources:
            if table.get(ord(s), target) != target:
                raise Conflict(f"U+{ord(s):04X} would become {table[ord(s)]!r} and {target!r}")
            table[ord(s)] = target
    for target in look_alikes:
        if ord(target) in table:
            raise Conflict(f"{target!r} is a target and has a form of its own")
    return table


def compile_units(look_alikes: dict[str, str]) -> dict[str, str]:
    """Every unit that has another form, with it: single characters and, longer, line ends and letters with their marks.

    All rules are written out for every scanned code point before any text is read. A rule
    that gives a unit a second form is a :class:`Conflict`, and so is a form that isn't its own.
    """
    alike = compile_mapping(look_alikes)
    units: dict[str, str] = {}

    def put(unit: str, form: str) -> None:
        if units.setdefault(unit, form) != form:
            raise Conflict(f"{unit!a} would become {units[unit]!a} and {form!a}")

    level = lambda text: unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(alike))
    for end in ("\r\n", "\r", "\x0b", "\x0c", "\u2028", "\u2029", "\x85"):
        put(end, "\n")
    put("\t", " ")
    for cp in alike:
        put(chr(cp), level(chr(cp)))
    for cp in _SCANNED:
        ch = chr(cp)
        kind, _, points = unicodedata.decomposition(ch).partition(" ")
        if _invisible(ch):
            put(ch, "")
        elif unicodedata.category(ch) == "Zs":
            if ch != " ":
                put(ch, " ")
        elif kind in SAME_LOOK or kind == "<compat>" and 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F:
            put(ch, level(unicodedata.normalize("NFKC", ch)))
        elif (form := level(ch)) != ch:
            put(ch, form)
        # a letter apart from its marks has the form of the letter with them
        if kind and not kind.startswith("<") and len(apart := unicodedata.normalize("NFD", ch)) > 1:
            put(apart, level(apart))
    for unit, form in units.items():
        if form != unit and any(units.get(c, c) != c for c in form):
            raise Conflict(f"the form {form!a} of {unit!a} has a form of its own")
    return units


class Transducer:
    """Compiled form of the mapping. Equal look gives equal output; applying it twice changes nothing."""

    def __init__(self, look_alikes: dict[str, str] | None = None):
        self._units = compile_units(LOOK_ALIKES if look_alikes is None else look_alikes)
        # the units as a tree of characters; a unit ends where "" is
        self._tree: dict = {}
        for unit, form in self._units.items():
            node = self._tree
            for ch in unit:
                node = node.setdefault(ch, {})
            node[""] = form
        category = unicodedata.category
        mark = _ranges([cp for cp in _SCANNED if category(chr(cp))[0] == "M"])
        hidden = _ranges([cp for cp in _SCANNED if _invisible(chr(cp))])
        pic = _ranges([cp for cp in _SCANNED if _pictograph(chr(cp))])
        tone = "\\U0001f3fb-\\U0001f3ff"
        # grapheme clusters, longest first: emoji joined to a next emoji; base with marks and invisible characters; line ends; the rest
        self._cluster = re.compile(
            f"[{pic}][{tone}]?\ufe0f?{ZWJ}(?=[{pic}])|[^{mark}{hidden}]?[{mark}{hidden}]+|\r\n?|[^\x00-\x7f]|[\t\x0b\x0c]"
        )
        # what differs from plain ASCII, with the character that its first mark may belong to
        self._run = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")
        self._line = re.compile("\r\n?|[\t\x0b\x0c]")
        self._memo: dict[str, str] = {}
        self._runs: dict[str, str] = {}

    def _walk(self, cluster: str) -> str:
        """The cluster's form: the longest known unit at each place, then composed."""
        out, i = [], 0
        while i < len(cluster):
            node, j, form, end = self._tree, i, cluster[i], i + 1
            while j < len(cluster) and (node := node.get(cluster[j])) is not None:
                j += 1
                if "" in node:
                    form, end = node[""], j
            out.append(form)
            i = end
        form = "".join(out)
        # marks in another order, or parted by what can't be seen, meet only now
        return form if len(cluster) == 1 else unicodedata.normalize("NFC", "".join(self._units.get(c, c) for c in unicodedata.normalize("NFC", form)))

    def _form(self, match: re.Match) -> str:
        unit = match.group()
        form = self._memo.get(unit)
        if form is None:
            if unit[-1] == ZWJ and _pictograph(unit[0]) and unit != unit[0] + ZWJ:
                unit = unit.replace("\ufe0f", "")
            joins = unit[-1] == ZWJ and match.end() < len(match.string) and _pictograph(unit[0]) and _pictograph(match.string[match.end()])
            form = unit[:-1].replace("\ufe0f", "") + ZWJ if joins else self._walk(unit)
            unit = match.group()
            if len(unit) < 16 and not _pictograph(unit[0]):
                if len(self._memo) > 100_000:
                    self._memo.clear()
                self._memo[unit] = form
        return form

    def _other(self, match: re.Match) -> str:
        """The form of a run of other than ASCII characters and the one before it."""
        run = match.group()
        form = self._runs.get(run)
        if form is None:
            form = self._cluster.sub(self._form, run)
            if len(run) < 32:
                if len(self._runs) > 100_000:
                    self._runs.clear()
                self._runs[run] = form
        return form

    def __call__(self, text: str) -> str:
        if "\r" in text or "\t" in text or "\x0b" in text or "\x0c" in text:
            text = self._line.sub(self._form, text)
        # ASCII is copied as it is; every other cluster lies in one run
        return text if text.isascii() else self._run.sub(self._other, text)


_READY: list[Transducer] = []


def transducer() -> Transducer:
    """The one transducer of this process; compiled at its first use."""
    if not _READY:
        _READY.append(Transducer())
    return _READY[0]


def _consistent(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    run = transducer()
    for texts in batches:
        yield texts.map(run, na_action="ignore")


def consistent(text: Column) -> Column:
    """The consistent form of a text; NULL stays NULL and an empty text empty."""
    return F.pandas_udf(_consistent, "string")(text)


def _digest_pairs(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    run = transducer()
    for texts in batches:
        raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        forms = [None if t is None else run(t).encode("utf-8", "surrogatepass") for t in texts]
        yield pd.DataFrame({"look": [b and blake2b(b, digest_size=16).digest() if b != b"" else b for b in forms], "exact": [b and blake2b(b, digest_size=16).digest() if b != b"" else b for b in raw]})


def looks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, look, exact``: 128-bit digests of the consistent form and of the text itself.

    Rows with a NULL id or NULL text are left out; an empty text has empty digests. Only the
    digests leave the task, never the texts.
    """
    both = F.pandas_udf(_digest_pairs, "look binary, exact binary")(F.col(text_col)).alias("_d")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col)).where(F.col("id").isNotNull() & F.col(text_col).isNotNull())
    return rows.select("id", both).select("id", "_d.look", "_d.exact")


def look_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id, class_id, documents, spellings, links``.

    ``class_id`` is the smallest id with the same look, ``documents`` and ``spellings`` count
    the class and its different strings, ``links`` the documents that look the same but are
    another string. Counts are joined to the digests, so a class may be of any size.
    """
    rows = cut(looks(df, id_col, text_col))  # texts are read once; digests are small
    exact = rows.groupBy("look", "exact").agg(F.count(F.lit(1)).alias("same"), F.min("id").alias("first"))
    classes = exact.groupBy("look").agg(F.min("first").alias("class_id"), F.sum("same").alias("documents"), F.count(F.lit(1)).alias("spellings"))
    return (
        rows.join(exact.select("look", "exact", "same"), ["look", "exact"])
        .join(classes, "look")
        .select("id", "class_id", "documents", "spellings", (F.col("documents") - F.col("same")).alias("links"))
    )


def look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = 2000) -> DataFrame:
    """``id_a < id_b``: every two documents with the same look whose strings differ.

    Classes with one string only are left out before anything is paired. The members of a
    large class are dealt into blocks of about ``block`` rows, so its pairs are made by many
    tasks. Documents with a NULL text or id aren't paired; documents with one id neither.
    """
    rows = cut(looks(df, id_col, text_col))  # texts are read once; digests are small
    mixed = (
        rows.groupBy("look")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("exact").alias("_lo"), F.max("exact").alias("_hi"))
        .where(F.col("_lo") != F.col("_hi"))
        .select("look", F.ceil(F.col("_n") / F.lit(block)).alias("_blocks"))
    )
    members = rows.join(mixed, "look")
    left = members.select("look", F.pmod(F.xxhash64("id"), "_blocks").alias("_b"), F.col("id").alias("id_a"), F.col("exact").alias("_x"))
    right = members.select("look", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_b"), F.col("id").alias("id_b"), F.col("exact").alias("_y"))
    return left.join(right, ["look", "_b"]).where((F.col("id_a") < F.col("id_b")) & (F.col("_x") != F.col("_y"))).select("id_a", "id_b")
