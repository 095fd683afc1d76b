"""Visually identical text with different characters: finding it and giving it one form.

A batch of Arrow strings is turned into one array of code points. Look-up tables built from the
Unicode character data say which points cannot be seen, which stand for another point or a
sequence, and which look like a letter of another script. Points are dropped, gathered and
expanded by array operations over the whole batch; marks are composed with their base by a sorted
table of pairs; no string function is called for a row.

Look-alike letters are decided by their surroundings: a letter of another script is one if its
word also has letters of the value's main script, or if it stands alone as a capital or is made of
look-alikes only while the value is in the other script. Single Greek letters that serve as
symbols stay; in text all of capitals, unless the Latin letter they look like is a word by itself.

Defined results: null gives null and is not affected; empty text stays. Full-width punctuation and
the ideographic space are ordinary beside ideographs or kana.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of other scripts and the Latin letters they look like.
LOOK_ALIKE = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ԝ": "W", "Ӏ": "I", "Ү": "Y", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ι": "i", "ϲ": "c", "ϳ": "j", "Ϲ": "C",
    # Armenian
    "Տ": "S", "Օ": "O", "Լ": "L", "հ": "h", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "զ": "q", "ռ": "n", "յ": "j",
}
#: Signs that look like an ordinary one whatever stands beside them.
ALWAYS = {"ɡ": "g", "‐": "-", "‑": "-", "⁃": "-", "˗": "-", "﹘": "-", "ı̇": "i", "ꞌ": "'", "ʻ": "'", "ǃ": "!", "⁄": "/", "∕": "/", "։": ":", "ː": ":", "᠆": "-"}
#: Letters that are words by themselves in languages of Latin script.
ALONE = "AEIOUWYZ"
#: Plain str.translate table of the look-alikes, for callers that need a rough fold of a string.
FOLD = {ord(k): v for k, v in LOOK_ALIKE.items()}
LATIN, CYRILLIC, GREEK, ARMENIAN, HAN, OTHER = range(1, 7)
SIZE = 0x110000


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """The look-up tables, from the Unicode character data."""
    script = np.zeros(SIZE, np.uint8)
    unseen = np.zeros(SIZE, bool)
    mark = np.zeros(SIZE, bool)
    space = np.zeros(SIZE, bool)
    wide = np.zeros(SIZE, bool)  # full-width punctuation
    upper = np.zeros(SIZE, bool)
    lower = np.zeros(SIZE, bool)
    rank = np.zeros(SIZE, np.uint8)  # combining class
    apart: dict[int, list[int]] = {}  # full canonical decompositions
    target = np.arange(SIZE, dtype=np.uint32)
    more: dict[int, list[int]] = {}
    pairs: dict[tuple[int, int], int] = {}
    for start, stop in ((0, 0xD800), (0xE000, 0x10000), (0x1D400, 0x1D800), (0x20000, 0x20100), (0xE0000, 0xE0200)):
        for o in range(start, stop):
            c = chr(o)
            cat = unicodedata.category(c)
            if cat == "Cn" or 0xAC00 <= o <= 0xD7A3:
                if cat != "Cn":
                    script[o] = OTHER
                continue
            if cat in ("Cf", "Cc") and c not in "\t\n\r" and not 0x600 <= o <= 0x8E2 or o in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0xFE00 <= o <= 0xFE0F:
                unseen[o] = True
                continue
            if cat == "Zs" and c != " ":
                space[o] = True
                target[o] = 32
                continue
            mark[o] = cat[0] == "M"
            rank[o] = unicodedata.combining(c)
            if cat[0] == "L":
                name = unicodedata.name(c, "")
                script[o] = next((s for p, s in (("LATIN", LATIN), ("FULLWIDTH LATIN", LATIN), ("CYRILLIC", CYRILLIC), ("GREEK", GREEK), ("ARMENIAN", ARMENIAN), ("CJK", HAN), ("HIRAGANA", HAN), ("KATAKANA", HAN)) if name.startswith(p)), OTHER)
                upper[o], lower[o] = cat == "Lu", cat == "Ll"
            form = unicodedata.decomposition(c)
            if not form:
                continue
            if form[0] == "<":
                kind = form[1 : form.index(">")]
                to = unicodedata.normalize("NFKC", c)
                ordinary = kind in ("wide", "font", "noBreak") or (kind == "compat" and (cat[0] == "L" or cat == "Nl") and not 0x3130 <= o <= 0x318F and not 0x0E00 <= o <= 0x0EFF)
                if ordinary and to != c:
                    wide[o] = kind == "wide" and cat[0] not in "LN"
                    target[o] = ord(to[0])
                    if len(to) > 1:
                        more[o] = [ord(x) for x in to]
            else:
                parts = [int(x, 16) for x in form.split()]
                to = unicodedata.normalize("NFC", c)
                apart[o] = [ord(x) for x in unicodedata.normalize("NFD", c)]
                if len(parts) == 1 and to != c:
                    target[o] = ord(to)
                elif len(parts) == 2 and to == c:
                    pairs[parts[0], parts[1]] = o
    for k, v in ALWAYS.items():
        if len(k) == 1:
            target[ord(k)] = ord(v)
    script[0x3005] = script[0x30FC] = HAN
    like = np.zeros(SIZE, np.uint32)
    back = np.zeros(SIZE, np.uint32)
    for k, v in LOOK_ALIKE.items():
        like[ord(k)] = ord(v)
        if script[ord(k)] == CYRILLIC:
            back[ord(v)] = ord(k)
    alone = np.zeros(SIZE, bool)
    alone[[ord(x) for x in ALONE]] = True
    key = np.array([a << 21 | b for a, b in pairs], np.int64)
    order = np.argsort(key)
    return {
        "script": script, "unseen": unseen, "mark": mark, "space": space, "wide": wide, "upper": upper, "lower": lower, "target": target, "like": like, "alone": alone, "back": back,
        "rank": rank, "apart": np.array(sorted(apart), np.uint32), "apart_to": np.array([(apart[k] + [0] * 4)[:4] for k in sorted(apart)], np.uint32),
        "pair": key[order], "composed": np.array(list(pairs.values()), np.uint32)[order],
        "long": np.array(sorted(more), np.uint32), "long_to": np.array([more[k] + [0] * (4 - len(more[k])) for k in sorted(more) if len(more[k]) <= 4], np.uint32) if all(len(v) <= 4 for v in more.values()) else np.array([(more[k] + [0] * 24)[:24] for k in sorted(more)], np.uint32),
    }


def points(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings, row of each)."""
    strings = strings.cast(pa.large_string())
    edges = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data is not None else np.zeros(0, np.uint8)
    cp = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(strings)), np.diff(edges))[(raw & 0xC0) != 0x80]
    return cp, row


def strings(cp: np.ndarray, row: np.ndarray, n: int, nulls: np.ndarray) -> pa.Array:
    """The inverse of :func:`points`."""
    size = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, weights=size, minlength=n).astype(np.int64))])
    body = cp.astype(np.uint32).tobytes().decode("utf-32-le").encode("utf-8")
    valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.tobytes()), pa.py_buffer(body), valid).cast(pa.string())


def expand(cp: np.ndarray, which: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with those of ``which`` replaced by the sequences in the rows of ``to``, source of
    each, place within its sequence); a sequence ends at the first 0."""
    size = np.ones(len(cp), np.int64)
    size[which] = (to > 0).sum(1)
    start = np.cumsum(size) - size
    src = np.repeat(np.arange(len(cp)), size)
    place = np.arange(len(src)) - start[src]
    line = np.full(len(cp), -1)
    line[which] = np.arange(len(which))
    replaced = line[src] >= 0
    new = cp[src].copy()
    new[replaced] = to[line[src[replaced]], place[replaced]]
    return new, src, place


def composed(cp: np.ndarray, row: np.ndarray, n: int, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points with marks in canonical order and joined to their base, row of each, whether a
    row changed). Bases that have marks are taken apart first; syllables of Hangul are put together."""
    same_row = np.append(False, row[1:] == row[:-1])
    follows = t["mark"][cp] & same_row
    jamo = (cp >= 0x1100) & (cp < 0x1200)
    if not follows.any() and not jamo.any():
        return cp, row, np.zeros(n, bool)
    before, before_row = cp, row
    touched = np.flatnonzero(follows | np.append(follows[1:], False))
    k = np.searchsorted(t["apart"], cp[touched]).clip(max=len(t["apart"]) - 1)
    ok = t["apart"][k] == cp[touched]
    cp, src, _ = expand(cp, touched[ok], t["apart_to"][k[ok]])
    row = row[src]
    # a segment is a base with the marks after it, stably sorted by their class
    rank = t["rank"][cp].astype(np.int64)
    rank[np.append(True, row[1:] != row[:-1])] = 0  # a mark at the start is its own base
    segment = np.cumsum(rank == 0) - 1
    order = np.lexsort((rank, segment))
    cp, rank = cp[order], rank[order]
    first = np.flatnonzero(rank == 0)
    size = np.diff(np.append(first, len(cp)))
    base, last, keep = cp[first].copy(), np.zeros(len(first), np.int64), np.ones(len(cp), bool)
    alive = np.flatnonzero(size > 1)
    place = 1
    while len(alive):
        at = first[alive] + place
        key = base[alive].astype(np.int64) << 21 | cp[at]
        k = np.searchsorted(t["pair"], key).clip(max=len(t["pair"]) - 1)
        joins = (t["pair"][k] == key) & (last[alive] < rank[at])
        base[alive[joins]] = t["composed"][k[joins]]
        keep[at[joins]] = False
        last[alive[~joins]] = rank[at[~joins]]
        place += 1
        alive = alive[size[alive] > place]
    cp = cp.copy()
    cp[first] = base
    cp, row = cp[keep], row[keep]
    # bases that join the base before them: spacing marks, Hangul vowels and final consonants
    while len(cp) > 1:
        beside = (row[1:] == row[:-1]) & (t["rank"][cp[1:]] == 0)
        a, b = cp[:-1].astype(np.int64), cp[1:].astype(np.int64)
        at = np.flatnonzero(beside & t["mark"][cp[1:]])
        k = np.searchsorted(t["pair"], a[at] << 21 | b[at]).clip(max=len(t["pair"]) - 1)
        ok = t["pair"][k] == (a[at] << 21 | b[at])
        to = np.zeros(len(a), np.int64)
        to[at[ok]] = t["composed"][k[ok]]
        lv = beside & (a >= 0x1100) & (a <= 0x1112) & (b >= 0x1161) & (b <= 0x1175)
        to[lv] = 0xAC00 + ((a[lv] - 0x1100) * 21 + b[lv] - 0x1161) * 28
        lvt = beside & (a >= 0xAC00) & (a <= 0xD7A3) & ((a - 0xAC00) % 28 == 0) & (b >= 0x11A8) & (b <= 0x11C2)
        to[lvt] = a[lvt] + b[lvt] - 0x11A7
        at = np.flatnonzero(to)
        at = at[np.append(True, np.diff(at) > 1)] if len(at) else at
        if not len(at):
            break
        cp[at] = to[at]
        keep = np.ones(len(cp), bool)
        keep[at + 1] = False
        cp, row = cp[keep], row[keep]
    changed = np.bincount(before_row, minlength=n) != np.bincount(row, minlength=n)
    i, j = ~changed[before_row], ~changed[row]
    changed[row[j][before[i] != cp[j]]] = True
    return cp, row, changed


def canonical(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the values in one consistent form, whether each had characters that only look ordinary)."""
    t = tables()
    n = len(values)
    nulls = np.asarray(values.is_null())
    cp, row = points(values)
    hit = np.zeros(n, bool)
    note = lambda at: hit.__setitem__(row[at], True)
    han = np.bincount(row, weights=t["script"][cp] == HAN, minlength=n) > 0
    # what can't be seen
    gone = t["unseen"][cp]
    note(gone)
    cp, row = cp[~gone], row[~gone]
    # marks beside their base
    cp, row, changed = composed(cp, row, n, t)
    hit |= changed
    # points that stand for others
    ordinary = (t["wide"][cp] | (cp == 0x3000)) & han[row]
    new = np.where(ordinary, cp, t["target"][cp])
    note(new != cp)
    if len(t["long"]) and len(cp):
        k = np.searchsorted(t["long"], cp).clip(max=len(t["long"]) - 1)
        is_long = (t["long"][k] == cp) & ~ordinary
        if is_long.any():
            new, src, _ = expand(new, np.flatnonzero(is_long), t["long_to"][k[is_long]])
            row = row[src]
    cp = new
    # look-alike letters
    s = t["script"][cp]
    is_letter = (s > 0) | t["mark"][cp]
    begin = is_letter & ~(np.append(False, is_letter[:-1]) & np.append(False, row[1:] == row[:-1]))[: len(cp)]
    word = np.cumsum(begin) - 1
    if begin.any():
        m = int(begin.sum())
        w = word[is_letter]
        of = lambda k: np.bincount(w, weights=s[is_letter] == k, minlength=m).astype(int)
        latin, cyr = of(LATIN), of(CYRILLIC)
        foreign = cyr + of(GREEK) + of(ARMENIAN)
        alike = np.bincount(w, weights=t["like"][cp[is_letter]] > 0, minlength=m).astype(int)
        first = np.flatnonzero(begin)
        wrow = row[first]
        v_latin, v_cyr = (np.bincount(wrow, weights=x, minlength=n) for x in (latin, cyr))
        pure = latin * (foreign == 0)
        v_pure_latin = np.bincount(wrow, weights=pure, minlength=n)
        v_pure_cyr = np.bincount(wrow, weights=cyr * (latin == 0) * (alike < cyr), minlength=n)
        mixed = (latin > 0) & (foreign > 0)
        # a value in Latin letters: look-alikes in mixed words, and words of look-alikes only
        in_latin = (v_latin[wrow] + 0.0 >= v_cyr[wrow]) & (v_pure_cyr[wrow] == 0) | (latin > foreign)
        single = (foreign == 1) & (latin == 0)
        sign = single & (s[first] == GREEK)
        before = np.where(first > 0, cp[np.maximum(first - 1, 0)], 32)
        after = np.where(first + 1 < len(cp), cp[np.minimum(first + 1, len(cp) - 1)], 32)
        capital = t["upper"][cp[first]]
        hyphen = (before == 45) | (after == 45)
        # in capitals throughout, one that stands alone is a symbol, too, unless the Latin letter it
        # looks like is a word or it is an initial
        has_lower = np.bincount(row, weights=t["lower"][cp] & (s == LATIN), minlength=n) > 0
        symbol = sign & (~capital | hyphen | (~has_lower[wrow] & (after != 46) & ~t["alone"][t["like"][cp[first]]]))
        whole = (latin == 0) & (foreign > 0) & (alike == foreign) & ~symbol & (v_pure_latin[wrow] > 0) & (v_pure_cyr[wrow] == 0)
        to_latin = (mixed & in_latin) | whole
        to_cyr = mixed & ~in_latin
        inside = np.flatnonzero(is_letter)
        change = inside[to_latin[w] & (t["like"][cp[inside]] > 0)]
        changed = cp.copy()
        changed[change] = t["like"][cp[change]]
        note(change)
        change = inside[to_cyr[w] & (s[inside] == LATIN) & (t["back"][cp[inside]] > 0)]
        changed[change] = t["back"][cp[change]]
        note(change)
        cp = changed
    return strings(cp, row, n, nulls), hit & ~nulls


def normalize(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns, and for each string column of ``columns``: ``<c>`` in one form and
    ``<c>_affected``."""
    kinds = {c: df.schema[c].dataType.simpleString() for c in keep}
    schema = ", ".join([f"`{c}` {k}" for c, k in kinds.items()] + [f"`{c}` string, `{c}_affected` boolean" for c in columns])

    def run(batches):
        for b in batches:
            out = [b.column(i) for i in range(len(keep))]
            for i in range(len(columns)):
                text, hit = canonical(b.column(len(keep) + i))
                out += [text, pa.array(hit)]
            yield pa.RecordBatch.from_arrays(out, [*keep, *[x for c in columns for x in (c, f"{c}_affected")]])

    return df.select(*keep, *columns).mapInArrow(run, schema)


def found(cases: DataFrame, openalex: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name) of values with characters that only look ordinary.

    Values that the garble finder counts are not among them.
    """
    from refaudit.llm import mojibake

    titles = cases.select(F.col("case_id").alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f"{s}.title").alias("field_name"), F.col(f"{s}.title").alias("text")) for s in ("original", "candidate")])).alias("v")).select("row_id", "v.*").where("text is not null")
    names = openalex.select(F.col("rec_id").alias("row_id"), F.lit("display_name").alias("field_name"), F.explode("authorships.author.display_name").alias("text")).where("text is not null")
    odd = r"[^\x20-\x7e]"  # plain ASCII has nothing to find
    seen = normalize(titles.where(F.col("text").rlike(odd)).withColumn("raw", F.col("text")), ["text"], ["row_id", "field_name", "raw"]).where("text_affected")
    known = mojibake.of_cases(cases)

    @F.pandas_udf("boolean")
    def garbled(s):
        return s.map(lambda x: mojibake.restore(x, known)[1] or mojibake.has_lost(x)).astype(bool)

    seen = seen.where(~((F.col("field_name") == "original.title") & garbled("raw")))
    people = normalize(names.where(F.col("text").rlike(odd)), ["text"], ["row_id", "field_name"]).where("text_affected").select("row_id", "field_name").distinct()
    return seen.select(F.lit("cases").alias("table_name"), "row_id", "field_name").unionByName(people.select(F.lit("search_openalex").alias("table_name"), "row_id", "field_name"))
