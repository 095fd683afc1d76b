"""Text that was decoded with a wrong code page: finding it and restoring it.

A wrong code page turns each letter of a value into a fixed sequence of other characters, so a
misread value is a substitution cipher whose key belongs to the swap of code pages that it went
through, its source. The operator cuts values into cipher units (the characters that can come from
the bytes of one letter), counts every unit with its neighbours over the whole corpus, and learns by
expectation-maximization against the letter bigrams of the clean values, for each source, how often
a unit is a cipher at all and which letter it stands for. The mapping starts unknown: every letter
that a code page can change (all but ASCII) is equally likely, and what the bytes of the unit give
counts as one more observation. A unit is a cipher if the learned letter is that of its bytes, or if
the letter of its bytes fits the neighbours on its own (rare letters, and the first turn of twice
misread text). It is replaced by the letter of its bytes; swaps of single-byte pages are
applied by ``str.translate``, others unit by unit. Units of a multi-byte page (gb18030) are decided
by decoding alone. Twice misread text is restored in turns.

Letters that were lost (replacement characters, or question marks inside words) cannot be
restored; such values are found but keep the lost places.

Defined results: null and empty values are not garbled; HTML escapes count only if what they
stand for is garbled. A question mark after a word is a lost letter unless it ends a question.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.session import materialize

#: Code pages that UTF-8 text may have been read with. Latin-1 fills the bytes that
#: cp1252 leaves undefined, as browsers do.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251", "cp1250")
WIDE_PAGE = "gb18030"
#: Words that open a question, in the languages of Latin and Cyrillic script.
ASKING = frozenset(
    "can could do does did is are was were has have how what why when where which who whose should will would may must "
    "comment pourquoi quand qui que quel quelle quels quelles est wie was warum wann wo wer welche welcher welches kann sind "
    "cómo qué quién cuándo dónde cuál por come perché quando dove chi quale como quem onde qual hoe wat waarom wanneer waar wie welke "
    "hur vad varför när var vem vilken jak co dlaczego kiedy gdzie kto czy quo quid quis cur ubi как что почему когда где кто".split()
)
ROUNDS = 25
#: A unit is read as a cipher when the mapping gives its letter at least this probability.
SURE = 0.5
#: Observations that the bytes of a unit count for.
BYTES = 1.0


def _page_chars(page: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


@lru_cache(maxsize=None)
def _page(page: str) -> tuple[re.Pattern, dict[str, int]]:
    """The pattern of a unit under a page, and the byte of each character."""
    chars = _page_chars(page)
    some = lambda a, b: "[" + "".join(re.escape(chars[i]) for i in range(a, b + 1)) + "]"
    rest = some(0x80, 0xBF)
    return re.compile(f"{some(0xC3, 0xDF)}{rest}|{re.escape(chars[0xC2])}{some(0x80 if page in ("cp1252", "latin-1") else 0xA0, 0xBF)}|{some(0xE0, 0xEF)}{rest}{{2}}|{some(0xF0, 0xF4)}{rest}{{3}}"), {c: i for i, c in enumerate(chars)}


CYRILLIC_PAGES = ("cp1251", "koi8-r", "cp866")
#: What shows that a value is Cyrillic text of one page read with another: runs of high Latin
#: letters, letters in the wrong case, signs and box drawings among letters.
LATIN_RUN = re.compile(r"[\u00c0-\u00ff\u00a8\u00b8\u00a3\u00b3]{3,}|(?<=[\u00c0-\u00ff] )[\u00c0-\u00ff]{1,2}(?= [\u00c0-\u00ff])")
WRONG_CASE = re.compile(r"(?<![\u0400-\u04ff])[\u0430-\u044f\u0451][\u0410-\u042f\u0401]{2,}")
SIGNS = re.compile(r"[\u2500-\u25a0](?=[\u0430-\u044f\u2500-\u25a0])|(?<=[\u0430-\u043f\u0410-\u041f])[\u00a0\u00a4-\u00b1\u040e\u045e\u0402\u0403\u2018-\u2022](?=[\u0430-\u043f\u00a0-\u00b1])")
#: Frequent Cyrillic letters, by which one of several readings is preferred.
FREQUENT = frozenset("оеаинтср")
#: Latin text of one byte a letter, read with a page of the DOS era: signs between letters.
DOS_PAGES = ("cp437", "cp850")
ANY_HIGH = re.compile(r"[^\x00-\x7f]")
#: Characters that a multi-byte page makes of the bytes of other text.
WIDE = r"\u2e80-\u9fff\uac00-\ud7ff\uf900-\ufaff\uff00-\uffef\u20ac\ue000-\uf8ff"
WIDE_RUN = re.compile(f"[{WIDE}]+[\\x40-\\x7e]?")
ESCAPES = re.compile(r"&[A-Za-z]{2,8};|&#x?[0-9A-Fa-f]+;")
LOST_INSIDE = re.compile(r"\w\?\w|(?:^|[\s{(\[“\"'-])\?+\w|(?:^|\s)\?+(?=\s|$)|\d\?\?", re.U)
LOST_AFTER = re.compile(r"\w\?", re.U)
CLAUSE_START = re.compile(r"(?:^|[.:;,!?–—]\s)[\W_]*(\w+)", re.U)
MARKUP = re.compile(r"</?\w+>|[{}]")


def letter_class(c: str) -> str:
    """The letter as the bigram model has it: lower case, ideographs and kana as one class each."""
    o = ord(c)
    if 0x4E00 <= o <= 0x9FFF or 0x3400 <= o <= 0x4DBF:
        return "漢"
    if 0x3040 <= o <= 0x30FF:
        return "か"
    if o > 0xFFFF or 0xAC00 <= o <= 0xD7FF:
        return "?"
    if c.isdigit():
        return "0"
    return c.lower()[:1] if not c.isspace() else " "


@lru_cache(maxsize=None)
def swap(written: str, used: str) -> dict[str, str]:
    """Letter by character for text of one single-byte page read with another."""
    wrong, right = _page_chars(used), _page_chars(written)
    return {wrong[b]: right[b] for b in range(0x80, 0x100) if right[b].isalpha() and wrong[b] != right[b]}


@lru_cache(maxsize=None)
def _dos(page: str) -> re.Pattern:
    odd = "".join(re.escape(c) for c, to in swap("cp1252", page).items() if c != "\xad" and (not c.isalpha() or "\u0370" <= c <= "\u03ff" or c == "ⁿ"))
    return re.compile(f"(?<=[A-Za-z])[{odd}](?=[a-z])|(?<![\\w{odd}])[{odd}](?=[a-z]{{3}})|(?<=[a-z]{{3}})[{odd}](?![\\w{odd}])")


def swapped(text: str) -> list[tuple[int, int, str, str]]:
    """Units of text of a single-byte page read with another one."""
    tries = []
    if LATIN_RUN.search(text):
        places = [i for m in LATIN_RUN.finditer(text) for i in range(m.start(), m.end())]
        tries += [(w, "cp1252", places) for w in CYRILLIC_PAGES[:2]]
    if len(WRONG_CASE.findall(text)) > 1 or len(SIGNS.findall(text)) > 2:
        tries += [(w, u, range(len(text))) for w in CYRILLIC_PAGES for u in CYRILLIC_PAGES if w != u]
    best, score = [], 0.0
    for written, used, places in tries:
        table = swap(written, used)
        found = [(i, i + 1, f"{written}>{used}", table[text[i]]) for i in places if text[i] in table]
        words = "".join(x[3] for x in found)
        # a reading is good if its letters are frequent ones and its capitals begin words
        good = sum(c in FREQUENT for c in words) - sum(a.islower() and b.isupper() for a, b in zip(words, words[1:]))
        if good > score:
            best, score = found, good
    if best:
        return best
    for page in DOS_PAGES:
        table = swap("cp1252", page)
        found = [(m.start(), m.end(), f"cp1252>{page}", table[m.group()]) for m in _dos(page).finditer(text)]
        if len(found) > len(best):
            best = found
    return best


def units(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, page, letter) of each unit, under the page that explains most characters."""
    best: list[tuple[int, int, str, str]] = []
    covered = 0
    for page in PAGES:
        pattern, byte = _page(page)
        found, size = [], 0
        for m in pattern.finditer(text):
            try:
                letter = bytes(byte[c] for c in m.group()).decode("utf-8")
            except UnicodeDecodeError:
                continue
            found.append((m.start(), m.end(), page, letter))
            size += m.end() - m.start()
        if size > covered:
            best, covered = found, size
    found = swapped(text)
    if len(found) > covered:
        best, covered = found, len(found)
    wide = []
    for m in WIDE_RUN.finditer(text):
        run = m.group()
        try:
            raw = run.encode(WIDE_PAGE)
        except UnicodeEncodeError:
            continue
        for s in (raw, raw[:-1]) if run[-1] < "\x7f" else (raw,):
            plain = s.decode("utf-8", "replace")
            bad = plain.count("�")
            if bad == 0 or (len(run) >= 6 and bad * 8 <= len(plain)):
                keep = m.end() - (len(raw) - len(s))
                wide.append((m.start(), keep, WIDE_PAGE, plain))
                break
    if sum(e - s for s, e, _, _ in wide) > covered:
        return wide
    return best


class Mapping(dict):
    """A learned mapping (page, unit) -> letter, and the test that every value passes that a unit of
    it or of the multi-byte page may begin in."""

    def __init__(self, units: dict[tuple[str, str], str] = {}) -> None:  # noqa: B006
        super().__init__(units)
        heads = "".join(sorted({re.escape(u[0]) for _, u in self}))
        self.head = re.compile(f"[{heads}{WIDE}]|&")

    def __reduce__(self):
        return Mapping, (dict(self),)


def restore_once(text: str, known: dict[tuple[str, str], str] | None) -> tuple[str, int]:
    """(text with its units replaced, number of units), all units or the known ones."""
    found = units(text)
    if found and ">" in found[0][2]:
        table = {ord(text[s]): letter for s, _, page, letter in found if known is None or (page, text[s]) in known}
        out, last = [], 0
        for s, e in ((m.start(), m.end()) for m in re.finditer("x+", _marked(found, len(text)))):
            out += [text[last:s], text[s:e].translate(table)]
            last = e
        return "".join(out) + text[last:], sum(ord(text[s]) in table for s, _, _, _ in found)
    out, last, n = [], 0, 0
    for s, e, page, letter in found:
        if page == WIDE_PAGE or known is None or (page, text[s:e]) in known:
            out += [text[last:s], letter]
            last, n = e, n + 1
    return "".join(out) + text[last:], n


def _marked(found: list[tuple[int, int, str, str]], n: int) -> str:
    """The places of units as a text of x and blanks."""
    line = bytearray(b" " * n)
    for s, e, _, _ in found:
        line[s:e] = b"x" * (e - s)
    return line.decode()


def restore(text: str, known: dict[tuple[str, str], str] | None = None) -> tuple[str, bool]:
    """(restored text, whether a unit was replaced); HTML escapes are resolved only for that."""
    if isinstance(known, Mapping) and not known.head.search(text):
        return text, False
    done, changed = text, False
    for _ in range(3):
        plain = html.unescape(done) if ESCAPES.search(done) else done
        if not ANY_HIGH.search(plain):
            break
        new, n = restore_once(plain, known)
        if not n:
            break
        done, changed = new, True
    return done, changed


def has_lost(text: str, is_name: bool = False) -> bool:
    """Whether letters were replaced by U+FFFD or by question marks."""
    if "�" in text:
        return True
    if "?" not in text:
        return False
    if is_name or LOST_INSIDE.search(text):
        return True
    return bool(LOST_AFTER.search(text)) and not asks(text)


def asks(text: str) -> bool:
    """Whether a clause opens with a question word, one slip in typing being allowed for."""
    from refaudit.llm.charforms import FOLD

    for word in CLAUSE_START.findall(MARKUP.sub("", text).translate(FOLD)):
        w = word.lower()
        if w in ASKING or (2 <= len(w) <= 6 and any(len(q) > 2 and _one_slip(w, q) for q in ASKING)):
            return True
    return False


def _one_slip(a: str, b: str) -> bool:
    """Whether one letter is wrong, missing, added or swapped with the next."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def suspicious(value: Column) -> Column:
    """Cheap JVM-side test that every garbled value passes."""
    return value.rlike(r"[^\x00-\x7f]|\?|&[A-Za-z#]")


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: counts of clean bigrams ('', c1, c2) and of units with their neighbours."""
    pairs: Counter = Counter()
    seen: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(pairs) + list(seen)
        cols = list(zip(*[(("", "", "", a, b) if len(k) == 2 else k) for k in keys for a, b in [k[:2]]])) or [[]] * 5
        batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols] + [pa.array([*pairs.values(), *seen.values()], pa.int64())], ["page", "unit", "letter", "l", "r", "n"])
        pairs.clear()
        seen.clear()
        return batch

    for b in batches:
        for text in b.column(0).to_pylist():
            if not text:
                continue
            text = html.unescape(text) if ESCAPES.search(text) else text
            found = units(text) if ANY_HIGH.search(text) else []
            if not found:
                c = [letter_class(x) for x in f" {text} "]
                pairs.update(zip(c, c[1:]))
                continue
            at = {s: letter for s, e, page, letter in found}
            upto = {e: letter for s, e, page, letter in found}
            for s, e, page, letter in found:
                if page != WIDE_PAGE:
                    left = upto.get(s, text[s - 1] if s else " ")[-1]
                    right = at.get(e, text[e] if e < len(text) else " ")[0]
                    seen[page, text[s:e], letter, letter_class(left), letter_class(right)] += 1
        if len(seen) + len(pairs) > 200_000:
            yield rows()
    yield rows()


def learn(values: DataFrame) -> Mapping:
    """The cipher mapping (page, unit) -> letter learned from all values (one string column).

    Its size is bounded by the letters in use times the swaps of code pages.
    """
    return Mapping({(r["page"], r["unit"]): r["letter"] for r in learned(values).where(F.col("p") >= SURE).collect()})


def learned(values: DataFrame) -> DataFrame:
    """(page, unit, letter, p, likely, n): the letter that the bytes of each unit give, the share of its
    occurrences that are ciphers, the letter learned from its neighbours, and their number."""
    counts = materialize(values.mapInArrow(_evidence, "page string, unit string, letter string, l string, r string, n bigint").groupBy("page", "unit", "letter", "l", "r").agg(F.sum("n").alias("n")))
    # letter classes bound the bigram table, whatever the corpus holds
    clean = counts.where("page = ''").select("l", "r", "n").toPandas()
    pair = {(a, b): n for a, b, n in zip(clean.l, clean.r, clean.n)}
    first: Counter = Counter()
    for (a, _), n in pair.items():
        first[a] += n
    total = sum(first.values()) + 1
    # logarithms of the bigram probabilities; the last row and column stand for letters not in use
    kinds = {k: i for i, k in enumerate(sorted(first))}
    m = len(kinds)
    seen = np.zeros((m + 1, m + 1))
    for (a, b), n in pair.items():
        if b in kinds:
            seen[kinds[a], kinds[b]] = n
    alone = (np.array([first[k] for k in kinds] + [0]) + 0.1) / (total + 0.1 * (m + 1))
    bigram = np.log((seen + 2 * alone) / (np.array([first[k] for k in kinds] + [0]) + 2)[:, None])
    # code pages agree on ASCII: only other letters can be what a unit stands for
    letters = [k for k in kinds if k > "\x7f"]
    place = {k: i for i, k in enumerate(letters)}
    numbers = lambda cs: np.array([kinds.get(c, m) for c in cs], np.int64)

    def em(group: pd.DataFrame) -> pd.DataFrame:
        page, unit, letter = group.page.iloc[0], group.unit.iloc[0], group.letter.iloc[0]
        n = group.n.to_numpy(float)
        body, plain = letter_class(letter), numbers(letter_class(c) for c in unit)
        inside = bigram[plain[:-1], plain[1:]].sum()
        own = letters if body in place else [*letters, body]
        left, right, k = numbers(group.l), numbers(group.r), numbers(own)
        ciphers = bigram[left][:, k] + bigram[k][:, right].T
        ordinary = bigram[left, plain[0]] + inside + bigram[plain[-1], right]
        at = own.index(body)

        def share(q: np.ndarray, fixed: bool) -> tuple[float, np.ndarray]:
            """Share of ciphers among the occurrences, and the letter, learned unless it is fixed."""
            theta, given = 0.5, BYTES * (1 / len(own) + (np.arange(len(own)) == at))
            for _ in range(ROUNDS):
                each = ciphers + np.log(np.maximum(q, 1e-300))
                top = each.max(1, keepdims=True)
                cipher = np.log(np.exp(each - top).sum(1)) + top[:, 0]
                odds = math.log(theta) + cipher - math.log1p(-theta) - ordinary
                post = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
                if not fixed:
                    told = (np.exp(each - cipher[:, None]) * (n * post)[:, None]).sum(0)
                    q = (told + given) / (told.sum() + given.sum())
                new = min(1 - 1e-6, max(1e-6, (float((n * post).sum()) + 0.5) / (n.sum() + 1)))
                if abs(new - theta) < 1e-6:
                    break
                theta = new
            return theta, q

        free, q = share(np.full(len(own), 1 / len(own)), False)
        likely = own[int(q.argmax())]
        theta, _ = share((np.arange(len(own)) == at).astype(float), True)
        # the letter that was learned freely confirms that of the bytes; where it is another one, or one
        # that no clean value has, the neighbours must fit that of the bytes on their own
        p = max(theta, free) if likely == body and body in place else theta
        return pd.DataFrame({"page": [page], "unit": [unit], "letter": [letter], "p": [p], "likely": [likely], "n": [int(n.sum())]})

    return counts.where("page <> ''").groupBy("page", "unit").applyInPandas(em, "page string, unit string, letter string, p double, likely string, n bigint")


def of_cases(cases: DataFrame) -> Mapping:
    """The mapping learned from all ``original`` titles and authors."""
    return learn(cases.select(F.explode(F.array("original.title", "original.author")).alias("v")).where("v is not null"))


def _fixer(known: dict[tuple[str, str], str], is_name: bool):
    @F.pandas_udf("restored string, garbled boolean")
    def fix(s: pd.Series) -> pd.DataFrame:
        out = [(t, False) if not t else restore(t, known) for t in s]
        return pd.DataFrame({"restored": [x for x, _ in out], "garbled": [bool(g or (t and has_lost(t, is_name))) for t, (_, g) in zip(s, out)]})

    return fix


def repair(df: DataFrame, columns: dict[str, Column], names: tuple[str, ...] = (), known: dict[tuple[str, str], str] | None = None) -> DataFrame:
    """``df`` with, for each entry of ``columns``, ``<key>_restored`` and ``<key>_garbled``, by the
    mapping ``known`` or else by what is learned from these columns.

    The columns named in ``names`` hold names of people, where no question mark is ordinary.
    """
    one = F.explode(F.array(*columns.values())).alias("v")
    known = learn(df.select(one).where("v is not null")) if known is None else known
    for key, value in columns.items():
        is_name = key in names

        needed, fix = suspicious(value), _fixer(known, is_name)
        df = df.withColumn("_fix", F.when(needed, fix(F.when(needed, value))))
        df = df.withColumn(f"{key}_restored", F.coalesce("_fix.restored", value)).withColumn(f"{key}_garbled", F.coalesce("_fix.garbled", F.lit(False))).drop("_fix")
    return df


def found(cases: DataFrame) -> DataFrame:
    """(case_id, field_name) of the garbled values of ``original.title`` and ``original.author``."""
    fields = {"title": F.col("original.title"), "author": F.col("original.author")}
    fixed = repair(cases.select("case_id", "original"), fields, ("author",), of_cases(cases))
    names = [F.when(F.col(f"{k}_garbled"), F.lit(f"original.{k}")) for k in fields]
    return fixed.select("case_id", F.explode(F.array_compact(F.array(*names))).alias("field_name"))
