"""Languages of running text: every document, and every stretch of a mixed one.

Words (characters for ideographs and kana) have a log score in each language. The script of a word
narrows the languages it can belong to. Viterbi over the words of a document, with a penalty for
each switch, gives the spans; it runs over all documents of a batch at once, position by position.
A sentence belongs to a language if most of its scored words do.

The scores are fitted on a bounded sample of labelled documents (``SAMPLE`` a language of at most
``LONGEST`` characters each, chosen by a hash of the id) and re-estimated from their own spans, so that wrong labels lose their weight.
Everything else covers all documents and whole texts.

Defined results: null, empty and blank texts, and texts without running text (BibTeX, payloads,
logs), have no language; what is running text is told by the lines themselves. Quotations, headings and reference lines are skipped. A label that names
no language of the table names nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.llm.tokens import pieces

#: Characters whose words are in memory at once.
PIECE = 1_500_000
#: Labelled documents a language that the scores are fitted on, at most about twice as many.
SAMPLE = 400
#: Characters of a text that the scores are fitted on, so that the sample has a bounded size.
LONGEST = 20_000
ROUNDS = 2
SWITCH = 7.0
CLIP = 5.0
#: Share of a sentence's scored words that its language must have, and how many it needs.
SHARE, LEAST = 0.6, 3
#: ISO 639-2/3 codes of the languages that occur.
LONG_CODES = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "ita": "it", "nld": "nl", "dut": "nl", "swe": "sv", "pol": "pl", "rus": "ru", "zho": "zh", "chi": "zh", "cmn": "zh", "jpn": "ja"}
#: The languages written in a script other than Latin.
CYRILLIC, KANA, HAN = ("ru",), ("ja",), ("zh", "ja")
TOKEN = re.compile(r"[぀-ヿ㐀-䶿一-鿿々]|[^\W\d_぀-ヿ㐀-䶿一-鿿]+", re.U)
STOP = re.compile(r"[.!?]+[\"'»”’)\]]*(?=\s|$)|[。！？]+|\n\s*\n", re.U)
QUOTED = re.compile(r"«[^«»]{0,300}»|『[^『』]{0,300}』|《[^《》]{0,300}》|「[^「」]{0,300}」|“[^“”]{0,300}”|„[^„“”]{0,300}[“”]|\([^()\n]{0,200}\)")
REFERENCE = re.compile(r"^\W{0,12}\[\d{1,4}\]\s+\S.*$", re.M | re.U)
HEADING = re.compile(r"^.{0,60}?#\s.*$", re.M)
#: Lines of BibTeX, of JSON and of logs: a member or field with its value, brackets alone, a time
#: stamp or two settings at least.
MACHINE_LINE = re.compile(r"""^(?:.*@\w+\{.*|.*=[^\n]*\{.*\}.*|.*"[^"\n]{1,60}"\s*:\s.*|[\s\[\]{},]*(?:\\\w+\{[^{}\n]*\}[\s\[\]{},]*)?|.*\d{4}-\d\d-\d\dT\d\d:\d\d.*|.*\b\w+=\S+\s+\w+=\S+.*)$""", re.M)


def running_text(text: str) -> str:
    """The text with everything that is not running text blanked; positions stay."""
    blank = lambda m: " " * len(m.group())
    text = REFERENCE.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)  # lines still end paragraphs
    text = HEADING.sub(blank, text)
    text = MACHINE_LINE.sub(blank, text)
    return QUOTED.sub(blank, text)


def fold(word: str) -> str:
    """Lower case without marks, so that lost accents make no difference."""
    w = word.lower()
    if w.isascii():
        return w
    return "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c))


class Scores:
    """Word scores in each language; words not known score nothing but what their script says."""

    def __init__(self, codes: list[str], counts: dict[str, np.ndarray]) -> None:
        self.codes = codes
        n = len(codes)
        total = sum(counts.values(), np.zeros(n)) + 1.0
        mean = total.mean()
        at = {c: i for i, c in enumerate(codes)}
        only = lambda langs: np.array([0.0 if c in langs else -CLIP for c in codes])
        other = set(CYRILLIC) | set(KANA) | set(HAN)
        self.script = {"cyr": only(CYRILLIC), "kana": only(KANA), "han": only(HAN), "none": np.zeros(n)}
        rows, self.number = [self.script["none"], self.script["cyr"], self.script["kana"], self.script["han"]], {}
        for w, k in counts.items():
            if k.sum() < 3:
                continue
            p = np.log((k / total * mean + 0.3) / (k.sum() / total.sum() * mean + 0.3))
            kind = script_of(w)
            s = np.maximum(p, -CLIP) + self.script[kind]
            if kind == "none":
                s = np.where([c in other for c in codes], np.minimum(s, 0.0), s)
            s = s - s.max()
            self.number[w] = len(rows)
            rows.append(np.maximum(s, -CLIP))
        self.rows = np.array(rows)
        self.informs = (self.rows.max(1) - np.sort(self.rows, axis=1)[:, -2 if n > 1 else -1]) > 0.5
        self.at = at
        self.memo: dict[str, int] = {}

    def lookup(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 300_000:
            memo.clear()
        out = np.empty(len(words), np.int64)
        for i, w in enumerate(words):
            k = memo.get(w)
            if k is None:
                f = fold(w)
                k = self.number.get(f)
                if k is None:
                    k = {"none": 0, "cyr": 1, "kana": 2, "han": 3}[script_of(f)]
                memo[w] = k
            out[i] = k
        return out


def script_of(word: str) -> str:
    o = ord(word[0])
    if 0x400 <= o <= 0x52F:
        return "cyr"
    if 0x3040 <= o <= 0x30FF:
        return "kana"
    if 0x3400 <= o <= 0x9FFF:
        return "han"
    return "none"


def viterbi(scores: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Language of each word; ``scores`` (words x languages), ``doc`` the ascending document of each."""
    size = np.bincount(doc, minlength=n_docs)
    start = np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    size, start = size[order], start[order]
    longest = int(size[0]) if n_docs else 0
    m = scores.shape[1]
    stay = np.ones(scores.shape, bool)
    jump = np.zeros(len(scores), np.int8)
    v = np.zeros((n_docs, m))
    active = n_docs - np.searchsorted(size[::-1], np.arange(longest), "right")
    for t in range(longest):
        k = active[t]
        at = start[:k] + t
        if t:
            best = v[:k].argmax(1)
            top = v[np.arange(k), best] - SWITCH
            keep = v[:k] >= top[:, None]
            stay[at], jump[at] = keep, best
            v[:k] = np.where(keep, v[:k], top[:, None])
        v[:k] += scores[at]
    path = np.zeros(len(scores), np.int8)
    state = v.argmax(1) if n_docs else np.zeros(0, int)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        path[at] = state[:k]
        held = stay[at, state[:k]]
        state[:k] = np.where(held, state[:k], jump[at])
    return path


def spans(texts: list[str | None], model: Scores) -> list[list[tuple[str, int, int, int, float]]]:
    """Per text the spans (language, start, end, whole sentences, confidence)."""
    words: list[str] = []
    begin: list[int] = []
    stop: list[int] = []
    sentence: list[np.ndarray] = []
    doc: list[int] = []
    last = 0
    for i, text in enumerate(texts):
        if not text or text.isspace():
            continue
        clean = running_text(text)
        found = [m.span() for m in TOKEN.finditer(clean)]
        if not found:
            continue
        words += [clean[i:j] for i, j in found]
        b = [i for i, _ in found]
        begin += b
        stop += [j for _, j in found]
        cuts = np.array([m.end() for m in STOP.finditer(clean)] or [len(clean)])
        sentence.append(last + np.searchsorted(cuts, b, "right"))
        last = int(sentence[-1][-1]) + 1
        doc += [i] * len(found)
    out: list[list[tuple[str, int, int, int, float]]] = [[] for _ in texts]
    if not words:
        return out
    number = model.lookup(words)
    kinds, where = np.unique(number, return_inverse=True)
    score, informs = model.rows[kinds][where], model.informs[kinds][where]
    d, sent = np.array(doc), np.concatenate(sentence)
    present, dense = np.unique(d, return_inverse=True)
    path = viterbi(score, dense, len(present)).astype(int)
    # the language of each sentence by its scored words
    _, sid = np.unique(sent, return_inverse=True)
    m = len(model.codes)
    votes = np.bincount(sid * m + path, weights=informs, minlength=(sid.max() + 1) * m).reshape(-1, m)
    lang = votes.argmax(1)
    full = (votes.max(1) >= LEAST) & (votes.max(1) >= SHARE * votes.sum(1))
    own = score[np.arange(len(path)), path]
    rival = score.copy()
    rival[np.arange(len(path)), path] = -np.inf
    margin = np.where(informs, own - rival.max(1), 0.0)
    first = np.flatnonzero(np.append(True, (sid[1:] != sid[:-1])))
    at = np.append(first, len(path))
    gain = np.add.reduceat(margin, first)
    n_inf = np.add.reduceat(informs.astype(int), first)
    for j in range(len(first)):
        if not full[j]:
            continue
        i, code = int(d[first[j]]), model.codes[lang[j]]
        conf = 1 / (1 + np.exp(-gain[j] / np.sqrt(max(n_inf[j], 1))))
        s, e = begin[first[j]], stop[at[j + 1] - 1]
        if out[i] and out[i][-1][0] == code:
            c, s0, _, k, old = out[i][-1]
            out[i][-1] = (c, s0, e, k + 1, (old * k + conf) / (k + 1))
        else:
            out[i].append((code, s, e, 1, float(conf)))
    return out


def count_words(texts: list[str], langs: list[int], m: int) -> dict[str, np.ndarray]:
    counts: dict[str, Counter] = {}
    for text, k in zip(texts, langs):
        for w in TOKEN.findall(running_text(text)):
            counts.setdefault(fold(w), Counter())[k] += 1
    return {w: np.array([c.get(i, 0) for i in range(m)], float) for w, c in counts.items()}


def fit(texts: list[str], langs: list[str], codes: list[str]) -> Scores:
    """Scores from labelled texts; wrong labels and foreign stretches are re-labelled in turns."""
    at = {c: i for i, c in enumerate(codes)}
    model = Scores(codes, count_words(texts, [at[x] for x in langs], len(codes)))
    for _ in range(ROUNDS - 1):
        parts = [(t[s:e], at[code]) for t, found in zip(texts, spans(texts, model)) for code, s, e, _, _ in found]
        if not parts:
            break
        model = Scores(codes, count_words([p for p, _ in parts], [k for _, k in parts], len(codes)))
    return model


def named(label: Column, languages: DataFrame) -> Column:
    """The code of the language that a label names, or null."""
    rows = [(r["code"], r["label"]) for r in languages.select("code", "label").collect()]
    codes = {c for c, _ in rows}
    if not codes:
        return F.lit(None).cast("string")
    known = {c: c for c in codes} | {n.lower(): c for c, n in rows if n} | {k: v for k, v in LONG_CODES.items() if v in codes}
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.coalesce(table[text], table[F.regexp_extract(text, r"^([a-z]{2,3})[-_][a-z0-9_-]+$", 1)])


def train(docs: DataFrame, languages: DataFrame) -> Scores:
    """Fit on about ``SAMPLE`` to twice as many labelled documents of each language."""
    codes = [r["code"] for r in languages.select("code").orderBy("code").collect()]
    labelled = docs.select("doc_id", "text", named(F.col("lang"), languages).alias("code")).where("code is not null and text is not null").where(F.length("text") <= LONGEST)
    if not codes:
        return Scores(["und"], {})
    tally = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count("*").alias("n")).collect()}
    if not tally:
        return Scores(codes, {})
    limit = F.create_map(*[x for c, n in tally.items() for x in (F.lit(c), F.lit(int(min(1.0, 1.5 * SAMPLE / n) * 1_000_000)))])
    rows = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) < limit[F.col("code")]).select("text", "code", F.xxhash64("doc_id").alias("h")).collect()
    rows.sort(key=lambda r: r["h"])
    taken: Counter = Counter()
    kept = []
    for r in rows:
        taken[r["code"]] += 1
        if taken[r["code"]] <= 2 * SAMPLE:
            kept.append(r)
    return fit([r["text"] for r in kept], [r["code"] for r in kept], codes)


def label(docs: DataFrame, languages: DataFrame) -> DataFrame:
    """(doc_id, code, spans): the language the label names, and the spans of the running text."""
    model = train(docs, languages)
    shared = docs.sparkSession.sparkContext.broadcast((model.codes, model.rows, model.number, model.informs))  # bounded by the sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scores(shared.value[0], {})
        own.codes, own.rows, own.number, own.informs = shared.value
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [x for i, j in pieces(texts, PIECE) for x in spans(texts[i:j], own)]
            kinds = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("sentences", pa.int32()), ("confidence", pa.float64())]))
            body = pa.array([[{"lang": c, "start": s, "end": e, "sentences": k, "confidence": f} for c, s, e, k, f in x] for x in found], kinds)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), body], ["doc_id", "code", "spans"])

    schema = f"doc_id {kind}, code string, spans array<struct<lang string, start int, end int, sentences int, confidence double>>"
    return docs.select("doc_id", named(F.col("lang"), languages).alias("code"), "text").mapInArrow(run, schema)


def found(docs: DataFrame, languages: DataFrame) -> DataFrame:
    """(doc_id, lang): languages of whole sentences that the label leaves out."""
    marked = label(docs, languages)
    each = marked.select("doc_id", "code", F.explode(F.array_distinct(F.col("spans.lang"))).alias("lang"))
    return each.where(F.col("code").isNull() | (F.col("code") != F.col("lang"))).select("doc_id", "lang")
