import itertools
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from refaudit.llm import charforms, languages, mojibake


@pytest.mark.parametrize(
    "raw, form, hit",
    [
        ("plain text", "plain text", False), ("", "", False), (None, None, False), ("ｆｕｌｌ width", "full width", True), ("a b", "a b", True), ("so­ft", "soft", True), ("Bo​y", "Boy", True),
        ("été", "été", True), ("été", "été", False), ("ﬁne", "fine", True), ("sсience", "science", True), ("Ρrobabilistic", "Probabilistic", True), ("Д. Петров", "Д. Петров", False),
        ("TNF-α and β-amyloid", "TNF-α and β-amyloid", False), ("WITH Β-AMYLOID", "WITH Β-AMYLOID", False), ("MARKED BY Κ CASEIN", "MARKED BY Κ CASEIN", False), ("BEYOND: Α REVIEW", "BEYOND: A REVIEW", True), ("Α robust way", "A robust way", True), ("10⁻³ and CO₂", "10⁻³ and CO₂", False),
        ("“quoted” – and…", "“quoted” – and…", False), ("目录：缺少（5）", "目录：缺少（5）", False), ("Part Ⅱ", "Part II", True), ("open‑access", "open-access", True),
    ],
)
def test_canonical(raw, form, hit):
    out, affected = charforms.canonical(pa.array([raw], pa.string()))
    assert out.to_pylist() == [form] and bool(affected[0]) is hit


def test_marks_are_composed_as_in_the_normal_form():
    rng = random.Random(1)
    marks = [chr(o) for o in range(0x300, 0x346) if unicodedata.normalize("NFC", chr(o)) == chr(o)]
    bases = list("aeiouEAOnsczéêếạởx") + ["가", "각", "ᄀ", "ᅡ", "ᆨ", "ে", "া"]
    texts = ["".join(rng.choice(bases) + "".join(rng.choice(marks) for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4]))) for _ in range(rng.randrange(0, 5))) for _ in range(10_000)]
    texts = [t for t in texts if not set(t) & {"ͅ"}] + ["\u0301x", "e" + "\u0323\u0302" * 50]
    out, hit = charforms.canonical(pa.array(texts, pa.string()))
    assert out.to_pylist() == [unicodedata.normalize("NFC", t) for t in texts]
    assert hit.tolist() == [unicodedata.normalize("NFC", t) != t for t in texts]
    one, other = "e\u0302\u0323", "e\u0323\u0302"
    assert charforms.canonical(pa.array([one, other], pa.string()))[0].to_pylist() == ["ệ", "ệ"]


def test_canonical_is_stable_and_batches_agree():
    rng = random.Random(2)
    pool = "aéе́ѕｆ​­  ́Α目（ﬁK"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 12))) for _ in range(300)] + [None, ""]
    once, _ = charforms.canonical(pa.array(texts, pa.string()))
    alone = [charforms.canonical(pa.array([t], pa.string()))[0].to_pylist()[0] for t in texts]
    assert once.to_pylist() == alone
    sliced = charforms.canonical(pa.array(texts, pa.string()).slice(7, 50))[0].to_pylist()
    assert sliced == alone[7:57]


CASES = "case_id bigint, original struct<title: string, author: string>, candidate struct<title: string>, extra int"


def test_p3_leaves_out_garbled_values(spark):
    good = "The quick brown fox möchte über die Brücke"
    rows = [(1, ("sсience of it", None), None, 1), (2, (good.encode().decode("cp1252") + " x", None), None, 1), (3, None, ("ｆull", ), 1), (4, (None, None), (None,), 1), (5, (good, "A"), None, 1)]
    oa = spark.createDataFrame([(7, [(("Jо Li",),), (("Jо Mi",),)]), (8, None), (9, [(None,)])], "rec_id bigint, authorships array<struct<author: struct<display_name: string>>>")
    got = {tuple(r) for r in charforms.found(spark.createDataFrame(rows + [(10 + i, (good, None), None, 1) for i in range(30)], CASES), oa).collect()}
    assert got == {("cases", 1, "original.title"), ("cases", 3, "candidate.title"), ("search_openalex", 7, "display_name")}


@pytest.mark.parametrize("page", ["cp1252", "mac_roman", "cp437", "cp1251"])
def test_restore_round_trip(page):
    for text in ("Größe und Übung", "naïve façade", "café – “so”"):
        raw = "".join(mojibake._page_chars(page)[b] for b in text.encode())
        assert mojibake.restore(raw) == (text, True)


def test_restore_twice_misread_and_swapped():
    once = "Größe".encode().decode("cp1252")
    assert mojibake.restore(once.encode().decode("cp1252")) == ("Größe", True)
    assert mojibake.restore("Вторая проверка".encode("cp1251").decode("cp1252")) == ("Вторая проверка", True)
    assert mojibake.restore("Gr&Atilde;&para;&Atilde;&Yuml;e") == ("Größe", True)


@pytest.mark.parametrize("written, used", [(w, u) for w in ("cp1251", "koi8-r", "cp866") for u in ("cp1251", "koi8-r", "cp866", "cp1252") if w != u and (w, u) not in (("cp1251", "cp866"), ("cp866", "cp1252"))])
def test_swaps_of_cyrillic_pages(written, used):
    text = "Вторая проверка карточек: Автоматическая выборка ведёт к другой работе"
    assert mojibake.restore("".join(mojibake._page_chars(used)[b] for b in text.encode(written))) == (text, True)


@pytest.mark.parametrize("page, text", [("cp437", "Müller über naïve façade"), ("cp850", "Müller über den Zaun")])
def test_latin_text_read_with_a_dos_page(page, text):
    assert mojibake.restore(text.encode("latin-1").decode(page)) == (text, True)


@pytest.mark.parametrize("text", ["TNF-α and β-amyloid", "10⁻³ and CO₂ ± 2 °C", "x² · y", "Вторая проверка карточек", "Straße größer", "so\u00adft", "Смирнов А. Б. и ИВАНОВ"])
def test_ordinary_signs_are_no_swap(text):
    assert mojibake.restore(text) == (text, False)


def test_letters_are_learned_from_an_unknown_mapping(spark):
    """The letter of each frequent unit comes out of its neighbours alone, without its bytes."""
    words = "möchte über die Brücke gehen und fährt später naïve René café größer schön Mühle".split()
    rng = random.Random(4)
    clean = [(" ".join(rng.choice(words) for _ in range(8)),) for _ in range(400)]
    bad = [(t.encode().decode("cp1252"),) for (t,) in clean[:60]]
    got = {r["unit"]: (r["letter"], r["likely"], r["p"]) for r in mojibake.learned(spark.createDataFrame(clean + bad, "v string")).collect()}
    assert {u: x[1] for u, x in got.items() if x[0] in "öüäé"} == {"Ã¶": "ö", "Ã¼": "ü", "Ã¤": "ä", "Ã©": "é"} and all(x[2] > 0.9 for x in got.values() if x[0] in "öüäé")


@pytest.mark.parametrize("text, lost", [("r?le", True), ("Can X replace Y?", False), ("Results ? more", True), ("caf� x", True), ("{C}an this be?", False), ("at Man?wen: x", True), ("plain", False), ("Quo vadis, ecology?", False), ("Warum fehlt die Seite?", False)])
def test_lost_letters(text, lost):
    assert mojibake.has_lost(text) is lost


def test_p4_found(spark):
    good = "möchte über die Brücke gehen und fährt naïve René"
    rows = [(1, (good.encode().decode("cp1252"), "A B"), None, 1), (2, (good, "J?rgen X"), None, 1), (3, None, None, 1), (4, (None, ""), None, 1), (5, ("A &amp; B", "R&eacute;my"), None, 1)] + [(10 + i, (good, "René"), None, 1) for i in range(40)]
    got = {tuple(r) for r in mojibake.found(spark.createDataFrame(rows, CASES)).collect()}
    assert got == {(1, "original.title"), (2, "original.author")}
    assert mojibake.found(spark.createDataFrame([], CASES)).count() == 0


def test_learning_rejects_ordinary_text(spark):
    words = "РЁБРА СЁСТРЫ ВСЁ РЁВ"  # looks like units of cp1251, but is what was written
    rows = [(f"{words} {i} and Größe", ) for i in range(50)] + [(f"рёбра сёстры всё рёв идёт {i} раз",) for i in range(50)]
    known = mojibake.learn(spark.createDataFrame(rows, "v string"))
    assert ("cp1251", "РЁ") not in known


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 3), (4, 3), (6, 2)):
        s = rng.normal(size=(n, m)) * 4
        best = max(itertools.product(range(m), repeat=n), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - languages.SWITCH * sum(a != b for a, b in zip(p, p[1:])))
        assert languages.viterbi(s, np.zeros(n, int), 1).tolist() == list(best)
    a, b = rng.normal(size=(5, 3)) * 3, rng.normal(size=(2, 3)) * 3
    both = languages.viterbi(np.vstack([a, b]), np.array([0] * 5 + [1] * 2), 2).tolist()
    assert both == languages.viterbi(a, np.zeros(5, int), 1).tolist() + languages.viterbi(b, np.zeros(2, int), 1).tolist()


EN = "The record was merged with an older entry because the page was missing. "
DE = "Der Eintrag wurde mit einem älteren Datensatz zusammengeführt weil die Seite fehlt. "
RU = "Эта запись получена слиянием с более старой карточкой. "


def test_p8_found(spark):
    docs = [(i, t, lab, "abstract") for i, (t, lab) in enumerate([(EN * 3, "en")] * 15 + [(DE * 3, "deu")] * 15 + [(RU * 2, "ru-RU")] * 10)]
    docs += [(100, EN + DE + EN, "English", "abstract"), (101, DE * 2, "en", "note"), (102, None, None, "note"), (103, "", "en", "note"), (104, " \n ", None, "note"), (105, "2024-01-02T03:04:05Z GET /works/1 " + EN, "zxx", "log"), (106, EN + "He said («Der Eintrag wurde mit einem Datensatz zusammengeführt») then.", "EN_us", "note"), (107, DE.upper(), None, "report"), (107, DE, "de", "report")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, kind string")
    langs = spark.createDataFrame([("en", "English"), ("de", "German"), ("ru", "Russian")], "code string, label string")
    assert sorted(tuple(r) for r in languages.found(d, langs).collect()) == [(100, "de"), (101, "de"), (107, "de")]
    spans = [r for r in languages.label(d, langs).where(F.col("doc_id") == 100).first()["spans"]]
    assert [s["lang"] for s in spans] == ["en", "de", "en"] and all(0.5 < s["confidence"] <= 1 for s in spans)
    assert languages.found(d.limit(0), langs).count() == 0 and languages.found(d, langs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ['{\n  "title": "The record was merged with an older entry",\n  "x": [\n    {\n    }\n  ]\n}', "@article{k,\n  title = {{The record was merged with an older entry}},\n}", "2024-01-02T03:04:05Z GET /works/1 status=200 hits=1\nGET the record was merged a=1 b=2"])
def test_machine_lines_are_no_running_text(text):
    assert languages.running_text(text).strip() == "" and len(languages.running_text(text)) == len(text)
    assert languages.running_text(f"{text}\nSome words here.").split() == ["Some", "words", "here."]


def test_documents_of_any_kind_are_read(spark):
    d = spark.createDataFrame([(i, DE * 3, "de", k) for i, k in enumerate(["abstract"] * 20)] + [(i, EN * 3, "en", "note") for i in range(100, 120)] + [(50, DE, "en", None), (51, DE, "en", "letter")], "doc_id bigint, text string, lang string, kind string")
    langs = spark.createDataFrame([("en", "English"), ("de", "German")], "code string, label string")
    assert sorted(tuple(r) for r in languages.found(d, langs).collect()) == [(50, "de"), (51, "de")]


def test_held_out_accuracy(spark):
    """Sentences of the smallest tables, fitted on one half and labelled on the other."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = spark.read.parquet("/root/testdata/sf0.01/languages.parquet")
    named = d.where("kind in ('abstract', 'note')").select("doc_id", "text", languages.named(F.col("lang"), langs).alias("code")).where("code is not null and length(text) > 40")
    rows = named.collect()
    train, test = [r for r in rows if r["doc_id"] % 2], [r for r in rows if not r["doc_id"] % 2]
    model = languages.fit([r["text"] for r in train], [r["code"] for r in train], sorted(r["code"] for r in langs.collect()))
    got = languages.spans([r["text"] for r in test], model)
    right = sum(any(s[0] == r["code"] for s in x) for r, x in zip(test, got))
    assert right / len(test) > 0.8  # some labels are wrong on purpose


def test_text_after_references_is_kept():
    text = "Some words before\n\n[1] Doe, J. A title. 2001.\n[2] Roe, R. Another. 2002.\n\nMore words after."
    got = languages.running_text(text)
    assert len(got) == len(text) and got.split() == "Some words before More words after.".split()
    assert languages.STOP.search(got, 0, got.index("More"))
