"""Variant spellings of names typed by people: linking those that mean the same entity.

Every distinct spelling is parsed into family part, possible given names and initials. Family
parts are indexed by their suffixes above a minimum length, and by those of their mirror image, so
that one slip anywhere leaves a common key. A key that is too common is not dropped but refined: by
the first initial, and beyond ``COMMON`` family parts also by the rest of the part with one letter
left out. Pairs within a key are compared by the ratio of their longest common subsequence; a rare
spelling joins the family part that more spellings share. Within one family part and initial the
spellings are divided into persons by given names (nicknames included) and initials; a spelling
that fits several persons joins none of them.

Organisations are handled alike: the distinctive word is the family part, the beginnings of the
other words take the place of the initials.

Defined results: null, blank and one-letter names have no entity; ``others`` is no name; repeated
spellings count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refaudit.session import materialize

COMMON = 24
LEAST_RATIO = 0.82
#: Share of the comma-form names that a given name must reach: at most 20,000 words are kept.
GIVEN_SHARE = 1 / 20_000
#: Particles of family names, and words that begin the names of organisations.
PARTICLES = frozenset("de da do dos del della di du la le van der den von vom zu ten ter".split())
LITTLE = frozenset("the of for on and in to de la".split())
ORG = re.compile(r"\b(consort\w*|collab\w*|stud(?:y|ies)|investig\w*|(?:working\s+)?group|institut\w*|inst\.|univ\w*|committee|comm\.|network|society|soc\.|cent(?:er|re)|initiative|association|academy|department|dept\.)", re.I)
#: Nicknames and the given names they stand for.
NICKNAMES = {
    "ted": "theodore edward", "teddy": "theodore edward", "kate": "catherine", "harry": "harold henry", "steve": "stephen", "judy": "judith", "bella": "isabel", "basia": "barbara", "jim": "james", "tony": "anthony",
    "ben": "benjamin", "thea": "dorothea", "leo": "leonard leopold", "bob": "robert", "sonja": "sofia", "stas": "stanislav", "sasha": "aleksandr", "sanne": "susanne", "lena": "helena elena magdalena", "peggy": "margaret",
    "natasha": "natalia", "magda": "magdalena", "dick": "richard", "tadek": "tadeusz", "rafa": "rafael", "sam": "samuel", "paco": "francisco", "mina": "wilhelmina amina", "matt": "matthias", "pepe": "jose giuseppe", "zosia": "zofia",
    "vic": "victor", "hans": "johannes hans-peter", "becky": "rebecca", "tom": "thomas", "kasia": "katarzyna", "tina": "christina valentina", "trish": "patricia", "danny": "daniel", "chuck": "charles", "joe": "joseph", "nick": "nicholas",
    "mitya": "dmitri", "liesl": "elisabeth", "debbie": "deborah", "bill": "william", "bea": "beatriz", "pip": "philip", "fritz": "frederick", "bert": "albert robert", "nell": "helena", "mike": "michael", "beppe": "giuseppe", "vanya": "ivan", "hank": "henry",
    "liz": "elizabeth", "lizzie": "elizabeth", "beth": "elizabeth", "betty": "elizabeth", "bobby": "robert", "rob": "robert", "billy": "william", "will": "william", "jack": "john", "johnny": "john", "dave": "david", "andy": "andrew", "alex": "alexander alexandra", "chris": "christopher christina",
    "dan": "daniel", "ed": "edward edmund", "eddie": "edward", "fred": "frederick", "greg": "gregory", "jeff": "jeffrey", "jenny": "jennifer", "ken": "kenneth", "larry": "lawrence", "maggie": "margaret", "meg": "margaret", "pat": "patricia patrick", "pete": "peter", "phil": "philip",
    "ray": "raymond", "ron": "ronald", "sue": "susan", "tim": "timothy", "zach": "zachary", "gabe": "gabriel", "jimmy": "james", "tommy": "thomas", "charlie": "charles", "joey": "joseph", "nate": "nathan nathaniel", "vince": "vincent", "walt": "walter", "wendy": "gwendolyn", "cathy": "catherine", "kathy": "katherine",
    "jo": "joanna josephine", "nicky": "nicholas nicole", "lou": "louis louise", "max": "maximilian", "gus": "gustav augustus", "manu": "manuel emmanuel", "pancho": "francisco", "lupe": "guadalupe", "nando": "fernando", "gigi": "luigi", "sepp": "josef", "uli": "ulrich", "heinz": "heinrich", "misha": "mikhail", "kolya": "nikolai", "volodya": "vladimir", "gosia": "malgorzata", "krysia": "krystyna",
}
LATEX = re.compile(r"\{?\\(?:['\"`^~=.vcHkur]|[a-zA-Z](?=\{))\s*\{?\\?([A-Za-z])\}?\}?")
LATEX_LETTER = re.compile(r"\{?\\(ss|ae|AE|oe|OE|aa|AA|o|O|l|L)\b\s*\}?")
EXTRA = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ð": "d", "ß": "ss", "æ": "a", "œ": "o", "þ": "th", "ı": "i"})
INITIALS = re.compile(r"^(?:[^\W\d_]\.?-?){1,4}$", re.U)
DIGRAPH = re.compile(r"(?<=[^aeiou])([aou])e(?=[^aeiou]|$)")


def fold(text: str) -> str:
    low = text.lower()
    if low.isascii():
        return low
    return "".join(c for c in unicodedata.normalize("NFD", low.translate(EXTRA)) if not unicodedata.combining(c))


def family(text: str) -> str:
    """Family part: folded letters without particles; ae, oe, ue count as the plain vowel."""
    words = [w for w in re.split(r"[^\w]+", fold(text)) if w and w not in PARTICLES]
    return "".join(DIGRAPH.sub(r"\1", w) for w in words)


def unlatex(name: str) -> str:
    if "\\" in name:
        name = LATEX_LETTER.sub(lambda m: m.group(1), name)
        name = LATEX.sub(r"\1", name)
    return name.replace("{", "").replace("}", "").strip()


def _is_initials(token: str) -> bool:
    letters = re.sub(r"[^\w]", "", token)
    return bool(INITIALS.match(token)) and (len(letters) == 1 or ("." in token and len(letters) <= 3) or (len(letters) <= 3 and letters.isupper()))


class Parser:
    """Parses names with the help of the given names that occur."""

    def __init__(self, given: dict[str, int], org_words: frozenset[str] = frozenset()) -> None:
        self.given = set(given) | set(NICKNAMES)
        top = max(given.values(), default=0)
        self.formal = sorted({g for g, n in given.items() if n * 4 >= top and len(g) > 2} | {f for v in NICKNAMES.values() for f in v.split()})
        self.given |= set(self.formal)
        self.memo: dict[str, tuple[str, ...]] = {}
        self.org_words = org_words

    def formals(self, token: str) -> tuple[str, ...]:
        """The given names that a typed one can stand for."""
        if token not in self.memo:
            out: tuple[str, ...] = (token,)
            if token in NICKNAMES:
                out = tuple(NICKNAMES[token].split())
            elif token not in self.formal and len(token) > 2:
                near = [f for f in self.formal if abs(len(f) - len(token)) <= 1 and one_slip(f, token)]
                nick = [f for k, v in NICKNAMES.items() if not near and len(token) > 3 and one_slip(k, token) for f in v.split()]
                out = tuple(near or nick or [token])
            if len(self.memo) > 50_000:
                self.memo.clear()
            self.memo[token] = out
        return self.memo[token]

    def looks_given(self, token: str) -> int:
        t = fold(token)
        if t in self.given:
            return 2
        return int(len(t) > 2 and self.formals(t) != (t,))

    def parse(self, raw: str) -> tuple[str, str, list[str], str] | None:
        """(kind, family part, possible given names, initials)."""
        name = unlatex(raw)
        if ORG.search(name):
            words = [w for w in re.split(r"[^\w.]+", fold(name)) if w.strip(".") and w not in LITTLE]
            core = [w for w in words if not w.endswith(".") and len(w) >= 5 and not ORG.match(w)]
            rare = [w for w in core if w not in self.org_words] or core or words
            if not rare:
                return None
            key = max(rare, key=len)
            rest = sorted(w.strip(".")[:3] for w in words if w != key)
            return "o", DIGRAPH.sub(r"\1", key), [], " ".join(rest)
        if "," in name:
            left, right = name.split(",", 1)
            fam, tokens = left, right.replace(",", " ").split()
        else:
            tokens = name.split()
            full = [i for i, t in enumerate(tokens) if not _is_initials(t) and fold(t) not in PARTICLES]
            if not full:
                return None
            caps = [i for i in full if tokens[i].isupper() and len(tokens[i]) > 2]
            if len(full) == 1:
                at = full[0]
            elif len(caps) == 1:
                at = caps[0]
            else:
                a, b = self.looks_given(tokens[full[0]]), self.looks_given(tokens[full[-1]])
                at = full[0] if b > a else full[-1]
            fam = tokens[at]
            tokens = tokens[:at] + tokens[at + 1 :]
        fam = family(fam)
        given: list[str] = []
        initials = ""
        for t in tokens:
            f = fold(t)
            if f in PARTICLES:
                continue
            if _is_initials(t):
                initials += re.sub(r"[^\w]", "", f)
            elif f.strip("."):
                f = re.sub(r"[^\w-]", "", f)
                if not given:
                    given = list(self.formals(f))
                    initials += "".join(p[:1] for p in (given[0] if len({g[:1] for g in given}) == 1 else f).split("-"))
                else:
                    initials += "".join(p[:1] for p in f.split("-"))
        if len(fam) < 2:
            return None
        return "p", fam, given, initials


def one_slip(a: str, b: str) -> bool:
    """Whether at most one letter is wrong, missing, added or swapped with the next."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def lcs_ratio(a: str, b: str) -> float:
    """2 * length of the longest common subsequence / total length, by bit-parallel counting."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & at.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 2 * (len(a) - v.bit_count()) / (len(a) + len(b))


def names_of(cases: DataFrame, europepmc: DataFrame, s2: DataFrame) -> DataFrame:
    """The distinct (name) of the three fields; garbled ``original.author`` values are left out."""
    from refaudit.llm import mojibake

    authors = cases.select(F.col("original.author").alias("a")).where("a is not null").distinct()
    clean = mojibake.repair(authors, {"a": F.col("a")}, names=("a",)).where("not a_garbled")
    parts = lambda c, sep: F.explode(F.split(c, sep))
    each = (
        clean.select(parts(F.col("a"), " and ").alias("name"))
        .unionByName(europepmc.select(parts(F.col("authorstring"), ", ").alias("name")))
        .unionByName(s2.select(F.explode("authors.name").alias("name")))
    )
    white = r"^[\s  -   　﻿]+|[\s  -   　]+$"
    return each.select(F.regexp_replace("name", white, "").alias("name")).where("name is not null and length(name) > 1 and name <> 'others'").distinct()


def given_names(names: DataFrame) -> dict[str, int]:
    """The words that stand in the place of given names, with their number; at most 20,000."""
    after = F.split(F.regexp_replace(F.trim("name"), r"^[^,]*,\s*", ""), r"\s+")
    tally = materialize(names.where(F.col("name").contains(",")).select(F.explode(after).alias("w")).where(F.col("w").rlike(r"^\p{L}[\p{L}-]{2,}$")).groupBy("w").agg(F.count("*").alias("n")))
    total = tally.agg(F.sum("n")).first()[0] or 0
    lexicon: dict[str, int] = {}
    for r in tally.where(F.col("n") >= max(2, total * GIVEN_SHARE)).collect():
        k = fold(r["w"])
        if k not in PARTICLES:
            lexicon[k] = lexicon.get(k, 0) + r["n"]
    return lexicon


def org_words_of(names: DataFrame) -> frozenset[str]:
    """Words that a hundredth of the organisations share: they don't tell one from another.

    At most a few hundred, as a name has few words; where no more than twenty names have a word,
    that is no evidence.
    """
    orgs = names.where(F.col("name").rlike(ORG.pattern.replace(r"\b(", r"(?i)\b(", 1)))
    words = orgs.select(F.explode(F.array_distinct(F.split(F.lower("name"), r"[^\p{L}]+"))).alias("w")).where(F.length("w") >= 5)
    tally = materialize(words.groupBy("w").agg(F.count("*").alias("n")))
    least = max(20, orgs.count() / 100)
    return frozenset(fold(r["w"]) for r in tally.where(F.col("n") > least).collect())


def _parsed(names: DataFrame) -> DataFrame:
    """(name, kind, fam, g, given, ini), one row for each possible first initial g."""
    from refaudit.llm import charforms

    lexicon, shared = given_names(names), org_words_of(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(lexicon, shared)
        for b in batches:
            raw = b.column(0)
            shown, _ = charforms.canonical(raw)
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for name, text in zip(raw.to_pylist(), shown.to_pylist()):
                p = parser.parse(text)
                if p is None:
                    continue
                kind, fam, given, ini = p
                for g in sorted({x[:1] for x in given} or {ini[:1]}) if kind == "p" else ["#"]:
                    # a nickname of several given names has another first initial in each group
                    own = g + ini[1:] if given and len({x[:1] for x in given}) > 1 else ini
                    for c, v in zip(cols, (name, kind, fam, g, given, own)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()))], ["name", "kind", "fam", "g", "given", "ini"])

    return names.mapInArrow(run, "name string, kind string, fam string, g string, given array<string>, ini string")


def _left_out(part: Column) -> Column:
    """The part and the part with each one of its letters left out."""
    n = F.length(part)
    return F.array_union(F.array(part), F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.substring(part, F.lit(1), i - 1), F.substring(part, i + 1, n))))


def _parents(parts: DataFrame) -> DataFrame:
    """(fam, g, parent): the family part that a rarer spelling of it belongs to."""
    n = F.length("fam")
    half = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)).cast("array<int>"))
    keys = F.flatten(F.transform(half, lambda m: F.array(
        F.struct(F.concat(F.lit("<"), F.right("fam", m)).alias("k"), F.substring(F.col("fam"), F.lit(1), n - m).alias("rest")),
        F.struct(F.concat(F.lit(">"), F.left("fam", m)).alias("k"), F.substring(F.col("fam"), m + 1, n).alias("rest")),
    )))
    keyed = parts.where(n >= 3).select("fam", "g", "n", F.explode(keys).alias("x")).select("fam", "g", "n", "x.rest", F.xxhash64("x.k", "g").alias("key"))
    counted = keyed.withColumn("size", F.count("*").over(Window.partitionBy("key")))
    final = counted.select("fam", "g", "n", F.explode(F.when(F.col("size") <= COMMON, F.array(F.col("key"))).otherwise(F.transform(_left_out(F.col("rest")), lambda r: F.xxhash64(F.col("key"), r)))).alias("key")).distinct()
    # a refined key holds only parts one letter apart, a plain one at most COMMON of them
    blocks = final.groupBy("key", "g").agg(F.collect_list(F.struct("n", "fam")).alias("m")).where(F.size("m") > 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple[str, str], tuple[int, str]] = {}
            for g, members in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = sorted(((x["n"], x["fam"]) for x in members), key=lambda x: (-x[0], x[1]))
                for i, (nb, small) in enumerate(m):
                    for na, big in m[:i]:
                        if (nb <= 2 or nb * 3 <= na) and abs(len(big) - len(small)) <= 1 and lcs_ratio(big, small) >= LEAST_RATIO and one_slip(big, small):
                            if (small, g) not in out or (-na, big) < (-out[small, g][0], out[small, g][1]):
                                out[small, g] = (na, big)
                            break
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.string()), pa.array([k[1] for k in out], pa.string()), pa.array([v[0] for v in out.values()], pa.int64()), pa.array([v[1] for v in out.values()], pa.string())], ["fam", "g", "pn", "parent"])

    found = blocks.select("g", "m").mapInArrow(run, "fam string, g string, pn bigint, parent string")
    return found.groupBy("fam", "g").agg(F.min_by("parent", F.struct(-F.col("pn"), "parent")).alias("parent"))


class _People:
    """The persons found so far, looked up by given name and by initials."""

    def __init__(self) -> None:
        self.all: list[dict] = []
        self.given: dict[str, list[int]] = {}
        self.nameless: dict[str, list[int]] = {}
        self.initials: dict[str, list[int]] = {}
        self.begin: dict[str, list[int]] = {}

    def add(self, given: tuple[str, ...], ini: str, name: str) -> None:
        self.all.append({"given": given, "ini": ini, "names": [name]})
        self._index(len(self.all) - 1, given, ini, 0)

    def _index(self, i: int, given: tuple[str, ...], ini: str, known: int) -> None:
        for g in given:
            self.given.setdefault(g, []).append(i)
        self.initials.setdefault(ini, []).append(i)
        if not self.all[i]["given"]:
            self.nameless.setdefault(ini, []).append(i)
        for k in range(known, len(ini) + 1):
            self.begin.setdefault(ini[:k], []).append(i)

    def put(self, i: int, name: str, given: tuple[str, ...], ini: str) -> None:
        p = self.all[i]
        p["names"].append(name)
        had, old = p["given"], p["ini"]
        if given:
            p["given"] = tuple(x for x in had if x in given) if had else given
        if len(ini) > len(old):
            p["ini"] = ini
        self._index(i, () if had else p["given"], p["ini"], len(old) + 1)

    def fitting(self, given: tuple[str, ...], ini: str, count: int) -> list[int]:
        """The first two of the persons 0 .. count - 1 that a spelling fits."""

        def places():
            if given:  # one of the same given name, or one without a given name
                for g in given:
                    yield from self.given.get(g, ())
                sources = self.nameless
            else:
                sources = self.initials
                yield from self.begin.get(ini, ())
            for k in range(len(ini) + 1):
                yield from sources.get(ini[:k], ())
            if given:
                yield from self.begin.get(ini, ())

        out: list[int] = []
        for i in places():
            p = self.all[i]
            if i >= count or i in out or (p["given"] and given and not set(p["given"]) & set(given)) or not (p["ini"].startswith(ini) or ini.startswith(p["ini"])):
                continue
            out.append(i)
            if len(out) == 2:
                break
        return out

    def same(self, given: tuple[str, ...], ini: str) -> list[int]:
        """The persons of exactly these initials whose given name does not speak against it."""
        return list(dict.fromkeys(i for i in self.initials.get(ini, ()) if self.all[i]["ini"] == ini and (not self.all[i]["given"] or not given or set(self.all[i]["given"]) & set(given))))


def persons(forms: list[tuple[str, tuple[str, ...], str]]) -> list[list[str]]:
    """Divides the spellings (name, given names, initials) of one family part and first initial.

    In turns: those with given names and further initials, with further initials, with given names,
    and the rest; each joins the one person it fits. One that fits none or several is a person of its
    own, together with those of the same turn that differ from it in form only.
    """
    found = _People()
    tiers: list[list] = [[], [], [], []]
    for f in sorted(forms, key=lambda f: (-len(f[2]), f[0])):
        name, given, ini = f
        long = len(ini) > (1 if not given else max(1, len(given[0].split("-"))))
        tiers[0 if long and given else 1 if long else 2 if given else 3].append(f)
    for k, tier in enumerate(tiers):
        alone: dict[str, list[int]] = {}
        known = len(found.all)
        for name, given, ini in tier:
            if k < 2:
                # M.C. may be a double given name without a middle initial
                own = found.same(given, ini)
                if not own and not given:
                    own = [i for i in dict.fromkeys(found.begin.get(ini, ())) if any("-" in x for x in found.all[i]["given"]) and found.all[i]["ini"].startswith(ini)]
            else:
                own = found.fitting(given, ini, known)
            if len(own) == 1:
                found.put(own[0], name, given, ini)
                continue
            # no one, or more than one: spellings that differ in form only still belong together
            near = [i for g in given or ("",) for i in alone.get(g if given else ini, ())]
            same = [i for i in near if (found.all[i]["ini"] == ini if k < 2 or not given else found.all[i]["ini"].startswith(ini) or ini.startswith(found.all[i]["ini"]))]
            if same:
                found.put(min(same), name, given, ini)
            else:
                for g in given or (ini,):
                    alone.setdefault(g, []).append(len(found.all))
                found.add(given, ini, name)
    return [p["names"] for p in found.all]


def organisations(forms: list[tuple[str, tuple[str, ...], str]]) -> list[list[str]]:
    """Divides the organisations that share a distinctive word by their other words."""
    found: list[tuple[list[str], list[str]]] = []
    for name, _, rest in sorted(forms, key=lambda f: f[0]):
        words = rest.split()
        for own, members in found:
            common = len(set(own) & set(words))
            if own == words or (common and common >= max(len(own), len(words)) - 1 and len(own) == len(words) and any(lcs_ratio(a, b) > 0.6 for a in set(own) - set(words) for b in set(words) - set(own))):
                members.append(name)
                break
        else:
            found.append((words, [name]))
    return [m for _, m in found]


def entities(names: DataFrame) -> DataFrame:
    """(name, entity) for every distinct name that shares its entity with another one.

    ``entity`` is a struct (family part, first initial, kind, number). A nickname of several given
    names lies in a group for each; a spelling that shares an entity with other names in more than
    one group is in none of them.
    """
    forms = materialize(_parsed(names))
    parents = _parents(forms.groupBy("fam", "g").agg(F.count("*").alias("n")))
    parents = materialize(parents.withColumnRenamed("parent", "rep"))
    while True:  # to the root of each chain; a parent has more spellings, so that chains end
        up = parents.select(F.col("fam").alias("rep"), "g", F.col("rep").alias("top"))
        step = materialize(parents.join(up, ["rep", "g"], "left").select("fam", "g", F.coalesce("top", "rep").alias("rep"), F.col("top").isNotNull().alias("moved")))
        parents = step.select("fam", "g", "rep")
        if not step.where("moved").limit(1).count():
            break
    grouped = forms.join(parents, ["fam", "g"], "left").withColumn("rep", F.coalesce("rep", "fam"))
    ordered = grouped.select("rep", "g", "kind", "name", "given", "ini").repartition("rep", "g").sortWithinPartitions("rep", "g", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(6)))

        cols: tuple[list, ...] = ([], [], [], [], [], [])

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_()))], ["name", "rep", "g", "kind", "number", "firm"])
            for c in cols:
                c.clear()
            return batch

        for (rep, g, kind), group in groupby(rows(), key=lambda r: r[:3]):
            members = [(r[3], tuple(r[4] or ()), r[5]) for r in group]
            several = {n for n, given, _ in members if len({x[:1] for x in given}) > 1}
            for k, people in enumerate((persons if kind == "p" else organisations)(members)):
                if len(people) > 1:
                    n, firm = len(people), not several.issuperset(people)
                    for c, v in zip(cols, (people, [rep] * n, [g] * n, [kind] * n, [k] * n, [firm] * n)):
                        c += v
            if len(cols[0]) > 20_000:
                yield flush()
        yield flush()

    linked = ordered.mapInArrow(run, "name string, rep string, g string, kind string, number int, firm boolean")
    each = linked.select("name", "firm", F.struct("rep", "g", "kind", "number").alias("entity"))
    best = each.groupBy("name").agg(F.count_if("firm").alias("n"), F.min_by("entity", F.struct(~F.col("firm"), "entity")).alias("entity"))
    return best.where("n <= 1").select("name", "entity")


def found(cases: DataFrame, europepmc: DataFrame, s2: DataFrame) -> DataFrame:
    """(name_a, name_b): the pairs of different names that mean the same."""
    linked = entities(materialize(names_of(cases, europepmc, s2)))
    sets = linked.groupBy("entity").agg(F.sort_array(F.collect_list("name")).alias("m")).where(F.size("m") > 1)
    pairs = sets.select("m", F.posexplode("m").alias("i", "name_a")).select("name_a", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("name_b"))
    return pairs
