"""Weighted, explained score of (entry, candidate) pairs and its status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refaudit.functions import identifiers as ids
from refaudit.functions import text
from refaudit.operators import similarity as sim

#: Weights of the signals, renormalized over those that are known.
WEIGHTS = {"title": 0.55, "authors": 0.20, "year": 0.10, "venue": 0.10, "pages": 0.05}
MATCHED, AMBIGUOUS, MARGIN = 0.86, 0.68, 0.04
FIELDS = ("title", "author", "year", "journal", "booktitle", "pages", "doi", "pmid", "pmcid", "eprint", "archiveprefix", "url", "note", "howpublished")


def _field(df: DataFrame, side: str, name: str) -> Column:
    fields = df.schema[side].dataType.fieldNames()
    return F.coalesce(F.col(f"{side}.{name}").cast("string"), F.lit("")) if name in fields else F.lit("")


#: The parts of the forms that :func:`assess` compares.
FORMS = ("t", "v", "p", "a", "year", "titled", "venued", "paged", "doi", "pmid", "pmcid", "arxiv")


def with_forms(df: DataFrame, side: str, name: str, exact: bool = True) -> DataFrame:
    """``df`` with the struct ``name``: what :func:`assess` compares of the struct ``side``, in normal forms.

    Made once a record and kept beside it, it spares every pair the normalization of both sides.
    """
    return forms(df, {n: _field(df, side, n) for n in FIELDS}, name, exact)


def forms(df: DataFrame, get: dict[str, Column], name: str, exact: bool = True, known: dict[str, Column] | None = None, own: bool = False) -> DataFrame:
    """As :func:`with_forms`, of the texts ``get`` (no nulls). Parts that are ``known`` (the title ``t``,
    the identifiers) are taken as they are; ``own`` keeps the columns of :func:`ids.with_ids`."""
    norm = text.normalize if exact else text.normalize_native
    known = known or {}
    venue = F.when(get["journal"] != "", get["journal"]).otherwise(get["booktitle"])
    made = {"t": norm(get["title"]), "v": norm(venue), "p": norm(get["pages"]), "a": sim.families(get["author"], norm), "year": text.year(get["year"]), "titled": get["title"] != "", "venued": venue != "", "paged": get["pages"] != ""}
    step = df.withColumns({f"{name}_{k}": v for k, v in (made | known).items()})
    if "doi" not in known:
        step = ids.with_ids(step, get, f"{name}_", own)
    return step.withColumn(name, F.struct(*[F.col(f"{name}_{k}").alias(k) for k in FORMS])).drop(*[f"{name}_{k}" for k in FORMS])


def least_title(form: str, ambiguous: float = AMBIGUOUS) -> Column:
    """The least similarity of titles with which a candidate is more than no match to an entry of the
    forms ``form``, whatever else the candidate has; 0 where the entry has an identifier, as that
    may be shared or differ.

    All other signals that the entry has are taken to be known and to agree in full.
    """
    f = F.col(form)
    others = {"authors": F.size(f["a"]) > 0, "year": f["year"].isNotNull(), "venue": f["venued"], "pages": f["paged"]}
    rest = sum((F.when(v, WEIGHTS[n]).otherwise(0.0) for n, v in others.items()), F.lit(0.0))
    none = (f["doi"] == "") & (f["pmid"] == "") & (f["pmcid"] == "") & (f["arxiv"] == "")
    return F.when(none, (ambiguous * (WEIGHTS["title"] + rest) - rest) / WEIGHTS["title"] - 1e-9).otherwise(0.0)


def assess(df: DataFrame, left: str = "original", right: str = "candidate", matched: float = MATCHED, ambiguous: float = AMBIGUOUS, exact: bool = True) -> DataFrame:
    """``df`` with ``score``, ``status`` and ``signals`` of the structs ``left`` and ``right``.

    Fields that a struct lacks count as empty. With ``exact=False`` the title similarity leaves
    the sequence ratio and compatibility forms out and the whole plan stays in the JVM. Where ``df``
    has the forms of a side already (:func:`with_forms`, named as the side with an underscore before),
    they are taken, and the side itself is not needed.
    """
    if matched < ambiguous:
        raise ValueError("the matched threshold must not be below the ambiguous one")
    step = df
    for s in (left, right):
        if f"_{s}" not in df.columns:
            step = with_forms(step, s, f"_{s}", exact)
    l, r = ({k: F.col(f"_{s}")[k] for k in FORMS} for s in (left, right))  # noqa: E741
    # in steps, as a word list or an intersection within a condition is made again wherever it is used
    unlike = l["t"] != r["t"]
    step = step.withColumns({"_words_l": F.when(unlike, sim.tokens(l["t"])), "_words_r": F.when(unlike, sim.tokens(r["t"]))})
    step = step.withColumns({"_both_w": F.size(F.array_intersect("_words_l", "_words_r")), "_both_a": F.size(F.array_intersect(l["a"], r["a"]))})
    step = step.withColumns({
        "_title": sim.title(l["t"], r["t"], exact, sim.jaccard(F.col("_words_l"), F.col("_words_r"), F.col("_both_w"))),
        "_authors": sim.jaccard(l["a"], r["a"], F.col("_both_a")),
        "_year": sim.years(l["year"], r["year"]),
        "_venue": F.when(l["venued"] & r["venued"], sim.title(l["v"], r["v"], exact)),
        "_pages": F.when(l["paged"] & r["paged"], (l["p"] == r["p"]).cast("double")),
        "_ids": sim.identifiers(l, r),
    })
    known = {"title": F.when(l["titled"] & r["titled"], F.col("_title"))} | {n: F.col(f"_{n}") for n in ("authors", "year", "venue", "pages")}
    total = sum((F.coalesce(v * WEIGHTS[n], F.lit(0.0)) for n, v in known.items()), F.lit(0.0))
    weight = sum((F.when(v.isNotNull(), WEIGHTS[n]).otherwise(0.0) for n, v in known.items()), F.lit(0.0))
    weighted = F.try_divide(total, weight)
    shared, clash = F.size("_ids.shared") > 0, F.size("_ids.conflicting") > 0
    other_title = shared & (l["t"] != "") & (r["t"] != "") & (F.col("_title") < 0.45)
    score = F.when(clash | other_title, 0.0).when(shared, F.greatest(F.lit(0.95), F.coalesce(weighted, F.lit(1.0)))).otherwise(F.coalesce(weighted, F.lit(0.0)))
    alone = ~shared & F.col("_authors").isNull() & F.col("_year").isNull() & F.col("_venue").isNull() & F.col("_pages").isNull()
    untitled = shared & (l["t"] == "") & (r["t"] != "")
    out = step.withColumn("score", score)
    status = (
        F.when(clash | other_title, "identifier_conflict")
        .when(alone & (F.col("_title") >= ambiguous), "ambiguous")
        .when((F.col("score") >= matched) & ((F.col("_title") >= 0.60) | untitled), "matched")
        .when((F.col("score") >= ambiguous) | (shared & (F.col("_title") >= 0.45)), "ambiguous")
        .otherwise("no_match")
    )
    text_or_null = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    signals = F.struct(
        F.round("_title", 4).alias("title"), F.round("_authors", 4).alias("authors"), F.col("_year").alias("year"), F.round("_venue", 4).alias("venue"), F.col("_pages").alias("pages"),
        shared.alias("identifier_exact"), text_or_null(F.col("_ids.shared")).alias("shared_identifiers"), text_or_null(F.col("_ids.conflicting")).alias("identifier_conflicts"),
    )
    reason = (
        F.when(clash, F.concat(F.lit("identifiers differ: "), F.array_join("_ids.conflicting", ", ")))
        .when(other_title, "the identifier is shared but the titles have little in common")
        .when((F.col("status") == "ambiguous") & alone, "only the titles agree")
        .when(F.col("status") == "matched", "the known signals agree")
        .when(F.col("status") == "ambiguous", "plausible, below the threshold of a match")
        .otherwise("the known signals do not agree")
    )
    out = out.withColumn("status", status).withColumn("signals", signals).withColumn("reason", reason)
    return out.drop(*[c for c in out.columns if c.startswith("_")])
