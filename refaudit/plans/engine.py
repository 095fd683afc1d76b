"""The whole verification of a reference list as one logical plan."""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refaudit.functions import identifiers as ids
from refaudit.functions import text
from refaudit.operators import lookup, merge, ranking, report, scoring
from refaudit.session import atomic_write, materialize, release
from refaudit.sources import adapters, bibtex, responses

FIELDS = (
    "title", "author", "journal", "booktitle", "year", "volume", "number", "pages", "publisher", "doi", "pmid", "pmcid", "eprint", "url", "note",
    "howpublished", "archiveprefix", "primaryclass", "keywords",
)
CANDIDATE = "struct<" + ", ".join(f"`{f}`: string" for f in ("ENTRYTYPE", *FIELDS)) + ">"
RESULT = ("key", "title", "bucket", "status", "complete", "confidence", "reason", "platform", "changes", "differences", "field_diffs", "n_applied", "n_meaningful", "providers")


@dataclass
class Settings:
    """Thresholds and switches of a run.

    With ``exact=False`` titles are compared without the sequence ratio and compatibility forms and
    the whole run stays in the JVM. ``keys`` holds the access keys of sources that demand one.
    """

    matched: float = scoring.MATCHED
    ambiguous: float = scoring.AMBIGUOUS
    margin: float = scoring.MARGIN
    auto_update: float = merge.THRESHOLD
    stop_on_match: bool = True
    exact: bool = True
    sources: list[tuple[str, int, bool]] = field(default_factory=lambda: list(ranking.SOURCES))
    keys: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name in ("matched", "ambiguous", "margin", "auto_update"):
            if not 0 <= getattr(self, name) <= 1:
                raise ValueError(f"{name} must lie between 0 and 1")
        if self.ambiguous > self.matched:
            raise ValueError("ambiguous must not exceed matched")


def _known(c: str) -> Column:
    return ids.strip(F.coalesce(F.col(c), F.lit(""))) != ""


class Engine:
    """``Engine(spark).verify(entries, {"crossref": records, ...})``.

    Entries have (pos, key, entrytype, the columns of FIELDS, extra) and, where they come from
    several lists, (path); an entry is named by path and pos, its key is unique within its list.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None) -> None:
        self.spark, self.settings = spark, settings or Settings()

    def entries(self, path: str, encoding: str = "auto") -> DataFrame:
        """Entries of reference list files as rows (path, pos, key, entrytype, fields, extra)."""
        e = bibtex.read_files(self.spark, path, encoding)
        known = [F.coalesce(F.col("fields")[f], F.lit("")).alias(f) for f in FIELDS]
        extra = F.map_filter("fields", lambda k, v: ~k.isin(*FIELDS))
        return e.select("path", F.col("pos").cast("bigint").alias("pos"), "key", "entrytype", *known, extra.alias("extra"))

    @staticmethod
    def scope(entries: DataFrame) -> list[str]:
        return ["path"] if "path" in entries.columns else []

    def _norm(self, c: Column | str) -> Column:
        return text.normalize(c) if self.settings.exact else text.normalize_native(c)

    def named(self, entries: DataFrame) -> DataFrame:
        """Entries with ``entry_ref`` and what they are asked by: identifiers ``_doi`` and so on, the
        title's words ``_t``, whether there is a title (``_titled``) or anything to search by, and the
        forms ``_original`` that their candidates are compared with."""
        e = ids.with_ids(entries, {f: F.col(f) for f in FIELDS}, "_")
        kinds = ("doi", "pmid", "pmcid", "arxiv")
        any_id = F.concat(*[F.col(f"_{k}") for k in kinds]) != ""
        ref = F.struct(*[F.col(c) for c in (*self.scope(entries), "pos")])
        e = e.withColumns({"entry_ref": ref, "_t": self._norm("title"), "_titled": _known("title")})
        get = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FIELDS}
        e = scoring.forms(e, get, "_original", self.settings.exact, known={"t": F.col("_t")} | {k: F.col(f"_{k}") for k in kinds})
        return materialize(e.withColumn("_searchable", F.col("_titled") | any_id))

    def asked(self, named: DataFrame, source: str) -> DataFrame:
        """(entry_ref, _t, _k, source_status, _titled, _least): what a source is asked by, ``_k`` an
        identifier or else the title ``_t``; a status where it cannot be asked at all. Candidates whose
        titles are less like the entry's than ``_least`` would be no match."""
        kinds, _, _ = adapters.ACCESS[source]
        key = lookup.first_id(kinds, {k: F.col(f"_{k}") for k in kinds}) if kinds else F.lit(None).cast("struct<kind: string, value: string>")
        if source == "biorxiv":
            key = F.when(F.col("_doi").startswith("10.1101/"), key)
            status = F.when(key.isNull(), "skipped")
        else:
            status = F.when(key.isNull() & ~F.col("_titled"), "invalid_input")
        if source == "core" and not self.settings.keys.get("core"):
            status = F.coalesce(status, F.lit("auth_error"))
        # the sequence ratio is not bounded by words; PubMed's records are only reached by way of those found
        least = F.lit(0.0) if self.settings.exact or source == "pubmed" else scoring.least_title("_original", self.settings.ambiguous)
        return named.select("entry_ref", "_t", key.alias("_k"), status.alias("source_status"), "_titled", least.alias("_least"))

    def prepare(self, records: DataFrame, source: str) -> DataFrame:
        """(rec_id, candidate, doi, pmid, pmcid, arxiv, _rt, _candidate): a source's records adapted,
        indexed and brought to the forms that are compared.

        :meth:`verify` takes it in place of the records; written as a table once, it spares every run
        (and every batch of a stream) the adaptation of the whole source.
        """
        adapted = adapters.records_of(records, source, ["rec_id"], native=not self.settings.exact)
        cols = set(adapted.columns)
        get = {f: F.coalesce(F.col(f).cast("string"), F.lit("")) if f in cols else F.lit("") for f in FIELDS}
        made = scoring.forms(adapted, get, "_candidate", self.settings.exact, own=True)
        own = {"doi": "doi", "pmid": "pmid", "pmcid": "pmcid", "arxiv": "eprint"}
        return made.select("rec_id", self._body(adapted).alias("candidate"), *[F.col(f"_candidate_{f}_").alias(k) for k, f in own.items()], F.col("_candidate.t").alias("_rt"), "_candidate")

    @staticmethod
    def _body(adapted: DataFrame) -> Column:
        """The fields of adapted records as a struct; those that a source lacks are null."""
        return F.struct(*[(F.col(f) if f in adapted.columns else F.lit(None).cast("string")).alias(f) for f in ("ENTRYTYPE", *FIELDS)])

    def candidates(self, asked: DataFrame, source: str, records: DataFrame) -> DataFrame:
        """(entry_ref, source, cand_pos, _candidate): the records a source answers an entry with, without
        those that would be no match for their titles."""
        kinds, falls_back, limit = adapters.ACCESS[source]
        stored = "candidate" in records.columns
        index = records if stored else materialize(self.prepare(records, source).drop("candidate", "_rt"))
        if stored and ("_candidate" not in index.columns or index.schema["_candidate"].dataType.fieldNames() != [*scoring.FORMS]):
            index = scoring.with_forms(index, "candidate", "_candidate", self.settings.exact)
        body = index.select("rec_id", "_candidate")

        def search(rest: DataFrame) -> DataFrame:
            titled = rest.where("_titled").select("entry_ref", "_t", "_least")
            return lookup.by_title(titled, index.select("rec_id", F.col("_candidate.t").alias("_rt")), "entry_ref", "rec_id", F.col("_t"), F.col("_rt"), least=F.col("_least")).select("entry_ref", "rec_id")

        ready = asked.where("source_status is null")
        if not kinds:
            pairs = search(ready)
        else:
            held = lookup.id_index(index, "rec_id", {k: F.col(k) for k in kinds}, limit)
            hits = lookup.exact(ready, held, "entry_ref", F.col("_k")).select("entry_ref", "rec_id")
            if source == "biorxiv":
                pairs = hits
            elif falls_back:
                pairs = lookup.with_fallback(hits, ready, search, "entry_ref")
            else:
                pairs = hits.unionByName(search(ready.where("_k is null")))
            if source == "pubmed":  # all but an id of its own lead to ids first, then to their records
                own = ready.where("_k.kind = 'pmid'").select("entry_ref")
                hop = lookup.two_hop(pairs.join(own, "entry_ref", "left_anti"), index, "entry_ref", "rec_id", F.col("pmid")).select("entry_ref", "rec_id")
                pairs = pairs.join(own, "entry_ref", "left_semi").unionByName(hop).distinct()
        found = materialize(pairs)
        del pairs, search  # with the pairs written down, nothing holds the files of the lookup any more
        release(self.spark)
        return found.join(body, "rec_id").select("entry_ref", F.lit(source).alias("source"), F.col("rec_id").cast("bigint").alias("cand_pos"), "_candidate")

    def _answers(self, valid: DataFrame, tables: Mapping[str, DataFrame], recorded: DataFrame | None) -> tuple[DataFrame | None, DataFrame | None]:
        """(statuses (entry_ref, source, asked_status), what :meth:`_chosen` gives) of all sources; with
        recorded answers the best candidates have their records as ``candidate``, those of tables null."""

        def answer(source: str) -> tuple[DataFrame, DataFrame]:
            asked = self.asked(valid, source)
            status = asked.where("source_status is not null").select("entry_ref", F.lit(source).alias("source"), F.col("source_status").alias("asked_status"))
            found = self.candidates(asked, source, tables[source])
            if recorded is not None:  # which may be answers of the same source
                return status, found
            best = materialize(self._chosen(found, valid))
            del found  # and with it the forms of the source's records
            release(self.spark)
            return status, best

        # two sources are asked side by side, as not all of their jobs fill the cores; more would only
        # have the files of more lookups lie about at once
        with ThreadPoolExecutor(2) as pool:
            answers = list(pool.map(inheritable_thread_target(self.spark)(answer), tables))
        statuses, found = [a[0] for a in answers], [a[1] for a in answers]
        if recorded is not None:
            found = [f.withColumn("candidate", F.lit(None).cast(CANDIDATE)) for f in found]
            scope = self.scope(recorded)
            read = responses.statuses(recorded.withColumn("entry_ref", F.struct(*[F.col(c) for c in (*scope, "pos")])))
            statuses.append(read.where("source_status is not null").select("entry_ref", "source", F.col("source_status").alias("asked_status")))
            for source in [s for s in adapters.ADAPTERS if s == "arxiv" or s in responses.PATHS]:
                rows = responses.records(read.where((F.col("source") == source) & F.col("source_status").isNull()), source, ["entry_ref"], native=not self.settings.exact)
                rows = rows.select("entry_ref", F.lit(source).alias("source"), F.col("cand_pos").cast("bigint").alias("cand_pos"), self._body(rows).cast(CANDIDATE).alias("candidate"))
                found.append(scoring.with_forms(rows, "candidate", "_candidate", self.settings.exact))
        union = lambda ds: None if not ds else ds[0] if len(ds) == 1 else union([ds[0].unionByName(ds[1]), *ds[2:]])
        if recorded is None:
            return union(statuses), union(found)
        return union(statuses), found and self._chosen(union(found), valid, ("candidate",))

    def _chosen(self, found: DataFrame, valid: DataFrame, own: tuple[str, ...] = ()) -> DataFrame:
        """(entry_ref, source, source_status, score, cand_pos, the columns ``own``) of the best candidates."""
        s = self.settings
        scored = scoring.assess(found.join(valid.select("entry_ref", "_original"), "entry_ref"), matched=s.matched, ambiguous=s.ambiguous, exact=s.exact)
        return ranking.select(scored.select("entry_ref", "source", "cand_pos", "status", "score", *own), ["entry_ref", "source"], s.margin)

    def _results(self, valid: DataFrame, tables: Mapping[str, DataFrame], recorded: DataFrame | None) -> DataFrame:
        """(entry_ref, source, rank, source_status, score, cand_pos) of every source in order; with
        recorded answers also their ``candidate``."""
        s = self.settings
        ranked = ranking.rank_sources(valid, {f: F.col(f) for f in FIELDS}, "entry_ref", ranking.sources(self.spark, s.sources))
        statuses, chosen = self._answers(valid, tables, recorded)
        answering = list(tables) if recorded is None else None
        if statuses is None or not chosen:
            return ranked.select("*", F.lit("skipped").alias("source_status"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("bigint").alias("cand_pos"))
        own = () if recorded is None else ("candidate",)
        both = ranked.join(chosen, ["entry_ref", "source"], "left").join(statuses, ["entry_ref", "source"], "left")
        if answering is not None:
            silent = F.when(F.col("source").isin(*answering), "no_match").otherwise("skipped")
        else:  # a recorded answer without candidates is no match; a source without an answer was not asked
            heard = recorded.select(F.struct(*[F.col(c) for c in (*self.scope(recorded), "pos")]).alias("entry_ref"), "source", F.lit(True).alias("_heard"))
            both = both.join(heard, ["entry_ref", "source"], "left")
            silent = F.when(F.col("_heard") | F.col("source").isin(*tables), "no_match").otherwise("skipped")
        return both.select("entry_ref", "source", "rank", F.coalesce("asked_status", "source_status", silent).alias("source_status"), "score", "cand_pos", *own)

    def _with_candidates(self, rows: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
        """``rows`` (entry_ref, source, cand_pos and others) with the records that they name as
        ``candidate``, adapted only now; a candidate that ``rows`` have already (a recorded one) is kept."""
        named = rows.where("cand_pos is not null" + (" and candidate is null" if "candidate" in rows.columns else "")).select(F.col("entry_ref").alias("_ref"), F.col("source").alias("_source"), F.col("cand_pos").alias("_cand"))
        parts = []
        for source, records in tables.items():
            at = F.col("rec_id").cast("bigint") == F.col("_cand")
            met = records.join(named.where(F.col("_source") == source), at)
            if "candidate" in records.columns:
                body = met.select("_ref", "_source", F.col("candidate").cast(CANDIDATE).alias("_body"))
            else:
                adapted = adapters.records_of(met, source, ["_ref", "_source"], native=not self.settings.exact)
                body = adapted.select("_ref", "_source", self._body(adapted).cast(CANDIDATE).alias("_body"))
            parts.append(body)
        own = F.col("candidate") if "candidate" in rows.columns else F.lit(None).cast(CANDIDATE)
        if not parts:
            return rows.withColumn("candidate", own)
        while len(parts) > 1:
            parts = [parts[0].unionByName(parts[1]), *parts[2:]]
        bodies = parts[0].select(F.col("_ref").alias("entry_ref"), F.col("_source").alias("source"), "_body")
        return rows.join(bodies, ["entry_ref", "source"], "left").withColumn("candidate", F.coalesce(own, F.col("_body"))).drop("_body")

    def verify(self, entries: DataFrame, tables: Mapping[str, DataFrame], recorded: DataFrame | None = None) -> DataFrame:
        """One row per entry: bucket, status, confidence, reason, source, decisions on the fields.

        ``tables`` holds the records of each source (rec_id and its columns, or a payload);
        ``recorded`` answers to single entries (pos, source, http_status, error, body). Entries
        without a key, or with one that occurs twice, are invalid input and looked up nowhere, as are
        entries with neither title nor identifier. Sources that are on but have no records are
        skipped.
        """
        s = self.settings
        scope = self.scope(entries)
        named = self.named(entries)
        searchable = report.valid_keys(named, "key", scope).where("_searchable")
        results = self._results(searchable, tables, recorded)
        walked = ranking.consulted(results, "entry_ref", s.stop_on_match)
        carried = tuple(c for c in ("cand_pos", "candidate") if c in results.columns)
        out = materialize(ranking.outcomes(walked, "entry_ref", carried))
        del results, walked
        release(self.spark)
        verified = self._with_candidates(out.where("status = 'verified'"), tables).join(searchable.select("entry_ref", "entrytype", *FIELDS), "entry_ref")
        norm = text.normalize if s.exact else text.normalize_native
        long = merge.decisions(
            verified, ["entry_ref"], {f: F.col(f) for f in FIELDS} | {"ENTRYTYPE": F.col("entrytype")}, {f: F.col(f"candidate.{f}") for f in ("ENTRYTYPE", *FIELDS)}, F.col("score"), s.auto_update, norm
        )
        joined = named.select("entry_ref", "key", "title", "_searchable", *[F.col(c) for c in (*scope, "pos")]).join(out.drop(*carried), "entry_ref", "left").join(merge.merged(long, ["entry_ref"]), "entry_ref", "left")
        duplicate = report.duplicate_keys(named, "key", scope).select(*scope, "key", F.lit(True).alias("_twice"))
        joined = joined.join(duplicate, [*scope, "key"], "left")
        unkeyed = F.trim(F.coalesce("key", F.lit(""))) == ""
        invalid = unkeyed | F.coalesce("_twice", F.lit(False))
        changed = (F.col("status") == "verified") & (F.coalesce("n_meaningful", F.lit(0)) > 0)
        status = F.when(invalid, None).when(changed, "metadata_mismatch").otherwise(F.coalesce("status", F.lit("invalid_input")))
        bucket = F.when(invalid, "invalid_input").when(changed, "updated").otherwise(status)
        reason = (
            F.when(unkeyed, "the entry has no key").when(invalid, "the key occurs more than once").when(~F.col("_searchable"), "the entry has neither a title nor an identifier")
            .when(F.col("status") == "verified", "a source has a record of high confidence").when(F.col("status") == "ambiguous", "the candidates are ambiguous; nothing was changed")
            .when(F.col("status") == "identifier_conflict", "an identifier of the entry belongs to another work").when(F.col("status") == "source_unavailable", "a source could not be asked, the lookup is incomplete")
            .when(F.col("status") == "not_found", "no source that answered has the work").otherwise("no source could be asked for this entry")
        )
        platform = F.when(F.col("status") == "verified", F.col("source"))
        full = joined.withColumns({"_status": status, "_bucket": bucket, "_reason": reason, "_platform": platform})
        shown = {"bucket": "_bucket", "status": "_status", "reason": "_reason", "platform": "_platform"}
        made = {"complete": F.coalesce("complete", F.lit(False)), "confidence": F.round("score", 4)}
        return full.select(*scope, "pos", *[(made[c] if c in made else F.col(shown.get(c, c))).alias(c) for c in RESULT])

    def first_match(self, entries: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
        """(scope, pos, source, candidate): asked by title only (the first source by DOI, too), the
        best candidate of the first source in order that has one, whatever its status."""
        scope = self.scope(entries)
        blank = {f: F.lit("") for f in FIELDS if f not in ("title", "doi")}
        e = self.named(entries.withColumns(blank))
        by_doi = {k: v for k, v in tables.items() if k == "crossref"}
        rest = {k: v for k, v in tables.items() if k != "crossref"}
        titled = e.withColumns({"doi": F.lit(""), "_doi": F.lit(""), "_original": F.col("_original").withField("doi", F.lit("")).withField("arxiv", F.lit(""))})
        parts = [self._with_candidates(self._results(x, t, None).where(F.col("source").isin(*t)), t) for x, t in ((e, by_doi), (titled, rest)) if t]
        results = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        order = ranking.rank_sources(entries.withColumn("entry_ref", F.struct(*[F.col(c) for c in (*scope, "pos")])), {f: F.col(f) for f in FIELDS}, "entry_ref", ranking.sources(self.spark, self.settings.sources))
        return ranking.first_match(results.drop("rank").join(order, ["entry_ref", "source"]), "entry_ref").select("entry_ref.*", "source", "candidate")

    def updated(self, entries: DataFrame, results: DataFrame) -> DataFrame:
        """(scope, pos, bibtex): every entry in its order, with the applied changes where there are
        any; fields that no source knows stay as they are."""
        scope = self.scope(entries)
        j = entries.join(results.where("bucket = 'updated'").select(*scope, "pos", "changes"), [*scope, "pos"], "left")
        changed = {f: F.coalesce(F.col("changes")[f], F.col(f)) for f in FIELDS}
        kind = F.coalesce(F.col("changes")["ENTRYTYPE"], F.col("entrytype"))
        return j.select(*scope, "pos", bibtex.serialize(F.coalesce("key", F.lit("")), kind, changed, F.col("extra")).alias("bibtex"))

    def review(self, entries: DataFrame, results: DataFrame) -> DataFrame:
        """(scope, bucket_ord, pos, bibtex) of the entries that need a look, as they were given."""
        scope = self.scope(entries)
        wanted = report.review(results.select(*scope, "pos", "bucket")).select(*scope, "pos", "bucket_ord")
        text_of = bibtex.serialize(F.coalesce("key", F.lit("")), F.col("entrytype"), {f: F.col(f) for f in FIELDS}, F.col("extra"))
        return entries.join(wanted, [*scope, "pos"]).select(*scope, "bucket_ord", "pos", text_of.alias("bibtex"))

    def explain(self, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, field, original, updated): the fields in which two tables of entries differ."""
        form = lambda d: merge.long_form(d, keys, [c for c in d.columns if c not in keys])
        return merge.differences(form(left), form(right), keys)

    def rank(self, entries: DataFrame) -> DataFrame:
        """(pos, source, rank): the order in which the sources are asked for each entry."""
        fields = {f: F.col(f) for f in FIELDS if f in entries.columns}
        return ranking.rank_sources(entries, fields, "pos", ranking.sources(self.spark, self.settings.sources))

    def apply(self, path: str, entries: DataFrame, results: DataFrame, backup: str | None = "", encoding: str = "auto") -> bool:
        """Rewrite one reference list in place if a change applies; the old bytes are kept first.

        One file on the driver's disk by nature; whole tables are written with
        ``bibtex.write_text``. The encoding is the one that the file was read with, without adding
        a mark that it did not have. ``backup`` names the copy (by default the path and ``.bak``);
        null makes none.
        """
        if results.where(F.coalesce("n_applied", F.lit(0)) > 0).limit(1).count() == 0:
            return False
        with open(path, "rb") as f:
            raw = f.read()
        body, found = bibtex.decode(raw, bibtex.ENCODINGS if encoding == "auto" else (encoding,))
        if found == "utf-8-sig" and not raw.startswith(b"\xef\xbb\xbf"):
            found = "utf-8"
        if backup is not None:
            with open(backup or f"{path}.bak", "wb") as f:
                f.write(raw)
        self.write_file(path, self.updated(entries, results), ["pos"], found or "utf-8", body or "")
        return True

    @staticmethod
    def write_file(path: str, rows: DataFrame, order: list[str], encoding: str = "utf-8", like: str = "") -> None:
        """The ``bibtex`` texts of ``rows`` as one file, with the line ends of the text ``like``."""
        newline = "\r\n" if like.count("\r\n") * 2 > like.count("\n") else "\n"
        atomic_write(path, "\n".join(r["bibtex"] for r in rows.orderBy(*order).toLocalIterator()), encoding, newline)

    def labelled_pairs(self, path: str) -> DataFrame:
        """Labelled pairs of a JSON array: id, expected, original, candidate."""
        side = "struct<title: string, author: string, year: string, doi: string>"
        return self.spark.read.schema(f"id string, expected string, original {side}, candidate {side}").json(path, multiLine=True)

    def doi_to_bibtex(self, doi: str, crossref: DataFrame, key: str | None = None) -> DataFrame:
        """(bibtex) of the first record with a DOI, which may be given in any form; ``key`` names the
        entry, else a key is made."""
        first = crossref.where(ids.doi("doi") == ids.doi(F.lit(doi))).orderBy("rec_id").limit(1)
        year = F.get(F.get(F.col("published")["date-parts"], F.lit(0)), F.lit(0)).cast("string")
        made = F.lit(key) if key else ids.citation_key(F.get("author", F.lit(0))["family"], year, F.get("title", F.lit(0)), F.col("doi"))
        e = adapters.adapt(first.withColumn("_key", made), "crossref", ["_key"])
        return e.select(bibtex.serialize(F.col("_key"), F.col("ENTRYTYPE"), {f: F.col(f) for f in e.columns if f not in ("_key", "ENTRYTYPE")}).alias("bibtex"))
