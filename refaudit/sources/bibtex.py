"""BibTeX: a scanner, a batch data source and a serializer.

Reference lists are read with ``mapInArrow`` over binary files (or text columns), one row per
entry with its position; nothing is parsed on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refaudit.functions import identifiers as ids
from refaudit.functions import text
from refaudit.sources.adapters import ENTRY_FIELDS

ENTRY_TYPE = pa.struct([("key", pa.string()), ("entrytype", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])
ENTRY_DDL = "key string, entrytype string, fields map<string, string>"
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030")
#: The month names that BibTeX knows.
MONTHS = {m[:3].lower(): m for m in ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")}
_NAME = re.compile(r"[^\s\"#%'(),={}]+")


class _Scanner:
    """Reads values with nested braces, quotes, concatenation and string macros."""

    def __init__(self, text: str) -> None:
        self.s, self.i, self.macros = text, 0, dict(MONTHS)

    def blank(self) -> None:
        while self.i < len(self.s) and self.s[self.i].isspace():
            self.i += 1

    def name(self) -> str:
        self.blank()
        m = _NAME.match(self.s, self.i)
        if not m:
            return ""
        self.i = m.end()
        return m.group()

    def braced(self, close: str) -> str | None:
        """Text up to the closing sign at depth 0; null if it never comes."""
        depth, start = 0, self.i
        while self.i < len(self.s):
            c = self.s[self.i]
            if c == "\\":
                self.i += 1
            elif c == close and depth == 0:
                self.i += 1
                return self.s[start : self.i - 1]
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            self.i += 1
        return None

    def value(self) -> str | None:
        parts = []
        while True:
            self.blank()
            c = self.s[self.i : self.i + 1]
            if c in ("{", '"'):
                self.i += 1
                body = self.braced("}" if c == "{" else '"')
                if body is None:
                    return None
                parts.append(body)
            else:
                word = self.name()
                if not word:
                    return None
                parts.append(self.macros.get(word.lower(), word))
            self.blank()
            if self.s[self.i : self.i + 1] != "#":
                return re.sub(r"\s*\n\s*", " ", "".join(parts)).strip()
            self.i += 1

    def entries(self) -> Iterator[dict]:
        while True:
            at = self.s.find("@", self.i)
            if at < 0:
                return
            self.i = at + 1
            kind = self.name().lower()
            self.blank()
            sign = self.s[self.i : self.i + 1]
            if not kind or sign not in ("{", "("):
                continue
            self.i += 1
            if kind in ("comment", "preamble"):
                if self.braced("}" if sign == "{" else ")") is None:
                    self.i = at + 1
                continue
            key = "" if kind == "string" else self.name()
            fields: dict[str, str] = {}
            while True:
                self.blank()
                c = self.s[self.i : self.i + 1]
                if c == ",":
                    self.i += 1
                    continue
                if c in ("}", ")", ""):
                    self.i += 1
                    break
                if c == "{":  # a group where a field should stand is passed over
                    self.i += 1
                    if self.braced("}") is None:
                        break
                    continue
                start = self.i
                field = self.name().lower()
                self.blank()
                if not field or self.s[self.i : self.i + 1] != "=":
                    self.i = max(self.i, start + 1)
                    if self.s[self.i : self.i + 1] == "@":
                        break
                    continue
                self.i += 1
                v = self.value()
                if v is None:
                    break
                fields.setdefault(field, v)
            if kind == "string":
                self.macros.update(fields)
            else:
                yield {"key": key, "entrytype": kind, "fields": list(fields.items())}


def parse(source: str | None) -> list[dict]:
    """The entries of a text in their order; what is not an entry is skipped."""
    return list(_Scanner(source).entries()) if source and "@" in source else []


def decode(raw: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str | None, str | None]:
    """(text, encoding) by the first encoding that fits."""
    for e in encodings:
        try:
            return raw.decode(e), e
        except UnicodeDecodeError:
            continue
    return None, None


def scan(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, pos, key, entrytype, fields): the entries of each text."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [parse(t) for t in b.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(found, pa.list_(ENTRY_TYPE))], [*keys, "entries"])

    parsed = df.select(*keys, text_col).mapInArrow(run, f"{kinds}, entries array<struct<{ENTRY_DDL.replace('key string', 'key: string').replace('entrytype string', 'entrytype: string').replace('fields map', 'fields: map')}>>")
    return parsed.select(*keys, F.posexplode("entries").alias("pos", "e")).select(*keys, "pos", "e.*")


def first_entry(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, ENTRYTYPE, fields): the first entry of each text, its values in one pair of braces.

    Doubly braced values are collapsed first; a text that then has no entry is read as it is, and
    one without any entry gives a ``misc`` without fields.
    """
    both = df.select(*keys, F.array(text.collapse_braces(F.col(text_col)), F.col(text_col)).alias("_t")).select(*keys, F.posexplode("_t").alias("_n", "_t"))
    got = scan(both, [*keys, "_n"], "_t").where("pos = 0").groupBy(*keys).agg(F.min_by(F.struct("entrytype", "fields"), "_n").alias("_e"))
    named = df.select(*keys).join(got, keys, "left")
    value = lambda v: F.concat(F.lit("{"), F.btrim(F.regexp_replace(F.regexp_replace(ids.strip(v), r"\{+", "{"), r"\}+", "}"), F.lit("{}")), F.lit("}"))
    fields = F.transform_values(F.map_filter("_e.fields", lambda k, v: ids.strip(v) != ""), lambda k, v: value(v))
    return named.select(*keys, F.coalesce("_e.entrytype", F.lit("misc")).alias("ENTRYTYPE"), F.coalesce(fields, F.create_map().cast("map<string,string>")).alias("fields"))


def read_files(spark: SparkSession, path: str, encoding: str = "auto") -> DataFrame:
    """(path, encoding, newline, pos, key, entrytype, fields) of reference list files.

    A file that none of the encodings fits fails the job: it must not pass for an empty list.
    """
    wanted = ENCODINGS if encoding == "auto" else (encoding,)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(p, *decode(raw, wanted)) for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            for p, t, _ in out:
                if t is None:
                    raise ValueError(f"{p} is in none of the encodings {', '.join(wanted)}")
            newline = ["\r\n" if t.count("\r\n") * 2 > t.count("\n") else "\n" for _, t, _ in out]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1, 2)] + [pa.array(newline, pa.string())], ["path", "text", "encoding", "newline"])

    files = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, text string, encoding string, newline string")
    return scan(files, ["path", "encoding", "newline"])


def serialize(key: Column, entrytype: Column, fields: dict[str, Column], extra: Column | None = None) -> Column:
    """Text of an entry: known fields in their fixed order, then the map of other fields by name;
    blank fields are left out."""
    line = lambda k, v: F.when(ids.strip(F.coalesce(v, F.lit(""))) != "", F.concat(F.lit(f"  {k} = {{"), ids.strip(v), F.lit("}")))
    known = [line(k, fields[k].cast("string")) for k in ENTRY_FIELDS if k in fields] + [line(k, fields[k].cast("string")) for k in sorted(fields) if k not in ENTRY_FIELDS]
    lines = F.array_compact(F.array(*known))
    if extra is not None:
        more = F.transform(F.array_sort(F.map_entries(F.map_filter(extra, lambda k, v: ids.strip(F.coalesce(v, F.lit(""))) != ""))), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = {"), ids.strip(e["value"]), F.lit("}")))
        lines = F.concat(lines, F.coalesce(more, F.array().cast("array<string>")))
    body = F.array_join(F.concat(F.array(F.concat(F.lit("@"), entrytype, F.lit("{"), key)), lines), ",\n")
    return F.replace(F.concat(body, F.lit("\n}\n")), F.lit("arXiv (Cornell University)"), F.lit("arXiv"))


def write_text(entries: DataFrame, path: str, order: list[str], text_col: str = "bibtex") -> None:
    """Entries as text files in a total order; the commit protocol makes the write atomic."""
    entries.orderBy(*order).select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)
