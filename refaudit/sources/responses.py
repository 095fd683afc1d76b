"""Recorded responses of the sources: their status, and the records in their bodies.

A row is one answer of a source to one entry: (entry, source, http_status, error, body). ``error``
is ``timeout`` or ``network`` where no answer came, else null. HTTP errors, bodies that are no JSON
object (no XML feed) and network errors give the source a status of its own for that entry; they
never fail the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refaudit.operators import ranking
from refaudit.sources import adapters

#: Where the records lie in a body, the first path that is present counting.
PATHS = {
    "crossref": ("$.message.items", "$.message"), "openalex": ("$.results",), "semantic_scholar": ("$.data", "$"), "europe_pmc": ("$.resultList.result",),
    "core": ("$.results",), "biorxiv": ("$.collection",), "dblp": ("$.result.hits.hit",), "pubmed": ("$.result",),
}


def statuses(df: DataFrame) -> DataFrame:
    """``df`` with ``source_status``: null where the body can be read for records."""
    sent = F.when(F.col("error").isNotNull(), "network_error").otherwise(ranking.status_of_http(F.col("http_status")))
    is_object = F.from_json("body", "map<string, string>").isNotNull() & F.trim("body").startswith("{")
    is_feed = F.from_xml("body", "entry array<string>").isNotNull() & F.trim("body").startswith("<") & F.trim("body").rlike(r"</\w*:?\w+>$")
    readable = F.coalesce(F.when(F.col("source") == "arxiv", is_feed).otherwise(is_object), F.lit(False))
    return df.withColumn("source_status", F.when(sent != "ok", sent).when(~readable, "parse_error"))


def records(df: DataFrame, source: str, keys: list[str], native: bool = False) -> DataFrame:
    """(keys, cand_pos, entry fields) of the records in one source's readable bodies, in order."""
    if source == "arxiv":
        plain = F.regexp_replace(F.col("body"), r"<(/?)\w+:", "<$1")
        items = F.from_xml(plain, f"entry array<struct<{_nested(adapters.DDL['arxiv'])}>>")["entry"]
    else:
        found = F.coalesce(*[F.get_json_object("body", p) for p in PATHS[source]])
        if source == "pubmed":
            # the records are the values of an object; its list of ids names them in order
            ids = F.from_json(F.get_json_object("body", "$.result.uids"), "array<string>")
            by_id = F.from_json(found, "map<string, string>")
            ddl = adapters.DDL["pubmed"]
            items = F.transform(F.coalesce(ids, F.map_keys(F.map_filter(by_id, lambda k, v: k != "uids"))), lambda i: F.from_json(by_id[i], ddl))
        elif source == "dblp":
            hits = F.from_json(found, "array<struct<info: string>>")["info"]
            items = F.transform(hits, lambda h: F.from_json(h, adapters.DDL["dblp"]))
        else:
            many = F.when(found.startswith("["), found).otherwise(F.concat(F.lit("["), found, F.lit("]")))
            items = F.transform(F.from_json(many, "array<string>"), lambda x: F.from_json(x, adapters.DDL[source]))
    each = df.select(*keys, F.posexplode(items).alias("cand_pos", "_p")).where("_p is not null")
    return adapters.of_struct(each, source, [*keys, "cand_pos"], "_p", native)


def _nested(ddl: str) -> str:
    """The DDL of a row as that of a nested struct."""
    depth, out = 0, []
    for part in ddl.split(", "):
        out.append(part.replace(" ", ": ", 1) if depth == 0 else part)
        depth += part.count("<") - part.count(">")
    return ", ".join(out)
