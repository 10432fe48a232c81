"""Fetching by host, and links out of stored pages.

Nothing here opens a connection: the caller hands in ``get``, which does. Hosts
are worked on one after the other by each worker, so that the pace of a host is
kept wherever it lands.
"""

from __future__ import annotations

import time as clock
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..streaming.ingest import next_wait

RETRIES = 3


def fetch(df: DataFrame, get: Callable[[str], tuple[int, str, str]], url_col: str = "url", wait: Callable[[float], None] = clock.sleep) -> DataFrame:
    """Every URL once: ``url``, ``status``, ``content_type``, ``body``, ``tries``.

    ``get`` gives status, content type and body; an exception counts as status
    599. Refusals are repeated, at growing intervals; null URLs drop out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backoff: dict[str, float] = {}
        for f in frames:
            out = []
            for host, url in zip(f["host_"], f["url"]):
                for tries in range(1, RETRIES + 1):
                    try:
                        status, kind, body = get(url)
                    except Exception as e:
                        status, kind, body = 599, type(e).__name__, ""
                    backoff[host], pause = next_wait(backoff.get(host, 0.0), status)
                    wait(pause)
                    if status != 429 and status < 500:
                        break
                out.append((url, status, kind, body, tries))
            yield pd.DataFrame(out, columns=["url", "status", "content_type", "body", "tries"])

    rows = df.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("url")).distinct().withColumn("host_", T.host(F.col("url")))
    return rows.repartition("host_").sortWithinPartitions("host_", "url").mapInPandas(run, "url string, status int, content_type string, body string, tries int")


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; nothing leads above the root."""
    parts = F.split(path, "/")
    ends_open = path.rlike(r"(?:^|/)\.{1,2}$")
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), none, lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_open & (F.size(kept) > 0), "/").otherwise(""))


def absolute(base: Column, href: Column) -> Column:
    """A link against the page it stands on, after RFC 3986: absolute, from the scheme, the root or beside the page, a query or a fragment only."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"#.*$", "")
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.concat(F.regexp_replace(path, r"[^/]*$", ""))
    own, rest = F.regexp_extract(href, r"^([^?#]*)", 1), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    beside = F.concat(root, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), rest)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(root, _without_dots(own), rest))
        .when(href == "", base).when(href.startswith("#"), F.concat(page, href)).when(href.startswith("?"), F.concat(root, path, href)).otherwise(beside)
    )


def answer_links(answer: Column) -> Column:
    """The URLs of a search service's JSON answer (``webPages.value[].url``), each once, in order; none for anything else."""
    pages = F.from_json(answer, "webPages struct<value: array<struct<url: string>>>")["webPages"]["value"]["url"]
    return F.array_distinct(F.filter(F.coalesce(pages, F.array().cast("array<string>")), lambda u: F.coalesce(F.length(u), F.lit(0)) > 0))


def domain_links(html: Column, domain: Column) -> Column:
    """The absolute links of a page of results whose host is the domain or below it, each once, in order."""
    host = lambda u: T.host(u)
    return F.filter(T.absolute_links(html), lambda u: (host(u) == domain) | host(u).endswith(F.concat(F.lit("."), domain)))


def allowed(candidates: DataFrame, robots: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """The candidates that the rules of their host allow; a host without rules (``robots``: host, body) allows all.

    A host's rules are parsed once a batch; a null URL drops out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from urllib.robotparser import RobotFileParser

        known: dict[str, RobotFileParser | None] = {}
        for f in frames:
            keep = []
            for url, body in zip(f["url_"], f["body_"]):
                if not isinstance(body, str):
                    keep.append(True)
                    continue
                if body not in known:
                    known[body] = RobotFileParser()
                    known[body].parse(body.splitlines())
                keep.append(known[body].can_fetch(agent, url))
            yield f.loc[keep, ["row_"]]

    rows = candidates.where(F.col(url_col).isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in candidates.columns]).alias("row_"), F.col(url_col).alias("url_"), T.host(F.col(url_col)).alias("host_"))
    rules = robots.groupBy(F.col("host").alias("host_")).agg(F.max("body").alias("body_"))
    both = rows.join(rules, "host_", "left").select(F.to_json("row_").alias("row_"), "url_", "body_")
    return both.mapInPandas(run, "row_ string").select(F.from_json("row_", candidates.schema).alias("x")).select("x.*")


def head_check(rows: DataFrame, head: Callable[[str], int], key: str = "institution_id", fields: tuple[str, ...] = ("website", "policy_search_url"), most: int = 5) -> DataFrame:
    """The answers to a look at the URLs of the first ``most`` rows, by key: the key, ``field``, ``url``, ``status``, ``elapsed_ms``, ``error``."""
    first = rows.orderBy(key).limit(most)
    each = first.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("url")) for f in fields])).alias("x")).select(key, "x.*").where(F.length("url") > 0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for url in f["url"]:
                began, status, error = clock.monotonic(), None, None
                try:
                    status = int(head(url))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                out.append((status, int((clock.monotonic() - began) * 1000), error))
            yield f.assign(status=pd.array([x[0] for x in out], dtype="Int32"), elapsed_ms=[x[1] for x in out], error=[x[2] for x in out])

    return each.mapInPandas(run, f"{key} string, field string, url string, status int, elapsed_ms bigint, error string")


def result_links(html: Column, domain: Column) -> Column:
    """Targets of a page of search results that wraps them in ``uddg``, decoded, on the domain, each once."""
    wrapped = F.regexp_extract_all(html, F.lit(r"[?&]uddg=([^&\"]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(wrapped, lambda u: F.try_url_decode(u)), lambda u: F.contains(u, domain)))


def scored_links(pages: DataFrame, keywords: list[str], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Links of stored pages that stay on the host and hold a keyword in path or label: ``source``, ``url``, ``score``."""
    a = pages.select(F.col(url_col).alias("source"), F.explode(T.anchors(F.col(html_col))).alias("x"))
    a = a.select("source", absolute(F.col("source"), F.col("x.href")).alias("url"), F.col("x.label").alias("label"))
    path = F.regexp_replace("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    target = F.lower(F.concat(path, F.lit(" "), F.col("label")))
    score = sum((F.contains(target, F.lit(k.lower())).cast("int") for k in keywords), F.lit(0))
    rows = a.where(F.length("url") <= 300).where(T.host(F.col("url")) == T.host(F.col("source"))).withColumn("score", score).where("score > 0")
    return rows.groupBy("source", "url").agg(F.max("score").alias("score"))


def crawl(seeds: DataFrame, links: DataFrame, hops: int = 2, enough: int = 3) -> DataFrame:
    """Pages reached from seeds over a stored graph of scored links: ``url``, ``score`` and ``hop``, at its first hop.

    Links below ``enough`` are followed; better ones are targets already.
    """
    front = seeds.select("url").where("url is not null").distinct()
    found = None
    for hop in range(1, hops + 1):
        step = links.join(front.withColumnRenamed("url", "source"), "source").groupBy("url").agg(F.max("score").alias("score")).withColumn("hop", F.lit(hop))
        if found is not None:
            step = step.join(found.select("url"), "url", "left_anti")
        found = step if found is None else found.unionByName(step)
        front = step.where(F.col("score") < enough).select("url")
    return found


def new_by_query(hits: DataFrame, order: str = "place", answers: DataFrame | None = None) -> DataFrame:
    """How many URLs each query of an institution adds that none before it had: ``institution_id``, ``query``, ``n_new``.

    ``answers`` (institution_id, query, the order, status) adds queries without
    hits: one that failed has its negative status, and after a refusal (429)
    there are no more of the institution's.
    """
    first = hits.groupBy("institution_id", "url").agg(F.min_by("query", order).alias("query"))
    n = first.groupBy("institution_id", "query").agg(F.count(F.lit(1)).alias("n_new"))
    if answers is None:
        return hits.select("institution_id", "query").distinct().join(n, ["institution_id", "query"], "left").select("institution_id", "query", F.coalesce("n_new", F.lit(0)).alias("n_new"))
    refused = answers.where("status = 429").groupBy("institution_id").agg(F.min(order).alias("refused_"))
    asked = answers.join(refused, "institution_id", "left").where(F.col("refused_").isNull() | (F.col(order) <= F.col("refused_")))
    return asked.join(n, ["institution_id", "query"], "left").select("institution_id", "query", F.when(F.col("status") != 200, -F.col("status").cast("bigint")).otherwise(F.coalesce("n_new", F.lit(0))).alias("n_new"))


def pending(candidates: DataFrame, done: DataFrame, key: str = "institution_id", limit: int | None = None, order: str | None = None) -> DataFrame:
    """What is left to do. A limit counts the rows before those done are taken out, in the given order."""
    if limit is not None:
        candidates = candidates.orderBy(order or key).limit(limit)
    return candidates.join(done.select(key).distinct(), key, "left_anti")
