"""Web pages: from a table, or fetched politely; their text and title.

Two ways lead to a page's main text: ``main_text`` is a column expression (scripts,
styles, navigation and the like go, then all tags), ``article.article_text`` weighs
the page's elements. Readers take either as ``extract``.
"""

from __future__ import annotations

import time
import urllib.robotparser
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import ENTITIES, squeezed

DROPPED = "script|style|nav|header|footer|aside|form|noscript|template|table"


def title(html: Column) -> Column:
    return squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def main_text(html: Column) -> Column:
    text = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, rf"(?is)<({DROPPED}|head)\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return squeezed(text)


def host(url: Column) -> Column:
    return F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))


def raw_documents(pages: DataFrame, extract: Callable[[Column], Column] = main_text) -> DataFrame:
    """Raw documents of a table (url, html): empty pages are errors."""
    text = F.coalesce(extract(F.col("html")), F.lit(""))
    ok = F.col("html").isNotNull()
    rows = pages.select("url", "html", text.alias("text"))
    return rows.select(
        "url", F.when(ok, title(F.col("html"))).alias("title"), "text", F.when(ok, F.length("text")).alias("char_count"), F.when(ok, "ok").otherwise("error").alias("status")
    )


class Robots:
    """Whether a site's rules allow an address; a rule file is read once per site."""

    def __init__(self, agent: str, fetch: Callable[[str], str] | None = None):
        self.agent, self.fetch, self.known = agent, fetch, {}

    def allows(self, url: str) -> bool:
        at = urlparse(url)
        site = f"{at.scheme}://{at.netloc}"
        if site not in self.known:
            rules = urllib.robotparser.RobotFileParser(f"{site}/robots.txt")
            try:
                rules.parse(self.fetch(f"{site}/robots.txt").splitlines()) if self.fetch else rules.read()
            except Exception:  # no rules to be had: all is allowed
                rules.allow_all = True
            self.known[site] = rules
        return self.known[site].can_fetch(self.agent, url)


def crawl(urls: DataFrame, fetch: Callable[[str], str], agent: str = "graph-reader/1.0", pause: float = 2.0, extract: Callable[[Column], Column] = main_text) -> DataFrame:
    """Raw documents of a table (url). A site's pages are in one task, which pauses between them.

    ``fetch`` gets an address and returns HTML; it raises LookupError for an
    answer that isn't a page, anything else for a failure.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        robots = Robots(agent, fetch)
        for batch in batches:
            rows = []
            for url in batch.url:
                html, status = None, "ok"
                if not robots.allows(url):
                    status = "blocked_by_robots"
                else:
                    try:
                        html = fetch(url)
                    except LookupError:
                        status = "http_error"
                    except Exception:
                        status = "error"
                    time.sleep(pause)
                rows.append((url, html, status))
            yield pd.DataFrame(rows, columns=["url", "html", "status"])

    got = urls.select("url").repartition(host(F.col("url"))).mapInPandas(run, "url string, html string, status string")
    ok = F.col("status") == "ok"
    found = got.withColumn("text", F.when(ok, extract(F.col("html"))).otherwise(""))
    return found.select("url", F.when(ok, title(F.col("html"))).alias("title"), "text", F.when(ok, F.length("text")).alias("char_count"), "status")


