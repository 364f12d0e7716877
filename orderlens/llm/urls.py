"""URL filters with redirect equivalence.

Allow and block rules decide urls by host and path. Redirects and canonical links make urls aliases of
one another; the components of that graph carry a block to aliases that no rule names, unless a rule
allows one of them explicitly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from orderlens.llm.components import connected_components
from orderlens.llm.store import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"^([\s\S]*?)://([^/?#]*)([^?#]*)(\??[^#]*)"
_CANONICAL = r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?i)\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
_CONTENT_URL = r"""(?i)\burl\s*=\s*["']?\s*([^"'>\s]+)"""
#: Rules are literals of the plan.
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host and its subdomains, on paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> Rule:
        host, _, path = text.partition("/")
        return cls(verdict, host, f"/{path}")

    def __str__(self) -> str:
        return self.host + self.path


RULES = tuple(Rule.parse(*r) for r in (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if null or none."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 2), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 3), F.lit(""))


def resource_of(url: Column) -> Column:
    """The key by which urls are one resource: scheme and host lower-cased, empty path as ``/``, no
    fragment; null if there is no ``://``."""
    scheme = F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER)
    path = F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url))
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), path, F.regexp_extract(url, _PARTS, 4)))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null. Of equal texts, allow wins."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; {MOST_RULES} at most")
    found = F.lit(None).cast("struct<verdict: string, rule: string>")
    for r in sorted(rules, key=lambda r: (len(str(r)), r.verdict == "allow")):  # the last that fits stands
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(str(r)).alias("rule"))).otherwise(found)
    return found


@pandas_udf(StringType())
def _resolve(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b, x):
        try:
            return urljoin(b, x)
        except ValueError:
            return None
    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) of every canonical link and meta refresh in ``pages`` (url, html), made absolute."""
    attr = lambda tag, i: F.regexp_extract(tag, _HREF, i)
    canonical, refresh = F.regexp_extract("html", _CANONICAL, 0), F.regexp_extract("html", _REFRESH, 0)
    links = pages.where("url is not null and html is not null").select("url", F.explode(F.array(
        F.concat(attr(canonical, 1), attr(canonical, 2), attr(canonical, 3)), F.regexp_extract(refresh, _CONTENT_URL, 1))).alias("link"))
    return links.where("link != ''").select("url", _resolve("url", "link").alias("target"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, redirects: DataFrame | None = None,
                scratch: Scratch | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url, html).

    ``redirects`` may add (url, target) edges. A url that a rule fits has that rule's verdict. Another
    url has the verdict of its component of aliases, which link targets that are not pages belong to as
    well: allow if a rule allows a member, else block if a rule blocks one, else allow. Null urls and
    those without ``://`` have empty host and path, no aliases and are allowed; null html has no links;
    repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    scratch = scratch or Scratch(pages.sparkSession, "urls")
    url = F.col("url")
    judged = scratch.write(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), resource_of(url).alias("key"))
                           .withColumn("own", matching_rule(F.col("host"), F.col("path"), rules)), "judged")
    links = alias_edges(pages)
    if redirects is not None:
        links = links.select("url", "target").unionByName(redirects.select("url", "target"))
    edges = scratch.write(links.select(resource_of(url).alias("a"), resource_of(F.col("target")).alias("b")).where("a is not null and b is not null"), "edges")
    if edges.isEmpty():  # no aliases in the whole table: rules decide, the rest is allowed
        verdict = F.coalesce("own.verdict", F.lit("allow"))
        return judged.select("page_id", "host", "path", "own.rule", verdict.alias("verdict"))
    members = connected_components(edges, scratch, "aliases")
    ruled = members.withColumn("own", matching_rule(host_of(F.col("id")), path_of(F.col("id")), rules))
    roots = scratch.write(ruled.groupBy("root").agg(
        F.max(F.when(F.col("own.verdict") == "allow", 1)).alias("allowed"), F.max(F.when(F.col("own.verdict") == "block", 1)).alias("blocked"))
        .where("blocked = 1 and allowed is null").select("root"), "blocked")
    blocked = scratch.write(members.join(roots, "root", "left_semi").select(F.col("id").alias("key"), F.lit("block").alias("inherited")), "inherited")
    return (judged.join(blocked, "key", "left")
            .select("page_id", "host", "path", "own.rule", F.coalesce("own.verdict", "inherited", F.lit("allow")).alias("verdict")))
