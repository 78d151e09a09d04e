"""URL filters with redirect equivalence, in DataFrame functions only.

Rules (host, path prefix, action) judge a URL directly: a rule fits its host and all subdomains if the URL's path starts
with the rule's; the longest fitting rule wins (allow before block if two are equally long).

A URL that no rule fits is judged through its aliases.  URLs are nodes up to what redirects commonly remove (scheme,
fragment, a trailing slash, ``utm_`` parameters); a page's canonical link and its refresh redirect are edges
(not those in comments, scripts or other raw text; character references in them are decoded).
Connected components of these edges are groups of aliases, and a component with a blocked URL blocks
its members that no rule fits, unless it also has an explicitly allowed one; all others are allowed.
Link targets are judged by the rules like pages, whether or not they are rows of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailspark.llm.common import connected_components, materialize

ALLOW, BLOCK = "allow", "block"
# (action, host + path prefix): the rules of the registered query.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_VALUE = r"""=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, F.lit("://"))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or a URL."""
    return F.translate(F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(_after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def alias_of(url: Column) -> Column:
    """Node of a URL: host, path without trailing slashes, query without ``utm_`` parameters; null without ``://``."""
    whole = F.regexp_extract(_after_scheme(url), r"^[^#]*", 0)
    query = F.regexp_replace(F.regexp_extract(whole, r"(?s)\?(.*)$", 1), r"(^|&)utm_[^&=]*=[^&]*", "")
    query = F.ltrim(query, F.lit("&"))
    node = F.concat(host_of(url), F.rtrim(path_of(url), F.lit("/")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    return F.when(F.instr(url, F.lit("://")) > 0, node)


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"(?is)\b{name}\s*{_VALUE}"
    parts = [F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]
    return F.trim(F.coalesce(*[F.when(p != "", p) for p in parts]))


# Parts of a page whose tags are no tags of the page; an open one goes to the end.
_HIDDEN = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template)\b.*?(?:</\1\s*>|\z)"
_NAMED = (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def visible(html: Column) -> Column:
    """The page without comments, scripts and other raw text."""
    return F.regexp_replace(html, _HIDDEN, " ")


def unescaped(text: Column) -> Column:
    """Character references decoded: numeric ones and the five of XML; one that names no character becomes U+FFFD."""
    parts = F.split(text, r"&#(?=[0-9]+;|[xX][0-9a-fA-F]+;)")

    def decoded(part: Column) -> Column:
        number = F.regexp_extract(part, r"^([0-9]+|[xX][0-9a-fA-F]+);", 1)
        code = F.when(number.rlike("^[xX]"), F.conv(F.substring(number, 2, 12), 16, 10)).otherwise(F.substring(number, 1, 12)).try_cast("long")
        ok = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, code).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32")
        return F.concat(char, F.regexp_replace(part, "^[^;]*;", ""))

    out = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), decoded), ""))
    for name, char in _NAMED:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def canonical_link(html: Column) -> Column:
    """Target of the first ``<link rel=canonical>``; null without one."""
    return _attribute(F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0), "href")


def refresh_target(html: Column) -> Column:
    """Target of the first ``<meta http-equiv=refresh content="0; url=...">``; null without one."""
    tag = F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    target = F.regexp_extract(_attribute(tag, "content"), r"""(?is)url\s*=\s*['"]?([^'"]*)""", 1)
    return F.when(F.trim(target) != "", F.trim(target))


def resolved(target: Column, base: Column) -> Column:
    """A link target made absolute against the page's URL; null for a fragment of the page and for schemes without ``//``
    (``mailto:``, ``javascript:``).  ``://`` behind anything but a scheme is part of a path or query."""
    scheme = F.regexp_extract(base, r"^(.*?)://", 1)
    root = F.concat(scheme, F.lit("://"), host_of(base))
    folder = F.concat(root, F.coalesce(F.regexp_extract(path_of(base), r"(?s)^(.*/)", 1), F.lit("")))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | target.startswith("#"), F.lit(None).cast("string"))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.startswith("?"), F.concat(root, path_of(base), target))
            .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), target)))


def _rules(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    rows = [(host, "/" + path, action, rule) for action, rule in rules for host, _, path in [rule.partition("/")]]
    return df.sparkSession.createDataFrame(rows, "rule_host string, rule_path string, action string, rule string")


def _best(urls: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys``, ``rule`` and ``action`` of the longest rule that fits the host and path of ``urls``, where one does."""
    # the host itself and all its parents
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fits = (urls.where("host <> ''").select(*keys, F.col("path").alias("__path"), F.explode(parents).alias("rule_host"))
            .join(rules, "rule_host").where(F.col("__path").startswith(F.col("rule_path"))))
    longest = F.struct(F.length("rule"), F.col("action") == ALLOW, F.col("rule"))
    best = fits.groupBy(*keys).agg(F.max_by(F.struct("rule", "action"), longest).alias("best"))
    return best.select(*keys, "best.rule", "best.action")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``component``.

    A null URL or one without ``://`` has an empty host and path, fits no rule, has no alias and is allowed.  Null or
    empty html has no links; repeated rows get the same verdict; an empty table gives an empty result.
    ``component`` is the smallest node (see :func:`alias_of`) of the URL's aliases.
    """
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), visible(F.col(html).cast("string")).alias("html"))
    targets = F.array_compact(F.array(canonical_link(F.col("html")), refresh_target(F.col("html"))))
    targets = F.transform(F.coalesce(targets, F.array().cast("array<string>")), lambda t: resolved(unescaped(t), F.col("url")))
    targets = F.transform(F.filter(targets, lambda t: F.coalesce(F.instr(t, F.lit("://")), F.lit(0)) > 0), lambda t: F.struct(
        alias_of(t).alias("node"), host_of(t).alias("host"), path_of(t).alias("path")))
    narrow = materialize(src.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                                    alias_of(F.col("url")).alias("node"), targets.alias("targets"), F.monotonically_increasing_id().alias("uid")))
    table = _rules(pages, rules)
    judged = materialize(narrow.join(_best(narrow, table, ["uid"]), "uid", "left").select("page_id", "host", "path", "node", "targets", "rule", "action"))
    links = judged.where("node is not null").select("node", F.explode("targets").alias("target"))
    linked = _best(links.select("target.*").distinct(), table, ["node", "host", "path"])
    edges = links.select(F.col("node").alias("a"), F.col("target.node").alias("b"))
    comp = connected_components(edges, "a", "b").withColumnRenamed("component", "root")
    every = judged.where("node is not null").select("node", "action").unionByName(linked.select("node", "action"))
    nodes = every.groupBy("node").agg(
        F.max(F.col("action") == BLOCK).alias("blocked"), F.max(F.col("action") == ALLOW).alias("allowed"))
    members = materialize(nodes.join(comp, "node", "left").withColumn("root", F.coalesce("root", "node")))
    roots = members.groupBy("root").agg(F.max("blocked").alias("blocked"), F.max("allowed").alias("allowed"))
    decided = members.select("node", "root").join(
        roots.select("root", (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("through")), "root")
    verdict = F.coalesce("action", F.when(F.col("through"), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return judged.join(decided, "node", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("root").alias("component"))
