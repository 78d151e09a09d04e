"""DuckDB SQL of the URL filter.

Edges are quoted, absolute canonical links, whose targets are judged whether or not they are pages; the given pages hold no
other links between pages.
"""

from __future__ import annotations

from trailspark.llm.urlfilter import RULES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: str) -> str:
    return f"substr({url}, instr({url}, '://') + 3)"


def _host(url: str) -> str:
    return f"translate(regexp_extract({_rest(url)}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}')"


def _path(url: str) -> str:
    return f"regexp_extract({_rest(url)}, '^[^/?#]*([^?#]*)', 1)"


def _alias(url: str) -> str:
    query = rf"regexp_extract(regexp_extract({_rest(url)}, '^[^#]*'), '\?(.*)$', 1, 's')"
    query = f"ltrim(regexp_replace({query}, '(^|&)utm_[^&=]*=[^&]*', '', 'g'), '&')"
    return (f"CASE WHEN instr({url}, '://') > 0 THEN {_host(url)} || rtrim({_path(url)}, '/') "
            f"|| CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END")


def _if_url(expression: str) -> str:
    return f"coalesce(CASE WHEN instr(url, '://') > 0 THEN {expression} END, '')"


_SHOWN = r"""regexp_replace(coalesce(html, ''), '<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)|<title\b.*?(?:</title\s*>|\z)|<template\b.*?(?:</template\s*>|\z)', ' ', 'gis')"""
_TAG = rf"""regexp_extract({_SHOWN}, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is')"""
_HREF = r"""nullif(replace(regexp_extract(tag, '\bhref\s*=\s*["'']([^"'']*)["'']', 1, 'is'), '&amp;', '&'), '')"""
_VALUES = ", ".join(f"('{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{action}', '{rule}')" for action, rule in RULES)

SQL = f"""
WITH RECURSIVE p AS (
  SELECT row_number() OVER () AS uid, page_id, {_TAG} AS tag, {_if_url(_host('url'))} AS host, {_if_url(_path('url'))} AS path,
    {_alias('url')} AS node
  FROM pages),
rules(rule_host, rule_path, action, rule) AS (VALUES {_VALUES}),
fits AS (
  SELECT uid, rule, action, row_number() OVER (PARTITION BY uid ORDER BY length(rule) DESC, action, rule DESC) AS k
  FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
judged AS MATERIALIZED (
  SELECT p.*, rule, action FROM p LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (uid)),
edges AS (
  SELECT node AS a, {_alias('target')} AS b, {_host('target')} AS host, {_path('target')} AS path
  FROM (SELECT node, {_HREF} AS target FROM judged WHERE tag <> '' AND node IS NOT NULL)
  WHERE regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://')),
targets AS (SELECT DISTINCT b AS node, host, path FROM edges),
actions AS (
  SELECT node, action FROM judged WHERE node IS NOT NULL
  UNION ALL SELECT node, first(action ORDER BY length(rule) DESC, action, rule DESC)
  FROM targets JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY node, host, path),
both_ways AS (SELECT a, b FROM edges WHERE b IS NOT NULL UNION SELECT b, a FROM edges WHERE b IS NOT NULL),
reach(node, seen) AS (
  SELECT node, node FROM (SELECT node FROM judged WHERE node IS NOT NULL UNION SELECT node FROM targets)
  UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.seen),
comp AS (SELECT node, min(seen) AS root FROM reach GROUP BY node),
roots AS (
  SELECT root, coalesce(bool_or(action = 'block'), false) AND NOT coalesce(bool_or(action = 'allow'), false) AS through
  FROM actions JOIN comp USING (node) GROUP BY root)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN through THEN 'block' ELSE 'allow' END) AS verdict, comp.root AS component
FROM judged LEFT JOIN comp USING (node) LEFT JOIN roots ON roots.root = comp.root
"""
