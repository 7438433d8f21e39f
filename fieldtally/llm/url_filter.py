"""URL filters: fixed rules first, then per-host path templates judged by labelled purity.

Paths of a host form a tree of segments.  Segments that are variable by shape (numbers, dates,
hexadecimal ids, uuids) become placeholders at once, so that counts shrink before any shuffle.
Level by level, down to the last one where a host has enough different segments for it, a node
whose children are many and rarely repeated becomes a wildcard.  Sibling
branches, alike but for one literal segment, are merged where their labelled shares agree: a
branch within ``MERGE_Z`` standard errors of what its siblings have together joins the merged
template, the others stay alone.  A template's purity is its share of good pages, smoothed
towards its host's and that towards the corpus'; below ``MIN_PURITY`` its pages are blocked.

All steps are DataFrame aggregates and joins over (host, path shape) counts; a host with a third
of all pages is spread over its shapes, and every aggregate combines before its shuffle.

Defined cases: a null url, or one without ``://``, has an empty host and path and belongs to
the template of empty paths; without labels every template has the corpus' purity (``PRIOR``);
repeated rows are judged alike; an empty table gives an empty result; a null page_id passes
through; a label without a page is ignored, conflicting labels of a page count as bad.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.session import cut_lineage

WIDE_NODE = 24
REPEATS = 4.0
MERGE_Z = 2.5
SMOOTHING = 8.0
PRIOR = 0.9
MIN_PURITY = 0.5
WILDCARD = "*"
MERGED = "{any}"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` for a host with all its subdomains and a path prefix."""

    action: str
    host: str
    path: str

    @classmethod
    def parse(cls, action: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(action, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        return ((host == self.host) | host.endswith("." + self.host)) & path.startswith(self.path)


_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), upper, lower)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def path_shape(path: Column) -> Column:
    """Segments of a path with those that are variable by their shape replaced."""
    segments = F.split(F.regexp_replace(path, "^/", ""), "/")

    def shape(s: Column) -> Column:
        bare = F.regexp_replace(s, r"\.(html?|php|aspx?)$", "")
        return (
            F.when(bare.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "<date>")
            .when(bare.rlike("^[0-9]+$"), "<num>")
            .when(bare.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"), "<uuid>")
            .when(bare.rlike("^(?=.*[0-9])[0-9a-fA-F]{8,}$"), "<hex>")
            .when(bare.rlike("[0-9]{3,}"), F.regexp_replace(bare, "[0-9]+", "<num>"))
            .otherwise(s)
        )

    return F.transform(segments, shape)


def _wide_levels(counts: DataFrame) -> list[int]:
    """Levels where a host has more than WIDE_NODE different segments; no node of another level can be wide."""
    seen = counts.select("host", F.posexplode("shape").alias("level", "segment")).groupBy("host", "level", "segment").agg(F.lit(1).alias("n"))
    many = seen.groupBy("host", "level").agg(F.sum("n").alias("n")).where(F.col("n") > WIDE_NODE)
    return many.agg(F.array_sort(F.collect_set("level"))).first()[0]


def path_templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Templates of all hosts.

    ``pages`` has ``host``, ``shape`` (see ``path_shape``) and ``page_key``; ``labels`` has
    ``page_key`` and ``good`` (boolean).  The result has, for each host and shape: ``template``,
    ``labelled``, ``good_pages`` and ``purity`` of the template.
    """
    known = labels.where("page_key IS NOT NULL AND good IS NOT NULL").groupBy("page_key").agg(F.min("good").alias("good"))
    marked = pages.join(known, "page_key", "left")
    counts = cut_lineage(
        marked.groupBy("host", "shape").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count("good").alias("labelled"),
            F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good_pages"),
        )
    )
    tree = counts.withColumn("path", F.col("shape"))
    for done, level in enumerate(_wide_levels(counts)):
        here = F.col("path")[level]
        node = F.slice("path", 1, level)
        children = (
            tree.where(F.size("path") > level)
            .groupBy("host", node.alias("node"), here.alias("child"))
            .agg(F.sum("pages").alias("n"))
            .groupBy("host", "node")
            .agg(F.count(F.lit(1)).alias("width"), F.sum("n").alias("n"))
        )
        wide = children.where((F.col("width") > WIDE_NODE) & (F.col("n") < REPEATS * F.col("width")))
        wide = wide.select("host", F.col("node"), F.lit(True).alias("wide"))
        replaced = F.transform("path", lambda s, i: F.when(i == level, WILDCARD).otherwise(s))
        tree = (
            tree.withColumn("node", node)
            .join(wide, ["host", "node"], "left")
            .withColumn("path", F.when(F.col("wide") & (F.size("path") > level), replaced).otherwise(F.col("path")))
            .drop("node", "wide")
        )
        if done % 2:
            tree = cut_lineage(tree)
    return _purity(_merge_siblings(tree))


def _merge_siblings(tree: DataFrame) -> DataFrame:
    """Adds ``template``: the path, or with its last literal segment merged among its siblings."""
    fixed = F.transform("path", lambda s: ~(s.contains("<") | (s == WILDCARD) | (s == "")))
    last = F.array_position(F.reverse(fixed), True)  # from the end, 0 if there is none
    place = F.when(last > 0, F.size("path") - last + 1).otherwise(0)
    family = F.transform("path", lambda s, i: F.when(i + 1 == F.col("place"), MERGED).otherwise(s))
    branches = tree.withColumn("place", place).withColumn("family", family)
    branch = branches.groupBy("host", "family", "path").agg(F.sum("labelled").alias("n"), F.sum("good_pages").alias("g"))
    pooled = branch.groupBy("host", "family").agg(
        F.sum("n").alias("all_n"), F.sum("g").alias("all_g"), F.count(F.lit(1)).alias("siblings")
    )
    both = branch.join(pooled, ["host", "family"])
    share = (F.col("all_g") + 1) / (F.col("all_n") + 2)
    error = F.sqrt(F.col("n") * share * (1 - share))
    alike = (F.col("siblings") > 1) & (F.abs(F.col("g") - F.col("n") * share) <= MERGE_Z * error)
    chosen = both.select("host", "path", F.when(alike, F.col("family")).otherwise(F.col("path")).alias("template"))
    return tree.join(chosen, ["host", "path"])


def _purity(tree: DataFrame) -> DataFrame:
    whole = tree.agg(F.sum("labelled").alias("n"), F.sum("good_pages").alias("g")).first()
    corpus = ((whole["g"] or 0) + SMOOTHING * PRIOR) / ((whole["n"] or 0) + SMOOTHING)
    hosts = tree.groupBy("host").agg(
        ((F.sum("good_pages") + SMOOTHING * corpus) / (F.sum("labelled") + SMOOTHING)).alias("host_purity")
    )
    templates = tree.groupBy("host", "template").agg(F.sum("labelled").alias("labelled"), F.sum("good_pages").alias("good_pages"))
    purity = (F.col("good_pages") + SMOOTHING * F.col("host_purity")) / (F.col("labelled") + SMOOTHING)
    judged = templates.join(hosts, "host").withColumn("purity", purity)
    return tree.select("host", "shape", "template").join(judged, ["host", "template"])


def judge_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, host, path, rule, template, purity, verdict`` of every row.

    ``labels`` has ``page_key`` (the key of a page) and ``good``.  The longest fitting rule
    decides; without one, the template's purity.
    """
    parts = pages.select(
        F.col(key).alias("page_id"),
        F.col(key).alias("page_key"),
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
    )
    shaped = parts.withColumn("shape", path_shape(F.col("path")))
    templates = path_templates(shaped.select("host", "shape", "page_key"), labels)
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # later, longer ones go before
        fits = r.fits(F.col("host"), F.col("path"))
        rule, action = F.when(fits, r.text).otherwise(rule), F.when(fits, r.action).otherwise(action)
    by_purity = F.when(F.col("purity") < MIN_PURITY, "block").otherwise("allow")
    return shaped.join(templates, ["host", "shape"], "left").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.array_join("template", "/").alias("template"),
        "purity",
        F.coalesce(action, by_purity).alias("verdict"),
    )
