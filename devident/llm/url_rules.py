"""URL filtering by host rules and by association rules mined from labelled URLs, with built-in functions only.

A URL becomes a small set of tokens. FP-growth counts the token sets that are frequent among labelled URLs; a set is a rule for a
label if enough of its URLs have it, and rules that a part of theirs already implies go. Rules are looked up by the
rarest of their tokens, once per distinct set of tokens that any rule knows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from devident.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: of the tokens of a URL: labels of the host from the right, segments of the path, keys of the query, and code points of each
HOST_LABELS, SEGMENTS, KEYS, TOKEN_LENGTH = 4, 3, 4, 64


@dataclass(frozen=True)
class HostRule:
    """`verdict` for all URLs of `host` and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Mining:
    """How rules are mined: from `sample` distinct labelled URLs at most (expected, by a hash of the URL), as a share of which a
    token set must have `support`; rules have `tokens` tokens at most and hold for a share of `confidence` of their URLs."""

    sample: int = 200_000
    support: float = 0.01
    confidence: float = 0.8
    tokens: int = 4


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?` or `#`, A-Z lower-cased; empty without `://` or for NULL."""
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The tokens of a URL, all different: host labels and path segments with their place, the file's extension, query
    keys and whether there is a fragment. Digits are one `#`. NULL and texts without `://` have none."""
    url = F.coalesce(url, F.lit(""))
    cut = lambda t: F.substring(t, 1, TOKEN_LENGTH)
    filled = lambda parts: F.filter(parts, lambda p: p != "")
    numbered = lambda parts, kind: F.transform(
        parts, lambda p, i: cut(F.concat(F.lit(kind), (i + 1).cast("string"), F.lit("="), F.regexp_replace(p, "[0-9]+", "#")))
    )
    labels = F.slice(F.reverse(filled(F.split(host(url), r"\."))), 1, HOST_LABELS)
    segments = F.slice(filled(F.split(path(url), "/")), 1, SEGMENTS)
    extension = F.regexp_extract(path(url), r"\.([A-Za-z]{1,8})\z", 1)
    asked = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    keys = F.slice(F.array_sort(F.array_distinct(filled(F.transform(asked, lambda k: F.substring_index(k, "=", 1))))), 1, KEYS)
    return F.array_distinct(F.concat(
        numbered(labels, "h"), numbered(segments, "p"),
        F.when(extension != "", F.array(F.concat(F.lit("x="), extension))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda k: cut(F.concat(F.lit("q="), k))),
        F.when(_rest(url).contains("#"), F.array(F.lit("f"))).otherwise(F.array().cast("array<string>")),
    ))


def by_host(rules: tuple[HostRule, ...], host: Column, path: Column) -> Column:
    """struct<name, verdict> of the longest rule that fits (ties: the longer host), NULL without one."""
    fits = [
        (r, ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path))
        for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.verdict))
    ]
    return F.coalesce(F.lit(None), *[F.when(c, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))) for r, c in fits])


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(tokens, label, confidence, support, rarest) from `labelled(url, label)`; `support` counts URLs with tokens and label.

    Rules are at least as confident as `mining` says and more than the label is among all URLs; of two rules for
    a label, one with all tokens of the other goes unless it is more confident. A URL counts once per label; NULL labels and URLs without
    tokens don't count. No labelled URLs: no rules.
    """
    urls = labelled.filter("label IS NOT NULL").select("url", "label").distinct()
    urls = urls.select(F.xxhash64("url").alias("hash"), tokens(F.col("url")).alias("tokens"), "label").filter(F.size("tokens") > 0)
    urls = materialize(urls)
    n_urls = urls.count()
    step = max(1, -(-n_urls // mining.sample))
    sample = urls.filter(F.pmod("hash", F.lit(step)) == 0)
    mark = "label="
    transactions = materialize(sample.select(F.concat("tokens", F.array(F.concat(F.lit(mark), "label"))).alias("items")))
    total = transactions.count()
    if not total:
        return sample.select(
            "tokens", "label", F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("support"), F.lit("").alias("rarest")
        )
    found = FPGrowth(itemsCol="items", minSupport=mining.support).fit(transactions).freqItemsets
    found = found.filter(F.size("items") <= mining.tokens + 1).select(
        F.array_sort(F.filter("items", lambda t: ~t.startswith(mark))).alias("tokens"),
        F.array_max(F.filter("items", lambda t: t.startswith(mark))).alias("label"), "freq",
    )
    found = materialize(found)
    plain = found.filter("label IS NULL").select("tokens", F.col("freq").alias("of"))
    label_counts = found.filter("label IS NOT NULL AND size(tokens) = 0").select("label", F.col("freq").alias("labelled"))
    rules = (
        found.filter("label IS NOT NULL").join(plain, "tokens").join(label_counts, "label")
        .withColumn("confidence", F.col("freq") / F.col("of"))
        .filter((F.col("confidence") >= mining.confidence) & (F.col("confidence") > F.col("labelled") / F.lit(total)))
    )
    # the token sets within a rule, by the bits of a number; their rarest token finds the rule
    parts = F.expr("filter(transform(sequence(1, shiftleft(1, size(tokens)) - 1), m -> filter(tokens, (t, i) -> shiftright(m, i) % 2 = 1)), s -> size(s) < size(tokens))")
    stronger = rules.select(F.col("tokens").alias("part"), "label", F.col("confidence").alias("enough"))
    implied = rules.select("tokens", "label", "confidence", F.explode(parts).alias("part")).join(stronger, ["part", "label"])
    implied = implied.filter("enough >= confidence").select("tokens", "label").distinct()
    single = plain.filter("size(tokens) = 1").select(F.col("tokens")[0].alias("rarest"), F.col("of").alias("uses"))
    kept = rules.join(implied, ["tokens", "label"], "left_anti").withColumn("rarest", F.explode("tokens")).join(single, "rarest")
    return materialize(
        kept.groupBy("tokens", F.regexp_replace("label", "^" + mark, "").alias("label"), "confidence", F.col("freq").alias("support"))
        .agg(F.min(F.struct("uses", "rarest")).alias("least")).select("tokens", "label", "confidence", "support", "least.rarest")
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The frame with `mined_verdict`, `mined_rule` (its tokens, by spaces) and `confidence`, NULL where no rule fits.

    Of the rules whose tokens a URL has, the most confident one decides, then the one with more support, fewer tokens, the first.
    `rules`: what `mine` returns. The tokens of its rules, of which there are as many as a URL has tokens over the share they must
    have at most, are the only ones of a URL that are kept; equal sets are looked up once, so that a hot kind of URL is one row.
    Columns of the frame with the names of the new ones are replaced; names that start with `_ur_` are taken.
    """
    known = [r[0] for r in rules.select(F.explode("tokens")).distinct().collect()]
    kept = [c for c in pages.columns if c not in ("mined_verdict", "mined_rule", "confidence")]
    shape = F.array_sort(F.filter(tokens(F.col(f"`{url}`")), lambda t: t.isin(known))) if known else F.array().cast("array<string>")
    shaped = pages.select(*[F.col(f"`{c}`") for c in kept], shape.alias("_ur_shape"))
    shapes = shaped.filter(F.size("_ur_shape") > 0).select("_ur_shape").distinct()
    index = rules.select("rarest", F.col("tokens").alias("needed"), "label", "confidence", "support")
    met = shapes.withColumn("rarest", F.explode("_ur_shape")).join(index, "rarest").filter(F.size(F.array_except("needed", "_ur_shape")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("needed").alias("n"), "needed", "label"))
    decided = materialize(met.groupBy("_ur_shape").agg(best.alias("_ur_best"))).select(F.col("_ur_shape").alias("_ur_of"), "_ur_best")
    return shaped.join(decided, F.col("_ur_shape") == F.col("_ur_of"), "left").select(
        *[F.col(f"`{c}`") for c in kept],
        F.col("_ur_best.label").alias("mined_verdict"),
        F.array_join("_ur_best.needed", " ").alias("mined_rule"),
        (-F.col("_ur_best.c")).alias("confidence"),
    )


def filter_urls(pages: DataFrame, host_rules: tuple[HostRule, ...], mining: Mining = Mining(), default: str = "allow", url: str = "url") -> DataFrame:
    """The frame with `host`, `path`, `rule`, `verdict`, `mined_rule` and `confidence`.

    The longest host rule that fits decides; what it says of the URLs it fits are the labels to mine from. Other URLs get the verdict of
    the best mined rule (`judge`), else `default`. NULL, empty and malformed URLs have empty host and path. Repeated rows stay;
    columns of the frame with the names of the new ones are replaced.
    """
    new = ("host", "path", "rule", "verdict", "mined_rule", "mined_verdict", "confidence")
    if url in new:
        raise ValueError(f"the URL's column can't be named {url}")
    kept = [c for c in pages.columns if c not in new]
    address = F.col(f"`{url}`").cast("string")
    parted = pages.select(*[F.col(f"`{c}`") for c in kept], host(address).alias("host"), path(address).alias("path"))
    ruled = parted.withColumn("_ur_rule", by_host(host_rules, F.col("host"), F.col("path")))
    labelled = ruled.filter("_ur_rule IS NOT NULL").select(address.alias("url"), F.col("_ur_rule.verdict").alias("label"))
    judged = judge(ruled.withColumn("_ur_url", address), mine(labelled, mining), "_ur_url")
    open_ = F.col("_ur_rule").isNull()
    return judged.select(
        *[F.col(f"`{c}`") for c in kept], "host", "path", F.col("_ur_rule.name").alias("rule"),
        F.coalesce("_ur_rule.verdict", "mined_verdict", F.lit(default)).alias("verdict"),
        F.when(open_, F.col("mined_rule")).alias("mined_rule"), F.when(open_, F.col("confidence")).alias("confidence"),
    )
