"""URL filters: longest-match block/allow rules, else a logistic regression on hashed character n-grams.

Scoring is built from SQL functions only. The model is fitted on a small labelled URL table whose size
is bounded by ``max_labelled``; its n-grams are hashed by the same Spark expressions that score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the production query: (host, path prefix, verdict).
DEFAULT_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)

#: Words of hosts by subject, from which labelled_urls() builds its table. The blocked ones name trades that
#: filters usually block; the allowed ones are subjects of public sites and names of cities. None is taken from a table.
BLOCKED_WORDS = (
    "casino", "poker", "betting", "slots", "jackpot", "roulette", "lottery", "online-casino", "sports-bets", "bonus-spins",
    "pills", "pharmacy", "viagra", "cialis", "steroids", "no-prescription", "weight-loss", "miracle-diet", "discount-meds", "online-pills",
    "adult", "porn", "xxx", "sexcams", "escort", "camgirls", "hot-dates", "adult-video", "nude-chat", "milf",
    "ads", "adserver", "ad-click", "tracker", "clicktrack", "popunder", "banner-ads", "tracking-pixel", "ads-network", "affiliate-clicks",
    "spam", "linkfarm", "seo-links", "bulk-mail", "spam-links", "phishing", "malware", "free-ringtones", "win-prize", "get-rich",
    "warez", "cracks", "keygen", "torrents", "serials", "payday", "quick-loan", "replica", "cheap-watches", "free-money",
)
ALLOWED_WORDS = (
    "news", "journal", "library", "museum", "archive", "school", "university", "college", "science", "physics",
    "weather", "climate", "garden", "recipes", "kitchen", "travel", "history", "gazette", "herald", "tribune",
    "theatre", "health", "hospital", "council", "parliament", "county", "railway", "transport", "engineering", "software",
    "docs", "manual", "handbook", "wiki", "forum", "questions", "answers", "music", "painting", "literature",
    "london", "paris", "berlin", "madrid", "rome", "vienna", "athens", "lisbon", "dublin", "stockholm",
    "helsinki", "warsaw", "prague", "budapest", "hamburg", "birmingham", "edinburgh", "perth", "toronto", "sydney",
)
HOST_FORMS = ("{}.example.com", "www.{}.example.net", "blog.{}.example.org", "m.{}.example.com", "{}.org", "www.{}.info")
PATHS = ("/en/12", "/de/345/", "/fr/7.html", "/es/81?page=2", "/index.html", "/")


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table: (url, 1 to block), from the two word lists and the host forms."""
    return [
        (f"https://{HOST_FORMS[(i + k) % len(HOST_FORMS)].format(word)}{PATHS[(i + 2 * k) % len(PATHS)]}", label)
        for label, words in ((1, BLOCKED_WORDS), (0, ALLOWED_WORDS))
        for i, word in enumerate(words)
        for k in range(3)
    ]


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host + path, its verdict) of the longest rule that fits; null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, kind in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(rule_path))
        rule = F.when(fits, F.lit(rule_host + rule_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _gram_buckets(mark: str, sizes: Sequence[int], buckets: int) -> Callable[[Column], Column]:
    """From a part's characters to the buckets of its n-grams; each n-gram is a slice of an array that is made once."""

    def of_size(chars: Column, n: int) -> Column:
        def bucket(_: Column, i: Column) -> Column:
            gram = F.concat(F.lit(f"{mark}{n}:"), F.concat_ws("", F.slice(chars, i + 1, n)))
            return (F.pmod(F.xxhash64(gram), F.lit(buckets)) + 1).cast("int")

        return F.transform(chars, bucket)

    return lambda chars: F.concat(*(of_size(chars, n) for n in sizes))


def ngram_buckets(host: Column, path: Column, sizes: Sequence[int], buckets: int) -> Column:
    """Array of bucket numbers (from 1) of the character n-grams of host and path, in time linear in their lengths."""
    parts = []
    for mark, part in (("h", host), ("p", path)):
        chars = F.split(F.concat(F.lit("^"), part, F.lit("$")), "")
        # as a lambda's variable the characters are split once, not once for each n-gram
        parts.append(F.flatten(F.transform(F.array(chars), _gram_buckets(mark, sizes, buckets))))
    return F.concat(*parts)


@dataclass(frozen=True)
class UrlModel:
    """Weights by bucket, a bias, and the shape of the n-grams they were fitted on."""

    weights: tuple[float, ...]
    bias: float
    sizes: tuple[int, ...]

    def score(self, host: Column, path: Column) -> Column:
        """Log-odds that the URL is to be blocked."""
        grams = ngram_buckets(host, path, self.sizes, len(self.weights))
        table = F.lit(list(self.weights))
        # the weight array is one constant object; every n-gram costs one lookup
        total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.element_at(table, g))
        return F.lit(self.bias) + total / F.sqrt(F.size(grams).cast("double"))


def fit(
    labelled: DataFrame,
    url: str = "url",
    label: str = "label",
    sizes: Sequence[int] = (3, 4, 5),
    buckets: int = 4096,
    max_labelled: int = 20_000,
    epochs: int = 40,
    rate: float = 0.5,
    l2: float = 1e-4,
) -> UrlModel:
    """Fit the regression by gradient descent over the labelled table, of at most max_labelled rows.

    A larger table is refused, never cut. Rows with a null label are left out; null URLs count as empty.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    rows = (
        labelled.where(F.col(label).isNotNull())
        .select(F.col(label).cast("int").alias("y"), ngram_buckets(url_host(u), url_path(u), sizes, buckets).alias("g"), u.alias("u"))
        .limit(max_labelled + 1)
        .collect()
    )
    if len(rows) > max_labelled:
        raise ValueError(f"the labelled URL table has more than {max_labelled} rows")
    rows = sorted(((r.y, r.g) for r in rows), key=lambda r: (r[1], r[0]))
    weights, bias = [0.0] * buckets, 0.0
    for epoch in range(epochs):
        step = rate / (1 + 0.05 * epoch)
        for y, grams in rows:
            norm = math.sqrt(len(grams))
            z = bias + sum(weights[g - 1] for g in grams) / norm
            slope = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            bias -= step * slope * 0.1
            for g in grams:
                weights[g - 1] -= step * (slope / norm + l2 * weights[g - 1])
    return UrlModel(tuple(weights), bias, tuple(sizes))


def default_model(spark: SparkSession) -> UrlModel:
    """The model fitted on labelled_urls()."""
    rows = labelled_urls()
    by_label = [
        spark.range(1).select(F.explode(F.lit([u for u, y in rows if y == label])).alias("url"), F.lit(label).alias("label"))
        for label in (0, 1)
    ]
    return fit(by_label[0].unionAll(by_label[1]))


def judge_urls(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES, url: str = "url", threshold: float = 1.0) -> DataFrame:
    """pages with url_host, url_path, url_rule, url_verdict and url_score; columns that clash are replaced.

    Null or unparsable URLs have empty host and path and are judged by the model on those. Repeated rows
    and ties give equal results; an empty table gives an empty table. The longest fitting rule wins. The
    model blocks above threshold, odds of e to 1 by default, as a page blocked wrongly costs more.
    """
    host, path = url_host(F.col(url)), url_path(F.col(url))
    parsed = pages.withColumn("url_host", host).withColumn("url_path", path)
    rule, verdict = rule_of(F.col("url_host"), F.col("url_path"), rules)
    scored = parsed.withColumn("url_score", model.score(F.col("url_host"), F.col("url_path")))
    by_model = F.when(F.col("url_score") > threshold, "block").otherwise("allow")
    return scored.withColumn("url_rule", rule).withColumn("url_verdict", F.coalesce(verdict, by_model))
