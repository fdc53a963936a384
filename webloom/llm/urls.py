"""URL filtering: host and path rules, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm.common import columns_without, map_values

#: Hash buckets of the n-gram features and the n-gram lengths.
BUCKETS, GRAMS = 1 << 14, (3, 4, 5)

#: The default rules as (action, host, path). A rule fits its host and all subdomains.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The small labelled table the model is trained from. Host words of unwanted sites ...
UNWANTED = ("adult-x", "adult-video", "xxx-tube", "porn-hub", "sex-cams", "nude-pics", "spam-farm", "link-farm", "seo-farm",
            "cheap-pills", "buy-pills", "pills-online", "viagra-shop", "casino-win", "online-casino", "win-casino", "slots-win",
            "free-bets", "bets-online", "poker-bets", "ads-track", "ad-tracker", "click-ads", "popup-ads", "track-pixel",
            "warez-crack", "free-cracks", "keygen-dl", "malware-dl", "phish-login", "replica-watches", "payday-loans")
#: ... and of wanted ones.
WANTED = ("news", "daily-news", "library", "university", "school", "museum", "science", "history", "nature", "research", "weather",
          "gardens", "recipes", "cooking", "travel", "music", "health-info", "city-council", "parliament", "archive", "journal",
          "open-source", "developer", "docs", "wiki", "encyclopedia", "astronomy", "mathematics", "poetry", "theatre", "the-other",
          "station", "thermal", "winter", "farmers", "tracking-birds")


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 for unwanted) : every word with the subdomains, endings and paths that say nothing about a site."""
    prefixes, tops = ("", "www.", "m.", "blog."), ("com", "net", "org")
    paths = ("/", "/en/12", "/de/345/", "/fr/6.html", "/es/78?page=2", "/index.html", "/a/b/c")
    rows = []
    for words, label in ((UNWANTED, 1), (WANTED, 0)):
        for i, w in enumerate(words):
            for j, p in enumerate(prefixes):
                rows.append((f"https://{p}{w}.example.{tops[(i + j) % 3]}{paths[(i + 2 * j) % len(paths)]}", label))
    return rows


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits, else null."""
    name = action = F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first: it is outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def features(host: str, path: str) -> np.ndarray:
    """Sorted distinct buckets of the character n-grams of host and path, each with its own boundary marks."""
    found = set()
    for mark, part in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for i in range(len(part) - n + 1):
                found.add(zlib.crc32(f"{mark}{part[i:i + n]}".encode()) % BUCKETS)
    return np.array(sorted(found), np.int64)


def split_plain(url: str | None) -> tuple[str, str]:
    """:func:`split_url` for one string."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    stops = [i for i in map(rest.find, "/?#") if i >= 0]
    host = rest[:min(stops, default=len(rest))]
    tail = rest[len(host):]
    ends = [i for i in map(tail.find, "?#") if i >= 0]
    return host.translate({c: c + 32 for c in range(65, 91)}), tail[:min(ends, default=len(tail))]


def train(rows: list[tuple[str, int]], epochs: int = 300, rate: float = 1.0, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch gradient descent from zero: the same table gives the same model."""
    x = np.zeros((len(rows), BUCKETS))
    for i, (url, _) in enumerate(rows):
        f = features(*split_plain(url))
        x[i, f] = 1 / max(np.sqrt(len(f)), 1)
    used = np.flatnonzero(x.any(axis=0))
    x, y = x[:, used], np.array([label for _, label in rows], float)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= rate * len(used) ** 0.5 * (x.T @ (p - y) / len(rows) + l2 * w)
        b -= rate * float(np.mean(p - y))
    full = np.zeros(BUCKETS)
    full[used] = w
    return full, b


def judge(df: DataFrame, url: str = "url", rules=RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.7,
          keep: list[str] | None = None) -> DataFrame:
    """Adds ``host, path, rule, verdict, p_block`` to every row of ``df``.

    The verdict is the longest fitting rule's action, else ``block`` where the model's probability of an unwanted site
    is at least ``threshold`` (over a half, since most sites are wanted ones). The model (128 kB, a fixed size) travels
    with the task. A null url, or one without ``://``, has an empty host and path, no features and probability 0;
    repeated urls are judged alike; columns of ``df`` with an added name are replaced."""
    weights, bias = train(labelled_urls() if labelled is None else labelled)
    added = ("host", "path", "rule", "verdict", "p_block")
    host, path = split_url(F.col(f"`{url}`"))
    kept = columns_without(df if keep is None else df.select(*[f"`{c}`" for c in keep]), added)
    parts = df.select(*[f"`{c}`" for c in kept], F.struct(host.alias("host"), path.alias("path")).alias("__parts"))
    out = T.StructType([T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("p_block", T.DoubleType())])

    def start():
        def one(part):
            f = features(part["host"], part["path"])
            return 0.0 if not len(f) else float(1 / (1 + np.exp(-(weights[f].sum() / max(np.sqrt(len(f)), 1) + bias))))
        return lambda rows: [[r["host"] for r in rows], [r["path"] for r in rows], [one(r) for r in rows]]
    scored = map_values(parts, F.col("__parts"), out, start, kept)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return scored.select(*[f"`{c}`" for c in kept], "host", "path", rule.alias("rule"),
                         F.coalesce(action, F.when(F.col("p_block") >= threshold, "block").otherwise("allow")).alias("verdict"), "p_block")
