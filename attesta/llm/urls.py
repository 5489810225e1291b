"""URL filter: explicit host and path rules, else a logistic regression.

The regression runs on hashed character n-grams of host and path. It is fitted
on the small labelled table below (its rows alone reach the driver) and applied
with DataFrame functions only.

Defined cases: a null url, or one without ``://``, has empty host and path and
is judged by the method like any other; repeated pages are judged each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): fits the host, its subdomains and paths that start so.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: The labelled table: names of hosts to block (betting, adult, pharmacy, link and mail spam, tracking, piracy, scams) and to allow.
BLOCKED = (
    "casino-club", "grand-casino", "casinoroyal", "online-slots", "slotmachine", "poker-room", "best-bets", "sportbets", "free-spins", "win-prize", "win-cash", "jackpot-win", "lottery-win",
    "adult-dates", "adultchat", "adult-video", "xxx-movies", "xxxcams", "hot-cams", "pornhub-free", "sex-dates", "escort-adult", "nude-pics",
    "diet-pills", "pillshop", "cheap-meds", "cheap-viagra", "viagra-shop", "buy-pills", "cheap-replica", "discount-pharma", "weight-loss-pills",
    "spam-mail", "spammers", "spam-links", "link-farm", "contentfarm", "seo-farm", "linkfarms", "clickfarm", "bulk-spam",
    "ads-server", "adserver", "banner-ads", "click-track", "trackpixel", "tracker-net", "ad-track", "popup-ads", "adclick",
    "free-warez", "warez-crack", "keygen-free", "crack-download", "free-movies-download", "torrentz-free",
    "free-money", "cheap-loans", "payday-loans", "free-gift-cards", "get-rich-fast", "crypto-double", "free-iphone",
)
ALLOWED = (
    "university", "open-library", "national-museum", "city-council", "parliament", "statistics", "weather", "meteo", "health-service", "hospital", "clinic", "pharmacology", "medicine-journal",
    "daily-news", "morning-herald", "tribune", "gazette", "the-times", "radio", "television", "science-review", "astronomy", "physics", "chemistry", "biology", "geology", "mathematics", "nature-walks",
    "gardening", "cooking", "recipes", "kitchen-table", "bakery", "farmhouse", "farmers-market", "vineyard", "travel-notes", "railways", "airport", "harbour", "mountain-huts", "cycling", "running-club", "football", "chess-club",
    "orchestra", "theatre", "cinema-club", "literature", "poetry", "history-society", "archives", "genealogy", "philosophy", "theology", "architecture", "engineering", "robotics", "software-docs", "python-guide", "linux-help",
    "winter-sports", "windmill", "twins-club", "tracks-and-trails", "adolescent-health", "pillar-press", "betania-school", "free-university", "freedom-archive", "spice-garden", "addresses",
    "school", "teachers", "students", "kindergarten", "parents", "community", "village", "town-hall", "neighbours", "charity", "foundation", "insurance", "bank-museum", "law-review", "justice", "police-records",
    "therapy", "thermal-baths", "theorems", "threads", "thirteen", "thinking", "thunder", "ration", "nation", "station", "motion", "action-theatre", "emotion", "vision", "region", "religion", "mention", "fashion", "ocean", "orange", "stone", "atlas", "elder", "letters", "senses",
)


def _labelled() -> tuple[tuple[str, int], ...]:
    """(url, label): each name under forms of prefix, ending and path that say nothing about the label."""
    rows = []
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for i, name in enumerate(names):
            prefix, end = ("", "www.", "m.", "blog.")[i % 4], ("com", "net", "org", "info", "test")[i % 5]
            path = ("/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/{}?page=2", "/en/news/{}")[i % 6].format(37 * i + 5)
            rows.append((f"http{'s' * (i % 2)}://{prefix}{name}.{end}{path}", label))
    return tuple(rows)


LABELLED = _labelled()

BUCKETS = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SHAPE = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _SHAPE, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _SHAPE, 2)


def features(host: Column, path: Column) -> Column:
    """Buckets of the 3- and 4-grams of host and path, one entry per occurrence."""

    def grams(name: str, text: Column) -> list[Column]:
        framed = F.concat(F.lit("^"), text, F.lit("$"))
        return [F.transform(F.regexp_extract_all(framed, F.lit(rf"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.pmod(F.xxhash64(F.lit(name), g), F.lit(BUCKETS)).cast("int")) for n in (3, 4)]

    return F.concat(*grams("host", host), *grams("path", path))


def fit(spark: SparkSession, labelled: tuple = LABELLED, rounds: int = 400, rate: float = 4.0, decay: float = 1e-4) -> tuple[list[float], float]:
    """(weights, bias) by gradient descent on the labelled rows."""
    values = ", ".join(f"('{url}', {label})" for url, label in labelled)
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(url, label)")
    rows = rows.select("label", features(host_of(F.col("url")), path_of(F.col("url"))).alias("ids")).collect()
    weights, bias = [0.0] * BUCKETS, 0.0
    share = {x: 2 * sum(r["label"] == x for r in rows) for x in (0, 1)}  # both labels weigh the same
    for _ in range(rounds):
        step, shift = {}, 0.0
        for r in rows:
            scale = 1 / math.sqrt(max(1, len(r["ids"])))
            error = (1 / (1 + math.exp(-bias - scale * sum(weights[i] for i in r["ids"]))) - r["label"]) / share[r["label"]]
            shift += error
            for i in r["ids"]:
                step[i] = step.get(i, 0.0) + error * scale
        for i, g in step.items():
            weights[i] -= rate * (g + decay * weights[i])
        bias -= rate * shift
    return weights, bias


def logit(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    table = F.split(F.lit(",".join(repr(w) for w in weights)), ",").cast("array<double>")
    ids = features(host, path)
    total = F.aggregate(ids, F.lit(0.0), lambda acc, i: acc + F.get(table, i))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(ids), F.lit(1)))


def judge(pages: DataFrame, rules: tuple = RULES, id_col: str = "page_id", url_col: str = "url", model: tuple[list[float], float] | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): the longest fitting rule, else the model."""
    weights, bias = model or fit(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    score = 1 / (1 + F.exp(-logit(F.col("host"), F.col("path"), weights, bias)))
    rows = rows.withColumns({"rule": rule, "said": verdict, "score": score})
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
