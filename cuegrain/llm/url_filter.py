"""Operator 3: URL filters: host and path rules, and logistic regression on hashed character n-grams.

The classifier is trained from a small labelled URL table. The one here is made by a rule from
words of kinds of unwanted and of ordinary sites, and has sites written out one by one besides
(url_table); callers may pass a table of (url, label) of their own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrain.llm.url_table import ORDINARY_SITES, UNWANTED_SITES

#: Rules of the registered query: host, path, verdict. A rule is written as host + path.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

# Words of unwanted and of ordinary sites, by kind; the labelled urls are made of them, apart from any table.
UNWANTED_WORDS = (
    "casino poker slots jackpot roulette betting bets odds gambling bingo lottery wager",
    "pills pharmacy meds tablets drugs prescription generic viagra slimming diet",
    "adult xxx sex nude cams webcams dating singles escort naughty hot",
    "loans cash payday credit forex crypto profit rich earn income invest",
    "spam backlinks links seo traffic farm bulk spinner directory",
    "ads adserver banner click clicks tracker tracking track popunder pixel affiliate",
    "replica fake cheap outlet keygen crack warez torrent serial cracked",
    "prize winner win free claim giveaway survey verify miracle bonus offer",
)
ORDINARY_WORDS = (
    "news herald times post journal review daily press weather editorial",
    "university college school institute library museum archive research science physics",
    "parliament council court city town government hospital health public records",
    "docs code developer project linux reference guide forum tools data",
    "garden kitchen recipes bread cooking hiking travel hotel mountain railway",
    "music film theatre orchestra books novels art history culture festival",
    "football tennis chess running cycling league club sports swimming rowing",
    "shop furniture shoes bicycle market farm bakery repairs design studio",
)
NEUTRAL_PATHS = ("/", "/en/{}", "/page/{}", "/de/{}.html", "/fr/{}?page=2", "/es/{}", "/2024/05/{}", "/index.html")
DOMAINS = ("com", "org", "net", "info")
#: Syllables of invented names, which most ordinary sites have.
SYLLABLES = "ba lor mi run ne tas ko vir da fel su gan pe hol zi mar".split()


def labelled_urls() -> tuple[tuple[str, int], ...]:
    """(url, label), 1 for unwanted: each word alone, before and after the next ones of its kind in a host, and in a path; invented names; and the sites of url_table."""
    out = []
    for label, kinds in ((1, UNWANTED_WORDS), (0, ORDINARY_WORDS)):
        began = len(out)  # both labels go through the same numbers, paths and domains
        for kind in kinds:
            words = kind.split()
            for i, w in enumerate(words):
                near, far = words[(i + 1) % len(words)], words[(i + 3) % len(words)]
                for j, host in enumerate((w, f"{w}-{near}", f"{near}{w}", f"www.{far}-{w}", "")):
                    n = len(out) - began
                    path = NEUTRAL_PATHS[n % len(NEUTRAL_PATHS)].format(n)
                    host = host or ("abcdefgh"[n % 8] * 2 + "site")
                    out.append((f"http{'s' * (n % 2)}://{host}.{DOMAINS[(n + j) % len(DOMAINS)]}{f'/{w}/{far}' if j == 4 else path}", label))
    names = [f"{a}{b}{c}" for i, a in enumerate(SYLLABLES) for j, b in enumerate(SYLLABLES) for c in (SYLLABLES[(3 * i + j) % len(SYLLABLES)],)]
    for n, name in enumerate(names):
        host = ("", "www.", "m.", "blog.")[n // 4 % 4] + name
        out.append((f"http{'s' * (n % 2)}://{host}.{DOMAINS[n % len(DOMAINS)]}{NEUTRAL_PATHS[n // 2 % len(NEUTRAL_PATHS)].format(n)}", 0))
    for label, sites in ((1, UNWANTED_SITES), (0, ORDINARY_SITES)):
        for n, site in enumerate(sites.split()):
            host, _, path = site.partition("/")
            out.append((f"http{'s' * (n % 2)}://{'' if n % 3 else 'www.'}{host}/{path}", label))
    return tuple(out)


#: Log odds of a url without evidence: fixed, so that hosts of unknown words are allowed. Chosen by four-fold cross-validation over the sites of url_table.
NO_EVIDENCE = -0.5

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
EPOCHS, RATE, RIDGE = 800, 4.0, 1e-4


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ?, # or the end, with A-Z lower-cased; empty without :// or for null."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null if none: its host or a subdomain, and the start of the path.

    The rules are a small list of the caller's and become one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for its_host, its_path, its_verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest is asked first
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(its_path)
        rule = F.when(fits, F.lit(its_host + its_path)).otherwise(rule)
        verdict = F.when(fits, F.lit(its_verdict)).otherwise(verdict)
    return rule, verdict


def ngrams(part: str, kind: str) -> list[int]:
    """Buckets of the character n-grams of a host or path; kind keeps the two apart."""
    text = f"^{part.lower()}$"
    return [zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in SIZES for i in range(len(text) - n + 1)]


@dataclass
class UrlModel:
    weights: np.ndarray
    bias: float

    def part(self, text: str, kind: str) -> tuple[float, int]:
        found = ngrams(text, kind)
        return float(self.weights[found].sum()) if found else 0.0, len(found)

    def probability(self, host: tuple[float, int], path: tuple[float, int]) -> float:
        n = host[1] + path[1]
        z = self.bias + (host[0] + path[0]) / np.sqrt(n) if n else self.bias
        return float(1 / (1 + np.exp(-z)))


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as in host_of and path_of."""
    head, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    stop = min((i for i in (rest.find(c, end) for c in "?#") if i >= 0), default=len(rest))
    host = rest[:end]
    return host.translate({c: c + 32 for c in range(65, 91)}), rest[end:stop]


#: Rows of a labelled table that the model is fitted on at most, in the order of a hash of the url.
MOST_LABELLED = 20_000


def labelled_rows(table: DataFrame, url_col: str = "url", label_col: str = "label", most: int = MOST_LABELLED) -> tuple[tuple[str, int], ...]:
    """Distinct (url, label) rows of a small labelled table, at most `most`; null urls, and labels other than 0 and 1, are not used."""
    rows = table.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("label")).where("url IS NOT NULL AND label IN (0, 1)").distinct()
    return tuple((r.url, r.label) for r in rows.orderBy(F.xxhash64("url"), "url", "label").limit(most).collect())


def train(labelled: tuple[tuple[str, int], ...] | None = None) -> UrlModel:
    """Ridge-regularised logistic regression by gradient descent on n-gram counts over the root of their sum."""
    labelled = labelled_urls() if labelled is None else labelled
    rows, cols = [], []
    for k, (url, _) in enumerate(labelled):
        host, path = split_url(url)
        found = ngrams(host, "h") + ngrams(path, "p")
        rows += [k] * len(found)
        cols += found
    rows, cols = np.array(rows, np.int64), np.array(cols, np.int64)
    share = (1 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(labelled)))))[rows]
    y = np.array([label for _, label in labelled], np.float64)
    weights = np.zeros(BUCKETS)
    for _ in range(EPOCHS if len(y) else 0):
        z = NO_EVIDENCE + np.bincount(rows, weights[cols] * share, len(y))
        error = 1 / (1 + np.exp(-z)) - y
        weights -= RATE * (np.bincount(cols, error[rows] * share, BUCKETS) / len(y) + RIDGE * weights)
    return UrlModel(weights, NO_EVIDENCE)


@cache
def default_model() -> UrlModel:
    """The model of the table here, trained once a process."""
    return train()


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str, str], ...] = RULES, model: UrlModel | None = None, labelled: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, score) per row.

    verdict is the longest fitting rule's; without one, block if the classifier's score is 0.5 or more,
    else allow. A null or malformed url has an empty host and path, fits no rule and is scored as such.
    Very long urls are judged whole. Repeated rows are judged alike; columns other than the two are not
    read. An empty table gives an empty result. labelled (url, label) trains the classifier in the place
    of the table here; model is a trained one.
    """
    model = model or (default_model() if labelled is None else train(labelled_rows(labelled)))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    @F.pandas_udf("double")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        its, hosts = shared.value, {}
        for host, path in batches:
            out = []
            for h, p in zip(host, path, strict=True):
                if h not in hosts:
                    if len(hosts) > 100_000:
                        hosts.clear()
                    hosts[h] = its.part(h, "h")
                out.append(its.probability(hosts[h], its.part(p, "p")))
            yield pd.Series(out, dtype="float64")

    judged = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "ruled": verdict, "score": scores("host", "path")})
    return judged.select("id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
