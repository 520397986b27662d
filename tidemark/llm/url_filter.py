"""URL filter: list rules first, then logistic regression on hashed character n-grams of host and path.

Rules ``(host, path, verdict)`` fit their host and all its subdomains when the
path starts with the rule's; the longest fitting rule decides.  A url's host
suffixes are looked up in a map of the rules, so the work for a url does not
grow with their number.  All other urls go to the model: 3- to 5-grams of host
and path (told apart, with marks at the ends) hashed into ``BUCKETS`` weights,
trained in numpy from a small labelled url table.  Only the rules and the
weights (``BUCKETS`` floats) go to the tasks; nothing is shuffled.

Cases: a NULL url or one without ``://`` has empty host and path, no n-grams,
and the verdict of the model's constant (allow); ports and user names belong
to the host as written; repeated rows and ties get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import count, cycle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import shipped

ALLOW, BLOCK = "allow", "block"
BUCKETS = 1 << 15
SIZES = (3, 4, 5)
EPOCHS, RATE, DECAY = 40, 0.5, 1e-5
#: Probability from which the model blocks.
THRESHOLD = 0.6

#: Fixed rules of the registered query.
RULES = [("org", "/", ALLOW), ("example.org", "/es/", BLOCK), ("example.org", "/en/1", BLOCK), ("com", "/fr/", ALLOW),
         ("com", "/de/", BLOCK)]

#: Words that name sites to block (gambling, adult, drugs and spam, advertising, piracy, fraud) and sites to keep.
BLOCK_WORDS = """
casino poker roulette jackpot slots betting bet bets sportsbook bingo lottery win-big big-win blackjack gamble
adult adults xxx porn sex escort nude camgirls hentai erotic milf hookup
pills cheap-meds viagra cialis pharmacy-rx no-prescription steroids weight-loss-miracle
spam spammer link-farm doorway seo-links backlinks clickbait content-farm
ads adserver ad-track tracker tracking banner-ads popunder click-track affiliate-click adclick doubleads
warez torrent keygen cracked serial-keys free-movies-hd nulled
prize-winner free-money get-rich payday-loan crypto-double phishing verify-account replica-watches
""".split()
ALLOW_WORDS = """
news journal herald times gazette weather maps library archive museum gallery university college school physics
chemistry biology history geography astronomy math garden recipes cooking travel guide hotel railway bicycle hiking
health clinic hospital council city county parliament ministry court law finance bank tax insurance energy climate
software compiler database kernel network linux python java docs manual wiki forum blog photo music film theatre radio
books poetry letters dictionary language grammar teacher student science research institute journal-of review report
open-data statistics census survey village river mountain island harbour airport bridge street house kitchen furniture
thunder other weathering thirty earth theory there thesis anthem mother father author method athens ether
""".split()
#: The most frequent English letter pairs; names made of them say nothing about a site.
PAIRS = """
th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur
""".split()
_PATHS = ["/", "", "/en/{}", "/de/{}.html", "/fr/{}/", "/es/{}", "/about", "/index.php", "/2024/{}/", "/a/b/{}", "/en/{}.html"]
_SPAM_PATHS = ["/win-now/{}", "/bonus/{}", "/click/{}", "/free-spins", "/buy-cheap/{}", "/track/{}.gif", "/xxx/{}"]
_HOSTS = ["www.{}.com", "{}.net", "{}.org", "blog.{}.com", "m.{}.info", "{}.example.com", "www.{}.example.net",
          "m.{}.example.org", "blog.{}.example.com", "{}.example.org"]


def labelled_urls(names: Callable[[str], bool] = lambda name: True) -> list[tuple[str, int]]:
    """The labelled table, 1 for urls to block: every name under hosts and paths of several forms.

    ``names`` chooses among the names, so that a part of them can be held out.

    Both labels go through the same hosts and paths, so that these carry no
    weight; the spam paths come with block words alone.
    """
    neutral = [a + b + PAIRS[(7 * i + j) % len(PAIRS)] * (j % 2) for i, a in enumerate(PAIRS)
               for j, b in enumerate(PAIRS) if (i + j) % 5 == 0]
    hosts, paths, spam, number = cycle(_HOSTS), cycle(_PATHS), cycle(_SPAM_PATHS), count(1)
    out = []
    for words, label, times in ((BLOCK_WORDS, 1, 12), (ALLOW_WORDS, 0, 6), (neutral, 0, 2)):
        for w in filter(names, words):
            for k in range(times):
                path = next(spam) if label and k % 4 == 3 else next(paths)
                out.append((f"https://{next(hosts).format(w)}{path.format(next(number) * 97 % 10007)}", label))
    return out


# ---------------------------------------------------------------- parts of a url

def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path as ``host_of`` and ``path_of`` give them."""
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    fold = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    return (m[1].translate(fold), m[2]) if m else ("", "")


# ---------------------------------------------------------------- rules

def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as the struct ``size, rule, verdict``; NULL where none does."""
    if not rules:
        return F.lit(None).cast("struct<size: int, rule: string, verdict: string>")
    by_host: dict[str, list[Column]] = {}
    for h, p, v in rules:
        entry = F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"), F.lit(p).alias("path"))
        by_host.setdefault(h, []).append(entry)
    table = F.create_map(*[x for h, e in by_host.items() for x in (F.lit(h), F.array(*e))])
    labels = F.split(host, r"\.", -1)
    # Every suffix of the host that begins at a label.
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: table[s]), lambda x: x.isNotNull()))
    best = F.array_max(F.filter(found, lambda r: path.startswith(r["path"])))
    return F.when(best.isNotNull(), F.struct(best["size"].alias("size"), best["rule"].alias("rule"), best["verdict"].alias("verdict")))


# ---------------------------------------------------------------- model

def grams(host: str, path: str) -> np.ndarray:
    """Hashed n-grams of both parts, repeats included."""
    out = []
    for salt, part in ((1, host), (2, path)):
        if not part:
            continue
        b = np.frombuffer(b"^" + part.encode() + b"$", np.uint8).astype(np.uint32)
        code = b
        for n in range(2, max(SIZES) + 1):
            code = code[:-1] * np.uint32(0x01000193) ^ b[n - 1:]
            if n in SIZES:
                own = code * np.uint32(0x9E3779B1) + np.uint32(salt * 0x85EBCA6B + n & 0xFFFFFFFF)
                out.append((own ^ own >> np.uint32(15)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - (BUCKETS.bit_length() - 1)))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    weights: np.ndarray
    constant: float

    def block(self, host: str, path: str) -> float:
        g = grams(host, path)
        z = float(self.weights[g].sum() / np.sqrt(len(g)) if len(g) else 0) + self.constant
        return 1 / (1 + np.exp(-z))


def train(labelled: list[tuple[str, int]], seed: int = 0) -> Model:
    """Logistic regression by stochastic gradient descent; without urls everything is allowed."""
    rng = np.random.default_rng(seed)
    x = [grams(*split_url(u)) for u, _ in labelled]
    y = [label for _, label in labelled]
    w, c = np.zeros(BUCKETS), -1.0
    for epoch in range(EPOCHS):
        rate = RATE / (1 + epoch / 10)
        for i in rng.permutation(len(x)):
            g, scale = x[i], 1 / np.sqrt(max(1, len(x[i])))
            error = 1 / (1 + np.exp(-(w[g].sum() * scale + c))) - y[i]
            np.add.at(w, g, -rate * (error * scale + DECAY * w[g]))
            c -= 0.1 * rate * error
    return Model(w.astype(np.float32), float(min(c, 0.0)))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None,
          labelled: list[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per page ``page_id, host, path, rule, verdict, block_score``; ``rule`` is NULL where the model decides."""
    model = train(labelled_urls() if labelled is None else labelled)
    shared = shipped(pages).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([m.block(h, p) for h, p in zip(host, path)], dtype="float64")

    p = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    p = p.select("*", rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules).alias("r"),
                 score("host", "path").alias("block_score"))
    by_model = F.when(F.col("block_score") >= THRESHOLD, BLOCK).otherwise(ALLOW)
    return p.select("page_id", "host", "path", F.col("r.rule").alias("rule"),
                    F.coalesce("r.verdict", by_model).alias("verdict"), "block_score")
