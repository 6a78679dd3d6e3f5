"""URL filter: domain rules first, then logistic regression on hashed character n-grams of host and path.

Defined cases: a null url or one without `://` has an empty host and path and is judged by the model; repeated rows
are judged each by itself; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 18
ORDERS = (3, 4, 5)
#: Share of blocked pages that the model expects: what has no n-gram of the table is allowed.
PRIOR = 0.25

# Words of the labelled URL table (fixed values): the usual kinds of sites on block lists, and everyday subjects. Words
# that go with either side say nothing by themselves.
BLOCKED = {
    "gambling": "casino poker jackpot betting roulette lottery bets bet slots blackjack".split(),
    "pharmacy": "pills viagra meds pharmacy cialis tablets drugstore rx".split(),
    "adult": "adult porn xxx sex cams escort nude".split(),
    "loans": "payday loans loan cashadvance quickcash debt".split(),
    "advertising": "ads adserver tracker track popups banner clicks adclick affiliate".split(),
    "link spam": "spam spammer linkfarm farm backlinks doorway traffic".split(),
    "piracy": "warez cracked keygen torrents serials".split(),
}
ALLOWED = (
    "news library weather university recipes history museum gardening science school music travel health kitchen forest river letters maths "
    "theatre village nature photo family cooking church language books journal energy water bicycle railway bridge cinema poetry painting "
    "parliament hospital harbour island mountain astronomy geology chess football orchestra festival market bakery craft knitting pottery"
).split()
NEUTRAL = "online best free cheap win my top the daily super".split()
_HOSTS, _TOPS, _PATHS = ("", "www.", "blog.", "m."), ("com", "org", "net"), ("/en/12", "/de/7.html", "/fr/901/", "/es/4410", "/", "/articles/3?page=2", "/item")


def labelled_urls(blocked: dict[str, list[str]] = BLOCKED, allowed: list[str] = ALLOWED) -> list[tuple[str, int]]:
    """The labelled table by rule, 1 is block: each word alone, with two neutral words before and after it, and in the
    path of a site named by a neutral word."""
    out = []
    for label, words in ((1, [w for ws in blocked.values() for w in ws]), (0, allowed)):
        for i, w in enumerate(words):
            before, after = NEUTRAL[i % len(NEUTRAL)], NEUTRAL[(3 * i + 1) % len(NEUTRAL)]
            for j, name in enumerate((w, f"{before}-{w}", f"{w}-{after}", f"{after}{w}")):
                k = i + j
                out.append((f"http://{_HOSTS[k % 4]}{name}.example.{_TOPS[k % 3]}{_PATHS[(i + 2 * j) % 7]}", label))
            out.append((f"https://{before}.example.{_TOPS[i % 3]}/{w}/{after}", label))
    return out


#: (host, path) to verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(url, pattern, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host itself or a subdomain of the rule's, path starting with the rule's) and its
    verdict; null if none."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str, bits: int = BITS) -> list[int]:
    """Hashed n-grams of `<host>` and `<path>`, digits folded to 0, host and path in different hash spaces."""
    out = set()
    for tag, text in (("h", host), ("p", path)):
        text = "<" + re.sub(r"[0-9]+", "0", text) + ">"
        for n in ORDERS:
            for i in range(max(1, len(text) - n + 1)):
                out.add(zlib.crc32(f"{tag}{text[i : i + n]}".encode()) & ((1 << bits) - 1))
    return sorted(out)


def _split(url: str) -> tuple[str, str]:
    found = re.search(r"://([^/?#]*)([^?#]*)", url)
    return (found[1].lower(), found[2]) if found else ("", "")


def train(labelled: list[tuple[str, int]] | None = None, bits: int = BITS, rounds: int = 1500, rate: float = 40.0, l2: float = 1e-4, prior: float = PRIOR) -> np.ndarray:
    """Weights and, last, the bias: full-batch gradient descent on the labelled table, which is small by contract.
    Rows are normalised to unit length; blocked ones weigh `prior` of all."""
    labelled = labelled_urls() if labelled is None else labelled
    rows = [features(*_split(u), bits) for u, _ in labelled]
    y = np.array([v for _, v in labelled], dtype=float)
    weigh = np.where(y == 1, prior / max(1, y.sum()), (1 - prior) / max(1, (1 - y).sum()))
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    columns, c = np.unique(np.concatenate(rows), return_inverse=True)
    v = np.repeat([1 / np.sqrt(len(x)) for x in rows], [len(x) for x in rows])
    w, b = np.zeros(len(columns)), 0.0
    for _ in range(rounds):
        z = np.bincount(r, v * w[c], len(rows)) + b
        g = weigh * (1 / (1 + np.exp(-z)) - y)
        w -= rate * (np.bincount(c, v * g[r], len(columns)) + l2 * w)
        b -= rate / 10 * g.sum()
    out = np.zeros((1 << bits) + 1)
    out[columns], out[-1] = w, b
    return out


def judge(pages: DataFrame, rules=RULES, weights: np.ndarray | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, score (probability of block), verdict."""
    model = pages.sparkSession.sparkContext.broadcast(train() if weights is None else weights)

    @F.pandas_udf("double")
    def probability(host: pd.Series, path: pd.Series) -> pd.Series:
        w = model.value
        out, known = np.empty(len(host)), {}
        for i, key in enumerate(zip(host, path)):
            key = (key[0], re.sub(r"[0-9]+", "0", key[1]))
            if key not in known:
                at = features(*key)
                known[key] = 1 / (1 + np.exp(-(w[at].sum() / np.sqrt(len(at)) + w[-1])))
            out[i] = known[key]
        return pd.Series(out)

    host, path = host_and_path(pages[url_col].cast("string"))
    parsed = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), list(rules))
    judged = parsed.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("score", probability("host", "path"))
    return judged.select("page_id", "host", "path", "rule", "score", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"))
