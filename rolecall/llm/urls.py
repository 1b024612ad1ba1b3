"""URL filters: rules by host and path, and logistic regression on hashed character n-grams for all other urls.

The model is trained from a small labelled url table by full-batch gradient descent in numpy. Host and path are
separate feature spaces; a url is its hashed 3- to 5-grams of characters in each, at unit length. Part of the table, by
a hash of the url, is held out of training: the threshold is the least at which at most `false_blocks` of the held
urls to keep are blocked.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of hosts to keep and to block.
KEPT = ("library weather garden museum school recipes science history travel health archive journal bakery bicycle bridge camera castle chess choir city clinic coast "
        "coffee college concert county dance design doctor engine family field film forest forum fruit gallery guide harbour hiking hotel house kitchen language law "
        "letters market math music nature news ocean opera orchard painting paper park pharmacy photo physics piano planet poetry post press radio railway river "
        "school sport stamps station street studio summer sunrise tea temple theatre tools town train valley village violin walking water wiki windows winter wood").split()
BLOCKED = ("casino poker bets betting slots jackpot roulette lottery pills viagra cialis steroids diet-pills spam spammer adult xxx porn sex camgirls escort hookup "
           "win-cash winner cash-prize free-prize freebie cheap cheapest replica fake-watches loan payday quickcash get-rich forex-profit earn-fast bonus giveaway ads "
           "adserver adclick track tracker tracking popup banner clickbait link-farm linkfarm seo-links backlinks warez crack keygen serials torrentz phish login-verify "
           "free cash win prize hot-singles nude fetish miracle-cure weight-loss").split()
_ENDS = ("example.com", "example.net", "example.org", "test.invalid", "site.test")
_FRONTS = ("", "www.", "blog.", "m.", "shop.", "static.")
_PATHS = ("", "/", "/index.html", "/a/12", "/about", "/2019/05/some-title", "/p/90.html", "/items/318", "/en/75", "/category/long/4021/", "/q/6", "/view", "/de/3/", "/news/today")
_SYLLABLES = "ba ron ti mer lo sha ing nda kel vo pri tha ul con est ar ash nish tion ble ock usk ith ard een oof ill ank arp int old unt ess ave".split()


def small_table() -> list[tuple[str, int]]:
    """The labelled urls the default model is trained on: (url, 1 to block). Each word stands alone, before and after
    another, at several ends and paths that both labels share; invented names stand for the mass of hosts that say nothing."""
    table = []

    def add(name: str, label: int) -> None:
        i = len(table)
        table.append((f"{('https', 'http')[i % 2]}://{_FRONTS[i * 5 % 6]}{name}.{_ENDS[i * 3 % 5]}{_PATHS[i * 11 % 14]}", label))

    for words, label in ((KEPT, 0), (BLOCKED, 1)):
        for i, word in enumerate(words):
            for k in range(6):
                other = (KEPT if k % 2 else words)[(i * 7 + k * 5) % 60]
                add((word, f"{other}-{word}", f"{word}-{other}", f"{word}{other}", f"{word}{i % 9}", f"{other}{word}")[k], label)
    n = len(_SYLLABLES)
    for i in range(700):
        add("".join(_SYLLABLES[(i * (j + 1) * 7 + i // n * (j + 3)) % n] for j in range(2 + i % 2)), 0)
    return table


@dataclass(frozen=True)
class UrlSettings:
    buckets: int = 1 << 14
    sizes: tuple[int, ...] = (3, 4, 5)
    steps: int = 4000
    rate: float = 3.0
    penalty: float = 1e-4
    prior: float = 0.2  # of urls to block, whatever the table holds
    held: int = 3  # one of so many urls is held out
    false_blocks: float = 0.01


@dataclass(frozen=True)
class UrlModel:
    weight: np.ndarray
    bias: float
    threshold: float = 0.5
    recall: float = 0.0  # of the held urls to block


def host_of(url: Column) -> Column:
    """What stands between the first `://` and the next `/`, `?`, `#` or end, A-Z lower-cased; empty without `://`."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null without one.

    A rule is `host/path`: it fits the host and its subdomains if the url's path starts with its path. Rules are a
    short list written by hand; they become part of the plan.
    """
    best = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def features(host: str, path: str, settings: UrlSettings) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a url."""
    ids, shares = [], []
    for space, text in ((1, host), (2, path)):
        data = np.frombuffer(f"^{text}$".encode("utf-32-le", "surrogatepass"), "<u4")
        own = []
        for size in settings.sizes:
            m = len(data) - size + 1
            if m > 0:
                value = np.full(m, (space * 0x9E3779B1 + size * 0x85EBCA6B) & 0xFFFFFFFF, np.uint32)
                for k in range(size):
                    value = (value ^ data[k : k + m]) * np.uint32(0x01000193)
                    value ^= value >> np.uint32(15)
                own.append(value % np.uint32(settings.buckets))
        if own:
            own = np.concatenate(own)
            ids.append(own)
            shares.append(np.full(len(own), len(own) ** -0.5, np.float32))
    return (np.concatenate(ids), np.concatenate(shares)) if ids else (np.zeros(0, np.uint32), np.zeros(0, np.float32))


def split_url(url: str) -> tuple[str, str]:
    """Host and path of a url as the column functions give them."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    end = min([rest.find(c, cut) for c in "?#" if rest.find(c, cut) >= 0], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:end]


def chance(url: str, model: UrlModel, settings: UrlSettings) -> float:
    ids, shares = features(*split_url(url), settings)
    return float(1 / (1 + np.exp(-(model.weight[ids] @ shares + model.bias))))


def train(table: list[tuple[str, int]], settings: UrlSettings = UrlSettings()) -> UrlModel:
    """The model of a labelled url table; one without a url to block allows everything. A table whose held part lacks a
    label keeps the threshold one half."""
    weight, bias = np.zeros(settings.buckets), 0.0
    held = [row for row in table if zlib.crc32(row[0].encode()) % settings.held == 0]
    learnt = [row for row in table if zlib.crc32(row[0].encode()) % settings.held]
    if not any(label for _, label in learnt):
        return UrlModel(weight, -10.0)
    rows = [features(*split_url(url), settings) for url, _ in learnt]
    used = np.unique(np.concatenate([ids for ids, _ in rows]))
    row = np.repeat(np.arange(len(rows)), [len(ids) for ids, _ in rows])
    column = np.searchsorted(used, np.concatenate([ids for ids, _ in rows]))
    value = np.concatenate([shares for _, shares in rows]).astype(float)
    own = np.zeros(len(used))
    bias = float(np.log(settings.prior / (1 - settings.prior)))  # a url without a known n-gram stays there
    y = np.array([label for _, label in learnt], float)
    share = np.where(y > 0, settings.prior / max(1, y.sum()), (1 - settings.prior) / max(1, (1 - y).sum()))
    for _ in range(settings.steps):
        z = np.bincount(row, own[column] * value, len(rows)) + bias
        wrong = (1 / (1 + np.exp(-z)) - y) * share
        own -= settings.rate * (np.bincount(column, wrong[row] * value, len(used)) + settings.penalty * own)
    weight[used] = own
    model = UrlModel(weight, bias)
    kept = np.sort([chance(url, model, settings) for url, label in held if not label])
    blocked = np.array([chance(url, model, settings) for url, label in held if label])
    if not len(kept) or not len(blocked):
        return model
    threshold = float(np.nextafter(kept[len(kept) - 1 - int(settings.false_blocks * len(kept))], 1))
    return UrlModel(weight, bias, threshold, float((blocked >= threshold).mean()))


def _scored(model: UrlModel, settings: UrlSettings, names: list[str]):
    def run(batches):
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
                ids, shares = features(host or "", path or "", settings)
                out[i] = 1 / (1 + np.exp(-(model.weight[ids] @ shares + model.bias)))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out)], [*names, "block_score"])
    return run


def judge(pages: DataFrame, rules: list[tuple[str, str]], model: UrlModel, settings: UrlSettings = UrlSettings()) -> DataFrame:
    """`pages` (url) with `host`, `path`, `rule`, `block_score` (0 to 1) and `verdict`: that of the longest fitting rule,
    else `block` from the threshold on. Null urls have empty parts. Columns of these names are replaced."""
    kept = pages.drop("host", "path", "rule", "block_score", "verdict")
    parts = kept.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    scored = parts.mapInArrow(_scored(model, settings, parts.columns), f"{fields}, block_score double")
    ruled = scored.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.select(*parts.columns, F.col("_rule.rule").alias("rule"), "block_score", F.coalesce(
        F.col("_rule.verdict"), F.when(F.col("block_score") >= model.threshold, "block").otherwise("allow")).alias("verdict"))
