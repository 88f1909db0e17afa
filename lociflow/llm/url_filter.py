"""URL verdicts from rules and from a list of canonical URLs.

A blocked Bloom filter of the listed URLs lets through whatever may be listed; an exact hash join then removes its false
positives. A block is eight 64-bit words; a key sets PROBES bits of one block, so a probe touches one cache line. The
filter's size follows the list up to MAX_BLOCKS (a fixed bound on what is sent to executors); beyond it the filter only
gets fuller, and the join sees more false positives, but the result stays exact.

Defined cases: a null url, or one without `://`, has an empty host and path, fits no rule and is never listed, so it is
allowed; repeated rows are judged alike; rules may share a host, and the longest that fits wins, of equally long ones the
first by name; a url may have any length; an empty table, or an empty list, gives all rows the rules' verdict or `allow`;
columns beside the identifier and the url are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociflow.llm.shared import cut, ship

BITS_A_KEY = 12
PROBES = 6
MAX_BLOCKS = 1 << 19
MAX_RULES = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change what a page is.
TRACKING = "(utm_[a-z]+|ref|gclid|fbclid)"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the page query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host in small letters without port 80 or 443, path without its last slash, query without tracking parameters; no
    scheme and no fragment. Null where there is no host."""
    host = F.regexp_replace(host_of(url), ":(80|443)$", "")
    query = F.regexp_extract(url, "(?s)^.*?://[^?#]*\\?([^#]*)", 1)
    kept = F.regexp_replace(F.regexp_replace(F.concat(F.lit("&"), query), f"&{TRACKING}=[^&]*", ""), "^&", "")
    return F.when(host != "", F.concat(host, F.regexp_replace(path_of(url), "/$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Index of the longest rule that fits, or null. A short list, checked against MAX_RULES, becomes one expression."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    out = None
    for i, r in sorted(enumerate(rules), key=lambda x: (-len(x[1].name), x[1].name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(i)) if out is None else out.when(fits, F.lit(i))
    return F.lit(None).cast("int") if out is None else out


def _places(key: Column, n_blocks: int) -> tuple[Column, Column]:
    """Block of a key and its PROBES bit numbers; another seed than the block's gives the bits."""
    block = F.pmod(F.xxhash64(key), F.lit(n_blocks))
    bits = F.array(*[F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(7), key), 9 * i), F.lit(512)).cast("int") for i in range(PROBES)])
    return block, bits


def build_filter(listed: DataFrame, key: str = "canonical") -> tuple[np.ndarray, int]:
    """Words of the filter over the column `key`; at most 64 MAX_BLOCKS bytes reach the driver."""
    n = listed.count()
    n_blocks = max(1, min(MAX_BLOCKS, -(-n * BITS_A_KEY // 512)))
    block, bits = _places(F.col(key), n_blocks)
    set_bits = listed.select(block.alias("block"), F.explode(bits).alias("bit"))
    powers = F.lit([1 << i if i < 63 else -(1 << 63) for i in range(64)])
    words = set_bits.select((F.col("block") * 8 + F.floor(F.col("bit") / 64)).alias("word"), F.get(powers, F.col("bit") % 64).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(8 * n_blocks, np.int64)
    got = words.toPandas()
    out[got["word"].to_numpy()] = got["mask"].to_numpy()
    return out, n_blocks


def maybe_listed(urls: DataFrame, words: np.ndarray, n_blocks: int, key: str = "canonical") -> DataFrame:
    """Add `maybe`: false only if the column `key` is surely not listed. Null is never listed."""
    ship(urls.sparkSession)
    sent = urls.sparkSession.sparkContext.broadcast(words.tobytes())  # 64 MAX_BLOCKS bytes at most

    @F.pandas_udf("boolean")
    def probe(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = np.frombuffer(sent.value, np.int64)
        for block, bits in parts:
            hit = np.ones(len(block), bool)
            if len(block):
                which = np.stack(bits.to_numpy())
                for i in range(PROBES):
                    word = table[block.to_numpy() * 8 + which[:, i] // 64]
                    hit &= (word.view(np.uint64) >> (which[:, i] % 64).astype(np.uint64)) & np.uint64(1) == 1
            yield pd.Series(hit)

    block, bits = _places(F.col(key), n_blocks)
    return urls.withColumn("maybe", F.col(key).isNotNull() & probe(block, bits))


def judge(pages: DataFrame, listed: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, listed). `listed` has a column `canonical`; a listed page that no rule fits is blocked."""
    known = cut(listed.where(F.col("canonical").isNotNull()).select("canonical").distinct(), "listed-urls")
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), canonical(F.col(url_col)).alias("canonical"))
    probed = cut(maybe_listed(urls, *build_filter(known)), "probed-urls")
    sure = probed.where("NOT maybe").withColumn("listed", F.lit(False))
    # only possible hits are shuffled
    found = probed.where("maybe").join(known.withColumn("listed", F.lit(True)), "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    columns = ["id", "host", "path", "listed"]
    both = sure.select(columns).unionByName(found.select(columns)).withColumn("i", rule_of(F.col("host"), F.col("path"), rules))
    names, verdicts = F.lit([r.name for r in rules]), F.lit([r.verdict for r in rules])
    method = F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))
    return both.select(F.col("id").alias(id_col), "host", "path", F.get(names, F.col("i")).alias("rule"), F.coalesce(F.get(verdicts, F.col("i")), method).alias("verdict"), "listed")


#: The list of the page query. Hosts whose pages are on it, with all their subdomains; the first hexadecimal digits of the
#: MD5 of canonical URLs that stand for reports of single pages elsewhere; and a page that goes with each of these, which
#: no crawled page need be.
LISTED_HOSTS = "(^|\\.)(spam-farm|casino-win|free-bets|cheap-pills)\\."
REPORTED, COMPANION = "00", "/amp"


def page_list(pages: DataFrame) -> DataFrame:
    """Canonical URLs of a list that grows with the pages; a host does not tell whether a page is on it."""
    known = pages.select(host_of(F.col("url")).alias("host"), canonical(F.col("url")).alias("canonical")).where("canonical IS NOT NULL")
    listed = known.where(F.col("host").rlike(LISTED_HOSTS) | F.md5(F.col("canonical").cast("binary")).startswith(REPORTED))
    return listed.select(F.explode(F.array("canonical", F.concat("canonical", F.lit(COMPANION)))).alias("canonical"))


def page_verdicts(pages: DataFrame) -> DataFrame:
    """Judge every page by the rules and page_list()."""
    return judge(pages, page_list(pages)).select("page_id", "host", "path", "rule", "verdict")
