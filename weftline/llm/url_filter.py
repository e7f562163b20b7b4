"""URL filters: rules, then host word segmentation and multinomial naive Bayes.

A rule names a host and a path prefix; it fits that host and all its subdomains, and the longest fitting rule decides.
Urls that no rule fits are judged by their words: concatenated names in hosts are split by unigram Viterbi, and naive
Bayes scores the words of host and path.

The unigram counts are those of the pages' visible text, and a few for each of the known unwanted words. Only
substrings of distinct host names are looked up in them, by a join, so neither the vocabulary nor the hosts are ever
broadcast. Naive Bayes needs examples, and there are no labels of urls: the rules block sections of sites, which says
nothing about words. What is known beforehand is a list of unwanted words, ``UNWANTED``. A url that holds one is an
example of what to block, and teaches by its *other* words only, those that keep it company; all other urls are
examples of what to allow. Counts of words are smoothed towards the words' shares in all urls (``SMOOTH``), so that a
few examples prove little. The listed words weigh ``KNOWN`` to 1 each, and the prior is ``PRIOR``, as a list says nothing
about how many urls are to be blocked. Words of the rules are no features. ``errors`` tells how well unwanted urls are recognised by their
company alone, with the listed words hidden, among pages that did not teach. Urls are counted and scored once for each
distinct (host, path).

Defined results: a null url, or one without ``://``, has empty host and path and no words: no rule fits, and the
verdict is the prior's, as it is for urls of unknown words only. Ties between equally long rules: the first given.
Even odds allow. Pages without text leave names unsplit, and so do runs
of more than ``LONGEST`` letters, which no host name has. Very long urls are judged by all their words. Repeated rows
each get their verdict. Other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import crc_mod, cut, slices

#: Words that mark a url as unwanted: adult, gambling, medicine, money, tracking, fraud, piracy.
UNWANTED = (
    "adult", "escort", "nude", "porn", "sex", "xxx", "bet", "bets", "betting", "casino", "gamble", "gambling", "jackpot", "lottery", "poker", "slots", "cialis", "pharmacy", "pill", "pills", "viagra",
    "loan", "loans", "payday", "ad", "ads", "clickbait", "popup", "tracker", "hack", "hacked", "malware", "phishing", "replica", "scam", "spam", "crack", "keygen", "torrent", "warez",
)
#: Odds of block against allow for a listed word, and for any url beforehand; words of a made-up url with usual words.
KNOWN, PRIOR, SMOOTH = 50.0, 1 / 20, 50.0
#: Letters of the longest label that a host name may have.
LONGEST = 63
Rule = tuple[str, str]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))


def ruling(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, else nulls. A rule is a pair like ("block", "net/es/")."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in reversed(sorted(rules, key=lambda r: -len(r[1]))):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def vocabulary(pages: DataFrame) -> DataFrame:
    """(word, n) over the visible text of all pages, lower case letters only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column="html"):
            text = pc.utf8_lower(pc.replace_substring_regex(pc.fill_null(batch.column(0), ""), "<[^>]*>", " "))
            words = pc.split_pattern_regex(text, "[^a-z]+").flatten()
            seen = pc.value_counts(words.filter(pc.and_(pc.greater(pc.utf8_length(words), 0), pc.less_equal(pc.utf8_length(words), LONGEST))))
            yield pa.RecordBatch.from_arrays([seen.field(0), seen.field(1)], ["word", "n"])

    return cut(pages.select("html").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


def best_split(name: str, known: dict[str, int], total: int) -> list[str]:
    """The most probable words whose concatenation is ``name``."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(name) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            word = name[start:end]
            n = known.get(word, 0)
            p = math.log(n / total) if n else math.log(1 / max(total, 1)) - 2.3 * len(word)
            options.append((best[start][0] + p, start))
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    out, end = [], len(name)
    while end:
        start = best[end][1]
        out.append(name[start:end])
        end = start
    return out[::-1]


def split_hosts(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, words): the words of each distinct host, in order; ``hosts`` has a column host."""
    runs = F.regexp_extract_all("host", F.lit(r"[a-z]+"), F.lit(0))
    each = hosts.distinct().select("host", F.posexplode(runs).alias("at", "name"))
    names = each.select("name").distinct().where(F.length("name") <= LONGEST)
    spans = F.explode(F.sequence(F.lit(1), F.length("name")))
    pieces = names.select("name", spans.alias("a")).select("name", "a", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("name") - F.col("a") + 1))).alias("n"))
    pieces = pieces.select("name", F.substr("name", F.col("a"), F.col("n")).alias("word")).distinct()
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    known = pieces.join(words, "word").groupBy("name").agg(F.collect_list("word").alias("w"), F.collect_list("n").alias("c"))
    known = names.join(known, "name", "left").join(F.broadcast(total))  # one row

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = zip(f["name"], f["w"], f["c"], f["total"], strict=True)
            yield pd.DataFrame({"name": f["name"], "split": [best_split(n, dict(zip(w, map(int, c), strict=True)) if w is not None else {}, int(t)) for n, w, c, t in rows]})

    found = known.mapInPandas(split, "name string, split array<string>")
    whole = F.coalesce("split", F.array("name"))
    return each.join(found, "name", "left").groupBy("host").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", whole.alias("split")))), lambda x: x["split"])).alias("words"))


def scored(pages: DataFrame, rules: list[Rule], unwanted: tuple[str, ...] = UNWANTED, training: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, said (the rule's verdict), bad (whether it holds a listed word), odds (log, of block
    against allow) and company (the same without listed words) of every page. ``training``: which pages teach; all by
    default."""
    spark = pages.sparkSession
    teaches = F.lit(True) if training is None else F.coalesce(training, F.lit(True))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), teaches.alias("train"))
    listed = spark.createDataFrame([(w,) for w in unwanted], "word string")
    lexicon = vocabulary(pages)
    total = lexicon.agg(F.greatest(F.lit(1), F.floor(F.coalesce(F.sum("n"), F.lit(0)) / 100_000)).alias("few"))
    lexicon = lexicon.unionByName(listed.join(F.broadcast(total)).select("word", F.col("few").alias("n"))).groupBy("word").agg(F.sum("n").alias("n"))  # one row
    urls = rows.groupBy("host", "path").agg(F.count_if("train").alias("n"))
    names = split_hosts(urls.select("host"), lexicon).withColumnRenamed("host", "h")
    in_path = F.regexp_extract_all(F.lower("path"), F.lit(r"[a-z]+"), F.lit(0))
    told = sorted({w for _, text in rules for w in re.findall("[a-z]+", text.lower())} - set(unwanted))
    words = F.filter(F.concat(F.coalesce("words", F.array().cast("array<string>")), in_path), lambda w: ~w.isin(told))
    urls = urls.join(names, F.col("host") == F.col("h"), "left").select("host", "path", "n", words.alias("words"))
    urls = cut(urls.withColumn("bad", F.arrays_overlap("words", F.array(*map(F.lit, unwanted)))), "urls")

    side = lambda bad: F.sum(F.when(F.col("bad") == bad, F.col("n")).otherwise(0))
    teaching = urls.where("n > 0").select("n", "bad", F.explode("words").alias("word")).where(~F.col("word").isin(*unwanted))
    counted = cut(teaching.groupBy("word").agg(side(True).alias("bad_n"), side(False).alias("good_n")), "words")
    sums = counted.agg(*(F.coalesce(F.sum(f"{k}_n"), F.lit(0)).alias(f"{k}_all") for k in ("bad", "good")))
    usual = SMOOTH * (F.col("bad_n") + F.col("good_n")) / (F.col("bad_all") + F.col("good_all"))
    share = lambda k: (F.col(f"{k}_n") + usual) / (F.col(f"{k}_all") + SMOOTH)
    learned = counted.join(F.broadcast(sums)).select(F.col("word").alias("w"), F.lit(False).alias("known"), F.log(share("bad") / share("good")).alias("weight"))  # one row
    weights = learned.unionByName(listed.select(F.col("word").alias("w"), F.lit(True).alias("known"), F.lit(math.log(KNOWN)).alias("weight")))
    weights = cut(weights, "weights")  # a hot word's rows can then be split in the join
    added = urls.select("host", "path", F.explode("words").alias("word")).join(weights, F.col("word") == F.col("w"))
    added = added.groupBy(F.col("host").alias("h"), F.col("path").alias("p")).agg(F.sum("weight").alias("weight"), F.sum(F.when(~F.col("known"), F.col("weight"))).alias("others"), F.max("known").alias("bad"))
    out = rows.join(added, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left")
    rule, said = ruling(rules, F.col("host"), F.col("path"))
    odds = lambda c: F.lit(math.log(PRIOR)) + F.coalesce(c, F.lit(0.0))
    return out.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), F.coalesce("bad", F.lit(False)).alias("bad"), odds("weight").alias("odds"), odds("others").alias("company"))


def _by_method(odds: str) -> Column:
    return F.when(F.col(odds) > 0, "block").otherwise("allow")


def judge(pages: DataFrame, rules: list[Rule], unwanted: tuple[str, ...] = UNWANTED) -> DataFrame:
    """page_id, host, path, rule, verdict, log_odds (of block against allow, by the method) for every page."""
    found = scored(pages, rules, unwanted)
    return found.select("page_id", "host", "path", "rule", F.coalesce("said", _by_method("odds")).alias("verdict"), F.col("odds").alias("log_odds"))


def errors(pages: DataFrame, rules: list[Rule], unwanted: tuple[str, ...] = UNWANTED) -> DataFrame:
    """(bad, pages, wrong): of the pages held out (crc32 of the id modulo 4 is 2), with and without listed words, how many
    the method judges otherwise by the other words alone, having learned from the rest."""
    held = F.coalesce(crc_mod(F.col("page_id"), 4) == 2, F.lit(False))
    found = scored(pages, rules, unwanted, ~held).join(pages.where(held).select(F.col("page_id").alias("p")).distinct(), F.col("page_id") == F.col("p"))
    return found.groupBy("bad").agg(F.count("*").alias("pages"), F.count_if((F.col("company") > 0) != F.col("bad")).alias("wrong"))
