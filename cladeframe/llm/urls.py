"""URL filtering by association rules: DataFrame functions and Spark's FP-growth only.

Every URL becomes a set of tokens: its host and the host's parents, path
segments with digits folded, file endings, query keys. Tokens that the same
labelled URLs hold are one item. FP-growth over labelled URLs finds item sets
that imply a bad label. A rule stays if its confidence and support reach the
limits, if chance does not explain it (a Chernoff bound against the share of bad
URLs, for all sets that could have been rules), and if no rule with a part of
its items is as confident. Pages meet rules by an inverted index on the rarest
item of each rule, one row per distinct token set. Given host and path rules
come first.

Null URLs and URLs without ``://`` have an empty host and path, no tokens, and
are allowed. Repeated pages are judged each. Without labels no rule is mined.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import UPPER
from cladeframe.session import cut

BAD = "label=bad"
SALTS = 16


def split_url(pages: DataFrame) -> DataFrame:
    """Add host and path; the rest of the columns stay."""
    whole = F.coalesce(F.col("url"), F.lit(""))
    rest = F.regexp_extract(whole, r"(?s)^.*?://(.*)$", 1)
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, UPPER.lower()),
        "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1),
    })


def tokens() -> Column:
    """Sorted distinct tokens of the columns url, host and path."""
    labels = F.split("host", r"\.")
    hosts = F.when(F.col("host") == "", F.array()).otherwise(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    folded = F.regexp_replace(F.col("path"), r"[0-9]+", "0")
    segments = F.transform(F.filter(F.split(folded, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path="), s))
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,8})$", 1)
    endings = F.when(ending == "", F.array()).otherwise(F.array(F.concat(F.lit("ending="), ending)))
    query = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""),
                       lambda s: F.concat(F.lit("key="), F.regexp_extract(s, r"(?s)^([^=]*)", 1)))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(x, none) for x in (hosts, segments, endings, keys)])))


def collapsed(sets: DataFrame, least: float) -> DataFrame:
    """(token, item) of every token that at least ``least`` URLs hold, from (tokens, n) with one row a token set.

    Tokens that the same sets hold are one item, named by the smallest of them,
    so a template of many tokens does not have all their subsets mined. What
    sets hold a token is told by their number and two sums of 64-bit hashes.
    """
    wide = sets.select(F.explode("tokens").alias("token"), "n", F.xxhash64("tokens").alias("h1"), F.xxhash64(F.lit("2"), "tokens").alias("h2"))
    held = wide.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("sets"), F.bit_xor("h1").alias("h1"), F.bit_xor("h2").alias("h2"))
    often = cut(held.where(F.col("n") >= least))
    same = ["n", "sets", "h1", "h2"]
    return cut(often.join(often.groupBy(*same).agg(F.min("token").alias("item")), same).select("token", "item"))


def surprise(n: Column, bad: Column, rate: Column) -> Column:
    """Chernoff bound of the chance, as a negative logarithm, that ``bad`` of ``n`` are bad where ``rate`` of all are; 0 below the rate."""
    share = bad / n
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    return F.when((share > rate) & (rate < 1), n * (share * F.log(share / rate) + rest)).otherwise(0.0)


def mine(urls: DataFrame, labels: DataFrame, min_support: float = 0.005, min_confidence: float = 0.6,
         chance: float = 0.01) -> tuple[DataFrame, DataFrame]:
    """(antecedent, confidence, support) of the rules and (token, item) of their items, from (row, tokens) and (row, bad).

    Antecedents are arrays of items; a URL has an item if it holds any of its
    tokens. A rule is kept if the chance that any set of items as frequent as
    the mined ones looks as bad without a cause is at most ``chance``.
    """
    known = urls.join(labels, "row").where(F.size("tokens") > 0).select("tokens", F.col("bad").cast("long").alias("bad"))
    sets = cut(known.groupBy("tokens").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    names = collapsed(sets.select("tokens", "n"), max(1.0, min_support * total["total"]))
    own = sets.select("tokens", F.explode("tokens").alias("item")).join(names.where("token = item").select("item"), "item")
    items = own.groupBy("tokens").agg(F.collect_list("item").alias("items"))
    # Sets without a frequent token count in the supports only.
    none = F.array().cast("array<string>")
    thin = sets.join(items, "tokens", "left").select(F.coalesce("items", none).alias("items"), "n", "bad")
    baskets = cut(thin.select("items", "bad", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(
        F.when(F.col("i") <= F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items")))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    tests = max(1, model.freqItemsets.where(~F.array_contains("items", BAD)).count())
    found = model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD)))
    n = F.round(F.col("support") * total["total"] / F.col("confidence"))
    rules = cut(found.where(surprise(n, F.round(n * F.col("confidence")), F.lit(total["bad"] / max(1, total["total"]))) >= math.log(tests / chance))
                .select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    # A rule adds nothing beside a rule of fewer items that is as sure; rules meet on single items.
    wide = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item"))
    less = rules.select(F.col("antecedent").alias("part"), F.col("confidence").alias("sure"),
                        F.element_at("antecedent", 1).alias("item"))
    covered = (wide.join(less, "item")
               .where((F.size("part") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence"))
                      & (F.size(F.array_except("part", "antecedent")) == 0))
               .select("antecedent").distinct())
    kept = cut(rules.join(covered, "antecedent", "left_anti"))
    return kept, names.join(kept.select(F.explode("antecedent").alias("item")).distinct(), "item").select("token", "item")


def match(sets: DataFrame, rules: DataFrame, names: DataFrame) -> DataFrame:
    """(tokens, confidence) of the surest rule for each distinct token set that some rule fits."""
    seen = sets.select("tokens").distinct()
    held = cut(seen.select("tokens", F.explode("tokens").alias("token")).join(names, "token")
               .groupBy("tokens").agg(F.collect_set("item").alias("items")))
    postings = held.select("tokens", "items", F.explode("items").alias("item"))
    often = postings.groupBy("item").count()
    members = rules.select("antecedent", "confidence", F.explode("antecedent").alias("item")).join(often, "item")
    index = members.groupBy("antecedent", "confidence").agg(F.min(F.struct("count", "item"))["item"].alias("item"))
    return (postings.join(index, "item").where(F.size(F.array_except("antecedent", "items")) == 0)
            .groupBy("tokens").agg(F.max("confidence").alias("confidence")))


def given_rule(rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, its verdict) of the longest (verdict, host, path) rule that fits; null if none does."""
    fits = text = verdict = None
    for what, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text = F.when(fits, host + path) if text is None else text.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def judge(pages: DataFrame, labels: DataFrame, given: list[tuple[str, str, str]],
          min_support: float = 0.005, min_confidence: float = 0.6) -> DataFrame:
    """(page_id, host, path, rule, verdict, confidence) of every page.

    ``labels`` holds (page_id, bad); several labels of a page count as bad if
    one is.
    """
    split = split_url(pages.select("page_id", "url")).withColumn("tokens", tokens())
    known = labels.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").alias("row")).agg(F.max("bad").alias("bad"))
    rules, names = mine(split.select(F.col("page_id").alias("row"), "tokens"), known, min_support, min_confidence)
    # One token set may be that of a third of all pages: its pages are spread.
    found = match(split, rules, names).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = split.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    rule, verdict = given_rule(given)
    return (spread.join(found, ["tokens", "salt"], "left").withColumn("rule", rule)
            .withColumn("verdict", F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")))
            .select("page_id", "host", "path", "rule", "verdict", "confidence"))
