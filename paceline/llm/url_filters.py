"""URL filters: host and path rules, and association rules over URL tokens mined by FP-growth; DataFrame functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import checkpointed, lower_ascii

#: (verdict, host, path): fixed values of the query's contract.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A mined rule holds for so many bad pages and this share of the pages it is mined from, and these are bad at this rate.
LEAST, SUPPORT, CONFIDENCE = 20, 0.001, 0.5
#: A rule is confirmed on labelled pages it wasn't mined from: their bad rate is CONFIDENCE at least, and over the rate
#: of all pages by so many standard deviations of its estimate (Wilson's lower bound).
DEVIATIONS = 2.0
#: Parts that the pages of one set of tokens are dealt to.
SALTS = 16
BAD = "label=bad"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits: struct(size, rule, verdict) or null. ``rules`` is a short list, part of the plan."""
    fits = [F.when(((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*fits))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: scheme, host suffixes, path segments with digits as one sign, endings, query names."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host="), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), F.regexp_replace(x, "[0-9]+", "#")))
    names = F.transform(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.element_at(F.split(x, "="), 1)))
    scheme = F.array(F.concat(F.lit("scheme="), F.lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    flags = F.when(F.contains(url, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_sort(F.array_distinct(F.concat(scheme, suffixes, parts, names, flags))), F.array().cast("array<string>"))


def _own_rules(labelled: DataFrame, least: int, confidence: float) -> DataFrame:
    """The tokens that are rules alone: antecedent, confidence, support (a count)."""
    each = labelled.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("hit"))
    return each.where((F.col("hit") >= least) & (F.col("hit") / F.col("n") >= confidence)).select(F.array("token").alias("antecedent"), (F.col("hit") / F.col("n")).alias("confidence"), F.col("hit").alias("support"))


def _distinct_tokens(rows: DataFrame) -> DataFrame:
    """``rows(row, token)`` with one token for all that are in the same rows, the first by name: their sets of rows are
    compared by count and two sums of hashes."""
    of = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(38,0)")).alias("y"))
    return rows.join(of.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token").hint("merge"), "token", "left_semi")


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``labelled(tokens, bad)`` to rules: antecedent, confidence, support; without those that a shorter rule covers.

    Tokens that are rules alone cover all that they are in, and are left out of what is mined; so are tokens under the
    support, and of tokens that occur on the same pages all but one, which stands for them: n tokens that come together
    are one item and not 2^n itemsets. Only combinations that occur with bad pages can be rules; they are mined by
    FP-growth among all labelled pages.
    """
    n = labelled.count()
    least = max(1, -int(-support * n // 1))
    own = checkpointed(_own_rules(labelled, least, confidence))
    row = F.struct(F.xxhash64("tokens").alias("x"), F.xxhash64("tokens", F.lit(1)).alias("y")).alias("row")  # pages of the same tokens are one
    tokens = labelled.select(row, "tokens").distinct().select("row", F.explode("tokens").alias("token"))
    tokens = tokens.join(own.select(F.col("antecedent")[0].alias("token")).hint("merge"), "token", "left_anti")
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    kept = _distinct_tokens(checkpointed(tokens.join(often.select("token").hint("merge"), "token", "left_semi")))
    items = kept.groupBy("row").agg(F.collect_set("token").alias("some"))
    per_row = labelled.select(row, "bad").join(items.hint("merge"), "row", "left")
    some = F.coalesce("some", F.array().cast("array<string>"))
    baskets = per_row.select(F.when(F.col("bad"), F.concat(some, F.array(F.lit(BAD)))).otherwise(some).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (F.size("consequent") == 1))
    rules = checkpointed(rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    # A rule is covered if dropping one of its tokens leaves a rule: rules of one token less, found by equality.
    shorter = rules.select(F.col("antecedent").alias("part"))
    drops = rules.where(F.size("antecedent") > 1).select("antecedent", F.explode("antecedent").alias("t")).select("antecedent", F.array_remove("antecedent", F.col("t")).alias("part"))
    covered = drops.join(shorter, "part", "left_semi").select("antecedent").distinct()
    return rules.join(covered, "antecedent", "left_anti").unionByName(own.withColumn("support", F.col("support") / F.lit(max(n, 1))))


def matched(kinds: DataFrame, rules: DataFrame) -> DataFrame:
    """``kinds(tokens, n)`` with the ``antecedent`` of every rule whose tokens they hold: a row for each.

    A rule stands under its rarest token of an inverted index, and is compared with the sets that have that token.
    """
    held = kinds.select(F.explode("tokens").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("n"))
    keyed = rules.select("antecedent", F.explode("antecedent").alias("token")).join(held, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    hits = kinds.withColumn("token", F.explode("tokens")).join(keyed, "token").drop("token")
    return hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)


def confirmed(rules: DataFrame, kinds: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """The ``rules`` that hold on ``kinds(tokens, n, bad)``, pages that they weren't mined from."""
    rate = kinds.agg((F.sum("bad") / F.sum("n")).alias("rate"))
    z = DEVIATIONS
    p = F.col("hit") / F.col("all")
    low = (p + z * z / (2 * F.col("all")) - z * F.sqrt(p * (1 - p) / F.col("all") + z * z / (4 * F.col("all") * F.col("all")))) / (1 + z * z / F.col("all"))
    tried = matched(kinds, rules).groupBy("antecedent").agg(F.sum("n").alias("all"), F.sum("bad").alias("hit"))
    return tried.join(F.broadcast(rate)).where((p >= confidence) & (low > F.col("rate"))).select("antecedent")  # one row


def learned(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules of ``labelled(page_id, tokens, bad)``: mined from four fifths of the pages and confirmed on the others.

    The fifths go by page_id's hash. What chance makes look like a rule in one part it doesn't in the other: labels
    that have nothing to do with URLs leave no rule.
    """
    turn = F.pmod(F.xxhash64("page_id"), F.lit(5))
    rows = checkpointed(labelled.select(turn.alias("fifth"), "tokens", "bad"))
    train, other = rows.where("fifth > 0"), rows.where("fifth = 0")
    n = train.count()
    found = checkpointed(mined_rules(train.select("tokens", "bad"), max(support, min(LEAST / max(n, 1), 1.0)), confidence))
    kinds = other.groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    return checkpointed(confirmed(found, kinds, confidence))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict.

    Where a host and path rule fits, the longest decides. Elsewhere a page is blocked if a learned rule's tokens are
    all in its URL, and allowed else. Rules are learned from the pages that ``labels`` marks (by doc_id = page_id; bad:
    quality 0 or toxic 1). Pages are one row a set of tokens when they are matched, and are dealt out by salt when they
    meet their verdict, so a host with a third of all pages is no hot key. Null urls and urls without ``://`` have
    empty host and path, fit no rule and are allowed; without labelled pages no rule is learned. Null page_ids, very
    long urls and rows that repeat are judged like any. Other columns aren't read. An empty table gives no rows.
    """
    own = pages.select("page_id", F.col("url").alias("url")).withColumn("tokens", tokens(F.col("url")))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).alias("bad"))
    found = learned(own.where(F.size("tokens") > 0).join(marks, "page_id").select("page_id", "tokens", "bad"), support, confidence)
    kinds = own.groupBy("tokens").agg(F.count("*").alias("n"))
    blocked = matched(kinds, found).select("tokens").distinct().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("hit", F.lit(True))
    out = own.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(blocked, ["tokens", "salt"], "left")
    out = out.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = out.withColumn("best", rule_for(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), method).alias("verdict"))
