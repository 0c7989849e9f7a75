"""Operator 1: URL filter by logistic regression on hashed character n-grams [native].

Features are the 3- and 4-grams of the host (between ^ and $) and the 3-grams
of the path, each hashed to one of BUCKETS, as shares of all n-grams. The model
is fitted by Spark ML on a small labelled table; scoring is one column
expression over the n-grams and the weights. Host rules come first.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 2048
#: Rows of a labelled table that are learned from at most, those with the smallest hashes.
LABELLED_ROWS = 5_000

# Host rules as (verdict, host and path).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

# Parts from which the labelled table is made.
_GOOD_WORDS = ("city", "library", "garden", "weather", "museum", "recipes", "history", "archive", "school", "physics", "medicine", "theatre", "travel", "county", "statistics", "orchestra")
_BAD_WORDS = ("spam", "farm", "cheap", "pills", "casino", "bonus", "free", "spins", "adult", "loan", "payday", "prize", "replica", "poker", "jackpot", "torrent")
_FRONTS = ("www.", "", "blog.", "m.")
_TAILS = ("example.org", "example.net", "site.org", "pages.info")
_GOOD_PATHS = ("/en/101", "/de/archive/7", "/fr/222.html", "/es/9/", "/articles/2019/spring", "/about.html", "/guide/index", "/notes/12")
_BAD_PATHS = ("/en/101", "/de/33", "/fr/222.html", "/es/9/", "/buy-cheap-now", "/free-bonus/claim", "/xxx/pics", "/win/prize.php")


# Syllables of the made-up names of ordinary hosts.
_SYLLABLES = ("an", "ber", "co", "del", "en", "fi", "gor", "hat", "in", "kel", "lor", "mon", "ner", "ol", "per", "ri", "sen", "tor", "ul", "ver", "wes", "th", "er", "on", "st", "re", "ti", "ble", "ing", "ou", "sh", "ly")
ORDINARY = 240


def _names() -> list[str]:
    """Names of ordinary hosts: two to four syllables each, all different."""
    size, out = len(_SYLLABLES), []
    for i in range(ORDINARY):
        n = 2 + i % 3
        picks = [(i * (2 * j + 3) + (i // size) * (5 * j + 1) + 7 * j) % size for j in range(n)]
        out.append("".join(_SYLLABLES[p] for p in picks))
    return list(dict.fromkeys(out))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table (url, label, word): label 1 for those to block.

    Ordinary hosts are most of them, as they are of the web: real words in pairs, and
    made-up names of many shapes. Hosts to block have words of advertising: in pairs,
    alone, and beside another name or a letter.
    Paths of either kind go with both, more often with their own. `word` is the host's
    first word, by which hosts can be held out.
    """
    hosts = [(f"{first}-{words[(i + j) % len(words)]}", first, label, i + j) for words, label in ((_GOOD_WORDS, 0), (_BAD_WORDS, 1)) for i, first in enumerate(words) for j in (1, 3, 6)]
    names = _names()
    hosts += [(name, name, 0, i) for i, name in enumerate(names)]
    for i, word in enumerate(_BAD_WORDS):
        hosts += [(word, word, 1, i), (f"{word}-{names[i]}", word, 1, i + 1), (f"{word}-{names[-i - 1]}", word, 1, i + 2), (f"{word}-{'xzqwk'[i % 5]}", word, 1, i + 3)]
    rows = []
    for host, word, label, i in hosts:
        own, other = (_BAD_PATHS, _GOOD_PATHS) if label else (_GOOD_PATHS, _BAD_PATHS)
        for n in range(2):
            paths = other if (i + n) % 5 == 4 else own
            rows.append(f"('https://{_FRONTS[i % len(_FRONTS)]}{host}.{_TAILS[i % len(_TAILS)]}{paths[(i + n) % len(paths)]}', {label}, '{word}')")
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(url, label, word)")


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, n: int, tag: str) -> Column:
    """Overlapping n-grams in one pass of a look-ahead, hashed to buckets with the tag."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)), lambda g: F.pmod(F.xxhash64(F.lit(tag), g), F.lit(BUCKETS)).cast("int"))


def features(host: Column, path: Column) -> Column:
    """The buckets of all n-grams of a host and a path, with repeats."""
    framed = F.concat(F.lit("^"), host, F.lit("$"))
    return F.concat(_grams(framed, 3, "h3"), _grams(framed, 4, "h4"), _grams(F.lower(path), 3, "p3"))


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", rows: int = LABELLED_ROWS) -> tuple[float, list[float]]:
    """Intercept and bucket weights of a logistic regression, from at most `rows` labelled urls (1: block)."""
    url = F.col(url_col)
    table = labelled.where(url.isNotNull() & F.col(label_col).isNotNull()).orderBy(F.xxhash64(url), url).limit(rows)
    grams = table.select(features(host_of(url), path_of(url)).alias("grams"), F.col(label_col).cast("double").alias("label")).where(F.size("grams") > 0)
    # Sparse counts of the buckets in one pass over a row's n-grams, then their shares.
    named = grams.select("label", F.transform("grams", lambda g: g.cast("string")).alias("grams"))
    counter = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], inputCol="grams", outputCol="counts")
    table = Normalizer(p=1.0, inputCol="counts", outputCol="features").transform(counter.transform(named)).select("label", "features")
    model = LogisticRegression(regParam=1e-3, maxIter=60).fit(table)
    return model.intercept, [float(w) for w in model.coefficients.toArray()]


def judge(pages: DataFrame, model: tuple[float, list[float]], rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id_col, host, path, rule, verdict, score) for each row of `pages`; score is the model's probability of a block.

    A rule fits its host and all subdomains if the path starts with the rule's;
    the longest wins; without one the model's verdict holds, a block from 0.5
    on. Defined cases: a null url, or one without '://', has an empty host and
    path, no rule, and the model's verdict on the empty url; ids are passed
    through, null or repeated; a url of any length is judged whole; an empty
    table gives no rows; other columns are not looked at.
    """
    intercept, weights = model
    table = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    parts = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    grams = features(F.col("host"), F.col("path"))
    scored = parts.withColumn("grams", F.explode(F.array(grams)))
    logit = F.lit(intercept) + F.coalesce(F.aggregate("grams", F.lit(0.0), lambda acc, g: acc + F.get(table, g)) / F.nullif(F.size("grams"), F.lit(0)), F.lit(0.0))
    score = 1 / (1 + F.exp(-logit))
    judged = scored.select(id_col, "host", "path", rule.alias("rule"), verdict.alias("ruled"), score.alias("score"))
    return judged.select(id_col, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
