"""URL filter: listed host and path rules, and mined association rules for the rest.

The listed rules label the urls that they fit. FP-growth mines the combinations of url tokens that go with a label; rules
with enough support and confidence stay, unless a part of theirs is at least as sure. A url that no listed rule fits is judged by
the mined rules that it meets, found through an inverted index from tokens to rules.
"""

from __future__ import annotations

import itertools
from collections import Counter

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from backflow.llm.common import checkpoint

ALLOW, BLOCK = "allow", "block"
#: Share and number of the labelled urls that a combination needs, and share of those with it that must have the label.
SUPPORT = 0.005
LEAST = 5
CONFIDENCE = 0.8
#: Up to so many mined rules the index is part of the query as a literal; more are a table that is joined.
LITERAL = 400


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (``host/path``, verdict) that fits, as a struct of rule and verdict; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones the first listed wins.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(reversed(rules), key=lambda r: len(r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url: host labels, path parts, file ending, query keys, fragment."""
    url = F.coalesce(url, F.lit(""))
    parts = lambda prefix, found: F.transform(F.filter(found, lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return F.array_distinct(F.concat(
        parts("host:", F.split(host, r"\.")), parts("path:", F.split(path, "/")), parts("ending:", F.array(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))),
        parts("key:", F.transform(F.split(query, "&"), lambda x: F.element_at(F.split(x, "="), 1))), parts("mark:", F.array(F.regexp_extract(url, r"(?s)#(.*)$", 1))),
    ))


def frequent_tokens(labelled: DataFrame, least: float) -> DataFrame:
    """(token, n, blocked, mark, other): the tokens of at least ``least`` labelled, numbered rows; tokens of the same rows have the same marks."""
    marks = [F.xxhash64(F.lit(k), "row") for k in (1, 2)]
    each = labelled.select("label", "row", F.explode(F.array_distinct("tokens")).alias("token"))
    counts = each.groupBy("token").agg(F.count("*").alias("n"), F.sum((F.col("label") == BLOCK).cast("long")).alias("blocked"), F.bit_xor(marks[0]).alias("mark"), F.bit_xor(marks[1]).alias("other"))
    return counts.filter(F.col("n") >= least)


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, width: int | None = None) -> list[tuple[tuple[str, ...], str, float, int]]:
    """(tokens, label, confidence, count) of all rules that stay, the surest first, from rows of (tokens, label).

    A rule needs ``support`` of the rows, LEAST of them at least, with its tokens and label, and ``confidence``. One that holds another rule of its label with at
    least its confidence says nothing new and goes. Nothing else prunes, unless ``width`` limits the tokens of a rule.

    Three kinds of tokens are not mined in combinations, which changes no rule that stays: one that is quite sure of a label alone, one that all
    rows have, and all but one of those that the same rows have; rules of that one are written for each of them.
    """
    labelled = checkpoint(labelled.withColumn("row", F.monotonically_increasing_id()))
    total = labelled.count()
    support = max(support, LEAST / max(total, 1))
    if support > 1:
        return []
    # A count that is the share times the rows counts as enough, however the product is rounded.
    least = support * total * (1 - 1e-12)
    alone: list[tuple[frozenset, str, float, int]] = []
    alike: dict[tuple, list[str]] = {}
    for r in frequent_tokens(labelled, least).orderBy("token").collect():
        if r.blocked in (0, r.n) or r.n == total:
            for verdict, n in ((BLOCK, r.blocked), (ALLOW, r.n - r.blocked)):
                if n >= least and n / r.n >= confidence:
                    alone.append((frozenset([r.token]), verdict, n / r.n, n))
        else:
            alike.setdefault((r.n, r.mark, r.other), []).append(r.token)
    members = {names[0]: names for names in alike.values()}
    out = list(alone)
    if members:
        spark = labelled.sparkSession
        mined = F.broadcast(spark.createDataFrame([(t,) for t in members], "token string"))
        rows = labelled.select("label", "row", F.explode(F.array_distinct("tokens")).alias("token")).join(mined, "token")
        baskets = checkpoint(rows.groupBy("row").agg(F.concat(F.collect_list("token"), F.array(F.concat(F.lit("label:"), F.first("label")))).alias("items")).select("items"))
        found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / baskets.count()), minConfidence=confidence).fit(baskets).freqItemsets
        # Itemsets with a label against those without give the confidences.
        label = F.filter("items", lambda x: x.startswith("label:"))
        sets = found.select(F.array_sort(F.array_except("items", label)).alias("left"), F.array_join(label, "").alias("label"), "freq")
        whole = sets.filter("label = ''").select("left", F.col("freq").alias("of"))
        rules = sets.filter((F.col("label") != "") & (F.size("left") >= 1)).join(whole, "left").withColumn("confidence", F.col("freq") / F.col("of"))
        if width is not None:
            rules = rules.filter(F.size("left") <= width)
        general: dict[tuple[str, str], list[tuple[frozenset, float]]] = {}
        for row in rules.filter(F.col("confidence") >= confidence).orderBy(F.size("left"), F.desc("confidence"), F.desc("freq"), "left").toLocalIterator():
            tokens, verdict = frozenset(row.left), row.label.removeprefix("label:")
            if not any(part <= tokens and sure >= row.confidence for t in tokens for part, sure in general.get((verdict, t), ())):
                general.setdefault((verdict, min(tokens)), []).append((tokens, row.confidence))
                out += [(frozenset(names), verdict, row.confidence, row.freq) for names in itertools.product(*(members[t] for t in row.left))]
    return sorted(((tuple(sorted(tokens)), verdict, sure, n) for tokens, verdict, sure, n in out), key=lambda r: (-r[2], -r[3], len(r[0]), r[0], r[1]))


def mined_verdict(tokens: Column, rules: list[tuple[tuple[str, ...], str, float, int]], default: str) -> tuple[Column, Column]:
    """(verdict, rule tokens) of the surest mined rule whose tokens a url has all; the default and null if it meets none."""
    if not rules:
        return F.lit(default), F.lit(None).cast("string")
    postings: dict[str, list[int]] = {}
    for number, (names, *_) in enumerate(rules):
        for name in names:
            postings.setdefault(name, []).append(number)
    index = F.create_map(*[x for name, numbers in sorted(postings.items()) for x in (F.lit(name), F.array(*[F.lit(n) for n in numbers]))])
    needs = F.array(*[F.lit(len(r[0])) for r in rules])
    hits = F.flatten(F.filter(F.transform(tokens, lambda t: index[t]), lambda x: x.isNotNull()))
    met = F.filter(F.array_distinct(hits), lambda n: F.size(hits) - F.size(F.array_remove(hits, n)) == F.element_at(needs, n + 1))
    found, first = F.size(met) > 0, F.coalesce(F.array_min(met), F.lit(0))
    verdicts, texts = F.array(*[F.lit(r[1]) for r in rules]), F.array(*[F.lit(" ".join(r[0])) for r in rules])
    return F.when(found, F.element_at(verdicts, first + 1)).otherwise(F.lit(default)), F.when(found, F.element_at(texts, first + 1))


def joined_verdicts(urls: DataFrame, rules: list[tuple[tuple[str, ...], str, float, int]]) -> DataFrame:
    """(url, mined_verdict, mined_tokens) of the surest mined rule of each url that meets one, from distinct rows of (url, tokens).

    The index is a table: each rule stands under that of its tokens that the fewest rules have, and its other tokens are compared.
    """
    used = Counter(t for names, *_ in rules for t in names)
    table = [(min(names, key=lambda t: (used[t], t)), number, list(names), verdict) for number, (names, verdict, *_) in enumerate(rules)]
    index = urls.sparkSession.createDataFrame(table, "token string, number int, names array<string>, mined_verdict string")
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(F.broadcast(index), "token").filter(F.size(F.array_except("names", "tokens")) == 0)
    first = met.groupBy("url").agg(F.min("number").alias("number"))
    named = index.select("number", "mined_verdict", F.array_join("names", " ").alias("mined_tokens"))
    return first.join(F.broadcast(named), "number").drop("number")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, **mining) -> DataFrame:
    """(id, host, path, rule, verdict, mined) of every row; ``mined`` has the tokens of the mined rule that decided, if one did.

    A listed rule decides where one fits. Otherwise the surest mined rule does, and ``default`` where none is met. Mining learns from the distinct urls that
    listed rules fit, so a repeated url counts once; every such url counts.

    A null url, or one without ``://``, has an empty host and path and no tokens. Repeated rows are judged each; null ids are kept; other
    columns are not read. An empty table gives an empty result. Ties between mined rules go to more support, then to fewer tokens, then by name.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col), F.col(url_col).alias("url"), host.alias("host"), path.alias("path")).withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path")))
    labelled = rows.filter("listed is not null").select("url", "tokens", F.col("listed.verdict").alias("label")).dropDuplicates(["url"]).select("tokens", "label")
    found = mined_rules(labelled, **mining)
    open_to = F.col("listed").isNull() & (F.col("host") != "")
    if len(found) <= LITERAL:
        verdict, mined = mined_verdict(F.col("tokens"), found, default)
    else:
        rows = rows.join(joined_verdicts(rows.filter(open_to).select("url", "tokens").dropDuplicates(["url"]), found), "url", "left")
        verdict, mined = F.coalesce("mined_verdict", F.lit(default)), F.col("mined_tokens")
    return rows.select(
        F.col(id_col), "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", F.when(open_to, verdict), F.lit(default)).alias("verdict"), F.when(open_to, mined).alias("mined")
    )
