"""Secret scan by a trigram inverted index, in DataFrame functions alone.

Each rule's regex implies a Boolean query over trigrams, derived from its parsed form (``regexterms``): some alternative's literals must occur, so all trigrams of
that alternative must. The index holds the postings of these trigrams only, over lower-cased whole texts. Postings
are intersected per alternative; a document that meets one of a rule's alternatives is a candidate, and only
candidates are searched with the rule's regex. A rule that no trigram is mandatory for is searched everywhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from backflow.llm.regexterms import mandatory


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


#: The patterns of the three base kinds, and public formats of common credentials.
RULES = (
    Rule(
        "assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2, least=8,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}", least=32),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", base=False),
)


def queries(rules: tuple[Rule, ...] = RULES) -> dict[int, list[tuple[str, ...]]]:
    """Per rule number, its alternatives as trigram conjunctions; rules that no trigram is mandatory for are left out."""
    found = {number: mandatory(rule.pattern) for number, rule in enumerate(rules)}
    return {number: alternatives for number, alternatives in found.items() if alternatives}


def _with(value: Column, use) -> Column:
    """``use(value)`` where ``value`` is worked out once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def postings(docs: DataFrame, grams: list[str], id_col: str, text_col: str) -> DataFrame:
    """(id, gram): the documents that hold each of ``grams``."""
    held = _with(F.lower(F.col(text_col)), lambda low: F.filter(F.lit(grams), lambda g: F.contains(low, g)))
    return docs.select(F.col(id_col).alias("id"), F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """(id, rules): numbers of the rules one of whose alternatives has all its trigrams in a document of that id."""
    terms = [(f"{number}/{k}", number, len(grams), list(grams)) for number, found in queries(rules).items() for k, grams in enumerate(found)]
    needed = sorted({g for *_, grams in terms for g in grams})
    # gram -> the alternatives it belongs to; as many entries as the rules have trigrams.
    by_gram = F.create_map(*[x for g in needed for x in (F.lit(g), F.array(*[F.struct(F.lit(a).alias("a"), F.lit(r).alias("rule"), F.lit(n).alias("n")) for a, r, n, grams in terms if g in grams]))])
    found = postings(docs, needed, id_col, text_col).distinct().select("id", F.explode(by_gram[F.col("gram")]).alias("term"))
    met = found.groupBy("id", "term").agg(F.count("*").alias("held")).filter("held = term.n")
    return met.groupBy("id").agg(F.collect_set("term.rule").alias("rules"))


def _running(values: Column, start: Column, add) -> Column:
    """``start`` and what ``add`` makes of it and the values so far, before each value of an array.

    An array that grows by one is copied each time, so values go by blocks of about the square root of their number: first what each block adds to
    what is before it, then the values of each block.
    """

    def before(part: Column, begin: Column) -> Column:
        empty = F.filter(F.array(begin), lambda x: F.lit(False))
        step = lambda state, x: F.struct(add(state["at"], x).alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))
        return F.aggregate(part, F.struct(begin.alias("at"), empty.alias("out")), step, lambda state: state["out"])

    def blocked(values: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(values))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(values) - 1) / width).cast("int")), lambda k: F.slice(values, k * width + 1, width))

        def joined(blocks: Column) -> Column:
            whole = F.transform(blocks, lambda block: F.aggregate(block, start, add))
            return F.flatten(F.zip_with(blocks, before(whole, start), before))

        return F.when(F.size(values) < 64, before(values, start)).otherwise(_with(blocks, joined))

    return _with(values, blocked)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """All matches of a rule in a text, leftmost and not overlapping, as structs of start, order, end (code points).

    Splitting at the regex gives the texts between the matches, which with the matches' own lengths give the places.
    """
    lengths = lambda parts: F.transform(parts, F.char_length)
    found = F.struct(
        lengths(F.split(text, rule.pattern, -1)).alias("gaps"), lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias("sizes"),
        *([lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).alias("judged")] if rule.group else []),
    )
    kind = "array<struct<start:int,order:int,end:int>>"

    def placed(m: Column) -> Column:
        judged = m["judged"] if rule.group else m["sizes"]
        both = F.zip_with(F.slice(m["gaps"], 1, F.size(m["sizes"])), m["sizes"], lambda gap, size: gap + size)
        rows = F.arrays_zip(_running(both, F.lit(0), lambda at, x: at + x).alias("at"), m["gaps"].alias("gap"), m["sizes"].alias("size"), judged.alias("judged"))
        kept = F.filter(F.slice(rows, 1, F.size(m["sizes"])), lambda row: row["judged"] >= rule.least)
        return F.transform(kept, lambda row: F.struct((row["at"] + row["gap"]).alias("start"), F.lit(order).alias("order"), (row["at"] + row["gap"] + row["size"]).alias("end")))

    return F.when(text.rlike(rule.pattern), _with(found, placed)).otherwise(F.array().cast(kind))


def found_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``_found``: the matches of all rules as an array of (start, order, end), sorted.

    Places count code points of the whole text, the end exclusive; order is the rule's number. A null text has no match. Rows
    that share an id share their candidate rules, which then hold for either text; the regex decides. Null ids are joined
    as equal. Repeated rows are searched each. A column named ``_found`` in ``docs`` is replaced.
    An empty table gives an empty result.
    """
    indexed = queries(rules)
    wanted = candidates(docs, rules, id_col, text_col).select(F.col("id").alias("_secret_id"), F.col("rules").alias("_secret_rules"))
    rows = docs.join(wanted.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col("_secret_id")), "left")
    none = F.array().cast("array<struct<start:int,order:int,end:int>>")
    parts = []
    for number, rule in enumerate(rules):
        spans = _spans(F.coalesce(F.col(text_col), F.lit("")), rule, number)
        parts.append(F.when(F.array_contains("_secret_rules", number), spans).otherwise(none) if number in indexed else spans)
    return rows.withColumn("_found", F.array_sort(F.concat(*parts))).drop("_secret_id", "_secret_rules")


def digest(found: Column, rules: tuple[Rule, ...], base: bool) -> Column:
    """kind:start:end of the matches by start, then rule, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    picked = F.filter(found, lambda s: s["order"].isin([k for k, r in enumerate(rules) if r.base])) if base else found
    return F.array_join(F.transform(picked, lambda s: F.concat_ws(":", F.element_at(kinds, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of each base kind, base_sha256, spans) of every row."""
    found = found_secrets(docs.select(id_col, text_col), rules, id_col, text_col).select(id_col, F.col("_found").alias("found"))
    of = F.transform("found", lambda s: s["order"])
    counts = [(F.size(of) - F.size(F.array_remove(of, k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base]
    return found.select(id_col, *counts, F.sha2(digest(F.col("found"), rules, True).cast("binary"), 256).alias("base_sha256"), digest(F.col("found"), rules, False).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every match replaced by ``mark``; overlapping matches count as one. Texts without a match, null among them, stay as they are."""
    rows = found_secrets(docs, rules, id_col, text_col)
    changed = F.when(F.size("_found") > 0, _with(F.struct(F.col(text_col).alias("text"), F.col("_found").alias("found")), lambda row: _marked(row["text"], row["found"], mark))).otherwise(F.col(text_col))
    return rows.withColumn(text_col, changed).select(*[F.col(f"`{c}`") for c in docs.columns])


def _marked(text: Column, found: Column, mark: str) -> Column:
    """The text with a mark in place of each stretch of ``found``, which is sorted.

    A place in a text is found by counting from its start, so the pieces are taken from cuts of the text, short enough for
    many matches and long enough for few.
    """
    covered = _running(F.transform(found, lambda s: s["end"]), F.lit(0), lambda at, end: F.greatest(at, end))
    spans = F.arrays_zip(covered.alias("at"), F.transform(found, lambda s: s["start"]).alias("start"))
    # A match that begins before the last one ended only moves the end on.
    apart = F.filter(spans, lambda s: s["start"] >= s["at"])
    end, length = F.array_max(F.transform(found, lambda s: s["end"])), F.char_length(text)
    width = F.greatest(F.lit(256), (length / F.sqrt(F.size(found))).cast("int"))
    known = F.struct(text.alias("text"), width.alias("width"), F.concat(apart, F.array(F.struct(end.alias("at"), length.alias("start")))).alias("gaps"))

    def cut(row: Column) -> Column:
        cuts = F.transform(F.sequence(F.lit(0), ((F.char_length(row["text"]) - 1) / row["width"]).cast("int")), lambda k: F.substr(row["text"], k * row["width"] + 1, row["width"]))
        return F.struct(cuts.alias("cuts"), row["width"].alias("width"), row["gaps"].alias("gaps"))

    def joined(row: Column) -> Column:
        width = row["width"]

        def piece(gap: Column) -> Column:
            def within(k: Column) -> Column:
                begin = F.greatest(gap["at"] - k * width, F.lit(0))
                return F.substr(F.get(row["cuts"], k), begin + 1, F.least(gap["start"] - k * width, width) - begin)

            some = F.sequence((gap["at"] / width).cast("int"), ((gap["start"] - 1) / width).cast("int"))
            return F.when(gap["start"] > gap["at"], F.array_join(F.transform(some, within), "")).otherwise("")

        return F.array_join(F.transform(row["gaps"], piece), mark)

    return _with(_with(known, cut), joined)


def _spelled(pattern: str) -> str:
    """The pattern with both cases of its case-blind letters written out, since engines differ on letters beyond ASCII."""
    return re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern)


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same digests in DuckDB, from all regexes on all texts."""
    parts = []
    for number, rule in enumerate(rules):
        p = _spelled(rule.pattern).replace("'", "''")
        judged = f"regexp_extract_all(t, '{p}', {rule.group})"
        parts.append(f"""SELECT doc_id, {number} AS ord, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base, m.s AS s, m.e AS e FROM (
          SELECT doc_id, unnest(list_transform(range(1, len(w) + 1), lambda i: {{'s': list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: len(x))), 0),
            'e': list_sum(list_transform(g[1:i], lambda x: len(x))) + list_sum(list_transform(w[1:i], lambda x: len(x))), 'n': len(j[i])}})) AS m
          FROM (SELECT doc_id, regexp_extract_all(t, '{p}', 0) AS w, {judged} AS j, string_split_regex(t, '{p}') AS g FROM docs WHERE regexp_matches(t, '{p}'))) WHERE m.n >= {rule.least}""")
    counts = ", ".join(f"CAST(coalesce(n_{r.kind}, 0) AS BIGINT) AS n_{r.kind}" for r in rules if r.base)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules if r.base)
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({' UNION ALL '.join(parts)}),
      per AS (SELECT doc_id, {sums}, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) FILTER (base) AS b,
        string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, ord) AS a FROM found GROUP BY doc_id)
      SELECT docs.doc_id, {counts}, sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM docs LEFT JOIN per ON docs.doc_id = per.doc_id"""
