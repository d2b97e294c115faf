"""Runs of words that repeat with a period, by a suffix automaton with link-cut access.

A run is a stretch of words with smallest period ``q`` that holds at least ``exponent`` periods and ``least`` words and that no
neighbouring word extends. The suffix links of the automaton of a text form a tree; the way from the root to the
state of a prefix holds all its endings. Words are taken in order, and the way of each is accessed in a link-cut tree
and takes the word's number as its colour: the last place where the endings on it stood. The way falls into segments of one
older colour. Where the deepest ending of a segment is L words long and its last end d words back, L + d words up to here have
period d; with L at least d they hold a square, and L words is all that both ends have in common, so the stretch begins there. It is
then followed to its end.

Text that can hold no run stays out of the automaton: after its first period, each word of a run has stood at most q words before,
for at least (exponent - 1) * q words on end. Stretches of such words are found for all texts of a batch at once, for
periods from 2 ** k to 2 ** (k + 1) together, and no run leaves the stretch that it is found by.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from backflow.llm.common import slices

EXPONENT = 4
LEAST = 6
#: Words of one text, as Spark's patterns have it.
WORD = r"[^\x20\x09-\x0D]+"


class SuffixAutomaton:
    """States of the endings of ``words``. The first step out of a state lies in flat arrays, further ones in a map."""

    def __init__(self, words: list[int]):
        self.length, self.link = array("i", [0]), array("i", [-1])
        self.word, self.to = array("i", [-1]), array("i", [-1])
        self.more: dict[int, dict[int, int]] = {}
        self.prefix = array("i")
        last = 0
        for w in words:
            last = self._append(last, w)
            self.prefix.append(last)

    def _state(self, length: int, link: int, word: int = -1, to: int = -1) -> int:
        self.length.append(length)
        self.link.append(link)
        self.word.append(word)
        self.to.append(to)
        return len(self.link) - 1

    def _append(self, last: int, w: int) -> int:
        length, link, word, to, more = self.length, self.link, self.word, self.to, self.more
        new = self._state(length[last] + 1, 0)
        p = last
        while p >= 0:
            if word[p] == w:
                break
            if word[p] < 0:
                word[p], to[p] = w, new
            else:
                steps = more.get(p)
                if steps is None:
                    more[p] = {w: new}
                elif w in steps:
                    break
                else:
                    steps[w] = new
            p = link[p]
        if p < 0:
            return new
        q = to[p] if word[p] == w else more[p][w]
        if length[q] == length[p] + 1:
            link[new] = q
            return new
        copy = self._state(length[p] + 1, link[q], word[q], to[q])
        if q in more:
            more[copy] = dict(more[q])
        while p >= 0:
            if word[p] == w:
                if to[p] != q:
                    break
                to[p] = copy
            elif more.get(p, {}).get(w) == q:
                more[p][w] = copy
            else:
                break
            p = link[p]
        link[q] = link[new] = copy
        return new


class LastEnds:
    """A link-cut tree over the suffix links. Each preferred path is a splay tree by depth with one colour, kept at its root.

    Nodes are states plus one; 0 is none.
    """

    def __init__(self, link: array, length: array):
        self.up = array("i", [0]) + array("i", [x + 1 for x in link])
        self.left, self.right, self.colour = (array("i", bytes(4 * len(self.up))) for _ in range(3))
        self.length = length

    def _rotate(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y], up[x] = x, z
        if z and left[z] == y:
            left[z] = x
        elif z and right[z] == y:
            right[z] = x
        else:
            self.colour[x] = self.colour[y]

    def _splay(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                self._rotate(y if (left[y] == x) == (left[z] == y) else x)
            self._rotate(x)

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the way from the root to ``state``; (old colour, length of the deepest ending) of each of its segments."""
        found = []
        up, right, colours = self.up, self.right, self.colour
        below, x = 0, state + 1
        while x:
            self._splay(x)
            old = colours[x]
            if old:
                found.append((old, self.length[x - 1]))
            r = right[x]
            if r:
                colours[r] = old
            right[x] = below
            below, x = x, up[x]
        colours[below] = colour
        return found


def runs_of(words: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``words``, by start and period. ``exponent`` is 3 at least."""
    automaton = SuffixAutomaton(words)
    ends = LastEnds(automaton.link, automaton.length)
    known: dict[int, int] = {}
    out = []
    for at, state in enumerate(automaton.prefix, 1):
        for end, length in ends.access(state, at):
            period = at - end
            if length < (exponent - 1) * period or length + period < least or known.get(period, 0) >= at:
                continue
            stop = at
            while stop < len(words) and words[stop] == words[stop - period]:
                stop += 1
            known[period] = stop
            start = end - length
            out.append((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def candidate_stretches(gaps: np.ndarray, longest: int, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches (begin, end) outside of which no run lies. ``gaps``: words since the same word stood before in the text, very large if never."""
    found = []
    period = 1
    while exponent * period <= longest:
        edges = np.diff(np.concatenate([[0], (gaps < 2 * period).view(np.int8), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        # A run of period q from this range has (exponent - 1) * q such words at least, and `least` words in all.
        long = end - begin >= max((exponent - 1) * period, least - 2 * period + 1)
        found += zip((begin[long] - (2 * period - 1)).tolist(), end[long].tolist())
        period *= 2
    merged: list[tuple[int, int]] = []
    for begin, end in sorted(found):
        if merged and begin <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        else:
            merged.append((begin, end))
    return merged


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, and the bounds of each text's words."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values, bounds = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    full = pc.binary_length(values).to_numpy(zero_copy_only=False) > 0
    return values.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[bounds]


def _batch(batch: pa.RecordBatch, names: list[str], exponent: int, least: int) -> pa.RecordBatch:
    values, bounds = _split(batch.column(1))
    total, rows = len(values), len(batch)
    sizes = np.diff(bounds)
    ids = values.dictionary_encode().indices.to_numpy().astype(np.int64)
    text_of = np.repeat(np.arange(rows), sizes)
    order = np.argsort(text_of * (int(ids.max(initial=0)) + 1) + ids, kind="stable")
    same = (ids[order[1:]] == ids[order[:-1]]) & (text_of[order[1:]] == text_of[order[:-1]])
    gaps = np.full(total, total + 1, dtype=np.int64)
    gaps[order[1:][same]] = (order[1:] - order[:-1])[same]
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
    dropped = np.zeros(total + 1, dtype=np.int64)
    for begin, end in candidate_stretches(gaps, int(sizes.max(initial=0)), exponent, least):
        # A stretch may begin before its text, since the first period is added to it, and so join that of the text before.
        first, last = text_of[max(begin, 0)], text_of[end - 1]
        for k in range(first, last + 1):
            low, high = max(begin, bounds[k]), min(end, bounds[k + 1])
            for start, length, period in runs_of(ids[low:high].tolist(), exponent, least):
                found[k].append((int(low - bounds[k]) + start, length, period))
                dropped[low + start + period] += 1
                dropped[low + start + length] -= 1
    kept = np.cumsum(dropped[:-1]) == 0
    new_bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(new_bounds, pa.int32()), values.filter(pa.array(kept))), " ")
    flat = [r for runs in found for r in runs]
    columns = np.array(flat, dtype=np.int64).reshape(-1, 3)
    runs = pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum([len(r) for r in found])]), pa.int32()),
        pa.StructArray.from_arrays([pa.array(columns[:, k]) for k in range(3)], names=["start", "length", "period"]),
    )
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), runs, texts], names=names)


def word_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """Runs of every whole text, and the text without what they repeat: (id, n_words, runs, collapsed).

    Words are what ASCII white space parts. ``runs`` are structs of start (word number from 0), length and period in
    words, by start, then period. ``collapsed`` holds the words that no run contains after its first period, joined by one space.
    One row per input row; repeats stay. A null text counts as empty: no words, no runs, empty text. A null id stays null.
    Other columns are not read. An empty table gives an empty result.

    A task holds the words of one slice of a batch, and the automaton of one stretch of one text at a time.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not told apart by their last ends")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 300):
            yield _batch(batch, [id_col, "n_words", "runs", "collapsed"], exponent, least)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(
        find, f"`{id_col}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )


def best_run(runs: Column) -> Column:
    """The run with the most periods, the first of several; null without a run."""
    return F.aggregate(
        runs, F.lit(None).cast("struct<start: long, length: long, period: long>"),
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of every tenth id, by its checksum, made periodic from some word on.

    With h the CRC-32 of the decimal id and g = h // 10: where h % 10 = 0, each word i >= a = g % n of the n words becomes word
    a + (i - a) % p, p = 1 + (n - a) // (3 + g % 8). Rows without id or words stay.
    """
    h = F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary"))
    words = docs.withColumn("_h", h).withColumn("_words", F.when(F.col("_h") % 10 == 0, F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(WORD), 0)))
    shaped = words.withColumns({"_n": F.size("_words").cast("long"), "_g": F.floor(F.col("_h") / 10)})
    shaped = shaped.withColumn("_a", F.expr("CASE WHEN _n > 0 THEN _g % _n END")).withColumn("_p", F.expr("1 + (_n - _a) DIV (3 + _g % 8)"))
    cycle = "flatten(array_repeat(slice(_words, int(_a + 1), int(_p)), int((_n - _a) DIV _p + 1)))"
    built = F.expr(f"array_join(concat(slice(_words, 1, int(_a)), slice({cycle}, 1, int(_n - _a))), ' ')")
    return shaped.withColumn(text_col, F.when(F.col("_a").isNotNull(), built).otherwise(F.col(f"`{text_col}`"))).drop("_h", "_words", "_n", "_g", "_a", "_p")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The result of :func:`word_runs` in figures and digests."""
    best = best_run(F.col("runs"))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    marked = found.withColumn("_best", best)
    return marked.select(
        F.col(f"`{id_col}`"), F.size("runs").cast("long").alias("n_runs"), F.col("_best.start"), F.col("_best.length"), F.col("_best.period"),
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"),
        F.sha2(F.concat(listed, F.when(F.size("runs") > 0, "\n").otherwise("")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def oracle(crc32: str) -> str:
    """The SQL of the registered query; ``crc32`` is the SQL of a checksum of a hexadecimal string named ``hexed``.

    Every pair of equal words at a distance of up to a quarter of the text; stretches of consecutive pairs with one distance.
    """
    return rf"""WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w, hex(encode(CAST(doc_id AS VARCHAR))) AS hexed FROM documents),
 drawn AS (SELECT doc_id, w, len(w) AS n, {crc32} AS h, h // 10 AS g, CASE WHEN len(w) > 0 THEN g % len(w) END AS a, 1 + (len(w) - a) // (3 + g % 8) AS p FROM texts),
 rebuilt AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) ELSE w END AS w FROM drawn),
 spots AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS word FROM rebuilt WHERE n > 0),
 pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM spots x JOIN spots y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i WHERE 4 * (y.i - x.i) <= x.n),
 islands AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS m FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs) GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
 runs AS (SELECT * FROM islands r WHERE NOT EXISTS (SELECT 1 FROM islands o WHERE o.doc_id = r.doc_id AND o.q < r.q AND o.s <= r.s AND o.s + o.m >= r.s + r.m)),
 listed AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || m || ',' || q || chr(10), '' ORDER BY s, q)) AS digest FROM runs GROUP BY doc_id),
 best AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.m * r.q > r.m * o.q OR (o.m * r.q = r.m * o.q AND (o.s, o.q) < (r.s, r.q))))),
 gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + m)) AS i FROM runs),
 left_over AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS digest FROM spots ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
 SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, m AS length, q AS period, 1000 * m // q AS exponent_milli, coalesce(l.digest, sha256('')) AS runs_sha256, coalesce(o.digest, sha256('')) AS collapsed_sha256
 FROM texts t LEFT JOIN listed l ON l.doc_id = t.doc_id LEFT JOIN best b ON b.doc_id = t.doc_id LEFT JOIN left_over o ON o.doc_id = t.doc_id"""
