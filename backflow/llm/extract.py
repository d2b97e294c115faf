"""Main text of web pages by wrapper induction over the pages of a host.

Each page gives a skeleton (its block elements, by tag and class words) and the text blocks of its article. The most frequent skeleton of a host is
its reference; the other skeletons are aligned with it by simple tree matching, so that nodes at one place of the
wrapper have one slot number. A text that stands in the same slot in half of the host's different articles that have the
slot, or in half of those with one skeleton, is template and goes from this slot; what varies is content. Elements that by their kind or name are menus, footers, adverts and so on are
never content.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from backflow.llm.common import checkpoint, fewer, slices, stored, texts_of
from backflow.llm.dom import Page, shapes, tree_match, ways
from backflow.llm.urlrules import host_of

#: A text is template in a slot if at least this many, and this share, of the different articles with the slot have it there.
LEAST_PAGES = 4
SHARE = 0.5
DEEPEST = 200_000
# Without an article or main element, a block that is mostly links is a menu.
LINKED = 0.5


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def content_blocks(html: str) -> tuple[Page, list]:
    page = Page(html)
    return page, page.blocks if page.marked else [b for b in page.blocks if b.linked <= LINKED]


def _page_key(host: str | None, html: str) -> int:
    """Names a page of a host: one html can be served by several hosts, each with a template of its own."""
    return _hash(f"{host or ''} {html}")


def _outlines(pages: DataFrame) -> DataFrame:
    """(page, host, skeleton, body, nodes, texts, layout): hash of the page and its host, and per block its node and the hash of its text."""

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for host, html in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))):
                page, blocks = content_blocks(html)
                texts = [_hash(b.text) for b in blocks]
                rows.append((_page_key(host, html), page.skeleton, _hash(" ".join(map(str, texts))), [b.node for b in blocks], texts))
            page, skeleton, body, nodes, texts = zip(*rows) if rows else ((),) * 5
            arrays = [pa.array(page, pa.int64()), batch.column(0), pa.array(skeleton, pa.string()), pa.array(body, pa.int64()), pa.array(nodes, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["page", "host", "skeleton", "body", "nodes", "texts"])

    out = pages.select("host", "html").mapInArrow(outline, "page long, host string, skeleton string, body long, nodes array<int>, texts array<long>")
    return out.withColumn("layout", F.xxhash64("host", "skeleton"))


def slots_of(skeleton: str, reference: str) -> list[int]:
    """The slot of each node of a skeleton: the number of the reference's node that it is aligned with.

    A node that the reference lacks has a slot named by its way from the nearest aligned node, so that like places of the
    host's other layouts are one slot, and unlike ones are not.
    """
    if skeleton == reference:
        return list(range(len(ways(skeleton))))
    matched = dict(tree_match(shapes(skeleton), shapes(reference))[1])
    slots: list[int] = []
    for k, (parent, label, place) in enumerate(ways(skeleton)):
        way = f"{slots[parent] if parent >= 0 else -1} {label} {place}"
        slots.append(matched.get(k, -2 - (_hash(way) & (1 << 62) - 1)))
    return slots


def _slots(outlines: DataFrame) -> DataFrame:
    """(layout, node, place): for each layout, that is skeleton of a host, the place of each node, one hash for a slot of a host."""
    kinds = outlines.filter("host <> ''").groupBy("host", "skeleton", "layout").agg(F.count("*").alias("n"))
    reference = kinds.groupBy("host").agg(F.max(F.struct("n", "skeleton"))["skeleton"].alias("reference"))
    pairs = kinds.join(reference, "host").select("host", "layout", "skeleton", "reference")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))  # trees are matched level by level
        for batch in batches:
            slots = [slots_of(*x) for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.list_(pa.int64()))], names=["host", "layout", "slots"])

    aligned = pairs.mapInArrow(align, "host string, layout long, slots array<long>")
    return aligned.select("layout", F.transform("slots", lambda s: F.xxhash64("host", s)).alias("places"))


def template_blocks(pages: DataFrame, least: int = LEAST_PAGES, share: float = SHARE) -> DataFrame:
    """(page, template): for pages that have any, node and text hash of their blocks that are template, from rows of (host, html).

    A text is template at a node if enough of the different articles that have the node's slot hold it there: of those with
    one layout, or of those of all layouts that are aligned at this slot.
    """
    outlines = stored(_outlines(pages))
    slots = checkpoint(_slots(outlines))
    # Pages with the same blocks count as one article, so that copies do not make a text template.
    articles = outlines.filter("host <> '' and size(texts) > 0").groupBy("host", "body").agg(F.min(F.struct("layout", "nodes", "texts")).alias("least")).select("least.*")
    placed = articles.join(slots, "layout")
    weights = articles.groupBy("layout").agg(F.count("*").alias("articles"))
    nodes = checkpoint(slots.join(weights, "layout").select("layout", "articles", F.posexplode("places").alias("node", "place")))
    at = F.explode(F.array_distinct(F.arrays_zip(F.col("nodes").alias("node"), F.transform("nodes", lambda k: F.element_at("places", k + 1)).alias("place"), F.col("texts").alias("text")))).alias("at")
    held = placed.select("layout", at).select("layout", "at.*")
    enough = (F.col("n") >= least) & (F.col("n") >= share * F.col("articles"))
    in_layout = held.groupBy("layout", "node", "text").agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(nodes.filter("node = 0").select("layout", "articles"), "layout").filter(enough)
    having = nodes.groupBy("place").agg(F.sum("articles").alias("articles"))
    in_slot = held.groupBy("place", "text").agg(F.count("*").alias("n")).filter(F.col("n") >= least).join(having, "place").filter(enough)
    constant = in_layout.select("layout", "node", "text").union(in_slot.join(nodes, "place").select("layout", "node", "text"))
    # A layout has at most 2 / share times an article's blocks of these.
    by_layout = constant.groupBy("layout").agg(F.collect_set(F.struct("node", "text")).alias("constant"))
    blocks = F.arrays_zip(F.col("nodes").alias("node"), F.col("texts").alias("text"))
    found = outlines.select("page", "layout", "nodes", "texts").join(by_layout, "layout").select("page", F.array_intersect(blocks, "constant").alias("template"))
    return found.filter(F.size("template") > 0).dropDuplicates(["page"])


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **induction) -> DataFrame:
    """(id, url, text, n_chars) of every row: the blocks of the main text in page order, joined by two line ends.

    Character references are decoded, white space inside a block becomes one space. A page with an article or main element has its main text there,
    any other page in its body. A null or empty page has an empty text. A null url, or one without host, leaves only the element kinds and
    names to tell what is content. Repeated rows are answered each; null ids are kept; other columns are not
    read. An empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    found = template_blocks(rows.select("host", "html"), **induction)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            pages_of, nodes, texts = [], [], []
            for host, html in zip(batch.column(2).to_pylist(), texts_of(batch.column(3))):
                _, blocks = content_blocks(html)
                pages_of.append(_page_key(host, html))
                nodes.append([b.node for b in blocks])
                texts.append([b.text for b in blocks])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pages_of, pa.int64()), pa.array(nodes, pa.list_(pa.int32())), pa.array(texts, pa.list_(pa.string()))], names=["id", "url", "page", "nodes", "blocks"])

    kind = pages.schema[id_col].dataType.simpleString()
    blocks = rows.select("id", "url", "host", "html").mapInArrow(hashes, f"id {kind}, url string, page long, nodes array<int>, blocks array<string>")
    joined = blocks.join(found.hint("shuffle_hash"), "page", "left")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for nodes, parts, template in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                gone = {(x["node"], x["text"]) for x in template or ()}
                texts.append("\n\n".join(p for node, p in zip(nodes, parts) if not gone or (node, _hash(p)) not in gone))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    return fewer(joined).select("id", "url", "nodes", "blocks", "template").mapInArrow(written, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col)
