"""Regions of pages: (doc, page, region, label, box, page_height)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.functions import geometry as g

LABELS = ["text", "table", "chart", "image", "header", "footer", "other"]


def regions_of(regions: DataFrame, *labels: str) -> DataFrame:
    """Regions with one of the labels."""
    odd = set(labels) - set(LABELS)
    if odd:
        raise ValueError(f"unknown labels {sorted(odd)}")
    return regions.where(F.col("label").isin(*labels))


def overlapping(regions: DataFrame) -> DataFrame:
    """(doc, page, a, b, iou, a_contains_b) of pairs of regions on a page that overlap or contain one another; a < b."""
    one = regions.select("doc", "page", F.col("region").alias("a"), F.col("box").alias("box_a"))
    two = regions.select("doc", "page", F.col("region").alias("b"), F.col("box").alias("box_b"))
    pairs = one.join(two, ["doc", "page"]).where("a < b")
    share, inside = g.iou(F.col("box_a"), F.col("box_b")), g.contains(F.col("box_a"), F.col("box_b"))
    return pairs.select("doc", "page", "a", "b", F.round(share, 4).alias("iou"), inside.alias("a_contains_b")).where((F.col("iou") > 0) | F.col("a_contains_b"))


def suppress(regions: DataFrame, confidence: float = 0.5, overlap: float = 0.4) -> DataFrame:
    """Detected regions (doc, page, region, label, box, confidence) that stay: those of at least ``confidence`` that no surer one of their
    label on the page overlaps by more than ``overlap`` of their union; of equally sure ones the smaller region is the surer.

    A fold over a page's boxes, the surest first; a page's own regions bound its row. Other columns are joined again by the keys.
    """
    keys = ["doc", "page", "label"]
    sure = regions.where(F.col("confidence") >= confidence)
    one = F.struct((-F.col("confidence")).alias("order"), "region", "box")
    boxes = sure.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("b"))
    kind = boxes.schema["b"].dataType

    def step(kept, x):
        return F.when(F.exists(kept, lambda k: g.iou(k["box"], x["box"]) > overlap), kept).otherwise(F.concat(kept, F.array(x)))

    stay = boxes.select(*keys, F.explode(F.aggregate("b", F.array().cast(kind), step)).alias("x")).select(*keys, "x.region")
    return sure.join(stay, [*keys, "region"], "left_semi").select(*regions.columns)


def cross_page_pairs(regions: DataFrame, margin: float = 5.0, tolerance: float = 0.1) -> DataFrame:
    """(doc, page, region, next_region): a table at a page's edge and the first table like it at the top of the next page."""
    tables = regions_of(regions, "table")
    now = tables.where(g.touches_edge(F.col("box"), F.col("page_height"), margin)).select("doc", "page", "region", "box")
    top = tables.where(F.col("box.y1") <= margin).select("doc", (F.col("page") - 1).alias("page"), F.col("region").alias("next_region"), F.col("box").alias("next_box"))
    like = F.abs(g.width(F.col("box")) - g.width(F.col("next_box"))) / F.greatest(g.width(F.col("box")), F.lit(1.0)) < tolerance
    first = Window.partitionBy("doc", "page", "region").orderBy("next_region")
    return now.join(top, ["doc", "page"]).where(like).withColumn("n", F.row_number().over(first)).where("n = 1").select("doc", "page", "region", "next_region")


def page_links(regions: DataFrame, margin: float = 5.0, tolerance: float = 0.1) -> DataFrame:
    """(doc, page, region, next_region): a table that reaches its page's lower edge, and its continuation at the top of the next page.

    Like ``cross_page_pairs``, but a table at the upper edge alone goes nowhere, and each table continues one table at most: of
    several that claim it the first by region, which then have no other.
    """
    tables = regions_of(regions, "table")
    now = tables.where(F.col("box.y2") > F.col("page_height") - margin).select("doc", "page", "region", g.width(F.col("box")).alias("wide"))
    top = tables.where(F.col("box.y1") <= margin).select("doc", (F.col("page") - 1).alias("page"), F.col("region").alias("next_region"), g.width(F.col("box")).alias("next_wide"))
    like = F.abs(F.col("wide") - F.col("next_wide")) / F.greatest(F.col("wide"), F.lit(1.0)) < tolerance
    one = now.join(top, ["doc", "page"]).where(like).groupBy("doc", "page", "region").agg(F.min("next_region").alias("next_region"))
    return one.groupBy("doc", "page", "next_region").agg(F.min("region").alias("region")).select("doc", "page", "region", "next_region")


def _follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a document, in the order of their pages, to the members of its chains: each link is looked at once."""
    for batch in batches:
        docs, links = batch.column(0), batch.column(1)
        sizes = np.diff(links.offsets.to_numpy())
        flat = links.flatten()
        page, region, following = (flat.field(i).to_pylist() for i in range(3))
        out: list[tuple] = []
        at = 0
        for d, n in enumerate(sizes):
            chain_of: dict[tuple, list[tuple]] = {}
            chains = []
            for i in range(at, at + n):
                chain = chain_of.pop((page[i], region[i]), None)
                if chain is None:
                    chain = [(page[i], region[i])]
                    chains.append(chain)
                chain.append((page[i] + 1, following[i]))
                chain_of[page[i] + 1, following[i]] = chain
            at += n
            out += [(d, *node, *chain[0], k, len(chain)) for chain in chains for k, node in enumerate(chain)]
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = (flat.field(0).type, flat.field(1).type, flat.field(0).type, flat.field(1).type, pa.int32(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [docs.take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))],
            names=["doc", "page", "region", "chain_page", "chain_region", "fragment", "n_fragments"],
        )


def table_chains(regions: DataFrame, margin: float = 5.0, tolerance: float = 0.1) -> DataFrame:
    """(doc, page, region, chain_page, chain_region, fragment, n_fragments) of every table region.

    A chain is a table that goes on over pages, named by its first region; a table that stays on its page is a chain of one. The
    links of a document, three values for each page that a table crosses, meet in one row.
    """
    links = page_links(regions, margin, tolerance)
    met = links.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "region", "next_region"))).alias("links"))
    kind = {f.name: f.dataType for f in links.schema}
    made = T.StructType([T.StructField(n, kind[k]) for n, k in (("doc", "doc"), ("page", "page"), ("region", "region"), ("chain_page", "page"), ("chain_region", "region"))])
    members = met.mapInArrow(_follow, made.add("fragment", T.IntegerType()).add("n_fragments", T.IntegerType()))
    alone = regions_of(regions, "table").select("doc", "page", "region")
    return alone.join(members, ["doc", "page", "region"], "left").select(
        "doc", "page", "region", F.coalesce("chain_page", "page").alias("chain_page"), F.coalesce("chain_region", "region").alias("chain_region"),
        F.coalesce("fragment", F.lit(0)).alias("fragment"), F.coalesce("n_fragments", F.lit(1)).alias("n_fragments"),
    )


def captions(regions: DataFrame, radius: float = 20.0) -> DataFrame:
    """(doc, page, region, caption) of charts: the text of the nearest region that ends above them within ``radius``."""
    charts = regions_of(regions, "chart").select("doc", "page", "region", F.col("box.y1").alias("top"))
    texts = regions_of(regions, "text").select("doc", "page", F.col("box.y2").alias("end"), F.col("region").alias("from"), "text")
    near = charts.join(texts, ["doc", "page"]).where((F.col("end") > F.greatest(F.lit(0.0), F.col("top") - radius)) & (F.col("end") < F.col("top")))
    best = near.groupBy("doc", "page", "region").agg(F.max_by("text", F.struct("end", -F.col("from"))).alias("caption"))
    return charts.join(best, ["doc", "page", "region"], "left").select("doc", "page", "region", F.coalesce("caption", F.lit("")).alias("caption"))


def merge_boxes(regions: DataFrame, *keys: str) -> DataFrame:
    """The box around all boxes of a group."""
    return regions.groupBy(*keys).agg(F.min("box.x1").alias("x1"), F.min("box.y1").alias("y1"), F.max("box.x2").alias("x2"), F.max("box.y2").alias("y2"))
