"""Headings, paragraphs and chunks of page text, all inside a row: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.functions.text import clean_paragraph, continued, count_spaced, count_tokens, level_of_line, strip, strip_marks

#: Private characters that mark block ends and headings inside a row's text; where a text has them itself, they are written with a third.
_CUT, _HEAD, _OWN = "\ue000", "\ue001", "\ue002"


def _escaped(text: Column) -> Column:
    """The text without the marks' characters."""
    plain = text
    for i, c in enumerate((_OWN, _CUT, _HEAD)):
        plain = F.replace(plain, F.lit(c), F.lit(f"{_OWN}{i}"))
    return F.when(text.rlike(f"[{_CUT}{_HEAD}{_OWN}]"), plain).otherwise(text)


def _unescaped(text: Column) -> Column:
    plain = text
    for i, c in reversed([*enumerate((_OWN, _CUT, _HEAD))]):
        plain = F.replace(plain, F.lit(f"{_OWN}{i}"), F.lit(c))
    return F.when(text.contains(_OWN), plain).otherwise(text)


def _sections(regions: DataFrame, text: str) -> DataFrame:
    """``regions`` with _sections, array<struct<first, path, part: array<struct<level, line>>>>, in place of the text.

    A section is a heading with the paragraphs up to the next one; the first may have none. ``first`` is its first block's place. Each value is
    made once and handed to the function after it, and blocks are cut, not gathered one by one, so that work grows with the text's length.
    """
    others = [c for c in regions.columns if c != text]

    def mark(line: Column) -> Column:
        s, level = line["s"], line["level"]
        return F.when(s == "", _CUT).when(level.isNotNull(), F.concat(F.lit(_CUT + _HEAD), level.cast("string"), F.lit(_HEAD), s, F.lit(_CUT))).otherwise(continued(s))

    lines = F.transform(F.split(_escaped(F.coalesce(F.col(text), F.lit(""))), "\n"), strip)
    leveled = F.transform(lines, lambda s: F.struct(s.alias("s"), level_of_line(s).alias("level")))
    marked = F.array_join(F.transform(leveled, mark), "\n")
    pieces = F.filter(F.split(marked, f"\n?{_CUT}\n?"), lambda p: p != "")

    def block(p: Column) -> Column:
        heading = p.startswith(_HEAD)
        level = F.when(heading, F.split_part(p, F.lit(_HEAD), F.lit(2)).try_cast("int"))
        return F.struct(level.alias("level"), F.when(heading, F.split_part(p, F.lit(_HEAD), F.lit(3))).otherwise(clean_paragraph(p)).alias("line"))

    plain = F.transform(F.transform(pieces, block), lambda b: F.struct(b["level"].alias("level"), _unescaped(b["line"]).alias("line")))
    made = regions.select(*others, F.filter(plain, lambda b: b["level"].isNotNull() | (F.length(b["line"]) >= 3)).alias("_blocks"))
    path_type = "struct<path:array<string>,paths:array<array<string>>>"
    start = F.struct(F.array().cast("array<string>").alias("path"), F.array().cast("array<array<string>>").alias("paths")).cast(path_type)

    def step(state: Column, b: Column) -> Column:
        path = F.concat(F.slice(state["path"], F.lit(1), b["level"] - 1), F.array(b["line"]))
        return F.struct(path.alias("path"), F.concat(state["paths"], F.array(path)).alias("paths")).cast(path_type)

    paths = F.aggregate(F.filter("_blocks", lambda b: b["level"].isNotNull()), start, step, lambda s: s["paths"])
    starts = F.filter(F.transform("_blocks", lambda b, i: F.when(b["level"].isNotNull(), i)), lambda i: i.isNotNull())
    placed = made.select(*others, "_blocks", starts.alias("_starts"), F.concat(F.array(F.array().cast("array<string>")), paths).alias("_paths"))
    ends = F.concat("_starts", F.array(F.size("_blocks")))
    spans = F.zip_with(F.concat(F.array(F.lit(0)), "_starts"), F.zip_with(ends, "_paths", lambda b, p: F.struct(b.alias("end"), p.alias("path"))), lambda a, x: F.struct(a.alias("first"), x["end"].alias("end"), x["path"].alias("path")))
    cut = F.transform(
        F.filter(spans, lambda z: z["end"] > z["first"]), lambda z: F.struct(z["first"].alias("first"), z["path"].alias("path"), F.slice(F.col("_blocks"), z["first"] + 1, z["end"] - z["first"]).alias("part"))
    )
    return placed.select(*others, cut.alias("_sections"))


def _raw(level: Column, line: Column) -> Column:
    """A block as Markdown."""
    return F.when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), line)).otherwise(line)


def extract_blocks(regions: DataFrame, text: str = "text") -> DataFrame:
    """A row for each heading or paragraph of a region, in reading order.

    Other columns stay; new ones are pos, level (null for paragraphs), path (headings above, the own one included), content,
    raw and token_count. A blank line or a heading ends a paragraph; paragraphs of fewer than three characters are dropped.
    A heading's path is the path so far, cut to its level less one, with the heading added.
    """
    others = [c for c in regions.columns if c != text]
    # explode_outer: for explode, a filter on the sections' number would be pushed down, and make them once more
    sections = _sections(regions, text).select(*others, F.explode_outer("_sections").alias("_z")).where("_z IS NOT NULL")
    rows = sections.select(*others, F.col("_z.first").alias("_first"), F.col("_z.path").alias("path"), F.posexplode("_z.part").alias("_at", "_b"))
    line, level = F.col("_b.line"), F.col("_b.level")
    content = strip_marks(line)
    return rows.select(
        *others, (F.col("_first") + F.col("_at")).alias("pos"), level.alias("level"), "path", content.alias("content"), _raw(level, line).alias("raw"),
        F.when(level.isNotNull(), count_spaced(content)).otherwise(count_spaced(line)).alias("token_count"),
    )


def chunk_regions(regions: DataFrame, most: int = 512, overlap: int = 64, least_heading: int = 32, text: str = "text") -> DataFrame:
    """The chunks of ``chunk_blocks`` for regions that are documents of their own, without a shuffle: a row's chunks are made in the row.

    Other columns stay; new ones are chunk_index, text, heading_level, path, num_blocks and token_count.
    """
    others = [c for c in regions.columns if c != text]
    none = F.array().cast("array<struct<first:int,last:int>>")

    def sized(z: Column) -> Column:
        head = F.get(z["part"], F.lit(0))
        paragraphs = F.filter(z["part"], lambda b: b["level"].isNull())
        counted = F.when(head["level"].isNotNull(), count_spaced(strip_marks(head["line"])))
        return F.struct(z["path"].alias("path"), F.when(head["level"].isNotNull(), head).alias("head"), counted.alias("n_head"), F.transform(paragraphs, lambda b: F.struct(b["line"].alias("line"), count_tokens(b["line"]).alias("n"))).alias("p"))

    def spanned(z: Column) -> Column:
        own = F.when(z["n_head"] >= least_heading, F.array(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last")))).otherwise(none)
        spans = F.concat(own, pack(F.transform(z["p"], lambda x: x["n"]), most, overlap > 0))
        prefix = F.when(F.size(z["path"]) > 0, F.concat(F.array_join(F.transform(z["path"], lambda h: F.concat(F.lit("## "), h)), "\n"), F.lit("\n"))).otherwise("")
        return F.struct(z["head"].alias("head"), z["n_head"].alias("n_head"), z["p"].alias("p"), F.array_join(z["path"], " > ").alias("path"), prefix.alias("prefix"), spans.alias("spans"))

    def chunks(z: Column) -> Column:
        def one(c: Column) -> Column:
            own = c["first"] < 0
            inside = F.slice(z["p"], c["first"] + 1, c["last"] - c["first"] + 1)
            joined = strip(F.concat(z["prefix"], F.array_join(F.transform(inside, lambda x: x["line"]), "\n\n")))
            whole = F.when(own, _raw(z["head"]["level"], z["head"]["line"])).otherwise(joined)
            return F.struct(whole.alias("text"), z["head"]["level"].alias("heading_level"), z["path"].alias("path"), F.when(own, 1).otherwise(c["last"] - c["first"] + 1).alias("num_blocks"), F.when(own, z["n_head"]).alias("n"))

        return F.transform(z["spans"], one)

    made = F.flatten(F.transform(F.transform(F.transform("_sections", sized), spanned), chunks))
    rows = _sections(regions, text).select(*others, F.posexplode(made).alias("chunk_index", "_c"))
    return rows.select(*others, "chunk_index", "_c.text", "_c.heading_level", "_c.path", "_c.num_blocks", F.coalesce("_c.n", count_tokens(F.col("_c.text"))).alias("token_count"))


def pack(sizes: Column, most: int, overlap: bool) -> Column:
    """array<struct<first, last>> of greedy chunks over paragraph sizes; with overlap, a chunk begins with the last paragraph before it.

    The joined text's token count is the sum of its parts', as the joiner is white space.
    """
    kind = "struct<first:int,total:int,at:int,chunks:array<struct<first:int,last:int>>>"
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("total"), F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("chunks")).cast(kind)

    def step(s: Column, n: Column) -> Column:
        full = (s["total"] + n > most) & (s["at"] > s["first"])
        emitted = F.concat(s["chunks"], F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last"))))
        again = F.get(sizes, s["at"] - 1) if overlap else F.lit(0)
        first = F.when(full, s["at"] - (1 if overlap else 0)).otherwise(s["first"])
        total = F.when(full, again + n).otherwise(s["total"] + n)
        return F.struct(first.alias("first"), total.alias("total"), (s["at"] + 1).alias("at"), F.when(full, emitted).otherwise(s["chunks"]).alias("chunks")).cast(kind)

    def finish(s: Column) -> Column:
        rest = F.array(F.struct(s["first"].alias("first"), (s["at"] - 1).alias("last")))
        return F.when(s["at"] > s["first"], F.concat(s["chunks"], rest)).otherwise(s["chunks"])

    return F.aggregate(sizes, start, step, finish)


def chunk_blocks(blocks: DataFrame, doc: str, most: int = 512, overlap: int = 64, least_heading: int = 32) -> DataFrame:
    """Chunks of a document's blocks (``extract_blocks``): doc, chunk_index, text, heading_level, path, num_blocks, token_count.

    Paragraphs under one heading are packed greedily; a heading of ``least_heading`` tokens is a chunk of its own. Blocks of a
    document meet in one row, whose size is the document's.
    """
    whole = blocks.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("pos", "level", "path", "raw", "token_count"))).alias("_b"))
    starts = F.filter(F.sequence(F.lit(0), F.size("_b") - 1), lambda i: (i == 0) | F.get("_b", i)["level"].isNotNull())
    # a section is a heading (or the document's beginning) and the paragraphs up to the next one
    sections = whole.select(doc, "_b", starts.alias("_s")).select(doc, "_b", F.posexplode(F.zip_with(F.col("_s"), F.slice("_s", F.lit(2), F.size("_s")), lambda a, b: F.struct(a.alias("a"), F.coalesce(b, F.size("_b")).alias("b")))).alias("section", "r"))
    part = F.slice("_b", F.col("r.a") + 1, F.col("r.b") - F.col("r.a"))
    cut = sections.select(doc, "section", F.get(part, F.lit(0)).alias("_h"), F.filter(part, lambda x: x["level"].isNull()).alias("_p"))
    sized = cut.withColumn("_n", F.transform("_p", lambda x: count_tokens(x["raw"])))
    head = F.when(F.col("_h.level").isNotNull() & (F.col("_h.token_count") >= least_heading), F.array(F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"))))
    spans = F.concat(F.coalesce(head, F.array().cast("array<struct<first:int,last:int>>")), pack(F.col("_n"), most, overlap > 0))
    rows = sized.select(doc, "section", "_h", "_p", F.posexplode(spans).alias("part", "c"))
    inside = F.slice("_p", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1)
    prefix = F.concat(F.array_join(F.transform(F.col("_h.path"), lambda h: F.concat(F.lit("## "), h)), "\n"), F.lit("\n"))
    joined = strip(F.concat(F.when(F.size("_h.path") > 0, prefix).otherwise(""), F.array_join(F.transform(inside, lambda x: x["raw"]), "\n\n")))
    own = F.col("c.first") < 0
    out = rows.select(
        doc, "section", "part", F.when(own, F.col("_h.raw")).otherwise(joined).alias("text"), F.col("_h.level").alias("heading_level"), F.array_join("_h.path", " > ").alias("path"),
        F.when(own, 1).otherwise(F.col("c.last") - F.col("c.first") + 1).alias("num_blocks"), F.when(own, F.col("_h.token_count")).alias("_t"),
    )
    from pyspark.sql import Window

    index = F.row_number().over(Window.partitionBy(doc).orderBy("section", "part")) - 1
    return out.select(doc, index.alias("chunk_index"), "text", "heading_level", "path", "num_blocks", F.coalesce("_t", count_tokens(F.col("text"))).alias("token_count"))
