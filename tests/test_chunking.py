"""Blocks and chunks of odd texts; chunks made in the row are those of gathered blocks."""

import random

from pyspark.sql import functions as F

from pagequarry.operators import chunking

DOCS = "doc_id long, text string"


def random_text(seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(rng.randrange(0, 40)):
        kind = rng.randrange(6)
        if kind == 0:
            lines.append("#" * rng.randrange(1, 7) + " " + " ".join(["head"] * rng.choice([1, 2, 40])))
        elif kind == 1:
            lines.append(f"{rng.randrange(1, 9)}.{rng.randrange(9)} Section")
        elif kind == 2:
            lines.append(rng.choice(["", "  ", "x", "\t"]))
        else:
            lines.append(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(1, 30))) + rng.choice(["", ".", " "]))
    return "\n".join(lines)


def test_chunks_made_in_the_row_are_those_of_gathered_blocks(spark):
    df = spark.createDataFrame([(i, random_text(i)) for i in range(60)] + [(100, None), (101, ""), (102, "# only a heading")], DOCS)
    for most, overlap in ((20, 4), (60, 0), (10_000, 64)):
        columns = ("doc_id", "chunk_index", "text", "heading_level", "path", "num_blocks", "token_count")
        gathered = chunking.chunk_blocks(chunking.extract_blocks(df), "doc_id", most, overlap).select(*columns)
        made = chunking.chunk_regions(df.withColumn("_own", F.lit(1)), most, overlap).select(*columns)
        assert sorted(map(str, made.collect())) == sorted(map(str, gathered.collect()))


def test_private_characters_stay_in_their_paragraph(spark):
    texts = ["gamma  delta", "# head  line\n\nalpha  beta 0 1", "", "plain text"]
    rows = chunking.extract_blocks(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id", "pos").collect()
    assert [(r.doc_id, r.pos, r.level, r.content) for r in rows] == [(0, 0, None, texts[0]), (1, 0, 1, "head  line"), (1, 1, None, "alpha  beta 0 1"), (2, 0, None, texts[2]), (3, 0, None, texts[3])]
    assert chunking.chunk_regions(spark.createDataFrame([(0, texts[0])], DOCS)).first().text == texts[0]


def test_a_long_text_with_many_headings(spark):
    text = "\n".join(f"# h{i}\nparagraph {i} of the text\n" for i in range(3000))
    rows = chunking.chunk_regions(spark.createDataFrame([(0, text)], DOCS)).collect()
    assert len(rows) == 3000 and rows[-1].chunk_index == 2999 and rows[-1].text == "## # h2999\nparagraph 2999 of the text"


def test_no_shuffle(spark, capsys):
    chunking.chunk_regions(spark.createDataFrame([(0, "a")], DOCS)).explain()
    assert "Exchange" not in capsys.readouterr().out
