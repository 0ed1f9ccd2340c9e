"""The training-data operators against brute force, round trips and held-out rows, and on odd inputs."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from pagequarry.llm import bpe, components, decontaminate, language_model, license_scan, near_dedup, quality_rules, quality_trees, queries, substring_dedup, toxicity, warc
from pagequarry.llm.common import Scratch, WordHashes, words

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def odd_docs(spark, extra=()):
    """Nulls in every column, empty, blank, short and very long texts, ties, repeated rows."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    base = prose(rng, 200)
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one two", "en", "a", 7), (5, base, "en", "a", 1), (6, base, "en", "a", 1), (6, base, "en", "a", 1),
        (7, base + " tail words here", None, "b", 2), (8, long, "en", "b", 3), (9, long[:-300] + " changed end", "en", None, 3), (None, base, "en", "c", 4), (None, None, None, None, None), (10, "x" * 200_000, "en", "c", 5),
        *extra,
    ]
    return spark.createDataFrame(rows, DOC)


def empty(spark):
    return spark.createDataFrame([], DOC)


def labels_for(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# --- near duplicates -------------------------------------------------------------------------------------------------


def brute_classes(texts, k, percent):
    """{id: (n, component)} from {id: text}."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(1)
    texts = {}
    for g in range(6):
        base = prose(rng, rng.choice([6, 20, 60, 150])).split()
        for c in range(14):
            w = list(base)
            for _ in range(rng.randrange(0, max(2, len(w) // 9))):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10_000)}"
            texts[len(texts)] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for k in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_classes(docs, k).collect()}
        assert got == brute_classes(texts, k, 80)


def test_near_duplicates_on_odd_rows(spark):
    rows = near_dedup.near_duplicate_classes(odd_docs(spark)).collect()
    assert len(rows) == 13
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert all(by[i].component_id == i and by[i].kept for i in (1, 2, 3, 4, 5, 8, 10))
    assert by[6].component_id == 5 and by[7].component_id == 5 and by[9].component_id == 8 and not by[9].kept
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = near_dedup.keep_one(odd_docs(spark)).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 2, 3, 4, 5, 8, 10] and sum(r.doc_id is None for r in kept) == 2


def test_near_duplicates_of_nothing_and_of_ids_with_several_texts(spark):
    assert near_dedup.near_duplicate_classes(empty(spark)).collect() == []
    rng = random.Random(2)
    a, b = prose(rng, 50), prose(rng, 50)
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.near_duplicate_classes(docs).collect()} == {(1, 1), (2, 1), (3, 1)}


def test_split_buckets_are_compared(spark):
    """A base in the middle of copies that aren't alike among themselves: stars may miss it, the second step may not."""
    rng = random.Random(3)
    base = prose(rng, 100, 5000).split()
    texts = {}
    for c in range(40):
        w = list(base)
        for j in range(10):
            w[(c * 10 + j) % 100] = f"c{c}_{j}"
        texts[c + 1] = " ".join(w)
    texts[99] = " ".join(base)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_classes(docs, 4).collect()}
    assert got == brute_classes(texts, 4, 80)


def test_whole_sets_are_compared_whatever_their_signatures_estimate():
    bands = np.zeros(near_dedup.BANDS, np.int64).tobytes()
    sets = [np.arange(x, x + 100, dtype=np.uint32).tobytes() for x in (0, 5, 60)]
    row = lambda i, estimate, whole: (0, 0, 0, 0, i, 100, i, 1, bands, bytes([estimate]) * near_dedup.BINS, whole)

    def found(rows):
        names = ["bucket", "one", "two", "block", "rep", "n", "component", "largest", "bands", "print", "whole"]
        batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)
        return [(a, b) for out in near_dedup._across(80)(iter([batch])) for a, b in near_dedup.rows_of(out)]

    assert found([row(1, 1, sets[0]), row(2, 2, sets[1]), row(3, 1, sets[2])]) == [(2, 1)]
    assert found([row(1, 1, None), row(2, 2, sets[1])]) == []


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges, Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_densified_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for n, most in ((5, 0.2), (40, 0.1), (400, 0.1), (3000, 0.1)):  # of few shingles, two may share a bin
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(n * 0.9)], rng.integers(0, 2**63, max(1, n // 10)).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((near_dedup.signature(a) == near_dedup.signature(b)).mean() - true) < most


# --- decontamination -------------------------------------------------------------------------------------------------


def test_decontamination_spans_and_items(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda."
    text = "Before it. ALPHA (beta) gamma—delta epsilon zeta eta theta iota kappa lambda after; ünïx"
    items = spark.createDataFrame([(1, item), (2, "short Item"), (3, None), (4, "..."), (None, "after ünïx")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item.upper()), (2, text), (3, "a short item."), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, items).collect()}
    assert got[1].items == ["1"] and got[1].n_hit == 11 and got[1].n_words == 12
    assert got[3].items == ["2"] and [got[3].spans[0]] == [[2, 12]]
    assert got[2].items == [""] and text[slice(*got[2].spans[0])] == "after; ünïx"  # the dash isn't ASCII: it joins two words
    assert (got[4].n_words, got[4].n_hit, got[5].n_words) == (0, 0, 0)


def test_decontamination_without_items_or_documents_and_beyond_its_bound(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.decontaminate(docs, items.limit(0)).where("n_hit > 0").isEmpty() and decontaminate.decontaminate(empty(spark), items).isEmpty()
    with pytest.raises(ValueError, match="in parts"):
        decontaminate.decontaminate(docs, items, most_item_bytes=100)


def brute_hits(items, text, window):
    """(hit words, items) by trying every window at every place."""
    w, hit, found = decontaminate._normal(text), set(), set()
    for item, t in items:
        x = decontaminate._normal(t)
        k = min(len(x), window)
        windows = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1 if k else 0):
            if tuple(w[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("most_places", [0, 1, 16])
def test_scanner_matches_brute_force(monkeypatch, most_places):
    monkeypatch.setattr(decontaminate, "MOST_PLACES", most_places)
    rng = random.Random(21)
    for window in (1, 2, 5, 10):
        items = [(str(i), prose(rng, rng.choice([0, 1, 3, 9, 10, 11, 14, 40]), 6)) for i in range(30)]
        items += [(f"again {i}", t) for i, t in items[:9]]
        scanner = decontaminate.Scanner(items, window)
        for _ in range(40):
            part = rng.choice(items)[1].split()
            text = " ".join([prose(rng, rng.randrange(12), 6), *part[rng.randrange(4) : len(part) - rng.randrange(4)], prose(rng, 8, 6)])
            n, spans, found = scanner.scan(text)
            assert n == len(text.split()) and ({x for a, b in spans for x in range(a, b)}, found) == brute_hits(items, text, window)


def test_decontamination_with_megabytes_of_items_is_one_scan(spark):
    rng = random.Random(22)
    items = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(30_000)}" for _ in range(100))) for i in range(5_000)]
    size = sum(len(t) for _, t in items)
    assert 2_500_000 < size < decontaminate.MOST_ITEM_BYTES
    docs = [(i, "before " + " ".join(items[i][1].split()[17:40]) + " after") for i in range(0, 5_000, 50)] + [(9_000, prose(rng, 500))]
    scans = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            scans.add(len(b))
            yield b

    source = spark.createDataFrame(docs, "doc_id long, text string").mapInArrow(seen, "doc_id long, text string")
    got = decontaminate.decontaminate(source, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert scans.value == len(docs) and all((r.n_hit, r.items) == ((23, [str(r.doc_id)]) if r.doc_id < 9_000 else (0, [])) for r in got)


def test_decontamination_keeps_other_columns(spark):
    docs = odd_docs(spark).withColumn("n_hit", F.lit("mine"))
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string"))
    assert got.where("doc_id = 4").first().n_hit == 2 and got.count() == 13


# --- quality rules ---------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_base_rules_match_brute_force(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + [None, "", " \n ", "a\na\n\na b", "é ü — x#x x#x x#x", "a b c a b c"]
    known = WordHashes()
    for t in texts:
        assert quality_rules.counts(t, known) == brute_counts(t)


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    toxic = {r.doc_id: r for r in queries.op5_toxicity(spark, sf).where("held_out").collect()}
    rules = {r.doc_id: r for r in queries.op3_quality_rules(spark, sf).collect()}
    trees = {r.doc_id: r for r in queries.op10_quality_trees(spark, sf).where("held_out").collect()}
    held = [i for i in labels if i in toxic]
    assert len(held) > 300 and set(toxic) == {i for i in rules if zlib.crc32(str(i).encode()) % 5 == 0} == set(trees)
    english = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").collect()}
    sure = [i for i in held if i in english]
    assert np.mean([toxic[i].predicted == labels[i].toxic for i in sure]) > 0.97 and np.mean([toxic[i].predicted == labels[i].toxic for i in held]) > 0.93
    assert np.mean([trees[i].predicted == labels[i].quality for i in held]) > 0.97
    assert np.mean([(rules[i].quality >= 0.5) == labels[i].quality for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in [*toxic.values(), *trees.values()]) and all(not r.kept for r in rules.values() if r.base_failed)


def test_classifiers_on_odd_rows(spark):
    docs, none = odd_docs(spark), labels_for(spark, [])
    one_class = labels_for(spark, [(5, 1, 0), (8, 1, 0), (8, 0, 1), (None, 1, 1), (7, None, None), (77, 1, 1)])
    for labels in (none, one_class):
        t, q, r = toxicity.train_toxicity(docs, labels), quality_trees.train_quality(docs, labels), quality_rules.train_quality_rules(docs, labels)
        assert toxicity.score_toxicity(docs, t).where("toxicity between 0 and 1").count() == 13
        assert quality_trees.score_quality(docs.withColumn("quality", F.lit(1)), q).where("quality between 0 and 1").count() == 13
        rows = quality_rules.apply_quality_rules(docs, r).collect()
        assert len(rows) == 13 and all(x.base_failed for x in rows if x.doc_id in (1, 2, 3, 4, 10))
        assert toxicity.score_toxicity(empty(spark), t).isEmpty() and quality_rules.apply_quality_rules(empty(spark), r).isEmpty()


def test_flat_trees_equal_a_walk_down_each():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(600, 5)), (rng.normal(size=600) > 0).astype(float)
    model = quality_trees.fit_trees(x, y)
    for row, p in zip(x[:50], quality_trees.predict_trees(model, x[:50])):
        total = model["start"]
        for f, t, v in zip(model["feature"], model["threshold"], model["value"]):
            at = 0
            for _ in range(quality_trees.DEPTH):
                at = 2 * at + 1 + (row[f[at]] > t[at])
            total += v[at - (2**quality_trees.DEPTH - 1)]
        assert math.isclose(p, 1 / (1 + math.exp(-total)))


# --- archive ---------------------------------------------------------------------------------------------------------


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("most_broadcast", [0, 200_000])
def test_archive_round_trip(spark, monkeypatch, most_broadcast):
    monkeypatch.setattr(warc, "MOST_BROADCAST", most_broadcast)  # both ways to leave out repeated captures
    pages = [(3, "http://a/x", "<p>é</p>"), (1, "http://a/y z", "<p>é</p>"), (2, None, None), (4, "http://b", ""), (5, "http://c", "solo\r\n\r\nWARC/1.1"), (None, "http://n", "<p>é</p>"), (1, "http://a/again", "<p>é</p>"), (6, "http://d", "x" * 3_000_000)]
    archive = warc.write_archive(spark.createDataFrame(pages, PAGES).withColumns({"digest": F.lit(1), "payload": F.lit("own")}), Scratch(spark, "w"))
    rows = warc.read_archive(archive).collect()
    assert len(rows) == 8 and archive.payloads.count() == 4
    html = {i: (t or "").encode() for i, _, t in pages}
    for r in rows:
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        n = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert head.startswith(b"WARC/1.1\r\n") and rest[n:] == b"\r\n\r\n" and len(rest) == n + 4 and (rest[:n] == html[r.page_id] if r.record_type == "response" else n == 0)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode() and r.payload_bytes == len(html[r.page_id])
    kinds = Counter((r.page_id, r.record_type, r.refers_to) for r in rows)
    assert kinds == Counter({(1, "response", None): 2, (3, "revisit", 1): 1, (None, "revisit", 1): 1, (2, "response", None): 1, (4, "revisit", 2): 1, (5, "response", None): 1, (6, "response", None): 1})
    assert Counter((r.page_id, r.html) for r in warc.restore_pages(archive).collect()) == Counter((i, t or "") for i, _, t in pages)


def test_archive_of_nothing_and_damage(spark):
    assert warc.read_archive(warc.write_archive(spark.createDataFrame([], PAGES), Scratch(spark, "w"))).isEmpty()
    whole = warc.write_archive(spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], PAGES), Scratch(spark, "w"))
    damaged = warc.Archive(whole.payloads.withColumn("payload", F.encode(F.lit("abd"), "UTF-8")), whole.records)
    for archive in (damaged, warc.Archive(whole.payloads.limit(0), whole.records)):
        with pytest.raises(Exception, match="damaged"):
            warc.read_archive(archive).collect()


# --- tokens ----------------------------------------------------------------------------------------------------------


def plain_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pieces_have_the_ids_of_the_whole():
    own, rng = plain_encoding(), random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["a", "Z", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "中", "1", "!!", " ", "\x1c", "…", "<|endoftext|>"]) for _ in range(600))
        cut = list(bpe.pieces(text, 20))
        assert "".join(cut) == text and [i for p in cut for i in own.encode_ordinary(p)] == own.encode_ordinary(text)
    assert list(bpe.pieces("x" * 500, 20)) == ["x" * 500]


def test_bpe_round_trip(spark):
    ranks = bpe.read_ranks(public_tokenizers.path(queries.RANKS))
    docs = odd_docs(spark, [(11, "naïve café 🙂 <|endoftext|>", "fr", "d", 1), (12, ("long text, with é " * 20_000), "en", "d", 1)]).withColumn("ids", F.lit("clash"))
    rows = bpe.bpe_decode(bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN).collect()
    own = plain_encoding()
    for r in rows:
        assert r.ids == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.bpe_encode(empty(spark), ranks, public_tokenizers.PATTERN).isEmpty()


# --- substring de-duplication ----------------------------------------------------------------------------------------


def brute_cut(rows, k):
    """[(id, kept words)] from [(id, text)]."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for j in range(len(w) - k + 1):
                key = tuple(w[j : j + k])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = {x for j in range(len(w) - k + 1) if i is not None and first[tuple(w[j : j + k])] < i for x in range(j, j + k)}
        out.append((i, [x for j, x in enumerate(w) if j not in gone]))
    return out


def test_substring_dedup_matches_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    shared = [prose(rng, n) for n in (13, 14, 30, 80)]
    rows = [(i, "\n".join([prose(rng, rng.randrange(0, 30)), *rng.sample(shared, rng.randrange(0, 3)), prose(rng, 5), "a a a a " * rng.randrange(0, 6)])) for i in range(60)] + [(7, shared[3]), (7, shared[3]), (None, shared[3]), (61, None), (62, ""), (63, shared[2] + " " + shared[2])]
    for block in (200, 2_000_000):
        monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", block)
        # clashing columns are replaced, others stay
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)).withColumn("other", F.lit("o"))
        got = substring_dedup.substring_dedup(docs, 13).collect()
        want = brute_cut(rows, 13)
        assert sorted((str(r.doc_id), " ".join((r.clean_text or "").split())) for r in got) == sorted((str(i), " ".join(w)) for i, w in want)
        assert sum(r.n_removed for r in got) == sum(b - a for r in got for a, b in r.removed) and all(r.other == "o" for r in got)


def test_rows_of_one_id_in_a_block_are_each_cut(spark, tmp_path, monkeypatch):
    rng = random.Random(14)
    shared = prose(rng, 20)
    rows = [(7, "one " + shared), (7, shared + " other"), (7, shared + " other"), (3, shared + " small")]
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", 24)  # the first three rows are a block, the last one is another
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "rows"))
    got = substring_dedup.substring_dedup(spark.read.parquet(str(tmp_path / "rows")).coalesce(1), 13).collect()
    assert sorted((r.doc_id, " ".join(r.clean_text.split())) for r in got) == sorted((i, " ".join(w)) for i, w in brute_cut(rows, 13))


def test_substring_dedup_on_odd_rows(spark):
    rows = substring_dedup.substring_dedup(odd_docs(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == 13 and by[1][0].clean_text is None and by[5][0].n_removed == 0 and [r.n_removed for r in by[6]] == [200, 200] and by[7][0].clean_text == "tail words here"
    assert by[9][0].n_removed > 29_000 and substring_dedup.substring_dedup(empty(spark)).isEmpty()


# --- licences --------------------------------------------------------------------------------------------------------


def test_license_scan(spark):
    texts = {
        1: "Some text.\nReleased under the MIT License.\nend", 2: "MIT license mit LICENSE, the Apache-License", 3: "redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the following conditions are met",
        4: None, 5: "", 6: "the of and a license", 7: "Licensed under CC BY-NC 4.0.", 8: "a general public licence; GNU General Public License",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("labels", F.lit("clash"))
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert (got[1].base_labels, got[1].labels, got[1].n_base, got[1].first_word, got[1].score) == ("mit", "mit", 1, 5, 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 5, "apache,mit")
    assert (got[3].labels, got[3].base_labels, got[3].score) == ("bsd", "", 1.0) and got[7].labels == "cc-by-nc"
    assert (got[4].n_words, got[4].labels, got[4].score, got[4].first_word) == (0, "", 0.0, None) and got[6].labels == "" and got[8].base_labels == "gpl"
    assert license_scan.scan_licenses(odd_docs(spark)).count() == 13 and license_scan.scan_licenses(empty(spark)).isEmpty()


# --- language model --------------------------------------------------------------------------------------------------

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lm_tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW)), "\n"]


class BruteTree:
    """The suffix tree by its definition, in dictionaries."""

    def __init__(self, texts, depth):
        self.c, follow, self.states = Counter(), {}, {}
        for t in map(lm_tokens, texts):
            self.c.update(t)
            for i in range(len(t)):
                for k in range(1, min(depth, i) + 1):
                    follow.setdefault(tuple(t[i - k : i]), Counter())[t[i]] += 1
        self.total, self.kinds, self.depth = sum(self.c.values()), len(self.c), depth
        for k in range(1, depth + 1):
            found = {x: f for x, f in follow.items() if len(x) == k and sum(f.values()) >= language_model.LEAST_COUNT and self.gain(x, f) >= language_model.LEAST_GAIN}
            self.states |= found

    def gain(self, context, f):
        n = sum(f.values())
        return sum(m * math.log(m / n / self.p(context[1:], s)) for s, m in f.items())

    def p(self, context, symbol):
        p = (self.c[symbol] + 1) / (self.total + self.kinds + 1)
        for k in range(1, len(context) + 1):
            f = self.states.get(tuple(context[len(context) - k :]))
            if f is not None:
                p = (f[symbol] + language_model.SMOOTH * p) / (sum(f.values()) + language_model.SMOOTH)
        return p

    def score(self, text):
        t = lm_tokens(text)
        root = sum(math.log10((self.c[s] + 1) / (self.total + self.kinds + 1)) for s in t)
        return len(t), sum(s in self.c for s in t), self.total, round(root, 6), round(sum(math.log10(self.p(t[max(0, i - self.depth) : i], s)) for i, s in enumerate(t)), 4)


def lm_texts(rng):
    """Words that depend on the three before them, of which some are rare."""
    follow = {a: rng.sample(range(60), 2) for a in range(200)}
    texts = []
    for i in range(150):
        w = [rng.randrange(60)]
        while len(w) < 150:
            w.append(follow[w[-1]][sum(w[-3:]) % 2] if rng.random() < 0.8 else rng.randrange(200))
        texts.append((i, " ".join(f"v{x}" for x in w)))
    return [*texts, (1000, None), (1001, "v1"), (1002, "V1 never v2 v3"), (None, "V1 v2"), (3, texts[3][1])]


@pytest.mark.parametrize("depth, hot, block", [(5, 1_000_000, 1_000_000), (4, 30, 2_000)])
def test_scores_match_the_tree_by_its_definition(spark, monkeypatch, depth, hot, block):
    """With all contexts whole in one bucket and one block, and with most of them dealt out over many."""
    monkeypatch.setattr(language_model, "HOT_LEAST", hot)
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", block)
    rows = lm_texts(random.Random(12))
    tree = BruteTree([t for i, t in rows if i is not None and i < 120], depth)
    assert {len(x) for x in tree.states} >= {1, 2, 3}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = language_model.score_texts(docs, F.col("doc_id") < 120, depth).collect()
    found = sorted((str(r.doc_id), (r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4))) for r in got)
    assert found == sorted((str(i), tree.score(t)) for i, t in rows)
    if depth == 5:
        for context in [*rng_contexts(tree), ("v1", "never"), ()]:
            assert math.isclose(sum(tree.p(context, s) for s in [*tree.c, "unseen"]), 1.0, rel_tol=1e-9)
        assert sum(r.score for r in got) > 0.9 * sum(r.base_score for r in got)


def rng_contexts(tree):
    return [max(tree.states, key=len), min(tree.states)]


def test_base_scores_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(10_001, None), (10_002, ""), (None, "the x"), (3, "again")], "doc_id long, text string"))
    rows = docs.collect()
    tokens = [lm_tokens(r.text) for r in rows]
    fold = [zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 7 for r in rows]
    c = Counter(t for ts, f in zip(tokens, fold) if f != 2 for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r.doc_id), len(ts), sum(t in c for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts in zip(rows, tokens))
    got = language_model.score_texts(docs, language_model.teaching(), 2).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


def test_a_bucket_is_sent_once_however_entries_are_sorted():
    edge = np.uint64((1 << 64) // 80 >> 40 << 40)  # the high bits in which a bucket of 80 ends
    assert len(list(language_model._slices(edge | np.array([0, (1 << 40) - 1, 0, (1 << 40) - 1], np.uint64), 80))) == 1


def test_only_large_levels_ask_in_turns(spark, monkeypatch):
    """Each turn goes through all blocks again, which levels that concern few tokens don't need."""
    asked, ask, rng = Counter(), language_model._ask, random.Random(4)
    monkeypatch.setattr(language_model, "_ask", lambda level, *more: asked.update([level]) or ask(level, *more))
    texts = [" ".join(f"v{rng.randrange(200)}" for _ in range(100)) + (" one two three four five six seven eight" if i < 8 else "") for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tree = BruteTree(texts, 3)
    got = {r.doc_id: round(r.score, 4) for r in language_model.score_texts(docs, F.lit(True), 3).collect()}
    assert got == {i: tree.score(t)[-1] for i, t in enumerate(texts)}
    assert asked == {1: language_model.TURNS, 2: 1, 3: 1}


def test_arrow_splits_texts_as_words_does():
    texts = ["left out", "", None, " a\x0bB\x1cc\x85d\u00a0e \t\n", "\x00 x", "\u00c9 \u00c0B\r\x0c", "\n\n", "Z"]
    for some in (pa.array(texts), pa.array(texts).slice(1), pa.array(texts, pa.large_string()).slice(1, 5), pa.array([None, ""], pa.string())):
        found, sizes = language_model._tokens(some)
        want = [words(t, lower=True) for t in some.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want]
        assert [w.encode() for w in found.to_pylist()] == [x for w in want for x in w]


def test_packed_arrays_come_back():
    rng = np.random.default_rng(2)
    made = [rng.integers(0, 1 << 31, n).astype(kind) for n in (0, 1, 8_192, 20_001) for kind in (np.uint8, np.uint32, np.int32, np.uint64, np.int64, np.float32, np.float64)]
    for a, b in zip(made, language_model._unpack(language_model._pack(*made)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()


def test_language_model_on_odd_rows(spark):
    docs = odd_docs(spark)
    assert language_model.score_texts(docs, language_model.teaching(), 3).where("score <= 0").count() == 13
    assert all(r.score == 0 and r.n_known == 0 for r in language_model.score_texts(docs, F.lit(None).cast("boolean")).where("n_tokens = 1").collect())
    assert language_model.score_texts(empty(spark), language_model.teaching()).isEmpty()


# --- whole queries ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(*columns).collect()) == sorted(map(str, want.fetchall()))
