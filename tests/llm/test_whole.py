"""Whole queries that SQL can't tell, against plain versions; names that clash; models that don't depend on the order of rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagequarry.llm import bpe, decontaminate, language_model, license_scan, near_dedup, quality_rules, quality_trees, queries, substring_dedup, toxicity, warc
from pagequarry.llm.common import Scratch, clean_up, is_scan, labelled_sample
from test_llm import brute_classes, brute_counts, brute_cut, empty, labels_for, odd_docs, plain_encoding, prose

# --- queries ---------------------------------------------------------------------------------------------------------


def test_bpe_query_matches_the_library(spark, sf):
    own = plain_encoding()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op6_bpe(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_quality_rules_query_matches_a_plain_version(spark, sf):
    rows = {r.doc_id: r for r in queries.op3_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    weights, bias = np.load_pickle(quality_rules.train_quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")))
    for r in docs.collect():
        got, counts = rows[r.doc_id], brute_counts(r.text)
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == counts
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        quality = 1 / (1 + math.exp(-plain_margin(r.text or "", weights, bias)))
        assert math.isclose(got.quality, quality, rel_tol=1e-6) and got.base_failed == failed and got.kept == (not failed and got.quality >= 0.5)


def plain_margin(text, weights, bias):
    """The regression's margin, a gram at a time."""
    import xxhash

    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", low)]
    mask = (1 << 64) - 1

    def mixed(x):
        x ^= x >> 31
        x = x * 0x7FB5D329728EA185 & mask
        x ^= x >> 27
        x = x * 0x81DADEF4BC2DD44D & mask
        return x ^ x >> 33

    def chars(k):
        for i in range(len(low) - k + 1):
            h = 0
            for c in low[i : i + k]:
                h = (h * 0x01000193 + ord(c)) & 0xFFFFFFFF
            yield (h * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality_rules.BITS

    shift = 64 - quality_rules.BITS
    groups = [[w >> shift for w in words], [mixed((a * 0x9E3779B97F4A7C15 + b) & mask) >> shift for a, b in zip(words, words[1:])], list(chars(3)), list(chars(4))]
    return bias + quality_rules.SCALE * sum(float(np.mean(weights[[x + (g << quality_rules.BITS) for x in group]], dtype=np.float64)) for g, group in enumerate(groups) if group)


def test_ftrl_matches_plain_steps():
    """Each step by its formula, a coordinate at a time."""
    rng = random.Random(31)
    rows = [(bytes([i]), np.array(sorted(rng.sample(range(40), 8)), np.int32)) for i in range(60)]
    labels = np.array([float(3 in r[1] or rng.random() < 0.2) for r in rows])
    share = (labels.sum() + 1) / (len(labels) + 2)
    z, n, bias, bias_n = {}, {}, math.log(share / (1 - share)), 0.0
    alpha, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(j):
        if abs(z.get(j, 0.0)) <= l1:
            return 0.0
        return -(z[j] - math.copysign(l1, z[j])) / ((beta + math.sqrt(n[j])) / alpha + l2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(rows)):
            at = rows[i][1].tolist()
            w = {j: weight(j) for j in at}
            g = 1 / (1 + math.exp(-(sum(w.values()) + bias))) - labels[i]
            if abs(g) < 1e-3:
                continue
            for j in at:
                step = (math.sqrt(n.get(j, 0.0) + g * g) - math.sqrt(n.get(j, 0.0))) / alpha
                z[j] = z.get(j, 0.0) + g - step * w[j]
                n[j] = n.get(j, 0.0) + g * g
            bias_n += g * g
            bias -= alpha / (beta + math.sqrt(bias_n)) * g
    at, values, got_bias = np.load_pickle(toxicity.fit(rows, labels))
    want = {j: weight(j) for j in z if weight(j)}
    assert at.tolist() == sorted(want) and want and np.allclose(values, [want[j] for j in sorted(want)]) and math.isclose(bias, got_bias)


def test_trees_match_the_best_splits_by_trial(monkeypatch):
    """The first tree against all cuts tried one by one."""
    monkeypatch.setattr(quality_trees, "TREES", 1)
    monkeypatch.setattr(quality_trees, "DEPTH", 2)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 1] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    model = quality_trees.fit_trees(x, y)
    start = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    p = np.full(len(y), 1 / (1 + math.exp(-start)))
    g, h = p - y, p * (1 - p)

    def best(rows):
        found = (0.0, None)
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality_trees.L2)
        for j in range(3):
            for cut in np.unique(np.quantile(x[:, j], np.linspace(0, 1, quality_trees.BINS + 1)[1:-1])):
                left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                if min(h[left].sum(), h[right].sum()) >= quality_trees.LEAST_WEIGHT:
                    found = max(found, (score(left) + score(right) - score(rows), (j, cut)), key=lambda f: f[0])
        return found[1]

    everything = np.arange(len(y))
    j, cut = best(everything)
    nodes = [everything, everything[x[:, j] <= cut], everything[x[:, j] > cut]]
    assert (int(model["feature"][0, 0]), float(model["threshold"][0, 0])) == (j, cut)
    leaves = []
    for k in (1, 2):
        split = best(nodes[k])
        assert split is None or (int(model["feature"][0, k]), float(model["threshold"][0, k])) == split
        parts = [nodes[k], nodes[k][:0]] if split is None else [nodes[k][x[nodes[k], split[0]] <= split[1]], nodes[k][x[nodes[k], split[0]] > split[1]]]
        leaves += [-quality_trees.RATE * g[r].sum() / (h[r].sum() + quality_trees.L2) for r in parts]
    assert np.allclose(model["value"][0], leaves)


@pytest.fixture(autouse=True)
def _pickles(monkeypatch):
    import pickle

    monkeypatch.setattr(np, "load_pickle", pickle.loads, raising=False)


def test_models_do_not_depend_on_the_order_of_rows(spark):
    """Of rows that repeat an id with other texts, the same one teaches."""
    rng = random.Random(41)
    rows = [(i, prose(rng, 60, 50 if i % 2 else 90)) for i in range(200)] + [(i, prose(rng, 60)) for i in range(0, 200, 3)]
    labels = labels_for(spark, [(i, i % 2, i % 2) for i in range(200)])
    samples, models = [], []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(seed * 2)
        samples.append(sorted(map(tuple, labelled_sample(docs, labels, "quality", 1000).collect())))
        models.append([quality_rules.train_quality_rules(docs, labels), toxicity.train_toxicity(docs, labels), quality_trees.train_quality(docs, labels)])
    assert samples[0] == samples[1] and len(samples[0]) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200)) and models[0] == models[1]
    few = labelled_sample(docs, labels, "quality", 1000, most_bytes=5_000).collect()
    assert 0 < len(few) and sum(len(r.text) for r in few) <= 5_000


# --- names -----------------------------------------------------------------------------------------------------------

#: Names that operators use inside, and some that are hard to say.
NAMES = """own block place payload teaches tokens kinds bucket key doc starts text_key marks gone rows id rep n component largest digest bands print
 whole hub members a b blocks one two _toxicity _row _words _id _text_key _marks _doc _labels _text _seen _known _tail _rest _gone _own_removed
 _lines _flat label size so_far item found grp hashes docs level word_rank ranks_of_block template _share _base_labels h left kind ctx gain
 x.y back`tick""".split()


def test_columns_of_any_name_stay(spark, sf):
    rng = random.Random(51)
    base = prose(rng, 80)
    plain = spark.createDataFrame([(1, base), (2, base + " tail"), (3, prose(rng, 60) + " mit license"), (4, None), (5, base)], "doc_id long, text string")
    docs = plain.withColumns({n: F.lit(f"mine {i}") for i, n in enumerate(NAMES)})
    labels = labels_for(spark, [(i, i % 2, i % 2) for i in range(1, 6)])
    ranks = bpe.read_ranks(bpe_path())
    items = spark.createDataFrame([(1, "mit license")], "item_id long, text string")
    made = {
        "toxicity": lambda d: toxicity.score_toxicity(d, toxicity.train_toxicity(d, labels)),
        "rules": lambda d: quality_rules.apply_quality_rules(d, quality_rules.train_quality_rules(d, labels)),
        "trees": lambda d: quality_trees.score_quality(d, quality_trees.train_quality(d, labels)),
        "copies": lambda d: near_dedup.keep_one(d),
        "passages": lambda d: substring_dedup.substring_dedup(d),
        "leaks": lambda d: decontaminate.decontaminate(d, items),
        "licenses": lambda d: license_scan.scan_licenses(d),
        "language": lambda d: language_model.score_texts(d, F.lit(True), 2),
        "tokens": lambda d: bpe.bpe_decode(bpe.bpe_encode(d, ranks, queries.public_tokenizers.PATTERN), ranks, queries.public_tokenizers.PATTERN),
    }
    made |= {name: lambda d, stage=stage: stage(spark, d, sf) for name, stage in corpus_pipeline.STAGES[:-1]}
    ticked = lambda n: "`" + n.replace("`", "``") + "`"
    for name, run in made.items():
        bare, full = run(plain), run(docs)
        assert set(full.columns) == set(bare.columns) | set(NAMES), name
        rows = full.collect()
        assert all(r[full.columns.index(n)] == f"mine {i}" for r in rows for i, n in enumerate(NAMES) if n not in bare.columns), name
        # and what is made is made as without them
        shown = [c for c in bare.columns if c not in NAMES]
        assert sorted(map(str, full.select(*map(ticked, shown)).collect())) == sorted(map(str, bare.select(*map(ticked, shown)).collect())), name
    assert near_dedup.near_duplicate_classes(docs).count() == 5 and corpus_pipeline.encode(spark, docs, sf).count() == 5
    pages = spark.createDataFrame([(1, "u", "x"), (2, "v", "x")], "page_id long, url string, html string").withColumns({n: F.lit(1) for n in NAMES})
    assert warc.read_archive(warc.write_archive(pages, Scratch(spark, "w"))).count() == 2


def bpe_path():
    return queries.public_tokenizers.path(queries.RANKS)


# --- scale -----------------------------------------------------------------------------------------------------------


def test_near_duplicates_in_small_blocks_and_beyond_whole_sets(spark, monkeypatch):
    """Members of one bucket in several blocks, and sets that are judged by their signatures first."""
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "WHOLE_SETS", 8)
    rng = random.Random(3)
    base = prose(rng, 100, 5000).split()
    texts = {99: " ".join(base)}
    for c in range(40):
        w = list(base)
        for j in range(10):
            w[(c * 10 + j) % 100] = f"c{c}_{j}"
        texts[c + 1] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_classes(docs, 4).collect()}
    assert got == brute_classes(texts, 4, 80)


def test_substring_dedup_of_inputs_that_are_no_scan(spark, sf, monkeypatch, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert is_scan(docs.select("doc_id", "text").where("doc_id > 3")) and not is_scan(docs.repartition(3)) and not is_scan(docs.union(docs))
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 30_000)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = substring_dedup.substring_dedup(docs.repartition(3), 13).collect()
    assert sorted((r.doc_id, " ".join((r.clean_text or "").split())) for r in got) == sorted((i, " ".join(w)) for i, w in brute_cut(rows, 13))


def test_clean_up_leaves_nothing(spark, sf):
    scratch = Scratch(spark, "left")
    scratch.save(spark.range(3), "x")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.base)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(where)
    clean_up(spark)
    assert not fs.exists(where)
    assert near_dedup.keep_one(odd_docs(spark)).count() > 0 and near_dedup.keep_one(empty(spark)).isEmpty()
