"""Each operator against brute force, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import pickle
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphflow.llm import ann, bpe, common, components, licenses, lm, media, mixing, ngram_join, pii, toxicity, urls
from glyphflow.llm.common import crc_mod


def words(text):
    return (text or "").encode().lower().split()


def test_tables_need_a_shared_folder_and_go_when_discarded(spark, tmp_path):
    from pathlib import Path
    from types import SimpleNamespace

    conf = SimpleNamespace(get=lambda key, other: other)
    alone = SimpleNamespace(sparkContext=SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(alone)
    before = spark.conf.get(common.CLEANUP)
    t = common.written(spark.range(9).repartition(3), "gone")
    (path,) = {Path(f.removeprefix("file:")).parent for f in t.inputFiles()}
    assert t.count() == 9 and path.exists() and spark.conf.get(common.CLEANUP) == before
    common.discard(t)
    assert not path.exists()


def test_fresh_names():
    docs = type("D", (), {"columns": ["A", "_a", "b"]})
    assert common.fresh(docs, "a") == "__a" and common.fresh(docs, "c") == "c"


# 1


def test_lm_base_score_is_exact_and_the_model_beats_it(docs, rows):
    train = [(i, t) for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(x for _, t in train for x in [*words(t), None])
    n, v = sum(counts.values()), len(counts)
    expected = Counter()
    for i, t, *_ in rows:
        tokens = [*words(t), None]
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        expected[(i, held, len(tokens), sum(counts[x] > 0 for x in tokens), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), 6))] += 1
    got = lm.scored(docs, crc_mod(F.col("doc_id"), 7) == 2).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == expected
    assert all(r.score <= 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_lm_hot_histories_are_spread_and_score_alike(docs, monkeypatch):
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    whole = sorted(lm.scored(docs, F.lit(False)).collect(), key=key)
    monkeypatch.setattr(lm, "HOT", 10**9)
    spread = sorted(lm.scored(docs, F.lit(False)).collect(), key=key)
    for r, s in zip(spread, whole, strict=True):
        assert (r.doc_id, r.n_known, r.base_score) == (s.doc_id, s.n_known, pytest.approx(s.base_score))
        assert r.score == pytest.approx(s.score, rel=0.03, abs=1.5)  # another region answers wrongly for other pairs
    assert sum(r.score for r in spread) == pytest.approx(sum(r.score for r in whole), rel=0.01)


def test_lm_small_chunks_score_alike(docs, monkeypatch):
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score, r.score)
    whole = sorted(lm.scored(docs, F.lit(False)).collect(), key=key)
    monkeypatch.setattr(lm, "CHUNK", 100)
    for r, s in zip(sorted(lm.scored(docs, F.lit(False)).collect(), key=key), whole, strict=True):
        assert tuple(r)[:5] == tuple(s)[:5] and tuple(r)[5:] == pytest.approx(tuple(s)[5:])


def lm_model(df):
    chunks = lm.chunked(df.selectExpr("doc_id", "false AS held_out", "text"))
    n = chunks.agg(F.sum("train")).first()[0]
    none = np.zeros(0, np.uint64)
    regions = lm.counted(chunks, none, 8)
    return regions, lm.Totals.of(n, regions)


def lm_probabilities(spark, regions, totals, texts):
    """Of each text, those of its tokens."""
    none = np.zeros(0, np.uint64)
    chunks = lm.chunked(spark.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string").coalesce(1))
    (row,), levels = chunks.collect(), sorted(lm.answered(chunks, regions, none, 8).collect(), key=lambda r: r.bucket)
    c = lm.Chunk.unpacked(row.data)
    parts = [lm.unpacked(r.entries, np.int64, np.uint8, np.float32, np.float32) for r in levels]
    exact, level, mass, after = (np.concatenate(x) for x in zip(*parts, strict=True))
    bigram = np.frombuffer(b"".join(zlib.decompress(r.levels) for r in levels), np.uint8)
    p = lm.probabilities(c, lm.Asked.of(c, none, 8), exact, level, mass, after, bigram, totals)[1]
    return {i: x for i, x in zip(row.ids, np.split(p, np.cumsum(c.sizes)[:-1]), strict=True)}


def zipf_texts():
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, 301)
    return vocabulary, [" ".join(r.choice(vocabulary, r.integers(1, 200), p=share / share.sum())) for _ in range(150)]


def test_lm_probabilities_add_up_to_one(spark):
    vocabulary, texts = zipf_texts()
    regions, totals = lm_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    asked = [" ".join(f"{h} {w}" for w in [*vocabulary, "unknown"]) + f" {h}" for h in [*vocabulary[:30], *vocabulary[-30:], "unknown"]]
    sums = [p[1::2].sum() for p in lm_probabilities(spark, regions, totals, asked).values()]  # the end is the last after h
    assert len(sums) == 61 and np.mean(np.abs(np.array(sums) - 1) < 0.01) > 0.9  # else a wrong answer of the filter


def test_lm_scores_are_near_those_of_exact_counts(spark):
    _, texts = zipf_texts()
    regions, totals = lm_model(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    before, pair, word, after = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        w = ["<s>", *t.split(), "</s>"]
        for a, b in zip(w, w[1:], strict=False):
            before[a] += 1
            pair[a, b] += 1
            word[b] += 1
            after[a].add(b)
    n, v = sum(word.values()), len(word)
    exact = lambda a, b: (pair[a, b] + (len(after[a]) + 1) * (word[b] + 1) / (n + v + 1)) / (before[a] + len(after[a]) + 1)
    for i, p in lm_probabilities(spark, regions, totals, texts[:40]).items():
        w = ["<s>", *texts[i].split(), "</s>"]
        slow = np.log10([exact(a, b) for a, b in zip(w, w[1:], strict=False)])
        assert len(p) == len(slow) and abs(np.log10(p) - slow).mean() < 0.1 and abs(np.log10(p).sum() - slow.sum()) < 0.03 * abs(slow.sum())


def test_lm_knows_pairs_seen_once(spark):
    rows = [(i, f"a{i} b{i}") for i in range(40)] + [(100 + i, f"a{i} b{(i + 1) % 40}") for i in range(40)]
    got = {r.doc_id: r.score for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") >= 100).collect()}
    assert np.mean([got[i] > got[100 + i] + 1 for i in range(40)]) > 0.9


def test_lm_empty_and_untrained(docs, empty):
    assert lm.scored(empty, F.lit(False)).count() == 0
    assert {(r.n_known, r.train_tokens, r.base_score) for r in lm.scored(docs, F.lit(True)).collect()} == {(0, 0, 0.0)}


def test_regions_hold_counts_and_sums():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))
    counts = r.integers(1, 1000, len(keys))
    region = lm.Region(lm.Region.made([lm.chain(keys, lm.quantised(counts))] + lm.valued(lm.mix64(keys), counts + 0.25)))
    levels = region.levels(keys)
    assert (levels >= lm.quantised(counts)).all() and (levels == lm.quantised(counts)).mean() > 0.98
    assert (region.levels(r.integers(0, 2**63, 5000, dtype=np.uint64)) > 0).mean() < 0.02
    assert np.mean(np.abs(region.values(lm.mix64(keys)) / (counts + 0.25) - 1) < 0.005) > 0.95
    assert (lm.Region(b"").levels(keys) == 0).all() and (lm.Region(b"").values(keys) == 0).all()


def test_levels_stand_for_means():
    assert lm.quantised([0, 1, 2, 3, 4, 7, 8]).tolist() == [0, 1, 2, 2, 3, 3, 4]
    assert lm.EXPECTED[0] == 0 and lm.EXPECTED[1] == 1
    for q in (2, 3, 6, 12):
        c = np.arange(2 ** (q - 1), 2**q)
        assert lm.EXPECTED[q] == pytest.approx((1 / (c + 1)).sum() / (1 / (c * (c + 1.0))).sum())


def test_packed_arrays_round_trip():
    a, b = np.array([0, 5, 2**64 - 1], np.uint64), np.array([1.5], np.float32)
    got = lm.unpacked(lm.packed(lm.steps(a), b, a[:0]), np.uint64, np.float32, np.uint64)
    assert np.cumsum(got[0], dtype=np.uint64).tolist() == a.tolist() and got[1].tolist() == [1.5] and not len(got[2])


# 2


def brute_targets(sizes, most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while open_:
        left, w = total - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        target |= {s: float(most * sizes[s]) for s in over}
        open_ -= over
    return target


def test_mix_targets_and_words(docs, rows):
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(words(t))
    target = brute_targets(sizes)
    got = mixing.mix(docs, block_words=16, shard_blocks=32).collect()
    assert Counter((r.doc_id, r["size"], r.source, r.source_size) for r in got) == Counter((i, len(words(t)), s, sizes[s]) for i, t, _, s, *_ in rows)
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 1.5 * 16
    again = mixing.mix(docs.repartition(7), block_words=16, shard_blocks=32).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_mix_targets_stop_at_three_times_a_source(spark):
    sizes = {"a": 1000, "b": 10, "c": 10, "d": 0, None: 5}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_permutation_is_one(spark):
    for n in (1, 2, 3, 10, 257):
        got = spark.range(n).selectExpr(f"{mixing.permuted('id', f'{n}L', '7L')} AS p").collect()
        assert sorted(r.p for r in got) == list(range(n))


def test_shards_draw_multinomial_counts(spark):
    """Counts of shards vary as independent draws do; all slots are filled, no block more than thrice, blocks by permutation."""
    rows = [(s * 10_000 + i, " ".join(["w"] * 40), f"src{s}") for s, n in enumerate((1200, 900, 600)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    m = mixing.Mix(mixing.sized(docs, "doc_id", "text", "source"), 8, 100, (1, 2, 3), 3, 1)
    drawn = {(r.shard, r.src): r["count"] for r in m.drawn().selectExpr("id div 100 AS shard", "src").groupBy("shard", "src").count().collect()}
    quota = {r.src: r.quota for r in m.quota.collect()}
    share = {s: q / m.slots for s, q in quota.items()}
    shards = m.slots // 100
    for s, p in share.items():
        counts = np.array([drawn.get((i, s), 0) for i in range(shards)])
        assert abs(counts.mean() - 100 * p) < 4 * (100 * p * (1 - p) / shards) ** 0.5 and 0.6 < counts.var() / (100 * p * (1 - p)) < 1.6
    filled = m.filled().collect()
    assert sorted(r.id for r in filled) == list(range(m.slots)) and Counter(r.src for r in filled) == quota
    blocks = Counter((r.src, r.block) for r in filled)
    for s, q in quota.items():
        times = [n for (x, _), n in blocks.items() if x == s]
        assert max(times) - (min(times) if q >= m.slots else 0) <= 3 and max(times) <= -(-q // (len(times) or 1)) + 1


def test_mix_of_nothing(empty, docs):
    assert mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).collect()} == {0}


def test_mixed_holds_the_words_that_are_taken(docs, rows):
    taken, out = Counter(), Counter()
    for r in mixing.mix(docs, block_words=16, shard_blocks=32).collect():
        taken[r.doc_id, r.source] += r.taken
    got = mixing.mixed(docs, block_words=16, shard_blocks=32)
    assert got.columns == docs.columns
    whole = {(i, s): [*m] for i, s, m in ((i, s, [words(t) for j, t, _, u, *_ in rows if (i, s) == (j, u)]) for i, _, _, s, *_ in rows)}
    for r in got.collect():
        w = words(r.text)
        out[r.doc_id, r.source] += len(w)
        assert any(all(x in iter_ for x in w) for iter_ in map(lambda t: iter(t), whole[r.doc_id, r.source]))  # in order, nothing else
    assert +taken == +out


def test_mixed_meets_targets(spark):
    rows = [(s * 100_000 + i, " ".join(["w"] * (40 + i % 200)), f"src{s}") for s, n in enumerate((2000, 400, 200)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    got = {r.source: r.words for r in mixing.mixed(docs).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("words")).collect()}
    assert target["src0"] < 150_000 and all(abs(got[s] - target[s]) <= 1.5 * 128 for s in target)


def test_mix_keeps_a_callers_columns(spark):
    df = spark.createDataFrame([(i, f"some words {i}", "s", i, "x", "y", i, i) for i in range(5)], "doc_id long, text string, source string, uid long, doc string, src string, time long, pieces long")
    got = mixing.mixed(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, df.collect()))


# 3


def brute_join(rows, k, num, den):
    def sets(t):
        w = words(t)
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    distinct = list({sets(t) for _, t, *_ in rows} - {frozenset()})
    up = list(range(len(distinct)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    links = set()
    for i, a in enumerate(distinct):
        for j in range(i):
            if a & distinct[j] and den * len(a & distinct[j]) >= num * len(a | distinct[j]):
                links.add((i, j))
                up[top(i)] = top(j)
    ids = defaultdict(list)
    at = {s: i for i, s in enumerate(distinct)}
    for i, t, *_ in rows:
        if (s := sets(t)) and i is not None:
            ids[top(at[s])].append(i)
    out = Counter()
    for i, t, *_ in rows:
        s = sets(t)
        out[(i, len(s), min(ids[top(at[s])], default=i) if s else i)] += 1
    return out, len(links)


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80), (1, 50)])
def test_join_components(docs, rows, k, num):
    got = Counter(map(tuple, ngram_join.joined(docs, k, num, 100).collect()))
    assert got == brute_join(rows, k, num, 100)[0]


def test_join_links_are_all(docs, rows):
    pairs, members = ngram_join.links(docs, 3, 80, 100)
    assert pairs.count() == brute_join(rows, 3, 80, 100)[1]
    assert members.where("doc_id <> text_id").count() > 0


def test_join_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Lists longer than a part, pairs across parts, and components that neighbours alone don't find."""
    import random

    monkeypatch.setattr(ngram_join, "LIST", 16)
    monkeypatch.setattr(ngram_join, "NEAR", 2)
    r = random.Random(9)
    base = [f"w{r.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(30)}"
        rows.append((i, " ".join(w)))
    got = Counter(map(tuple, ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()))
    assert got == brute_join(rows, 3, 90, 100)[0]
    assert 1 < len({c for _, _, c in got}) < 220


def test_join_deals_out_no_texts_that_share_nothing(spark):
    """Shuffles take disk: words are long here, so that they would show. Tables count as too large for a broadcast."""
    r = np.random.default_rng(9)
    texts = [" ".join(r.bytes(100).hex() for _ in range(60)) for _ in range(300)]
    rows = [*enumerate(texts), (300, texts[7] + " more"), (301, texts[8])]
    status = spark.sparkContext._jsc.sc().statusStore()
    before = status.executorSummary("driver").totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = Counter(map(tuple, ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    moved = status.executorSummary("driver").totalShuffleWrite() - before
    assert got == Counter([*((i, 58, i) for i in range(300)), (300, 59, 7), (301, 58, 8)])
    assert 0 < moved < sum(map(len, texts)) / 4


def test_a_sieve_keeps_all_keys_and_little_else(spark):
    rows = spark.range(20_000).selectExpr("IF(id = 0, NULL, CAST(id AS string)) AS k", "id")
    keys = spark.range(0, 20_000, 10).selectExpr("IF(id = 0, NULL, CAST(id AS string)) AS other")
    kept = {x["id"] for x in ngram_join.sieved(rows, "k", keys).collect()}
    assert kept >= set(range(0, 20_000, 10)) and len(kept) < 2_100
    assert ngram_join.sieved(rows, "k", keys).columns == rows.columns
    assert ngram_join.sieved(rows, "k", keys.limit(0)).count() == 0


def test_join_of_nothing(empty):
    assert ngram_join.joined(empty).count() == 0


@pytest.mark.parametrize("at_once", [1 << 19, 10])
def test_components_of_a_chain_a_star_and_loops(spark, monkeypatch, at_once):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(70, 70), (71, 72), (72, 71)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 0 for i in range(1, 50)}, 72: 71}


# 4


def test_licenses_base(docs, rows):
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    expected = Counter()
    for i, t, *_ in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hits = tuple(sorted((k, label) for label, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()))
        expected[(i, len(w), hits)] += 1
    got = licenses.scanned(docs).collect()
    assert Counter((r.doc_id, r.n_words, tuple(sorted((b.word, b.label) for b in r.base))) for r in got) == expected
    assert sum(len(hits) * n for (*_, hits), n in expected.items()) > 3


def test_licenses_containment_and_priority(spark):
    text = "Licensed under the GNU Lesser General Public License, version 2.1. All rights reserved. CC BY-NC-SA 4.0"
    (r,) = licenses.scanned(spark.createDataFrame([(text,)], "text string")).collect()
    labels = {d.label for d in r.detections}
    assert {"lgpl-2.1", "cc-by-nc-sa-4.0", "all-rights-reserved"} <= labels and "unknown-license" not in labels and "cc-by-nc-sa" not in labels
    for d in r.detections:
        assert not any(o != d and o.start <= d.start and o.stop >= d.stop and o.priority <= d.priority for o in r.detections)


LICENSED = (
    ("Released under GPLv3", ["gpl-3"]),
    ("under the GNU GPL v3+ only", ["gpl-3"]),
    ("SPDX-License-Identifier: GPL-2.0-or-later", ["gpl-2-or-later"]),
    ("This is MIT-licensed code", ["mit"]),
    ("SPDX-License-Identifier: Apache-2.0", ["apache-2"]),
    ("Licensed under the GNU Lesser General Public License, version 2.1.", ["lgpl-2.1"]),
    ("GNU Lesser General Public License version 2.1 or later", ["lgpl-2.1-or-later"]),
    ("CC BY-NC-SA 4.0", ["cc-by-nc-sa-4.0"]),
    ("Creative Commons Attribution-ShareAlike 3.0", ["cc-by-sa-3.0"]),
    ("3-clause BSD license", ["bsd-3-clause"]),
    ("BSD 2-Clause License", ["bsd-2-clause"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", ["bsd"]),
    ("Mozilla Public License 2.0", ["mpl-2.0"]),
    ("MPL-2.0", ["mpl-2.0"]),
    ("AGPLv3", ["agpl-3"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl-3"]),
    ("All rights reserved.", ["all-rights-reserved"]),
    ("Released under the MIT license.", ["mit"]),
    ("Licensed under the Apache License, Version 2.0.", ["apache-2"]),
    ("licensed under CC BY-NC 4.0", ["cc-by-nc-4.0"]),
    ("we went to mit and saw the boost in apache land by the python", []),
    ("http://www.apache.org/licenses/LICENSE-2.0", ["apache-2.0"]),
    ("dedicated to the public domain", ["public-domain"]),
    ("either version 2 of the License, or (at your option) any later version", ["gpl-2-or-later"]),
    ("a copy of the Eclipse Public License v2.0", ["epl-2.0"]),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["isc"]),
)


def test_licenses_of_a_table_of_texts(spark):
    df = spark.createDataFrame([(t, list(e)) for t, e in LICENSED], "text string, expected array<string>")
    for r in licenses.scanned(df).collect():
        assert sorted({d.label for d in r.detections}) == r.expected, r.text


#: Matches of rules that hold no word for a license, right or permission.
UNNAMED = (
    ("Released under MIT", ["mit"]),
    ("published under the terms of the ISC", ["isc"]),
    ("ASL 2.0", ["apache-2"]),
    ("OFL-1.1", ["ofl-1.1"]),
    ("Artistic 2.0", ["artistic-2.0"]),
    ("GNU Free Documentation, version 1.3 or later", ["gfdl-1.3-or-later"]),
    ("SSPL", ["sspl"]),
    ("BUSL 1.1", ["busl-1.1"]),
    ("ODbL v1.0", ["odbl-1.0"]),
    ("Open Government 3.0", ["open-government-3.0"]),
    ("Altered source versions must be plainly marked as such, and must not be misrepresented", ["zlib"]),
    ("You can buy me a beer in return", ["beerware"]),
    ("with Reserved Font Name X", ["ofl"]),
    ("Commons Clause", ["commons-clause"]),
    ("use restrictions set forth in Attachment A", ["openrail"]),
    ("Gemma Terms of Use", ["gemma"]),
    ("Unauthorized copying of this file", ["proprietary"]),
    ("for personal and non-commercial use only", ["non-commercial"]),
    ("a work of the United States Government", ["us-government"]),
)


def test_licenses_of_texts_without_the_word(spark):
    df = spark.createDataFrame([(t, list(e)) for t, e in UNNAMED], "text string, expected array<string>")
    for r in licenses.scanned(df).collect():
        assert sorted({d.label for d in r.detections}) == r.expected, r.text


def test_licenses_against_all_rules_on_all_texts(spark):
    import random

    given, rng = [t for t, _ in LICENSED + UNNAMED], random.Random(4)
    texts = [*given, *("; ".join(rng.sample(given, 4)) for _ in range(20)), "a strong copyleft license", "strongcopyleft license", "apache org", "general public", "cc by ncx"]
    every = [(r, re.compile(r["regex"])) for r in licenses.rules()]
    got = {r.text: sorted(tuple(d) for d in r.detections) for r in licenses.scanned(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    for t in texts:
        found = [(r["priority"], r["n"], r["label"], *m.span(), r["weight"]) for r, x in every for m in x.finditer(licenses_spaced(t))]
        inside = lambda d, o: o[3] <= d[3] and o[4] >= d[4] and o[0] <= d[0] and (o[4] - o[3] > d[4] - d[3] or o[0] < d[0] or o[1] < d[1])
        assert got[t] == sorted(d for d in found if not any(inside(d, o) for o in found)), t


def test_licenses_longest_keywords():
    import random

    keywords, rng = [g["keyword"] for g in licenses.grouped()], random.Random(6)
    at = re.compile(f" (?=({licenses.longest(keywords)}))")
    for _ in range(300):
        text = " " + " ".join(k[: rng.choice([len(k), len(k), rng.randint(1, len(k))])] for k in rng.sample(keywords, 5)) + " "
        assert {k for k in keywords if f" {k}" in text} == {k for k in keywords for h in at.findall(text) if h.startswith(k)}, text


def test_licenses_rules_hold_their_keywords(empty):
    assert 300 <= len(licenses.rules()) and len({r["keyword"] for r in licenses.rules()}) > 150
    for r in licenses.rules():
        re.compile(r["regex"])
        assert len(r["keyword"].strip()) >= 3
    texts = [licenses_spaced(t) for t, _ in LICENSED]
    assert all(r["keyword"] in t or not re.search(r["regex"], t) for t in texts for r in licenses.rules())
    assert licenses.scanned(empty).count() == 0


def licenses_spaced(text):
    return " " + re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", text.lower() + " ").lstrip()


def test_licenses_keep_a_callers_columns(spark):
    df = spark.createDataFrame([("under the MIT license", "a", "b", "c", "d", "e", "f")], "text string, words string, rules string, spaced string, hit string, doc string, groups string")
    (r,) = licenses.scanned(df).collect()
    assert tuple(r)[:7] == tuple(df.first()) and r.n_words == 4 and [b.word for b in r.base] == [0]


# 5


def test_urls(spark):
    pages = [
        (1, "http://Example.NET/en/x?y"), (2, "https://example.net/EN/"), (3, "http://a.b.example.com/de/"), (4, "http://notexample.com/de/"), (5, "http://x.org/fr/#a"), (6, "http://net"), (7, "http://net/"), (8, None),
        (9, "no scheme"), (10, ""), (11, "ftp://spam-farm.example.org/en"), (12, "http://ok.example.org/a/casino/"), (13, "http://casinos.example.org/"), (14, "http://h.com"), (14, "http://h.com"), (15, "x://y://z.net/"), (16, "http://x.org/fr\n/b"),
        (17, "http://x.org/fr?/b"), (None, "http://x.net/"), (18, "http://h.org/a\nb/casino"), (19, "http://free-BETS.example.com/x"), (20, "http://a.ads.example.com/"), (21, "http://ads.example.com"), (22, "http://nads.example.com/"), (23, "http://h.com/a.exe"),
        (24, "http://h.com/a.exe\n"), (25, "http://h.com/sex-education/casino"), (26, "http://h.com/WP-admin/x"), (27, "http://en.wikipedia.org/porn"),
    ]

    def judge(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
            path = re.match(r"[^?#]*", rest[len(host) :])[0]
        fits = [(len(h + p), h + p, a) for a, h, p in urls.BASE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        found = {a for a, pattern, _ in map(urls.parsed, urls.PATTERN_RULES) if re.search(pattern.replace(r"\z", r"\Z"), (host + path).lower())}
        return host, path, None, "block" if found == {"block"} else "allow"

    df = spark.createDataFrame(pages, "page_id long, url string").withColumns({"host": F.lit(1), "rule": F.lit(2), "token": F.lit("net"), "_best": F.lit(3), "_host": F.lit(4)})
    got = urls.judged(df).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *judge(u)) for i, u in pages)
    assert urls.judged(df.limit(0)).count() == 0


def test_url_patterns():
    verdict = lambda rule, text: bool(re.search(urls.parsed(rule)[1].replace(r"\z", r"\Z"), text))
    for rule, yes, no in (
        ("||a.com^", ["a.com", "x.a.com/b"], ["ba.com/x", "a.com.de", "x/a.com/"][:1]), ("|a.com", ["a.com/x"], ["b.a.com/x"]), ("/x.exe|", ["h/x.exe"], ["h/x.exe/y"]),
        ("^casino^", ["casino", "casino.de/", "h/casino", "the-casino.com", "h/a-casino-b"], ["casinos.de", "mycasino.de"]), ("a*b^", ["axxb", "ab/"], ["axxbc"]), ("@@^ok^", ["ok"], ["okay"]),
    ):
        assert all(verdict(rule, x) for x in yes) and not any(verdict(rule, x) for x in no), rule
    assert urls.parsed("||ads.example.com^")[2] == ["ads", "com", "example"] and urls.parsed("a*bcd^efg")[2] == [] and urls.parsed("@@^x-y^")[0::2] == ("allow", ["x", "y"])
    assert urls.parsed("*.exe|")[2] == ["exe"] and urls.parsed("/wp-admin/*")[2] == ["admin", "wp"]


def test_url_tokens_leave_out_what_may_go_on():
    assert urls.literal_tokens("a.com", "/de") == ["a", "com"]
    assert urls.literal_tokens("a.com", "/de/x") == ["a", "com", "de"]


# 6


@pytest.mark.parametrize("code", [media.NONE, media.LZW, media.DEFLATE, media.PACKBITS, media.OLD_DEFLATE])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(code, order):
    r = np.random.default_rng(code)
    for kind in (np.uint8, np.uint16):
        for shape in ((1, 1), (5, 7), (70, 33, 3)):
            for predictor in (1, 2):
                for tile in (None, (16, 32)):
                    images = [(r.integers(0, 60, shape) // r.integers(1, 9)).astype(kind), np.zeros(shape, kind)]
                    got = media.pages(media.encode(images, code, predictor, tile, 9, order))
                    assert [e for *_, e in got] == [None, None]
                    for (_, x, _), y in zip(got, images, strict=True):
                        assert (x == (y if y.ndim == 3 else y[:, :, None])).all()


def test_lzw_over_full_tables():
    for high in (2, 5, 256):
        data = np.random.default_rng(high).integers(0, high, 60_000, dtype=np.uint8).tobytes()
        assert media.lzw(media.pack_lzw(data), len(data)) == data


def test_lzw_and_packbits_of_the_specification():
    assert media.lzw(bytes.fromhex("8001E0408044080C068080"), 99) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    assert media.packbits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 99) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_samples_planes_and_offsets(order):
    r = np.random.default_rng(5)
    for wide in (False, True):
        for shape in ((1, 1), (5, 7, 3), (40, 33, 2)):
            for planar in (1, 2):
                for tile in (None, (16, 16)):
                    options = {"tile": tile, "strip_rows": 9, "order": order, "planar": planar, "wide": wide}
                    cases = [(r.integers(0, 1 << b, shape).astype(np.uint8), 1, b) for b in (1, 2, 4)]
                    cases += [(r.integers(0, 1000, shape).astype(k), p, None) for k in ("u4", "i2", "i4", "u8") for p in (1, 2)]
                    cases += [(r.normal(size=shape).astype(k), p, None) for k in ("f2", "f4", "f8") for p in (1, 3)]
                    for x, predictor, bits in cases:
                        ((_, got, error),) = media.pages(media.encode([x], media.DEFLATE, predictor, bits=bits, **options))
                        assert error is None and got.dtype == x.dtype and (got == (x if x.ndim == 3 else x[:, :, None])).all()


def test_tiff_refuses_what_it_does_not_read():
    good = media.encode([np.full((3, 4), 7, np.uint8)], media.NONE)
    for tag, value in ((media.BITS, 5), (media.PREDICTOR, 3), (media.PREDICTOR, 7), (media.COMPRESSION, 6), (media.WIDTH, 0)):
        at = good.index(media.struct.pack("<H", tag) + (b"\4\0" if tag == media.WIDTH else b"\3\0"))
        ((_, image, error),) = media.pages(good[: at + 8] + media.struct.pack("<I", value) + good[at + 12 :])
        assert image is None and error


def test_tiff_pages_keep_columns_and_survive_broken_files(spark):
    good = media.encode([np.full((3, 4), 7, np.uint8), np.full((2, 2, 3), 9, np.uint8)])
    loop = good[:-4] + good[4:8]  # the last directory leads to the first again
    assert loop != good
    files = [(1, good), (2, b""), (3, None), (4, good[:30]), (5, b"II*\0\x08\0\0\0"), (6, loop)]
    got = media.tiff_pages(spark.createDataFrame(files, "id int, data binary").withColumn("page", F.lit("clash"))).collect()
    for i in (1, 6):
        assert [(r.page, r.width, r.height, r.samples, r.bits, r.format, r.error) for r in got if r.id == i] == [(0, 4, 3, 1, 8, "uint", None), (1, 2, 2, 3, 8, "uint", None)]
    assert all(r.error and r.pixels is None for r in got if r.id in (2, 3, 4, 5))
    assert media.tiff_pages(spark.createDataFrame([], "id int, data binary")).count() == 0


def test_text_tiffs(rows):
    for _, t, *_ in rows:
        n, data = media.text_tiff(t)
        ((_, image, error),) = media.pages(data)
        raw = (t or "").encode()
        assert error is None and n == len(raw) and image.tobytes() == raw + bytes(max(64, -(-n // 64) * 64) - n)


# 7


def test_automaton_agrees_with_distance():
    def distance(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            d, last = [i], d
            for j, y in enumerate(b, 1):
                d.append(min(last[j] + 1, d[-1] + 1, last[j - 1] + (x != y)))
        return d[-1]

    found = ["clown", "clwn", "cloown", "clawn", "brown", "c", "", "clownish", "nwolc"]
    for a in found:
        for b in found:
            for k in (0, 1, 2):
                m = toxicity.Automaton(a, k)
                s = m.start()
                for c in b:
                    s = m.step(s, c)
                assert m.accepts(s) == (distance(a, b) <= k)


def test_lexicon_finds_words_stems_and_misspellings():
    x = toxicity.Lexicon([("idiot", False, 5.0), ("worthless", False, 4.0), ("lowei", True, 3.0), ("bad", False, 1.0)])
    assert x.find("idiot") == (0, False) and x.find("1d10t") == (0, True) and x.find("idjot") == (0, True) and x.find("worthles") == (1, True)
    assert x.find("loweischaft") == (2, False) and x.find("bda") is None and x.find("id") is None and x.find("thread") is None


def test_lexicon_finds_swapped_letters():
    x = toxicity.Lexicon([("idiot", False, 5.0), ("stem", True, 3.0)])
    assert all(x.find(w) == (0, True) for w in ("diiot", "iidot", "idoit", "idito"))
    assert x.find("tidoi") is None and toxicity.Lexicon([("idiot", False, 5.0)], k=0).find("idoit") is None
    with pytest.raises(ValueError):
        toxicity.Lexicon([("idiot", False, 5.0)], k=2)


def test_the_gate_keeps_nothing_out():
    x = toxicity.Lexicon([("idiot", False, 5.0), ("worthless", False, 4.0)])
    letters = "abdehilorstw"
    for term in ("idiot", "worthless"):
        edits = {term[:i] + c + term[i + j :] for i in range(len(term) + 1) for c in (*letters, "") for j in (0, 1)}
        assert all(x.find(w) is not None for w in edits if len(w) >= 4)


def test_quotations_of_any_length():
    assert toxicity.quotations('a "b c" “d” e „f“ «g» "h') == [(2, 7), (8, 11), (14, 17), (18, 21)]
    assert toxicity.quotations('"' + "x" * 9000 + '" "a\nb" c') == [(0, 9002), (9007, 9007)][:1]
    assert len(toxicity.quotations("“ " * 200_000)) == 0


def test_quotation_counts_less():
    x = toxicity.Lexicon([("idiot", False, 5.0)])
    assert toxicity.features("you are an idiot", x)[0] > toxicity.features("a long “idiot” stood there", x)[0] > 0
    assert toxicity.features(None, x) == toxicity.features("", x) == [0.0] * toxicity.FEATURES


def test_toxicity_held_out(spark, docs):
    r = np.random.default_rng(3)
    base = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        w = list(r.choice(base, 40))
        if toxic := i % 4 == 0:
            for k in r.integers(0, 40, 4):
                w[k] = r.choice(["badword", "vileterm", "stemmyx", "stemmyyy", "stemmyz"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None), (10**9, 1)], "doc_id long, toxic int")
    model = toxicity.fitted(d, y, toxicity.training_out())
    got = {x.doc_id: x.score for x in toxicity.scored(d, model).where(toxicity.training_out()).collect()}
    assert len(got) > 100 and sum((s >= 0.7) == (i % 4 == 0) for i, s in got.items()) >= 0.97 * len(got)
    assert toxicity.scored(docs, model).count() == docs.count()
    assert toxicity.scored(docs, toxicity.fitted(docs, y.limit(0), toxicity.training_out())).where("score >= 0.7").count() == 0


# 8


def test_bpe_equals_the_library(docs, rows):
    import tiktoken

    path, pattern = bpe.vocabulary()
    b = bpe.bpe(path, pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=b.ranks, special_tokens={})
    odd = ["<|endoftext|>", " \n\n  x ", "日本語😀 don't I'LL 123", "a" * 3000, "\ufffd\u0301" * 40]
    for t in odd:
        assert b.encode(t) == other.encode_ordinary(t) and b.decode(b.encode(t)).decode() == t
    expected = Counter((i, tuple(other.encode_ordinary(t or ""))) for i, t, *_ in rows)
    out = bpe.encoded(docs)
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == expected
    assert Counter((r.doc_id, r.text) for r in bpe.decoded(out).collect()) == Counter((i, t or "") for i, t, *_ in rows)
    shown = {(r.doc_id, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs, digests=True).collect()}
    assert shown == {(i, hashlib.sha256(" ".join(map(str, other.encode_ordinary(t or ""))).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows}


def test_bpe_of_very_long_pieces():
    """As the library, in a time that grows with the piece and not with its square."""
    import random
    import time

    import tiktoken

    path, pattern = bpe.vocabulary()
    b = bpe.bpe(path, pattern)
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=b.ranks, special_tokens={})
    r = random.Random(4)
    for n in (511, 512, 513, 3000, 20_000):
        for letters in ("ab", "etaoinshrdlu", "é日"):
            t = "".join(r.choice(letters) for _ in range(n))
            assert b.encode(t) == other.encode_ordinary(t)
    t = "".join(r.choice("etaoinshrdlu") for _ in range(200_000))
    began = time.time()
    ids = b.encode(t)
    assert time.time() - began < 20 and b.decode(ids).decode() == t


def test_pair_table_finds_all_and_nothing_else():
    r = np.random.default_rng(2)
    pairs = np.unique(r.integers(0, 5000, (20_000, 2)), axis=0).astype(np.int32)
    t = bpe.PairTable(pairs[:, 0], pairs[:, 1], np.arange(len(pairs), dtype=np.int32))
    assert (t.find(pairs[:, 0], pairs[:, 1]) == np.arange(len(pairs))).all()
    assert (t.find(pairs[:, 0] + 5000, pairs[:, 1]) == bpe.NO_RANK).all()


# 9

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 13 <= len(d) <= 19 and pii.luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append((kind, *m.span()))
    return out


def test_pii_base_spans(rows):
    import random

    r = random.Random(3)
    made = ["".join(r.choice("a1.2@+ -(5)9b é0") for _ in range(r.randint(0, 60))) for _ in range(5000)]
    for t in [*made, *(t or "" for _, t, *_ in rows)]:
        assert pii.base_spans(t) == brute_spans(t)


def test_pii_keeps_base_and_adds_what_it_missed():
    text = "call +1 (269) 555-3296 4524132264652876 now, order 1234-5678"
    base, spans = pii.found(text)
    assert not [s for s in base if s[0] == "phone"] and ("phone", 5, 22) in spans and set(base) <= set(spans)
    assert pii.found("version 1.2.3, on 2024-11-05 in 123 pages") == ([], [])
    assert pii.redacted("a b@c.de f", pii.found("a b@c.de f")[1]) == "a [EMAIL] f"


def test_pii_is_calibrated():
    trees, least = pii.model()
    held = pii.examples(400, 99)
    p, y = trees.probability(np.array([pii.features(t, s) for t, s, _ in held], float)), np.array([y for *_, y in held])
    assert y[p >= least].mean() > 0.97 and (p >= least)[y == 1].mean() > 0.95
    assert abs(p.mean() - y.mean()) < 0.05


def test_pii_frame(docs, rows, empty):
    got = pii.scrubbed(docs).collect()
    assert Counter((r.doc_id, r.text, tuple(map(tuple, r.pii))) for r in got) == Counter((i, pii.redacted(t, pii.found(t)[1]), tuple(pii.found(t)[1])) for i, t, *_ in rows)
    assert pii.scrubbed(empty).count() == 0 and pii.scrubbed(docs, digests=True).where("spans <> ''").count() == 1


def test_pii_long_runs_are_read_once():
    for t in ("1" * 200_000, "a." * 100_000, "+1" * 100_000, "1 " * 100_000, "@" * 100_000, "1." * 100_000):
        pii.found(t)


# 10


def brute_nearest(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, x in {i: v for i, v in reversed(good) if i % every == 0}.items():
        near = sorted((-float((x * v).sum()), i) for i, v in good if i != q and len(v) == len(x))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_nearest_is_exact_at_factor_one(spark):
    r = np.random.default_rng(4)
    x = [(i, [float(np.float32(a)) for a in r.normal(size=8)]) for i in range(700)]
    x += [(1000 + i, x[40][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 8), (2040, [None] * 8), (2060, [float("nan")] * 8), (2080, [float("inf")] * 8), (None, x[1][1]), (3000, []), (3020, [1.0, 2.0])]
    df = spark.createDataFrame(x, "vec_id long, embedding array<float>").withColumns({"id": F.lit("clash"), "dim": F.lit(0)})
    got = sorted(map(tuple, ann.nearest(df, k=5, every=20, shard_rows=200, query_rows=16).collect()))
    assert [g[:3] for g in got] == [e[:3] for e in brute_nearest(x, 5, 20)]
    assert all(a[3] == pytest.approx(b[3]) for a, b in zip(got, brute_nearest(x, 5, 20), strict=True))
    relaxed = {g[:1] + g[2:3] for g in map(tuple, ann.nearest(df, k=5, every=20, factor=1.5, shard_rows=200).collect())}
    assert len(relaxed & {g[:1] + g[2:3] for g in got}) >= 0.9 * len(got)


@pytest.mark.parametrize(("shard_rows", "a_slice"), [(10_000, 1 << 17), (40, 1 << 17), (40, 5)])
def test_nearest_of_hundreds_of_equal_scores(spark, monkeypatch, shard_rows, a_slice):
    """Different vectors with one inner product with the queries, over one shard and over many, at once and in slices."""
    monkeypatch.setattr(ann, "SLICE", a_slice)
    r = np.random.default_rng(6)
    x = [(i, [1.0, 0.0, 0.0]) for i in (0, 20)] + [(i, [0.5, float(a), float(b)]) for i, (a, b) in enumerate(r.normal(size=(400, 2)), 1) if i != 20]
    df = spark.createDataFrame(x, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(g) for g in ann.nearest(df, k=20, every=20, shard_rows=shard_rows, query_rows=7).collect())
    assert got == brute_nearest(x, 20, 20)
    assert [g[2] for g in got if g[0] == 0] == [20, *range(1, 20)]


def test_nearest_skips_cells_that_cannot_reach_the_bar(spark):
    """Clusters far from each other: what is compared grows by less than the square of the rows, and is exact."""
    r = np.random.default_rng(8)
    seen = {}
    for n in (400, 1600):
        centres = r.normal(size=(n // 50, 16)) * 20
        x = [(i, (centres[i % len(centres)] + r.normal(size=16)).tolist()) for i in range(n)]
        df = spark.createDataFrame(x, "vec_id long, embedding array<double>")
        assert [g[:3] for g in sorted(map(tuple, ann.nearest(df, k=5, every=20, shard_rows=50).collect()))] == [e[:3] for e in brute_nearest(x, 5, 20)]
        rows = df.selectExpr("vec_id AS id", "embedding AS v", "size(embedding) AS dim")
        cells = ann.Cells.of(rows, n, 50)
        v = np.array([b for _, b in x])
        at = cells.cell(v)
        bar = np.sort(v[::20] @ v.T, axis=1)[:, -6]
        go = 0
        for c in np.unique(at):
            radius = np.sqrt(((v[at == c] - cells.pivots[16][c]) ** 2).sum(axis=1)).max()
            reach = v[::20] @ cells.pivots[16][c] + np.sqrt((v[::20] ** 2).sum(axis=1)) * radius
            go += int((reach >= bar).sum()) * int((at == c).sum())
        seen[n] = go
    assert seen[1600] < 0.75 * 16 * seen[400]


def test_nearest_of_few_or_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, ann.nearest(df).collect())) == [(0, 1, 20, 0.5), (20, 1, 0, 0.5)]
    assert ann.nearest(df.limit(0)).count() == 0
