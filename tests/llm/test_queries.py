"""The queries over the driver's smallest tables, their SQL, and the pipeline stage by stage."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from glyphflow.llm import bpe, licenses, media, mixing, ngram_join, pii
from glyphflow.llm.queries import QUERIES, SQL

from .test_operators import PATTERNS, brute_join, brute_spans

COLUMNS = {
    1: "doc_id held_out n_tokens n_known train_tokens base_score score",
    2: "doc_id size source_size target taken",
    3: "doc_id n_shingles component_id",
    4: "doc_id n_words n_base first_word last_word base_labels labels score",
    5: "page_id host path rule verdict",
    6: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    7: "doc_id held_out score predicted",
    8: "doc_id n_tokens ids_sha256 decoded_sha256",
    9: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
    10: "query_id rank vec_id score",
}


@pytest.mark.parametrize("n", range(1, 11))
def test_queries(spark, sf_dir, n):
    (name,) = (q for q in QUERIES if q.startswith(f"op{n}_"))
    assert name in __spark_entry__.queries()
    df = QUERIES[name](spark, sf_dir)
    assert df.columns == COLUMNS[n].split()
    rows = Counter(map(tuple, df.collect()))
    if n not in (5, 10):
        assert sum(rows.values()) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    if name in SQL:
        c = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS FROM '{sf_dir}/{t}.parquet'")
        result = c.sql(SQL[name])
        at = [result.columns.index(x) for x in df.columns]
        assert Counter(tuple(r[i] for i in at) for r in result.fetchall()) == rows


def documents(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def rows_of(spark, sf_dir, n):
    (name,) = (q for q in QUERIES if q.startswith(f"op{n}_"))
    return {r.doc_id: r for r in QUERIES[name](spark, sf_dir).collect()}


def test_op2_is_near_its_targets(spark, sf_dir):
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for i, r in rows_of(spark, sf_dir, 2).items():
        assert 0 <= r.taken <= 3 * r["size"]
        taken[sources[i]] += r.taken
        target[sources[i]] = r.target
    assert all(abs(taken[s] - t) <= 1.5 * 128 for s, t in target.items()) and sum(target.values()) == pytest.approx(sum(taken.values()), rel=0.1)


def test_op4_against_brute_force(spark, sf_dir):
    texts = documents(spark, sf_dir)
    for i, r in rows_of(spark, sf_dir, 4).items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i]))
        hits = sorted((k, label) for label, p in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        labels = sorted({label for _, label in hits})
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(labels))
        found = r.labels.split(",") if r.labels else []
        assert found == sorted(set(found)) and set(labels) <= set(found) and 0 <= r.score <= 1 and (r.score > 0) == bool(found)


def test_op6_against_brute_force(spark, sf_dir):
    texts, seen = documents(spark, sf_dir), {}
    for i, r in rows_of(spark, sf_dir, 6).items():
        raw = texts[i].encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        x = np.frombuffer(padded, np.uint8).astype(object)
        n, total, squares = len(x), int(x.sum()), int((x * x).sum())
        feature = f"64x{n // 64} mean {1000 * total // n} var {1000 * (squares * n - total * total) // (n * n)} values {len(set(padded))}"
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(raw), n, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), feature)
        stored = media.text_tiff(texts[i])[1]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert seen.setdefault(texts[i], tuple(r)[1:]) == tuple(r)[1:]


def test_op7_on_the_fold_that_it_has_not_seen(spark):
    """The driver's own labels, of which a third were kept from the model."""
    sf_dir = "/root/testdata/sf0.01"
    rows, labels = rows_of(spark, sf_dir, 7), {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(labels[i], r.predicted) for i, r in rows.items() if r.held_out and labels.get(i) is not None]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in rows.items())
    hit = sum(t and p for t, p in held)
    assert hit >= 0.7 * sum(t for t, _ in held) > 0 and hit >= 0.9 * sum(p for _, p in held)


def test_op9_against_brute_force(spark, sf_dir):
    texts, kinds = documents(spark, sf_dir), list(PATTERNS)
    for i, r in rows_of(spark, sf_dir, 9).items():
        base = sorted(brute_spans(texts[i]), key=lambda s: (kinds.index(s[0]), s[1]))
        shown = [f"{k}:{s}:{e}" for k, s, e in base]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, *_ in base) for kind in kinds]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest() and set(shown) <= set(r.spans.split(",") if r.spans else [])


def test_ann_recall_against_brute_force(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in found]), np.array([r.embedding for r in found], float)
    got = {(r.query_id, r.vec_id) for r in QUERIES["op10_vptree"](spark, sf_dir).collect()}
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    best = {(int(ids[i]), int(ids[j])) for i in np.flatnonzero(ids % 20 == 0) for j in np.argsort(-s[i], kind="stable")[:20]}
    assert len(got & best) >= 0.9 * len(best)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    steps = {name: f for name, f in corpus_pipeline.STAGES}
    assert list(steps) == ["toxicity", "ngram_join", "pii", "mixing", "bpe"]
    clean = steps["toxicity"](spark, docs, sf_dir)
    kept = {r.doc_id for r in clean.collect()}
    scores = QUERIES["op7_toxicity"](spark, sf_dir).collect()
    assert clean.columns == docs.columns and kept == {r.doc_id for r in scores if not r.predicted}
    alone = steps["ngram_join"](spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert alone.columns == docs.columns and {r.doc_id for r in alone.collect()} == {c for _, _, c in brute_join(rows, 5, 80, 100)[0]}
    blanked = steps["pii"](spark, docs, sf_dir)
    assert blanked.columns == docs.columns and {r.doc_id: r.text for r in blanked.collect()} == {i: pii.redacted(t, pii.found(t)[1]) for i, t in rows}
    mixed = steps["mixing"](spark, docs, sf_dir)
    got, words = Counter(), Counter()
    for r in mixed.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] += len((r.text or "").encode().split())
        words[r.source] += len((r.text or "").encode().split())
    plan = mixing.mix(docs).collect()
    assert mixed.columns == docs.columns and got == +Counter({r.doc_id: r.taken for r in plan})
    assert all(abs(words[r.source] - r.target) <= 1.5 * 128 for r in plan)
    b = bpe.bpe(*bpe.vocabulary())
    assert {r.doc_id: r.ids for r in steps["bpe"](spark, docs, sf_dir).collect()} == {i: b.encode(t or "") for i, t in rows}


def test_pipeline_keeps_a_callers_columns(spark, sf_dir):
    """Names that stages use inside, on rows with null and repeated ids."""
    rows = [(1, "a b c d e f g", "s", 13, *"tpiyxwuvz"), (1, "another text under one id", "s", 25, *"tpiyxwuvz"), (2, "A b c d e f g", "s", 13, *"tpiyxwuvz"), (None, "a b c d e f g", "s", 13, *"tpiyxwuvz"), (None, None, None, 0, *"tpiyxwuvz"), (3, "", "s", 0, *"tpiyxwuvz"), (3, "", "s", 0, *"tpiyxwuvz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, toxic string, pii string, _id string, _text string, _time string, words string, uid string, rules string, doc string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()
    assert sorted(map(str, kept)) == sorted(map(str, [docs.collect()[i] for i in (0, 1, 4, 5)]))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.blank_personal_data, corpus_pipeline.mix_sources):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and all("".join(r[4:]) == "tpiyxwuvz" for r in out.collect()) and out.count() >= 4


def test_pipeline_runs_through(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 50 and "ids" in out.columns


def test_pipeline_with_nulls_and_nothing(spark, docs, empty, sf_dir):
    own = [spark.createDataFrame(d.select("doc_id", "text", "lang", "source", "n_chars").collect(), "doc_id long, text string, lang string, source string, n_chars long") for d in (docs, empty)]
    for d, least in zip(own, (1, 0), strict=True):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, sf_dir)
        assert d.count() >= least


def test_nothing_else_needs_this_subpackage():
    from pathlib import Path

    top = Path(ngram_join.__file__).parents[1]
    for p in top.rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
