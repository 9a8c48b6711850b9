"""Neighbour voting, the Merkle manifest and hard negatives against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from terravox.llm import hard_negatives, merkle_manifest, neighbour_quality, queries

from .test_llm import documents, empty, odd_docs

# --------------------------------------------------------------------- op 11


def plain_counts(text):
    out = Counter()
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            code = int.from_bytes(text[i : i + n], "big") + (n << 24)
            out[(code * 2654435761 % 2**32) >> 20] += 1
    before = None
    for w in text.split():
        kind = lambda c: 0 if 97 <= c < 123 or c >= 128 else 1 if 65 <= c < 91 else 3 if 48 <= c < 58 else 2
        out[neighbour_quality.RUNS + ((min(3, int(math.log2(len(w)))) * 2 + (w == before)) * 4 + kind(w[0])) * 4 + kind(w[-1])] += 1
        before = w
    return out


def test_op11_counts():
    texts = [b"", b"a", "Wörd wörd wörd A1 !! x\n\n".encode(), b"ab", b"x" * 300, b"  "]
    got = neighbour_quality.term_counts(texts)
    assert [{int(k): int(r[k]) for k in np.flatnonzero(r)} for r in got] == [dict(plain_counts(t)) for t in texts]
    assert neighbour_quality.term_counts([b"", b""]).sum() == 0


def test_op11_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.op11_neighbour_quality(spark, sf).collect()}
    assert len(rows) == documents(spark, sf).count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    known = [(r.quality, rows[r.doc_id].score) for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.doc_id in rows and rows[r.doc_id].held_out and r.quality is not None]
    good, bad = ([s for q, s in known if q == k] for k in (1, 0))
    assert sum(s >= 0.7 for s in good) >= 0.98 * len(good) and sum(s < 0.7 for s in bad) >= 0.8 * len(bad)


def test_op11_scores_equal_a_plain_vote(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    m = neighbour_quality.train(docs, labels, near=5)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    df = Counter(t for x in texts.values() for t in plain_counts(x))
    assert np.allclose(m.idf, [math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in range(neighbour_quality.TERMS)])

    def latent(text):
        c = plain_counts(text)
        runs = np.array([math.log1p(c[t]) for t in range(neighbour_quality.RUNS)]) * m.idf[: neighbour_quality.RUNS]
        shapes = np.array([c[t] for t in range(neighbour_quality.RUNS, neighbour_quality.TERMS)], float)
        shapes = np.sqrt(shapes / max(1, shapes.sum())) * m.idf[neighbour_quality.RUNS :]
        z = np.concatenate([x / (np.linalg.norm(x) or 1) for x in (runs, shapes)]) @ m.axes
        return z / (np.linalg.norm(z) or 1)

    for r in neighbour_quality.quality_scores(docs, m).collect()[:60]:
        cosines = np.round(m.vectors @ latent(texts[r.doc_id]), 9)
        least = sorted(cosines)[-5]
        votes = {y: sum(max(0, c) ** 8 for c, k in zip(cosines, m.labels, strict=True) if c >= least and k == y) / (m.labels == y).sum() for y in (0, 1)}
        v = votes[1] / (votes[0] + votes[1])
        assert r.score == pytest.approx(0.7 * v / m.cut if v < m.cut else 0.7 + 0.3 * (v - m.cut) / (1 - m.cut), abs=2e-6)


def test_op11_odd_rows(spark, sf_dir):
    docs = odd_docs(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    m = neighbour_quality.train(documents(spark, sf_dir), labels)
    got = neighbour_quality.quality_scores(docs, m).collect()
    assert len(got) == docs.count()
    assert {r.score for r in got if r.doc_id in (0, 1)} == {round(m.prior, 6)}
    assert neighbour_quality.quality_scores(empty(spark), m).count() == 0
    none = neighbour_quality.train(docs, labels.limit(0))
    assert {r.score for r in neighbour_quality.quality_scores(docs, none).collect()} == {0.5}
    one = neighbour_quality.train(docs, spark.createDataFrame([(4, 1), (5, 1), (None, 0), (6, None)], "doc_id long, quality int"))
    assert {r.score for r in neighbour_quality.quality_scores(docs, one).collect()} == {1.0}
    odd = neighbour_quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(12)] + [(4, 1), (4, 0)], "doc_id long, quality int"))
    assert all(0 <= r.score <= 1 for r in neighbour_quality.quality_scores(docs, odd).collect())


# --------------------------------------------------------------------- op 12


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, add=0):
    parts = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + add, r.text)
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(hashes):
    """The levels above the hashes and, for each, its siblings on the way."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(hashes)):
        path = []
        for level in levels[:-1]:
            path.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
            i >>= 1
        paths.append(path)
    return levels[-1][0], paths


def brute_proofs(rows):
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    parts, subs = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        top, paths = tree([leaf(r) for r in own])
        parts[lang] = own, paths
        subs.append(top)
    root, above = tree(subs)
    out = []
    for lang, sub, up in zip(langs, subs, above, strict=True):
        for r, path in zip(*parts[lang], strict=True):
            h = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0)
            for odd, s in path + up:
                h = sha(s + h) if s and odd else sha(h + (s or ""))
            out.append((r.doc_id, leaf(r), sub, root, sha("".join(s for _, s in path + up if s)), h, h == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("stride", [1, 3, 10])
def test_op12_equals_plain_hashing(spark, stride):
    docs = odd_docs(spark, ["more"] * 9).unionByName(odd_docs(spark, ["x"]).selectExpr("doc_id + 100 as doc_id", "text", "'é' as lang", "'s' as source", "doc_id as n_chars", "score", "kept", "row", "key"))
    docs = docs.unionByName(docs.filter("doc_id = 104").selectExpr("doc_id", "text", "'z' as lang", "source", "n_chars", "score", "kept", "row", "key"))
    got = sorted((tuple(r) for r in merkle_manifest.merkle_proofs(docs, stride).collect()), key=str)
    assert got == brute_proofs(docs.collect())
    assert {r[-1] for r in got} == {True, False}


def test_op12_query_and_edges(spark, sf_dir):
    limits = spark.conf.get("spark.sql.cteRecursionRowLimit")
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, sf_dir).collect()), key=str)
    assert got == brute_proofs(documents(spark, sf_dir).collect())
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") == limits
    assert merkle_manifest.merkle_proofs(empty(spark)).count() == 0
    one = documents(spark, sf_dir).filter("doc_id = 5")
    (r,) = merkle_manifest.merkle_proofs(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")


def test_op12_places_across_tasks(spark):
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 7, id) as k", "if(id % 5 = 0, null, id % 2) as g").repartition(9)
    got = merkle_manifest.placed(rows, "g", ["k"]).collect()
    for g in (None, 0, 1):
        own = sorted((r.idx, r.k) for r in got if r.g == g)
        assert [i for i, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
    assert len(got) == 2000


# --------------------------------------------------------------------- op 13

EMB = "vec_id long, embedding array<float>, label int, score double, rank string, v int"


def brute_negatives(rows, every=100, n_pos=5, n_neg=10):
    rows = [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    use = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [math.floor(256 * float(x)) for x in r.embedding]) for r in rows]
    anchors = {}
    for i, y, v in sorted(use):
        if i % every == 0:
            anchors.setdefault(i, (y, v))
    out = []
    for a, (y, v) in anchors.items():
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z == y) for i, z, w in use if i != a)  # noqa: B905
        for s, p, _ in [x for x in scored if x[2]][:n_pos]:
            fits = [(i, t) for t, i, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:n_neg]
            out += [(a, p, k + 1, i, -s, -t) for k, (i, t) in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_op13_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 12))
    rows = []
    for i in range(900):
        v = centres[rng.integers(6)] * (1 if seed < 2 else 0.2) + rng.standard_normal(12) * (0.4, 1.0, 1.5)[seed]
        if i % 9 == 0:
            v = np.round(centres[0], 1)  # many rows tie
        v = v[: rng.integers(3, 13)] if seed == 1 else v
        rows.append((i if seed else i - 400, [float(np.float32(x)) for x in v], int(rng.integers(4 if seed else 10)), None, None, None))
    rows += [(1000, None, 1, 1.0, "r", 1), (1100, [1.0, None], 1, 1.0, "r", 1), (1200, [float("nan"), 1.0], 1, None, None, None), (1300, [float("inf")], 2, None, None, None), (1400, [1.0] * 12, None, None, None, None), (None, [1.0] * 12, 1, None, None, None), (1500, [], 3, None, None, None), (1600, [0.0] * 12, 3, None, None, None)]
    df = spark.createDataFrame(rows, EMB).repartition(5)
    want = brute_negatives(df.collect())
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(df).collect()) == want and len(want) > 20
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(df, at_once=3).collect()) == want


def test_op13_edges(spark, sf_dir):
    none = spark.createDataFrame([], EMB)
    assert hard_negatives.hard_negatives(none).count() == 0
    alone = spark.createDataFrame([(100, [1.0, 2.0], 1, None, None, None), (5, [1.0, 2.0], 1, None, None, None)], EMB)
    assert hard_negatives.hard_negatives(alone).count() == 0
    twice = spark.createDataFrame([(100, [1.0, 2.0], 1, None, None, None)] * 2 + [(5, [1.0, 2.0], 1, None, None, None), (6, [1.0, 0.5], 2, None, None, None), (6, [1.0, 0.5], 2, None, None, None)], EMB)
    assert sorted(tuple(r) for r in hard_negatives.hard_negatives(twice).collect()) == brute_negatives(twice.collect())
    got = sorted(tuple(r) for r in queries.op13_hard_negatives(spark, sf_dir).collect())
    assert got == brute_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect())
    with pytest.raises(Exception, match="2\\*\\*53"):
        hard_negatives.hard_negatives(spark.createDataFrame([(100, [1e9], 1, None, None, None), (1, [1e9], 1, None, None, None)], EMB)).count()


def test_op13_index_omits_and_loses_nothing():
    rng = np.random.default_rng(4)
    rows, anchors = np.floor(rng.standard_normal((300, 40)) * 50), np.floor(rng.standard_normal((20, 40)) * 50)
    exact = anchors @ rows.T
    for share in (0.0, 0.2, 0.4, 0.6):
        t = np.full(20, share) * np.linalg.norm(anchors, axis=1) * np.linalg.norm(rows, axis=1).max()
        index = hard_negatives.indexed(rows, t.min(), np.linalg.norm(anchors, axis=1).max())
        a, r, s = hard_negatives.reaching(index, anchors, t)
        assert set(zip(a.tolist(), r.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(exact >= t[:, None])), strict=True))
        assert (s == exact[a, r]).all()
        assert (sum((values != 0).sum() for _, values in index.postings) < (rows != 0).sum()) == (share > 0)


# ---------------------------------------------------------------------- op 6


def test_op6_packed_counts_are_unpacked():
    from terravox.llm import quality_ratio

    rng = np.random.default_rng(6)
    keys = np.unique(rng.integers(0, 1 << 18, 40_000))
    n = rng.integers(1, 1 << 40, len(keys))
    blocks, data = quality_ratio.packed_counts(keys, n)
    back = [quality_ratio.unpacked_counts(b, d) for b, d in zip(blocks, data, strict=True)]
    assert (np.concatenate([k for k, _ in back]) == keys).all() and (np.concatenate([m for _, m in back]) == n).all()
    one = quality_ratio.packed_counts(np.array([2 * quality_ratio.BLOCK - 1]), np.array([7]))
    assert [(k.tolist(), m.tolist()) for k, m in map(quality_ratio.unpacked_counts, *one)] == [([2 * quality_ratio.BLOCK - 1], [7])]


def test_op6_registered_size_equals_plain_counts(spark, sf_dir):
    from terravox.llm import common, quality_ratio

    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    trusted = common.stored(labels.filter("quality = 1").select("doc_id"), "trusted")
    buckets = quality_ratio.model_size(docs)
    raw, target = quality_ratio.count_ngrams(docs, trusted, buckets, at_once=5000)
    good, want, own = {r.doc_id for r in trusted.collect()}, np.zeros(buckets), np.zeros(buckets)
    for r in docs.collect():
        h, _, _, first = common.hashed_words([(r.text or "").encode()])
        b, _ = quality_ratio.ngram_buckets(h, first, buckets)
        np.add.at(want, b, 1)
        if r.doc_id in good:
            np.add.at(own, b, 1)
    assert (raw == want).all() and (target == own).all()


# ---------------------------------------------------------------------- op 5


def test_op5_matches_have_their_places(spark):
    from terravox.llm import decontaminate

    item = " ".join(f"w{i}" for i in range(20))
    loose = "aa bb cc dd ee ff gg hh"
    bench = spark.createDataFrame([("one", item), ("same", item.upper()), ("two", loose), (None, "solo")], "item_id string, text string")
    body = f"x y z {item} end"
    docs = spark.createDataFrame([(1, body), (1, body), (2, "aa bb cc so dd ee it ff gg hh"), (3, "nothing here"), (4, None), (5, "solo and solo")], "doc_id long, text string")
    got = {tuple(r) for r in decontaminate.matches(docs, bench).collect()}
    exact = {r for r in got if r[2] == "exact"}
    assert exact == {(1, i, "exact", s, 13) for i in ("one", "same") for s in range(3, 11)} | {(5, "", "exact", s, 1) for s in (0, 2)}
    near = {r[:2] for r in got if r[2] == "near"}
    assert (2, "two") in near and {r[0] for r in got} == {1, 2, 5}
    assert decontaminate.matches(docs.limit(0), bench).count() == 0


def test_op3_very_long_urls(spark):
    from terravox.llm import url_filter

    urls = ["http://x.org/" + "a" * 20_000, "http://" + "b." * 5_000 + "com/fr/" + "c" * 10, "http://example.org/en/1" + "?q" * 10_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    assert [(got[i].rule, got[i].verdict) for i in range(3)] == [("org/", "allow"), ("com/fr/", "allow"), ("example.org/en/1", "block")]
    assert len(got[0].path) == 20_001 and len(got[1].host) == 10_003


def test_op4_one_row_many_times(spark):
    from terravox.llm import paragraph_dedup

    text = " ".join(f"t{i}" for i in range(80))
    rows = [(7, text)] * 60 + [(8, text), (9, "other words " * 4)]
    got = paragraph_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.doc_id for r in got) == [7] * 60 + [8] and len({r.class_id for r in got}) == 1
