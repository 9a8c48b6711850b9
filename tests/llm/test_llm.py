"""The training-data operators against brute force on small fixtures, with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import io
import os
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from terravox.llm import bpe_chunks, chat_format, common, decontaminate, jaccard_join, near, paragraph_dedup, quality_ratio, queries, secret_scan, sst_output, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, row string, key string"
LONG = " ".join(f"wörd{i % 977} it's  x\n\n" for i in range(9000))


def odd_docs(spark, extra=()):
    texts = [None, "", "   \n ", "a", "one two three", LONG, LONG, "x" * 90_000, " " * 5000, "password = hunter2secret AKIA" + "A1" * 9 + " " + "0123456789abcdef" * 2, *extra]
    rows = [(i, t, None, None, None, None, None, None, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, "null id", "en", "s", 7, 1.0, True, "r", "k"), (4, "same id, other text", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf_dir, n=None):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.limit(n) if n else df


# ------------------------------------------------------------ shared pieces


def test_hashed_words_and_shingles():
    texts = [b"a b c d e f", b"", b"a b", "\xe9 a b c d e f".encode()]
    h, start, end, first = common.hashed_words(texts)
    words = [t[a:b] for t, lo, hi in zip(texts, first, first[1:], strict=False) for a, b in zip(start[lo:hi], end[lo:hi], strict=True)]
    assert words == [w for t in texts for w in t.split()]
    assert h[0] == h[first[2]] and len(set(h.tolist())) == len(set(words))
    runs, at = common.shingle_hashes(h, first)
    assert np.diff(at).tolist() == [2, 0, 1, 3]
    assert set(runs[at[0] : at[1]]) <= set(runs[at[3] : at[4]])


def test_intersections_match_sets():
    rng = np.random.default_rng(0)
    for m in (2, 5, 30):
        sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(m)]
        got = near.intersections(sets, columns=7)
        for i in range(m):
            for j in range(m):
                if i != j:
                    assert got[i, j] == len(set(sets[i].tolist()) & set(sets[j].tolist()))


# ---------------------------------------------------------------------- op 1


def test_shards_round_trip_and_search():
    rng = np.random.default_rng(1)
    keys = sorted([sst_output.key_bytes(int(k)) for k in rng.integers(-(10**6), 10**6, 3000)] + [b"", b""])
    ids = [rng.integers(0, 60_000, rng.integers(1, 60)).astype("<u2") for _ in keys]
    out = io.BytesIO()
    w = sst_output.ShardWriter(out, block_bytes=1000)
    for k, i in zip(keys, ids, strict=True):
        w.add(k, i)
    w.close()
    data = out.getvalue()
    reader = sst_output.ShardReader(io.BytesIO(data), len(data))
    assert [(k, i.tolist()) for k, i in reader] == [(k, i.tolist()) for k, i in zip(keys, ids, strict=True)]
    for k in {keys[0], keys[7], keys[-1]}:
        assert [i.tolist() for i in reader.get(k)] == [i.tolist() for kk, i in zip(keys, ids, strict=True) if kk == k]
    assert sum(bool(reader.may_hold(sst_output.key_bytes(10**7 + i))) for i in range(1000)) < 50
    with pytest.raises(ValueError, match="damaged"):
        broken = bytearray(data)
        broken[reader.places[-1][0] + reader.places[-1][1] + 3] ^= 1
        sst_output.ShardReader(io.BytesIO(bytes(broken)), len(broken))
    with pytest.raises(ValueError, match="ascend"):
        sst_output.ShardWriter(io.BytesIO()).add(b"", ids[0]) or w.add(b"", ids[0])


def brute_tokens(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = [np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for _, x in rows]
    starts = np.concatenate(([0], np.cumsum([len(i) for i in ids])[:-1]))
    return [(d, int(s), len(i), zlib.crc32(i.tobytes())) for (d, _), s, i in zip(rows, starts, ids, strict=True)]


def test_op1_equals_the_library(spark, sf_dir):
    rows = sorted((r.doc_id, r.text) for r in documents(spark, sf_dir).collect())
    got = sorted(tuple(r) for r in queries.op1_sst_shards(spark, sf_dir).collect())
    assert got == brute_tokens(rows)


def test_op1_odd_rows(spark):
    docs = odd_docs(spark, ["\x1c\x0b\x0c tab\tand\u2003wide", "ΣΑΣ Σ é\u0301 İ", "<|endoftext|> <|endoftext|>"])
    got = sst_output.token_shards(docs, P.path("word_bpe_49k.json")).collect()
    assert len(got) == docs.count()
    want = brute_tokens([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == sorted((d is None, d or 0, n, c) for d, _, n, c in want)
    spans = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sst_output.token_shards(empty(spark), P.path("word_bpe_49k.json")).count() == 0


def test_op1_other_tokenizers_are_asked_whole(spark, tmp_path):
    import json

    assert sst_output.encodes_by_units(P.path("word_bpe_49k.json"))
    other = P.path("byte_bpe_50k.json")
    assert not sst_output.encodes_by_units(other)
    from tokenizers import Tokenizer

    texts = ["It's  a test\n of 123 words", "", "naïve Ünï", " lead"]
    want = [e.ids for e in Tokenizer.from_file(other).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in sst_output.encoder(other).encode(texts)] == want
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        rules = json.load(f)
    rules["normalizer"]["normalizers"].pop()
    changed = tmp_path / "cased.json"
    changed.write_text(json.dumps(rules), encoding="utf-8")
    assert not sst_output.encodes_by_units(str(changed))


# ---------------------------------------------------------------------- op 2


def brute_secrets(text):
    t, out = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def check_secrets(rows, texts):
    for r in rows:
        found = brute_secrets(texts[r.doc_id])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in found) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_op2_equals_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in documents(spark, sf_dir).collect()}
    got = queries.op2_secret_scan(spark, sf_dir).collect()
    assert len(got) == len(texts)
    check_secrets(got, texts)


def test_op2_hard_texts(spark):
    texts = ["secret=token: abcdefgh", "Password:'abc' passwd= tok-en.1", "API_KEY=AKIA" + "Z" * 16, "AKIAAKIA" + "Q" * 15, "PASſWORD=aaaaaaa", "é token=\u212aabcdefg", "0123456789abcdef01234567G" + "f" * 23, "token==abcdef=", "secret : : abcdefg", "ghp_" + "a" * 36, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = secret_scan.scan_secrets(docs).collect()
    check_secrets(got, dict(enumerate(texts)))
    assert "github:0:40" in {r.doc_id: r.spans for r in got}[9]
    assert secret_scan.scan_secrets(odd_docs(spark)).count() == odd_docs(spark).count()
    assert secret_scan.scan_secrets(empty(spark)).count() == 0


def test_redaction_keeps_rows_and_columns(spark):
    docs = odd_docs(spark)
    out = secret_scan.redact_secrets(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    text = out.filter("doc_id = 9").first().text
    assert "hunter2" not in text and "[assign]" in text and "[access]" in text and "[hex]" in text


def test_trigram_queries():
    by = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.RULES}
    assert by["hex"] is None and by["access"] == [[b"aki", b"kia"]]
    index = secret_scan.SegmentIndex([b"xx AKIA", b"aki", b"", b"kia aki"], [b"aki", b"kia"])
    assert index.candidates(by["access"]).tolist() == [0, 3]


def test_trigram_queries_are_derived():
    """Expressions that the rules don't have: whatever matches satisfies the query, and the query is not empty where it can't be."""
    derived = lambda p: secret_scan.trigram_query(secret_scan.Rule("x", p))
    assert derived("abcd") == [[b"abc", b"bcd"]] and derived("AbC") == [[b"abc"]]
    assert derived("ab") is None and derived("a.c") is None and derived("(abc)?x") is None and derived("abc|d") is None
    assert derived("abc.*def") == [[b"abc", b"def"]] and derived("abc|xyz") == [[b"abc"], [b"xyz"]]
    assert derived("(?i:task)") is None and derived("(?ia:task)") == [[b"ask", b"tas"]]
    assert derived("gh[po]_x") == [sorted([b"gh" + c, b"h" + c + b"_", c + b"_x"]) for c in (b"o", b"p")]
    by = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.RULES}
    assert all(b"ey-" in x and b"beg" in x for x in by["pem"]) and len(by["github"]) == 5 and by["jwt"] == [[b"eyj"]]
    assert len(by["assign"]) >= 6 and all({b"tok", b"sec", b"pas", b"api"} & set(x) for x in by["assign"])
    rng = np.random.default_rng(11)
    patterns = ["ab(c|de)+f", "x{2,4}yz", "(?:foo|bar)[0-9]baz", "a?bcd", "(ab|ba){3}", "k[a-c]{2}z?end", "^abc$", "(?=abc)a.c", "(?>abc)d*", "(a|)bcd", "x(abc)*y", "(?i)sKx|abc", "é[ab]cd", "[^a]bcd", "\\dabc", "((a)(b))c\\2d", "a{0}bcd"]
    letters = list("abcdefkxyzéS0159 ")
    for p in patterns:
        query, expression, hits = derived(p), re.compile(p), 0
        pieces = [*letters, "abc", "bcd", "foo", "bar", "baz", "end", "xx", "yz", "ab", "ba", "def", "skx", "ſKX"]
        texts = ["".join(rng.choice(pieces, rng.integers(1, 9))) for _ in range(3000)]
        index = secret_scan.SegmentIndex([t.encode() for t in texts], sorted({t for x in query or [] for t in x}))
        found = set(index.candidates(query).tolist()) if query else set(range(len(texts)))
        matching = {i for i, t in enumerate(texts) if expression.search(t)}
        assert matching <= found, p


def test_many_trigrams():
    rules = tuple(secret_scan.Rule(f"k{i}", f"key{i:04d}x") for i in range(400))
    assert secret_scan.scan_segment(["a key0399x b", "none", "key0000x"], rules) == [[(2, 399, 10)], [], [(0, 0, 8)]]


# ---------------------------------------------------------------------- op 3


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for what, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, what)
    return host, path, best


def test_op3_rules_and_method(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    urls = {r.page_id: r.url for r in pages.collect()}
    got = queries.op3_url_filter(spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path, best = brute_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[0])
        assert r.verdict == best[1] if best else r.verdict in ("allow", "block")
    plan = url_filter.url_verdicts(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_oracles(spark):
    import duckdb

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    for name, sql in queries.ORACLE_SQL.items():
        df = queries.QUERIES[name](spark, sf)
        cursor = con.execute(sql)
        names = [c[0] for c in cursor.description]
        assert sorted(names) == sorted(df.columns)
        theirs = sorted(tuple(str(row[names.index(c)]) for c in df.columns) for row in cursor.fetchall())
        assert sorted(tuple(str(x) for x in row) for row in df.collect()) == theirs


def test_op3_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.ORG/es/x?q#f", "a://b://c/d", "http://x.com/de/", "http://com/fr/1", "http://notcom/de/", "http://Ünï.org/\n/é", "http://x.net/en/1", "http://x.net/en/1"]
    pages = spark.createDataFrame([(i, u, "h", 1.0) for i, u in enumerate(urls)] + [(None, "http://y.com/de/2", "h", 1.0)], "page_id long, url string, html string, llr double")
    got = {r.page_id: r for r in url_filter.url_verdicts(pages).collect()}
    for i, u in enumerate(urls):
        host, path, best = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0])
    assert url_filter.url_verdicts(pages.filter("false")).count() == 0


def brute_llr(spark, pages):
    """The models again, one character at a time."""
    from collections import Counter

    import pyspark.sql.functions as f

    rows = pages.withColumn("s", url_filter.symbols(f.col("url"))).withColumn("held", url_filter.held_back(f.col("url"))).collect()
    count = [Counter(), Counter()]
    for r in rows:
        best = brute_rule(r.url)[2]
        if best and not r.held:
            for i in range(3, len(r.s)):
                count[best[1] == "block"][r.s[i - 3 : i + 1]] += 1
    grams = set().union(*count) | {r.s[i - 3 : i + 1] for r in rows for i in range(3, len(r.s))}

    def prob(c, gram, k):
        if k < 0:
            return 1 / (len(url_filter.ALPHABET) - 1)
        ctx = gram[3 - k : 3]
        own = [x for x in (0, 1) for _ in [0]]
        total = sum(n for x in own for g, n in count[x].items() if g[3 - k : 3] == ctx)
        if total < 8:
            return prob(c, gram, k - 1)
        t = sum(n for g, n in count[c].items() if g[3 - k : 3] == ctx)
        if not t:
            return prob(c, gram, k - 1)
        kinds = len({g[3] for g in count[c] if g[3 - k : 3] == ctx})
        n = sum(m for g, m in count[c].items() if g[3 - k :] == gram[3 - k :])
        return (n + kinds * prob(c, gram, k - 1)) / (t + kinds)

    some = {g: np.log(prob(0, g, 3) / prob(1, g, 3)) for g in grams}
    return {r.page_id: np.mean([some[r.s[i - 3 : i + 1]] for i in range(3, len(r.s))]) for r in rows}


def test_op3_scores_equal_brute_force(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60).cache()
    want = brute_llr(spark, pages)
    for r in url_filter.url_verdicts(pages).collect():
        assert r.llr == pytest.approx(want[r.page_id], abs=2e-6)


# ---------------------------------------------------------------------- op 4


def test_op4_finds_repeated_passages(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    line = lambda n: " ".join(rng.choice(words, n))
    sentence = lambda n: " ".join(rng.choice(words, n)) + "."
    passage, inner = line(60), " ".join(sentence(9) for _ in range(7))
    edited = passage.split()
    edited[30] = "changed"
    texts = [line(80) + "\n" + passage, passage + "\n" + line(70), line(30) + "\n" + " ".join(edited), sentence(20) + " " + inner + " " + sentence(20), sentence(25) + " " + inner, line(200), line(90) + "\nshort common line", "short common line", None, "", line(40)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, class_id int")
    got = paragraph_dedup.repeated_passages(docs).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4}
    assert {r.doc_id for r in got if r.removed} == {1, 2, 4}
    for r in got:
        if r.doc_id in (0, 1):
            assert texts[r.doc_id].encode()[r.start : r.end].decode() == passage
            assert r.class_id == 0 and r.n_words == 60
    assert paragraph_dedup.repeated_passages(empty(spark)).count() == 0
    repeats = paragraph_dedup.repeated_passages(docs.unionByName(docs.filter("doc_id = 10"))).filter("doc_id = 10").collect()
    assert sorted(r.removed for r in repeats) == [False, True]
    assert paragraph_dedup.repeated_passages(odd_docs(spark)).filter("doc_id in (5, 6)").count() >= 2


def test_op4_finds_passages_inside_lines(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"w{i}" for i in range(9000)])
    line = lambda n: " ".join(rng.choice(words, n))
    inner, wrapped, phrase = line(51), line(51), line(11)
    w = wrapped.split()
    wrap = lambda *cut: "\n".join(" ".join(w[a:b]) for a, b in zip((0, *cut), (*cut, 51), strict=True))
    long = line(30) + " " + phrase + " " + line(30)
    texts = [line(33) + " " + inner + " " + line(50), line(70) + " " + inner + " " + line(41), line(20) + " " + wrap(25) + " " + line(5), line(9) + " " + wrap(11, 38) + " " + line(22), phrase + " " + line(60), line(45) + " " + long + " " + line(7), line(12) + " " + long + " " + line(48), line(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = paragraph_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.class_id, r.removed) for r in got} == {(0, 0, False), (1, 0, True), (2, 2, False), (3, 2, True), (5, 5, False), (6, 5, True)}
    assert all(31 <= r.n_words <= 71 for r in got)


def test_op4_equals_brute_force_runs(spark, sf_dir):
    """Each run of 51 words that stands twice lies, but for its ends, in a passage at each place; each passage has words that stand elsewhere."""
    rows = {r.doc_id: r.text or "" for r in documents(spark, sf_dir).collect()}
    words = {d: [(m.start(), m.end(), m[0]) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())] for d, t in rows.items()}
    at = {}
    for d, w in words.items():
        for i in range(len(w) - 50):
            at.setdefault(tuple(x[2] for x in w[i : i + 51]), []).append((d, i))
    spans = {}
    for r in queries.op4_paragraph_dedup(spark, sf_dir).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end, r.n_words))
    places = [p for ps in at.values() if len(ps) > 1 for p in ps]
    assert places
    for d, i in places:
        inside = {k for a, b, _ in spans[d] for k in range(i, i + 51) if a <= words[d][k][0] and words[d][k][1] <= b}
        assert len(inside) >= 31
    runs = {}
    for d, w in words.items():
        for i in range(len(w) - 4):
            runs.setdefault(tuple(x[2] for x in w[i : i + 5]), set()).add((d, i))
    for d, ps in spans.items():
        for a, b, n in ps:
            own = [k for k, x in enumerate(words[d]) if a <= x[0] and x[1] <= b]
            assert 30 <= n <= len(own)
            twice = sum(len(runs[tuple(x[2] for x in words[d][k : k + 5])]) > 1 for k in own[:-4])
            assert twice >= 0.6 * (n - 4)


def test_op4_tuning_meets_recall():
    bands, rows = paragraph_dedup.tune(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 > 1 - (1 - 0.8**rows) ** (bands - 1)


# ---------------------------------------------------------------------- op 5


def brute_contamination(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12)) if w else ():
            wins.setdefault(tuple(w[s : s + 13]), set()).add("" if i is None else str(i))
    out = []
    for d, t in texts:
        w, hit, ids = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                found = wins.get(tuple(w[s : s + n]))
                if found:
                    hit.update(range(s, s + n))
                    ids |= found
        out.append((d is None, d or 0, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_op5_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    words = ["the", "of", *(f"term{i}" for i in range(60))]
    say = lambda n: " ".join(rng.choice(words, n))
    items = [(i, say(30)) for i in range(8)] + [(8, "Two Words"), (9, "solo"), (10, None), (11, "..."), (12, "the " * 20), (0, say(14)), (None, say(15)), (13, "no Such phrase anywhere at all")]
    texts = [say(100) + " " + items[k][1] + ". " + say(30) for k in range(5)] + [items[5][1][40:] + " " + say(50), "two  words, SOLO!", "the " * 50, None, "", "ÉTÉ straße solo", say(20) + items[14][1], " ".join(items[6][1].split()[5:25])]
    rows = list(enumerate(texts)) + [(1, texts[1]), (None, texts[0]), (2, "other text")]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n_words int, key string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs, bench).collect())
    assert got == brute_contamination(rows, items)
    kept = decontaminate.without_contaminated(docs, bench)
    assert kept.schema == docs.schema and kept.count() == sum(not x[-1] for x in got)
    assert decontaminate.contamination(docs, bench.filter("false")).filter("contaminated or n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.filter("false"), bench).count() == 0


def test_op5_proximity(spark):
    items = decontaminate.benchmark_items(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"))
    docs = decontaminate.keyed(spark.createDataFrame([(1, "alpha x beta gamma y delta"), (2, "alpha " + "x " * 50 + "delta")], "doc_id long, text string"))
    terms = items.select(F.explode("words").alias("term"))
    anchor = items.select("item", F.posexplode("words").alias("p", "term"))
    met = decontaminate.diagonals(decontaminate.index_of(docs, terms), anchor)
    assert decontaminate.proximity_matches(met, items, 5, 3).count() == 1


# ---------------------------------------------------------------------- op 6


def test_op6_base_rules(spark, sf_dir):
    from collections import Counter

    docs = documents(spark, sf_dir)
    texts = {r.doc_id: r.text for r in docs.collect()} | {-1: None, -2: "", -3: "a b c d e " * 30, -4: "x #<\n\n\ny\ny\n y"}
    extra = spark.createDataFrame([(i, texts[i]) for i in (-1, -2, -3, -4)], "doc_id long, text string")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    got = quality_ratio.quality_verdicts(docs.select("doc_id", "text").unionByName(extra), labels).collect()
    assert len(got) == len(texts)
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    for r in got:
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {i + k for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w))
        assert not (r.base_failed and r.kept)
    clean = [r for r in got if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.97 * len(clean)
    assert quality_ratio.quality_verdicts(empty(spark), labels).count() == 0
    assert quality_ratio.quality_verdicts(odd_docs(spark), labels.filter("false")).count() == odd_docs(spark).count()


def test_op6_scores_equal_brute_force(spark, sf_dir):
    """The multinomials over the n-grams themselves, with the buckets' smoothing; so many buckets that hardly two n-grams share one."""
    from collections import Counter

    buckets = 1 << 23
    docs = documents(spark, sf_dir).select("doc_id", "text").unionByName(spark.createDataFrame([(3, "another text of a known id " * 5), (-7, None)], "doc_id long, text string"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, good = [tuple(r) for r in docs.collect()], {r.doc_id for r in labels.filter("quality = 1").collect()}

    def grams(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        return [*((x,) for x in w), *zip(w, w[1:], strict=False)]

    back = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    raw = Counter(g for _, t in rows for g in grams(t))
    target = Counter(g for i, t in rows if i in good and not back(i) for g in grams(t))
    R, Q = sum(raw.values()) + buckets, sum(target.values()) + buckets
    got = quality_ratio.quality_verdicts(docs, labels, buckets=buckets).collect()
    assert len(got) == len(rows)
    score = lambda t: np.mean([np.log((target[g] + 1) / Q) - np.log((raw[g] + 1) / R) for g in grams(t)] or [0])
    want = sorted((i, score(t)) for i, t in rows)
    mine = sorted((r.doc_id, r.score) for r in got)
    assert [i for i, _ in mine] == [i for i, _ in want]
    off = np.abs(np.array([x for _, x in mine]) - [x for _, x in want])
    assert off.max() < 0.2 and np.median(off) < 2e-3, np.quantile(off, (0.5, 0.8, 0.95, 1))  # the rest have n-grams that share a bucket
    known = np.array([round(r.score, 3) for r in got if r.doc_id in good and back(r.doc_id) and not r.base_failed])
    q, m = np.quantile(known, (0.002, 0.5))
    assert all(r.kept == (not r.base_failed and r.score >= q - 0.25 * (m - q)) for r in got if abs(r.score - (q - 0.25 * (m - q))) > 1e-6)
    four = docs.unionByName(docs)
    assert quality_ratio.model_size(four.unionByName(four)) == 2 * quality_ratio.model_size(docs)


# ---------------------------------------------------------------------- op 7


def tiktoken_rows(rows):
    c = bpe_chunks.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    out = []
    for d, t in rows:
        ids = np.array(c.encoding.encode_ordinary(t or ""), "<u4")
        out.append((d is None, d or 0, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def key7(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows)


def test_op7_equals_the_library(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert key7(queries.op7_bpe_chunks(spark, sf_dir).collect()) == tiktoken_rows(rows)


def test_op7_chunks_and_stitches(spark):
    texts = [LONG[:4000], "a" * 700, "a" * 400 + " b c d " * 60 + "c" * 500 + " end it's", "\n\n  \n" * 200 + "x", "it's we'll " * 90, "漢字 かな" * 200, "1234567890" * 50, "ab\n\ncd  ef " * 80, None, ""]
    docs = odd_docs(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = bpe_chunks.bpe_encode(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, chunk=128, overlap=32).collect()
    assert key7(got) == tiktoken_rows(rows)
    assert bpe_chunks.bpe_encode(empty(spark), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0


def test_op7_stitches_every_script(spark):
    """Chunks of 128 and overlaps of 48: each text is over five chunks long, and its pieces are short."""
    rng = np.random.default_rng(7)
    letters = {"chinese": "的一是不了人我在有他这中大来上国个到说们", "thai": "กขคงจฉชซญดตถทนบปผพฟมยรลวสหอ\u0e34\u0e35\u0e48\u0e49", "arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "russian": "абвгдежзиклмнопрстуфхцчшщыэюя"}
    word = lambda script, n: "".join(rng.choice(list(letters[script]), n))
    texts = {"chinese": "，".join(word("chinese", 9) for _ in range(90)), "thai": word("thai", 900), "arabic": " ".join(word("arabic", 5) for _ in range(150)), "russian": " ".join(word("russian", 7) for _ in range(120))}
    # One run that no overlap can cut, then text again: only the run is one piece.
    texts["lost"] = texts["russian"] + word("chinese", 700) + " " + texts["arabic"]
    texts["digits"] = "7" * 900
    c = bpe_chunks.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts.values())], "doc_id long, text string")
    args = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    pieces = bpe_chunks.cut_pieces(docs, *args, chunk=128, overlap=48).collect()
    for i, (name, t) in enumerate(texts.items()):
        own = sorted((r.k, r.piece) for r in pieces if r.doc_id == i)
        assert "".join(p for _, p in own) == t
        at = np.cumsum([len(p) for _, p in own])[:-1]
        assert set(at.tolist()) <= set(c.boundaries(t))
        if name in ("chinese", "thai", "arabic", "russian"):
            assert len(own) == (len(t) - 48 - 1) // 128 + 1
        if name == "lost":
            assert sum(len(p) > 400 for _, p in own) == 1 and sum(len(p) <= 128 + 48 for _, p in own) >= 10
        if name == "digits":
            assert len(own) == 1
    got = bpe_chunks.bpe_encode(docs, *args, chunk=128, overlap=48).collect()
    assert key7(got) == tiktoken_rows([(i, t) for i, t in enumerate(texts.values())])


# ---------------------------------------------------------------------- op 8


def test_op8_separates_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op8_toxicity(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(got[r.doc_id].predicted, r.toxic) for r in labels if got[r.doc_id].held_out]
    assert all(got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in labels)
    hit, toxic, said = sum(p and t for p, t in held), sum(t for _, t in held), sum(p for p, _ in held)
    assert hit >= 0.7 * toxic and hit >= 0.7 * said
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())


def test_op8_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert toxicity.toxicity_scores(docs, model).filter("score = 0").count() == docs.count()
    assert toxicity.without_toxic(docs, model).schema == docs.schema
    assert toxicity.toxicity_scores(empty(spark), model).count() == 0
    assert b"".join(toxicity.windows(b"ab cd" * 100 + b"z" * 500, 64)) == b"ab cd" * 100 + b"z" * 500


def toxic_rows(n=160, seed=8):
    """Prose of made-up words, a quarter with a few marked words among them."""
    rng = np.random.default_rng(seed)
    parts = "an ba ce do er fi go hu in ja ke lo mu no or pa qui re su ta".split()
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.integers(60, 300))]
        if i % 4 == 0:
            for k in rng.integers(0, len(w), 6):
                w[k] = str(rng.choice(["wretchedly", "blockheads", "filthywitz", "dumbfutzen"]))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    return rows


def test_op8_trained_model(spark):
    """The registered rule on fresh rows, odd rows by a trained model, and each score against a plain recomputation."""
    import zstandard

    model = toxicity.fit([(t.encode(), y) for _, t, y in toxic_rows()])
    fresh = toxic_rows(seed=9)
    docs = spark.createDataFrame([(i, t) for i, t, _ in fresh], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity_scores(docs, model).collect()}
    assert sum(got[i].predicted == y for i, _, y in fresh) >= 0.97 * len(fresh)

    def packed(content, window):
        how = zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(content), write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(how.compress(window))

    for i, t, _ in fresh[:12]:
        pieces = toxicity.windows(t.lower().encode(), toxicity.WINDOW)
        assert b"".join(pieces) == t.lower().encode()
        saved = np.array([packed(model.ordinary, w) - packed(model.ordinary + model.toxic, w) for w in pieces])
        x = np.array([np.sort(saved)[-3:].mean(), np.maximum(0, saved - 1).mean(), np.maximum(0, saved - 1).sum() / np.sqrt(len(saved)), np.log(len(saved))])
        z = ((x - model.means) / model.scales) @ np.array(model.weights) + model.shift
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)), abs=0.02)
    odd = odd_docs(spark)
    scores = {(r.doc_id, r.score) for r in toxicity.toxicity_scores(odd, model).collect()}
    by = {i: x for i, x in scores}
    assert all(0 <= x <= 1 for _, x in scores) and by[0] == by[1] and by[5] == by[6] and by[0] < 0.7
    assert toxicity.toxicity_scores(empty(spark), model).count() == 0
    # All of a long text counts: what stands at its end alone changes the score.
    long = " ".join(t for _, t, y in fresh if not y)
    ends = spark.createDataFrame([(0, long), (1, long + " wretchedly blockheads filthywitz dumbfutzen" * 12)], "doc_id long, text string")
    a, b = (r.score for r in toxicity.toxicity_scores(ends, model).orderBy("doc_id").collect())
    assert a < b and b >= 0.7


# ---------------------------------------------------------------------- op 9


def test_op9_escapes_are_reversible():
    for t in ["", "\\", "<|", "<\\|", "[\\INST]", "</s>[INST] ok [/INST]", "<<SYS>>\\<</SYS>>", "<<|end|>>", "a<", "\\\\[INST]<", "<|user|>x<|end|>"]:
        e = chat_format.escape(t)
        assert chat_format.unescape(e) == t and not any(c in e for c in chat_format.CONTROL)


def test_op9_reads_back_whole_conversations(spark, sf_dir):
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    check9(queries.op9_chat_format(spark, sf_dir).collect(), turns)


def check9(rows, turns):
    assert {r.conv_id for r in rows} == set(turns) and len(rows) == len(turns)
    for r in rows:
        said = turns[r.conv_id]
        loss = "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_op9_odd_rows(spark):
    rows = [(1, 1, "assistant", " leading <|end|>\n"), (1, 0, "user", None), (1, 2, "assistant", ""), (1, 3, "assistant", "<"), (1, 4, "assistant", "\\x"), (2, None, None, "é" * 30_000), (2, 0, "odd <|role|>", "\ud7ff 漢"), (None, 0, "assistant", "n"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    want = {1: [("user", ""), ("assistant", " leading <|end|>\n"), ("assistant", ""), ("assistant", "<"), ("assistant", "\\x")], 2: [("", "é" * 30_000), ("odd <|role|>", "\ud7ff 漢")], None: [("assistant", "n")], 3: [("assistant", "same")] * 2}
    check9(chat_format.chat_digests(df, P.path("byte_bpe_50k.json")).collect(), want)
    assert chat_format.chat_digests(df.filter("false"), P.path("byte_bpe_50k.json")).count() == 0


# --------------------------------------------------------------------- op 10


def runs_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    """class id, links and copies of each row."""
    texts = sorted({t or "" for _, t in rows})
    sets = [runs_of(t) for t in texts]
    links = [set() for _ in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        todo, seen = [i], {i}
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        root[i] = min(seen)
    at = {t: i for i, t in enumerate(texts)}
    least = {}
    for d, t in rows:
        if d is not None:
            k = root[at[t or ""]]
            least[k] = min(d, least.get(k, d))
    copies = {}
    for _, t in rows:
        copies[t or ""] = copies.get(t or "", 0) + 1
    return sorted((d is None, d or 0, least.get(root[at[t or ""]], -1), len(links[at[t or ""]]), copies[t or ""]) for d, t in rows)


def key10(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, -1 if r.class_id is None else r.class_id, r.n_links, r.n_copies) for r in rows)


def crowd(n=120, seed=0):
    """Near copies of one text, copies, texts that share a passage, and others."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(words, 150))
    texts = []
    for _ in range(n):
        t = list(base)
        for k in rng.integers(0, 150, rng.integers(0, 4)):
            t[k] = rng.choice(words)
        texts.append(" ".join(t))
    shared = " ".join(rng.choice(words, 80))
    texts += [shared + " " + " ".join(rng.choice(words, 60)) for _ in range(n)] + [" ".join(rng.choice(words, 40)) for _ in range(n // 2)]
    return texts + texts[:20] + ["a b", "a b", "a b c", "", "  "]


def test_op10_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 32)
    rows = list(enumerate(crowd())) + [(3, "same id"), (None, None), (None, "x y z"), (5, None)]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, class_id int, sid string").repartition(5)
    assert key10(jaccard_join.jaccard_classes(docs).collect()) == brute_classes(rows)


def test_op10_on_the_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents(spark, sf_dir).collect()]
    assert key10(queries.op10_jaccard_join(spark, sf_dir).collect()) == brute_classes(rows)


def test_op10_small_paths_split(spark):
    texts = crowd(60, 4)
    sigs = jaccard_join.signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).filter("sig is not null")
    reps = sigs.groupBy("sid").agg(F.first("sig").alias("sig"))
    leaves = jaccard_join.chosen_paths(reps, 3, small=4).groupBy("bucket").agg(F.count("*").alias("n")).collect()
    assert min(r.n for r in leaves) >= 2
    assert jaccard_join.runs_needed(0.8, 0.9999) <= 3


def test_op10_one_of_each(spark):
    docs = odd_docs(spark, ["p q r s t u v w x y " * 3, "p q r s t u v w x y " * 3])
    kept = jaccard_join.one_of_each(docs)
    assert kept.schema == docs.schema
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = kept.collect()
    assert len(got) == len({c[2] if not c[0] else ("none", i) for i, c in enumerate(brute_classes(rows))} | {("t", 4)})
    assert len({(r.text or "") for r in got}) == len(got)
    assert jaccard_join.one_of_each(empty(spark)).count() == 0


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = documents(spark, sf)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.schema.names == docs.schema.names
        kept = common.stored(out, "test")
        before = {r.doc_id: r.text for r in docs.collect()}
        after = {r.doc_id: r.text for r in kept.collect()}
        assert after.keys() <= before.keys()
        if name == "ngram_jaccard_join":
            assert {c[2] for c in brute_classes(list(before.items()))} == set(after)
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert set(after) == {c[1] for c in brute_contamination(list(before.items()), items) if not c[-1]}
        if name == "secret_scans":
            assert after.keys() == before.keys() and not any(brute_secrets(t) for t in after.values())
        docs = kept
    name, stage = corpus_pipeline.STAGES[-1]
    assert key7(stage(spark, docs, sf).collect()) == tiktoken_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_pipeline_on_odd_and_empty_input(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing columns and no rows at all: every stage keeps the schema, nothing fails."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for docs in (odd_docs(spark), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            docs = common.stored(out, "odd")
        name, stage = corpus_pipeline.STAGES[-1]
        rows = stage(spark, docs, sf).collect()
        assert key7(rows) == tiktoken_rows([(r.doc_id, r.text) for r in docs.collect()])


def test_the_rest_does_not_import_this_package():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "terravox")):
        if os.path.basename(folder) not in ("llm", "__pycache__"):
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f), encoding="utf-8") as source:
                        assert not re.search(r"(from|import)\s+\S*llm", source.read())
