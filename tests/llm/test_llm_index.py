"""BPE, top-k, joins, suffix dedup, packing, WARC, pipeline: against brute force, round trips and the libraries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkloom.llm import bpe, components, jaccard, packing, suffixes, tokens, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(parts)


def sha(b):
    return hashlib.sha256(b).hexdigest()


TEXTS = [None, "", " ", "a", "Hello world's  end\n\n  x", "é" * 50, "=" * 700, " " * 500 + "x", "日本語テキスト 123", "<|endoftext|> plain", "\x00\x01", "word " * 3000, "we're I'll don't 'tis", "a b c\u0085d", "x" * 5000]


def reference_bpe():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe(spark, tmp_path):
    enc, texts = reference_bpe(), [*TEXTS, TEXTS[4]]
    docs(spark, enumerate(texts)).withColumn("ids", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in bpe.op2_bpe(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode())), t
    assert bpe.bpe(docs(spark, [(0, "a")]).filter("doc_id < 0"), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_bpe_higher_order_functions(spark):
    """The fold over one word as Spark's higher-order functions, and its decoding."""
    path, enc = P.path("byte_bpe_50k.tiktoken"), reference_bpe()
    words = ["a", "the", " thntblere", "internationalisation", "é", "===="]
    df = spark.createDataFrame([(w, list(w.encode())) for w in words], "w string, b array<smallint>")
    coded = df.select("w", bpe.encode_word(F.col("b"), path).alias("ids"))
    for r in coded.select("w", "ids", bpe.decode_ids(F.col("ids"), path).alias("raw")).collect():
        assert list(r.ids) == enc.encode_ordinary(r.w) and bytes(r.raw).decode() == r.w


def test_fold_against_library():
    draw, enc = random.Random(3), reference_bpe()
    words = [bytes(draw.choices(range(97, 103), k=draw.randint(1, 30))) for _ in range(300)] + [b"", b"ab" * 150, bytes(range(256))]
    flat, begin = bpe.fold(words, P.path("byte_bpe_50k.tiktoken"))
    for i, w in enumerate(words):
        assert list(flat[begin[i] : begin[i + 1]]) == (enc._core_bpe.encode_single_piece(w) if w else []), w


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for x in filter(None, TEXTS):
        assert tokens.encoder(P.path("byte_bpe_50k.json")).encode_ordinary(x) == t.encode(x, add_special_tokens=False).ids, x[:20]


def test_packing(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    draw = random.Random(8)
    texts = [*TEXTS, *(" ".join(draw.choices(["alpha", "beta", "x", "1234"], k=draw.choice([3, 30, 300, 900, 2500]))) for _ in range(60)), TEXTS[4]]
    got = packing.best_fit(docs(spark, enumerate(texts)).withColumn("length", F.lit("clash"))).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 2048) and all(r.length == 2048 for r in own[1:])
        assert [r.start for r in own] == list(np.cumsum([0, *(r.length for r in own)])[:-1])
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in by_seq.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_seq) <= spec_best_fit([r.length for r in got], 2048)
    assert packing.best_fit(docs(spark, [(0, "a")]).filter("doc_id < 0")).count() == 0


def test_packing_of_added_tokens(spark, tmp_path):
    """The tokenizer as it is loaded finds its added tokens in texts."""
    from tokenizers import Tokenizer

    mark, t = "<|endoftext|>", Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", mark, mark * 3, f" x {mark} y\n{mark}", "<|endoftext", f"<|endof{mark}text|>", f"it's{mark}'s é{mark}é", *filter(None, TEXTS)]
    assert tokens.encode_whole(P.path("byte_bpe_50k.json"), texts[0]) == [64, 50256, 65]
    docs(spark, enumerate(texts)).write.parquet(str(tmp_path / "documents.parquet"))
    found = defaultdict(list)
    for r in packing.op10_best_fit_packing(spark, str(tmp_path)).collect():
        found[r.doc_id].append(r)
    for i, x in enumerate(texts):
        ids = np.array([*t.encode(x, add_special_tokens=False).ids, 0], "<u4")
        assert sum(r.length for r in found[i]) == len(ids), x[:30]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in found[i]), x[:30]


def test_components_settle_or_fail(spark):
    """Labels that have not settled are no result."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(64)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)
    assert {r.label for r in components.components(chain).collect()} == {0}


def spec_best_fit(sizes, limit):
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = [i for i, g in enumerate(gaps) if g >= s]
        if fit:
            i = min(fit, key=lambda i: gaps[i])
            gaps[i] -= s
        else:
            gaps.append(limit - s)
    return len(gaps)


def test_sweeps_are_best_fit():
    """As many sequences as best-fit over pieces in falling order, lengths that repeat included."""
    draw = random.Random(1)
    cases = [(2048, [600] * 4 + [480] * 3), (10, [10] * 5), (10, [1])]
    cases += [(limit, [draw.randint(1, limit) for _ in range(draw.randint(1, 200))]) for limit in (10, 50, 2048) for _ in range(20)]
    cases += [(limit, [x for x in draw.sample(range(1, limit + 1), draw.randint(2, 6)) for _ in range(draw.randint(1, 12))]) for limit in (10, 100, 2048) for _ in range(400)]
    for limit, sizes in cases:
        steps = packing.sweeps(dict(Counter(sizes)), limit)
        assert sum(s[2] for s in steps) == len(sizes)
        used, ranks = Counter(), Counter()
        for length, rank, n, first, offset, times in steps:
            assert rank == ranks[length] and n % times == 0
            ranks[length] += n
            for b in range(first, first + n // times):
                assert used[b] == offset
                used[b] += times * length
        assert max(used.values()) <= limit and len(used) == spec_best_fit(sizes, limit), sizes


def test_sweeps_over_tables(spark):
    """Every piece once, no overlap, nothing beyond the limit, and not many more sequences than best-fit takes."""
    draw = random.Random(4)
    sizes = [draw.choice([draw.randint(60, 128), draw.randint(20, 60), draw.randint(9, 20)]) for _ in range(60)] + [128, 128, 64, 64]
    stats = {}
    rows = packing.pack_by_sweeps(spark.createDataFrame(list(enumerate(sizes)), "piece_id long, length long"), 128, stats).collect()
    assert sorted(r.piece_id for r in rows) == list(range(len(sizes)))
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, sizes[r.piece_id]))
    for own in by.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end
            end += n
        assert end <= 128
    assert len(by) <= 1.15 * spec_best_fit(sizes, 128) and stats["sweeps"] < 60


def test_a_sweep_matches_by_rank(spark):
    """Of several pieces a gap takes the largest that it holds; each of equal gaps takes one."""
    pieces = spark.createDataFrame([(1, 5), (2, 5), (3, 9), (4, 3), (5, 20)], "piece_id long, length long").repartition(3)
    gaps = spark.createDataFrame([(10, 5), (11, 6), (12, 10), (13, 2)], "sequence_id long, room long").repartition(2)
    got = {r.sequence_id: r.piece_id for r in packing.sweep(pieces, gaps).collect()}
    assert got[12] == 3 and {got[10], got[11]} == {1, 2} and set(got) == {10, 11, 12}


def test_top_k(spark, tmp_path):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=8)]) for i in range(200)]
    rows += [(250, None), (251, [1.0, None] + [0.0] * 6), (300, [float("nan")] * 8), (350, [float("inf")] * 8), (400, [0.5] * 8), (401, [0.5] * 8), (402, [0.5] * 8), (450, [-3.0, 2.0]), (500, [])]
    spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<float>, label int, score int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op4_exact_top_k(spark, str(tmp_path)).collect())
    ok = {i: np.floor(256 * np.array([float(np.float32(x)) for x in v] + [0.0] * (8 - len(v)))).astype(np.int64) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ok if i % 50 == 0):
        scored = sorted((-int(ok[q] @ ok[i]), i) for i in ok if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == sorted(want)


def test_top_k_ids(spark):
    """Rows without an id take no part, and ids stay integers beside them."""
    df = spark.createDataFrame([(None, [2.0, 0.0]), (2**53 + 1, [1.0, 0.0]), (2**53, [0.5, 0.0]), (50, [1.0, 1.0])], "vec_id long, embedding array<double>")
    v = topk.integers(df)
    got = sorted(tuple(r) for r in topk.exact_top_k(v, v.filter("vec_id % 50 = 0")).collect())
    assert got == [(50, 1, 2**53 + 1, 65536), (50, 2, 2**53, 32768)]


def test_top_k_sends_vectors_once_and_thresholds_on(spark):
    """Rows exchanged grow with the vectors and the queries' blocks; later blocks know the k-th score of the first one and prune by it."""
    draw = np.random.default_rng(3)
    sent, pruned = [], []
    for n in (600, 1200):
        rows = [(i, [float(x) for x in np.floor(256 * draw.normal(size=8))]) for i in range(n)]
        v = spark.createDataFrame(rows, "vec_id long, v array<double>").cache()
        stats = {}
        got = topk.exact_top_k(v, v.filter("vec_id % 50 = 0"), block=100, stats=stats).collect()
        m = np.array([x for _, x in rows])
        for q in range(0, n, 50):
            want = sorted((-int(m[q] @ m[i]), i) for i in range(n) if i != q)[:5]
            assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
        sent.append(stats["vectors"])
        pruned.append(stats["queries"])
    assert sent == [600, 1200] and pruned == [12 * 6, 24 * 12]


def test_index_prunes_by_a_threshold():
    draw = np.random.default_rng(4)
    v = np.floor(256 * draw.standard_normal((4000, 32))).astype(np.int64)
    index, q = topk.ImpactIndex(np.arange(4000), v), np.floor(256 * draw.standard_normal(32)).astype(np.int64)
    scores = np.sort(v @ q)[::-1]
    rows, found = index.search(-1, q, 5)
    assert found.tolist() == scores[:5].tolist()
    rows, found = index.search(-1, q, 5, floor=int(scores[2]))
    assert found.tolist() == scores[:3].tolist() and index.segments < index.levels * 32
    assert index.search(-1, q, 5, floor=int(scores[0]) + 1)[0].size == 0


def test_top_k_few(spark, tmp_path):
    spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [(r.query_id, r.vec_id, r.score) for r in topk.op4_exact_top_k(spark, str(tmp_path)).collect()] == [(0, 1, 256 * 512)]


def test_top_k_of_wide_and_long_vectors(spark):
    """Sums beyond 64 bits, and vectors of very different lengths, in several blocks and parts."""
    draw = random.Random(3)
    rows = [(0, [1e17, 2.0]), (1, [1e17, 1.0]), (2, [-1e300, 5.0]), (3, [3.0] * 3000), (4, [float(2**52 + 1), 1.0]), *((i, [float(draw.randint(-9, 9)) for _ in range(draw.choice([0, 1, 5]))]) for i in range(5, 60))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [int(x) * 256 for x in v] for i, v in rows}  # all are whole numbers
    score = lambda a, b: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(whole[a], whole[b]))))
    v = topk.integers(df)
    want = sorted((q, k + 1, i, -s) for q in whole for k, (s, i) in enumerate(sorted((-score(q, i), i) for i in whole if i != q)[:5]))
    before = topk.QUERIES
    try:
        topk.QUERIES = 16
        assert sorted(tuple(r) for r in topk.exact_top_k(v, v).collect()) == want
    finally:
        topk.QUERIES = before


def test_index_is_exact_and_stops():
    draw = np.random.default_rng(2)
    v = draw.integers(-300, 300, (1500, 16))
    v[100:140] = v[0]
    ids = np.arange(1500)
    index = topk.ImpactIndex(ids, v)
    for q in (0, 7, 100, 1499):
        rows, scores = index.search(q, v[q], 5)
        s = v @ v[q]
        s[q] = -(10**9)
        best = np.lexsort((ids, -s))[:5]
        assert rows.tolist() == best.tolist() and scores.tolist() == s[best].tolist()
    assert len(index.search(0, np.zeros(16, np.int64), 5)[0]) == 5


def near_texts():
    draw = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choices(words, k=120) for _ in range(6)]
    out = [" ".join(b) for b in base] + [None, "", " \n", "one two", "one two", "one  two\n", "a b c d e", "x y z"]
    for b in base:
        for _ in range(15):
            c = list(b)
            for _ in range(draw.choice([0, 1, 1, 2, 4])):
                c[draw.randrange(len(c))] = draw.choice(words)
            out.append(" ".join(c))
    return out + [out[0]] * 5


def spec_join(texts):
    sets = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root, links = list(range(len(texts))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in range(len(texts))}


def test_jaccard_join(spark):
    texts = near_texts()
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs(spark, enumerate(texts)).withColumn("class_id", F.lit(0))).collect()}
    assert got == spec_join(texts)


def test_jaccard_rows_not_ids(spark):
    """Repeated rows are copies; rows of one id and different texts are documents of their own."""
    draw = random.Random(4)
    a, c = (" ".join(f"w{draw.randrange(999)}" for _ in range(100)) for _ in range(2))
    b, d = a + " more", c + " more"
    join = lambda rows: sorted(((r.doc_id, r.class_id, r.n_links, r.first) for r in jaccard.jaccard_join(docs(spark, rows)).collect()), key=str)
    assert join([(1, a), (1, a), (3, b)]) == [(1, 1, 2, True), (1, 1, 2, True), (3, 1, 2, False)]
    assert join([(1, a), (1, c), (4, d)]) == [(1, 1, 0, True), (1, 1, 1, True), (4, 1, 1, False)]
    assert join([(None, a), (None, a), (2, b), (3, c), (None, d), (5, None), (5, "")]) == join([(5, ""), (None, d), (3, c), (2, b), (None, a), (None, a), (5, None)])
    # One row of each class stays, whatever its id.
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs(spark, rows), "").collect()), key=str)
    assert kept([(1, a), (1, a), (3, b)]) == [(1, a)]
    assert kept([(1, a), (1, c), (4, d)]) == sorted([(1, a), (1, c)])
    assert len(kept([(5, None), (5, None), (6, ""), (None, a), (None, a)])) == 4


def test_jaccard_chain(spark, monkeypatch):
    """Texts that only a chain holds together don't meet: rows of a large group grow with it, and links are those of brute force."""
    draw = random.Random(2)
    words = [f"w{i}" for i in range(5000)]
    chain, now = [], draw.choices(words, k=60)
    for _ in range(60):
        chain.append(" ".join(now))
        now = now[6:] + draw.choices(words, k=6)
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    sent = []
    deal = jaccard.dealt

    def counted(rows, bins):
        out = deal(rows, bins)
        sent.append(out)
        return out

    monkeypatch.setattr(jaccard, "dealt", counted)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs(spark, enumerate(chain))).collect()}
    assert got == spec_join(chain)
    near = [c.rsplit(" ", 1)[0] + f" z{i}" for i, c in enumerate([chain[0]] * 100)]
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs(spark, enumerate(near))).collect()} == spec_join(near)
    rows = [x.count() for x in sent]
    assert rows[0] < 60 * 14 and rows[1] == 100 * 25, rows  # the whole group: 60 * 15


def test_slots_of_a_long_chain(spark):
    """20,000 texts in one group, each in a bucket with the next: some rows for each text, not a block for each block."""
    n = 20_000
    members = spark.range(n).select(F.col("id").alias("node"), F.lit(0).cast("long").alias("comp"), F.array((F.col("id") / 2).cast("long"), ((F.col("id") + 1) / 2).cast("long") + n, *(F.col("id") + (k + 2) * n for k in range(22))).alias("bands"))
    rows = jaccard.dealt(jaccard.slots(members), 20)
    assert n < rows.count() <= 2 * n and rows.agg(F.max("band")).first()[0] == 1


def test_jaccard_blocks():
    """A group in two blocks finds what it finds as a whole."""
    hashes, texts = jaccard.WordHashes(), [t for t in near_texts() if t and len(t.split()) > 5]
    sets = [jaccard.shingles(t.encode().split(), hashes) for t in texts]
    reps, copies = np.arange(len(sets)), np.ones(len(sets), np.int64)
    whole, _ = jaccard.linked(copies, sets, np.full(len(sets), jaccard.WHOLE), 0.8)
    half = (reps % 2).astype(int)
    parts = np.zeros(len(sets), np.int64)
    for own in (np.flatnonzero(half == 0), np.flatnonzero(half == 1), reps):
        side = half if len(own) == len(reps) else np.full(len(own), jaccard.WHOLE)
        parts[own] += jaccard.linked(copies[own], [sets[i] for i in own], side, 0.8)[0]
    assert (parts == whole).all()


def test_jaccard_large_group(spark, monkeypatch):
    """Groups beyond a block go to pairs of blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    texts = near_texts()
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_join(docs(spark, enumerate(texts))).collect()} == spec_join(texts)


def test_bands():
    bands, rows = jaccard.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= jaccard.MOST_HASHES
    with pytest.raises(ValueError):
        jaccard.bands_for(0.1, 0.9999, 4)


def test_components(spark):
    draw = random.Random(9)
    edges = [(i, i + 1) for i in range(30)] + [(100 + draw.randrange(20), 100 + draw.randrange(20)) for _ in range(15)] + [(7, 7), (200, 201), (201, 200)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_nothing_that_grows_is_broadcast(spark, monkeypatch):
    """Sides exploded over salts count as small as before to Spark, so the driver got many times the threshold."""
    plans = []

    def seen(f):
        return lambda df, *more: (plans.append(df._jdf.queryExecution().executedPlan().toString()), f(df, *more))[1]

    monkeypatch.setattr(components, "written", seen(components.written))
    components.components(spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "a long, b long"))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    plans.clear()
    monkeypatch.setattr(jaccard, "cut", seen(jaccard.cut))
    words = " ".join(f"w{i}" for i in range(40))
    out = jaccard.jaccard_join(spark.createDataFrame([(1, words), (2, words + " x"), (3, "y")], "doc_id long, text string"))
    out = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in out and "Broadcast" not in out


def test_second_stage_broadcasts_nothing_while_it_runs(spark, monkeypatch):
    """Once it knew a side's size, Spark sent members of groups and kept documents through the driver, as hash tables of twice the threshold."""
    plans = []

    def seen(df, cut=jaccard.cut):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(jaccard, "cut", seen)
    words = " ".join(f"w{i}" for i in range(40))
    out = corpus_pipeline.near_duplicates(spark, docs(spark, [(1, words), (2, words + " x"), (3, "y"), (None, "z")]), "")
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, None]
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joined = [p for p in plans if "SortMergeJoin" in p]
    assert len(joined) > 2 and all("isFinalPlan=true" in p and "Broadcast" not in p for p in joined) and not any("Broadcast" in p for p in plans)


def spec_suffix(rows):
    first = {}
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    for i, b in rows:
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        spans, p = [], 0
        while p < len(gone):
            q = p
            while q < len(gone) and gone[q] == gone[p]:
                q += 1
            if gone[p]:
                spans.append((p, q))
            p = q
        out.append((i, spans, bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


def repeated_rows():
    draw = random.Random(7)
    text = lambda n: "".join(draw.choices("abcdé \n", k=n))
    shared = [text(n) for n in (49, 50, 51, 90, 400)]
    rows = [(i, text(draw.randint(0, 300)) + draw.choice(shared) + text(draw.randint(0, 80)) + draw.choice(shared)) for i in range(40)]
    long = text(30000)
    return rows + [(50, None), (51, ""), (52, "x" * 49), (53, "x" * 50), (54, "x" * 500), (55, long), (56, text(100) + long[5000:9000] + text(100) + long[100:160]), (57, rows[3][1]), (57, rows[3][1]), (58, "\x00" * 200), (59, "\x00" * 60), (-5, shared[4][10:80])]


@pytest.mark.parametrize("block_bytes", [1 << 30, 3000])
def test_suffix_dedup(spark, block_bytes):
    rows = repeated_rows()
    got = suffixes.suffix_dedup(docs(spark, rows).withColumn("kept", F.lit("clash")), block_bytes=block_bytes).collect()
    assert sorted((r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got) == spec_suffix(rows)
    assert all(r.rest.source == "s" and r.rest.kept == "clash" for r in got)


def test_suffix_dedup_whole_characters_and_empty(spark):
    a = "é" * 60
    got = suffixes.suffix_dedup(docs(spark, [(0, a), (1, "x" + a)]), whole_chars=True).orderBy("doc_id").collect()
    assert bytes(got[1].kept).decode() == "x"
    assert suffixes.suffix_dedup(docs(spark, [(0, a)]).filter("doc_id < 0")).count() == 0


def test_families_against_brute_force():
    draw = np.random.default_rng(3)
    for _ in range(4):
        n = 300
        base = draw.integers(97, 101, 400).astype(np.uint8)
        doc, size, texts = np.sort(draw.integers(0, 60, n)), draw.integers(1, 30, n), []
        for z in size:
            at = draw.integers(0, 400 - z - 49)
            x = base[at : at + z + 49].copy()
            if draw.random() < 0.3:
                x[draw.integers(0, len(x))] = 120
            texts.append(x)
        first, want = {}, []
        for x, d, z in zip(texts, doc, size):
            for k in range(z):
                first.setdefault(x[k : k + 50].tobytes(), d)
        for x, d, z in zip(texts, doc, size):
            want += [first[x[k : k + 50].tobytes()] < d for k in range(z)]
        found, family = suffixes.find_strings(np.concatenate(texts), doc, size, batch=200)
        assert (found == np.array(want)).all() and family.scanned > 10 and family.merged > 3
        m, a = draw.integers(0, 20, (n, 2)).astype(np.uint64), draw.integers(0, 3, n).astype(np.uint32)
        found, open_, _ = suffixes.find_sections(m, a, doc, batch=32)
        seen = {}
        for x, d in zip(map(tuple, m), doc):
            seen.setdefault(x, d)
        assert (found == np.array([seen[x] < d for x, d in zip(map(tuple, m), doc)])).all()  # most keys stand for several sections here
        assert not (found & open_).any()


def test_levels_stay_few():
    family = suffixes.SuffixFamily(lambda at: at[:, None])
    for i in range(40):
        k = np.arange(i * 10, i * 10 + 10)
        assert not family.take(k.astype(np.uint64), k, np.full(10, i)).any()
    sizes = [len(x) for x in family.levels]
    assert sum(sizes) == 400 and len(sizes) <= 6 and all(a > 2 * b for a, b in zip(sizes, sizes[1:]))
    assert all((np.diff(x.key.astype(int)) > 0).all() for x in family.levels)


def test_suffix_dedup_of_patterns_that_cancel(spark):
    """Changes in the order of a Thue-Morse word cancel in polynomials modulo 2 ** 64; these two documents have no string in common."""
    bit = [bin(i).count("1") & 1 for i in range(1024)]
    count = lambda i: "".join("ABCDEFGHIJK"[i // 11**k % 11] for k in range(3))
    # Every string holds a part of the filling that names its anchor, so all are one section.
    one, two = ("".join("zy"[b ^ k] + count(i) + "cdchbhhggdefcbbhdadhgabdch" for i, b in enumerate(bit)) for k in (0, 1))
    rows = [(1, one), (2, two)]
    assert all(k == t.encode() for (_, _, k), (_, t) in zip(spec_suffix(rows), rows))
    got = {r.doc_id: bytes(r.kept).decode() for r in suffixes.suffix_dedup(docs(spark, rows)).collect()}
    assert got == {i: k.decode() for i, _, k in spec_suffix(rows)}


def test_suffix_dedup_hot_anchors(spark, monkeypatch):
    """Very many sections of one anchor go to the buckets of their strings."""
    draw = random.Random(5)
    noise = lambda n: "".join(draw.choices("abcdefgh", k=n))
    rows = [(i, noise(60) + "all rights reserved by the owner of this" + noise(60)) for i in range(150)]
    rows += [(200 + i, rows[i][1][20:130] + noise(40)) for i in range(20)] + [(300, rows[0][1]), (300, rows[1][1])]
    # Workers read the module anew, so the bound is set in what they are sent.
    whole = suffixes._reply_anchors

    def reply(group):
        suffixes.HOT = 5
        return whole(group)

    monkeypatch.setattr(suffixes, "_reply_anchors", reply)
    for block_bytes in (1 << 30, 4000):
        got = suffixes.suffix_dedup(docs(spark, rows), block_bytes=block_bytes).collect()
        assert sorted((r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in got) == spec_suffix(rows)


def test_suffix_rows_grow_with_the_input():
    """Rows of an exchange are pairs of block and bucket: at most a row for every ROW_BYTES."""
    for size in (0, 1, 10**6, 10**9, 10**11, 10**14):
        assert suffixes.n_blocks(size) ** 2 <= max(1, 2 * size / suffixes.ROW_BYTES + 2 * suffixes.n_blocks(size))


def test_suffix_family_on_the_query_path(spark, tmp_path):
    """Over sf0.001 a bucket's levels are scanned and merged many times."""
    data = b"".join((r.text or "").encode() for r in spark.read.parquet(SMALL + "/documents.parquet").select("text").collect())
    data = np.frombuffer(data, np.uint8)
    s = suffixes.Sections(data, np.array([0, len(data)]))
    mark = suffixes.strong(data, s.first, s.first + s.size + 49, 1)
    _, _, family = suffixes.find_sections(mark, s.anchor.astype(np.uint32), np.arange(len(s.first)))
    assert family.merged > 2 and family.scanned > 5


SMALL = "/root/testdata/sf0.001"


def test_suffix_query_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(SMALL + "/documents.parquet").select("doc_id", "text").collect()]
    want = {i: (len((t or "").encode()), len((t or "").encode()) - len(k), len(spans), sha(k)) for (i, spans, k), (_, t) in zip(spec_suffix(rows), sorted(rows))}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.op1_suffix_dedup(spark, SMALL).collect()}
    assert got == want


PAGES = [(1, "http://a/x", "<p>" + "é" * 60), (2, "http://a/y\r\nX: 1", "<p>" + "é" * 60), (3, None, None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (9, "u", "z" * 200000), (8, "u", "z" * 200000), (7, "http://a/%20é", "\r\n\r\nbody\x00" * 40)]


def test_warc_query(spark, tmp_path):
    spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, payload string").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r for r in warc.op9_warc(spark, str(tmp_path)).collect()}
    first = {}
    for i, _, h in sorted(PAGES):
        b = (h or "").encode()
        first.setdefault(b, i)
        ref = first[b] if len(b) >= 100 and first[b] < i else None
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(b), sha(b), "revisit" if ref else "response", ref)
    assert len(got) == len(PAGES)


def test_warc_reads_and_skips(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "w")
    rows = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.page_records(rows).write.format("warc").mode("append").option("path", path).save()
    df = lambda: spark.read.format("warc").load(path)
    assert {r.target_uri for r in df().collect()} == {"http://a/x", "http://a/y\r\nX: 1", None, "u", "http://a/%20é"}
    assert df().filter("record_type = 'revisit'").count() == 2
    assert [r.payload_length for r in df().filter("record_id in ('<urn:page:4>', '<urn:page:3>')").collect()] == [0, 0]
    bare = lambda: spark.read.format("warc").option("payload", "false").load(path)
    assert bare().filter("payload is not null").count() == 0 and bare().filter("target_uri like 'http://a%'").count() == 3
    # Archives of other writers: members that do not carry their length, records that are not compressed, blocks that are no HTTP, headers that look encoded or repeat.
    import gzip

    other = str(tmp_path / "other")
    (tmp_path / "other").mkdir()
    row = {"record_type": "response", "record_id": "<urn:x>", "target_uri": "u", "record_date": "d", "payload_digest": None, "refers_to": None, "payload_length": None, "headers": [], "payload": b"abc" * 50000}
    (tmp_path / "other" / "a.warc.gz").write_bytes(gzip.compress(warc.record(row)) + gzip.compress(warc.record(row | {"record_id": "<urn:y>"})))
    info = b"software: x\r\n\r\nmore"
    foreign = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(info), info)
    http = b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nbody"
    foreign += b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:r>\r\nWARC-Target-URI: http://x/a%%20b%%2Fc\r\nWARC-Concurrent-To: <1>\r\nWARC-Concurrent-To: <2>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(http), http)
    (tmp_path / "other" / "b.warc").write_bytes(foreign + warc.record(row | {"record_id": "<urn:z>"}))
    (tmp_path / "other" / "c.warc.gz").write_bytes(gzip.compress(foreign))
    (tmp_path / "other" / "d.warc").write_bytes(b"")
    read = lambda **options: spark.read.format("warc").options(path=other, **options).load()
    assert read().filter("record_id = '<urn:y>'").first().payload == b"abc" * 50000 and read().count() == 7
    assert [bytes(r.payload) for r in read().filter("record_type = 'warcinfo'").collect()] == [info] * 2
    for options in ({}, {"payload": "false"}):
        for r in read(**options).filter("record_id = '<urn:r>'").collect():
            assert (r.target_uri, r.headers["warc-concurrent-to"], r.payload_length) == ("http://x/a%20b%2Fc", "<1>\n<2>", 4)
            assert r.payload == (None if options else b"body")
    # A write beside them adds to what is read.
    warc.page_records(rows).write.format("warc").mode("append").option("path", other).save()
    assert read().count() == 7 + len(PAGES)


def test_warc_append_and_overwrite(spark, tmp_path):
    warc.register(spark)
    path = str(tmp_path / "w")
    pages = lambda lo, hi: warc.page_records(spark.createDataFrame([(i, f"u{i}", "x" * 200 * i) for i in range(lo, hi)], "page_id long, url string, html string").repartition(2))
    ids = lambda: sorted(r.record_id for r in spark.read.format("warc").load(path).collect())
    names = lambda *r: sorted(f"<urn:page:{i}>" for i in r)
    save = lambda df, mode: df.write.format("warc").mode(mode).option("path", path).save()
    save(pages(0, 2), "append")
    save(pages(2, 4), "append")
    assert ids() == names(0, 1, 2, 3)
    (tmp_path / "w" / f"part-{'0' * 32}.warc.gz").write_bytes(b"what a lost task left")
    assert ids() == names(0, 1, 2, 3)
    save(pages(7, 9), "overwrite")
    assert ids() == names(7, 8)
    save(pages(1, 2), "append")
    assert ids() == names(1, 7, 8)


def test_warc_without_ids(spark, tmp_path):
    spark.createDataFrame([(None, "u", "x" * 150), (3, "u", "x" * 150), (4, None, "x" * 150), (None, "u", "x" * 150)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.op9_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(None, 150, "response", None)] * 2 + [(3, 150, "response", None), (4, 150, "revisit", 3)], key=str)


def test_paths_are_those_of_spark(spark):
    """Without a scheme a path lies in Spark's default file system; new paths carry theirs."""
    from sparkloom.llm import common

    assert common.qualified(spark, "/a/b") == "file:///a/b" and common.qualified(spark, "file:///a b") == "file:///a b"
    assert "://" in common.fresh(spark, "x") and warc.filesystem(common.fresh(spark, "x"))[1].startswith("/")
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://store/")
    conf.set("fs.viewfs.mounttable.store.link./in", "file:///tmp")
    try:
        assert common.qualified(spark, "/in/x") == "viewfs://store/in/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_warc_empty(spark, tmp_path):
    warc.register(spark)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.page_records(none).write.format("warc").mode("append").option("path", str(tmp_path / "w")).save()
    assert spark.read.format("warc").load(str(tmp_path / "w")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    draw = random.Random(12)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghijkl", k=draw.randint(3, 8))) for _ in range(n))
    base, passage = prose(150), prose(60)
    rows = [(i, prose(120)) for i in range(12)] + [(20, base), (21, base), (22, base.replace(base.split()[70], "changed")), (23, "too short"), (24, None), (25, prose(60) + " " + passage), (26, prose(80) + " " + passage), (27, prose(90) + " password=b7db7aa4a5fcc78305")]
    rows.append(rows[0])
    d = docs(spark, rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
        if name != "best-fit packing":
            assert now.columns == d.columns
            assert all(r.n_chars == len(r.text) for r in seen[name] if r.text is not None)
    ids = lambda name: sorted(r.doc_id for r in seen[name])
    assert ids("quality rules") == sorted([*range(12), 0, 20, 21, 22, 25, 26, 27])
    assert ids("n-gram Jaccard join") == [*range(12), 20, 25, 26, 27]
    texts = {r.doc_id: r.text for r in seen["suffix-array dedup"]}
    assert passage in texts[25] and passage[10:-10] not in texts[26] and texts[20] == base
    assert "[secret]" in {r.doc_id: r.text for r in seen["secret scans"]}[27]
    assert sorted({r.doc_id for r in seen["best-fit packing"]}) == ids("secret scans")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen["best-fit packing"])


@pytest.mark.parametrize("some", [True, False])
def test_pipeline_edges(spark, tmp_path, some):
    """Null ids and texts, an empty table, and columns that clash with names the stages use."""
    draw = random.Random(1)
    prose = lambda n: " ".join("".join(draw.choices("abcdefghijkl", k=draw.randint(3, 8))) for _ in range(n))
    rows = [(i, prose(90), "en", None, 1) for i in range(3)] + [(None, prose(90), None, "s", None), (None, None, "en", "s", 1), (7, None, "en", "s", 1), (8, "", "en", "s", 1)]
    now = spark.createDataFrame(rows, DOCS).filter(F.lit(some))
    now = now.withColumn("kept", F.lit(True)).withColumn("rest", F.struct(F.lit(1).alias("z"))).withColumn("spans", F.array(F.lit("q"))).withColumn("ids", F.lit(2)).withColumn("length", F.lit("L"))
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert name == "best-fit packing" or now.columns == columns
        assert now.count() == 4 * some
