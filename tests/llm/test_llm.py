"""The training-data operators against brute force, on a small fixture with the awkward cases."""
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from oracle import compare, connect
from tidegate.llm import ann, apportion, chaining, chat, jaccard, langid, mixing, packing, quality_cnn, queries, rules, simhash, stages, suffixes
from tidegate.llm.text import told_apart
from tidegate.llm.tokens import WordTokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, shard string, size string, spans string, fp string"


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh éß") for _ in range(rng.randint(2, 8))).replace(" ", "") or "x" for _ in range(400)]
    new = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = new(300), new(70)
    edited = base.split(" ")
    edited[150] = "edited"
    texts = [base, base, " ".join(edited), new(80) + " " + passage + " " + new(40), new(30) + "\n" + passage, new(120), "", None, "  \n ", "one", new(6000), "ZZ " + base]
    return [(i, t, "en", None if i % 4 == 3 else "sß"[i % 2], None if t is None else len(t), "x", "y", "z", "w", "v") for i, t in enumerate(texts)] + [
        (None, base, None, "s", 1, None, None, None, None, None), (5, texts[5], "en", "ß", 1, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_texts(), SCHEMA).repartition(3).cache()


def test_apportionment():
    got = apportion.sainte_lague([53, 24, 23], 7)
    seats = [0, 0, 0]
    for _ in range(7):
        i = max(range(3), key=lambda j: ([53, 24, 23][j] / (2 * seats[j] + 1), -j))
        seats[i] += 1
    assert got == seats and sum(apportion.sainte_lague([1.0] * 5, 50, [3] * 5)) == 15
    assert apportion.shares([10, 100], [5, 1], 100) == [20.0, 80.0]


def test_mixing(docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    by = {}
    for r, s in [(r, r.source_size) for r in rows]:
        a = by.setdefault(s, [0, r.target])
        a[0] += r.taken
    assert all(abs(t - want) <= 64 for t, want in by.values())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def test_small_sources_stay_in_the_mix_of_the_pipeline():
    """A source of 150 words keeps its share, and what is chosen of a large one stays in long runs."""
    from tidegate.llm import stages
    spec = stages.MIX
    sources = [{"sid": 0, "target": 1_500_000.0}, {"sid": 1, "target": 300.0}]
    bands = [{"sid": i, "band": 0, "words": w, "blocks": -(-w // spec.block_words)} for i, w in enumerate((1_000_000, 150))]
    quota = {sid: q for sid, _, q in mixing._band_quotas(sources, bands, spec)}
    assert abs(quota[1] * spec.block_words - 300) <= spec.block_words
    counts = mixing.block_counts(100_000, 3_000, spec.block_words, np.random.default_rng(1), spec.run_blocks)
    assert counts.sum() == 3_000 and (np.diff(counts) != 0).sum() <= 2 * 3_000 / spec.run_blocks + 2


def test_fingerprints_and_classes(docs):
    def slow(t):
        w = (t or "").encode().lower().split()
        s = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(docs).collect()}
    want = {r[0]: slow(r[1]) for r in _texts()}
    assert got == want


@pytest.mark.parametrize("bucket", [512, 4])
def test_covering_finds_every_link(spark, bucket):
    """Also with a tiny bucket, so that the recursion is used, and with dense clusters."""
    rng = np.random.default_rng(1)
    centres = rng.integers(0, 2 ** 63, 20, dtype=np.uint64)
    fps = {int(c) for c in centres}
    for c in centres[:4]:
        fps |= {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False)) for _ in range(60)}
    a = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 4
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        if (new == label).all():
            break
        label = new
    nodes = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp bigint")
    parent = {int(x): int(x) for x in a.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for r in simhash.near_links(nodes, 4, bucket).collect():
        parent[root(r.a)] = root(r.b)
    groups = {}
    for x, k in zip(a.view(np.int64).tolist(), label.tolist()):
        groups.setdefault(k, set()).add(root(x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


@pytest.mark.parametrize("bucket, size", [(64, 300), (512, 1500)])
def test_covering_of_large_clusters_at_radius_6(spark, bucket, size):
    """More fingerprints than a bucket takes share 32 bits, and some of the open ones are cut further: all links are found."""
    rng = np.random.default_rng(4)
    low = rng.choice(2 ** 20, size, replace=False).astype(np.uint64)
    a = np.sort(np.concatenate([np.uint64(0xA5A5A5A5 << 32) | low, rng.integers(0, 2 ** 63, 40, dtype=np.uint64)]))
    want = {frozenset((i, j)) for i, j in zip(*np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 6, 1)))}
    at = {int(x): i for i, x in enumerate(a.view(np.int64))}
    parent = list(range(len(a)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    nodes = spark.createDataFrame([(x,) for x in at], "fp bigint")
    for r in simhash.near_links(nodes, 6, bucket).collect():
        parent[root(at[r.a])] = root(at[r.b])
    assert want and all(len({root(i) for i in pair}) == 1 for pair in want)
    assert len({root(i) for i in range(len(a))}) > 1


def test_every_table_narrows_its_bucket():
    rng = random.Random(2)
    for radius in (4, 6):
        for n in (64, 40, 32, 20, 10, radius + 1):
            shared = sum(1 << b for b in rng.sample(range(64), 64 - n))
            tables = simhash.masks(shared, radius).view(np.uint64).tolist()
            assert all(m & shared == shared and m != shared for m in tables)
            for _ in range(50):
                x = sum(1 << b for b in rng.sample([b for b in range(64) if not shared >> b & 1], rng.randint(1, radius)))
                assert any(not m & x for m in tables) or n == radius + 1 and x.bit_count() == radius + 1


def test_near_copies(docs):
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got[1] == 0 and got[2] == 0 and got[11] == 0 and 3 not in got and 10 not in got


def _shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def _copy_groups(texts):
    """Smallest id of every text's closure of pairs with 0.8 of their shingles in common, by brute force."""
    sets, label = [_shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {i: x for i, x in enumerate(label) if label.count(x) > 1}


def test_near_copies_with_edits_insertions_and_cuts(spark):
    """Every pair of similarity 0.8 or more is found, also where a stretch of new words was put in."""
    rng = random.Random(3)
    new = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for _ in range(25):
        base = new(200)
        edited = list(base)
        for i in rng.sample(range(200), 4):
            edited[i] = "edited"
        texts += [base, base[:90] + new(40) + base[90:], base[:160 + rng.randrange(10)], edited, new(30) + base]
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id bigint, text string").repartition(3)
    want = _copy_groups([" ".join(t) for t in texts])
    assert len(want) > 90 and {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want


def test_near_copies_of_several_families(spark):
    """Families of the same words in other order, which all share some shingles with the first text and are not its copies."""
    rng = random.Random(6)
    words, common = [f"v{i}" for i in range(120)], [f"c{i}" for i in range(30)]
    texts = [words + common]
    for _ in range(30):
        base = rng.sample(words, 120) + common
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(120)] = "edited"
            texts.append(copy)
    docs = spark.createDataFrame(list(enumerate(map(" ".join, texts))), "doc_id bigint, text string").repartition(3)
    want = _copy_groups([" ".join(t) for t in texts])
    assert len(want) > 100 and {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()} == want


def test_lists_compare_what_the_first_leaders_reject(spark):
    """Sets over few tokens: every list is long, and few of its members are like the one that leads."""
    rng = random.Random(8)
    sets = sorted({tuple(sorted(rng.sample(range(15), rng.randint(8, 11)))) for _ in range(150)}, key=lambda s: rng.random())
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    near = {(i, j) for j in range(len(sets)) for i in range(j) if len({*sets[i]} & {*sets[j]}) >= 0.8 * len({*sets[i]} | {*sets[j]})}
    for i, j in near:
        parent[max(root(i), root(j))] = min(root(i), root(j))
    frame = spark.createDataFrame([(i, " ".join(f"t{x}" for x in s)) for i, s in enumerate(sets)], "doc_id bigint, text string")
    for spec in (jaccard.JoinSpec(width=1, percent=80, most_keys=0), jaccard.JoinSpec(width=1, percent=80, most_keys=0, close=0)):
        got = {r.doc_id: r.component_id for r in jaccard.link(frame, spec).collect()}
        assert len(near) > 20 and got == {i: root(i) for i in range(len(sets))}


def test_near_copies_of_a_repeated_doc_id(spark):
    """Two texts under one doc_id are two documents: the unique one stays, its namesake goes as a copy."""
    rng = random.Random(4)
    text = lambda: " ".join(f"v{rng.randrange(5000)}" for _ in range(60))
    lone, copied = text(), text()
    rows = [(1, copied), (2, lone), (2, copied), (2, copied + " more"), (3, lone + " x"), (4, ""), (5, None), (None, copied)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    kept = stages.simhash_dedup(spark, docs, "").collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(1, copied), (2, lone), (4, ""), (None, copied)], key=str)


def test_sketches_drop_no_similar_pair():
    rng = np.random.default_rng(5)
    for _ in range(300):
        both, x, y = (rng.integers(0, 1 << 63, rng.integers(0, n) + 1).astype(np.uint64) for n in (400, 60, 60))
        sx, sy = (np.unique(np.concatenate([both, z])) for z in (x, y))
        apart = int(np.bitwise_count((jaccard.parity(sx, 8) ^ jaccard.parity(sy, 8)).view(np.uint64)).sum())
        assert apart <= len(np.setxor1d(sx, sy))


def test_packing(docs, spark):
    path = queries.vocabulary()
    rows = packing.pack_documents(docs, packing.PackSpec(path)).collect()
    tok = WordTokenizer(path)
    want = {r[0]: tok.whole.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in _texts()}
    places = {}
    for r in rows:
        own = want[r.doc_id][r.start:r.start + r.length]
        assert r.length == len(own) and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(want[r[0]]) for r in _texts())
    for t in ("İstanbul ΣΑΣ b naïve x\x1cy I'LL 12a<|endoftext|> 日本語 z", "", " ", "don't a1b2!?"):
        assert tok.ids(t) == tok.whole.encode(t, add_special_tokens=False).ids
    lengths = np.random.default_rng(0).integers(1, 2048, 3000)
    seq, _ = packing.pack(lengths, packing.PackSpec(path))
    plain, _ = packing.pack(lengths, packing.PackSpec(path, small=2048))          # best-fit decreasing alone
    assert seq.max() <= 1.01 * plain.max()
    assert packing.pack_documents(docs.limit(0), packing.PackSpec(path)).count() == 0


def test_rule_counts_and_list():
    text = "a b c d e\na b c d e\n\n #x\n #x"
    assert rules.text_counts(text)[:5] == (12, 14, 2, 2, 10) and rules.text_counts(None)[0] == 0
    rng = np.random.default_rng(0)
    x = {"a": rng.random(2000), "b": rng.random(2000)}
    bad = (x["a"] > 0.8) & (x["b"] < 0.5)
    learned = rules.learn(x, bad)
    hit = np.zeros(2000, bool)
    for r in learned:
        hit |= rules.covers(r, x, 2000)
    assert (hit == bad).mean() > 0.98
    assert rules.learn(x, np.zeros(2000, bool)) == []


def test_cnn(docs):
    rng = random.Random(2)
    texts = [(" ".join(rng.choice(["ab", "cde", "fg"]) + ("%%%" if bad else "") for _ in range(60))).encode() for bad in (0, 1) * 60]
    m = quality_cnn.fit(texts, np.array([1, 0] * 60) == 1, quality_cnn.CnnSpec(epochs=3))
    p = np.array([quality_cnn.probability(quality_cnn.document_vector(t, m)[None], m)[0] for t in texts])
    assert ((p > 0.5) == (np.arange(120) % 2 == 0)).mean() > 0.95
    rows = quality_cnn.score(docs, m).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality_cnn.fit([], np.empty(0, bool)).dense[-1] == 0


def test_every_byte_is_read():
    spec = quality_cnn.CnnSpec(filters=2)
    m = quality_cnn.constant(0.5, spec)
    m.table[:, ord("z"), 0] = 1
    for n in (1, 2, 5, 6, 7, 8, 9, 1023, 1024, 1025, 1985, 61_440, 61_441, 61_503, 61_504, 61_505, 61_507, 123_001):
        flat = quality_cnn.document_vector(b"a" * n, m)
        for at in {0, n // 2, n - 1, max(0, n - 2), max(0, n - 7)}:
            text = bytearray(b"a" * n)
            text[at] = ord("z")
            assert (quality_cnn.document_vector(bytes(text), m) != flat).any(), (n, at)


def test_chat(spark, sf):
    t = chat.ChatTemplate()
    said = [(1, 0, "user", "a\\<|end|>\n</s>\\\\[INST]"), (1, 1, "assistant", "<|text|><\\|turn|>"), (2, 0, "assistant", None), (None, None, None, "x"), (3, 0, "user", "q"), (3, 1, "user", "q")]
    df = spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()}
    assert [(x.role, x.text) for x in got[1].back] == [(r, x) for c, _, r, x in said if c == 1] and got[1].loss == said[1][3]
    assert got[1].valid and not got[2].valid and got[3].bad_turn == 1 and got[None].n_turns == 1
    assert all(c not in x.text for r in got.values() for x in r.segments for c in t.controls if x.text not in ("", t.close) and not x.text.startswith(t.open))
    assert compare(connect(sf), queries.QUERIES["op8_chat"](spark, sf), queries.SQL["op8_chat"]) is None


def test_passages(docs):
    got = {r.doc_id: r for r in chaining.repeat_spans(told_apart(docs)).collect()}
    n = lambda i: sum(s.stop - s.start for s in got[i].spans)
    assert 70 <= n(4) <= 72 and got[4].sources == [3]
    assert n(1) == len(_texts()[0][1].split()) and n(2) == n(1) and 3 not in got and 10 not in got
    assert chaining.cut_words("a b  c\nd", [(1, 3)]) == "a d"
    at = np.array([0, 5, 10, 40, 15])
    assert [c.tolist() for c in chaining.chains(at, np.array([0, 5, 10, 12, 15]), chaining.ChainSpec())] == [[0, 1, 2, 4]]


def test_passages_whose_seeds_occur_elsewhere(spark):
    """Every run of 50 equal words is found, though its parts also stand alone in earlier and later documents."""
    rng = random.Random(9)
    new = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    passage = new(56)
    texts = [new(60) + passage[i:i + 14] + new(60) for i in range(0, 42, 6)]
    texts += [new(50) + passage + new(50)] + [new(60) + passage[i:i + 14] + new(60) for i in range(3, 42, 6)] + [new(70) + passage + new(30)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: [(s.start, s.stop) for s in r.spans] for r in chaining.repeat_spans(told_apart(docs)).collect()}
    assert list(got) == [len(texts) - 1] and got[len(texts) - 1][0][0] <= 70 and got[len(texts) - 1][0][1] >= 126


def test_exact_cosines_hold_few_pairs_at_a_time():
    """Many pairs pass the bounds of a full block of queries; gathered at once their vectors would take 2 x 120 MB here."""
    import tracemalloc
    rng = np.random.default_rng(2)
    q, v = rng.standard_normal((50, 300)), rng.standard_normal((70, 300))
    qi, vi = rng.integers(0, 50, 50_000), rng.integers(0, 70, 50_000)
    tracemalloc.start()
    got = ann.cosines(q, ann.norms(q), v, ann.norms(v), qi, vi, 30_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20
    assert np.allclose(got, ((q / ann.norms(q)[:, None]) @ (v / ann.norms(v)[:, None]).T)[qi, vi], atol=1e-12)


def test_alike_parts_of_an_alignment():
    score = [3, -5, 4, -1, 2, -9, 1, 1]
    assert chaining.heavy_parts(score) == [(0, 1), (2, 5), (6, 7), (7, 8)] or chaining.heavy_parts(score) == [(0, 1), (2, 5), (6, 8)]
    x = np.arange(200, dtype=np.uint32)
    y = x.copy()
    y[60:140] += 1000
    xs, ys, runs = chaining.align(x, y, np.array([5, 20, 150]), np.array([5, 20, 150]))
    assert (xs, ys, runs.tolist()) == (0, 0, [[60, 60, 1], [80, 80, 0], [60, 60, 1]])
    assert chaining.passages(xs, runs, chaining.ChainSpec()) == [(0, 60), (140, 200)]


def test_long_texts_tokenize_in_stretches(monkeypatch):
    from tidegate.llm import tokens
    texts = ["one two  three\tfour " * 40, "é ß 日本 語 " * 30, "x" * 500]
    coder = WordTokenizer(queries.vocabulary())
    whole = [coder.ids(t) for t in texts]
    monkeypatch.setattr(tokens, "STRETCH", 17)
    assert [coder.ids(t) for t in texts] == whole == [coder.whole.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("chunk", [1 << 20, 700])
def test_suffixes(docs, chunk):
    spec = suffixes.SuffixSpec(chunk=chunk, least_buckets=3)
    got = sorted(((r.doc_id is None, r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffixes.dedup_bytes(docs, spec).collect()), key=str)
    first = {}
    rows = [(r[0], (r[1] or "").encode()) for r in _texts()]
    for d, b in rows:
        if d is not None:
            for i in range(len(b) - 49):
                first[b[i:i + 50]] = min(d, first.get(b[i:i + 50], d))
    want = []
    for d, b in rows:
        hit = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if d is not None else 0):
            if first[b[i:i + 50]] < d:
                hit[i:i + 50] = True
        want.append((d is None, d, len(b), bytes(np.frombuffer(b, np.uint8)[~hit])))
    assert got == sorted(want, key=str)


def test_one_id_with_two_texts(spark):
    """A text loses its own repeats only, whatever another text of the same doc_id repeats, and two texts of
    one doc_id are no repeats of each other."""
    rng = random.Random(21)
    new = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared, alone, own = new(80), new(200), new(90)
    said = [(1, new(100) + " " + shared), (2, shared + " " + own), (2, alone), (2, new(30) + " " + own), (3, new(60)), (3, new(60)), (3, None)]
    rows = said + [(2, alone)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"twin": F.lit("x"), "n_chars": F.length("text").cast("bigint")}).repartition(3)
    found = told_apart(docs, "_t").select("doc_id", "text", F.col("_t").alias("twin"))
    by_text = {r.text: r.twin for r in found.collect()}
    got = {(r.doc_id, r.twin): [(s.start, s.stop) for s in r.spans] for r in chaining.repeat_spans(found).collect()}
    assert got == {(2, by_text[said[1][1]]): [(0, 80)]} and len({by_text[t] for i, t in said if i == 2}) == 3
    kept = {}
    for r in suffixes.dedup_bytes(docs, suffixes.SuffixSpec(least_buckets=3)).collect():
        kept.setdefault((r.doc_id, r.n_bytes), set()).add(bytes(r.kept))
    for i, t in rows:
        raw = (t or "").encode()
        first = said[0][1].encode()
        want = np.ones(len(raw), bool)
        for p in range(len(raw) - 49 if i == 2 else 0):
            if raw[p:p + 50] in first:
                want[p:p + 50] = False
        assert bytes(np.frombuffer(raw, np.uint8)[want]) in kept[i, len(raw)]
    left = stages.passage_dedup(spark, docs, "")
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == sorted((i, own if t == said[1][1] else t or "") for i, t in rows)


def test_blind_trie():
    rng = random.Random(0)
    words = [bytes(rng.choice(b"ab") for _ in range(8)) for _ in range(300)]
    trie = suffixes.BlindTrie()
    for i, w in enumerate(words):
        trie.add(w, i)
    got = list(trie.leaves())
    assert [w for w, _ in got] == sorted(set(words)) and all(words[i] == w for w, at in got for i in at)


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((400, 24)) + 3 * rng.standard_normal((8, 24))[rng.integers(0, 8, 400)]
    v[7] = v[9]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1050, [0.0] * 24), (1100, [float("nan")] + [1.0] * 23), (1150, [1.0]), (None, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit(1))
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    assert sorted(got) == list(range(0, 400, 50))
    hits = 0
    for q, found in got.items():
        c = unit @ unit[q]
        c[q] = -2
        hits += len({i for _, i, _ in found} & set(np.lexsort((np.arange(400), -c))[:5].tolist()))
        assert all(abs(s - c[i]) < 1e-12 for _, i, s in found)
    assert hits >= 0.9 * 5 * len(got)
    assert ann.search(df.limit(0)).count() == 0


def test_tags_in_one_pass():
    """Equal to the plain pattern with backtracking, and linear where nothing closes."""
    plain = re.compile(rb"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
    rng = random.Random(3)
    pieces = ["<script", "</script>", "</SCRIPT  >", "<Style>", "</style", "<!--", "-->", "<p>", "<", ">", "x", "\n", "<scripts>", "<!-->", "é"]
    for _ in range(4000):
        raw = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))).encode()
        assert langid.visible(raw) == plain.sub(b" ", raw), raw
    for one in ("<script ", "<style>", "<!-- ", "<", "<p ", "</script ", "<script>x</script "):
        start = time.process_time()
        langid.page_text(one * (1_000_000 // len(one)))
        assert time.process_time() - start < 3, one


def test_language(spark):
    words = {"en": "the house and the water of this place", "de": "das haus und der garten mit dem wasser", "fr": "la maison et le jardin avec des fleurs"}
    docs = spark.createDataFrame([(i, t, k) for k, t in words.items() for i in range(5)], "doc_id bigint, text string, lang string")
    pages = [(i, f"http://h{k}.example.{k if k != 'en' else 'com'}/{i}", f'<html lang="{k}"><p>{t}</p><script>x</script>') for k, t in words.items() for i in range(6)]
    pages += [(90, "http://hde.example.de/1", "<html><p>123</p>"), (91, None, None)]
    rows = {(r.page_id, r.host): r for r in langid.fuse(spark.createDataFrame(pages, "page_id bigint, url string, html string"), langid.train_text(docs)).collect()}
    assert len(rows) == 20 and rows[(90, "hde.example.de")].lang == "de" and all(r.lang == r.declared for r in rows.values() if r.declared)


def test_pipeline(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = simhash.written(stage(spark, docs.withColumn("k_text", F.lit(1)) if not seen else docs, sf), name)
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 100 and "k_text" in docs.columns
    assert docs.groupBy("text").count().where("count > 1").count() == 0


def test_chaining_helpers_agree_with_plain_loops():
    """The helpers of op9 that count words and sort matches without building arrays per step."""
    rng = np.random.default_rng(5)
    spec = chaining.ChainSpec()
    for _ in range(200):
        same = rng.random(rng.integers(0, 6)) < 0.6
        assert chaining.leading(same) == next((i for i, s in enumerate(same) if not s), len(same))
        n = int(rng.integers(1, 30))
        order = sorted({(int(d), int(a)) for d, a in rng.integers(0, 120, (n, 2))})
        dt, at = (np.array(c, np.int64) for c in zip(*order))
        alike = rng.random(len(at)) < 0.4
        last, plain = spec.reach - spec.k, set(order)
        for i in np.flatnonzero(alike):
            ahead = i + 1 < len(at) and dt[i + 1] - dt[i] <= last and at[i + 1] - at[i] == dt[i + 1] - dt[i]
            if not ahead:
                plain |= {(int(dt[i] + x), int(at[i] + x)) for x in (last // 2, last)}
        got_at, got_dt = chaining.spread(at, dt, alike, spec)
        assert list(zip(got_dt.tolist(), got_at.tolist())) == sorted(plain)
        blocks = np.array(sorted(set(rng.integers(0, 12, 5).tolist())))
        pos = rng.choice(blocks, 4) * 64 + rng.integers(0, 64, 4)
        size = len(blocks) * 64 - 10
        held = blocks.tolist()
        for p, i, low, high in zip(pos, *chaining.placed(pos, blocks, size, 64)):
            k = held.index(p // 64)
            first = last_ = k
            while first and held[first - 1] == held[first] - 1:
                first -= 1
            while last_ + 1 < len(held) and held[last_ + 1] == held[last_] + 1:
                last_ += 1
            assert (i, low, high) == (k * 64 + p % 64, first * 64, size if last_ == len(held) - 1 else (last_ + 1) * 64)
