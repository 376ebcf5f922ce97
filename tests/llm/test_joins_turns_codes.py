"""Set join, conversation repair and product codes against brute force, with the awkward cases."""
import hashlib
import itertools
import math
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest

from tidegate.llm import codes, jaccard, turns

DOCS = "doc_id bigint, text string, n int, node string, token string, key string"


def _sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    return out


def _classes(rows, percent=85):
    """(doc_id, set size, smallest doc_id reachable) by comparing all pairs."""
    sets, at = _sets([t for _, t in rows]), list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i
    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            at[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return sorted(((d, len(s), low.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=str)


def _joined(spark, rows, spec=jaccard.JoinSpec()):
    df = spark.createDataFrame([(d, t, 1, "x", "y", "z") for d, t in rows], DOCS).repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.link(df, spec).collect()), key=str)


def _near(rng, words, vocabulary, edits):
    out = list(words)
    for _ in range(edits):
        i = rng.randrange(len(out))
        out[i:i + rng.randint(0, 1)] = [rng.choice(vocabulary)]
    return " ".join(out)


def _corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    rows = [(100, None), (101, ""), (102, " \n "), (103, "One"), (104, "one "), (105, "a b c"), (106, "A B\tC"), (107, "a b"), (None, "a b c")]
    for n in (7, 9, 12, 16, 23, 40, 90, 160):
        base = [rng.choice(vocabulary) for _ in range(n + 3)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base).upper()), (3, " ".join(base[::-1]))]
        rows += [(200 + len(rows) + k, _near(rng, base, vocabulary, rng.randint(1, 1 + n // 30))) for k in range(9)]
        rows += [(400 + len(rows), " ".join(base[:-1])), (500 + len(rows), " ".join([*base, "tail"])), (None, " ".join(base))]
    return rows + rows[20:22]


def test_join_equals_all_pairs(spark):
    rows = _corpus()
    want = _classes(rows)
    assert _joined(spark, rows) == want
    assert len({c for _, _, c in want}) < len(rows) - 30                       # there are links to lose


@pytest.mark.parametrize("spec", [jaccard.JoinSpec(check_cost=10 ** 6), jaccard.JoinSpec(most_keys=0), jaccard.JoinSpec(bins=1, small=0, close=0, short=2)])
def test_boundary_and_rounds_change_nothing(spark, spec):
    """All sizes that may enumerate do; none does; every join shuffles, and leaders go on to the end."""
    rows = _corpus(4)
    assert _joined(spark, rows, spec) == _classes(rows)


def test_subsets_are_enough():
    """Sets that share the needed number share an enumerated subset, whatever their sizes."""
    spec = jaccard.JoinSpec()
    for n in range(1, 30):
        for m in range(n, 40):
            similar = [c for c in range(n + 1) if 100 * c >= 85 * (n + m - c)]
            assert (m in spec.partners(n)) == bool(similar) == (n in spec.partners(m))
            if similar:
                assert spec.needed(n, m) == min(similar)


def test_group_of_near_copies_makes_few_pairs(spark):
    """A third of all documents are copies with other edits: pairs grow with the group, not with its square."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocabulary) for _ in range(400)]
    rows = [(i, _near(rng, base, vocabulary, 2)) for i in range(150)] + [(1000 + i, " ".join(rng.choices(vocabulary, k=100))) for i in range(300)]
    counted = []
    real = jaccard.written

    def spy(df, name):
        out = real(df, name)
        if name == "jaccard-pairs":
            counted.append(out.count())
        return out
    jaccard.written = spy
    try:
        got = _joined(spark, rows)
    finally:
        jaccard.written = real
    assert got == _classes(rows) and sum(counted) < 10 * len(rows)


def test_join_of_long_and_no_texts(spark):
    rng = random.Random(2)
    long = [f"x{rng.randrange(10 ** 6)}" for _ in range(30_000)]
    rows = [(1, " ".join(long)), (2, " ".join(long[:27_000])), (3, " ".join(long[:20_000]))]
    assert _joined(spark, rows) == _classes(rows) == [(1, len(_sets([rows[0][1]])[0]), 1), (2, len(_sets([rows[1][1]])[0]), 1), (3, len(_sets([rows[2][1]])[0]), 3)]
    assert _joined(spark, []) == []
    assert _joined(spark, [(1, None), (2, None), (2, "")]) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


# --- conversations

def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def _cheapest(rows):
    """Least (cost, audit) and its rows, by trying all edits: a search over every row and place."""
    seen, faults = set(), []
    for role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    def options(i, said, inserted):
        done = [r for r, _ in said]
        initials = "".join(r[:1] for r in done)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            yield 0, "", said
        if inserted < 2:
            for role in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", initials + role[0]):
                    for c, a, s in options(i, said + [(role, "")], inserted + 1):
                        yield c + 3, "I" + a, s
        if i < len(rows):
            for c, a, s in options(i + 1, said, 0):
                yield c + 4, "D" + a, s
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] == "truncated" else 0
                for letter, role, cost in (("K", rows[i][0], 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if re.fullmatch("s?(ua)*u?", initials + role[:1]) and (role[:1] or letter != "K"):
                        for c, a, s in options(i + 1, said + [(role, rows[i][1])], 0):
                            yield c + cost + more, letter + a, s
    cost, audit, said = min(options(0, [], 0), key=lambda x: x[:2])
    return faults, cost, audit, "\n".join(f"{r}:{t}" for r, t in said)


def _expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in _damage(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        faults, cost, audit, said = _cheapest([r[2:] for r in own])
        turn = [r[1] for r in own if r[1] is not None]
        initials = [r[2][:1] for r in own]
        out.append((conv, max(turn) - min(turn) + 1 - len(set(turn)) if turn else 0, faults.count("blank"), faults.count("duplicate"),
                    faults.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                    hashlib.sha256(said.encode()).hexdigest()))
    return sorted(out, key=str)


def _said(seed=1, n=40):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Ok!\n", "What? ", " \t", "", None, "é.", "Nein, danke"]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(n) for t in rng.sample([None, 0, 1, 2, 3, 5, 9, -4], rng.randint(1, 5))]
    return rows + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), *rows[:3], (7, 2, "user", "Yes.")]


def _repaired(spark, rows, spec=turns.RepairSpec()):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, audit string, pos int").repartition(5)
    cols = ("conv_id", *turns.COUNTS, "audit", "repaired_sha256")
    return sorted((tuple(r[c] for c in cols) for r in turns.repair(turns.damaged(df), spec).select(*cols).collect()), key=str)


def test_repair_equals_trying_all_edits(spark):
    rows = _said()
    assert _repaired(spark, rows) == _expected(rows)
    assert _repaired(spark, []) == []


def test_spilled_conversations_give_the_same(spark):
    rows = _said(2)
    assert _repaired(spark, rows, turns.RepairSpec(keep_rows=1)) == _expected(rows)
    assert _repaired(spark, rows, turns.RepairSpec(keep_chars=0)) == _expected(rows)


def test_giant_conversation(spark):
    """One conversation over many batches: spilled and kept runs agree, and its audit repairs it."""
    rng = random.Random(6)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{t}{rng.choice('.!x')}") for t in range(30_000)] + [(2, 0, "user", "long " * 300_000)]
    got = _repaired(spark, rows, turns.RepairSpec(keep_rows=500))
    assert got == _repaired(spark, rows, turns.RepairSpec(keep_rows=10 ** 6, keep_chars=1 << 40))
    one = next(r for r in got if r[0] == 1)
    assert len(re.sub("I", "", one[7])) == len(_damage([r for r in rows if r[0] == 1]))


# --- product codes

def _coded(spark, rows, spec):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id bigint, embedding array<double>, label int, id string, code string").repartition(3)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in codes.compress(df, spec=spec).collect()), key=str)


def _plain(rows, spec):
    """The same by loops over Python integers."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // spec.parts)
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = []
    for _, v, _ in kept:
        x = []
        for c in v:
            p, q = c.as_integer_ratio()
            x.append(p * spec.scale // q)
        x += [0] * (width * spec.parts - len(x))
        whole.append([x[p * width:(p + 1) * width] for p in range(spec.parts)])
    books = [[whole[e][p] for e in range(min(spec.entries, len(whole)))] for p in range(spec.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(spec.rounds):
        for p in range(spec.parts):
            of = [nearest(p, w[p]) for w in whole]
            for e in range(len(books[p])):
                own = [w[p] for w, f in zip(whole, of) if f == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    fits = lambda n: n if n < 2 ** 63 else None
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], {}
    for (i, _, lab), w in zip(kept, whole):
        of = [nearest(p, w[p]) for p in range(spec.parts)]
        error = fits(sum(far(w[p], books[p][e]) for p, e in enumerate(of)))
        out.append((i, "".join(f"{e:02x}" for e in of), error, lab))
        total.setdefault(lab, []).append(error)
    of_label = {k: fits(sum(v)) if None not in v else None for k, v in total.items()}
    return sorted(((i, c, e, of_label[lab], digest) for i, c, e, lab in out), key=str)


def _vectors(seed, n, dims, size=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, size, dims)], None if i % 5 == 0 else int(i % 3)) for i in rng.permutation(n)]
    return rows + [(3, rows[0][1], 1), (3, [-1.0] * dims, None), (None, [0.5] * dims, 2), (900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * dims, 1),
                   (903, [float("-inf")] * dims, 1), (904, [-0.001] * dims, 0), (905, [0.25] * (dims - 1), 0)]


@pytest.mark.parametrize("dims, size", [(16, 1.0), (11, 0.02), (12, 1e9), (8, 1e30)])
def test_codes_equal_plain_loops(spark, dims, size):
    """Widths that are and are not powers of two; numbers beyond 64 bits; many ties."""
    spec = codes.CodeSpec(parts=4, entries=7)
    rows = _vectors(1, 60, dims, size)
    assert _coded(spark, rows, spec) == _plain(rows, spec)


def test_codes_of_few_and_no_vectors(spark):
    spec = codes.CodeSpec()
    for rows in ([], [(1, None, 1)], [(2, [], 1)], [(1, [0.1, -0.1, 3.0], None), (2, [0.1, -0.1, 3.0], None)]):
        assert _coded(spark, rows, spec) == _plain(rows, spec)


def test_walsh_rows_come_by_sign_changes():
    for width in (1, 2, 3, 8, 13):
        h = codes.walsh(width)
        assert (h @ h.T == len(h) * np.eye(len(h))).all() and list((np.diff(h, axis=1) != 0).sum(axis=1)) == list(range(len(h)))


def test_early_elimination_is_exact():
    rng = np.random.default_rng(4)
    for size in (3, 10 ** 4):
        x, book = rng.integers(-size, size, (500, 5)), rng.integers(-size, size, (40, 5))
        entry, far = codes.nearest_entries(x, replace_rows(book))
        want = ((x[:, None] - replace_rows(book)[None]) ** 2).sum(axis=2)
        assert (entry == want.argmin(axis=1)).all() and (far == want.min(axis=1)).all()


def replace_rows(book):
    """Some entries twice, so that distances tie."""
    return np.concatenate([book, book[::-1]])


def test_spec_is_bounded(spark):
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int"), spec=replace(codes.CodeSpec(), entries=300))


def test_small_link_tables_are_few_files_and_lists_are_shuffled_once(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tidegate import session
    from tidegate.llm import components as parts
    made = []

    def kept(df, name):
        out = session.written(df, name)
        made.append((name, len(out.inputFiles()), df))
        return out
    monkeypatch.setattr(parts, "written", kept)
    monkeypatch.setattr(jaccard, "written", kept)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        links = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        got = {r.node: r.root for r in parts.components(links, "a", "b", 300).collect()}
        assert got == {i: 0 for i in range(301)}
        cores = spark.sparkContext.defaultParallelism
        assert max(files for name, files, _ in made if name == "small-star") <= cores
        rng = random.Random(5)
        words = [f"v{i}" for i in range(80)]
        rows = [(i, _near(rng, words, words, i % 4)) for i in range(12)]
        assert _joined(spark, rows) == _classes(rows)
        lists = next(df for name, _, df in made if name == "jaccard-lists")
        assert lists._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning(token") == 1
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
