import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import crf, crosssplit, mixing, neardup, packing, personal, pieces, sharedspans, tokens
from spanloom.llm.components import connected_components

WORDS = "ward note patient fever cough pain left right knee mild acute chronic seen today plan review stable dose daily rest".split()


def text(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def runs(t, n=3):
    import re

    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def edited(r, t, k):
    w = t.split()
    for _ in range(k):
        i = r.randrange(len(w))
        if r.random() < 0.5:
            w[i] = r.choice(WORDS)
        else:
            del w[i]
    return " ".join(w)


@pytest.fixture(scope="module")
def notes():
    r = random.Random(3)
    rows = []
    for g in range(25):
        base = text(r, r.randint(40, 130))
        for c in range(r.choice([1, 1, 2, 4])):
            split = r.choice(["train", "Train ", "val", "dev", " test"])
            rows.append((f"g{g:02}-{c}", edited(r, base, c * 4) if c else base, split, "x"))
    rows += rows[:5] + [("null", None, "train", None), ("empty", "", "dev", None), (None, rows[0][1], "train", None), ("nosplit", rows[0][1], None, None)]
    rows += [("copy", rows[0][1].upper(), "test", None)]
    return rows


SCHEMA = "guid string, text string, split string, node string"


def test_near_duplicates_against_brute_force(spark, notes):
    docs = {g: runs(t) for g, t, *_ in notes if g and t}
    ok = sorted(g for g, (s, n) in docs.items() if n >= 60)
    part = {g: g for g in ok}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in enumerate(ok):
        for b in ok[:i]:
            x, y = docs[a][0], docs[b][0]
            if len(x & y) / len(x | y) >= 0.6:
                part[root(a)] = root(b)
    want = {(a, b) for a in ok for b in ok if a < b and root(a) == root(b)}
    df = spark.createDataFrame(notes, SCHEMA)
    g = neardup.near_duplicate_groups(df, similarity=0.6, n=3, least_words=60)
    assert {tuple(r) for r in neardup.group_pairs(g).collect()} == want and want
    assert g.count() == len({x[0] for x in notes if x[0]})
    assert neardup.near_duplicate_groups(df.limit(0), similarity=0.6, n=3).count() == 0
    assert neardup.recall_at(0.6) > 0.99


def test_hub_component(spark):
    e = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(500, 540)] + [(7, 7), (3, 0)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    assert all(got[i] == 0 for i in range(200)) and all(got[i] == 500 for i in range(500, 541))
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_split_overlaps_against_brute_force(spark, notes):
    want = set()
    side = lambda s: None if s is None else "train" if s.strip().lower() == "train" else "eval"
    for a, t, s, _ in notes:
        for b, u, v, _ in notes:
            if a and b and t and u and side(s) == "eval" and side(v) == "train" and a != b:
                (x, n), (y, _) = runs(t), runs(u)
                if n >= 60 and len(x & y) / len(x) >= 0.8:
                    want.add((a, b))
    df = spark.createDataFrame(notes, SCHEMA)
    got = crosssplit.split_overlaps(df, contained=0.8, n=3, least_words=60).collect()
    assert {(r.eval_key, r.train_key) for r in got} == want and want and len(got) == len(want)
    assert crosssplit.split_overlaps(df.limit(0), n=3).count() == 0


def brute_edits(a, b):
    d = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        n = [i + 1]
        for j, y in enumerate(b):
            n.append(min(d[j] + (x != y), d[j + 1] + 1, n[j] + 1))
        d = n
    return min(d)


def test_banded_distance():
    r = random.Random(5)
    pairs = [([r.randint(0, 3) for _ in range(r.randint(1, 9))], [r.randint(0, 3) for _ in range(r.randint(0, 12))]) for _ in range(200)]
    arrays = [(np.array(a, np.int64), np.array(b, np.int64)) for a, b in pairs]
    got = crosssplit.banded_distances(arrays, np.zeros(200, np.int64), np.full(200, 30))
    assert got.tolist() == [brute_edits(a, b) for a, b in pairs]
    base = [r.randint(0, 10**6) for _ in range(300)]
    cut = [base[40:90] + [7] + base[91:130], base[100:140]]
    got = crosssplit.banded_distances([(np.array(c, np.int64), np.array(base, np.int64)) for c in cut] + [(np.array([1, 2]), np.array(base))], np.array([40, 103, 250]), np.array([5, 4, 3]))
    assert got.tolist()[:2] == [1, 0] and got[2] == 2


def test_pieces():
    r = random.Random(1)
    for _ in range(60):
        t = "".join(r.choice(["w ", "ww. ", "x\n", "- y\n", "  - yy\n", "HEAD:\n", "## sub\n", "\n\n", "z; ", "q "]) for _ in range(r.randint(0, 400)))
        starts, stops, strong = pieces.gap_strengths(t)
        n, length, step = len(starts), r.randint(6, 60), 0
        step = r.randint(max(1, length // 3), length)
        got = pieces.piece_ranges(strong, length, step)
        assert all(0 < b - a <= length for a, _, b in got)
        if n > length:
            assert got[0][0] == 0 and got[-1][2] == n
            assert all(x[2] == y[1] and y[1] - y[0] == length - step for x, y in zip(got, got[1:]))


def test_pieces_keep_to_the_tree():
    """No piece holds the rest of a cut section and a heading after it; items stay with the items below them."""
    section = lambda name, n: f"# {name}\n" + " ".join(f"{name.lower()}{i}." for i in range(n)) + "\n"
    t = section("A", 25) + section("B", 6) + section("C", 3)
    starts, stops, strong = pieces.gap_strengths(t)
    got = [t[starts[own] : stops[b - 1]] for _, own, b in pieces.piece_ranges(strong, 12, 12)]
    assert got[-1].startswith("# B") and "# C" not in got[-1] or got[-1].startswith("# C")
    assert all("#" not in x[1:] or x.startswith("#") for x in got) and any(x.endswith("a24.") for x in got)
    t = "# T\n## U\nu1 u2.\n## V\nv1 v2.\n# W\nw1 w2.\n"
    starts, stops, strong = pieces.gap_strengths(t)
    assert [t[starts[a] : stops[b - 1]] for a, b in pieces.pack(strong, 0, len(strong), 10)] == ["# T\n## U\nu1 u2.\n## V\nv1 v2.", "# W\nw1 w2."]
    t = "- a a\n  - b b\n  - c c\n- d d\n  - e e\n"
    starts, stops, strong = pieces.gap_strengths(t)
    assert [t[starts[a] : stops[b - 1]] for a, b in pieces.pack(strong, 0, len(strong), 10)] == ["- a a\n  - b b\n  - c c", "- d d\n  - e e"]


def test_oversized_edges(spark):
    cfg = spark.createDataFrame([("k", 3, 2, 1), ("k", 3, 2, 1), ("z", None, 2, 1)], "data_type string, max_seq_length int, sequence_length int, step_size int")
    rows = [("a", "one two three four", " K "), ("a", "one two three four", " K "), ("b", "a. b. c. d.", "k"), ("c", "x y", "k"), ("d", "a b c d", None), ("e", None, "k"), (None, "a b c d", "k"), ("f", "a b c d", "z")]
    df = spark.createDataFrame(rows, "guid string, text string, data_type string")
    p = pieces.split_oversized(df, cfg)
    assert {tuple(r) for r in pieces.oversized_kinds(p).collect()} == {("a", "oversized"), ("a", "unbroken"), ("b", "oversized")}
    assert [r.piece for r in p.where("guid = 'a'").orderBy("piece_no").collect()] == ["one two", "two three", "three four"]


def test_packing(spark):
    r = random.Random(2)
    for cap in (5, 64):
        h = {n: r.randint(0, 9) for n in range(1, cap + 1)}
        plan, packs = packing.plan_packs(h, cap)
        load = [0] * packs
        for n, lo, hi, first in plan:
            for i in range(hi - lo):
                load[first + i] += n
        assert max(load) <= cap and sum(load) == sum(n * c for n, c in h.items())
    sizes = spark.createDataFrame([(i, r.choice([0, 3, 7, 7, 7, 40])) for i in range(300)] + [(1, 9), (None, 4), (5, None)], "doc_id bigint, n_tokens bigint")
    specs = spark.createDataFrame([("s", 16), ("s", 16), ("t", 32), ("u", None), ("v", 0)], "container_name string, capacity_tokens int")
    p = packing.pack_documents(sizes, specs)
    total = sizes.where("doc_id IS NOT NULL").agg(F.sum("n_tokens")).first()[0]
    assert [r[0] for r in p.groupBy("container_name").agg(F.sum("n_tokens").alias("n")).select("n").collect()] == [total, total]
    assert p.groupBy("container_name", "container_no", "capacity_tokens").agg(F.sum("n_tokens").alias("n")).where("n > capacity_tokens").count() == 0
    assert packing.pack_documents(sizes.limit(0), specs).count() == 0
    assert packing.pack_documents(sizes, specs.limit(0)).count() == 0


def test_near_duplicates_shared_template(spark, monkeypatch):
    """Notes with one template below the threshold: their buckets aren't emitted as all pairs."""
    r = random.Random(11)
    own = lambda k: " ".join(f"u{r.randint(0, 10**9)}" for _ in range(k))
    head = " ".join(f"t{i}" for i in range(60))
    verified, tried = neardup._verified, []
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: tried.append(pairs.count()) or verified(pairs, *a))
    n = 600
    g = neardup.near_duplicate_groups(spark.createDataFrame([(str(i), f"{head} {own(50)}") for i in range(n)], "guid string, text string"), similarity=0.6, n=3)
    assert g.select("group_id").distinct().count() == n
    assert sum(tried) < n * neardup.HOT / 2 < n * (n - 1) / 2 / 4


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_hot_buckets_lose_no_link(spark, seed):
    r = random.Random(seed)
    own = lambda k: " ".join(f"u{r.randint(0, 10**9)}" for _ in range(k)).split()
    heads = [own(40) for _ in range(2)]
    notes = []
    for _ in range(70):
        w = heads[r.randrange(2)] + own(r.choice([4, 8, 14, 18, 24, 30, 40]))
        notes.append(w)
        for _ in range(r.choice([0, 0, 1, 2])):
            w = list(w)
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = own(1)[0]
            notes.append(w)
    sets = [runs(" ".join(w))[0] for w in notes]
    root = list(range(len(notes)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(notes)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6:
                root[top(i)] = top(j)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(notes)], "guid int, text string")
    got = {}
    for x in neardup.near_duplicate_groups(df, similarity=0.6, n=3, bands=40, rows=1, hot=2).collect():
        got.setdefault(x.group_id, set()).add(x.guid)
    want = {}
    for i in range(len(notes)):
        want.setdefault(top(i), set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert 10 < len(want) < len(notes)


def test_packing_one_hot_length(spark):
    plan, packs = packing.plan_packs({500: 10000}, 8192)
    assert packs == 625  # 16 to each, fill 0.977; one to each would fill 0.061
    h = {3000: 999, 500: 10000, 40: 9000, 2: 100000}
    plan, packs = packing.plan_packs(h, 8192)
    load, joined = [0] * packs, [0] * packs
    for n, lo, hi, first in plan:
        for i in range(hi - lo):
            load[first + i] += n
    for n, lo, hi, first, width in packing.joined_rounds(plan):
        for i in range(hi - lo):
            joined[first + i % width] += n
    assert load == joined and max(load) <= 8192 and sum(load) == sum(n * c for n, c in h.items())
    assert sum(load) / (packs * 8192) > 0.99
    sizes = spark.range(1005).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1000, 50).otherwise(700).alias("n_tokens"))
    p = packing.pack_documents(sizes, spark.createDataFrame([("s", 1024)], "container_name string, capacity_tokens int"))
    f = packing.fill_report(p).first()
    assert (f.n_pieces, f.n_tokens) == (1005, 53500) and f.fill > 0.95
    assert p.groupBy("container_no").agg(F.sum("n_tokens").alias("n")).where("n > 1024").count() == 0
    assert p.select("doc_id").distinct().count() == 1005


def test_mixing(spark):
    sizes = spark.createDataFrame([(i, "a" if i % 3 else "b", 10) for i in range(6000)] + [(9999, None, 5), (None, "a", 5), (9998, "a", 0)], "doc_id bigint, source string, n_tokens bigint")
    t = spark.createDataFrame([("m", "A ", 0.3, 2), ("m", "b", 0.5, 3), ("m", "none", 0.2, 4), ("n", "b", 1.0, 1), (None, "b", 1.0, 1)], "mix_name string, source string, target_share double, max_repeats int")
    rates = mixing.mix_rates(sizes, t)
    m = mixing.mix_documents(sizes, rates)
    rep = {(r.mix_name, r.source): r for r in mixing.share_report(m, rates).collect()}
    assert abs(rep["m", "a"].actual_share - 0.375) < 0.02 and rep["m", "b"].most_repeats == 3 and rep["m", "none"].n_copies == 0
    assert rep["n", "b"].n_docs == 2000 and rep["n", "b"].most_repeats == 1
    assert m.exceptAll(mixing.mix_documents(sizes, rates)).count() == 0
    assert mixing.mix_documents(sizes.limit(0), rates).count() == 0


def test_token_counts(spark):
    rows = [(1, "Dr. Müller's  note\n\n x² \t½"), (2, ""), (3, None)]
    got = {r.doc_id: r.n_tokens for r in tokens.with_token_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), ["doc_id"]).collect()}
    assert got[1] > 8 and got[2] == got[3] == 0


@pytest.mark.parametrize("suffixes", [1, 20000])
def test_shared_spans_against_brute_force(spark, suffixes):
    r = random.Random(4)
    least = 40
    base = ["".join(r.choice("abcd e🩺") for _ in range(150)) for _ in range(4)]
    docs = []
    for i in range(40):
        t = "".join(r.choice("abcd ") for _ in range(r.randint(0, 80)))
        for _ in range(r.choice([0, 1, 2])):
            b = r.choice(base)
            x = r.randrange(0, 100)
            t += b[x : x + r.randint(20, 90)] + "".join(r.choice("xyz") for _ in range(r.randint(0, 30)))
        docs.append((i, t))
    docs += [(100, docs[3][1] + "k" * 90), (101, docs[3][1] + "k" * 90), (102, "k" * 70), (103, None), (104, ""), (None, docs[3][1]), docs[0]]
    seen = {}
    for k, t in docs:
        if k is not None and t:
            for p in range(len(t) - least + 1):
                seen.setdefault(t[p : p + least], set()).add(k)
    want = set()
    for k, t in docs:
        if k is None or not t:
            continue
        cur = None
        for p in range(len(t) - least + 1):
            if len(seen[t[p : p + least]]) > 1:
                if cur and p <= cur[1]:
                    cur[1] = p + least
                else:
                    if cur:
                        want.add((k, *cur))
                    cur = [p, p + least]
        if cur:
            want.add((k, *cur))
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in docs], "doc_id bigint, text string, start int, h int")
    got = sharedspans.shared_spans(df, least=least, tree_suffixes=suffixes)
    assert {tuple(x) for x in got.collect()} == want and want
    rep = {x.doc_id: x for x in sharedspans.shared_report(df, got).collect()}
    assert rep[104].shared_part == 0 and rep[101].shared_part == 1
    assert sharedspans.shared_spans(df.limit(0), least=least).count() == 0


def test_crf_against_enumeration():
    import itertools

    r = np.random.default_rng(1)
    c = crf.Chain(3, 6)
    c.t, c.s = r.normal(size=(3, 3)).astype(np.float32), r.normal(size=3).astype(np.float32)
    lengths = np.array([3, 1, 4])
    e = r.normal(size=(8, 3)).astype(np.float32)
    y, m, at = c.viterbi(e, lengths), c.marginals(e, lengths)[0], 0
    for n in lengths:
        paths = list(itertools.product(range(3), repeat=int(n)))
        score = np.array([c.s[p[0]] + sum(e[at + i, k] for i, k in enumerate(p)) + sum(c.t[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert tuple(y[at : at + n]) == paths[int(score.argmax())]
        w = np.exp(score - score.max()) / np.exp(score - score.max()).sum()
        for i in range(n):
            assert np.allclose(m[at + i], [sum(w[j] for j, p in enumerate(paths) if p[i] == k) for k in range(3)], atol=1e-4)
        at += n


def test_personal_learned_and_edges(spark):
    r = random.Random(6)
    first, last = ["Anna", "Bert", "Cora", "Dora", "Emil"], ["Moor", "Lund", "Stein", "Wick", "Rell"]
    rows, gold = [], []
    for i in range(160):
        n, p = f"{r.choice(first)} {r.choice(last)}", f"{r.randint(200, 999)}-555-{r.randint(1000, 9999)}"
        t = f"Seen with Dr. {n} today. Call {p} or write to {n[:4].lower()}{i}@mail.test with lot 12-3{i}."
        rows.append((f"n{i:03}", t))
        a, b = t.index(n), t.index(p)
        gold += [(f"n{i:03}", a, a + len(n) + (i % 9 == 0), "DOCTOR"), (f"n{i:03}", b, b + len(p), "phone")]
        m = t.index(" to ") + 4
        gold.append((f"n{i:03}", m, t.index(" with lot"), "EMAIL"))
    notes = spark.createDataFrame(rows + rows[:3] + [("null", None), ("empty", ""), (None, rows[0][1]), ("long", (rows[0][1] + "\n") * 300)], "guid string, text string")
    g = spark.createDataFrame(gold + [("n001", None, 4, "DOCTOR"), ("n001", 9, 2, "DOCTOR"), (None, 1, 2, "X")], "document_id string, start int, stop int, entity_type string")
    model = personal.trained_model(notes, g, {})
    found = {(x.guid, x.start, x.stop, x.entity_type) for x in personal.find_personal(notes, model, {}).collect()}
    want = {(k, a, b - (int(k[1:]) % 9 == 0 and t == "DOCTOR"), personal.GOLD[t.upper()]) for k, a, b, t in gold}
    assert len(found & want) >= 0.97 * len(want)
    assert sum(f[0] == "long" for f in found) >= 850 and not any(f[0] in (None, "null", "empty") for f in found)
    red = {x.guid: x.redacted for x in personal.find_personal(notes, model, {}, placeholder="[{}]").collect()}
    assert red["n005"].startswith("Seen with Dr. [NAME] today. Call [PHONE] or write to [EMAIL] with lot") and red["null"] is None and red["empty"] == ""
    none = personal.trained_model(notes, g.limit(0), {})
    assert personal.find_personal(notes.limit(5), none, {}).count() == 0


@pytest.mark.parametrize(
    "kind,text,span,want",
    [
        ("PHONE", "tel (716) 555-0121 x9.", (5, 18), "(716) 555-0121"),
        ("STREET", "at 8478 Elinwell Rd. Now", (3, 20), "8478 Elinwell Rd."),
        ("NAME", "Seen O'Vale's scan", (5, 13), "O'Vale"),
        ("ID", "ssn xxx-xx-5995;", (4, 10), "xxx-xx-5995"),
        ("EMAIL", "to a_b@c.test.", (5, 8), "a_b@c.test"),
    ],
)
def test_snapped_gold(kind, text, span, want):
    points = personal.pointed_words(["at 1 A Rd. Now", "b 2 Rd.", "in 3 Lane."], [[(3, 10, "STREET")], [(2, 7, "STREET")], [(3, 9, "STREET")]])
    assert points == {"rd"}
    a, b = personal.snapped(kind, *span, text, points)
    assert text[a:b] == want


def test_tokens_and_scores():
    """Tokens and gaps against a regular expression; scores by type tables equal those of the feature rows."""
    import re

    r = np.random.default_rng(3)
    texts = ["Dr. Müller-Öz, tel (0)17_5\u00b2.\n\nNew  line\rx", "", "  ", "a1b2 ½ “q”🦆", "one"]
    chain = crf.Chain(personal.LABELS, personal.BITS)
    chain.w[:] = r.normal(size=chain.w.shape).astype(np.float32)
    lexicon = personal.Lexicon({"müller": "surname"}, chain.w)
    t = personal.Tokens(texts, lexicon)
    want = [[m.span() for m in re.finditer(r"[^\W\d_]+|\d+|_|[^\w\s]", x)] for x in texts]
    assert t.sizes.tolist() == [len(w) for w in want] and [tuple(x) for x in t.at.tolist()] == [s for w in want for s in w]
    assert np.allclose(personal.scores(t, lexicon, chain), chain.scores(personal.features(t, lexicon)), atol=1e-3)
    assert t.gap[t.real].tolist()[:2] == [3, 0] and 2 in t.gap[t.real]


def test_near_duplicates_sketches_rounds_and_bits(spark, monkeypatch):
    """Notes that meet by chance are ruled out before their words are sent; rounds change no result."""
    from spanloom.llm.triples import bits_of, in_bits

    r = random.Random(5)
    own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    head = own(25)
    texts = [head + own(75) for _ in range(150)]
    texts += [[*x[:40], "other", *x[41:]] for x in texts[:10]]
    verified, rounds, tried = neardup._verified, neardup._in_rounds, []
    monkeypatch.setattr(neardup, "_verified", lambda pairs, *a: tried.append(pairs.count()) or verified(pairs, *a))
    monkeypatch.setattr(neardup, "_in_rounds", lambda amount, room, *a: rounds(amount, max(1, amount // 3), *a))
    df = spark.createDataFrame([(f"{i:03}", " ".join(x)) for i, x in enumerate(texts)], "guid string, text string")
    for hot in (64, 4):
        tried.clear()
        g = neardup.near_duplicate_groups(df, similarity=0.6, n=3, hot=hot)
        assert {tuple(x) for x in neardup.group_pairs(g).collect()} == {(f"{i:03}", f"{150 + i}") for i in range(10)}
        assert sum(tried) <= 20
    rows = [0, 1, 7, 8, 32768, 32769, 65536, (1 << 33) + 5]
    t = spark.createDataFrame([(x, "t") for x in [*rows, 2, 9, 32767, (1 << 33) + 6]], "x bigint, y string")
    bits = bits_of(spark.createDataFrame([(x,) for x in rows * 2], "x bigint"), "x")
    assert sorted(x.x for x in in_bits(t, "x", bits).collect()) == rows
    assert sorted(x.x for x in in_bits(t, "x", bits, False).collect()) == [2, 9, 32767, (1 << 33) + 6]
    assert in_bits(t, "x", bits.limit(0), False).count() == 12


def test_pairs_of_several_groups_count_once(spark):
    g = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2"), ("b", "2"), ("c", "2"), ("a", "2"), ("d", "3")], "guid string, group_id string")
    p = neardup.group_pairs(g)
    assert sorted(map(tuple, p.collect())) == [("a", "b"), ("a", "c"), ("b", "c")]
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.lstrip().startswith("Aggregate")  # no shuffle of the pairs
