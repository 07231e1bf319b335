import collections
import hashlib
import random

import numpy as np
from helpers import HARD, LOWER, documents, ink, rows

from corpusmill.llm import exact_dedup as E
from corpusmill.llm import near_dedup as N
from corpusmill.llm.graph import components
from corpusmill.llm.substring_dedup import from_planes, planes, without_repeats


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    for width, step in ((64, 0x0123456789ABCDEF), (10, 1), (7, 1)):
        parts = [rng.integers(0, 100, 400) ** 2 // 99 * np.int64(step) for _ in range(5)]
        parts[0] = np.concatenate([parts[0], np.repeat(parts[0][:1], 3000)])  # a count of several slots
        for bits in (0, 3):
            blocks = collections.defaultdict(list)
            for p in parts:
                for block, *made in E.build_filters(p, bits, width):
                    blocks[block].append(made)
            got = {}
            for block, made in blocks.items():
                values, many = E.merge_filters(made, bits, width)
                assert (np.diff(values) > 0).all()
                got |= {int(x) | (block << (width - bits) if bits else 0): int(n) for x, n in zip(values, many, strict=True)}
            assert got == collections.Counter(int(x) & (1 << 64) - 1 for p in parts for x in p)


def test_runs_stand_at_or_behind_their_quotient():
    values, counts = np.array([0, 1, 2, 9, 10, 31], np.uint64), np.array([1, 20, 1, 1, 2, 1])
    occupied, ends, counter, held = E.slots(values, counts, 3, 2)
    # Quotients 0, 2 and 7; the count of 1 is 19 = 3 + 0 * 4 + 1 * 16, in three slots.
    assert list(held) == [0, 1, 3, 0, 1, 2, 1, 2, 1, 3] and np.unpackbits(np.frombuffer(occupied, np.uint8)).tolist() == [1, 0, 1, 0, 0, 0, 0, 1]
    assert np.flatnonzero(np.unpackbits(np.frombuffer(ends, np.uint8))).tolist() == [5, 8, 9] and np.flatnonzero(np.unpackbits(np.frombuffer(counter, np.uint8))).tolist() == [2, 3, 4, 8]
    back = E.read_slots(occupied, ends, counter, held, 3, 2)
    assert back[0].tolist() == values.tolist() and back[1].tolist() == counts.tolist()


def test_exact_duplicates(spark):
    texts, ids = [*HARD, "one"], [*range(len(HARD)), 3]
    want = []
    norm = [(t or "").translate(LOWER) for t in texts]
    for i, t in zip(ids, norm, strict=True):
        own = [j for j, u in zip(ids, norm, strict=True) if u == t]
        want.append((i, max(own), len(own), i == max(own), hashlib.sha256(t.encode()).hexdigest()))
    got = rows(E.exact_duplicates(documents(spark, texts, ids)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == sorted(want)
    assert rows(E.exact_duplicates(documents(spark, ["a"]).limit(0))) == []
    nulls = documents(spark, ["a", "b", "a"], [None, None, 5])
    assert rows(E.exact_duplicates(nulls), "doc_id", "keep_id", "group_size", "kept") == [(None, None, 1, True), (None, 5, 2, False), (5, 5, 2, True)]


def test_hot_group(spark):
    texts = ["same"] * 3000 + [f"text {i}" for i in range(3000)]
    got = E.exact_duplicates(documents(spark, texts))
    assert got.where("kept").count() == 3001 and got.where("group_size = 3000 AND keep_id = 2999").count() == 3000


def components_of(sets):
    link = {i: i for i in sets}

    def find(i):
        while link[i] != i:
            i = link[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                link[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    base = [[f"w{rng.randrange(4000)}" for _ in range(rng.randrange(20, 300))] for _ in range(12)]
    texts = list(HARD)
    for _ in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in words))
    texts += ["".join(f"hot {i} word " for i in range(40)) + f"tail {k % 7}" for k in range(200)]
    sets = {}
    for i, t in enumerate(texts):
        w = ink((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    own = components_of(sets)
    got = rows(N.near_duplicates(documents(spark, texts)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == [(i, len(sets[i]), own[i], own[i] == i) for i in sets]


def test_near_duplicates_of_little(spark):
    assert rows(N.near_duplicates(documents(spark, ["a"]).limit(0))) == []
    got = rows(N.near_duplicates(documents(spark, ["a b", "a b", "a b", None], [3, 3, None, None])), "doc_id", "component_id", "kept")
    assert got == [(None, None, True), (None, None, True), (3, 3, True), (3, 3, True)]


def test_pairs_across_partitions():
    rows_ = [(0, 0, 5, 1), (0, -1, 9, 2), (1, 0, 9, 3), (1, -1, 9, 4), (2, 0, 9, 6), (2, -1, 8, 7)]
    pairs, crowded = N.border_pairs(rows_)
    assert {(2, 3), (4, 6), (2, 6)} <= pairs and crowded == set() and N.border_pairs([]) == (set(), set())
    wide = [(p, at, 9, 10 * p + k) for p in range(2) for k, at in ((1, 0), (2, 1), (1, -2), (2, -1))]
    assert N.border_pairs(wide) == ({(a, b) for a in (1, 2) for b in (11, 12)}, {1, 2, 11, 12})


def test_a_crowded_region_loses_no_link(spark):
    """A large group, and texts that are linked with a single one of its members."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for i in range(120):  # texts near the base, each with a tail of its own
        texts.append(base + [f"m{i}_{k}" for k in range(12)])
    for i in range(0, 120, 10):  # less of the base, and the tail of one
        texts.append(base[:92] + [f"m{i}_{k}" for k in range(12)] + [f"z{i}_{k}" for k in range(14)])
    order = rng.sample(range(len(texts)), len(texts))
    texts = [" ".join(texts[i]) for i in order]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(t.split() for t in texts)}
    own = components_of(sets)
    assert rows(N.near_duplicates(documents(spark, texts)), "doc_id", "component_id") == sorted(own.items())


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100)], "u long, v long")
    got = dict(rows(components(edges)))
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 100: 90}


def test_repeats_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.choice("abcdefgh") for _ in range(300)]
    texts = [*HARD, "a " * 100, "a " * 36 + "b " * 3, "x " + "a " * 34, "p q " * 60, "q p " * 20, "p q " * 60]
    for _ in range(40):
        i = rng.randrange(250)
        texts.append(" ".join([rng.choice("abcdefghij") for _ in range(rng.randrange(20))] + base[i : i + rng.randrange(30, 60)] + [rng.choice("abc") for _ in range(rng.randrange(20))]))
    split = [ink(t) for t in texts]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in split for i in range(len(w) - 34))
    want = []
    for i, w in enumerate(split):
        gone = {p for s in range(len(w) - 34) if seen[tuple(w[s : s + 35])] > 1 for p in range(s, s + 35)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    assert rows(without_repeats(documents(spark, texts)), "doc_id", "n_words", "n_removed", "text") == want
    assert rows(without_repeats(documents(spark, ["a"]).limit(0))) == []
    twice = " ".join(map(str, range(50)))
    assert rows(without_repeats(documents(spark, [twice, twice, None], [1, 1, None])), "doc_id", "n_removed") == [(None, 0), (1, 50), (1, 50)]


def test_planes():
    x = np.array([1, 1 << 40, 7], np.uint64)
    assert (from_planes(planes(x), np.uint64) == x).all() and len(from_planes(planes(x[:0]), np.uint64)) == 0


def test_candidates_have_the_longest_common_prefixes():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 2, (400, N.DEPTH))
    sig = sig[np.lexsort(sig.T[::-1])]
    head = (sig[:, : N.MIN_DEPTH] @ (1 << np.arange(N.MIN_DEPTH))).astype(np.int64)
    rest = np.zeros(len(sig), np.int64)
    for k in range(N.MIN_DEPTH, N.DEPTH):
        rest = rest << 16 | sig[:, k]

    def prefix(i, j):
        same = sig[i] == sig[j]
        n = int(np.argmin(same)) if not same.all() else N.DEPTH
        return n if n >= N.MIN_DEPTH else 0

    shared = N.common_prefixes(head, rest)
    assert shared.tolist() == [prefix(i, i + 1) for i in range(len(sig) - 1)]
    want = set()
    for i in range(len(sig)):
        near = [j for j in range(max(0, i - N.REACH), min(len(sig), i + N.REACH + 1)) if j != i]
        depth = max(N.MIN_DEPTH, sorted([prefix(i, j) for j in near] + [0] * (2 * N.REACH - len(near)))[-N.REACH])
        want |= {(min(i, j), max(i, j)) for j in near if prefix(i, j) >= depth}
    got = {(int(i), int(i) + d) for d, found in N.candidates(shared) for i in found}
    assert got == want and N.candidates(np.zeros(0, np.int64))[0][1].tolist() == []


def test_sets_with_the_same_hash_are_told_apart(spark):
    rng = random.Random(12)
    texts = []
    for k in range(30):
        own = [f"w{rng.randrange(500)}" for _ in range(60)]
        texts += [" ".join(own), " ".join(own), " ".join([*own, f"t{k}"])]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(t.split() for t in texts)}
    assert rows(N.near_duplicates(documents(spark, texts), node_bits=3), "doc_id", "component_id") == sorted(components_of(sets).items())
