import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillspark.llm import neardup


def texts(n, seed=0, size=120):
    rng = np.random.default_rng(seed)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(4000)])
    return [list(rng.choice(vocab, size)) for _ in range(n)], vocab, rng


def brute(rows, bits):
    """Smallest id of each group: equal texts and pairs of fingerprints within ``bits``."""
    ids = sorted({i for i, t in rows if i is not None and t is not None})
    own = [(i, t) for i, t in rows if i is not None and t is not None]
    prints, n = neardup.fingerprints(pa.array([t for _, t in own], pa.string()))
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(own)):
        for b in range(a):
            if own[a][1] == own[b][1] or (n[a] and n[b] and (prints[a] == prints[b]).sum() >= neardup.LEAST and np.bitwise_count(prints[a] ^ prints[b]).sum() <= bits):
                x, y = find(own[a][0]), find(own[b][0])
                root[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in ids if find(i) != i}


def test_against_brute_force(spark):
    base, vocab, rng = texts(40)
    rows = [(k, " ".join(t)) for k, t in enumerate(base)]
    for k, t in enumerate(base[:30]):  # copies with up to 6 % of the words edited
        for c in range(3):
            e = list(t)
            for p in rng.choice(len(e), rng.integers(0, 8), replace=False):
                e[p] = rng.choice(vocab)
            rows.append((1000 + 10 * k + c, " ".join(e)))
    rows += [(5000, ""), (5001, ""), (5002, "..."), (5003, None), (None, rows[0][1]), (3, rows[3][1]), (6000, rows[5][1]), (7000, "word " * 60_000), (7001, "word " * 60_000)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, node int, print string")
    got = {(r["doc_id"], r["duplicate_of"]) for r in neardup.near_duplicates(df).collect()}
    want = brute(rows, neardup.BITS)
    assert len(got & want) >= 0.9 * len(want)
    assert all(a > b for a, b in got)
    assert {(5001, 5000), (6000, 5), (7001, 7000)} <= got
    # nothing is linked that brute force doesn't link
    group = dict(want)
    assert all(group.get(a, a) == group.get(b, b) for a, b in got)


def test_clean_documents_stay_and_columns_too(spark):
    base, _, _ = texts(60, 4)
    rows = [(k, " ".join(t), None if k % 2 else "s") for k, t in enumerate(base)] + [(0, " ".join(base[0]), "s"), (None, None, "s"), (99, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumns({c: F.lit("x") for c in ("_id", "_a", "_b", "a", "b", "row", "node", "root", "n", "count", "a.b")})
    out = neardup.drop_duplicates_near(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect() if r["doc_id"] is not None) == [*range(60), 99]
    assert out.where("doc_id IS NULL").count() == 1
    assert neardup.drop_duplicates_near(df.where("false")).count() == 0
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_link_is_a_spanning_forest():
    rng = np.random.default_rng(1)
    seed = rng.integers(0, 256, neardup.BYTES).astype(np.uint8)
    f = np.stack([seed] * 500)
    for k in range(500):
        f[k, rng.integers(neardup.BYTES)] ^= 1
    a, b = neardup.link(np.arange(500), f, neardup.BITS)
    assert len(a) == 499


def test_recall_of_candidates():
    """Runs of positions find at least 0.9 of the pairs at any distance within the bound."""
    rng = np.random.default_rng(2)
    for bits in (40, 64, 80, neardup.BITS):
        hit = 0
        for _ in range(400):
            flip = np.zeros(768, np.uint8)
            flip[rng.choice(768, bits, replace=False)] = 1
            same = np.packbits(flip) == 0
            hit += any(same[list(run)].all() for run in neardup.design(1))
        assert hit >= 0.9 * 400


def test_recall_of_copies_by_text():
    """Copies whose word-3-shingles overlap by half or more are found, whatever distance their edits give."""
    hit, total = {}, {}
    for size in (60, 120, 300):
        base, vocab, rng = texts(150, 6, size)
        a, b = [], []
        for t in base:
            e = list(t)
            for p in rng.choice(size, round(0.055 * size), replace=False):
                e[p] = rng.choice(vocab)
            x, y = ({tuple(w[k : k + 3]) for k in range(size - 2)} for w in (t, e))
            if len(x & y) >= 0.5 * len(x | y):
                a.append(" ".join(t))
                b.append(" ".join(e))
        f, g = (neardup.fingerprints(pa.array(t, pa.string()))[0] for t in (a, b))
        met = (f == g)[:, neardup.design(1)].all(2).any(1)
        hit[size], total[size] = (met & (np.bitwise_count(f ^ g).sum(1) <= neardup.BITS)).sum(), len(a)
    assert min(total.values()) > 100
    assert all(hit[s] >= 0.9 * total[s] for s in total) and sum(hit.values()) >= 0.95 * sum(total.values()), (hit, total)


def test_a_doc_id_with_two_texts_loses_neither(spark):
    (x, y), _, _ = texts(2, 7)
    a, b = " ".join(x), " ".join(y)
    df = spark.createDataFrame([(3, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (3, a, 4)], "doc_id long, text string, a int")
    assert {(r["doc_id"], r["duplicate_of"]) for r in neardup.near_duplicates(df).collect()} == {(5, 3)}
    assert sorted((r["doc_id"], r["text"]) for r in neardup.drop_duplicates_near(df).collect()) == [(3, a), (5, b)]


def test_long_lists_are_cut_without_loss(spark):
    """Chunks, seeds and tiles link what one task would have linked, whatever the seeds are."""
    base, vocab, rng = texts(3, 8)
    rows = []
    for t in base:
        for _ in range(40):
            e = list(t)
            for p in rng.choice(len(e), 5, replace=False):
                e[p] = rng.choice(vocab)
            rows.append((len(rows), " ".join(e)))
    rng.shuffle(rows)
    own = neardup.nodes(spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string"))
    runs = np.zeros((1, 0), np.int64)  # one list holds all
    groups = []
    for limit in (1000, 7):
        g = neardup.components(neardup.edges(own, runs=runs, limit=limit)).join(own.select(own.node.alias("id"), own.id.alias("doc")), "id").collect()
        first = {}
        for r in g:
            first[r["root"]] = min(first.get(r["root"], 10**9), r["doc"])
        groups.append({r["doc"]: first[r["root"]] for r in g})
    assert groups[0] == groups[1] and len(groups[0]) == 120 and len(set(groups[0].values())) == 3


def test_cutting_lists():
    rng = np.random.default_rng(3)
    key = np.sort(rng.integers(0, 30, 400)) ** 2
    key[100:260] = key[100]
    node = np.arange(400)
    for step in (1, 7, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + step]), pa.array(node[i : i + step]), pa.array(np.zeros(len(node[i : i + step]), np.int64))], names=["key", "node", "sketch"]) for i in range(0, 400, step)]
        seen = {}
        for b in neardup._cut(iter(batches), 2, 16):
            for k, c, ids in zip(*(b.column(i).to_pylist() for i in range(3))):
                assert len(ids) <= 16 + neardup.SEEDS
                own = ids if c <= 0 else ids[neardup.SEEDS :]
                assert c <= 0 or ids[: neardup.SEEDS] == seen[k][: neardup.SEEDS]
                seen.setdefault(k, []).extend(own)
        want = {int(k): node[key == k].tolist() for k in np.unique(key) if (key == k).sum() >= 2}
        assert seen == want


def test_wider_keys_keep_the_recall():
    for n in (10, 10**7, 10**9):
        runs = neardup.design(n)
        met = (1 - neardup.BITS / (8 * neardup.BYTES)) ** (8 * runs.shape[1])
        assert 1 - (1 - met) ** len(runs) >= neardup.RECALL and all(len(set(r)) == runs.shape[1] for r in runs.tolist())


def test_members_without_a_likeness_go():
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 62), 1 << 62, 9)
    sketch = np.array([x[0], x[1], x[2], x[3], x[2] ^ 1, *x[4:8], x[4] ^ 3])
    assert neardup._alike(sketch, np.array([2, 3, 5])).tolist() == [False] * 2 + [True, False, True] + [True, False, False, False, True]
    assert neardup._alike(np.concatenate([x, x])[:17], np.array([17])).all()


def test_no_pair_within_the_bound_is_left_out(spark):
    """Copies edited until they are about at the bound: runs of three positions alone miss some of them."""
    base, vocab, rng = texts(300, 9)
    rows = [(k, " ".join(t)) for k, t in enumerate(base)]
    for k, t in enumerate(base):
        e = list(t)
        for p in rng.choice(len(e), 8, replace=False):
            e[p] = rng.choice(vocab)
        rows.append((1000 + k, " ".join(e)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows, neardup.BITS)
    assert len(want) > 100
    assert {(r["doc_id"], r["duplicate_of"]) for r in neardup.near_duplicates(df).collect()} == want


def test_second_pass_finds_the_rest_in_slabs(spark):
    """Pairs that share LEAST bytes and not one more, BITS bits apart, with no run of ``design`` in common; groups of many members among them."""
    rng = np.random.default_rng(10)
    f = rng.integers(0, 256, (400, neardup.BYTES)).astype(np.uint8)
    f[50:100] = f[50]  # one group
    f[np.arange(51, 100), rng.integers(0, 96, 49)] ^= 1
    for k in range(100):
        while True:
            at = rng.permutation(neardup.BYTES)[: neardup.BYTES - neardup.LEAST]
            f[200 + k] = f[k]
            f[200 + k, at] ^= 1
            two = rng.choice(at, neardup.BITS - len(at), replace=False)
            f[200 + k, two] ^= 2
            same = f[200 + k] == f[k]
            if not same[neardup.design(1)].all(1).any():
                break
    d = [(f == g).sum(1) >= neardup.LEAST for g in f] & np.array([np.bitwise_count(f ^ g).sum(1) <= neardup.BITS for g in f])
    parts = f.view(np.int64)
    rows = [(k, True, *map(int, parts[k])) for k in range(len(f))]
    own = spark.createDataFrame(rows, "node long, wordy boolean, " + ", ".join(f"{p} long" for p in neardup._PARTS))
    groups = spark.createDataFrame([(k, 50) for k in range(50, 100)], "id long, root long")
    root = np.arange(400)
    root[50:100] = 50
    want = {tuple(sorted((int(root[a]), int(root[b])))) for a, b in zip(*np.nonzero(d)) if root[a] != root[b]}
    assert len(want) >= 100
    for slab in (1 << 18, 90):
        assert {(r["a"], r["b"]) for r in neardup.missed(own, groups, slab=slab).collect()} == want
    all_in_one = spark.createDataFrame([(k, 0) for k in range(400)], "id long, root long")
    assert neardup.missed(own, all_in_one) is None
    assert neardup.missed(own.where("false"), groups) is None


def test_any_positions_of_the_minimum_hold_two_of_a_class():
    rng = np.random.default_rng(11)
    pairs = neardup.classes()
    for _ in range(200):
        same = np.zeros(neardup.BYTES, bool)
        same[rng.choice(neardup.BYTES, neardup.LEAST, replace=False)] = True
        assert same[pairs].all(1).any()
