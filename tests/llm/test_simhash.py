import random

import numpy as np
import xxhash

from corpusloom.llm import components, simhash


def groups(n, pairs):
    up = list(range(n))

    def top(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(a) for a in range(n)]


def near(prints):
    x = prints[:, None] ^ prints[None, :]
    return np.argwhere(np.unpackbits(x.view("u1").reshape(len(prints), len(prints), 8), axis=2).sum(2) <= simhash.TAU).tolist()


def plain(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_documents_against_all_pairs(spark, docs):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = np.array([plain(t) for _, t in rows], "u8")
    want = groups(len(rows), near(prints))
    for k, (i, _) in enumerate(rows):
        assert got[i].fingerprint == f"{int(prints[k]):016x}"
        assert got[i].component_id == rows[want[k]][0]


def test_links_connect_all_near(spark):
    """Clusters that fill buckets far beyond BUCKET, chains at two bits, and scattered fingerprints."""
    rng = random.Random(11)
    prints = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        centre = rng.getrandbits(64)
        spots = rng.sample(range(64), 12)
        prints |= {centre ^ sum(1 << s for s in rng.sample(spots, rng.randint(0, 6))) for _ in range(150)}
    walk = rng.getrandbits(64)
    for _ in range(40):
        walk ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        prints.add(walk)
    x = np.array(sorted(prints), "u8")
    signed = x.view("i8").tolist()
    edges = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    place = {v: k for k, v in enumerate(signed)}
    links = [(place[a], place[b]) for a, b in edges]
    pairs = near(x)
    assert groups(len(x), links) == groups(len(x), pairs)
    tree = groups(len(x), pairs)
    assert all(tree[a] == tree[b] for a, b in links)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(k, k + 1) for k in range(500, 560)] + [(600, k) for k in range(601, 700)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = groups(700, pairs)
    assert all(got[a] == want[a] for p in pairs for a in p if p[0] != p[1])


def test_full_buckets_grow_their_keys(spark):
    """Hundreds of fingerprints that share two segments, some within two bits: links equal brute force, and no
    neighbours are listed; thousands around one centre do need them, and stay whole."""
    rng = random.Random(12)
    low = rng.getrandbits(26)
    spread = {low | rng.getrandbits(38) << 26 for _ in range(600)}
    spread |= {x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for x in list(spread)[:150]}
    dense = {rng.getrandbits(64)}
    centre = next(iter(dense))
    dense |= {centre ^ (1 << a) ^ (1 << b) for a in range(45) for b in range(a)}
    for prints, listed in ((spread, False), (dense, True)):
        signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
        shares = {}
        got = simhash.links(spark.createDataFrame(signed, "fp long"), shares).collect()
        bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
        assert all(bits(r.u, r.v) <= 4 for r in got) and ("neighbours" in shares) == listed and "keys 1" in shares
        root = {x: x for (x,) in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        def merged(pairs):
            root.update({x: x for x in root})
            for a, b in pairs:
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            return {x: find(x) for x in root}

        mine = merged((r.u, r.v) for r in got)
        flat = [x for (x,) in signed]
        assert mine == merged((a, b) for k, a in enumerate(flat) for b in flat[k + 1 :] if bits(a, b) <= 2)


def test_one_of_each_of_string_ids(spark):
    """Ids that are strings; of rows equal in id and text the same one stays however they lie."""
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [("b", text, "de"), ("a", text, "fr"), ("a", text, "en"), ("c", "something else entirely and not alike at all", "en"), (None, text, "x"), (None, None, "y")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    got = [sorted(map(tuple, simhash.one_of_each(df.repartition(n)).collect()), key=repr) for n in (1, 3)]
    assert got[0] == got[1] and {r[0] for r in got[0]} == {"a", "c", None} and len(got[0]) == 3
