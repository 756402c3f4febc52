"""Exact, near and embedding dedup against brute force on small fixtures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedscope.llm import blocknames, components, minhash, rotcodes
from embedscope.llm.work import Cuts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, kept int"


def odd_rows():
    """Nulls, empty and blank texts, a long text, ties, repeated rows, clashing columns."""
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (4, ""), (5, "  \n"),
             (6, long), (7, long), (8, long + " x"), (9, "A B C d e f"), (10, "one two"), (11, "one two"),
             (None, "a b c d e f"), (None, None), (12, "É a b c"), (13, "é a b c"), (14, "x" * 4096), (15, "x" * 4097),
             (16, "y" * 8192 + "z"), (17, "y" * 8192 + "z"), (18, "y" * 8192 + "w")]
    return [(i, t, "en", "s", None, "n", 1) for i, t in texts]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, weak):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    kw = {"fingerprint": lambda c: F.pmod(F.xxhash64(c), F.lit(3)), "block_bytes": 64} if weak else {}
    got = blocknames.exact_groups(docs, [], Cuts(spark), **kw).collect()
    want = {}
    for r in odd_rows():
        want.setdefault(r[1] or "", []).append(r[0])
    import hashlib
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in want.items()}
    assert len(got) == len(odd_rows())
    seen = {}
    for r in got:
        ids = by_hash[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        seen[r.text_sha256] = seen.get(r.text_sha256, 0) + r.kept
    assert set(seen.values()) == {1}  # one row stays, also of rows that repeat the id


def test_exact_empty_and_stage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert blocknames.exact_groups(empty, [], Cuts(spark)).count() == 0
    assert blocknames.drop_exact_copies(empty).count() == 0
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    out = blocknames.drop_exact_copies(docs)
    assert out.columns == docs.columns
    assert out.count() == len({(r[1] or "") for r in odd_rows()})


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, size=(90, 2))] + [(200, 200)]
    edges += [(1000, k) for k in range(1001, 1300)] + [(k, k + 1) for k in range(2000, 2040)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.components(
        spark.createDataFrame(edges, "a long, b long"), Cuts(spark)).collect()}
    assert got == {x: root(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long"), Cuts(spark)).count() == 0


def brute(sets, percent):
    n = len(sets)
    comp = list(range(n))
    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    return comp


def shingles(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: 32 for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


@pytest.mark.parametrize("blocks", [256, 4])
def test_near_groups_brute_force(spark, monkeypatch, blocks):
    """Also a star: copies that are near the original but not near each other."""
    monkeypatch.setattr(minhash, "BLOCK_DOCS", blocks)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in rng.integers(0, 500, 200)]
    texts = []
    for k in range(40):
        t = list(base)
        for p in rng.integers(0, 200, 3 + k % 4):
            t[p] = f"v{rng.integers(0, 9999)}"
        texts.append(" ".join(t))
    texts += [" ".join(base), " ".join(base).upper()]
    texts += [" ".join(f"z{i}" for i in rng.integers(0, 400, 60)) for _ in range(20)]
    texts += ["", None, "  ", "one", "one", "One", "two words", "two  words"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_groups(
        docs, [], Cuts(spark), words=3, percent=85, bands=36, rows=7).collect()}
    sets = [shingles(t, 3) for t in texts]
    comp = brute(sets, 85)
    assert len(set(comp[:42])) > 1 or blocks == 256
    assert got == {i: (len(s), comp[i], comp[i] == i) for i, s in enumerate(sets)}


def test_near_odd_rows_and_stage(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    got = minhash.near_groups(docs, [], Cuts(spark)).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got}
    assert by[9].component_id == 1 and by[8].component_id == 6 and by[12].component_id == 12
    assert all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_groups(empty, [], Cuts(spark)).count() == 0
    out = minhash.drop_near_copies(docs)
    assert out.columns == docs.columns and out.where("doc_id = 7").count() == 0


def test_superminhash_estimates():
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for common in (0, 300, 700, 1000):
        a, b = np.unique(pool[:1000]), np.unique(pool[1000 - common:2000 - common])
        s = minhash.signatures([a, b, a[:1], a[:3]], 256)
        true = common / (2000 - common)
        assert abs((s[0] == s[1]).mean() - true) < 0.09
        for row in s:  # every slot is filled, by ranks below the number of slots
            assert (row >> np.uint64(53)).max() < 256
        # one element alone visits each slot once: all ranks occur
        assert sorted((s[2] >> np.uint64(53)).tolist()) == list(range(256))


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1):
        centres = rng.standard_normal((30, 16))
        for c in centres:
            for _ in range(rng.integers(1, 5)):
                rows.append((n, (c + rng.normal(0, 0.06, 16)).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, None, 0), (n + 3, [0.0] * 16, 0),
             (n + 4, [float("nan")] * 16, 0), (n + 5, rows[0][1], None), (n + 6, [1.0, None], 0), (n + 7, [], 1),
             (n + 8, [2 * x for x in rows[0][1]], 0), (n + 9, [1.0, 2.0], 0), (n + 10, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    ok = [i for i, (_, v, lab) in enumerate(rows) if v and lab is not None and None not in v
          and np.isfinite(v).all() and any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and rows[i][2] == rows[j][2] and len(a) == len(b) \
                    and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                links[i].add(j)
    comp = list(range(len(rows)))
    for _ in range(50):
        comp = [min([comp[i], *[comp[j] for j in links[i]]]) for i in range(len(rows))]
    want = {i: (len(links[i]), comp[i], comp[i] == i) for i in range(len(rows))}
    for block in (1024, 2):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept)
               for r in rotcodes.near_vectors(df, Cuts(spark), block=block).collect()}
        assert got == want
    assert rotcodes.near_vectors(df.limit(0), Cuts(spark)).count() == 0


def test_code_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 64))
    turned, codes, f = rotcodes.encoded(x)
    met = codes @ turned.T
    true = turned @ turned.T
    assert (true <= rotcodes.upper_bounds(f, met, 64) + 1e-9).all()
    err = (met / f[:, None] - true)[np.triu_indices(300, 1)]
    assert abs(err.mean()) < 0.01  # unbiased


def _with_repeated_ids(n, rng):
    """Ids of which many occur with several contents."""
    return rng.integers(0, n // 2, n).tolist()


def test_near_groups_repeated_ids(spark):
    rng = np.random.default_rng(11)
    texts = []
    for k in range(25):
        base = [f"w{i}" for i in rng.integers(0, 300, 60)]
        for _ in range(rng.integers(1, 4)):
            t = list(base)
            t[int(rng.integers(0, 60))] = f"v{rng.integers(0, 99)}"
            texts.append(" ".join(t))
    ids = _with_repeated_ids(len(texts), rng)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    comp = brute([shingles(t, 5) for t in texts], 80)
    least = {c: min(i for i, d in zip(ids, comp) if d == c) for c in set(comp)}
    want = sorted((i, least[c]) for i, c in zip(ids, comp))
    assert sorted((r.doc_id, r.component_id) for r in minhash.near_groups(docs, [], Cuts(spark)).collect()) == want


def test_near_vectors_repeated_ids(spark):
    rng = np.random.default_rng(12)
    x = np.repeat(rng.standard_normal((20, 16)), 3, axis=0) + rng.normal(0, 0.03, (60, 16))
    ids = _with_repeated_ids(60, rng)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    comp = brute([{i for i in range(60) if near[i, j]} or {j} for j in range(60)], 1)
    least = {c: min(i for i, d in zip(ids, comp) if d == c) for c in set(comp)}
    want = sorted((i, int(near[k].sum()) - 1, least[c]) for k, (i, c) in enumerate(zip(ids, comp)))
    got = rotcodes.near_vectors(df, Cuts(spark)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


def test_column_named_like_file_knowledge(spark, tmp_path):
    docs = spark.createDataFrame(odd_rows(), SCHEMA).withColumn(
        "_metadata", F.struct(F.lit("mine").alias("file_path"), F.lit(1).alias("row_index")))
    docs.write.parquet(str(tmp_path / "t"))
    for df in (docs, spark.read.parquet(str(tmp_path / "t"))):
        out = blocknames.drop_exact_copies(df)
        assert out.columns == docs.columns and out.count() == len({(r[1] or "") for r in odd_rows()})
        assert minhash.drop_near_copies(df).columns == docs.columns
