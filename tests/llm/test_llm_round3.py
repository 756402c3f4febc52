"""Prefix hashes, cross-tokenizer alignment and spelling variants against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from embedscope.llm import alignment, prefixhash, queries, variants
from embedscope.llm.work import Cuts, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, fingerprint string, n_chars long, word int"
ODD = [(1, "Plain words, here.\nAnd there."), (1, "Plain words, here.\nAnd there."), (None, "no id"), (3, None), (4, ""),
       (5, " \n\t "), (6, "double  space\r\n\ttab don't ~ <|endoftext|> <s> naïve Σας ́x １２ \U0001f600"), (7, "a" * 9000),
       (8, "word " * 20_000), (9, "x\xa0 \ny z"), (10, "▁mark"), (11, "abc"), (12, "abcd"), (13, " lead"),
       (14, "\x00 a"), (15, "日本語 テスト"), (15, "second of its id"), (None, "no id either")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "mine", 1, 1) for i, t in ODD], DOCS)


# ------------------------------------------------------------------ prefix hashes

def test_spans_and_extensions():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ab\U0001f600"), rng.integers(0, 60))) for _ in range(2))
        p, q = prefixhash.Prefixes.of(a), prefixhash.Prefixes.of(b)
        i, j = int(rng.integers(0, len(a) + 1)), int(rng.integers(0, len(b) + 1))
        right = next((k for k in range(len(a)) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k]), 0)
        left = next((k for k in range(len(a) + 1) if k >= i or k >= j or a[i - k - 1] != b[j - k - 1]), 0)
        assert p.extend_right(i, q, j) == right and p.extend_left(i, q, j) == left
        for n in range(min(len(a) - i, len(b) - j) + 1):
            assert p.same_span(i, q, j, n) == (a[i:i + n] == b[j:j + n])
            assert (int(p.span(i, i + n)) == int(q.span(j, j + n))) == (a[i:i + n] == b[j:j + n])
        whole = prefixhash.Prefixes.of(a[:i] + b[:j])
        assert all((x == y).all() for x, y in zip(p.joined(i, q, j).arrays, whole.arrays))


def _bag(t, width=prefixhash.WIDTH):
    return collections.Counter(t[max(0, e - width):e] for e in range(1, len(t) + 1))


def _dice(a, b):
    x, y = _bag(a), _bag(b)
    return 2 * sum((x & y).values()) / max(1, sum(x.values()) + sum(y.values())) if a != b else 1.0


@pytest.mark.parametrize("part_bytes", [1 << 24, 64, 3000])
def test_edited_and_next(spark, odd, part_bytes):
    for docs in (odd, table(spark, SF, "documents")):
        got = prefixhash.edited_and_next(docs, part_bytes).collect()
        rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
        assert len(got) == len(rows)
        hashes = {t: r for t, r in zip(
            [t for _, t in rows], spark.createDataFrame(rows, "i long, t string").select(F.xxhash64("t").alias("h")).collect())}
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]].h, r[1].encode()))
        left = collections.Counter()
        far = []
        for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
            k = len(t) // 4
            e = t[:len(t) - k] + after[:k]
            key = (i, len(t), hashlib.sha256(e.encode()).hexdigest())
            left[key] += 1
            r = next(r for r in got if (r.doc_id, r.n_chars, r.edited_sha256) == key)
            assert (r.fingerprint == r.edited_fingerprint) == (t == e)
            assert r.near_edited == prefixhash.likeness(r.fingerprint, r.edited_fingerprint)
            far += [abs(r.near_edited - _dice(t, e)), abs(r.near_next - _dice(t, after))]
            assert r.prefix_edited >= len(t) - k or r.prefix_edited == len(e)
        assert left == collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got)
        assert np.mean(far) < 0.03 and max(far) < 0.25
    by_text = {r.doc_id: r.fingerprint for r in prefixhash.fingerprints(odd).collect()}
    assert by_text[3] == by_text[4] and by_text[7] != by_text[8]


def test_edited_small_tables(spark, odd):
    assert prefixhash.edited_and_next(odd.where("false")).count() == 0
    one = prefixhash.edited_and_next(odd.where("doc_id = 12")).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(4, 1.0)]
    assert one[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest()


# ------------------------------------------------------------------ alignment

def _plain_alignment(texts):
    """Groups and links by definition, from whole texts encoded by the libraries."""
    a_file = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_file.encode_special_tokens = True
    b_file = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    for b in range(256):
        shown.setdefault(b, chr(256 + sum(c not in shown or ord(shown[c]) > 255 for c in range(b))))
    back = {c: b for b, c in shown.items()}
    out = []
    for t in texts:
        a = a_file.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_file.encode(t) if t else []
        da = [bytes(back[c] for c in a_file.id_to_token(i)) for i in a]
        db = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
              for p in map(b_file.id_to_piece, b)]
        if not t or not b"".join(da) == b"".join(db) == (" " + t).encode():
            out.append((0, 0, [], ""))
            continue
        ends_a = dict(zip(np.cumsum([len(x) for x in da]).tolist(), range(len(da))))
        ends_b = dict(zip(np.cumsum([len(x) for x in db]).tolist(), range(len(db))))
        groups, links, i, j = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            p, q = ends_a[e] + 1, ends_b[e] + 1
            groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
            links.append((a[p - 1], b[q - 1]))
            i, j = p, q
        out.append((len(a), len(b), links, ";".join(groups)))
    return out


@pytest.mark.parametrize("broadcast_rows", [1 << 20, 0])
def test_alignment(spark, odd, broadcast_rows):
    docs = odd.select("doc_id", "text", "word").unionByName(
        table(spark, SF, "documents").select((F.col("doc_id") + 100).alias("doc_id"), "text", F.lit(1).alias("word")))
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    plain = _plain_alignment([t for _, t in texts])
    count = collections.Counter(x for _, _, links, _ in plain for x in links)
    top = collections.defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    want = collections.Counter()
    for (i, _), (n_a, n_b, links, groups) in zip(texts, plain):
        want[(i, n_a, n_b, len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
              hashlib.sha256(groups.encode()).hexdigest() if groups else "")] += 1
    got = alignment.alignment_summary(docs, public_tokenizers.path("byte_bpe_50k.json"),
                                      public_tokenizers.path("piece_bpe_32k.model"), broadcast_rows)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.collect())) == want
    assert any(n[0] == 0 and t for (_, t), n in zip(texts, plain))  # a text that B does not give back
    empty = alignment.alignment_summary(docs.where("false"), public_tokenizers.path("byte_bpe_50k.json"),
                                        public_tokenizers.path("piece_bpe_32k.model"))
    assert empty.count() == 0


def test_alignment_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "MEMO_ENTRIES", 50)
    monkeypatch.setattr(alignment, "PIECE_ENTRIES", 50)
    both = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    texts = [f"some words {i} and {i * i} more\nline {i}" for i in range(200)] + [t for _, t in ODD]
    got = [r for k in range(0, len(texts), 20) for r in both.align(texts[k:k + 20])]
    for g, w in zip(got, _plain_alignment([t or "" for t in texts])):
        assert (g[0], g[1], g[2]) == (w[0], w[1], w[3])
    assert len(both.memo) <= 50 + 200


def test_alignment_learns_a_word_once():
    """A word, alone or before a sign, goes through each library once."""
    both = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    given = []

    class Model:
        def encode(self, texts, num_threads):
            given.extend(texts)
            return model.encode(texts, num_threads=num_threads)

    model, both.b.model = both.b.model, Model()
    texts = ["alpha, beta. gamma", "alpha beta, alpha.\nbeta gamma,"]
    got = both.align(texts) + both.align(texts)
    for g, w in zip(got, _plain_alignment(texts + texts)):
        assert (g[0], g[1], g[2]) == (w[0], w[1], w[3])
    words = [t for t in given if t.isalpha()]
    assert sorted(words) == ["alpha", "beta", "gamma"]


def test_alignment_of_mixed_parts():
    """Words, signs and white space of every kind, in random order."""
    rng = np.random.default_rng(0)
    parts = ["foo", "bar,", "É.", "×,", "3, ", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\r", "don't", "Σας.", "日本",
             "\U00010348", "<|endoftext|>", "~", "(),", "a", ".", ",", "\xa0", "\x0b", "▁", "e\u0301", "ﬁ"]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 14, 1500)]
    texts += ["a\tb c", "a \tb", "a\t", "a\r\nb\r\n", "\tx", "x\n", "x \n", " x", "x\n ", " \n x", "é, ab.\ncd,\n"]
    both = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    got = [r for k in range(0, len(texts), 50) for r in both.align(texts[k:k + 50])]
    for t, g, w in zip(texts, got, _plain_alignment(texts)):
        assert (g[0], g[1], g[2]) == (w[0], w[1], w[3]), t
        links = collections.Counter(a << 32 | b for a, b in w[2])
        assert dict(zip(map(int, g[3]), map(int, g[4]))) == links, t


# ------------------------------------------------------------------ spelling variants

def _plain_vocabulary(rows, least_length, least_count):
    n = collections.Counter()
    for i, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for w in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    return {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}


def _edits(w, letters):
    out = {w[:i] + w[i + 1:] for i in range(len(w))}
    out |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
    out |= {w[:i] + c + w[i + 1:] for i in range(len(w)) for c in letters}
    return out - {w}


def _plain_variants(n):
    letters = {c for w in n for c in w}
    near = {w: [v for v in _edits(w, letters) if v in n] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_vocabulary(spark, odd):
    docs = odd.select("doc_id", "text").unionByName(
        table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = variants.vocabulary(docs).collect()
    want = _plain_vocabulary(rows, 6, 5)
    assert {r.word: r.n for r in got} == want and len(got) == len(want) > 1000
    everything = variants.vocabulary(docs, 1, 1).collect()
    assert {r.word: r.n for r in everything} == _plain_vocabulary(rows, 1, 1)


@pytest.mark.parametrize("block,group", [(1024, 8192), (16, 24), (4, 6)])
def test_variants(spark, block, group):
    rng = np.random.default_rng(block)
    n = {}
    for letters, sizes, count in (("abà", (6, 10), 500), ("ab", (6, 8), 100), ("xyzÿ×", (6, 30), 200)):
        for _ in range(count):
            w = "".join(rng.choice(list(letters), rng.integers(*sizes)))
            n[w] = int(5 * 7 ** rng.integers(0, 5))
    n |= {"prefix" + "".join(rng.choice(list("abcd"), 3)): int(rng.integers(5, 900)) for _ in range(60)}  # a hot group
    n |= {"a" * k: 5 * 5 ** (k % 7) for k in range(6, 40)} | {"q" * 3000: 5, "q" * 3001: 25}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    got = variants.spelling_variants(words, block_words=block, group_words=group)
    rows = got.collect()
    assert len(rows) == len(n)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows} == _plain_variants(n)


def test_variants_empty_and_query(spark):
    empty = spark.createDataFrame([], "word string, n long")
    assert variants.spelling_variants(empty).count() == 0
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.spelling_variants(variants.vocabulary(docs)).count() == 0
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = queries.QUERIES["op13_spelling_variants"](spark, SF).collect()
    assert {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in got} == \
        _plain_variants(_plain_vocabulary(rows, 6, 5))
