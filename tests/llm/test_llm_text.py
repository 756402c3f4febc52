"""Classifiers, tokens, packing, mixing, urls, quotations and the pipeline."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from embedscope.llm import (encode, linktrust, mixing, packing, quality, queries, quotes, tokenfiles, toxicity)
from embedscope.llm.work import Cuts, shared_dir, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, "Plain words, here.\nAnd there.", "en", "a", 29), (1, "Plain words, here.\nAnd there.", "en", "a", 29),
       (None, "no id", "en", None, 5), (3, None, None, "b", None), (4, "", "en", "b", 0), (5, " \n\t ", "en", "c", 4),
       (6, "double  space\r\n\ttab don't ~ <|endoftext|> naïve Σας ́x １２", "en", "c", 9), (7, "a" * 9000, "en", "b", 9000),
       (8, "word " * 20_000, "en", "a", 100_000), (9, "x\xa0 \ny z", "en", None, 1)]
FILES = (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True))


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("mine")).withColumn("size", F.lit(1))


@pytest.mark.parametrize("name,keeps_space", FILES)
def test_encoder_equals_library(spark, name, keeps_space):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    texts = [r.text for r in table(spark, SF, "documents").select("text").collect()] + [r[1] for r in ODD]
    texts += [" lead", "trail ", "\n", "x \n y", "a, b. c.. ä, Ö. µ ª º İ ß ÿ Ÿ é.x", "\n\n a", "~ a~b ~~", "it's we'll"]
    enc = encode.Encoder(path, keeps_space)
    for t, packed in zip(texts, enc.packed(texts)):
        assert np.frombuffer(packed, enc.dtype).tolist() == library.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,keeps_space", FILES)
def test_encoder_merges_a_word_once(name, keeps_space):
    """A word, alone or before a sign, goes through the library's merges once."""
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    enc = encode.Encoder(path, keeps_space)
    given, merges = [], enc.merges
    enc.merges = lambda word: given.append(word) or merges(word)
    texts = ["x alpha, béta. gamma", "x alpha béta, alpha. béta gamma,", "x 3, ×, É, (a), alpha.. béta,."]
    for t, packed in zip(texts + texts, enc.packed(texts + texts)):
        assert np.frombuffer(packed, enc.dtype).tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(given) == len(set(given)) and sum("lpha" in g for g in given) == 1


def test_forget():
    """Encoders dropped between stages come back with the same ids."""
    path, texts = public_tokenizers.path("byte_bpe_50k.json"), [r[1] for r in ODD]
    before = list(encode.encoder(path, True).packed(texts))
    encode.forget()
    assert not encode._encoders
    encode.forget()
    assert list(encode.encoder(path, True).packed(texts)) == before


def test_best_fit_decreasing():
    rng = np.random.default_rng(0)
    lengths = sorted(rng.integers(1, 101, 500).tolist(), reverse=True)
    number, offset = packing.best_fit_decreasing(lengths, 100)
    room, want = [], []
    for n in lengths:  # the plain rule, in quadratic time
        fits = [r for r in room if r >= n]
        if fits:
            room[room.index(min(fits))] -= n
        else:
            room.append(100 - n)
    used = collections.Counter()
    for n, w, o in zip(lengths, number, offset):
        assert o == used[w]
        used[w] += n
    assert max(used.values()) <= 100 and sorted(100 - u for u in used.values()) == sorted(room)


def test_packing(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for docs in (odd, table(spark, SF, "documents")):
        rows = packing.pack(docs, path, with_ids=True, window=256).collect()
        by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            by_seq[r.sequence_id].append((r.offset, r.length))
            by_doc[r.doc_id].append(r)
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        for parts in by_seq.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 256
        if docs is not odd:
            for d in docs.collect():
                ids = np.frombuffer(b"".join(r.ids for r in sorted(by_doc[d.doc_id], key=lambda r: r.start)), "<u4")
                assert ids.tolist() == library.encode(d.text, add_special_tokens=False).ids + [2]
        else:
            assert sum(r.length for r in by_doc[3]) == 1 and len(by_doc[None]) == 2 - 1
    assert packing.pack(odd.limit(0), path).count() == 0


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for high in (1, 2, 255, 256, 257, 65536, 70000, 2**32):
        ids = rng.integers(0, high, size=(6, 1024), dtype=np.uint64).astype(np.uint32)
        ids[0, :3] = [0, high - 1, high // 2]
        ids[1] = 7
        ids[2] = np.where(rng.random(1024) < 0.03, ids[2], 5)
        for row, b in zip(ids, tokenfiles.encode_blocks(ids)):
            assert (tokenfiles.decode_block(memoryview(b), 0) == row).all()


def test_token_files(spark, odd):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    folder = shared_dir(spark)
    manifest = Cuts(spark).cut(tokenfiles.write_token_files(odd, folder, path, file_text_bytes=20_000))
    rows = sorted(tokenfiles.read_token_files(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 1, 1, 3, 4, 5, 6, 7, 8, 9]
    text = {r[0]: r[1] for r in ODD}
    at = 0
    for r in rows:
        ids = np.array(library.encode(text[r.doc_id] or "", add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_hypergeometric(spark):
    q = spark.range(4000).selectExpr(
        "shiftrightunsigned(xxhash64(7, id), 11) / 9007199254740992D AS u").selectExpr(
        mixing.hypergeometric("u", "60D", "140D", "50D") + " AS k")
    k = np.array([r.k for r in q.collect()])
    assert abs(k.mean() - 15) < 0.2 and abs(k.var() - 50 * 0.3 * 0.7 * 150 / 199) < 0.8
    assert k.min() >= 0 and k.max() <= 50
    for good, bad, draws, want in ((0, 5, 3, 0), (5, 0, 3, 3), (4, 4, 8, 4), (0, 0, 0, 0)):
        sql = mixing.hypergeometric("0.3D", f"{good}D", f"{bad}D", f"{draws}D")
        assert spark.range(1).selectExpr(f"{sql} AS k").first().k == want


def test_splitting_tree(spark):
    q = {0: 1000, 1: 377, 2: 5, 3: 0, 4: 6000}
    rows = mixing.split_tree(spark.createDataFrame(list(q.items()), "idx long, q long"), 7).collect()
    per, shard = collections.Counter(), collections.Counter()
    for r in rows:
        per[r.idx] += r.n
        shard[r.shard] += r.n
        assert r.n >= 0
    assert per == collections.Counter(q) and len(shard) == 7 and max(shard.values()) - min(shard.values()) <= 3


def test_mixing(spark, odd):
    docs = table(spark, SF, "documents")
    full = mixing.mix(docs, [], Cuts(spark)).collect()
    again = {(r.doc_id, sum(p.words for p in r.pieces)) for r in mixing.mix(
        docs.repartition(7), [], Cuts(spark)).collect()}
    assert again == {(r.doc_id, sum(p.words for p in r.pieces)) for r in full}
    size, target, taken, blocks = collections.Counter(), {}, collections.Counter(), set()
    for r in full:
        size[r.source] += r.size
        target[r.source] = r.target
        for p in r.pieces:
            taken[r.source] += p.words
            blocks.add((r.source, p["pass"], p.block, p.shard))
        assert sum(p.words for p in r.pieces) <= 2 * r.size
    order = sorted(size)
    level = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, rest, open_ = {}, 1.5 * sum(size.values()), set(order)
    while open_:
        unit = rest / sum(level[s] for s in open_)
        full_ = {s for s in open_ if unit * level[s] >= 2 * size[s]}
        if not full_:
            want |= {s: unit * level[s] for s in open_}
            break
        want |= {s: 2.0 * size[s] for s in full_}
        rest -= sum(2.0 * size[s] for s in full_)
        open_ -= full_
    for s in order:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - target[s]) <= 1.5 * mixing.BLOCK_WORDS
    # a block of a pass goes to one shard
    assert len(blocks) == len({b[:3] for b in blocks})
    mixed = mixing.mixed_documents(docs).collect()
    words = collections.Counter()
    for r in mixed:
        words[r.source] += len(r.text.split())
    assert words == taken
    for cap in (3.0, 2.5):  # more than two passes; a pass in part
        few = docs.where("source in ('src0', 'src5')")
        rows = mixing.mix(few, [], Cuts(spark), cap=cap, share=4.0, block_words=64).collect()
        want = collections.Counter()
        for r in rows:
            want[r.source] += sum(p.words for p in r.pieces)
            assert sum(p.words for p in r.pieces) <= math.ceil(cap) * r.size
        for r in rows:
            assert r.target <= cap * r.source_size + 1e-6 and abs(want[r.source] - r.target) <= 2 * 64
        got = collections.Counter()
        for r in mixing.mixed_documents(few, cap=cap, share=4.0, block_words=64).collect():
            got[r.source] += len(r.text.split())
        assert got == want
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and out.where("doc_id in (3, 4, 5)").count() == 0
    assert mixing.mix(odd.limit(0), [], Cuts(spark)).count() == 0


def test_permutation(spark):
    """Every place once, and each row of keys another order."""
    seen = set()
    for n in (1, 2, 7, 64, 1000):
        for salt in range(3):
            keys = (f"transform(sequence(1, {mixing.ROUNDS}), r -> named_struct('k', pmod(xxhash64({salt}, r), {n}L), "
                    f"'s', xxhash64({salt}, r, 1)))")
            got = [r.p for r in spark.range(n).orderBy("id").selectExpr(
                f"{mixing._permuted('id', f'{n}L', keys)} AS p").collect()]
            assert sorted(got) == list(range(n))
            seen.add(tuple(got))
    assert len([s for s in seen if len(s) > 7]) == 6


def test_mix_shards(spark, odd, tmp_path):
    """The pieces by a plain walk: streams cut into blocks, shards' numbers from the tree."""
    docs = table(spark, SF, "documents").select("doc_id", "source", "text")
    repeated = docs.groupBy("doc_id").count().where("count > 1").count()
    assert repeated == 0
    texts = {r.doc_id: re.findall(r"[^ \t-\r]+", r.text or "") for r in docs.collect()}
    rows = mixing.mix_shards(docs, shards=5, file_words=4000, block_words=50)
    files = rows.rdd.glom().collect()
    got = [r for f in files for r in f]
    assert len([f for f in files if f]) > 5  # a shard of more than file_words has several partitions
    for f in files:
        assert [(r.shard, r.place) for r in f] == sorted((r.shard, r.place) for r in f)
    per = {r.doc_id: r.pieces for r in mixing.mix(docs, [], Cuts(spark), shards=5, block_words=50).collect()}
    want = [(d, p["pass"], p.block, p.shard, p.place, p.first, p.words) for d, v in per.items() for p in v]
    assert sorted((r.doc_id, r["pass"], r.block, r.shard, r.place, r.first, r.words) for r in got) == sorted(want)
    taken, blocks = collections.Counter(), collections.defaultdict(set)
    for r in got:
        assert r.text.split() == texts[r.doc_id][r.first:r.first + r.words] and r.words > 0
        taken[r.source, r["pass"], r.block] += r.words
        blocks[r.source, r["pass"], r.block].add(r.shard)
        for i in range(r.first, r.first + r.words):
            taken[r.doc_id, r["pass"], "word", i] += 1
    assert max(n for k, n in taken.items() if "word" in k) == 1  # a word once a pass
    assert all(len(s) == 1 for s in blocks.values())
    assert max(n for k, n in taken.items() if "word" not in k) == 50
    shard = collections.Counter(next(iter(s)) for s in blocks.values())
    assert len(shard) == 5 and max(shard.values()) - min(shard.values()) <= 3
    order = [(r.doc_id, r.first) for r in sorted(got, key=lambda r: r.place) if r.shard == 0]
    assert order != sorted(order)
    folder = str(tmp_path / "mix")
    mixing.write_mix(odd, folder, shards=3, block_words=1000)
    back = spark.read.parquet(folder).collect()
    by = {r.doc_id: (r.size, sum(p.words for p in r.pieces)) for r in mixing.mix(
        odd, [], Cuts(spark), shards=3, block_words=1000).collect()}
    for d in (6, 7, 8, 9):
        assert sum(len(re.findall(r"[^ \t-\r]+", r.text)) for r in back if r.doc_id == d) == by[d][1]
    assert mixing.mix_shards(odd.limit(0)).count() == 0


def test_quality(spark, odd):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    rows = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    hits = [(rows[r.doc_id].predicted == r.quality) for r in labels.collect()
            if rows[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert np.mean(hits) > 0.95
    got = quality.classify(odd, labels.limit(0)).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    out = quality.keep_good(odd, labels)
    assert out.columns == odd.columns


def test_toxicity(spark, odd):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    weights, theta = toxicity.fit(docs, labels)
    assert (np.diff(theta) > 0).all()
    rows = {r.doc_id: r for r in toxicity.score(docs, weights, theta).collect()}
    toxic = [r for r in labels.collect()]
    assert np.mean([rows[r.doc_id].toxic for r in toxic if r.toxic]) > 0.95
    assert np.mean([rows[r.doc_id].toxic for r in toxic if not r.toxic]) < 0.005
    for r in list(rows.values())[:50]:
        assert 1 >= r.p_ge_1 >= r.p_ge_2 >= r.p_ge_3 >= 0
        assert r.expected_severity == pytest.approx(r.p_ge_1 + r.p_ge_2 + r.p_ge_3)
    assert len(toxicity.score(odd, *toxicity.fit(odd, labels.limit(0))).collect()) == len(ODD)


def test_url_rules_and_links(spark):
    rules = (("block", "bad.com", "/"), ("allow", "good.org", "/"))
    link = '<a href="http://{}/x">l</a>'.format
    pages = [(1, "http://bad.com/a", ""), (2, "http://friend.com/", link("bad.com")),
             (3, "http://good.org/", link("fine.net")), (4, "http://fine.net/p?q#f", None),
             (5, None, "x"), (6, "nothing", "x"), (7, "HTTP://Sub.Bad.COM/Q?x", None), (8, "http://bad.com", None),
             (9, "http://notbad.com/", None), (9, "http://notbad.com/", None), (None, "ftp://u@good.org/#f", ""),
             (10, "http://bad.com/b", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = [tuple(r) for r in linktrust.judge(df, Cuts(spark), rules).collect()]
    by = {r[0]: r[1:] for r in got}
    assert len(got) == len(pages)
    assert by[1] == ("bad.com", "/a", "bad.com/", "block") and by[7] == ("sub.bad.com", "/Q", "bad.com/", "block")
    assert by[8] == ("bad.com", "", None, "block")  # no rule, but its host is blocked
    assert by[2][3] == "block"  # links to a blocked host: distrust comes back along the link
    assert by[4] == ("fine.net", "/p", None, "allow") and by[9][3] == "allow"
    assert by[5] == by[6] == ("", "", None, "allow")
    assert by[None][2] is None or by[None][2] == "good.org/"
    assert linktrust.judge(df.limit(0), Cuts(spark)).count() == 0


def test_link_trust_settles(spark):
    """A chain of 16 hosts, far longer than 12 links, against the linear solution."""
    n, rules = 16, (("block", "bad.com", "/"), ("allow", "good.org", "/"))
    hosts = ["good.org", *(f"h{i}.net" for i in range(1, n - 1)), "bad.com"]
    pages = [(i, f"http://{h}/", f'<a href="http://{hosts[i + 1]}/">x</a>' if i + 1 < n else None)
             for i, h in enumerate(hosts)] + [(100 + i, "http://bad.com/", None) for i in range(500)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.host: r for r in linktrust.host_scores(df, Cuts(spark), rules).collect()}
    start = np.zeros((3, n))
    start[0, 0], start[1, -1], start[2, 1:-1] = 1, 501, 1
    down, eye = np.eye(n, k=-1), np.eye(n)  # the next host of the chain receives
    for name, s, m in zip(("trust", "distrust", "plain"), start / start.sum(), (down, down.T, down)):
        want = np.linalg.solve(eye - 0.85 * m, 0.15 * s)
        assert [got[h][name] for h in hosts] == pytest.approx(want, rel=1e-9, abs=1e-15)
    with pytest.raises(RuntimeError):
        linktrust.host_scores(df, Cuts(spark), rules, max_rounds=3)


def test_quotations(spark):
    m = [(1, 0, "user", "Hello there, how do I sort a list?\n\nAlso: what about dicts?"),
         (1, 1, "assistant", "Use sorted(x).\nIt is stable."), (1, 2, "user", "thanks"),
         (1, 3, "user", "On Monday bob wrote:\n> Also: what about DICTS?\n>> deep thing\nPlease answer this one"),
         (2, 0, "user", "> use sorted(x).\nwhy?"), (2, 1, "assistant", None), (None, 1, "x", "q"),
         (3, 0, "user", ""), (3, 0, "user", "dup"), (4, 0, None, "> nobody said this")]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("c"))
    rows = quotes.reply_order(df, Cuts(spark)).collect()
    by = {(r.conv_id, r.turn): r for r in rows}
    assert len(rows) == len(m)
    assert (by[1, 3].reply_conv, by[1, 3].reply_turn) == (1, 0) and by[1, 3].text == "Please answer this one"
    assert (by[2, 0].reply_conv, by[2, 0].reply_turn) == (1, 1) and by[2, 1].depth == 3
    assert by[None, 1].thread_conv is None and by[4, 0].reply_conv is None and by[4, 0].text == ""
    place = {(r.thread_conv, r.position): (r.conv_id, r.turn) for r in rows if r.thread_conv == 1}
    order = [place[1, i] for i in range(len(place))]
    for r in rows:
        if r.reply_conv is not None:
            assert order.index((r.reply_conv, r.reply_turn)) < order.index((r.conv_id, r.turn))
    chain = spark.createDataFrame([(1, i, "u", f"t {i}") for i in range(70)], "conv_id long, turn long, role string, text string")
    assert max(r.depth for r in quotes.reply_order(chain, Cuts(spark)).collect()) == 69
    assert quotes.reply_order(df.limit(0), Cuts(spark)).count() == 0


def test_nested_quotations(spark):
    m = [(1, 0, "b", "Text of B, first.\nSecond line of B."), (1, 1, "a", "Text of A."), (1, 2, "c", "in between"),
         (1, 3, "d", "> On Sun B wrote:\n>> Text of B, first.\n>> Second line of B.\nmy answer"),  # depth 1 trimmed
         (1, 4, "e", ">> text of a\nonly nested"),
         (1, 5, "f", "> Text of A.\n>> Text of B, first.\n>> Second line of B.\nthe shallow one counts"),
         (1, 6, "g", ">> unknown\n>>> In between\n>>>> Text of A."),
         (2, 0, "h", "> > > Second line of B.\nfrom elsewhere"), (3, 0, "i", ">> nobody said this"),
         (3, 1, "j", "plain")]
    df = spark.createDataFrame(m, "conv_id long, turn long, role string, text string")
    by = {(r.conv_id, r.turn): r for r in quotes.reply_order(df, Cuts(spark)).collect()}
    assert {k: (r.reply_conv, r.reply_turn, r.quote_depth) for k, r in by.items()} == {
        (1, 0): (None, None, None), (1, 1): (1, 0, None), (1, 2): (1, 1, None), (1, 3): (1, 0, 2), (1, 4): (1, 1, 2),
        (1, 5): (1, 1, 1), (1, 6): (1, 2, 3), (2, 0): (1, 0, 3), (3, 0): (None, None, None), (3, 1): (3, 0, None)}
    assert by[1, 4].n_quotes == by[3, 0].n_quotes == by[2, 0].n_quotes == 1 and by[1, 6].n_quotes == 3
    assert by[1, 3].n_quotes == 4 and by[3, 1].n_quotes == 0 and by[1, 3].text == "my answer"


def test_parse_quotations():
    assert quotes.parse("a\n> b\n> c\n\n>> d\ne") == ("a\n\ne", [(0, "a"), (1, "b\nc"), (2, "d"), (0, "e")])
    assert quotes.parse(None) == ("", []) and quotes.parse("x > y") == ("x > y", [(0, "x > y")])
    assert quotes.normalised("Ab,  c!") == "ab c"


def test_pipeline(spark, odd):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    cuts = Cuts(spark)
    docs = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cuts.cut(stage(spark, docs, SF))
        assert out.columns == docs.columns, name
        if name != "mixing":
            assert out.exceptAll(docs).count() == 0  # only drops rows
        docs = out
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    for clash in (odd, odd.limit(0)):
        docs = clash
        for _, stage in corpus_pipeline.STAGES:
            docs = cuts.cut(stage(spark, docs, SF))


def test_all_queries_are_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", k).group(1)) for k in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)
