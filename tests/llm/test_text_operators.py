"""Operators on texts: brute force on small tables, and every odd case a table may hold."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from lattiq.llm import bpe, decontaminate, pii, quality, simhash, token_counts, token_files
from lattiq.llm.common import Scratch
from lattiq.llm.tagger import Tagger

RANKS = bpe.read_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
ENC = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = [
    None, "", " ", "\n\n", "a", "the  cat \n sat", "It's 'll we're  ok", "日本語 テキスト 😀", "x\u0085 y\x1c z\u00a0 w", "a" * 3000, "<|endoftext|> <s>", " lead and trail ", "tab\tand 12,345.67",
    "mail a.b@mail1.example.com or +1 (788) 555-2942, card 4111 1111 1111 1111, ip 10.0.0.255 and 1.2.3.400", "12 4111111111111111 x", "word " * 4000,
]
SCHEMA = "doc_id bigint, text string, lang string, n_chars bigint, ids string, score string, __text__ string, `own` boolean, spans int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, len(t or ""), "x", "y", "z", True, 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[6], rows[6], (None, "no id", None, None, None, None, None, None, None)], SCHEMA)


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_bpe_equals_the_library_and_decodes(spark, odd):
    got = sorted(map(repr, bpe.encode(spark, odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True, keep_decoded=True, digests=True).collect()))
    rows = bpe.encode(spark, odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, keep_ids=True, keep_decoded=True, digests=True).collect()
    assert len(got) == len(ODD) + 3
    want = sorted((repr((k, ENC.encode_ordinary(t))), t) for k, t in texts_of(odd))
    mine = sorted((repr((r.doc_id, list(r.ids))), bytes(r.decoded).decode()) for r in rows)
    assert mine == want
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded).hexdigest() for r in rows)
    assert bpe.encode(spark, odd.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_merge_order_within_a_piece_when_a_merge_opens_a_lower_rank():
    letters = {bytes([b]): b for b in range(256)}
    ranks = letters | {b"bc": 256, b"abc": 257, b"ab": 258, b"cc": 259, b"bcc": 260, b"aa": 261}
    replay = bpe.MergeReplay(ranks, r"\S+|\s+")
    ref = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abc"), n)) for n in rng.integers(1, 12, 400)]
    ids, sizes = replay.replay([w.encode() for w in words])
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ref.encode_ordinary(w) for w in words]
    assert all(replay.alone(w.encode()).tolist() == ref.encode_ordinary(w) for w in words)


def test_token_counts_answer_every_limit(spark, odd):
    sums = token_counts.count_tokens(spark, odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    lengths = np.array([len(ENC.encode_ordinary(t)) for _, t in texts_of(odd)])
    for r in sums.collect():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_tokens) == ((lengths == r.n_tokens).sum(), (lengths >= r.n_tokens).sum(), lengths[lengths >= r.n_tokens].sum(), np.minimum(lengths, r.n_tokens).sum())
    limits = [0, 3, 100, 2000, 10**6]
    assert {r.limit: r.truncated_tokens for r in token_counts.truncated_totals(sums, limits).collect()} == {x: np.minimum(lengths, x).sum() for x in limits}
    assert {r.share: r.n_tokens for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()} == {0.5: np.sort(lengths)[-(-len(lengths) // 2) - 1], 1.0: lengths.max()}
    assert token_counts.count_tokens(spark, odd.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 32])
def test_packing_round_trip_and_random_access(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1000).astype(np.uint32)
    packed = token_files.pack(ids, width)
    assert len(packed) == -(-1000 * width // 8)
    assert np.array_equal(token_files.unpack(packed, width, 0, 1000), ids)
    assert all(np.array_equal(token_files.unpack(packed, width, a, n), ids[a : a + n]) for a, n in ((0, 1), (7, 0), (333, 100), (999, 1)))
    assert token_files.width_for(50_257) == 16 and token_files.width_for(2) == 1 and token_files.width_for(1) == 1


@pytest.mark.parametrize("plain", [False, True])
def test_token_file(spark, odd, plain):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = plain
    target = Scratch(spark, "t").path("f")
    odd = odd.unionByName(spark.createDataFrame([(901, "a <|endoftext|> b"), (902, "<|endoftext|>"), (903, "x<|endoftext|>  y <|endoftext|"), (904, "")], "doc_id bigint, text string"), allowMissingColumns=True)
    token_files.write(spark, odd, P.path("byte_bpe_50k.json"), P.PATTERN, target, shards=3, plain=plain)
    blocks = token_files.open_file(spark, target)
    rows = sorted(token_files.documents(blocks).collect(), key=lambda r: r.start)
    docs = sorted(texts_of(odd), key=lambda r: (r[0] is not None, r[0] or 0))
    stream = []
    assert len(rows) == len(docs)
    for r, (key, text) in zip(rows, docs, strict=True):
        ids = [*tok.encode(text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (key, len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stream += ids
    assert token_files.read_run(spark, target, 5, 700).tolist() == stream[5:705]
    assert token_files.write_and_read(spark, odd.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0


def test_token_file_takes_its_width_from_the_vocabulary(spark):
    docs = spark.createDataFrame([(1, "ab ba"), (2, None)], "doc_id bigint, text string")
    target = Scratch(spark, "t").path("wide")
    token_files.write(spark, docs, P.path("byte_bpe_50k.json"), P.PATTERN, target, end_id=70_000, shards=1)
    blocks = token_files.open_file(spark, target)
    assert blocks.first().width == 17 and token_files.read_run(spark, target, 0, 9)[-1] == 70_000


def test_chunk_memory_is_bounded_and_forgets_nothing_that_matters():
    from lattiq.llm.chunks import ChunkEncoder

    asked = []

    def encode(chunks):
        chunks = chunks.to_pylist()
        asked.extend(chunks)
        return np.array([ord(c) for x in chunks for c in x], np.uint32), np.array([len(x) for x in chunks], np.int64)

    c = ChunkEncoder(encode, r"\s?\S+|\s+", remember=200, whole=("<s>",))
    rng = np.random.default_rng(1)
    for n in range(30):
        texts = [" ".join(["often", *(f"w{x}" for x in rng.integers(0, 400, 12))]) + tail for tail in ("", " ", "  y", " <s> z")]
        ids, offsets = c.flat(pa.array([*texts, None, ""]))
        assert ["".join(map(chr, ids[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [*texts, "", ""]
        assert len(c.known) <= 200 + 60
    assert asked.count("often") <= 3


def brute_print(text, k=4):
    w = text.encode().lower().split()
    s = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [b" ".join(w)] if w else []
    votes = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in votes) > len(votes))


def test_fingerprints(odd):
    values = [t for _, t in texts_of(odd)]
    assert simhash.fingerprints([t.encode() for t in values]).tolist() == [brute_print(t) for t in values]


@pytest.mark.parametrize(("blocks", "threshold"), [(simhash.BLOCKS_4, 4), (simhash.BLOCKS_7, 7)])
def test_every_pair_within_the_threshold_meets_at_an_anchor(blocks, threshold):
    assert sum(b[2] + 1 for b in blocks) > threshold and sum(b[1] for b in blocks) == 64
    rng = np.random.default_rng(3)

    def keys(fp, own):
        out = set()
        for n, (first, bits, share) in enumerate(blocks):
            b = fp >> first & (1 << bits) - 1
            ms = simhash.moves(bits, simhash.RADIUS + share)[simhash.syndrome(b & 0x7FFF)]
            out |= {(n, b ^ m) for m in (ms[:1] if own else ms)}
        return out

    for _ in range(300):
        x = int(rng.integers(0, 2**63))
        y = x
        for bit in rng.choice(64, int(rng.integers(0, threshold + 1)), replace=False):
            y ^= 1 << int(bit)
        assert keys(x, True) & keys(y, False)


def test_simhash_components(spark, odd):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 8
    near = [(100 + i, base + f"tail{i}") for i in range(40)] + [(200 + i, base) for i in range(30)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id bigint, text string"))
    got = simhash.near_duplicates(spark, docs).collect()
    rows = texts_of(docs)
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        least[r] = key if least.get(r) is None else least[r] if key is None else min(least[r], key)
    want = sorted(repr((key, f"{prints[i]:016x}", least[find(i)])) for i, (key, _) in enumerate(rows))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_hot_anchor_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 16)
    rng = np.random.default_rng(5)
    seed = int(rng.integers(0, 2**62))
    prints = sorted({seed ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))})
    df = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    out = simhash.links(spark, df, Scratch(spark, "t"), lambda: simhash.Links(4), simhash.BLOCKS_4)
    edges = {(r.u, r.v) for r in out.collect()}
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        parent[max(find(u), find(v))] = min(find(u), find(v))
    assert len({find(p) for p in prints}) == 1 and len(edges) < 20 * len(prints)


def test_near_copies_stage(spark, odd):
    rng = np.random.default_rng(8)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(3000)]
    a, b = ([str(x) for x in rng.choice(vocabulary, 200)] for _ in range(2))
    close = [*a]
    close[50] = close[150] = "changed"
    rows = [(300, " ".join(a)), (301, " ".join(close)), (302, " ".join(a).upper()), (303, " ".join(b)), (304, " ".join(a[:120])), (303, " ".join(b)), (303, "another text with the same id"), (305, " ".join(b))]
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    got = simhash.deduplicated(spark, docs)
    assert got.columns == docs.columns
    kept = sorted((r.doc_id, r.text) for r in got.filter("doc_id >= 300").collect())
    assert kept == sorted([(300, " ".join(a)), (303, " ".join(b)), (303, "another text with the same id"), (304, " ".join(a[:120]))])
    assert got.filter("doc_id is null").count() == 1 and got.filter("doc_id = 6").count() == 1
    assert got.filter("doc_id in (0, 1, 2, 3)").count() == 1
    assert simhash.deduplicated(spark, docs.limit(0)).count() == 0


def test_tiles_cover_reordered_passages():
    item = np.arange(20)
    doc = np.concatenate([[-1] * 3, item[10:20], [-1], item[:10], [50, 51]])
    assert sorted(decontaminate.tiles(doc, item, 5)) == [(3, 10, 10), (14, 0, 10)]
    assert decontaminate.tiles(np.array([1, 2, 3]), item, 5) == [] and decontaminate.tiles(np.zeros(0, int), item, 5) == []
    again = np.concatenate([item[:12], item[5:20]])
    assert sum(t[2] for t in decontaminate.tiles(again, item, 5)) == 20


def brute_tiles(doc, item, least):
    """Greedy string tiling as first described: find the longest free matches, mark, repeat."""
    d, i, out = [False] * len(doc), [False] * len(item), 0
    while True:
        best = (0, 0, 0)
        for y in range(len(item)):
            for x in range(len(doc)):
                k = 0
                while x + k < len(doc) and y + k < len(item) and doc[x + k] == item[y + k] and doc[x + k] >= 0 and not d[x + k] and not i[y + k]:
                    k += 1
                if k > best[0]:
                    best = (k, y, x)
        k, y, x = best
        if k < least:
            return out
        for j in range(k):
            d[x + j] = i[y + j] = True
        out += k


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(150):
        doc, item = rng.integers(-1, 4, int(rng.integers(0, 40))), rng.integers(0, 4, int(rng.integers(1, 20)))
        assert sum(t[2] for t in decontaminate.tiles(doc, item, 3)) == brute_tiles(doc.tolist(), item.tolist(), 3)


def test_leaks(spark, odd):
    w = [f"w{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(w)), (2, "Short one."), (3, None), (4, "..."), (1, " ".join(w)), (None, "odd item without any number here")], "item_id bigint, text string")
    rows = [(500, "intro " + " ".join(w[15:] + ["x"] + w[:15]).upper() + " end"), (501, " ".join(w[:10])), (502, "a short, ONE!"), (503, " ".join(w[::2])), (500, "intro " + " ".join(w))]
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    found = decontaminate.leaks(spark, docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.coverage, len(r.tiles)) for r in found) == [(500, 1, 1.0, 1), (500, 1, 1.0, 2), (502, 2, 1.0, 1)]
    sliced = decontaminate.leaks(spark, docs, bench, limit=64).collect()
    assert sorted(map(repr, sliced)) == sorted(map(repr, found))
    clean = decontaminate.clean(spark, docs, bench)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 3
    assert decontaminate.leaks(spark, docs.limit(0), bench).count() == 0 and decontaminate.leaks(spark, docs, bench.limit(0)).count() == 0


def test_tagger_gradients():
    allowed = np.ones((3, 3), bool)
    allowed[0, 2] = False
    m = Tagger(5, 3, allowed, np.array([True, True, False]), 3, 4)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (2, 6)), np.array([[0, 1, 2, 2, 0, 0], [1, 2, 0, 1, 1, 2]])
    _, g = m.loss(x, y)
    for name in g:
        i = tuple(int(rng.integers(0, s)) for s in m.p[name].shape)
        old, e = m.p[name][i], 1e-5
        m.p[name][i] = old + e
        up = m.loss(x, y)[0]
        m.p[name][i] = old - e
        down = m.loss(x, y)[0]
        m.p[name][i] = old
        assert abs((up - down) / 2 / e - g[name][i]) < 1e-7


BASE = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True), (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", pii.is_ip), (r"[0-9]([\x20-]?[0-9])+", pii.is_card), (r"\+[0-9][\x20().0-9-]+[0-9]", pii.is_phone)]


def brute_base(text):
    return sorted((m.start(), k, m.end()) for k, (p, good) in enumerate(BASE) for m in re.finditer(p, text) if good(m.group()))


def test_base_spans_equal_the_patterns(odd):
    rng = np.random.default_rng(4)
    random = ["".join(rng.choice(list("a1.@+- (9\n€"), 40)) for _ in range(4000)]
    for text in [*random, *(t for _, t in texts_of(odd))]:
        assert pii.base_spans(text) == brute_base(text)
    assert pii.emails("a" * 200_000 + "@") == []


def test_pii_adds_lost_spans_and_keeps_the_base(spark, odd):
    rows = {r.doc_id: r for r in pii.detect(spark, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for key, text in texts_of(odd.filter("doc_id is not null")):
        base, r = brute_base(text), rows[key]
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == k for s in base) for k in range(4))
        assert set(filter(None, pii.written(base).split(","))) <= set(r.spans.split(","))
    assert rows[14].spans == "card:3:19" and rows[14].n_added == 1
    assert pii.detect(spark, odd).count() == odd.count() and pii.detect(spark, odd.limit(0)).count() == 0
    test = pii.examples(200, seed=77)
    inner = lambda spans, t: {s for s in spans if s[0] > 0 and s[2] < len(t)}  # noqa: E731  an end of the text may cut the others
    got = [inner(g, t) for g, (t, _) in zip(pii.decoded(pii.trained(), [t for t, _ in test]), test, strict=True)]
    want = [inner(s, t) for t, s in test]
    right = sum(len(g & s) for g, s in zip(got, want, strict=True))
    assert right / sum(map(len, got)) > 0.9 and right / sum(map(len, want)) > 0.85


def test_redaction(spark, odd):
    out = pii.redact(spark, odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    r = out.filter("doc_id = 13").first()
    assert r.text == "mail [EMAIL] or [PHONE], card [CARD], ip [IP] and 1.2.3.400" and r.n_chars == len(r.text)
    assert out.filter("doc_id = 0").first().text is None
    assert pii.reconcile([(0, 2, 9, 2.0), (5, 2, 20, 3.0), (10, 2, 20, 1.5), (10, 2, 20, 1.0)]) == [(0, 2, 9), (10, 2, 20)]


def test_quality_trees_against_a_walk_by_hand():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    m = quality.fit(x[:400], y[:400], trees=30)
    s = m.score(x)
    assert ((s[400:] > 0.5) == y[400:]).mean() > 0.93

    def walk(row):
        total = m.base
        for n in m.roots:
            while m.left[n] != n:
                n = m.left[n] if row[m.feature[n]] <= m.cut[n] else m.right[n]
            total += m.value[n]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], s[:50])
    assert np.allclose(quality.fit(x[:0], y[:0]).score(x), 0.5)
    assert (quality.fit(x, np.ones(600)).score(x) > 0.99).all()


def test_quality_query_shape(spark, odd):
    good = "Plain words stand here in sentences. They end with stops, and they differ. "
    rows = [(1000 + i, good * (1 + i % 5) + f"Number {i} of them.") for i in range(60)] + [(2000 + i, "$$$ ### " * (20 + i)) for i in range(60)]
    docs = odd.unionByName(spark.createDataFrame(rows, "doc_id bigint, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(k, int(k < 2000), 0) for k, _ in rows] + [(1000, 1, 0), (77777, 0, 0), (None, 1, 0), (1001, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(spark, docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [(r.predicted, int(r.doc_id < 2000)) for r in got if r.held_out and r.doc_id >= 1000]
    assert len(held) > 10 and all(a == b for a, b in held)
    assert {r.score for r in quality.classify(spark, odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(spark, docs, labels)
    assert kept.columns == docs.columns and kept.filter("doc_id >= 2000").count() == 0 and kept.filter("doc_id between 1000 and 1999").count() == 60
    assert quality.classify(spark, docs.limit(0), labels).count() == 0


def test_tiles_of_equal_words_take_little_memory():
    import tracemalloc

    tracemalloc.start()
    assert decontaminate.tiles(np.zeros(20_000, np.int64), np.zeros(5_000, np.int64), 5) == [(0, 0, 5000)]
    assert decontaminate.tiles(np.tile([0] * 99 + [1], 200), np.tile([0] * 37 + [2], 130), 5)[:2] == [(0, 0, 37), (37, 38, 37)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_long_texts_vote_in_parts(monkeypatch):
    rng = np.random.default_rng(2)
    values = [b" ".join(b"w%d" % x for x in rng.integers(0, 500, int(rng.integers(0, 60)))) + b"  \n" * (k % 2) for k in range(60)] + [b"", b" ", b"a b", b"abc" * 50]
    for words in (1, 4, 5):
        want = simhash.fingerprints(values, words)
        for part in (1, 7, 40):
            monkeypatch.setattr(simhash, "PART", part)
            assert np.array_equal(simhash.fingerprints(values, words), want)
        monkeypatch.undo()


def test_repeated_benchmark_items_count_once(spark):
    item = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(1, f"so {item} it is")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, item)] * 500 + [(8, None)], "item_id bigint, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs, bench, limit=2_000).collect()] == [(1, 7)]


def test_the_tagger_adds_what_patterns_lose():
    model = pii.trained()
    adds = {
        "Call +1 (826) 555-4081 190.137.223.204 today": ("phone", "+1 (826) 555-4081"),
        "Write to anna.lee [at] post [dot] org now": ("email", "anna.lee [at] post [dot] org"),
        "See 10[.]20[.]30[.]44 for more": ("ip", "10[.]20[.]30[.]44"),
        "nun 7536784127813050 4845168114407329 da": ("card", "4845168114407329"),
    }
    found = 0
    for text, (kind, value) in adds.items():
        base, every = pii.find(model, [text])
        assert set(base[0]) <= set(every[0]) and base[0] == pii.base_spans(text)
        found += any(pii.KINDS[k] == kind and text[a:b] == value for a, k, b in set(every[0]) - set(base[0]))
    assert found >= 3
    right = wrong = lost = 0
    for text, spans in pii.examples(600, seed=99):
        want = {s for s in spans if s[0] >= 0 and s[2] <= len(text) and pii.plainly(s[1], text[s[0] : s[2]])}
        base, every = (set(x[0]) for x in pii.find(model, [text]))
        right, lost = right + len((every - base) & want), lost + len(want - every)
        wrong += sum(a > 0 and b < len(text) for a, _, b in (every - base) - want)
    assert right >= 0.8 * (right + lost) and wrong <= 0.05 * right


def test_spans_cut_by_windows_are_joined():
    whole = [(2, 0, 9, 1.0, False, False)]
    cut = [(100, 1, 140, 2.0, False, True), (120, 1, 160, 3.0, True, True), (150, 1, 170, 1.0, True, False), (300, 2, 310, 1.0, True, False), (400, 3, 410, 1.0, False, True)]
    assert sorted(pii.joined([*cut, *whole])) == [(2, 0, 9, 1.0), (100, 1, 170, 3.0)]


def test_many_slices_leave_what_one_slice_leaves(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(40)]
    docs = [(i, f"before it {items[i][1]} and after" if i % 3 else f"nothing of the kind {i} here at all", "x", i) for i in range(40)] + [(None, items[5][1], "y", 1), (41, None, "z", 2)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, text_ string, item_id int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(repr, decontaminate.clean(spark, df, bench).collect()))
    n = len(list(decontaminate.slices(spark, bench, 5, 400)))
    assert n > 2 * decontaminate.SLICES
    assert sorted(map(repr, decontaminate.clean(spark, df, bench, limit=400).collect())) == one
    assert len(one) == sum(i % 3 == 0 for i in range(40)) + 1
    plan = decontaminate.clean(spark, df, bench, limit=400)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 1
    found = decontaminate.leaks(spark, df, bench, limit=400)
    assert sorted(r.item_id for r in found.collect()) == sorted([i for i in range(40) if i % 3] + [5])
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == -(-n // decontaminate.SLICES)


def test_the_first_look_knows_all_white_space():
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    spaces = [chr(c) for c in range(0x110000) if re.match(r"\s", chr(c))]
    texts = [f"a{s}dot{s}b" for s in spaces] + [f"x [at{s}] y" for s in spaces]
    assert all(pc.match_substring_regex(pa.array(texts), pii._MAYBE).to_pylist())
    assert not any(pc.match_substring_regex(pa.array(["a dotted line", "at home", "plain words"]), pii._MAYBE).to_pylist())
