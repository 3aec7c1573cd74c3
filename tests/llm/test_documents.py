"""Operators over documents: against brute force on a small table, and on awkward rows."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallystream.llm import bpe, components, jpeg, langid, minhash, mixing, sharding, tokencount
from tallystream.llm.queries import byte_vocabulary, word_vocabulary

SMALL = "/root/testdata/sf0.001/documents.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def small(spark):
    return spark.read.parquet(SMALL)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# --- Near-duplicates ------------------------------------------------------------------------------


def components_of(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations([i for i in sets if sets[i]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    d = small(spark)
    want = components_of([(r.doc_id, r.text) for r in d.collect()], width, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d, width=width).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_near_duplicates_find_every_link_of_a_spread_out_group(spark):
    """Copies with random edits lie on both sides of the threshold; hubs alone do not settle them."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in rng.integers(0, 4000, 150)]
    texts = []
    for i in range(120):
        own = list(words)
        for k in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            own[k] = f"e{rng.integers(1 << 40)}"
        texts.append((i, " ".join(own)))
    want = components_of(texts, 4, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), width=4).collect()}
    assert got == want


def test_members_of_a_family_do_not_all_meet(spark, monkeypatch):
    """Edits of a text that is not there itself: most pairs are a little under the threshold, and hubs leave nearly all of them open."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(160):
        own = list(words)
        for k in rng.choice(150, 2 if i % 40 == 0 else 3, replace=False):
            own[k] = f"e{rng.integers(1 << 40)}"
        texts.append((i, " ".join(own)))
    met, confirmed = [], minhash._confirmed
    monkeypatch.setattr(minhash, "_confirmed", lambda pairs, *rest: (met.append(pairs.count()), confirmed(pairs, *rest))[1])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), width=4).collect()}
    assert got == components_of(texts, 4, 80)
    assert met[1] < 160 * 159 / 2 / 5


def test_texts_that_share_a_doc_id_or_have_none_are_linked(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, a), (1, b), (2, b + " more"), (3, a + " more"), (None, b + " else"), (None, "other words that nobody shares at all"), (None, None), (9, None)]
    got = sorted(((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()))
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (0, 1, False), (0, 0, False), (0, 0, False), (9, 9, True)])


def test_the_sample_does_not_hang_on_doc_ids(spark):
    words = {"en": "the house and the garden of", "de": "das Haus und der Garten von"}
    rows = [(None, f"{words[lang]} {lang}{i} {lang}{i * 7}", lang) for lang in words for i in range(200)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=20)
    assert model is not None and sorted(model.langs) == ["de", "en"]


def test_near_duplicates_of_awkward_rows(spark, awkward):
    got = defaultdict(list)
    for r in minhash.near_duplicates(awkward, width=4).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert [got[i][0][1] for i in (1, 2, 3)] == [1, 1, 1] and got[11] == [(1, 10, False)]
    assert [got[i] for i in (4, 5, 6)] == [[(0, i, True)] for i in (4, 5, 6)]
    assert got[9] == [(1, 9, True)] and len(got[12]) == 2
    assert minhash.near_duplicates(awkward.limit(0)).count() == 0


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 1 << 63, 3000, dtype=np.uint64)
    a, b = x[:2000], x[500:2500]
    assert (minhash.merged(minhash.registers(a), minhash.registers(b)) == minhash.registers(x[:2500])).all()
    got = minhash.likely_similarity(minhash.registers(a)[None], minhash.registers(b)[None], np.array([2000.0]), np.array([2000.0]))
    assert abs(got[0] - 1500 / 2500) < 0.15


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components.connected_components(e).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


# --- Language -------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(d, langid.fit(d.where(~langid.held_out()))).join(d.select("doc_id", "lang", langid.held_out().alias("held")), "doc_id").where("held").collect()
    assert len(found) > 100 and np.mean([r.lang == r.lang_pred for r in found]) > 0.97
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in found)


def test_mixture_shares(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(d)
    by = {r.lang: r.text for r in d.where("length(text) > 3000").dropDuplicates(["lang"]).collect()}
    mixed = spark.createDataFrame([(1, by["en"][:2000] + " " + by["fr"][:1000])], "doc_id long, text string")
    r = langid.identify(mixed, model).first()
    assert r.lang_pred == "en" and 0.5 < r.score < 0.85 and r.n_languages == 2


def test_language_of_awkward_rows(spark, awkward):
    model = langid.fit(awkward)
    got = {r.doc_id: r for r in langid.identify(awkward, model).collect()}
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (4, 5, 6, 7)) and got[1].lang_pred == got[2].lang_pred
    assert langid.identify(awkward, None).where("lang_pred <> 'und'").count() == 0
    assert langid.fit(awkward.limit(0)) is None and langid.identify(awkward.limit(0), model).count() == 0


# --- Media ----------------------------------------------------------------------------------------


def padded(raw):
    return raw + b"\xff" * (max(1, -(-len(raw) // jpeg.UNIT)) * jpeg.UNIT - len(raw))


def test_media_round_trip(spark, awkward):
    d = small(spark).select("doc_id", "text").union(awkward.select("doc_id", "text"))
    texts = [(r.doc_id, (r.text or "").encode()) for r in d.collect()]
    want = sorted((i, len(t), hashlib.sha256(padded(t)).hexdigest(), zlib.crc32(padded(t)[-32:])) for i, t in texts)
    got = jpeg.media_digests(d).collect()
    assert sorted((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert all(r.payload_bytes % jpeg.UNIT == 0 and r.media_bytes > 0 for r in got)
    same = {(r.media_sha256, r.feature) for r in got if r.doc_id in (10, 11) and r.n_bytes == 7}
    assert len(same) == 1 and jpeg.media_digests(d.limit(0)).count() == 0


def test_any_coefficients_survive_all_scans():
    rng = np.random.default_rng(1)
    raw = [bytes(rng.integers(0, 256, 576 * 5, dtype=np.uint8)), bytes(rng.integers(126, 131, 576 * 9, dtype=np.uint8)), b"\x80" * 1700 + b"\x81" + b"\x80" * (576 * 4 - 1701), b"\x00" * 576]
    images, coef = jpeg.coefficients(jpeg.encode_batch(raw))
    assert [jpeg.payload(i, coef) for i in images] == raw


def test_pixels_are_the_inverse_transform():
    image, coef = (lambda x: (x[0][0], x[1]))(jpeg.coefficients(jpeg.encode_batch([bytes(range(256)) * 9])))
    part = image.parts[0]
    flat = np.zeros(64)
    flat[jpeg.ZIGZAG] = coef[part["base"]]
    f, c = flat.reshape(8, 8), lambda k: np.sqrt(0.125) if k == 0 else 0.5
    want = np.array([[sum(c(u) * c(v) * f[u, v] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) for y in range(8)] for x in range(8)])
    got = jpeg.pixels([image], coef)[part["base"]].reshape(8, 8)
    assert np.abs(got - np.clip(want + 128, 0, 255)).max() <= 0.6
    assert jpeg.tensor(image, jpeg.pixels([image], coef)).shape == (image.height, image.width, 3)


# --- Tokens ---------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark, awkward):
    t = Tokenizer.from_file(byte_vocabulary())
    d = small(spark).select("doc_id", "text").union(awkward.select("doc_id", "text"))
    want = sorted((r.doc_id, len((r.text or "").encode()), n := len(t.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in d.collect())
    assert sorted(map(tuple, tokencount.token_counts(d, byte_vocabulary).collect())) == want
    twice = d.union(d)
    assert sorted(map(tuple, tokencount.token_counts(twice, byte_vocabulary).collect())) == sorted(want + want)
    assert tokencount.token_counts(d.limit(0), byte_vocabulary).count() == 0


def test_sums_without_documents_fail():
    batch = tokencount._partial(5, [0, 1], [3, 4])
    owner = tokencount._partial(5, [], [], [10, 11], [1, 2])
    got = next(iter(tokencount._documents(iter([batch, owner]))))
    assert got.column(2).to_pylist() == [3, 4]
    with pytest.raises(RuntimeError, match="no documents"):
        list(tokencount._documents(iter([tokencount._partial(6, [0], [1]), owner])))


def test_encoding_equals_the_library(spark, awkward):
    t = Tokenizer.from_file(word_vocabulary())
    d = small(spark).select("doc_id", "text").union(awkward.select("doc_id", "text"))
    want = []
    for r in d.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_decode(d, word_vocabulary).collect())) == sorted(want)
    assert bpe.encode_decode(d.limit(0), word_vocabulary).count() == 0


def test_transducer_with_a_small_buffer_equals_merging_at_once():
    m = bpe.BpeModel(public_tokenizers.path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "the", "abcdefghijklmnopqrstuvwxyz", "a"):
        word = "".join(rng.choice(list(alphabet), 3000))
        symbols = [*word[:-1], word[-1] + m.suffix]
        assert list(m.transduce(symbols)) == m._merge(symbols)
    decoder = bpe.TextDecoder(m)
    ids = m.encode("Straße über 日本 ok")
    assert "".join(map(decoder.feed, ids)) + decoder.close() == "straße über 日本 ok "


def test_encoding_in_pieces_decodes_the_ids(spark, monkeypatch):
    t = Tokenizer.from_file(word_vocabulary())
    text = "One two  three\nfour\tfive<|endoftext|> six " * 40 + "x" * 700 + " end"
    monkeypatch.setattr(bpe, "PIECE", 50)
    m = bpe.BpeModel(word_vocabulary())
    ids = t.encode(text, add_special_tokens=False).ids
    assert m.encode(text) == ids and len(list(m.encode_runs(text))) > 20
    assert m.decode(ids) == t.decode(ids, skip_special_tokens=False) == " ".join(x for piece in m.encode_runs(text) for _, _, x in piece)
    # A wrong id is seen: the decoded text follows from ids, not from the encoder's tokens.
    m.token[ids[0]] = "?"
    assert m.decode(ids) != t.decode(ids, skip_special_tokens=False)


def test_letters_without_grams(spark):
    model = langid.LanguageModel(["aa", "bb"], np.ones((2, langid.KINDS)))
    got = langid.identify(spark.createDataFrame([(1, "ab"), (2, "é")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("aa", 0.5), ("aa", 0.5)]


# --- Mixing and sharding --------------------------------------------------------------------------


def filled(sizes, weights, total):
    target, open_ = {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        w = sum(weights[s] for s in open_)
        over = [s for s in open_ if left * weights[s] / w > 2 * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / w for s in open_}
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= set(over)
    return target


def test_mix(spark, awkward):
    for d in (small(spark), awkward):
        texts = d.select("doc_id", "text", "source").collect()
        sizes = Counter()
        for r in texts:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        names = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = filled(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()))
        got = mixing.mix(d).collect()
        assert len(got) == len(texts)
        taken = Counter()
        for r in got:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert 0 <= r.taken <= 2 * r.size and len(r.places) == r.takes
            taken[r.source] += r.taken
        for s in sizes:
            # Short by less than its longest text.
            assert 0 <= want[s] - taken[s] + 1e-6 and want[s] - taken[s] < max(1, max(r.size for r in got if r.source == s))
        assert rows(mixing.mix(d.repartition(5))) == rows(mixing.mix(d))
    assert mixing.mix(awkward.limit(0)).count() == 0


def test_room_beside_a_giant_text_is_filled(spark):
    # One text of half the source's words; where it does not fit, short ones of later blocks must.
    for giant, share in ((0, 0.3), (120, 0.3), (240, 1.3)):
        d = spark.range(600).selectExpr("id as doc_id", f"repeat('w ', case when id = {giant} then 9000 else 11 + id % 7 end) as text", "'a' as source")
        got = mixing.mix(d, weights=(1,), share=share).collect()
        left = got[0].target - sum(r.taken for r in got)
        assert len(got) == 600 and 0 <= left < min(r.size for r in got if r.takes == int(share))
        assert all(0 <= p.shard < 16 for r in got for p in r.places)


def test_rows_of_one_doc_id_or_none_are_mixed_to_target(spark):
    word = "case when id = 0 then 1 else 3 + id % 17 end"
    for ids in ("cast(null as long)", "cast(5 as long)", "if(id % 3 = 0, null, id % 4)"):
        d = spark.range(200).selectExpr(f"{ids} as doc_id", f"repeat('w ', cast({word} as int)) as text", "if(id % 5 = 0, 'a', null) as source")
        got = mixing.mix(d).collect()
        assert len(got) == 200
        for s in ("a", None):
            mine = [r for r in got if r.source == s]
            left = mine[0].target - sum(r.taken for r in mine)
            assert 0 <= left < 20  # within the longest text
        assert rows(mixing.mix(d.repartition(7))) == rows(mixing.mix(d))
    same = spark.range(500).selectExpr("cast(1 as long) as doc_id", "'one two three' as text", "'a' as source")
    got = mixing.mix(same, weights=(1,), share=0.5).collect()
    assert sum(r.taken for r in got) == 750 and rows(mixing.mix(same.repartition(9), weights=(1,), share=0.5)) == rows(mixing.mix(same, weights=(1,), share=0.5))


def test_split_quotas_are_exact(spark):
    totals = np.array([500, 400, 103])
    parts = mixing._drawn(np.array([1000, 3, 0]), totals, [1])
    assert parts.sum(axis=0).tolist() == [1000, 3, 0] and parts.sum(axis=1).tolist() == totals.tolist() and (parts >= 0).all()
    quota = [(f"s{i}" if i else None, (i * 7919) % 1000) for i in range(600)]
    out = {r.source: r.ends for r in mixing.splits(spark.createDataFrame(quota, "source string, quota long"), 8, 1).collect()}
    assert {s: e[-1] for s, e in out.items()} == dict(quota) and all(e == sorted(e) and len(e) == 8 for e in out.values())
    shards = np.diff(np.array([[0, *e] for e in out.values()]), axis=1).sum(axis=0)
    assert shards.max() - shards.min() <= 1


def test_split_draws_have_the_means_of_the_distribution():
    quotas, totals = np.array([600, 300, 100]), np.array([250, 250, 500])
    draws = np.array([mixing._drawn(quotas, totals, [s]) for s in range(400)])
    assert np.abs(draws.mean(axis=0) - np.outer(totals, quotas) / 1000).max() < 2.5 and draws.std(axis=0).min() > 1


def test_blocks_of_the_mix_are_disjoint_in_a_pass(spark):
    got = mixing.mix(small(spark)).collect()
    for s in {r.source for r in got}:
        places = [(p.shard, p.key) for r in got if r.source == s for p in r.places]
        assert len(places) == len(set(places)) == sum(r.takes for r in got if r.source == s)


def test_ring(spark, awkward):
    for d in (small(spark), awkward):
        got = sharding.ring_shards(d).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in d.collect())
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.shard].append(r.slot)
        counts = [len(by[g]) for g in range(8)]
        assert max(counts) - min(counts) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sharding.ring_shards(awkward.limit(0)).count() == 0


def ring_by_hand(positions, shards, cells, node_cells):
    """The shard of each row; rows are (cell, place) and walk the ring one after the other: own arcs fill a shard in the order of arcs, the rest goes on clockwise to the room left at the nodes."""
    arcs = sorted(node_cells)  # cell -> shard
    arc_of = lambda c: next((a for a in arcs if a >= c), arcs[0])
    n = len(positions)
    left = {s: n // shards + (s < n % shards) for s in range(shards)}
    queue = defaultdict(list)
    for i, (c, at) in enumerate(positions):
        queue[arc_of(c)].append((c <= arc_of(c), c, at, i))
    shard_of, over = {}, {}
    for a in arcs:
        rows = [x[-1] for x in sorted(queue[a])]
        take = min(len(rows), left[node_cells[a]])
        left[node_cells[a]] -= take
        shard_of |= {i: node_cells[a] for i in rows[:take]}
        over[a] = rows[take:]
    free = {}
    for s in range(shards):
        mine = [a for a in arcs if node_cells[a] == s]
        for k, a in enumerate(mine):
            free[a] = left[s] // len(mine) + (k < left[s] % len(mine))
    # Behind the arc where the fewest rows wait nobody is left over from the lap before.
    waits, so_far = {}, 0
    for a in arcs:
        so_far += len(over[a]) - free[a]
        waits[a] = so_far
    k = arcs.index(min(arcs, key=lambda a: (waits[a], a))) + 1
    line = []
    for a in arcs[k:] + arcs[:k]:
        line += over[a]
        served, line = line[: free[a]], line[free[a] :]
        shard_of |= {i: node_cells[a] for i in served}
    assert not line
    return [shard_of[i] for i in range(n)]


def test_ring_equals_a_walk_by_hand(spark):
    from pyspark.sql import functions as F

    shards, vnodes, cells = 3, 4, 64
    d = spark.range(301).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "cast(id % 50 as string) as text")
    at = F.xxhash64(F.lit("row"), F.col("doc_id").cast("long"), F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 1).cast("long"))
    rows = d.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"), at.alias("at"), F.pmod(at, F.lit(cells)).alias("c")).collect()
    nodes = {}
    for r in spark.range(shards).selectExpr("cast(id as int) as s", f"explode(sequence(0L, {vnodes - 1}L)) as i").select("s", F.pmod(F.xxhash64(F.lit("node"), "s", "i"), F.lit(cells)).alias("c")).collect():
        nodes[r.c] = min(nodes.get(r.c, shards), r.s)
    placed = ring_by_hand([(r.c, r["at"]) for r in rows], shards, cells, nodes)
    # Rows equal in doc_id and text are interchangeable.
    want = Counter((r.doc_id, r.crc, s) for r, s in zip(rows, placed))
    assert Counter((r.doc_id, r.text_crc32, r.shard) for r in sharding.ring_shards(d, shards=shards, vnodes=vnodes, cells=cells).collect()) == want


def test_one_more_shard_takes_its_share_and_moves_little_else(spark):
    from pyspark.sql import functions as F

    d = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    cells = d.select(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 14)).alias("cell"))
    before, after = ({r.cell: r.shard for r in sharding._ring(cells, n, 64, 1 << 14).collect()} for n in (8, 9))
    moved = [c for c in before if before[c] != after[c]]
    assert all(after[c] == 8 for c in moved) and 0.05 < len(moved) / len(before) < 0.2  # of the arcs alone: only to the new shard
    home, grown = ({r.doc_id: r.shard for r in sharding.ring_shards(d, shards=n).collect()} for n in (8, 9))
    moved = [i for i in home if home[i] != grown[i]]
    assert len(moved) < 0.16 * len(home) and sum(grown[i] != 8 for i in moved) < 0.04 * len(home)  # with bounded loads


def test_one_more_shard_and_hot_ids(spark):
    d = spark.range(9000).selectExpr("if(id < 3000, null, if(id < 6000, 1, id)) as doc_id", "if(id < 1500, null, cast(id as string)) as text")
    for n in (8, 9):
        got = sharding.ring_shards(d, shards=n).collect()
        assert sorted((r.shard, r.slot) for r in got) == [(g, i) for g in range(n) for i in range(9000 // n + (g < 9000 % n))]


def test_few_rows_leave_their_own_arc(spark):
    d = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    home = {r.doc_id: r.shard for r in sharding.ring_shards(d, vnodes=64).collect()}
    more = {r.doc_id: r.shard for r in sharding.ring_shards(d.union(spark.range(20_000, 20_400).selectExpr("id as doc_id", "'x' as text")), vnodes=64).collect()}
    assert sum(home[i] != more[i] for i in home) < 0.1 * len(home)
