"""Operators on texts against brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from compare import rows

from schemaloom.llm import bpe, katz, line_dedup, mixing, packing, quality_classifier, quality_rules, queries, simhash, suffix_dedup, tiff, token_counts


def docs(spark, given):
    return spark.createDataFrame(given, "doc_id long, text string")


def words(rng, n, vocabulary=60):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(n))


# -- 1 and 4: against SQL ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, duck, data, name):
    assert rows(queries.QUERIES[name](spark, data).toPandas()) == rows(duck.sql(queries.ORACLES[name]).df())


def test_repeated_windows():
    def brute(text):
        w = text.split()
        seen = {}
        for i in range(len(w) - 2):
            seen.setdefault(tuple(w[i : i + 3]), []).append(i)
        return len({j for at in seen.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)})

    assert brute("a b c a b c a") == 7  # the reference for the SQL and the rules below
    assert brute("a b c d a b c") == 6


def test_policies_and_ablations_use_the_ledger_alone(spark):
    texts = ["one two three " * 40, "short", " ".join(f"word{i}" for i in range(80)), " ".join(f"word{i}###" for i in range(80))]
    found = quality_rules.ledger(docs(spark, list(enumerate(texts)))).cache()
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.apply_policy(found).collect()}
    assert kept == {0: (True, False), 1: (True, False), 2: (False, True), 3: (False, False)}
    assert {r.doc_id: r.kept for r in quality_rules.apply_policy(found, "base").collect()}[3]
    table = {r.rule: (r.failing, r.failing_alone, r.kept_without) for r in quality_rules.ablations(found).collect()}
    assert table["symbols"] == (1, 1, 2) and table["few_words"] == (1, 1, 2)


def test_rules_run_no_python(spark):
    plan = quality_rules.quality_rules(docs(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rates_are_means(spark):
    df = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 4 = 0, 'rare', 'often') AS source", "'t' AS text")
    got = dict(mixing.mix(df, mixing.weighted(df, {"rare": 1.0, "often": 1.0}, 1.5)).groupBy("source").count().collect())
    assert abs(got["rare"] / 15_000 - 1) < 0.05 and abs(got["often"] / 15_000 - 1) < 0.05
    big = mixing.mix(df.limit(400), df.limit(0).selectExpr("source", "1.0D AS rate").union(spark.sql("SELECT 'often' AS source, 40.0D AS rate")))
    assert abs(big.count() / (40 * 300) - 1) < 0.05
    salted = mixing.mix(df, mixing.tempered(df), broadcast_rows=0)
    assert sorted(salted.collect()) == sorted(mixing.mix(df, mixing.tempered(df)).collect())


# -- 2 and 7: tokens -----------------------------------------------------------------------------------------------


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(queries.tokenizer()).encode_batch(texts, add_special_tokens=False)]


def parity(n):
    """Words of n letters that alternate by the parity of the bits of their place: they and their complements collide under any polynomial hash modulo 2^64."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


def test_ids_are_those_of_the_library():
    rng = random.Random(3)
    alphabet = "abcdeéÉ'stldrevm 12.,!\n\t日Σσςʼ́ẛ𝟘🎉 \x1f\x85ǅİ"
    texts = ["", "it's 'twas I'll we've'd 're's '' 's' don't''s", "aaaaaaa aaaa", "<|endoftext|> x", "x" * 2000, "!!!'s ?'re ''''s", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(800))]
    ids, sizes = bpe.load(queries.tokenizer()).encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == library(texts)


def test_packing_holds_every_token_once(spark):
    rng = random.Random(5)
    given = [(i, words(rng, rng.choice([0, 3, 200, 700, 1500, 6000]), 500)) for i in range(60)]
    pieces = packing.digests(packing.pack(docs(spark, given).repartition(2), queries.tokenizer())).collect()
    ids = {d: [*x, 2] for (d, _), x in zip(given, library([t for _, t in given]), strict=True)}
    by_doc, by_window = {}, {}
    for p in pieces:
        part = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(part.tobytes()) and p.doc_tokens == len(ids[p.doc_id])
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length))
        by_window.setdefault(p.sequence_id, []).append((p.offset, p.length, p.tier))
    for group, total in [(sorted(v), len(ids[k])) for k, v in by_doc.items()] + [(sorted((o, n) for o, n, _ in v), v[0][2]) for v in by_window.values()]:
        ends = np.cumsum([n for _, n in group])
        assert [s for s, _ in group] == [0, *ends[:-1]] and ends[-1] == total
    assert by_doc.keys() == ids.keys() and all(t & (t - 1) == 0 and t <= 4096 for v in by_window.values() for _, _, t in v)


def test_edits_of_a_tree_equal_a_new_count():
    rng, count = random.Random(6), token_counts.counter(queries.tokenizer())
    for _ in range(150):
        text = "".join(rng.choice("ab c'sd  é\n12!? ") for _ in range(rng.randrange(60)))
        tree = token_counts.TokenTree.of(text, count)
        for _ in range(rng.randrange(1, 6)):
            at, removed, new = rng.randrange(-1, 70), rng.randrange(12), "".join(rng.choice("xy 's!\n") for _ in range(rng.randrange(6)))
            place = min(max(at, 0), len(text))
            text = text[:place] + new + text[min(place + removed, len(text)) :]
            tree.edit(at, removed, new, count)
            assert tree.text() == text and tree.total == count([text])[0]


def test_an_edit_encodes_its_surroundings_only(spark):
    text = words(random.Random(1), 20_000) + " me@example.org " + words(random.Random(2), 20_000)
    (row,) = token_counts.token_counts(docs(spark, [(1, text)]), queries.tokenizer(), token_counts.cleaning_edits).collect()
    edited = text.replace("me@example.org", "[masked]")
    assert (row.n_edits, row.n_edited_tokens) == (1, len(library([edited])[0])) and row.n_encoded_chars < 60


def test_the_queries_count_as_the_library(spark, data):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, data, "documents").collect()}
    ids = dict(zip(texts, library([*texts.values()]), strict=True))
    counted = {r.doc_id: r for r in queries.op7_token_counts(spark, data).collect()}
    assert {d: r.n_tokens for d, r in counted.items()} == {d: len(x) for d, x in ids.items()}

    def edited(text):
        for at, n, new in token_counts.cleaning_edits(text):
            text = text[:at] + new + text[at + n :]
        return text

    changed = [d for d, r in counted.items() if r.n_edits]
    assert changed and [counted[d].n_edited_tokens for d in changed] == [len(x) for x in library([edited(texts[d]) for d in changed])]
    assert token_counts.cleaning_edits("a line of twenty signs\na line of twenty signs") == [(23, 23, "")]
    collide = docs(spark, list(enumerate([*parity(512), *parity(256), "x <|endoftext|> y"]))).coalesce(1)
    want = library([r.text for r in collide.collect()])
    assert [r.n_tokens for r in token_counts.token_counts(collide, queries.tokenizer()).collect()] == [len(x) for x in want]
    for r in packing.digests(packing.pack(collide, queries.tokenizer())).collect():
        part = np.array([*want[r.doc_id], 2][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())


# -- 3: lines ------------------------------------------------------------------------------------------------------


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[p:] == b[p + 1 :] or len(a) == len(b) and a[p + 1 :] == b[p + 1 :])


@pytest.mark.parametrize("seed", [1, 2])
def test_lines(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abc é") for _ in range(rng.choice([1, 2, 5, 6, 7, 12, 26, 30, 60, 150, 300]))) for _ in range(34)]

    def changed(line):
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(line) + 1)
            line = rng.choice([line[:i] + line[i + 1 :], line[:i] + rng.choice("abx") + line[i:], line[:i] + "x" + line[i + 1 :]])
        return line

    given = [(i, "\n".join(changed(rng.choice(pool)) for _ in range(rng.randrange(6)))) for i in range(60)]
    gone, seen = {}, []
    for d, t in given:
        for pos, line in enumerate(t.split("\n")):
            if line.strip(" "):
                if line in seen or len(line.strip(" ")) >= 5 and any(within_one(line, s) for s in seen if len(s.strip(" ")) >= 5):
                    gone.setdefault(d, set()).add(pos)
                seen.append(line)
    want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone.get(d, ())) for d, t in given}
    got = line_dedup.dedup_lines(docs(spark, given), min_chars=5, removed="n").collect()
    assert {r.doc_id: r.text for r in got} == want and {r.doc_id: r.n for r in got if r.n} == {d: len(g) for d, g in gone.items()}


# -- 5: TIFF -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("tile, predictor, order", [(0, 1, "<"), (0, 2, ">"), (16, 2, "<"), (64, 1, ">")])
def test_tiff_round_trip(compression, tile, predictor, order):
    rng = random.Random(compression + tile)
    for payload in (b"hello hello " * 16 * 40, rng.randbytes(192 * 9), bytes(192), bytes(rng.choice(b"ab \n") for _ in range(192 * 70))):
        data = tiff.encode(payload, compression, predictor, tile, 13, order)
        found = list(tiff.pages(data))
        assert b"".join(p.pixels.tobytes() for p in found) == payload and len(found) == -(-len(payload) // (192 * 13))


def test_pages_as_rows_and_damaged_files(spark):
    good = tiff.encode(b"x" * 192 * 30, page_rows=10)
    loop = bytearray(good)
    loop[-4:] = good[4:8]
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:300])), (3, bytearray(b"no")), (4, None), (5, loop)], "doc_id long, media binary")
    got = tiff.read(df).collect()
    assert [r.page for r in got if r.doc_id == 1] == [0, 1, 2] and b"".join(r.pixels for r in got if r.doc_id == 1) == b"x" * 192 * 30
    assert {r.doc_id for r in got if r.error} == {2, 3, 4, 5}


def codes(values):
    """LZW codes of nine bits, the highest bit first."""
    bits = "".join(f"{v:09b}" for v in values)
    return bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8))


def image(compression, stored, width, height, **claims):
    """A file of one strip, written field by field."""
    tags = {256: width, 257: height, 258: 8, 259: compression, 262: 1, 273: 8, 277: 1, 278: height, 279: len(stored), **claims}
    body = struct.pack("<2sHI", b"II", 42, 8 + len(stored)) + stored + struct.pack("<H", len(tags))
    return body + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items())) + struct.pack("<I", 0)


def test_known_bytes_of_each_compression():
    runs = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    (page,) = tiff.pages(image(tiff.PACKBITS, runs, 24, 1))
    assert page.pixels.tobytes() == plain
    (page,) = tiff.pages(image(tiff.LZW, codes([256, 7, 258, 8, 8, 258, 6, 6, 257]), 9, 1))
    assert page.pixels.tobytes() == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    (page,) = tiff.pages(image(tiff.DEFLATE, zlib.compress(plain), 12, 2))
    assert page.pixels.tobytes() == plain and (page.width, page.height) == (12, 2)
    (page,) = tiff.pages(image(tiff.NONE, bytes([5, 1, 1, 255]), 4, 1, **{}))
    assert page.pixels.tobytes() == bytes([5, 1, 1, 255])


def test_a_small_file_that_claims_a_large_image(spark):
    files = [image(tiff.DEFLATE, zlib.compress(b"x"), 2_000_000, 2_000_000), image(tiff.LZW, codes([256, 7, 257]), 2_000_000, 2_000_000)]
    got = tiff.read(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "doc_id long, media binary")).collect()
    assert len(got) == 2 and all("more samples" in r.error for r in got)


def test_the_query_stores_whole_texts(spark, data):
    got = {r.doc_id: r for r in queries.op5_tiff_pages(spark, data).collect()}
    for r in queries.table(spark, data, "documents").collect():
        raw = (r.text or "").encode()
        full = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-16:]))


# -- 6: classifier -------------------------------------------------------------------------------------------------


def test_trees_equal_a_walk_of_each_row():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < 0)).astype(float)
    model = quality_classifier.fit(x, y, rounds=25)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.95

    def walk(row):
        total = model.base
        for f, t, v in zip(model.feature, model.threshold, model.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + (row[f[node]] > t[node])
            total += v[node - len(f)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose([walk(r) for r in x[:50]], model.score(x[:50]))


def test_held_out_accuracy(spark, data):
    got = queries.QUERIES["op6_quality_classifier"](spark, data.replace("sf0.001", "sf0.01")).toPandas()
    truth = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/labels.parquet").toPandas()
    both = got[got.held_out].merge(truth, on="doc_id")
    assert all(zlib.crc32(str(d).encode()) % 3 == 1 for d in both.doc_id) and (both.predicted == both.quality).mean() > 0.95


# -- 8: SimHash ----------------------------------------------------------------------------------------------------


def test_components(spark):
    import xxhash

    rng = random.Random(8)
    base = [words(rng, 120, 4000) for _ in range(12)]
    given = []
    for i in range(300):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
        given.append((i * 3 % 301, " ".join(w)))
    given += [(900, "a"), (901, ""), (902, "A B\tC"), (903, "a b c")]

    def slow(text):
        w = text.encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {d: slow(t) for d, t in given}
    ids = sorted(fps)
    label = {d: d for d in ids}
    while True:
        new = {d: min(label[e] for e in ids if (fps[d] ^ fps[e]).bit_count() <= 4) for d in ids}
        if new == label:
            break
        label = new
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(docs(spark, given)).collect()}
    assert got == {d: (fps[d], label[d]) for d in ids}


def test_buckets_in_blocks_lose_no_link(spark):
    rng = np.random.default_rng(2)
    center = rng.integers(0, 1 << 62, 3)
    fps = np.unique([int(c) ^ (1 << int(a)) ^ (1 << int(b)) for c in center for a, b in rng.integers(0, 62, (80, 2))])
    nodes = spark.createDataFrame([(int(f),) for f in fps], "fp long")

    def groups(block):
        found = simhash.connected_components(simhash.links(nodes, block=block)).collect()
        return sorted((r.node, r.root) for r in found)

    assert groups(4) == groups(10_000) and len({r for _, r in groups(4)}) == 3


@pytest.mark.parametrize("block", [4, 30, 4096])
def test_large_buckets_lose_no_link(spark, block):
    """Near copies of a few fingerprints, so that buckets are dense, and buckets beyond the block are split."""
    rng = random.Random(block)
    seeds = [rng.getrandbits(64) for _ in range(4)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 6]))) for s in seeds for _ in range(60)})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(nodes, 4, 3, block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    mine = {f: f for f in fps}

    def least(x):
        while mine[x] != x:
            x = mine[x]
        return x

    for a, b in found:
        mine[least(a)] = least(b)
    groups = lambda f: {frozenset(x for x in fps if f(x) == r) for r in map(f, fps)}
    assert groups(least) == groups(find)


# -- 9: passages ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [text(rng.choice([30, 49, 50, 51, 60, 100, 200])) for _ in range(12)]
    given = []
    for i in range(120):
        parts = [rng.choice([text(rng.randrange(120)), rng.choice(shared), rng.choice(shared)[: rng.randrange(20, 200)], "a" * rng.randrange(150), "xyz " * rng.randrange(40)]) for _ in range(rng.randrange(5))]
        given.append((rng.randrange(110) if i % 20 else None, "".join(parts)))
    given += [given[3], (1000, None), (2000, given[8][1])]
    got = suffix_dedup.digests(suffix_dedup.dedup_passages(docs(spark, given).repartition(3), chunk=2000)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, suffix_dedup.brute_force(given)))


def test_passages_of_the_tables(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = suffix_dedup.digests(suffix_dedup.dedup_passages(df)).collect()
    assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force([(r.doc_id, r.text) for r in df.collect()]))


# -- 10: language model --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("chunk", "part", "order"), [(2000, 40, 3), (katz.CHUNK, katz.PART, 3), (1500, 300, 2), (2000, 60, 4)])
def test_scores(spark, chunk, part, order):
    """Small parts make common words hot: these are dealt with their successors."""
    rng = random.Random(chunk)
    given = [(i, words(rng, rng.randrange(60))) for i in range(150)] + [(None, "w1 w2"), (500, None), (5, "W1  w1\tw3\x0b")]
    got = katz.score(docs(spark, given).repartition(3), order, chunk=chunk, part=part).collect()
    brute = katz.brute_force(given, order)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:4])
    want = sorted([(d, *s) for (d, _), s in zip(given, brute["scores"], strict=True)], key=key)
    mine = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=key)
    for g, w in zip(mine, want, strict=True):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], abs=1e-6)
    for h in brute["histories"][:200]:
        total = sum(brute["probability"](h, w) for w in brute["words"]) + brute["probability"](h, "never seen")
        assert total == pytest.approx(1, abs=1e-9)


def test_scores_beat_the_base_on_held_out_texts(spark, data):
    got = queries.QUERIES["op10_katz"](spark, data.replace("sf0.001", "sf0.01")).toPandas()
    held = got[got.held_out]
    assert held.score.sum() / held.n_tokens.sum() > held.base_score.sum() / held.n_tokens.sum() + 0.2
