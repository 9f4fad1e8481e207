"""The training-data operators against brute force, round trips and edge cases."""

import base64
import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import bpe, line_dedup, ngram_jaccard, packing, pii, quality, queries, sharding, substring_dedup, tiff, toxicity

FOLDER = "/root/testdata/sf0.001"
SPACE = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, _id string"


def words(t):
    return [x for x in re.split(SPACE, t or "") if x]


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "one"), (3, "one"), (None, "a b c d e f g"), (4, "a b c d e f g"), (5, " \t\n "), (6, "x" * 50_000), (7, "w " * 3000), (8, "é日🙂 " * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return dict(docs.select("doc_id", "text").collect())


def test_all_take_odd_rows_and_empty_tables(spark):
    path = queries.vocabulary("byte_bpe_50k.json")
    runs = [lambda d: sharding.kd_shards(d, 3), lambda d: packing.pack_best_fit(d, path), lambda d: tiff.media_digests(tiff.store_texts(d)), ngram_jaccard.jaccard_components, lambda d: bpe.bpe_round_trip(d, path), pii.find_personal_data, quality.quality_lines, line_dedup.dedup_lines, substring_dedup.dedup_substrings, lambda d: toxicity.score_toxicity(d, toxicity.Model({b"bad": 3.0}, [1.0, 2.0, 3.0]))]
    for run in runs:
        rows = run(make(spark, ODD)).collect()
        name = "doc_id" if "doc_id" in rows[0].__fields__ else "_id"
        assert collections.Counter(r[name] for r in rows if "piece" not in r.__fields__ or r["piece"] == 0) == collections.Counter(i for i, _ in ODD)
        assert run(make(spark, [])).count() == 0
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(make(spark, ODD)).collect()}
    assert got[1] == got[2] == got[5] == (0, 0, "") and got[3] == (1, 0, "one") and got[6][0] == 1 and got[7][:2] == (3000, 2999)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(make(spark, ODD)).collect()}
    assert got[1] == (0, 1) and got[5] == (0, 5) and got[4] == (3, 4) and got[None] == (3, 4) and got[3] == (1, 3) and got[7] == (1, 7)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(make(spark, ODD)).collect()}
    assert got[1] == got[2] == (1, 0) and got[5] == (2, 0) and got[4] == (1, 0) and got[None] == (1, 1)
    got = {r["doc_id"]: (r["n_words"], r["base_failed"]) for r in quality.quality_lines(make(spark, ODD)).collect()}
    assert got[1] == got[5] == (0, True) and got[7] == (3000, True)


def test_row_keeping_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows and ids, and no rows, in the forms that return documents."""
    good = "\n".join(" ".join(f"word{k}x{j}" for k in range(12)) for j in range(8))
    odd = [*ODD, (8, good), (8, good), (None, good + " end"), (9, "mail x.y@z.example.com now"), (9, "mail x.y@z.example.com now")]
    docs, none = make(spark, odd), make(spark, [])
    for run in (quality.clean_documents, pii.redact_documents, line_dedup.dedup_documents, ngram_jaccard.keep_one):
        assert run(none).count() == 0 and run(docs).columns == docs.columns
    pairs = lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.collect())
    assert pairs(quality.clean_documents(docs)) == {(8, good): 2, (None, good + " end"): 1}
    got = pairs(pii.redact_documents(docs))
    assert got == pairs(make(spark, [*odd[:-2], (9, "mail <EMAIL> now"), (9, "mail <EMAIL> now")]))
    got = line_dedup.dedup_documents(docs)
    assert got.count() == len(odd) and got.where("doc_id is null and text = ''").count() == 1 and got.where("text is null").count() == 1
    kept = pairs(ngram_jaccard.keep_one(docs))
    assert kept[(3, "one")] == 1 and kept[(8, good)] == 1 and (None, good + " end") not in kept and kept[(1, None)] == 1


def test_kd_shards(docs, texts):
    rows = sharding.kd_shards(docs, 6).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sums, slots = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        t = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(t) + 8, zlib.crc32(t))
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(sums.values()) - min(sums.values()) <= 0.1 * sum(sums.values()) / 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_equal_texts_share_a_shard(spark, docs):
    rows = [(i, t) for i, (t,) in enumerate(docs.select("text").limit(150).collect())]
    rows += [(1000 + i, rows[i % 40][1]) for i in range(80)] + [(5000 + i, rows[0][1][:200]) for i in range(200)]
    got = sharding.kd_shards(make(spark, rows), 4).collect()
    assert len(got) == len(rows)
    texts, held = dict(rows), collections.defaultdict(collections.Counter)
    for r in got:
        held[texts[r["doc_id"]]][r["shard"]] += 1
    total = sum(r["size"] for r in got)
    assert all(len(c) == 1 or sum(c.values()) * (len(t.encode()) + 8) > total / 4 for t, c in held.items())
    assert any(len(c) == 1 and sum(c.values()) == 200 for c in held.values())


def test_only_a_group_beyond_a_shard_is_parted(spark):
    """A group of half of all bytes fills several shards; all others are whole, and the sums are level."""
    rows = [(i, f"text {i} " + "z" * (i % 97)) for i in range(600)] + [(10_000 + i, "same words again and again") for i in range(1500)] + [(20_000 + i, "") for i in range(300)]
    got = sharding.kd_shards(make(spark, rows), 6).collect()
    texts, held, sums = dict(rows), collections.defaultdict(set), collections.Counter()
    for r in got:
        held[texts[r["doc_id"]]].add(r["shard"])
        sums[r["shard"]] += r["size"]
    assert [t for t, s in held.items() if len(s) > 1] == ["same words again and again"]
    assert len(sums) == 6 and max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values()) / 6 + 300 * 8


@pytest.mark.parametrize("constant", [0, 1])
def test_either_half_of_a_print_tells_lines_apart(spark, monkeypatch, constant):
    """Lines and rows of one id stay apart when one of the two hashes is the same for all."""
    rows = [(i, f"line number {i} alone\nshared by every text") for i in range(20)] + [(3, "other text of this id\nline number 4 alone")]
    want = sorted((r["doc_id"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(make(spark, rows)).collect())
    real = line_dedup.prints
    monkeypatch.setattr(line_dedup, "prints", lambda v: tuple(F.lit(7).cast("long") if k == constant else p for k, p in enumerate(real(v))))
    assert sorted((r["doc_id"], r["n_dropped"], r["kept"]) for r in line_dedup.dedup_lines(make(spark, rows)).collect()) == want
    assert sum(n for _, n, _ in want) == 19 + 1


def test_jaccard_components(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(docs).collect()}
    sets = {}
    for i, t in texts.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    top = components_of(sets)
    assert got == {i: (len(s), top[i]) for i, s in sets.items()}


def test_keep_one_decides_per_row(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    near = text(1) + " more"
    rows = [(1, text(1)), (2, near), (None, text(1) + " end"), (None, text(2)), (None, text(3)), (None, text(3)), (None, text(3) + " tail"), (4, near), (4, text(4)), (4, text(4)), (5, text(5)), (5, text(6)), (3, text(6) + " tail"), (6, None), (6, ""), (7, ""), (None, None), (None, None)]
    clashing = make(spark, rows).withColumnsRenamed({"lang": "_row", "source": "_kept", "shard": "component_id", "n_chars": "_other"})
    got = ngram_jaccard.keep_one(clashing)
    assert got.columns == clashing.columns and {r["component_id"] for r in got.collect()} == {"x"}
    assert ngram_jaccard.keep_one(clashing.where("doc_id = 2")).columns == clashing.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert got.pop((None, text(3)), 0) + got.pop((None, text(3) + " tail"), 0) == 1
    want = [(1, text(1)), (None, text(2)), (4, text(4)), (5, text(5)), (3, text(6) + " tail"), (6, None), (6, ""), (7, ""), (None, None)]
    assert got == collections.Counter(want)


def keys_of(scheme, *sets):
    """Keys and tier of each set."""
    k, owner, tier = scheme.keys(np.concatenate(sets), np.array([len(s) for s in sets]))
    return [k[owner == i] for i in range(len(sets))], tier.tolist()


def test_universe_partition_loses_no_pair():
    rnd, tiers = np.random.default_rng(1), collections.Counter()
    for recurring, common in ((0.0, 0), (0.3, 30), (0.6, 55), (0.6, 75), (0.9, 95)):
        for n in (1, 3, 5, 9, 17, 40, 130, 700):
            for _ in range(40):
                a = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
                keep = a[rnd.random(len(a)) < 0.9]
                b = np.unique(np.concatenate((keep, rnd.integers(0, 1 << 63, max(0, n // 12)).astype(np.uint64))))
                scheme = ngram_jaccard.Scheme(75, 100, np.sort(rnd.permutation(a)[: len(a) * common // 100]), recurring)
                both = len(np.intersect1d(a, b))
                if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
                    (ka, kb), tier = keys_of(scheme, a, b)
                    tiers[max(tier)] += 1
                    assert len(np.intersect1d(ka, kb))
                    assert ngram_jaccard.apart(ngram_jaccard.sketch(a), ngram_jaccard.sketch(b)) <= len(a) + len(b) - 2 * both
    assert min(tiers[0], tiers[1], tiers[2]) > 50


@pytest.mark.parametrize(("n", "m"), [(6, 8), (12, 16), (15, 20)])
def test_a_set_meets_the_next_band(n, m):
    rnd = np.random.default_rng(n)
    scheme = ngram_jaccard.Scheme(75, 100, np.empty(0, np.uint64), 0.0)
    for _ in range(3000):
        b = rnd.integers(0, 1 << 63, m).astype(np.uint64)
        (ka, kb), _ = keys_of(scheme, np.sort(b[:n]), np.sort(b))
        assert len(np.intersect1d(ka, kb))


def components_of(sets):
    """The smallest id that links of similarity 0.75 reach, by comparing all sets."""
    least, held = {i: i for i in sets}, collections.defaultdict(list)

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in sorted(sets):
        for j, n in collections.Counter(j for x in sets[i] for j in held[x]).items():
            if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                least[max(a, b)] = min(a, b)
        for x in sets[i]:
            held[x].append(i)
    return {i: top(i) for i in sets}


def test_large_groups_of_near_copies(spark, monkeypatch):
    """Thousands of near copies of three texts that share a passage, with outsiders; blocks smaller than the groups."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 256)
    rnd = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for i in range(2500):
        w = [*passage, *(f"b{i % 3}x{k}" for k in range(80))]
        for _ in range(rnd.choice((0, 1, 2, 3, 5, 9, 30))):
            w[rnd.randrange(len(w))] = f"r{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.jaccard_components(make(spark, rows)).collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    assert got == components_of(sets)


def test_one_deletion_neighbourhoods_are_used(docs):
    """On the test documents some sets take allowance 1, and the neighbourhoods are among their keys."""
    raw = [t.encode() for (t,) in docs.select("text").where("text is not null").distinct().collect()]
    sets = [s for s in ngram_jaccard.shingle_sets(raw, 5) if len(s)]
    token, k = np.unique(np.concatenate(sets), return_counts=True)
    scheme = ngram_jaccard.Scheme(75, 100, token[k >= 3], 0.1)
    keys, tier = keys_of(scheme, *sets)
    assert 1 in tier
    i = tier.index(1)
    full = ngram_jaccard.Scheme(75, 100, np.empty(0, np.uint64), 0.1)
    assert len(keys[i]) > len(keys_of(full, sets[i])[0][0])


def test_substring_dedup(docs, texts):
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substring_dedup.dedup_substrings(docs).collect()}
    seen = set()
    for i in sorted(texts):
        w = words(texts[i])
        gone = [0] * len(w)
        for k in range(len(w) - 19):
            t = tuple(w[k : k + 20])
            if t in seen:
                gone[k : k + 20] = [1] * 20
            seen.add(t)
        assert got[i] == (sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y))


def test_line_dedup(spark, docs, texts):
    got = {r["doc_id"]: r["kept"] for r in line_dedup.dedup_lines(docs).collect()}
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            held[key(line)].add(i)
    gone = lambda i, s: len(key(s)) >= 10 and len(held[key(s)]) > 1 and min(held[key(s)]) < i
    assert got == {i: "\n".join(s for s in t.split("\n") if not gone(i, s)) for i, t in texts.items()}
    kept = line_dedup.dedup_documents(docs)
    assert kept.columns == docs.columns
    assert kept.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()


def test_bpe_equals_tiktoken(docs, texts):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.ByteBPE(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    rnd = random.Random(7)
    parts = ["a", "B", " ", "  ", "\n", "\t", "'s", "1", "!", "é", "日本", "\u0085", "🙂", "\x1c", "word"]
    some = [*texts.values(), *("".join(rnd.choices(parts, k=rnd.randint(0, 25))) for _ in range(3000))]
    for t, ids in zip(some, mine.encode_all(some), strict=True):
        assert ids.tolist() == other.encode_ordinary(t)
        assert mine.decode(ids) == t.encode()
    ids = mine.encode("é日🙂x")
    at = mine.offsets("é日🙂x".encode(), ids)
    assert at[0, 0] == 0 and at[-1].tolist() == [3, 4] and mine.decode_text(ids[:-1]).startswith("é日")


def test_bpe_equals_tokenizers(texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    other, mine = Tokenizer.from_file(path), bpe.ByteBPE(path)
    assert mine.encode("<|endoftext|>").tolist() == other.encode("<|endoftext|>", add_special_tokens=False).ids
    marks = [t.content for t in other.get_added_tokens_decoder().values()]
    assert mine.encode("see \u00a0 \u00a0 here").tolist() == [3826, 11504, 994]
    rnd = random.Random(8)
    white = [*"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\u0085\u00a0\u1680\u180e\u2007\u200a\u200b\u2028\u2029\u202f\u205f\u3000"]
    some = [*texts.values()]
    for k in range(6000):
        parts = ["a", "word", "'s", "1", "!", "é", "日本", " ", " ", " ", "  ", "\u00a0", *marks[:3], *rnd.choices(white, k=1 + k % 4)]
        some.append("".join(rnd.choices(parts, k=rnd.randint(0, 25))))
    for t, ids in zip(some, mine.encode_all(some), strict=True):
        assert ids.tolist() == other.encode(t, add_special_tokens=False).ids


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    rows = packing.pack_best_fit(docs, path).collect()
    library, pieces = Tokenizer.from_file(path), collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    for i, t in texts.items():
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want, at = [], 0
        while at < len(ids):
            n = (len(ids) - 1) % 1024 + 1 if not at else 1024
            want.append((len(want), at, n, zlib.crc32(struct.pack(f"<{n}I", *ids[at : at + n]))))
            at += n
        assert sorted(pieces[i]) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert {r["doc_id"] for r in rows} == set(texts)
    assert len(bins) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1
    rnd = random.Random(3)
    for _ in range(200):
        counts = collections.Counter(rnd.randint(1, 60) for _ in range(rnd.randint(0, 80)))
        used = collections.Counter()
        for lengths, n in packing.plan(counts, 60):
            assert n > 0 and sum(lengths) <= 60 and sum(3 * x > 60 for x in lengths) <= 2
            for x in lengths:
                used[x] += n
        assert used == counts


def test_tiff_round_trips():
    rnd = np.random.default_rng(5)
    for how in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for shape in ((5, 7), (33, 20, 3), (1, 1), (200, 90)):
            for predictor in (1, 2):
                for kind in (np.uint8, np.uint16):
                    for more in ({}, {"rows_per_strip": 4}, {"tile": (16, 16)}, {"order": ">"}):
                        pages = [(rnd.integers(0, 7, shape) ** 3).astype(kind), rnd.integers(0, 255, shape).astype(kind)]
                        got = [p for p, _ in tiff.read_pages(tiff.write_tiff(pages, how, predictor, **more))]
                        assert all((g.reshape(p.shape) == p).all() for g, p in zip(got, pages, strict=True))


def retagged(data, page, **tags):
    """A little-endian TIFF with other single values of some tags of one page."""
    out, at = bytearray(data), struct.unpack_from("<I", data, 4)[0]
    for _ in range(page):
        at = struct.unpack_from("<I", out, at + 2 + 12 * struct.unpack_from("<H", out, at)[0])[0]
    for k in range(struct.unpack_from("<H", out, at)[0]):
        here = at + 2 + 12 * k
        for name, (kind, value) in tags.items():
            if struct.unpack_from("<H", out, here)[0] == getattr(tiff, name):
                struct.pack_into("<HII", out, here + 2, kind, 1, value)
    return bytes(out)


def test_tiff_small_samples_and_floats():
    rnd = np.random.default_rng(6)
    for bits in (1, 2, 4):
        page = rnd.integers(0, 1 << bits, (9, 13)).astype(np.uint8)
        packed = np.packbits([[int(b) for x in row for b in f"{x:0{bits}b}"] for row in page], axis=1)
        for how in (tiff.NONE, tiff.DEFLATE, tiff.PACKBITS):
            ((got, _),) = tiff.read_pages(retagged(tiff.write_tiff([packed], how, rows_per_strip=4), 0, WIDTH=(4, 13), BITS=(3, bits)))
            assert (got[:, :, 0] == page).all()
    page = rnd.normal(size=(5, 7)).astype(np.float32)
    planes = np.concatenate([page.astype(">f4").view(np.uint8).reshape(5, 7, 4)[:, :, k] for k in range(4)], axis=1)
    coded = tiff.write_tiff([planes], tiff.DEFLATE, 2)
    coded = retagged(coded, 0, WIDTH=(4, 7), BITS=(3, 32), PREDICTOR=(3, 3), PHOTOMETRIC=(3, 1), PLANAR=(3, 1))
    tags = next(tiff._directories(coded))[0] | {tiff.SAMPLE_FORMAT: (3,)}
    assert (tiff._page(coded, tags, "<")[:, :, 0] == page).all()


def test_tiff_goes_on_after_a_bad_page():
    pages = [np.full((2, 3), k, np.uint8) for k in range(4)]
    for bad in ({"COMPRESSION": (3, 99)}, {"BITS": (3, 7)}, {"STRIP_OFFSETS": (12, 1 << 30)}):
        rows = list(tiff._rows(1, retagged(tiff.write_tiff(pages), 1, **bad)))
        assert [r[1] for r in rows] == [0, 1, 2, 3] and [r[7] is None for r in rows] == [True, False, True, True]
        assert [r[5] for r in rows if r[7] is None] == [pages[k].tobytes() for k in (0, 2, 3)]


def test_tiff_digests(spark, docs, texts):
    for r in queries.op4_tiff_media(spark, FOLDER).collect():
        t = texts[r["doc_id"]].encode()
        t += b"\0" * (-len(t) % 64 if t else 64)
        assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(t).hexdigest(), zlib.crc32(t[-64:]), len(t))
        media = tiff.write_tiff([np.frombuffer(t, np.uint8).reshape(-1, 64)], tiff.DEFLATE, 2, 1024, level=1)
        samples = np.frombuffer(t, np.uint8)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        assert f"mean={samples.mean():.3f};dev={samples.std():.3f};" in r["feature"]
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "_id long, media binary")
    assert tiff.tiff_pages(bad).where("error is not null").count() == 2


def test_personal_data(docs):
    text = 'mail a.b@c.example.com, ip 10.0.0.255 not 10.0.0.256, card 4111 1111 1111 1111, +1 (017) 555-7713. token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    assert [text[a:b] for a, b, _ in pii.base_spans(text)] == ["a.b@c.example.com", "10.0.0.255", "4111 1111 1111 1111", "+1 (017) 555-7713"]
    rows = [("x " + s + " y", 2, 2 + len(s), [(2, 2 + len(s), k)] if k else []) for s, k in (("10.1.2.3", "ip"), ("10.1.22.33", "ip"), ("4.0", None), ("2.1", None), ("a@b.example.com", "email"), ("c.d@e.example.org", "email"))]
    w = pii.train(rows)
    assert pii.decode("see 9.8.7.6 now", 4, 11, w) == [(4, 11, "ip")]
    assert pii.decode("see 7.5 now", 4, 7, w) == []
    out = pii.redact_documents(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def brute_base_spans(t):
    """The base kinds by the patterns of the contract as they stand."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(x.lstrip("0")) < 4 and int(x[-4:]) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    }
    return {k: [m.span() for m in re.finditer(p, t) if ok(m.group())] for k, (p, ok) in rules.items()}


def test_personal_data_equals_brute_force(spark, texts):
    rnd = random.Random(11)
    parts = ["a", "b.c", "@", "x-y", ".", "..", "1", "22", "255", "256", "0", "00", " ", "  ", "\n", "-", "+", "(", ")", "_", "%", "é", "²", "٣", "\u00a0", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (017) 555-7713", "m@n.org", "10.0.0.1", "token=", '"']
    some = dict(enumerate([*texts.values(), *("".join(rnd.choices(parts, k=rnd.randint(0, 40))) for _ in range(4000)), "call 1.².3.4 now", "0" * 5000 + ".1.2.3", "7" * 20_000 + "@", "字" * 50_000 + "1", "a" * 50_000 + " x@y.zz"]))
    order = ("email", "ip", "card", "phone")
    for r in pii.find_personal_data(make(spark, some.items()), redacted=False).collect():
        t = some[r["doc_id"]]
        want = brute_base_spans(t)
        assert tuple(r[f"n_{k}"] for k in order) == tuple(len(want[k]) for k in order)
        joined = [f"{k}:{a}:{b}" for a, _, b, k in sorted((a, order.index(k), b, k) for k in order for a, b in want[k])]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",") if x]
        assert set(joined) <= {":".join(x) for x in spans} and len(spans) == len(joined) + r["n_added"]
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans) and all(0 <= int(a) < int(b) <= len(t) for _, a, b in spans)
        assert pii.windows(t) == [m.span() for m in re.finditer(r"\S*[0-9@]\S*(?: \S*[0-9@]\S*)*", t)] if len(t) < 10_000 else True


def test_quality(docs, texts):
    for r in quality.quality_lines(docs).collect():
        w = words(texts[r["doc_id"]])
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + d for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for d in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        lines = texts[r["doc_id"]].split("\n")
        assert (r["n_symbols"], r["n_dup_lines"]) == (sum(c in "#*$%&|<>" for c in texts[r["doc_id"]]), sum(bool(words(x)) and x in lines[:k] for k, x in enumerate(lines)))
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w)) and not (r["base_failed"] and r["kept"])
    plain = "Plain words make up this line of prose, again and again with others.\n" + " ".join(f"word{k}" for k in range(80))
    assert quality.judge(plain.encode(), quality.WordHash())[-2]
    loud = "\n".join(" ".join(f"WORD{k}{j}!!" for k in range(10)) for j in range(8))
    menu = "\n".join(" | ".join(f"item{k}{j}" for k in range(10)) for j in range(8))
    assert not any(quality.judge(t.encode(), quality.WordHash())[-2] for t in (loud, menu))


def test_toxicity_is_ordinal(spark):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        w = [f"w{chr(97 + rnd.randint(0, 25))}{chr(97 + rnd.randint(0, 25))}" for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            w[: 2 + i % 6] = rnd.choices(["vile", "nasty"], k=2 + i % 6)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = make(spark, rows)
    model = toxicity.fit(docs.where("doc_id < 200"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score_toxicity(docs.where("doc_id >= 200"), model).collect()
    assert all(r["toxic"] == (r["doc_id"] % 4 == 0) for r in got)
    assert model.thresholds == sorted(model.thresholds)


def test_ordinal_fit_is_a_minimum(spark):
    """The numeric gradient of the penalised likelihood vanishes at the fit."""
    rnd = np.random.default_rng(3)
    x = (rnd.random((400, 3)) < 0.4).astype(float)
    y = np.digitize(x @ [1.5, -0.5, 0.7] + rnd.logistic(size=400), [0.5, 1.5, 2.5])
    w, t = toxicity.fit_ordinal(x, y, rounds=4000)

    def loss(p):
        w, t = p[:3], np.concatenate(([-np.inf], p[3:], [np.inf]))
        upper, lower = (1 / (1 + np.exp(-(t[y + k] - x @ w))) for k in (1, 0))
        return -np.log(upper - lower).mean() + 0.001 * (w @ w)

    p = np.concatenate((w, t))
    for k in range(6):
        d = np.eye(6)[k] * 1e-4
        assert abs(loss(p + d) - loss(p - d)) / 2e-4 < 2e-3
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    for docs in (make(spark, []), make(spark, ODD)):
        assert toxicity.fit(docs, empty).words == {}


def test_tiff_bad_files():
    page = np.arange(64, dtype=np.uint8).reshape(8, 8)
    for tags in ({"WIDTH": (4, 0)}, {"ROWS": (4, 0)}):
        assert len(list(tiff._rows(1, retagged(tiff.write_tiff([page]), 0, **tags)))) == 1
    tiled = tiff.write_tiff([page], tile=(16, 16))
    assert "Zero" in next(tiff._rows(1, retagged(tiled, 0, TILE_WIDTH=(4, 0))))[-1]
    with pytest.raises(ValueError):
        tiff.lzw_decode(bytes((0b10000000, 0b01111111, 0b11000000)), 10)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(want.fetchall())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, FOLDER)
    placed = out.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert out.count() > 0 and placed.where("n > 1024").count() == 0
    kept = {r["doc_id"] for r in quality.quality_lines(spark.read.parquet(f"{FOLDER}/documents.parquet")).where("kept").collect()}
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} <= kept


def test_toxic_texts_are_found_held_out(spark):
    """Fitted on half of the labels, most toxic texts of the other half are found and few others; some are labelled toxic without any of the words."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = toxicity.fit(docs, labels.where(half))
    rest = labels.where(~half).where("toxic is not null").select(F.col("doc_id"), F.col("toxic").alias("label"))
    got = toxicity.score_toxicity(docs.join(rest.select("doc_id"), "doc_id", "left_semi"), model).join(rest, "doc_id")
    n = {(r["label"], r["toxic"]): r["count"] for r in got.groupBy("label", "toxic").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) >= 0.85
    assert n.get((0, True), 0) / (n.get((0, True), 0) + n[0, False]) <= 0.01


def test_field_adds_spans_that_no_pattern_labels(spark):
    """Planted secrets that the labelling pattern misses are found; strings like them that are no data are not."""
    rnd = random.Random(11)
    mixed = lambda n: "".join(rnd.choices("abcdef", k=n // 2) + rnd.choices("0123456789", k=n - n // 2))
    shuffled = lambda n: "".join(rnd.sample(mixed(n), n))
    data = [lambda: f'api_key = "{shuffled(18)}"', lambda: f"token: {shuffled(20)}", lambda: shuffled(32), lambda: f"see {shuffled(40)} here"]
    none = [lambda: f"{rnd.randint(1, 28)}.{rnd.randint(1, 12)}.2024", lambda: f"version 1.{rnd.randint(0, 9)}", lambda: f"{rnd.randint(10, 10**6)} items", lambda: f"room{rnd.randint(1, 99)} and abc{rnd.randint(100, 999)}def", lambda: "=" * 30 + "7", lambda: f"{rnd.randint(10**15, 10**16)}x", lambda: f"2024-01-{rnd.randint(10, 28)} 12:{rnd.randint(10, 59)}:44", lambda: "a1" * 5]
    rows = [(k, f"some words before, {data[k % 4]()} and some behind") for k in range(200)]
    rows += [(1000 + k, f"some words before, {none[k % 8]()} and some behind") for k in range(300)]
    assert not any(pii._SECRET.search(t) for _, t in rows)
    weights = pii.fit(pii.keyed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")))
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(make(spark, rows), weights=weights).collect()}
    exact = 0
    for i, t in rows[:200]:
        m = max(re.finditer(r"[a-z0-9]{16,}", t), key=lambda m: len(m[0]))
        exact += f"secret:{m.start()}:{m.end()}" in got[i].split(",")
    false = sum(got[i] != "" for i, _ in rows[200:])
    assert exact >= 180 and false <= 6
