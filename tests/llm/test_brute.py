"""Whole query rows and every pipeline stage on its own input, against plain versions of their own."""

import base64
import collections
import hashlib
import math
import re
import struct
import zlib

import pytest

import corpus_pipeline
from lodestack.llm import pii, queries, toxicity
from lodestack.llm.common import keyed
from tests.llm.test_llm import brute_base_spans, components_of, words

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())


def test_op1_rows(spark, texts):
    """Sizes, checksums and slots of every row, equal texts in one shard, and sums no further apart than the largest item."""
    rows = queries.op1_kd_sharding(spark, FOLDER).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in rows} == {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for i, t in texts.items()}
    slots, held, sums, items = collections.defaultdict(list), collections.defaultdict(set), collections.Counter(), collections.Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        held[texts[r["doc_id"]]].add(r["shard"])
        sums[r["shard"]] += r["size"]
        items[texts[r["doc_id"]]] += r["size"]
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in held.values())
    assert max(sums.values()) - min(sums.values()) <= max(items.values())


def test_op2_rows(spark, texts):
    """Severities by the formula, feature by feature, with the model that the query fits."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    got = {r["doc_id"]: (r["severity"], r["toxic"]) for r in queries.op2_toxicity(spark, FOLDER).collect()}
    assert set(got) == set(texts) and model.thresholds == sorted(model.thresholds)
    least = sum(1 / (1 + math.exp(min(50, t))) for t in model.thresholds)
    for i, t in texts.items():
        w = set(re.findall(rb"[a-z\x80-\xff]+", (t or "").encode().lower()))
        x = sum(v for f, v in model.words.items() if f in w or f[:1] == b"^" and any(len(u) > 8 and u[:8] == f[1:] for u in w))
        severity = sum(1 / (1 + math.exp(max(-50, min(50, h - x)))) for h in model.thresholds)
        assert abs(got[i][0] - severity) < 1e-5 and got[i][1] == (got[i][0] >= least + 0.1)


def test_op6_rows(spark, texts):
    """Counts and both digests as the tiktoken library gives them."""
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op6_bpe(spark, FOLDER).collect()}
    want = {}
    for i, t in texts.items():
        ids = library.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert got == want


def fails(line):
    """The line rules as their constants say, by plain text operations."""
    w = words(line)
    marks = "#*$%&~^=_"
    bare = lambda x: x[:-1] if x.endswith(".") else x
    loud = lambda x: bare(x).endswith(("!!", "??")) or len(bare(x)) - len(bare(x).rstrip(marks)) >= 2 or len(x) - len(x.lstrip(marks)) >= 2
    if any(c * 2 in line for c in "!?*#$%&=_~^") and sum(map(loud, w)) > 0.3 * len(w):
        return True
    menu = {"|", "||", ">", ">>", "»", "›", "·", "•", "home", "login", "menu", "sitemap", "contact", "next", "previous"}
    lower = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x)
    if len(w) > 1 and sum(lower(x) in menu for x in w) > 0.2 * len(w):
        return True
    phrases = ("lorem ipsum", "enable javascript", "use of cookies", "cookie policy", "privacy policy", "all rights reserved", "terms of use", "terms of service")
    return any(p in lower(line) for p in phrases)


def judged(t):
    """(kept, cleaned) of a text."""
    w, lines = words(t), (t or "").split("\n")
    triples = collections.Counter(zip(w, w[1:], w[2:]))  # noqa: B905
    covered = {k + d for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for d in range(3)}
    bad = [bool(words(x)) and fails(x) for x in lines]
    lost = sum(len(words(x)) for x, b in zip(lines, bad, strict=True) if b)
    kept = not (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and lost <= 0.5 * len(w)
    return kept, "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)


def test_op8_rows(spark, texts):
    """The verdict of every document, beside the base columns that test_quality compares."""
    got = {r["doc_id"]: r["kept"] for r in queries.op8_quality_lines(spark, FOLDER).collect()}
    assert got == {i: judged(t)[0] for i, t in texts.items()}


def test_every_stage(spark):
    """Each stage of the pipeline against a plain version on the stage's own input."""
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before = rows(docs)

    cleaned = stages[0](spark, docs, FOLDER).cache()
    want = {i: judged(t)[1] for i, t in before.items() if judged(t)[0]}
    assert rows(cleaned) == want and cleaned.columns == docs.columns

    deduped = stages[1](spark, cleaned, FOLDER).cache()
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in want.items():
        for line in t.split("\n"):
            held[key(line)].add(i)
    gone = lambda i, s: len(key(s)) >= 10 and len(held[key(s)]) > 1 and min(held[key(s)]) < i
    want = {i: "\n".join(s for s in t.split("\n") if not gone(i, s)) for i, t in want.items()}
    assert rows(deduped) == want

    single = stages[2](spark, deduped, FOLDER).cache()
    sets = {}
    for i, t in want.items():
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    top = components_of(sets)
    want = {i: t for i, t in want.items() if top[i] == i}
    assert rows(single) == want

    private = stages[3](spark, single, FOLDER).cache()
    weights = pii.fit(keyed(single))
    spans = {r["doc_id"]: [x.split(":") for x in r["spans"].split(",") if x] for r in pii.find_personal_data(single, weights=weights, redacted=False).collect()}
    redacted = {}
    for i, t in want.items():
        mine = [(int(a), int(b), k) for k, a, b in spans[i]]
        assert {(a, b, k) for k, s in brute_base_spans(t).items() for a, b in s} <= set(mine)
        out, last = "", 0
        for a, b, k in mine:
            if a >= last:
                out += t[last:a] + f"<{k.upper()}>"
            last = max(last, b)
        redacted[i] = out + t[last:]
    assert rows(private) == redacted and all(len(redacted[r["doc_id"]]) == r["n_chars"] for r in private.collect() if redacted[r["doc_id"]] != want[r["doc_id"]])

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    packed, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in stages[4](spark, private, FOLDER).collect():
        packed[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(packed) == set(redacted)
    for i, t in redacted.items():
        pieces = sorted(packed[i])
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == len(library.encode(t, add_special_tokens=False).ids) + 1
        assert all(n == 1024 for _, _, n in pieces[1:]) and [s for _, s, _ in pieces] == [sum(n for _, _, n in pieces[:k]) for k in range(len(pieces))]
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
    assert len(bins) <= 1.02 * sum(n for p in packed.values() for _, _, n in p) / 1024 + 1
