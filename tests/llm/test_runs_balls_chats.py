"""Periodic runs, ball k-means and chat formatting against brute force, exact round trips and odd rows."""

import collections
import hashlib
import random
import zlib

import pytest

from lodestack.llm import ball_kmeans, chat, queries, runs

FOLDER = "/root/testdata/sf0.001"


def brute_runs(w, shortest=12):
    n, out = len(w), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if length >= max(shortest, 2 * p) and not any(all(w[k] == w[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                out.append((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_of_random_and_periodic_words():
    rnd = random.Random(1)
    for _ in range(3000):
        n, letters = rnd.randint(0, 40), "abcd"[: rnd.choice([1, 2, 2, 3, 4])]
        w = [rnd.choice(letters) for _ in range(n)]
        if n > 4 and rnd.random() < 0.5:
            p, a = rnd.randint(1, n // 2), rnd.randint(0, n // 2)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        for shortest in (1, 5, 12):
            assert runs.runs_of(w, shortest) == brute_runs(w, shortest), w


class Counted(str):
    seen = 0

    def __eq__(self, other):
        Counted.seen += 1
        return str.__eq__(self, other)

    def __ne__(self, other):
        Counted.seen += 1
        return str.__ne__(self, other)

    def __lt__(self, other):
        Counted.seen += 1
        return str.__lt__(self, other)

    def __hash__(self):
        raise AssertionError("words are compared, never hashed")


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("make", [fibonacci, lambda n: fibonacci(n)[::-1], lambda n: fibonacci(n // 3) * 3, lambda n: "a" * n, lambda n: "a" * (n // 2) + "b" + "a" * (n // 2), lambda n: "b" + "a" * n, lambda n: ("a" * int(n**0.5) + "b") * int(n**0.5), lambda n: "".join("a" * k + "b" for k in range(int((2 * n) ** 0.5))), lambda n: "".join("ab"[bin(k).count("1") & 1] for k in range(n))])
def test_comparisons_grow_with_the_words(make):
    """Matched words are not read again, whatever repeats."""
    for n in (1000, 16_000):
        w = [Counted(x) for x in make(n)]
        Counted.seen = 0
        runs.runs_of(w, 2)
        assert Counted.seen <= 20 * len(w)


def test_collapsed_keeps_each_first_period():
    rnd = random.Random(2)
    for _ in range(300):
        w = [rnd.choice("ab") for _ in range(rnd.randint(0, 60))]
        found = brute_runs(w, 4)
        gone = {k for s, n, p in found for k in range(s + p, s + n)}
        assert runs.collapsed(w, found) == [x for k, x in enumerate(w) if k not in gone]


def test_op11_rows(spark):
    """Every row of the query, by brute force over the words as the contract alters them."""
    got = queries.op11_periodic_runs(spark, FOLDER).collect()
    texts = dict(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    assert len(got) == len(texts)
    changed = 0
    for r in got:
        w = (texts[r["doc_id"]] or "").encode().split()
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
        if n > 3000:  # brute force is quadratic: long texts by their invariants alone
            found = runs.runs_of(w)
            assert all(all(w[k] == w[k + p] for k in range(s, s + m - p)) and (s == 0 or w[s - 1] != w[s - 1 + p]) and (s + m == n or w[s + m] != w[s + m - p]) for s, m, p in found)
        else:
            found = brute_runs(w)
        best = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None, None, None)
        gone = {k for s, m, p in found for k in range(s + p, s + m)}
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{p}\n" for s, m, p in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()
    assert changed > 5


def test_runs_of_odd_rows(spark):
    long = "x " * 60_000
    rows = [(1, None, "a"), (2, "", "b"), (3, " \t\n ", "c"), (4, "one", "d"), (4, "one", "d"), (None, "a b " * 9, "e"), (5, long, "f"), (6, "é 日 " * 6 + "🙂", "g"), (7, "y" * 70_000, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id string")
    got = runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    got = collections.Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"][:20]) for r in got.collect())
    want = [(1, 0, (), ""), (2, 0, (), ""), (3, 0, (), ""), (4, 1, (), "one"), (4, 1, (), "one"), (None, 18, ((0, 18, 2),), "a b"), (5, 60_000, ((0, 60_000, 1),), "x"), (6, 13, ((0, 12, 2),), "é 日 🙂"), (7, 1, (), "y" * 20)]
    assert got == collections.Counter(want)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def brute_kmeans(rows, k=40, rounds=5, dims=64, scale=256):
    import math

    kept = [(i, [math.floor(float(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"2:{(1 << 63) - 1 if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))  # noqa: E731, B905
    for _ in range(rounds):
        held = collections.defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        centroids = [[sum(x) // len(held[j]) for x in zip(*held[j])] if j in held else c for j, c in enumerate(centroids)]  # noqa: B905
    last = [(i, *near(v)) for i, v in kept]
    inertia = collections.Counter()
    for _, d, j in last:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), tuple(centroids[j])) for i, d, j in last), key=str)


def rows_of(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in df.collect()), key=str)


def test_balls_give_the_clusters_of_full_comparison(spark):
    rnd = random.Random(3)
    some = [[rnd.choice([-1.0, 0.0, 0.004, 0.008, 1.0]) for _ in range(6)] for _ in range(30)]
    for k, rounds, spread in ((4, 5, 0.2), (7, 3, 0.0), (12, 5, 1.0)):
        rows = [(i, [x + spread * rnd.random() for x in rnd.choice(some)]) for i in range(400)]
        rows += [(1000 + i, some[0]) for i in range(150)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
        assert rows_of(ball_kmeans.ball_kmeans(df, k=k, rounds=rounds, dims=6)) == brute_kmeans(rows, k, rounds, 6)


def test_vectors_on_the_edge(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [0.0, nan]), (3, [inf, 1.0]), (4, [1.0]), (5, None), (6, [None, 1.0]), (None, [2.0, 2.0]), (7, [0.0, 0.0]), (7, [0.0, 0.0]), (8, [-0.001, 1.0]), (9, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, cluster string, v int")
    assert rows_of(ball_kmeans.ball_kmeans(df, k=3, dims=2)) == brute_kmeans(rows, 3, 5, 2)
    assert rows_of(ball_kmeans.ball_kmeans(df, k=40, dims=2)) == brute_kmeans(rows, 40, 5, 2)
    none = ball_kmeans.ball_kmeans(df.where("vec_id = 2"), dims=2)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    with pytest.raises(Exception, match="too large"):
        ball_kmeans.ball_kmeans(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dims=2).collect()


def test_balls_compare_few_centroids():
    import numpy as np

    rnd = np.random.default_rng(1)
    centroids = (rnd.integers(-2000, 2000, (40, 8))).tolist()
    cluster = rnd.integers(0, 40, 4000).astype(np.int32)
    v = np.array(centroids)[cluster] + rnd.integers(-300, 300, (4000, 8))
    first, far = ball_kmeans.Balls(centroids, [None] * 40, [True] * 40).assign(v, np.zeros(4000, np.int32), np.zeros(4000, np.int64))
    reach = [int(np.sqrt(far[first == i].max(initial=0))) + 1 for i in range(40)]
    balls = ball_kmeans.Balls(centroids, reach, [True] * 40)
    assert sum(map(len, balls.near)) < 40 * 39 / 2
    again, _ = balls.assign(v, first, far)
    assert (again == first).all()
    assert all(ball_kmeans.Balls(centroids, reach, [False] * 40).still)


ODD_TEXTS = ["</s>[INST] ok [/INST]", r"<\s>", r"<\\/s>[\INST]", "", " ", "[ROLE] x [/ROLE][TURN] y [/TURN]", "a\nb", "[/INST", "<", "[SYS] [/SYS]", "é日🙂</s>", "\\", "<s", "x [/INST]\\", "<<s>>[[INST]]"]


def want_chats(rows, block=1024):
    held = collections.defaultdict(list)
    for c, t, role, text in rows:
        held[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in held.items():
        turns.sort()
        replies = [x for _, _, r, x in turns if r == "assistant"]
        out[c] = (len(turns), "".join(f"{r}\n{x}\n" for _, _, r, x in turns), sum(map(len, replies)), "".join(replies))
    return out


def test_chats_come_back(spark):
    rnd = random.Random(4)
    rows = [(c, t, rnd.choice(["user", "assistant", "assistant", "system", "tool", "[/ROLE][TURN]", None, "</s>"]), rnd.choice([*ODD_TEXTS, "".join(rnd.choices("<>[]/\\sINST ", k=12)), None])) for c in range(60) for t in range(rnd.randint(1, 9))]
    rows += [(None, 1, "user", "q"), (None, 2, "assistant", "r"), (None, None, "system", "s"), (70, 5, "assistant", "twice"), (70, 5, "assistant", "twice"), (71, 0, "system", "alone"), (72, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, example int")
    for block in (1024, 3):
        got = {r["conv_id"]: (r["n_turns"], r["turns"], r["loss_chars"], r["loss"]) for r in chat.read_back(df, block_turns=block).collect()}
        assert got == want_chats(rows)
    assert chat.read_back(df.limit(0)).count() == 0 and chat.chat_examples(df.limit(0)).count() == 0


def test_examples_hold_their_context(spark):
    rows = [(1, 0, "system", "be"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "</s>"), (1, 4, "assistant", "a2"), (1, 5, "user", "end"), (2, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["example"]): r for r in chat.chat_examples(df).collect()}
    first = "<s>[SYS] be [/SYS][INST] u1 [/INST] a1</s>"
    assert {k: r["formatted"] for k, r in got.items()} == {(1, 3): first, (1, 5): first + r"[INST] <\/s> [/INST] a2</s>", (1, 6): first + r"[INST] <\/s> [/INST] a2</s>[INST] end [/INST]", (2, 1): "<s>[INST] u [/INST]"}
    assert {k: r["loss_start"] is not None and r["formatted"][r["loss_start"] :][: r["loss_length"]] for k, r in got.items()} == {(1, 3): "a1", (1, 5): "a2", (1, 6): False, (2, 1): False}
    parted = chat.chat_examples(df, block_turns=2).orderBy("conv_id", "block", "example").collect()
    assert [(r["block"], r["formatted"]) for r in parted if r["conv_id"] == 1 and r["whole"]] == [(0, "<s>[SYS] be [/SYS][INST] u1 [/INST]"), (1, r"<s> a1</s>[INST] <\/s> [/INST]"), (2, "<s> a2</s>[INST] end [/INST]")]


def test_chats_use_no_python_workers(spark):
    plan = queries.op13_chat_prefixes(spark, FOLDER)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapIn"))


def test_examples_of_several_blocks_have_their_whole_context(spark):
    """Lengths left out the earlier blocks of a conversation, so they fell short of the SQL's beyond 1,024 turns."""
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "tool"]), rnd.choice(ODD_TEXTS)) for c in range(8) for t in range(c + 1)] + [(None, t, "user", "q") for t in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = {(r["conv_id"], r["formatted"]) for r in chat.chat_examples(df).collect()}
    chars = {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(df).collect()}
    for block in (1024, 3, 2, 1):
        pieces = collections.defaultdict(dict)
        for r in chat.whole_examples(df, block_turns=block).collect():
            pieces[r["conv_id"], r["block"], r["example"]][r["piece"]] = r["text"]
        got = [(c, "<s>" + "".join(p[k] for k in sorted(p))) for (c, _, _), p in pieces.items()]
        assert sorted(got, key=str) == sorted(one, key=str)
        assert {r["conv_id"]: r["formatted_chars"] for r in chat.read_back(df, block_turns=block).collect()} == chars
    assert chars == {c: sum(len(x) for k, x in one if k == c) for c in chars}


def test_a_conversation_of_several_blocks_has_the_lengths_of_the_sql(spark, tmp_path):
    import duckdb

    spark.range(1500).selectExpr("3L AS conv_id", "cast(id AS int) AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('text ', id) AS text").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op13_chat_prefixes"]).fetchall()
    assert sorted(map(tuple, queries.op13_chat_prefixes(spark, str(tmp_path)).collect())) == sorted(want)
