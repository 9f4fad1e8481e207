"""The thirteen operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import ball_kmeans, bpe, chat, line_dedup, ngram_jaccard, packing, pii, quality, runs, sharding, substring_dedup, tiff, toxicity
from lodestack.llm.common import documents


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.kd_shards(documents(spark, sf_dir), 24)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score_toxicity(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_best_fit(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), capacity=1024, end=2)


def op4_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digests(tiff.store_texts(documents(spark, sf_dir))).withColumnRenamed("_id", "doc_id")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.jaccard_components(documents(spark, sf_dir), width=5, num=75, den=100)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.bpe_round_trip(documents(spark, sf_dir), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.find_personal_data(documents(spark, sf_dir), redacted=False)
    return done.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_lines(documents(spark, sf_dir), cleaned=False).drop("cleaned")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, sf_dir))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup_substrings(documents(spark, sf_dir), width=20)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in about a tenth of the documents, chosen by the id, the words from some place on become periodic."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(F.col("h") / 10)
    chosen = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, chosen)).withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")).cast("int"))
    some = some.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8))).cast("int"))
    late = F.transform(F.sequence(F.lit(0), F.col("n") - F.col("a") - 1), lambda i: F.element_at("w", (F.col("a") + i % F.col("p") + 1).cast("int")))
    periodic = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), late), " ")
    return some.select("doc_id", F.when(F.col("a").isNotNull(), periodic).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = runs.periodic_runs(planted(documents(spark, sf_dir)))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    done = done.withColumn("best", best).withColumn("length", -F.col("best.length"))
    return done.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "length", "best.period", F.expr("1000 * length div best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ball_kmeans.ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=40, rounds=5, dims=64, scale=256, salt="2")
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256).alias("centroid_sha256"))


def op13_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    marks = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    done = chat.read_back(given.unionByName(marks))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return done.select("conv_id", "n_turns", digest("turns"), "loss_chars", digest("loss"), "formatted_chars")


def queries() -> dict:
    every = (op1_kd_sharding, op2_toxicity, op3_best_fit_packing, op4_tiff_media, op5_ngram_jaccard, op6_bpe, op7_pii, op8_quality_lines, op9_line_dedup, op10_substring_dedup, op11_periodic_runs, op12_ball_kmeans, op13_chat_prefixes)
    return {f.__name__: f for f in every}


#: Splits at line feeds; strips ASCII white space; lowers A-Z only.
_LINES = """
lines AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
each_line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM lines),
keyed_lines AS (SELECT doc_id, line, pos, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM each_line),
common_lines AS (SELECT k, min(doc_id) AS first FROM keyed_lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
judged_lines AS (SELECT l.doc_id, l.line, l.pos, c.first IS NOT NULL AND l.doc_id > c.first AS gone FROM keyed_lines l LEFT JOIN common_lines c ON l.k = c.k)
"""


#: Words of every document with their places, and of every window of 20 whether its words start earlier.
_WINDOWS = r"""
split_words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
each_word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM split_words),
windows AS (SELECT doc_id, w, pos, CASE WHEN count(*) OVER ahead = 20 THEN string_agg(w, ' ') OVER ahead END AS k FROM each_word
  WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT doc_id, w, pos, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS again FROM windows),
covered AS (SELECT doc_id, w, pos, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM later)
"""


def _kmeans_sql(k: int = 40, rounds: int = 5) -> str:
    """All rounds written out, in exact integers."""
    parts = ["""kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS (SELECT r, unnest(v) AS x, unnest(range(64)) AS d FROM kept)",
        f"first AS (SELECT v, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {k})",
        "c0 AS (SELECT c, unnest(v) AS x, unnest(range(64)) AS d FROM first)"]
    for t in range(rounds + 1):
        parts.append(f"far{t} AS (SELECT p.r, c.c, sum((p.x - c.x) * (p.x - c.x)) AS far FROM parts p JOIN c{t} c USING (d) GROUP BY ALL)")
        parts.append(f"in{t} AS (SELECT r, c, far FROM far{t} QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1)")
        if t < rounds:
            parts.append(f"m{t} AS (SELECT i.c, p.d, CAST(floor((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) / count(*)) AS BIGINT) AS x FROM in{t} i JOIN parts p USING (r) GROUP BY ALL)")
            parts.append(f"c{t + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x, c.d FROM c{t} c LEFT JOIN m{t} m ON m.c = c.c AND m.d = c.d)")
    parts.append(f"marks AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS s FROM c{rounds} GROUP BY c)")
    return "WITH " + ",\n".join(parts) + f"""
SELECT k.vec_id, CAST(i.c AS INTEGER) AS cluster, CAST(i.far AS BIGINT) AS distance, CAST(sum(i.far) OVER (PARTITION BY i.c) AS BIGINT) AS cluster_inertia, CAST(sum(i.far) OVER () AS BIGINT) AS inertia, m.s AS centroid_sha256
FROM in{rounds} i JOIN kept k USING (r) JOIN marks m USING (c)"""


#: Statistics of every document, and the words of the lines that fail a rule: punctuation, navigation or boilerplate.
_QUALITY = r"""
ts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ws AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM ts),
each_line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM ts),
lined AS (SELECT doc_id, line, pos, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM each_line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
judged AS (SELECT doc_id, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) > 1 AS dup,
  regexp_matches(line, '!!|\?\?|\*\*|##|\$\$|%%|&&|==|__|~~|\^\^') AND len(list_filter(w, lambda x: regexp_matches(x, '(?:!!+|\?\?+|[#*$%&~^=_]{2,})\.?$|^[#*$%&~^=_]{2,}'))) > CAST(0.3 AS DOUBLE) * len(w)
  OR len(w) > 1 AND len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ('|', '||', '>', '>>', '»', '›', '·', '•', 'home', 'login', 'menu', 'sitemap', 'contact', 'next', 'previous'))) > CAST(0.2 AS DOUBLE) * len(w)
  OR regexp_matches(line, '(?i)lorem ipsum|enable javascript|use of cookies|cookie policy|privacy policy|all rights reserved|terms of (?:use|service)') AS bad FROM lined),
of_lines AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS n_lost FROM judged GROUP BY doc_id),
each_word AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS pos FROM ws),
threes AS (SELECT doc_id, pos, CASE WHEN count(*) OVER ahead = 3 THEN string_agg(x, ' ') OVER ahead END AS k FROM each_word WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
twice AS (SELECT doc_id, pos, k IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, k) > 1 AS again FROM threes),
over_words AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS hit FROM twice),
repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM over_words GROUP BY doc_id),
per_doc AS (SELECT ws.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(n_lost, 0) AS n_lost FROM ws LEFT JOIN of_lines USING (doc_id) LEFT JOIN repeats r ON r.doc_id = ws.doc_id)
"""


#: Distinct shingles of every document, pairs that share enough of them, and what their links reach.
_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b)
"""


#: Lengths from the template: an example of an assistant turn holds all turns up to it, and so does one behind the last reply.
_CHATS = r"""
turns AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
written AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|(?:INST|SYS|ROLE|TURN)\]))', '\1\2\\\3', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 13 WHEN 'assistant' THEN 5 ELSE 30 + length(role) END AS n FROM turns),
upto AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) + 3 AS chars, role = 'assistant' OR turn = max(turn) OVER (PARTITION BY conv_id) AS example FROM written)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_quality_lines": f"""WITH {_QUALITY}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lost, base_failed, NOT base_failed AND n_lost <= CAST(0.5 AS DOUBLE) * n_words AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM per_doc)""",
        "op12_ball_kmeans": _kmeans_sql(),
        "op5_ngram_jaccard": f"""WITH RECURSIVE {_SHINGLES}
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id""",
        "op13_chat_prefixes": f"""WITH {_CHATS}
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) FILTER (example) AS BIGINT) AS formatted_chars
FROM upto GROUP BY conv_id""",
        "op10_substring_dedup": f"""WITH {_WINDOWS}
SELECT d.doc_id, count(c.w) AS n_words, count(c.w) FILTER (c.gone) AS n_removed, sha256(coalesce(string_agg(c.w, ' ' ORDER BY c.pos) FILTER (NOT c.gone), '')) AS kept_sha256
FROM documents d LEFT JOIN covered c ON c.doc_id = d.doc_id GROUP BY d.doc_id""",
        "op9_line_dedup": f"""WITH {_LINES}
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged_lines GROUP BY doc_id""",
    }
