"""Registered queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import clustering, decontamination, importance, jaccard_join, licences, line_dedup, mixing, ngram_lm, privacy, quality, substring_dedup, token_counts, toxicity
from vitrine.llm.common import staged

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.col("__sha256").alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP9_SQL = r"""
WITH lines AS (
  SELECT r, doc_id, i, l, lower_key FROM (
    SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l,
           translate(trim(unnest(ls), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_key
    FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), gone AS (
  SELECT lower_key FROM lines WHERE length(lower_key) >= 1 GROUP BY lower_key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT r, doc_id, i, l, lower_key IN (SELECT lower_key FROM gone) AS dropped FROM lines
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality.judged(_table(spark, sf_dir, "documents"))
    return verdicts.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
tri AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM w WHERE len(w) >= 3),
rep AS (SELECT r, count(DISTINCT c) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS c FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS k FROM tri) WHERE k > 1) GROUP BY r),
m AS (SELECT w.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
long AS (
  SELECT lang, source, 'symbols' AS ratio, n_symbols * 1000 // greatest(word_chars, 1) AS v FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_lines', n_dup_lines * 1000 // greatest(n_lines, 1) FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeats', n_repeat_words * 1000 // greatest(n_words, 1) FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'upper', n_upper * 1000 // greatest(word_chars, 1) FROM b WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'length', word_chars * 10 // greatest(n_words, 1) FROM b WHERE NOT base_failed),
fine AS (SELECT lang, source, ratio, CASE WHEN v < 32 THEN v ELSE (v >> (length(bin(v)) - 5)) << (length(bin(v)) - 5) END AS bucket, count(*)::HUGEINT AS n FROM long GROUP BY ALL),
a AS (SELECT ratio, bucket, sum(n)::HUGEINT AS n, sum(sum(n)) OVER (PARTITION BY ratio)::HUGEINT AS n_all FROM fine GROUP BY ratio, bucket),
l AS (SELECT g.lang, g.ratio, a.bucket, (SELECT coalesce(sum(n), 0)::HUGEINT FROM fine WHERE lang IS NOT DISTINCT FROM g.lang AND ratio = g.ratio AND bucket = a.bucket) * a.n_all + 100 * a.n AS n
      FROM (SELECT DISTINCT lang, ratio FROM fine) g JOIN a USING (ratio)),
la AS (SELECT *, sum(n) OVER (PARTITION BY lang, ratio)::HUGEINT AS n_all FROM l),
s AS (SELECT g.lang, g.source, g.ratio, la.bucket, coalesce(f.n, 0) * la.n_all + 100 * la.n AS n
      FROM (SELECT DISTINCT lang, source, ratio FROM fine) g JOIN la ON la.lang IS NOT DISTINCT FROM g.lang AND la.ratio = g.ratio
      LEFT JOIN fine f ON f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source AND f.ratio = g.ratio AND f.bucket = la.bucket),
c AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bucket)::HUGEINT AS upto, sum(n) OVER (PARTITION BY lang, source, ratio)::HUGEINT AS n_all FROM s),
q AS (SELECT lang, source, ratio, min(bucket) FILTER (upto * 10 >= n_all) AS d1, min(bucket) FILTER (upto * 4 >= n_all) AS q1, min(bucket) FILTER (upto * 2 >= n_all) AS q2,
             min(bucket) FILTER (upto * 4 >= n_all * 3) AS q3, min(bucket) FILTER (upto * 10 >= n_all * 9) AS d9 FROM c GROUP BY lang, source, ratio),
f AS (SELECT lang, source, max(hi) FILTER (ratio = 'symbols') AS symbols, max(hi) FILTER (ratio = 'dup_lines') AS dup_lines, max(hi) FILTER (ratio = 'repeats') AS repeats,
             max(hi) FILTER (ratio = 'upper') AS upper, max(hi) FILTER (ratio = 'length') AS longest, max(lo) FILTER (ratio = 'length') AS shortest
      FROM (SELECT *, CASE WHEN q3 < 32 THEN q3 ELSE q3 + (1 << (length(bin(q3)) - 5)) - 1 END + 3 * greatest(q3 - q1, d9 - q2) AS hi, q1 - 3 * greatest(q3 - q1, q2 - d1) AS lo FROM q) GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols * 1000 <= symbols * word_chars + 3000 AND n_dup_lines * 1000 <= dup_lines * n_lines + 3000 AND n_repeat_words * 1000 <= repeats * n_words + 18000
       AND n_upper * 1000 <= f.upper * word_chars + 3000 AND word_chars * 10 // greatest(n_words, 1) BETWEEN shortest AND longest AS kept
FROM b LEFT JOIN f ON f.lang IS NOT DISTINCT FROM b.lang AND f.source IS NOT DISTINCT FROM b.source
"""


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_table(spark, sf_dir, "documents"))


def _op4_sql() -> str:
    """The same tables searched sentence by sentence: places of each, less those within a longer one."""
    sentences, rules = licences.references()
    quoted = ", ".join(f"('{name}', '{licences.normal(text)}')" for name, text in {**licences.SENTENCES, **sentences}.items())
    listed = ", ".join(f"('{rule}', '{licence}', ',{','.join(seq)},')" for rule, licence, seq in [*licences.RULES, *rules])
    return f"""
    WITH known AS (SELECT name, ' ' || replace(sentence, ' ', '  ') || ' ' AS sentence FROM (VALUES {quoted}) v(name, sentence)), rules(rule, licence, seq) AS (VALUES {listed}),
    plain AS (SELECT row_number() OVER () AS r, doc_id, replace(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ', '  ') AS t FROM documents),
    pieces AS (SELECT r, doc_id, name, length(sentence) AS n, string_split(t, sentence) AS p FROM plain JOIN known ON contains(t, sentence)),
    hits AS (SELECT r, doc_id, name, n, list_sum(list_transform(p[:i], lambda x: length(x))) + (i - 1) * n AS place FROM (SELECT *, unnest(range(1, len(p))) AS i FROM pieces)),
    own AS (SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.r = h.r AND o.place <= h.place AND o.place + o.n >= h.place + h.n AND o.n > h.n)),
    ids AS (SELECT r, doc_id, string_agg(name, ',' ORDER BY place) AS sentence_ids FROM own GROUP BY r, doc_id),
    met AS (SELECT r, doc_id, licence, rule, sentence_ids, seq FROM ids JOIN rules ON contains(',' || sentence_ids || ',', seq)),
    alone AS (SELECT r, doc_id, licence, rule, sentence_ids FROM met m WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.r = m.r AND length(o.seq) > length(m.seq) AND contains(o.seq, m.seq) AND NOT contains(replace(',' || m.sentence_ids || ',', o.seq, ',;,'), m.seq))),
    spdx(given, licence) AS (VALUES {", ".join(f"('{given}', '{licence}')" for given, licence in licences.identifiers().items())}),
    tags AS (SELECT r, doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{licences.TAG}', 1)) AS expression FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
    parts AS (SELECT r, doc_id, unnest(string_split_regex(lower(translate(expression, '()', '')), '{licences.BETWEEN}')) AS given FROM tags)
    SELECT doc_id, licence, rule, sentence_ids FROM alone
    UNION ALL SELECT DISTINCT ON (r, licence) p.doc_id, licence, 'spdx-tag', coalesce(sentence_ids, '') FROM parts p JOIN spdx USING (given) LEFT JOIN ids USING (r)"""


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    out = toxicity.held_out(F.col("doc_id"), 7, 2)
    model = ngram_lm.train(documents.where(~out))
    found = ngram_lm.scored(documents, model)
    return found.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    out = toxicity.held_out(F.col("doc_id"), 3, 1)
    model = toxicity.fit(documents, labels, ~out)
    found = toxicity.scored(documents.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), F.col("tox_score").alias("score"), F.col("tox_predicted").alias("predicted"), F.size("tox_spans").alias("n_passages"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated line of 30 words or more and every repeated passage of as many, with its offsets; shorter repeats stay."""
    return substring_dedup.repeats(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted; those of low quality are revised, their hyphens parting words; those labelled toxic are taken down, in a batch that is sent twice."""
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    parted = F.replace("text", F.lit("-"), F.lit(" "))
    counted = staged(documents.select("doc_id", "source", "lang", token_counts.counts(F.col("text")).alias("counts"), token_counts.counts(parted).alias("parted")), "counted")
    low, toxic = (labels.where(rule).select("doc_id").distinct() for rule in ("quality = 0 AND toxic = 0", "toxic = 1"))
    rollup = token_counts.Rollup(spark)
    rollup.commit("0001-insert", token_counts.deltas(counted))
    old = counted.join(low, "doc_id", "left_semi")
    rollup.commit("0002-revise", token_counts.revised(old, old.withColumn("counts", F.col("parted"))))
    rollup.compact()
    taken_down = token_counts.deltas(counted.join(toxic, "doc_id", "left_semi"), -1)
    rollup.commit("0003-take-down", taken_down)
    rollup.commit("0003-take-down", taken_down)
    return rollup.totals()


OP8_SQL = r"""
WITH d AS (SELECT source, lang, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 0 ELSE 1 END AS n,
  CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0 AND toxic = 0) THEN replace(text, '-', ' ') ELSE text END AS text FROM documents),
c AS (SELECT source, lang, n, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(coalesce(text, ''), '[\pL\pN]+|[^\pL\pN\x20\x09-\x0D]')) AS pieces FROM d)
SELECT source, lang, 'words-1' AS tokenizer, sum(n)::BIGINT AS docs, sum(n * words)::BIGINT AS tokens FROM c GROUP BY ALL
UNION ALL
SELECT source, lang, 'pieces-1' AS tokenizer, sum(n)::BIGINT AS docs, sum(n * pieces)::BIGINT AS tokens FROM c GROUP BY ALL
"""


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.col("imp_features").alias("n_features"), F.col("imp_weight").alias("weight"), F.col("imp_score").alias("score"), F.col("imp_rank").alias("rank"))


OP11_SQL = r"""
WITH crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
t AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents
      UNION ALL SELECT -row_number() OVER (), NULL, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT r, doc_id, list_filter(string_split_regex(x, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda v: v <> '') AS w FROM t),
f AS (SELECT r, unnest(w) AS f FROM w UNION ALL SELECT r, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM w WHERE len(w) >= 2),
n AS (SELECT r, f, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM n)),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::BIGINT)),
             lambda c, y: xor(steps[xor(c, y) % 256 + 1], c >> 8)), 4294967295) % 10000 AS bucket FROM h, crc),
m AS (SELECT r, bucket, sum(n)::BIGINT AS n FROM n JOIN b USING (f) GROUP BY ALL),
c AS (SELECT bucket, coalesce(sum(n) FILTER (r > 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (r < 0), 0)::DOUBLE AS t FROM m GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM c, a),
d AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM m JOIN g USING (bucket) WHERE r > 0 GROUP BY r),
s AS (SELECT r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM w LEFT JOIN d USING (r) WHERE r > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS n_all FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n_all // 100 THEN place END AS rank FROM o
"""


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(_table(spark, sf_dir, "embeddings"))


def _op12_sql(k: int = 40, rounds: int = 5) -> str:
    """Plain rounds over all pairs of a vector and a centroid, one step of the query for each round."""
    near = """SELECT r, c.cluster, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS distance
                 FROM p, c{0} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c.cluster) = 1"""
    steps = "".join(
        f"""a{i} AS ({near.format(i)}),
    m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY d) AS v
             FROM (SELECT cluster, d, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(range(64)) AS d, unnest(v) AS x FROM a{i} JOIN p USING (r)) GROUP BY cluster, d) GROUP BY cluster),
    c{i + 1} AS (SELECT cluster, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (cluster)),
    """
        for i in range(rounds)
    )
    return f"""
    WITH p AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    c0 AS (SELECT (row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1)::INTEGER AS cluster, v FROM p QUALIFY cluster < {k}),
    {steps}a AS ({near.format(rounds)})
    SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM a JOIN p USING (r) JOIN c{rounds} c USING (cluster)"""


def op13_private_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, every = privacy.span_text()
    found = privacy.spans(_table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", *[F.col(f"pii_n_{k}").alias(f"n_{k}") for k in privacy.KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def queries() -> dict[str, Query]:
    return {
        "op1_mix_sources": op1_mix_sources, "op2_quality_rules": op2_quality_rules, "op3_decontamination": op3_decontamination, "op4_licence_scan": op4_licence_scan, "op5_lm_scoring": op5_lm_scoring, "op6_toxicity": op6_toxicity,
        "op7_substring_dedup": op7_substring_dedup, "op8_token_counts": op8_token_counts,
        "op9_line_dedup": op9_line_dedup, "op10_jaccard_join": op10_jaccard_join,
        "op11_importance_resampling": op11_importance_resampling, "op12_centroid_clustering": op12_centroid_clustering, "op13_private_terms": op13_private_terms, "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op4_licence_scan": _op4_sql(), "op8_token_counts": OP8_SQL, "op9_line_dedup": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op12_centroid_clustering": _op12_sql()}
