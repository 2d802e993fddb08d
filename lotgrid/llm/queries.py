"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_crf, langid, minhash, mixing, packing, pii, quality, token_store, toxicity
from .scratch import fresh_path
from .text import crc_mod


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-store")
    token_store.write_store(_docs(spark, sf_dir), path, tokenizer_path("word_bpe_49k.json"), end_id=1)
    rows = token_store.TokenStore(spark, path).read()
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    scored = toxicity.train(docs, labels, ~held_out).score(docs)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), width=2, percent=80)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.assess(docs, quality.train(docs, labels))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    return model.predict(docs).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir)).drop("uid")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.default_model(spark).find(_docs(spark, sf_dir))
    counts = [F.expr(f"CAST(size(filter(base, c -> c.kind = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in pii.KINDS]
    base = F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256")
    sizes = [F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")]
    return found.select("doc_id", *counts, base, pii.joined(F.expr(pii.all_spans("base", "added"))).alias("spans"), *sizes)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_docs(spark, sf_dir)).drop("alike", "uid")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_toxicity": op2_toxicity,
    "op3_html": op3_html,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_language_id": op6_language_id,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_pii": op9_pii,
    "op10_mixing": op10_mixing,
}

#: Near-duplicates by prefix filtering: of two similar sets the rarest fifth of the shingles share one.
_NEAR = r"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) < 2 THEN a ELSE list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) END) AS sh FROM w),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  f AS MATERIALIZED (SELECT sh, count(*) AS df FROM s GROUP BY sh),
  r AS MATERIALIZED (SELECT s.doc_id, s.sh, n.n, row_number() OVER (PARTITION BY s.doc_id ORDER BY df, s.sh) AS k FROM s JOIN f USING (sh) JOIN n USING (doc_id)),
  p AS MATERIALIZED (SELECT doc_id, sh, n FROM r WHERE k <= n - ceil(0.8 * n) + 1),
  c AS MATERIALIZED (SELECT DISTINCT x.doc_id AS u, y.doc_id AS v, x.n AS un, y.n AS vn FROM p x JOIN p y ON x.sh = y.sh AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
  l AS MATERIALIZED (SELECT u, v FROM c JOIN s a ON a.doc_id = u JOIN s b ON b.doc_id = v AND b.sh = a.sh GROUP BY u, v, un, vn HAVING 100 * count(*) >= 80 * (un + vn - count(*))),
  e AS MATERIALIZED (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
  t AS (SELECT doc_id, doc_id AS hop FROM n UNION SELECT t.doc_id, e.v FROM t JOIN e ON e.u = t.hop),
  g AS (SELECT doc_id, min(hop) AS component_id FROM t GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(g.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(g.component_id, w.doc_id) AS kept FROM w LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)"""

ORACLE: dict[str, str] = {
    "op4_minhash": _NEAR,
    "op8_exact_dedup": """
        WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM t WINDOW g AS (PARTITION BY text_sha256)""",
}
