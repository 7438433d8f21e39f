"""One query per operator, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldtally.llm import fill_in_middle, jaccard, mixing, nearest, packing, phrases, quality, repeats, secret_scan, spelling, token_files, toxicity, url_filter
from fieldtally.llm.catalog import query, table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_quality_rules")
def op8(spark, sf_dir):
    judged = quality.judge_quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1|' || coalesce(doc_id::VARCHAR, 'null')) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM s),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
         sum(source_size) OVER ()::DOUBLE AS total
  FROM w),
v AS (SELECT coalesce(min(k) FILTER (WHERE cap / weight > (total - used) / open_weight), 1000000000) AS first_open FROM o),
lev AS (SELECT first_open, coalesce((SELECT (total - used) / open_weight FROM o WHERE k = first_open), 0) AS level FROM v),
t AS (SELECT source, source_size, CASE WHEN k < first_open THEN cap ELSE weight * level END AS target FROM o, lev),
r AS (SELECT source, source_size, target,
             CASE WHEN source_size > 0 THEN least(round(target)::BIGINT, 3 * source_size) // source_size ELSE 0 END AS reps,
             CASE WHEN source_size > 0 THEN least(round(target)::BIGINT, 3 * source_size) % source_size ELSE 0 END AS rest
      FROM t),
c AS (SELECT d.*, r.source_size, r.target, r.reps, r.rest,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * reps + least(size, greatest(0, rest - before)))::BIGINT AS taken
FROM c
"""


@query("op2_source_mixing", OP2_SQL)
def op2(spark, sf_dir):
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op3_secret_scans")
def op3(spark, sf_dir):
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents"))

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select(
        "doc_id",
        *[number(k) for k in secret_scan.BASE_KINDS],
        F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


@query("op7_packing")
def op7(spark, sf_dir):
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), path, with_ids=False)


@query("op9_token_files")
def op9(spark, sf_dir):
    folder = token_files.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_files.read_token_files(spark, folder, with_ids=False)


URL_RULES = (
    url_filter.Rule.parse("allow", "org/"),
    url_filter.Rule.parse("block", "example.org/es/"),
    url_filter.Rule.parse("block", "example.org/en/1"),
    url_filter.Rule.parse("allow", "com/fr/"),
    url_filter.Rule.parse("block", "com/de/"),
)


@query("op10_url_filters")
def op10(spark, sf_dir):
    """A page shows the document whose id is the number in its path; that document's label is the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    document = F.expr("try_cast(nullif(regexp_extract(__path, '/([0-9]+)', 1), '') AS BIGINT)")
    shown = pages.withColumn("__path", url_filter.url_path(F.col("url"))).select(
        F.col("page_id").alias("page_key"), document.alias("doc_id")
    )
    good = ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    labels = table(spark, sf_dir, "labels").select("doc_id", good)
    labelled = shown.where("doc_id IS NOT NULL").join(labels, "doc_id").select("page_key", "good")
    judged = url_filter.judge_urls(pages, labelled, URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query("op5_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@query("op1_nearest_neighbours")
def op1(spark, sf_dir):
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
g AS (
  SELECT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END, ' ') AS s
  FROM d, unnest(range(1, greatest(len(w) - 3, 2))) AS r(i) WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS root, doc_id FROM n UNION SELECT c.root, u.b FROM c JOIN u ON u.a = c.doc_id AND u.b > c.root),
m AS (SELECT doc_id, min(root) AS component_id FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


@query("op4_ngram_jaccard", OP4_SQL)
def op4(spark, sf_dir):
    return jaccard.similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    return repeats.find_repeats(table(spark, sf_dir, "documents")).drop("spans")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS h
  FROM documents),
c AS (
  SELECT *, len(u)::BIGINT AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                   OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS prefix, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suffix
  FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query("op13_fill_in_middle", OP13_SQL)
def op13(spark, sf_dir):
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    return fill_in_middle.restore_text(made).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


@query("op12_document_fingerprints")
def op12(spark, sf_dir):
    return phrases.compare_with_next(table(spark, sf_dir, "documents"))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    found = spelling.spelling_forms(table(spark, sf_dir, "documents"))
    return found.select("word", "n", "form", "form_n", "root", "n_near")
