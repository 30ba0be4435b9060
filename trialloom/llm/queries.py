"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import language, toxicity
from trialloom.llm.common import held_out, table
from trialloom.llm.embeddings import near_duplicates
from trialloom.llm.html import extract_text
from trialloom.llm.language import identify
from trialloom.llm.lexical import rank
from trialloom.llm.lm import stupid_backoff
from trialloom.llm.mixing import TARGETS, label_domains, mix
from trialloom.llm.ogg import from_media, to_media
from trialloom.llm.packing import pack
from trialloom.llm.quality import score, train
from trialloom.llm.rope import fill_in_middle
from trialloom.llm.secrets import scan_secrets
from trialloom.llm.simhash import simhash_groups


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of documents."""
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a field that learns from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    field = train(docs, table(spark, sf_dir, "labels"), ~out)
    return score(docs, field).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff score of every document against the rest of the corpus, to the hundredth."""
    got = stupid_backoff(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_backoff", F.round("log_score", 2).alias("log_score"), F.round("score", 5).alias("score"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), window=1024)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return extract_text(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors, rates and copies that bring the domains of documents to their target shares."""
    return mix(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), TARGETS)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by machines that learn from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"))
    return identify(docs, language.train(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.98."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every text."""
    return scan_secrets(table(spark, sf_dir, "documents"), redacted=False)


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an Ogg file and read back."""
    return from_media(to_media(table(spark, sf_dir, "documents")))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every item of benchmark."""
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a grammar that learns from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), of=3, rest=1)
    grammar = toxicity.train(docs, table(spark, sf_dir, "labels"), ~out)
    return toxicity.score(docs, grammar).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut twice at code points, rearranged and restored."""
    return fill_in_middle(table(spark, sf_dir, "documents"), unit="char", texts=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_quality": op2_quality,
        "op3_lm": op3_lm,
        "op4_packing": op4_packing,
        "op5_html": op5_html,
        "op6_mixing": op6_mixing,
        "op7_language": op7_language,
        "op8_embeddings": op8_embeddings,
        "op9_secrets": op9_secrets,
        "op10_media": op10_media,
        "op11_search": op11_search,
        "op12_toxicity": op12_toxicity,
        "op13_fim": op13_fim,
    }


_LM = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x09-\x0D\x20]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS v, unnest(range(len(ws))) AS i FROM d), t AS (SELECT count(*) AS total FROM w), u AS (SELECT v AS word, count(*) AS n FROM w GROUP BY 1),
n AS (SELECT r, v, lead(v) OVER (PARTITION BY r ORDER BY i) AS w FROM w), p AS (SELECT r, v, w, count(*) AS own FROM n WHERE w IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT v, w, sum(own) AS n FROM p GROUP BY 1, 2),
s AS (SELECT r, sum(own * CASE WHEN c.n > own THEN ln((c.n - own)::DOUBLE / a.n) ELSE ln(0.4 * b.n / total) END) AS log, sum(CASE WHEN c.n > own THEN 0 ELSE own END) AS back
  FROM p JOIN c USING (v, w) JOIN u a ON a.word = v JOIN u b ON b.word = w, t GROUP BY 1),
f AS (SELECT r, ln(n::DOUBLE / total) AS log FROM w JOIN u ON word = v, t WHERE i = 0)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(back, 0) AS BIGINT) AS n_backoff, round(coalesce(f.log, 0) + coalesce(s.log, 0), 2) AS log_score,
  CASE WHEN len(ws) > 0 THEN round((f.log + coalesce(s.log, 0)) / len(ws), 5) END AS score FROM d LEFT JOIN f USING (r) LEFT JOIN s USING (r)"""

_VECTORS = """WITH RECURSIVE g AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT *, sqrt(list_dot_product(v, v)) AS size FROM g WHERE label IS NOT NULL AND len(v) > 0 AND list_count(v) = len(v) AND NOT list_bool_or(list_transform(v, lambda x: isnan(x) OR isinf(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))),
l AS (SELECT a.r, b.r AS o, b.vec_id FROM n a JOIN n b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.98),
reach(r, o) AS (SELECT r, r FROM g UNION SELECT reach.r, l.o FROM reach JOIN l ON l.r = reach.o),
c AS (SELECT reach.r, min(g.vec_id) AS component_id FROM reach JOIN g ON g.r = reach.o GROUP BY 1), k AS (SELECT r, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM g JOIN c USING (r) LEFT JOIN k USING (r)"""

_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_SEARCH = f"""WITH words AS (SELECT r, doc_id, unnest({_TERMS.format("text")}) AS term FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
lengths AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM words GROUP BY r),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM lengths),
postings AS (SELECT r, term, count(*) AS tf FROM words GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM postings, totals GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
scored AS (SELECT item_id, r, CAST(sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (r), totals GROUP BY 1, 2)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored JOIN lengths USING (r) WHERE score > 0)
WHERE rank <= 20"""

_FIM = """WITH d AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT *, CAST('0x' || substr(s, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(s, 9, 8) AS BIGINT) % (n + 1) AS b, CAST('0x' || substr(s, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(s, 25, 8) AS BIGINT) % 100 AS e FROM d),
f AS (SELECT doc_id, n, x, least(a, b) AS p, greatest(a, b) AS m,
  CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
t AS (SELECT *, substring(x, 1, p) AS pre, substring(x, p + 1, m - p) AS mid, substring(x, m + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN m - p END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(x) AS restored_sha256 FROM t"""


def oracle_sql() -> dict[str, str]:
    return {"op3_lm": _LM, "op8_embeddings": _VECTORS, "op11_search": _SEARCH, "op13_fim": _FIM}
