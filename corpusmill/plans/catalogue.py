"""The catalogue of queries over the operators, with SQL that gives the same rows.

Samples are all documents with their label (or doc_id modulo 2 where they have
none). The data has no leaks, blanks or nulls of its own: some are put in by
doc_id, alike in both forms.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.config import LanguageConfig, TaskSpec
from corpusmill.functions import text as T
from corpusmill.functions.arithmetic import allocate, label_counts, normalised
from corpusmill.functions.jsonparse import contrastive_pair_of, criteria_of, question_pairs_of, sample_texts_of
from corpusmill.operators import filters as O
from corpusmill.operators import reports, sampling, similarity
from corpusmill.plans import strategies as S
from corpusmill.plans.builder import DatasetBuilder
from corpusmill.plans.prompts import TEMPLATES, PromptRenderer
from corpusmill.shared import shared_dir
from corpusmill.sources import files, providers
from corpusmill.sources.providers import ColumnProvider
from corpusmill.streaming.filters import counted_stream, counts_to, latest_counts

TASK = TaskSpec(
    "toxicity",
    {0: "civil", 1: "abusive"},
    "Tell abusive texts from civil ones.",
    label_descriptions={0: "polite or neutral", 1: "insulting"},
    topics={"daily life": ["traffic", "weather"], "media": ["films", "games", "news"]},
    marker_keywords={1: ["idiot", "loser", "scum", "stupid", "trash", "moron", "clown", "pathetic"]},
)
LANGS = LanguageConfig({"en": "English", "de": "German", "fr": "French", "es": "Spanish"}, related_languages={"es": "fr"})

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_TEXT = """CASE WHEN doc_id % 11 = 0 THEN concat('Label: toxic. ', text) WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN '   '
 WHEN doc_id % 19 = 0 THEN concat('Classified as abusive: ', text) WHEN doc_id % 23 = 0 THEN concat('This is a positive example. ', text) ELSE text END"""
_LABEL = "CAST(CASE WHEN doc_id % 29 = 0 THEN 7 ELSE coalesce(toxic, doc_id % 2) END AS INT)"
DS = f"""ds AS (SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS id, {_TEXT} AS text, {_LABEL} AS label, lang AS language
 FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id))"""


def ds(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").select("doc_id", "text", "lang").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return both.select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.expr(_TEXT).alias("text"), F.expr(_LABEL).alias("label"), F.col("lang").alias("language"))


def _draw(*parts: str) -> str:
    return f"CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8)) AS BIGINT)"


_STRIP = r"regexp_replace({0}, '^[\s]+|[\s]+$', '', 'g')"

# --- filters of one row

_NOT_BLANK = "text IS NOT NULL AND trim(text) <> ''"
_LEN = "length(text) BETWEEN 10 AND 1000"
_LEAKS = "|".join(f"({p})" for p in [*O.LEAKAGE_PATTERNS["generic"], *O.LEAKAGE_PATTERNS["en"]])
_LABEL_LEAKS = "|".join(rf"((?:label|class|category|classified\s+as)\s*[:=]?\s*{n})" for n in TASK.labels.values())
_NO_LEAK = f"NOT coalesce(regexp_matches(lower(text), '{_LEAKS}|{_LABEL_LEAKS}'), false)"
_FOUND = " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{k}') AS INT)" for k in TASK.marker_keywords[1])


def _kept(name: str, f: O.Filter, where: str) -> None:
    QUERIES[name] = lambda spark, sf: f.apply(ds(spark, sf)).select("ord", "label")
    ORACLE_SQL[name] = f"WITH {DS} SELECT ord, label FROM ds WHERE {where}"


_kept("basic_null_blank", O.BasicFilter(min_length=0, max_length=1 << 30), _NOT_BLANK)
_kept("basic_labels", O.BasicFilter([0, 1], 0, 1 << 30), f"{_NOT_BLANK} AND label IN (0, 1)")
_kept("basic_length", O.BasicFilter(), f"{_NOT_BLANK} AND {_LEN}")
_kept("basic_all", O.BasicFilter([0, 1]), f"{_NOT_BLANK} AND {_LEN} AND label IN (0, 1)")
_kept("leakage_generic", O.LeakageFilter(language="xx"), "NOT coalesce(regexp_matches(lower(text), '" + "|".join(O.LEAKAGE_PATTERNS["generic"]) + "'), false)")
_kept("leakage_en", O.LeakageFilter(), f"NOT coalesce(regexp_matches(lower(text), '{_LEAKS}'), false)")
_kept("leakage_task_labels", O.LeakageFilter(TASK.labels), _NO_LEAK)
_kept("leakage_custom", O.LeakageFilter(patterns={"generic": [r"\btoxic\b"]}), r"NOT coalesce(regexp_matches(lower(text), '\btoxic\b'), false)")
_kept("markers_min1", O.MarkerFilter(TASK), f"label IS DISTINCT FROM 1 OR ({_FOUND}) >= 1")
_kept("markers_min2", O.MarkerFilter(TASK, 2), f"label IS DISTINCT FROM 1 OR ({_FOUND}) >= 2")
_kept("blocklist_custom_filter", O.BlocklistFilter(["scum", "trash"]), "NOT (contains(lower(coalesce(text, '')), 'scum') OR contains(lower(coalesce(text, '')), 'trash'))")

# --- similarity


def _tf(base: str, name: str = "tf") -> str:
    return f"""{name}_w AS (SELECT ord, unnest(string_split_regex(lower(coalesce(text, '')), '\\s+')) AS word FROM {base}),
 {name} AS (SELECT ord, word, CAST(count(*) AS BIGINT) AS n FROM {name}_w WHERE word <> '' GROUP BY ALL),
 {name}_n AS (SELECT ord, CAST(sum(n * n) AS HUGEINT) AS norm2 FROM {name} GROUP BY ord)"""


def _greedy(nodes: str, edges: str) -> str:
    """Rows in order; a row stays unless one that stays is tied to it. One step for each row that has an earlier tie."""
    return f"""nb AS MATERIALIZED (SELECT j, list(i) AS prev, row_number() OVER (ORDER BY j) AS rn FROM {edges} GROUP BY j),
 walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS gone UNION ALL
  SELECT w.rn + 1, CASE WHEN len(list_filter(nb.prev, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, nb.j) ELSE w.gone END FROM walk w JOIN nb ON nb.rn = w.rn + 1),
 gone AS (SELECT unnest(gone) AS ord FROM walk WHERE rn = (SELECT max(rn) FROM walk)),
 kept AS (SELECT ord FROM {nodes} WHERE ord NOT IN (SELECT ord FROM gone))"""


def _tf_edges(percent: int) -> str:
    return f"""edges AS MATERIALIZED (SELECT a.ord AS i, b.ord AS j FROM tf a JOIN tf b ON a.word = b.word AND a.ord < b.ord JOIN tf_n x ON x.ord = a.ord JOIN tf_n y ON y.ord = b.ord
 GROUP BY a.ord, b.ord, x.norm2, y.norm2 HAVING CAST(sum(a.n * b.n) AS HUGEINT) * CAST(sum(a.n * b.n) AS HUGEINT) * 10000 >= x.norm2 * y.norm2 * {percent * percent})"""


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")


@query(f"WITH RECURSIVE d AS (SELECT doc_id AS ord, text FROM documents), {_tf('d')}, {_tf_edges(90)}, {_greedy('d', 'edges')} SELECT ord FROM kept")
def dedup_tf_intra_090(spark, sf):
    return O.SimilarityDeduplicator(0.90).apply(_docs(spark, sf)).select("ord")


_VECS = "v AS (SELECT vec_id AS ord, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"
_VEDGES = "edges AS MATERIALIZED (SELECT a.ord AS i, b.ord AS j FROM v a JOIN v b ON a.ord < b.ord WHERE list_cosine_similarity(a.e, b.e) >= 0.4)"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vector"), "label")


@query(f"WITH RECURSIVE {_VECS}, {_VEDGES}, {_greedy('v', 'edges')} SELECT ord FROM kept")
def dedup_embedding_intra_040(spark, sf):
    return O.SimilarityDeduplicator(0.40, encoder=lambda d: d).apply(_vectors(spark, sf)).select("ord")


@query(f"WITH {_VECS}, l AS (SELECT vec_id, label FROM embeddings) SELECT v.ord FROM v JOIN l ON l.vec_id = v.ord WHERE l.label < 5 AND NOT EXISTS (SELECT 1 FROM v o JOIN l m ON m.vec_id = o.ord WHERE m.label >= 5 AND list_cosine_similarity(v.e, o.e) >= 0.4)")
def dedup_embedding_cross(spark, sf):
    v = _vectors(spark, sf)
    own, other = v.where("label < 5"), v.where("label >= 5")
    near = similarity.dense_pairs(own, other, 0.40).select(F.col("i").alias("ord")).distinct()
    return own.join(near, "ord", "left_anti").select("ord")


@query(
    f"""WITH RECURSIVE {_VECS}, l AS (SELECT vec_id, label FROM embeddings), own AS (SELECT v.ord, v.e FROM v JOIN l ON l.vec_id = v.ord WHERE label < 5), other AS (SELECT v.e FROM v JOIN l ON l.vec_id = v.ord WHERE label >= 5),
 edges AS MATERIALIZED (SELECT a.ord AS i, b.ord AS j FROM own a JOIN own b ON a.ord < b.ord WHERE list_cosine_similarity(a.e, b.e) >= 0.35), {_greedy('own', 'edges')}
 SELECT ord FROM kept JOIN own USING (ord) WHERE NOT EXISTS (SELECT 1 FROM other o WHERE list_cosine_similarity(own.e, o.e) >= 0.35)"""
)
def dedup_combined(spark, sf):
    v = _vectors(spark, sf)
    return O.SimilarityDeduplicator(0.35, encoder=lambda d: d, original=v.where("label >= 5")).apply(v.where("label < 5")).select("ord")


@query(f"WITH {_VECS}, l AS (SELECT vec_id, label FROM embeddings) SELECT v.ord, round(max(list_cosine_similarity(v.e, o.e)), 4) AS max_similarity FROM v JOIN l ON l.vec_id = v.ord AND l.label < 5 CROSS JOIN v o JOIN l m ON m.vec_id = o.ord AND m.label >= 5 GROUP BY v.ord")
def max_similarity_to_original(spark, sf):
    v = _vectors(spark, sf)
    return similarity.most_similar(v.where("label < 5"), v.where("label >= 5")).select("ord", F.round("max_similarity", 4).alias("max_similarity"))


@query("SELECT min(doc_id) AS ord FROM documents GROUP BY lower(trim(text))")
def dedup_exact_intra(spark, sf):
    return _docs(spark, sf).groupBy(F.lower(F.trim("text")).alias("k")).agg(F.min("ord").alias("ord")).select("ord")


# --- judge

_JUDGED = _draw("'42'", "id")


@query(f"WITH {DS}, r AS (SELECT ord, row_number() OVER (ORDER BY {_JUDGED}, id) AS rank FROM ds) SELECT ord, rank <= (SELECT greatest(1, CAST(floor(count(*) * 0.3) AS BIGINT)) FROM ds) AS judged FROM r")
def judge_exact_k(spark, sf):
    judged, others = O.JudgeFilter(None, 0.3).split(ds(spark, sf))
    return judged.select("ord", F.lit(True).alias("judged")).unionByName(others.select("ord", F.lit(False).alias("judged")))


_ANSWER = """concat('{"realistic": ', CASE WHEN ord % 2 = 0 THEN 'true' ELSE 'false' END, ', "label_correct": ', CASE WHEN ord % 3 = 0 THEN '"true"' ELSE 'true' END, ', "natural_language": true, "no_artifacts": ', CASE WHEN ord % 5 = 0 THEN 'null' ELSE 'true' END, '}')"""
_SUM = "CAST((CASE WHEN ord % 2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN ord % 3 = 0 THEN 0 ELSE 1 END) + 1 + (CASE WHEN ord % 5 = 0 THEN 0 ELSE 1 END) AS INT)"


@query(f"WITH {DS} SELECT ord, {_SUM} AS passing FROM ds")
def judge_criteria_sum(spark, sf):
    return ds(spark, sf).withColumn("raw", F.expr(_ANSWER)).select("ord", criteria_of(F.col("raw"), O.CRITERIA).cast("int").alias("passing"))


@query(f"WITH {DS} SELECT ord FROM ds WHERE ord % 7 = 0 OR (ord % 7 <> 1 AND {_SUM} >= 3)")
def judge_filter_jsoncol(spark, sf):
    """A seventh of the calls fails (those rows pass), a seventh gives no JSON (those go)."""
    answer = F.when(F.col("ord") % 7 == 0, F.lit(None).cast("string")).when(F.col("ord") % 7 == 1, F.lit("no idea")).otherwise(F.expr(_ANSWER))
    return O.JudgeFilter(lambda d: d.withColumn("raw", answer), min_passing=3).apply(ds(spark, sf)).select("ord")


# --- words and texts

_WORDS = "list_filter(string_split_regex(lower(coalesce({0}, '')), '\\s+'), lambda x: x <> '')"
_PAIRED = "p AS (SELECT a.doc_id AS ord, a.text AS a, b.text AS b FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)"
_JACCARD = """s AS (SELECT ord, list_distinct({0}) AS x, list_distinct({1}) AS y FROM p),
 j AS (SELECT ord, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE CAST(len(list_intersect(x, y)) AS DOUBLE) / (len(x) + len(y) - len(list_intersect(x, y))) END AS s FROM s)""".format(_WORDS.format("a"), _WORDS.format("b"))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.col("doc_id").alias("ord"), F.col("text").alias("a")).join(d.select((F.col("doc_id") - 1).alias("ord"), F.col("text").alias("b")), "ord")


@query(f"WITH {_PAIRED}, {_JACCARD} SELECT ord, round(CAST(s AS DOUBLE), 6) AS similarity FROM j")
def jaccard_consistency(spark, sf):
    return _neighbours(spark, sf).select("ord", F.round(T.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@query(f"WITH {_PAIRED}, {_JACCARD} SELECT ord FROM j WHERE s >= 0.1")
def translation_filter_precomputed(spark, sf):
    df = _neighbours(spark, sf).withColumnsRenamed({"a": "back_translated", "b": "english_original"})
    return O.TranslationQualityFilter(threshold=0.1).apply(df).select("ord")


@query(r"""SELECT doc_id AS ord, CASE doc_id % 5 WHEN 0 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN 1 THEN regexp_replace(text, '^\s+|\s+$', '', 'g')
 WHEN 2 THEN regexp_replace(text, '^\s+|\s+$', '', 'g') WHEN 3 THEN concat('is ', regexp_replace(text, '^\s+|\s+$', '', 'g')) ELSE '' END AS text FROM documents""")
def clean_text_prefixes(spark, sf):
    t = F.col("text")
    made = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("Here is: "), t)).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("  social media POST: "), t, F.lit("\n"))).when(F.col("doc_id") % 5 == 2, F.concat(F.lit("Text: - "), t)).when(F.col("doc_id") % 5 == 3, F.concat(F.lit("Result: is "), t))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), T.clean_generated(made).alias("text"))


@query(r"SELECT doc_id AS ord, CASE doc_id % 3 WHEN 2 THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END AS text FROM documents")
def clean_text_quotes(spark, sf):
    t = F.col("text")
    made = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(' "'), t, F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Output: '"), t, F.lit("' "))).otherwise(F.lit('"'))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), T.clean_generated(made).alias("text"))


@query(f"SELECT doc_id AS ord, CAST(len(list_distinct({_WORDS.format('text')})) AS INT) AS n_words, md5(array_to_string(list_sort(list_distinct({_WORDS.format('text')})), ' ')) AS words_md5 FROM documents")
def word_set(spark, sf):
    w = T.words(F.col("text"))
    # By hash of the sorted set: byte order in both engines.
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.size(w).alias("n_words"), F.md5(F.array_join(F.array_sort(w), " ").cast("binary")).alias("words_md5"))


@query("SELECT doc_id AS ord, substr(text, 1, 200) AS preview, sha256(text) AS hash FROM documents")
def preview_hash(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), T.preview(F.col("text")).alias("preview"), T.content_hash(F.col("text")).alias("hash"))


@query("SELECT doc_id AS ord, concat('direct_syn_', substr(md5(concat_ws('_', 'direct', 'direct', CAST(doc_id AS VARCHAR), 'run')), 1, 12)) AS id FROM documents")
def sample_id(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), T.sample_id("direct", "direct", F.col("doc_id"), "run").alias("id"))


# --- answers

_WS = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


def _whole_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("text").alias("t"))


def _q(c) -> F.Column:
    """A text as a JSON string."""
    return F.substring(F.to_json(F.struct(c.alias("v"))), F.lit(6), F.length(F.to_json(F.struct(c.alias("v")))) - 6)


def _qa(d: DataFrame) -> DataFrame:
    q = _q(F.col("t"))
    raw = F.when(F.col("ord") % 4 == 0, F.concat(F.lit('{"qa_pairs": [{"question": '), q, F.lit(', "answer": " yes "}, {"question": 1, "answer": "x"}, {"question": "second", "answer": "no"}]}')))
    raw = raw.when(F.col("ord") % 4 == 3, F.lit("not json")).otherwise(F.concat(F.lit('{"qa_pairs": [{"question": '), q, F.lit(', "answer": "yes"}, {"question": "  ", "answer": "no"}]}')))
    return d.withColumn("raw", raw).select("ord", F.posexplode(question_pairs_of(F.col("raw"))).alias("k", "p")).select("ord", "k", "p.question", "p.answer")


@query(f"""SELECT doc_id AS ord, CAST(0 AS INT) AS k, {_WS} AS question, 'yes' AS answer FROM documents WHERE doc_id % 4 <> 3 AND {_WS} <> ''
 UNION ALL SELECT doc_id, CASE WHEN {_WS} <> '' THEN 1 ELSE 0 END, 'second', 'no' FROM documents WHERE doc_id % 4 = 0""")
def json_qa_explode(spark, sf):
    return _qa(_whole_text(spark, sf))


def _shapes(d: DataFrame) -> DataFrame:
    q, shape = _q(F.col("t")), F.col("ord") % 6
    raw = F.when(shape == 0, F.concat(F.lit('{"samples": [{"text": '), q, F.lit('}, {"text": 5}, "more"]}'))).when(shape == 1, F.concat(F.lit('{"samples": {"text": '), q, F.lit("}}")))
    raw = raw.when(shape == 2, F.concat(F.lit('{"generated_texts": ['), q, F.lit(', "more"]}'))).when(shape == 3, F.concat(F.lit('{"output": '), q, F.lit("}"))).when(shape == 4, F.concat(F.lit('{"sample": {"text": '), q, F.lit("}}"))).otherwise(F.lit('{"other": 1}'))
    return d.withColumn("raw", raw).select("ord", F.posexplode(sample_texts_of(F.col("raw"))).alias("k", "text"))


@query("SELECT doc_id AS ord, CAST(0 AS INT) AS k, text FROM documents WHERE doc_id % 6 <> 5 UNION ALL SELECT doc_id, 1, 'more' FROM documents WHERE doc_id % 6 IN (0, 2)")
def json_samples_shapes(spark, sf):
    return _shapes(_whole_text(spark, sf))


def _fenced(d: DataFrame) -> DataFrame:
    q = _q(F.col("t"))
    raw = F.when(F.col("ord") % 2 == 0, F.concat(F.lit("Sure!\n```json\n{\"text\": "), q, F.lit("}\n```\nDone {x}"))).otherwise(F.concat(F.lit("a { b [{\"text\": "), q, F.lit("}] c")))
    return d.withColumn("raw", raw).select("ord", F.element_at(sample_texts_of(F.col("raw")), 1).alias("text"))


@query("SELECT doc_id AS ord, text FROM documents")
def json_fenced(spark, sf):
    return _fenced(_whole_text(spark, sf))


def _contrastive(d: DataFrame, a: F.Column, b: F.Column) -> DataFrame:
    way = F.col("ord") % 6
    raw = F.when(way == 0, F.concat(F.lit('{"civil": '), _q(a), F.lit(', "abusive": '), _q(b), F.lit("}"))).when(way == 1, F.concat(a, F.lit("\n---\n"), b)).when(way == 2, F.concat(F.lit("1. "), a, F.lit("\n2) "), b))
    raw = raw.when(way == 3, F.concat(F.lit("abusive: "), b, F.lit("\ncivil: "), a)).when(way == 4, F.concat(a, F.lit("\n\n"), b)).otherwise(F.lit("one line"))
    return d.withColumn("raw", raw).withColumn("pair", contrastive_pair_of(F.col("raw"), ("civil", "abusive"))).where("pair IS NOT NULL").select("ord", F.col("pair")[0].alias("first"), F.col("pair")[1].alias("second"))


# The texts have no line that is a rule or begins with a number; where they have a blank line or a break, the
# first two lines are a pair too.
@query(
    f"""WITH d AS (SELECT doc_id AS ord, {_WS} AS a, regexp_replace(concat('good ', text), '^\\s+|\\s+$', '', 'g') AS b FROM documents),
 l AS (SELECT ord, list_filter(list_transform(string_split(concat(a, chr(10), chr(10), b), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM d)
 SELECT ord, CASE ord % 6 WHEN 4 THEN l[1] ELSE a END AS first, CASE ord % 6 WHEN 4 THEN l[2] ELSE b END AS second FROM d JOIN l USING (ord) WHERE ord % 6 <> 5"""
)
def contrastive_parse_cascade(spark, sf):
    return _contrastive(_whole_text(spark, sf), F.col("t"), F.concat(F.lit("good "), F.col("t")))


# --- reports


@query(f"WITH {DS} SELECT label, count(*) AS n FROM ds WHERE label IS NOT NULL GROUP BY label")
def class_distribution(spark, sf):
    return reports.class_distribution(ds(spark, sf))


@query("WITH a AS (SELECT unnest(['en', 'de', 'fr', 'it']) AS language), c AS (SELECT a.language, count(d.lang) AS n FROM a LEFT JOIN documents d ON d.lang = a.language GROUP BY a.language) SELECT language, n, CASE WHEN n > 0 THEN 'ok' ELSE 'FAIL' END AS status FROM c UNION ALL SELECT 'TOTAL', CAST(sum(n) AS BIGINT), 'ok' FROM c")
def language_summary(spark, sf):
    return reports.language_summary(ds(spark, sf), ["en", "de", "fr", "it"])


@query(f"WITH {DS} SELECT DISTINCT label FROM ds WHERE label IS NOT NULL")
def distinct_labels(spark, sf):
    return reports.distinct_labels(ds(spark, sf))


# --- sampling


@query(f"WITH {DS}, r AS (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY {_JUDGED}, id) AS rn FROM ds WHERE label IS NOT NULL) SELECT ord, label FROM r WHERE rn <= 20")
def sample_balanced(spark, sf):
    return sampling.balanced(ds(spark, sf), 20).select("ord", "label")


_NUMBERED = "r AS (SELECT ord, label, row_number() OVER (ORDER BY id) - 1 AS rn FROM ds)"
_NO = _draw("'42'", "CAST(draw_no AS VARCHAR)")


@query(f"WITH {DS}, {_NUMBERED}, d AS (SELECT range AS draw_no FROM range(500)) SELECT draw_no, ord FROM d JOIN r ON r.rn = {_NO} % (SELECT count(*) FROM ds)")
def sample_replacement(spark, sf):
    return sampling.with_replacement(ds(spark, sf), 500).select("draw_no", "ord")


@query(
    f"""WITH {DS}, r AS (SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS rn FROM ds WHERE label IS NOT NULL),
 l AS (SELECT label, count(*) AS size, row_number() OVER (ORDER BY label) - 1 AS k, count(*) OVER () AS nl FROM r GROUP BY label),
 q AS (SELECT *, 500 // nl + CASE WHEN k < 500 % nl THEN 1 ELSE 0 END AS many FROM l), f AS (SELECT *, sum(many) OVER (ORDER BY k) - many AS first FROM q),
 d AS (SELECT range AS draw_no FROM range(500)), e AS (SELECT draw_no, label, {_NO} % size AS rn FROM d JOIN f ON draw_no >= first AND draw_no < first + many)
 SELECT draw_no, label, ord FROM e JOIN r USING (label, rn)"""
)
def sample_balanced_replacement(spark, sf):
    return sampling.balanced_with_replacement(ds(spark, sf), 500).select("draw_no", "label", "ord")


def _topic_sql(index: str, seed: int = 42) -> str:
    groups = list(TASK.topics.values())
    group = f"{_draw(f"'{seed}'", "'category'", index)} % {len(groups)}"
    topic = _draw(f"'{seed}'", "'topic'", index)
    return "CASE " + " ".join(f"WHEN {group} = {i} THEN [{', '.join(repr(t) for t in g)}][{topic} % {len(g)} + 1]" for i, g in enumerate(groups)) + " END"


@query(f"SELECT doc_id AS ord, {_topic_sql('CAST(doc_id AS VARCHAR)')} AS topic FROM documents")
def topic_pick(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), sampling.topic_of(TASK.topics, 42, F.col("doc_id")).alias("topic"))


# --- shares


@query("SELECT * FROM (VALUES ('direct', 6), ('paraphrase', 2), ('contrastive', 2)) t(strategy, n)")
def allocate_strategies(spark, sf):
    names = ["direct", "paraphrase", "contrastive"]
    return spark.createDataFrame(list(zip(names, allocate(10, normalised([5, 2.5, 2.5], 3)), strict=True)), "strategy string, n int")


@query("SELECT * FROM (VALUES (0, 3), (1, 2), (2, 2)) t(label, n)")
def label_distribution_equal(spark, sf):
    return spark.createDataFrame(list(label_counts(7, [0, 1, 2]).items()), "label int, n int")


@query("SELECT * FROM (VALUES (0, 2), (1, 3)) t(label, n)")
def label_distribution_ratio(spark, sf):
    return spark.createDataFrame(list(label_counts(5, [0, 1], {0: 1.0, 1: 1.0}).items()), "label int, n int")


# --- prompts


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_prompt(strategy: str, **values: str) -> str:
    low, high = TASK.word_count_range
    known = {"task_name": _sql_text(TASK.name), "task_description": _sql_text(TASK.description), "text_domain": _sql_text(TASK.text_domain), "word_min": f"'{low}'", "word_max": f"'{high}'"} | values
    label = values.get("label", "label")
    for name, text in (("label_name", TASK.label_name), ("label_description", TASK.label_description)):
        known[name] = f"CASE {label} WHEN 0 THEN {_sql_text(text(0))} WHEN 1 THEN {_sql_text(text(1))} ELSE '' END"
        known[f"other_{name}"] = f"CASE {label} WHEN 0 THEN {_sql_text(text(1))} WHEN 1 THEN {_sql_text(text(0))} ELSE '' END"
    parts = [p for text, name, _, _ in string.Formatter().parse(TEMPLATES[strategy]) for p in ([_sql_text(text)] if text else []) + ([f"coalesce({known[name]}, '')"] if name else [])]
    return f"concat({', '.join(parts)})"


def _prompt_query(name: str, strategy: str, values: dict[str, str], columns: Callable[[], dict]) -> None:
    def run(spark, sf):
        df = ds(spark, sf)
        return df.select("ord", F.md5(PromptRenderer(TASK).render(strategy, F.col("language"), F.col("label"), **columns()).cast("binary")).alias("prompt_md5"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH {DS} SELECT ord, md5({_sql_prompt(strategy, language='language', **values)}) AS prompt_md5 FROM ds"


_prompt_query("prompt_direct", "direct", {"topic": "CASE WHEN ord % 2 = 0 THEN 'traffic' ELSE 'any relevant topic' END"}, lambda: {"topic": F.expr("CASE WHEN ord % 2 = 0 THEN 'traffic' END")})
_prompt_query("prompt_paraphrase", "paraphrase", {"text": "text"}, lambda: {"text": F.col("text")})
_prompt_query("prompt_contrastive", "contrastive", {"topic": "'films'"}, lambda: {"topic": "films"})
_prompt_query("prompt_judge", "judge", {"text": "text"}, lambda: {"text": F.col("text")})
_prompt_query("prompt_rag", "rag_qa", {"chunk": "text", "num_samples": "'3'"}, lambda: {"chunk": F.col("text"), "num_samples": 3})
_prompt_query("prompt_restyle", "templated_generation", {"text": "text", "source_topic": "'cars'", "target_topic": "'gardens'", "style": "'short'", "num_samples": "'2'"}, lambda: {"text": F.col("text"), "source_topic": "cars", "target_topic": "gardens", "style": "short", "num_samples": 2})

# --- strategies, with backends that are expressions

ECHO = ColumnProvider(lambda prompt: F.concat(F.lit("Here is: text "), F.md5(prompt.cast("binary"))))
TAG = ColumnProvider(lambda text, source, target: F.concat(text, F.lit(" "), source, F.lit(">"), target))


def _run(spark: SparkSession, provider=ECHO) -> S.Run:
    return S.Run(spark, TASK, provider, TAG, LANGS)


def _id_sql(prefix: str, source: str, index: str = "CAST(ord AS VARCHAR)") -> str:
    return f"concat('{prefix}_syn_', substr(md5(concat_ws('_', '{prefix}', '{source}', {index}, 'run')), 1, 12))"


def _direct_sql(n: int, language: str) -> str:
    half = (n + 1) // 2
    return f"""plan AS (SELECT range AS ord, CAST(CASE WHEN range < {half} THEN 0 ELSE 1 END AS INT) AS label, {_topic_sql('CAST(range AS VARCHAR)')} AS topic FROM range({n})),
 asked AS (SELECT ord, label, topic, concat('text ', md5({_sql_prompt('direct', language=_sql_text(language), topic='topic')})) AS text FROM plan)"""


_DIRECT = f"WITH {_direct_sql(301, 'English')} SELECT ord, {_id_sql('direct', 'direct')} AS id, text, label, topic, CASE label WHEN 0 THEN 'civil' ELSE 'abusive' END AS label_name FROM asked"


def _direct_out(df: DataFrame) -> DataFrame:
    return df.select("ord", "id", "text", "label", "metadata.topic", "metadata.label_name")


@query(_DIRECT)
def gen_direct(spark, sf):
    return _direct_out(S.direct(_run(spark), "en", 301))


@query(_DIRECT)
def gen_direct_python_provider(spark, sf):
    """The same by a Python backend, one client for each task."""
    import hashlib

    class Echo:
        def generate(self, prompt: str, **_) -> str:
            return "Here is: text " + hashlib.md5(prompt.encode()).hexdigest()

    return _direct_out(S.direct(_run(spark, Echo), "en", 301))


_ORIGINAL = "o AS (SELECT CAST(doc_id AS VARCHAR) AS id, text, CAST(coalesce(toxic, doc_id % 2) AS INT) AS label FROM documents LEFT JOIN (SELECT doc_id, toxic FROM labels) USING (doc_id))"


def _original(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return both.select(F.col("doc_id").cast("string").alias("id"), "text", F.coalesce("toxic", F.col("doc_id") % 2).cast("int").alias("label"))


@query(
    f"""WITH {_ORIGINAL}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn FROM o), d AS (SELECT range AS draw_no FROM range(200)),
 x AS (SELECT draw_no AS ord, r.id AS original_id, r.text, r.label FROM d JOIN r ON r.rn = {_NO} % (SELECT count(*) FROM o))
 SELECT ord, {_id_sql('para', 'paraphrase')} AS id, concat('text ', md5({_sql_prompt('paraphrase', language="'English'", text='text')})) AS text, label, original_id FROM x"""
)
def gen_paraphrase(spark, sf):
    return S.paraphrase(_run(spark), "en", 200, original=_original(spark, sf)).select("ord", "id", "text", "label", "metadata.original_id")


@query(
    f"""WITH p AS (SELECT range AS pair_id FROM range(51)), b AS (SELECT pair_id, k AS side, pair_id * 2 + k AS ord FROM p CROSS JOIN (SELECT unnest([0, 1]) AS k))
 SELECT CAST(ord AS BIGINT) AS ord, {_id_sql('contrast', 'contrastive')} AS id, CASE side WHEN 0 THEN 'A fine thing' ELSE 'A bad thing' END AS text, CAST(side AS INT) AS label, CAST(pair_id AS INT) AS pair_id FROM b WHERE ord < 101"""
)
def gen_contrastive(spark, sf):
    answer = ColumnProvider(lambda prompt: F.lit('{"civil": "A fine thing", "abusive": "A bad thing"}'))
    return S.contrastive(_run(spark, answer), "en", 101).select("ord", "id", "text", "label", "metadata.pair_id")


@query(
    f"""WITH {_ORIGINAL}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY label) AS size FROM o), d AS (SELECT range AS draw_no FROM range(201)),
 e AS (SELECT draw_no, CASE WHEN draw_no < 101 THEN 0 ELSE 1 END AS label FROM d),
 x AS (SELECT draw_no AS ord, r.id AS original_id, regexp_replace(r.text, '^\\s+|\\s+$', '', 'g') AS text, r.label, CASE WHEN draw_no % 2 = 0 THEN 'en' ELSE 'es' END AS pv FROM e JOIN r ON r.label = e.label AND r.rn = {_NO} % r.size)
 SELECT ord, {_id_sql('bt', 'backtranslation')} AS id, concat(text, ' de>', pv, ' ', pv, '>de') AS text, label, original_id, pv AS pivot_language FROM x"""
)
def gen_backtranslation(spark, sf):
    return S.backtranslation(_run(spark), "de", 201, original=_original(spark, sf), pivots=("en", "de", "es")).select("ord", "id", "text", "label", "metadata.original_id", "metadata.pivot_language")


@query(
    f"""WITH plan AS (SELECT range AS ord, CAST(CASE WHEN range < 50 THEN 0 ELSE 1 END AS INT) AS label, {_topic_sql('CAST(range AS VARCHAR)')} AS topic, range < 30 AS cross_lingual FROM range(100)),
 asked AS (SELECT *, concat('text ', md5({_sql_prompt('direct', language="CASE WHEN cross_lingual THEN 'French' ELSE 'English' END", topic='topic')})) AS src FROM plan)
 SELECT ord, {_id_sql('pivot', 'pivot')} AS id, concat(src, CASE WHEN cross_lingual THEN ' fr>es' ELSE ' en>es' END) AS text, label, cross_lingual, CASE WHEN NOT cross_lingual THEN src END AS english_original FROM asked"""
)
def gen_pivot(spark, sf):
    return S.pivot(_run(spark), "es", 100, cross_lingual=True).select("ord", "id", "text", "label", "metadata.cross_lingual", "metadata.english_original")


_CHUNKS = r"c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS chunk FROM documents)"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text")


@query(
    f"""WITH {_CHUNKS}, k AS (SELECT unnest([0, 1]) AS k), x AS (SELECT c.*, k.k, md5({_sql_prompt('rag_qa', language="'English'", chunk='chunk', num_samples="'2'")}) AS h FROM c CROSS JOIN k WHERE chunk <> '')
 SELECT {_id_sql('ragqa', 'rag_qa', "concat_ws('/', chunk_id, CAST(k AS VARCHAR))")} AS id, CASE k WHEN 0 THEN concat('q ', h) ELSE 'q2' END AS question, CASE k WHEN 0 THEN 'a' ELSE 'a2' END AS answer, sha256(chunk) AS chunk_hash, substr(chunk, 1, 200) AS chunk_preview FROM x"""
)
def gen_rag_qa(spark, sf):
    answer = ColumnProvider(lambda p: F.concat(F.lit('Well: {"qa_pairs": [{"question": "q '), F.md5(p.cast("binary")), F.lit('", "answer": "a"}, {"question": "", "answer": "x"}, {"question": "q2", "answer": " a2 "}, {"question": "q3", "answer": "a3"}]}')))
    return S.questions(_run(spark, answer), _chunks(spark, sf), 2).select("id", "question", "answer", "metadata.chunk_hash", "metadata.chunk_preview")


@query(
    f"""WITH {_CHUNKS}, x AS (SELECT *, md5({_sql_prompt('templated_generation', language="'English'", text='chunk', source_topic="'cars'", target_topic="'gardens'", style="'short'", num_samples="'1'")}) AS h FROM c WHERE chunk <> '')
 SELECT {_id_sql('templated', 'templated_generation', "concat_ws('/', chunk_id, '0')")} AS id, concat('new ', h) AS text, sha256(chunk) AS source_text_hash, 'gardens' AS target_topic FROM x"""
)
def gen_restyle(spark, sf):
    answer = ColumnProvider(lambda p: F.concat(F.lit('{"texts": [" ", "Text: new '), F.md5(p.cast("binary")), F.lit('", "more"]}')))
    return S.restyled(_run(spark, answer), _chunks(spark, sf), "cars", "gardens", "short").select("id", "text", "metadata.source_text_hash", "metadata.target_topic")


@query(
    f"""WITH {_direct_sql(60, 'English')}, {_ORIGINAL}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn FROM o), d AS (SELECT range AS draw_no FROM range(40)),
 x AS (SELECT draw_no AS ord, r.text AS src, r.label FROM d JOIN r ON r.rn = {_NO} % (SELECT count(*) FROM o))
 SELECT 'direct' AS source, text, label FROM asked UNION ALL SELECT 'paraphrase', concat('text ', md5({_sql_prompt('paraphrase', language="'English'", text='src')})), label FROM x"""
)
def gen_multi_strategy(spark, sf):
    return DatasetBuilder(_run(spark)).raw("en", 100, ["direct", "paraphrase"], [3, 2], _original(spark, sf)).select("source", "text", "label")


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_direct_sql(50, name)} SELECT '{code}' AS language, ord, text, label FROM asked)" for code, name in LANGS.languages.items()))
def gen_all_languages(spark, sf):
    df, errors = DatasetBuilder(_run(spark)).generate_all(50, ["direct"], apply_filters=False)
    if errors:
        raise RuntimeError(errors)
    return df.select("language", "ord", "text", "label")


# --- backends that are clients


class EchoClient:
    """Answers with a hash of the prompt; knows no response_format."""

    def generate(self, prompt: str, *, temperature: float = 0.9, max_tokens: int = 250) -> str:
        import hashlib

        return "Here is: text " + hashlib.md5(prompt.encode()).hexdigest()


@query(_DIRECT)
def gen_direct_by_name(spark, sf):
    """The client by the name it has in the registry."""
    providers.REGISTRY["echo"] = EchoClient
    return _direct_out(S.direct(_run(spark, "echo"), "en", 301))


@query(f"WITH {_direct_sql(301, 'English')} SELECT ord, concat('Here is: ', text) AS raw, CAST(NULL AS VARCHAR) AS error FROM asked WHERE ord % 10 <> 0 UNION ALL SELECT ord, NULL, 'RuntimeError: never' FROM asked WHERE ord % 10 = 0")
def provider_retry(spark, sf):
    """A client that fails each first call, and some prompts always."""

    class Flaky(EchoClient):
        failed: set[str] = set()

        def generate(self, prompt: str, **options) -> str:
            if prompt.startswith("never "):
                raise RuntimeError("never")
            if prompt not in self.failed:
                self.failed.add(prompt)
                raise RuntimeError("at first")
            return super().generate(prompt, **options)

    run = _run(spark)
    plan = S.labelled_plan(run, 301).withColumn("topic", sampling.topic_of(TASK.topics, run.seed, F.col("ord")))
    plan = plan.withColumn("prompt", run.prompts.render("direct", "English", F.col("label"), topic=F.col("topic")))
    plan = plan.withColumn("prompt", F.when(F.col("ord") % 10 == 0, F.concat(F.lit("never "), "prompt")).otherwise(F.col("prompt")))
    return providers.answered(plan, Flaky, base_delay=0).select("ord", "raw", "error")


@query(f"WITH {DS} SELECT ord FROM ds WHERE ord % 3 <> 0")
def judge_without_json_mode(spark, sf):
    """A judge that knows no response_format: it is asked without, and what it finds bad goes."""

    class Judge:
        def generate(self, prompt: str, *, temperature: float = 0.9, max_tokens: int = 250) -> str:
            good = "false" if "[bad]" in prompt else "true"
            return f'{{"realistic": true, "label_correct": {good}, "natural_language": true, "no_artifacts": true}}'

    marked = ds(spark, sf).withColumn("text", F.when(F.col("ord") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" [bad]"))).otherwise(F.col("text")))
    return O.JudgeFilter(S.judge_of(_run(spark, Judge))).apply(marked).select("ord")


# --- whole pipelines

UNMARKED = replace(TASK, marker_keywords=None)
#: Says half of the texts again as they are, and writes others for the rest.
PARROT = ColumnProvider(lambda prompt: F.when(F.md5(prompt.cast("binary")) < "8", F.regexp_extract(prompt, r"(?s)\nText:\n(.*)\nAnswer with nothing but", 1)).otherwise(F.concat(F.lit("text "), F.md5(prompt.cast("binary")))))


@query(
    f"""WITH {_ORIGINAL}, r AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS rn FROM o), d AS (SELECT range AS draw_no FROM range(200)),
 x AS (SELECT draw_no AS ord, r.label, md5({_sql_prompt('paraphrase', language="'English'", text='text')}) AS h FROM d JOIN r ON r.rn = {_NO} % (SELECT count(*) FROM o))
 SELECT min(ord) AS ord, any_value(label) AS label, concat('text ', h) AS text FROM x WHERE h >= '8' GROUP BY h"""
)
def gen_filtered_cross(spark, sf):
    """With the usual filters: what says an original text again goes, and of equal new texts all but the first."""
    run = S.Run(spark, UNMARKED, PARROT, TAG, LANGS)
    return DatasetBuilder(run).generate("en", 200, ["paraphrase"], original=_original(spark, sf)).select("ord", "label", "text")


@query(" UNION ALL ".join(f"SELECT * FROM (WITH {_direct_sql(50, name)} SELECT '{code}' AS language, min(ord) AS ord, text, min(label) AS label FROM asked GROUP BY text)" for code, name in LANGS.languages.items()))
def gen_all_filtered(spark, sf):
    """All languages in one job; texts that languages share stay in each."""
    df, errors = DatasetBuilder(S.Run(spark, UNMARKED, ECHO, TAG, LANGS)).generate_all(50, ["direct"])
    if errors:
        raise RuntimeError(errors)
    return df.select("language", "ord", "text", "label")


_LIGHT = f"{_NOT_BLANK} AND {_LEN} AND label IN (0, 1) AND {_NO_LEAK} AND (label IS DISTINCT FROM 1 OR ({_FOUND}) >= 1)"


@query(f"WITH {DS} SELECT ord, id, text, label, language FROM ds WHERE {_LIGHT}")
def filter_pipeline_light(spark, sf):
    return O.FilterPipeline.default(TASK, use_embeddings=False).run(ds(spark, sf))


@query(f"WITH RECURSIVE {DS}, f AS (SELECT ord, text, label FROM ds WHERE {_NOT_BLANK} AND {_LEN} AND label IN (0, 1) AND {_NO_LEAK}), {_tf('f')}, {_tf_edges(90)}, {_greedy('f', 'edges')} SELECT ord, label FROM f JOIN kept USING (ord) WHERE label <> 1 OR ({_FOUND}) >= 1")
def filter_pipeline_default(spark, sf):
    return O.FilterPipeline.default(TASK).run(ds(spark, sf)).select("ord", "label")


@query(
    f"""WITH {DS}, k AS (SELECT ({_NOT_BLANK} AND {_LEN} AND label IN (0, 1)) IS TRUE AS a, {_NO_LEAK} AS b, (label IS DISTINCT FROM 1 OR ({_FOUND}) >= 1) AS c FROM ds),
 n AS (SELECT count(*) AS n0, count(*) FILTER (a) AS n1, count(*) FILTER (a AND b) AS n2, count(*) FILTER (a AND b AND c) AS n3 FROM k)
 SELECT CAST(1 AS INT) AS stage, 'BasicFilter' AS name, n0 AS n_before, n1 AS n_after, n0 - n1 AS n_removed FROM n UNION ALL SELECT 2, 'LeakageFilter', n1, n2, n1 - n2 FROM n UNION ALL SELECT 3, 'MarkerFilter', n2, n3, n2 - n3 FROM n"""
)
def filter_stage_stats(spark, sf):
    return O.FilterPipeline.default(TASK, use_embeddings=False).statistics(ds(spark, sf))


# --- files


def _new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex[:12]}"


@query(f"WITH {DS} SELECT id, text, label FROM ds WHERE text IS NOT NULL AND ord % 31 <> 0")
def csv_roundtrip_na(spark, sf):
    """Written as CSV and read back; a null label and a text that says NA go."""
    path = _new_path(spark)
    own = ds(spark, sf).select("id", F.when(F.col("ord") % 62 == 31, F.lit("NA")).otherwise(F.col("text")).alias("text"), F.when(F.col("ord") % 62 == 0, F.lit(None)).otherwise(F.col("label").cast("double")).alias("toxic"))
    files.save_csv(own, path)
    return files.load_samples(spark, path, "toxic").select("id", "text", "label")


@query(f"WITH {DS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(0 AS BIGINT) AS first, CAST(count(*) - 1 AS BIGINT) AS last, CAST(count(*) AS BIGINT) AS n_ids FROM ds")
def csv_dense_ids(spark, sf):
    """Files without ids: rows are numbered from 0."""
    path = _new_path(spark)
    files.save_csv(table(spark, sf, "documents").select("text", F.lit(1).alias("label")), path)
    ids = files.load_samples(spark, path).select(F.col("id").cast("long").alias("id"))
    return ids.agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.max("id").alias("last"), F.count_distinct("id").alias("n_ids"))


@query("SELECT doc_id AS ord, lang AS language, text FROM documents WHERE lang IN ('en', 'de', 'fr')")
def files_by_language(spark, sf):
    """A file of each language, of which one is not asked for and one is not there."""
    folder = _new_path(spark)
    own = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit(0).alias("label"), "lang")
    for code in ("en", "de", "fr", "es"):
        files.save_csv(own.where(F.col("lang") == code).drop("lang"), f"{folder}/{code}.csv")
    return files.load_by_language(spark, folder, ["en", "de", "fr", "it"]).select(F.col("id").cast("long").alias("ord"), "language", "text")


@query(f"WITH {DS} SELECT label, count(*) AS n FROM ds WHERE label IS NOT NULL GROUP BY label")
def json_output(spark, sf):
    import json

    made = json.loads(files.as_json(reports.class_distribution(ds(spark, sf))))
    return spark.createDataFrame([(r["label"], r["n"]) for r in made], "label int, n long")


# --- streams


@query("SELECT event_type AS label, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, count(*) AS n FROM events GROUP BY ALL")
def stream_label_counts(spark, sf):
    """Counts by window of a stream of files, one file a batch, as the last change of each count left them."""
    folder = _new_path(spark)
    events = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("label"))
    # A stream of several files, in the order of time.
    events.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    counts_to(counted_stream(stream, "ts", "1 hour", "36500 days"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return latest_counts(spark, f"{folder}/out").select("label", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")
