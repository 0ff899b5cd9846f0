"""Queries over records: splits, duplicates, joins, validation."""

from pyspark.sql import functions as F

from curalith.functions import text as X
from curalith.operators import dataset, duplicates, joins, leak, ranking, script, split, validation
from curalith.plans.registry import Registry, table
from curalith.plans.texts import _LEAKS, _OUTSIDE, VOCABULARY
from curalith.sources.tables import stored

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

_HOLD = "CASE WHEN {n} < 3 THEN 0 ELSE greatest(1, round_even({n} * 0.05::DOUBLE, 0))::BIGINT END"
_SPLIT = f"""
WITH g AS (SELECT lower(text) AS key, arg_min(coalesce(lang, 'unknown'), doc_id) AS category FROM documents GROUP BY 1),
  r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY sha256('42:' || key)) AS rank, count(*) OVER (PARTITION BY category) AS n FROM g),
  s AS (SELECT *, {_HOLD.format(n='n')} AS n_test FROM r),
  t AS (SELECT *, {_HOLD.format(n='(n - n_test)')} AS n_val FROM s),
  split AS (SELECT doc_id AS id, category, CASE WHEN rank <= n_test THEN 'test' WHEN rank <= n_test + n_val THEN 'val' ELSE 'train' END AS split FROM documents d JOIN t ON lower(d.text) = t.key)
"""


def _records(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("category"))


@query(_SPLIT + "SELECT * FROM split")
def split_assign(spark, sf_dir):
    return split.assign_splits(_records(spark, sf_dir))


@query(_SPLIT + "SELECT split, category, count(*) AS n FROM split GROUP BY ALL")
def split_summary(spark, sf_dir):
    return split.assign_splits(_records(spark, sf_dir)).groupBy("split", "category").agg(F.count("*").alias("n"))


@query("SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id)) AS rank FROM documents) WHERE rank <= 20")
def sample_topk(spark, sf_dir):
    return split.sample_by_hash(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 20)


@query(f"""WITH RECURSIVE keys(k, q, a, b, c) AS (VALUES {', '.join(f'({k}, {q}::BIGINT, {a}::BIGINT, {b}::BIGINT, {c}::BIGINT)' for k, (q, a, b, c) in enumerate(split.round_keys(42, 1)))}),
  p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, count(*) OVER () AS n, 0 AS k FROM documents
    UNION ALL SELECT doc_id, CASE WHEN (((v * v + c) % {split.PRIME}) >> 11) & 1 = 1 THEN y ELSE x END, n, k + 1
    FROM (SELECT *, (greatest(x, y) % {split.PRIME} * a + b) % {split.PRIME} AS v FROM (SELECT *, (q % n - x + n) % n AS y FROM p JOIN keys USING (k))))
SELECT doc_id, x // 16 AS batch, x % 16 AS place FROM p WHERE k = {split.ROUNDS} AND x < n // 16 * 16""")
def epoch_batches(spark, sf_dir):
    return split.epoch_batches(table(spark, sf_dir, "documents"), "doc_id", 16, 42, 1)


@query("SELECT doc_id, CASE WHEN text <> '' AND doc_id > f THEN f ELSE -1 END AS first_id FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY lower(text)) AS f FROM documents)")
def dup_first(spark, sf_dir):
    return duplicates.first_occurrence(table(spark, sf_dir, "documents"), F.when(F.col("text") != "", F.lower("text")), "doc_id", "doc_id").select("doc_id", F.coalesce("first_id", F.lit(-1)).alias("first_id"))


@query("""WITH a AS (SELECT 0 AS rank, item_id AS id, lower(text) AS key FROM benchmark UNION ALL SELECT 1, doc_id, lower(text) FROM documents)
SELECT id, coalesce(previous_id, -1) AS previous_id FROM (SELECT *, lag(id) OVER (PARTITION BY key ORDER BY rank, id) AS previous_id FROM a) WHERE rank = 1""")
def dup_prev(spark, sf_dir):
    rows = lambda name, key, rank: table(spark, sf_dir, name).select(F.lit(rank).alias("rank"), F.col(key).alias("id"), "text")
    both = rows("benchmark", "item_id", 0).unionByName(rows("documents", "doc_id", 1))
    return duplicates.previous_occurrence(both, F.lower("text"), ["rank", "id"], "id", F.struct("rank", F.floor(F.col("id") / 1_000_000).alias("million"))).filter("rank = 1").select("id", F.coalesce("previous_id", F.lit(-1)).alias("previous_id"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_labels(spark, sf_dir):
    return joins.missing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT l_partkey AS doc_id FROM lineitem WHERE l_partkey NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf_dir):
    return joins.missing(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc_id")), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT d.doc_id AS id, q IS NOT NULL AS has_text, CASE WHEN q IS NULL THEN 'no transcript for this audio file' ELSE '' END AS error, row_number() OVER (ORDER BY q IS NULL, pos, d.doc_id) AS k
FROM documents d LEFT JOIN (SELECT doc_id, quality AS q, -doc_id AS pos FROM labels) l ON l.doc_id = d.doc_id""")
def audio_transcripts(spark, sf_dir):
    scripts = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").cast("string").alias("text"), (-F.col("doc_id")).alias("pos"))
    joined = joins.with_transcripts(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), scripts)
    # the place in the whole order, by ranges: rows with a script first
    placed = joined.select("id", "has_text", F.array_join("errors", "; ").alias("error"), "place.orphan", F.coalesce("pos", "id").alias("at"))
    return ranking.numbered(placed, "orphan", "at", ["id"], "k").select("id", "has_text", "error", "k")


@query("SELECT clip_id FROM (SELECT doc_id::VARCHAR AS clip_id FROM documents) WHERE clip_id NOT IN (SELECT doc_id::VARCHAR FROM labels)")
def resume_todo(spark, sf_dir):
    ids = lambda name: table(spark, sf_dir, name).select(F.col("doc_id").cast("string").alias("clip_id"))
    return joins.todo(ids("documents"), ids("labels"))


@query("SELECT l.l_partkey AS doc_id, coalesce(d.source, 'unknown') AS category FROM (SELECT DISTINCT l_partkey FROM lineitem) l LEFT JOIN documents d ON d.doc_id = l.l_partkey")
def record_category(spark, sf_dir):
    """Parts stand for records, of which some have no document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("category"))
    return joins.with_category(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc_id")).distinct(), docs, "doc_id")


@query("SELECT category, count(*) AS n FROM (SELECT coalesce(source, 'unknown') AS category FROM documents) GROUP BY 1")
def category_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("source", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))


@query("SELECT item_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)")
def id_collisions(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi")


@query("""WITH s AS (SELECT lower(text) AS key, source, min(doc_id) AS id FROM documents WHERE source IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source) AS k FROM s)
SELECT doc_id, d.source, r.source AS other_script, r.id AS other_id FROM documents d JOIN (SELECT key, source FROM r WHERE k = 1) f ON f.key = lower(d.text) JOIN r ON r.key = f.key AND r.k = CASE WHEN f.source = d.source THEN 2 ELSE 1 END
WHERE f.key IN (SELECT key FROM r WHERE k = 2)""")
def text_collisions(spark, sf_dir):
    """A source's documents stand for a script."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return joins.text_collisions(docs, "text", "source", "doc_id").select("doc_id", "source", "other_script", "other_id")


@query(r"""WITH c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) = 1 THEN doc_id::VARCHAR ELSE doc_id || '_' || i END AS clip_id, l[i] AS clause FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM c)""")
def clip_clauses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joins.clauses(docs, F.filter(F.split("text", "\n"), lambda x: x != ""), "doc_id").select("doc_id", "clip_id", "clause")


_MARKS = "list_filter(['Ã', 'Ä', 'Å', 'Â±', '�', '﻿'], lambda m: contains(text, m))"
_FLAGS = _LEAKS + f""",
  f AS (SELECT d.doc_id, text, {_MARKS} AS marks, {_OUTSIDE} AS outside, first_gram FROM documents d LEFT JOIN found USING (doc_id)),
  e AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN ['empty transcript'] ELSE list_filter([CASE WHEN len(marks) > 0 THEN 'encoding problem in transcript: ' || array_to_string(marks, ' ') END,
    CASE WHEN len(outside) > 0 THEN 'unmappable characters: ' || array_to_string(outside, ' ') END, CASE WHEN first_gram IS NOT NULL THEN 'evaluation-set leakage: ' || first_gram END], lambda x: x IS NOT NULL) END AS errors FROM f)
"""


def _flagged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = leak.ngram_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "first_gram")
    # texts are judged where they are read: only ids and errors come to the join
    own = docs.select("doc_id", "source", validation.text_errors(F.col("text"), VOCABULARY).alias("own"))
    return own.join(found, "doc_id", "left").select("doc_id", "source", validation.with_leak(F.col("own"), F.col("first_gram")).alias("errors"))


@query(_FLAGS + "SELECT doc_id, len(errors) = 0 AS accepted, array_to_string(errors, '; ') AS errors FROM e")
def validation_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("doc_id", (F.size("errors") == 0).alias("accepted"), F.array_join("errors", "; ").alias("errors"))


@query(_FLAGS + """SELECT kind, string_split(x, ':')[1] AS type, count(*) AS n FROM (SELECT 'errors' AS kind, unnest(errors) AS x FROM e
  UNION ALL SELECT 'warnings', 'same transcript: as ' || f FROM (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY lower(text)) AS f FROM documents) WHERE text <> '' AND doc_id > f) GROUP BY ALL""")
def error_types(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = duplicates.first_occurrence(docs, F.when(F.col("text") != "", F.lower("text")), "doc_id", "doc_id").select("doc_id", "first_id")
    again = validation.messages((F.col("first_id").isNotNull(), F.concat(F.lit("same transcript: as "), F.col("first_id").cast("string"))))
    return validation.message_counts(_flagged(spark, sf_dir).join(seen, "doc_id").withColumn("warnings", again))


_INFO = _FLAGS + ", acc AS (SELECT d.* FROM documents d JOIN e USING (doc_id) WHERE len(errors) = 0)," + _SPLIT.replace("FROM documents", "FROM acc").replace("WITH g AS", "g AS", 1).strip() + """,
  p AS (SELECT s.id, s.split, coalesce(a.lang, 'unknown') AS category, a.n_chars / 14.0::DOUBLE AS seconds FROM split s JOIN acc a ON a.doc_id = s.id),
  c AS (SELECT split, string_agg(category || ' ' || n, ', ' ORDER BY category) AS categories FROM (SELECT split, category, count(*) AS n FROM p GROUP BY ALL) GROUP BY split)
SELECT split, count(*) AS records, sum(a.n_chars) AS characters, sum(('0x' || sha256(p.id::VARCHAR)[1:15])::BIGINT)::VARCHAR AS digest, any_value(categories) AS categories FROM p JOIN acc a ON a.doc_id = p.id JOIN c USING (split) GROUP BY split"""


@query(_INFO)
def split_info(spark, sf_dir):
    """From documents to splits as one flow: what passes the text rules is split, with the guard
    against leaks in the plan; here the duration of a record is its number of characters."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("category"), F.col("n_chars").alias("duration_s"))
    # written down first: where few pass, Spark knows it and doesn't shuffle the texts of all
    ids = stored(_flagged(spark, sf_dir).filter(F.size("errors") == 0).select(F.col("doc_id").alias("id")), "ids")
    accepted = stored(dataset.guarded(stored(docs.join(ids, "id"), "passed"), table(spark, sf_dir, "benchmark")), "accepted")
    split_of = split.assign_splits(accepted.select("id", "text", "category")).select("id", "split")
    rows = accepted.withColumn("category", F.coalesce("category", F.lit("unknown"))).join(split_of, "id")
    info = dataset.split_info(rows).join(rows.groupBy("split").agg(F.sum("duration_s").alias("characters")), "split")
    shown = F.array_join(F.transform("categories", lambda c: F.concat_ws(" ", c["category"], c["n"].cast("string"))), ", ")
    return info.select("split", "records", "characters", "digest", shown.alias("categories"))


_SCRIPT = _LEAKS + f""",
  a AS (SELECT 0 AS turn, conv_id AS pos, turn AS second, 'conversations:' || conv_id AS label, NULL AS id, text FROM conversations UNION ALL SELECT 1, doc_id, 0, doc_id::VARCHAR, doc_id, text FROM documents),
  p AS (SELECT *, lag(label) OVER (PARTITION BY lower(text) ORDER BY turn, pos, label) AS previous FROM a),
  s AS (SELECT id, text, previous, length(text) / 14.0::DOUBLE + 0.35::DOUBLE * (length(text) - length(replace(text, ',', ''))) AS seconds, {_OUTSIDE} AS outside FROM p WHERE turn = 1)
SELECT s.id, lang AS category, printf('%.1f', seconds) AS est_seconds, array_to_string(list_filter([CASE WHEN s.id IN (SELECT conv_id FROM conversations) THEN 'id is used in another script' END,
  CASE WHEN same.doc_id IS NOT NULL THEN 'identical sentence' WHEN found.doc_id IS NOT NULL THEN 'shared run: ' || first_gram END, 'duplicate of ' || previous,
  CASE WHEN len(outside) > 0 THEN 'unmappable characters: ' || array_to_string(outside, ' ') END, CASE WHEN seconds > 14 THEN 'estimated ' || printf('%.1f', seconds) || 's exceeds 14.0s' END], lambda x: x IS NOT NULL), '; ') AS errors
FROM s JOIN documents d ON d.doc_id = s.id LEFT JOIN found ON found.doc_id = s.id LEFT JOIN same ON same.doc_id = s.id"""


@query(_SCRIPT)
def recording_script(spark, sf_dir):
    """A script of the documents; the conversations' turns are another one.  Texts are read as they
    stand, which SQL can say too."""
    docs = _records(spark, sf_dir).withColumn("pos", F.col("id"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "text", F.lit("conversations").alias("origin"), F.col("conv_id").alias("pos"))
    found = script.recording_script(docs, table(spark, sf_dir, "benchmark"), VOCABULARY, turns, prepare=None)
    return found.select("id", "category", "est_seconds", F.array_join("errors", "; ").alias("errors"))


@query("SELECT count(*) AS n, sum(value) / 60 AS total_min, avg(value) AS mean_s, median(value) AS median_s, min(value) AS min_s, max(value) AS max_s FROM events WHERE value <> 0")
def duration_stats(spark, sf_dir):
    return validation.duration_stats(table(spark, sf_dir, "events"), "value")


@query("SELECT doc_id, length(text) / 14.0::DOUBLE + 0.35::DOUBLE * (length(text) - length(replace(text, ',', ''))) > 14 AS too_long FROM documents")
def too_long_to_read(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", validation.too_long_to_read(F.col("text")).alias("too_long"))


@query("SELECT doc_id, sha256(text) AS digest, CASE WHEN source LIKE 'src0%' THEN replace(source, 'src0', 'data/') ELSE source END AS path FROM documents")
def content_digests(spark, sf_dir):
    paths = F.when(F.col("source").startswith("src0"), F.concat(F.lit("/root/data/"), F.substring("source", 5, 100))).otherwise(F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), X.relative_path(paths, "/root").alias("path"))
