"""Queries over samples and pitch tracks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from curalith.functions import signal as S
from curalith.operators import chunks, pitch, validation
from curalith.operators.duplicates import first_occurrence
from curalith.plans.registry import Registry, table

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

RATE, HOP = 400, 8
_PCM = f"""WITH pcm AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s FROM embeddings),
  f AS (SELECT vec_id, s, list_transform(range(0, len(s) // {HOP}), lambda i: 20 * log10(greatest(sqrt(list_sum(list_transform(s[i * {HOP} + 1 : i * {HOP} + {HOP}], lambda x: x * x)) / {HOP}), 1e-10::DOUBLE))) AS l FROM pcm),
  v AS (SELECT *, list_max(l) AS loudest, list_filter(range(0, len(l)), lambda i: l[i + 1] > list_max(l) - 6) AS on_ FROM f),
  e AS (SELECT *, on_[1] AS a, on_[len(on_)] AS b FROM v)
"""
_BELOW = 6.0


def _samples(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("samples"))
    return rows.withColumn("levels", S.frame_levels(F.col("samples"), F.lit(HOP)))


def _edges(spark, sf_dir):
    return _samples(spark, sf_dir).withColumn("edge", S.voiced_edges(F.col("levels"), _BELOW))


@query(_PCM + "SELECT vec_id, i AS frame, l[i + 1] AS db FROM (SELECT *, unnest(range(0, len(l))) AS i FROM f)")
def frame_levels(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", F.posexplode("levels").alias("frame", "db"))


@query(_PCM + "SELECT vec_id, len(list_filter(s, lambda x: abs(x) >= 0.3::DOUBLE)) / len(s) AS clipped FROM pcm")
def clip_fraction(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", S.clipped_fraction(F.col("samples"), 0.3).alias("clipped"))


@query(_PCM + "SELECT vec_id, 20 * log10(greatest(list_max(list_transform(s, lambda x: abs(x))), 1e-10::DOUBLE)) AS peak_dbfs, loudest < -20 AS no_speech FROM v")
def peak_levels(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", S.decibels(S.peak(F.col("samples"))).alias("peak_dbfs"), (F.array_max("levels") < -20).alias("no_speech"))


@query(_PCM + "SELECT vec_id, a * 0.02::DOUBLE AS leading_s, (len(l) - 1 - b) * 0.02::DOUBLE AS trailing_s FROM e")
def edge_silence(spark, sf_dir):
    return _edges(spark, sf_dir).select("vec_id", (F.col("edge.first") * S.FRAME_S).alias("leading_s"), ((F.size("levels") - 1 - F.col("edge.last")) * S.FRAME_S).alias("trailing_s"))


@query(_PCM + """, n AS (SELECT vec_id, l, list_concat(l[1 : a], l[b + 2 : len(l)]) AS edge, l[a + 1 : b + 1] AS speech FROM e)
SELECT vec_id, CASE WHEN len(edge) >= 5 THEN list_aggregate(speech, 'quantile_cont', 0.9::DOUBLE) - list_aggregate(edge, 'median') END AS snr, list_aggregate(speech, 'quantile_cont', 0.9::DOUBLE) - list_aggregate(l, 'quantile_cont', 0.1::DOUBLE) AS rough FROM n""")
def snr_edges(spark, sf_dir):
    noise = S.noise_ratio(F.col("levels"), F.col("edge.first"), F.col("edge.last"))
    return _edges(spark, sf_dir).withColumn("x", noise).select("vec_id", "x.snr", "x.rough")


@query(_PCM + r"SELECT vec_id, printf('%.1f', length(regexp_replace(text, '[^\p{L}]', '', 'g')) / ((b - a + 1) * 0.02::DOUBLE))::DOUBLE AS letters_per_s FROM e JOIN documents ON doc_id = vec_id")
def speaking_rate(spark, sf_dir):
    """A document is what is said in the samples of its number."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    spoken = _edges(spark, sf_dir).select("vec_id", ((F.col("edge.last") - F.col("edge.first") + 1) * S.FRAME_S).alias("speech_s"))
    return validation.with_rate(spoken.join(texts, "vec_id")).select("vec_id", "letters_per_s")


@query(_PCM + "SELECT vec_id, 20 * log10(greatest(sqrt(list_sum(list_transform(s[len(s) - 11 : len(s)], lambda x: x * x)) / 12) / list_max(list_transform(s, lambda x: abs(x))), 1e-10::DOUBLE)) AS end_db FROM pcm")
def end_level(spark, sf_dir):
    return _samples(spark, sf_dir).select("vec_id", S.end_level(F.col("samples"), RATE).alias("end_db"))


@query("SELECT vec_id, (embedding[2 * i + 1]::DOUBLE + embedding[2 * i + 2]::DOUBLE) / 2 AS mono, i AS sample FROM (SELECT *, unnest(range(0, 32)) AS i FROM embeddings)")
def downmix(spark, sf_dir):
    channel = lambda k: F.filter("samples", lambda _, i: i % 2 == k)
    rows = _samples(spark, sf_dir).select("vec_id", S.downmixed(F.array(channel(0), channel(1))).alias("mono"))
    return rows.select("vec_id", F.posexplode("mono").alias("sample", "mono"))


@query("SELECT vec_id, i - 1 AS sample, CASE WHEN i <= 64 THEN embedding[i] WHEN i > 112 THEN embedding[i - 112] ELSE 0 END::DOUBLE AS value FROM (SELECT *, unnest(range(1, 177)) AS i FROM embeddings)")
def concat_gap(spark, sf_dir):
    part = F.transform("samples", lambda x: x.cast("double"))
    return _samples(spark, sf_dir).select("vec_id", F.posexplode(S.with_gaps(F.array(part, part), RATE)).alias("sample", "value"))


def _chunked(spark, sf_dir, length):
    """Each vector as a recording of one channel, in chunks of ``length`` samples."""
    audio = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.lit(RATE).alias("sample_rate"), F.lit(1).alias("channels"), F.lit("PCM_16").alias("subtype"), F.lit(None).cast("string").alias("error"), F.array(F.transform("embedding", lambda x: x.cast("double"))).alias("samples"))
    return chunks.cut(audio, length)


@query("SELECT vec_id, CASE WHEN vec_id > f THEN f ELSE -1 END AS first_id FROM (SELECT vec_id, min(vec_id) OVER (PARTITION BY embedding::VARCHAR) AS f FROM embeddings)")
def duplicate_audio(spark, sf_dir):
    """By the digest of the samples."""
    found = chunks.digests(_chunked(spark, sf_dir, 64)).select(F.col("id").cast("long").alias("vec_id"), "digest")
    return first_occurrence(found, F.col("digest"), "vec_id", "vec_id").select("vec_id", F.coalesce("first_id", F.lit(-1)).alias("first_id"))


@query(_PCM + """, n AS (SELECT *, list_concat(l[1 : a], l[b + 2 : len(l)]) AS edge, l[a + 1 : b + 1] AS speech FROM e)
SELECT vec_id, printf('%.1f', 20 * log10(greatest(list_max(list_transform(s, lambda x: abs(x))), 1e-10::DOUBLE)))::DOUBLE AS peak_dbfs, len(list_filter(s, lambda x: abs(x) >= 0.3::DOUBLE)) / len(s) AS clipped, loudest, printf('%.2f', a * 0.02::DOUBLE)::DOUBLE AS leading_s, printf('%.2f', (len(l) - 1 - b) * 0.02::DOUBLE)::DOUBLE AS trailing_s,
  printf('%.1f', CASE WHEN len(edge) >= 5 THEN list_aggregate(speech, 'quantile_cont', 0.9::DOUBLE) - list_aggregate(edge, 'median') END)::DOUBLE AS snr_db, printf('%.1f', list_aggregate(speech, 'quantile_cont', 0.9::DOUBLE) - list_aggregate(l, 'quantile_cont', 0.1::DOUBLE))::DOUBLE AS rough_snr_db FROM n""")
def chunked_sound(spark, sf_dir):
    """The measures of recordings whose chunks of 20 samples end inside their frames of 8."""
    th = validation.Thresholds(silence_rel_db=-_BELOW, clip_level=0.3, no_speech_dbfs=-1000.0)
    found = chunks.sound(_chunked(spark, sf_dir, 20), th)
    return found.select(F.col("id").cast("long").alias("vec_id"), "peak_dbfs", "clipped", "loudest", "leading_s", "trailing_s", "snr_db", "rough_snr_db")


_NEW, _UP, _DOWN, _ZEROS = 250, 5, 8, 8  # 400 samples a second to 250
_HALF, _CUTOFF = chunks.reach(_UP, _DOWN, _ZEROS), chunks.PASSING * _UP / _DOWN


@query(f"""WITH k AS (SELECT m, m * {_DOWN} // {_UP} AS place, unnest(range(-{_HALF}, {_HALF + 1})) AS t FROM range(0, 40) r(m)),
  v AS (SELECT m, place + t AS i, t - (m * {_DOWN} % {_UP}) / {_UP}::DOUBLE AS u FROM k),
  w AS (SELECT m, i, {_CUTOFF}::DOUBLE * CASE WHEN u = 0 THEN 1 ELSE sin(pi() * {_CUTOFF}::DOUBLE * u) / (pi() * {_CUTOFF}::DOUBLE * u) END * CASE WHEN abs(u) < {_HALF + 1} THEN 0.35875::DOUBLE + 0.48829::DOUBLE * cos(pi() * u / {_HALF + 1}) + 0.14128::DOUBLE * cos(2 * pi() * u / {_HALF + 1}) + 0.01168::DOUBLE * cos(3 * pi() * u / {_HALF + 1}) ELSE 0 END AS h FROM v WHERE i BETWEEN 0 AND 63)
SELECT vec_id, m AS sample, round(sum(h * embedding[i + 1]::DOUBLE), 6) + 0.0::DOUBLE AS value FROM embeddings, w GROUP BY vec_id, m""")
def resample(spark, sf_dir):
    """400 samples a second to 250, over the borders of chunks."""
    whole = chunks.joined(chunks.resampled(_chunked(spark, sf_dir, 24), _NEW, _ZEROS))
    return whole.select(F.col("id").cast("long").alias("vec_id"), F.posexplode("samples").alias("sample", "value")).withColumn("value", F.round("value", 6) + 0.0)


@query()
def audio_validation(spark, sf_dir):
    """Errors and warnings of samples as if they were recordings at 400 a second."""
    th = validation.Thresholds(sample_rate=RATE, min_sample_rate=100, min_duration_s=0.05, silence_rel_db=-6.0, clip_level=0.5)
    audio = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.lit(RATE).alias("sample_rate"), F.lit(1).alias("channels"), F.lit("PCM_16").alias("subtype"), F.lit("on iki harf").alias("text"))
    done = validation.audio_messages(validation.measured(audio, th), th)
    return done.select("vec_id", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))


_TRACK = """WITH t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, 120 + value AS f0, event_type <> 'error' AS voiced FROM events),
  w AS (SELECT user_id, i // 16 AS w, CASE WHEN count(*) FILTER (voiced) >= 5 THEN median(f0) FILTER (voiced) END AS m FROM t GROUP BY ALL),
  a AS (SELECT user_id, list(m ORDER BY w) AS ws FROM w GROUP BY user_id),
  o AS (SELECT *, list_filter(ws, lambda x: x IS NOT NULL) AS ok FROM a),
  r AS (SELECT *, CASE WHEN len(ok) > 0 THEN list_aggregate(ok[1:2], 'median') END AS ref FROM o)
"""


def _windows(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(order) - 1).alias("i"), (F.lit(120) + F.col("value")).alias("f0"), (F.col("event_type") != "error").alias("voiced"))
    return pitch.window_medians(frames, "user_id", window_s=0.5)


@query(_TRACK + "SELECT user_id, w, m FROM w")
def window_median(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", F.posexplode("windows").alias("w", "m"))


@query(_TRACK + "SELECT user_id, ref AS opening_hz, CASE WHEN ref IS NOT NULL THEN list_max(list_transform(ws, lambda x: coalesce(12 * log2(ref / x), 0::DOUBLE))) END AS max_drop_st FROM r")
def pitch_drop(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", S.opening(F.col("windows")).alias("opening_hz"), S.pitch_drop(F.col("windows")).alias("max_drop_st"))


@query(_TRACK + "SELECT user_id, CASE WHEN len(ok) < 0.5::DOUBLE * len(ws) OR coalesce(ref, 0) < 150 THEN 0 ELSE list_min(ok) END::DOUBLE AS floor_hz FROM r")
def take_floor(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", S.take_floor(F.col("windows"), 0.5, 150.0).alias("floor_hz"))


@query(_TRACK + "SELECT user_id, coalesce(list_max(list_transform(ws, lambda x: coalesce(12 * log2(ref / x), 0::DOUBLE))) >= 0.5, false) AS drift FROM r")
def drift_flags(spark, sf_dir):
    return _windows(spark, sf_dir).select("user_id", F.coalesce(S.pitch_drop(F.col("windows")) >= 0.5, F.lit(False)).alias("drift"))
