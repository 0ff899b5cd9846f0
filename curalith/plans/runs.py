"""Queries over takes, generation logs, model comparison and training logs."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from curalith.functions.text import fixed
from curalith.operators import comparison, takes, training
from curalith.plans.registry import Registry, table
from curalith.plans.texts import VOCABULARY

query = Registry()
QUERIES, ORACLE = query.queries, query.oracle

# an order is a clip, its lines are the takes; a line's number can repeat in the stand-in, so lines are
# numbered anew in an order that tells them apart
_CODES = (
    ("min_f0_hz IS NULL OR voiced_ratio < 0.5::DOUBLE", "unvoiced"), ("opening_hz < 200", "low_opening"), ("min_f0_hz < 180", "low_pitch"), ("duration_s NOT BETWEEN 0.5::DOUBLE AND 14", "duration"),
    ("coalesce(letters_per_s NOT BETWEEN 5 AND 25, true)", "speaking_rate"), ("clipped_fraction > 0.001::DOUBLE", "clipped"),
)
_DISTINCT = f"""WITH lines AS (SELECT l_orderkey AS clip, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS attempt, * FROM lineitem),
  m AS (SELECT clip, attempt, nullif(l_quantity::DOUBLE, 13) * 8 AS min_f0_hz, l_tax::DOUBLE * 10 + 0.2::DOUBLE AS voiced_ratio, CASE WHEN l_suppkey % 9 > 0 THEN 150 + l_partkey % 500 END::DOUBLE AS opening_hz, l_extendedprice::DOUBLE / 4000 AS duration_s, CASE WHEN l_partkey % 11 > 0 THEN l_suppkey % 30 END::DOUBLE AS letters_per_s, CASE WHEN l_discount::DOUBLE > 0.085::DOUBLE THEN l_discount::DOUBLE / 10 ELSE 0 END AS clipped_fraction FROM lines),
  takes AS (SELECT clip, attempt, min_f0_hz, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for c, n in _CODES)}], lambda x: x IS NOT NULL) AS reasons FROM m)
"""


def _takes(spark, sf_dir):
    c = F.col
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    double = lambda name: c(name).cast("double")
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("clip"), F.row_number().over(order).cast("long").alias("attempt"), (F.nullif(double("l_quantity"), F.lit(13.0)) * 8).alias("min_f0_hz"), (double("l_tax") * 10 + 0.2).alias("voiced_ratio"),
        F.when(c("l_suppkey") % 9 > 0, 150.0 + c("l_partkey") % 500).alias("opening_hz"), (double("l_extendedprice") / 4000).alias("duration_s"),
        F.when(c("l_partkey") % 11 > 0, (c("l_suppkey") % 30).cast("double")).alias("letters_per_s"), F.when(double("l_discount") > 0.085, double("l_discount") / 10).otherwise(0.0).alias("clipped_fraction"),
    )
    return rows.select("clip", "attempt", "min_f0_hz", takes.take_reasons().alias("reasons"))


@query(_DISTINCT + """, k AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, row_number() OVER (PARTITION BY clip ORDER BY len(reasons) > 0, CASE WHEN len(reasons) = 0 THEN attempt ELSE 0 END, len(reasons), -coalesce(min_f0_hz, 0), attempt) AS r FROM takes)
SELECT clip, attempt, min_f0_hz, array_to_string(reasons, '; ') AS reasons, CASE WHEN len(reasons) = 0 THEN attempt ELSE n END::BIGINT AS attempts, CASE WHEN len(reasons) = 0 THEN 'accepted' ELSE 'rejected' END AS status FROM k WHERE r = 1""")
def take_select(spark, sf_dir):
    return takes.choose_take(_takes(spark, sf_dir), "clip", "attempt").withColumn("reasons", F.array_join("reasons", "; "))


@query(_DISTINCT + ", k AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY coalesce(min_f0_hz, 0) < 300, CASE WHEN min_f0_hz >= 300 THEN 0 ELSE -coalesce(min_f0_hz, 0) END, attempt) AS r FROM takes) SELECT clip, attempt, nullif(min_f0_hz, 0) AS min_f0_hz FROM k WHERE r = 1")
def drift_guard_select(spark, sf_dir):
    return takes.choose_by_floor(_takes(spark, sf_dir).withColumn("floor", F.coalesce("min_f0_hz", F.lit(0.0))), "clip", "attempt", 300.0)


@query(_DISTINCT + "SELECT code, count(*) AS n FROM (SELECT unnest(reasons) AS code FROM takes) GROUP BY code")
def take_codes(spark, sf_dir):
    return _takes(spark, sf_dir).select(F.explode("reasons").alias("code")).groupBy("code").agg(F.count("*").alias("n"))


# an event is a clip of the log
_LOG = """WITH log AS (SELECT event_id AS clip_id, event_type AS source, CASE WHEN value < 150 THEN 'accepted' ELSE 'rejected' END AS status, 180 + value AS median_f0_hz, CASE WHEN user_id % 7 > 0 THEN -(user_id % 60)::DOUBLE END AS end_db,
    value / 10 AS duration_s, value * 0.3::DOUBLE AS compute_s, CASE WHEN value >= 150 THEN CASE WHEN user_id % 2 = 0 THEN 'low_pitch: x; unvoiced: y' ELSE 'unvoiced: z' END ELSE '' END AS reasons, user_id % 4 AS scale FROM events),
  f AS (SELECT *, 12 * log2(median_f0_hz / (SELECT median(median_f0_hz) FROM log WHERE status = 'accepted')) AS f0_dev_st FROM log WHERE status = 'accepted'),
  v AS (SELECT *, CASE WHEN abs(f0_dev_st) > 2 THEN 'inconsistent' WHEN end_db > -40 THEN 'end_cut' ELSE 'kept' END AS verdict FROM f)
"""


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    value, user = F.col("value"), F.col("user_id")
    return e.select(
        F.col("event_id").alias("clip_id"), F.col("event_type").alias("source"), F.when(value < 150, "accepted").otherwise("rejected").alias("status"), (F.lit(180) + value).alias("median_f0_hz"),
        F.when(user % 7 > 0, -(user % 60).cast("double")).alias("end_db"), (value / 10).alias("duration_s"), (value * F.lit(0.3)).alias("compute_s"),
        F.when(value >= 150, F.when(user % 2 == 0, "low_pitch: x; unvoiced: y").otherwise("unvoiced: z")).otherwise("").alias("reasons"), (user % 4).alias("scale"),
    )


@query(_LOG + "SELECT clip_id, f0_dev_st, verdict FROM v")
def finalize_consistency(spark, sf_dir):
    return takes.finalize(_log(spark, sf_dir)).select("clip_id", "f0_dev_st", "verdict")


@query(_LOG + "SELECT source, count(*) AS clips, count(*) FILTER (k) AS kept, count(*) FILTER (k) / count(*) AS kept_ratio, coalesce(sum(duration_s) FILTER (k), 0) / 60 AS kept_minutes FROM (SELECT log.*, coalesce(verdict = 'kept', false) AS k FROM log LEFT JOIN (SELECT clip_id, verdict FROM v) USING (clip_id)) GROUP BY source")
def per_source_kept(spark, sf_dir):
    log = _log(spark, sf_dir)
    return takes.kept_by_source(takes.judged(log, takes.voice_median(log)), F.col("verdict") == "kept")


@query(_LOG + "SELECT string_split(r, ':')[1] AS reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '; ')) AS r FROM log WHERE status = 'rejected') WHERE r <> '' GROUP BY 1")
def reject_reasons(spark, sf_dir):
    return takes.reason_counts(_log(spark, sf_dir))


@query(_LOG + "SELECT scale::VARCHAR AS scale, count(*) AS n FROM v WHERE verdict = 'kept' GROUP BY 1")
def scale_histogram(spark, sf_dir):
    return takes.histogram(takes.finalize(_log(spark, sf_dir)).filter("verdict = 'kept'"), "scale")


@query(_LOG + "SELECT count(end_db) AS n, median(end_db) AS median, max(end_db) AS max FROM log")
def stat_triple(spark, sf_dir):
    return takes.stat_triple(_log(spark, sf_dir), "end_db")


_TRIPLE = "SELECT '{p}' AS part, unnest(['n', 'median', 'max']) AS name, unnest([count({c})::DOUBLE, printf('%.2f', median({c}))::DOUBLE, printf('%.2f', max({c}))::DOUBLE]) AS value FROM a WHERE {w}"
_SUMMARY = _LOG + """, a AS (SELECT log.*, coalesce(verdict, 'rejected') AS verdict, coalesce(verdict = 'kept', false) AS k, 'c' || (clip_id % 3) AS category, clip_id % 5 + 1 AS attempts, median_f0_hz - 80 AS min_f0_hz, CASE WHEN clip_id % 4 > 0 THEN duration_s / 7 END AS max_drop_st FROM log LEFT JOIN (SELECT clip_id, verdict FROM v) USING (clip_id)),
  t AS (SELECT count(*)::DOUBLE AS clips_total, count(*) FILTER (status = 'accepted')::DOUBLE AS accepted_by_generation, count(*) FILTER (verdict = 'inconsistent')::DOUBLE AS excluded_by_consistency, count(*) FILTER (verdict = 'end_cut')::DOUBLE AS excluded_by_end_cut, count(*) FILTER (k)::DOUBLE AS kept,
    printf('%.3f', count(*) FILTER (k) / count(*))::DOUBLE AS kept_ratio, printf('%.2f', sum(duration_s) FILTER (k) / 60)::DOUBLE AS kept_minutes, printf('%.3f', sum(compute_s) / 3600)::DOUBLE AS compute_hours, printf('%.1f', median(median_f0_hz) FILTER (status = 'accepted'))::DOUBLE AS voice_median_f0_hz, printf('%.2f', sum(compute_s) / sum(duration_s) FILTER (k))::DOUBLE AS compute_s_per_kept_audio_s FROM a)
SELECT 'total' AS part, name, value FROM (UNPIVOT t ON * INTO NAME name VALUE value)
UNION ALL SELECT 'source_clips', source, count(*) FROM a GROUP BY source
UNION ALL SELECT 'source_kept', source, count(*) FILTER (k) FROM a GROUP BY source
UNION ALL SELECT 'source_kept_minutes', source, printf('%.2f', coalesce(sum(duration_s) FILTER (k), 0) / 60)::DOUBLE FROM a GROUP BY source
UNION ALL SELECT 'category_of_kept', category, count(*) FROM a WHERE k GROUP BY category
UNION ALL SELECT 'scale_of_kept', scale::VARCHAR, count(*) FROM a WHERE k GROUP BY scale
UNION ALL SELECT 'attempts_of_kept', attempts::VARCHAR, count(*) FROM a WHERE k GROUP BY attempts
UNION ALL SELECT 'reject_reasons', string_split(r, ':')[1], count(*) FROM (SELECT unnest(string_split(reasons, '; ')) AS r FROM a WHERE status = 'rejected') WHERE r <> '' GROUP BY 2
UNION ALL """ + " UNION ALL ".join(_TRIPLE.format(p=p, c=c, w=w) for p, c, w in (("min_f0_hz_kept", "min_f0_hz", "k"), ("min_f0_hz_rejected", "min_f0_hz", "status = 'rejected'"), ("max_drop_st_kept", "max_drop_st", "k")))


@query(_SUMMARY)
def finalize_summary(spark, sf_dir):
    clip = F.col("clip_id")
    log = _log(spark, sf_dir).withColumns({
        "category": F.concat(F.lit("c"), (clip % 3).cast("string")), "attempts": clip % 5 + 1, "min_f0_hz": F.col("median_f0_hz") - 80,
        "max_drop_st": F.when(clip % 4 > 0, F.col("duration_s") / 7),
    })
    return takes.summary(log)


@query(_LOG + "SELECT sum(compute_s) / sum(CASE WHEN status = 'accepted' THEN duration_s ELSE 0 END) AS compute_per_audio FROM log")
def compute_ratio(spark, sf_dir):
    return takes.compute_ratio(_log(spark, sf_dir), F.col("status") == "accepted")


# order status is the model, a customer the sentence
_RESULTS = "WITH r AS (SELECT o_custkey AS sentence_id, o_orderstatus AS model, min(o_totalprice) AS time_s, max(o_totalprice) AS duration_s, max(o_totalprice) / min(o_totalprice) AS drop_st FROM orders GROUP BY ALL) "


def _results(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sentence_id"), F.col("o_orderstatus").alias("model")).agg(F.min("o_totalprice").alias("time_s"), F.max("o_totalprice").alias("duration_s"), (F.max("o_totalprice") / F.min("o_totalprice")).alias("drop_st"))


@query(_RESULTS + "SELECT c_custkey AS sentence_id, b.time_s AS O_time_s, b.duration_s AS O_duration_s, f.time_s AS F_time_s, f.duration_s AS F_duration_s FROM customer LEFT JOIN (SELECT * FROM r WHERE model = 'O') b ON b.sentence_id = c_custkey LEFT JOIN (SELECT * FROM r WHERE model = 'F') f ON f.sentence_id = c_custkey")
def compare_pivot(spark, sf_dir):
    sentences = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sentence_id"))
    return comparison.side_by_side(sentences, _results(spark, sf_dir), "sentence_id", ["O", "F"], ["time_s", "duration_s"])


_SHOWN = ", ".join(f"coalesce({m}.audio, '') AS {m.upper()}_audio, coalesce(printf('%.2f', {m}.time_s), '') AS {m.upper()}_time_s, coalesce(printf('%.2f', {m}.duration_s), '') AS {m.upper()}_duration_s, coalesce(printf('%.1f', {m}.drop_st), '') AS {m.upper()}_drop_st" for m in "of")
_SHEET = "WITH r AS (SELECT o_custkey AS sentence_id, o_orderstatus AS model, 'order ' || o_orderkey AS audio, o_totalprice::DOUBLE / 1000 AS time_s, o_totalprice::DOUBLE / 70 AS duration_s, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice::DOUBLE / 30000 END AS drop_st FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY 'order ' || o_orderkey) = 1) "


@query(_SHEET + f"SELECT c_custkey AS sentence_id, c_mktsegment AS category, {_SHOWN} FROM customer LEFT JOIN (SELECT * FROM r WHERE model = 'O') o ON o.sentence_id = c_custkey LEFT JOIN (SELECT * FROM r WHERE model = 'F') f ON f.sentence_id = c_custkey")
def compare_sheet(spark, sf_dir):
    price = F.col("o_totalprice").cast("double")
    results = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("sentence_id"), F.col("o_orderstatus").alias("model"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("audio"),
        (price / 1000).alias("time_s"), (price / 70).alias("duration_s"), F.when(F.col("o_orderkey") % 3 > 0, price / 30000).alias("drop_st"),
    )
    sentences = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sentence_id"), F.col("c_mktsegment").alias("category"))
    return comparison.comparison_sheet(sentences, results, "sentence_id", ["O", "F"])


@query(_RESULTS + "SELECT model, count(*) AS n, sum(time_s) / sum(duration_s) AS rtf, count(*) FILTER (drop_st >= 5) AS drifted FROM r GROUP BY model")
def rtf_by_model(spark, sf_dir):
    return comparison.real_time_factors(_results(spark, sf_dir))


@query("SELECT l_orderkey, l_linenumber, l_partkey, printf('%.2f', l_quantity::DOUBLE * 0.335) AS shown FROM lineitem")
def fixed_decimals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", fixed(F.col("l_quantity").cast("double") * 0.335, 2).alias("shown"))


@query("SELECT event_id AS step, CASE WHEN event_id < 500 THEN 0.0003::DOUBLE * event_id / 500 ELSE 0.05::DOUBLE * 0.0003::DOUBLE + 0.475::DOUBLE * 0.0003::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (event_id - 500) / 7500.0::DOUBLE))) END AS lr FROM events")
def lr_schedule(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), training.learning_rate(F.col("event_id"), 500, 8000, 0.0003).alias("lr"))


@query("SELECT ceil((event_id + 1) / 50)::BIGINT AS window, avg(value) AS mean_loss, count(*) AS steps FROM events GROUP BY 1")
def loss_windows(spark, sf_dir):
    return training.loss_windows(table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("step"), F.col("value").alias("loss")), 50)


@query("SELECT event_type AS run, sum(value * (user_id % 5 + 1)) / sum(user_id % 5 + 1) AS loss FROM events GROUP BY 1")
def weighted_loss(spark, sf_dir):
    return training.weighted_loss(table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.col("value").alias("loss"), (F.col("user_id") % 5 + 1).alias("n")), "run")


@query("""WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS step, value AS loss, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
s AS (SELECT run, k, loss AS best, step AS kept, 0 AS streak, NULL::BIGINT AS stop FROM e WHERE k = 1
  UNION ALL SELECT e.run, e.k, CASE WHEN loss < best - 0.5::DOUBLE THEN loss ELSE best END, CASE WHEN loss < best - 0.5::DOUBLE THEN step ELSE kept END, CASE WHEN loss < best - 0.5::DOUBLE THEN 0 ELSE streak + 1 END,
    CASE WHEN NOT loss < best - 0.5::DOUBLE AND streak + 1 >= 4 THEN step END FROM s JOIN e ON e.run = s.run AND e.k = s.k + 1 WHERE stop IS NULL)
SELECT run, kept AS best_step, best AS best_loss, stop AS stop_step FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY k DESC) AS r FROM s) WHERE r = 1""")
def early_stop(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return training.early_stop(log, "run", patience=4, min_delta=0.5)


@query("SELECT user_id AS run, event_id AS step FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3")
def keep_last(spark, sf_dir):
    return training.keep_last(table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step")), "run", 3)


_IDS = dict(zip(VOCABULARY, range(2, 2 + len(VOCABULARY)), strict=True))
_IDMAP = "MAP {" + ", ".join("'" + c.replace("'", "''") + f"': {i}" for c, i in _IDS.items()) + "}"
_ADMITTED = f"""WITH a AS (SELECT conv_id, turn, length(text) AS n_frames, list_transform(string_split(text[1:300], ''), lambda c: coalesce(m[c], 1)) AS ids FROM conversations, (SELECT {_IDMAP} AS m)),
  b AS (SELECT * FROM a WHERE n_frames BETWEEN 8 AND 240 AND len(ids) BETWEEN 1 AND 250) """


def _admitted(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.length("text").alias("n_frames"))
    return training.admitted(rows, _IDS, 240)


@query(_ADMITTED + "SELECT conv_id, turn, n_frames, array_to_string(ids, ' ') AS ids FROM b")
def latent_admission(spark, sf_dir):
    return _admitted(spark, sf_dir).select("conv_id", "turn", "n_frames", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query(_ADMITTED + ", c AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS longest FROM b) SELECT conv_id, turn, longest, len(ids) AS used, list_sum(ids)::BIGINT AS total, ln(n_frames::DOUBLE) AS log_frames FROM c")
def batch_pad(spark, sf_dir):
    rows = training.padded(_admitted(spark, sf_dir), "conv_id")
    return rows.select("conv_id", "turn", F.size("padded").alias("longest"), F.size(F.filter("mask", lambda m: m)).alias("used"), F.aggregate("padded", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), "log_frames")


@query("SELECT conv_id % 10 AS shard, count(*) AS n, sum(n_frames) / 60.0::DOUBLE AS minutes, count(*) FILTER (n_frames NOT BETWEEN 8 AND 240) AS skipped FROM (SELECT conv_id, length(text) AS n_frames FROM conversations) GROUP BY 1")
def shard_accounts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") % 10).alias("shard"), F.length("text").alias("n_frames"))
    return rows.groupBy("shard").agg(F.count("*").alias("n"), (F.sum("n_frames") / 60.0).alias("minutes"), F.count_if(~F.col("n_frames").between(8, 240)).alias("skipped"))


@query("SELECT p_partkey, greatest(1, (p_partkey * 37 // p_size) // 4) AS steps_per_epoch, ceil(600 / greatest(1, (p_partkey * 37 // p_size) // 4))::BIGINT AS epochs FROM part WHERE p_size > 0")
def train_plan(spark, sf_dir):
    config = table(spark, sf_dir, "part").filter("p_size > 0").select("p_partkey", (F.col("p_partkey") * 37).alias("n"), F.col("p_size").alias("batch"), F.lit(4).alias("accumulate"), F.lit(600).alias("steps"))
    return training.plan(config).select("p_partkey", "steps_per_epoch", "epochs")
