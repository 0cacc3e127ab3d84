"""Token-level queries over turns: divergences, losses, importance weights, returns, whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tokens as K
from millrace.operators import advantages
from millrace.plans.base import TOK, r6, sequences
from millrace.runtime import table

QUERIES, ORACLE = {}, {}
KEY = ["session_id", "turn"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def cols() -> dict:
    return {c: F.col(c) for c in ("new", "old", "ref", "mask", "adv", "reward")}


def per_sequence(spark: SparkSession, d: str, **columns) -> DataFrame:
    return sequences(spark, d).select(*KEY, *[r6(c).alias(n) for n, c in columns.items()])


MEAN = "round(sum({x} * mask) / greatest(sum(mask), 1), 6) + 0.0"
BASE = f"WITH {TOK} SELECT session_id, turn, "
BY = " FROM tok GROUP BY session_id, turn"


@query(BASE + ", ".join(f"{MEAN.format(x=x)} AS {n}" for n, x in (("k1", "(new - ref)"), ("k2", "((new - ref) * (new - ref) / 2)"), ("k3", "(exp(ref - new) - 1 + new - ref)"), ("low_var_kl", "least(greatest(exp(ref - new) - 1 + new - ref, -10), 10)"), ("weighted_k3", "(exp(new - old) * (exp(ref - new) - 1 + new - ref))"))) + BY)
def g1_approximate_kl(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    kls = {k: K.masked_mean(K.approx_kl(c["new"], c["ref"], k), c["mask"]) for k in ("k1", "k2", "k3", "low_var_kl")}
    kls["weighted_k3"] = K.masked_mean(K.approx_kl(c["new"], c["ref"], "k3", K.importance(c["new"], c["old"])), c["mask"])
    return per_sequence(spark, d, **kls)


@query(f"WITH {TOK}, q AS (SELECT session_id, turn, sum((old - new) * mask) / greatest(sum(mask), 1) AS kl, max(adv) AS adv, count(*) AS n FROM tok GROUP BY 1, 2) SELECT session_id, turn, round(kl, 6) + 0.0 AS sequence_kl, CASE WHEN adv < 0 AND kl > 0.01 THEN 0 ELSE n END AS kept_tokens FROM q")
def g2_g3_sequence_kl(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    kept = K.total(K.opsm_mask(c["new"], c["old"], c["adv"], c["mask"], 0.01)).cast("long")
    return sequences(spark, d).select(*KEY, r6(K.sequence_kl(c["new"], c["old"], c["mask"])).alias("sequence_kl"), kept.alias("kept_tokens"))


_R = "exp(new - old)"
_C = "least(greatest(exp(new - old), 0.8), 1.28)"


@query(BASE + f"{MEAN.format(x=f'greatest(-{_R} * adv, -{_C} * adv)')} AS loss, {MEAN.format(x=f'CASE WHEN adv < 0 THEN least(-3.0 * adv, greatest(-{_R} * adv, -{_C} * adv)) ELSE greatest(-{_R} * adv, -{_C} * adv) END')} AS dual_loss, {MEAN.format(x=f'CASE WHEN -{_C} * adv > -{_R} * adv THEN 1.0 ELSE 0.0 END')} AS clipfrac" + BY)
def g4_ppo_loss(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    kl = F.zip_with("old", "new", lambda o, n: o - n)
    return per_sequence(spark, d, loss=K.masked_mean(K.ppo_loss(kl, c["adv"], 0.2, 0.28), c["mask"]), dual_loss=K.masked_mean(K.ppo_loss(kl, c["adv"], 0.2, 0.28, 3.0), c["mask"]), clipfrac=K.masked_mean(K.ppo_clipped(kl, c["adv"], 0.2, 0.28), c["mask"]))


@query(BASE + f"{MEAN.format(x=f'(-{_C} * adv * new)')} AS loss, {MEAN.format(x=f'CASE WHEN {_C} <> {_R} THEN 1.0 ELSE 0.0 END')} AS clipfrac" + BY)
def g5_cispo_loss(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    kl = F.zip_with("old", "new", lambda o, n: o - n)
    return per_sequence(spark, d, loss=K.masked_mean(K.cispo_loss(kl, c["new"], c["adv"], 0.2, 0.28), c["mask"]), clipfrac=K.masked_mean(K.cispo_clipped(F.transform(F.zip_with("old", "new", lambda o, n: n - o), lambda x: -x), 0.2, 0.28), c["mask"]))


@query(BASE + f"{MEAN.format(x=_R)} AS tis, {MEAN.format(x=f'least(greatest({_R}, 0.5), 1.05)')} AS tis_clipped, {MEAN.format(x=f'CASE WHEN {_R} BETWEEN 0.95 AND 1.05 THEN {_R} ELSE 0 END')} AS icepop, {MEAN.format(x=f'abs({_R} - 1)')} AS tis_abs" + BY)
def g6_g7_importance_weights(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    w = K.importance(c["new"], c["old"])
    return per_sequence(spark, d, tis=K.masked_mean(w, c["mask"]), tis_clipped=K.masked_mean(K.tis_weights(c["new"], c["old"], 0.5, 1.05), c["mask"]), icepop=K.masked_mean(K.icepop_weights(c["new"], c["old"], 0.95, 1.05), c["mask"]), tis_abs=K.masked_mean(F.transform(w, lambda x: F.abs(x - 1)), c["mask"]))


@query(f"WITH {TOK}, q AS (SELECT session_id, turn, " + ", ".join(f"sum({x} * mask) / greatest(sum(mask), 1) AS {n}" for n, x in (("pg", f"greatest(-{_R} * adv, -{_C} * adv)"), ("kl", "(exp(ref - new) - 1 + new - ref)"), ("diff", "abs(new - old)"))) + " FROM tok GROUP BY 1, 2) SELECT round(avg(pg), 6) + 0.0 AS pg_loss, round(avg(kl), 6) + 0.0 AS kl_loss, round(avg(diff), 6) + 0.0 AS logprob_abs_diff, round(avg(pg) + 0.01 * avg(kl), 6) + 0.0 AS loss, count(*) AS sequences FROM q")
def g8_policy_loss(spark: SparkSession, d: str) -> DataFrame:
    """The assembled policy loss: mean over sequences of masked means."""
    c = cols()
    kl = F.zip_with("old", "new", lambda o, n: o - n)
    q = sequences(spark, d).select(K.masked_mean(K.ppo_loss(kl, c["adv"], 0.2, 0.28), c["mask"]).alias("pg"), K.masked_mean(K.approx_kl(c["new"], c["ref"], "k3"), c["mask"]).alias("kl"), K.masked_mean(F.transform(kl, lambda x: F.abs(x)), c["mask"]).alias("diff"))
    return q.agg(r6(F.avg("pg")).alias("pg_loss"), r6(F.avg("kl")).alias("kl_loss"), r6(F.avg("diff")).alias("logprob_abs_diff"), r6(F.avg("pg") + 0.01 * F.avg("kl")).alias("loss"), F.count("*").alias("sequences"))


@query(BASE + MEAN.format(x="greatest((new - reward) * (new - reward), (old + least(greatest(new - old, -0.05), 0.05) - reward) * (old + least(greatest(new - old, -0.05), 0.05) - reward))") + " AS value_loss" + BY)
def g9_value_loss(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    returns = K.broadcast_to(c["reward"], c["new"])
    return per_sequence(spark, d, value_loss=K.masked_mean(K.value_loss(c["new"], c["old"], returns, 0.05), c["mask"]))


@query(f"WITH {TOK}, q AS (SELECT session_id, turn, sum(-new * mask) AS s, sum(mask) AS m FROM tok GROUP BY 1, 2) SELECT round(sum(s), 6) + 0.0 AS token_sum, round(sum(s) / greatest(sum(m), 1), 6) + 0.0 AS per_token, round(avg(s / greatest(m, 1)), 6) + 0.0 AS per_sequence FROM q")
def g10_g13_nll_reducers(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    q = sequences(spark, d).select(K.masked_sum(K.nll(c["new"]), c["mask"]).alias("s"), K.total(c["mask"]).alias("m"))
    return q.agg(r6(F.sum("s")).alias("token_sum"), r6(F.sum("s") / F.greatest(F.sum("m"), F.lit(1.0))).alias("per_token"), r6(F.avg(F.col("s") / F.greatest(F.col("m"), F.lit(1.0)))).alias("per_sequence"))


@query(f"WITH {TOK}, q AS (SELECT *, sum((new - old) * mask) OVER w AS seq, sum((new - old) * mask) OVER w / greatest(sum(mask) OVER w, 1) AS geo, max(CASE WHEN new - old < ln(0.9) AND mask > 0 THEN 1 ELSE 0 END) OVER w AS bad FROM tok WINDOW w AS (PARTITION BY session_id, turn)) SELECT session_id, turn, round(sum(least(exp(new - old), 1.05) * mask), 6) + 0.0 AS token_truncate, round(sum(least(greatest(exp(least(greatest(seq, -20), 20)), 0.9), 1.1) * mask), 6) + 0.0 AS sequence_clip, round(sum(exp(geo) * mask), 6) + 0.0 AS geometric_mask_weight, CAST(sum(CASE WHEN exp(geo) BETWEEN 0.97 AND 1.03 AND bad = 0 THEN mask ELSE 0 END) AS BIGINT) AS kept FROM q GROUP BY 1, 2")
def g14_mismatch_weights(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    w = lambda level, mode, lo, hi: K.total(K.mis_weights(c["new"], c["old"], c["mask"], level, mode, lo, hi))
    kept = K.total(K.mis_mask(c["new"], c["old"], c["mask"], "geometric", 0.97, 1.03, 0.9)).cast("long")
    return sequences(spark, d).select(*KEY, r6(w("token", "truncate", 0.0, 1.05)).alias("token_truncate"), r6(w("sequence", "clip", 0.9, 1.1)).alias("sequence_clip"), r6(w("geometric", "mask", 0.97, 1.03)).alias("geometric_mask_weight"), kept.alias("kept"))


@query(f"WITH {TOK}, q AS (SELECT session_id, turn, sum(new * mask) / greatest(sum(mask), 1) AS t, sum(old * mask) / greatest(sum(mask), 1) AS r, sum((old - new) * mask) / greatest(sum(mask), 1) AS kl, sum((exp(new - old) - (new - old) - 1) * mask) / greatest(sum(mask), 1) AS k3, sum(exp(2 * least(greatest(new - old, -20), 20)) * mask) / greatest(sum(mask), 1) - 1 AS c2, exp(2 * least(greatest(sum((new - old) * mask), -20), 20)) - 1 AS c2s FROM tok GROUP BY 1, 2) SELECT session_id, turn, " + ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in (("training_log_ppl", "-t"), ("training_ppl", "exp(-t)"), ("rollout_log_ppl", "-r"), ("rollout_ppl", "exp(-r)"), ("kl", "kl"), ("k3_kl", "k3"), ("log_ppl_diff", "r - t"), ("log_ppl_abs_diff", "abs(r - t)"), ("ppl_ratio", "exp(r - t)"), ("chi2_token", "c2"), ("chi2_seq", "c2s"))) + " FROM q")
def g15_mismatch_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    return per_sequence(spark, d, **K.mismatch_metrics(c["new"], c["old"], c["mask"]))


@query(f"WITH {TOK} SELECT session_id, turn, round(sum(adv), 6) + 0.0 AS total, count(*) AS n FROM tok GROUP BY 1, 2")
def f7_grpo_returns(spark: SparkSession, d: str) -> DataFrame:
    r = K.grpo_returns(F.get("adv", F.lit(0)), F.col("new"))
    return sequences(spark, d).select(*KEY, r6(K.total(r)).alias("total"), F.size(r).cast("long").alias("n"))


@query(f"WITH {TOK}, l AS (SELECT *, max(CASE WHEN mask > 0 THEN pos END) OVER (PARTITION BY session_id, turn) AS last FROM tok), r AS (SELECT *, -0.1 * (new - ref) * mask + CASE WHEN pos = last THEN reward ELSE 0 END AS tr FROM l) SELECT a.session_id, a.turn, a.pos, round(sum(pow(0.95, b.pos - a.pos) * b.tr), 6) + 0.0 AS ret FROM r a JOIN r b ON a.session_id = b.session_id AND a.turn = b.turn AND b.pos >= a.pos GROUP BY 1, 2, 3")
def f8_discounted_returns(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    kl = F.zip_with("new", "ref", lambda a, b: a - b)
    out = K.reinforce_pp_returns(sequences(spark, d), c["reward"], kl, c["mask"], 0.1, 0.95, "g").select(*KEY, F.posexplode("g").alias("p", "ret"))
    return out.select(*KEY, (F.col("p") + 1).cast("long").alias("pos"), r6("ret").alias("ret"))


@query(BASE + "round(sum(reward - 0.1 * (new - ref)), 6) + 0.0 AS total" + BY)
def f9_baseline_advantages(spark: SparkSession, d: str) -> DataFrame:
    kl = F.zip_with("new", "ref", lambda a, b: a - b)
    return per_sequence(spark, d, total=K.total(K.reinforce_pp_baseline(F.col("reward"), kl, 0.1)))


@query(f"WITH {TOK}, r AS (SELECT *, -0.1 * (new - ref) + CASE WHEN pos = n THEN reward ELSE 0 END AS tr, coalesce(lead(old) OVER (PARTITION BY session_id, turn ORDER BY pos), 0) AS nxt FROM tok), e AS (SELECT *, tr + 0.99 * nxt - old AS delta FROM r), g AS (SELECT a.session_id, a.turn, a.pos, any_value(a.old) AS v, sum(pow(0.99 * 0.9, b.pos - a.pos) * b.delta) AS adv FROM e a JOIN e b ON a.session_id = b.session_id AND a.turn = b.turn AND b.pos >= a.pos GROUP BY 1, 2, 3) SELECT session_id, turn, pos, round(adv, 6) + 0.0 AS advantage, round(adv + v, 6) + 0.0 AS ret FROM g")
def f10_f12_gae(spark: SparkSession, d: str) -> DataFrame:
    """Token rewards with the reward at the last token, then advantages with old log-probabilities as values."""
    c = cols()
    kl = F.zip_with("new", "ref", lambda a, b: a - b)
    rewards = K.token_rewards(c["reward"], kl, c["mask"], 0.1, at_last_trainable=False)
    g = K.gae(sequences(spark, d), rewards, c["old"], 0.99, 0.9, "a")
    out = g.select(*KEY, F.posexplode(F.arrays_zip("a", F.col("old").alias("v"))).alias("p", "x"))
    return out.select(*KEY, (F.col("p") + 1).cast("long").alias("pos"), r6("x.a").alias("advantage"), r6(F.col("x.a") + F.col("x.v")).alias("ret"))


@query(BASE + "round(sum(adv - 0.3 * (new - ref)), 6) + 0.0 AS total" + BY)
def f13_on_policy_distillation(spark: SparkSession, d: str) -> DataFrame:
    c = cols()
    return per_sequence(spark, d, total=K.total(K.opd_advantage(c["adv"], c["new"], c["ref"], 0.3)))


@query(f"WITH {TOK}, m AS (SELECT sum(mask) AS n, sum(new * mask) AS s, sum(new * new * mask) AS q FROM tok), v AS (SELECT s / n AS mean, (q / n - (s / n) * (s / n)) * n / greatest(n - 1, 1) AS var FROM m) SELECT session_id, turn, round(sum((new - mean) / sqrt(var + 1e-8)), 6) + 0.0 AS total FROM tok, v GROUP BY 1, 2")
def f14_masked_whitening(spark: SparkSession, d: str) -> DataFrame:
    return advantages.whitened(sequences(spark, d), "new", "mask").select(*KEY, r6(K.total(F.col("whitened"))).alias("total"))


@query(BASE + "count(CASE WHEN pos > 1 AND pos > n - 3 THEN 1 END) AS kept, round(coalesce(sum(CASE WHEN pos > 1 AND pos > n - 3 THEN old END), 0), 6) + 0.0 AS total" + BY)
def c28_teacher_trim(spark: SparkSession, d: str) -> DataFrame:
    """Teacher log-probabilities without the first, cut to the last three."""
    tail = K.last_n(F.slice("old", 2, F.greatest(F.size("old") - 1, F.lit(0))), F.lit(3))
    return sequences(spark, d).select(*KEY, F.size(tail).cast("long").alias("kept"), r6(K.total(tail)).alias("total"))


@query("""WITH t AS (SELECT DISTINCT session_id, turn, prompt_ids, output_ids FROM turns WHERE prompt_ids IS NOT NULL AND output_ids IS NOT NULL) SELECT session_id, turn, CAST(len(prompt_ids) AS BIGINT) AS first_end, CAST(len(prompt_ids) + len(output_ids) AS BIGINT) AS second_end, CAST(list_sum(list_concat(prompt_ids, output_ids)) AS BIGINT) AS id_sum FROM t""")
def c18_csr_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two ragged rows, of one row each, merged into one of two rows."""
    t = table(spark, d, "turns").where("prompt_ids is not null and output_ids is not null").select(*KEY, "prompt_ids", "output_ids").distinct()
    off = lambda c: F.array(F.lit(0), F.size(c))
    ids, offsets = K.csr_merge(F.col("prompt_ids"), off("prompt_ids"), F.col("output_ids"), off("output_ids"))
    total = F.when(F.size(ids) > 0, F.aggregate(ids, F.lit(0).cast("long"), lambda s, v: s + v))
    return t.select(*KEY, F.get(offsets, F.lit(1)).cast("long").alias("first_end"), F.get(offsets, F.lit(2)).cast("long").alias("second_end"), total.alias("id_sum"))


@query("""WITH t AS (SELECT DISTINCT session_id, turn, output_ids FROM turns WHERE len(output_ids) > 0), u AS (SELECT session_id, turn, unnest(output_ids) % 5 AS kept, generate_subscripts(output_ids, 1) AS pos FROM t) SELECT round(sum(CASE WHEN pos % 2 = 1 THEN kept ELSE 0 END) / sum(CASE WHEN pos % 2 = 1 THEN 1.0 ELSE 0 END), 6) + 0.0 AS kept_per_token FROM u""")
def e9_kept_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Mean number of ids kept per trainable token, from ragged offsets (ids mod 5 stand in for the counts)."""
    t = table(spark, d, "turns").where("size(output_ids) > 0").select(*KEY, "output_ids").distinct()
    counts = F.transform("output_ids", lambda x: x % 5)
    start = F.array(F.lit(0))
    offsets = F.aggregate(counts, start, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    mask = F.transform("output_ids", lambda x, i: F.when(i % 2 == 0, 1).otherwise(0))
    q = t.select(offsets.alias("o"), mask.alias("m"))
    total, n = K.kept_vocabulary(F.col("o"), F.col("m"))
    return q.agg(r6(F.sum(total) / F.sum(n)).alias("kept_per_token"))


@query("""WITH u AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings), n AS (SELECT vec_id, max(v) + ln(sum(exp(v - m))) AS z FROM (SELECT *, max(v) OVER (PARTITION BY vec_id) AS m FROM u) GROUP BY 1) SELECT u.vec_id, round(-sum(exp(v - z) * (v - z)), 5) + 0.0 AS entropy FROM u JOIN n USING (vec_id) GROUP BY 1""")
def g16_small_vocabulary_entropy(spark: SparkSession, d: str) -> DataFrame:
    """The whole embedding as the logits."""
    x = table(spark, d, "embeddings").where("size(embedding) > 0").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("l"))
    return x.select("vec_id", (F.round(K.entropy(F.col("l")), 5) + F.lit(0.0)).alias("entropy"))


@query("""WITH s AS (SELECT sample_indices AS i, max(len(tokens)) AS n, max(response_lengths) AS r FROM train_data WHERE sample_indices IS NOT NULL AND tokens IS NOT NULL GROUP BY 1) SELECT i AS sample_index, CAST(n AS BIGINT) * 6 * 1000000 + CAST(n AS BIGINT) * n * 12 * 4096 AS flops FROM s""")
def g17_flops(spark: SparkSession, d: str) -> DataFrame:
    """Training FLOPs of a sample: linear in its tokens for the weights, quadratic for attention (fixed model sizes)."""
    s = table(spark, d, "train_data").where("sample_indices is not null and tokens is not null").groupBy(F.col("sample_indices").alias("sample_index")).agg(F.max(F.size("tokens")).cast("long").alias("n"))
    return s.select("sample_index", (F.col("n") * 6 * 1_000_000 + F.col("n") * F.col("n") * 12 * 4096).alias("flops"))
