"""Evaluation protocols (E1-E8) composed from the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorcast import config
from factorcast.operators.history import drop_not_applicable, last_k_buffer, mark_first_seen
from factorcast.operators.metrics import rmse, round_metric
from factorcast.operators.recall import recall_along_trail
from factorcast.session import broadcast_max_bytes, factor_row_bytes, materialize
from factorcast.functions.vectors import cold_start_prediction, is_cold
from factorcast.operators.ordering import block_bounds, global_index, holdout_split, time_blocks
from factorcast.operators.recommend import predict
from factorcast.operators.train import (batch_gd, block_sgd, block_sgd_table, combine_factors,
                                        distributed_sgd, replay_rows, score_and_learn)
from factorcast.sources.sinks import delete_scratch, scratch_path


def eval_holdout(ratings: DataFrame, key_cols: list[str], k: int = 8, epochs: int = 2,
                 gamma: float = 0.05, lam: float = 0.02, seed: int = config.SEED,
                 train_fraction: float = config.TRAIN_FRACTION, trainer: str = "batch",
                 blocks: int = config.GRID) -> DataFrame:
    """Hash hold-out split, learning on the train side, prediction of the
    test side (cold rows at 3.5), one row (n, unknown, rmse).

    ``trainer``: 'batch' (mean gradients, L1) or 'sgd' (a step per rating in
    a new pseudo-random order each epoch, L2, on a grid of ``blocks``)."""
    split = holdout_split(ratings, key_cols, seed, train_fraction)
    train = split.where(F.col("is_train"))
    test = split.where(~F.col("is_train")).select("user", "product", "rating")
    uf, pf = _trained(train, trainer, k, epochs, gamma, lam, key_cols, blocks, seed)
    pred = predict(test, uf, pf, k, pf_rows=pf.count())
    return rmse(pred).select("n", "unknown", "rmse")


def _trained(train: DataFrame, trainer: str, k: int, epochs: int, gamma: float, lam: float,
             row_cols: list[str], blocks: int, seed: int, keys: list[str] | None = None):
    if trainer == "batch":
        return batch_gd(train, k, epochs, gamma, lam, keys=keys)
    if trainer != "sgd":
        raise ValueError(f"trainer must be 'batch' or 'sgd', not {trainer!r}")
    return block_sgd(train, k, epochs, gamma, gamma, lam, blocks=blocks, order_cols=row_cols,
                     seed=seed, keys=keys)


GROUP_TABLES = 2             # times a group of rounds replicates the ratings
GROUP_ROWS = 100_000_000     # rows that a group of online rounds may have in any case


def round_groups(n_blocks: int, fit: int, tables: float = GROUP_TABLES) -> list[tuple[int, int]]:
    """Rounds 1..n_blocks-1 in consecutive groups [lo, hi]: ``fit`` rounds each, or
    if that is none as many as train on at most ``tables`` x all blocks, one at least."""
    groups, lo = [], 1
    while lo < n_blocks:
        hi, blocks = lo, lo
        while hi + 1 < n_blocks and (hi + 2 - lo <= fit or
                                     fit < 1 and blocks + hi + 1 <= tables * n_blocks):
            hi += 1
            blocks += hi
        groups.append((lo, hi))
        lo = hi + 1
    return groups


def eval_expanding(ratings: DataFrame, order_cols: list[str], k: int = 8, epochs: int = 2,
                   gamma: float = 0.05, lam: float = 0.02,
                   n_blocks: int = config.N_BLOCKS, trainer: str = "batch",
                   blocks: int = config.GRID, seed: int = config.SEED) -> DataFrame:
    """For every round i = 1..n_blocks-1 a *fresh* model trained on
    blocks [0, i) predicts block i (``trainer`` as in ``eval_holdout``).

    Rounds train side by side as keyed models (round is part of the
    factor-table key): a rating of block b is offered to rounds b+1.. by
    ``explode`` (no join), so the 49 retrains are a few jobs an epoch.  The
    replicated volume is what the protocol costs anyway (sum of prefixes).
    Rounds are taken in groups whose keyed product tables fit the broadcast
    limit, so that the replicated ratings do not move to meet them; if one
    round's does not fit, in groups that replicate the ratings at most
    ``GROUP_TABLES`` times, so what a group keeps on disk is in proportion to
    the ratings.  Returns (round, lo, hi, n, unknown, rmse), a round without
    test rows having n = 0 and a null rmse."""
    spark = ratings.sparkSession
    ix = global_index(ratings, order_cols)
    n = ix.count()
    b = time_blocks(ix, n, n_blocks=n_blocks).where(F.col("block").isNotNull())
    products = b.select("product").distinct().count()
    fit = broadcast_max_bytes(spark) // max(1, products * factor_row_bytes(k))

    def group(lo: int, hi: int) -> DataFrame:
        rounds = F.sequence(F.greatest(F.col("block") + 1, F.lit(lo).cast("long")), F.lit(hi).cast("long"))
        train = b.where(F.col("block") < hi).select(
            F.explode(rounds).alias("round"), "idx", "user", "product", "rating")
        test = b.where(F.col("block").between(lo, hi)).select(
            F.col("block").alias("round"), "user", "product", "rating")
        uf, pf = _trained(train, trainer, k, epochs, gamma, lam, ["idx"], blocks, seed, ["round"])
        u = uf.select("round", F.col("id").alias("user"), F.col("f").alias("uf"))
        p = pf.select("round", F.col("id").alias("product"), F.col("f").alias("pf"))
        pred = (test.join(u, ["round", "user"], "left").join(p, ["round", "product"], "left")
                .withColumn("prediction", cold_start_prediction("uf", "pf", k))
                .withColumn("is_cold", is_cold("uf", "pf")))
        return materialize(rmse(pred, group_cols=["round"]))

    found = []
    for lo, hi in round_groups(n_blocks, fit):
        found.append(group(lo, hi))
        # the group's frames are out of reach: a collection lets Spark's cleaner
        # delete their shuffle files and checkpoints before the next group
        spark._jvm.System.gc()
    # at most one frame a round, of one row a round
    return _every_round(reduce(DataFrame.unionByName, found), spark, n, n_blocks)


# ---------------------------------------------------------------- online protocols

def _metrics(pred: DataFrame, t_col: str, round_rows: int) -> DataFrame:
    """Overall (round NULL) + full rounds of ``round_rows`` rows of t_col."""
    overall = rmse(pred).select(F.lit(None).cast("long").alias("round"), "n", "unknown", "rmse")
    rounds = (pred.withColumn("round", F.floor(F.col(t_col) / F.lit(round_rows)).cast("long") + 1)
              .groupBy("round")
              .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_cold").cast("long")).alias("unknown"),
                   F.sqrt(F.avg((F.col("rating") - F.col("prediction")) ** 2)).alias("rmse"))
              .where(F.col("n") == round_rows))
    return overall.unionByName(rounds)


def _every_round(metrics: DataFrame, spark, n: int, n_blocks: int) -> DataFrame:
    """(round, lo, hi, n, unknown, rmse) of every round 1..n_blocks-1."""
    edges = block_bounds(spark, n, n_blocks).withColumnRenamed("block", "round").where("round >= 1")
    return edges.join(metrics, "round", "left").select(
        "round", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("unknown", F.lit(0)).alias("unknown"), "rmse")


def eval_holdout_distributed(ratings: DataFrame, key_cols: list[str], k: int = 8, epochs: int = 2,
                             gamma: float = 0.01, lam: float = 0.02, blocks: int = config.GRID,
                             seed: int = config.SEED,
                             train_fraction: float = config.TRAIN_FRACTION) -> DataFrame:
    """Hash split, conflict-free distributed SGD (one rate), predictions
    joined back on (user, product) (duplicate pairs multiply, as the pair
    join does), (count, sum) aggregate -> (n, total, rmse)."""
    split = holdout_split(ratings, key_cols, seed, train_fraction)
    train = split.where(F.col("is_train"))
    test = split.where(~F.col("is_train")).select("user", "product", "rating")
    uf, pf = distributed_sgd(train, k, epochs, gamma, lam, blocks=blocks, seed=seed,
                             order_cols=key_cols)
    pred = predict(test.select("user", "product"), uf, pf, k)
    j = test.join(pred, ["user", "product"])
    se = (F.col("rating") - F.col("prediction")) ** 2
    return j.agg(F.count(F.lit(1)).alias("n"), F.sum(se).alias("total"),
                 F.sqrt(F.sum(se) / F.count(F.lit(1))).alias("rmse"))


STEP_ROWS = 1 << 20          # rows learned in one step, in whole micro-batches
REPLAY_STEP_ROWS = 1 << 25   # the same of replays, at most


def _consume(rows: DataFrame, position: str, start: int, end: int, batch_rows: int,
             facs: DataFrame, learn, schema: str = "idx long, score double",
             step_rows: int = STEP_ROWS, at_most: int | None = None) -> DataFrame:
    """Predict-then-learn over positions [start, end) of a stream, one
    micro-batch after the other: ``learn(rows, facs) -> (facs, scores)``,
    where column ``batch`` of the rows is the number of their micro-batch.

    A step learns as many micro-batches as hold ``step_rows`` rows, one at
    least; ``at_most`` bounds the rows where counting them costs too much.  The stream is written once, partitioned by step, so a step reads
    its own rows only; scores are appended as one folder a step.
    Rows are deleted when learned, and the learner's copy of their scores.
    Returns the scores (``schema``, names by position)."""
    spark = rows.sparkSession
    source, scored = scratch_path(spark, "stream-rows"), scratch_path(spark, "stream-scores")
    if start >= end:
        return spark.createDataFrame([], schema)
    batch_rows = max(1, int(batch_rows))
    rows = rows.where(F.col(position) >= start)
    batches = -(-(end - start) // batch_rows)
    size = max(1, step_rows * batches // max(1, at_most or rows.count()))
    number = F.floor((F.col(position) - F.lit(start)) / F.lit(batch_rows)).cast("long")
    staged = rows.withColumn("batch", number).withColumn("step_", F.floor(F.col("batch") / F.lit(size)))
    staged.write.partitionBy("step_").parquet(source)
    staged = spark.read.schema(staged.schema).parquet(source)
    names = [c.split()[0] for c in schema.split(", ")]
    for j in range(-(-batches // size)):
        facs, scores = learn(staged.where(F.col("step_") == j).drop("step_"), facs)
        scores.toDF(*names).write.mode("overwrite").parquet(f"{scored}/step_={j}")
        for written in [f"{source}/step_={j}", *scores.inputFiles()]:
            delete_scratch(spark, written)
    return spark.read.schema(schema).parquet(scored)


def _scored(ix: DataFrame, scores: DataFrame) -> DataFrame:
    """The scored rows with ``is_cold`` (first row of its user or product,
    whatever the micro-batches) and ``prediction`` (cold start where cold)."""
    return (mark_first_seen(ix.select("idx", "user", "product", "rating")).join(scores, "idx")
            .withColumn("prediction", F.when(F.col("is_cold"), F.lit(config.COLD_START))
                        .otherwise(F.col("score"))))


def eval_prequential(ratings: DataFrame, order_cols: list[str], k: int = 8, steps: int = 1,
                     gamma_u: float = 0.01, gamma_i: float = 0.01, lam: float = 0.02,
                     batch_rows: int = config.BATCH_ROWS,
                     round_rows: int = config.PREQUENTIAL_ROUND,
                     n_blocks: int = config.N_BLOCKS, blocks: int = config.GRID,
                     seed: int = config.SEED, shuffle_warmup: bool = True) -> DataFrame:
    """E5: warm up on block 0 (T shuffled epochs), then predict-then-learn
    over the rest: every rating is scored with what was learned before it,
    then learned with T consecutive steps.

    ``batch_rows`` bounds the rows of one step and ``blocks`` is the grid
    inside it (see ``score_and_learn``; blocks=1 is the exact event order).
    ``is_cold`` comes from first-seen positions and depends on neither.
    Returns metrics rows (round NULL = overall)."""
    ix = global_index(ratings, order_cols)
    n = ix.count()
    warm_end = int(n / float(n_blocks) * 1)
    facs = block_sgd_table(ix.where(F.col("idx") < warm_end), combine_factors(None, None, ix.sparkSession),
                           k, steps, gamma_u, gamma_i, lam, blocks, ["idx"],
                           shuffle=shuffle_warmup, seed=seed)

    def learn(batch, facs):
        return score_and_learn(batch, facs, k, steps, gamma_u, gamma_i, lam, ["idx"], blocks=blocks,
                               batch_col="batch")

    scores = _consume(ix.select("idx", "user", "product", "rating"), "idx", warm_end, n,
                      batch_rows, facs, learn)
    pred = _scored(ix, scores).withColumn("t", F.col("idx") - F.lit(warm_end))
    return _metrics(pred, "t", round_rows)


def eval_prequential_last_k(ratings: DataFrame, order_cols: list[str], k: int = 8,
                            last_k: int = 5, gamma_u: float = 0.01, gamma_i: float = 0.01,
                            lam: float = 0.02, batch_rows: int = config.BATCH_ROWS,
                            round_rows: int = config.PREQUENTIAL_ROUND,
                            n_blocks: int = config.N_BLOCKS, blocks: int = config.GRID) -> DataFrame:
    """As E5 with last-K replay learning (a rating is scored before the
    first step of its own replay); the warm-up is one ordered pass.  Replay
    rows do not depend on the factors: those of the whole stream are built
    and written at once, those of the warm-up from its own events."""
    ix = global_index(ratings, order_cols)
    n = ix.count()
    warm_end = int(n / float(n_blocks) * 1)
    rows = replay_rows(last_k_buffer(ix, last_k))
    facs = block_sgd_table(replay_rows(last_k_buffer(ix.where(F.col("idx") < warm_end), last_k)),
                           combine_factors(None, None, ix.sparkSession), k, 1, gamma_u, gamma_i,
                           lam, blocks, ["event", "step"], shuffle=False)

    def learn(batch, facs):
        return score_and_learn(batch, facs, k, 1, gamma_u, gamma_i, lam, ["event", "step"],
                               score_id="scored", blocks=blocks, batch_col="batch", dense=True)

    scores = _consume(rows, "event", warm_end, n, batch_rows, facs, learn, step_rows=REPLAY_STEP_ROWS,
                      at_most=config.REPLAY_PASSES * last_k * (n - warm_end))
    pred = _scored(ix, scores).withColumn("t", F.col("idx") - F.lit(warm_end))
    return _metrics(pred, "t", round_rows)


def eval_expanding_online(ratings: DataFrame, order_cols: list[str], k: int = 8, steps: int = 1,
                          gamma_u: float = 0.01, gamma_i: float = 0.01, lam: float = 0.02,
                          n_blocks: int = config.N_BLOCKS, batch_rows: int = config.BATCH_ROWS,
                          blocks: int = config.GRID, seed: int = config.SEED) -> DataFrame:
    """E3 with predict-then-learn inside every test block.

    Rounds are keyed models trained in the same jobs (fresh model per
    round on blocks [0, i), T shuffled epochs); each test block is then
    consumed in micro-batches of ``batch_rows``, the j-th of every round in
    one pass.  Rounds go in groups that replicate the ratings at most
    ``GROUP_TABLES`` times (or to ``GROUP_ROWS`` rows), and what a group wrote
    is deleted before the next, so the disk it takes is in proportion to the
    ratings.  Returns (round, lo, hi, n, unknown, rmse) of every round."""
    spark = ratings.sparkSession
    ix = global_index(ratings, order_cols)
    n = ix.count()
    b = time_blocks(ix, n, n_blocks=n_blocks).where(F.col("block").isNotNull())
    edges = block_bounds(spark, n, n_blocks).withColumnRenamed("block", "round")
    longest = -(-n // n_blocks)

    def learn(batch, facs):
        facs, scores = score_and_learn(batch, facs, k, steps, gamma_u, gamma_i, lam, ["idx"],
                                       blocks=blocks, keys=["round"], batch_col="batch")
        return facs, scores.select("idx", "score")

    def group(lo: int, hi: int) -> DataFrame:
        rounds = F.sequence(F.greatest(F.col("block") + 1, F.lit(lo).cast("long")), F.lit(hi).cast("long"))
        train = b.where(F.col("block") < hi).select(
            F.explode(rounds).alias("round"), "idx", "user", "product", "rating")
        facs = block_sgd_table(train, combine_factors(None, None, spark, ["round"]), k, steps, gamma_u,
                               gamma_i, lam, blocks, ["idx"], seed=seed, keys=["round"])
        test = (b.where(F.col("block").between(lo, hi)).withColumnRenamed("block", "round")
                .join(F.broadcast(edges), "round")
                .select("round", "idx", "user", "product", "rating",
                        (F.col("idx") - F.col("lo")).alias("at")))
        return _consume(test, "at", 0, longest, batch_rows, facs, learn)

    scored = []
    for lo, hi in round_groups(n_blocks, 0, max(GROUP_TABLES, GROUP_ROWS / max(1, n))):
        scored.append(group(lo, hi))
        # lets Spark's cleaner delete the group's shuffle files and checkpoints
        spark._jvm.System.gc()
    if not scored:
        scored.append(spark.createDataFrame([], "idx long, score double"))
    scores = reduce(DataFrame.unionByName, scored)
    pred = _scored(ix, scores).join(b.select("idx", F.col("block").alias("round")), "idx")
    return _every_round(rmse(pred, group_cols=["round"]), spark, n, n_blocks)


def eval_prequential_recall(feedback: DataFrame, order_cols: list[str], k: int = 8,
                            steps: int = 1, gamma_u: float = 0.01, gamma_i: float = 0.01,
                            lam: float = 0.02, r: int = 10, batch_rows: int = config.BATCH_ROWS,
                            blocks: int = 1) -> DataFrame:
    """For each event recall@R with the factors learned so far (the
    catalogue is the products learned so far), *then* learn it; no warm-up.
    Event i is ranked after event i - 1 was learned.

    Two passes.  Learning goes through the stream in micro-batches and leaves
    a trail: each event's user vector before and product vector after it,
    written as one folder a micro-batch.  Ranking, which is nearly all of the
    work (every event against the whole catalogue), then replays chunks of
    events in parallel (``recall_along_trail``).  Learning in exact event
    order is one task a micro-batch (blocks=1), as each event starts from what
    the one before left; with more blocks it is spread over that many tasks
    and visits a micro-batch stratum by stratum.  Neither the size of the
    micro-batches nor of the chunks changes the result.  Returns the
    per-event samples (idx, user, hits, n_future, recall); aggregate with
    ``recall_metrics``."""
    ix = global_index(feedback, order_cols).select("idx", "user", "product", "rating")

    def learn(batch, facs):
        return score_and_learn(batch, facs, k, steps, gamma_u, gamma_i, lam, ["idx"], blocks=blocks,
                               implicit=True, trail=True, batch_col="batch")

    trail = _consume(ix, "idx", 0, ix.count(), batch_rows, combine_factors(None, None, ix.sparkSession),
                     learn, "idx long, score double, before array<double>, after array<double>")
    return recall_along_trail(ix.join(trail, "idx"), k, r)


def recall_metrics(samples: DataFrame, round_rows: int = config.RECALL_ROUND) -> DataFrame:
    """A5 + A6 over kept samples: overall (round NULL) and per full round
    of ``round_rows`` kept samples (index counted after dropping)."""
    kept = drop_not_applicable(samples)
    overall = kept.agg(F.count(F.lit(1)).alias("n"), F.avg("recall").alias("recall")).select(
        F.lit(None).cast("long").alias("round"), "n", "recall")
    kix = global_index(kept, ["idx"], idx="k")
    rounds = round_metric(kix, "k", round_rows, F.avg("recall"), "recall").select("round", "n", "recall")
    return overall.unionByName(rounds)
