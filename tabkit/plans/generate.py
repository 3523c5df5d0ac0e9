"""A generation run: representative rows, profile, rounds of prompts, typed rows."""

from __future__ import annotations

import math
import threading
import uuid
import warnings
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabkit.operators.decode import cap_per_prompt, complete, decode, first_rows
from tabkit.operators.profile import DatasetProfile, profile
from tabkit.operators.prompt import (
    DEFAULT_SHOTS,
    MAX_EMPTY_ROUNDS,
    MAX_RETRY_TOKENS,
    ROWS_PER_PROMPT,
    build_prompts,
    dense_index,
    draw_shots,
    plan_next_round,
    schema_block,
)
from tabkit.operators.sample import representative
from tabkit.plans.ledger import Ledger

FIRST_PROMPTS = 300  # of the first round, which learns how many rows a prompt gives
PROMPTS_PER_BATCH = 10_000  # answered in one job and noted together
UNDER_WAY = 4  # batches asked at once, so that the start and the note of one are not waited for by the others


def generate(
    train: DataFrame,
    fn: Callable[[list[str], int], list[str]],
    n_rows: int,
    key: Sequence[str],
    k_shot: int = 80,
    rows_per_prompt: int = ROWS_PER_PROMPT,
    prompts_per_batch: int = PROMPTS_PER_BATCH,
    max_tokens: int = 8192,
    mode: str = "json",
    target: str | None = None,
    overrides: Mapping[str, str] | None = None,
    conditions: Mapping[str, str] | None = None,
    representative_threshold: float | None = 0.7,
    correlations: bool = True,
    permute: bool = False,
    max_concurrency: int | None = None,
    seed: int = 42,
    run_id: str | None = None,
    first_prompts: int = FIRST_PROMPTS,
) -> tuple[DataFrame, DatasetProfile]:
    """Rows made by a model from ``k_shot`` examples per prompt, and the profile they follow.

    ``fn(prompts, max_tokens)`` returns one text per prompt. After a first round of at most ``first_prompts`` prompts each round asks for
    all rows still missing, at the decode rate seen so far, so the number of rounds does not grow with ``n_rows``. The prompts of a round are made
    in one job and answered in batches, a few at once (one after another where ``max_concurrency`` bounds the calls); a round without rows is tried once more with twice the tokens, and five such rounds end the run. ``key`` identifies training rows.

    Every step is noted in the shared checkpoint folder. A run that was cut off and is called again with its ``run_id`` and the
    same settings goes on after the last noted step: no batch whose answers are noted is sent to the model again. The answers of
    the batches that were under way are lost. The driver sees one row per step.
    """
    spark = train.sparkSession
    settings = {"n_rows": n_rows, "key": list(key), "k_shot": k_shot, "rows_per_prompt": rows_per_prompt, "prompts_per_batch": prompts_per_batch, "first_prompts": first_prompts}
    settings |= {"max_tokens": max_tokens, "mode": mode, "target": target, "overrides": overrides, "conditions": conditions, "representative_threshold": representative_threshold}
    settings |= {"correlations": correlations, "permute": permute, "seed": seed, "columns": train.schema.simpleString()}
    ledger = Ledger(spark, run_id or uuid.uuid4().hex, settings)
    pool = ledger.step("pool", lambda: train if representative_threshold is None else representative(train, "flexible", representative_threshold, seed=seed))
    prof = profile(pool, target, overrides, seed=seed)
    schema = schema_block(prof, pool if correlations else None)
    indexed = ledger.step("pool-index", lambda: dense_index(pool, key, seed))
    encoder = "json" if mode == "json" else "flexible"

    def ask(first: int, count: int) -> DataFrame:
        asked = spark.range(first, first + count).withColumnRenamed("id", "prompt_id")
        shots = draw_shots(pool, asked, key, k_shot, seed, indexed=indexed, size=ledger.rows("pool"))
        prompts = build_prompts(shots, prof, rows_per_prompt, encoder, conditions=conditions, schema=schema, permute=permute, row_key=key, seed=seed)
        prompts = prompts.withColumn("batch", F.floor((F.col("prompt_id") - first) / prompts_per_batch))
        return prompts.repartitionByRange("prompt_id").sortWithinPartitions("batch", "prompt_id")

    def answer(number: int, first: int, count: int, limit: int) -> tuple[DataFrame, int]:
        """The decoded rows of a round. Its prompts meet the pool once and its answers are decoded together; only the model is asked batch by batch."""
        prompts, step = ledger.step(f"round-{number}-prompts", lambda: ask(first, count), by="batch"), f"round-{number}-tokens-{limit}"
        texts = [f"{step}-batch-{k}-texts" for k in range(math.ceil(count / prompts_per_batch))]

        def answer_batch(k: int) -> None:
            at = first + k * prompts_per_batch
            mine = prompts.where(F.col("prompt_id").between(at, min(at + prompts_per_batch, first + count) - 1))
            if "batch" in prompts.columns:  # its own files only; a run begun by an older version has them together
                mine = mine.where(F.col("batch") == k).drop("batch")
            if max_concurrency is None:
                mine = mine.repartition(spark.sparkContext.defaultParallelism)  # a batch lies in one or two files
            ledger.step(texts[k], lambda: complete(mine, lambda batch: fn(batch, limit), max_concurrency=max_concurrency, keep=False))

        _all(spark, answer_batch, len(texts), UNDER_WAY if max_concurrency is None else 1)
        rows = ledger.step(
            f"{step}-rows",
            lambda: cap_per_prompt(decode(ledger.tables(texts).select(F.lit(number).alias("round"), "prompt_id", "text"), prof, mode), rows_per_prompt),
        )
        return rows, ledger.rows(f"{step}-rows")

    rounds: list[DataFrame] = []
    rows = sent = empty_rounds = number = 0
    while rows < n_rows and empty_rounds < MAX_EMPTY_ROUNDS:
        count = plan_next_round(n_rows, rows, sent, rows_per_prompt, None if rows else first_prompts)
        for limit in (max_tokens, min(2 * max_tokens, MAX_RETRY_TOKENS)):
            part, got = answer(number, sent, count, limit)
            if got:
                rounds.append(part)
                break
        sent += count
        rows += got
        empty_rounds = 0 if got else empty_rounds + 1
        number += 1
    if rows < n_rows:
        warnings.warn(f"stopped after {empty_rounds} rounds without rows; got {rows} of {n_rows}", stacklevel=2)
    if not rounds:
        raise RuntimeError("no rows could be decoded")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return first_rows(out, n_rows).select(*[F.col(f"`{c}`") for c in prof.column_order]), prof


def _all(spark: SparkSession, work: Callable[[int], None], count: int, at_once: int) -> None:
    """``work`` for each number below ``count``; after a failure those that have begun end, the others do not begin."""
    failed = threading.Event()

    def one(k: int) -> None:
        if failed.is_set():
            return
        try:
            work(k)
        except BaseException:
            failed.set()
            raise

    with ThreadPoolExecutor(at_once) as threads:
        for done in [threads.submit(inheritable_thread_target(spark)(one), k) for k in range(count)]:
            done.result()


def generate_sweep(train: DataFrame, fn: Callable[[list[str], int], list[str]], n_rows: int, key: Sequence[str], shots: Sequence[int] = DEFAULT_SHOTS, **options) -> DataFrame:
    """One run per number of examples, as one table with ``k_shot``."""
    out = None
    for k in shots:
        rows, _ = generate(train, fn, n_rows, key, k_shot=k, **options)
        rows = rows.withColumn("k_shot", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out
