"""Checked query of a whole generation run, with a model that repeats examples and sometimes says nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tabkit.plans.base import query, table
from tabkit.plans.generate import generate
from tabkit.plans.queries_text import SEED, SHOTS, _draw_sql, _index_sql

ROWS = 5  # asked for in a prompt


def echo_model(key: str):
    """Repeats the examples of a prompt; says nothing where the first one's key is divisible by 5."""

    def echo(prompts, max_tokens):
        # A local function travels to the workers by value; they need no tabkit.
        import json
        import re

        texts = []
        for prompt in prompts:
            rows = re.findall(r"^\d+\. (\{.*\})$", prompt.split("## Examples")[1].split("## Instructions")[0], re.M)
            silent = json.loads(rows[0])[key] % 5 == 0
            texts.append("" if silent else "<think>hm</think>\n" + "\n".join(f"{i}. {r}" for i, r in enumerate(rows, 1)))
        return texts

    return echo


@query(f"""WITH prompts AS (SELECT range AS prompt_id, {SHOTS} AS k_shot, n FROM (SELECT count(*) AS n FROM customer) c, range((SELECT count(*) FROM customer))),
draws AS ({_draw_sql("SELECT * FROM prompts", 'k_shot', f"'{SEED}:{SHOTS}:' || prompt_id", 'n', SHOTS, 'prompt_id')}),
said AS (SELECT prompt_id, shot_no, c.* FROM draws JOIN ({_index_sql('customer', 'c_custkey')}) c USING (idx)
  QUALIFY first_value(c_custkey) OVER (PARTITION BY prompt_id ORDER BY shot_no) % 5 <> 0)
SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment
FROM (SELECT * FROM said WHERE shot_no <= {ROWS} ORDER BY prompt_id, shot_no LIMIT (SELECT count(*) FROM customer))""")
def generate_run(spark, d) -> DataFrame:
    """As many rows as there are customers, in rounds that learn how many rows a prompt gives."""
    train = table(spark, d, "customer")
    rows, _ = generate(train, echo_model("c_custkey"), train.count(), ["c_custkey"], SHOTS, ROWS, prompts_per_batch=2000, representative_threshold=None, seed=SEED, first_prompts=20)
    return rows
