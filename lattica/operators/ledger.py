"""Costs of language-model calls: prices, budgets, reports; the client protocol and a deterministic stand-in."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: USD for a million input and output tokens.
PRICES = {
    "gpt-4o": (5.0, 15.0),
    "gpt-4o-mini": (0.15, 0.60),
    "gpt-4": (30.0, 60.0),
    "gpt-4-turbo": (10.0, 30.0),
    "claude-3-5-sonnet": (3.0, 15.0),
    "claude-3-opus": (15.0, 75.0),
    "grok-4-1": (3.0, 15.0),
    "grok-4-1-fast": (0.20, 0.50),
    "grok-4-1-fast-reasoning": (0.20, 0.50),
    "deepseek-chat": (0.28, 0.42),
    "deepseek-reasoner": (0.28, 0.42),
}
#: A model without a price costs what this one does.
DEFAULT_MODEL = "gpt-4o"
OUTPUT_ESTIMATE = 500


def cost(model: Column, tokens_in: Column, tokens_out: Column) -> Column:
    price = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for m, p in PRICES.items() for x in (m, p[k] / 1_000_000)]), model), F.lit(PRICES[DEFAULT_MODEL][k] / 1_000_000))
    return tokens_in * price(0) + tokens_out * price(1)


def greedy_accept(calls: DataFrame, limit: float, group: str = "budget") -> DataFrame:
    """calls (budget, seq, estimate, cost) with accepted: in order of seq a call counts if neither its estimate nor its cost overflows what is left.

    A refused call costs nothing and later ones may still fit, so this is a fold, not a running sum: each budget's calls are streamed in order
    past one number, whatever their count. A call without estimate or cost is refused. accepted calls' running total is total.
    """
    number = lambda c, kind: F.col(c).cast(kind).alias(c)
    ordered = calls.select(group, number("seq", "long"), number("estimate", "double"), number("cost", "double")).repartition(group).sortWithinPartitions(group, "seq", "estimate", "cost")

    def run(batches):
        now, total = object(), 0.0
        for b in batches:
            accepted, totals = [], []
            for budget, estimate, cost in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if budget != now:
                    now, total = budget, 0.0
                ok = estimate is not None and cost is not None and total + estimate <= limit and total + cost <= limit
                total += cost if ok else 0.0
                accepted.append(ok)
                totals.append(total)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(accepted, pa.bool_()), pa.array(totals, pa.float64())], [group, "seq", "accepted", "total"])

    return ordered.mapInArrow(run, f"`{group}` {calls.schema[group].dataType.simpleString()}, seq long, accepted boolean, total double")


def running_accept(calls: DataFrame, limit: float, group: str = "budget") -> DataFrame:
    """calls with total and accepted, where the first overflow ends a budget."""
    total = F.sum("cost").over(Window.partitionBy(group).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return calls.withColumn("total", total).withColumn("accepted", F.col("total") <= limit)


def report(calls: DataFrame, limit: float) -> DataFrame:
    """One row: tokens, cost, what remains of the limit."""
    out = calls.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total_tokens"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    return out.select("total_tokens", F.bround("cost", 4).alias("total_cost"), F.lit(float(limit)).alias("cost_limit"), F.bround(F.greatest(F.lit(0.0), limit - F.col("cost")), 4).alias("remaining"))


class CostLimitExceeded(RuntimeError):
    """A call would cost more than what is left."""


@dataclass(frozen=True)
class Reply:
    content: str
    model: str
    tokens: int
    cost: float


class Client(Protocol):
    def chat(self, system: str, user: str) -> Reply: ...


class StubClient:
    """A client without a model: replies come from a function; costs and limits work as with a model."""

    def __init__(self, model: str = DEFAULT_MODEL, limit: float = 5.0, reply: Callable[[str, str], str] = lambda s, u: "{}", retries: int = 3, delay: float = 1.0):
        self.model, self.limit, self.reply, self.retries, self.delay = model, limit, reply, retries, delay
        self.tokens, self.cost, self.calls = 0, 0.0, []

    def _price(self, tokens_in: int, tokens_out: int) -> float:
        a, b = PRICES.get(self.model, PRICES[DEFAULT_MODEL])
        return (tokens_in * a + tokens_out * b) / 1_000_000

    def _check(self, more: float) -> None:
        if self.cost + more > self.limit:
            raise CostLimitExceeded(f"{self.cost:.4f} + {more:.4f} USD is over {self.limit:.2f}")

    def chat(self, system: str, user: str) -> Reply:
        tokens_in = (len(system) + len(user)) // 4
        self._check(self._price(tokens_in, OUTPUT_ESTIMATE))
        for attempt in range(self.retries):
            try:
                content = self.reply(system, user)
                break
            except ConnectionError:
                if attempt + 1 == self.retries:
                    raise
                time.sleep(self.delay * 2**attempt)
        tokens_out = len(content) // 4
        spent = self._price(tokens_in, tokens_out)
        self._check(spent)
        self.tokens += tokens_in + tokens_out
        self.cost += spent
        self.calls.append(Reply(content, self.model, tokens_in + tokens_out, spent))
        return self.calls[-1]

    def reset(self) -> None:
        self.tokens, self.cost, self.calls = 0, 0.0, []
