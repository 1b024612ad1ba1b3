"""The evidence contract and the registry of evidence operators.

An evidence operator is a function from a Context to a DataFrame of evidence
rows.  `register` adds one; user code may register its own.
"""

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ... import fixed
from ...config import Config
from ...schemas import EVIDENCE_COLUMNS, Inputs
from ..postings import Postings, index_files

REPO = ["forge", "repo"]


@dataclass(frozen=True)
class Context:
    """What an evidence operator may read."""

    inputs: Inputs
    cfg: Config
    candidates: DataFrame       # gated candidates
    keys: DataFrame             # gated candidates x keys of their person
    packages: DataFrame         # package references of persons
    index: Postings | None = None

    @cached_property
    def postings(self) -> Postings:
        """What the role files say: the run's index, or one of these inputs."""
        return self.index or index_files(self.inputs, self.cfg.proposals_per_series)


Operator = Callable[[Context], DataFrame]
_OPERATORS: dict[str, Operator] = {}


def register(name: str) -> Callable[[Operator], Operator]:
    def add(fn: Operator) -> Operator:
        _OPERATORS[name] = fn
        return fn
    return add


@contextmanager
def registered(name: str, fn: Operator):
    """`fn` registered for as long as the block runs."""
    before = dict(_OPERATORS)
    register(name)(fn)
    try:
        yield
    finally:
        _OPERATORS.clear()
        _OPERATORS.update(before)


def operators() -> dict[str, Operator]:
    """All registered operators, built-in ones in tie-break order first."""
    from . import credits, documents, feeds, pages, proposals, rosters, manifests  # noqa: F401
    order = {n: i for i, n in enumerate(fixed.EVIDENCE_ORDER)}
    return dict(sorted(_OPERATORS.items(), key=lambda kv: order.get(kv[0], len(order))))


def emit(df: DataFrame, name: str, *, role, url: Column, confidence, detail: Column,
         seq=0, source=None, **extra: Column) -> DataFrame:
    """Evidence rows in the common schema.

    `ord` keeps operator order and, within one, `seq`: it breaks ties between
    equally strong evidence.
    """
    position = (fixed.EVIDENCE_ORDER.index(name) if name in fixed.EVIDENCE_ORDER
                else len(fixed.EVIDENCE_ORDER))
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    given = {
        "person_id": F.col("person_id"), "forge": F.col("forge"), "repo": F.col("repo"),
        "ord": F.lit(position << 40).cast("bigint") + lit(seq).cast("bigint"),
        "source": lit(source if source is not None else name), "role": lit(role),
        "url": url, "confidence": lit(confidence), "detail": detail, **extra,
    }
    default = {"capped": F.lit(False), "approx": F.lit(False)}
    return df.select(*[
        given.get(c, default.get(c, F.lit(None))).cast(t).alias(c) for c, t in EVIDENCE_COLUMNS])


def check_schema(df: DataFrame, name: str) -> DataFrame:
    got = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    if got != EVIDENCE_COLUMNS:
        raise ValueError(f"evidence operator {name} returned {got}")
    return df
