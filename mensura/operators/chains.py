"""Lists and cycles given as links: labels and ranks by pointer doubling, in as many rounds as the logarithm of the longest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.operators.spatial import kept

MAX_ROUNDS = 60


def cycles(links: DataFrame) -> DataFrame:
    """node, label (the smallest node of its cycle) for links (node, next) in which every node is the next of exactly one."""
    state = kept(links.select("node", "next", F.col("node").alias("label")))
    mark = lambda df: df.agg(F.bit_xor(F.xxhash64("node", "label"))).first()[0]
    before = mark(state)
    for _ in range(MAX_ROUNDS):
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("further"), F.col("label").alias("beyond"))
        state = kept(state.join(ahead, "next").select("node", F.col("further").alias("next"), F.least("label", "beyond").alias("label")))
        last, before = before, mark(state)
        if last == before:
            # a label is the least of the next 2^k nodes; were it not yet the cycle's, doubling would have changed one
            return state.select("node", "label")
    raise RuntimeError(f"cycles not labelled in {MAX_ROUNDS} rounds")


def ranks(links: DataFrame) -> DataFrame:
    """node, last (the end of its list), after (how many nodes come after it) for links (node, next) in which the end of a
    list has a null next and no node is the next of two."""
    state = kept(links.select("node", "next", F.col("node").alias("last"), F.col("next").isNotNull().cast("long").alias("after")))
    for _ in range(MAX_ROUNDS):
        if state.filter("next IS NOT NULL").isEmpty():
            return state.select("node", "last", "after")
        ahead = state.select(F.col("node").alias("next"), F.col("next").alias("further"), F.col("last").alias("end"), F.col("after").alias("more"))
        open_, closed = state.filter("next IS NOT NULL"), state.filter("next IS NULL")
        moved = open_.join(ahead, "next").select("node", F.col("further").alias("next"), F.col("end").alias("last"), (F.col("after") + F.col("more")).alias("after"))
        state = kept(moved.unionByName(closed))
    raise RuntimeError(f"lists not ranked in {MAX_ROUNDS} rounds")


def followed(node: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """label (the smallest node of the cycle) and after (how many of the cycle come after it, up to the one before its smallest) of
    nodes that are all in one task; following is the place of the next one of each."""
    label, ahead = node.copy(), following.copy()
    for _ in range(max(1, len(node)).bit_length()):
        label, ahead = np.minimum(label, label[ahead]), ahead[ahead]
    last = node[following] == label
    after, ahead = (~last).astype(np.int64), np.where(last, np.arange(len(node)), following)
    for _ in range(max(1, len(node)).bit_length()):
        after, ahead = after + after[ahead], ahead[ahead]
    return label, after
