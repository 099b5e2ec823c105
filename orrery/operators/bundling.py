"""Exclusive feature bundling: features that are rarely non-zero together share a binned column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(name: str) -> Column:
    x = F.col(name).cast("double")
    return F.coalesce((x != 0) & ~F.isnan(x), F.lit(False))


def find_bundles(df: DataFrame, edges: dict[str, list[float]], threshold: float = 0.0, max_bins: int = 255) -> list[list[str]]:
    """Bundles of the features of `edges`, most often non-zero first.  A feature joins when the rows that it shares
    with the bundle so far are at most `threshold` of the bundle's rows and the bins fit.  One aggregate tries all
    candidates against the present bundle, so there are at most as many passes as features, each of a few counts."""
    names = list(edges)
    count = df.agg(*[F.count_if(present(f)).alias(f) for f in names]).first()
    order = sorted(names, key=lambda f: (-count[f], names.index(f)))
    bundles: list[list[str]] = []
    left = list(order)
    while left:
        bundle, candidates, bins = [left[0]], left[1:], len(edges[left[0]]) + 2
        while candidates := [c for c in candidates if bins + len(edges[c]) + 1 <= max_bins]:
            union = F.lit(False)
            for member in bundle:
                union = union | present(member)
            row = df.agg(F.count_if(union).alias("_all"), *[F.count_if(union & present(c)).alias(c) for c in candidates]).first()
            at = next((k for k, c in enumerate(candidates) if row[c] / max(row["_all"], 1) <= threshold), None)
            if at is None:
                break
            bundle.append(candidates[at])
            bins += len(edges[candidates[at]]) + 1
            candidates = candidates[at + 1 :]
        bundles.append(bundle)
        left = [f for f in left if f not in bundle]
    return bundles
