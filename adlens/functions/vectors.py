"""Nearest-centre expressions.

Centres are few (K <= 96 in every use) and reach the driver anyway as model
parameters, so assignment is one column expression over literals: no join, no
Python, and it stays inside whole-stage codegen.  Ties go to the lower cluster
id, as the K-means predict does.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Centres = Sequence[Sequence[float]]


def _as_cols(features: Sequence[str | Column]) -> list[Column]:
    return [F.col(f) if isinstance(f, str) else f for f in features]


def squared_distance(features: Sequence[str | Column], centre: Sequence[float]) -> Column:
    """Squared Euclidean distance of the feature columns to one literal centre."""
    cols = _as_cols(features)
    if len(cols) != len(centre):
        raise ValueError(f"{len(cols)} features against a centre of {len(centre)} coordinates")
    terms = [(c - F.lit(float(v))) * (c - F.lit(float(v))) for c, v in zip(cols, centre)]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def nearest_centre(features: Sequence[str | Column], centres: Centres,
                   ids: Sequence[int] | None = None) -> Column:
    """Id of the closest centre (squared Euclidean distance, first wins a tie)."""
    if not centres:
        raise ValueError("no centres")
    ids = list(range(len(centres))) if ids is None else list(ids)
    if len(centres) == 1:
        return F.lit(int(ids[0]))
    candidates = [
        F.struct(squared_distance(features, c).alias("d"), F.lit(int(i)).alias("id"))
        for i, c in zip(ids, centres)
    ]
    return F.least(*candidates).getField("id")


def centre_coordinate(cluster_id: str | Column, centres: Centres, dim: int,
                      ids: Sequence[int] | None = None) -> Column:
    """Coordinate ``dim`` of the centre with the given id.

    A lookup by position in a literal array, so ``cluster_id`` appears once in
    the expression tree (a ``CASE`` over K ids would copy a nearest-centre
    expression K times, K^2 distance terms in all).
    """
    cid = F.col(cluster_id) if isinstance(cluster_id, str) else cluster_id
    coords = F.array(*[F.lit(float(c[dim])) for c in centres])
    if ids is None or list(ids) == list(range(len(centres))):
        return F.get(coords, cid)
    id_array = F.array(*[F.lit(int(i)) for i in ids])
    return F.get(coords, F.array_position(id_array, cid).cast("int") - 1)
