"""Feature rows from plain vectors: every image feature has a counterpart in a vector's components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixkin.functions.scores import dot, mean, total
from pixkin.functions.signatures import packed
from pixkin.functions.transform import let
from pixkin.operators.cells import usable


def median(values: Column) -> Column:
    return let(F.array_sort(values), lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2)


def vector_features(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", patch: int = 4, size: int = 64) -> DataFrame:
    """id, cls and the features: median, neighbour, mean and block-mean bits, energies of three bands,
    and blocks of `patch` components as unit vectors one after the other.  Bits are signatures.  A vector
    that is null, has null or non-finite components or not `size` of them has no row."""

    def of(x: Column) -> Column:
        above = lambda threshold: let(threshold, lambda t: packed(F.transform(x, lambda v: (v > t).cast("int"))))
        energy = lambda a, b: let(F.slice(x, a, b), lambda part: dot(part, part))
        energies = F.array(energy(1, size // 4), energy(size // 4 + 1, size // 4), energy(size // 2 + 1, size // 2))
        blocks = F.transform(F.sequence(F.lit(0), F.lit(size // patch - 1)), lambda i: F.slice(x, i * patch + 1, F.lit(patch)))
        repeated = lambda means: let(median(means), lambda t: F.flatten(F.transform(means, lambda m: F.array_repeat((m > t).cast("int"), patch))))
        unit = lambda b: let(F.sqrt(dot(b, b)), lambda n: F.transform(b, lambda v: v / n))
        middle = above(median(x))
        return F.struct(
            x.alias("cls"), middle.alias("phash"),
            packed(F.transform(x, lambda v, i: (F.get(x, F.pmod(i + 1, F.lit(size))) > v).cast("int"))).alias("dhash"),
            above(mean(x)).alias("ahash"), let(F.transform(blocks, mean), lambda means: packed(repeated(means))).alias("whash"),
            let(energies, lambda e: let(total(e) + 1e-9, lambda n: F.transform(e, lambda y: y / n))).alias("dct_bands"),
            middle.alias("grid"), F.flatten(F.transform(blocks, unit)).alias("patches"),
        )

    label = [c for c in ("label",) if c in rows.columns]
    df = rows.filter(usable(vector, size)).select(F.col(id_column).alias("id"), *label, let(F.transform(vector, lambda v: v.cast("double")), of).alias("own"))
    return df.select("id", *label, "own.*")
