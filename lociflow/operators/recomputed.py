"""Documents against what follows from their own observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociflow.operators import samples as S

#: Counts of a locus that a document states.
TOPOLOGY = ("reads", "forward_reads", "reverse_reads", "reference_reads", "alternate_reads", "deletion_reads", "unresolved_reads", "alternate_forward", "alternate_reverse")


def _fields(rows: DataFrame, names: tuple[str, ...], value: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).cast("long").alias(value)) for n in names])
    return rows.select("sample", "position", F.explode(pairs).alias("x")).select("sample", "position", "x.*")


def document_differences(documents: DataFrame) -> DataFrame:
    """(sample, path, stored, recomputed): what a document (sample, loci: array of position, topology, observations of read, base,
    reference, forward) states of a locus and its observations do not give, a row a field. A locus without observations has
    counts of nothing to compare with: `recomputed` is null."""
    loci = documents.select("sample", F.explode("loci").alias("l")).select("sample", "l.*")
    stored = _fields(loci.select("sample", "position", "topology.*"), TOPOLOGY, "stored")
    seen = loci.select("sample", "position", F.explode("observations").alias("o")).select("sample", "position", "o.*")
    again = _fields(S.locus_topology(S.with_state(seen), ["sample", "position"]), TOPOLOGY, "recomputed")
    both = stored.join(again, ["sample", "position", "field"], "full_outer").where(~F.col("stored").eqNullSafe(F.col("recomputed")))
    return both.select("sample", F.concat(F.lit("loci["), F.col("position").cast("string"), F.lit("].topology."), F.col("field")).alias("path"), "stored", "recomputed")
