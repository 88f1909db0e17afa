"""SQL names for the engine's expressions and table functions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from lociflow.functions.expressions import BASES
from lociflow.operators.alignment import Scoring, align_read
from lociflow.sources import abif
from lociflow.sources.shipping import ship

#: Bodies over the parameter names; Catalyst inlines them, so they cost what the plain expressions cost.
SQL_FUNCTIONS = {
    "iupac_complement": ("b STRING", "STRING", "regexp_replace(translate(b, 'ACGTRYSWKMBDHV', 'TGCAYRSWMKVHDB'), '[^ACGTRYSWKMBDHVN]', 'N')"),
    "reverse_complement": ("b STRING", "STRING", "reverse(regexp_replace(translate(b, 'ACGTRYSWKMBDHV', 'TGCAYRSWMKVHDB'), '[^ACGTRYSWKMBDHVN]', 'N'))"),
    "profile_impurity": ("w ARRAY<DOUBLE>", "DOUBLE", "if(w IS NULL, NULL, 1 - aggregate(w, 0D, (a, x) -> a + x * x))"),
    "profile_max_impurity": ("w ARRAY<DOUBLE>", "DOUBLE", "1 - array_max(w)"),
    "profile_tv": ("l ARRAY<DOUBLE>, r ARRAY<DOUBLE>", "DOUBLE", "if(l IS NULL OR r IS NULL, NULL, aggregate(zip_with(l, r, (x, y) -> abs(x - y)), 0D, (a, x) -> a + x) / 2)"),
    "round_metric": ("v DOUBLE", "DOUBLE", "round(v * 1e6D) / 1e6D"),
}


def register(spark: SparkSession) -> None:
    ship(spark)
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")

    @F.udtf(returnType="entry int, tag string, number long, element_type int, element_size int, element_count long")
    class AbifDirectory:
        def eval(self, content: bytes) -> Iterator[tuple]:
            for i, e in enumerate(abif.directory(bytes(content))):
                yield i, e["tag"].decode("latin1"), int(e["number"]), int(e["type"]), int(e["size"]), int(e["count"])

    @F.udtf(returnType="read string, orientation string, col_idx int, query_base string, reference_base string, call_index int, ref_pos0 int")
    class AlignmentColumns:
        """Columns of each placed row of a table argument with read and query, and if it likes profiles and first_call, against a
        reference of bounded length. A read that can't be placed has none."""

        def eval(self, row: Row, reference: str, circular: bool) -> Iterator[tuple]:
            given = row.asDict()
            query = given["query"]
            if not query:
                return
            sharp = [[float(b == x) for x in BASES] if b in BASES else None for b in query]
            profiles = [None if p is None else list(p) for p in given["profiles"]] if given.get("profiles") else sharp
            placed = align_read(query, profiles, int(given.get("first_call") or 0), reference, circular, Scoring())
            for i, c in enumerate(placed[11] or ()):
                yield str(given["read"]), placed[0], i, c["query_base"], c["reference_base"], c["call_index"], c["ref_pos0"]

    spark.udtf.register("abif_directory", AbifDirectory)
    spark.udtf.register("alignment_columns", AlignmentColumns)
