"""Column layouts of the long facts and literal dimensions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketpulse.spec import Category, SegmentSpec

ENROLMENT = T.StructType(
    [
        T.StructField("segmento", T.StringType()),
        T.StructField("competencia", T.DateType()),
        T.StructField("registro", T.StringType()),
        T.StructField("operadora", T.StringType()),
        T.StructField("modalidade", T.StringType()),
        T.StructField("regiao", T.StringType()),
        T.StructField("beneficiarios", T.LongType()),
    ]
)

LEDGER = T.StructType(
    [
        T.StructField("segmento", T.StringType()),
        T.StructField("registro", T.StringType()),
        T.StructField("modalidade", T.StringType()),
        T.StructField("ano_tri", T.DateType()),
        T.StructField("class_conta", T.StringType()),
        T.StructField("saldo_cents", T.LongType()),
    ]
)

MEMBERS = T.StructType(
    [
        T.StructField("segmento", T.StringType()),
        T.StructField("registro", T.StringType()),
        T.StructField("associada", T.IntegerType()),
    ]
)


def dimension(
    spark: SparkSession,
    specs: Sequence[SegmentSpec],
    categories: Callable[[SegmentSpec], Sequence[Category]],
) -> DataFrame:
    """The categories of each segment as rows: segmento, chave, coluna, rotulo, ordem, codigo.

    A handful of literals from the spec, so it is always broadcast.
    """
    rows = [
        F.struct(
            F.lit(s.segmento).alias("segmento"),
            F.lit(c.key).alias("chave"),
            F.lit(c.column).alias("coluna"),
            F.lit(c.label).alias("rotulo"),
            F.lit(c.ordem).alias("ordem"),
            F.lit(c.codigo).cast("int").alias("codigo"),
        )
        for s in specs
        for c in categories(s)
    ]
    return F.broadcast(spark.range(0, 1, 1, 1).select(F.inline(F.array(*rows))))
