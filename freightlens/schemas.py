"""Explicit schemas of the ERP base tables and control tables (FIXTURES.md).

Used to build hand-made test tables and to read external sources without
inference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

MONEY = DecimalType(15, 2)
WEIGHT = DecimalType(15, 3)


def _s(*fields: tuple[str, DataType]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


TBFIL = _s(("codfil", IntegerType()), ("nome", StringType()))
TBCLI = _s(("cgccpfcli", StringType()), ("nomefantasia", StringType()))
TBCID = _s(("codcid", IntegerType()), ("nome", StringType()), ("coduf", StringType()))
TBPRO = _s(("codpro", IntegerType()), ("nome", StringType()))
TBCTA = _s(("contareduz", IntegerType()), ("nomeconta", StringType()))
TBFOR = _s(("cgccpfforne", StringType()), ("nomefantasia", StringType()))
TBHIS = _s(("codtransacao", IntegerType()), ("descricao", StringType()))

FACTRC = _s(
    ("nrofatura", LongType()), ("anofatura", IntegerType()), ("cgccpffatura", StringType()),
    ("codfilfatur", IntegerType()), ("codciddes", IntegerType()), ("codcidpagto", IntegerType()),
    ("codpro", IntegerType()), ("dataemissao", DateType()), ("datavencto", DateType()),
    ("datarecbto", DateType()), ("vlrrecbto", MONEY), ("vlrsaldo", MONEY), ("contareduz", IntegerType()),
)

FRCTRC = _s(
    ("nroctrc", LongType()), ("ufctrc", StringType()), ("dataemissao", DateType()), ("situacao", StringType()),
    ("indctetpcte", IntegerType()), ("codfilemite", IntegerType()), ("cgccpfdestina", StringType()),
    ("codciddes", IntegerType()), ("codpro", IntegerType()), ("totalpeso", WEIGHT), ("vlrpedagio", MONEY),
    ("vlrcarreto", MONEY), ("vlrseguromerca", MONEY), ("vlrpis", MONEY), ("vlriapas", MONEY),
    ("vlricmsst", MONEY), ("vlricms", MONEY),
)

CPTIT = _s(
    ("nrocontrole", LongType()), ("anocontrole", IntegerType()), ("cgccpfforne", StringType()),
    ("codtransacao", IntegerType()), ("vlrtotal", MONEY), ("vlrsaldo", MONEY), ("datamovto", DateType()),
    ("datavencto", DateType()), ("contareduz", IntegerType()),
)

TBEMPRESAS = _s(
    ("codempresa", IntegerType()), ("nomeempresa", StringType()), ("cnpjcpf", StringType()),
    ("tipobdempresa", StringType()), ("portabd", StringType()), ("ipbd", StringType()),
    ("caminhobd", StringType()), ("ativa", StringType()),
)

TBUSUARIOS = _s(
    ("codusuario", IntegerType()), ("nomeusuario", StringType()), ("senhausuario", StringType()),
    ("codempresa", IntegerType()), ("usuarioativo", StringType()), ("cpfusuario", StringType()),
    ("emailusuario", StringType()),
)

AUDIT_IN = _s(
    ("id", LongType()), ("ts", TimestampNTZType()), ("usuario", StringType()), ("codempresa", StringType()),
    ("metodo", StringType()), ("endpoint", StringType()), ("params", StringType()),
    ("body_request", StringType()), ("body_response", StringType()), ("status_code", IntegerType()),
    ("user_agent", StringType()), ("ip_address", StringType()),
)

#: Raw request events as they arrive (input of the audit mapping and stream).
EVENTS_RAW = _s(
    ("event_id", LongType()), ("ts", TimestampNTZType()), ("user_id", LongType()), ("event_type", StringType()),
    ("value", DoubleType()), ("props", StringType()),
)

ERP_SCHEMAS = {
    "tbfil": TBFIL, "tbcli": TBCLI, "tbcid": TBCID, "tbpro": TBPRO, "tbcta": TBCTA, "tbfor": TBFOR,
    "tbhis": TBHIS, "factrc": FACTRC, "frctrc": FRCTRC, "cptit": CPTIT,
}


def frame(spark: SparkSession, name: str, rows: list[tuple | dict]) -> DataFrame:
    """A base table from Python rows with its fixed schema."""
    schema = ERP_SCHEMAS[name]
    if rows and isinstance(rows[0], dict):
        rows = [tuple(r.get(f.name) for f in schema.fields) for r in rows]
    return spark.createDataFrame(rows, schema)
