"""Dimension lists for the report filter pickers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.erp import ErpTables


def _pair(t: ErpTables, table: str, code: str, label: str, out_code: str, out_label: str) -> DataFrame:
    return t.table(table).select(
        *t.tenant_cols,
        F.col(code).cast("string").alias(out_code),
        F.col(label).cast("string").alias(out_label),
    )


def filtro_filial(t: ErpTables) -> DataFrame:
    """Q10: branches."""
    return _pair(t, "tbfil", "codfil", "nome", "codfilial", "filial")


def filtro_cliente(t: ErpTables) -> DataFrame:
    """Q11: customers."""
    return _pair(t, "tbcli", "cgccpfcli", "nomefantasia", "codcliente", "cliente")


def filtro_fornecedor(t: ErpTables) -> DataFrame:
    """Q16: suppliers."""
    return _pair(t, "tbfor", "cgccpfforne", "nomefantasia", "codfornecedor", "fornecedor")


def filtro_transacao(t: ErpTables) -> DataFrame:
    """Q17: transaction types."""
    return _pair(t, "tbhis", "codtransacao", "descricao", "codtransacao", "transacao")
