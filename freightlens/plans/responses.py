"""The reference's response shapes for each report (R1-R6), built from the
flat report DataFrames.

* ``nested``: ``{ano: {mes_numero: {...}}}`` (Q2);
* ``map``: ``{code: {...}}`` keyed by the report's code, one entry per code
  as the reference's dict keeps it (K14: rows sorted by the measure DESC,
  later ones overwrite -> the smallest measure survives, at the place where
  the code first came, so entries are in order of each code's largest measure);
* ``rows``: the row list (tables and KPI records).

Map shapes are delivered entry by entry, a row each, so they have no size limit;
``posicao`` (1, 2, 3...) is an entry's place in the map, from a range sort;
``response_json`` gives the text of each without collecting rows on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_place
from ..operators.shaping import collapse_last_wins, default_keys, entries_json, to_entries, to_json_rows

# report -> (shape, key, value columns, measure deciding "last wins", label)
SHAPES = {
    "big_numbers": ("rows", None, None, None, None),
    "kpi_mes_ano": ("nested", ("ano", "mes_numero"), ["mes", "volume", "embarques", "faturamento"], None, None),
    "kpi_dia_mes_atual": ("map", "dia", ["volume", "embarques", "faturamento"], None, None),
    "kpi_filial": ("map", "codfilial", ["filial", "volume", "embarques", "faturamento"], "faturamento", "filial"),
    "kpi_regiao": ("map", "regiao", ["volume", "embarques", "faturamento"], "faturamento", None),
    "kpi_cidade": ("map", "codcid", ["cidade", "volume", "embarques", "faturamento"], "faturamento", "cidade"),
    "kpi_cliente": ("map", "codcliente", ["cliente", "faturamento"], "faturamento", "cliente"),
    "kpi_produto": ("map", "codpro", ["produto", "faturamento"], "faturamento", "produto"),
    "tabela_faturamento": ("rows", None, None, None, None),
    "big_numbers_contas_receber": ("rows", None, None, None, None),
    "recebimentos_dia_mes_atual": ("map", "dia", ["faturamento", "a_receber"], None, None),
    "a_receber_cliente": ("map", "codcliente", ["cliente", "a_receber"], "a_receber", "cliente"),
    "tabela_a_receber": ("rows", None, None, None, None),
    "big_numbers_contas_pagar": ("rows", None, None, None, None),
    "contas_pagar_dia_mes_atual": ("map", "dia", ["pago", "a_pagar"], None, None),
    "a_pagar_fornecedor": ("map", "codfornecedor", ["fornecedor", "a_pagar"], "a_pagar", "fornecedor"),
    "tabela_a_pagar": ("rows", None, None, None, None),
}

#: Map keys cannot be NULL in Spark; a NULL code is rendered as the JSON
#: encoder renders a ``None`` dict key.
NULL_KEY = "null"


def response(name: str, df: DataFrame) -> DataFrame:
    """The report ``name``'s flat rows in the reference's response shape:
    a row per map entry (``posicao``, ``chave``, ``subchave``, ``valor``) for map
    shapes, the rows unchanged otherwise."""
    shape, key, values, measure, label = SHAPES[name]
    if shape == "rows":
        return df
    keys = [key] if isinstance(key, str) else list(key)
    if shape == "nested" or key == "dia":
        order = [F.asc_nulls_first(f"__{k}") for k in keys]
        shaped = default_keys(df.withColumns({f"__{k}": F.col(k) for k in keys}), keys, ["mes"] if shape == "nested" else [])
    else:
        shaped = df.withColumn(key, F.coalesce(F.col(key).cast("string"), F.lit(NULL_KEY)))
        order = [F.desc_nulls_last("__first"), F.asc(key)]
        # a code's place is that of its first row, its value that of its last
        first = F.max(measure).alias("__first")
        shaped = collapse_last_wins(shaped, key, measure, label, first)
    placed = with_place(shaped, order, "posicao").withColumn("posicao", F.col("posicao") + 1)
    return to_entries(placed, keys, values, "posicao")


def response_json(name: str, df: DataFrame) -> DataFrame:
    """Delivery text: one JSON object per map entry (with its ``posicao``) or per row."""
    shaped = response(name, df)
    if SHAPES[name][0] == "rows":
        return to_json_rows(shaped)
    return entries_json(shaped)
