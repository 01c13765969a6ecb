"""Run one report from the command line.

    python -m freightlens kpi_filial --data /root/testdata/sf0.01 \
        --inicio 2000-05-01 --fim 2000-06-15 --codfilial 1,2 --as-of "2000-06-15 12:00:00" \
        --out /shared/out/kpi_filial          # JSON lines in the reference's response shape
    python -m freightlens tabela_a_pagar --warehouse /shared/erp --show 20

``--data`` reads the driver's test tables through the fixture mapping;
``--warehouse`` reads a folder written by ``freightlens.sources.stage``.
Output is written by the executors (``--out``); ``--show`` prints a preview.
"""

from __future__ import annotations

import argparse
import datetime as dt

from . import ErpTables, ReportFilters, plans
from .operators.shaping import to_json_rows
from .session import apply_report_conf, build_session

INT_FILTERS = ("codfilial", "codcid", "codpro", "ano", "mes", "dia", "codtransacao")
TEXT_FILTERS = ("codcliente", "regiao", "codfornecedor")


def _values(text: str | None, cast):
    if text is None:
        return None
    return [cast(v) for v in text.split(",") if v != ""]


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="freightlens")
    p.add_argument("report", choices=sorted(plans.REPORTS) + sorted(plans.LISTS))
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--data", help="folder with the driver's test tables (fixture mapping)")
    src.add_argument("--warehouse", help="folder written by freightlens.sources.stage")
    p.add_argument("--inicio", type=dt.date.fromisoformat)
    p.add_argument("--fim", type=dt.date.fromisoformat)
    p.add_argument("--as-of", dest="as_of", type=dt.datetime.fromisoformat)
    for name in INT_FILTERS + TEXT_FILTERS:
        p.add_argument(f"--{name}")
    p.add_argument("--out", help="write the response as JSON lines to this folder")
    p.add_argument("--show", type=int, default=0, help="print the first N rows")
    p.add_argument("--master", default=None, help="local master for a standalone run, e.g. local[8]")
    a = p.parse_args(argv)

    # no --master: keep the launcher's (spark-submit) master and cluster sizing
    spark = build_session(a.master, shuffle_partitions=8 if a.master else None)
    apply_report_conf(spark)
    t = ErpTables.from_fixture(spark, a.data) if a.data else ErpTables.from_parquet(spark, a.warehouse)
    if a.report in plans.LISTS:
        df = plans.LISTS[a.report](t)
        out = to_json_rows(df)
    else:
        f = ReportFilters(
            data_inicio=a.inicio,
            data_fim=a.fim,
            **{n: _values(getattr(a, n), int) for n in INT_FILTERS},
            **{n: _values(getattr(a, n), str) for n in TEXT_FILTERS},
        )
        df = plans.REPORTS[a.report](t, f, a.as_of)
        out = plans.response_json(a.report, df)
    if a.out:
        if "posicao" in out.columns:  # map entries: lines in the map's order
            out = out.orderBy("posicao").select("json")
        out.write.mode("overwrite").text(a.out)
    if a.show:
        df.show(a.show, truncate=False)


if __name__ == "__main__":
    main()
