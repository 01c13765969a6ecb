"""Benchmark: run the headline reports at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line.

Each query is executed to completion with the ``noop`` sink (full execution,
nothing collected to the driver).  An untimed warm-up pass over the smallest
test data runs first (JVM JIT, code generation); nothing is cached between
passes, and the dimension size checks are part of the timed queries.

``value``/``queries``: the reports over the driver's tables through the
fixture mapping (what ``__spark_entry__.queries()`` runs).  ``staged``: the
same reports over a month-partitioned Parquet warehouse written by
``freightlens.sources.stage`` (``stage_sec`` is the one-off write), which is
the production layout.  Set BENCH_STAGED=0 to skip that part.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import uuid  # noqa: E402

from freightlens import catalog, plans  # noqa: E402
from freightlens.catalog import AS_OF, FILTERED  # noqa: E402
from freightlens.operators.filters import NO_FILTERS  # noqa: E402
from freightlens.session import build_session, ensure_checkpoint_dir  # noqa: E402
from freightlens.sources import ErpTables, stage  # noqa: E402

WARMUP_DIR = "/root/testdata/sf0.001"

HEADLINE = [
    "big_numbers",
    "kpi_mes_ano",
    "kpi_dia_mes_atual",
    "kpi_filial",
    "kpi_regiao",
    "kpi_cidade",
    "kpi_cliente",
    "kpi_produto",
    "tabela_faturamento",
    "filtro_filial",
    "filtro_cliente",
    "big_numbers_contas_receber",
    "recebimentos_dia_mes_atual",
    "a_receber_cliente",
    "tabela_a_receber",
    "filtro_fornecedor",
    "filtro_transacao",
    "big_numbers_contas_pagar",
    "contas_pagar_dia_mes_atual",
    "a_pagar_fornecedor",
    "tabela_a_pagar",
    "kpi_filial_filtered",
    "kpi_filial_all_tenants",
    "cpf_quality",
    "users_insert_new",
    "audit_normalised",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus), app_name="freightlens-bench")
    qs = catalog.all_queries()

    def run(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    if os.path.isdir(WARMUP_DIR) and WARMUP_DIR != sf_dir:
        for name in HEADLINE:
            run(qs[name](spark, WARMUP_DIR))

    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        run(qs[name](spark, sf_dir))
        times[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(times.values()), 3)
    out = {
        "metric": "report_suite_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "cpus": int(cpus),
    }

    if os.environ.get("BENCH_STAGED", "1") != "0":
        # a fresh folder under the shared checkpoint location (a URI on a cluster)
        root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/bench-warehouse-{uuid.uuid4().hex}"
        t0 = time.perf_counter()
        stage(ErpTables.from_fixture(spark, sf_dir), root)
        out["stage_sec"] = round(time.perf_counter() - t0, 3)
        w = ErpTables.from_parquet(spark, root)
        staged = {}
        for name, fn in plans.REPORTS.items():
            t0 = time.perf_counter()
            run(fn(w, NO_FILTERS, AS_OF))
            staged[name] = round(time.perf_counter() - t0, 3)
        t0 = time.perf_counter()
        run(plans.REPORTS["kpi_filial"](w, FILTERED["kpi_filial"], AS_OF))
        staged["kpi_filial_filtered"] = round(time.perf_counter() - t0, 3)
        out["staged"] = staged
        out["staged_total"] = round(sum(staged.values()), 3)

    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
