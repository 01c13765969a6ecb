"""The ERP table bundle every view and report reads.

``ErpTables`` hides where the business tables come from:

* ``from_fixture``  - derived lazily from the driver's TPC-H-style Parquet;
* ``from_parquet``  - a warehouse folder with one Parquet table per name
  (facts partitioned by month, see :func:`stage`);
* ``from_tables``   - bucketed tables of the session's catalog;
* ``from_jdbc``     - the tenant's database via Spark's JDBC reader.

Dimension lookups go through :meth:`ErpTables.lookup_side`, which leaves the
join to Spark: its broadcast threshold, AQE's runtime broadcast when a side is
measured small, else sort-merge join (AQE splits skewed partitions).
``broadcast_policy`` hints dimensions that are bounded by their domain (branches,
accounts).  A warehouse of bucketed tables (:func:`stage_bucketed`) joins large
customer and supplier tables without shuffling the fact.
"""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass, field
from typing import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import fixtures as fx
from . import snapshots
from .jdbc import jdbc_reader

DIMENSIONS = ("tbfil", "tbcli", "tbcid", "tbpro", "tbcta", "tbfor", "tbhis")
FACTS = ("factrc", "frctrc", "cptit")

#: Main date of each fact: the partition column of a staged table.
FACT_MAIN_DATE = {"factrc": "datarecbto", "frctrc": "dataemissao", "cptit": "datavencto"}
#: Partition column of staged facts: month of the main date as yyyymm.
PARTITION_COL = "particao_mes"
#: Month of the title's other date, so that a period on either date skips months.
#: The two dates of a title lie a few months apart, so months are only cut in a few parts.
OTHER_COL = "particao_mes_outra"
#: fact -> date column -> its month's partition column in the staged layout
MONTH_PARTITIONS = {
    "factrc": {"datarecbto": PARTITION_COL, "datavencto": OTHER_COL},
    "frctrc": {"dataemissao": PARTITION_COL},
    "cptit": {"datavencto": PARTITION_COL, "datamovto": OTHER_COL},
}
#: Open-balance partition flag of staged receivables/payables: the balance is
#: not zero (or unknown), i.e. the title can still be open or overdue.
OPEN_COL = "tem_saldo"
OPEN_FACTS = ("factrc", "cptit")
#: Key of a pruning hint meaning "or any title with an open balance".
OPEN_BALANCE = "__open_balance__"
#: Unique document key of each fact.
FACT_KEY = {"factrc": "nrofatura", "frctrc": "nroctrc", "cptit": "nrocontrole"}
#: Sort column inside each staged file (tightens row-group statistics).
FACT_SORT_COL = {"factrc": "datavencto", "frctrc": "codfilemite", "cptit": "datamovto"}

#: Folder of a warehouse with its published fingerprints, a table per fact.
FINGERPRINTS = "_impressoes"

Loader = Callable[[str, frozenset | None], DataFrame]

#: fact -> (its key, dimension, the dimension's key): lookups of dimensions that grow
LARGE_LOOKUPS = {
    "factrc": ("cgccpffatura", "tbcli", "cgccpfcli"),
    "frctrc": ("cgccpfdestina", "tbcli", "cgccpfcli"),
    "cptit": ("cgccpfforne", "tbfor", "cgccpfforne"),
}
#: Slice of a fact's rows: bucketed tables spread a hot customer over the slices.
SLICE_COL = "fatia"


@dataclass
class ErpTables:
    spark: SparkSession
    loader: Loader
    tenant_cols: tuple[str, ...] = ()
    #: table -> date column -> the Parquet partition column that holds its month
    #: (yyyymm INT, staged warehouse); empty for other sources.
    month_partitions: dict = field(default_factory=dict)
    #: facts with the open-balance partition flag ``tem_saldo`` (staged warehouse)
    open_partitions: frozenset = frozenset()
    #: dimensions that their domain bounds -> True: hinted for broadcast; the
    #: others are left to Spark.
    broadcast_policy: dict = field(default_factory=dict)
    #: the source has sliced copies of the large dimensions (bucketed tables)
    sliced: bool = False
    _sides: dict = field(default_factory=dict, repr=False)
    _tables: dict = field(default_factory=dict, repr=False)

    # ------------------------------------------------------------------ access
    def table(self, name: str, need: Iterable[str] | None = None) -> DataFrame:
        """A base table.  ``need`` lets a source skip work for unused columns
        (the fixture skips the order join behind freight's customer).

        DataFrames are memoised per bundle, so file listing and schema reads
        happen once per bundle, not once per report; build a new bundle (or
        call :meth:`refresh`) to see files written since."""
        key = (name, frozenset(need) if need is not None else None)
        df = self._tables.get(key)
        if df is None:
            df = self.loader(name, key[1])
            self._tables[key] = df
        return df

    def refresh(self) -> None:
        """Forget memoised tables, lookup sides and size checks."""
        self._tables.clear()
        self._sides.clear()

    def lookup_side(self, name: str) -> DataFrame:
        """Dimension ready for a fact->dim join.  The same DataFrame is
        returned on every call, so lookups of one dimension in several union
        arms share one plan subtree and Spark reuses its broadcast."""
        side = self._sides.get(name)
        if side is None:
            df = self.table(name)
            side = self._sides[name] = F.broadcast(df) if self.broadcast_policy.get(name) else df
        return side

    def large_side(self, name: str, fact: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
        """A dimension that grows, and further columns to match: over bucketed
        tables its copy per slice, in which ``fact`` finds its row in place.

        Over several tenants the files don't tell its size (a row may stand for each
        tenant, and Spark's estimate doesn't see that), so it isn't left to the broadcast
        threshold but joined by sort-merge, unless ``broadcast_policy`` says otherwise."""
        if self.sliced and SLICE_COL in fact.columns:
            return self.lookup_side(f"{name}_{SLICE_COL}"), (SLICE_COL,)
        side = self.lookup_side(name)
        return (side.hint("merge") if self.tenant_cols and not self.broadcast_policy.get(name) else side), ()

    def prune(self, name: str, df: DataFrame, ranges: dict | None) -> DataFrame:
        """Partition pruning hint.

        ``ranges`` describes the rows the caller will keep anyway, as
        alternatives: date column -> list of ``(start, end)`` date ranges
        (``end`` None = open), and optionally ``OPEN_BALANCE: True`` for
        "or any title whose balance is not zero".  When every alternative
        maps to a partition column of ``name`` (the months of its dates,
        the open-balance flag) the same alternatives become a partition
        predicate, so settled history and other months are skipped.
        Otherwise nothing is added: the hint never changes results.
        """
        if not ranges:
            return df
        months = {k: v for k, v in self.month_partitions.get(name, {}).items() if v in df.columns}
        cond = None
        for key, value in ranges.items():
            if key == OPEN_BALANCE:
                if not value:
                    continue
                if name not in self.open_partitions or OPEN_COL not in df.columns:
                    return df
                c = F.col(OPEN_COL) == 1
            elif key in months:
                pm = F.col(months[key])
                c = None
                for start, end in value:
                    r = pm >= F.lit(start.year * 100 + start.month)
                    if end is not None:
                        r = r & (pm <= F.lit(end.year * 100 + end.month))
                    c = r if c is None else (c | r)
            else:
                return df
            cond = c if cond is None else (cond | c)
        return df if cond is None else df.filter(cond)

    def for_tenant(self, code) -> "ErpTables":
        """One tenant's view of a multi-tenant bundle (the reference's
        per-request company).  Every table is filtered on the tenant column,
        which prunes the tenant partition of a staged warehouse, and the
        column is dropped, so reports run with single-tenant semantics."""
        if not self.tenant_cols:
            return self
        col = self.tenant_cols[0]
        parent = self

        def load(name: str, need: frozenset | None) -> DataFrame:
            return parent.table(name, need).filter(F.col(col) == F.lit(code)).drop(col)

        return ErpTables(
            self.spark, load, (),
            month_partitions=dict(self.month_partitions),
            open_partitions=self.open_partitions,
            broadcast_policy=dict(self.broadcast_policy),
            sliced=self.sliced,
        )

    @property
    def multi_tenant(self) -> bool:
        return bool(self.tenant_cols)

    # ------------------------------------------------------------ constructors
    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str, multi_tenant: bool = False, **kw) -> "ErpTables":
        def load(name: str, need: frozenset | None) -> DataFrame:
            if name == "frctrc":
                with_cust = need is None or "cgccpfdestina" in need
                df = fx.frctrc(spark, sf_dir, with_customer=with_cust)
            elif name in fx.FACT_BUILDERS:
                df = fx.FACT_BUILDERS[name](spark, sf_dir)
            elif name in fx.DIM_BUILDERS:
                df = fx.DIM_BUILDERS[name](spark, sf_dir)
                df = _settled(df, name) if name in fx.DERIVED_DIMS else df
            else:
                raise KeyError(name)
            return fx.add_fixture_tenant(name, df) if multi_tenant else df

        return cls(spark, load, ("codempresa",) if multi_tenant else (), **kw)

    @classmethod
    def from_frames(cls, spark: SparkSession, frames: dict[str, DataFrame], tenant_cols: tuple[str, ...] = (), **kw) -> "ErpTables":
        """A bundle over DataFrames already in hand (tests, notebooks)."""

        def load(name: str, need: frozenset | None) -> DataFrame:
            return frames[name]

        return cls(spark, load, tenant_cols, **kw)

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str, tenant_cols: tuple[str, ...] = (), **kw) -> "ErpTables":
        """A warehouse written by :func:`stage` (facts month-partitioned)."""
        root = root.rstrip("/")

        def load(name: str, need: frozenset | None) -> DataFrame:
            return spark.read.parquet(f"{root}/{name}")

        kw.setdefault("month_partitions", MONTH_PARTITIONS)
        kw.setdefault("open_partitions", frozenset(OPEN_FACTS))
        return cls(spark, load, tenant_cols, **kw)

    @classmethod
    def from_tables(cls, spark: SparkSession, database: str, tenant_cols: tuple[str, ...] = (), **kw) -> "ErpTables":
        """Bucketed tables written by :func:`stage_bucketed`."""

        def load(name: str, need: frozenset | None) -> DataFrame:
            return spark.table(f"{database}.{name}")

        kw.setdefault("month_partitions", {k: {FACT_MAIN_DATE[k]: PARTITION_COL} for k in FACTS})
        return cls(spark, load, tenant_cols, sliced=True, **kw)

    @classmethod
    def from_tenant_sources(
        cls, spark: SparkSession, tenants: list[tuple[int, "ErpTables"]], tenant_col: str = "codempresa", **kw
    ) -> "ErpTables":
        """N9 over one database per tenant: every table is the UNION ALL of the
        tenants' tables with the tenant code added, and every join and group
        then includes it.  The plan has an arm per tenant; with many of them,
        stage each into one warehouse (``stage(..., tenant=code)``), which is one
        scan.  ``tenants`` is configuration (built from
        :func:`..jdbc.tenant_sources`), not data, so it is a short driver list."""

        def load(name: str, need: frozenset | None) -> DataFrame:
            # partition columns that all sources have are kept: hints then prune each arm
            tables = [(code, src.table(name, need)) for code, src in tenants]
            drop = [c for c in (PARTITION_COL, OTHER_COL, OPEN_COL) if any(c not in df.columns for _, df in tables)]
            parts = [df.drop(*drop).withColumn(tenant_col, F.lit(code)) for code, df in tables]
            out = parts[0]
            for p in parts[1:]:
                # a source may omit columns its caller did not ask for (``need``)
                out = out.unionByName(p, allowMissingColumns=True)
            return out

        kw.setdefault("month_partitions", MONTH_PARTITIONS)
        kw.setdefault("open_partitions", frozenset(OPEN_FACTS))
        return cls(spark, load, (tenant_col,), **kw)

    @classmethod
    def from_jdbc(
        cls,
        spark: SparkSession,
        url: str,
        properties: dict[str, str],
        partitioning: dict[str, dict] | None = None,
        **kw,
    ) -> "ErpTables":
        """Read each table with Spark's JDBC source.  ``partitioning`` maps a
        table to ``partitionColumn/lowerBound/upperBound/numPartitions`` so big
        facts are read by many tasks in parallel."""
        partitioning = partitioning or {}

        def load(name: str, need: frozenset | None) -> DataFrame:
            return jdbc_reader(spark, url, name, properties, partitioning.get(name)).load()

        return cls(spark, load, (), **kw)


def _settled(df: DataFrame, name: str) -> DataFrame:
    """A dimension that is computed, written to the shared folder and read back, so that
    Spark plans its lookups by its size and not by that of the table it is computed from
    (which shuffles the fact on a key of a few values)."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _write_fact(tables: ErpTables, name: str, df: DataFrame, path: str, mode: str, max_records_per_file: int) -> None:
    """Write one fact in the warehouse layout: partitioned by tenant, months of
    its dates and (receivables/payables) the open-balance flag;
    range-partitioned on (tenant, main date, key) so tasks are balanced and
    each writes few partitions; sorted by date inside files."""
    main = FACT_MAIN_DATE[name]
    parts = _partition_cols(tables, name)
    (
        df.withColumns(parts)
        .repartitionByRange(*tables.tenant_cols, main, FACT_KEY[name])
        .sortWithinPartitions(*tables.tenant_cols, main, FACT_SORT_COL[name])
        .write.mode(mode)
        .option("maxRecordsPerFile", max_records_per_file)
        .partitionBy(*parts)
        .parquet(path)
    )


def _partition_cols(tables: ErpTables, name: str) -> dict:
    """Partition column -> its expression over a source row."""
    out = {c: F.col(c) for c in tables.tenant_cols}
    for date, col in MONTH_PARTITIONS[name].items():
        out[col] = F.year(date) * 100 + F.month(date)
    if name in OPEN_FACTS:
        # 1/0 rather than a boolean: partition discovery reads integers back as INT
        out[OPEN_COL] = F.when(F.coalesce(F.col("vlrsaldo") != 0, F.lit(True)), 1).otherwise(0)
    return out


def _fingerprints(df: DataFrame, parts: dict, cols: list[str]) -> DataFrame:
    """Rows and a sum of row hashes per partition: a pre-aggregated group-by.
    xxhash64 skips nulls, so each column goes with its null flag."""
    row = F.xxhash64(*[x for c in cols for x in (F.col(c), F.col(c).isNull())]).cast("decimal(38,0)")
    return df.groupBy(*[e.cast("int").alias(c) for c, e in parts.items()]).agg(F.count(F.lit(1)).alias("n"), F.sum(row).alias("h"))


def _in_months(tables: ErpTables, name: str, months: list[int]) -> DataFrame:
    """A source fact's rows whose main date lies in ``months`` (yyyymm); the dates
    are pushed to the source, so other months aren't read."""
    main = FACT_MAIN_DATE[name]
    spans = [(dt.date(m // 100, m % 100, 1), dt.date(m // 100 + (m % 100 == 12), m % 100 % 12 + 1, 1)) for m in months]
    rows = tables.prune(name, tables.table(name), {main: [(a, b - dt.timedelta(days=1)) for a, b in spans]})
    wanted = F.lit(False)
    for a, b in spans:
        wanted = wanted | ((F.col(main) >= F.lit(a)) & (F.col(main) < F.lit(b)))
    return rows.filter(wanted)


def _stored_fingerprints(tables: ErpTables, root: str, name: str) -> DataFrame:
    """The warehouse's fingerprints as the last refresh published them; from the
    warehouse itself before the first one."""
    spark, parts = tables.spark, _partition_cols(tables, name)
    if snapshots.current(spark, f"{root}/{FINGERPRINTS}/{name}"):
        return snapshots.read(spark, f"{root}/{FINGERPRINTS}/{name}")
    cols = [c for c in tables.table(name).columns if c not in parts]
    return _fingerprints(spark.read.parquet(f"{root}/{name}"), {c: F.col(c) for c in parts}, cols)


def changed_partitions(tables: ErpTables, root: str, name: str, only: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(changed, fingerprints).  ``changed`` has ``__<partition column>`` and
    ``__keep`` (false: to remove) of the partitions of a staged fact that differ
    from the source, as a document moves between months and open-balance flags
    when it is paid.  ``fingerprints`` are the warehouse's once these are
    rewritten.  With ``only``, the source is read for these months alone, and
    partitions of others stay as they are."""
    parts = _partition_cols(tables, name)
    src = tables.table(name) if only is None else _in_months(tables, name, only)
    cols = [c for c in src.columns if c not in parts]
    stored = _stored_fingerprints(tables, root, name)
    here = F.lit(True) if only is None else F.coalesce(F.col(PARTITION_COL).isin(list(only)), F.lit(False))
    fresh = _fingerprints(src, parts, cols)
    new, old = fresh.alias("new"), stored.filter(here).alias("old")
    same = [F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in parts]
    differs = ~(F.col("new.n").eqNullSafe(F.col("old.n")) & F.col("new.h").eqNullSafe(F.col("old.h")))
    # a partition column may be null on a side that is there
    there = F.col("new.n").isNotNull()
    changed = new.join(old, same, "full").where(differs).select(
        *[F.when(there, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(f"__{c}") for c in parts], there.alias("__keep"))
    return changed, fresh.unionByName(stored.filter(~here))


def refresh_months(
    tables: ErpTables, root: str, months: list[int] = (), max_records_per_file: int = 5_000_000, only: bool = False,
) -> None:
    """Incremental upkeep of a staged warehouse: rewrite the partitions of every
    fact that differ from the source (dynamic partition overwrite), and those of
    ``months`` (yyyymm) in any case; remove partitions that have become empty;
    rewrite the dimensions.  A document that was paid or re-dated leaves its old
    partition, since that one differs too.

    What the warehouse holds is known from fingerprints that each refresh
    publishes (the first one takes them from the warehouse), so the warehouse is
    not scanned.  With ``only``, the source is read for ``months`` alone: then the
    caller names every month whose documents changed, a re-dated document's old
    month too (a run without ``only`` finds what was left out).

    Between the overwrite of a document's new partition and the removal of its
    old, emptied one a reader can see it twice; a job that stops there is healed
    by the next run, since fingerprints are published last."""
    root = root.rstrip("/")
    spark = tables.spark
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode", "static")
    for name in DIMENSIONS:
        dim = tables.table(name).write.mode("overwrite")
        (dim.partitionBy(*tables.tenant_cols) if tables.tenant_cols else dim).parquet(f"{root}/{name}")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for name in FACTS:
            parts = _partition_cols(tables, name)
            # written first: the warehouse that it may be read from changes below
            path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/changed-{name}-{uuid.uuid4().hex}"
            changed, prints = changed_partitions(tables, root, name, list(months) if only else None)
            prints.write.parquet(f"{path}/fingerprints")
            changed.write.parquet(f"{path}/changed")
            changed = spark.read.parquet(f"{path}/changed")
            some = changed.where("__keep").withColumnRenamed("__keep", "__hit")
            here = [e.cast("int").eqNullSafe(F.col(f"__{c}")) for c, e in parts.items()]
            source = _in_months(tables, name, list(months)) if only else tables.table(name)
            rows = source.join(some, here, "left")
            wanted = F.col("__hit").isNotNull()
            if months:
                wanted = wanted | F.coalesce(parts[PARTITION_COL].isin(list(months)), F.lit(False))
            if months or not some.isEmpty():
                _write_fact(tables, name, rows.filter(wanted).select(*tables.table(name).columns), f"{root}/{name}", "overwrite", max_records_per_file)
            # folders are removed one by one, without the list in memory
            _remove_partitions(spark, f"{root}/{name}", list(parts), changed.where("not __keep").drop("__keep").toLocalIterator())
            snapshots.publish(spark.read.parquet(f"{path}/fingerprints"), f"{root}/{FINGERPRINTS}/{name}")
            done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(done, True)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def _remove_partitions(spark: SparkSession, path: str, cols: list[str], partitions: Iterable) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in partitions:
        folder = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else v}" for c, v in zip(cols, p))
        gone = jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        gone.getFileSystem(conf).delete(gone, True)


def stage(
    tables: ErpTables, root: str, mode: str = "overwrite", max_records_per_file: int = 5_000_000,
    tenant: int | None = None, tenant_col: str = "codempresa",
) -> None:
    """Write the bundle as a Parquet warehouse.

    With ``tenant``, a single-tenant bundle goes into a warehouse that tenants
    share, under its own partition of every table; other tenants' data isn't
    touched.  ``from_parquet(spark, root, (tenant_col,))`` then reads all tenants
    by partition discovery: one scan per table, however many tenants there are.

    Facts are partitioned by tenant (multi-tenant bundles), by the month of
    their main date (``particao_mes``, yyyymm INT) and, for receivables and
    payables, by the month of their other date (``particao_mes_outra``) and the open-balance flag (``tem_saldo``); reports pass their
    periods / open-balance needs as pruning hints
    (:meth:`ErpTables.prune`), so whole months are skipped.  Before writing,
    facts are range-partitioned on (main date, document key): tasks get
    balanced ranges, each task writes only the few months its range covers
    (no tasks x months small files), and a hot month or day is split across
    several tasks because the key breaks ties.  Inside each file rows are
    sorted by date, so row-group statistics prune within a month.
    """
    root = root.rstrip("/")
    if tenant is not None and tables.tenant_cols:
        raise ValueError("the bundle has a tenant column already")
    under = "" if tenant is None else f"/{tenant_col}={int(tenant)}"
    for name in DIMENSIONS:
        dim = tables.table(name).write.mode(mode)
        if tables.tenant_cols:
            dim = dim.partitionBy(*tables.tenant_cols)
        dim.parquet(f"{root}/{name}{under}")
    # what earlier refreshes knew of the warehouse holds no longer
    spark = tables.spark
    known = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{FINGERPRINTS}")
    known.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(known, True)
    for name in FACTS:
        _write_fact(tables, name, tables.table(name), f"{root}/{name}{under}", mode, max_records_per_file)


def stage_bucketed(tables: ErpTables, database: str, root: str, buckets: int = 64, slices: int = 8) -> None:
    """Write the bundle as bucketed tables of the catalog, for customer and
    supplier tables too large to broadcast.

    A fact and the copy of its dimension are bucketed alike by (tenant, key,
    slice), so their join reads bucket by bucket and moves neither side.  A row's
    slice is a hash of its document, so a customer with a third of all rows lies
    in up to ``slices`` buckets; the dimension has a copy per slice
    (``<dimension>_fatia``).  Facts are partitioned by tenant and the month of their
    main date; each writing task holds one bucket, so there are months x buckets
    files.  The tables' files lie under ``root``.
    """
    spark, tc = tables.spark, tables.tenant_cols

    def write(df: DataFrame, name: str, by: list[str], parts: list[str]) -> None:
        out = df.repartition(buckets, *by).write.mode("overwrite").bucketBy(buckets, *by).sortBy(*by)
        out = out.partitionBy(*parts) if parts else out
        out.option("path", f"{root.rstrip('/')}/{name}").saveAsTable(f"{database}.{name}")

    for name in DIMENSIONS:
        tables.table(name).write.mode("overwrite").option("path", f"{root.rstrip('/')}/{name}").saveAsTable(f"{database}.{name}")
    for name, key in sorted({(d, k) for _, d, k in LARGE_LOOKUPS.values()}):
        copies = tables.table(name).withColumn(SLICE_COL, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        write(copies, f"{name}_{SLICE_COL}", [*tc, key, SLICE_COL], [])
    for name in FACTS:
        main, key = FACT_MAIN_DATE[name], LARGE_LOOKUPS[name][0]
        fact = tables.table(name).withColumn(PARTITION_COL, F.year(main) * 100 + F.month(main)).withColumn(
            SLICE_COL, F.pmod(F.xxhash64(FACT_KEY[name]), F.lit(slices)).cast("int"))
        write(fact, name, [*tc, key, SLICE_COL], [PARTITION_COL])
