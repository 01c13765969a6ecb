"""Test-table mapping: the ERP and control tables derived from the driver's
TPC-H-style Parquet (FIXTURES.md).  Every table is a lazy DataFrame over the
given files, so the work grows with them.

Money is cast DOUBLE -> DECIMAL before any arithmetic so that Spark and the
DuckDB oracle agree exactly.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Two-letter state codes by nation key (0 to 24).  "EX" is not a
# state and exercises 'Outros'.
UF_BY_NATION = ["SP", "RJ", "MG", "ES", "PR", "SC", "RS", "MS", "MT", "GO", "DF", "RO", "AC",
                "AM", "RR", "PA", "TO", "AP", "MA", "PI", "CE", "RN", "PB", "PE", "EX"]

#: Tenants used for the multi-tenant layout.
FIXTURE_TENANTS = (0, 1, 2)

BACKSLASH = chr(92)


def _raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lpad14(c: Column) -> Column:
    return F.lpad(c.cast("string"), 14, "0")


def _dec2(c: Column) -> Column:
    return c.cast("decimal(15,2)")


def _day(c: Column) -> Column:
    return c.cast("date")


# --------------------------------------------------------------------------- dims
def tbfil(spark, sf_dir) -> DataFrame:
    n = _raw(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").cast("int").alias("codfil"), F.col("n_name").alias("nome"))


def tbcli(spark, sf_dir) -> DataFrame:
    c = _raw(spark, sf_dir, "customer")
    return c.select(lpad14(F.col("c_custkey")).alias("cgccpfcli"), F.col("c_name").alias("nomefantasia"))


def tbcid(spark, sf_dir) -> DataFrame:
    s = _raw(spark, sf_dir, "supplier")
    uf = F.element_at(F.array(*map(F.lit, UF_BY_NATION)), F.col("s_nationkey").cast("int") + 1)
    return s.select(
        F.col("s_suppkey").cast("int").alias("codcid"),
        F.col("s_name").alias("nome"),
        uf.alias("coduf"),
    )


def tbpro(spark, sf_dir) -> DataFrame:
    p = _raw(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("int").alias("codpro"), F.col("p_name").alias("nome"))


def tbcta(spark, sf_dir) -> DataFrame:
    r = _raw(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").cast("int").alias("contareduz"), F.col("r_name").alias("nomeconta"))


def tbfor(spark, sf_dir) -> DataFrame:
    s = _raw(spark, sf_dir, "supplier")
    return s.select(lpad14(F.col("s_suppkey")).alias("cgccpfforne"), F.col("s_name").alias("nomefantasia"))


def tbhis(spark, sf_dir) -> DataFrame:
    o = _raw(spark, sf_dir, "orders")
    return (
        o.select("o_orderpriority")
        .distinct()
        .select(
            F.substring("o_orderpriority", 1, 1).cast("int").alias("codtransacao"),
            F.expr("substring(o_orderpriority, 3)").alias("descricao"),
        )
    )


# -------------------------------------------------------------------------- facts
def factrc(spark, sf_dir) -> DataFrame:
    o = _raw(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    odate = _day(F.col("o_orderdate"))
    price = _dec2(F.col("o_totalprice"))
    thousand = F.lit(Decimal("1000.00")).cast("decimal(15,2)")
    zero = F.lit(Decimal("0.00")).cast("decimal(15,2)")
    return o.select(
        key.alias("nrofatura"),
        F.year(odate).alias("anofatura"),
        lpad14(F.col("o_custkey")).alias("cgccpffatura"),
        (key % 25).cast("int").alias("codfilfatur"),
        (F.col("o_custkey") % 120).cast("int").alias("codciddes"),
        (key % 120).cast("int").alias("codcidpagto"),
        (key % 2100).cast("int").alias("codpro"),
        odate.alias("dataemissao"),
        F.date_add(odate, 30).alias("datavencto"),
        F.when(status == "O", F.lit(None).cast("date"))
        .otherwise(F.date_add(odate, (key % 60).cast("int")))
        .alias("datarecbto"),
        _dec2(
            F.when(status == "F", price).when(status == "P", price - thousand).when(status == "O", zero)
        ).alias("vlrrecbto"),
        _dec2(
            F.when(status == "F", zero).when(status == "P", thousand).when(status == "O", price)
        ).alias("vlrsaldo"),
        (key % 6).cast("int").alias("contareduz"),
    )


def frctrc(spark, sf_dir, with_customer: bool = True) -> DataFrame:
    """Freight documents from line items.  The destination customer is the
    only column taken from ``orders``; without it the big line-item/order join
    is skipped (used when no report column needs the customer)."""
    li = _raw(spark, sf_dir, "lineitem")
    if with_customer:
        o = _raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        li = li.join(o, li.l_orderkey == o.o_orderkey, "inner")
        dest = lpad14(F.col("o_custkey"))
    else:
        dest = None
    flag = F.col("l_returnflag")
    ln = F.col("l_linenumber")
    cols = [
        (F.col("l_orderkey") * 10 + ln).alias("nroctrc"),
        F.lit("SP").alias("ufctrc"),
        _day(F.col("l_shipdate")).alias("dataemissao"),
        F.when(flag == "N", "N").when(flag == "R", "F").otherwise("C").alias("situacao"),
        (ln - 1).cast("int").alias("indctetpcte"),
        (F.col("l_suppkey") % 25).cast("int").alias("codfilemite"),
    ]
    if dest is not None:
        cols.append(dest.alias("cgccpfdestina"))
    cols += [
        F.col("l_suppkey").cast("int").alias("codciddes"),
        F.col("l_partkey").cast("int").alias("codpro"),
        (F.col("l_quantity").cast("decimal(15,3)") * 100).cast("decimal(15,3)").alias("totalpeso"),
        _dec2(F.col("l_quantity")).alias("vlrpedagio"),
        _dec2(F.col("l_extendedprice")).alias("vlrcarreto"),
        _dec2(F.col("l_quantity")).alias("vlrseguromerca"),
        F.lit(Decimal("1.65")).cast("decimal(15,2)").alias("vlrpis"),
        F.lit(Decimal("0.00")).cast("decimal(15,2)").alias("vlriapas"),
        F.when(ln == 7, F.lit(None).cast("decimal(15,2)"))
        .otherwise(F.lit(Decimal("0.00")).cast("decimal(15,2)"))
        .alias("vlricmsst"),
        _dec2(_dec2(F.col("l_tax")) * 100).alias("vlricms"),
    ]
    return li.select(*cols)


def cptit(spark, sf_dir) -> DataFrame:
    li = _raw(spark, sf_dir, "lineitem")
    flag = F.col("l_returnflag")
    ship = _day(F.col("l_shipdate"))
    ext = _dec2(F.col("l_extendedprice"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("nrocontrole"),
        F.year(ship).alias("anocontrole"),
        lpad14(F.col("l_suppkey")).alias("cgccpfforne"),
        F.col("l_linenumber").cast("int").alias("codtransacao"),
        ext.alias("vlrtotal"),
        _dec2(
            F.when(flag == "A", F.lit(Decimal("0.00")))
            .when(flag == "R", F.lit(Decimal("100.00")))
            .when(flag == "N", ext)
        ).alias("vlrsaldo"),
        ship.alias("datamovto"),
        F.date_add(ship, 30).alias("datavencto"),
        (F.col("l_partkey") % 6).cast("int").alias("contareduz"),
    )


# ------------------------------------------------------------------ control tables
def tbempresas(spark, sf_dir) -> DataFrame:
    n = _raw(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    path = F.concat(
        F.lit("C:" + BACKSLASH * 2 + "dados" + BACKSLASH * 2), F.col("n_name"), F.lit(".FDB")
    )
    return n.select(
        k.cast("int").alias("codempresa"),
        F.col("n_name").alias("nomeempresa"),
        lpad14(k).alias("cnpjcpf"),
        F.lit("F").alias("tipobdempresa"),
        F.lit("3050").alias("portabd"),
        F.concat(F.lit("10.0.0."), k.cast("string")).alias("ipbd"),
        path.alias("caminhobd"),
        F.when(k % 5 == 0, "N").otherwise("S").alias("ativa"),
    )


def tbusuarios(spark, sf_dir) -> DataFrame:
    c = _raw(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    r = F.concat(
        F.lpad((k * 7919 + 123456).cast("string"), 9, "0"),
        F.lpad((k % 100).cast("string"), 2, "0"),
    )
    punct = F.concat(
        F.substring(r, 1, 3), F.lit("."), F.substring(r, 4, 3), F.lit("."),
        F.substring(r, 7, 3), F.lit("-"), F.substring(r, 10, 2),
    )
    return c.select(
        k.cast("int").alias("codusuario"),
        F.col("c_name").alias("nomeusuario"),
        F.lit("x").alias("senhausuario"),
        F.col("c_nationkey").cast("int").alias("codempresa"),
        F.when(F.col("c_acctbal") < 0, "N").otherwise("S").alias("usuarioativo"),
        F.when(k % 2 == 0, r).otherwise(punct).alias("cpfusuario"),
        F.concat(F.lower(F.replace(F.col("c_name"), F.lit("#"), F.lit(""))), F.lit("@example.com")).alias(
            "emailusuario"
        ),
    )


def audit_events(spark, sf_dir) -> DataFrame:
    """Raw request-audit events (input of N1) from ``events``."""
    return audit_rows(_raw(spark, sf_dir, "events"))


def audit_rows(e: DataFrame, body: Column | None = None) -> DataFrame:
    """Map ``events`` rows to request captures; a plain projection, so it
    works on a streaming DataFrame too.  ``body`` replaces the response body."""
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    plain_body = F.lit("  plain" + BACKSLASH + "n text ")
    json_body = F.concat(F.lit(" "), F.col("props"), F.lit(BACKSLASH + "n"))
    return e.select(
        eid.alias("id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.concat(F.lit("user_"), uid.cast("string")).alias("usuario"),
        (uid % 25).cast("string").alias("codempresa"),
        F.when(et.isin("click", "view"), "GET").otherwise("POST").alias("metodo"),
        F.when(et == "click", F.lit("/login")).otherwise(F.concat(F.lit("/bi/"), et)).alias("endpoint"),
        F.col("props").alias("params"),
        F.col("props").alias("body_request"),
        (F.when(eid % 7 == 0, plain_body).otherwise(json_body) if body is None else body).alias("body_response"),
        F.when(F.col("value") > 300, 501).otherwise(200).cast("int").alias("status_code"),
        F.when(eid % 50 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("agent/"), (uid % 3).cast("string")))
        .alias("user_agent"),
        F.lit("10.0.0.1").alias("ip_address"),
    )


def audit_body_events(spark, sf_dir) -> DataFrame:
    """``audit_events`` with bodies of every kind (E23): objects, arrays, numbers,
    strings, JSON with white space, broken JSON, plain text and none."""
    e = _raw(spark, sf_dir, "events")
    eid, uid = F.col("event_id").cast("string"), F.col("user_id").cast("string")
    q = F.lit
    bodies = [
        F.concat(q('{"access_token":"t'), eid, q('","empresa":'), uid, q(',"itens":['), eid, q(',"'), F.col("event_type"), q('",null]}')),
        F.concat(q("["), eid, q(',"x",{"a":true}]')),
        eid,
        F.concat(q('"user '), uid, q('"')),
        F.concat(q('{ "z" : '), uid, q(' , "a" : [ 1 , 2 ] }' + BACKSLASH + "n")),
        F.concat(q('{"empresa": '), eid),
        F.concat(q("  plain "), eid),
        q("-12.5"),
        q(None).cast("string"),
    ]
    body = F.lit(None).cast("string")
    for i, b in enumerate(bodies):
        body = F.when(F.col("event_id") % len(bodies) == i, b).otherwise(body)
    return audit_rows(e, body)


DIM_BUILDERS = {
    "tbfil": tbfil,
    "tbcli": tbcli,
    "tbcid": tbcid,
    "tbpro": tbpro,
    "tbcta": tbcta,
    "tbfor": tbfor,
    "tbhis": tbhis,
}
#: Dimensions that are an aggregate of a large table.
DERIVED_DIMS = ("tbhis",)
FACT_BUILDERS = {"factrc": factrc, "frctrc": frctrc, "cptit": cptit}
CONTROL_BUILDERS = {"tbempresas": tbempresas, "tbusuarios": tbusuarios, "tbauditoria_in": audit_events}

#: Branch column per fact; its value % 3 is the tenant in the multi-tenant
#: layout.  Payables carry no branch, so their supplier key is used.
TENANT_SOURCE = {"factrc": "codfilfatur", "frctrc": "codfilemite", "cptit": None}


def add_fixture_tenant(name: str, df: DataFrame) -> DataFrame:
    """Multi-tenant fixture (N9): facts get ``codempresa``; every dimension
    is repeated once per tenant with ``explode`` (no join)."""
    if name in FACT_BUILDERS:
        src = TENANT_SOURCE[name]
        if src is None:
            tenant = (F.col("cgccpfforne").cast("bigint") % 3).cast("int")
        else:
            tenant = (F.col(src) % 3).cast("int")
        return df.withColumn("codempresa", tenant)
    tenants = F.array(*[F.lit(t) for t in FIXTURE_TENANTS])
    return df.withColumn("codempresa", F.explode(tenants))
