"""Profiling, projection, typing and cleaning queries with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tablewright.catalogue.inputs import DIRTY_SQL, dirty_orders, table
from tablewright.functions import casts
from tablewright.operators import charts, cleaning, profile, statistics
from tablewright.plans.clean import clean
from tablewright.runtime import new_folder
from tablewright.sources import tables
from tablewright.spec import DatasetSpec

QUERIES, ORACLES = {}, {}
# Bytes of text that one task writes into one CSV file, about: several of the byte ranges by which it is read.
FILE_BYTES = 512 << 20


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


D = f"with d as ({DIRTY_SQL})"
BASIC = ("o_orderkey", "price", "prio", "odate", "status")
_mode = lambda c, t="d": f"(select {c} from {t} where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
_missing = " union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as missing, count(distinct {c}) as uniq from d" for c in BASIC)


@query("profile_shape", f"{D} select count(*) as n_rows, 5::bigint as n_columns from d")
def _(spark, sf):
    return profile.shape(dirty_orders(spark, sf, *BASIC))


_TYPES = {"o_orderkey": "bigint", "price": "double", "prio": "string", "odate": "date", "status": "string"}
_TYPE_ROWS = ", ".join(f"('{c}', '{t}')" for c, t in _TYPES.items())


@query("profile_dtypes", f"select * from (values {_TYPE_ROWS}) v(column_name, dtype)")
def _(spark, sf):
    return profile.column_types(dirty_orders(spark, sf, *BASIC)).withColumnRenamed("column", "column_name")


@query("column_names", "select i - 1 as position, list_extract(['o_orderkey','price','prio','odate','status'], i::int) as column_name from range(1, 6) t(i)")
def _(spark, sf):
    return profile.column_names(dirty_orders(spark, sf, *BASIC)).withColumnRenamed("column", "column_name")


@query("profile_missing", f"{D}, m as ({_missing}) select column_name, missing from m")
def _(spark, sf):
    return profile.missing_values(dirty_orders(spark, sf, *BASIC)).withColumnRenamed("column", "column_name")


@query("profile_unique", f"{D}, m as ({_missing}) select column_name, uniq from m")
def _(spark, sf):
    return profile.unique_values(dirty_orders(spark, sf, *BASIC)).toDF("column_name", "uniq")


@query("profile_report", f"{D}, m as ({_missing}), t as (select * from (values {_TYPE_ROWS}) v(column_name, dtype)) "
       "select m.column_name, t.dtype, m.missing, m.uniq from m join t on m.column_name = t.column_name")
def _(spark, sf):
    return profile.profile(dirty_orders(spark, sf, *BASIC)).toDF("column_name", "dtype", "missing", "uniq")


@query("head_rows", f"{D} select o_orderkey, price, prio, status from d order by o_orderkey limit 10")
def _(spark, sf):
    return profile.head(dirty_orders(spark, sf, "o_orderkey", "price", "prio", "status"), ["o_orderkey"], 10)


@query("col_mean", f"{D} select round(avg(price), 4) as mean_price from d")
def _(spark, sf):
    return dirty_orders(spark, sf, "price").agg(F.round(F.avg("price"), 4).alias("mean_price"))


@query("col_median", f"{D} select round(median(price::double), 4) as median_price from d")
def _(spark, sf):
    df = dirty_orders(spark, sf, "price")
    value = statistics.medians(df, ["price"])["price"]
    return spark.range(1).select(F.round(F.lit(value), 4).alias("median_price"))


@query("col_mode", f"{D} select {_mode('prio')} as mode_prio, {_mode('price')} as mode_price, cast({_mode('odate')} as varchar) as mode_date")
def _(spark, sf):
    df = dirty_orders(spark, sf, "prio", "price", "odate")
    found = statistics.modes(df, df.columns)
    return spark.range(1).select(
        found["prio"].value.alias("mode_prio"), found["price"].value.alias("mode_price"),
        found["odate"].value.cast("string").alias("mode_date"),
    )


@query("unique_mode", f"{D}, c as (select 'prio' as column_name, prio::varchar as v, count(*) as n from d where prio is not null group by prio "
       "union all select 'price', price::varchar, count(*) from d where price is not null group by price), "
       "m as (select column_name, max(n) as n from c group by column_name) "
       "select c.column_name, count(*) as ties, count(*) = 1 as usable from c join m on c.column_name = m.column_name and c.n = m.n group by c.column_name")
def _(spark, sf):
    found = statistics.modes(dirty_orders(spark, sf, "prio", "price"), ["prio", "price"])
    rows = [(c, m.ties, m.ties == 1) for c, m in found.items()]
    return spark.createDataFrame(rows, "column_name string, ties long, usable boolean")


CAST_SPEC = DatasetSpec(types={"price_txt": "float", "qty_txt": "int", "odate": "date", "status": "category"})


@query("cast_report", f"{D} select 'price_txt' as column_name, 'float' as declared, count(*) filter (price_txt is not null and try_cast(price_txt as double) is null) as new_nulls from d "
       "union all select 'qty_txt', 'int', count(*) filter (qty_txt is not null and try_cast(qty_txt as bigint) is null) from d "
       "union all select 'odate', 'date', 0::bigint union all select 'status', 'category', 0::bigint")
def _(spark, sf):
    return cleaning.cast_report(dirty_orders(spark, sf), CAST_SPEC).withColumnRenamed("column", "column_name")


@query("distinct_values", f"{D} select distinct flag from d")
def _(spark, sf):
    return profile.distinct_values(dirty_orders(spark, sf, "flag"), "flag")


@query("all_in_set", f"{D} select bool_and(coalesce(lower(trim(flag)) in ('true','false','1','0','yes','no'), false)) as all_in_set from d")
def _(spark, sf):
    df = dirty_orders(spark, sf, "flag").select(F.lower(F.trim("flag")).alias("flag"))
    return profile.all_in_set(df, "flag", casts.TRUE_TOKENS + casts.FALSE_TOKENS)


# ---- projections and filters ----------------------------------------------

def _with_empty(spark, sf):
    return dirty_orders(spark, sf, *BASIC).withColumns({
        "empty": F.lit(None).cast("double"), "Unnamed: 3": F.lit(1), "odate": F.col("odate").cast("string"),
    })


@query("drop_null_columns", f"{D} select o_orderkey, price, prio, odate::varchar as odate, status, 1::int as \"Unnamed: 3\" from d")
def _(spark, sf):
    return cleaning.drop_null_columns(_with_empty(spark, sf))


@query("drop_unnamed", f"{D} select o_orderkey, price, prio, odate::varchar as odate, status, null::double as empty from d")
def _(spark, sf):
    return cleaning.drop_unnamed(_with_empty(spark, sf))


@query("drop_null_rows", f"{D} select o_orderkey, price, prio, odate::varchar as odate, status from d where price is not null and prio is not null and odate is not null")
def _(spark, sf):
    return cleaning.drop_null_rows(_with_empty(spark, sf).drop("empty", "Unnamed: 3"))


@query("drop_null_subset", f"{D} select o_orderkey, price, prio from d where prio is not null")
def _(spark, sf):
    return cleaning.drop_null_rows(dirty_orders(spark, sf, "o_orderkey", "price", "prio"), ["prio"])


@query("split_target", f"{D} select o_orderkey, price, status as label from d")
def _(spark, sf):
    return cleaning.split_target(dirty_orders(spark, sf, "o_orderkey", "price", "status"), "status")


@query("chart_xy", f"{D} select price as x, prio as y from d where price is not null and prio is not null")
def _(spark, sf):
    return charts.chart_data(dirty_orders(spark, sf, "price", "prio"), "price", "prio")


@query("chart_xy_compat", f"{D}, a as (select price, row_number() over (order by o_orderkey) as i from d where price is not null), "
       "b as (select prio, row_number() over (order by o_orderkey) as i from d where prio is not null) "
       "select a.price as x, b.prio as y from a join b on a.i = b.i")
def _(spark, sf):
    return charts.chart_data(dirty_orders(spark, sf, "o_orderkey", "price", "prio"), "price", "prio", compat=True, order="o_orderkey")


@query("csv_round_trip", f"{D} select o_orderkey, price, prio, odate::varchar as odate, trim(status) as status, qty_txt from d")
def _(spark, sf):
    df = dirty_orders(spark, sf, "o_orderkey", "price", "prio", "odate", "status", "qty_txt")
    back = tables.round_trip_csv(df)
    return back.withColumns({"odate": F.col("odate").cast("string"), "status": F.trim("status")})


# ---- typing ---------------------------------------------------------------

def _typed(spark, sf, column, declared, **options):
    df = dirty_orders(spark, sf, "o_orderkey", column)
    return cleaning.enforce_types(df, DatasetSpec(types={column: declared}, **options))


_BOOL = "coalesce(case when lower(trim(flag)) in ('true','1','yes') then true when lower(trim(flag)) in ('false','0','no') then false {} end, false)"


@query("enforce_types", f"{D} select o_orderkey, try_cast(price_txt as double) as price_txt, try_cast(qty_txt as bigint) as qty_txt, "
       f"{_BOOL.format('')} as flag, lower(trim(status)) as status from d")
def _(spark, sf):
    df = dirty_orders(spark, sf, "o_orderkey", "price_txt", "qty_txt", "flag", "status")
    return cleaning.enforce_types(df, DatasetSpec(types={
        "price_txt": "float", "qty_txt": "int", "flag": "bool", "status": "category", "o_orderkey": "object"}))


@query("to_int", f"{D} select o_orderkey, try_cast(qty_txt as bigint) as qty_txt from d")
def _(spark, sf):
    return _typed(spark, sf, "qty_txt", "int")


@query("to_int_fractional", f"{D} select o_orderkey, try_cast(price_txt as double) as price_txt from d")
def _(spark, sf):
    return _typed(spark, sf, "price_txt", "int")


@query("to_float", f"{D} select o_orderkey, try_cast(price_txt as double) as price_txt from d")
def _(spark, sf):
    return _typed(spark, sf, "price_txt", "float")


@query("to_date", f"{D} select o_orderkey, cast(try_cast(clock as date) as varchar) as clock from d")
def _(spark, sf):
    return _typed(spark, sf, "clock", "date").withColumn("clock", F.col("clock").cast("string"))


@query("to_str", f"{D} select o_orderkey, coalesce(price::varchar, '') as price from d")
def _(spark, sf):
    return dirty_orders(spark, sf, "o_orderkey", "price").withColumn("price", casts.to_text(F.col("price"), empty=True))


@query("to_bool", f"{D} select o_orderkey, {_BOOL.format(chr(32) + 'when lower(trim(flag)) = ' + chr(39) + 'maybe' + chr(39) + ' then true')} as flag from d")
def _(spark, sf):
    return _typed(spark, sf, "flag", "bool", value_maps={"flag": {"maybe": True}})


@query("to_category", f"{D} select o_orderkey, case lower(trim(status)) when 'o' then 'open' when 'f' then 'final' else lower(trim(status)) end as status from d")
def _(spark, sf):
    return _typed(spark, sf, "status", "category", value_maps={"status": {"o": "open", "f": "final"}})


@query("to_time", f"{D} select o_orderkey, strftime(try_cast(clock as timestamp), '%H:%M:%S') as clock from d")
def _(spark, sf):
    return _typed(spark, sf, "clock", "time")


_NUM = lambda p: f"coalesce(try_cast(nullif(regexp_extract(dur, '{p}', 1), '') as bigint), 0)"


@query("to_timedelta", f"{D} select o_orderkey, case when dur <> 'soon' then {_NUM('([0-9]+) days')} * 86400 + {_NUM('([0-9]+):[0-9]+:')} * 3600 "
       f"+ {_NUM(':([0-9]+):')} * 60 + {_NUM('[0-9]:([0-9]+)$')} end as seconds from d")
def _(spark, sf):
    df = _typed(spark, sf, "dur", "timedelta")
    seconds = (F.extract(F.lit("DAY"), F.col("dur")).cast("long") * 86400
               + F.extract(F.lit("HOUR"), F.col("dur")).cast("long") * 3600
               + F.extract(F.lit("MINUTE"), F.col("dur")).cast("long") * 60
               + F.extract(F.lit("SECOND"), F.col("dur")).cast("long"))
    return df.select("o_orderkey", seconds.alias("seconds"))


@query("to_complex", f"{D} select o_orderkey, try_cast(nullif(regexp_extract(cplx, '^([0-9]+)[+]', 1), '') as double) as re, "
       "try_cast(nullif(regexp_extract(cplx, '[+]([0-9]+)j$', 1), '') as double) as im from d")
def _(spark, sf):
    return _typed(spark, sf, "cplx", "complex").select("o_orderkey", "cplx.re", "cplx.im")


@query("to_uint", f"{D} select o_orderkey, try_cast(qty_txt as bigint) as qty_txt from d")
def _(spark, sf):
    return _typed(spark, sf, "qty_txt", "uint").withColumn("qty_txt", F.col("qty_txt").cast("long"))


# ---- filling --------------------------------------------------------------

def _filled(method):
    def run(spark, sf):
        df = cleaning.fill_columns(dirty_orders(spark, sf, "o_orderkey", "price"), ["price"], method)
        return df.withColumn("price", F.round("price", 4))

    return run


for _method, _expr in {
    "mean": "(select avg(price) from d)", "median": "(select median(price::double) from d)",
    "mode": _mode("price"), "custom": "0.0",
}.items():
    query(f"fill_{_method}", f"{D} select o_orderkey, round(coalesce(price, {_expr})::double, 4) as price from d")(
        _filled("custom_value" if _method == "custom" else _method))


@query("round_int", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round_even(l_quantity / 2, 0) as bigint) as half from lineitem")
def _(spark, sf):
    half = cleaning.round_whole(F.col("l_quantity") / 2)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", half.alias("half"))


@query("fill_string", f"{D} select o_orderkey, coalesce(prio, {_mode('prio')}) as prio from d")
def _(spark, sf):
    return cleaning.fill_most_frequent(dirty_orders(spark, sf, "o_orderkey", "prio"), ["prio"], unique_only=True)


@query("fill_string_tie", "with d as (select o_orderkey, case when o_orderkey % 3 = 0 then null else 'id' || cast(o_orderkey as varchar) end as tag from orders) "
       "select o_orderkey, tag from d where tag is not null")
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 3 = 0 then null else concat('id', cast(o_orderkey as string)) end as tag")
    return cleaning.fill_most_frequent(df, ["tag"], unique_only=True)


@query("fill_category", f"{D}, c as (select o_orderkey, lower(trim(prio)) as prio from d) select o_orderkey, coalesce(prio, {_mode('prio', 'c')}) as prio from c")
def _(spark, sf):
    typed = _typed(spark, sf, "prio", "category")
    return cleaning.fill_most_frequent(typed, ["prio"])


@query("fill_datetime", f"{D} select o_orderkey, cast(coalesce(odate, {_mode('odate')}) as varchar) as odate from d")
def _(spark, sf):
    filled = cleaning.fill_most_frequent(dirty_orders(spark, sf, "o_orderkey", "odate"), ["odate"])
    return filled.withColumn("odate", F.col("odate").cast("string"))


CLEAN_SPEC = DatasetSpec(
    types={"price_txt": "float", "qty_txt": "int", "prio": "category", "odate": "date_time", "status": "str", "flag": "bool"},
    fill_empty_rows_using="median",
)
_CLEAN_COLUMNS = ("price_txt", "qty_txt", "prio", "odate", "status", "flag")
_CLEAN_TYPED = (f"t as (select try_cast(price_txt as double) as price_txt, try_cast(qty_txt as bigint) as qty_txt, lower(trim(prio)) as prio, "
                f"odate, status, {_BOOL.format('')} as flag from d)")
_CLEAN_FILL = (f"select round(coalesce(price_txt, (select median(price_txt) from t)), 4) as price_txt, "
               f"cast(round_even(coalesce(qty_txt::double, (select median(qty_txt::double) from t)), 0) as bigint) as qty_txt, "
               f"coalesce(prio, {_mode('prio', 't')}) as prio, cast(coalesce(odate, {_mode('odate', 't')}) as varchar) as odate, status, flag from t")


def _shown(df):
    return df.withColumns({"price_txt": F.round("price_txt", 4), "odate": F.col("odate").cast("string")})


@query("handle_nulls", f"{D}, {_CLEAN_TYPED} {_CLEAN_FILL}")
def _(spark, sf):
    typed = cleaning.enforce_types(dirty_orders(spark, sf, *_CLEAN_COLUMNS), CLEAN_SPEC)
    return _shown(cleaning.handle_nulls(typed, CLEAN_SPEC))


@query("handle_nulls_untyped", f"{D} select o_orderkey, price, prio from d where price is not null and prio is not null")
def _(spark, sf):
    """Without declared types nothing is filled, and incomplete rows still go."""
    df = dirty_orders(spark, sf, "o_orderkey", "price", "prio").withColumns({"_c7": F.lit(1), "empty": F.lit(None).cast("string")})
    return cleaning.handle_nulls(df, DatasetSpec()).drop("_c7")


@query("csv_round_trip_text", "select doc_id, text from documents")
def _(spark, sf):
    """Texts that hold line breaks and quotes."""
    return tables.round_trip_csv(table(spark, sf, "documents").select("doc_id", "text"))


@query("csv_one_file", "select doc_id, text, lang, source, n_chars from documents")
def _(spark, sf):
    """One file whose cells hold line breaks, read by as many tasks as it has byte ranges.

    A file has one writer, so there is another file for every ``FILE_BYTES`` of text.
    """
    documents = table(spark, sf, "documents")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = tables.write_csv(documents.coalesce(max(1, math.ceil(size / FILE_BYTES))), new_folder(spark, "one") + ".csv")
    return tables.read_csv(spark, path)


@query("handle_nulls_unfilled_types", f"{D} select o_orderkey, coalesce(price, 0.0) as price, odate::varchar as odate from d where odate is not null")
def _(spark, sf):
    spec = DatasetSpec(types={"o_orderkey": "int", "price": "float", "odate": "date"}, fill_empty_rows_using="custom_value")
    df = cleaning.handle_nulls(dirty_orders(spark, sf, "o_orderkey", "price", "odate"), spec)
    return df.withColumn("odate", F.col("odate").cast("string"))


@query("dedupe", "select distinct l_quantity, l_tax, l_returnflag from lineitem")
def _(spark, sf):
    return cleaning.remove_duplicates(table(spark, sf, "lineitem").select("l_quantity", "l_tax", "l_returnflag"))


@query("clean", f"{D}, {_CLEAN_TYPED} select distinct * from ({_CLEAN_FILL})")
def _(spark, sf):
    return _shown(clean(dirty_orders(spark, sf, *_CLEAN_COLUMNS), CLEAN_SPEC))


@query("drop_correlated", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice from lineitem "
       "where (select abs(corr(l_quantity, l_quantity * 3 + l_tax)) > 0.9 and abs(corr(l_quantity, l_extendedprice)) < 0.9 from lineitem)")
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_quantity * 3 + l_tax as twin", "l_extendedprice")
    return cleaning.drop_correlated(df, ["l_quantity", "twin", "l_extendedprice"])


@query("oversample", "with c as (select toxic, count(*) as n from labels group by toxic), f as (select toxic, (select max(n) from c)::double / n as f from c), "
       "r as (select l.doc_id, l.quality, l.toxic, cast(floor(f.f) as bigint) + case when cast(('0x' || substr(md5('42:' || l.doc_id::varchar), 1, 8)) as bigint) / 4294967296.0::double < f.f - floor(f.f) then 1 else 0 end as k "
       "from labels l join f on l.toxic = f.toxic) select doc_id, quality, toxic, cast(unnest(range(1, k + 1)) as int) as copy from r")
def _(spark, sf):
    return cleaning.oversample(table(spark, sf, "labels"), "toxic", ["doc_id"])
