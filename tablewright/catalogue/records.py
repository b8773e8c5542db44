"""Registry and reply-parsing queries over records derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.catalogue.inputs import table
from tablewright.functions.text import json_object, strip_fence
from tablewright.sources import registry
from tablewright.spec import read_specs

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def _models(spark, sf):
    """One dataset record per order, holding two models (one when the key is a multiple of 5)."""
    entry = ("named_struct('model_id', concat('m', cast(o_orderkey as string), '{i}'), 'model_name', '{name}', 'score', o_totalprice / {div})")
    first, second = entry.format(i="a", name="ridge", div="1000"), entry.format(i="b", name="lasso", div="2000")
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as dataset_id", f"case when o_orderkey % 5 = 0 then array({first}) else array({first}, {second}) end as models")


_ENTRY = "{{'model_id': 'm' || o_orderkey::varchar || '{i}', 'model_name': '{name}', 'score': o_totalprice / {div}}}"
_FIRST, _SECOND = _ENTRY.format(i="a", name="ridge", div="1000"), _ENTRY.format(i="b", name="lasso", div="2000")
_MODELS = f"with m as (select o_orderkey as dataset_id, case when o_orderkey % 5 = 0 then [{_FIRST}] else [{_FIRST}, {_SECOND}] end as models from orders)"


@query("model_metrics", "select 'm' || o_orderkey::varchar as model_id, o_orderstatus as name, case when o_orderkey % 3 = 0 then 0.0 else o_totalprice / 1000000 end as accuracy, "
       "0.0 as precision, 0.0 as recall, 0.0 as f1, case when o_orderkey % 4 = 0 then 0.0 else o_totalprice / 100 end as training_time, "
       "case when o_orderkey % 3 = 0 then o_totalprice / 10 end as mse, null::double as r2 from orders")
def _(spark, sf):
    rows = table(spark, sf, "orders").selectExpr(
        "concat('m', cast(o_orderkey as string)) as model_id", "cast(o_custkey as string) as dataset_id", "o_orderstatus as model_name",
        "case when o_orderkey % 4 = 0 then null else o_totalprice / 100 end as train_time",
        "case when o_orderkey % 3 = 0 then map('mse', o_totalprice / 10) else map('accuracy', o_totalprice / 1000000) end as metrics")
    return registry.model_metrics(rows)


@query("find_model", f"{_MODELS} select dataset_id, e.model_id, e.model_name, e.score from (select dataset_id, unnest(models) as e from m)")
def _(spark, sf):
    return registry.find_model(_models(spark, sf))


@query("array_append", f"{_MODELS} select dataset_id, list_append(list_transform(models, lambda x: x.model_id), 'new')[-1] as last, len(models) + 1 as n from m")
def _(spark, sf):
    df = _models(spark, sf).withColumn("ids", F.transform("models", lambda m: m["model_id"]))
    grown = registry.array_append(F.col("ids"), F.lit("new"))
    return df.select("dataset_id", F.element_at(grown, -1).alias("last"), F.size(grown).cast("long").alias("n"))


@query("array_set", "with o as (select o_orderkey, [o_custkey % 5, o_custkey % 3, o_custkey % 5] as ids from orders) "
       "select o_orderkey, array_to_string(case when list_contains(ids, 2) then ids else list_append(ids, 2) end, ',') as added, "
       "array_to_string(list_filter(ids, lambda x: x <> 1), ',') as pulled from o")
def _(spark, sf):
    ids = F.array(F.col("o_custkey") % 5, F.col("o_custkey") % 3, F.col("o_custkey") % 5)
    text = lambda a: F.array_join(F.transform(a, lambda v: v.cast("string")), ",")
    return table(spark, sf, "orders").select(
        "o_orderkey", text(registry.array_add(ids, F.lit(2).cast("long"))).alias("added"),
        text(registry.array_pull(ids, F.lit(1).cast("long"))).alias("pulled"))


@query("null_default", "select o_orderkey, case when o_orderkey % 3 = 0 then 'none' else 'file' || o_custkey::varchar end as config from orders")
def _(spark, sf):
    nested = F.when(F.col("o_orderkey") % 3 != 0, F.struct(F.concat(F.lit("file"), F.col("o_custkey").cast("string")).alias("config")))
    return table(spark, sf, "orders").withColumn("artifacts", nested).select(
        "o_orderkey", F.coalesce("artifacts.config", F.lit("none")).alias("config"))


@query("dataset_names", "with o as (select o_orderkey, unnest([o_custkey, -o_custkey - 1]) as c_custkey from orders) "
       "select o.o_orderkey, o.c_custkey, coalesce(c.c_name, 'Unknown Dataset') as dataset_name from o left join customer c on o.c_custkey = c.c_custkey")
def _(spark, sf):
    owners = table(spark, sf, "orders").select("o_orderkey", F.array("o_custkey", -F.col("o_custkey") - 1).alias("ids"))
    return registry.dataset_names(owners, "ids", table(spark, sf, "customer"), "c_custkey", "c_name")


_REPLY = ("text || ' ' || case when turn % 3 = 0 then '{\"models\": [\"' || role || '\"], \"turn\": ' || turn::varchar || '}' "
          "when turn % 3 = 1 then '{\"turn\": ' || turn::varchar || '}' else 'no {broken: object' end || ' ok'")
_BODY = f"with r as (select conv_id, turn, nullif(regexp_extract({_REPLY}, '(?s)\\{{.*\\}}', 0), '') as j from conversations) "


@query("json_from_text", _BODY + "select conv_id, turn, case when json_valid(j) and json_exists(j, '$.models') then json_extract_string(j, '$.models[0]') end as model, "
       "case when json_valid(j) and json_exists(j, '$.models') then json_extract_string(j, '$.turn')::bigint end as parsed_turn from r")
def _(spark, sf):
    turn = F.col("turn").cast("string")
    reply = F.concat("text", F.lit(" "), F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"models": ["'), "role", F.lit('"], "turn": '), turn, F.lit("}")))
                     .when(F.col("turn") % 3 == 1, F.concat(F.lit('{"turn": '), turn, F.lit("}"))).otherwise("no {broken: object"), F.lit(" ok"))
    parsed = json_object(reply, "models array<string>, turn bigint", ["models"])
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.get(parsed["models"], F.lit(0)).alias("model"), parsed["turn"].alias("parsed_turn"))


@query("strip_fence", "with r as (select conv_id, turn, trim(case when turn % 2 = 0 then '```json' || chr(10) || text || chr(10) || '```' else text end) as t from conversations) "
       "select conv_id, turn, case when starts_with(t, '```json') then regexp_replace(regexp_replace(substr(t, 8), '```$', ''), '^\\s+|\\s+$', '', 'g') else t end as body from r")
def _(spark, sf):
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", strip_fence(text).alias("body"))


@query("read_spec", "select o_orderkey, case when o_orderkey % 2 = 0 then 'median' else '' end as fill_empty_rows_using, true as remove_duplicate, "
       "o_orderkey % 3 <> 0 as standardization_necessary, false as normalization_necessary, case when o_orderkey % 4 = 0 then 30 else cast(o_custkey % 50 as int) end as test_dataset_percentage, "
       "false as increase_the_size_of_dataset, false as fill_string_type_columns, false as dimensionality_reduction, '' as target_column, false as remove_highly_correlated_columns from orders")
def _(spark, sf):
    return read_specs(table(spark, sf, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 2 = 0 then 'median' end as fill_empty_rows_using",
        "case when o_orderkey % 3 = 0 then false end as standardization_necessary",
        "case when o_orderkey % 4 = 0 then null else cast(o_custkey % 50 as int) end as test_dataset_percentage"))
