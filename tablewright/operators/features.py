"""Imputing, scaling, encoding and expanding columns into features.

A fitted transformer is a ``PipelineModel`` whose statistics are literals in SQL
stages, so it runs inside code generation, saves natively and scores streams.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, PCA, SQLTransformer, StandardScaler, StringIndexerModel, VectorAssembler, VectorSlicer,
)
from pyspark.ml.linalg import SparseVector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from tablewright.functions.casts import DATE_FORMATS, to_timestamp
from tablewright.operators import statistics
from tablewright.operators.lookup import lookup
from tablewright.operators.ordering import with_position
from tablewright.operators.statistics import cell
from tablewright.runtime import BROADCAST_ROWS, bounded_count, cut
from tablewright.spec import DatasetSpec, route_columns

# Parts of a datetime feature, in order, and the stand-in date.
DATETIME_PARTS = ("day", "month", "year", "hour", "minute", "second")
MISSING_DATE = "1900-01-01"


# ---- scaling and imputing -------------------------------------------------

def impute_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = statistics.medians(df, columns)
    return _filled(df, found)


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _filled(df, statistics.means(df, columns))


def _filled(df: DataFrame, found: dict) -> DataFrame:
    return df.withColumns({
        c: cell(df, c).cast("double") if v is None else F.coalesce(cell(df, c).cast("double"), F.lit(v))
        for c, v in found.items()
    })


def impute_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = statistics.modes(df, columns)
    return df.withColumns({c: F.coalesce(cell(df, c), m.value) for c, m in found.items()})


def _scale_facts(df: DataFrame, values: dict[str, Column], how: str) -> dict[str, tuple[float, float]]:
    """(shift, divisor) per column; a constant column gets divisor 1."""
    if not values:
        return {}
    first, second = (F.avg, F.stddev_pop) if how == "standard" else (F.min, F.max)
    row = df.agg(*[e for c in values.values() for e in (first(c), second(c))]).first()
    facts = {}
    for i, name in enumerate(values):
        shift, other = row[2 * i], row[2 * i + 1]
        if shift is None:
            facts[name] = (0.0, 1.0)
            continue
        width = other if how == "standard" else other - shift
        # rounding noise of a constant column is not a spread
        constant = width <= 1e-12 * max(1.0, abs(shift))
        facts[name] = (float(shift), 1.0 if constant else float(width))
    return facts


def standardize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0."""
    return _scaled(df, columns, "standard")


def minmax(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column becomes 0."""
    return _scaled(df, columns, "minmax")


def _scaled(df: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    values = {c: cell(df, c).cast("double") for c in columns}
    facts = _scale_facts(df, values, how)
    return df.withColumns({c: (v - F.lit(facts[c][0])) / F.lit(facts[c][1]) for c, v in values.items()})


# ---- datetime -------------------------------------------------------------

def feature_timestamp(column: Column, data_type: T.DataType, formats: Sequence[str] = ()) -> Column:
    """Timestamp of a cell; a time-only text falls on the stand-in date, as does a bad one."""
    stand_in = F.to_timestamp(F.lit(MISSING_DATE))
    if not isinstance(data_type, T.StringType):
        return F.coalesce(column.cast("timestamp"), stand_in)
    text = F.trim(column)
    time_only = text.contains(":") & ~text.contains("-")
    clock = F.try_to_timestamp(F.concat(F.lit(MISSING_DATE + " "), text), F.lit("yyyy-MM-dd H:m:s"))
    return F.coalesce(F.when(time_only, clock).otherwise(to_timestamp(text, data_type, formats)), stand_in)


def datetime_parts(df: DataFrame, column: str, formats: Sequence[str] = ()) -> DataFrame:
    """Replace a datetime column by day, month, year, hour, minute and second."""
    stamp = feature_timestamp(F.col(f"`{column}`"), df.schema[column].dataType, formats)
    parts = [getattr(F, p)("_ts").alias(f"{column}_{p}") for p in DATETIME_PARTS]
    return df.withColumn("_ts", stamp).select(
        *[F.col(f"`{c}`") for c in df.columns if c != column], *parts
    )


# ---- categories -----------------------------------------------------------

def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, value, n, code): every text of each column numbered in sorted order.

    Missing cells are the class 'nan'. A small dictionary is numbered by a window
    per column; a large one by range partitions, so none is sorted in one task.
    """
    cells = F.array(*[
        F.struct(F.lit(c).alias("col"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias("value"))
        for c in columns
    ])
    counts = cut(df.select(F.inline(cells)).groupBy("col", "value").agg(F.count(F.lit(1)).alias("n")), "dictionary")
    if bounded_count(counts, BROADCAST_ROWS) <= BROADCAST_ROWS:
        rank = F.row_number().over(Window.partitionBy("col").orderBy("value")) - 1
        return counts.withColumn("code", rank.cast("double"))
    placed = with_position(counts, ["col", "value"], small=0)
    first = placed.groupBy("col").agg(F.min("position").alias("_first"))  # one row per column
    return placed.join(F.broadcast(first), "col").select(
        "col", "value", "n", (F.col("position") - F.col("_first")).cast("double").alias("code")
    )


def label_encode(df: DataFrame, columns: Sequence[str], codes: DataFrame | None = None) -> DataFrame:
    """Replace each text column by the sorted position of its value, as double."""
    if not columns:
        return df
    codes = codes if codes is not None else cut(dictionary(df, columns), "codes")
    out = df
    for name in columns:
        own = codes.where(F.col("col") == name).select(
            F.col("value"), F.col("n"), F.col("code").alias("_code")
        )
        text = out.withColumn("_text", F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("nan")))
        out = lookup(text, own, "_text", "value", "_code").withColumn(name, F.col("_code")).drop("_text", "_code")
    return out.select(*[F.col(f"`{c}`") for c in df.columns])


def one_hot_columns(df: DataFrame, column: str, categories: Sequence[str] | None = None) -> DataFrame:
    """One 0/1 column per category, sorted, named ``column_value``; unseen values give zeros."""
    if categories is None:
        counts = statistics.value_counts(df, [column]).where("as_text is not null")
        categories = [r.as_text for r in counts.select("as_text").orderBy("as_text").collect()]
    flags = [
        F.coalesce(F.col(f"`{column}`") == v, F.lit(False)).cast("int").alias(f"{column}_{v}") for v in categories
    ]
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], *flags)


def quick_features(df: DataFrame, target: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Every feature as double: texts label-encoded, the rest mean-imputed; target as ``label``.

    A text target is label-encoded, any other target is cast to double; the
    columns in ``keep`` pass through.
    """
    features = [c for c in df.columns if c != target and c not in keep]
    is_text = lambda c: isinstance(df.schema[c].dataType, T.StringType)
    texts = [c for c in features if is_text(c)]
    numbers = [c for c in features if not is_text(c)]
    to_encode = texts + ([target] if target and is_text(target) else [])
    numeric = df.withColumns({
        c: F.unix_micros(F.col(f"`{c}`").cast("timestamp")).cast("double")
        for c in numbers
        if isinstance(df.schema[c].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))
    })
    filled = impute_mean(numeric, numbers)
    encoded = label_encode(filled, to_encode)
    if target:
        encoded = encoded.withColumn(target, F.col(f"`{target}`").cast("double")).withColumnRenamed(target, "label")
    return encoded


# ---- principal components -------------------------------------------------

def fit_pca(df: DataFrame, features: str = "features", k: int | None = None, keep: float = 0.95,
            output: str = "components") -> tuple[PipelineModel, list[float]]:
    """Centred PCA with ``k`` components, or the fewest whose variance ratios exceed ``keep``.

    The covariance needs no centred rows, so sparse vectors stay sparse; the few scores are
    centred instead.
    """
    width = len(df.select(features).first()[0])
    full = PCA(k=k or width, inputCol=features, outputCol="_scores").fit(df)
    centre = StandardScaler(inputCol="_scores", outputCol="_centred", withMean=True, withStd=False).fit(full.transform(df))
    ratios = [float(v) for v in full.explainedVariance]
    if k is None:
        total, k = 0.0, width
        for i, ratio in enumerate(ratios):
            total += ratio
            if total > keep:
                k = i + 1
                break
    kept = VectorSlicer(inputCol="_centred", outputCol=output, indices=list(range(k)))
    tidy = SQLTransformer(statement="SELECT * EXCEPT (_centred, _scores) FROM __THIS__")
    return PipelineModel([full, centre, kept, tidy]), ratios[:k]


# ---- the whole transformer ------------------------------------------------

def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _sql_double(value: float) -> str:
    return f"({float(value)!r}D)"


@F.udf(T.ArrayType(T.StructType([T.StructField("position", T.LongType()), T.StructField("value", T.DoubleType())])))
def _set_slots(vector):
    if vector is None:
        return []
    if isinstance(vector, SparseVector):
        return [(int(i), float(v)) for i, v in zip(vector.indices, vector.values) if v != 0]
    return [(i, float(v)) for i, v in enumerate(vector.values) if v != 0]


@dataclass
class FeatureModel:
    """Fitted transformer: a pipeline, plus a code table for very wide categories.

    ``names`` has an entry per feature; one ``<column>=*`` stands for all values of a wide
    category, of which there are ``widths``. ``name_table`` spells all of them out.
    """

    pipeline: PipelineModel
    codes: DataFrame | None
    wide: list[str]
    names: list[str]
    widths: dict[str, int] = field(default_factory=dict)

    def name_table(self, spark: SparkSession) -> DataFrame:
        """(position, name) of every slot of the feature vector."""
        at, plain, starts = 0, [], []
        for name in self.names:
            if name in self.widths:
                starts.append((name[:-2], at))
            else:
                plain.append((at, name))
            at += self.widths.get(name, 1)
        out = spark.createDataFrame(plain, "position long, name string")
        if starts:
            first = F.broadcast(spark.createDataFrame(starts, "col string, _at long"))
            spelled = self.codes.join(first, "col").select((F.col("_at") + F.col("code")).cast("long"), F.concat("col", F.lit("="), "value"))
            out = out.union(spelled)
        return out

    @staticmethod
    def set_slots(df: DataFrame, *kept: str, features: str = "features") -> DataFrame:
        """(kept..., position, value): one row per slot of a feature vector that is not 0.

        Only these are gone through, so a row costs what it holds and not the width of its vector.
        """
        return df.select(*kept, F.inline(_set_slots(features)))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.wide:
            copies = df.withColumns({f"{c}__code": F.col(f"`{c}`") for c in self.wide})
            renamed = self.codes.withColumn("col", F.concat("col", F.lit("__code")))
            df = label_encode(copies, [f"{c}__code" for c in self.wide], renamed)
        return self.pipeline.transform(df)

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        spark.createDataFrame(
            [(self.wide, self.names, self.widths)], "wide array<string>, names array<string>, widths map<string,int>"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/names")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark, path: str) -> "FeatureModel":
        row = spark.read.parquet(f"{path}/names").first()
        codes = spark.read.parquet(f"{path}/codes") if row.wide else None
        return cls(PipelineModel.load(f"{path}/pipeline"), codes, list(row.wide), list(row.names), dict(row.widths))


def fit_features(df: DataFrame, spec: DatasetSpec, wide_categories: int = BROADCAST_ROWS) -> FeatureModel:
    """Numeric, categorical and datetime features of ``spec``, assembled in that order."""
    numeric, categorical, datetimes = ([c for c in group if c in df.columns] for group in route_columns(spec))
    medians = statistics.medians(df, numeric)
    imputed = {c: F.coalesce(cell(df, c).cast("double"), F.lit(medians[c] or 0.0)) for c in numeric}
    how = "standard" if spec.standardization_necessary else "minmax" if spec.normalization_necessary else None
    facts = _scale_facts(df, imputed, how) if how else {c: (0.0, 1.0) for c in numeric}

    parts, names, widths = ["*"], [], {}
    for i, c in enumerate(numeric):
        shift, width = facts[c]
        value = f"coalesce(nanvl(cast(`{c}` as double), null), {_sql_double(medians[c] or 0.0)})"
        parts.append(f"({value} - {_sql_double(shift)}) / {_sql_double(width)} as _n{i}")
        names.append(c)

    stages: list = []
    small, wide, labels = [], [], {}
    codes = None
    if categorical:
        frequent = statistics.modes(df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in categorical]), categorical)
        fills = {c: m.value for c, m in frequent.items()}
        texts = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), fills.get(c, F.lit(""))).alias(c) for c in categorical])
        codes = cut(dictionary(texts, categorical), "codes")
        sizes = {r.col: r.k for r in codes.groupBy("col").agg(F.count(F.lit(1)).alias("k")).collect()}
        small = [c for c in categorical if sizes.get(c, 0) <= wide_categories]
        wide = [c for c in categorical if c not in small]
        if sum(sizes.get(c, 0) for c in small) > 10 * wide_categories:
            small, wide = [], categorical
        rows = codes.where(F.col("col").isin(small)).orderBy("col", "code").collect() if small else []
        for r in rows:
            labels.setdefault(r.col, []).append(r.value)
        plain = {c: (m.value) for c, m in frequent.items()}
        literals = {}
        if plain:
            row = df.sparkSession.range(1).select(*[v.alias(f"v{i}") for i, v in enumerate(plain.values())]).first()
            literals = dict(zip(plain, row))
        for i, c in enumerate(categorical):
            if c in small:
                parts.append(f"coalesce(cast(`{c}` as string), {_sql_text(literals.get(c, ''))}) as _c{i}")
                names += [f"{c}={v}" for v in labels.get(c, [])]
            else:
                fallback = codes.where((F.col("col") == c) & (F.col("value") == literals.get(c, ""))).first()
                # an unseen value takes the slot after the last one, which the encoder drops
                code = f"coalesce(`{c}__code`, {_sql_double(sizes[c])})"
                parts.append(f"case when `{c}` is null then {_sql_double(fallback.code)} else {code} end as _c{i}")
                names.append(f"{c}=*")
                widths[f"{c}=*"] = sizes[c]
    for i, c in enumerate(datetimes):
        kind = df.schema[c].dataType
        if isinstance(kind, T.StringType):
            tried = [f"try_to_timestamp(trim(`{c}`), {_sql_text(f)})" for f in spec.date_formats or DATE_FORMATS]
            if not spec.date_formats:
                tried.insert(0, f"try_cast(trim(`{c}`) as timestamp)")
            parsed = ", ".join(tried)
            stamp = (
                f"case when `{c}` like '%:%' and `{c}` not like '%-%' then "
                f"try_to_timestamp(concat('{MISSING_DATE} ', trim(`{c}`)), 'yyyy-MM-dd H:m:s') else coalesce({parsed}) end"
            )
        else:
            stamp = f"cast(`{c}` as timestamp)"
        stamp = f"coalesce({stamp}, timestamp'{MISSING_DATE} 00:00:00')"
        parts += [f"cast({p}({stamp}) as double) as _d{i}_{p}" for p in DATETIME_PARTS]
        names += [f"{c}_{p}" for p in DATETIME_PARTS]

    stages.append(SQLTransformer(statement=f"SELECT {', '.join(parts)} FROM __THIS__"))
    encoded = []
    if categorical:
        indexed = [f"_i{i}" for i, c in enumerate(categorical) if c in small]
        if indexed:
            stages.append(StringIndexerModel.from_arrays_of_labels(
                [labels.get(c, [""]) for c in categorical if c in small],
                inputCols=[f"_c{i}" for i, c in enumerate(categorical) if c in small],
                outputCols=indexed, handleInvalid="keep",
            ))
        sources = [f"_i{i}" if c in small else f"_c{i}" for i, c in enumerate(categorical)]
        encoded = [f"_v{i}" for i in range(len(categorical))]
        # keep: one extra slot for unseen values, dropped again by dropLast
        stages.append(OneHotEncoder(inputCols=sources, outputCols=encoded, handleInvalid="keep", dropLast=True)
                      if wide else OneHotEncoder(inputCols=sources, outputCols=encoded, dropLast=True))
    assembled = [f"_n{i}" for i in range(len(numeric))] + encoded + [
        f"_d{i}_{p}" for i in range(len(datetimes)) for p in DATETIME_PARTS
    ]
    output = "_raw" if spec.dimensionality_reduction else "features"
    stages.append(VectorAssembler(inputCols=assembled, outputCol=output))
    scratch = [a for a in assembled] + [f"_c{i}" for i in range(len(categorical))] + [
        f"_i{i}" for i, c in enumerate(categorical) if c in small
    ]
    dropped = ", ".join(f"`{s}`" for s in dict.fromkeys(scratch))
    stages.append(SQLTransformer(statement=f"SELECT * EXCEPT ({dropped}) FROM __THIS__"))

    model = FeatureModel(PipelineModel([]), codes if wide else None, wide, names, widths)
    if wide:
        coded = label_encode(
            df.withColumns({f"{c}__code": F.col(f"`{c}`") for c in wide}), [f"{c}__code" for c in wide],
            codes.withColumn("col", F.concat("col", F.lit("__code"))),
        )
    else:
        coded = df
    fitted = Pipeline(stages=stages).fit(coded)
    if spec.dimensionality_reduction:
        components, ratios = fit_pca(fitted.transform(coded), "_raw", output="features")
        fitted = PipelineModel(fitted.stages + components.stages)
        model.names, model.widths = [f"component_{i}" for i in range(len(ratios))], {}
    model.pipeline = fitted
    return model
