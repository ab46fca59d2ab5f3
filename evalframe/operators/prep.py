"""Feature preparation learned on training rows only.

Statistics are exact aggregates: the median (interpolated, as NumPy) of numeric
columns, the mode (smallest value on ties) of categorical ones, and the sorted
vocabulary of each categorical column.  All categorical columns share one
``(column, value) -> n`` aggregate, which gives modes and vocabularies.
One-hot drops the first sorted category and maps unknown values to all zeros.

A vocabulary is a table (column, value, position) of any size, ranked by Spark
and joined to the rows; what a row gets is a sparse vector.  Only where the
caller wants one named column per category is the list of names brought to the
driver, and a table of more than ``MAX_COLUMNS`` indicators is refused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, StructType

from evalframe.operators._keys import as_list, join_on_keys
from evalframe.operators.quantiles import wide_quantiles
from evalframe.operators.vocab import dense_positions, with_positions
from evalframe.session import cut_lineage

MAX_COLUMNS = 1000     # named indicator columns of one table; vectors have no limit


def feature_roles(schema: StructType, exclude=()) -> dict[str, str]:
    """P1: 'numeric' (numbers, not booleans), 'categorical' (strings and
    booleans) or 'dropped' (anything else) for each column."""
    ex = set(as_list(exclude))
    out = {}
    for f in schema.fields:
        if f.name in ex:
            continue
        t = f.dataType
        if isinstance(t, BooleanType) or isinstance(t, StringType):
            out[f.name] = "categorical"
        elif isinstance(t, NumericType):
            out[f.name] = "numeric"
        else:
            out[f.name] = "dropped"
    return out


@dataclass
class PrepModel:
    keys: list
    numeric: list
    categorical: list
    stats: DataFrame                      # keys + med_<c> / mode_<c>
    index: DataFrame | None = None        # (column, value, position), stored
    sizes: dict = field(default_factory=dict)   # column -> number of categories

    def vocabulary(self) -> dict:
        """Sorted categories of each column, for naming indicator columns."""
        if sum(self.sizes.values()) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} indicator columns {self.sizes}: use vectors")
        out = {c: [] for c in self.sizes}
        for r in self.index.orderBy("column", "position").collect() if self.sizes else []:
            out[r["column"]].append(r["value"])
        return out


def _cat_text(df: DataFrame, c: str) -> Column:
    t = df.schema[c].dataType
    return F.col(c).cast("int").cast("string") if isinstance(t, BooleanType) else F.col(c).cast("string")


def fit_prep(train: DataFrame, numeric=(), categorical=(), keys=(), one_hot: bool = True) -> PrepModel:
    """M1-M3 fit: medians, modes and vocabularies from ``train`` only.

    ``train`` is read three times (two passes of the medians, one of the
    categories); hand in a stored split (``folds.fold_split`` gives one)."""
    keys, numeric, categorical = as_list(keys), as_list(numeric), as_list(categorical)
    if one_hot and categorical and keys:
        raise ValueError("one-hot vocabularies are fitted per training set: call once per fold")
    parts = []
    if numeric:
        parts.append(wide_quantiles(train, keys, numeric, [0.5], ["med_{col}"]))
    counts = None
    if categorical:
        long = train.select(*keys, *[_cat_text(train, c).alias(c) for c in categorical]).unpivot(
            keys, categorical, "column", "value")
        counts = cut_lineage(long.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("n")))
        seen = F.col("value").isNotNull()
        best = F.min_by(F.when(seen, F.col("value")), F.when(seen, F.struct((-F.col("n")).alias("neg"), F.col("value"))))
        modes = counts.groupBy(*keys, "column").agg(best.alias("mode"))
        parts.append(modes.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"mode_{c}")
                                                for c in categorical]))
    stats = parts[0] if parts else train.select(*keys).distinct()
    for p in parts[1:]:
        stats = join_on_keys(stats, p, keys)
    # one row per fit group; every later use reads what is written here
    model = PrepModel(keys, numeric, categorical, cut_lineage(stats))
    if one_hot and categorical:
        # the imputed value (the mode) is itself an observed value, so the
        # vocabulary after imputation is the set of observed non-null values
        model.index = cut_lineage(dense_positions(counts.where(F.col("value").isNotNull()).select("column", "value"),
                                                  ["column"], ["value"]))
        found = {r["column"]: r["n"] for r in model.index.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
        model.sizes = {c: found.get(c, 0) for c in categorical}
    return model


def onehot_name(col: str, value: str) -> str:
    return f"{col}_{value}"


def _filled(model: PrepModel, df: DataFrame, keep) -> DataFrame:
    """M1, M2: ``keep`` + numeric columns as doubles + categorical ones as text, imputed."""
    j = join_on_keys(df, model.stats, model.keys)
    num = [F.coalesce(F.col(c).cast("double"), F.col(f"med_{c}")).alias(c) for c in model.numeric]
    cats = [F.coalesce(_cat_text(df, c), F.col(f"mode_{c}")).alias(c) for c in model.categorical]
    return j.select(*model.keys, *keep, *num, *cats)


def apply_prep(model: PrepModel, df: DataFrame, keep=()) -> DataFrame:
    """M1-M3 apply with named columns: impute with the training statistics, then one-hot with
    drop-first; numeric columns first, then the indicator columns (M4 order)."""
    keep = as_list(keep)
    out = _filled(model, df, keep)
    if model.index is None:
        return out
    ind = [F.when(F.col(c) == F.lit(v), 1.0).otherwise(0.0).alias(onehot_name(c, v))
           for c, values in model.vocabulary().items() for v in values[1:]]
    return out.select(*model.keys, *keep, *[F.col(c) for c in model.numeric], *ind)


def encode_features(model: PrepModel, df: DataFrame, keep=(), out: str = "features") -> DataFrame:
    """M1-M4 apply: ``keep`` + one sparse vector: numeric columns, then for each categorical
    column its categories but the first, in order.  Vocabularies of any size; the first
    category and values unknown to the training rows have no entry."""
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    keep = as_list(keep)
    rows = _filled(model, df, keep)
    cats = [c for c in model.categorical if model.sizes.get(c, 0) > 1]
    if cats:
        rows = with_positions(rows, model.index, cats, "__p_")
        # the encoder drops the last of k slots: it takes the first category and the unknown ones
        slot = lambda c: F.when(F.col(f"__p_{c}") > 0, F.col(f"__p_{c}") - 1).otherwise(model.sizes[c] - 1)
        rows = rows.withColumns({f"__s_{c}": slot(c).cast("double") for c in cats})
        sizes = df.sparkSession.createDataFrame([tuple(float(model.sizes[c] - 1) for c in cats)],
                                                ", ".join(f"`__s_{c}` double" for c in cats))
        encoder = OneHotEncoder(inputCols=[f"__s_{c}" for c in cats], outputCols=[f"__v_{c}" for c in cats])
        rows = encoder.fit(sizes).transform(rows)
    inputs = [*model.numeric, *[f"__v_{c}" for c in cats]]
    return VectorAssembler(inputCols=inputs, outputCol=out, handleInvalid="error").transform(rows).select(
        *model.keys, *keep, out)


def feature_columns(model: PrepModel) -> list[str]:
    """M4: output feature order of ``apply_prep``: numeric first, then categorical indicators."""
    names = model.vocabulary() if model.index is not None else {}
    return list(model.numeric) + [onehot_name(c, v) for c, values in names.items() for v in values[1:]]


def assemble(df: DataFrame, cols, out: str = "features") -> DataFrame:
    """M4: one vector column for Spark ML, in the given column order."""
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error").transform(df)
