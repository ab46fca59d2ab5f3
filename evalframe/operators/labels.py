"""Label handling: canonical text labels (P2 helpers), positive-label
resolution per run (P3, V8), binary target encoding and decoding (P4, P5),
positive-class probability (P6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from evalframe.operators._keys import as_list, join_on_keys

# Labels taken as the positive class, in priority order, when
# the label set is not numeric or does not contain 1.
POSITIVE_CANDIDATES = (
    ">50K", ">50K.", "yes", "Yes", "YES", "true", "True", "TRUE",
    "positive", "Positive", "POSITIVE",
)


def label_is_numeric(df: DataFrame, col: str) -> bool:
    """True when the source column is numeric or boolean (then the value 1 wins)."""
    t = df.schema[col].dataType
    return isinstance(t, (NumericType, BooleanType))


def canonical_label(df: DataFrame, col: str) -> Column:
    """Text form of a label column: booleans become '0'/'1', numbers their text."""
    t = df.schema[col].dataType
    c = F.col(col)
    if isinstance(t, BooleanType):
        c = c.cast("int")
    return c.cast("string")


def canonical_predictions(preds: DataFrame, label_cols=("y_true", "y_pred")) -> tuple[DataFrame, bool]:
    """Cast label columns to canonical text; return the frame and whether the
    labels came from a numeric source."""
    present = [c for c in label_cols if c in preds.columns]
    numeric = label_is_numeric(preds, label_cols[0])
    # numbers of different types (1 and 1.0) are compared by value
    mixed = all(label_is_numeric(preds, c) for c in present) and len({preds.schema[c].dataType for c in present}) > 1
    out = preds
    for c in present:
        out = out.withColumn(c, _number_text(preds, c) if mixed else canonical_label(preds, c))
    return out, numeric


def _number_text(df: DataFrame, col: str) -> Column:
    """The same text for the same number, whatever its type."""
    c = F.col(col).cast("int") if isinstance(df.schema[col].dataType, BooleanType) else F.col(col)
    d = c.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < F.lit(2.0 ** 53))
    return F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))


def positive_labels(df: DataFrame, keys, numeric: bool, label_cols=("y_true", "y_pred"),
                    on_invalid: str = "error", weight: str | None = None) -> DataFrame:
    """P3 + V8: one row per run with ``n_labels``, ``positive_label``,
    ``negative_label``.  ``weight``: a column of row counts (of a table of counts).

    Labels are the union of the label columns; a missing label counts as one
    more.  Exactly two are required: ``on_invalid='error'`` fails the job naming the run, ``'null'``
    returns NULL labels for that run, ``'keep'`` returns the row as is.
    Rule: with a numeric source the label equal to 1 wins; else the first
    entry of ``POSITIVE_CANDIDATES`` present; else the larger label (numeric
    order for numeric sources, text order otherwise).
    """
    keys = as_list(keys)
    rows = F.col(weight) if weight else F.lit(1)
    stacked = df.select(*keys, rows.alias("_n"), F.explode(F.array(*[F.col(c) for c in label_cols])).alias("label"))
    # partial aggregation collapses the rows to distinct labels per task
    distinct = stacked.groupBy(*keys, "label").agg(F.sum("_n").alias("_n"))
    cands = F.array(*[F.lit(x) for x in POSITIVE_CANDIDATES])
    rank = F.array_position(cands, F.col("label"))
    as_num = F.col("label").try_cast("double")
    aggs = [
        F.count(F.lit(1)).alias("n_labels"), (F.sum("_n") / len(label_cols)).cast("long").alias("n_rows"),
        F.min(F.when(rank > 0, rank)).alias("_rank"),
        F.max("label").alias("_max_text"),
        F.min("label").alias("_min_text"),
    ]
    if numeric:
        aggs += [F.min(F.when(as_num == 1.0, F.col("label"))).alias("_one"),
                 F.max_by(F.col("label"), as_num).alias("_max_num")]
    per_run = distinct.groupBy(*keys).agg(*aggs)
    fallback = F.col("_max_num") if numeric else F.col("_max_text")
    # guarded: element_at(literal array, NULL) yields the last element in Spark 4.1
    pos = F.when(F.col("_rank").isNotNull(), F.element_at(cands, F.col("_rank").cast("int")))
    if numeric:
        pos = F.coalesce(F.col("_one"), pos, fallback)
    else:
        pos = F.coalesce(pos, fallback)
    per_run = per_run.withColumn("positive_label", pos).withColumn(
        "negative_label",
        F.when(F.col("positive_label") == F.col("_max_text"), F.col("_min_text")).otherwise(F.col("_max_text")))
    ok = F.col("n_labels") == 2
    if on_invalid == "error":
        msg = F.concat(F.lit("binary metrics need exactly two labels; run "),
                       F.to_json(F.struct(*keys)) if keys else F.lit("(all)"),
                       F.lit(" has "), F.col("n_labels").cast("string"), F.lit(" in "), F.col("n_rows").cast("string"),
                       F.lit(" rows"))
        per_run = per_run.withColumn("positive_label",
                                     F.when(ok, F.col("positive_label")).otherwise(F.raise_error(msg).cast("string")))
    elif on_invalid == "null":
        per_run = (per_run.withColumn("positive_label", F.when(ok, F.col("positive_label")))
                   .withColumn("negative_label", F.when(ok, F.col("negative_label"))))
    return per_run.select(*keys, "n_labels", "positive_label", "negative_label")


def check_binary(preds: DataFrame, keys, label_cols=("y_true", "y_pred")) -> DataFrame:
    """V8: runs whose label union does not have exactly two values."""
    canon, numeric = canonical_predictions(preds, label_cols)
    labels = positive_labels(canon, keys, numeric, label_cols, on_invalid="keep")
    return labels.where(F.col("n_labels") != 2).select(*as_list(keys), "n_labels")


def encode_target(train: DataFrame, other: DataFrame | None, keys, label: str = "y_true",
                  out: str = "label") -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """0/1 encoding learned on ``train`` only, per run: the smaller label
    (text order) is 0, the larger is 1.  A run with other than two training
    labels, or a label in ``other`` unseen in training, fails the job.
    Returns (encoded train, encoded other, mapping per run)."""
    keys = as_list(keys)
    canon = train.withColumn(label, canonical_label(train, label))
    mapping = (canon.where(F.col(label).isNotNull()).select(*keys, label).distinct()
               .groupBy(*keys).agg(F.count(F.lit(1)).alias("n_classes"),
                                   F.min(label).alias("label_0"), F.max(label).alias("label_1")))
    mapping = mapping.withColumn(
        "label_1", F.when(F.col("n_classes") == 2, F.col("label_1")).otherwise(
            F.raise_error(F.concat(F.lit("target must have two classes, found "),
                                   F.col("n_classes").cast("string"))).cast("string")))

    def _apply(df: DataFrame) -> DataFrame:
        d = df.withColumn(label, canonical_label(df, label))
        j = join_on_keys(d, mapping.select(*keys, "label_0", "label_1"), keys)
        enc = (F.when(F.col(label) == F.col("label_1"), F.lit(1.0))
               .when(F.col(label) == F.col("label_0"), F.lit(0.0))
               .otherwise(F.raise_error(F.concat(F.lit("unseen label: "), F.col(label))).cast("double")))
        return j.withColumn(out, enc).drop("label_0", "label_1")

    return _apply(train), (_apply(other) if other is not None else None), mapping


def decode_predictions(df: DataFrame, mapping: DataFrame, keys, pred: str = "prediction",
                       out: str = "y_pred") -> DataFrame:
    """P5: map 0/1 model output back to the original labels of the run."""
    keys = as_list(keys)
    j = join_on_keys(df, mapping.select(*keys, "label_0", "label_1"), keys)
    return j.withColumn(out, F.when(F.col(pred) == 1.0, F.col("label_1")).otherwise(F.col("label_0"))) \
            .drop("label_0", "label_1")


def positive_probability(df: DataFrame, probability: str = "probability", out: str = "y_prob") -> DataFrame:
    """Probability of the class encoded as 1 (second sorted class) from a
    Spark ML probability vector; NULL unless the vector has two entries."""
    from pyspark.ml.functions import vector_to_array
    arr = vector_to_array(F.col(probability))
    return df.withColumn(out, F.when(F.size(arr) == 2, arr[1]))
