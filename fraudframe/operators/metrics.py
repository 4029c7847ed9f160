"""Binary classification metrics (survey 2.I): ONE aggregate (four
``count_if``) and column arithmetic, a one-row DataFrame of 22 doubles.

``convention="standard"``: positive class = 1 (TP = label 1 predicted 1).
``convention="reference"``: the original service's table, which takes the
class-0 cell of the confusion matrix as TP and mixes it with library scores
computed for class 1 (see README, "Metrics").
"""
from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudframe.functions.columns import safe_div

# Metric column names and order of the metrics table.
METRIC_COLUMNS = ["TP", "FP", "TN", "FN", "sensitivity", "specificity", "accuracy", "balanced_accuracy",
                  "prec", "recall", "PPV", "NPV", "FNR", "FPR", "FDR", "F_OR", "f1", "f_05", "f2", "MCC",
                  "ROCAUC", "Youdens_statistic"]


def confusion_counts(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """c00, c01, c10, c11 (cRC = true class R predicted C) in one pass."""
    y, p = F.col(label).cast("int"), F.col(prediction).cast("int")
    return df.agg(*[F.count_if((y == r) & (p == c)).cast("double").alias(f"c{r}{c}") for r in (0, 1) for c in (0, 1)])


def _mcc(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    den = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return safe_div(tp * tn - fp * fn, den)


def _fbeta_reference(beta: float, p: Column, r: Column) -> Column:
    return safe_div((1 + beta) * (1 + beta) * p * r, beta * beta * p + r)


def _fbeta(beta: float, p: Column, r: Column) -> Column:
    return safe_div((1 + beta * beta) * p * r, beta * beta * p + r)


def metrics_from_counts(counts: DataFrame, convention: str = "standard") -> DataFrame:
    c00, c01, c10, c11 = (F.col(c) for c in ("c00", "c01", "c10", "c11"))
    n = c00 + c01 + c10 + c11
    # class-1 scores as a library computes them (positive = 1)
    tpr = safe_div(c11, c11 + c10)
    tnr = safe_div(c00, c00 + c01)
    accuracy = safe_div(c00 + c11, n)
    balanced = (tpr + tnr) / 2
    f1 = safe_div(2 * c11, 2 * c11 + c01 + c10)
    if convention == "standard":
        tp, fp, fn, tn = c11, c01, c10, c00
        prec = safe_div(tp, tp + fp)
        cols = {
            "TP": tp, "FP": fp, "TN": tn, "FN": fn,
            "sensitivity": tpr, "specificity": tnr, "accuracy": accuracy, "balanced_accuracy": balanced,
            "prec": prec, "recall": tpr, "PPV": prec, "NPV": safe_div(tn, tn + fn),
            "FNR": safe_div(fn, fn + tp), "FPR": safe_div(fp, fp + tn), "FDR": safe_div(fp, fp + tp),
            "F_OR": safe_div(fn, fn + tn), "f1": f1, "f_05": _fbeta(0.5, prec, tpr), "f2": _fbeta(2.0, prec, tpr),
            "MCC": _mcc(tp, fp, tn, fn), "ROCAUC": balanced, "Youdens_statistic": tpr + tnr - 1,
        }
    elif convention == "reference":
        tp, fp, fn, tn = c00, c01, c10, c11
        sens = safe_div(tp, tp + fn)
        spec = safe_div(tn, tn + fp)
        prec = safe_div(tp, tp + fp)
        cols = {
            "TP": tp, "FP": fp, "TN": tn, "FN": fn,
            "sensitivity": sens, "specificity": spec, "accuracy": accuracy, "balanced_accuracy": balanced,
            "prec": prec, "recall": tpr, "PPV": safe_div(tp, tp + fn), "NPV": safe_div(tn, tn + fn),
            "FNR": safe_div(fn, fn + tp), "FPR": safe_div(fp, fp + tn), "FDR": safe_div(fp, fp + tp),
            "F_OR": safe_div(fn, fn + tn), "f1": f1, "f_05": _fbeta_reference(0.5, prec, tpr),
            "f2": _fbeta_reference(2.0, prec, tpr), "MCC": _mcc(tp, fp, tn, fn), "ROCAUC": balanced,
            "Youdens_statistic": sens + spec - 1,
        }
    else:
        raise ValueError(f"unknown convention {convention!r}")
    return counts.select(*[cols[c].cast("double").alias(c) for c in METRIC_COLUMNS])


def binary_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                   convention: str = "standard") -> DataFrame:
    """One-row DataFrame with the 22 metric columns."""
    return metrics_from_counts(confusion_counts(df, label, prediction), convention)


def score_auc(df: DataFrame, label: str = "label", score: str = "positive_probability") -> float:
    """Area under the ROC curve of the scores, every score a point of the curve
    (``ROCAUC`` of the metrics table is that of the 0/1 predictions)."""
    rows = df.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score"))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0).evaluate(rows)


def metrics_sql(src: str, label: str, prediction: str, convention: str = "standard") -> str:
    """The same metrics as SQL text (used as the oracle)."""
    def div(a, b):
        return f"COALESCE(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END, 0.0)"

    counts = ", ".join(f"CAST(count_if({label} = {r} AND {prediction} = {c}) AS DOUBLE) AS c{r}{c}"
                       for r in (0, 1) for c in (0, 1))
    tpr, tnr = div("c11", "c11 + c10"), div("c00", "c00 + c01")
    acc = div("c00 + c11", "c00 + c01 + c10 + c11")
    bal = f"(({tpr}) + ({tnr})) / 2"
    f1 = div("2 * c11", "2 * c11 + c01 + c10")
    if convention == "standard":
        tp, fp, fn, tn = "c11", "c01", "c10", "c00"
        prec = div(tp, f"{tp} + {fp}")
        fb = lambda b: div(f"{1 + b * b} * ({prec}) * ({tpr})", f"{b * b} * ({prec}) + ({tpr})")
        sens, spec, ppv, youden = tpr, tnr, prec, f"({tpr}) + ({tnr}) - 1"
    else:
        tp, fp, fn, tn = "c00", "c01", "c10", "c11"
        prec = div(tp, f"{tp} + {fp}")
        fb = lambda b: div(f"{(1 + b) * (1 + b)} * ({prec}) * ({tpr})", f"{b * b} * ({prec}) + ({tpr})")
        sens, spec = div(tp, f"{tp} + {fn}"), div(tn, f"{tn} + {fp}")
        ppv, youden = div(tp, f"{tp} + {fn}"), f"({sens}) + ({spec}) - 1"
    mcc = div(f"{tp} * {tn} - {fp} * {fn}",
              f"sqrt({tp} + {fp}) * sqrt({tp} + {fn}) * sqrt({tn} + {fp}) * sqrt({tn} + {fn})")
    exprs = {
        "TP": tp, "FP": fp, "TN": tn, "FN": fn, "sensitivity": sens, "specificity": spec, "accuracy": acc,
        "balanced_accuracy": bal, "prec": prec, "recall": tpr, "PPV": ppv, "NPV": div(tn, f"{tn} + {fn}"),
        "FNR": div(fn, f"{fn} + {tp}"), "FPR": div(fp, f"{fp} + {tn}"), "FDR": div(fp, f"{fp} + {tp}"),
        "F_OR": div(fn, f"{fn} + {tn}"), "f1": f1, "f_05": fb(0.5), "f2": fb(2.0), "MCC": mcc, "ROCAUC": bal,
        "Youdens_statistic": youden,
    }
    sel = ", ".join(f"CAST({exprs[c]} AS DOUBLE) AS {c}" for c in METRIC_COLUMNS)
    return f"SELECT {sel} FROM (SELECT {counts} FROM ({src}) s) c"
