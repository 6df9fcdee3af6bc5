"""What an evaluation shows: lines of text, a page of neighbours, the order of leaves in a plot. All of it is small, on the driver."""

from __future__ import annotations

import html

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics


def text(judged: DataFrame, names: dict[int, str], by: str = "dataset") -> str:
    """Accuracies over all datasets and the confusion matrix of rows (by, truth, pred), one line each; as many as there are labels."""
    labels = sorted(names)
    acc = metrics.pooled(judged, labels, by).first()
    cells = {(r["truth"], r["pred"]): r["n"] for r in metrics.confusion(judged, labels).collect()}
    width = max(len(n) for n in names.values())
    lines = [f"{k}: {acc[k]:.3f}" if acc[k] is not None else f"{k}: -" for k in ("sample_acc", "label_acc", "set_acc")]
    return "\n".join([*lines, *[f"{names[t]:<{width}} " + " ".join(f"{cells[t, p]:>8}" for p in labels) for t in labels]]) + "\n"


def page(report: DataFrame, rows: int, title: str = "Neighbours") -> str:
    """A page with the first `rows` rows of a report in the order of dataset and id; its length is bounded by that number."""
    cell = lambda *xs: "<td>" + "<br>".join(html.escape(str(x)) for x in xs) + "</td>"
    lines = []
    for r in report.orderBy("dataset", "id").limit(rows).collect():
        near = "".join(cell(n["id"], f"{n['d']:.3f}", n["prediction"], n["propagated"], n["truth"]) for n in r["neighbours"] or [])
        lines.append(f"<tr>{cell(r['id'], r['prediction'], r['propagated'], r['truth'])}{near}</tr>")
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table>{''.join(lines)}</table>\n"


def leaves(square: np.ndarray) -> list[int]:
    """Order of the rows of a small matrix as leaves of average linkage over their Euclidean distances; of a pair the older cluster comes first."""
    x = np.asarray(square, float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    groups = {i: [i] for i in range(len(x))}
    while len(groups) > 1:
        keys = sorted(groups)
        gap = {(a, b): d[np.ix_(groups[a], groups[b])].mean() for k, a in enumerate(keys) for b in keys[k + 1 :]}
        a, b = min(gap, key=lambda p: (gap[p], p))
        groups[max(keys) + 1 if max(keys) >= len(x) else len(x)] = groups.pop(a) + groups.pop(b)
    return next(iter(groups.values()), [])


def copies(table: DataFrame, columns: list[str], source: str, target: str) -> DataFrame:
    """(source, target) of all files that the columns name, for a tool that copies them."""
    names = table.select(F.explode(F.array(*columns)).alias("n")).where("n is not null").distinct()
    return names.select(F.concat(F.lit(source.rstrip("/") + "/"), "n").alias("source"), F.concat(F.lit(target.rstrip("/") + "/"), "n").alias("target"))
