"""Formula front ends: one function per model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions import formula as formulas
from .operators import advanced, neighbors
from .plans import workflow


def _fit(penalty: str):
    def run(formula: str, data: DataFrame, coords: list[str], k: int, key: str = "id", **options) -> workflow.Fit:
        df, design = formulas.build(data, formula)
        renamed = {c: c.replace(":", "_x_").replace(" ", "_") for c in design.columns}
        df = df.withColumnsRenamed({a: b for a, b in renamed.items() if a != b})
        f = workflow.fit(df, design.y, list(renamed.values()), coords, k, penalty, key, **options)
        f.cache["design"] = design
        return f

    run.__name__ = f"gwr_{penalty}"
    run.__doc__ = f"Fit the {penalty} model of a formula."
    return run


gwr, gwr_sl, gwr_lasso, gwr_ridge, gwr_en, gwr_scad, gwr_mcp, lad_gwr_sl = map(_fit, ("gwr", "scaled_lasso", "lasso", "ridge", "elastic_net", "scad", "mcp", "lad"))


def gwr_penalized(formula: str, data: DataFrame, coords: list[str], k: int, penalty: str, **options) -> workflow.Fit:
    """Fit any named penalty of a formula."""
    return _fit(penalty)(formula, data, coords, k, **options)


def gwr_nonconvex(formula: str, data: DataFrame, coords: list[str], k: int, penalty: str = "scad", **options) -> workflow.Fit:
    """Fit SCAD or MCP of a formula."""
    if penalty not in ("scad", "mcp"):
        raise ValueError("penalty must be scad or mcp")
    return _fit(penalty)(formula, data, coords, k, **options)


def gwr_ktdd(formula: str, data: DataFrame, coords: list[str], k: int, operator: DataFrame, source: DataFrame, laplacian: DataFrame | None = None, key: str = "id", **options) -> dict:
    """Fit the process-constrained model of a formula; ``operator`` and ``source`` are those of :func:`advanced.process_model`."""
    df, design = formulas.build(data, formula)
    renamed = {c: c.replace(":", "_x_").replace(" ", "_") for c in design.columns}
    df = df.withColumnsRenamed({a: b for a, b in renamed.items() if a != b})
    edges = neighbors.knn(df, k, coords, key).persist()
    return advanced.process_model(df, design.y, list(renamed.values()), edges, operator, source, laplacian, key=key, **options)
