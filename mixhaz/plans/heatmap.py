"""Heatmap of coefficients by subgroup, written as SVG."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import escape

import numpy as np

from mixhaz.operators.scaling import InputError
from mixhaz.plans.model import MixtureModel

# The two ends of the diverging palette.
LOW, HIGH = (0x21, 0x66, 0xAC), (0xB2, 0x18, 0x2B)


def shade(x: float) -> str:
    """Blue for negative, white for zero, red for positive; x in [-1, 1]."""
    end, t = (HIGH if x > 0 else LOW), min(abs(x), 1.0)
    return "#" + "".join(f"{round(255 + (e - 255) * t):02X}" for e in end)


def beta_heatmap(beta, output_file: str | None = None, rows: Sequence[str] | None = None, columns: Sequence[str] | None = None,
                 title: str = "Cox coefficients by subgroup (per SD)", width: int = 560, height: int = 500) -> np.ndarray:
    """Return the plotted matrix (features x clusters) and write it to `output_file` (.svg) if given.

    Limits are symmetric at the largest absolute value; rows read from the top down.
    """
    if isinstance(beta, MixtureModel):
        rows, columns = beta.hazard_vars, beta.clusters
        beta = beta.beta_scaled
    m = np.atleast_2d(np.asarray(beta, float))
    if output_file is None:
        return m
    if not output_file.lower().endswith(".svg"):
        raise InputError("The heatmap is written as SVG; give a file name ending in .svg.")
    nr, nc = m.shape
    rows = list(rows or [f"row {i + 1}" for i in range(nr)])
    columns = list(columns or [f"C{j + 1}" for j in range(nc)])
    left, top = 20 + 7 * max(len(r) for r in rows), 50
    cw, ch = (width - left - 20) / nc, (height - top - 40) / nr
    peak = max(float(np.abs(m).max()), 1e-8)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="12">',
           f'<text x="{width / 2}" y="25" text-anchor="middle" font-size="14">{escape(title)}</text>']
    for i in range(nr):
        y = top + i * ch
        out.append(f'<text x="{left - 8}" y="{y + ch / 2 + 4}" text-anchor="end">{escape(rows[i])}</text>')
        for j in range(nc):
            x = left + j * cw
            out.append(f'<rect x="{x}" y="{y}" width="{cw}" height="{ch}" fill="{shade(m[i, j] / peak)}" stroke="#fff"/>')
            out.append(f'<text x="{x + cw / 2}" y="{y + ch / 2 + 4}" text-anchor="middle">{m[i, j]:.2f}</text>')
    for j in range(nc):
        out.append(f'<text x="{left + (j + 0.5) * cw}" y="{height - 18}" text-anchor="middle">{escape(columns[j])}</text>')
    out.append("</svg>")
    with open(output_file, "w", encoding="utf-8") as f:
        f.write("\n".join(out))
    return m
