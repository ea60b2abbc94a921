"""Command line: ``python -m partonframe.cli Algorithm "{'DeltaR': 0.4}" E px py pz PT y phi ...`` prints a merge sequence."""

from __future__ import annotations

import ast
import sys

import numpy as np

from .operators.cluster import KERNELS
from .operators.kernels.physics import Nodes
from .plans.params import check_params

#: Columns of a particle on the command line.
COLUMNS = ["energy", "px", "py", "pz", "pt", "rapidity", "phi"]


def parse_input(words: list[str]) -> tuple[str, dict, np.ndarray]:
    """(algorithm, parameters, rows of particles); the parameters end with the first word that ends with a brace."""
    end = next(i for i, w in enumerate(words) if w.endswith("}"))
    values = [float(w) for w in words[end + 1 :]]
    if len(values) % len(COLUMNS):
        raise ValueError(f"a particle has {len(COLUMNS)} numbers")
    return words[0], ast.literal_eval(" ".join(words[1 : end + 1])), np.array(values, float).reshape(-1, len(COLUMNS))


def get_sequence(algorithm: str, params: dict, rows: np.ndarray) -> tuple[list[int], list[list[int]], list[int]]:
    """(input labels, merges [child, child, label], labels of the roots)."""
    if not len(rows):
        return [], [], []
    energy, px, py, pz, pt, y, phi = rows.T
    checked = check_params(algorithm, params)
    if algorithm.startswith("Spectral"):
        checked.pop("PhyDistance")
    _, ints, _ = KERNELS[algorithm](Nodes(px, py, pz, energy, pt, y, phi), **checked).table()
    merged = ints[ints[:, 2] >= 0]
    merged = merged[np.argsort(merged[:, 0])]
    return list(range(len(rows))), merged[:, [2, 3, 0]].tolist(), sorted(ints[ints[:, 1] < 0, 0].tolist())


def format_sequence(labels: list[int], merges: list[list[int]], remaining: list[int]) -> str:
    listed = lambda x: " ".join(["[", *map(str, x), "]"])
    return f"input_labels {listed(labels)} cluster_sequence {' '.join(['[', *map(listed, merges), ']'])} remaining {listed(remaining)}"


def main(words: list[str] | None = None) -> None:
    words = sys.argv[1:] if words is None else words
    print(format_sequence(*(get_sequence(*parse_input(words)) if words else ([], [], []))))


if __name__ == "__main__":
    main()
