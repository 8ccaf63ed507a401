"""Methods as data: which representations a run evaluates, branch by branch."""

from __future__ import annotations

from dataclasses import dataclass, field

from fathom.operators.sampling import BASELINE_SEEDS

#: Base methods; a name ending in ``*`` stands for one method for each baseline seed.  Fixed values.
COMMON = (
    "all_raw", "last_raw", "fixed4_raw", "fixed4_pca", "all_pca", "chosen_raw", "chosen_pca", "chosen_random*", "random4_raw*", "random_count_raw*", "all_random*",
)
PER_OBJECTIVE = {
    "matching": ("main", "main_uniform", "all_support", "all_uniform", "fixed4_support", "fixed4_uniform", "last_support", "no_nuisance", "no_divergence", "no_score", "no_polish", "random_count_support*"),
    "local": ("main", "main_uniform", "all_support", "all_uniform", "fixed4_support", "fixed4_uniform", "last_support", "no_nuisance", "no_rank", "random_count_support*"),
    "gram": ("main", "main_uniform", "all_support", "all_uniform", "fixed4_support", "no_nuisance", "random_count_support*"),
}
MODES = {"l2": "layer_l2_", "none": "raw_input_"}


@dataclass(frozen=True)
class Branch:
    """One objective on one input normalisation; its methods carry its prefix."""

    objective: str
    mode: str
    prefix: str
    methods: tuple[str, ...] = field(default=())


def expand(names: tuple[str, ...], seeds=BASELINE_SEEDS) -> list[str]:
    out = [f"{n[:-1]}_seed{s}" for n in names if n.endswith("*") for s in seeds] + [n for n in names if not n.endswith("*")]
    if len(set(out)) != len(out):
        raise ValueError("a method is listed twice")
    return out


def branches(objectives=("matching", "local", "gram"), modes=("l2", "none"), primary=("matching", "l2")) -> list[Branch]:
    """A branch for every objective and mode; the primary one has no prefix."""
    out = []
    for mode in modes:
        for objective in objectives:
            prefix = "" if (objective, mode) == primary else f"{MODES[mode]}{objective}_"
            out.append(Branch(objective, mode, prefix, tuple(expand(COMMON + PER_OBJECTIVE[objective]))))
    if len({b.prefix for b in out}) != len(out):
        raise ValueError("two branches share a prefix")
    return out


def roster(found: list[Branch]) -> list[str]:
    names = [b.prefix + m for b in found for m in b.methods]
    if len(set(names)) != len(names):
        raise ValueError("two branches name the same method")
    return names


def task_plan(seeds: list[int], datasets: list[str], gate: tuple[int, str] | None = None) -> list[tuple[int, str]]:
    """(seed, dataset) tasks with the gate task first."""
    tasks = [(s, d) for s in seeds for d in datasets]
    gate = gate or tasks[0]
    return [gate, *(t for t in tasks if t != gate)]
