"""Run settings: defaults per task, strict checks, versioned JSON form."""

from __future__ import annotations

import math

VERSION = 1

# Defaults, ranges and choices of every setting.
LOOP = {"max_rounds": (None, int, 1, 1_000_000), "stop_ratio": (0.005, float, 0, 0.999999)}
JOIN = {
    "projections": (16, int, 1, 64), "window": (8, int, 1, 64), "cap": (32, int, 2, 128),
    "representatives": (2, int, [1, 2, 4]), "landmarks": (32, int, 2, 512), "ann_k": (16, int, 1, 64),
    "ann_rounds": (2, int, 0, 8), "terminal_limit": (512, int, 4, 512), "minimum_divisor": (514, int, 4, 4096),
    "seed": (20260934, int, 0, 2**32 - 1), "distance_model": (3, int, [1, 2, 3]),
}
STAGES = {
    "distance": {"max_rounds": (4, int, 1, 1_000_000), "stop_ratio": (0.0, float, 0, 0.999999),
                 "representatives": (4, int, 1, 4), "min_gain": (0.0, float, 0, 1e6)},
    "mlp": {**LOOP, "representatives": (4, int, 1, 4), "min_margin": (0.10, float, 0, 1)},
    "likelihood": {**LOOP, "model": ("GTR+FO+I+G4", str, ["GTR+FO+I+G4", "GTR+I+G4", "GTR+G4", "HKY+G4", "GTR", "SYM",
                                                          "TN93", "HKY", "K80", "F81", "JC"]),
                   "min_gain": (0.001, float, 0, 1e6), "optimizer_iterations": (32, int, 1, 1024)},
    "kernel": {**LOOP, "min_gain": (0.0, float, 0, 1e6)},
}
TASKS = {"gene": ("distance", "mlp", "likelihood"), "species": ("distance", "mlp", "kernel")}


def defaults(task: str) -> dict:
    if task not in TASKS:
        raise ValueError(f"unknown task {task!r}")
    return {"version": VERSION, "task": task, "apnj": {k: v[0] for k, v in JOIN.items()},
            "stages": [{"id": s, "enabled": True, **{k: v[0] for k, v in STAGES[s].items()}} for s in TASKS[task]]}


def _checked(values: dict, spec: dict, where: str) -> dict:
    extra = set(values) - set(spec)
    if extra:
        raise ValueError(f"{where}: unknown setting {sorted(extra)[0]}")
    out = {}
    for name, (default, kind, *limits) in spec.items():
        value = values.get(name, default)
        label = f"{where}.{name}"
        if value is None and default is None:
            out[name] = None
            continue
        if kind is str:
            good = isinstance(value, str)
        else:
            good = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
            good = good and (kind is float or isinstance(value, int))
        if not good:
            raise ValueError(f"{label} must be {'text' if kind is str else 'a finite ' + kind.__name__}")
        inside = value in limits[0] if len(limits) == 1 else limits[0] <= value <= limits[1]
        if not inside:
            raise ValueError(f"{label} is outside its range")
        out[name] = value
    return out


def normalize(settings: dict | None, task: str) -> dict:
    """Complete, checked settings; every stage of the task appears exactly once, in any order."""
    if settings is None:
        return defaults(task)
    if set(settings) - {"version", "task", "apnj", "stages"}:
        raise ValueError("unknown top-level setting")
    if settings.get("version") != VERSION or settings.get("task") != task:
        raise ValueError("version or task does not match")
    stages, out = settings.get("stages"), []
    if not isinstance(stages, list) or sorted(str(s.get("id")) for s in stages) != sorted(TASKS[task]):
        raise ValueError("list every stage of the task exactly once")
    for stage in stages:
        if not isinstance(stage.get("enabled"), bool):
            raise ValueError("enabled must be true or false")
        rest = {k: v for k, v in stage.items() if k not in ("id", "enabled")}
        out.append({"id": stage["id"], "enabled": stage["enabled"], **_checked(rest, STAGES[stage["id"]], stage["id"])})
    return {"version": VERSION, "task": task, "apnj": _checked(settings.get("apnj", {}), JOIN, "apnj"), "stages": out}
