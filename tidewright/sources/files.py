"""Driver-side file helpers: safe archive extraction, configuration, report registry and stage markers."""

from __future__ import annotations

import json
import os
import re
import tarfile
import tempfile
import zipfile
from pathlib import Path

#: Report names and where they are written below the report folder.
REPORTS = {
    "corpus_stats": "stage_1/corpus_stats.json",
    "taxonomy_inventory": "stage_1/taxonomy_inventory.json",
    "coverage_matrix": "stage_1/coverage_matrix.json",
    "length_distribution": "stage_1/length_distribution.json",
    "dedup_report": "stage_1/dedup_report.json",
    "split_health": "stage_2/split_health.json",
    "slo": "stage_2/slo.json",
    "rule_baseline": "stage_2/rule_baseline.json",
    "classical_baseline": "stage_2/classical_baseline.json",
    "gate_summary": "stage_3/gate_summary.json",
    "augmented_inventory": "stage_3/augmented_inventory.json",
    "token_leakage": "stage_3/token_leakage.json",
    "tokenizer_metrics": "stage_4/tokenizer_metrics.json",
    "canary_gate": "stage_6/canary_gate.json",
    "detection_metrics": "stage_7/detection_metrics.json",
    "robustness": "stage_7/robustness.json",
    "master_table": "stage_7/master_table.csv",
    "deployment": "stage_7/deployment.json",
}


def report_path(root: str, name: str) -> str:
    """Where a report goes; unknown names go to _unfiled."""
    return f"{root.rstrip('/')}/{REPORTS.get(name, f'_unfiled/{name}.json')}"


def report_status(root: str) -> list[tuple[str, str, bool]]:
    """Of each known report: name, path below the root, and whether it is there and can be read."""
    readable = lambda p: load_json(p) is not None if p.endswith(".json") else done(p)
    return [(name, place, readable(report_path(root, name))) for name, place in REPORTS.items()]


def expand_env(value):
    """Replaces ${NAME} in every string of a nested configuration; unset names become empty."""
    if isinstance(value, str):
        return re.sub(r"\$\{([A-Za-z_][A-Za-z0-9_]*)\}", lambda m: os.environ.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: expand_env(v) for k, v in value.items()}
    return [expand_env(v) for v in value] if isinstance(value, list) else value


def checked_config(config: dict) -> dict:
    """The configuration, or a ValueError where shares, heads or weights don't fit."""
    config = expand_env(config)
    if (s := config.get("splits")) and abs(sum(s.values()) - 1) > 1e-4:
        raise ValueError(f"splits sum to {sum(s.values())}")
    if (m := config.get("model")) and m["d_model"] % m["n_heads"]:
        raise ValueError("d_model is no multiple of n_heads")
    if (d := config.get("distillation")) and abs(d["alpha_hard"] + d["alpha_soft"] - 1) > 1e-4:
        raise ValueError("alphas do not sum to 1")
    return config


def load_json(path: str):
    """The content of a JSON file, None where it is missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def extract(archive: str, folder: str) -> list[str]:
    """Unpacks a zip or tar file, or copies any other, and gives the files; members that leave the folder raise."""
    target = Path(folder).resolve()
    target.mkdir(parents=True, exist_ok=True)
    if zipfile.is_zipfile(archive):
        with zipfile.ZipFile(archive) as z:
            for name in z.namelist():
                if not (target / name).resolve().is_relative_to(target):
                    raise ValueError(f"{name} leaves the folder")
            z.extractall(target)
    elif tarfile.is_tarfile(archive):
        with tarfile.open(archive) as t:
            t.extractall(target, filter="data")
    else:
        write_atomic(str(target / Path(archive).name), Path(archive).read_bytes())
    return sorted(str(p) for p in target.rglob("*") if p.is_file())


def write_atomic(path: str, content: bytes) -> None:
    """Writes to a file beside the target, which then takes its place."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=Path(path).parent, delete=False) as f:
        f.write(content)
    os.replace(f.name, path)


def missing_inputs(paths: list[str]) -> list[str]:
    return [p for p in paths if not os.path.exists(p)]


def done(path: str, force: bool = False) -> bool:
    """Whether an output is there and not empty: a file with content, or a folder that Spark finished."""
    p = Path(path)
    return not force and (p.is_file() and p.stat().st_size > 0 or (p / "_SUCCESS").exists())
