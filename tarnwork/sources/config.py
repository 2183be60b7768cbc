"""Training recipes (YAML) and model registries (TOML), read on the driver."""

from __future__ import annotations

import tomllib
from pathlib import Path

try:
    import yaml
except ImportError:  # a recipe's small subset of YAML is read without the library
    yaml = None


def _scalar(text: str):
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "": None}.get(text.lower(), text)


def _indented(text: str) -> dict:
    """Nested `key: value` lines by indentation, with inline lists; comments are left out."""
    root: dict = {}
    stack: list[tuple[int, dict]] = [(-1, root)]
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip()
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth = len(line) - len(line.lstrip())
        key, _, value = line.strip().partition(":")
        while stack[-1][0] >= depth:
            stack.pop()
        if value.strip():
            stack[-1][1][key] = _scalar(value)
        else:
            child: dict = {}
            stack[-1][1][key] = child
            stack.append((depth, child))
    return root


def read_recipe(path: str) -> dict:
    """version, embedding_model and projections {name: {layers, epochs, batch_size}}."""
    text = Path(path).read_text()
    recipe = yaml.safe_load(text) if yaml is not None else _indented(text)
    for name, p in (recipe.get("projections") or {}).items():
        if len(p.get("layers", [])) < 2:
            raise ValueError(f"projection {name} needs at least two layers")
    return recipe


def read_registry(path: str) -> dict:
    return tomllib.loads(Path(path).read_text())
