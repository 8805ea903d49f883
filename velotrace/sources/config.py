"""Job settings: nested keys in indented text, with values taken from the environment."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping

_LINE = re.compile(r"^(\s*)([^\s#:][^:]*):(?:\s+(.*))?$")
_REFERENCE = re.compile(r"\$\{([^${}]+)\}")


def _value(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    text = re.sub(r"\s+#.*$", "", text)
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(text.lower(), text)


def parse_config(text: str, environment: Mapping[str, str] | None = None) -> dict:
    """Nested mappings of `key: value` lines, indented by level. `${env.NAME}` stands for a variable of the environment, `${a.b}` for another key; both may stand in longer values. An unknown one raises KeyError."""
    root: dict = {}
    levels: list[tuple[int, dict]] = [(-1, root)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = _LINE.match(line.rstrip())
        if not m:
            raise ValueError(f"not a key and a value: {line!r}")
        depth, key = len(m[1].expandtabs()), m[2].strip()
        while levels[-1][0] >= depth:
            levels.pop()
        if m[3] is None or not m[3].strip():
            levels[-1][1][key] = {}
            levels.append((depth, levels[-1][1][key]))
        else:
            levels[-1][1][key] = _value(m[3])
    known = {"env": dict(os.environ if environment is None else environment), **root}

    def look_up(path: str, seen: tuple[str, ...]):
        if path in seen:
            raise ValueError(f"{path} refers to itself")
        at = known
        for part in path.split("."):
            at = at[part]
        return resolve(at, (*seen, path))

    def resolve(value, seen: tuple[str, ...] = ()):
        if isinstance(value, dict):
            return {k: resolve(v, seen) for k, v in value.items()}
        if not isinstance(value, str):
            return value
        whole = _REFERENCE.fullmatch(value)
        if whole:
            return look_up(whole[1], seen)
        return _REFERENCE.sub(lambda m: str(look_up(m[1], seen)), value)

    return resolve(root)


def flat(config: dict, prefix: str = "") -> dict[str, object]:
    """Leaves by their dotted paths."""
    out: dict[str, object] = {}
    for k, v in config.items():
        out |= flat(v, f"{prefix}{k}.") if isinstance(v, dict) else {prefix + k: v}
    return out
