"""Result envelopes in YAML, in the order of insertion."""

from __future__ import annotations

from typing import Any

import yaml


def success(command: str, result: Any, total: int | None = None, limit: int | None = None) -> str:
    out = {"ok": True, "command": command, "result": result}
    if total is not None and limit is not None:
        out |= {"total": total, "truncated": True, "limit": limit}
    return yaml.dump(out, default_flow_style=False, sort_keys=False, allow_unicode=True)


def failure(command: str, error: str, suggestion: str | None = None) -> str:
    out = {"ok": False, "command": command, "error": error} | ({} if suggestion is None else {"suggestion": suggestion})
    return yaml.dump(out, default_flow_style=False, sort_keys=False, allow_unicode=True)
